import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sarani.llm.conversations import damaged, repair_conversations
from sarani.llm.role_stacks import Repair, Repairer, StackGraph

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}  # of (s?(ua)+)?
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """The repair by best-first search over places and states of the expression."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        if i == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(out)
        seen.add((i, state))
        for symbol, name in NAMES.items():
            if symbol in NEXT[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[state][symbol], (*out, name + ":")))
        if i < len(rows):
            role, text, must_go, cut = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if must_go:
                continue
            if role[:1] in NEXT[state]:
                heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, NEXT[state][role[:1]], (*out, f"{role}:{text}")))
            for symbol, name in NAMES.items():
                if symbol in NEXT[state]:
                    heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, NEXT[state][symbol], (*out, f"{name}:{text}")))


def all_edits(rows):
    """Every edit of few rows, with up to two turns inserted anywhere, held against the expression."""
    inserts = ["", "u", "a", "ua", "au"]
    best = None
    for actions in itertools.product(*[("D",) if r[2] else ("D", "K", "Ru", "Ra") for r in rows]):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            roles, audit, cost, out = "", "", 0, []
            for k, gap in enumerate(gaps):
                roles, audit, cost = roles + gap, audit + "I" * len(gap), cost + 3 * len(gap)
                out += [NAMES[c] + ":" for c in gap]
                if k == len(rows):
                    break
                role, text, _, cut = rows[k]
                action = actions[k]
                audit += action[0]
                if action == "D":
                    cost += 4
                    continue
                name = role if action == "K" else NAMES[action[1]]
                roles, cost = roles + (name[:1] or "?"), cost + 3 * cut + 3 * (action != "K")
                out.append(f"{name}:{text}")
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(out)
    return best


def parsed(rows):
    repair = Repair(Repairer(), lambda out, edit, symbol, row: (*out, NAMES[symbol] + ":" if edit == "I" else (NAMES[symbol] if edit == "R" else row[0]) + ":" + row[1]), ())
    for role, text, must_go, cut in rows:
        repair.add(role[:1], must_go, cut, (role, text))
    cost, audit, out = repair.result()
    return cost, audit, "\n".join(out)


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", ""]), f"t{i}", rng.random() < 0.2, rng.random() < 0.2) for i in range(n)]


def test_the_graph_accepts_the_role_grammar():
    graph = StackGraph(Repairer().graph.rules)
    for n in range(7):
        for symbols in itertools.product("sua", repeat=n):
            tops = {graph.root}
            for s in symbols:
                tops = {t for top in tops for t in graph.shift(top, s)}
            assert any(map(graph.accepts, tops)) == bool(re.fullmatch("(s?(ua)+)?", "".join(symbols)))
    assert len(graph.nodes) < 40  # stacks share their lower parts


def test_repairs_equal_every_edit_and_the_search():
    rng = random.Random(1)
    for _ in range(25):
        rows = random_rows(rng, rng.randrange(4))
        assert parsed(rows) == all_edits(rows) == cheapest(rows)
    for _ in range(400):
        rows = random_rows(rng, rng.randrange(14))
        assert parsed(rows) == cheapest(rows)


def test_another_grammar():
    repairer = Repairer((("S", "Q"), ("Q", "u"), ("Q", "Qau")))
    repair = Repair(repairer, lambda out, edit, symbol, row: out + symbol, "")
    for symbol in "uua":
        repair.add(symbol, False, False, None)
    assert repair.result() == (6, "KIKKI", "uauau")


def test_a_grammar_without_end_is_refused():
    with pytest.raises(ValueError):
        Repair(Repairer((("S", "A"), ("A", "uAa"), ("A", ""))), lambda out, *_: out, "").result()


def plain(rows, harm=True):
    """All columns of the query from its statement; rows are (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if harm else 9
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            own += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        faults, said, before, illegal, items = [], set(), None, 0, []
        for turn, role, text in own:
            core = text.strip(BLANKS)
            fault = "blank" if not core else "duplicate" if (role, text) in said else "truncated" if core[-1] not in ".!?" else ""
            said.add((role, text))
            faults.append(fault)
            illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            items.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, text = cheapest(items)
        out[conv] = (conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations(rng):
    roles, texts = ["user", "assistant", "system", "tool", None, ""], ["Yes.", "no", "", " \t", None, "naïve é!", "x\x85", "last?\n ", "a" * 5000]
    rows = [(c, t if rng.random() < 0.9 else t + 3, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {c} {t}{rng.choice('.!? ')}")
            for c in range(60) for t in range(rng.randrange(12))]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (700, None, "user", "Hi."), (701, 5, None, None), (702, -3, "user", "a."), (702, 2**62, "assistant", "b.")]
    rows += [(800, t, "user" if t % 2 else "assistant", f"line {t % 40}.") for t in range(600)]  # one long conversation
    rng.shuffle(rows)
    return rows


def test_jobs_equal_the_plain_version(spark):
    rows = conversations(random.Random(2))
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("mark", "nth", "cost", "audit", "gaps")])
    harmed = damaged(df)
    assert harmed.columns == ["conv_id", "turn", "role", "text", "times"]
    for found, want in ((repair_conversations(harmed, times=F.col("times")), plain(rows)), (repair_conversations(df), plain(rows, harm=False))):
        assert {r.conv_id: tuple(r) for r in found.collect()} == want


def test_repaired_texts(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Ho."), (1, 2, "assistant", ""), (2, 0, "assistant", "So.")]
    found = {r.conv_id: r for r in repair_conversations(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()}
    assert (found[1].audit, found[1].repaired) == ("KRD", "user:Hi.\nassistant:Ho.")
    assert (found[2].audit, found[2].cost, found[2].repaired) == ("IK", 3, "user:\nassistant:So.")
    assert found[1].repaired_sha256 == hashlib.sha256(found[1].repaired.encode()).hexdigest()


def test_conversations_without_rows_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(empty).count() == 0 and repair_conversations(damaged(empty), times=F.col("times")).count() == 0
    gone = spark.createDataFrame([(5, 0, "user", "Hi.")], SCHEMA)
    assert [tuple(r) for r in repair_conversations(gone, times=F.lit(0)).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("n", [20_000])
def test_a_long_conversation_is_parsed_in_linear_steps(n):
    repair = Repair(Repairer(), lambda out, edit, symbol, row: out, None)
    for k in range(n):
        repair.add("uas"[k % 5 % 3], k % 7 == 0, k % 3 == 0, None)
    cost, audit, _ = repair.result()
    assert len(audit.replace("I", "")) == n and cost > 0
