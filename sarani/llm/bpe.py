"""Encoding and decoding with a word-end BPE vocabulary through a minimal acyclic transducer.

1. Words of all documents are counted by Spark; the most frequent ones form the lexicon.
2. The lexicon is compiled into a minimal acyclic transducer: suffixes share states, and the
   numbers on a path sum up to the word's place in a table of ids.
3. The transducer is stored as arrays, sent to executors as a file and memory-mapped there.
4. Words outside the lexicon are merged exactly by merge rank. The lexicon thus never
   changes a result.

A text is cut into words as the vocabulary file says (canonical composition, lower case,
its pattern); marks of special tokens in a text become their ids.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from sarani.llm.common import chunks, keyed_texts
from sarani.llm.pair_table import PairTable, by_width, padded
from sarani.session import materialise

LEXICON_WORDS = 1 << 16
LONGEST_WORD = 64  # characters of a word in the lexicon
CHUNK = 2 << 20
SHORT_WORD = 64  # bytes of a word that is merged without a queue
FLUSH_WORDS = 200_000  # distinct words a counting task holds before it passes them on

# Below this code point, and in the listed block, composition changes nothing and lower
# case works character by character; other texts are cut by the tokenizer's own rules.
_PLAIN_END, _PLAIN_MARKS = 0x180, "‐-‧"


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable, else from code 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _is_latin(text: str) -> bool:
    """A fast test that covers most texts below the plain end."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Vocabulary:
    """Ids, merge ranks and the rules to cut words, read from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for word, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = word
        self.letters = byte_letters()
        rules = Tokenizer.from_file(path)
        self._normalise, self._cut = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self._shown = {c: b for b, c in enumerate(self.letters)}
        chars = [chr(c) for c in range(_PLAIN_END)]
        letters = "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == "L")
        numbers = "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == "N")
        blank = "\t-\r \x85\xa0"
        self._word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blank}{letters}{numbers}]+")
        self._plain = re.compile(f"[\0-{chr(_PLAIN_END - 1)}{_PLAIN_MARKS}]*")
        self._marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.merge = functools.lru_cache(maxsize=1 << 16)(self._merge)
        # For many words at once: the id of each byte, inside a word and at its end, and of each merge.
        self.inner, self.last = (np.array([self.ids.get(c + end, -1) for c in self.letters], np.int64) for end in ("", self.end))
        known = lambda a, b: a in self.ids and b in self.ids and a + b in self.ids
        self.pairs = PairTable({(self.ids[a], self.ids[b]): (self.ids[a + b], r) for (a, b), r in self.ranks.items() if known(a, b)})

    def words(self, text: str) -> list[str]:
        """The words in order; a special mark stays as it is in the text."""
        if self._marks and any(m in text for m in self.special):
            found = []
            for i, part in enumerate(self._marks.split(text)):
                found += [part] if i % 2 else self._words(part)
            return found
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii() or _is_latin(text) or self._plain.fullmatch(text):
            return self._word.findall(text.lower())
        return [bytes(self._shown[c] for c in piece).decode() for piece, _ in self._cut(self._normalise(text))]

    def _merge(self, word: str) -> tuple[int, ...]:
        """The ids of a word: neighbours merge by lowest rank, leftmost first."""
        if word in self.special:
            return (self.special[word],)
        parts: list[str | None] = [self.letters[b] for b in word.encode()]
        parts[-1] += self.end
        if len(parts) <= SHORT_WORD:
            return self._merge_short(parts)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(parts) and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(queue, (r, x, parts[x], parts[y]))
        return tuple(self.ids[p] for p in parts if p is not None)

    def merge_all(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word; short ones advance together."""
        out: list = [None] * len(words)
        data = [w.encode() if w not in self.special else b"" for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        for width, own in by_width(lengths, SHORT_WORD):
            symbols = padded(b"".join([data[i] for i in own.tolist()]), lengths[own], width, self.inner)
            symbols[np.arange(len(own)), lengths[own] - 1] = self.last[[data[i][-1] for i in own.tolist()]]
            if symbols[np.arange(width) < lengths[own][:, None]].min(initial=0) < 0:
                continue  # a letter without an id of its own: merged one by one

            def finish(rows: np.ndarray, done: np.ndarray, own: np.ndarray = own) -> None:
                held = done >= 0
                flat, ends = done[held].astype(np.uint32), np.cumsum(held.sum(axis=1)).tolist()
                low = 0
                for i, high in zip(own[rows].tolist(), ends):
                    out[i] = flat[low:high]
                    low = high

            self.pairs.merge(symbols, finish)
        return [np.array(self.merge(w), np.uint32) if ids is None else ids for w, ids in zip(words, out)]

    def _merge_short(self, parts: list[str]) -> tuple[int, ...]:
        """The same for few parts: the ranks of all pairs stand in a list."""
        rank_of, none = self.ranks.get, len(self.ranks)
        ranks = [rank_of(p, none) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), none)
        return tuple([self.ids[p] for p in parts])

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by a blank, as the library does for a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(entries: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic transducer of `entries` (words to ids).

    Words are added in byte order; a finished suffix is replaced by an equal one seen before,
    so that words share states. `skip` holds how many lexicon words lie before a transition:
    their sum on a path is the word's place, which points into `first` and `ids`.
    """
    words = sorted((w.encode(), ids) for w, ids in entries.items())
    arcs: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    known: dict[tuple, int] = {}
    path, previous = [0], b""

    def close(down_to: int) -> None:
        while len(path) - 1 > down_to:
            state = path.pop()
            form = (final[state], tuple(arcs[state].items()))
            arcs[path[-1]][previous[len(path) - 1]] = known.setdefault(form, state)

    for word, _ in words:
        same = len(os.path.commonprefix([word, previous]))
        close(same)
        for byte in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        previous = word
    close(0)

    order = {0: 0}  # reachable states, numbered
    stack = [0]
    while stack:
        for target in arcs[stack.pop()].values():
            if target not in order:
                order[target] = len(order)
                stack.append(target)
    counts: dict[int, int] = {}

    def count(root: int) -> None:
        todo = [root]
        while todo:
            state = todo[-1]
            missing = [t for t in arcs[state].values() if t not in counts]
            if missing:
                todo += missing
            else:
                counts[state] = final[state] + sum(counts[t] for t in arcs[state].values())
                todo.pop()

    count(0)
    used = sorted({b for s in order for b in arcs[s]})
    symbol = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
    symbol[used] = np.arange(1, len(used) + 1)
    target = np.full((len(order) + 1, len(used) + 1), len(order), np.int32)  # the last state is the dead one
    skip = np.zeros_like(target)
    for state, number in order.items():
        before = int(final[state])
        for byte in sorted(arcs[state]):
            target[number, symbol[byte]] = order[arcs[state][byte]]
            skip[number, symbol[byte]] = before
            before += counts[arcs[state][byte]]
    ends = np.zeros(len(order) + 1, bool)
    ends[[order[s] for s in order if final[s]]] = True
    lengths = [len(ids) for _, ids in words]
    return {
        "symbol": symbol, "target": target, "skip": skip, "ends": ends,
        "first": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
        "ids": np.array([i for _, ids in words for i in ids], np.uint32),
    }


class Lexicon:
    """A compiled transducer whose arrays are memory-mapped from one file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = json.loads(f.readline())
            start = f.tell()
        for name, (kind, shape, at) in head.items():
            size = int(np.prod(shape))
            array = np.memmap(path, kind, "r", start + at, tuple(shape)) if size else np.zeros(shape, kind)
            setattr(self, name, array)

    @staticmethod
    def save(arrays: dict[str, np.ndarray], path: str) -> None:
        head, at = {}, 0
        for name, a in arrays.items():
            head[name] = (a.dtype.str, list(a.shape), at)
            at += -(-a.nbytes // 16) * 16
        with open(path, "wb") as f:
            f.write(json.dumps(head).encode() + b"\n")
            for a in arrays.values():
                f.write(a.tobytes() + bytes(-a.nbytes % 16))

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word in the lexicon, or -1: all words walk the automaton together."""
        data = [w.encode() for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        falling = -lengths[order]
        state, place = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        dead, live = len(self.ends) - 1, order
        for step in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > step]
            if not len(live):
                break
            letter = self.symbol[flat[starts[live] + step]]
            place[live] += self.skip[state[live], letter]
            state[live] = self.target[state[live], letter]
            live = live[state[live] != dead]
        return np.where(self.ends[state], place, -1)


@functools.lru_cache(maxsize=2)
def lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def frequent_words(texts: DataFrame, path: str, size: int) -> list[str]:
    """The most frequent words of all texts, at most `size`: all words from a certain count on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, held = vocabulary(path), Counter()
        for chunk in chunks(batches, "text", CHUNK):
            for text in chunk.column("text").to_pylist():
                held.update(vocab.words(text))
            if len(held) > FLUSH_WORDS:
                yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                held = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(held, pa.string()), "n": pa.array(held.values(), pa.int64())})

    counted = texts.select("text").mapInArrow(count, "word string, n long")
    words = counted.where(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.sum("n").alias("n"))
    words = materialise(words.withColumn("step", F.floor(8 * F.log2("n"))), "word-counts")
    # Steps of the count, largest first, as long as all their words fit.
    held, least = 0, None
    for step, found in sorted(words.groupBy("step").count().collect(), reverse=True):
        held += found
        if held > size:
            break
        least = step
    return [] if least is None else [r.word for r in words.where(F.col("step") >= least).select("word").collect()]


def send_lexicon(docs: DataFrame, words: list[str], vocab: Vocabulary) -> str:
    """Compiles and stores the lexicon, adds it to the files of the job, and gives its name."""
    path = f"{tempfile.mkdtemp(prefix='lexicon-')}/lexicon-{uuid.uuid4().hex}.bin"
    Lexicon.save(compile_lexicon({w: vocab._merge(w) for w in words if w not in vocab.special}), path)
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_words(words: list[str], vocab: Vocabulary, known: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and where each word's ids end."""
    places = known.places(words)
    unseen = np.flatnonzero(places < 0).tolist()
    rest = dict(zip(unseen, vocab.merge_all([words[i] for i in unseen])))
    lengths = np.where(places >= 0, known.first[np.maximum(places, 0) + 1] - known.first[np.maximum(places, 0)], 0) if len(known.ids) else np.zeros(len(words), np.int64)
    for i, ids in rest.items():
        lengths[i] = len(ids)
    ends = np.cumsum(lengths)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    held = np.flatnonzero(places >= 0)
    out[ragged(ends[held] - lengths[held], lengths[held])] = known.ids[ragged(known.first[places[held]], lengths[held])]
    for i, ids in rest.items():
        out[ends[i] - len(ids) : ends[i]] = ids
    return out, ends


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[i], ..., starts[i] + lengths[i] - 1 for all i in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def encode_texts(texts: list[str], vocab: Vocabulary, known: Lexicon, decode: bool = False) -> tuple[list[np.ndarray], list[str]]:
    """The ids of each text and, as asked for, their decoded text; each distinct word is
    looked up, and its ids decoded, once."""
    cut = [vocab.words(t) for t in texts]
    distinct = list({w for ws in cut for w in ws})
    place = dict(zip(distinct, range(len(distinct))))
    ids, ends = encode_words(distinct, vocab, known)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    held = ids.tolist() if decode else []
    decoded = [vocab.decode(held[a:b]) for a, b in zip(starts.tolist(), ends.tolist())] if decode else []
    found, out = [], []
    for ws in cut:
        places = [place[w] for w in ws]
        which = np.array(places, np.int64)
        found.append(ids[ragged(starts[which], ends[which] - starts[which])] if len(ws) else np.zeros(0, np.uint32))
        if decode:
            out.append(" ".join([decoded[i] for i in places]))
    return found, out


def bpe_encode(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", lexicon_words: int = LEXICON_WORDS,
    with_ids: bool = True, digests: bool = True,
) -> DataFrame:
    """doc_id, n_tokens and, as asked for, ids (array<long>) or digests of ids and decoded text.

    `path` is the vocabulary file, at the same place on every machine. ids_sha256 is taken
    from the ids as little-endian 32-bit numbers, decoded_sha256 from the decoded text.
    Null and empty texts have no tokens and decode to an empty text. Every input row gives a
    row, repeated ids too; other columns are not read.
    """
    texts = keyed_texts(docs, key, text)
    name = send_lexicon(docs, frequent_words(texts, path, lexicon_words), vocabulary(path))
    schema = "doc_id long, n_tokens long" + ", ids array<long>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary(path), lexicon(name)
        for chunk in chunks(batches, "text", CHUNK):
            found, decoded = encode_texts(chunk.column("text").to_pylist(), vocab, known, digests)
            out = {"doc_id": chunk.column("doc_id"), "n_tokens": pa.array(map(len, found), pa.int64())}
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(i) for i in found])]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).astype(np.int64)))
            if digests:
                out["ids_sha256"] = pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in found])
                out["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])
            yield pa.RecordBatch.from_pydict(out)

    return texts.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the decoded text of a column of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    chosen = encoded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<long>").alias("ids"))
    return chosen.mapInArrow(run, "doc_id long, text string")
