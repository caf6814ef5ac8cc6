"""Cheapest repairs of a sequence of symbols by generalised LR parsing.

A small LR(0) automaton is built from a grammar. Stacks are nodes of a graph: a node is a state
and the node below it, and equal nodes are one, so stacks share their lower parts and keep them
when several actions apply. At every place of the sequence each node on top holds only its
cheapest way, by (cost, audit): keep, change (rerole), delete and insert are weighted actions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

Rule = tuple[str, str]

# Nonterminals are upper case; the first rule's left side is the start.
ROLE_RULES: tuple[Rule, ...] = (("S", ""), ("S", "T"), ("S", "sT"), ("T", "P"), ("T", "TP"), ("P", "ua"))
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # fixed costs; keeping is free
STEPS_HELD = 50_000
MOST_NODES = 1000


class StackGraph:
    """The automaton of a grammar and its graph of stacks; nodes are numbers, the root is 0.

    A grammar may have only so many different stacks, as with left recursion; nested ones, whose
    stacks have no end, raise ValueError.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.rules = tuple(rules)
        self.start = self.rules[0][0]
        self.terminals = sorted({c for _, right in self.rules for c in right if c.islower()})
        self._states: dict[frozenset, int] = {}
        self._goto: list[dict[str, int]] = []
        self._complete: list[list[int]] = []
        self._state(frozenset((r, 0) for r, (left, _) in enumerate(self.rules) if left == self.start))
        self.nodes: list[tuple[int, int]] = []  # state, node below
        self._number: dict[tuple[int, int], int] = {}
        self._shifted: dict[tuple[int, str], tuple[int, ...]] = {}
        self.root = self._node(0, -1)

    def _closure(self, items: frozenset) -> frozenset:
        found, work = set(items), list(items)
        while work:
            r, dot = work.pop()
            for k, (left, _) in enumerate(self.rules):
                if self.rules[r][1][dot : dot + 1] == left and (k, 0) not in found:
                    found.add((k, 0))
                    work.append((k, 0))
        return frozenset(found)

    def _state(self, kernel: frozenset) -> int:
        items = self._closure(kernel)
        if items in self._states:
            return self._states[items]
        number = self._states[items] = len(self._states)
        self._goto.append({})
        self._complete.append([r for r, dot in items if dot == len(self.rules[r][1])])
        after: dict[str, set] = {}
        for r, dot in items:
            if dot < len(self.rules[r][1]):
                after.setdefault(self.rules[r][1][dot], set()).add((r, dot + 1))
        for symbol, moved in sorted(after.items()):
            self._goto[number][symbol] = self._state(frozenset(moved))
        return number

    def _node(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self._number:
            if len(self.nodes) >= MOST_NODES:
                raise ValueError("the grammar has too many different stacks")
            self._number[key] = len(self.nodes)
            self.nodes.append(key)
        return self._number[key]

    def _base(self, node: int, length: int) -> int:
        for _ in range(length):
            node = self.nodes[node][1]
        return node

    def accepts(self, node: int) -> bool:
        """Whether a rule of the start symbol is complete with nothing below it."""
        return any(self.rules[r][0] == self.start and self._base(node, len(self.rules[r][1])) == self.root for r in self._complete[self.nodes[node][0]])

    def shift(self, node: int, symbol: str) -> tuple[int, ...]:
        """The tops after a symbol and all reductions, without tops that can neither go on nor end."""
        found = self._shifted.get((node, symbol))
        if found is not None:
            return found
        state = self._goto[self.nodes[node][0]].get(symbol)
        work = [] if state is None else [self._node(state, node)]
        tops = set(work)
        while work:
            top = work.pop()
            for r in self._complete[self.nodes[top][0]]:
                left, right = self.rules[r]
                base = self._base(top, len(right))
                to = self._goto[self.nodes[base][0]].get(left)
                if to is not None and (new := self._node(to, base)) not in tops:
                    tops.add(new)
                    work.append(new)
        live = (t for t in sorted(tops) if self.accepts(t) or any(s in self._goto[self.nodes[t][0]] for s in self.terminals))
        return self._shifted.setdefault((node, symbol), tuple(live))


# A way to a top: cost, rank of its audit at the row before, edits since, the top at the row
# before, symbols of these edits ("-" for a deleted row).
Way = tuple[int, int, str, int, str]


class Repairer:
    """Ways from a row to the next, for any sequence; steps between equal sets of ways are kept."""

    def __init__(self, rules: Iterable[Rule] = ROLE_RULES, inserted: str = "ua"):
        self.graph, self.inserted = StackGraph(rules), inserted
        self._steps: dict[tuple, tuple] = {}

    def _with_inserts(self, ways: tuple[tuple[int, int, int], ...]) -> dict[int, Way]:
        best: dict[int, Way] = {node: (cost, rank, "", node, "") for node, cost, rank in ways}
        work = list(best)
        while work:
            node = work.pop()
            cost, rank, edits, source, made = best[node]
            for symbol in self.inserted:
                for top in self.graph.shift(node, symbol):
                    way = (cost + INSERT, rank, edits + "I", source, made + symbol)
                    if top not in best or way < best[top]:
                        best[top] = way
                        work.append(top)
        return best

    def step(self, ways: tuple[tuple[int, int, int], ...], symbol: str, must_go: bool, truncated: bool) -> tuple[tuple[int, Way], ...]:
        """The cheapest way to each top after a row; `ways` are (top, cost, rank) before it.

        Audits before the row end with an edit of a row, so none begins another one, and the
        rank of the audit with the edits since decides as the whole audits would.
        """
        key = (ways, symbol, must_go, truncated)
        found = self._steps.get(key)
        if found is None:
            best: dict[int, Way] = {}

            def offer(top: int, way: Way) -> None:
                if top not in best or way < best[top]:
                    best[top] = way

            extra = TRUNCATED * truncated
            for node, (cost, rank, edits, source, made) in self._with_inserts(ways).items():
                offer(node, (cost + DELETE, rank, edits + "D", source, made + "-"))
                if must_go:
                    continue
                for top in self.graph.shift(node, symbol):
                    offer(top, (cost + extra, rank, edits + "K", source, made + symbol))
                for other in self.inserted:
                    if other != symbol:
                        for top in self.graph.shift(node, other):
                            offer(top, (cost + REROLE + extra, rank, edits + "R", source, made + other))
            if len(self._steps) >= STEPS_HELD:
                self._steps.clear()
            found = self._steps[key] = tuple(sorted(best.items()))
        return found

    def last(self, ways: tuple[tuple[int, int, int], ...]) -> Way:
        """The cheapest way to an accepted sequence after the last row."""
        return min(way for node, way in self._with_inserts(ways).items() if self.graph.accepts(node))


class Repair:
    """The repair of one sequence, row by row; `write` extends what a way has written.

    write(written, edit, symbol, row) returns a new value and leaves the old one as it is.
    Memory per row is one link of the audit; ways that lose are freed.
    """

    def __init__(self, repairer: Repairer, write: Callable, empty):
        self.repairer, self.write = repairer, write
        root = repairer.graph.root
        self.least = 0  # costs in `ways` count from here
        self.ways: tuple[tuple[int, int, int], ...] = ((root, 0, 0),)
        self.held = {root: (None, empty)}  # the audit as (audit before, edits), and what is written

    def _extended(self, way: Way, row) -> tuple:
        _, _, edits, source, made = way
        audit, written = self.held[source]
        for edit, symbol in zip(edits, made):
            if edit != "D":
                written = self.write(written, edit, symbol, row)
        return (audit, edits) if edits else audit, written

    def add(self, symbol: str, must_go: bool, truncated: bool, row) -> None:
        found = self.repairer.step(self.ways, symbol, must_go, truncated)
        rank = {audit: k for k, audit in enumerate(sorted({way[1:3] for _, way in found}))}
        least = min(way[0] for _, way in found)
        self.held = {top: self._extended(way, row) for top, way in found}
        self.ways = tuple((top, way[0] - least, rank[way[1:3]]) for top, way in found)
        self.least += least

    def result(self) -> tuple[int, str, object]:
        """Cost, audit and what is written."""
        way = self.repairer.last(self.ways)
        link, written = self._extended(way, None)
        edits = []
        while link is not None:
            link, more = link
            edits.append(more)
        return self.least + way[0], "".join(reversed(edits)), written
