"""Regular expressions compiled to minimal deterministic byte automata.

The syntax: literals, ``\\xHH``, ``\\`` escapes, classes ``[a-z_]``, groups, ``|``, ``? * +`` and ``{m}``,
``{m,}``, ``{m,n}``; ``(?i:...)`` is spelt by the flag ``fold`` for ASCII letters of a rule part in ``<...>``.
Patterns are parsed to a position-free Thompson graph, determinised by subset construction, and minimised by
refining partitions until stable. A table has one row of 256 next states per state, as one flat list in which
states are multiples of 256; state 0 is dead.
"""

from __future__ import annotations

from dataclasses import dataclass

_SPECIAL = set("()[]{}|?*+\\<>")


class _Graph:
    """States with byte-set moves and empty moves."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1


class _Parser:
    """Recursive descent to a tree of ("set", bytes), ("cat", [..]), ("or", [..]), ("rep", node, least, most)."""

    def __init__(self, pattern: str) -> None:
        self.p, self.i, self.fold = pattern, 0, False

    def parse(self):
        tree = self.choice()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def choice(self):
        branches = [self.row()]
        while self.peek() == "|":
            self.i += 1
            branches.append(self.row())
        return branches[0] if len(branches) == 1 else ("or", branches)

    def row(self):
        items = []
        while (c := self.peek()) and c not in "|)>":
            items.append(self.repeated())
        return ("cat", items)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            if c == "{":
                close = self.p.index("}", self.i)
                least, _, most = self.p[self.i + 1 : close].partition(",")
                node = ("rep", node, int(least), int(most) if most else None if "," in self.p[self.i : close] else int(least))
                self.i = close + 1
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
                self.i += 1
        return node

    def atom(self):
        c = self.peek()
        if c in "(<":
            self.i += 1
            self.fold = self.fold or c == "<"
            node = self.choice()
            if c == "<":
                self.fold = False
            self.i += 1
            return node
        if c == "[":
            self.i += 1
            negated = self.peek() == "^"
            self.i += negated
            chosen: set[int] = set()
            while self.peek() != "]":
                low = self.byte()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    chosen.update(range(low, self.byte() + 1))
                else:
                    chosen.add(low)
            self.i += 1
            return ("set", self.folded(set(range(256)) - chosen if negated else chosen))
        return ("set", self.folded({self.byte()}))

    def byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def folded(self, chosen: set[int]) -> frozenset[int]:
        if self.fold:
            chosen = chosen | {x ^ 32 for x in chosen if chr(x).isascii() and chr(x).isalpha()}
        return frozenset(chosen)


def _build(g: _Graph, tree, at: int, backward: bool) -> int:
    """Adds the tree's moves after state ``at``; the state they end in."""
    kind = tree[0]
    if kind == "set":
        to = g.state()
        g.moves[at].append((tree[1], to))
        return to
    if kind == "cat":
        for x in reversed(tree[1]) if backward else tree[1]:
            at = _build(g, x, at, backward)
        return at
    if kind == "or":
        end = g.state()
        for x in tree[1]:
            begin = g.state()
            g.empty[at].append(begin)
            g.empty[_build(g, x, begin, backward)].append(end)
        return end
    _, node, least, most = tree
    for _ in range(least):
        at = _build(g, node, at, backward)
    end = g.state()
    if most is None:
        loop = g.state()
        g.empty[at].append(loop)
        g.empty[_build(g, node, loop, backward)].append(loop)
        g.empty[loop].append(end)
    else:
        g.empty[at].append(end)
        for _ in range(most - least):
            at = _build(g, node, at, backward)
            g.empty[at].append(end)
    return end


@dataclass
class Automaton:
    table: list[int]  # next state of state s and byte b: table[s + b]
    start: int
    accepts: dict[int, tuple[int, ...]]  # state -> the patterns that end in it
    least_accept: int  # states from this on accept, those below don't


def compile_rules(patterns: list[str], anywhere: bool = False, backward: bool = False) -> Automaton:
    """One automaton for all patterns. anywhere: matches may start at any byte. backward: for reversed input."""
    g = _Graph()
    root = g.state()
    ends: dict[int, int] = {}
    for k, p in enumerate(patterns):
        begin = g.state()
        g.empty[root].append(begin)
        ends[_build(g, _Parser(p).parse(), begin, backward)] = k

    def closed(states: set[int]) -> frozenset[int]:
        todo = list(states)
        seen = set(states)
        while todo:
            for x in g.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if g.moves[x] or x in ends)

    # bytes that no pattern tells apart share a class
    sets = list(dict.fromkeys(s for m in g.moves for s, _ in m))
    sign: dict[tuple[bool, ...], int] = {}
    klass = [sign.setdefault(tuple(b in s for s in sets), len(sign)) for b in range(256)]
    sample = {k: b for b, k in reversed(list(enumerate(klass)))}

    by_class = [{k: t for k in sample if (t := {to for chosen, to in m if sample[k] in chosen})} for m in g.moves]
    first = closed({root})
    number = {frozenset(): 0, first: 1}
    rows: list[list[int]] = [[0] * len(sample), []]
    todo = [first]
    if anywhere:
        number = {first: 1}
        rows[0] = [1] * len(sample)  # not reached
    while todo:
        here = todo.pop()
        row = []
        for k in range(len(sample)):
            nxt = closed(set().union(*(by_class[s][k] for s in here if k in by_class[s]))) | (first if anywhere else frozenset())
            if nxt not in number:
                number[nxt] = len(rows)
                rows.append([])
                todo.append(nxt)
            row.append(number[nxt])
        rows[number[here]] = row

    ending: list[tuple[int, ...]] = [()] * len(rows)
    for states, n in number.items():
        ending[n] = tuple(sorted({ends[x] for x in states if x in ends}))

    # minimise: split blocks until states of a block agree on blocks of all successors
    block = [-1] * len(rows)
    names: dict = {}
    for n in range(len(rows)):
        block[n] = names.setdefault(ending[n], len(names))
    while True:
        names = {}
        new = [names.setdefault((block[n], *(block[x] for x in rows[n])), len(names)) for n in range(len(rows))]
        if len(set(new)) == len(set(block)):
            break
        block = new
    order: dict[int, int] = {block[0]: 0}
    for n in sorted(range(len(rows)), key=lambda n: bool(ending[n])):
        order.setdefault(block[n], len(order))
    table = [0] * (256 * len(order))
    accepts: dict[int, tuple[int, ...]] = {}
    for n in range(len(rows)):
        at = 256 * order[block[n]]
        table[at : at + 256] = [256 * order[block[rows[n][klass[b]]]] for b in range(256)]
        if ending[n]:
            accepts[at] = ending[n]
    return Automaton(table, 256 * order[block[1]], accepts, min(accepts, default=len(table)))
