"""Regular expressions over bytes to one minimal deterministic automaton for all of them.

The syntax is that of Python's re, as far as rules need it: literals, ``\\xHH`` and escaped signs,
classes, groups, ``|``, ``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

ALL = (1 << 256) - 1


class _Parser:
    """Recursive descent to a tree of ("set", bits), ("cat", ...), ("or", ...), ("rep", node, low, high)."""

    def __init__(self, pattern: str, any_case: bool):
        self.p, self.i, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def parse(self):
        node = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"can't parse {self.p!r} at {self.i}")
        return node

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            if self.p[self.i : self.i + 2] == "?:":
                self.i += 2
            node = self.alternatives()
            self.take()
            return node
        if c == "[":
            return ("set", self.cases(self.char_class()))
        return ("set", self.cases(1 << self.code(c)))

    def code(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def char_class(self) -> int:
        bits, negated = 0, self.peek() == "^"
        self.i += negated
        while (c := self.take()) != "]":
            low = self.code(c)
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                high = self.code(self.take())
                bits |= ((1 << (high + 1)) - 1) ^ ((1 << low) - 1)
            else:
                bits |= 1 << low
        return ALL ^ bits if negated else bits

    def cases(self, bits: int) -> int:
        if self.any_case:
            for k in range(26):
                if bits >> (65 + k) & 1 or bits >> (97 + k) & 1:
                    bits |= 1 << (65 + k) | 1 << (97 + k)
        return bits


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[int, int]]] = []
        self.accept: dict[int, int] = {}

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def build(self, node, start: int) -> int:
        """The end state of node when it begins at start."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.edges[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.build(part, start)
            return start
        if kind == "or":
            end = self.state()
            for option in node[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.build(option, begin)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.build(inner, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.build(inner, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.build(inner, start)
            self.empty[start].append(end)
        return end


@dataclass
class Automaton:
    """table[state * n_classes + classes[byte]] is the next state, from state 0; masks has the rules that end in a state.

    dead is the state that nothing leaves and nothing ends in, -1 if there is none.
    """

    table: np.ndarray
    classes: np.ndarray
    masks: np.ndarray
    n_classes: int
    dead: int = -1

    def longest(self, data: bytes, start: int, end: int) -> int | None:
        """Where the longest match of data from start towards end stops; backwards if end is less.  None without a match."""
        table, classes, masks, k = self._lists
        state, best, step = 0, None, 1 if end >= start else -1
        for i in range(start, end, step):
            state = table[state * k + classes[data[i] if step > 0 else data[i - 1]]]
            if state == self.dead:
                break
            if masks[state]:
                best = i + step
        return best

    @functools.cached_property
    def _lists(self):
        return self.table.tolist(), self.classes.tolist(), self.masks.tolist(), self.n_classes

    @property
    def resets(self) -> np.ndarray:
        """Bytes after which every state is the first one: no match of any rule holds them."""
        t = self.table.reshape(-1, self.n_classes)
        return (t == 0).all(axis=0)[self.classes]


def _reversed(node):
    if node[0] == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if node[0] == "or":
        return ("or", [_reversed(x) for x in node[1]])
    return ("rep", _reversed(node[1]), *node[2:]) if node[0] == "rep" else node


def compile_rules(rules: list[tuple[str, bool]], max_states: int = 100_000, anchored: bool = False, backwards: bool = False) -> Automaton:
    """One automaton that finds where any of the (pattern, any_case) rules ends, wherever it begins; anchored:
    only from the first byte; backwards: of the reversed patterns."""
    nfa = _Nfa()
    first = nfa.state()
    for k, (pattern, any_case) in enumerate(rules):
        begin = nfa.state()
        nfa.empty[first].append(begin)
        tree = _Parser(pattern, any_case).parse()
        end = nfa.build(_reversed(tree) if backwards else tree, begin)
        nfa.accept[end] = nfa.accept.get(end, 0) | 1 << k
    # Bytes that no edge tells apart are one class.
    sets = sorted({bits for edges in nfa.edges for bits, _ in edges})
    of_byte = [tuple(bits >> b & 1 for bits in sets) for b in range(256)]
    kinds = {kind: k for k, kind in enumerate(dict.fromkeys(of_byte))}
    classes = np.array([kinds[x] for x in of_byte], "u1")
    members = [[kind[j] for kind in kinds] for j in range(len(sets))]
    in_class = {bits: [c for c, x in enumerate(members[j]) if x] for j, bits in enumerate(sets)}

    closures: dict[int, frozenset[int]] = {}

    def closure(state: int) -> frozenset[int]:
        if state not in closures:
            seen, todo = {state}, [state]
            while todo:
                for nxt in nfa.empty[todo.pop()]:
                    if nxt not in seen:
                        seen.add(nxt)
                        todo.append(nxt)
            # Only states that read a byte or accept tell sets apart.
            closures[state] = frozenset(s for s in seen if nfa.edges[s] or s in nfa.accept)
        return closures[state]

    moves: dict[int, dict[int, set[int]]] = {}

    def moves_of(state: int) -> dict[int, set[int]]:
        if state not in moves:
            own: dict[int, set[int]] = {}
            for bits, to in nfa.edges[state]:
                for c in in_class[bits]:
                    own.setdefault(c, set()).update(closure(to))
            moves[state] = own
        return moves[state]

    start = closure(first)
    numbers, order, rows = {start: 0}, [start], []
    for current in order:
        targets = [set() if anchored else set(start) for _ in kinds]
        for state in current:
            for c, to in moves_of(state).items():
                targets[c] |= to
        row = []
        for target in map(frozenset, targets):
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
                if len(order) > max_states:
                    raise ValueError("too many states")
            row.append(numbers[target])
        rows.append(row)
    table = np.array(rows, "i4")
    masks = np.zeros(len(order), "i4")
    for k, states in enumerate(order):
        for s in states:
            masks[k] |= nfa.accept.get(s, 0)
    # Minimisation: refine the partition by masks until no class splits.
    part, n = np.unique(masks, return_inverse=True)[1], 0
    while True:
        keyed = np.column_stack([part, part[table]])
        _, index, part = np.unique(keyed, axis=0, return_index=True, return_inverse=True)
        part = part.reshape(-1)
        if len(index) == n:
            break
        n = len(index)
    # The first state becomes 0.
    swap = np.arange(n)
    swap[[0, part[0]]] = swap[[part[0], 0]]
    part, small, ends = swap[part], np.empty((n, len(kinds)), "i4"), np.empty(n, "i4")
    small[part], ends[part] = part[table], masks
    dead = np.flatnonzero((small == np.arange(n)[:, None]).all(axis=1) & (ends == 0))
    return Automaton(small.reshape(-1), classes, ends, len(kinds), int(dead[0]) if anchored and len(dead) else -1)


#: Bytes a lane has at most before it goes on alone; aim of a lane.
LANE, LONG = 512, 16384


def scan(automaton: Automaton, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, masks): every byte of data after which rules end, in order, and which; one pass over all bytes.

    data is cut after bytes that reset the automaton, into lanes that advance in step.
    """
    n = len(data)
    if not n:
        return np.zeros(0, "i8"), np.zeros(0, "i4")
    cuts = np.flatnonzero(automaton.resets[data] & (data < 128)) + 1
    aims = np.searchsorted(cuts, np.arange(LANE, n, LANE))
    starts = np.unique(np.concatenate([[0], cuts[aims[aims < len(cuts)]]]))
    starts = starts[starts < n]
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    symbols, table, masks, k = automaton.classes[data], automaton.table * automaton.n_classes, automaton.masks, automaton.n_classes
    mask_of = np.zeros(len(table), "i4")
    mask_of[::k] = masks
    places, found, state = [np.zeros(0, "i8")], [np.zeros(0, "i4")], np.zeros(len(starts), "i4")
    alone = int((lengths > LONG).sum())
    # Lanes by falling length: the first `active` ones still have a byte at j.
    active_at = np.searchsorted(-lengths, -np.arange(min(int(lengths[0]), LONG)) - 1, side="right")
    for j, active in enumerate(active_at.tolist()):
        at = starts[alone:active] + j
        s = table[state[alone:active] + symbols[at]]
        state[alone:active] = s
        own = mask_of[s]
        hit = np.flatnonzero(own)
        if len(hit):
            places.append(at[hit])
            found.append(own[hit])
    if alone:
        steps, ends = table.tolist(), mask_of.tolist()
        for lane in range(alone):
            s, at, own = 0, [], []
            for i, c in enumerate(symbols[starts[lane] : starts[lane] + lengths[lane]].tolist(), int(starts[lane])):
                s = steps[s + c]
                if ends[s]:
                    at.append(i)
                    own.append(ends[s])
            places.append(np.array(at, "i8"))
            found.append(np.array(own, "i4"))
    at, own = np.concatenate(places), np.concatenate(found)
    order = np.argsort(at)
    return at[order], own[order]
