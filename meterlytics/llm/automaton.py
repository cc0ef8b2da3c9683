"""One deterministic automaton for many byte patterns.

``compile_rules`` parses each rule (literals, classes, groups, ``|``, ``?``,
``*``, ``+``, ``{m,n}``; the part of the regex language that is regular),
builds one nondeterministic automaton with an unanchored start for all rules,
determinises it by subset construction over byte classes and minimises it by
partition refinement. The result is a transition array, a byte class array and
an array of the rules that accept in each state.

``scan`` runs it over a byte array in one pass. The pass is cut into lanes at
reset bytes, those that no rule reads at any place and that therefore send
every state back to the start, so all lanes step together and no match is split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ESCAPES = {"n": 10, "r": 13, "t": 9}


class _Parser:
    """Regular expression text to a tree over byte sets."""

    def __init__(self, text: str, fold: bool):
        self.s, self.i, self.fold = text, 0, fold

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"pattern ends early: {self.s!r}")
        self.i += 1
        return c

    def alternation(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeat(self.atom()))
        return ("seq", items)

    def repeat(self, node):
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                low = self.number()
                high: int | None = low
                if self.peek() == ",":
                    self.take()
                    high = self.number() if self.peek().isdigit() else None
                if self.take() != "}" or low is None:
                    raise ValueError(f"bad repeat in {self.s!r}")
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, low, high)
        return node

    def number(self) -> int | None:
        at = self.i
        while self.peek().isdigit():
            self.i += 1
        return int(self.s[at:self.i]) if self.i > at else None

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        return _ESCAPES.get(c) or ord(c)

    def byte_set(self, codes) -> tuple:
        out = set()
        for b in codes:
            if b > 127:
                raise ValueError("only ASCII patterns are supported")
            out.add(b)
            if self.fold and chr(b).isalpha():
                out.update((ord(chr(b).lower()), ord(chr(b).upper())))
        return ("set", frozenset(out))

    def atom(self):
        c = self.take()
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            node = self.alternation()
            if self.take() != ")":
                raise ValueError(f"unbalanced group in {self.s!r}")
            return node
        if c == "[":
            codes: list[int] = []
            while self.peek() != "]":
                lo = self.code()
                if self.peek() == "-" and self.s[self.i + 1:self.i + 2] != "]":
                    self.take()
                    codes.extend(range(lo, self.code() + 1))
                else:
                    codes.append(lo)
            self.take()
            return self.byte_set(codes)
        if c in "^$.":
            raise ValueError(f"{c!r} is not supported in {self.s!r}")
        return self.byte_set([self.escaped() if c == "\\" else ord(c)])

    def code(self) -> int:
        c = self.take()
        return self.escaped() if c == "\\" else ord(c)


class _Nfa:
    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def build(self, node, a: int) -> int:
        """Add ``node`` from state ``a``; the state after it."""
        kind = node[0]
        if kind == "set":
            b = self.state()
            self.edges[a].append((node[1], b))
            return b
        if kind == "seq":
            for x in node[1]:
                a = self.build(x, a)
            return a
        if kind == "or":
            end = self.state()
            for x in node[1]:
                start = self.state()
                self.free[a].append(start)
                self.free[self.build(x, start)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            a = self.build(inner, a)
        if high is None:
            loop = self.state()
            self.free[a].append(loop)
            self.free[self.build(inner, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(high - low):
            self.free[a].append(end)
            a = self.build(inner, a)
        self.free[a].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    classes: np.ndarray      # byte -> class
    table: np.ndarray        # state * n_classes + class -> state * n_classes
    n_classes: int
    first_accept: int        # states from this one on (times n_classes) accept
    accepts: np.ndarray      # state -> bit mask of rules
    resets: np.ndarray       # byte -> is it read by no rule (back to the start)

    @property
    def states(self) -> int:
        return len(self.accepts)


def parse(text: str, fold: bool):
    p = _Parser(text, fold)
    node = p.alternation()
    if p.i != len(text):
        raise ValueError(f"unbalanced group in {text!r}")
    return node


def alphabet(node) -> frozenset:
    """Bytes that a parsed rule reads at any place."""
    if node[0] == "set":
        return node[1]
    parts = [node[1]] if node[0] == "rep" else node[1]
    return frozenset().union(*map(alphabet, parts))


def compile_rules(rules: list[tuple[str, bool]], also: list[tuple[str, bool]] = ()) -> Automaton:
    """``rules``: (pattern, letters in either case). Rule k sets bit k. Bytes
    that the patterns ``also`` read are no reset bytes either."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    read = frozenset().union(*[alphabet(parse(*r)) for r in [*rules, *also]])
    for k, rule in enumerate(rules):
        node = parse(*rule)
        start = nfa.state()
        nfa.free[root].append(start)
        ends[nfa.build(node, start)] = 1 << k
    # byte classes: bytes that the same edges read
    sets = sorted({s for es in nfa.edges for s, _ in es}, key=sorted)
    sign: dict[tuple, int] = {}
    classes = np.zeros(256, np.int32)
    samples = []
    for b in range(256):
        key = tuple(i for i, s in enumerate(sets) if b in s)
        if key not in sign:
            sign[key] = len(sign)
            samples.append(b)
        classes[b] = sign[key]
    closure: list[frozenset] = []
    for s in range(len(nfa.edges)):
        seen, stack = {s}, [s]
        while stack:
            for t in nfa.free[stack.pop()]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        # states without edges or acceptance need not be kept
        closure.append(frozenset(t for t in seen if nfa.edges[t] or t in ends))
    step = [[frozenset().union(*[closure[t] for s, t in nfa.edges[x] if b in s]) for b in samples]
            for x in range(len(nfa.edges))]
    # subset construction; the start's closure is added at every byte
    first = closure[root]
    number, order, rows = {first: 0}, [first], []
    for subset in order:
        row = []
        for c in range(len(samples)):
            nxt = first.union(*[step[x][c] for x in subset])
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    trans = np.array(rows, np.int64)
    mask = np.array([sum({ends[x] for x in s if x in ends}) for s in order], np.int64)
    # minimisation by partition refinement
    block = np.unique(mask, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[trans]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    n = int(block.max()) + 1
    pick = np.zeros(n, np.int64)
    pick[block[::-1]] = np.arange(len(block))[::-1]
    small, masks = block[trans[pick]], mask[pick]
    # start first, accepting states last
    rank = np.lexsort((np.arange(n) != block[0], masks != 0))
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    small, masks = place[small[rank]], masks[rank]
    start = int(place[block[0]])
    if start != 0 or masks[0]:
        raise ValueError("a rule matches the empty text")
    width = len(samples)
    resets = np.array([b not in read for b in range(256)])
    return Automaton(classes.astype(np.int32), (small * width).astype(np.int32).reshape(-1), width,
                     int((masks == 0).sum()) * width, masks, resets)


#: bytes after which all states should have met
MEET = 32


def _meetings(a: Automaton, cls: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts within lanes of over four times ``lane``, and the state there: of
    every ``lane``-th place, those where all states, run over the ``MEET`` bytes
    before, end in one."""
    places = [np.arange(s + lane, e, lane) for s, e in zip(starts, ends) if e - s > 4 * lane and lane >= MEET]
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    at = np.concatenate(places)
    every = np.arange(a.states, dtype=np.int32) * a.n_classes
    cut, known = [], []
    for k in range(0, len(at), 4096):
        p = at[k:k + 4096]
        state = np.broadcast_to(every, (len(p), a.states))
        for j in range(MEET, 0, -1):
            state = a.table[state + cls[p - j][:, None]]
        met = (state == state[:, :1]).all(axis=1)
        cut.append(p[met])
        known.append(state[met, 0])
    return np.concatenate(cut), np.concatenate(known).astype(np.int32)


def scan(a: Automaton, data: np.ndarray, lane: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of the last byte) and rule masks of all accepting steps.

    The text is cut into lanes that run side by side: at reset bytes and, where
    those are too far apart, at places that all states reach alike."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = a.classes[data]
    reset = np.flatnonzero(a.resets[data])
    want = np.arange(lane, n, lane)
    at = np.searchsorted(reset, want)
    cuts = reset[at[at < len(reset)]] + 1
    starts = np.unique(np.concatenate([[0], cuts[cuts < n]]))
    more, known = _meetings(a, cls, starts, np.append(starts[1:], n), lane)
    state = np.concatenate([np.zeros(len(starts), np.int32), known])
    starts = np.concatenate([starts, more])
    order = np.argsort(starts, kind="stable")
    starts, state = starts[order], state[order]
    ends = np.append(starts[1:], n)
    order = np.argsort(starts - ends, kind="stable")          # longest first
    starts, length, state = starts[order], (ends - starts)[order], state[order]
    live = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    found_at, found = [], []
    for i, k in enumerate(live):
        if k < len(state):
            state, starts = state[:k], starts[:k]
        state = a.table[state + cls[starts + i]]
        hit = np.flatnonzero(state >= a.first_accept)
        if len(hit):
            found_at.append(starts[hit] + i)
            found.append(a.accepts[state[hit] // a.n_classes])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found)
