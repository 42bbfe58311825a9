"""Re-Pair grammar over turn sequences, and the cheapest repair of a sequence by min-plus matrices.

A turn is one letter: the initial of its role (s, u, a, or x for any other), in capitals where its
text is truncated, or D where it has to go. States of the wanted form (s?(ua)+)?: 0 nothing yet,
1 after s, 2 after u, 3 after a; 0 and 3 accept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

Rope = str | tuple  # text, or (left, right)
Cell = tuple[int, Rope] | None  # cost and audit of the best way between two states
LETTERS = "DsuaxSUAX"
STATES = 4
ACCEPT = (0, 3)
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_SHORT = 64


def join(a: Rope, b: Rope) -> Rope:
    if not a or not b:
        return a or b
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= _SHORT:
        return a + b
    return (a, b)


def pieces(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            if top:
                yield top
        else:
            stack += [top[1], top[0]]


def less(a: Rope, b: Rope) -> bool:
    """Whether a's text comes before b's; texts are compared piece by piece, not built."""
    if a is b:
        return False
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    left, right = pieces(a), pieces(b)
    x = y = ""
    while True:
        x, y = x or next(left, ""), y or next(right, "")
        n = min(len(x), len(y))
        if not n or x[:n] != y[:n]:
            return x[:n] < y[:n] if n else bool(y) and not x
        x, y = x[n:], y[n:]


def better(a: Cell, b: Cell) -> Cell:
    """The cheaper way; of equal cost the one of the smaller audit.

    Over the same turns, ways of equal cost never have audits of which one begins the other, since
    equal letters cost the same. So the smaller audit stays smaller whatever follows.
    """
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if less(b[1], a[1]) else a


def times(m: list[Cell], n: list[Cell], rows: int = STATES) -> list[Cell]:
    """Min-plus product of matrices given row by row; `rows` of the left one."""
    out: list[Cell] = [None] * (rows * STATES)
    for i in range(rows):
        for k in range(STATES):
            a = m[i * STATES + k]
            if a is None:
                continue
            for j in range(STATES):
                b = n[k * STATES + j]
                if b is not None:
                    at = i * STATES + j
                    out[at] = better(out[at], (a[0] + b[0], join(a[1], b[1])))
    return out


def _single(ways: list[tuple[int, int, int, str]]) -> list[Cell]:
    out: list[Cell] = [None] * (STATES * STATES)
    for i, j, cost, audit in ways:
        out[i * STATES + j] = better(out[i * STATES + j], (cost, audit))
    return out


_STILL = [(i, i, 0, "") for i in range(STATES)]
_ONE_MORE = _single(_STILL + [(i, j, INSERT, "I") for (i, c), j in NEXT.items() if c != "s"])
INSERTS = times(_ONE_MORE, _ONE_MORE)  # a third insertion leads back to where the first did
IDENTITY = _single(_STILL)


def _terminal(letter: str) -> list[Cell]:
    ways = [(i, i, DELETE, "D") for i in range(STATES)]
    if letter != "D":
        extra = TRUNCATED if letter.isupper() else 0
        ways += [(i, j, extra, "K") for (i, c), j in NEXT.items() if c == letter.lower()]
        ways += [(i, j, REROLE + extra, "R") for (i, c), j in NEXT.items() if c != "s"]
    return times(INSERTS, _single(ways))


class Grammar:
    """Rules in the order of their making; rule k is symbol len(LETTERS) + k for a pair of symbols.

    A rule's matrix is made once, from those of its two symbols, when it is first wanted.
    """

    def __init__(self, rules: list[tuple[int, int]]):
        self.rank = {pair: k for k, pair in reversed(list(enumerate(rules)))}
        self.rules = rules
        self.made: dict[int, list[Cell]] = {k: _terminal(c) for k, c in enumerate(LETTERS)}

    def symbols(self, letters: str) -> list[int]:
        """The sequence with all rules applied in their order, each from the left."""
        out = [LETTERS.index(c) for c in letters]
        while len(out) > 1:
            rank = min((self.rank[p] for p in pairwise(out) if p in self.rank), default=None)
            if rank is None:
                break
            a, b = self.rules[rank]
            new, k = [], 0
            while k < len(out):
                if k + 1 < len(out) and out[k] == a and out[k + 1] == b:
                    new.append(len(LETTERS) + rank)
                    k += 2
                else:
                    new.append(out[k])
                    k += 1
            out = new
        return out

    def matrix(self, symbol: int) -> list[Cell]:
        wanted = [symbol]
        while wanted:
            top = wanted[-1]
            if top in self.made:
                wanted.pop()
                continue
            parts = self.rules[top - len(LETTERS)]
            missing = [p for p in parts if p not in self.made]
            if missing:
                wanted += missing
            else:
                self.made[top] = times(self.made[parts[0]], self.made[parts[1]])
        return self.made[symbol]

    def transfer(self, letters: str) -> list[Cell]:
        """Matrix of a whole sequence, without the insertions after its end."""
        found = IDENTITY
        for k, symbol in enumerate(self.symbols(letters)):
            found = times(found, self.matrix(symbol)) if k else self.matrix(symbol)
        return found


def finish(start: list[Cell]) -> tuple[int, Rope]:
    """Cheapest way from the start to an accepting state, given the way's first row so far."""
    last = times(start, INSERTS, 1)
    best = None
    for k in ACCEPT:
        best = better(best, last[k])
    return best


def digrams(symbols: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of neighbours that a replacement from the left would replace; equal ones do not overlap."""
    before = None
    for pair in pairwise(symbols):
        if pair == before and pair[0] == pair[1]:
            before = None
            continue
        before = pair
        yield pair
