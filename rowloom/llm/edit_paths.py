"""Cheapest edits that bring role initials into the form (s?(ua)+)?, in linear space.

Four states tell what the repaired roles end in: nothing, the system turn, a user turn, an assistant turn.
A step takes one row (after any inserts) from state to state; a matrix holds, for each state it may begin
in, the least cost to each state it may end in, and how the least edits to those ends compare as texts.
Edits that use up the same rows never begin one another, so comparing them is settled by the first step
that differs, and matrices of neighbouring stretches combine exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

STATES = NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
# The state that the next user or assistant turn leads to.
NEXT = (USER, USER, ASSISTANT, USER)
# Cost and edits that close what ends in a state.
CLOSE = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))

# A row's code: the state its own role leads to (0: none), GOES if it must go, TRUNCATED if it ends early.
GOES, TRUNCATED = 4, 8

Vector = tuple[tuple[int, ...], tuple[int, ...]]
Matrix = tuple[Vector, ...]


@lru_cache(maxsize=None)
def edits(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(begin, end) -> the least (cost, edits) that take one row: up to two inserts, then D, K or R."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    role, more = code & 3, CUT_OFF if code & TRUNCATED else 0
    for begin in STATES:
        state = begin
        for inserts in range(3):
            cost, before = inserts * INSERT, "I" * inserts
            ways = [(state, cost + DELETE, before + "D")]
            if not code & GOES:
                ways.append((NEXT[state], cost + REROLE + more, before + "R"))
                if role == SYSTEM and state == NOTHING or role and role != SYSTEM and role == NEXT[state]:
                    ways.append((role, cost + more, before + "K"))
            for end, price, text in ways:
                found[begin, end] = min(found.get((begin, end), (FAR, "")), (price, text))
            state = NEXT[state]
    return found


@lru_cache(maxsize=None)
def row_matrix(code: int) -> Matrix:
    rows = []
    for begin in STATES:
        ways = [edits(code).get((begin, end)) for end in STATES]
        order = sorted(w[1] for w in ways if w)
        rows.append((tuple(w[0] if w else FAR for w in ways), tuple(order.index(w[1]) if w else 4 for w in ways)))
    return tuple(rows)


def only(state: int) -> Vector:
    """Nothing taken yet, in this state."""
    return tuple(0 if s == state else FAR for s in STATES), tuple(0 if s == state else 4 for s in STATES)


def forward(vector: Vector, matrix: Matrix) -> Vector:
    """Costs and order after one more step."""
    costs, ranks = vector
    best, keys = [], []
    for end in STATES:
        cost, rank, begin = min((costs[s] + matrix[s][0][end], ranks[s], s) for s in STATES)
        best.append(min(cost, FAR))
        keys.append((rank, matrix[begin][1][end]))
    order = sorted(k for k, c in zip(keys, best, strict=True) if c < FAR)
    return tuple(best), tuple(order.index(k) if c < FAR else 4 for k, c in zip(keys, best, strict=True))


def backward(matrix: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before one more step."""
    return tuple(min(FAR, *(matrix[s][0][t] + costs[t] for t in STATES)) for s in STATES)


def joined(matrices: Sequence[Matrix]) -> Matrix:
    """One matrix for neighbouring steps."""
    rows = [only(s) for s in STATES]
    for matrix in matrices:
        rows = [forward(row, matrix) for row in rows]
    return tuple(rows)


@lru_cache(maxsize=1 << 16)
def _step(vector: Vector, code: int) -> tuple[Vector, int]:
    """``forward`` over a row, with the least cost taken out: few vectors ever occur."""
    costs, ranks = forward(vector, row_matrix(code))
    least = min(costs)
    return (tuple(c - least if c < FAR else FAR for c in costs), ranks), least


@lru_cache(maxsize=1 << 16)
def _step_back(code: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    costs = backward(row_matrix(code), costs)
    least = min(costs)
    return tuple(c - least if c < FAR else FAR for c in costs)


def rows_matrix(codes: Sequence[int]) -> Matrix:
    """``joined`` over rows."""
    made = []
    for state in STATES:
        vector, total = only(state), 0
        for code in codes:
            vector, least = _step(vector, code)
            total += least
        made.append((tuple(c + total if c < FAR else FAR for c in vector[0]), vector[1]))
    return tuple(made)


def closing(vector: Vector) -> tuple[int, int]:
    """Least cost of all edits, and the state they end in before the closing inserts."""
    costs, ranks = vector
    cost, _, state = min((costs[s] + CLOSE[s][0], ranks[s], s) for s in STATES)
    return cost, state


def crossings(n: int, begin: int, end: int, ahead: Callable[[Vector, int], Vector], back: Callable[[int, tuple[int, ...]], tuple[int, ...]]) -> list[int]:
    """The states at all n + 1 borders of n steps, on the least of the cheapest paths from begin to end.

    Forward costs meet backward costs at the middle border; of the cheapest crossings the one whose edits so
    far come first as a text is taken, and both halves are solved alike. Only two vectors are held at a time.
    """
    states = [begin, *[-1] * (n - 1), end] if n else [begin]
    open_ = [(0, n)]
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        vector = only(states[low])
        for k in range(low, middle):
            vector = ahead(vector, k)
        costs = only(states[high])[0]
        for k in range(high - 1, middle - 1, -1):
            costs = back(k, costs)
        states[middle] = min((vector[0][s] + costs[s], vector[1][s], s) for s in STATES)[2]
        open_ += [(low, middle), (middle, high)]
    return states


def row_crossings(codes: Sequence[int], begin: int, end: int) -> list[int]:
    return crossings(len(codes), begin, end, lambda v, k: _step(v, codes[k])[0], lambda k, c: _step_back(codes[k], c))


def matrix_crossings(matrices: Sequence[Matrix], begin: int, end: int) -> list[int]:
    return crossings(len(matrices), begin, end, lambda v, k: forward(v, matrices[k]), lambda k, c: backward(matrices[k], c))
