"""Wide SimHash fingerprints compared bit by bit: planes of lanes, carry-save counters, abandoned blocks."""

from __future__ import annotations

import numpy as np

from rowloom.llm.rolling import mixed

# A fingerprint has PARTS * 64 bits.
PARTS = 4
# Two sets of Jaccard 0.8 differ in a bit with probability 0.152 (the angle of their bit sums), small ones in 0.161, sets of
# four and five hashes in 0.188; over 256 bits more than RADIUS differ with probability below 1e-6 (those of four and
# five: 2e-5). Unrelated sets differ in 128 bits, give or take 8.
RADIUS = 75
# Paragraphs of fewer shingles are not sifted: there the sets themselves are as quick.
LEAST = 64
# So many lanes or rows of lanes are compared at once.
BLOCK = 4096
# So many fingerprints are compared with a whole file at once (a multiple of 64, so lanes can be cut there).
ROWS_AT_ONCE = 256
# Differences in so many planes are counted once for all rows that have the same bits there.
TOGETHER = 7

_SEEDS = mixed(np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def fingerprint(hashes: np.ndarray) -> bytes:
    """Majority bits of PARTS mixes of every hash; counted in slices."""
    ones = np.zeros(PARTS * 64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = mixed(hashes[at : at + BLOCK, None] ^ _SEEDS)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def words(fingerprints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fingerprints), "<u8").reshape(-1, PARTS)


def _planes(fps: np.ndarray) -> np.ndarray:
    """One row of packed lanes per bit place: bit i of row p is bit p of fingerprint i."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], (len(fps) + 63) // 64 * 64), np.uint8)
    padded[:, : len(fps)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


class Counters:
    """A number per lane in carry-save form: up to two planes a weight, and three of one weight become one of it and a
    carry of the next. So most planes cost one full adder, and sums are only carried through when they are compared."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.shape, self.radius = shape, radius
        self.weights: list[list[np.ndarray]] = [[]]

    def add(self, plane: np.ndarray, weight: int = 0) -> None:
        while True:
            if weight == len(self.weights):
                self.weights.append([])
            planes = self.weights[weight]
            planes.append(plane)
            if len(planes) < 3:
                return
            total, plane = _full_adder(*planes)
            self.weights[weight] = [total]
            weight += 1

    def sums(self) -> list[np.ndarray]:
        """The numbers' bits, from the lowest up."""
        bits, carry = [], []
        for planes in self.weights:
            total, carry = _summed([*planes, *carry], self.shape)
            bits.append(total)
        return bits + carry

    def over(self) -> np.ndarray:
        """Lanes above the radius, compared from the highest bit down."""
        bits = self.sums()
        more, same = np.zeros(self.shape, np.uint64), ~np.zeros(self.shape, np.uint64)
        for k in range(max(len(bits), self.radius.bit_length()) - 1, -1, -1):
            bit = bits[k] if k < len(bits) else np.zeros(self.shape, np.uint64)
            if self.radius >> k & 1:
                same &= bit
            else:
                more |= same & bit
                same &= ~bit
        return more

    def keep(self, rows: np.ndarray) -> None:
        self.weights = [[plane[rows] for plane in planes] for planes in self.weights]
        self.shape = (int(rows.sum()), *self.shape[1:])


def _full_adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    either = a ^ b
    return either ^ c, (a & b) | (either & c)


def _summed(planes: list[np.ndarray], shape: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sum's bit of one weight, and what is carried to the next."""
    if not planes:
        return np.zeros(shape, np.uint64), []
    if len(planes) == 1:
        return planes[0], []
    if len(planes) == 2:
        return planes[0] ^ planes[1], [planes[0] & planes[1]]
    total, carry = _full_adder(*planes)
    return total, [carry]


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) differ in ``radius`` bits or fewer. A block is abandoned once all its lanes are over."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), BLOCK):
        planes = _planes(a[at : at + BLOCK] ^ b[at : at + BLOCK])
        counters = Counters(planes.shape[1:], radius)
        for number, plane in enumerate(planes):
            counters.add(plane)
            if number % 32 == 31 and not (~counters.over()).any():
                break
        near = np.unpackbits((~counters.over()).view(np.uint8), bitorder="little").astype(bool)
        out[at : at + BLOCK] = near[: len(out[at : at + BLOCK])]
    return out


def rows_within(rows: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row, which fingerprints differ from it in ``radius`` bits or fewer. Rows whose lanes are all over are abandoned."""
    near = _near_lanes(rows, _counted(_planes(fps)), radius)
    return np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(fps)].astype(bool)


def _counted(planes: np.ndarray) -> list[list[np.ndarray]]:
    """For each TOGETHER planes the bits of their count of differences, one row of lanes for each way a fingerprint may
    have its bits there."""
    out = []
    for at in range(0, len(planes), TOGETHER):
        part = planes[at : at + TOGETHER]
        ways = np.arange(1 << len(part), dtype=np.uint64)
        counters = Counters((len(ways), planes.shape[1]), 0)
        for k, plane in enumerate(part):
            counters.add(plane[None, :] ^ (np.uint64(0) - (ways >> np.uint64(k) & np.uint64(1)))[:, None])
        out.append(counters.sums())
    return out


def _near_lanes(rows: np.ndarray, counted: list[list[np.ndarray]], radius: int, begin: int = 0) -> np.ndarray:
    """``rows_within`` in packed lanes, from word ``begin`` of them on."""
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
    out = np.zeros((len(rows), counted[0][0].shape[1] - begin), np.uint64)
    live = np.arange(len(rows))
    counters = Counters(out.shape, radius)
    for number, sums in enumerate(counted):
        own = bits[:, number * TOGETHER : (number + 1) * TOGETHER]
        way = (own @ (1 << np.arange(own.shape[1])))[live]
        for weight, lanes in enumerate(sums):
            counters.add(lanes[:, begin:].take(way, axis=0), weight)
        # Unrelated fingerprints differ in every second bit, so before twice the radius hardly a row is over.
        if number % 4 == 3 and number * TOGETHER >= 2 * radius:
            some = (~counters.over()).any(axis=1)
            if not some.all():
                live = live[some]
                counters.keep(some)
            if not len(live):
                return out
    out[live] = ~counters.over()
    return out


def groups_within(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint, the least index that pairs within ``radius`` bits connect it with. All are compared with all,
    some rows at once, each with the lanes from its own block on."""
    counted = _counted(_planes(fps))
    lanes = np.zeros((len(fps) + 63) // 64 * 64, np.uint8)
    lanes[: len(fps)] = 1
    real = np.packbits(lanes, bitorder="little").view("<u8")
    label = np.arange(len(fps))
    for at in range(0, len(fps), ROWS_AT_ONCE):
        near = _near_lanes(fps[at : at + ROWS_AT_ONCE], counted, radius, at // 64) & real[at // 64 :]
        near[np.arange(len(near)), np.arange(len(near)) // 64] &= ~(np.uint64(1) << (np.arange(len(near), dtype=np.uint64) % np.uint64(64)))
        row, word = np.nonzero(near)
        if len(row):
            at_, lane = np.nonzero(np.unpackbits(near[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            label = _joined(label, at + row[at_], at + word[at_] * 64 + lane)
    return label


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the pairs (i, j) are joined: every member has the least index of its group."""
    i, j = np.concatenate((i, np.arange(len(label)))), np.concatenate((j, label))
    label = np.arange(len(label))
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label
