"""Adaptive context-mixing range coder for token ids below 65,536.

Ids are coded in blocks of ``BLOCK``; every block starts from the same model and has its own checksum, so it can be read
alone. The blocks of a call advance together, ``LANES`` at a time, one id a step, as lanes of NumPy arrays.

Three orders predict the next id. Order 0 is the file's own table of all its ids, carried in the header. Order 2 and order 1
look up the id that last followed the last two ids, or the last one, with a confidence that grows with each hit; how much
each order weighs at every pair of confidences is learned within the block, from how often it was right. The predictions are
mixed into one distribution over all ids,

    cum(id) = w0 * C0(id) + w1 * [pred1 < id] + w2 * [pred2 < id]

and a carry-less range coder with 64-bit state and 16-bit output codes the id in one step.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2_048
LANES = 4_096
SLOTS = 256
LEVELS = 4
_S = 18
_Z = 1 << _S  # all ids of order 0, which weighs a whole number of these
_T = 24  # log2 of the whole distribution
_PARTS = 1 << _T - _S
_MOST = np.int32((_PARTS - 2) << _S)  # of orders 1 and 2
_RATE = 5
_FIRST = (0.02, 0.1, 0.25, 0.5)  # how often a confidence is right, before anything is learned
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_16, _48, _24 = np.uint64(16), np.uint64(48), np.uint64(24)
_U = np.uint64
MAGIC = b"DFIDS2\0\0"


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Order-0 frequency of each id up to the largest: at least one where it occurs, summing to ``_Z``."""
    if not len(ids):
        return np.array([_Z], dtype=np.int32)
    count = np.bincount(ids).astype(np.int64)
    freq = (count > 0) + count * (_Z - np.count_nonzero(count)) // len(ids)
    freq[freq.argmax()] += _Z - freq.sum()
    return freq.astype(np.int32)


class _Table:
    """Order 0 as starts and widths of ids, and the id at each place."""

    def __init__(self, freq: np.ndarray) -> None:
        self.width = np.zeros(1 << 16, dtype=np.int32)
        self.width[: len(freq)] = freq
        self.start = np.cumsum(self.width, dtype=np.int32) - self.width
        self.ids = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)


def _first_weights() -> list[np.ndarray]:
    """Weights of orders 1 and 2 by whether both predict one id (which order 1 then stands for) and their confidences."""
    p1, p2 = np.repeat(_FIRST, LEVELS), np.tile(_FIRST, LEVELS)
    one, two = np.r_[(1 - p2) * p1, p1 + p2 - p1 * p2], np.r_[p2, np.zeros(LEVELS * LEVELS)]
    return [(w * int(_MOST)).astype(np.int32) for w in (one, two)]


class _Model:
    """Prediction state of ``lanes`` blocks. A slot holds the predicted id and, above it, the confidence."""

    def __init__(self, lanes: int, table: _Table) -> None:
        self.table = table
        row = np.arange(lanes, dtype=np.int64)  # places are 64 bits wide: NumPy would widen them at every use
        self.slots = np.zeros((2, lanes * SLOTS), dtype=np.int32)
        self.weights = [np.tile(w, lanes) for w in _first_weights()]
        self.last, self.before = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        self.row_slots, self.row_levels = row * SLOTS, row * (2 * LEVELS * LEVELS)

    def predict(self, active: int) -> None:
        """Sets predictions (guess) and weights (k, w1, w2) of the first ``active`` lanes."""
        one = self.last[:active] * 181
        two = one ^ self.before[:active] * 911
        rows, levels = self.row_slots[:active], self.row_levels[:active]
        self.slot = (rows + (one >> 4 & (SLOTS - 1)), rows + (two >> 3 & (SLOTS - 1)))
        self.held = [self.slots[o].take(self.slot[o], mode="clip") for o in (0, 1)]
        self.guess = [h & 65535 for h in self.held]
        self.sure = [h >> 16 for h in self.held]
        self.same = self.guess[0] == self.guess[1]
        self.level = levels + (self.same * np.int32(LEVELS * LEVELS) + self.sure[0] * LEVELS + self.sure[1]).astype(np.int64)
        self.mass = [w.take(self.level, mode="clip") for w in self.weights]
        self.w1 = self.mass[0]
        parts = (self.w1 + self.mass[1] + (_Z - 1)) >> _S
        self.k = _PARTS - parts
        self.w2 = (parts << _S) - self.w1

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the ids in the mixed distribution."""
        c1, c2 = self.guess
        self.hit = (c1 == ids, c2 == ids)
        self.at = at = ids.astype(np.int64)
        start = self.k * self.table.start.take(at, mode="clip") + self.w1 * (c1 < ids) + self.w2 * (c2 < ids)
        return start, self.k * self.table.width.take(at, mode="clip") + self.w1 * self.hit[0] + self.w2 * self.hit[1]

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id whose interval holds ``value``: a prediction's, or order 0's once the predictions before are taken out."""
        table, k, w1, w2 = self.table, self.k, self.w1, self.w2
        c1, c2 = self.guess
        same = c1 == c2
        at1, at2 = c1.astype(np.int64), c2.astype(np.int64)
        begin1 = k * table.start.take(at1, mode="clip") + w2 * (c2 < c1)
        begin2 = k * table.start.take(at2, mode="clip") + w1 * (c1 < c2)
        end1 = begin1 + k * table.width.take(at1, mode="clip") + w1 + w2 * same
        end2 = begin2 + k * table.width.take(at2, mode="clip") + w2 + w1 * same
        past1, past2 = value >= end1, value >= end2
        # below 2**24 over less than 2**6: the quotient of doubles never rounds up to the next whole number
        place = ((value - w1 * past1 - w2 * past2) / k).astype(np.int64)
        ids = table.ids.take(place, mode="clip").astype(np.int32)
        ids = np.where((value >= begin1) > past1, c1, ids)
        return np.where((value >= begin2) > past2, c2, ids)

    def update(self, ids: np.ndarray, active: int) -> None:
        for order, right in ((0, self.hit[0]), (1, self.hit[1] > self.same)):
            hit, sure, mass = self.hit[order], self.sure[order], self.mass[order]
            self.weights[order][self.level] = mass + (right * _MOST - mass >> _RATE)
            surer = np.minimum(sure + 1, LEVELS - 1) * hit
            kept = self.held[order] - 65536 - ids  # from the id, if a sure prediction was wrong
            self.slots[order][self.slot[order]] = ids + (surer << 16) + kept * ((sure > 1) > hit)
        self.before[:active] = self.last[:active]
        self.last[:active] = self.at


def _renorm(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose upper 16 bits are settled, or whose range is cut so that they are."""
    settled = (low ^ (low + span)) < _TOP
    short = span < _BOT
    if short.any():
        short &= ~settled
        at = np.flatnonzero(short)
        span[at] = (~low[at] + _U(1)) & (_BOT - _U(1))
        settled |= short
    return np.flatnonzero(settled)


def _encode(grid: np.ndarray, lengths: np.ndarray, table: _Table) -> list[bytes]:
    """Payloads of the lanes of ``grid`` (steps, lanes); longer blocks come first."""
    lanes = grid.shape[1]
    model = _Model(lanes, table)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, ~np.uint64(0))
    room = grid.shape[0] * 2 + 8
    out = np.zeros(lanes * room, dtype="<u2")
    put = np.arange(lanes, dtype=np.int64) * room
    for step in range(grid.shape[0]):
        active = lanes if step < lengths[-1] else int(np.searchsorted(-lengths, -step, side="left"))
        now = grid[step, :active].astype(np.int32)
        model.predict(active)
        start, width = model.interval(now)
        lo, sp = low[:active], span[:active]
        unit = sp >> _24
        lo += unit * start.astype(np.uint64)
        np.multiply(unit, width.astype(np.uint64), out=sp)
        at = _renorm(lo, sp)
        while len(at):
            a, b, to = lo[at], sp[at], put[at]
            out[to] = a >> _48
            put[at] = to + 1
            a <<= _16
            b <<= _16
            more = _renorm(a, b)
            lo[at], sp[at] = a, b
            at = at[more]
        model.update(now, active)
    for i in range(4):
        out[put + i] = low >> _U(48 - 16 * i)
    return [out[i * room : put[i] + 4].tobytes() for i in range(lanes)]


def encode(ids: np.ndarray, block: int = BLOCK, freq: np.ndarray | None = None) -> list[bytes]:
    """Payload of each block of ``ids`` (uint16), under the order-0 frequencies of their file (their own if not given)."""
    table = _Table(frequencies(ids) if freq is None else freq)
    out: list[bytes] = []
    for first in range(0, len(ids), block * LANES):
        some = ids[first : first + block * LANES]
        lanes, steps = -(-len(some) // block), min(block, len(some))
        grid = np.zeros(lanes * steps, dtype=np.uint16)
        grid[: len(some)] = some
        lengths = np.full(lanes, steps)
        lengths[-1] = len(some) - (lanes - 1) * steps
        out += _encode(np.ascontiguousarray(grid.reshape(lanes, steps).T), lengths, table)
    return out


def _decode(payloads: list[bytes], sizes: np.ndarray, table: _Table) -> np.ndarray:
    """Ids (lanes, steps) of payloads; longer blocks come first."""
    lanes = len(payloads)
    data = [np.frombuffer(p, dtype="<u2") for p in payloads]
    at_word = np.r_[0, np.cumsum([len(d) for d in data])[:-1]]
    words = np.concatenate([*data, np.zeros(8, dtype="<u2")])
    model = _Model(lanes, table)
    low, span, code = np.zeros(lanes, dtype=np.uint64), np.full(lanes, ~np.uint64(0)), np.zeros(lanes, dtype=np.uint64)
    for _ in range(4):
        code = code << _16 | words.take(at_word, mode="clip")
        at_word += 1
    out = np.zeros((int(sizes[0]), lanes), dtype=np.uint16)
    limit = _U((1 << _T) - 1)
    for step in range(int(sizes[0])):
        active = lanes if step < sizes[-1] else int(np.searchsorted(-sizes, -step, side="left"))
        model.predict(active)
        lo, sp, co = low[:active], span[:active], code[:active]
        unit = sp >> _24
        now = model.find(np.minimum((co - lo) // unit, limit).astype(np.int32))
        start, width = model.interval(now)
        lo += unit * start.astype(np.uint64)
        np.multiply(unit, width.astype(np.uint64), out=sp)
        at = _renorm(lo, sp)
        while len(at):
            a, b, to = lo[at], sp[at], at_word[at]
            co[at] = co[at] << _16 | words.take(to, mode="clip")
            at_word[at] = to + 1
            a <<= _16
            b <<= _16
            more = _renorm(a, b)
            lo[at], sp[at] = a, b
            at = at[more]
        model.update(now, active)
        out[step, :active] = now
    return np.ascontiguousarray(out.T)


def decode(payloads: list[bytes], lengths: list[int], freq: np.ndarray) -> list[np.ndarray]:
    """Ids of blocks; any blocks of a file, in any order, under the file's order-0 frequencies."""
    table = _Table(freq)
    order = sorted(range(len(payloads)), key=lambda i: -lengths[i])
    ids: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(order)
    for first in range(0, len(order), LANES):
        some = order[first : first + LANES]
        back = _decode([payloads[i] for i in some], np.array([lengths[i] for i in some]), table)
        for lane, i in enumerate(some):
            ids[i] = back[lane, : lengths[i]]
    return ids


def write_file(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray, block: int = BLOCK) -> bytes:
    """A file image: header, documents (id, whether null is marked by the caller, size), order-0 table, block table, blocks.

    Every part has a CRC-32; a block has one over its bytes and one over its ids as little-endian unsigned 32-bit integers.
    """
    freq = frequencies(ids)
    payloads = encode(ids, block, freq)
    index = zlib.compress(doc_ids.astype("<i8").tobytes() + sizes.astype("<i8").tobytes(), 1)
    order0 = zlib.compress(freq.astype("<u4").tobytes(), 1)
    lengths = [min(block, len(ids) - i * block) for i in range(len(payloads))]
    checks = [zlib.crc32(ids[i * block : i * block + n].astype("<u4").tobytes()) for i, n in enumerate(lengths)]
    table = b"".join(struct.pack("<IIII", n, len(p), c, zlib.crc32(p)) for n, p, c in zip(lengths, payloads, checks, strict=True))
    head = MAGIC + struct.pack("<QQQQII", len(ids), len(doc_ids), len(index), len(order0), len(payloads), block)
    sums = struct.pack("<IIII", zlib.crc32(head), zlib.crc32(index), zlib.crc32(order0), zlib.crc32(table))
    return head + sums + index + order0 + table + b"".join(payloads)


class BadFile(ValueError):
    """A checksum or a length of a file is wrong."""


def read_file(data: bytes, blocks: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, document ids, sizes) of a file image; or the ids of some blocks only."""
    size = len(MAGIC) + 40
    head = data[:size]
    if len(data) < size + 16 or head[: len(MAGIC)] != MAGIC:
        raise BadFile("not a token-id file")
    n_ids, n_docs, n_index, n_order0, n_blocks, _ = struct.unpack("<QQQQII", head[len(MAGIC) :])
    sums = struct.unpack("<IIII", data[size : size + 16])
    edges = np.cumsum([size + 16, n_index, n_order0, 16 * n_blocks]).tolist()
    index, order0, table = (data[a:b] for a, b in zip(edges, edges[1:], strict=False))
    if tuple(map(zlib.crc32, (head, index, order0, table))) != sums:
        raise BadFile("header, index, order-0 table or block table is damaged")
    lengths, widths, checks, packed = (list(x) for x in zip(*struct.iter_unpack("<IIII", table), strict=True)) if n_blocks else ([], [], [], [])
    begin = np.r_[0, np.cumsum(widths)].astype(np.int64) + edges[-1]
    if begin[-1] != len(data):
        raise BadFile("the file is cut off")
    chosen = list(range(n_blocks)) if blocks is None else blocks
    for i in chosen:
        if zlib.crc32(data[begin[i] : begin[i + 1]]) != packed[i]:
            raise BadFile(f"block {i} is damaged")
    freq = np.frombuffer(zlib.decompress(order0), dtype="<u4").astype(np.int32)
    parts = decode([data[begin[i] : begin[i + 1]] for i in chosen], [lengths[i] for i in chosen], freq)
    for i, part in zip(chosen, parts, strict=True):
        if zlib.crc32(part.astype("<u4").tobytes()) != checks[i]:
            raise BadFile(f"block {i} is damaged")
    both = np.frombuffer(zlib.decompress(index), dtype="<i8")
    ids = np.concatenate([np.zeros(0, np.uint16), *parts])
    if blocks is None and len(ids) != n_ids:
        raise BadFile("the number of ids is wrong")
    return ids, both[:n_docs], both[n_docs:]
