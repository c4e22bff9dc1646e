"""Adaptive context-mixing range coder for token ids, in independent blocks.

A block's ids lie in *lanes* that are coded side by side: step *t* codes the *t*-th
id of every lane in one numpy step.  All lanes share the block's model, which
learns at fixed steps that grow (``ROUNDS``), from the ids of all lanes so far; at
the start of a block nothing is known.

Order 0 counts the ids seen.  Order 1 counts the ids that followed each of the
``CLASSES`` commonest ids.  Both are mixed to one distribution for each previous id:
a class with n observations of d different ids gives order 1 the weight n / (n + d).
Order 2 remembers which id last followed two ids and how often in a row that was
so; that id gets a share of the whole, learned for each such number, before the
mixed distribution gets the rest.  An id not seen before is an escape and raw bits.
Shares are integers or single roundings of IEEE divisions, so any machine decodes
any block.

The range coder keeps 48 bits of low and sends 16-bit words; carries are resolved
at the end.  Ids must be below 2**29.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS = 256, 1024
BLOCK = LANES * STEPS
#: blocks coded side by side
GROUP = 8
CLASSES = 64
ROUNDS = (3, 12, 48, 160, 448)
SLOTS = 1 << 15
#: bits of a mixed distribution, and of the whole with order 2
MIXED, WHOLE = 16, 21
DENSE_BITS = 18
COARSE = 1024
COARSE_SHIFT = MIXED - 10


def slot(before2: np.ndarray, before1: np.ndarray) -> np.ndarray:
    return ((before2 * 0x9E3779B1 + before1 * 0x85EBCA77) >> 9) & (SLOTS - 1)


class Model:
    """What a block knows; symbols number its ids by first appearance, 0 is the escape."""

    def __init__(self, bits: int):
        self._dense = np.zeros(1 << bits, np.int32) if bits <= DENSE_BITS else None
        self._sorted = np.zeros(0, np.int64)
        self._symbols = np.zeros(0, np.int64)
        self.ids = np.zeros(1, np.int64)
        self._past: list[tuple[np.ndarray, np.ndarray]] = []
        self._count = np.zeros(1, np.int64)
        self.last = np.zeros(SLOTS, np.int32)
        self._sure = np.zeros(SLOTS, np.int8)
        self._outcomes = np.ones((4, 2), np.int64)
        self.share = np.zeros(SLOTS, np.int64)
        # one row, in which everything is an escape
        self.row = np.zeros(1, np.int64)
        self.table = np.array([[0, 1 << MIXED]], np.int32)

    def symbol(self, ids: np.ndarray) -> np.ndarray:
        if self._dense is not None:
            return self._dense[ids]
        if not len(self._sorted):
            return np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(self._sorted, ids), len(self._sorted) - 1)
        return np.where(self._sorted[at] == ids, self._symbols[at], 0)

    def _add(self, new: np.ndarray) -> None:
        numbers = len(self.ids) + np.arange(len(new))
        self.ids = np.concatenate([self.ids, new])
        if self._dense is not None:
            self._dense[new] = numbers
            return
        whole = np.concatenate([self._sorted, new])
        order = np.argsort(whole, kind="stable")
        self._sorted, self._symbols = whole[order], np.concatenate([self._symbols, numbers])[order]

    def learn(self, before2: np.ndarray, before1: np.ndarray, ids: np.ndarray) -> None:
        """Take in the ids of a round, step by step and lane by lane, and their predecessors."""
        unknown = ids[self.symbol(ids) == 0]
        new = np.unique(unknown) if len(unknown) else unknown
        if len(new):
            self._add(new)
        at, symbols, previous = slot(before2, before1), self.symbol(ids), self.symbol(before1)
        # order 2: outcomes by how sure a slot was
        old, sure = self.last[at], self._sure[at]
        hit = old == symbols
        self._outcomes += np.bincount((sure * 2 + hit)[old > 0], minlength=8).reshape(4, 2)
        self.last[at] = symbols
        self._sure[at] = np.where(hit, np.minimum(sure + 1, 3), 0)
        share = (self._outcomes[:, 1] << WHOLE) // self._outcomes.sum(axis=1)
        share = np.minimum(np.where(self._outcomes.sum(axis=1) > 8, share, 0), (1 << WHOLE) - (1 << MIXED))
        self.share = np.where(self.last > 0, share[self._sure], 0)
        # orders 0 and 1
        n = len(self.ids)
        count = np.bincount(symbols, minlength=n)
        count[: len(self._count)] += self._count
        self._count = count
        common = np.argsort(-count, kind="stable")[: CLASSES - 1]
        self.row = np.zeros(n, np.int64)
        self.row[common] = 1 + np.arange(len(common))
        self.row[0] = 0
        self._past = [tuple(np.concatenate(x) for x in zip(*self._past, (previous, symbols), strict=True))]
        past, following = self._past[0]
        rows = len(common) + 1
        mixed = np.bincount(self.row[past] * n + following, minlength=rows * n).reshape(rows, n)
        different = np.maximum(np.count_nonzero(mixed, axis=1), 1)[:, None]
        whole = count.copy()
        whole[0] = max(1, len(new) // 2)
        order0 = (whole << 20) // whole.sum() + 1
        # the table is the largest thing here: worked out in place
        mixed <<= 20
        mixed += different * order0
        np.cumsum(mixed, axis=1, out=mixed)
        total = mixed[:, -1:].astype(np.float64)
        mixed *= (1 << MIXED) - n
        # every symbol keeps one unit
        self.table = np.zeros((rows, n + 1), np.int32)
        np.divide(mixed, total, out=self.table[:, 1:], casting="unsafe")
        self.table[:, 1:] += np.arange(1, n + 1, dtype=np.int32)

    def intervals(self, before2: np.ndarray, before1: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, is an escape) of ids on the scale of ``WHOLE`` bits."""
        at, symbols = slot(before2, before1), self.symbol(ids)
        share, row = self.share[at], self.row[self.symbol(before1)] * self.table.shape[1] + symbols
        flat = self.table.ravel()
        rest = (1 << WHOLE) - share
        start = share + (flat[row] * rest >> MIXED)
        size = share + (flat[row + 1] * rest >> MIXED) - start
        hit = (share > 0) & (self.last[at] == symbols)
        return np.where(hit, 0, start), np.where(hit, share, size), (symbols == 0) & ~hit


def _rounds(steps: int) -> list[tuple[int, int]]:
    cuts = [0, *(r for r in ROUNDS if r < steps), steps]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _parts(bits: int) -> list[tuple[int, int]]:
    """(shift, bits) of the raw parts of an id."""
    return [(0, bits)] if bits <= 16 else [(0, 16), (16, bits - 16)]


class _Writer:
    """Low, size and words of every lane."""

    def __init__(self, lanes: int, room: int):
        self.low, self.size = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
        self.words, self.place = np.zeros((lanes, room + 256), np.uint32), np.zeros(lanes, np.int64)

    def reserve(self, n: int) -> None:
        if int(self.place.max()) + n > self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros((len(self.low), self.words.shape[1] // 2 + n), np.uint32)], axis=1)

    def _renew(self, lanes: np.ndarray) -> None:
        while len(lanes):
            part = self.low[lanes]
            self.words[lanes, self.place[lanes]] = part >> 32
            self.low[lanes] = (part & 0xFFFFFFFF) << 16
            self.size[lanes] <<= 16
            self.place[lanes] += 1
            lanes = lanes[self.size[lanes] < 1 << 32]

    def put(self, start: np.ndarray, size: np.ndarray) -> None:
        unit = self.size >> WHOLE
        self.low += unit * start
        self.size = unit * size
        self._renew(np.flatnonzero(self.size < 1 << 32))

    def put_raw(self, lanes: np.ndarray, value: np.ndarray, bits: int) -> None:
        unit = self.size[lanes] >> bits
        self.low[lanes] += unit * value
        self.size[lanes] = unit
        self._renew(lanes[unit < 1 << 32])

    def close(self) -> list[bytes]:
        self.reserve(4)
        lane = np.arange(len(self.low))
        for down in (32, 16, 0):
            self.words[lane, self.place] = (self.low >> down) & (0x1FFFF if down == 32 else 0xFFFF)
            self.place += 1
        for column in range(int(self.place.max()) - 1, 0, -1):
            self.words[:, column - 1] += self.words[:, column] >> 16
        whole = self.words.astype("<u2")
        return [whole[i, :n].tobytes() for i, n in enumerate(self.place.tolist())]


def _encode(ids: np.ndarray, lanes: int, bits: int) -> list[list[bytes]]:
    """Words of each lane of blocks (rows of ``lanes`` x steps ids)."""
    blocks, steps = len(ids), ids.shape[1] // lanes
    by_step = ids.reshape(blocks, lanes, steps).transpose(2, 0, 1)
    padded = np.zeros((steps + 2, blocks, lanes), np.int64)
    padded[2:] = by_step
    models, out = [Model(bits) for _ in range(blocks)], _Writer(blocks * lanes, steps)
    for a, b in _rounds(steps):
        start, size, escape = (np.empty((b - a, blocks, lanes), t) for t in (np.int64, np.int64, bool))
        contexts = []
        for i, model in enumerate(models):
            own = [padded[a + d : b + d, i].ravel() for d in range(3)]
            contexts.append(own)
            for whole, part in zip((start, size, escape), model.intervals(*own), strict=True):
                whole[:, i] = part.reshape(b - a, lanes)
        for t in range(a, b):
            if t % 16 == 0:
                out.reserve(160)  # ten words an id at most
            out.put(start[t - a].ravel(), size[t - a].ravel())
            raw = np.flatnonzero(escape[t - a].ravel())
            if len(raw):
                value = padded[t + 2].ravel()[raw]
                for shift, n in _parts(bits):
                    out.put_raw(raw, value >> shift & ((1 << n) - 1), n)
        if b < steps:
            for model, own in zip(models, contexts, strict=True):
                model.learn(*own)
    words = out.close()
    return [words[i * lanes : (i + 1) * lanes] for i in range(blocks)]


def _decode(words: list[list[bytes]], steps: int, bits: int) -> np.ndarray:
    """Ids [blocks, lanes x steps] of the words of each lane."""
    blocks, lanes = len(words), len(words[0])
    n = blocks * lanes
    flat_words = [w for own in words for w in own]
    longest = max(map(len, flat_words)) // 2 + 8
    sent = np.zeros((n, longest), np.int64)
    for i, part in enumerate(flat_words):
        sent[i, : len(part) // 2] = np.frombuffer(part, "<u2")
    code, place = sent[:, 0] << 32 | sent[:, 1] << 16 | sent[:, 2], np.arange(n) * longest + 3
    ends, sent = np.arange(1, n + 1) * longest - 1, sent.ravel()
    size = np.full(n, 1 << 48, np.int64)

    def renew(low: np.ndarray) -> None:
        while len(low):
            at = place[low]
            code[low] = code[low] << 16 | sent[np.minimum(at, ends[low])]
            size[low] <<= 16
            place[low] = at + 1
            low = low[size[low] < 1 << 32]

    models = [Model(bits) for _ in range(blocks)]
    out = np.zeros((steps + 2, n), np.int64)
    block = np.repeat(np.arange(blocks), lanes)
    slots = block * SLOTS
    for a, b in _rounds(steps):
        rows, most = max(len(m.table) for m in models), max(len(m.ids) for m in models)
        # where the search of a row starts, by the upper bits of what is looked for, and how far it may go
        coarse = np.zeros((blocks, rows, COARSE), np.int32)
        span = 1
        for i, m in enumerate(models):
            inner = m.table[:, 1:-1]
            at = (inner + (1 << MIXED) // COARSE - 1) * COARSE >> MIXED
            counts = np.bincount((at + np.arange(len(inner))[:, None] * (COARSE + 1)).ravel(), minlength=len(inner) * (COARSE + 1)).reshape(len(inner), COARSE + 1)
            coarse[i, : len(inner)] = np.cumsum(counts, axis=1)[:, :COARSE]
            span = max(span, int(counts.max()) + 1)
        top = 1 << (span.bit_length() - 1)
        # rows padded so that the search needs no bounds
        width = most + 2 * top
        table = np.full((blocks, rows, width), 1 << 30, np.int32)
        row, ids = np.zeros((blocks, most), np.int64), np.zeros((blocks, most), np.int64)
        for i, m in enumerate(models):
            table[i, : len(m.table), : m.table.shape[1]] = m.table
            row[i, : len(m.row)] = m.row + i * rows
            ids[i, : len(m.ids)] = m.ids
        table, row, ids, coarse = table.ravel(), row.ravel(), ids.ravel(), coarse.ravel()
        first = block * most
        last, share = np.concatenate([m.last for m in models]), np.concatenate([m.share for m in models])
        previous = np.concatenate([m.symbol(out[a + 1, i * lanes : (i + 1) * lanes]) for i, m in enumerate(models)]).astype(np.int64)
        for t in range(a, b):
            at = slot(out[t], out[t + 1]) + slots
            part = share[at]
            unit = size >> WHOLE
            # quotients of less than 22 bits by less than 28: the double nearest to one lies on the same side of any integer
            target = np.minimum((code / unit).astype(np.int64), (1 << WHOLE) - 1)
            rest = (1 << WHOLE) - part
            inside = np.maximum((((target - part + 1) << MIXED) - 1) / rest, 0).astype(np.int32)
            own_row = row[previous + first]
            left = own_row * width
            found, step = left + coarse.take(own_row * COARSE + (inside >> COARSE_SHIFT)), top
            while step:
                found += (table.take(found + step) <= inside) * step
                step >>= 1
            low = part + (table[found].astype(np.int64) * rest >> MIXED)
            high = part + (table[found + 1].astype(np.int64) * rest >> MIXED)
            symbol = found - left
            hit = target < part
            if hit.any():
                low, high, symbol = np.where(hit, 0, low), np.where(hit, part, high), np.where(hit, last[at], symbol)
            code -= unit * low
            np.multiply(unit, high - low, out=size)
            renew(np.flatnonzero(size < 1 << 32))
            own = ids[symbol + first]
            raw = np.flatnonzero(symbol == 0)
            if len(raw):
                value = np.zeros(len(raw), np.int64)
                for shift, k in _parts(bits):
                    part_unit = size[raw] >> k
                    some = np.minimum(code[raw] // part_unit, (1 << k) - 1)
                    code[raw] -= part_unit * some
                    size[raw] = part_unit
                    renew(raw[part_unit < 1 << 32])
                    value |= some << shift
                own[raw] = value
            out[t + 2] = own
            previous = symbol
        if b < steps:
            for i, m in enumerate(models):
                m.learn(*(out[a + d : b + d, i * lanes : (i + 1) * lanes].ravel() for d in range(3)))
    return out[2:].reshape(steps, blocks, lanes).transpose(1, 2, 0).reshape(blocks, lanes * steps)


def _shape(count: int) -> tuple[int, int]:
    """Lanes and steps of a block of ``count`` ids."""
    lanes = min(LANES, max(1, -(-count // STEPS)))
    return lanes, -(-count // lanes)


def encode_blocks(ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(count, CRC-32 of the ids, coded bytes) of every block of a stream of ids."""
    if len(ids) and int(ids.max()) >= 1 << 29:
        raise ValueError("ids must be below 2**29")
    out = []
    whole = len(ids) // BLOCK * BLOCK
    spans = [(a, min(a + GROUP * BLOCK, whole)) for a in range(0, whole, GROUP * BLOCK)] + ([(whole, len(ids))] if whole < len(ids) else [])
    for a, b in spans:
        count = min(BLOCK, b - a)
        lanes, steps = _shape(count)
        rows = np.full((-(-(b - a) // count), lanes * steps), int(ids[b - 1]), np.int64)
        rows[:, :count] = ids[a:b].reshape(len(rows), count)
        bits = max(1, int(rows.max()).bit_length())
        for row, words in zip(rows, _encode(rows, lanes, bits), strict=True):
            sizes = np.array([len(w) // 2 for w in words], "<u2")
            out.append((count, zlib.crc32(row[:count].astype("<u4").tobytes()), struct.pack("<BH", bits, lanes) + sizes.tobytes() + b"".join(words)))
    return out


def _lane_words(count: int, data: bytes) -> tuple[int, list[bytes]]:
    """(bits, words of each lane) of a block's coded bytes."""
    if len(data) < 3:
        raise ValueError("block header")
    bits, lanes = struct.unpack_from("<BH", data)
    if not 1 <= bits <= 29 or not count or lanes != _shape(count)[0] or len(data) < 3 + 2 * lanes:
        raise ValueError("block header")
    sizes = np.frombuffer(data, "<u2", lanes, 3).astype(np.int64) * 2
    ends = 3 + 2 * lanes + np.cumsum(sizes)
    if int(ends[-1]) != len(data) or int(sizes.min()) < 6:
        raise ValueError("block header")
    return bits, [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def decode_blocks(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Ids of blocks in order; each is checked against its CRC."""
    out: list[np.ndarray] = []
    group: list[tuple[int, int, list[bytes]]] = []
    kind: tuple[int, int] | None = None

    def flush() -> None:
        if not group:
            return
        count, bits = kind
        for row, (_, crc, _) in zip(_decode([words for _, _, words in group], _shape(count)[1], bits), group, strict=True):
            ids = row[:count].astype("<u4")
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError("block checksum")
            out.append(ids)
        group.clear()

    for count, crc, data in blocks:
        bits, words = _lane_words(count, data)
        if kind != (count, bits) or len(group) == GROUP:
            flush()
            kind = (count, bits)
        group.append((count, crc, words))
    flush()
    return np.concatenate(out) if out else np.zeros(0, "<u4")
