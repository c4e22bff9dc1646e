"""FLAC media columns: lossless 8-bit mono streams with a seek point per frame.

Encoder: frames of ``BLOCK`` samples, each a constant, verbatim, fixed-predictor or
linear-predictor subframe (``ORDER`` coefficients of ``PRECISION`` bits from the
frame's autocorrelation) with one Rice partition, whichever is least.  Decoder: two
paths with the same result.
``decode_lanes`` takes many frames of this profile at once: step *t* reads the
Rice code of sample *t* of every frame with numpy.  ``decode`` is the general
one, a bit reader for any mono or stereo stream up to 16 bits with constant,
verbatim, fixed and LPC subframes, partitions and escapes.  Both check the CRC-8
of a frame's header and the CRC-16 of the frame, and the sample count.  What they
give are PCM blocks of ``PCM`` samples, each with the offset of its first sample.

Defined results: a null payload is an empty one; an empty payload is padded to
one block; very long payloads are encoded ``LANES`` frames at a time; equal
payloads give equal media; columns other than the id and the payload are not
read.  A damaged stream raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compressed

BLOCK = 576
LANES = 1024
#: linear predictor: coefficients, and bits of each
ORDER, PRECISION = 4, 8
#: samples of a PCM block
PCM = 16 * BLOCK
PAD = b"\xff"


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, (table << 1) ^ poly, table << 1) & ((1 << bits) - 1)
    return table.astype(np.uint32)


CRC8 = _crc_table(0x07, 8)
CRC16 = _crc_table(0x8005, 16)
#: Leading zeros of a 16-bit number.
ZEROS = (16 - np.ceil(np.log2(np.arange(65536, dtype=np.float64) + 1))).astype(np.int64)


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = int(CRC8[value ^ byte])
    return value


def crc16(data: bytes) -> int:
    value = 0
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ int(CRC16[value >> 8 ^ byte])
    return value


def _crc16_lanes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges of ``data``."""
    order = np.argsort(-length, kind="stable")
    at, left = start[order], length[order]
    value = np.zeros(len(start), dtype=np.uint32)
    most = int(left[0]) if len(left) else 0
    counts = len(left) - np.searchsorted(left[::-1], np.arange(most), side="right")
    for step in range(most):
        n = counts[step]
        part = value[:n]
        value[:n] = ((part << 8) & 0xFFFF) ^ CRC16[(part >> 8) ^ data[at[:n] + step]]
    out = np.empty_like(value)
    out[order] = value
    return out


def _coded_number(number: int) -> bytes:
    """A frame number in the UTF-8 style of the format (up to 36 bits)."""
    if number < 0x80:
        return bytes([number])
    extra = 1
    while number >> (6 * extra + 6 - extra) and extra < 6:
        extra += 1
    head = (0xFF << (7 - extra)) & 0xFF | number >> 6 * extra
    return bytes([head, *(0x80 | number >> 6 * i & 0x3F for i in range(extra - 1, -1, -1))])


_HEADERS: dict[int, bytes] = {}


def _frame_header(number: int) -> bytes:
    """Sync, 576 samples, rate from STREAMINFO, mono, 8 bits, number, CRC-8."""
    found = _HEADERS.get(number)
    if found is None:
        head = bytes([0xFF, 0xF8, 0x20, 0x02]) + _coded_number(number)
        found = head + bytes([crc8(head)])
        if number < 100_000:
            _HEADERS[number] = found
    return found


def _residuals(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best fixed order (0 to 2) per frame and the residuals, warm-up samples first."""
    first = np.diff(samples, axis=1)
    second = np.diff(first, axis=1)
    cost = np.stack([np.abs(samples[:, 2:]).sum(1), np.abs(first[:, 1:]).sum(1), np.abs(second).sum(1)])
    order = np.argmin(cost, axis=0)
    chosen = samples.copy()
    one, two = order == 1, order == 2
    chosen[one, 1:] = first[one]
    chosen[two, 2:] = second[two]
    return order, chosen


def _predictors(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer coefficients [frames, ORDER], shift of each frame and residuals, by the Levinson recursion on all frames at once."""
    x = samples.astype(np.float64)
    r = [np.einsum("ij,ij->i", x[:, lag:], x[:, : BLOCK - lag]) for lag in range(ORDER + 1)]
    error = r[0] * (1 + 1e-6) + 1e-3
    a = np.zeros((ORDER, len(x)))
    for i in range(ORDER):
        k = (r[i + 1] - sum((a[j] * r[i - j] for j in range(i)), np.zeros(len(x)))) / error
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error = error * (1 - k * k)
    reach = np.ceil(np.log2(np.maximum(np.abs(a).max(axis=0), 2.0**-14)))
    shift = np.clip(PRECISION - 1 - reach, 0, 15).astype(np.int32)
    most = 1 << (PRECISION - 1)
    q = np.clip(np.rint(a * 2.0**shift), -most, most - 1).astype(np.int32)
    guess = np.zeros(samples.shape, np.int32)
    for j in range(ORDER):
        guess[:, j + 1 :] += q[j][:, None] * samples[:, : BLOCK - 1 - j]
    residual = samples - (guess >> shift[:, None])
    residual[:, :ORDER] = samples[:, :ORDER]
    return q.T, shift, residual


def _rice(residual: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
    """(which samples are coded, folded residuals, Rice parameter, quotients, bits of each sample) of frames."""
    folded = (residual << 1) ^ (residual >> 31)
    coded = np.arange(BLOCK) >= order[:, None]
    mean = np.where(coded, folded, 0).sum(1) / (BLOCK - order)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int64)
    quotient = np.where(coded, folded >> k[:, None], 0)
    return coded, folded, k, quotient, np.where(coded, quotient + 1 + k[:, None], 8)


def _encode_frames(samples: np.ndarray, headers: list[bytes]) -> list[bytes]:
    """Frames (rows of 576 signed 8-bit samples) as bytes."""
    samples = samples.astype(np.int32)
    count = len(samples)
    order, residual = _residuals(samples)
    bits = 18 + _rice(residual, order)[4].sum(1)
    factors, shifts, foretold = _predictors(samples)
    own = 9 + ORDER * PRECISION
    linear = 18 + own + _rice(foretold, np.full(count, ORDER))[4].sum(1) < bits
    residual[linear] = foretold[linear]
    order = np.where(linear, ORDER, order)
    coded, folded, k, quotient, width = _rice(residual, order)
    size = 18 + np.where(linear, own, 0) + width.sum(1)
    constant = (samples == samples[:, :1]).all(1)
    verbatim = ~constant & (size >= 8 + 8 * BLOCK)
    rice = np.flatnonzero(~constant & ~verbatim)
    out: list[bytes] = [b""] * count
    if len(rice):
        head = np.array([len(headers[i]) for i in rice], dtype=np.int64)
        length = head + (size[rice] + 7) // 8 + 2
        start = np.concatenate([[0], np.cumsum(length)])
        data = np.zeros(int(start[-1]) + 8, dtype=np.float64)
        kk, qq, ww, oo, ll = k[rice], quotient[rice], width[rice], order[rice], linear[rice]
        body = (start[:-1] + head) * 8  # bit at which the subframe begins
        # after the warm-up samples come a predictor's own bits, then 10 of the method and the one partition
        extra = np.where(ll, own, 0)
        after = np.where(coded[rice], (10 + extra)[:, None], 0)
        places = [(np.cumsum(ww, axis=1) - ww + body[:, None] + 8 + after + np.where(coded[rice], qq, 0)).ravel()]
        sizes = [np.where(coded[rice], kk[:, None] + 1, 8).ravel()]
        values = [np.where(coded[rice], (1 << kk[:, None]) | (folded[rice] & ((1 << kk[:, None]) - 1)), samples[rice] & 0xFF).ravel()]
        first = body + 8 + 8 * oo
        # method 00 and partition order 0000 are six zero bits
        places.append(first + extra + 6), sizes.append(np.full(len(rice), 4)), values.append(kk)
        lpc = np.flatnonzero(ll)
        places.append(first[lpc]), sizes.append(np.full(len(lpc), 9)), values.append((PRECISION - 1) << 5 | shifts[rice[lpc]])
        for j in range(ORDER):
            places.append(first[lpc] + 9 + PRECISION * j), sizes.append(np.full(len(lpc), PRECISION)), values.append(factors[rice[lpc], j] & ((1 << PRECISION) - 1))
        place, n = np.concatenate(places), len(data)
        word = np.concatenate(values).astype(np.int64) << (24 - (place & 7) - np.concatenate(sizes))
        at = place >> 3
        data += np.bincount(at, weights=word >> 16, minlength=n)
        data += np.bincount(at + 1, weights=word >> 8 & 255, minlength=n)
        if int(kk.max()) > 8:
            data += np.bincount(at + 2, weights=word & 255, minlength=n)
        data[start[:-1] + head] += np.where(ll, 32 | ORDER - 1, 8 | oo) << 1
        packed = data.astype(np.uint8)
        for position, i in enumerate(rice):
            a = start[position]
            packed[a : a + head[position]] = np.frombuffer(headers[i], np.uint8)
        check = _crc16_lanes(packed, start[:-1], length - 2)
        packed[start[1:] - 2] = check >> 8
        packed[start[1:] - 1] = check & 255
        whole = packed.tobytes()
        for position, i in enumerate(rice):
            out[i] = whole[start[position] : start[position + 1]]
    for i in np.flatnonzero(constant):
        frame = headers[i] + bytes([0, int(samples[i, 0]) & 0xFF])
        out[i] = frame + crc16(frame).to_bytes(2, "big")
    plain = np.flatnonzero(verbatim)
    if len(plain):
        frames = [headers[i] + b"\x02" + samples[i].astype(np.int8).tobytes() for i in plain]
        length = np.array([len(f) for f in frames], dtype=np.int64)
        data = np.frombuffer(b"".join(frames), np.uint8)
        for i, frame, check in zip(plain, frames, _crc16_lanes(data, np.cumsum(length) - length, length), strict=True):
            out[i] = frame + int(check).to_bytes(2, "big")
    return out


def pad(payload: bytes) -> bytes:
    """The payload with bytes 255 up to a positive multiple of 576."""
    return payload + PAD * (BLOCK - len(payload) if len(payload) < BLOCK else -len(payload) % BLOCK)


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    """STREAMINFO, SEEKTABLE with a point per frame, then the frames."""
    sizes = [len(f) for f in frames]
    info = (
        BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        + (8000 << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big")
        + hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest()
    )
    points = np.zeros(len(frames), dtype=[("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
    points["sample"] = np.arange(len(frames)) * BLOCK
    points["offset"] = np.cumsum([0, *sizes[:-1]])
    points["count"] = BLOCK
    table = b""
    most = (2**24 - 1) // 18
    if len(frames) <= most:  # a longer table has no place in a metadata block
        table = b"\x83" + (18 * len(frames)).to_bytes(3, "big") + points.tobytes()
    return b"fLaC" + (b"\x00" if table else b"\x80") + b"\x00\x00\x22" + info + table + b"".join(frames)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of padded payloads, byte b stored as the sample b - 128."""
    frames: list[bytes] = []
    counts = [len(p) // BLOCK for p in payloads]
    headers = [_frame_header(i) for n in counts for i in range(n)]
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 128).view(np.int8).reshape(-1, BLOCK)
    for a in range(0, len(samples), LANES):
        frames += _encode_frames(samples[a : a + LANES], headers[a : a + LANES])
    out, at = [], 0
    for payload, n in zip(payloads, counts, strict=True):
        out.append(_stream(payload, frames[at : at + n]))
        at += n
    return out


class Bits:
    """Bit reader over bytes, most significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends too early")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n) & ((1 << n) - 1)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n) if n else 0
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        count = 0
        while not self.take(1):
            count += 1
        return count


def metadata(stream: bytes) -> tuple[dict, np.ndarray, int]:
    """STREAMINFO fields, the seek table (sample, offset, count) and where frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, info, points = 4, {}, np.zeros((0, 3), np.int64)
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[:2], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind & 127 == 3:
            table = np.frombuffer(body, dtype=[("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
            points = np.stack([table["sample"].astype(np.int64), table["offset"].astype(np.int64), table["count"].astype(np.int64)], 1)
        at += 4 + size
        if kind & 128:
            return info, points, at


FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _residual(bits: Bits, order: int, block: int) -> list[int]:
    method, partitions = bits.take(2), 1 << bits.take(4)
    wide = 5 if method == 1 else 4
    out: list[int] = []
    for part in range(partitions):
        n, parameter = block // partitions - (order if part == 0 else 0), bits.take(wide)
        if parameter == (1 << wide) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            value = bits.unary() << parameter | (bits.take(parameter) if parameter else 0)
            out.append(value >> 1 ^ -(value & 1))
    return out


def _subframe(bits: Bits, block: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("bad subframe")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
        depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * block
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out, shift, factors = [bits.signed(depth) for _ in range(order)], 0, FIXED[order] if kind < 32 else ()
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            factors = tuple(bits.signed(precision) for _ in range(order))
        for value in _residual(bits, order, block):
            out.append(value + (sum(f * out[-1 - i] for i, f in enumerate(factors)) >> shift))
    else:
        raise ValueError("reserved subframe type")
    return np.array(out, dtype=np.int64) << wasted


def decode(stream: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Samples [first, last) as an array (samples, channels), through the seek table where there is one."""
    info, points, base = metadata(stream)
    last = info["samples"] if last is None else min(last, info["samples"])
    position, at = 0, base
    for sample, offset, _ in points:
        if sample <= first and sample >= position:
            position, at = int(sample), base + int(offset)
    skip, blocks = first - position, []
    sizes = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {8 + i: 256 << i for i in range(8)}
    while position < last:
        bits = Bits(stream, at)
        if bits.take(15) != 0x7FFC:
            raise ValueError("no frame where one should begin")
        bits.take(1)
        size_code, rate_code, layout, depth_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        lead = bits.take(8)
        while lead & 0x80 and lead & 0x40:
            bits.take(8)
            lead = lead << 1 & 0xFF
        block = bits.take(8) + 1 if size_code == 6 else bits.take(16) + 1 if size_code == 7 else sizes[size_code]
        bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0)) if rate_code >= 12 else None
        head = bits.at // 8
        if bits.take(8) != crc8(stream[at:head]):
            raise ValueError("frame header checksum")
        depth = {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24}[depth_code]
        if layout < 8:
            parts = [_subframe(bits, block, depth) for _ in range(layout + 1)]
        else:
            parts = [_subframe(bits, block, depth + (layout == 9)), _subframe(bits, block, depth + (layout != 9))]
            if layout == 8:
                parts[1] = parts[0] - parts[1]
            elif layout == 9:
                parts[0] = parts[0] + parts[1]
            else:
                middle = parts[0] << 1 | parts[1] & 1
                parts = [middle + parts[1] >> 1, middle - parts[1] >> 1]
        end = (bits.at + 7) // 8
        if int.from_bytes(stream[end : end + 2], "big") != crc16(stream[at:end]):
            raise ValueError("frame checksum")
        blocks.append(np.stack(parts, 1))
        position, at = position + block, end + 2
    whole = np.concatenate(blocks) if blocks else np.zeros((0, info["channels"]), np.int64)
    return whole[skip : skip + max(0, last - first)]


def _decode_frames(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Frames of the encoder's profile at byte ranges of ``data``: a row of samples each."""
    check = _crc16_lanes(data, start, length - 2)
    if (check != (data[start + length - 2].astype(np.uint32) << 8 | data[start + length - 1])).any():
        raise ValueError("frame checksum")
    if (data[start] != 0xFF).any() or (data[start + 1] != 0xF8).any() or (data[start + 2] != 0x20).any() or (data[start + 3] != 0x02).any():
        raise ValueError("no frame of 576 samples, mono, 8 bits")
    lead = data[start + 4].astype(np.int64)
    extra = np.where(lead < 0x80, 0, np.where(lead < 0xE0, 1, np.where(lead < 0xF0, 2, np.where(lead < 0xF8, 3, np.where(lead < 0xFC, 4, 5)))))
    body = start + 5 + extra
    value = np.zeros(len(start), dtype=np.uint32)
    for step in range(int((body - start).max())):
        live = start + step < body
        value = np.where(live, CRC8[value ^ data[np.minimum(start + step, len(data) - 1)]], value)
    if (value != data[body]).any():
        raise ValueError("frame header checksum")
    body = body + 1
    kind = data[body].astype(np.int64)
    out = np.zeros((len(start), BLOCK), dtype=np.int32)
    for i in np.flatnonzero(kind == 0):
        out[i] = data[body[i] + 1].astype(np.int8)
    for i in np.flatnonzero(kind == 2):
        out[i] = data[body[i] + 1 : body[i] + 1 + BLOCK].view(np.int8)
    fixed = np.flatnonzero((kind >= 16) & (kind <= 20) & (kind % 2 == 0) | (kind >= 64) & (kind <= 78) & (kind % 2 == 0))
    if len(fixed) + int(((kind == 0) | (kind == 2)).sum()) != len(kind):
        raise ValueError("a subframe type outside this profile")
    if len(fixed):
        wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        windows = (wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]).astype(np.int64)

        def read(at: np.ndarray, n: int) -> np.ndarray:
            return (windows[np.minimum(at >> 3, len(windows) - 1)] << (at & 7) & 0xFFFFFFFF) >> (32 - n)

        linear = kind[fixed] >= 64
        order, first = np.where(linear, (kind[fixed] >> 1) - 31, (kind[fixed] >> 1) & 7), body[fixed] + 1
        params = 8 * (first + order)
        precision, shift = read(params, 4) + 1, read(params + 4, 5)
        lpc = np.flatnonzero(linear)
        if (shift[lpc] > 15).any() or (precision[lpc] > 15).any():
            raise ValueError("a predictor outside this profile")
        head = np.where(linear, 9 + precision * order, 0)
        factors = np.zeros((8, len(fixed)), np.int64)
        for j in range(int(order[lpc].max()) if len(lpc) else 0):
            value = read(params[lpc] + 9 + precision[lpc] * j, 15) >> (15 - precision[lpc])
            factors[j, lpc] = np.where(j < order[lpc], value - ((value >> (precision[lpc] - 1)) << precision[lpc]), 0)
        place = params + head + 10
        if read(params + head, 6).any():
            raise ValueError("a partition outside this profile")
        k = read(params + head + 6, 4)
        mask, steps = (1 << k) - 1, np.zeros((BLOCK, len(fixed)), dtype=np.int32)
        late = int(order.max())
        for t in range(late):
            warm = t < order
            steps[t] = np.where(warm, data[np.minimum(first + t, len(data) - 1)].astype(np.int8), 0)
        for t in range(BLOCK):
            live = t >= order if t < late else None
            here = place
            window = windows[here >> 3] << (here & 7) & 0xFFFFFFFF
            q = ZEROS[window >> 16]
            at = here + q
            far = np.flatnonzero(q == 16)
            while len(far):
                more = ZEROS[(windows[at[far] >> 3] << (at[far] & 7) & 0xFFFFFFFF) >> 16]
                at[far] += more
                far = far[more == 16]
            q = at - here
            at = at + 1
            low = (windows[at >> 3] << (at & 7) & 0xFFFFFFFF) >> (32 - k) & mask
            value = q << k | low
            value = (value >> 1) ^ -(value & 1)
            if live is None:
                steps[t], place = value, at + k
            else:
                steps[t], place = np.where(live, value, steps[t]), np.where(live, at + k, here)
        if len(lpc):
            own, q, down, lead = steps[:, lpc].astype(np.int64), factors[:, lpc], shift[lpc], order[lpc]
            low, high = int(lead.min()), int(lead.max())
            for t in range(low, BLOCK):
                n = min(t, high)
                guess = (q[:n] * own[t - n : t][::-1]).sum(axis=0) >> down
                own[t] += guess if t >= high else np.where(t >= lead, guess, 0)
            steps[:, lpc] = own
        rows = steps.T.copy()
        for o in (1, 2):
            own = (order == o) & ~linear
            part = rows[own]
            if o == 2:
                part[:, 1] -= part[:, 0]
                part[:, 1:] = np.cumsum(part[:, 1:], axis=1)
            rows[own] = np.cumsum(part, axis=1)
        out[fixed] = rows
    return out


def decode_many(streams: list[bytes]) -> list[bytes]:
    """Padded payloads of the encoder's streams, frames of all streams side by side."""
    starts, lengths, counts, base = [], [], [], 0
    wanted, sums = [], []
    for stream in streams:
        info, points, at = metadata(stream)
        n = info["samples"] // BLOCK
        if len(points) != n or info["bits"] != 8 or info["channels"] != 1:  # no table of frames: the general way
            starts.append(None), lengths.append(None)
        else:
            offset = points[:, 1] + at
            starts.append(offset + base), lengths.append(np.diff(np.append(offset, len(stream))))
        counts.append(n)
        wanted.append(info["samples"]), sums.append(info["md5"])
        base += len(stream)
    data = np.frombuffer(b"".join(streams), np.uint8)
    fast = [i for i, s in enumerate(starts) if s is not None]
    rows = np.zeros((0, BLOCK), np.int32)
    if fast:
        start, length = np.concatenate([starts[i] for i in fast]), np.concatenate([lengths[i] for i in fast])
        parts = []
        for a in range(0, len(start), LANES):
            s, n = start[a : a + LANES], length[a : a + LANES]
            low, high = int(s.min()), int((s + n).max())
            parts.append(_decode_frames(data[low:high], s - low, n))
        rows = np.concatenate(parts)
    out, at = [], 0
    for i, stream in enumerate(streams):
        if starts[i] is None:
            samples = decode(stream)[:, 0]
        else:
            samples = rows[at : at + counts[i]].ravel()
            at += counts[i]
        pcm = samples.astype(np.int8).tobytes()
        if hashlib.md5(pcm).digest() != sums[i] or len(pcm) != wanted[i]:
            raise ValueError("the samples differ from the stream's checksum")
        out.append((np.frombuffer(pcm, np.uint8) ^ 128).tobytes())
    return out


def features(payload: bytes) -> str:
    """Level, loudness, peak and zero crossings of the samples."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())
    return f"samples={len(samples)};mean={samples.mean():.6f};rms={np.sqrt((samples**2).mean()):.6f};peak={int(np.abs(samples).max())};crossings={crossings}"


def _encode_batches(batches: Iterator, group: int) -> Iterator:
    import pyarrow as pa

    from .common import text_groups

    for batch in batches:
        ids, payloads = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).to_pylist()]
        for a, b in text_groups(payloads, group):
            sizes = [len(p) for p in payloads[a:b]]
            media = encode_many([pad(p) for p in payloads[a:b]])
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])


def encode_column(df: DataFrame, id_col: str, payload: str, group: int = 1_000_000) -> DataFrame:
    """id, n_bytes and media: the FLAC stream of each binary payload."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(payload).cast("binary").alias("payload")).mapInArrow(
        lambda it: _encode_batches(it, group), "id bigint, n_bytes bigint, media binary"
    )


def decode_column(media: DataFrame, group: int = 1_000_000) -> DataFrame:
    """id, n_bytes, media and payload: the padded bytes that the stored stream gives back."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .common import text_groups

        for batch in batches:
            streams = batch.column(2).to_pylist()
            for a, b in text_groups(streams, group):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(decode_many(streams[a:b]), pa.binary())], names=["id", "n_bytes", "media", "payload"])

    return media.select("id", "n_bytes", "media").mapInArrow(run, "id bigint, n_bytes bigint, media binary, payload binary")


def pcm_column(media: DataFrame, block_samples: int = PCM, group: int = 1_000_000) -> DataFrame:
    """id, n_bytes, media and blocks: PCM blocks (first_sample, n_samples, pcm) of each stream, in order.

    Streams of the encoder's profile are decoded side by side, others one by one;
    samples of up to 8 bits take a byte each, others two.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .common import text_groups

        for batch in batches:
            streams = batch.column(2).to_pylist()
            for a, b in text_groups(streams, group):
                pcm, width = [], []
                infos = [metadata(x)[0] for x in streams[a:b]]
                own = [i for i, info in enumerate(infos) if info["bits"] == 8 and info["channels"] == 1]
                whole = dict(zip(own, decode_many([streams[a + i] for i in own]), strict=True))
                for i, info in enumerate(infos):
                    width.append((1 if info["bits"] <= 8 else 2) * info["channels"])
                    if i in whole:
                        pcm.append((np.frombuffer(whole[i], np.uint8) ^ 128).tobytes())
                    else:
                        pcm.append(decode(streams[a + i]).astype("i1" if info["bits"] <= 8 else "<i2").tobytes())
                counts = [-(-info["samples"] // block_samples) for info in infos]
                ends = np.cumsum([0, *counts])
                first = np.concatenate([np.arange(n) * block_samples for n in counts] or [np.zeros(0)]).astype(np.int64)
                held = np.concatenate([np.minimum(block_samples, info["samples"] - np.arange(n) * block_samples) for n, info in zip(counts, infos, strict=True)] or [np.zeros(0)]).astype(np.int64)
                places = np.concatenate([[0], np.cumsum(held * np.repeat(width, counts))]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(places), pa.py_buffer(b"".join(pcm))])
                blocks = pa.StructArray.from_arrays([pa.array(first), pa.array(held), data], names=["first_sample", "n_samples", "pcm"])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), blocks)], names=["id", "n_bytes", "media", "blocks"])

    kind = "id bigint, n_bytes bigint, media binary, blocks array<struct<first_sample: bigint, n_samples: bigint, pcm: binary>>"
    return media.select("id", "n_bytes", "media").mapInArrow(run, kind)


def pcm_blocks(media: DataFrame, block_samples: int = PCM) -> DataFrame:
    """PCM blocks of each stream, (id, block, first_sample, n_samples, pcm), addressable by sample offset."""
    rows = media if "n_bytes" in media.columns else media.withColumn("n_bytes", F.lit(None).cast("long"))
    return pcm_column(rows, block_samples).select("id", F.posexplode("blocks").alias("block", "b")).select("id", "block", "b.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: digests of the stored stream and of the PCM blocks that it gives back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("payload"))

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: dict = {"doc_id": batch.column(0), "n_bytes": batch.column(1), "payload_bytes": [], "payload_sha256": [], "tail_crc32": [], "media_bytes": [], "media_sha256": [], "feature": []}
            for media, blocks in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                pcm = b"".join(blocks.values.field("pcm").to_pylist())
                payload = (np.frombuffer(pcm, np.uint8) ^ 128).tobytes()
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-32:]))
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(hashlib.sha256(media).hexdigest())
                out["feature"].append(features(payload))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    media = compressed(encode_column(docs, "doc_id", "payload"), "media", level=9, page_bytes=8 << 20)
    return pcm_column(media).mapInArrow(digest, schema)
