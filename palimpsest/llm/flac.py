"""FLAC media columns: encode 8-bit mono samples, decode them frame-parallel, and cut PCM blocks that can be sought.

A frame can only be found by its sync code, so the decoder collects the places that hold a sync code, a header whose
CRC-8 agrees and the frame number that is due. All frames of many streams are then decoded in step: sample ``i`` of
every frame at once, first its Rice code, then the predictor's sum. CRC-16 of each frame, the place where it ends and
the stream's MD5 must agree, or the stream is reported as broken. Samples leave as PCM blocks of 8 unsigned bits (as WAV
has them), each with the offset of its first sample.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import flat, slices

# Fixed values of the format (RFC 9639).
MARK = b"fLaC"
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
RATE = 8000

BLOCK = 256  # samples a frame, as this encoder writes them
PCM_BLOCK = 1 << 16  # samples of a PCM block, and between the encoder's seek points
LPC_ORDER = 4  # of the quantised predictors that the encoder tries
SLICE = 2 << 20  # bytes of rows taken together; a longer row is taken alone
ENCODE_FRAMES, DECODE_FRAMES = 1 << 11, 1 << 13  # frames in step, however long a stream is


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each byte span, all spans in step."""
    table = CRC8 if bits == 8 else CRC16
    order = np.argsort(start - end, kind="stable")  # longest first: those still running are a prefix
    at, n = start[order], (end - start)[order]
    crc = np.zeros(len(at), dtype=np.uint32)
    live = len(at) - np.searchsorted(n[::-1], np.arange(int(n[0]) if len(n) else 0), side="right")
    for i, m in enumerate(live):
        crc[:m] = table[(crc[:m] >> (bits - 8) ^ data[at[:m] + i]) & 0xFF] ^ (crc[:m] << 8 & ((1 << bits) - 1))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's variable-length code: bytes (n x 7) and their count."""
    size = 1 + sum((values >= 1 << b).astype(np.int64) for b in (7, 11, 16, 21, 26, 31))
    out = np.zeros((len(values), 7), dtype=np.uint8)
    for n in range(1, 8):
        rows = size == n
        if rows.any():
            v = values[rows]
            lead = 0 if n == 1 else 0x100 - (1 << (8 - n))
            out[rows, 0] = lead | (v >> (6 * (n - 1)))
            for j in range(1, n):
                out[rows, j] = 0x80 | (v >> (6 * (n - 1 - j)) & 0x3F)
    return out, size


def _put(words: np.ndarray, end: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    """Set bit fields in big-endian 64-bit ``words``: each ``value`` of ``width`` bits ends just before bit ``end``.
    The ends ascend, so the fields of one word are one run."""
    if not len(end):
        return
    last = end - 1
    word, off = last >> 6, (63 - (last & 63)).astype(np.uint64)
    value = value.astype(np.uint64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
    words[word[first]] |= np.bitwise_or.reduceat(value << off, first)
    over = np.flatnonzero(off.astype(np.int64) + width > 64)
    words[word[over] - 1] |= value[over] >> (np.uint64(64) - off[over])


def _lpc(frames: np.ndarray, order: int, shift: int) -> np.ndarray:
    """Quantised predictor coefficients of each frame, from its autocorrelation."""
    x = frames.astype(np.float64)
    auto = np.stack([np.einsum("ij,ij->i", x[:, k:], x[:, : x.shape[1] - k]) for k in range(order + 1)], axis=1)
    lag = np.abs(np.arange(order)[:, None] - np.arange(order)[None, :])
    solved = np.linalg.solve(auto[:, lag] + np.eye(order) * (auto[:, :1, None] * 1e-3 + 1), auto[:, 1:, None])[..., 0]
    return np.clip(np.round(solved * (1 << shift)), -(1 << 11), (1 << 11) - 1).astype(np.int64)


def _encode_frames(payloads: np.ndarray, start: np.ndarray, number: np.ndarray, size: np.ndarray, lpc_order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some frames, and the length of each."""
    F = len(start)
    lane = np.arange(BLOCK)
    real = lane < size[:, None]
    x = np.where(real, payloads[np.minimum(start[:, None] + lane, len(payloads) - 1)].astype(np.int32) - 128, 0)

    def residual(rows: np.ndarray | slice, order: int) -> np.ndarray:
        part = x[rows]
        res = part.copy()
        for lag, c in enumerate(FIXED[order], 1):
            res[:, lag:] -= c * part[:, :-lag]
        res[:, :order] = 0
        return np.where(real[rows], res, 0)

    def bits(res: np.ndarray, order: int, extra: int) -> np.ndarray:
        """About as many as the residuals take in the best Rice code, and what stands before them."""
        n = np.maximum(size - order, 1)
        return n * np.log2(1 + 2 * np.abs(res).sum(axis=1) / n) + np.where(size > order, 8 * order + extra, 1 << 30)

    size_of = [bits(residual(slice(None), order), order, 0) for order in range(3)]
    shift, coefficients, left = 9, None, None
    if lpc_order:
        coefficients = _lpc(x, lpc_order, shift)
        guess = np.zeros(x.shape, dtype=np.int64)
        for lag in range(1, lpc_order + 1):
            guess[:, lag:] += coefficients[:, lag - 1 : lag] * x[:, :-lag]
        left = np.where(real & (lane >= lpc_order), x - (guess >> shift), 0).astype(np.int32)
        size_of.append(bits(left, lpc_order, 9 + 12 * lpc_order))
    kind = np.argmin(size_of, axis=0)
    orders = (0, 1, 2, lpc_order)
    codes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    body = np.zeros(F, dtype=np.int64)
    for which in range(len(size_of)):
        rows, order = np.flatnonzero(kind == which), orders[which]
        res = left[rows] if which == 3 else residual(rows, order)
        u = res << 1 ^ res >> 31
        n = np.maximum(size[rows] - order, 1)
        k = np.clip(np.ceil(np.log2(np.maximum(u.sum(axis=1) / n, 1)) - 0.5), 0, 14).astype(np.int32)
        body[rows] = 10 + 8 * order + (9 + 12 * order) * (which == 3) + (u >> k[:, None]).sum(axis=1) + n * (k + 1)
        codes.append((rows, u, k))
    constant = np.where(real, x, x[:, :1]).max(axis=1) == np.where(real, x, x[:, :1]).min(axis=1)
    plain = ~constant & (body >= 8 * size)
    body = np.where(constant, 8, np.where(plain, 8 * size, body))

    num, num_size = _number(number)
    short = size != BLOCK
    head = 5 + num_size + short  # with its CRC-8
    length = head + (8 + body + 7) // 8 + 2
    at = np.concatenate(([0], np.cumsum(length)))
    words = np.zeros(int(at[-1]) // 8 + 2, dtype=np.uint64)
    sub = 8 * (at[:-1] + head) + 8  # after the subframe's header byte

    def put(ends: np.ndarray, value: np.ndarray, width: int) -> None:
        _put(words, ends, value, np.full(len(ends), width))

    put(sub, np.where(constant, 0, np.where(plain, 1, np.where(kind == 3, 31 + lpc_order, 8 + kind))) << 1, 8)
    rows = np.flatnonzero(constant)
    put(sub[rows] + 8, x[rows, 0] & 0xFF, 8)
    rows = np.flatnonzero(plain)
    ok = real[rows]
    put((sub[rows][:, None] + 8 * (lane + 1))[ok], (x[rows] & 0xFF)[ok], 8)
    for which, (rows, u, k) in enumerate(codes):
        chosen = ~(constant | plain)[rows]
        rows, u, k, order = rows[chosen], u[chosen], k[chosen], orders[which]
        for i in range(order):
            put(sub[rows] + 8 * (i + 1), x[rows, i] & 0xFF, 8)
        pos = sub[rows] + 8 * order
        if which == 3:
            put(pos + 9, np.full(len(rows), 11 << 5 | shift), 9)
            for i in range(order):
                put(pos + 9 + 12 * (i + 1), coefficients[rows, i] & 0xFFF, 12)
            pos = pos + 9 + 12 * order
        put(pos + 10, k, 10)  # method 0, partition order 0, then the 4-bit parameter
        u, k = u[:, order:], k[:, None]
        ok = real[rows][:, order:]
        width = np.where(ok, (u >> k) + (1 + k), 0)
        ends = (pos + 10)[:, None] + np.cumsum(width, axis=1, dtype=np.int32)
        low = u & (1 << k) - 1 | 1 << k
        if ok.all():
            _put(words, ends.ravel(), low.ravel(), np.broadcast_to(k + 1, ok.shape).ravel())
        else:
            _put(words, ends[ok], low[ok], np.broadcast_to(k + 1, ok.shape)[ok])
    out = words.astype(">u8").view(np.uint8)[: int(at[-1])]
    base = at[:-1]
    out[base], out[base + 1] = 0xFF, 0xF8
    out[base + 2] = np.where(short, 0x60, 0x80)
    out[base + 3] = 0x02  # mono, 8 bits
    for j in range(7):
        rows = np.flatnonzero(num_size > j)
        out[base[rows] + 4 + j] = num[rows, j]
    rows = np.flatnonzero(short)
    out[base[rows] + 4 + num_size[rows]] = size[rows] - 1
    crc_at = base + head - 1
    out[crc_at] = crc_spans(out, base, crc_at, 8)
    tail = base + length - 2
    crc = crc_spans(out, base, tail, 16)
    out[tail], out[tail + 1] = crc >> 8, crc & 0xFF
    return out, length


def encode(payloads: np.ndarray, offsets: np.ndarray, lpc_order: int = 0, seek: int = PCM_BLOCK) -> list[bytes]:
    """One FLAC stream for each span of bytes; a byte b is the 8-bit sample b - 128. Spans must not be empty.

    A frame takes the smallest of: constant, fixed predictors of order 0 to 2, a quantised predictor of ``lpc_order``
    (0: not tried), verbatim. Residuals are one Rice partition a frame. Streams of more than ``seek`` samples (a multiple
    of BLOCK) have a table of seek points so far apart.
    """
    count = np.diff(offsets)
    frames = -(-count // BLOCK)
    doc = np.repeat(np.arange(len(count)), frames)
    first = np.concatenate(([0], np.cumsum(frames)))
    number = np.arange(len(doc)) - first[doc]
    start = offsets[doc] + number * BLOCK
    size = np.minimum(BLOCK, offsets[doc + 1] - start)
    parts = [_encode_frames(payloads, start[i : i + ENCODE_FRAMES], number[i : i + ENCODE_FRAMES], size[i : i + ENCODE_FRAMES], lpc_order) for i in range(0, len(doc), ENCODE_FRAMES)]
    at = np.concatenate(([0], np.cumsum(np.concatenate([p[1] for p in parts])))) if parts else np.zeros(1, np.int64)
    out = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint8)

    raw, made = (payloads ^ 0x80).tobytes(), out.tobytes()
    streams = []
    for i, n in enumerate(count.tolist()):
        md5 = hashlib.md5(raw[offsets[i] : offsets[i + 1]]).digest()
        info = BLOCK.to_bytes(2) * 2 + bytes(6) + (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8) + md5
        points = b""
        if n > seek:
            for f in range(0, int(frames[i]), seek // BLOCK):
                points += (f * BLOCK).to_bytes(8) + int(at[first[i] + f] - at[first[i]]).to_bytes(8) + min(BLOCK, n - f * BLOCK).to_bytes(2)
            points = b"\x83" + len(points).to_bytes(3) + points
        streams.append(MARK + (b"\x00" if points else b"\x80") + len(info).to_bytes(3) + info + points + made[at[first[i]] : at[first[i + 1]]])
    return streams


def seek_points(stream: bytes) -> list[tuple[int, int, int]]:
    """(first sample, place in the stream, samples) of the frames in a stream's seek table, in order; none without one."""
    at, found, last = 4, [], 0
    while not last and at + 4 <= len(stream):
        last, kind, size = stream[at] & 0x80, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4])
        if kind == 3:
            found = [stream[p : p + 18] for p in range(at + 4, at + 4 + size, 18)]
        at += 4 + size
    return [(int.from_bytes(p[:8]), at + int.from_bytes(p[8:16]), int.from_bytes(p[16:])) for p in found if p[:8] != b"\xff" * 8]


class Broken(ValueError):
    """A stream that a checksum, a frame's place or its MD5 contradicts."""


def _frames(data: np.ndarray, lo: int, hi: int, places: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, first byte after the header, samples) of the frames in ``data[lo:hi]``."""
    found, due = [], 0
    raw = data
    for p in places.tolist():
        if p + 6 > hi:
            break
        lead, n = int(raw[p + 4]), 1
        if lead >= 0x80:
            n = 8 - (lead ^ 0xFF).bit_length()
            if not 2 <= n <= 7:
                continue
        value = lead if n == 1 else lead & ((1 << (7 - n)) - 1)
        for j in range(1, n):
            value = value << 6 | int(raw[p + 4 + j]) & 0x3F
        if value != due:
            continue
        code, q = int(raw[p + 2]) >> 4, p + 4 + n
        if code == 6:
            size, q = int(raw[q]) + 1, q + 1
        elif code == 7:
            size, q = (int(raw[q]) << 8 | int(raw[q + 1])) + 1, q + 2
        elif code == 1:
            size = 192
        elif 2 <= code <= 5:
            size = 576 << (code - 2)
        elif code >= 8:
            size = 256 << (code - 8)
        else:
            continue
        crc = 0
        for b in raw[p:q].tolist():
            crc = int(CRC8[crc ^ b])
        if crc == int(raw[q]):
            found.append((p, q + 1, size))
            due += 1
    return found


def _decode_frames(data: np.ndarray, start: np.ndarray, pos: np.ndarray, size: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The samples of some frames one after the other. ``pos``: the first byte after each header."""
    F, most = len(start), int(size.max(initial=0))
    words = np.ndarray(shape=(len(data) - 7,), dtype=">u8", buffer=data.data, strides=(1,))
    pos = pos * 8

    def read(p: np.ndarray, width: int) -> np.ndarray:
        w = words[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        return (w >> np.uint64(64 - width)).astype(np.int64)

    def signed(v: np.ndarray, width: int) -> np.ndarray:
        return v - ((v >> (width - 1) & 1) << width)

    kind = read(pos, 8)
    if (kind & 0x81).any():
        raise Broken("a subframe with wasted bits or a bad header")
    kind = kind >> 1
    pos = pos + 8
    x = np.zeros((most + 32, F), dtype=np.int32)  # 32 rows of zeros stand before the first sample
    constant, plain = kind == 0, kind == 1
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | plain | fixed | lpc).all():
        raise Broken("unknown subframe")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    rows = np.flatnonzero(constant)
    x[32:, rows] = signed(read(pos[rows], 8), 8)
    pos[rows] += 8
    for i in range(int(size[plain].max(initial=0))):
        rows = np.flatnonzero(plain & (size > i))
        x[32 + i, rows] = signed(read(pos[rows], 8), 8)
        pos[rows] += 8
    for i in range(int(order.max(initial=0))):
        rows = np.flatnonzero(order > i)
        x[32 + i, rows] = signed(read(pos[rows], 8), 8)
        pos[rows] += 8
    taps = int(order.max(initial=0))
    coefficient, shift = np.zeros((taps, F), dtype=np.int64), np.zeros(F, dtype=np.int64)
    for o in range(1, min(taps, 4) + 1):
        for lag, c in enumerate(FIXED[o]):
            coefficient[lag, fixed & (order == o)] = c
    rows = np.flatnonzero(lpc)
    if len(rows):
        width = read(pos[rows], 4) + 1
        shift[rows] = signed(read(pos[rows] + 4, 5), 5)
        pos[rows] += 9
        for lag in range(int(order[rows].max())):
            live = order[rows] > lag
            v = np.zeros(int(live.sum()), dtype=np.int64)
            for w in np.unique(width[live]).tolist():
                hit = width[live] == w
                v[hit] = signed(read(pos[rows][live][hit], w), w)
            coefficient[lag, rows[live]] = v
            pos[rows[live]] += width[live]
    coded = fixed | lpc
    wide, parts = np.zeros(F, dtype=np.int64), np.ones(F, dtype=np.int64)
    rows = np.flatnonzero(coded)
    wide[rows] = 4 + (read(pos[rows], 2) & 1)
    parts[rows] = size[rows] >> read(pos[rows] + 2, 4)
    pos[rows] += 6
    k, raw = np.zeros(F, dtype=np.int64), np.full(F, -1, dtype=np.int64)
    for i in range(most if len(rows) else 0):
        live = np.flatnonzero(coded & (size > i) & (order <= i))
        if not len(live):
            continue
        fresh = live[(i % parts[live] == 0) | (order[live] == i)]
        if len(fresh):
            v = read(pos[fresh], 5) >> 5 - wide[fresh]
            escape = v == (1 << wide[fresh]) - 1
            pos[fresh] += wide[fresh]
            k[fresh], raw[fresh] = v, np.where(escape, read(pos[fresh], 5), -1)
            pos[fresh] += 5 * escape
        at, kk = pos[live], k[live]
        quotient = np.zeros(len(live), dtype=np.int64)
        w = words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        top = (w >> np.uint64(16)).astype(np.float64)
        lead = 48 - np.frexp(top)[1].astype(np.int64)
        long = top == 0
        more = at.copy()
        while long.any():  # a quotient beyond one window
            quotient[long] += 48
            more[long] += 48
            w2 = words[more[long] >> 3].astype(np.uint64) << (more[long] & 7).astype(np.uint64)
            top2 = (w2 >> np.uint64(16)).astype(np.float64)
            lead[long] = 48 - np.frexp(top2)[1].astype(np.int64)
            still = top2 == 0
            long[np.flatnonzero(long)[~still]] = False
        quotient += lead
        after = at + quotient + 1
        w = words[after >> 3].astype(np.uint64) << (after & 7).astype(np.uint64)
        low = ((w >> np.uint64(1)) >> (63 - kk).astype(np.uint64)).astype(np.int64)
        u = quotient << kk | low
        residual = u >> 1 ^ -(u & 1)
        after += kk
        odd = np.flatnonzero(raw[live] >= 0)
        for j in odd.tolist():  # raw samples are rare
            n, p = int(raw[live[j]]), int(at[j])
            residual[j] = int(signed(read(np.array([p]), n), n)[0]) if n else 0
            after[j] = p + n
        pos[live] = after
        guess = np.zeros(len(live), dtype=np.int64)
        for lag in range(taps):
            guess += coefficient[lag, live] * x[31 + i - lag, live]
        x[32 + i, live] = residual + (guess >> shift[live])
    stop = (pos + 7) // 8
    if (stop + 2 != end).any():
        raise Broken("a frame does not end where the next begins")
    if (crc_spans(data, start, stop, 16) != (data[stop].astype(np.uint32) << 8 | data[stop + 1])).any():
        raise Broken("CRC-16")
    x = x[32:].T
    return (x[np.arange(most) < size[:, None]] if F else np.zeros(0)).astype(np.int8)


def decode(streams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples plus 128 as bytes, and their offsets, of mono 8-bit streams; raises Broken."""
    data = np.concatenate([streams, np.zeros(16, np.uint8)])
    sync = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0xF8))
    starts: list[int] = []
    bodies: list[int] = []
    sizes: list[int] = []
    ends: list[int] = []
    count, md5 = [], []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        head = data[lo:hi][:42].tobytes()
        if head[:4] != MARK or len(head) < 42 or head[4] & 0x7F:
            raise Broken("no stream header")
        packed = int.from_bytes(head[18:26])
        if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
            raise Broken("not mono of 8 bits")
        count.append(packed & (1 << 36) - 1)
        md5.append(head[26:42])
        last, at = head[4] & 0x80, lo + 42
        while not last:  # further metadata blocks are stepped over
            last, at = data[at] & 0x80, at + 4 + int.from_bytes(data[at + 1 : at + 4].tobytes())
        own = _frames(data, at, hi, sync[np.searchsorted(sync, at) : np.searchsorted(sync, hi)])
        if sum(f[2] for f in own) != count[-1] or own and own[0][0] != at:
            raise Broken("frames are missing")
        starts += [f[0] for f in own]
        bodies += [f[1] for f in own]
        sizes += [f[2] for f in own]
        ends += [f[0] for f in own[1:]] + [hi] * bool(own)
    start, pos, size, end = (np.array(v, dtype=np.int64) for v in (starts, bodies, sizes, ends))
    samples = [_decode_frames(data, *(v[i : i + DECODE_FRAMES] for v in (start, pos, size, end))) for i in range(0, len(start), DECODE_FRAMES)]
    to = np.concatenate(([0], np.cumsum(count))).astype(np.int64)
    pcm = np.concatenate(samples).view(np.uint8) if samples else np.zeros(0, np.uint8)
    raw_bytes = pcm.tobytes()
    for i, digest in enumerate(md5):
        if hashlib.md5(raw_bytes[to[i] : to[i + 1]]).digest() != digest:
            raise Broken("MD5")
    return pcm ^ 0x80, to


def pad(offsets: np.ndarray, data: np.ndarray, unit: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Each span lengthened with bytes 0 to a positive multiple of ``unit``."""
    n = np.diff(offsets)
    to = np.concatenate(([0], np.cumsum(np.maximum(unit, -(-n // unit) * unit)))).astype(np.int64)
    out = np.zeros(int(to[-1]), dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(to[:-1] - offsets[:-1], n)] = data
    return to, out


def decode_each(streams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Like ``decode``, with a status for each stream: "ok", or why it is broken, and then without samples."""
    try:
        return *decode(streams, offsets), ["ok"] * (len(offsets) - 1)
    except (Broken, IndexError):
        pass
    parts, status = [], []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        try:
            parts.append(decode(streams[lo:hi], np.array([0, hi - lo]))[0])
            status.append("ok")
        except (Broken, IndexError) as e:  # a cut stream points beyond its end
            parts.append(np.zeros(0, np.uint8))
            status.append(str(e) if isinstance(e, Broken) else "cut off")
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64), status


def encode_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lpc_order: int = LPC_ORDER) -> DataFrame:
    """doc_id, n_bytes and ``media``: every whole text, padded, as a FLAC stream. Null text counts as empty; other
    columns are left behind; equal rows give equal rows; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            offsets, data = flat(b.column(1))
            to, payload = pad(offsets, data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(encode(payload, to, lpc_order), type=pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


BLOCKS = "array<struct<sample_offset:long,n_samples:long,pcm:binary>>"
_BLOCK = pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary())])


def _pcm(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Batches that end with column ``media``, and behind it status, n_samples and blocks."""
    for b in slices(batches, "media", SLICE):
        column = b.column(b.num_columns - 1)
        offsets, data = flat(column)
        null = column.is_null().to_numpy(zero_copy_only=False)
        there = np.flatnonzero(~null)
        # Null streams take no bytes, so the others stay in one piece.
        samples, to, told = decode_each(data, np.concatenate((offsets[:-1][there], offsets[-1:])))
        n = np.zeros(b.num_rows, np.int64)
        n[there] = np.diff(to)
        status = np.full(b.num_rows, "null", dtype=object)
        status[there] = told
        blocks = -(-n // block)
        row = np.repeat(np.arange(b.num_rows), blocks)
        first = np.concatenate(([0], np.cumsum(blocks)))
        no = np.arange(len(row)) - first[row]
        size = np.minimum(block, n[row] - no * block)
        ends = np.concatenate(([0], np.cumsum(size)))
        pcm = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(samples.tobytes())])
        made = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(no * block), pa.array(size), pcm], fields=list(_BLOCK)))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(status), pa.string()), pa.array(n), made], names=[*b.schema.names, "status", "n_samples", "blocks"])


def decode_media(media: DataFrame, *, block: int = PCM_BLOCK) -> DataFrame:
    """The streams of column ``media`` as PCM: every other column, and ``status`` ("ok", "null" or why a stream is broken),
    ``n_samples`` and ``blocks``, each with its sample_offset, n_samples and pcm (8 bits unsigned).

    A reader that seeks sample s opens the block with the greatest sample_offset <= s, which is number s div ``block``.
    Null and broken streams have no block and end no job; equal rows give equal rows; an empty table gives none.
    """
    rows = media.select(*[c for c in media.columns if c != "media"], "media")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lambda batches: _pcm(batches, block), f"{fields}, status string, n_samples long, blocks {BLOCKS}")


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """A row for each PCM block: doc_id, block_no, sample_offset, n_samples, pcm. Streams without a block (null, broken or of
    no samples) and an empty table give no rows; equal rows give equal rows."""
    return decoded.select("doc_id", F.posexplode("blocks").alias("block_no", "b")).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "b.sample_offset", "b.n_samples", "b.pcm")


def media_features(media: DataFrame, *, block: int = PCM_BLOCK) -> DataFrame:
    """Digests and features of each stream of ``encode_media``, from the PCM blocks that ``decode_media`` makes of it: peak,
    mean, root mean square and the share of sign changes. Blocks are made and read in one task, so that they need not
    leave it. Null and broken streams have the values of no samples and their ``status`` as the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pcm(batches, block):
            lists = b.column(5)
            pcm = lists.flatten().field("pcm")
            first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ends, samples = flat(pcm)
            to = ends[first]
            raw = samples.tobytes()
            v = samples.astype(np.int16) - 128
            n = np.diff(to)
            full = np.flatnonzero(n > 0)
            at = to[:-1][full]
            flips = np.concatenate((v[1:] < 0, [False])) != (v < 0) if len(v) else np.zeros(0, bool)
            flips[to[1:][full] - 1] = False
            text: list[str] = [f"status={s}" for s in b.column(3).to_pylist()]
            if len(full):
                peak, total = np.maximum.reduceat(np.abs(v), at), np.add.reduceat(v, at, dtype=np.int64)
                square, change = np.add.reduceat(v.astype(np.int32) ** 2, at, dtype=np.int64), np.add.reduceat(flips, at, dtype=np.int64)
                for i, p, s, q, z, m in zip(full.tolist(), peak.tolist(), total.tolist(), square.tolist(), change.tolist(), n[full].tolist()):
                    text[i] = f"peak={p};mean={s / m:.4f};rms={(q / m) ** 0.5:.4f};zcr={z / m:.4f}"
            spans = list(zip(to[:-1].tolist(), to[1:].tolist()))
            offsets, stored = flat(b.column(2))
            kept = stored.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(n),
                    pa.array([hashlib.sha256(raw[p:q]).hexdigest() for p, q in spans]),
                    pa.array([zlib.crc32(raw[max(p, q - 64) : q]) for p, q in spans], type=pa.int64()),
                    pa.array(np.diff(offsets)),
                    pa.array([hashlib.sha256(kept[p:q]).hexdigest() for p, q in zip(offsets[:-1].tolist(), offsets[1:].tolist())]),
                    pa.array(text),
                    pa.array(np.diff(first), pa.int64()),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks"],
            )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"
    )
