import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import flac


def spans(pieces):
    return np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64), np.frombuffer(b"".join(pieces), np.uint8)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=1500), st.text("ab \n", max_size=900).map(str.encode), st.integers(0, 255).map(lambda b: bytes([b]) * 700)), min_size=1, max_size=6), st.sampled_from([0, 1, 3, 8]))
def test_round_trip(pieces, lpc):
    to, payload = flac.pad(*spans(pieces))
    streams = flac.encode(payload, to, lpc)
    at, data = spans(streams)
    samples, back = flac.decode(data, at)
    assert (samples == payload).all() and (back == to).all()


def test_damage_is_noticed():
    to, payload = flac.pad(*spans([b"some ordinary text " * 60]))
    (stream,) = flac.encode(payload, to)
    for place in (60, 200, len(stream) - 30):
        bad = bytearray(stream)
        bad[place] ^= 0x10
        with pytest.raises(flac.Broken):
            flac.decode(*reversed(spans([bytes(bad)])))


def test_crc_against_the_definition():
    data = np.frombuffer(b"123456789", np.uint8)
    assert flac.crc_spans(data, np.array([0]), np.array([9]), 8)[0] == 0xF4
    assert flac.crc_spans(data, np.array([0]), np.array([9]), 16)[0] == 0xFEE8


class Bits:
    """A bit writer for streams made by hand."""

    def __init__(self):
        self.text = ""

    def put(self, value, width):
        self.text += format(value & (1 << width) - 1, f"0{width}b") if width else ""
        return self

    def rice(self, value, k):
        u = value * 2 if value >= 0 else -2 * value - 1
        return self.put(0, u >> k).put(1, 1).put(u, k)

    def bytes(self):
        bits = self.text + "0" * (-len(self.text) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def crc(data, poly, bits):
    value = 0
    for b in data:
        value ^= b << (bits - 8)
        for _ in range(8):
            value = (value << 1 ^ (poly if value >> (bits - 1) else 0)) & ((1 << bits) - 1)
    return value


def frame(number, samples, body):
    """A frame of 8-bit mono samples whose subframe ``body`` writes, its size told in 16 bits."""
    head = bytes([0xFF, 0xF8, 0x70, 0x02, number]) + (len(samples) - 1).to_bytes(2)
    bits = Bits()
    body(bits)
    whole = head + bytes([crc(head, 0x07, 8)]) + bits.bytes()
    return whole + crc(whole, 0x8005, 16).to_bytes(2)


def stream(samples, frames):
    info = (16).to_bytes(2) + (4096).to_bytes(2) + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8) + hashlib.md5(bytes(v & 0xFF for v in samples)).digest()
    other = b"\x01" + (5).to_bytes(3) + bytes(5)  # padding, to be stepped over
    return flac.MARK + b"\x00" + len(info).to_bytes(3) + info + b"\x84"[:0] + b"\x81" + other[1:] + b"".join(frames)


def residuals(samples, order, coefficients, shift):
    return [v - (sum(c * samples[i - 1 - j] for j, c in enumerate(coefficients)) >> shift) for i, v in enumerate(samples) if i >= order]


def test_streams_made_by_hand():
    import random

    rng = random.Random(4)
    wave = [max(-128, min(127, int(60 * np.sin(i / 5) + rng.randint(-3, 3)))) for i in range(192)]

    def lpc(bits):  # order 3, coefficients of 7 bits, shift 4, four partitions of their own parameters, one of them raw
        order, coefficients, shift = 3, [30, -17, 2], 4
        bits.put(0, 1).put(31 + order, 6).put(0, 1)
        for v in wave[:order]:
            bits.put(v, 8)
        bits.put(7 - 1, 4).put(shift, 5)
        for c in coefficients:
            bits.put(c, 7)
        left = residuals(wave, order, coefficients, shift)
        bits.put(0, 2).put(2, 4)
        at = 0
        for part, k in enumerate((2, 3, None, 1)):
            n = 48 - (order if part == 0 else 0)
            if k is None:
                width = max(abs(v) for v in left[at : at + n]).bit_length() + 1
                bits.put(15, 4).put(width, 5)
                for v in left[at : at + n]:
                    bits.put(v, width)
            else:
                bits.put(k, 4)
                for v in left[at : at + n]:
                    bits.rice(v, k)
            at += n

    def five_bits(bits):  # fixed order 4, Rice parameters of five bits, two partitions
        bits.put(0, 1).put(8 + 4, 6).put(0, 1)
        for v in wave[:4]:
            bits.put(v, 8)
        left = residuals(wave, 4, [4, -6, 4, -1], 0)
        bits.put(1, 2).put(1, 4)
        for part, k in ((left[:92], 5), (left[92:], 17)):
            bits.put(k, 5)
            for v in part:
                bits.rice(v, k)

    def verbatim(bits):
        bits.put(0, 1).put(1, 6).put(0, 1)
        for v in wave:
            bits.put(v, 8)

    made = stream(wave * 3, [frame(0, wave, lpc), frame(1, wave, five_bits), frame(2, wave, verbatim)])
    samples, to = flac.decode(*reversed(spans([made])))
    assert (samples.astype(int) - 128).tolist() == wave * 3 and to.tolist() == [0, 576]


def test_predictors_are_used_and_sought():
    tone = bytes(int(128 + 90 * np.sin(i * 2.1)) for i in range(3000))
    to, payload = flac.pad(*spans([tone, b"plain words here " * 90]))
    with_lpc, without = flac.encode(payload, to, 4, seek=512), flac.encode(payload, to, 0, seek=512)
    assert len(with_lpc[0]) < len(without[0])
    points = flac.seek_points(with_lpc[0])
    assert [p[0] for p in points] == list(range(0, 3008, 512)) and points[-1][2] == 256
    assert all(with_lpc[0][at : at + 2] == b"\xff\xf8" for _, at, _ in points)
    samples, _ = flac.decode(*reversed(spans(with_lpc)))
    assert (samples == payload).all()


def test_columns(spark):
    import zlib

    rows = [(1, "abc" * 100, "x"), (2, None, "y"), (3, "", "z"), (None, "é" * 40000, None), (1, "abc" * 100, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    media = flac.encode_media(docs)
    stored = {r.doc_id: bytes(r.media) for r in media.collect()}
    got = flac.media_features(media, block=1000).collect()
    assert len(got) == 5
    for r in got:
        text = next(t or "" for i, t, _ in rows if i == r.doc_id).encode()
        padded = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(padded), hashlib.sha256(padded).hexdigest())
        v = [b - 128 for b in padded]
        changes = sum((a < 0) != (b < 0) for a, b in zip(v, v[1:]))
        feature = f"peak={max(map(abs, v))};mean={sum(v) / len(v):.4f};rms={(sum(x * x for x in v) / len(v)) ** 0.5:.4f};zcr={changes / len(v):.4f}"
        media_sha = hashlib.sha256(stored[r.doc_id]).hexdigest()
        assert (r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == (zlib.crc32(padded[-64:]), len(stored[r.doc_id]), media_sha, feature)
    assert len({tuple(r) for r in got if r.doc_id == 1}) == 1
    blocks = flac.pcm_blocks(flac.decode_media(media, block=1000)).where("doc_id IS NULL").orderBy("block_no").collect()
    assert [(b.sample_offset, b.n_samples) for b in blocks] == [(1000 * i, 1000) for i in range(80)]
    assert b"".join(bytes(b.pcm) for b in blocks).decode() == "é" * 40000
    assert flac.media_features(flac.encode_media(docs.limit(0))).count() == 0


def test_null_and_broken_streams_are_rows(spark):
    to, payload = flac.pad(*spans([b"some ordinary text " * 60]))
    (good,) = flac.encode(payload, to)
    bad = bytearray(good)
    bad[200] ^= 0x10
    rows = [(1, 5, bytearray(good)), (2, 5, bad), (3, 5, None), (4, 5, bytearray(good[:100])), (5, 5, bytearray(b"x")), (6, 5, bytearray(good))]
    media = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").coalesce(1)
    status = {r.doc_id: (r.status, r.n_samples, len(r.blocks)) for r in flac.decode_media(media).collect()}
    assert status[1] == status[6] == ("ok", len(payload), 1) and status[3] == ("null", 0, 0)
    assert all(status[i][0] not in ("ok", "null") and status[i][1:] == (0, 0) for i in (2, 4, 5))
    told = {r.doc_id: r for r in flac.media_features(media).collect()}
    assert told[1].payload_sha256 == hashlib.sha256(payload.tobytes()).hexdigest() and told[3].feature == "status=null" and told[3].payload_bytes == 0
