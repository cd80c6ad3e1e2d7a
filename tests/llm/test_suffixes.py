import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import suffixes


def check(raw, cap, memory):
    text = np.frombuffer(raw, np.uint8)
    order, common = suffixes.suffix_array(text, cap, memory)
    want = sorted(range(len(raw)), key=lambda i: raw[i:])
    shared = lambda a, b: next((k for k in range(min(len(raw) - a, len(raw) - b)) if raw[a + k] != raw[b + k]), min(len(raw) - a, len(raw) - b))
    assert order.tolist() == want
    exact = [0][: len(raw)] + [shared(a, b) for a, b in zip(want, want[1:])]
    assert [min(c, cap) for c in common.tolist()] == [min(c, cap) for c in exact]


TEXTS = st.one_of(st.lists(st.sampled_from(b"ab"), max_size=120), st.lists(st.integers(0, 254), max_size=120), st.lists(st.sampled_from(b"aab\x00c"), max_size=200)).map(bytes)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([3, 8, 50, 10**6]), st.sampled_from([8, 1 << 20]), st.sampled_from([1, 5, 1 << 18]))
def test_against_sorting(raw, cap, memory, block):
    suffixes.BLOCK, before = block, suffixes.BLOCK
    try:
        check(raw, cap, memory)
    finally:
        suffixes.BLOCK = before


@pytest.mark.parametrize("memory", [64, 1 << 10, 1 << 20])
def test_long_repeats(memory):
    """Queues, types and orders on disk and in memory."""
    check(b"abracadabra" * 30 + b"x" + b"abracadabra" * 20, 400, memory)
    check(b"a" * 300 + b"b" * 100 + b"a" * 200, 10**6, memory)
    check((b"the cat sat on the mat. " * 12 + b"\x00") * 3, 100, memory)


def test_a_shard_larger_than_its_memory(tmp_path, monkeypatch):
    """A text of 300 KB with 4 KB of memory for queue and arrays: everything by place is on disk, and all files go."""
    import random
    import tempfile

    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))).encode() for _ in range(300)]
    raw = b" ".join(rng.choices(words, k=50_000))
    raw = raw + raw[1000:60_000]
    text = np.frombuffer(raw, np.uint8)
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 12)
    order, common = suffixes.suffix_array(text, 1000, 4096)
    assert np.array_equal(np.sort(order), np.arange(len(raw))) and not list(tmp_path.iterdir())
    for i in rng.sample(range(1, len(raw)), 4000):
        a, b, c = int(order[i - 1]), int(order[i]), int(common[i])
        assert raw[a : a + 1200] < raw[b : b + 1200] or c >= 1000
        assert raw[a : a + c] == raw[b : b + c] and (c >= 1000 or raw[a + c : a + c + 1] != raw[b + c : b + c + 1])


@given(st.lists(st.integers(0, 6), min_size=1, max_size=200))
def test_names_are_sorted_by_induction(values):
    dense = np.unique(values, return_inverse=True)[1]
    want = sorted(range(len(dense)), key=lambda i: dense[i:].tolist())
    assert suffixes._sorted_names(dense.astype(np.int64), int(dense.max()) + 1).tolist() == want


def test_types():
    text = np.frombuffer(b"mississippi", np.uint8)
    want = [sorted([text[i:].tobytes(), text[i + 1 :].tobytes()])[0] == text[i:].tobytes() and i < 10 for i in range(11)]
    for block in (1, 2, 4, 100):
        suffixes.BLOCK, before = block, suffixes.BLOCK
        assert suffixes.types(text).tolist() == want
        suffixes.BLOCK = before
