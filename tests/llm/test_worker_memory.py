import random
import tracemalloc

import numpy as np
import pyarrow as pa

from palimpsest.llm import shared
from palimpsest.llm import substring_dedup as module


def test_a_worker_keeps_nothing_of_a_long_text():
    data = np.frombuffer(random.Random(1).randbytes(2 << 20), np.uint8)
    tracemalloc.start()
    module.anchors(data, np.array([0, len(data)]), 400, 64)
    shared.span_hashes(data, np.array([0, 1 << 20]), np.array([1 << 20, len(data)]))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 4 << 20


def test_sums_and_powers_over_several_steps():
    rng = random.Random(2)
    base, n = int(shared._R), 2 * shared.STEP + 7
    data = np.frombuffer(rng.randbytes(n), np.uint8)
    power, total, want_powers, want_sums = 1, 0, [], [0]
    for x in data.tolist():
        want_powers.append(power)
        total = (total + (x + 1) * power) % 2**64
        want_sums.append(total)
        power = power * base % 2**64
    assert shared.powers(shared._R, n).tolist() == want_powers
    assert shared.power_at(shared._R, np.arange(n)).tolist() == want_powers
    assert shared.prefix_sums(data).tolist() == want_sums
    assert shared.powers(shared._R, 0).tolist() == [] and shared.prefix_sums(data[:0]).tolist() == [0]


def test_runs_of_groups_hold_a_shard_whatever_a_batch_holds():
    n = 12_000
    anchor = np.sort(np.random.default_rng(3).integers(0, 4000, n))
    side = pa.array([bytes(200)] * n, pa.binary())
    columns = [pa.array(anchor), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, 186, np.int32)), pa.array(np.arange(n)), pa.array(np.zeros(n, bool)), side, side]
    batch = pa.RecordBatch.from_arrays(columns, names=module._names(module.GROUP))
    assert batch.nbytes > 2 * module.SHARD
    runs = list(module._by_group(iter([batch.slice(0, 0), batch])))
    assert max(r.nbytes for r in runs) < 2 * module.SHARD
    assert pa.concat_tables(runs).column("context").to_pylist() == list(range(n))
    ends = [(r.column("anchor")[0].as_py(), r.column("anchor")[-1].as_py()) for r in runs]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
