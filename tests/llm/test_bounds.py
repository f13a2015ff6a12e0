"""Memory of the text operators' tasks stays bounded where rows or groups are large."""

import tracemalloc

import numpy as np
import pyarrow as pa

import tabloom.llm.chosenpath as chosenpath


def peak_mb(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_compare_holds_no_matrix_of_all_earlier_buckets():
    rng = np.random.default_rng(1)
    m, base = 1500, rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.append(base, np.uint64(i))) for i in range(m)]
    before = [np.append(rng.integers(0, 2**62, 30), 5 if i < 2 else 10 + i) for i in range(m)]  # 0 and 1 met earlier
    table = pa.table({
        "cls": pa.array(np.arange(m)), "copies": pa.array(np.full(m, 2)), "side": pa.array(np.zeros(m, np.int32)),
        "before": pa.array(before), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())})
    found, peak = peak_mb(lambda: chosenpath._compare(0.8)(table).to_pylist())
    links = {r["u"]: (r["links"], r["similar"]) for r in found if r["v"] == -1}
    assert links == {i: (m - 2, 2 * m - 4) if i < 2 else (m - 1, 2 * m - 2) for i in range(m)}
    assert len(found) - len(links) == m - 1  # a spanning tree
    assert peak < 120


def test_paths_and_words_of_a_long_text_stay_small():
    tokens = np.unique(np.random.default_rng(2).integers(0, 2**63, 400_000).astype(np.uint64))
    _, peak = peak_mb(lambda: chosenpath.path_keys(tokens, np.arange(1, 9, dtype=np.uint64), 0.8))
    assert peak < 24
    hashes = chosenpath.WordHashes()
    chosenpath.shingle_set(b" ".join(b"w%d" % k for k in range(400_000)), hashes)
    assert len(hashes) <= chosenpath.REMEMBERED
