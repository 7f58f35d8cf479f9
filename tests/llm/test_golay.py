import random
from collections import Counter

import numpy as np
import xxhash

from tests_llm_helpers import rows_of
from tickwatch.llm import golay, queries
from tickwatch.session import stage

SMALL = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    ones = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(fps):
    """{row number: smallest id reachable} over all pairs."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_the_code_is_perfect():
    words = np.arange(0, 1 << 23, 37)
    found = golay.codewords(words)
    assert (found[:, 0] >= 0).all()
    sizes = (found >= 0).sum(axis=1)
    assert set(sizes) == {1, 6}
    assert len(np.unique(golay._syndromes(found[:1, 0] << 11))) == 1


def test_any_three_errors_meet_in_a_key():
    draw = random.Random(5)
    pairs = []
    for _ in range(4000):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randint(0, 3)):
            b ^= 1 << bit
        pairs.append((a, b))
    left_row, left_key, _, _ = golay.golay_keys(np.array([a for a, _ in pairs], dtype=np.uint64))
    _, _, right_row, right_key = golay.golay_keys(np.array([b for _, b in pairs], dtype=np.uint64))
    left, right = [set() for _ in pairs], [set() for _ in pairs]
    for r, k in zip(left_row, left_key):
        left[r].add(k)
    for r, k in zip(right_row, right_key):
        right[r].add(k)
    assert all(x & y for x, y in zip(left, right))


def test_candidates_of_unrelated_fingerprints_are_few():
    """Fewer than one pair in ten million meets in a key: candidates stay few as fingerprints grow."""
    for n in (20_000, 80_000):
        fps = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
        _, left, _, right = golay.golay_keys(fps)
        at, counts = np.unique(left, return_counts=True)
        more, others = np.unique(right, return_counts=True)
        _, i, j = np.intersect1d(at, more, return_indices=True)
        # Every fingerprint meets itself: in 3 exact keys, 6 mixed ones and the nearest codewords.
        assert 10 * n <= (counts[i] * others[j]).sum() < 10 * n + n * n * 1e-7


def test_query_against_all_pairs(spark, small):
    out = {r["doc_id"]: r for r in queries.QUERIES["op3_simhash_components"](spark, SMALL).collect()}
    ids = sorted(small)
    fps = [brute_fingerprint(small[i]) for i in ids]
    roots = brute_components(fps)
    least = {}
    for i, root in zip(ids, roots):
        least[root] = min(least.get(root, i), i)
    assert len(out) == len(ids)
    for i, fp, root in zip(ids, fps, roots):
        assert out[i]["fingerprint"] == f"{fp:016x}"
        assert out[i]["component_id"] == least[root]


def test_near_fingerprints_chain(spark):
    draw = random.Random(3)
    chain = [draw.getrandbits(63)]
    for _ in range(40):
        step = chain[-1]
        for bit in draw.sample(range(63), 3):
            step ^= 1 << bit
        chain.append(step)
    far = [draw.getrandbits(63) for _ in range(300)]
    fps = spark.createDataFrame([(x,) for x in set(chain + far)], "fp long")
    edges = golay.linked_fingerprints(fps)
    found = {tuple(sorted((r["a"], r["b"]))) for r in edges.collect()}
    every = sorted(set(chain + far))
    assert found == {(a, b) for i, a in enumerate(every) for b in every[i + 1:] if (a ^ b).bit_count() <= 3}
    roots = {r["node"]: r["root"] for r in golay.components(edges).collect()}
    assert len({roots.get(x, x) for x in chain}) == 1


def test_keys_are_not_broadcast(spark):
    """A fingerprint has dozens of keys, of which Spark knows nothing when it sizes them by the file of fingerprints."""
    draw = random.Random(9)
    chain = [draw.getrandbits(63)]
    for i in range(20):
        chain.append(chain[-1] ^ 1 << 3 * i)
    fps = stage(spark.createDataFrame([(x,) for x in chain], "fp long"))
    edges = golay.linked_fingerprints(fps)
    assert {(r["a"], r["b"]) for r in edges.collect()} == {
        (a, b) for a in chain for b in chain if a < b and (a ^ b).bit_count() <= 3}
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_odd_rows(spark, documents, odd_rows):
    out = rows_of(golay.simhash_components(documents(odd_rows)))
    assert len(out) == len(odd_rows)
    zero = [r for r in out if r["fp"] == 0]
    assert len(zero) == 3 and {r["component_id"] for r in zero} == {1}
    assert [r["component_id"] for r in out if r["doc_id"] in (3, 4, 5)] == [3] * 4
    assert golay.simhash_components(documents([])).count() == 0
