import random

import numpy as np
import pyarrow as pa
import pytest

from tests_llm_helpers import rows_of
from tickwatch.llm import near_copies

SMALL = "/root/testdata/sf0.001"


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([b" ".join(words)] if len(words) < 5 else (b" ".join(words[i:i + 5]) for i in range(len(words) - 4)))


def similar(a, b):
    return not a and not b or len(a & b) >= 0.8 * len(a | b) > 0


def brute_groups(rows):
    """{id: smallest id of its group} over all pairs of (id, text)."""
    sets = [(i, brute_shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if similar(a, b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in rows}


def edited(draw, words, share):
    """A copy with about this share of words replaced, dropped or doubled."""
    out = []
    for w in words:
        if draw.random() >= share:
            out.append(w)
        elif draw.random() < 0.7:
            out.append(f"new{draw.randrange(10**6)}")
        elif draw.random() < 0.5:
            out += [w, w]
    return out


def planted(draw, groups, copies):
    rows, vocabulary = [], [f"{a}{b}" for a in "abcdefghijklmnop" for b in range(90)]
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([60, 150, 400, 900]))]
        rows.append(base)
        rows += [edited(draw, base, draw.choice([0.004, 0.01, 0.02])) for _ in range(draw.randrange(copies))]
    draw.shuffle(rows)
    return [(i, " ".join(words)) for i, words in enumerate(rows)]


def test_keys_of_two_segments_with_one_error_each_meet():
    draw = random.Random(2)
    for _ in range(400):
        bits = draw.getrandbits(115)
        other = bits
        near = draw.sample(range(5), 2)
        for segment in range(5):
            # Two segments differ by one bit at most, the others as they like.
            for bit in draw.sample(range(23), draw.randrange(2) if segment in near else draw.randrange(24)):
                other ^= 1 << (23 * segment + bit)
        both = np.array([[x & 2**64 - 1, x >> 64] for x in (bits, other)], dtype=np.uint64).view(np.int64)
        rows, keys = near_copies.bucket_keys(both[:, 0], both[:, 1])
        assert set(keys[rows == 0]) & set(keys[rows == 1])
        assert not any(np.unique(keys[rows == r], return_counts=True)[1].max() > 1 for r in (0, 1))


def test_near_copies_are_found_and_others_left_alone(spark, documents):
    rows = planted(random.Random(7), 60, 9)
    want = brute_groups(rows)
    out = {r["doc_id"] for r in rows_of(near_copies.one_of_each(documents(rows)))}
    removable = {i for i, root in want.items() if i != root}
    assert len(removable) > 150
    caught = removable - out
    assert len(caught) >= 0.95 * len(removable)
    # Every group keeps its smallest id, so nothing without a copy goes.
    assert set(want.values()) <= out


def test_no_link_is_lost_at_the_threshold(spark, documents):
    """Texts with a new end, just similar enough, and others just not."""
    draw = random.Random(3)
    rows = []
    for _ in range(150):
        base = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice([30, 60, 120]))]
        rows.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            # New words in one stretch change few shingles but many words.
            cut = draw.randrange(len(copy) // 12, len(copy) // 8 + 1)
            copy[len(copy) - cut:] = [f"x{draw.randrange(10**6)}" for _ in range(cut)]
            rows.append(" ".join(copy))
    rows = list(enumerate(rows + [" ", "\t", "\n ", "a b", "A b", "a  B"]))
    want = brute_groups(rows)
    assert len(set(want.values())) < len(rows) - 100
    assert {r["doc_id"] for r in rows_of(near_copies.one_of_each(documents(rows)))} == set(want.values())


def test_no_similar_text_is_lost_on_the_small_table(spark, small):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute_groups(sorted(small.items()))
    out = {r["doc_id"] for r in near_copies.one_of_each(docs).collect()}
    assert out == set(want.values()) and len(out) < len(small)


@pytest.mark.parametrize("piece", [2, 3, 7, 2048])
def test_pieces_of_buckets_and_centres(spark, documents, monkeypatch, piece):
    """A crowded group stays one group however small the pieces are in which its buckets are handled."""
    draw = random.Random(11)
    low, high = np.zeros(40, np.int64), np.zeros(40, np.int64)
    for i in range(1, 40):
        low[i] = 1 << draw.randrange(60)
    monkeypatch.setattr(near_copies, "PIECE", piece)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.repeat([5, 9], 20).astype(np.int32)[a:b]), *[
        pa.array(c[a:b]) for c in (np.arange(40), low, high)]], ["key", "v", "low", "high"]) for a, b in ((0, 3), (3, 25), (25, 40))]
    pairs = [tuple(r.values()) for b in near_copies._pass_centres(iter(batches)) for r in b.to_pylist()]
    parent = list(range(40))
    for a, b in pairs:
        old, new = parent[a], parent[b]
        parent = [new if p == old else p for p in parent]
    assert len(set(parent[:20])) == 1 and len(set(parent[20:])) == 1 and parent[0] != parent[20]
    assert len(pairs) <= 40 * (2 if piece > 6 else 20)


def test_a_large_group_makes_few_pairs(spark):
    draw = random.Random(5)
    base = [f"w{draw.randrange(3000)}" for _ in range(300)]
    texts = [" ".join(edited(draw, base, 0.005)) for _ in range(1500)]
    fps = np.array([near_copies.wide_fingerprint(t.encode()) for t in texts], dtype=np.uint64).view(np.int64)
    nodes = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(fps)], "v long, low long, high long")
    pairs = near_copies.candidate_pairs(nodes).count()
    assert 1490 <= pairs < 60 * 1500


def test_odd_rows(spark, documents, odd_rows):
    rows = odd_rows + [(None, "x y z"), (None, "x y z"), (30, "One TWO three\tfour"), (31, None)]
    out = rows_of(near_copies.one_of_each(documents(rows)))
    assert out and list(out[0]) == documents(rows).columns
    # Without words: 1; alike but for case: 30, as the other row's id is unknown.
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "3", "30", "6", "7", "8", "None"]
    assert near_copies.one_of_each(documents([])).count() == 0


def test_sketches_never_rule_out_similar_sets():
    draw = np.random.default_rng(4)
    for _ in range(300):
        a = draw.integers(0, 2**63, draw.integers(1, 700)).astype(np.uint64)
        b = np.concatenate([a[draw.random(len(a)) < draw.random()], draw.integers(0, 2**63, draw.integers(0, 400)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        assert near_copies.apart(near_copies.sketch(a), near_copies.sketch(b)) <= len(np.setxor1d(a, b))
    a, b = (np.unique(draw.integers(0, 2**63, 400).astype(np.uint64)) for _ in range(2))
    assert 9 * near_copies.apart(near_copies.sketch(a), near_copies.sketch(b)) > 800


def test_texts_that_share_a_passage_are_not_sent_to_be_compared(spark, documents, monkeypatch):
    """A passage of a quarter of the words makes no pairs; copies beside it are still found, whatever is frequent."""
    draw = random.Random(6)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for _ in range(120):
        own = [f"w{draw.randrange(10**6)}" for _ in range(120)]
        rows.append(own[:60] + passage + own[60:])
    # New words in one stretch change few shingles but many words.
    rows += [r[:145] + [f"x{draw.randrange(10**6)}" for _ in range(15)] for r in rows[:40]]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    want = brute_groups(rows)
    compared, similar_pairs = [], near_copies.similar_pairs

    def counted(nodes, packed, pairs=None):
        if pairs is not None:
            compared.append(pairs.count())
        return similar_pairs(nodes, packed, pairs)

    monkeypatch.setattr(near_copies, "similar_pairs", counted)
    for sampled, often in ((1, 3), (8, 3), (1, 10**9)):
        monkeypatch.setattr(near_copies, "SAMPLED", sampled)
        monkeypatch.setattr(near_copies, "OFTEN", often)
        assert {r["doc_id"] for r in rows_of(near_copies.one_of_each(documents(rows)))} == set(want.values())
    assert len(set(want.values())) == 120 and max(compared) <= 40


def test_frequent_shingles_make_no_candidates(spark, documents, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLED", 1)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = documents([(i, " ".join(f"w{i}x{k}" for k in range(100)) + " " + passage) for i in range(60)])
    named = rows.select(near_copies.text_key(rows).alias("n"), rows["doc_id"].alias("v"), rows["doc_id"].alias("first"),
                        rows["doc_id"].alias("root"), rows["doc_id"].alias("id"), "text")
    packed = named.select("n", "id", "text").mapInArrow(near_copies._pass_packed, "n binary, id long, text binary")
    nodes = named.select("n", "v", "first", "root")
    assert len(near_copies.frequent_shingles(nodes, packed)) == 56
    assert near_copies.missed_pairs(nodes, packed).count() == 0
