import math
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickwatch.llm import hard_negatives, oracle, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negatives=10, least=30, most=90, every=100):
    """Hard negatives by comparing all rows with integers of any size."""
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
             if i is not None and label is not None and v is not None
             and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in whole:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in whole
                        if j != i and len(v) == len(w))
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            hits = [s for s in scored if s[2] != label and least * -p <= 100 * -s[0] <= most * -p][:negatives]
            out += [(i, j, k, n, -p, -s) for k, (s, n, _) in enumerate(hits, 1)]
    return sorted(out)


def mined(df, **more):
    return sorted(map(tuple, hard_negatives.mine(df, anchor=F.col("id") % 100 == 0, **more).collect()))


def test_packed_products_are_exact():
    draw = np.random.default_rng(4)
    for reach in (1, 200, 2**20, 2**40, 2**61):
        comps = draw.integers(-reach, reach, (50, 7))
        packed = hard_negatives.Packed(comps)
        for anchor in draw.integers(-reach, reach, (6, 7)).tolist() + [[0] * 7, [reach] * 7, [-reach] * 7]:
            exact = [sum(a * b for a, b in zip(anchor, row)) for row in comps.tolist()]
            assert packed.products(anchor).tolist() == [max(-2**63 + 1, min(2**63 - 1, x)) for x in exact]


def test_fields_of_several_integers(monkeypatch):
    monkeypatch.setattr(hard_negatives, "FIELDS", 8)
    comps = np.arange(300).reshape(100, 3) - 150
    assert hard_negatives.Packed(comps).products([3, -5, 7]).tolist() == (comps @ [3, -5, 7]).tolist()
    assert hard_negatives.Packed(comps[:0]).products([1, 1, 1]).tolist() == []
    assert hard_negatives.Packed(np.zeros((4, 0), np.int64)).products([]).tolist() == [0] * 4


def test_query_against_brute_force_and_sql(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"])
            for r in table.collect()]
    out = queries.QUERIES["op11_hard_negatives"](spark, SMALL)
    found = sorted(map(tuple, out.collect()))
    assert found and found == brute(rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    expected = db.sql(oracle.oracle_sql()["op11_hard_negatives"])
    assert expected.columns == out.columns and found == sorted(expected.fetchall())


def test_any_blocks_give_the_same_rows(spark):
    draw = random.Random(6)
    rows = [(i, [draw.choice([-0.5, 0.25, 0.3, 0.9, 4.0]) for _ in range(5)], draw.randrange(3)) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = brute(rows)
    assert expected
    for blocks in (1, 2, 9):
        assert mined(df, blocks=blocks) == expected
    assert mined(df, positives=2, negatives=3, least=50, most=100) == brute(rows, 2, 3, 50, 100)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (200, [], 1), (300, [0.0, 0.0], 2), (400, None, 1), (500, [1.0, 1.0], None),
            (600, [nan, 1.0], 1), (700, [inf, 1.0], 1), (800, [None, 1.0], 1), (None, [1.0, 2.0], 1), (1, [1.0, 1.0], 1),
            (2, [1.0, 1.0], 1), (3, [0.5, 0.5], 2), (4, [0.5, 0.5], 2), (5, [0.5, 0.5, 0.5], 2), (6, [-1.0, -1.0], 2),
            (900, [-1.0, -2.0], 1), (7, [0.25, 1.0], 3), (201, [], 1), (202, [], 2), (8, [1e6, 2e7], 1), (9, [3e5, -1e6], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("comps", F.lit(1))
    assert mined(df) == brute(rows) and brute(rows)
    # Repeated rows take a rank each; a repeated anchor is mined twice.
    twice = mined(spark.createDataFrame(rows + [(3, [0.5, 0.5], 2), (0, [1.0, 2.0], 1)], SCHEMA))
    assert len([r for r in twice if r[:2] == (100, 1) and r[3] == 3]) == 2
    assert [r[2] for r in twice if r[:2] == (0, 1)].count(1) == 2
    assert mined(spark.createDataFrame([], SCHEMA)) == []


def test_labels_without_a_second_row_and_huge_components(spark):
    rows = [(0, [1e300, 1.0], 1), (1, [1e300, 2.0], 1), (2, [1.0, 5.0], 2), (100, [1.0, 1.0], 3)]
    out = mined(spark.createDataFrame(rows, SCHEMA))
    assert all(abs(r[4]) < 2**63 and abs(r[5]) < 2**63 for r in out)


def test_anchors_stream_past_one_block_of_candidates():
    def batch(rows):
        names = ["block", "dim", "kind", "id", "label", "comps", "anchor_no", "wanted"]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    rows = [(0, 1, 0, 1, 1, [2], None, None), (0, 1, 0, 2, 1, [3], None, None), (0, 1, 1, 9, 1, [1], 7, None),
            (0, 1, 1, 2, 1, [1], 8, None), (1, 1, 1, 9, 1, [1], 7, None), (1, 2, 0, 4, 1, [1, 1], None, None)]
    for cuts in ([0, 6], [0, 1, 3, 6], [0, 1, 2, 3, 4, 5, 6]):
        parts = [batch(rows[a:b]) for a, b in zip(cuts, cuts[1:])]
        out = hard_negatives._meet(iter(parts), lambda block, own, label, comps, wanted: block.positives(own, label, comps, 5))
        assert sorted(tuple(r.values()) for b in out for r in b.to_pylist()) == [(7, 1, 2), (7, 2, 3), (8, 1, 2)]
