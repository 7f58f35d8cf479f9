import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests_llm_helpers import rows_of
from tickwatch.llm import oracle, queries, sharding

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("total", [1, 2, 3, 4, 5, 17, 255, 256, 257, 1000])
def test_a_permutation_and_its_inverse(spark, total):
    shuffle = sharding.Permutation(total, "key")
    x = F.col("id")
    rows = spark.range(total).select("id", shuffle.forward(x).alias("p"))
    rows = rows_of(rows.withColumn("back", shuffle.inverse(F.col("p"))))
    assert sorted(r["p"] for r in rows) == list(range(total))
    assert all(r["back"] == r["id"] for r in rows)


def test_far_walks_end_inside(spark):
    # 101 * 100 numbers for 10,001 rows: some walks leave the rows.
    shuffle = sharding.Permutation(10_001, "w")
    assert shuffle.a * shuffle.b > 10_001
    rows = spark.range(10_001).agg(F.countDistinct(shuffle.forward(F.col("id"))).alias("n"),
                                   F.max(shuffle.forward(F.col("id"))).alias("top")).first()
    assert (rows["n"], rows["top"]) == (10_001, 10_000)


def test_keys_and_neighbours_are_unrelated(spark):
    a, b = (sharding.Permutation(5000, k) for k in ("one", "two"))
    rows = rows_of(spark.range(5000).select(a.forward(F.col("id")).alias("p"), b.forward(F.col("id")).alias("q")))
    assert sum(r["p"] == r["q"] for r in rows) < 20
    up = sum(rows[i]["p"] < rows[i + 1]["p"] for i in range(4999))
    assert 2300 < up < 2700


def test_query_against_plain_counts(spark, small):
    out = {r["doc_id"]: r for r in queries.QUERIES["op13_feistel_shards"](spark, SMALL).collect()}
    assert set(out) == set(small)
    for i, text in small.items():
        assert out[i]["size"] == len(text.encode()) + 8 and out[i]["text_crc32"] == zlib.crc32(text.encode())
    shards = {}
    for r in out.values():
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert set(shards) == set(range(24))
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert [out[i]["row_number"] for i in sorted(out)] == list(range(len(out)))


def test_query_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    out = queries.QUERIES["op13_feistel_shards"](spark, SMALL)
    expected = db.sql(oracle.oracle_sql()["op13_feistel_shards"])
    assert out.columns == expected.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected.fetchall()))


def test_places_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.document_places(docs).collect()}
    many = sharding.document_places(docs.repartition(7, F.rand(3)))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in many.collect()} == one


def test_a_row_is_found_by_its_place(spark):
    shuffle = sharding.Permutation(1000, "k")
    places = spark.range(30).crossJoin(spark.range(50).withColumnRenamed("id", "slot")).select(
        F.col("id").cast("int").alias("shard"), "slot")
    found = places.withColumn("x", sharding.row_at(F.col("shard"), F.col("slot"), shuffle, 24))
    rows = rows_of(found.withColumn("p", shuffle.forward(F.col("x"))))
    assert sorted(r["x"] for r in rows if r["x"] is not None) == list(range(1000))
    assert all((r["p"] % 24, r["p"] // 24) == (r["shard"], r["slot"]) for r in rows if r["x"] is not None)


def test_odd_rows_and_hot_keys(spark, documents, odd_rows):
    rows = odd_rows + [(None, None)] * 40 + [(9, "x")] * 40
    docs = documents(rows).withColumnRenamed("key", "shard").withColumnRenamed("a", "row_number")
    out = rows_of(sharding.document_places(docs, shards=7))
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len((t or "").encode()) + 8) for i, t in rows)
    assert sorted(r["slot"] * 7 + r["shard"] for r in out) == list(range(len(rows)))
    assert sharding.document_places(documents([])).count() == 0
    assert sharding.document_places(documents([(5, "x")])).first()["slot"] == 0


def test_written_shards_keep_all_columns_in_order(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.randrange(50), f"t{i % 90}") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(5)
    sharding.write_shards(df, str(tmp_path / "out"), ["k", "v"], shards=5)
    out = rows_of(spark.read.parquet(str(tmp_path / "out")))
    assert Counter((r["k"], r["v"]) for r in out) == Counter(rows)
    assert sorted(r["slot"] * 5 + r["shard"] for r in out) == list(range(400))
    for shard in range(5):
        assert len(list((tmp_path / "out" / f"shard={shard}").glob("*.parquet"))) >= 1
