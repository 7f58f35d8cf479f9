from collections import Counter

import duckdb

from tests_llm_helpers import rows_of
from tickwatch.llm import host_lines, oracle, queries

SMALL = "/root/testdata/sf0.001"


def brute(text):
    w = (text or "").encode().split()
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    chars = sum(len(x.decode()) for x in w)
    return (len(w), chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_query_against_counts(spark, small):
    out = {r["doc_id"]: r for r in queries.QUERIES["op2_host_lines"](spark, SMALL).collect()}
    assert set(out) == set(small)
    for i, text in small.items():
        n = brute(text)
        assert tuple(out[i][c] for c in COUNTS) == n, i
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        assert out[i]["base_failed"] == failed and not (failed and out[i]["kept"])
    assert any(r["n_repeat_words"] for r in out.values())


def test_query_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    out = queries.QUERIES["op2_host_lines"](spark, SMALL)
    expected = db.sql(oracle.oracle_sql()["op2_host_lines"])
    assert sorted(out.columns) == sorted(expected.columns)
    rows = sorted(str(tuple(r)) for r in out.select(*expected.columns).collect())
    assert rows == sorted(map(str, expected.fetchall()))


def test_lines_are_counted_per_host_and_depleted_documents_go(spark):
    own = [f"own words of document {i} are these " * 5 + str(i) for i in range(40)]
    rows = [(i, f"Share this  PAGE, {i}!\n" + own[i].replace("document", chr(97 + i % 26) * (i + 2)), "a") for i in range(12)]
    rows += [(100 + i, "share this page: 7\n" + " ".join(f"z{i}q{chr(97 + k)}" for k in range(25)), "b") for i in range(5)]
    rows += [(200 + i, "all of this is the very same footer text in every one of these twenty and more "
              "documents of the host here", "c") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in rows_of(host_lines.line_rules(docs, min_docs=10, share=0.1))}
    assert all(out[i]["n_removed_lines"] == 1 and not out[i]["depleted"] for i in range(12))
    assert all(out[100 + i]["n_removed_lines"] == 0 and out[100 + i]["kept"] for i in range(5))
    assert all(out[200 + i]["depleted"] and not out[200 + i]["kept"] for i in range(15))
    counts = spark.createDataFrame([("a", r["h"]) for r in docs.limit(1).select(
        host_lines.F.xxhash64(host_lines.normalized(host_lines.F.lit("share this page 3"))).alias("h")).collect()],
        "host string, h long")
    texts = {r["doc_id"]: r["text"] for r in rows_of(host_lines.without_lines(docs, counts))}
    assert "PAGE" not in texts[3] and texts[3] == rows[3][1].split("\n")[1] and texts[100] == rows[12][1]


def test_the_limit_does_not_rise_with_the_host(spark):
    F = host_lines.F
    own = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda k: F.translate(
        F.concat(F.lit("q"), k, F.lit("x"), F.col("doc_id")), "0123456789", "abcdefghij")), " ")
    line = F.when(F.col("doc_id") < 60, F.lit("the same passage here\n")).when(
        F.col("doc_id").between(100, 109), F.lit("a passage of ten\n")).otherwise(F.lit(""))
    docs = spark.range(6500).select(F.col("id").alias("doc_id")).select(
        "doc_id", F.concat(line, own).alias("text"), F.lit("hot").alias("source"))
    out = host_lines.line_rules(docs).filter("n_removed_lines > 0")
    assert sorted((r["doc_id"], r["n_removed_lines"]) for r in out.collect()) == [(i, 1) for i in range(60)]


def test_odd_rows(spark, documents, odd_rows):
    out = rows_of(host_lines.line_rules(documents(odd_rows)))
    assert sorted(tuple(r[c] for c in COUNTS) for r in out) == sorted(brute(t) for _, t in odd_rows)
    assert host_lines.line_rules(documents([])).count() == 0


def test_only_dataframe_functions(spark, documents, odd_rows):
    plan = host_lines.line_rules(documents(odd_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
