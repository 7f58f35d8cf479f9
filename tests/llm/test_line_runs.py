import hashlib
from collections import Counter

from tests_llm_helpers import rows_of
from tickwatch.llm import line_runs, queries

SMALL = "/root/testdata/sf0.001"


def brute(texts, min_docs):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").encode().lower()

    docs = Counter()
    for t in texts:
        docs.update({key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and docs[key(x)] >= min_docs)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_query_against_counts(spark, small):
    ids = sorted(small)
    out = {r["doc_id"]: r for r in queries.QUERIES["op7_line_runs"](spark, SMALL).collect()}
    assert len(out) == len(ids)
    dropped = 0
    for i, (n, d, kept) in zip(ids, brute([small[i] for i in ids], 10)):
        assert (out[i]["n_lines"], out[i]["n_dropped"]) == (n, d)
        assert out[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        dropped += d
    assert dropped > 0


def test_odd_rows(spark, documents, odd_rows):
    out = rows_of(line_runs.dedup_lines(documents(odd_rows), min_docs=3, batches=5))
    expected = brute([t for _, t in odd_rows], 3)
    assert sorted(map(str, [(r["n_lines"], r["n_dropped"], r["kept"]) for r in out])) == sorted(map(str, expected))
    assert sum(r["n_dropped"] for r in out) == 4
    assert line_runs.dedup_lines(documents([])).count() == 0


def test_runs_are_compacted_and_saturated_keys_are_not_added_again(spark):
    store = line_runs.LineRuns(spark, limit=1, fanout=2, buckets=4)
    batches = [["a", "b", "b"], ["b", "c"], ["a", "d"], ["d", "e", "c"]]
    added = []
    for batch in batches:
        run = store.add(spark.createDataFrame([(x.encode(),) for x in batch], "line_key binary"))
        added.append({bytes(r["line_key"]).decode() for r in run.collect()})
    assert added == [{"a", "b"}, {"c"}, {"d"}, {"e"}]
    assert len(store.runs()) == 1 and len(store.levels) == 3
    assert {bytes(r["line_key"]).decode() for r in store.frequent().collect()} == set("abcde")
    plan = store.runs()[0].join(store.runs()[0].select("line_key").hint("merge"), "line_key", "left_anti")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
