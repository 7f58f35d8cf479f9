from tickwatch.llm import line_runs


def test_equal_keys_of_several_runs_are_added_up(spark):
    store = line_runs.LineRuns(spark, limit=3, fanout=3)
    for batch in (["a", "b", "c"], ["a", "a", "b"]):
        store.add(spark.createDataFrame([(x.encode(),) for x in batch], "line_key binary"))
    assert len(store.runs()) == 2
    assert {bytes(r["line_key"]).decode() for r in store.frequent().collect()} == {"a"}
    store.add(spark.createDataFrame([(b"b",), (b"c",)], "line_key binary"))
    assert len(store.runs()) == 1
    assert {bytes(r["line_key"]).decode() for r in store.frequent().collect()} == {"a", "b"}


def test_neither_tables_nor_files_stay(spark, documents):
    import os

    def tables():
        return {t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")}

    before = tables()
    paths = []
    with line_runs.LineRuns(spark, limit=2, fanout=2) as store:
        for batch in (["a", "b"], ["b"], ["c"], ["d"], ["a"]):
            store.add(spark.createDataFrame([(x.encode(),) for x in batch], "line_key binary"))
            paths += [run.path for level in store.levels for run in level] + [run.path for run in store.merged]
            # What is merged goes with the next batch.
            assert len(tables() - before) == len(store.runs()) + len(store.merged) <= 4 + 2
        assert {bytes(r["line_key"]).decode() for r in store.frequent().collect()} == {"a", "b"}
    assert tables() == before and not any(os.path.exists(p) for p in paths)
    line_runs.dedup_lines(documents([(i, "x\ny") for i in range(12)])).collect()
    assert tables() == before


def test_buckets_follow_the_number_of_keys():
    assert [line_runs.bucket_count(n) for n in (0, 32_000_000, 32_000_001, 10**11)] == [16, 16, 17, 50_000]


def test_slices_keep_whole_texts_together():
    import pyarrow as pa

    from tickwatch.llm.common import slices

    column = pa.array(["aa", "", "bbbbbbb", None, "c", "dd"])
    assert list(slices(column, 3)) == [(0, 2), (2, 3), (3, 6)]
    assert list(slices(column[:0], 3)) == []
