import __spark_entry__ as entry
from tickwatch.plans import catalog


def test_every_sql_twin_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    # What no SQL states: the fitted forest and the metadata of its files.
    assert set(catalog.QUERIES) - set(sql) == {
        "forest_fit_score", "evaluate_model", "evaluate_injected", "preset_scores", "model_info_row"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["symbol", "window_start", "window_end"]
    assert df.count() == 477
