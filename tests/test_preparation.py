import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickwatch.operators import quality
from tickwatch.operators.scaler import fit_scaler, standardize
from tickwatch.operators.split import row_hash, stratified_rule, train_test
from tickwatch.schema import FEATURES


def frame(spark, n, labels=None, nan=0):
    rows = []
    for i in range(n):
        values = [math.sin(i * k + k) for k in (1, 2, 3)] + [abs(math.cos(i)) / 1000, abs(math.cos(i)) * 10]
        if i < nan:
            values[0] = math.nan
        rows.append((f"s{i}", *values, *([labels[i]] if labels else [])))
    schema = "symbol string, " + ", ".join(f"{c} double" for c in FEATURES) + (", is_anomaly int" if labels else "")
    return spark.createDataFrame(rows, schema)


def test_labelled_data(spark):
    df = frame(spark, 100, [1] * 5 + [0] * 95)
    kept = quality.drop_incomplete(df)
    assert kept.count() == 100
    assert quality.design_matrix(kept).columns == FEATURES
    summary = quality.label_summary(kept).first()
    assert (summary["mode"], summary["n_anomalies"]) == ("labelled", 5)
    assert summary["anomaly_ratio"] == pytest.approx(0.05)


def test_missing_values_are_dropped_and_reported(spark):
    df = frame(spark, 100, [0] * 99 + [1], nan=10)
    assert quality.drop_incomplete(df).count() == 90
    report = quality.incomplete_report(df).first()
    assert (report["n_rows"], report["n_kept"], report["n_dropped"], report["dropped_pct"]) == (100, 90, 10, 10.0)


@pytest.mark.parametrize("labels", [None, [0] * 50])
def test_unsupervised_modes(spark, labels):
    summary = quality.label_summary(frame(spark, 50, labels)).first()
    assert summary["mode"] == "unsupervised" and summary["n_rows"] == 50


def test_all_rows_incomplete(spark):
    df = frame(spark, 2, nan=2)
    assert quality.drop_incomplete(df).count() == 0
    assert quality.incomplete_report(df.limit(0)).first()["dropped_pct"] == 0.0


VALID = ("BTC-USDT", 1.5, 0.8, -0.3, 0.002, 10.0)


@pytest.mark.parametrize("change, reasons", [
    ({}, []),
    ({4: -0.001}, ["rolling_price_std: negative"]),
    ({1: 200.0}, ["z_score_price: out of range"]),
    ({1: 100.0, 2: -100.0}, []),
    ({2: math.nan}, ["z_score_log_return: not finite"]),
    ({5: math.inf}, ["rolling_volume_std: not finite"]),
    ({0: None, 3: None}, ["symbol: missing", "z_score_volume: missing"]),
])
def test_validation(spark, change, reasons):
    row = tuple(change.get(i, v) for i, v in enumerate(VALID))
    df = spark.createDataFrame([row], "symbol string, " + ", ".join(f"{c} double" for c in FEATURES))
    assert quality.with_reject_reasons(df).first()["reject_reasons"] == reasons
    valid, rejected = quality.split_valid(df)
    assert (valid.count(), rejected.count()) == ((0, 1) if reasons else (1, 0))


def test_requests_from_json(spark):
    texts = ['{"symbol": "a", "z_score_price": "1.5", "z_score_log_return": 1, "z_score_volume": 0, '
             '"rolling_price_std": 0.1, "rolling_volume_std": 2}',
             '{"symbol": "a", "z_score_price": "not_a_number"}', '{"symbol": "BTC-USDT"}']
    rows = quality.read_requests(spark.createDataFrame([(t,) for t in texts], "value string"))
    counts = [len(r["reject_reasons"]) for r in quality.with_reject_reasons(rows).collect()]
    assert counts == [0, 5, 5]


def test_scaler_uses_population_deviation_and_guards_zero(spark):
    df = frame(spark, 10).withColumn("z_score_volume", F.lit(3.0))
    rows = {r["feature"]: r for r in fit_scaler(df).collect()}
    assert rows["z_score_volume"]["scale"] == 1.0
    expected = df.agg(F.stddev_pop("z_score_price")).first()[0]
    assert rows["z_score_price"]["scale"] == pytest.approx(expected)
    ordered = sorted(rows.values(), key=lambda r: r["position"])
    assert [r["feature"] for r in ordered] == FEATURES
    scaled = standardize(df, [r["mean"] for r in ordered], [r["scale"] for r in ordered])
    assert fit_scaler(scaled).where("feature = 'z_score_price'").first()["mean"] == pytest.approx(0, abs=1e-12)


def test_split_equals_ranking_by_hash(spark):
    df = spark.range(5000).select("id", (F.col("id") % 100 == 0).cast("int").alias("y"))
    rule = stratified_rule(df, "y", ("id",), 0.2, 42)
    train, test = train_test(df, rule)
    assert train.count() + test.count() == 5000
    sizes = {r["y"]: r["count"] for r in test.groupBy("y").count().collect()}
    assert sizes == {0: 990, 1: 10}
    w = Window.partitionBy("y").orderBy(row_hash(("id",), 42))
    ranked = df.withColumn("rn", F.row_number().over(w)).where(
        F.col("rn") <= F.when(F.col("y") == 1, 10).otherwise(990)).drop("rn")
    assert test.exceptAll(ranked).count() == 0


def test_split_finds_its_cut_through_several_ranges(spark):
    from tickwatch.operators.ordered import ROWS_PER_RANGE_CONF

    df = spark.range(3000).select("id", F.lit(0).alias("y"))
    spark.conf.set(ROWS_PER_RANGE_CONF, "3")
    try:
        _, test = train_test(df, stratified_rule(df, "y", ("id",)))
    finally:
        spark.conf.unset(ROWS_PER_RANGE_CONF)
    assert test.count() == 600


def test_split_of_many_small_classes(spark):
    df = spark.range(600).select("id", (F.col("id") % 150).alias("y"))
    _, test = train_test(df, stratified_rule(df, "y", ("id",)))
    # Of four rows of a class one is held out.
    assert test.count() == 150 and test.select("y").distinct().count() == 150
    with pytest.raises(ValueError, match="more than"):
        stratified_rule(spark.range(3000).withColumn("y", F.col("id") % 1500), "y", ("id",))
    few = spark.range(4).select("id", F.lit(0).alias("y"))
    assert train_test(few, stratified_rule(few, "y", ("id",), 0.1))[1].count() == 0


def test_split_keeps_sides_when_rows_are_added(spark):
    df = spark.range(1000).select("id", F.lit(0).alias("y"))
    rule = stratified_rule(df, "y", ("id",))
    more = spark.range(2000).select("id", F.lit(0).alias("y"))
    before = {r["id"] for r in train_test(df, rule)[1].collect()}
    after = {r["id"] for r in train_test(more, rule)[1].where("id < 1000").collect()}
    assert before == after


def test_split_needs_two_rows_per_class(spark):
    df = spark.range(10).select("id", (F.col("id") == 0).cast("int").alias("y"))
    with pytest.raises(ValueError):
        stratified_rule(df, "y", ("id",))


def test_split_does_not_depend_on_the_session_zone(spark):
    df = spark.range(900).select(F.timestamp_seconds(F.col("id") * 3600).alias("t"), F.lit(0).alias("y"))
    sides = []
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            _, test = train_test(df, stratified_rule(df, "y", ("t",)))
            sides.append({r["s"] for r in test.select(F.unix_seconds("t").alias("s")).collect()})
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sides[0] == sides[1] and len(sides[0]) == 180


def test_split_tells_nulls_in_keys_apart_and_names_missing_labels(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("n", "a"), ("", "a")], "k string, l string")
    hashes = df.select(row_hash(("k", "l"), 1).alias("h")).distinct().count()
    assert hashes == 4
    with pytest.raises(ValueError, match="no y"):
        stratified_rule(spark.createDataFrame([(1, None), (2, 1), (3, 1)], "id long, y int"), "y", ("id",))
