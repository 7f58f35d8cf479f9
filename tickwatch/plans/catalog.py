"""The registered queries: each operator over the provided tables."""

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwatch.functions.columns import gauge_value, rate_alert, rate_band, to_stream_name, to_symbol
from tickwatch.operators import analytics, history, metrics, quality, tree_levels
from tickwatch.operators.features import build_features, model_view
from tickwatch.operators.forest import ForestModel, score
from tickwatch.operators.inject import FADE, inject_anomalies
from tickwatch.operators.quantiles import quantiles
from tickwatch.operators.scaler import fit_scaler, moments, standardize
from tickwatch.operators.split import stratified_rule
from tickwatch.operators.trades import normalize_trades, parse_trades, quarantine_counts
from tickwatch.plans import domain, training
from tickwatch.schema import FEATURE, FEATURES, LABEL, NODES, PREDICTION
from tickwatch.session import scratch_path, stage
from tickwatch.sources.events import decode_events, encode_events, text_message_stream
from tickwatch.sources.exports import export_csv, read_csv
from tickwatch.sources.feature_store import compact, feature_sink, read_compat, read_features, read_store, write_features
from tickwatch.sources.model_store import load_model, model_info, save_model
from tickwatch.streaming import request_stream
from tickwatch.streaming.feature_stream import WATERMARK, start_feature_stream
from tickwatch.streaming.progress import ProgressLog
from tickwatch.streaming.progress import read as read_progress
from tickwatch.streaming.return_stream import start_return_stream, stateful_log_return
from tickwatch.streaming.score_stream import start_score_stream
from tickwatch.streaming.trade_stream import start_trade_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# A table arrives at a stream in so many parts of time; the query is started anew for each.
ARRIVALS = 3
RULE_CUT = -1.5


def query(f: Callable[[SparkSession, str], DataFrame]):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The tables hold times without a zone; they are read as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def flat(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals and timestamps to epoch seconds, for comparison with SQL."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            c = F.round(c, 6)
        elif kind == "timestamp":
            c = F.unix_seconds(c)
        out.append(c.alias(name))
    return df.select(*out)


# --- features ---------------------------------------------------------------


@query
def window_features(spark, sf_dir):
    return flat(domain.market_features(spark, sf_dir))


@query
def window_features_1min(spark, sf_dir):
    return flat(domain.market_features(spark, sf_dir, "1 minute"))


@query
def window_features_7day(spark, sf_dir):
    events = domain.with_log_return(domain.trade_ticks(spark, sf_dir))
    return flat(build_features(events, "7 days"))


@query
def tick_log_return(spark, sf_dir):
    return flat(domain.market_events(spark, sf_dir).select("event_id", "symbol", "log_return"))


@query
def tick_log_return_lineitem(spark, sf_dir):
    ticks = domain.trade_ticks(spark, sf_dir)
    return flat(domain.with_log_return(ticks).select("event_id", "symbol", "log_return"))


# --- messages ---------------------------------------------------------------


def event_messages(spark, sf_dir) -> DataFrame:
    """`events` as JSON messages; every 50th is cut short, every 51st has a bad price.

    Of every 53 messages four give their time in ms, us, ns and below zero.
    """
    seconds, turn = F.unix_seconds("event_time"), F.col("event_id") % 53
    events = domain.market_ticks(spark, sf_dir).select(
        "event_id",
        F.when(turn == 1, seconds * 1000).when(turn == 2, seconds * 1_000_000).when(turn == 3, seconds * 1_000_000_000)
        .when(turn == 4, -seconds).otherwise(seconds).alias("timestamp"), "symbol", "price", "volume",
        F.lit(0.0).alias("log_return"), "is_anomaly", F.lit(None).cast("string").alias("anomaly_type"))
    text = encode_events(events.drop("event_id")).columns[0]
    whole = events.select("event_id", F.to_json(F.struct(*events.columns[1:])).alias(text))
    return whole.withColumn(text, F.when(F.col("event_id") % 50 == 0, F.substring(text, 1, 20))
                            .when(F.col("event_id") % 51 == 0,
                                  F.regexp_replace(text, '"price":[^,]+', '"price":"n/a"'))
                            .otherwise(F.col(text)))


@query
def decode_messages(spark, sf_dir):
    return flat(decode_events(event_messages(spark, sf_dir), keep=("event_id",)))


def trade_messages(spark, sf_dir, *keep: str) -> DataFrame:
    """`events` as raw exchange trades with several kinds of bad messages; `keep` names further columns."""
    name = (F.when(F.col("event_type") == "click", "BTCUSDT").when(F.col("event_type") == "error", "ethusdt")
            .when(F.col("event_type") == "view", "BnbUsdt").otherwise(F.upper("event_type")))
    i = F.col("event_id")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    trade = F.struct(
        F.when(F.col("event_type") == "signup", "kline").otherwise("trade").alias("e"),
        F.when(i % 40 != 7, name).alias("s"),
        F.when(i % 40 == 11, "n/a").otherwise(F.col("value").cast("string")).alias("p"),
        F.get_json_object("props", "$.k").alias("q"),
        F.when(i % 40 == 19, millis * 1000).when(i % 40 == 23, millis * 1_000_000).when(i % 40 == 29, -millis)
        .otherwise(millis).alias("T"))
    text = F.to_json(F.struct(trade.alias("data")))
    text = F.when(i % 40 == 13, F.concat(F.lit("not json "), text)).when(i % 40 == 17, F.lit('{"id": 1}')).otherwise(text)
    return domain.read(spark, sf_dir, "events").select("event_id", text.alias("value"), *keep)


@query
def normalized_trades(spark, sf_dir):
    return flat(normalize_trades(trade_messages(spark, sf_dir)))


@query
def trade_quarantine(spark, sf_dir):
    return quarantine_counts(parse_trades(trade_messages(spark, sf_dir)))


@query
def forward_symbol_map(spark, sf_dir):
    symbol = (F.when(F.col("event_type") == "click", "BTC-USDT").when(F.col("event_type") == "error", "ETH-USDT")
              .when(F.col("event_type") == "view", "BNB-USDT")
              .otherwise(F.concat(F.upper("event_type"), F.lit("-EUR"))))
    named = domain.read(spark, sf_dir, "events").select("event_id", symbol.alias("symbol"))
    streams = named.withColumn("stream", to_stream_name("symbol"))
    return streams.withColumn("back", to_symbol(F.upper("stream")))


# --- quality and preparation ------------------------------------------------


def doubtful_features(spark, sf_dir) -> DataFrame:
    """The features with some values moved out of their bounds."""
    z, v = F.col("z_score_price"), F.col("z_score_volume")
    return domain.market_features(spark, sf_dir).withColumns({
        "z_score_price": z * 60,
        "z_score_log_return": F.when(z > 2, F.lit(float("inf"))).otherwise(F.col("z_score_log_return")),
        "z_score_volume": F.when(v < -1.2, F.lit(float("nan"))).otherwise(v),
        "rolling_price_std": F.col("rolling_price_std") - 40,
        "rolling_volume_std": F.when(F.col(LABEL) == 0, F.col("rolling_volume_std")),
    })


@query
def validate_features(spark, sf_dir):
    checked = quality.with_reject_reasons(doubtful_features(spark, sf_dir))
    return flat(checked.select(
        "symbol", "window_start", (F.size("reject_reasons") == 0).alias("valid"),
        F.concat_ws("; ", "reject_reasons").alias("reasons")))


@query
def clean_features(spark, sf_dir):
    kept = quality.drop_incomplete(doubtful_features(spark, sf_dir).drop("z_score_log_return")
                                   .withColumn("z_score_log_return", F.lit(0.5)))
    return flat(kept.select("symbol", "window_start", *FEATURES))


@query
def clean_report(spark, sf_dir):
    return flat(quality.incomplete_report(doubtful_features(spark, sf_dir)))


@query
def label_mode(spark, sf_dir):
    return flat(quality.label_summary(domain.market_features(spark, sf_dir)))


@query
def stratified_split(spark, sf_dir):
    rows = stage(domain.market_features(spark, sf_dir, "1 hour").select(*training.KEY, LABEL), "split")
    rule = stratified_rule(rows, LABEL, training.KEY, training.TEST_SHARE, 42)
    return flat(rows.withColumn("is_test", rule.test_column(rows)))


@query
def scaler_fit(spark, sf_dir):
    return flat(fit_scaler(domain.market_features(spark, sf_dir)))


@query
def standardized(spark, sf_dir):
    features = domain.market_features(spark, sf_dir)
    means, scales = scaler_values(features)
    return flat(standardize(features, means, scales).select("symbol", "window_start", *FEATURES))


# --- scoring with a small hand-written forest -------------------------------


def scaler_values(features: DataFrame) -> tuple[list[float], list[float]]:
    row = moments(features).first()
    return [row[f"m{i}"] for i in range(5)], [row[f"s{i}"] or 1.0 for i in range(5)]


def small_forest(features: DataFrame) -> ForestModel:
    """Three trees of depth two or less, with the scaler of the given features."""
    rows = [
        # tree, node, feature, threshold, left, right, depth, rows
        (0, 0, 0, 0.0, 1, 2, 0, 8), (0, 1, -1, None, -1, -1, 1, 5),
        (0, 2, 2, 0.5, 3, 4, 1, 3), (0, 3, -1, None, -1, -1, 2, 2), (0, 4, -1, None, -1, -1, 2, 1),
        (1, 0, 3, 1.0, 1, 2, 0, 8), (1, 1, 1, -0.5, 3, 4, 1, 7), (1, 2, -1, None, -1, -1, 1, 1),
        (1, 3, -1, None, -1, -1, 2, 3), (1, 4, -1, None, -1, -1, 2, 4),
        (2, 0, 4, -1.0, 1, 2, 0, 8), (2, 1, -1, None, -1, -1, 1, 1), (2, 2, -1, None, -1, -1, 1, 7),
    ]
    means, scales = scaler_values(features)
    return ForestModel(pd.DataFrame(rows, columns=NODES.names), means, scales, psi=8,
                       contamination=0.01, offset=-0.55, seed=42, n_train=8, version="small")


def _scores(df: DataFrame) -> DataFrame:
    return flat(df.select("symbol", "window_start", "anomaly_score", "is_anomaly"))


@query
def score_small_forest(spark, sf_dir):
    features = domain.market_features(spark, sf_dir)
    return _scores(score(features, small_forest(features)))


@query
def model_roundtrip(spark, sf_dir):
    features = domain.market_features(spark, sf_dir)
    path = scratch_path(spark, "model")
    save_model(spark, small_forest(features), path)
    return _scores(score(features, load_model(spark, path)))


# --- predictions of a plain rule, so that SQL can check what is built on them


def rule_predictions(spark, sf_dir) -> DataFrame:
    """Score = minus the mean |z|; seq packs the window start and a hash of the symbol."""
    rows = domain.market_features(spark, sf_dir)
    mean_z = (F.abs("z_score_price") + F.abs("z_score_log_return") + F.abs("z_score_volume")) / 3
    symbol_bits = F.conv(F.substring(F.md5("symbol"), 1, 8), 16, 10).cast("bigint")
    return rows.select(
        (F.unix_seconds("window_start") * F.lit(1 << 32) + symbol_bits).alias("seq"),
        "symbol", *FEATURES, (-mean_z).alias("anomaly_score"), (-mean_z < RULE_CUT).alias("is_anomaly"),
        F.lit("rule").alias("model_version"), F.col(LABEL).alias("label"))


def stored_predictions(spark, sf_dir) -> DataFrame:
    """The same as a written table, for queries that read it several times."""
    return stage(rule_predictions(spark, sf_dir), "predictions")


@query
def prediction_totals(spark, sf_dir):
    return flat(analytics.totals(rule_predictions(spark, sf_dir)))


@query
def per_symbol_stats(spark, sf_dir):
    return flat(analytics.per_symbol(rule_predictions(spark, sf_dir)))


@query
def per_symbol_long(spark, sf_dir):
    return analytics.per_symbol_long(rule_predictions(spark, sf_dir))


@query
def score_percentiles(spark, sf_dir):
    return analytics.score_percentiles(stored_predictions(spark, sf_dir))


@query
def feature_stats(spark, sf_dir):
    return analytics.feature_stats(rule_predictions(spark, sf_dir))


@query
def stats_view(spark, sf_dir):
    """The nested statistics of the recent view, one row per symbol."""
    return _nested_stats(history.history(rule_predictions(spark, sf_dir)))


def _nested_stats(view: DataFrame) -> DataFrame:
    nested = analytics.stats(view)
    rows = nested.select(
        "total_predictions", "total_anomalies", "anomaly_rate", "avg_score",
        F.col("score_percentiles.p50").alias("p50"), F.col("score_percentiles.p99").alias("p99"),
        F.col("feature_stats")["z_score_price"]["std"].alias("z_score_price_std"),
        F.explode("per_symbol").alias("symbol", "s"))
    return rows.select("*", F.col("s.count").alias("symbol_count"), F.col("s.anomalies").alias("symbol_anomalies"),
                       F.col("s.avg_score").alias("symbol_avg_score")).drop("s")


@query
def feature_correlation(spark, sf_dir):
    return flat(analytics.feature_correlation(rule_predictions(spark, sf_dir)))


@query
def score_histogram(spark, sf_dir):
    return flat(analytics.score_histogram(stored_predictions(spark, sf_dir)))


@query
def feature_box_stats(spark, sf_dir):
    return flat(analytics.feature_box_stats(stored_predictions(spark, sf_dir)))


@query
def class_breakdown(spark, sf_dir):
    return analytics.class_breakdown(rule_predictions(spark, sf_dir))


@query
def score_timeline(spark, sf_dir):
    return flat(analytics.score_timeline(stored_predictions(spark, sf_dir)))


@query
def score_moving_avg(spark, sf_dir):
    return flat(analytics.score_trend(stored_predictions(spark, sf_dir)))


@query
def score_heatmap(spark, sf_dir):
    return flat(analytics.score_heatmap(stored_predictions(spark, sf_dir)))


@query
def kpis(spark, sf_dir):
    return flat(analytics.kpis(history.latest(rule_predictions(spark, sf_dir))))


@query
def latest_predictions(spark, sf_dir):
    return flat(history.latest(rule_predictions(spark, sf_dir), 100).drop("label"))


@query
def latest_of_symbol(spark, sf_dir):
    return flat(history.latest(rule_predictions(spark, sf_dir), 50, "click").drop("label"))


@query
def recent_alerts(spark, sf_dir):
    view = history.latest(rule_predictions(spark, sf_dir), 500)
    return analytics.alerts(history.recent_anomalies(view))


def predictions_in_batches(spark, sf_dir, batches: int = 24) -> str:
    """The predictions as a stream leaves them: a partition per batch, seq growing with the batch."""
    path = scratch_path(spark, "predictions")
    rows = stored_predictions(spark, sf_dir)
    second = F.floor(F.col("seq") / (1 << 32))
    first, last = rows.agg(F.min(second), F.max(second)).first()
    batch = F.floor((second - F.lit(first)) * batches / F.lit(last - first + 1))
    rows.withColumn("batch_id", batch).repartition("batch_id").write.partitionBy("batch_id").parquet(path)
    return path


@query
def latest_stored_predictions(spark, sf_dir):
    return flat(history.latest_stored(spark, predictions_in_batches(spark, sf_dir), 100))


@query
def latest_stored_of_symbol(spark, sf_dir):
    return flat(history.latest_stored(spark, predictions_in_batches(spark, sf_dir), 50, "click"))


@query
def stored_alerts(spark, sf_dir):
    view = history.latest_stored(spark, predictions_in_batches(spark, sf_dir), 500)
    return analytics.alerts(history.recent_anomalies(view))


@query
def stored_kpis(spark, sf_dir):
    return flat(analytics.kpis(history.latest_stored(spark, predictions_in_batches(spark, sf_dir))))


@query
def stored_stats(spark, sf_dir):
    """The nested statistics of the stored table's recent view; its five parts read the newest batches alone."""
    return _nested_stats(history.stored_view(spark, predictions_in_batches(spark, sf_dir)))


@query
def anomalies_only(spark, sf_dir):
    return flat(history.anomalies_only(rule_predictions(spark, sf_dir)).drop("label"))


@query
def rate_bands(spark, sf_dir):
    rates = analytics.per_symbol(rule_predictions(spark, sf_dir))
    return flat(rates.select("symbol", "anomaly_rate", rate_band("anomaly_rate").alias("band"),
                             rate_alert("anomaly_rate").alias("alert")))


@query
def display_table(spark, sf_dir):
    return analytics.display_table(rule_predictions(spark, sf_dir).drop("label"))


@query
def gauge_values(spark, sf_dir):
    rows = rule_predictions(spark, sf_dir)
    return flat(rows.select("seq", gauge_value("anomaly_score", "is_anomaly").alias("gauge")))


@query
def csv_export_roundtrip(spark, sf_dir):
    rows = rule_predictions(spark, sf_dir).select(*PREDICTION.names)
    path = scratch_path(spark, "csv")
    export_csv(rows, path)
    return flat(read_csv(spark, path, rows.schema))


@query
def classification_report(spark, sf_dir):
    return flat(metrics.classification_report(rule_predictions(spark, sf_dir), "label", "is_anomaly"))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(rule_predictions(spark, sf_dir), "label", "is_anomaly")


@query
def score_distribution_stats(spark, sf_dir):
    return flat(metrics.score_distribution(rule_predictions(spark, sf_dir)))


@query
def detected_share(spark, sf_dir):
    return flat(metrics.detected_share(rule_predictions(spark, sf_dir)))


@query
def contamination_threshold(spark, sf_dir):
    return flat(quantiles(stored_predictions(spark, sf_dir), "anomaly_score", [0.01]))


# --- injection and the fitted forest ----------------------------------------


@query
def inject_anomalies_persistent(spark, sf_dir):
    return _injected(spark, sf_dir)


@query
def inject_anomalies_fading(spark, sf_dir):
    return _injected(spark, sf_dir, fade=FADE)


@query
def inject_anomalies_transient(spark, sf_dir):
    return _injected(spark, sf_dir, persist=False)


def _injected(spark, sf_dir, **how):
    marked = inject_anomalies(domain.market_ticks(spark, sf_dir), **how)
    return marked.select("event_id", "price", "volume", "log_return", "is_anomaly", "anomaly_type")


def _trained(spark, sf_dir) -> training.Training:
    return training.train(domain.market_features(spark, sf_dir, "1 hour"))


@query
def forest_fit_score(spark, sf_dir):
    trained = _trained(spark, sf_dir)
    return _scores(score(trained.rows, trained.model))


@query
def evaluate_model(spark, sf_dir):
    return flat(training.evaluate(_trained(spark, sf_dir))["report"])


@query
def evaluate_injected(spark, sf_dir):
    """Inject, build features, train and report on the held-out part."""
    events = inject_anomalies(domain.market_ticks(spark, sf_dir), fade=FADE)
    return flat(training.evaluate(training.train(build_features(events, "1 hour")))["report"])


@query
def forest_level_nodes(spark, sf_dir):
    """The nodes of three trees over all feature rows, every level grown by one aggregation."""
    features = domain.market_features(spark, sf_dir)
    means, scales = scaler_values(features)
    scaled = stage(standardize(features, means, scales), "scaled")
    samples = scaled.withColumn("tree_id", F.explode(F.array(*[F.lit(t) for t in range(3)])))
    return flat(tree_levels.grow(samples, scaled.count(), seed=42, subtree_rows=1))


@query
def preset_scores(spark, sf_dir):
    """The presets under the fitted model, each with the share of all rows that score lower."""
    trained = _trained(spark, sf_dir)
    presets = training.score_presets(spark, trained.model)
    marks = {row["preset"]: row["anomaly_score"] for row in presets.collect()}
    below = score(trained.rows, trained.model).agg(*[
        F.avg((F.col("anomaly_score") < mark).cast("double")).alias(name) for name, mark in marks.items()])
    return flat(presets.join(F.broadcast(below.unpivot([], list(marks), "preset", "share_below")), "preset"))


@query
def preset_scores_small(spark, sf_dir):
    return flat(training.score_presets(spark, small_forest(domain.market_features(spark, sf_dir))))


@query
def model_facts(spark, sf_dir):
    """What is known of a stored model, but for the size and time of its files."""
    path = scratch_path(spark, "model")
    save_model(spark, small_forest(domain.market_features(spark, sf_dir)), path)
    facts = model_info(spark, path).drop("model_file_size_kb", "model_file_modified")
    numbers = F.arrays_zip("feature_names", "scaler_means", "scaler_stds")
    return flat(facts.select("loaded", "model_type", "n_estimators", "contamination", "max_samples", F.inline(numbers))
                .withColumnsRenamed({"feature_names": "feature", "scaler_means": "mean", "scaler_stds": "std"}))


def _first_parts(features: DataFrame, parts: int = 2) -> DataFrame:
    """The rows of the first arrivals, of `ARRIVALS` even parts of time."""
    second = F.unix_seconds("window_start")
    first, last = features.agg(F.min(second), F.max(second)).first()
    return features.where(F.floor((second - F.lit(first)) * ARRIVALS / F.lit(last - first + 1)) < parts)


@query
def evaluate_saved_model(spark, sf_dir):
    """A model and its split are saved, a third of the rows is added, and all held-out rows are reported on."""
    features = stage(domain.market_features(spark, sf_dir, "1 hour"), "features")
    known = quality.drop_incomplete(_first_parts(features))
    rule = stratified_rule(known, LABEL, training.KEY, training.TEST_SHARE, 42)
    path = scratch_path(spark, "model")
    training.save_training(spark, training.Training(small_forest(known), "labelled", known, rule), path)
    return flat(training.evaluate_saved(spark, path, features)["report"])


@query
def unsupervised_summary(spark, sf_dir):
    """A model saved without a split: the share of all rows it detects and the distribution of their scores."""
    unlabelled = stage(domain.market_features(spark, sf_dir).drop(LABEL), "features")
    path = scratch_path(spark, "model")
    training.save_training(spark, training.Training(small_forest(unlabelled), "unsupervised", unlabelled, None), path)
    parts = training.evaluate_saved(spark, path, unlabelled)
    return flat(parts["detected"].crossJoin(F.broadcast(parts["scores"])))


@query
def train_on_compat_store(spark, sf_dir):
    """The seven model columns alone, stored in two writes: split sizes, and rows that changed sides by the second."""
    features = stage(domain.market_features(spark, sf_dir, "1 hour"), "features")
    path, key = scratch_path(spark, "compat"), ("symbol", "row_key")
    model_view(_first_parts(features)).write.partitionBy("symbol").parquet(path)
    before = stage(read_compat(spark, path), "before")
    rule = stratified_rule(before, LABEL, key, training.TEST_SHARE, 42)
    sides = stage(before.select(*key, rule.test_column(before).alias("was_test")), "sides")
    model_view(features.join(_first_parts(features), list(training.KEY), "left_anti")).write.mode("append").partitionBy(
        "symbol").parquet(path)
    trained = training.train(read_compat(spark, path), key, n_estimators=20)
    now = trained.rows.withColumn("is_test", trained.rule.test_column(trained.rows)).withColumn(
        "side", rule.test_column(trained.rows))
    both = now.join(sides, list(key), "left")
    return both.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_test").alias("n_test"),
        F.count_if(F.col("was_test").isNotNull()).alias("n_before"), F.count_if("was_test").alias("n_test_before"),
        F.count_if(F.col("side") != F.col("was_test")).alias("n_moved"),
        F.lit(trained.model.n_train).alias("n_train"), F.lit(trained.model.psi).alias("psi"))


@query
def model_info_row(spark, sf_dir):
    path = scratch_path(spark, "model")
    save_model(spark, _trained(spark, sf_dir).model, path)
    return model_info(spark, path)


# --- stores and streams -----------------------------------------------------


@query
def store_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "features")
    write_features(domain.market_features(spark, sf_dir), path)
    return flat(read_features(spark, path))


def arrive(df: DataFrame, seconds, path: str, run: Callable[[], object], arrivals: int = ARRIVALS,
           write=lambda part, path: part.write.mode("append").parquet(path)) -> None:
    """Let `df` arrive at the folder `path` in even parts of time, oldest first, and call `run` after each.

    A stream that `run` starts takes all that has arrived since its last stop, so
    every part is a micro-batch of its own and every call but the first a restart.
    """
    edges = df.agg(F.min(seconds).alias("first"), F.max(seconds).alias("last")).first()
    if edges["first"] is None:
        write(df, path)
        run()
        return
    span = edges["last"] - edges["first"] + 1
    part = F.floor((seconds - F.lit(edges["first"])) * arrivals / F.lit(span))
    for i in range(arrivals):
        write(df.where(F.coalesce(part, F.lit(0)) == i), path)
        run()


@query
def compacted_store(spark, sf_dir):
    """Three arrivals of features, the store compacted after each, and the days of the second read from few files."""
    path = scratch_path(spark, "features")
    features = stage(domain.market_features(spark, sf_dir), "features")
    arrive(features, F.unix_seconds("window_start"), path, lambda: compact(spark, path, file_rows=100, fanout=2),
           write=write_features)
    since, until = features.select(*[F.timestamp_seconds(F.floor(F.unix_seconds(edge) / 86400) * 86400) for edge in (
        F.percentile_approx("window_start", 0.3), F.percentile_approx("window_start", 0.6))]).first()
    return flat(read_store(spark, path, since, until).unionByName(read_store(spark, path)))


def _messages(spark, sf_dir) -> DataFrame:
    """The events, and copies of some whose time is in another unit: a stream must pass over those."""
    events = domain.market_events(spark, sf_dir).withColumn("timestamp", F.unix_seconds("event_time"))
    wrong = events.where("event_id % 97 = 5").withColumn("timestamp", F.col("timestamp") * F.element_at(
        F.array(*[F.lit(k) for k in (1000, 1_000_000, 1_000_000_000, -1)]), (F.col("event_id") % 4 + 1).cast("int")))
    return events.unionByName(wrong)


def _write_messages(events: DataFrame, path: str) -> None:
    """Events as JSON text files, the file form of a topic."""
    encode_events(events.drop("event_time")).write.mode("append").text(path)


@query
def stream_window_features(spark, sf_dir):
    """Messages -> decode -> watermark -> windows -> feature store, as a stream."""
    source, path, checkpoint = (scratch_path(spark, n) for n in ("messages", "features", "checkpoint"))

    def run():
        start_feature_stream(text_message_stream(spark, source), path, checkpoint, domain.WINDOW,
                             extra="event_id bigint", available_now=True).awaitTermination()

    arrive(stage(_messages(spark, sf_dir), "events"), F.unix_seconds("event_time"), source, run, write=_write_messages)
    return flat(read_features(spark, path))


def _arriving_ticks(spark, sf_dir, source: str, run: Callable[[DataFrame], object]) -> None:
    """`run` starts a stream over the ticks once per arrival and waits for it."""
    ticks = domain.market_ticks(spark, sf_dir)
    arrive(ticks, F.unix_seconds("event_time"), source,
           lambda: run(spark.readStream.schema(ticks.schema).parquet(source)))


@query
def stream_log_return(spark, sf_dir):
    """Log returns micro-batch by micro-batch with a state table."""
    source, out, state, checkpoint = (scratch_path(spark, n) for n in ("ticks", "returns", "state", "checkpoint"))
    _arriving_ticks(spark, sf_dir, source, lambda ticks: start_return_stream(
        ticks, out, state, checkpoint, available_now=True).awaitTermination())
    return flat(spark.read.parquet(out).select("event_id", "symbol", "log_return"))


@query
def stream_normalized_trades(spark, sf_dir):
    """Raw trade messages -> parse -> returns -> events, as a stream."""
    names = ("messages", "events", "quarantine", "state", "checkpoint")
    source, out, rejected, state, checkpoint = (scratch_path(spark, n) for n in names)
    messages = trade_messages(spark, sf_dir, "ts")

    def run():
        stream = spark.readStream.schema(messages.drop("ts").schema).parquet(source)
        start_trade_stream(stream, out, rejected, state, checkpoint, available_now=True).awaitTermination()

    arrive(messages, F.unix_seconds(F.col("ts").cast("timestamp")), source, run,
           write=lambda part, path: part.drop("ts").write.mode("append").parquet(path))
    return flat(spark.read.parquet(out).drop("batch_id"))


@query
def stream_state_features(spark, sf_dir):
    """Keyed state feeding windows in one streaming query."""
    source, path, checkpoint = (scratch_path(spark, n) for n in ("ticks", "features", "checkpoint"))

    def run(ticks):
        features = build_features(stateful_log_return(ticks, slice_seconds=domain.WINDOW_SECONDS), domain.WINDOW)
        feature_sink(features, path, checkpoint).trigger(availableNow=True).start().awaitTermination()

    _arriving_ticks(spark, sf_dir, source, run)
    return flat(read_features(spark, path))


@query
def stream_score(spark, sf_dir):
    """Stored features -> stream -> scores with the latest model -> predictions."""
    names = ("features", "model", "predictions", "rejects", "checkpoint")
    store, model, out, rejects, checkpoint = (scratch_path(spark, n) for n in names)
    features = stage(domain.market_features(spark, sf_dir), "features")
    save_model(spark, small_forest(features), model)

    def run():
        stream = spark.readStream.schema(features.schema).parquet(store)
        start_score_stream(stream, model, out, rejects, checkpoint, available_now=True).awaitTermination()

    arrive(features, F.unix_seconds("window_start"), store, run)
    return flat(spark.read.parquet(out).drop("batch_id", "model_version").withColumn(
        "seq", F.col("seq").cast("bigint")))


@query
def stream_late_rows(spark, sf_dir):
    """Each arrival's messages, and the windows that its late ones reached after they had closed."""
    source, path, checkpoint, log = (scratch_path(spark, n) for n in ("messages", "features", "checkpoint", "progress"))
    events = domain.market_events(spark, sf_dir).withColumn("timestamp", F.unix_seconds("event_time"))
    first, last = events.agg(F.min("timestamp"), F.max("timestamp")).first()
    part = F.floor((F.col("timestamp") - F.lit(first)) * ARRIVALS / F.lit(last - first + 1))
    # Some messages of the first part come with the last one.
    dealt = stage(events.withColumn("part", F.when(F.col("event_id") % 29 == 3, F.greatest(part, F.lit(ARRIVALS - 1)))
                                    .otherwise(part)), "events")
    with ProgressLog(spark, log) as progress:
        for i in range(ARRIVALS):
            _write_messages(dealt.where(F.col("part") == i).drop("part"), source)
            progress.wait(start_feature_stream(
                text_message_stream(spark, source), path, checkpoint, domain.WINDOW, extra="event_id bigint",
                available_now=True))
    batches = read_progress(spark, log).where("n_rows > 0")
    arrival = F.row_number().over(Window.orderBy("batch_id")) - 1
    return batches.select(arrival.alias("arrival"), "n_rows", "n_without_time", "late_windows")


def request_messages(spark, sf_dir) -> DataFrame:
    """The features as JSON scoring requests; of every seven four are wrong, each in another way."""
    rows = rule_predictions(spark, sf_dir).select(F.col("seq").alias("request_id"), "symbol", *FEATURES)
    turn = F.col("request_id") % 7
    wrong = rows.withColumns({
        "z_score_price": F.when(turn == 0, F.lit(150.0)).otherwise(F.col("z_score_price")),
        "rolling_price_std": F.when(turn == 1, F.lit(-1.0)).otherwise(F.col("rolling_price_std")),
        "rolling_volume_std": F.when(turn != 3, F.col("rolling_volume_std"))})
    text = F.to_json(F.struct("symbol", *FEATURES))
    return wrong.select("request_id", F.when(turn == 2, F.lit("{broken")).otherwise(text).alias("value"))


@query
def score_requests(spark, sf_dir):
    """JSON requests in three arrivals -> checked -> scored -> predictions and refusals, with a mark per batch."""
    source, model, path, checkpoint = (scratch_path(spark, n) for n in ("requests", "model", "answers", "checkpoint"))
    save_model(spark, small_forest(domain.market_features(spark, sf_dir)), model)
    messages = stage(request_messages(spark, sf_dir), "requests")

    def run():
        stream = spark.readStream.schema(messages.schema).parquet(source)
        request_stream.start_request_stream(stream, model, path, checkpoint, available_now=True).awaitTermination()

    arrive(messages, F.floor(F.col("request_id") / (1 << 32)), source, run)
    answered = request_stream.predictions(spark, path).select(
        "request_id", "symbol", "seq", "anomaly_score", "is_anomaly", F.lit("").alias("reasons"))
    refused = request_stream.rejects(spark, path).select(
        "request_id", "symbol", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("double").alias("anomaly_score"),
        F.lit(None).cast("boolean").alias("is_anomaly"), F.concat_ws("; ", "reject_reasons").alias("reasons"))
    return flat(answered.unionByName(refused))


@query
def stream_chain_stats(spark, sf_dir):
    """Ticks -> returns -> features -> scores, three chained streams over three arrivals; statistics of what they stored."""
    names = ("ticks", "returns", "state", "features", "model", "predictions", "rejects", "cp_returns", "cp_features", "cp_scores")
    source, returns, state, store, model, out, rejects, cp1, cp2, cp3 = (scratch_path(spark, n) for n in names)
    save_model(spark, small_forest(domain.market_features(spark, sf_dir)), model)

    def run(ticks):
        start_return_stream(ticks, returns, state, cp1, available_now=True).awaitTermination()
        schema = T.StructType([*ticks.schema.fields, T.StructField("log_return", T.DoubleType())])
        # A micro-batch that was repeated after a failure is read again, in new files.
        events = spark.readStream.schema(schema).parquet(returns).withWatermark(
            "event_time", WATERMARK).dropDuplicatesWithinWatermark(["symbol", "event_id"])
        feature_sink(build_features(events, domain.WINDOW), store, cp2).trigger(availableNow=True).start().awaitTermination()
        features = spark.readStream.schema(FEATURE).parquet(store)
        start_score_stream(features, model, out, rejects, cp3, available_now=True).awaitTermination()

    _arriving_ticks(spark, sf_dir, source, run)
    stored = spark.read.parquet(out).drop("batch_id")
    return flat(analytics.per_symbol(stored))
