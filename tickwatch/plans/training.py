"""Training and evaluation over a feature table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwatch.functions.columns import gauge_value
from tickwatch.operators.forest import CONTAMINATION, N_ESTIMATORS, SEED, ForestModel, fit_forest, score
from tickwatch.operators.metrics import (
    classification_report,
    confusion_matrix,
    detected_share,
    score_distribution,
)
from tickwatch.operators.quality import drop_incomplete, label_summary
from tickwatch.operators.split import SplitRule, stratified_rule, train_test
from tickwatch.schema import FEATURES, LABEL
from tickwatch.session import stage
from tickwatch.sources.model_store import held_out, load_model, load_split, save_model, save_split

KEY = ("symbol", "window_start")
TEST_SHARE = 0.2

# The preset inputs, in feature order.
PRESETS = {
    "Normal": (0.1, 0.05, 0.2, 0.002, 10.0),
    "Price Spike": (4.5, 3.8, 1.5, 0.008, 25.0),
    "Volume Spike": (0.5, 0.3, 4.8, 0.003, 45.0),
    "Flash Crash": (-4.2, -4.5, 3.5, 0.009, 40.0),
}


@dataclass
class Training:
    model: ForestModel
    mode: str
    rows: DataFrame
    rule: SplitRule | None

    def held_out(self) -> DataFrame:
        """What evaluation looks at: the test part, or all rows without labels."""
        return train_test(self.rows, self.rule)[1] if self.rule else self.rows


def train(
    features: DataFrame,
    key: tuple[str, ...] = KEY,
    n_estimators: int = N_ESTIMATORS,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
    materialize: bool = True,
    max_samples="auto",
) -> Training:
    """Fit on 80% of each class when there are labelled anomalies, else on all rows.

    Training reads the rows several times, so they are written out first unless
    they already are a stored table (materialize=False).
    """
    rows = drop_incomplete(features)
    if materialize:
        rows = stage(rows, "training")
    mode = label_summary(rows).first()["mode"]
    rule = stratified_rule(rows, LABEL, key, TEST_SHARE, seed) if mode == "labelled" else None
    fit_rows = train_test(rows, rule)[0] if rule else rows
    model = fit_forest(fit_rows, list(key), n_estimators, max_samples, contamination, seed)
    return Training(model, mode, rows, rule)


def evaluate(training: Training) -> dict[str, DataFrame]:
    """report and confusion (labelled) or detected (unsupervised), and the score distribution."""
    return _evaluation(score(training.held_out(), training.model), training.rule is not None)


def _evaluation(scored: DataFrame, labelled: bool) -> dict[str, DataFrame]:
    result = {"scores": score_distribution(scored)}
    if labelled:
        result["report"] = classification_report(scored, "label", "is_anomaly")
        result["confusion"] = confusion_matrix(scored, "label", "is_anomaly")
    else:
        result["detected"] = detected_share(scored)
    return result


def save_training(spark: SparkSession, training: Training, path: str) -> None:
    """The model and, where there is one, the split it was fitted under; the model becomes visible last."""
    if training.rule:
        save_split(spark, training.rule, training.model.version, path)
    save_model(spark, training.model, path)


def evaluate_saved(spark: SparkSession, path: str, features: DataFrame, version: str | None = None) -> dict[str, DataFrame]:
    """`evaluate` of a saved model on rows its training never saw, rows added to the table since included.

    Without a saved split (a model fitted on unlabelled rows) all rows are looked at.
    """
    model = load_model(spark, path, version)
    if model is None:
        raise RuntimeError(f"no model in {path}")
    split = load_split(spark, path, model.version)
    rows = drop_incomplete(features)
    return _evaluation(score(held_out(rows, split, LABEL) if split else rows, model), split is not None)


def presets(spark: SparkSession) -> DataFrame:
    rows = [(name, "BTC-USDT", *values) for name, values in PRESETS.items()]
    columns = ", ".join(f"{c} DOUBLE" for c in FEATURES)
    return spark.createDataFrame(rows, f"preset STRING, symbol STRING, {columns}")


def score_presets(spark: SparkSession, model: ForestModel) -> DataFrame:
    scored = score(presets(spark), model)
    return scored.select(
        "preset", "anomaly_score", "is_anomaly",
        gauge_value("anomaly_score", "is_anomaly").alias("gauge"),
        F.format_string("%.4f", "anomaly_score").alias("score_text"))
