"""Schemas of every table the package reads or writes."""

from pyspark.sql import types as T

# Field names and order of the messages (EVENT, TRADE) and of the model's inputs.
FEATURES = [
    "z_score_price",
    "z_score_log_return",
    "z_score_volume",
    "rolling_price_std",
    "rolling_volume_std",
]
Z_FEATURES = FEATURES[:3]
STD_FEATURES = FEATURES[3:]
LABEL = "is_anomaly"

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(),
    "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def table(columns: str) -> T.StructType:
    """A schema from "name type, ..." that needs no running session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_FEATURE_DOUBLES = ", ".join(f"{name} double" for name in FEATURES)

EVENT = table(
    "timestamp bigint, symbol string, price double, volume double, "
    "log_return double, is_anomaly boolean, anomaly_type string"
)

# Exchange trades carry numbers as text, so every leaf is read as text and
# converted with try_cast: a bad number is then a null, not a failed job.
TRADE = T.StructType([
    T.StructField("data", table("e string, s string, p string, q string, T string"))
])

FEATURE = table(
    f"symbol string, window_start timestamp, window_end timestamp, {_FEATURE_DOUBLES}, is_anomaly int"
)

# The model columns alone, as stores without window bounds hold them.
COMPAT = table(f"symbol string, {_FEATURE_DOUBLES}, is_anomaly int")

MANIFEST = table(
    "kind string, symbol string, file string, n_rows bigint, first_window timestamp, last_window timestamp"
)

# A scoring request as text fields: numbers may arrive quoted or not.
REQUEST = table("symbol string, " + ", ".join(f"{name} string" for name in FEATURES))

SCALER = table("feature string, position int, mean double, scale double")

# feature -1 marks a leaf.
NODES = table(
    "tree_id int, node_id int, feature int, threshold double, left int, right int, "
    "depth int, n_samples int"
)

META = table(
    "model_version string, n_estimators int, max_samples string, psi int, "
    "contamination double, offset double, seed bigint, n_train bigint"
)

PREDICTION = table(
    f"seq bigint, symbol string, {_FEATURE_DOUBLES}, anomaly_score double, "
    "is_anomaly boolean, model_version string"
)

# A report per micro-batch; the watermark is text as the engine prints it.
PROGRESS = table(
    "query_id string, batch_id bigint, reported_at string, n_rows bigint, n_without_time bigint, "
    "late_windows bigint, open_windows bigint, watermark string"
)

SPLIT = table("model_version string, label string, cut string, keys string, seed bigint")
