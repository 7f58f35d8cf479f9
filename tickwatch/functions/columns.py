"""Scalar column functions (all JVM-side built-ins)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The listed pairs and their exchange stream names.
SYMBOL_TO_STREAM = {
    "BTC-USDT": "btcusdt",
    "ETH-USDT": "ethusdt",
    "BNB-USDT": "bnbusdt",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    # A chain of WHENs over a fixed handful of names stays inside code
    # generation; a map literal would be searched entry by entry anyway.
    result = F.lit(None).cast("string")
    for name, value in mapping.items():
        result = F.when(key == name, F.lit(value)).otherwise(result)
    return result


def json_columns(text, schema, options: dict | None = None) -> Column:
    """The fields of a JSON text as columns of a select, parsed once per row.

    As a generator it stays below later filters; a filter on fields of a plain
    from_json is pushed under the projection and parses the text again.
    """
    return F.inline(F.array(F.from_json(_col(text), schema, options or {})))


def to_symbol(exchange_symbol) -> Column:
    """BTCUSDT in any case becomes BTC-USDT; unknown names pass through as given."""
    c = _col(exchange_symbol)
    back = {stream: symbol for symbol, stream in SYMBOL_TO_STREAM.items()}
    return F.coalesce(_lookup(back, F.lower(c)), c)


def to_stream_name(symbol) -> Column:
    """BTC-USDT becomes btcusdt; unknown names lose their dashes and are lowered."""
    c = _col(symbol)
    return F.coalesce(_lookup(SYMBOL_TO_STREAM, c), F.lower(F.replace(c, F.lit("-"), F.lit(""))))


# Seconds of the years 1970 to 9999. Other numbers are times in another unit, or none.
LAST_SECOND = 253_402_300_799


def valid_seconds(seconds) -> Column:
    """Epoch seconds inside the years 1970 to 9999; null for anything else, so that no conversion overflows."""
    c = _col(seconds)
    return F.when(c.between(0, LAST_SECOND), c)


def valid_millis(millis) -> Column:
    """Epoch milliseconds inside the years 1970 to 9999; null for anything else."""
    c = _col(millis)
    return F.when(c.between(0, LAST_SECOND * 1000 + 999), c)


def floor_seconds(millis) -> Column:
    """Epoch milliseconds to whole seconds, rounding down also below zero."""
    c = _col(millis)
    return ((c - F.pmod(c, F.lit(1000))) / 1000).cast("bigint")


def log_return(price, previous) -> Column:
    """ln(price / previous); 0 for a first tick or a previous price of zero or less.

    A price of zero or less after a valid one has no log return: null.
    """
    p, q = _col(price), _col(previous)
    return F.when(q.isNull() | (q <= 0), F.lit(0.0)).when(p > 0, F.ln(p / q))


def z_score(value, mean, std) -> Column:
    """(value - mean) / std, and 0 where std is 0."""
    return F.when(_col(std) == 0, F.lit(0.0)).otherwise((_col(value) - _col(mean)) / _col(std))


def arrival_key(event_time, event_id) -> Column:
    """One sortable DECIMAL(38) for (event_time, event_id).

    A decimal fits a fixed-width aggregation buffer, so max_by over this key
    stays a hash aggregate; the same max_by over a struct would sort every
    input split first.
    """
    micros = F.unix_micros(_col(event_time)).cast("decimal(18,0)")
    scale = F.lit("10000000000000000000").cast("decimal(20,0)")
    tie = F.coalesce(_col(event_id).cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    return (micros * scale).cast("decimal(38,0)") + tie


def uniform(key, seed: int, stream: int) -> Column:
    """A repeatable uniform draw in [0, 1) from a row key (32 bits of an MD5)."""
    text = F.concat_ws(":", _col(key).cast("string"), F.lit(str(seed)), F.lit(str(stream)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def is_finite(c) -> Column:
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def rate_band(rate) -> Column:
    """Severity band of a percentage: low [0,5), medium [5,15), high [15,100]."""
    r = _col(rate)
    return (
        F.when((r >= 0) & (r < 5), "low")
        .when((r >= 5) & (r < 15), "medium")
        .when((r >= 15) & (r <= 100), "high")
    )


def rate_alert(rate) -> Column:
    return _col(rate) > 10


def gauge_value(score, is_anomaly) -> Column:
    """100 for an anomaly, else |score| * 20 held within 0..100."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.abs(_col(score)) * 20))
    return F.when(_col(is_anomaly), F.lit(100.0)).otherwise(scaled)


def alert_text(symbol, score, z_price, z_log_return, z_volume) -> Column:
    # The wording of an alert.
    return F.format_string(
        "%s — score: %.4f | z_price: %.2f | z_log_ret: %.2f | z_vol: %.2f",
        _col(symbol), _col(score), _col(z_price), _col(z_log_return), _col(z_volume),
    )


def display_text(name: str, data_type: str) -> Column:
    """A cell as text: doubles with 4 decimals, booleans as YES/no, others as they are."""
    c = F.col(name)
    if data_type in ("double", "float"):
        return F.format_string("%.4f", c)
    if data_type == "boolean":
        return F.when(c, "YES").otherwise("no")
    return c.cast("string")
