"""The same queries as SQL over the provided tables, for checking results."""

import math

from tickwatch.plans.training import PRESETS
from tickwatch.schema import FEATURES

_EVENT_TICKS = """
ev AS (
  SELECT event_id, ts, event_type AS symbol, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, value > 230 AS is_anomaly
  FROM events)"""

_LINEITEM_TICKS = """
ev AS (
  SELECT ('0x' || substr(md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15))::BIGINT AS event_id,
         l_shipdate AS ts,
         l_returnflag || l_linestatus AS symbol, l_extendedprice AS price, l_quantity AS volume,
         l_discount >= 0.1 AS is_anomaly
  FROM lineitem)"""

_TICK = """
prior AS (
  SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS previous FROM ev),
tick AS (
  SELECT event_id, ts, symbol, price, volume, is_anomaly,
         CASE WHEN previous IS NULL OR previous <= 0 THEN 0.0
              WHEN price > 0 THEN ln(price / nullif(previous, 0)) END AS log_return
  FROM prior)"""


def _features(window: str, ticks: str = _EVENT_TICKS, tick: str = _TICK) -> str:
    return f"""{ticks},{tick},
win AS (
  SELECT symbol, time_bucket(INTERVAL '{window}', ts, TIMESTAMP '1970-01-01') AS window_start,
         avg(log_return) AS lr_mean, coalesce(stddev_samp(log_return), 0.0) AS lr_std,
         avg(volume) AS v_mean, coalesce(stddev_samp(volume), 0.0) AS rolling_volume_std,
         avg(price) AS p_mean, coalesce(stddev_samp(price), 0.0) AS rolling_price_std,
         arg_max_null(log_return, (ts, event_id)) AS lr, arg_max_null(volume, (ts, event_id)) AS v,
         arg_max_null(price, (ts, event_id)) AS p, max(CAST(is_anomaly AS INTEGER)) AS is_anomaly
  FROM tick GROUP BY ALL),
feat AS (
  SELECT symbol, window_start, window_start + INTERVAL '{window}' AS window_end,
         CASE WHEN rolling_price_std = 0 THEN 0.0 ELSE (p - p_mean) / nullif(rolling_price_std, 0) END AS z_score_price,
         CASE WHEN lr_std = 0 THEN 0.0 ELSE (lr - lr_mean) / nullif(lr_std, 0) END AS z_score_log_return,
         CASE WHEN rolling_volume_std = 0 THEN 0.0 ELSE (v - v_mean) / nullif(rolling_volume_std, 0) END AS z_score_volume,
         rolling_price_std, rolling_volume_std, is_anomaly
  FROM win)"""


def r(expression: str, digits: int = 6) -> str:
    # Adding zero turns a rounded -0.0 into 0.0.
    return f"(round({expression}, {digits}) + 0.0)"


def _epoch(c: str) -> str:
    return f"CAST(epoch({c}) AS BIGINT) AS {c}"


def _rounded(columns: list[str]) -> str:
    return ", ".join(f"{r(c)} AS {c}" for c in columns)


_FEATURE_ROW = f"symbol, {_epoch('window_start')}, {_epoch('window_end')}, {_rounded(FEATURES)}, is_anomaly"
_F6 = "WITH " + _features("6 hours")
_CLOSED = "window_end <= (SELECT max(ts) FROM ev) - INTERVAL '1 minute'"

_PRED = _F6 + """,
pred AS (
  SELECT CAST(epoch(window_start) AS BIGINT) * 4294967296
           + ('0x' || substr(md5(symbol), 1, 8))::BIGINT AS seq,
         symbol, z_score_price, z_score_log_return, z_score_volume, rolling_price_std, rolling_volume_std,
         -(abs(z_score_price) + abs(z_score_log_return) + abs(z_score_volume)) / 3 AS anomaly_score,
         -(abs(z_score_price) + abs(z_score_log_return) + abs(z_score_volume)) / 3 < -1.5 AS is_anomaly,
         'rule' AS model_version, is_anomaly AS label
  FROM feat)"""
_PRED_ROW = f"seq, symbol, {_rounded(FEATURES)}, {r('anomaly_score')} AS anomaly_score, is_anomaly, model_version"
_VIEW = _PRED + ", view AS (SELECT * FROM pred ORDER BY seq DESC LIMIT 500)"

_DOUBTFUL = _F6 + """,
doubt AS (
  SELECT symbol, window_start, z_score_price * 60 AS z_score_price,
         CASE WHEN z_score_price > 2 THEN 'inf'::DOUBLE ELSE z_score_log_return END AS z_score_log_return,
         CASE WHEN z_score_volume < -1.2 THEN 'nan'::DOUBLE ELSE z_score_volume END AS z_score_volume,
         rolling_price_std - 40 AS rolling_price_std,
         CASE WHEN is_anomaly = 0 THEN rolling_volume_std END AS rolling_volume_std, is_anomaly
  FROM feat)"""


def _reason(c: str, broken: str, text: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN '{c}: missing' WHEN NOT isfinite({c}) THEN '{c}: not finite' "
            f"WHEN {broken} THEN '{c}: {text}' END")


def _reasons() -> str:
    parts = ["CASE WHEN symbol IS NULL THEN 'symbol: missing' END"]
    parts += [_reason(c, f"abs({c}) > 100", "out of range") for c in FEATURES[:3]]
    parts += [_reason(c, f"{c} < 0", "negative") for c in FEATURES[3:]]
    return f"concat_ws('; ', {', '.join(parts)})"


def _c(n: int) -> float:
    """Mean unsuccessful search depth, as in the Isolation Forest paper."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _scaled() -> str:
    scaled = ", ".join(
        f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END AS {c}"
        for c in FEATURES)
    return f"scaled AS (SELECT symbol, window_start, window_end, {scaled} FROM feat)"


def _scaled_by(rows: str, known: str, keep: str) -> str:
    """The features of `rows` scaled by the moments of `known`."""
    moments = ", ".join(f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s{i}"
                        for i, c in enumerate(FEATURES))
    scaled = ", ".join(f"(x.{c} - m{i}) / s{i} AS {c}" for i, c in enumerate(FEATURES))
    return f"moments AS (SELECT {moments} FROM {known}), scaled AS (SELECT {keep}, {scaled} FROM {rows} x, moments)"


def _small_scores(keep: str) -> str:
    """path and scored: the hand-written forest over the rows of `scaled`."""
    return f"""
path AS (
  SELECT {keep},
    ( CASE WHEN z_score_price <= 0.0 THEN {1 + _c(5)!r}
           WHEN z_score_volume <= 0.5 THEN {2 + _c(2)!r} ELSE {2 + _c(1)!r} END
    + CASE WHEN rolling_price_std > 1.0 THEN {1 + _c(1)!r}
           WHEN z_score_log_return <= -0.5 THEN {2 + _c(3)!r} ELSE {2 + _c(4)!r} END
    + CASE WHEN rolling_volume_std <= -1.0 THEN {1 + _c(1)!r} ELSE {1 + _c(7)!r} END) / 3.0 AS h
  FROM scaled),
scored AS (SELECT {keep}, -pow(2.0, -h / {_c(8)!r}) + 0.55 AS anomaly_score FROM path)"""


def _small_forest() -> str:
    return f"{_F6}, {_scaled()},{_small_scores('symbol, window_start, window_end')}"


def _level_nodes(trees: int = 3, levels: int = 12) -> str:
    """Isolation trees level by level; the height limit follows from the number of rows, 2**levels at most."""
    def u(k: int) -> str:
        return f"('0x' || substr(md5(tree_id || '/' || path || ':42:{k}'), 1, 8))::BIGINT / 4294967296.0"

    edges = ", ".join(f"min({c}) AS low_{i}, max({c}) AS high_{i}" for i, c in enumerate(FEATURES))
    entries = ", ".join(f"{{'i': {i}, 'low': low_{i}, 'high': high_{i}}}" for i in range(len(FEATURES)))
    value = " ".join(f"WHEN {i} THEN l.{c}" for i, c in enumerate(FEATURES))
    parts = [f"""top AS (SELECT greatest(1, ceil(log2(count(*)))) AS height FROM scaled),
l0 AS MATERIALIZED (SELECT t::INT AS tree_id, 1::BIGINT AS path, {', '.join(FEATURES)} FROM scaled, range({trees}) AS g(t))"""]
    for d in range(levels + 1):
        parts.append(f"""f{d} AS (SELECT tree_id, path, count(*) AS n, {edges} FROM l{d} GROUP BY tree_id, path),
u{d} AS (SELECT *, list_filter([{entries}], lambda e: e.high - e.low > 1e-7) AS usable FROM f{d}),
e{d} AS (SELECT *, usable[1 + floor({u(1)} * len(usable))::INT] AS e FROM u{d}),
c{d} AS (SELECT *, e.low + {u(2)} * (e.high - e.low) AS cut FROM e{d}),
n{d} AS MATERIALIZED (
  SELECT tree_id, path, {d} AS depth, CASE WHEN {d} >= height OR n <= 1 THEN -1 ELSE coalesce(e.i, -1) END AS feature,
         CASE WHEN cut >= e.high THEN e.low ELSE cut END AS threshold, n AS n_samples FROM c{d}, top),
l{d + 1} AS MATERIALIZED (
  SELECT l.tree_id, l.path * 2 + CASE WHEN CASE feature {value} END <= threshold THEN 0 ELSE 1 END AS path,
         {', '.join(f'l.{c}' for c in FEATURES)}
  FROM l{d} l JOIN n{d} n ON l.tree_id = n.tree_id AND l.path = n.path WHERE feature >= 0)""")
    every = " UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(levels + 1))
    return f"""{_F6}, {_scaled()}, {', '.join(parts)}
SELECT tree_id, path, depth, feature, CASE WHEN feature >= 0 THEN {r('threshold')} END AS threshold, n_samples FROM ({every})"""


_SMALL_ROW = (f"symbol, {_epoch('window_start')}, {r('anomaly_score')} AS anomaly_score, "
              "anomaly_score < 0 AS is_anomaly")


def _long(source: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra} '{c}' AS feature, {c} AS value FROM {source}" for c in FEATURES)


def _inject(how: str) -> str:
    def u(k: int) -> str:
        return f"('0x' || substr(md5(event_id || ':42:{k}'), 1, 8))::BIGINT / 4294967296.0"

    order = "OVER (PARTITION BY symbol ORDER BY ts, event_id)"
    if how == "persistent":
        level = f"""
moved AS (
  SELECT event_id, ts, symbol, volume, anomaly_type, price AS raw, lag(price) {order} AS raw_previous,
         f, exp(sum(ln(f)) {order}) AS level FROM marked),
final AS (
  SELECT *, raw * level AS price, raw_previous * level / f AS previous FROM moved)"""
    elif how == "fading":
        level = f"""
placed AS MATERIALIZED (SELECT *, lag(price) {order} AS raw_previous, row_number() {order} AS i FROM marked),
run AS (
  SELECT symbol, i, 0.0::DOUBLE AS before, ln(f) AS level FROM placed WHERE i = 1
  UNION ALL
  SELECT p.symbol, p.i, r.level, r.level * 0.999::DOUBLE + ln(p.f) FROM run r JOIN placed p ON p.symbol = r.symbol AND p.i = r.i + 1),
final AS (
  SELECT event_id, volume, anomaly_type, price * exp(level) AS price, raw_previous * exp(before) AS previous
  FROM placed JOIN run USING (symbol, i))"""
    else:
        level = f"""
moved AS (SELECT event_id, ts, symbol, volume, anomaly_type, price * f AS price FROM marked),
final AS (SELECT *, lag(price) {order} AS previous FROM moved)"""
    return f"""WITH RECURSIVE {_EVENT_TICKS},
drawn AS (
  SELECT *, {u(1)} < 0.01 AS hit, {u(3)} AS u3,
         ['PRICE_SPIKE', 'VOLUME_SPIKE', 'FLASH_CRASH'][1 + CAST(floor({u(2)} * 3) AS INTEGER)] AS kind
  FROM ev),
marked AS (
  SELECT event_id, ts, symbol, price, CASE WHEN hit THEN kind END AS anomaly_type,
         CASE WHEN hit AND kind = 'VOLUME_SPIKE' THEN volume * 8 ELSE volume END AS volume,
         CASE WHEN hit AND kind = 'PRICE_SPIKE' THEN 1.05 + u3 * 0.1
              WHEN hit AND kind = 'FLASH_CRASH' THEN 0.85 + u3 * 0.1 ELSE 1.0 END AS f
  FROM drawn),{level}
SELECT event_id, {r('price', 2)} AS price, {r('volume')} AS volume,
       {r("CASE WHEN previous IS NULL OR previous <= 0 THEN 0.0 WHEN price > 0 THEN ln(price / nullif(previous, 0)) END")} AS log_return,
       anomaly_type IS NOT NULL AS is_anomaly, anomaly_type
FROM final"""


def _report(source: str = "pred", head: str | None = None) -> str:
    def cls(name: str, t: int) -> str:
        return (f"SELECT '{name}' AS class, p{t} AS precision, r{t} AS recall, "
                f"CASE WHEN p{t} + r{t} = 0 THEN 0.0 ELSE 2 * p{t} * r{t} / nullif(p{t} + r{t}, 0) END AS f1, "
                f"s{t} AS support FROM pr")

    return f"""{head or _PRED},
cm AS (
  SELECT count(*) FILTER (label = 0 AND NOT is_anomaly) AS tn, count(*) FILTER (label = 0 AND is_anomaly) AS fp,
         count(*) FILTER (label = 1 AND NOT is_anomaly) AS fn, count(*) FILTER (label = 1 AND is_anomaly) AS tp
  FROM {source}),
pr AS (
  SELECT coalesce(tn / nullif(tn + fn, 0), 0.0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0.0) AS r0, tn + fp AS s0,
         coalesce(tp / nullif(tp + fp, 0), 0.0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r1, tp + fn AS s1,
         (tn + tp) / nullif(tn + tp + fn + fp, 0) AS acc
  FROM cm),
cls AS ({cls('0', 0)} UNION ALL {cls('1', 1)}),
every AS (
  SELECT * FROM cls
  UNION ALL SELECT 'accuracy', NULL, NULL, coalesce(acc, 0.0), s0 + s1 FROM pr
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM cls
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM cls)
SELECT class, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1,
       CAST(support AS BIGINT) AS support FROM every"""


_TOTALS = ("count(*) AS {n}, count(*) FILTER (is_anomaly) AS {a}, "
           "round(coalesce(count(*) FILTER (is_anomaly) * 100.0 / nullif(count(*), 0), 0.0), 2) AS anomaly_rate, "
           "(round(coalesce(avg(anomaly_score), 0.0), 6) + 0.0) AS avg_score")

_POSITION = "CAST(row_number() OVER (ORDER BY seq) - 1 AS BIGINT) AS position"


def _correlation() -> str:
    rows = [
        f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, {r(f'corr({x}, {y})')} AS correlation FROM pred"
        for x in FEATURES for y in FEATURES
    ]
    return _PRED + " " + " UNION ALL ".join(rows)


def _feature_stats() -> str:
    return f"""{_PRED}, long AS ({_long('pred')})
SELECT feature, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std,
       {r('min(value)')} AS min, {r('max(value)')} AS max FROM long GROUP BY feature"""


def _box() -> str:
    return f"""{_PRED}, long AS ({_long('pred', 'is_anomaly,')}),
box AS (
  SELECT feature, is_anomaly, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL)
SELECT feature, is_anomaly, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3, {r('avg(value)')} AS mean,
       {r('min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_low,
       {r('max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_high
FROM long JOIN box USING (feature, is_anomaly) GROUP BY feature, is_anomaly, q1, median, q3"""


_TRADE_MESSAGES = """
msg AS (
  SELECT event_id, epoch_us(ts) // 1000 AS t,
         CASE event_type WHEN 'click' THEN 'BTC-USDT' WHEN 'error' THEN 'ETH-USDT' WHEN 'view' THEN 'BNB-USDT'
              ELSE upper(event_type) END AS symbol,
         value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
         CASE WHEN event_id % 40 = 13 THEN 'malformed'
              WHEN event_id % 40 = 17 OR event_type = 'signup' THEN 'other'
              WHEN event_id % 40 = 7 THEN 'symbol'
              WHEN event_id % 40 = 11 THEN 'price'
              WHEN event_id % 40 IN (19, 23, 29) THEN 'time' END AS reason
  FROM events)"""

# The arrivals of a stream, three even parts of time, are its micro-batches.
_ARRIVAL = ("(SELECT epoch(min(window_start))::BIGINT AS lo, epoch(max(window_start))::BIGINT AS hi FROM feat)")
_BATCH = "floor((epoch(window_start)::BIGINT - lo) * 3 / (hi - lo + 1))::BIGINT"
_BATCH_SEQ = (f"({_BATCH} * 68719476736 + row_number() OVER (PARTITION BY {_BATCH} ORDER BY window_start, symbol) - 1)"
              "::BIGINT")
_SQL_STREAM_FEATURES = f"{_F6} SELECT {_FEATURE_ROW} FROM feat WHERE {_CLOSED}"
_SQL_LOG_RETURN = f"SELECT event_id, symbol, {r('log_return')} AS log_return FROM tick"


_ARRIVED = (f"arrived AS (SELECT feat.*, {_BATCH} AS arrival FROM feat, {_ARRIVAL})")


def _saved_report() -> str:
    """Cut-offs from the rows of the first two arrivals; every row at or below its label's cut-off is held out."""
    return _report("pred", f"""WITH {_features('1 hour')}, {_ARRIVED},
hashed AS (SELECT *, md5('s' || symbol || chr(0) || 's' || epoch_us(window_start) || chr(0) || '42') AS h FROM arrived),
known AS (SELECT * FROM hashed WHERE arrival < 2),
placed AS (SELECT is_anomaly, h, row_number() OVER (PARTITION BY is_anomaly ORDER BY h) AS i,
                  floor(count(*) OVER (PARTITION BY is_anomaly) * 0.2 + 0.5) AS need FROM known),
cuts AS (SELECT is_anomaly, h AS cut FROM placed WHERE i = need),
{_scaled_by('(SELECT hashed.* FROM hashed JOIN cuts ON hashed.is_anomaly = cuts.is_anomaly AND h <= cut)', 'known', 'is_anomaly')},
{_small_scores('is_anomaly')},
pred AS (SELECT is_anomaly AS label, anomaly_score < 0 AS is_anomaly FROM scored)""")


def _presets() -> str:
    rows = ", ".join(f"('{name}', {', '.join(map(repr, values))})" for name, values in PRESETS.items())
    gauge = "CASE WHEN anomaly_score < 0 THEN 100.0 ELSE greatest(0.0, least(100.0, abs(anomaly_score) * 20)) END"
    return f"""{_F6},
asked AS (SELECT * FROM (VALUES {rows}) AS v(preset, {', '.join(FEATURES)})),
{_scaled_by('asked', 'feat', 'preset')},{_small_scores('preset')}
SELECT preset, {r('anomaly_score')} AS anomaly_score, anomaly_score < 0 AS is_anomaly, {r(gauge)} AS gauge,
       printf('%.4f', anomaly_score) AS score_text FROM scored"""


def _requests() -> str:
    turn = "seq % 7"
    return f"""{_PRED},
asked AS (
  SELECT seq AS request_id, CASE WHEN {turn} <> 2 THEN symbol END AS symbol,
         CASE {turn} WHEN 0 THEN 150.0 WHEN 2 THEN NULL ELSE z_score_price END AS z_score_price,
         CASE WHEN {turn} <> 2 THEN z_score_log_return END AS z_score_log_return,
         CASE WHEN {turn} <> 2 THEN z_score_volume END AS z_score_volume,
         CASE {turn} WHEN 1 THEN -1.0 WHEN 2 THEN NULL ELSE rolling_price_std END AS rolling_price_std,
         CASE WHEN {turn} NOT IN (2, 3) THEN rolling_volume_std END AS rolling_volume_std
  FROM pred),
checked AS (SELECT *, {_reasons()} AS reasons FROM asked),
{_scaled_by('(SELECT * FROM checked)', 'feat', 'request_id, symbol, reasons')},
{_small_scores('request_id, symbol, reasons')},
edge AS (SELECT min(request_id // 4294967296) AS lo, max(request_id // 4294967296) AS hi FROM asked),
parts AS (SELECT *, floor((request_id // 4294967296 - lo) * 3 / (hi - lo + 1))::BIGINT AS batch FROM scored, edge)
SELECT request_id, symbol,
       CASE WHEN reasons = '' THEN batch * 68719476736 + row_number() OVER (PARTITION BY batch, reasons = '' ORDER BY request_id) - 1
            END::BIGINT AS seq,
       CASE WHEN reasons = '' THEN {r('anomaly_score')} END AS anomaly_score,
       CASE WHEN reasons = '' THEN anomaly_score < 0 END AS is_anomaly, reasons FROM parts"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "window_features": f"{_F6} SELECT {_FEATURE_ROW} FROM feat",
        "window_features_1min": f"WITH {_features('1 minute')} SELECT {_FEATURE_ROW} FROM feat",
        "window_features_7day": f"WITH {_features('7 days', _LINEITEM_TICKS)} SELECT {_FEATURE_ROW} FROM feat",
        "tick_log_return": f"WITH {_EVENT_TICKS},{_TICK} {_SQL_LOG_RETURN}",
        "tick_log_return_lineitem": f"WITH {_LINEITEM_TICKS},{_TICK} {_SQL_LOG_RETURN}",
        "stream_log_return": f"WITH {_EVENT_TICKS},{_TICK} {_SQL_LOG_RETURN}",
        "store_roundtrip": f"{_F6} SELECT {_FEATURE_ROW} FROM feat",
        "stream_window_features": _SQL_STREAM_FEATURES,
        "stream_state_features": _SQL_STREAM_FEATURES,
    }
    bad = "event_id % 50 = 0"
    sql["decode_messages"] = f"""WITH {_EVENT_TICKS}
SELECT event_id, CASE WHEN NOT {bad} THEN CAST(floor(epoch(ts)) AS BIGINT) * (CASE event_id % 53
         WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000000 WHEN 4 THEN -1 ELSE 1 END) END AS timestamp,
       CASE WHEN NOT {bad} THEN symbol END AS symbol,
       CASE WHEN NOT {bad} AND event_id % 51 <> 0 THEN {r('price')} END AS price,
       CASE WHEN NOT {bad} THEN {r('volume')} END AS volume, CASE WHEN NOT {bad} THEN 0.0::DOUBLE END AS log_return,
       CASE WHEN NOT {bad} THEN is_anomaly END AS is_anomaly, NULL::VARCHAR AS anomaly_type,
       CASE WHEN NOT {bad} AND event_id % 53 NOT IN (1, 2, 3, 4) THEN CAST(floor(epoch(ts)) AS BIGINT) END AS event_time FROM ev"""
    sql["normalized_trades"] = f"""WITH {_TRADE_MESSAGES},
good AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY t, event_id) AS previous FROM msg WHERE reason IS NULL)
SELECT event_id, t // 1000 AS timestamp, symbol, {r('price', 2)} AS price, {r('volume')} AS volume,
       {r('CASE WHEN previous IS NULL OR previous <= 0 THEN 0.0 WHEN price > 0 THEN ln(price / nullif(previous, 0)) END')} AS log_return,
       FALSE AS is_anomaly, NULL::VARCHAR AS anomaly_type, t // 1000 AS event_time FROM good"""
    sql["stream_normalized_trades"] = sql["normalized_trades"]
    sql["trade_quarantine"] = f"""WITH {_TRADE_MESSAGES}
SELECT reason AS reject_reason, count(*) AS n FROM msg WHERE reason <> 'other' GROUP BY reason"""
    sql["forward_symbol_map"] = """WITH s AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'BTC-USDT' WHEN 'error' THEN 'ETH-USDT'
         WHEN 'view' THEN 'BNB-USDT' ELSE upper(event_type) || '-EUR' END AS symbol FROM events),
m AS (SELECT *, lower(replace(symbol, '-', '')) AS stream FROM s)
SELECT event_id, symbol, stream,
       CASE WHEN symbol LIKE '%-USDT' THEN symbol ELSE upper(stream) END AS back FROM m"""
    sql["validate_features"] = f"""{_DOUBTFUL}
SELECT symbol, {_epoch('window_start')}, {_reasons()} = '' AS valid, {_reasons()} AS reasons FROM doubt"""
    sql["clean_features"] = f"""{_DOUBTFUL.replace("CASE WHEN z_score_price > 2 THEN 'inf'::DOUBLE ELSE z_score_log_return END", "0.5")}
SELECT symbol, {_epoch('window_start')}, {_rounded(FEATURES)} FROM doubt
WHERE NOT isnan(z_score_volume) AND rolling_volume_std IS NOT NULL"""
    sql["clean_report"] = f"""{_DOUBTFUL},
k AS (SELECT count(*) AS n_rows, count(*) FILTER (NOT isnan(z_score_volume) AND rolling_volume_std IS NOT NULL) AS n_kept
      FROM doubt)
SELECT n_rows, n_kept, n_rows - n_kept AS n_dropped, {r('(n_rows - n_kept) * 100.0 / n_rows')} AS dropped_pct FROM k"""
    sql["label_mode"] = f"""{_F6}
SELECT count(*) AS n_rows, CAST(sum(is_anomaly) AS BIGINT) AS n_anomalies, {r('avg(is_anomaly)')} AS anomaly_ratio,
       CASE WHEN sum(is_anomaly) > 0 THEN 'labelled' ELSE 'unsupervised' END AS mode FROM feat"""
    sql["stratified_split"] = f"""WITH {_features('1 hour')},
ranked AS (
  SELECT symbol, window_start, is_anomaly, count(*) OVER (PARTITION BY is_anomaly) AS n,
         row_number() OVER (PARTITION BY is_anomaly ORDER BY
           md5('s' || symbol || chr(0) || 's' || epoch_us(window_start) || chr(0) || '42')) AS rn
  FROM feat)
SELECT symbol, {_epoch('window_start')}, is_anomaly, rn <= floor(n * 0.2 + 0.5) AS is_test FROM ranked"""
    sql["scaler_fit"] = f"""{_F6}, long AS ({_long('feat')})
SELECT feature, CAST(list_position({FEATURES!r}, feature) - 1 AS INTEGER) AS position, {r('avg(value)')} AS mean,
       {r('CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END')} AS scale FROM long GROUP BY feature"""
    sql["standardized"] = f"{_F6}, {_scaled()} SELECT symbol, {_epoch('window_start')}, {_rounded(FEATURES)} FROM scaled"
    sql["score_small_forest"] = f"{_small_forest()} SELECT {_SMALL_ROW} FROM scored"
    sql["model_roundtrip"] = sql["score_small_forest"]
    sql["stream_score"] = f"""{_small_forest()}
SELECT {_BATCH_SEQ} AS seq, symbol, {_rounded(FEATURES)},
       {r('anomaly_score')} AS anomaly_score, anomaly_score < 0 AS is_anomaly
FROM scored JOIN feat USING (symbol, window_start), {_ARRIVAL}"""
    sql["prediction_totals"] = f"{_PRED} SELECT {_TOTALS.format(n='total_predictions', a='total_anomalies')} FROM pred"
    sql["per_symbol_stats"] = f"{_PRED} SELECT symbol, {_TOTALS.format(n='count', a='anomalies')} FROM pred GROUP BY symbol"
    sql["per_symbol_long"] = f"""{_PRED}
SELECT symbol, 'Total' AS series, count(*) AS value FROM pred GROUP BY symbol
UNION ALL SELECT symbol, 'Anomalies', count(*) FILTER (is_anomaly) FROM pred GROUP BY symbol"""
    sql["score_percentiles"] = f"{_PRED} SELECT " + ", ".join(
        f"{r(f'quantile_cont(anomaly_score, 0.{p})')} AS p{p}" for p in (25, 50, 75, 95, 99)) + " FROM pred"
    sql["feature_stats"] = _feature_stats()
    sql["stats_view"] = f"""{_VIEW},
t AS (SELECT {_TOTALS.format(n='total_predictions', a='total_anomalies')}, {r('quantile_cont(anomaly_score, 0.5)')} AS p50,
             {r('quantile_cont(anomaly_score, 0.99)')} AS p99, {r('stddev_pop(z_score_price)')} AS z_score_price_std FROM view),
s AS (SELECT symbol, count(*) AS symbol_count, count(*) FILTER (is_anomaly) AS symbol_anomalies,
             {r('avg(anomaly_score)')} AS symbol_avg_score FROM view GROUP BY symbol)
SELECT * FROM t, s"""
    sql["feature_correlation"] = _correlation()
    sql["score_histogram"] = f"""{_PRED},
e AS (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM pred),
b AS (SELECT least(29, CAST(floor(coalesce((anomaly_score - lo) * 30 / nullif(hi - lo, 0), 0)) AS INTEGER)) AS bin,
             count(*) AS n FROM pred, e GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, {r('lo + (hi - lo) * i / 30')} AS bin_low, {r('lo + (hi - lo) * (i + 1) / 30')} AS bin_high,
       coalesce(n, 0) AS n FROM range(30) AS g(i) LEFT JOIN b ON b.bin = i, e"""
    sql["feature_box_stats"] = _box()
    sql["class_breakdown"] = f"""{_PRED}
SELECT 'Normal' AS class, count(*) FILTER (NOT is_anomaly) AS n FROM pred
UNION ALL SELECT 'Anomaly', count(*) FILTER (is_anomaly) FROM pred"""
    sql["score_timeline"] = f"""{_PRED}
SELECT {_POSITION}, {r('anomaly_score')} AS anomaly_score,
       CASE WHEN is_anomaly THEN {r('anomaly_score')} END AS anomaly_marker FROM pred"""
    sql["score_moving_avg"] = f"""{_PRED}
SELECT {_POSITION}, {r('anomaly_score')} AS anomaly_score,
       {r('avg(anomaly_score) OVER (ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} AS moving_avg FROM pred"""
    sql["score_heatmap"] = f"""{_PRED},
n AS (SELECT symbol, anomaly_score, (row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1) // 10 AS bin FROM pred)
SELECT symbol, CAST(bin AS BIGINT) AS bin, {r('avg(anomaly_score)')} AS avg_score FROM n GROUP BY symbol, bin"""
    sql["kpis"] = f"""{_VIEW}, last AS (SELECT * FROM view ORDER BY seq DESC LIMIT 100),
k AS (SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies,
             count(*) FILTER (is_anomaly) * 100.0 / count(*) AS rate, avg(anomaly_score) AS avg_score FROM last)
SELECT total, anomalies, {r('rate')} AS rate, {r('avg_score')} AS avg_score, format('{{:,}}', total) AS total_text,
       format('{{:,}}', anomalies) AS anomalies_text, printf('%.1f%%', rate) AS rate_text,
       printf('%.4f', avg_score) AS avg_score_text FROM k"""
    sql["latest_predictions"] = f"{_VIEW} SELECT {_PRED_ROW} FROM view ORDER BY seq DESC LIMIT 100"
    sql["latest_of_symbol"] = f"{_VIEW} SELECT {_PRED_ROW} FROM view WHERE symbol = 'click' ORDER BY seq DESC LIMIT 50"
    sql["recent_alerts"] = f"""{_VIEW}
SELECT seq, printf('%s — score: %.4f | z_price: %.2f | z_log_ret: %.2f | z_vol: %.2f',
       symbol, anomaly_score, z_score_price, z_score_log_return, z_score_volume) AS alert
FROM view WHERE is_anomaly ORDER BY seq DESC LIMIT 5"""
    sql["anomalies_only"] = f"{_PRED} SELECT {_PRED_ROW} FROM pred WHERE is_anomaly"
    sql["rate_bands"] = f"""{_PRED},
p AS (SELECT symbol, {_TOTALS.format(n='count', a='anomalies')} FROM pred GROUP BY symbol)
SELECT symbol, anomaly_rate, CASE WHEN anomaly_rate < 5 THEN 'low' WHEN anomaly_rate < 15 THEN 'medium' ELSE 'high' END AS band,
       anomaly_rate > 10 AS alert FROM p"""
    cells = ", ".join(f"printf('%.4f', {c}) AS {c}" for c in [*FEATURES, "anomaly_score"])
    sql["display_table"] = f"""{_PRED}
SELECT CAST(seq AS VARCHAR) AS seq, symbol, {cells}, CASE WHEN is_anomaly THEN 'YES' ELSE 'no' END AS is_anomaly,
       model_version FROM pred"""
    sql["gauge_values"] = f"""{_PRED}
SELECT seq, {r('CASE WHEN is_anomaly THEN 100.0 ELSE greatest(0.0, least(100.0, abs(anomaly_score) * 20)) END')} AS gauge FROM pred"""
    sql["csv_export_roundtrip"] = f"{_PRED} SELECT {_PRED_ROW} FROM pred"
    sql["classification_report"] = _report()
    sql["confusion_matrix"] = f"""{_PRED}
SELECT CAST(l AS INTEGER) AS label, count(*) FILTER (label = l AND NOT is_anomaly) AS pred_0,
       count(*) FILTER (label = l AND is_anomaly) AS pred_1 FROM pred, (VALUES (0), (1)) AS v(l) GROUP BY l"""
    sql["score_distribution_stats"] = f"""{_PRED}
SELECT {r('avg(anomaly_score)')} AS mean_score, {r('stddev_pop(anomaly_score)')} AS std_score,
       {r('min(anomaly_score)')} AS min_score, {r('max(anomaly_score)')} AS max_score FROM pred"""
    sql["detected_share"] = f"""{_PRED}
SELECT count(*) AS n_rows, count(*) FILTER (is_anomaly) AS n_detected,
       {r('count(*) FILTER (is_anomaly) * 100.0 / count(*)')} AS detected_pct FROM pred"""
    sql["contamination_threshold"] = f"""{_PRED}
SELECT 0.01::DOUBLE AS prob, {r('quantile_cont(anomaly_score, 0.01)')} AS quantile FROM pred"""
    sql["forest_level_nodes"] = _level_nodes()
    for stored, view in (("latest_stored_predictions", "latest_predictions"), ("stored_alerts", "recent_alerts"),
                         ("latest_stored_of_symbol", "latest_of_symbol"), ("stored_kpis", "kpis"), ("stored_stats", "stats_view")):
        sql[stored] = sql[view]
    sql["preset_scores_small"] = _presets()
    long = f"long AS ({_long('feat')})"
    sql["model_facts"] = f"""{_F6}, {long}
SELECT TRUE AS loaded, 'IsolationForest' AS model_type, 3::INT AS n_estimators, 0.01::DOUBLE AS contamination,
       'auto' AS max_samples, feature, {r('avg(value)')} AS mean,
       {r('CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END')} AS std FROM long GROUP BY feature"""
    sql["evaluate_saved_model"] = _saved_report()
    sql["unsupervised_summary"] = f"""{_small_forest()}
SELECT count(*) AS n_rows, count(*) FILTER (anomaly_score < 0) AS n_detected,
       {r('count(*) FILTER (anomaly_score < 0) * 100.0 / count(*)')} AS detected_pct,
       {r('avg(anomaly_score)')} AS mean_score, {r('stddev_pop(anomaly_score)')} AS std_score,
       {r('min(anomaly_score)')} AS min_score, {r('max(anomaly_score)')} AS max_score FROM scored"""
    sql["train_on_compat_store"] = f"""WITH {_features('1 hour')}, {_ARRIVED},
n AS (SELECT is_anomaly, count(*) AS n_rows, count(*) FILTER (arrival < 2) AS n_before FROM arrived GROUP BY is_anomaly),
t AS (SELECT *, floor(n_rows * 0.2 + 0.5)::BIGINT AS n_test, floor(n_before * 0.2 + 0.5)::BIGINT AS n_test_before FROM n)
SELECT is_anomaly, n_rows, n_test, n_before, n_test_before, 0::BIGINT AS n_moved,
       sum(n_rows - n_test) OVER ()::BIGINT AS n_train, least(256, sum(n_rows - n_test) OVER ())::INT AS psi FROM t"""
    sql["compacted_store"] = f"""{_F6},
edge AS (SELECT time_bucket(INTERVAL '1 day', quantile_disc(window_start, 0.3), TIMESTAMP '1970-01-01') AS since,
                time_bucket(INTERVAL '1 day', quantile_disc(window_start, 0.6), TIMESTAMP '1970-01-01') AS until FROM feat)
SELECT {_FEATURE_ROW} FROM feat
UNION ALL SELECT {_FEATURE_ROW} FROM feat, edge WHERE window_start >= since AND window_start < until"""
    sql["stream_late_rows"] = f"""WITH {_EVENT_TICKS},
t AS (SELECT *, epoch(ts)::BIGINT AS s FROM (SELECT event_id, symbol, date_trunc('second', ts) AS ts FROM ev)),
e AS (SELECT min(s) AS lo, max(s) AS hi FROM t),
p AS (SELECT *, floor((s - lo) * 3 / (hi - lo + 1))::INT AS part FROM t, e),
a AS (SELECT *, CASE WHEN event_id % 29 = 3 THEN greatest(part, 2) ELSE part END AS arrival, s // 21600 AS w FROM p),
m AS (SELECT arrival, count(*) AS n_rows, max(s) AS top FROM a GROUP BY arrival),
k AS (SELECT *, max(top) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 60 AS mark FROM m),
late AS (SELECT arrival, count(DISTINCT (symbol, w)) AS late_windows FROM a JOIN k USING (arrival)
         WHERE (w + 1) * 21600 <= mark GROUP BY arrival)
SELECT arrival, n_rows, 0::BIGINT AS n_without_time, coalesce(late_windows, 0) AS late_windows FROM k LEFT JOIN late USING (arrival)"""
    sql["score_requests"] = _requests()
    sql["stream_chain_stats"] = f"""{_small_forest()},
pred AS (SELECT symbol, anomaly_score, anomaly_score < 0 AS is_anomaly FROM scored
         WHERE window_end <= (SELECT to_timestamp(floor(epoch(max(ts))))::TIMESTAMP FROM ev) - INTERVAL '1 minute')
SELECT symbol, {_TOTALS.format(n='count', a='anomalies')} FROM pred GROUP BY symbol"""
    for how in ("persistent", "fading", "transient"):
        sql[f"inject_anomalies_{how}"] = _inject(how)
    return sql
