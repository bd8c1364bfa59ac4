"""Session, history, recursive and cross-symbol features, and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.operators import cross, features, labels
from barspark.operators.recursive import recursive_features
from barspark.plans.bar_queries import rounded
from barspark.plans.sqlbars import DAILY, HOURLY, MINUTE, bars, r6, ratio0
from barspark.sources.bars import daily_bars, event_bars

KEYS = ["symbol", "timestamp"]
TP, SL, H = 0.5, 0.95, 5


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return event_bars(spark, d)


def _of(df: DataFrame, *names: str, exact: bool = False) -> DataFrame:
    out = df.select(*KEYS, *names)
    return out if exact else rounded(out, *names)


def _sql(columns: dict[str, str], view: str = HOURLY, extra: str = "", exact: bool = False, where: str = "") -> str:
    return f"{bars(view, extra)} SELECT symbol, timestamp, {', '.join(f'{v if exact else r6(v)} AS {k}' for k, v in columns.items())} FROM x {where}"


LAGS, WINDOW, PERIODS = (1, 2, 5, 10), 5, (9, 20, 50)
QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, make, sql: str | None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE[name] = sql


register("bars_until_close", lambda s, d: _of(features.bars_until_close(hourly(s, d)), "bars_until_close", exact=True), _sql({"bars_until_close": "n - 1 - i"}, exact=True))
register("bars_since_open", lambda s, d: _of(features.bars_since_open(hourly(s, d)), "bars_since_open", exact=True), _sql({"bars_since_open": "i"}, exact=True))
register(
    "pct_change_batch", lambda s, d: _of(features.pct_change(hourly(s, d), LAGS), *[f"pct_change_{b}" for b in LAGS]),
    _sql({f"pct_change_{b}": f"CASE WHEN c{b} <> 0 THEN (close - c{b}) / c{b} ELSE 0.0 END" for b in LAGS}, extra=", ".join(f"lag(close, {b}) OVER w AS c{b}" for b in LAGS)),
)
_ROLL = "(PARTITION BY symbol, d ORDER BY timestamp ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_HIST = "(PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _z(c: str, n: int = WINDOW) -> tuple[str, str]:
    o = _ROLL.format(n - 1)
    return f"count(*) OVER {o} AS k_{c}, avg({c}) OVER {o} AS m_{c}, stddev_pop({c}) OVER {o} AS s_{c}", f"CASE WHEN k_{c} = {n} AND s_{c} > 1e-9 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END"


register("volume_zscore", lambda s, d: _of(features.rolling_zscore(daily_bars(s, d).withColumn("timestamp", F.col("timestamp")).withColumn("trade_date", F.trunc("timestamp", "month")), ["volume"], WINDOW), f"volume_zscore_{WINDOW}"), _sql({f"volume_zscore_{WINDOW}": _z("volume")[1]}, f"SELECT * FROM ({DAILY})", _z("volume")[0]).replace("CAST(timestamp AS DATE) AS d", "date_trunc('month', timestamp) AS d"))
register("trade_count_zscore", lambda s, d: _of(features.rolling_zscore(hourly(s, d), ["volume", "trade_count"], WINDOW), f"volume_zscore_{WINDOW}", f"trade_count_zscore_{WINDOW}"), _sql({f"volume_zscore_{WINDOW}": _z("volume")[1], f"trade_count_zscore_{WINDOW}": _z("trade_count")[1]}, extra=_z("volume")[0] + ", " + _z("trade_count")[0]))
register(
    "volume_roll_mean", lambda s, d: _of(features.volume_roll_mean(hourly(s, d), [2, 10]), "volume_roll_mean_2", "volume_roll_mean_10"),
    _sql({f"volume_roll_mean_{n}": f"CASE WHEN k{n} = {n} THEN m{n} ELSE 0.0 END" for n in (2, 10)}, extra=", ".join(f"count(*) OVER {_ROLL.format(n - 1)} AS k{n}, avg(volume) OVER {_ROLL.format(n - 1)} AS m{n}" for n in (2, 10))),
)
_TP_, _o = "((high + low + close) / 3)", _ROLL.format(WINDOW - 1)
register(
    "session_vwap_pct_diff", lambda s, d: _of(features.rolling_vwap(hourly(s, d), WINDOW), f"typical_vwap_{WINDOW}_pct_diff"),
    _sql({f"typical_vwap_{WINDOW}_pct_diff": ratio0(_TP_, "vw")}, extra=f"sum({_TP_} * volume) OVER {_o} / nullif(sum(volume) OVER {_o}, 0) AS vw"),
)
register(
    "close_sma_pct_diff", lambda s, d: _of(features.close_sma(hourly(s, d), PERIODS), *[f"close_sma_{p}_pct_diff" for p in PERIODS]),
    _sql({f"close_sma_{p}_pct_diff": ratio0("close", f"CASE WHEN k{p} = {p} THEN a{p} END") for p in PERIODS}, extra=", ".join(f"count(*) OVER {_HIST.format(p - 1)} AS k{p}, avg(close) OVER {_HIST.format(p - 1)} AS a{p}" for p in PERIODS)),
)
_B = _HIST.format(19)
register(
    "bollinger_pct_diff", lambda s, d: _of(features.bollinger(hourly(s, d), 20, 1.5), "close_bb_upper_20_1p5std_pct_diff", "close_bb_lower_20_1p5std_pct_diff"),
    _sql({f"close_bb_{x}_20_1p5std_pct_diff": ratio0("close", f"(CASE WHEN kb = 20 THEN ab {g} 1.5 * sb END)") for x, g in (("upper", "+"), ("lower", "-"))}, extra=f"count(*) OVER {_B} AS kb, avg(close) OVER {_B} AS ab, stddev_pop(close) OVER {_B} AS sb"),
)
register("close_bar_vwap_pct_diff", lambda s, d: _of(features.close_bar_vwap(hourly(s, d)), "close_vwap_pct_diff"), _sql({"close_vwap_pct_diff": "CASE WHEN vwap <> 0 THEN (close - vwap) / vwap ELSE 0.0 END"}))
for _c in ("close", "volume"):
    register(
        f"{_c}_lag_pct_diff", lambda s, d, c=_c: _of(features.lag_pct_diff(hourly(s, d), c, LAGS), *[f"{c}_lag_{n}_pct_diff" for n in LAGS]),
        _sql({f"{_c}_lag_{n}_pct_diff": ratio0(f"CAST({_c} AS DOUBLE)", f"l{n}") for n in LAGS}, extra=", ".join(f"CAST(lag({_c}, {n}) OVER h AS DOUBLE) AS l{n}" for n in LAGS)),
    )
for _a, _b in (("close", "high"), ("high", "close"), ("close", "low")):
    register(
        f"{_a}_minus_{_b}_lag", lambda s, d, a=_a, b=_b: _of(features.lagged_difference(hourly(s, d), a, b, (0, 1, 5)), *[f"{a}_minus_{b}_lag_{n}" for n in (0, 1, 5)]),
        _sql({f"{_a}_minus_{_b}_lag_{n}": f"l{n}" for n in (0, 1, 5)}, extra=", ".join(f"lag({_a} - {_b}, {n}, 0.0) OVER h AS l{n}" for n in (0, 1, 5))),
    )
register(
    "close_lag_vector", lambda s, d: _of(features.close_lag_vector(hourly(s, d), 24).withColumn("lag_sum", F.aggregate("close_lags", F.lit(0.0), lambda a, x: a + x)).withColumn("lag_24", F.get("close_lags", F.lit(23))), "lag_sum", "lag_24"),
    _sql({"lag_sum": " + ".join(["0.0", *[f"({ratio0('close', f'l{n}')})" for n in range(1, 25)]]), "lag_24": ratio0("close", "l24")}, extra=", ".join(f"lag(close, {n}) OVER h AS l{n}" for n in range(1, 25))),
)
register("day_of_week", lambda s, d: _of(features.day_of_week(hourly(s, d)), "day_of_week", exact=True), _sql({"day_of_week": "CAST(isodow(timestamp) AS INTEGER)"}, exact=True))
_TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
register("true_range", lambda s, d: _of(features.true_range(hourly(s, d)), "true_range"), _sql({"true_range": _TR}, extra="lag(close) OVER h AS pc"))
_PDM, _MDM = "CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END", "CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END"
register("directional_movement", lambda s, d: _of(features.directional_movement(hourly(s, d)), "plus_dm", "minus_dm"), _sql({"plus_dm": _PDM, "minus_dm": _MDM}, extra="lag(high) OVER h AS ph, lag(low) OVER h AS pl"))
_DAY = "SELECT symbol, CAST(timestamp AS DATE) AS trade_date, last(close ORDER BY timestamp) AS close FROM ({}) GROUP BY 1, 2".format(HOURLY)
register("last_close_per_day", lambda s, d: features.last_close_per_day(hourly(s, d)), _DAY)
register(
    "daily_return", lambda s, d: rounded(features.daily_return(hourly(s, d)).select("symbol", "trade_date", "daily_return"), "daily_return"),
    f"SELECT symbol, trade_date, {r6('close / p - 1')} AS daily_return FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS p FROM ({_DAY})) WHERE p <> 0",
)
register("session_forward_return", lambda s, d: _of(features.session_forward_return(hourly(s, d), 3), "forward_return"), _sql({"forward_return": "CASE WHEN close > 0 THEN l / close - 1 END"}, extra="lead(close, 3) OVER w AS l"))


def training_table(s: SparkSession, d: str) -> DataFrame:
    """Label, features over three scopes, then the bounds of the session: one exchange on the symbol."""
    df = labels.absolute_move(hourly(s, d), 0.5, H)
    df = features.close_sma(features.lag_pct_diff(features.pct_change(features.bars_until_close(features.bars_since_open(df)), (1, 2)), "close", (1,)), (9,))
    return df.where("bars_since_open >= 2 AND bars_until_close >= 3").select(*KEYS, "move_target", "pct_change_1", "pct_change_2", "close_lag_1_pct_diff", "close_sma_9_pct_diff")


_TRAIN = ("pct_change_1", "pct_change_2", "close_lag_1_pct_diff", "close_sma_9_pct_diff")
_MAXMIN = f"max(high) OVER (PARTITION BY symbol, d ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING) AS mx, min(low) OVER (PARTITION BY symbol, d ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING) AS mn"
_MOVE = "CASE WHEN close > 0 AND greatest(mx / close - 1, 1 - mn / close) >= 0.5 THEN 1 ELSE 0 END"
_TRAIN_SQL = f"{bars(HOURLY, _MAXMIN + ', lag(close, 1) OVER w AS c1, lag(close, 2) OVER w AS c2, lag(close, 1) OVER h AS l1, count(*) OVER ' + _HIST.format(8) + ' AS k, avg(close) OVER ' + _HIST.format(8) + ' AS a')} SELECT symbol, timestamp, {_MOVE} AS move_target, CASE WHEN c1 <> 0 THEN (close - c1) / c1 ELSE 0.0 END AS pct_change_1, CASE WHEN c2 <> 0 THEN (close - c2) / c2 ELSE 0.0 END AS pct_change_2, {ratio0('close', 'l1')} AS close_lag_1_pct_diff, {ratio0('close', 'CASE WHEN k = 9 THEN a END')} AS close_sma_9_pct_diff FROM x WHERE i >= 2 AND n - 1 - i >= 3"
register("training_table", lambda s, d: rounded(training_table(s, d), *_TRAIN), f"SELECT symbol, timestamp, move_target, {', '.join(f'{r6(c)} AS {c}' for c in _TRAIN)} FROM ({_TRAIN_SQL})")

# --- recursive features: one recursive step per bar -------------------------------------------------------------
_SEQ = f"b AS ({HOURLY}), q AS (SELECT *, row_number() OVER h AS k, lag(close) OVER h AS pc, lag(high) OVER h AS ph, lag(low) OVER h AS pl FROM b WINDOW h AS (PARTITION BY symbol ORDER BY timestamp)), v AS (SELECT *, {_TR} AS tr, {_PDM} AS pdm, {_MDM} AS mdm, greatest(coalesce(close - pc, 0), 0) AS g, greatest(coalesce(pc - close, 0), 0) AS s FROM q)"


def _wilder(name: str, source: str, cols: tuple[str, ...], p: int, first: int) -> str:
    """A CTE with the Wilder averages of ``cols``, from row ``first`` (1-based), whose value is the mean of p rows."""
    seed = ", ".join(f"(SELECT avg({c}) FROM {source} y WHERE y.symbol = z.symbol AND y.k BETWEEN {first - p + 1} AND {first}) AS w_{c}" for c in cols)
    step = ", ".join(f"(r.w_{c} * {p - 1} + z.{c}) / {p}" for c in cols)
    return f"{name} AS (SELECT z.symbol, z.k, {seed} FROM {source} z WHERE z.k = {first} UNION ALL SELECT z.symbol, z.k, {step} FROM {name} r JOIN {source} z ON z.symbol = r.symbol AND z.k = r.k + 1)"


def _rsi(p: int, flat: float) -> str:
    return f"CASE WHEN w_g IS NULL THEN 0.0 WHEN w_s > 0 THEN 100 - 100 / (1 + w_g / w_s) WHEN w_g > 0 THEN 100.0 ELSE {flat} END"


register(
    "atr", lambda s, d: _of(recursive_features(hourly(s, d), atr=[14]), "atr_14"),
    f"WITH RECURSIVE {_SEQ}, {_wilder('r', 'v', ('tr',), 14, 14)} SELECT v.symbol, timestamp, {r6('coalesce(w_tr, 0.0)')} AS atr_14 FROM v LEFT JOIN r ON r.symbol = v.symbol AND r.k = v.k",
)
_DI = "CASE WHEN w_tr > 0 THEN 100 * w_{0} / w_tr ELSE 0.0 END"
register(
    "adx_di", lambda s, d: _of(recursive_features(hourly(s, d), adx=[7]), "plus_di_7", "minus_di_7", "adx_7"),
    f"WITH RECURSIVE {_SEQ}, {_wilder('r', 'v', ('tr', 'pdm', 'mdm'), 7, 7)}, di AS (SELECT v.symbol, v.timestamp, v.k, coalesce({_DI.format('pdm')}, 0.0) AS a, coalesce({_DI.format('mdm')}, 0.0) AS z FROM v LEFT JOIN r ON r.symbol = v.symbol AND r.k = v.k), "
    f"dx AS (SELECT *, CASE WHEN a + z > 0 THEN 100 * abs(a - z) / (a + z) ELSE 0.0 END AS dx FROM di), {_wilder('ax', 'dx', ('dx',), 7, 7)} SELECT dx.symbol, timestamp, {r6('a')} AS plus_di_7, {r6('z')} AS minus_di_7, {r6('coalesce(w_dx, 0.0)')} AS adx_7 FROM dx LEFT JOIN ax ON ax.symbol = dx.symbol AND ax.k = dx.k",
)
for _name, _p, _flat in (("rsi", 14, 50.0), ("rsi_flat100", 7, 100.0)):
    register(
        _name, lambda s, d, p=_p, f=_flat: _of(recursive_features(hourly(s, d), rsi=[p], flat=f), f"rsi_{p}"),
        f"WITH RECURSIVE {_SEQ}, {_wilder('r', 'v', ('g', 's'), _p, _p + 1)} SELECT v.symbol, timestamp, {r6(_rsi(_p, _flat))} AS rsi_{_p} FROM v LEFT JOIN r ON r.symbol = v.symbol AND r.k = v.k",
    )
register(
    "ema_pct_diff", lambda s, d: _of(recursive_features(hourly(s, d), ema=[12]), "close_ema_12_pct_diff"),
    f"WITH RECURSIVE {_SEQ}, e AS (SELECT symbol, k, close AS e FROM v WHERE k = 1 UNION ALL SELECT v.symbol, v.k, e.e + 2.0 / 13 * (v.close - e.e) FROM e JOIN v ON v.symbol = e.symbol AND v.k = e.k + 1) SELECT v.symbol, timestamp, {r6(ratio0('close', 'CASE WHEN v.k >= 12 THEN e.e END'))} AS close_ema_12_pct_diff FROM v JOIN e ON e.symbol = v.symbol AND e.k = v.k",
)

# --- cross-symbol features ---------------------------------------------------------------------------------------
REFS = ("click", "purchase")


def _views(s: SparkSession, d: str) -> DataFrame:
    return hourly(s, d).where("symbol = 'view'")


_REF = f"WITH b AS ({HOURLY}), m AS (SELECT * FROM b WHERE symbol = 'view')"
register(
    "close_vs_reference", lambda s, d: _of(cross.close_vs_reference(_views(s, d), hourly(s, d), REFS), *[f"close_{r}_pct_diff" for r in REFS]),
    f"{_REF} SELECT m.symbol, m.timestamp, {', '.join(f'{r6(ratio0("m.close", f"{r}.close"))} AS close_{r}_pct_diff' for r in REFS)} FROM m {' '.join(f"LEFT JOIN b {r} ON {r}.symbol = '{r}' AND {r}.timestamp = m.timestamp" for r in REFS)}",
)
register(
    "rsi_reference", lambda s, d: _of(cross.reference_rsi(_views(s, d), hourly(s, d), REFS, 7), *[f"rsi_{r}_7" for r in REFS]),
    f"WITH RECURSIVE {_SEQ}, {_wilder('r', 'v', ('g', 's'), 7, 8)}, z AS (SELECT v.symbol, v.timestamp, {_rsi(7, 50.0)} AS rsi FROM v LEFT JOIN r ON r.symbol = v.symbol AND r.k = v.k) SELECT m.symbol, m.timestamp, {', '.join(f'{r6(f"coalesce({r}.rsi, 0.0)")} AS rsi_{r}_7' for r in REFS)} FROM b m {' '.join(f"LEFT JOIN z {r} ON {r}.symbol = '{r}' AND {r}.timestamp = m.timestamp" for r in REFS)} WHERE m.symbol = 'view'",
)
register("pair_inner_align", lambda s, d: cross.pair_align(hourly(s, d), "view", "click"), f"WITH b AS ({HOURLY}) SELECT x.timestamp, x.close AS close_a, y.close AS close_b FROM b x JOIN b y USING (timestamp) WHERE x.symbol = 'view' AND y.symbol = 'click'")

# --- labels ------------------------------------------------------------------------------------------------------
_X = bars(HOURLY, "lead(high) OVER w AS entry, lead(low) OVER w AS entry_low")


def _hits(h: str, entry: str, tp: str, sl: str) -> str:
    """CTE j: per bar the first bars from i + 2 on that reach the levels (range join), and the last bar looked at."""
    return f"{_X}, j AS (SELECT a.symbol, a.timestamp, a.i, a.n, a.{entry} AS e, min(CASE WHEN f.high >= a.{entry} * (1 + {tp}) THEN f.i END) AS up, min(CASE WHEN f.low <= a.{entry} * (1 - {sl}) THEN f.i END) AS dn, last(f.low ORDER BY f.i) AS lo, count(f.i) AS m FROM x a LEFT JOIN x f ON f.symbol = a.symbol AND f.d = a.d AND f.i BETWEEN a.i + 2 AND {h} GROUP BY ALL)"


_J = _hits(f"a.i + 1 + {H}", "entry", str(TP), str(SL))
_LABEL = f"{_J} SELECT symbol, timestamp, CASE WHEN i < n - 3 AND e > 0 AND up IS NOT NULL AND (dn IS NULL OR up < dn) THEN 1 ELSE 0 END AS target FROM j"


def label_tp_sl(s: SparkSession, d: str) -> DataFrame:
    return _of(labels.tp_before_sl(hourly(s, d), TP, SL, H), "target", exact=True)


register("label_tp_sl", label_tp_sl, _LABEL)
register("label_tp_sl_day", lambda s, d: _of(labels.tp_before_sl(hourly(s, d), TP, SL), "target", exact=True), _LABEL.replace(f"a.i + 1 + {H}", "a.n"))
register("label_touched", lambda s, d: _of(labels.touched(hourly(s, d), 2.0, 0.99, H), "range_target", exact=True), f"{_hits(f'a.i + 1 + {H}', 'entry', '2.0', '0.99')} SELECT symbol, timestamp, CASE WHEN i < n - 3 AND e > 0 AND (up IS NOT NULL OR dn IS NOT NULL) THEN 1 ELSE 0 END AS range_target FROM j")
register("label_abs_move", lambda s, d: _of(labels.absolute_move(hourly(s, d), 0.5, H), "move_target", exact=True), _sql({"move_target": _MOVE}, extra=_MAXMIN, exact=True))
register(
    "label_direction", lambda s, d: _of(labels.direction(hourly(s, d), 0.5, H), "move_eligible", "move_direction", exact=True),
    f"{bars(HOURLY)}, j AS (SELECT a.symbol, a.timestamp, a.close, min(CASE WHEN f.high / a.close - 1 >= 0.5 THEN f.i END) AS up, min(CASE WHEN 1 - f.low / a.close >= 0.5 THEN f.i END) AS dn, first(f.high ORDER BY CASE WHEN f.high / a.close - 1 >= 0.5 THEN 0 ELSE 1 END, f.i) AS hi, first(f.low ORDER BY CASE WHEN f.high / a.close - 1 >= 0.5 THEN 0 ELSE 1 END, f.i) AS lo FROM x a LEFT JOIN x f ON f.symbol = a.symbol AND f.d = a.d AND f.i BETWEEN a.i + 1 AND a.i + {H} GROUP BY ALL) "
    "SELECT symbol, timestamp, CASE WHEN close > 0 AND (up IS NOT NULL OR dn IS NOT NULL) THEN 1 ELSE 0 END AS move_eligible, CASE WHEN close > 0 AND (up IS NOT NULL OR dn IS NOT NULL) THEN CASE WHEN dn IS NULL OR up < dn THEN 1 WHEN up IS NULL OR dn < up THEN 0 WHEN hi / close - 1 >= 1 - lo / close THEN 1 ELSE 0 END END AS move_direction FROM j",
)
KIND = "CASE WHEN NOT (i < n - 3 AND coalesce(e, 0) > 0) OR m = 0 THEN -1 WHEN dn IS NOT NULL AND (up IS NULL OR dn <= up) THEN 1 WHEN up IS NOT NULL THEN 0 ELSE 2 END"


def trades_sql(entry: str = "entry") -> str:
    """(symbol, timestamp, exit_kind, gross_return) of every bar."""
    return f"{_hits(f'a.i + 1 + {H}', entry, str(TP), str(SL))}, y AS (SELECT *, {KIND} AS exit_kind FROM j) SELECT symbol, timestamp, exit_kind, CASE exit_kind WHEN 1 THEN e * (1 - {SL}) WHEN 0 THEN e * (1 + {TP}) WHEN 2 THEN lo END / e - 1 AS gross_return FROM y"


for _name, _entry, _col in (("gross_ret_next_high", "high", "entry"), ("gross_ret_next_low", "low", "entry_low")):
    register(
        _name, lambda s, d, e=_entry: rounded(_of(labels.gross_return(hourly(s, d), TP, SL, H, e), "exit_kind", "gross_return", exact=True), "gross_return"),
        f"SELECT symbol, timestamp, exit_kind, {r6('gross_return')} AS gross_return FROM ({trades_sql(_col)})",
    )
register("label_minute_h90", lambda s, d: labels.tp_before_sl(event_bars(s, d, "minute"), TP, SL, 90).groupBy("symbol").agg(F.sum("target").alias("hits"), F.count("*").alias("n")), f"SELECT symbol, CAST(sum(target) AS BIGINT) AS hits, count(*) AS n FROM ({_LABEL.replace(HOURLY, MINUTE).replace(f'a.i + 1 + {H}', 'a.i + 91')}) GROUP BY symbol")
