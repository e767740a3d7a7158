"""Queries on the driver's tables, each with the SQL that checks it.

Sessions are users, times are hours, the signal is an event's value, the second
channel its ``k``; ``signup`` is a strike, ``click`` and ``view`` are swing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideline.functions import columns as C
from strideline.operators import folds
from strideline.operators import segments as S
from strideline.operators.live import LiveLoop
from strideline.schema import SAMPLES_SQL, samples, table
from strideline.sources.csv_samples import derivative, telemetry_lines
from strideline.sources.sinks import Config
from strideline.sources.telemetry import key_value

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
W = "(PARTITION BY session ORDER BY t, seq)"


def query(sql: str | None = None, base: str = SAMPLES_SQL) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that must give the same rows; ``s`` is the sample table in it."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH RECURSIVE {base}{sql}" if sql.lstrip().startswith(",") else f"WITH {base} {sql}"
        return f
    return add


def r6(c, name: str):
    """A double rounded to 6 places, so that the order of a sum does not show."""
    return F.round(c.cast("double") if not isinstance(c, str) else F.col(c).cast("double"), 6).alias(name)


def win(lo: int | None = None, hi: int | None = None):
    """A session's samples in order, with a frame if one is given."""
    w = S.by_session()
    return w if hi is None else w.rowsBetween(Window.unboundedPreceding if lo is None else lo, hi)


# --- samples: projection and validity -------------------------------------------------

@query("SELECT session, seq, round(t, 6) AS t, coalesce(x, 0.0) AS x, coalesce(k, 0) AS k, swing FROM s")
def sample_projection(spark, d):
    return samples(spark, d).select("session", "seq", r6("t", "t"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("k", F.lit(0)).alias("k"), "swing")


@query(f"SELECT session, seq, round(coalesce(CASE WHEN t - lag(t) OVER w > 0 THEN (x - lag(x) OVER w) / (t - lag(t) OVER w) END, 0), 6) AS v FROM s WINDOW w AS {W}")
def derivative_fill(spark, d):
    return samples(spark, d).select("session", "seq", r6(derivative(F.col("x"), F.col("t"), win()), "v"))


@query(f"SELECT session, seq, round((row_number() OVER {W} - 1) / 100.0::DOUBLE, 6) AS t FROM s")
def synthetic_time(spark, d):
    return samples(spark, d).select("session", "seq", r6((F.row_number().over(win()) - 1) / 100.0, "t"))


@query("SELECT session, seq, round(sqrt(x * x + k * k + 1.0::DOUBLE), 6) AS magnitude FROM s")
def axis_magnitude(spark, d):
    return samples(spark, d).select("session", "seq", r6(C.magnitude(F.col("x"), F.col("k"), F.lit(1.0)), "magnitude"))


@query("SELECT session, seq, CASE WHEN abs(x) > 400 THEN 'belt_range' WHEN abs(x * 10) > 2000 THEN 'velocity_range' WHEN abs(x * 1e4::DOUBLE) > 1e6 THEN 'position_range' WHEN abs(k) > 10 THEN 'current_range' ELSE '' END AS reason FROM s")
def encoder_reason(spark, d):
    x = F.col("x")
    return samples(spark, d).select("session", "seq", C.encoder_reason(x, x * 10, x * 1e4, F.col("k").cast("double")).alias("reason"))


@query("SELECT session, seq, CASE WHEN greatest(abs(x / 10), abs(k)) > 16 THEN 'accel_range' WHEN abs(x * 20) > 2000 THEN 'gyro_range' ELSE '' END AS reason, isfinite(x) AS ok FROM s")
def sample_health(spark, d):
    x, k = F.col("x"), F.col("k").cast("double")
    return samples(spark, d).select("session", "seq", C.imu_reason([x / 10, k], [x * 20]).alias("reason"), C.finite(x).alias("ok"))


@query("SELECT session, kind, count(*) >= 2 AND max(abs(x - first_x)) <= 1e-9 AS frozen FROM (SELECT *, first_value(x) OVER (PARTITION BY session, kind ORDER BY t, seq) AS first_x FROM s) GROUP BY session, kind")
def frozen_signal(spark, d):
    first = F.first("x").over(S.by_session("kind"))
    return samples(spark, d).withColumn("first_x", first).groupBy("session", "kind").agg(((F.count("*") >= 2) & (F.max(F.abs(F.col("x") - F.col("first_x"))) <= 1e-9)).alias("frozen"))


_FAULTS = "CASE WHEN x > 300 THEN 1 ELSE 0 END AS belt, CASE WHEN abs(k) > 90 THEN 1 ELSE 0 END AS current, CASE WHEN t - lag(t) OVER w > 24 THEN 1 ELSE 0 END AS stale"


@query(f", f AS (SELECT session, seq, t, {_FAULTS} FROM s WINDOW w AS {W}) SELECT session, seq, concat_ws(',', CASE WHEN belt = 1 THEN 'BELT' END, CASE WHEN current = 1 THEN 'CURRENT' END, CASE WHEN stale = 1 THEN 'STALE' END) AS faults FROM f")
def fault_set(spark, d):
    stale = F.col("t") - F.lag("t").over(win()) > 24
    codes = [F.when(F.col("x") > 300, "BELT"), F.when(F.abs("k") > 90, "CURRENT"), F.when(stale, "STALE")]
    return samples(spark, d).select("session", "seq", F.concat_ws(",", *codes).alias("faults"))


@query(f", f AS (SELECT session, seq, t, {_FAULTS} FROM s WINDOW w AS {W}) SELECT session, seq, concat_ws(',', CASE WHEN max(belt) OVER r = 1 THEN 'BELT' END, CASE WHEN max(current) OVER r = 1 THEN 'CURRENT' END, CASE WHEN max(stale) OVER r = 1 THEN 'STALE' END) AS latched, belt + current + stale = 0 AS ok FROM f WINDOW r AS (PARTITION BY session ORDER BY t, seq ROWS UNBOUNDED PRECEDING)")
def fault_latch(spark, d):
    now = {"BELT": F.col("x") > 300, "CURRENT": F.abs("k") > 90, "STALE": F.coalesce(F.col("t") - F.lag("t").over(win()) > 24, F.lit(False))}
    rows = samples(spark, d).withColumns(now)
    upto = win(None, 0)
    return rows.select("session", "seq", F.concat_ws(",", *[F.when(F.max(c).over(upto), c) for c in now]).alias("latched"), (~(F.col("BELT") | F.col("CURRENT") | F.col("STALE"))).alias("ok"))


@query(f"SELECT session, count(*) FILTER (WHERE gap > 24) AS stale, round(max(gap), 6) AS longest FROM (SELECT session, t - lag(t) OVER {W} AS gap FROM s) GROUP BY session")
def stale_gap(spark, d):
    rows = samples(spark, d).select("session", (F.col("t") - F.lag("t").over(win())).alias("gap"))
    return rows.groupBy("session").agg(F.count_if(F.col("gap") > 24).alias("stale"), r6(F.max("gap"), "longest"))


# --- phases and events -----------------------------------------------------------------

@query(", p AS (SELECT session, seq, t, (t - min(t) OVER (PARTITION BY session)) / 24.0::DOUBLE AS turns FROM s), q AS (SELECT *, turns - floor(turns) AS u, floor(turns) AS cycle FROM p) SELECT session, seq, CASE WHEN u >= 0.15 AND u < 0.55 THEN 'SWING' ELSE 'STANCE' END AS phase, coalesce(cycle <> lag(cycle) OVER w, false) AS strike, round(u, 6) AS u FROM q WINDOW w AS (PARTITION BY session ORDER BY t, seq)")
def scheduled_phase(spark, d):
    turns = (F.col("t") - F.min("t").over(Window.partitionBy("session"))) / 24.0
    rows = samples(spark, d).withColumn("turns", turns).withColumn("cycle", F.floor("turns")).withColumn("u", F.col("turns") - F.col("cycle"))
    phase = F.when((F.col("u") >= 0.15) & (F.col("u") < 0.55), "SWING").otherwise("STANCE")
    return rows.select("session", "seq", phase.alias("phase"), F.coalesce(F.col("cycle") != F.lag("cycle").over(win()), F.lit(False)).alias("strike"), r6("u", "u"))


_NUMBERED = f", n AS (SELECT session, seq, t, x, row_number() OVER {W} AS i FROM s)"
_BELT = f"""{_NUMBERED}, f AS (
  SELECT session, seq, i, t, x AS b, 0.0::DOUBLE AS a, false AS swinging, NULL::DOUBLE AS last, NULL::VARCHAR AS event FROM n WHERE i = 1
  UNION ALL
  SELECT session, seq, i, t, b, a, CASE WHEN event = 'toe_off' THEN true WHEN event = 'heel_strike' THEN false ELSE swinging END, CASE WHEN event = 'heel_strike' THEN t ELSE last END, event FROM (
    SELECT *, CASE WHEN a < 5 THEN NULL WHEN NOT swinging AND x - b >= 0.3::DOUBLE * a THEN 'toe_off' WHEN swinging AND x - b <= -0.5::DOUBLE * a AND (last IS NULL OR t - last >= 6) THEN 'heel_strike' END AS event FROM (
      SELECT session, seq, i, t, x, b, a0 + alpha * (abs(x - b) - a0) AS a, swinging, last FROM (
        SELECT session, seq, i, t, x, alpha, b0 + alpha * (x - b0) AS b, a0, swinging, last FROM (
          SELECT n.session, n.seq, n.i, n.t, n.x, 1 - exp(-greatest(n.t - f.t, 0) / 24.0::DOUBLE) AS alpha, f.b AS b0, f.a AS a0, f.swinging, f.last FROM f JOIN n ON n.session = f.session AND n.i = f.i + 1))))
)"""


@query(_BELT + " SELECT session, seq, event, round(b, 6) AS baseline, round(a, 6) AS amplitude FROM f")
def belt_length_events(spark, d):
    return folds.run_machine(samples(spark, d), folds.BeltTrigger()).select("session", "seq", "event", r6("baseline", "baseline"), r6("amplitude", "amplitude"))


@query(_BELT + ", g AS (SELECT *, max(CASE WHEN event = 'heel_strike' THEN t END) OVER w AS hs FROM f WINDOW w AS (PARTITION BY session ORDER BY i ROWS UNBOUNDED PRECEDING)), h AS (SELECT session, t, t - lag(t) OVER (PARTITION BY session ORDER BY t) AS period FROM f WHERE event = 'heel_strike') SELECT g.session, g.seq, CASE WHEN h.period IS NULL THEN NULL WHEN least((g.t - g.hs) / h.period, 1) >= 0.15 AND least((g.t - g.hs) / h.period, 1) < 0.55 THEN 'SWING' ELSE 'STANCE' END AS phase, CASE WHEN h.period IS NOT NULL THEN round(least((g.t - g.hs) / h.period, 1), 6) END AS u FROM g LEFT JOIN h ON g.session = h.session AND g.hs = h.t")
def belt_cycle_phase(spark, d):
    rows = folds.run_machine(samples(spark, d), folds.BeltTrigger())
    strike = F.when(F.col("event") == "heel_strike", F.col("t"))
    upto = win(None, 0)
    rows = rows.withColumn("hs", F.last(strike, ignorenulls=True).over(upto)).withColumn("own", strike)
    rows = rows.withColumn("before", F.last("own", ignorenulls=True).over(win(None, -1)))
    period = F.last(F.col("own") - F.col("before"), ignorenulls=True).over(upto)
    share = (F.col("t") - F.col("hs")) / period
    u = F.when(share.isNotNull(), F.least(share, F.lit(1.0)))
    return rows.withColumn("u", u).select("session", "seq", F.when(F.col("u").isNotNull(), F.when((F.col("u") >= 0.15) & (F.col("u") < 0.55), "SWING").otherwise("STANCE")).alias("phase"), r6("u", "u"))


def _level_sql(high: float, low: float, wait: float, defer: bool) -> str:
    drop = "event IS NOT NULL" if defer else "x <= {0}".format(low)
    return f"""{_NUMBERED}, f AS (
  SELECT session, seq, i, t, x >= {high} AS armed, NULL::DOUBLE AS last, CASE WHEN x >= {high} THEN 'toe_off' END AS event FROM n WHERE i = 1
  UNION ALL
  SELECT session, seq, i, t, CASE WHEN NOT armed THEN x >= {high} ELSE NOT ({drop}) END, CASE WHEN event = 'heel_strike' THEN t ELSE last END, event FROM (
    SELECT n.session, n.seq, n.i, n.t, n.x, f.armed, f.last, CASE WHEN NOT f.armed AND n.x >= {high} THEN 'toe_off' WHEN f.armed AND n.x <= {low} AND (f.last IS NULL OR n.t - f.last >= {wait}) THEN 'heel_strike' END AS event
    FROM f JOIN n ON n.session = f.session AND n.i = f.i + 1)
) SELECT session, seq, event FROM f"""


@query(_level_sql(120, 40, 12, True))
def belt_velocity_events(spark, d):
    return folds.run_machine(samples(spark, d), folds.LevelTrigger(120, 40, 12)).select("session", "seq", "event")


@query(_level_sql(120, 40, 48, False))
def script_strikes(spark, d):
    return folds.run_machine(samples(spark, d), folds.LevelTrigger(120, 40, 48, defer=False)).select("session", "seq", "event")


@query(", h AS (SELECT session, t - lag(t) OVER (PARTITION BY session ORDER BY t, seq) AS gap FROM s WHERE strike) SELECT session, count(gap) AS intervals, round(median(gap), 6) AS median_gap, round(avg(gap), 6) AS mean_gap FROM h GROUP BY session")
def interval_model(spark, d):
    gaps = samples(spark, d).where("strike").withColumn("gap", F.col("t") - F.lag("t").over(win()))
    return gaps.groupBy("session").agg(F.count("gap").alias("intervals"), r6(F.percentile("gap", 0.5), "median_gap"), r6(F.avg("gap"), "mean_gap"))


@query("SELECT session, seq, round(CASE WHEN k <= 0 THEN 0.3 ELSE greatest(least(0.3::DOUBLE * 2 * k / 1.2::DOUBLE, 20), 0.1) END, 6)::DOUBLE AS width FROM s")
def pulse_width(spark, d):
    return samples(spark, d).select("session", "seq", r6(C.pulse_width(F.col("k"), 0.3, 0.1, 20.0), "width"))


# --- strides ---------------------------------------------------------------------------

_CUT = f""", n AS (SELECT *, sum(strike::INT) OVER {W} AS n, sum(strike::INT) OVER (PARTITION BY session) AS total FROM s),
c AS (SELECT session, seq, t, x, k, swing, (n - 1)::BIGINT AS stride_id, total, false AS closing FROM n UNION ALL SELECT session, seq, t, x, k, swing, (n - 2)::BIGINT, total, true FROM n WHERE strike),
cut AS (SELECT * FROM c WHERE stride_id >= 0 AND stride_id < total - 1)"""
_METRICS = _CUT + """, st AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY session, stride_id ORDER BY t, seq) - t, 0) AS step FROM cut),
m0 AS (SELECT session, stride_id, count(*) AS n_samples, min(t) AS t_start, max(t) AS t_end, sum(CASE WHEN swing THEN step ELSE 0 END) AS swing_time, sum(CASE WHEN swing THEN 0 ELSE step END) AS stance_time,
  max(x) - min(x) AS excursion, avg(x) AS mean_x, max(abs(k)) AS peak_k, stddev_pop(x) AS rms_x, count(*) FILTER (WHERE swing) AS n_swing, count(*) FILTER (WHERE NOT swing) AS n_stance, count(*) FILTER (WHERE x IS NULL OR NOT isfinite(x)) AS n_bad FROM st GROUP BY session, stride_id),
m AS (SELECT *, t_end - t_start AS stride_time, CASE WHEN swing_time + stance_time > 0 THEN swing_time / (swing_time + stance_time) ELSE 0 END AS swing_ratio, CASE WHEN stance_time > 0 THEN swing_time / stance_time ELSE 0 END AS swing_stance_ratio,
  CASE WHEN n_samples < 3 THEN 'too_few_samples' WHEN t_end - t_start < 0.5 THEN 'too_short' WHEN t_end - t_start > 150 THEN 'too_long' WHEN n_bad > 0 THEN 'non_finite' WHEN n_swing = 0 THEN 'no_swing' WHEN n_stance = 0 THEN 'no_stance' ELSE '' END AS reject_reason FROM m0)"""


def strides(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of all strides."""
    return S.metrics(S.cut(samples(spark, d)))


@query(_CUT + " SELECT session, stride_id, seq, closing FROM cut")
def stride_segments(spark, d):
    return S.cut(samples(spark, d)).select("session", "stride_id", "seq", "closing")


@query(_METRICS + " SELECT session, stride_id, reject_reason FROM m WHERE reject_reason <> ''")
def stride_rejections(spark, d):
    return strides(spark, d).where("not valid").select("session", "stride_id", "reject_reason")


_METRIC_COLUMNS = ["stride_time", "swing_time", "stance_time", "swing_ratio", "swing_stance_ratio", "excursion", "mean_x", "rms_x"]


@query(_METRICS + f" SELECT session, stride_id, n_samples, peak_k, reject_reason = '' AS valid, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in _METRIC_COLUMNS)} FROM m")
def stride_metrics(spark, d):
    return strides(spark, d).select("session", "stride_id", "n_samples", "peak_k", "valid", *[r6(c, c) for c in _METRIC_COLUMNS])


@query(_METRICS + " SELECT session, count(*) AS strides, count(*) FILTER (WHERE reject_reason = '') AS valid_strides, round(avg(stride_time) FILTER (WHERE reject_reason = ''), 6) AS mean_stride_time, round(avg(swing_ratio) FILTER (WHERE reject_reason = ''), 6) AS mean_swing_ratio, round(max(excursion) FILTER (WHERE reject_reason = ''), 6) AS max_excursion FROM m GROUP BY session")
def stride_summary(spark, d):
    return S.session_summary(strides(spark, d)).select("session", "strides", "valid_strides", *[r6(c, c) for c in ("mean_stride_time", "mean_swing_ratio", "max_excursion")])


_USABLE = "least(a.swing_time, a.stance_time, b.swing_time, b.stance_time) > 0 AND b.session IS NOT NULL"
_RATIOS = {"swing_symmetry": "a.swing_time / b.swing_time", "stance_symmetry": "a.stance_time / b.stance_time", "own_ratio": "a.swing_time / a.stance_time", "other_ratio": "b.swing_time / b.stance_time", "ratio_symmetry": "(a.swing_time / a.stance_time) / (b.swing_time / b.stance_time)"}


@query(_METRICS + f", v AS (SELECT *, stride_id // 2 AS pair FROM m) SELECT a.session, a.pair, {', '.join(f'CASE WHEN {_USABLE} THEN round({v}, 6) END AS {k}' for k, v in _RATIOS.items())} FROM v a LEFT JOIN v b ON a.session = b.session AND a.pair = b.pair AND b.stride_id % 2 = 1 WHERE a.stride_id % 2 = 0")
def symmetry(spark, d):
    return symmetry_of(strides(spark, d))


def symmetry_of(rows: DataFrame) -> DataFrame:
    """Ratios of each even stride of ``rows`` and the next one."""
    rows = rows.withColumn("pair", F.floor(F.col("stride_id") / 2))
    out = S.symmetry(rows.where("stride_id % 2 = 0"), rows.where("stride_id % 2 = 1"))
    return out.select("session", "pair", *[r6(c, c) for c in _RATIOS])


def unpivoted(spark: SparkSession, d: str) -> DataFrame:
    """(session, stride_id, metric, value) of the valid strides."""
    return unpivoted_of(strides(spark, d))


def unpivoted_of(rows: DataFrame) -> DataFrame:
    """``unpivoted`` of given strides."""
    rows = rows.where("valid").select("session", "stride_id", *_METRIC_COLUMNS)
    return rows.unpivot(["session", "stride_id"], _METRIC_COLUMNS, "metric", "value").where(C.finite(F.col("value")))


_UNPIVOT = _METRICS + ", u AS (" + " UNION ALL ".join(f"SELECT session, stride_id, '{c}' AS metric, {c}::DOUBLE AS value FROM m WHERE reject_reason = ''" for c in _METRIC_COLUMNS) + ")"


@query(_UNPIVOT + " SELECT session, stride_id, metric, round(value, 6) AS value FROM u")
def metric_unpivot(spark, d):
    return unpivoted(spark, d).select("session", "stride_id", "metric", r6("value", "value"))


@query(_UNPIVOT + " SELECT session, metric, round(avg(value), 6) AS mean FROM u GROUP BY session, metric")
def metric_means(spark, d):
    return unpivoted(spark, d).groupBy("session", "metric").agg(r6(F.avg("value"), "mean"))


_RANGES = _UNPIVOT + ", rg AS (SELECT metric, quantile_cont(value, 0.05) AS lower, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS upper FROM u GROUP BY metric)"


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """(metric, lower, median, upper, scale): reference intervals over all valid strides; scale is null for an empty interval."""
    return ranges_of(strides(spark, d))


def ranges_of(rows: DataFrame) -> DataFrame:
    """``ranges`` of given strides."""
    shares = {"lower": 0.05, "median": 0.5, "upper": 0.95}
    counts = unpivoted_of(rows).groupBy("metric", "value").agg(F.count("value").alias("n"))
    by_value = Window.partitionBy("metric").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("upto", F.sum("n").over(by_value)).withColumn("all", F.sum("n").over(Window.partitionBy("metric")))
    place = {c: (F.col("all") - 1) * F.lit(share) for c, share in shares.items()}
    # the values on both sides of a quantile: strides lie at an interval's end, where the last bit of their mean decides
    sides = [F.min(F.when(F.col("upto") > F.least(F.floor(p) + i, F.col("all") - 1), F.col("value"))).alias(f"{c}_{i}") for c, p in place.items() for i in (0, 1)]
    out = counts.groupBy("metric").agg(F.first("all").alias("all"), *sides)
    out = out.select("metric", *[C.between(F.col(f"{c}_0"), F.col(f"{c}_1"), p - F.floor(p)).alias(c) for c, p in place.items()])
    return out.withColumn("scale", F.nullif((F.col("upper") - F.col("lower")) / 2, F.lit(0.0)))


@query(_RANGES + " SELECT metric, round(lower, 6) AS lower, round(median, 6) AS median, round(upper, 6) AS upper, round(nullif((upper - lower) / 2, 0), 6) AS scale FROM rg")
def metric_ranges(spark, d):
    return ranges(spark, d).select("metric", *[r6(c, c) for c in ("lower", "median", "upper", "scale")])


@query(_CUT + ", a AS (SELECT session, stride_id, list(x ORDER BY t, seq) AS v FROM cut GROUP BY session, stride_id HAVING count(*) >= 2), p AS (SELECT session, stride_id, v, i, i * (len(v) - 1) / 9.0::DOUBLE AS place, least(floor(i * (len(v) - 1) / 9.0::DOUBLE)::BIGINT, len(v) - 2) AS low FROM a, (SELECT unnest(range(10)) AS i)) SELECT session, stride_id, i::INT AS point, round(v[low + 1] + (v[low + 2] - v[low + 1]) * (place - low), 6) AS value FROM p")
def resample_cycle(spark, d):
    rows = S.cut(samples(spark, d)).groupBy("session", "stride_id").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "x"))).alias("rows"))
    rows = rows.select("session", "stride_id", F.transform("rows", lambda r: r["x"]).alias("values")).where(F.size("values") >= 2)
    return rows.select("session", "stride_id", F.posexplode(C.resample(F.col("values"), 10)).alias("point", "value")).select("session", "stride_id", "point", r6("value", "value"))


# --- smoothing -------------------------------------------------------------------------

@query("SELECT session, seq, round(avg(x) OVER (PARTITION BY session ORDER BY t, seq ROWS 4 PRECEDING), 6) AS mean FROM s")
def moving_average(spark, d):
    return samples(spark, d).select("session", "seq", r6(F.avg("x").over(win(-4, 0)), "mean"))


@query("SELECT session, seq, round(median(x) OVER (PARTITION BY session ORDER BY t, seq ROWS 4 PRECEDING), 6) AS median FROM s")
def moving_median(spark, d):
    return samples(spark, d).select("session", "seq", r6(F.percentile("x", 0.5).over(win(-4, 0)), "median"))


@query("SELECT session, seq, round(avg(x) OVER w, 6) AS mean, round(max(abs(x)) OVER w, 6) AS peak FROM (SELECT *, round(t * 3600000000)::BIGINT AS us FROM s) WINDOW w AS (PARTITION BY session ORDER BY us RANGE 172800000000 PRECEDING)")
def time_range_mean(spark, d):
    us = F.round(F.col("t") * 3600000000).cast("long")
    w = Window.partitionBy("session").orderBy("us").rangeBetween(-172800000000, 0)
    return samples(spark, d).withColumn("us", us).select("session", "seq", r6(F.avg("x").over(w), "mean"), r6(F.max(F.abs("x")).over(w), "peak"))


@query("SELECT session, seq, round(CASE WHEN abs(k - 50.5::DOUBLE) <= 1e-9 THEN 0 ELSE x / (k - 50.5::DOUBLE) END, 6) AS ratio FROM s")
def threshold_ratio(spark, d):
    bound = F.col("k") - 50.5
    return samples(spark, d).select("session", "seq", r6(F.when(F.abs(bound) <= 1e-9, 0.0).otherwise(F.col("x") / F.nullif(bound, F.lit(0.0))), "ratio"))


@query(_NUMBERED + ", f AS (SELECT session, seq, i, x AS y FROM n WHERE i = 1 UNION ALL SELECT n.session, n.seq, n.i, 0.2::DOUBLE * n.x + 0.8::DOUBLE * f.y FROM f JOIN n ON n.session = f.session AND n.i = f.i + 1) SELECT session, seq, round(y, 6) AS ema FROM f")
def ema(spark, d):
    return folds.ema(samples(spark, d), 0.2).select("session", "seq", r6("ema", "ema"))


@query(_NUMBERED + ", f AS (SELECT session, seq, i, x AS y FROM n WHERE i = 1 UNION ALL SELECT n.session, n.seq, n.i, f.y + greatest(least(n.x - f.y, 10), -10) FROM f JOIN n ON n.session = f.session AND n.i = f.i + 1) SELECT session, seq, round(y, 6) AS limited FROM f")
def rate_limit(spark, d):
    return folds.rate_limited(samples(spark, d), 10.0).select("session", "seq", r6("limited", "limited"))


# --- matrices --------------------------------------------------------------------------

_COV = ", cv AS (SELECT session, var_samp(x) + 1e-6::DOUBLE AS a, covar_samp(x, k) AS b, var_samp(k) + 1e-6::DOUBLE AS c FROM s GROUP BY session HAVING count(*) >= 2)"
_LOG = _COV + ", e AS (SELECT *, (a + c) / 2 AS mid, sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS half FROM cv), l0 AS (SELECT *, ln(greatest(mid + half, 1e-10)) AS hi, ln(greatest(mid - half, 1e-10)) AS lo FROM e), l AS (SELECT session, (hi + lo) / 2 + (hi - lo) / (2 * half) * (a - c) / 2 AS p, (hi - lo) / (2 * half) * b AS q, (hi + lo) / 2 - (hi - lo) / (2 * half) * (a - c) / 2 AS r FROM l0)"


def covariances(spark: SparkSession, d: str) -> DataFrame:
    """(session, a, b, c): ridged sample covariance of the two channels."""
    k = F.col("k").cast("double")
    rows = samples(spark, d).groupBy("session").agg(F.count("*").alias("n"), (F.var_samp("x") + 1e-6).alias("a"), F.covar_samp("x", k).alias("b"), (F.var_samp(k) + 1e-6).alias("c"))
    return rows.where("n >= 2").drop("n")


def logs(spark: SparkSession, d: str) -> DataFrame:
    """(session, p, q, r): logarithms of the covariances."""
    p, q, r = C.matrix_log_2x2(F.col("a"), F.col("b"), F.col("c"))
    return covariances(spark, d).select("session", p.alias("p"), q.alias("q"), r.alias("r"))


@query(", z AS (SELECT avg(x) AS m, greatest(stddev_pop(x), 1e-8) AS sd FROM s WHERE kind = 'view') SELECT session, seq, round((x - m) / sd, 6) AS z FROM s, z")
def zscore_frozen(spark, d):
    rows = samples(spark, d)
    stats = rows.where("kind = 'view'").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(1e-8)).alias("sd"))
    return rows.join(F.broadcast(stats)).select("session", "seq", r6((F.col("x") - F.col("m")) / F.col("sd"), "z"))


@query(_COV + " SELECT session, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM cv")
def covariance_2x2(spark, d):
    return covariances(spark, d).select("session", *[r6(c, c) for c in "abc"])


@query(_LOG + " SELECT session, round(p, 6) AS p, round(q, 6) AS q, round(r, 6) AS r FROM l")
def matrix_log_2x2(spark, d):
    return logs(spark, d).select("session", *[r6(c, c) for c in "pqr"])


@query(_LOG + " SELECT round(avg(p), 6) AS p, round(avg(q), 6) AS q, round(avg(r), 6) AS r, count(*) AS n FROM l")
def log_mean(spark, d):
    return logs(spark, d).agg(*[r6(F.avg(c), c) for c in "pqr"], F.count("*").alias("n"))


@query(_LOG + ", g AS (SELECT avg(p) AS gp, avg(q) AS gq, avg(r) AS gr FROM l) SELECT session, round(sqrt((p - gp) ** 2 + 2 * (q - gq) ** 2 + (r - gr) ** 2), 6) AS distance FROM l, g")
def log_distance(spark, d):
    rows = logs(spark, d)
    mean = rows.agg(C.vectorise_2x2(F.avg("p"), F.avg("q"), F.avg("r")).alias("mean"))
    return rows.join(F.broadcast(mean)).select("session", r6(C.distance(C.vectorise_2x2(F.col("p"), F.col("q"), F.col("r")), F.col("mean")), "distance"))


@query(_LOG + " SELECT session, round(0.7::DOUBLE * p, 6) AS p, round(0.7::DOUBLE * q * sqrt(2), 6) AS q, round(0.7::DOUBLE * r + 0.3::DOUBLE, 6) AS r FROM l")
def interpolate_log(spark, d):
    target = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    mixed = C.interpolate(C.vectorise_2x2(F.col("p"), F.col("q"), F.col("r")), target, 0.3)
    return logs(spark, d).withColumn("v", mixed).select("session", *[r6(F.col("v")[i], c) for i, c in enumerate("pqr")])


# --- clusters, outliers and regions over embeddings -------------------------------------

_EMB = "u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), ce AS (SELECT label, i, avg(v) AS m FROM u GROUP BY label, i), di AS (SELECT u.vec_id, u.label AS own, ce.label, sqrt(sum((u.v - ce.m) ** 2)) AS d FROM u JOIN ce ON u.i = ce.i GROUP BY u.vec_id, u.label, ce.label), rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM di), near AS (SELECT a.vec_id, a.own, a.label, a.d AS d1, b.d AS d2 FROM rk a JOIN rk b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2)"


#: Labels whose centres are broadcast as one row, at most.
MOST_LABELS = 1000


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """(label, centre): mean vector of each label."""
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))


def assigned(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, own, label, d1, d2): nearest and second nearest centre of each vector.

    The centres, one per label, become one array that each vector is measured against; how many there are is checked.
    """
    all_centres = centroids(spark, d).agg(F.collect_list(F.struct("label", "centre")).alias("centres"))
    all_centres = all_centres.select(F.when(F.size("centres") <= MOST_LABELS, F.col("centres")).otherwise(F.raise_error(F.lit(f"{MOST_LABELS} labels at most"))).alias("centres"))
    rows = table(spark, d, "embeddings").join(F.broadcast(all_centres))
    ranked = F.array_sort(F.transform("centres", lambda c: F.struct(C.distance(F.col("embedding"), c["centre"]).alias("d"), c["label"].alias("label"))))
    rows = rows.select("vec_id", F.col("label").alias("own"), ranked.alias("ranked"))
    return rows.select("vec_id", "own", F.col("ranked")[0]["label"].alias("label"), F.col("ranked")[0]["d"].alias("d1"), F.get("ranked", F.lit(1))["d"].alias("d2"))


@query("SELECT vec_id, label, round(d1, 6) AS d1, round(d2, 6) AS d2, round(greatest(least(1 - d1 / (d2 + 1e-12), 1), 0), 6) AS confidence FROM near", _EMB)
def nearest_centroid(spark, d):
    return assigned(spark, d).select("vec_id", "label", r6("d1", "d1"), r6("d2", "d2"), r6(C.clip(1 - F.col("d1") / (F.col("d2") + 1e-12), 0.0, 1.0), "confidence"))


@query("SELECT label, count(*) AS members, greatest(3, ceil(0.15::DOUBLE * max(count(*)) OVER ()))::BIGINT AS required, round(avg(d1), 6) AS mean_distance, round(stddev_pop(d1), 6) AS std_distance FROM near GROUP BY label", _EMB)
def cluster_sizes(spark, d):
    rows = assigned(spark, d).groupBy("label").agg(F.count("*").alias("members"), r6(F.avg("d1"), "mean_distance"), r6(F.stddev_pop("d1"), "std_distance"))
    return rows.withColumn("required", F.greatest(F.lit(3), F.ceil(F.max("members").over(Window.partitionBy()) * 0.15)).cast("long"))


@query(", n AS (SELECT own, label, count(*) AS n FROM near GROUP BY own, label), p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS both_, (SELECT sum(a * (a - 1) / 2) FROM (SELECT sum(n) AS a FROM n GROUP BY own)) AS one, (SELECT sum(a * (a - 1) / 2) FROM (SELECT sum(n) AS a FROM n GROUP BY label)) AS two, (SELECT sum(n) FROM n) AS total) SELECT round((both_ - one * two / (total * (total - 1) / 2)) / ((one + two) / 2 - one * two / (total * (total - 1) / 2)), 6)::DOUBLE AS adjusted_rand FROM p", _EMB)
def adjusted_rand(spark, d):
    n = assigned(spark, d).groupBy("own", "label").agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = n.agg(pairs("n").alias("both"), F.sum("n").alias("total"))
    one = n.groupBy("own").agg(F.sum("n").alias("a")).agg(pairs("a").alias("one"))
    two = n.groupBy("label").agg(F.sum("n").alias("a")).agg(pairs("a").alias("two"))
    chance = F.col("one") * F.col("two") / (F.col("total") * (F.col("total") - 1) / 2)
    return both.join(one).join(two).select(r6((F.col("both") - chance) / ((F.col("one") + F.col("two")) / 2 - chance), "adjusted_rand"))


@query("SELECT round(avg(d1) + 3 * stddev_pop(d1), 6) AS threshold FROM near", _EMB)
def ood_threshold(spark, d):
    return assigned(spark, d).agg(r6(F.avg("d1") + 3 * F.stddev_pop("d1"), "threshold"))


@query("SELECT vec_id, d1 > (SELECT avg(d1) + stddev_pop(d1) FROM near) AS ood FROM near", _EMB)
def ood_flags(spark, d):
    rows = assigned(spark, d)
    bound = rows.agg((F.avg("d1") + F.stddev_pop("d1")).alias("bound"))
    return rows.join(F.broadcast(bound)).select("vec_id", (F.col("d1") > F.col("bound")).alias("ood"))


@query("SELECT label, round(quantile_cont(d1, 0.95), 6) AS by_percentile, round(avg(d1) + 2 * stddev_pop(d1), 6) AS by_std, round(median(d1) + 3 * mad(d1), 6) AS by_mad FROM near GROUP BY label", _EMB)
def region_threshold(spark, d):
    rows = assigned(spark, d)
    mid = rows.groupBy("label").agg(F.percentile("d1", 0.5).alias("mid"), F.percentile("d1", 0.95).alias("p95"), (F.avg("d1") + 2 * F.stddev_pop("d1")).alias("std"))
    spread = rows.join(mid, "label").groupBy("label", "mid", "p95", "std").agg(F.percentile(F.abs(F.col("d1") - F.col("mid")), 0.5).alias("mad"))
    return spread.select("label", r6("p95", "by_percentile"), r6("std", "by_std"), r6(F.col("mid") + 3 * F.col("mad"), "by_mad"))


@query(", th AS (SELECT label, quantile_cont(d1, 0.95) AS thr, greatest(quantile_cont(d1, 0.95) - median(d1), stddev_pop(d1), 1e-9) AS scale FROM near GROUP BY label) SELECT vec_id, d1 <= thr AS inside, round(greatest(least(greatest(d1 - thr, 0) / scale, 1), 0), 6) AS deviation FROM near JOIN th USING (label)", _EMB)
def region_deviation(spark, d):
    rows = assigned(spark, d)
    region = rows.groupBy("label").agg(F.percentile("d1", 0.95).alias("thr"), F.percentile("d1", 0.5).alias("mid"), F.stddev_pop("d1").alias("sd"))
    region = region.withColumn("scale", F.greatest(F.col("thr") - F.col("mid"), F.col("sd"), F.lit(1e-9)))
    return rows.join(region, "label").select("vec_id", (F.col("d1") <= F.col("thr")).alias("inside"), r6(C.region_deviation(F.col("d1"), F.col("thr"), F.col("scale")), "deviation"))


@query(f", h AS (SELECT session, seq, t, CASE WHEN x > 250 THEN -2 WHEN k >= 40 THEN k % 4 END AS own FROM s), g AS (SELECT *, count(own) OVER {W} AS grp FROM h) SELECT session, seq, CASE WHEN own IS NOT NULL THEN own WHEN first_value(own) OVER (PARTITION BY session, grp ORDER BY t, seq) >= 0 THEN first_value(own) OVER (PARTITION BY session, grp ORDER BY t, seq) ELSE -1 END AS state FROM g")
def state_with_hold(spark, d):
    own = F.when(F.col("x") > 250, F.lit(-2)).when(F.col("k") >= 40, F.pmod("k", F.lit(4)))
    held = F.last("own", ignorenulls=True).over(win(None, 0))
    rows = samples(spark, d).withColumn("own", own).withColumn("held", held)
    return rows.select("session", "seq", F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("held") >= 0, F.col("held")).otherwise(-1).alias("state"))


@query(f", h AS (SELECT session, seq, t, x > 60 AS ood, sum(CASE WHEN x > 60 THEN 0 ELSE 1 END) OVER {W} AS island FROM s) SELECT session, seq, CASE WHEN ood THEN sum(ood::INT) OVER (PARTITION BY session, island ORDER BY t, seq) ELSE 0 END::BIGINT AS streak, ood AND sum(ood::INT) OVER (PARTITION BY session, island ORDER BY t, seq) >= 5 AS engaged FROM h")
def ood_streak(spark, d):
    rows = samples(spark, d).withColumn("ood", F.col("x") > 60).withColumn("island", F.sum(F.when(F.col("x") > 60, 0).otherwise(1)).over(win(None, 0)))
    run = F.sum(F.col("ood").cast("long")).over(S.by_session("island").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", run).select("session", "seq", F.when(F.col("ood"), F.col("run")).otherwise(0).cast("long").alias("streak"), (F.col("ood") & (F.col("run") >= 5)).alias("engaged"))


_BANK = _METRICS + ", bank AS (SELECT kind AS label, quantile_cont(x, 0.25) AS lower, quantile_cont(x, 0.75) AS upper FROM s GROUP BY kind)"


@query(_BANK + ", g AS (SELECT session, stride_id, label, greatest(lower - stride_time, stride_time - upper, 0) AS gap FROM m, bank) SELECT session, stride_id, arg_min(label, {'gap': gap, 'label': label}) AS label, round(min(gap), 6) AS gap FROM g GROUP BY session, stride_id")
def bank_select(spark, d):
    bank = samples(spark, d).groupBy(F.col("kind").alias("label")).agg(F.percentile("x", 0.25).alias("lower"), F.percentile("x", 0.75).alias("upper"))
    bank = bank.agg(F.collect_list(F.struct("label", "lower", "upper")).alias("bank"))  # one row: a reference per label
    v = F.col("stride_time")
    best = F.array_min(F.transform("bank", lambda b: F.struct(F.greatest(b["lower"] - v, v - b["upper"], F.lit(0.0)).alias("gap"), b["label"].alias("label"))))
    return strides(spark, d).join(F.broadcast(bank)).withColumn("best", best).select("session", "stride_id", F.col("best.label").alias("label"), r6("best.gap", "gap"))


# --- scores and policy ------------------------------------------------------------------

_SCORED = _RANGES + ", w AS (SELECT m.*, a.lower AS sl, a.upper AS su, b.lower AS el, b.upper AS eu FROM m, rg a, rg b WHERE a.metric = 'swing_ratio' AND b.metric = 'excursion' AND reject_reason = ''), sc AS (SELECT session, stride_id, t_start, CASE WHEN swing_ratio >= sl THEN 0 ELSE least((sl - swing_ratio) / 0.1::DOUBLE, 1) END AS e_swing, CASE WHEN excursion >= el AND excursion <= eu THEN 0 ELSE least(greatest(el - excursion, excursion - eu) / ((eu - el) / 2), 1) END AS e_exc, CASE WHEN stride_time > 100 THEN least((stride_time - 100) / 40, 1) ELSE 0 END AS e_r, stride_time > 140 AS ood FROM w), sd AS (SELECT *, least(greatest(0.3::DOUBLE * e_swing + 0.7::DOUBLE * e_exc, 0), 1) AS e_b FROM sc)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(session, stride_id, t_start, e_swing, e_exc, e_r, ood, e_b) of the valid strides."""
    rows = with_scores(with_ranges(strides(spark, d)))
    return rows.select("session", "stride_id", "t_start", "e_swing", "e_exc", "e_r", "ood", "e_b")


def with_ranges(rows: DataFrame) -> DataFrame:
    """The valid ones of ``rows``, strides, with ``r``: lower and upper end by metric."""
    every = ranges_of(rows).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("lower", "upper")))).alias("r"))  # one row
    return rows.where("valid").join(F.broadcast(every))


def with_scores(rows: DataFrame) -> DataFrame:
    """``rows`` of ``with_ranges`` with e_swing, e_exc, e_r, ood and e_b."""
    low, high = lambda m: F.col("r")[m]["lower"], lambda m: F.col("r")[m]["upper"]
    swing = C.interval_error(F.col("swing_ratio"), low("swing_ratio"), high("swing_ratio"), F.lit(0.1), "deficit")
    exc = C.interval_error(F.col("excursion"), low("excursion"), high("excursion"), F.lit(0.0), "two_sided")
    e_r = C.region_deviation(F.col("stride_time"), F.lit(100.0), F.lit(40.0))
    rows = rows.withColumns({"e_swing": swing, "e_exc": exc, "e_r": e_r, "ood": F.col("stride_time") > 140})
    return rows.withColumn("e_b", C.weighted_deficit([(0.3, F.col("e_swing")), (0.7, F.col("e_exc"))]))


@query(_SCORED + " SELECT session, stride_id, round(e_swing, 6)::DOUBLE AS e_swing, round(e_exc, 6)::DOUBLE AS e_exc FROM sd")
def interval_error(spark, d):
    return scored(spark, d).select("session", "stride_id", r6("e_swing", "e_swing"), r6("e_exc", "e_exc"))


@query(_SCORED + " SELECT session, stride_id, round(e_b, 6) AS e_b, round(e_b * (0.5 + 0.5 * e_r), 6) AS score, round(0.8::DOUBLE * e_b * (0.5 + 0.5 * e_r), 6) AS raw_gain FROM sd")
def assist_score(spark, d):
    score = C.assist_score(F.col("e_b"), F.col("e_r"))
    return scored(spark, d).select("session", "stride_id", r6("e_b", "e_b"), r6(score, "score"), r6(score * 0.8, "raw_gain"))


@query(_SCORED + " SELECT session, stride_id, CASE WHEN ood THEN 'OOD' WHEN e_b > 0 AND e_r > 0 THEN 'COMBINED' WHEN e_b > 0 THEN 'BIOMECH_ONLY' WHEN e_r > 0 THEN 'MANIFOLD_ONLY' ELSE 'IN_RANGE' END AS state FROM sd")
def decision_state(spark, d):
    return scored(spark, d).select("session", "stride_id", C.decision_state(F.col("ood"), F.col("e_b"), F.col("e_r")).alias("state"))


@query(_SCORED + " SELECT session, stride_id, round(0.5::DOUBLE * e_r + 0.3::DOUBLE * e_swing + 0.2::DOUBLE * e_exc, 6) AS score FROM sd")
def legacy_score(spark, d):
    return scored(spark, d).select("session", "stride_id", r6(C.legacy_score(F.col("e_r"), F.col("e_swing"), F.col("e_exc")), "score"))


@query(_SCORED + """, gn AS (SELECT session, stride_id, least(e_b, 1) * 0.8::DOUBLE AS target, row_number() OVER (PARTITION BY session ORDER BY stride_id) AS i FROM sd), z AS (
  SELECT DISTINCT session, -1::BIGINT AS stride_id, 0::BIGINT AS i, 0.0::DOUBLE AS gain, 0 AS deficits, 0 AS recoveries FROM gn
  UNION ALL
  SELECT session, stride_id, i, CASE WHEN CASE WHEN target > gain THEN deficits ELSE recoveries END >= 3 THEN least(greatest(gain + least(greatest(target - gain, -0.1::DOUBLE), 0.1::DOUBLE), 0), 0.8::DOUBLE) ELSE gain END, deficits, recoveries FROM (
    SELECT gn.session, gn.stride_id, gn.i, gn.target, z.gain, CASE WHEN gn.target > 0 THEN z.deficits + 1 ELSE 0 END AS deficits, CASE WHEN gn.target > 0 THEN 0 ELSE z.recoveries + 1 END AS recoveries FROM z JOIN gn ON gn.session = z.session AND gn.i = z.i + 1)
) SELECT session, stride_id, round(gain, 6) AS gain, deficits, recoveries FROM z WHERE i > 0""")
def gain_policy(spark, d):
    rows = scored(spark, d).select("session", F.col("stride_id").alias("seq"), F.col("stride_id").cast("double").alias("t"), F.col("e_b").alias("x"))
    return folds.run_machine(rows, folds.PersistentGain()).select("session", F.col("seq").alias("stride_id"), r6("gain", "gain"), "deficits", "recoveries")


@query(_SCORED + """, gn AS (SELECT session, stride_id, 0.8::DOUBLE * least(e_b * (0.5 + 0.5 * e_r), 1) AS raw, e_r > 0 AS ood, e_exc >= 1 AS veto, row_number() OVER (PARTITION BY session ORDER BY stride_id) AS i FROM sd), z AS (
  SELECT DISTINCT session, -1::BIGINT AS stride_id, 0::BIGINT AS i, 0.0::DOUBLE AS gain, NULL::DOUBLE AS last, NULL::DOUBLE AS w1, NULL::DOUBLE AS w2, NULL::DOUBLE AS w3, 0 AS deficits, 0 AS recoveries, 0 AS streak, 0 AS same, 0 AS since, false AS engaged, true AS updated FROM gn
  UNION ALL
  SELECT session, stride_id, i, gain, gain, w1, w2, w3, deficits, recoveries, streak, CASE WHEN last IS NOT NULL AND abs(gain - last) <= 1e-12 THEN same + 1 ELSE 0 END, since, engaged, updated FROM (
    SELECT *  REPLACE (least(greatest(gain + least(greatest(CASE WHEN veto THEN 0 WHEN engaged THEN least(gain, 0.2::DOUBLE) WHEN NOT updated THEN gain WHEN CASE WHEN best > gain THEN deficits ELSE recoveries END >= 2 THEN best ELSE gain END - gain, -0.1::DOUBLE), 0.1::DOUBLE), 0), 0.8::DOUBLE) AS gain) FROM (
      SELECT * REPLACE (CASE WHEN veto OR engaged OR NOT updated THEN deficits WHEN best > 0 THEN deficits + 1 ELSE 0 END AS deficits, CASE WHEN veto OR engaged OR NOT updated THEN recoveries WHEN best > 0 THEN 0 ELSE recoveries + 1 END AS recoveries) FROM (
        SELECT *, greatest(w1, w2, w3) AS best, veto OR engaged OR since = 0 AS updated FROM (
          SELECT session, stride_id, i, gain, last, veto, engaged, CASE WHEN NOT veto AND NOT engaged THEN raw END AS w1, CASE WHEN NOT veto AND NOT engaged THEN w1 END AS w2, CASE WHEN NOT veto AND NOT engaged THEN w2 END AS w3, deficits, recoveries, streak, same, CASE WHEN NOT veto AND NOT engaged AND same >= 4 THEN (since + 1) % 3 ELSE 0 END AS since FROM (
            SELECT gn.session, gn.stride_id, gn.i, gn.raw, gn.veto, z.gain, z.last, z.w1, z.w2, z.deficits, z.recoveries, z.same, z.since, CASE WHEN gn.ood THEN z.streak + 1 ELSE 0 END AS streak, CASE WHEN gn.ood THEN z.streak + 1 ELSE 0 END >= 2 AS engaged FROM z JOIN gn ON gn.session = z.session AND gn.i = z.i + 1)))))
) SELECT session, stride_id, round(gain, 6) AS gain, engaged::INT AS engaged, updated::INT AS updated, deficits, recoveries FROM z WHERE i > 0""")
def assist_policy(spark, d):
    """The whole policy, with streaks short enough for the sessions of the tables to reach."""
    from strideline.operators.policy import AssistPolicy
    from strideline.sources.sinks import Config
    raw = C.assist_score(F.col("e_b"), F.col("e_r")) * 0.8
    rows = scored(spark, d).select("session", F.col("stride_id").alias("seq"), F.col("stride_id").cast("double").alias("t"), raw.alias("x"), (F.col("e_r") > 0).alias("ood"), (F.col("e_exc") >= 1).alias("veto"))
    out = folds.run_machine(rows, AssistPolicy(Config(ood_streak=2, persist=2, settle=4)))
    return out.select("session", F.col("seq").alias("stride_id"), r6("gain", "gain"), "engaged", "updated", "deficits", "recoveries")


@query(_SCORED + ", h AS (SELECT *, e_b > 0 AS deficit, row_number() OVER w - row_number() OVER (PARTITION BY session, e_b > 0 ORDER BY stride_id) AS island FROM sd WINDOW w AS (PARTITION BY session ORDER BY stride_id)) SELECT session, stride_id, deficit, row_number() OVER (PARTITION BY session, deficit, island ORDER BY stride_id)::INT AS streak FROM h")
def persistence_streaks(spark, d):
    rows = scored(spark, d).withColumn("deficit", F.col("e_b") > 0)
    before = Window.partitionBy("session").orderBy("stride_id")
    change = F.coalesce((F.col("deficit") != F.lag("deficit").over(before)).cast("int"), F.lit(0))
    rows = rows.withColumn("change", change).withColumn("island", F.sum("change").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("session", "stride_id", "deficit", F.row_number().over(Window.partitionBy("session", "island").orderBy("stride_id")).alias("streak"))


# --- control ----------------------------------------------------------------------------

@query("SELECT session, seq, round(sin(pi() * u), 6) AS sine, round((1 - cos(2 * pi() * u)) / 2, 6) AS raised_cosine, round(least(u / 0.25, 1, (1 - u) / 0.25), 6)::DOUBLE AS trapezoid FROM (SELECT *, greatest(least(k / 100.0::DOUBLE, 1), 0) AS u FROM s)")
def swing_profile(spark, d):
    u = F.col("k") / 100.0
    return samples(spark, d).select("session", "seq", *[r6(C.swing_profile(p, u), p) for p in ("sine", "raised_cosine", "trapezoid")])


@query(f"SELECT session, seq, round(target, 6) AS target, round(coalesce(CASE WHEN t - lag(t) OVER w > 0 THEN (target - lag(target) OVER w) / (t - lag(t) OVER w) END, 0), 6) AS velocity FROM (SELECT *, x - 0.5::DOUBLE * 30 * CASE WHEN swing THEN sin(pi() * greatest(least(k / 100.0::DOUBLE, 1), 0)) ELSE 0 END AS target FROM s) WINDOW w AS {W}")
def belt_target(spark, d):
    profile = F.when(F.col("swing"), C.swing_profile("sine", F.col("k") / 100.0)).otherwise(0.0)
    rows = samples(spark, d).withColumn("target", F.col("x") - 15.0 * profile)
    return rows.select("session", "seq", r6("target", "target"), r6(derivative(F.col("target"), F.col("t"), win()), "velocity"))


@query("SELECT a.session, a.seq, b.x AS set_point FROM (SELECT * FROM s WHERE NOT strike) a ASOF LEFT JOIN (SELECT session, t, x FROM s WHERE strike) b ON a.session = b.session AND a.t >= b.t")
def setpoint_asof(spark, d):
    published = F.last(F.when(F.col("strike"), F.col("x")), ignorenulls=True).over(win(None, 0))
    return samples(spark, d).withColumn("set_point", published).where("not strike").select("session", "seq", "set_point")


@query("SELECT session, seq, round(f, 6) AS force, round(CASE WHEN f <= 0 THEN 0 ELSE least((f + 0.04::DOUBLE) / 0.87::DOUBLE, 13) END, 6)::DOUBLE AS current FROM (SELECT *, 0.005::DOUBLE * (x - 60) + 0.005::DOUBLE * (k - 50) + 2 * greatest(least(k / 100.0::DOUBLE, 1), 0) AS f FROM s)")
def impedance_force(spark, d):
    f = C.impedance_force(F.col("x") - 60, F.col("k").cast("double") - 50, F.col("k") / 100.0, assist=2.0)
    return samples(spark, d).withColumn("f", f).select("session", "seq", r6("f", "force"), r6(C.force_to_current(F.col("f")), "current"))


@query(f", h AS (SELECT *, t - max(CASE WHEN strike THEN t END) OVER {W} AS e FROM s) SELECT session, seq, round(CASE WHEN e IS NULL OR e < 0 OR e > 30 THEN 0 WHEN e < 5 THEN 2 * e / 5 WHEN e <= 20 THEN 2 ELSE 2 * (30 - e) / 10 END, 6)::DOUBLE AS torque FROM h")
def torque_pulse(spark, d):
    since = F.col("t") - F.last(F.when(F.col("strike"), F.col("t")), ignorenulls=True).over(win(None, 0))
    return samples(spark, d).withColumn("e", since).select("session", "seq", r6(F.coalesce(C.torque_pulse(F.col("e"), 5.0, 15.0, 10.0, 2.0), F.lit(0.0)), "torque"))


@query("SELECT session, seq, CASE WHEN (us - min(us) OVER (PARTITION BY session)) % 108000000000 < 43200000000 THEN 1.5 ELSE 0.0 END::DOUBLE AS torque FROM (SELECT *, round(t * 3600000000)::BIGINT AS us FROM s)")
def onoff_torque(spark, d):
    rows = samples(spark, d).withColumn("us", F.round(F.col("t") * 3600000000).cast("long"))
    on = F.pmod(F.col("us") - F.min("us").over(Window.partitionBy("session")), F.lit(108000000000)) < 43200000000
    return rows.select("session", "seq", F.when(on, 1.5).otherwise(0.0).alias("torque"))


# --- reports and text --------------------------------------------------------------------

@query(_SCORED + " SELECT session, count(*) AS strides, round(avg(e_b), 6) AS mean_e_b, round(max(e_b), 6) AS max_e_b, count(*) FILTER (WHERE ood) AS ood FROM sd GROUP BY session")
def run_summary(spark, d):
    return scored(spark, d).groupBy("session").agg(F.count("*").alias("strides"), r6(F.avg("e_b"), "mean_e_b"), r6(F.max("e_b"), "max_e_b"), F.count_if("ood").alias("ood"))


@query("SELECT session, round(avg(x), 6) AS mean_current, max(x) AS max_current, round(avg((x >= 150)::INT) * 100, 6) AS saturated_percent, round(avg(x) FILTER (WHERE swing), 6) AS swing_mean, count(*) FILTER (WHERE NOT swing AND x * k > 0) AS stance_assist, max(abs(x)) = 0 AS clamped_off FROM s GROUP BY session")
def cycle_summary(spark, d):
    return samples(spark, d).groupBy("session").agg(r6(F.avg("x"), "mean_current"), F.max("x").alias("max_current"), r6(F.avg((F.col("x") >= 150).cast("int")) * 100, "saturated_percent"), r6(F.avg(F.when(F.col("swing"), F.col("x"))), "swing_mean"), F.count_if(~F.col("swing") & (F.col("x") * F.col("k") > 0)).alias("stance_assist"), (F.max(F.abs("x")) == 0).alias("clamped_off"))


@query(", c AS (SELECT session, kind, count(*) AS n, sum(count(*)) OVER (PARTITION BY session) AS total FROM s GROUP BY session, kind) SELECT session, arg_max(kind, {'n': n, 'kind': kind}) AS kind, round(max(n) / any_value(total), 6)::DOUBLE AS share FROM c GROUP BY session")
def majority_label(spark, d):
    n = samples(spark, d).groupBy("session", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("session").agg(F.max(F.struct("n", "kind")).alias("top"), F.sum("n").alias("total")).select("session", F.col("top.kind").alias("kind"), r6(F.col("top.n") / F.col("total"), "share"))


@query(", p AS (SELECT session, arg_max(t, {'g': x * k, 't': t}) AS centre FROM s GROUP BY session) SELECT s.session, s.seq, round(s.t - centre, 6) AS since FROM s JOIN p ON s.session = p.session WHERE abs(s.t - centre) <= 24")
def peak_window(spark, d):
    rows = samples(spark, d)
    peak = rows.groupBy("session").agg(F.max_by("t", F.struct((F.col("x") * F.col("k")).alias("g"), "t")).alias("centre"))
    return rows.join(peak, "session").where(F.abs(F.col("t") - F.col("centre")) <= 24).select("session", "seq", r6(F.col("t") - F.col("centre"), "since"))


@query("SELECT page_id, regexp_extract(url, 'page=([^ ]*)', 1) AS page, regexp_extract(url, 'utm_source=([^ ]*)', 1) AS source FROM pages", "none AS (SELECT 1)")
def kv_extract(spark, d):
    return table(spark, d, "pages").select("page_id", key_value(F.col("url"), "page").alias("page"), key_value(F.col("url"), "utm_source").alias("source"))


def matrix_log_nd(spark, d):
    """Logarithm of each label's 64 x 64 covariance, as a vector that keeps lengths."""
    from strideline.functions.matrices import covariance_logs
    return covariance_logs(table(spark, d, "embeddings").select(F.col("label").alias("key"), F.col("embedding").alias("v")))


QUERIES["matrix_log_nd"] = matrix_log_nd


def k_selection(spark, d):
    """Evidence for the number of clusters among the log vectors of each session's baseline, its first 30 strides."""
    from strideline.operators.clusters import choose_clusters
    return choose_clusters(stride_logs(spark, d).where("stride_id < 30").select(F.col("session").alias("key"), "v"))


def stride_logs(spark: SparkSession, d: str) -> DataFrame:
    """(session, stride_id, v): logarithm of each stride's covariance as a vector that keeps lengths."""
    k = F.col("k").cast("double")
    rows = S.cut(samples(spark, d)).groupBy("session", "stride_id").agg((F.var_samp("x") + 1e-6).alias("a"), F.covar_samp("x", k).alias("b"), (F.var_samp(k) + 1e-6).alias("c"))
    v = C.vectorise_2x2(*C.matrix_log_2x2(F.col("a"), F.col("b"), F.col("c")))
    return rows.select("session", "stride_id", v.alias("v"))


def event_match_f1(spark, d):
    """Agreement of detected strikes with the recorded ones, within 12 hours."""
    from strideline.operators.clusters import matched_sessions
    rows = samples(spark, d)
    found = folds.run_machine(rows, folds.BeltTrigger()).where("event = 'heel_strike'").select("session", "t", F.lit(True).alias("detected"))
    return matched_sessions(found.unionByName(rows.where("strike").select("session", "t", F.lit(False).alias("detected"))), 12.0)


QUERIES |= {"k_selection": k_selection, "event_match_f1": event_match_f1}


_MEANS = ", a AS (SELECT session, min(x) AS lo, max(x) AS hi, 0 AS i FROM s GROUP BY session UNION ALL SELECT session, lo2, hi2, i + 1 FROM (SELECT a.session, a.i, avg(s.x) FILTER (WHERE abs(s.x - a.lo) <= abs(s.x - a.hi)) AS lo2, avg(s.x) FILTER (WHERE abs(s.x - a.lo) > abs(s.x - a.hi)) AS hi2 FROM a JOIN s ON s.session = a.session WHERE a.i < 12 GROUP BY a.session, a.i))"


@query(_MEANS + " SELECT session, CASE WHEN hi - lo >= 5 THEN round(lo + 0.65::DOUBLE * (hi - lo), 10) END AS threshold, CASE WHEN hi - lo >= 5 THEN round(lo + 0.8::DOUBLE * (hi - lo), 10) END AS reset FROM a WHERE i = 12")
def two_means_threshold(spark, d):
    """To 10 places: means of values with 2 decimals times 0.65 end in exact halves at the sixth."""
    from strideline.operators.clusters import thresholds
    return thresholds(samples(spark, d)).select("session", *[F.round(c, 10).alias(c) for c in ("threshold", "reset")])


@query(", h AS (SELECT session, t, k, t - lag(t) OVER w AS gap, k % 2 = lag(k) OVER w % 2 AS same FROM s WHERE strike WINDOW w AS (PARTITION BY session ORDER BY t, seq)) SELECT session, count(*) AS strikes, round(min(gap), 6) AS least_gap, round(avg(CASE WHEN same THEN 0.0 WHEN NOT same THEN 1.0 END), 6)::DOUBLE AS alternation FROM h GROUP BY session")
def speed_metrics(spark, d):
    rows = samples(spark, d).where("strike").withColumn("gap", F.col("t") - F.lag("t").over(win())).withColumn("same", F.pmod("k", F.lit(2)) == F.pmod(F.lag("k").over(win()), F.lit(2)))
    return rows.groupBy("session").agg(F.count("*").alias("strikes"), r6(F.min("gap"), "least_gap"), r6(F.avg(F.when(F.col("same"), 0.0).when(~F.col("same"), 1.0)), "alternation"))


@query("SELECT seq, round(x, 2) AS belt, k::DOUBLE AS velocity, CASE WHEN k % 2 = 0 THEN k * 0.25::DOUBLE ELSE 0.0::DOUBLE END AS spring_torque FROM s WHERE kind <> 'error' AND x IS NOT NULL AND k IS NOT NULL")
def telemetry_text(spark, d):
    """Samples written as lines of text telemetry, some without a torque and with other lines between them, and read back."""
    number = lambda c: c.cast("decimal(18, 2)").cast("string")
    tel = F.concat(F.lit("[TEL] n="), F.col("seq").cast("string"), F.lit(" belt= "), number(F.col("x")), F.lit("mm vel="), F.col("k").cast("string"), F.lit("mm/s"))
    torque = F.when(F.col("k") % 2 == 0, F.concat(F.lit(" spring_torque="), number(F.col("k") * 0.25))).otherwise(F.lit(""))
    line = F.when(F.col("kind") == "error", F.concat(F.lit("[RX] belt="), number(F.col("x")))).otherwise(F.concat(tel, torque))
    found, _ = telemetry_lines(samples(spark, d).select("seq", line.alias("value")))
    return found.select("seq", r6("belt", "belt"), "velocity", "spring_torque")


#: States of a session and the events that lead from one to the next; anything else leaves the state as it is.
_EDGES = {("INIT", "signup"): "CALIBRATION", ("CALIBRATION", "click"): "BASELINE", ("BASELINE", "view"): "READY", ("READY", "click"): "WALKING", ("WALKING", "signup"): "OOD", ("OOD", "view"): "WALKING"}
_NEXT = " ".join(f"WHEN f.state = '{a}' AND n.kind = '{k}' THEN '{b}'" for (a, k), b in _EDGES.items())


@query(f", n AS (SELECT session, seq, kind, row_number() OVER {W} AS i FROM s), f AS (SELECT session, seq, i, CASE WHEN kind = 'signup' THEN 'CALIBRATION' ELSE 'INIT' END AS state FROM n WHERE i = 1 UNION ALL SELECT n.session, n.seq, n.i, CASE {_NEXT} ELSE f.state END FROM f JOIN n ON n.session = f.session AND n.i = f.i + 1) SELECT session, seq, state FROM f")
def session_states(spark, d):
    return folds.run_machine(samples(spark, d), folds.Transitions("INIT", _EDGES)).select("session", "seq", "state")


@query(f"SELECT session, seq, CASE WHEN n > 1 AND t > first_t THEN round((n - 1) / (t - first_t), 6) END AS rate FROM (SELECT session, seq, t, count(*) OVER r AS n, min(t) OVER r AS first_t FROM s WINDOW r AS (PARTITION BY session ORDER BY t, seq ROWS 99 PRECEDING))")
def tick_rate(spark, d):
    w = win(-99, 0)
    rows = samples(spark, d).withColumn("n", F.count("*").over(w)).withColumn("first_t", F.min("t").over(w))
    return rows.select("session", "seq", r6(F.when((F.col("n") > 1) & (F.col("t") > F.col("first_t")), (F.col("n") - 1) / F.nullif(F.col("t") - F.col("first_t"), F.lit(0.0))), "rate"))


@query(f", h AS (SELECT *, x >= 100 AND lag(x) OVER {W} < 100 AS up FROM s) SELECT session, count(*) FILTER (WHERE up) AS crossings, count(*) FILTER (WHERE x >= 100) AS above, round(min(t) FILTER (WHERE up) - min(t), 6) AS first_after FROM h GROUP BY session")
def rising_crossings(spark, d):
    rows = samples(spark, d).withColumn("up", F.coalesce((F.col("x") >= 100) & (F.lag("x").over(win()) < 100), F.lit(False)))
    return rows.groupBy("session").agg(F.count_if("up").alias("crossings"), F.count_if(F.col("x") >= 100).alias("above"), r6(F.min(F.when(F.col("up"), F.col("t"))) - F.min("t"), "first_after"))


@query(_NUMBERED + ", f AS (SELECT session, seq, i, t, x >= 100 AS fired, CASE WHEN x >= 100 THEN t END AS last FROM n WHERE i = 1 UNION ALL SELECT n.session, n.seq, n.i, n.t, n.x >= 100 AND (f.last IS NULL OR n.t - f.last >= 31.2::DOUBLE), CASE WHEN n.x >= 100 AND (f.last IS NULL OR n.t - f.last >= 31.2::DOUBLE) THEN n.t ELSE f.last END FROM f JOIN n ON n.session = f.session AND n.i = f.i + 1) SELECT session, seq, fired FROM f")
def torque_trigger(spark, d):
    """Strikes that may start a pulse: at least 0.65 of a cycle of 48 hours after the last that did."""
    trigger = folds.Recurrence("last", lambda x, t: t if x >= 100 else -1e18, lambda y, x, t: t if x >= 100 and t - y >= 31.2 else y, ("x", "t"))
    return folds.run_machine(samples(spark, d), trigger).select("session", "seq", (F.col("last") == F.col("t")).alias("fired"))


@query(_NUMBERED + ", f AS (SELECT session, seq, i, 0.2::DOUBLE * CASE WHEN abs(k - 50) <= 5 THEN 0 ELSE k - 50 END AS y FROM (SELECT n.*, s.k FROM n JOIN s USING (session, seq)) WHERE i = 1 UNION ALL SELECT n.session, n.seq, n.i, 0.2::DOUBLE * CASE WHEN abs(s.k - 50) <= 5 THEN 0 ELSE s.k - 50 END + 0.8::DOUBLE * f.y FROM f JOIN n ON n.session = f.session AND n.i = f.i + 1 JOIN s ON s.session = n.session AND s.seq = n.seq) SELECT session, seq, round(0.5::DOUBLE * y, 6) AS torque FROM f")
def proportional_assist(spark, d):
    """Dead band, exponential mean from 0, and gain."""
    dead = F.when(F.abs(F.col("k") - 50) <= 5, 0.0).otherwise((F.col("k") - 50).cast("double"))
    rows = folds.run_machine(samples(spark, d).withColumn("drive", dead), folds.Recurrence("y", lambda v: 0.2 * v, lambda y, v: 0.2 * v + 0.8 * y, ("drive",)))
    return rows.select("session", "seq", r6(F.col("y") * 0.5, "torque"))


@query("SELECT session, round(max(abs(x)) * 0.02::DOUBLE, 6) AS peak_force, round(0.87::DOUBLE * 3 - 0.04::DOUBLE, 6) AS ceiling, max(abs(x)) * 0.02::DOUBLE > 0.87::DOUBLE * 3 - 0.04::DOUBLE AS clipped FROM s GROUP BY session")
def force_budget(spark, d):
    peak, ceiling = F.max(F.abs("x")) * 0.02, 0.87 * 3 - 0.04
    return samples(spark, d).groupBy("session").agg(r6(peak, "peak_force"), r6(F.lit(ceiling), "ceiling"), (peak > ceiling).alias("clipped"))


@query(", u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT a.vec_id, a.label, b.vec_id AS other, b.label AS ol, sqrt(sum((a.v - b.v) ** 2)) AS d FROM u a JOIN u b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL), g AS (SELECT vec_id, label, ol, avg(d) AS m FROM p GROUP BY vec_id, label, ol), z AS (SELECT vec_id, label, max(m) FILTER (WHERE ol = label) AS a, min(m) FILTER (WHERE ol <> label) AS b FROM g GROUP BY vec_id, label) SELECT vec_id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6)::DOUBLE AS silhouette FROM z", "none AS (SELECT 1)")
def silhouette(spark, d):
    """Silhouette of the recorded labels among all vectors."""
    from strideline.operators.clusters import silhouettes
    out = silhouettes(table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "label", F.col("embedding").alias("v")))
    return out.select(F.col("key").alias("vec_id"), r6("silhouette", "silhouette"))


def offline_replay(spark, d):
    """Strides, baseline model, scores and gain of every session."""
    from strideline.plans.batch import replay
    from strideline.sources.sinks import Config
    return replay(samples(spark, d), Config(baseline_strides=4))


def mock_session(spark, d):
    """Strikes that the belt trigger finds in mock sessions."""
    from strideline.sources.mock import mock_sessions
    found = folds.run_machine(mock_sessions(spark, 4, 30.0), folds.BeltTrigger(tau=2.0, refractory=0.35))
    return found.groupBy("session").agg(F.count_if(F.col("event") == "heel_strike").alias("strikes"))


QUERIES |= {"offline_replay": offline_replay, "mock_session": mock_session}


# --- further recurrences and windows -----------------------------------------------------

@query(_NUMBERED + ", e AS (SELECT *, 1 - exp(-greatest(t - lag(t) OVER (PARTITION BY session ORDER BY i), 0) / 24.0::DOUBLE) AS a FROM n), f AS (SELECT session, seq, i, x AS y FROM e WHERE i = 1 UNION ALL SELECT e.session, e.seq, e.i, f.y + e.a * (e.x - f.y) FROM f JOIN e ON e.session = f.session AND e.i = f.i + 1) SELECT session, seq, round(y, 6) AS ema FROM f")
def ema_elapsed(spark, d):
    """Exponential mean whose weight follows the time since the last sample."""
    rows = samples(spark, d).withColumn("a", 1 - F.exp(-F.greatest(F.coalesce(F.col("t") - F.lag("t").over(win()), F.lit(0.0)), F.lit(0.0)) / 24.0))
    return folds.run_machine(rows, folds.Recurrence("ema", lambda x, a: x, lambda y, x, a: y + a * (x - y), ("x", "a"))).select("session", "seq", r6("ema", "ema"))


@query(_NUMBERED + ", e AS (SELECT n.*, 40.0::DOUBLE * greatest(least(s.k / 10.0::DOUBLE, 5), -5) AS drive, 1 - exp(-greatest(n.t - lag(n.t) OVER (PARTITION BY n.session ORDER BY i), 0) / 12.0::DOUBLE) AS a FROM n JOIN s USING (session, seq)), f AS (SELECT session, seq, i, 0.0::DOUBLE AS y FROM e WHERE i = 1 UNION ALL SELECT e.session, e.seq, e.i, f.y + e.a * (e.drive - f.y) FROM f JOIN e ON e.session = f.session AND e.i = f.i + 1) SELECT session, seq, round(y, 6) AS position FROM f")
def motor_lag(spark, d):
    """First-order plant: 40 mm an ampere, the current held to 5."""
    rows = samples(spark, d).withColumn("drive", 40.0 * C.clip(F.col("k") / 10.0, -5.0, 5.0))
    rows = rows.withColumn("a", 1 - F.exp(-F.greatest(F.coalesce(F.col("t") - F.lag("t").over(win()), F.lit(0.0)), F.lit(0.0)) / 12.0))
    return folds.run_machine(rows, folds.Recurrence("y", lambda v, a: 0.0, lambda y, v, a: y + a * (v - y), ("drive", "a"))).select("session", "seq", r6("y", "position"))


@query(_level_sql(70, 30, 12, True).replace("SELECT session, seq, t, x, row_number()", "SELECT session, seq, t, k AS x, row_number()"))
def gyro_events(spark, d):
    rows = samples(spark, d).withColumn("x", F.col("k").cast("double"))
    return folds.run_machine(rows, folds.create_detector("level", high=70, low=30, refractory=12)).select("session", "seq", "event")


@query(_NUMBERED + ", e AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY session ORDER BY i) < 100 AND x >= 100, false) AS up FROM n), f AS (SELECT session, seq, i, false AS crossing, NULL::DOUBLE AS last FROM e WHERE i = 1 UNION ALL SELECT e.session, e.seq, e.i, e.up AND (f.last IS NULL OR e.t - f.last >= 24), CASE WHEN e.up AND (f.last IS NULL OR e.t - f.last >= 24) THEN e.t ELSE f.last END FROM f JOIN e ON e.session = f.session AND e.i = f.i + 1) SELECT session, seq, crossing FROM f")
def refractory_crossings(spark, d):
    """Rises through a threshold, each at least 24 hours after the one before."""
    rows = samples(spark, d).withColumn("up", F.coalesce((F.lag("x").over(win()) < 100) & (F.col("x") >= 100), F.lit(False)))
    crossing = folds.Recurrence("last", lambda up, t: -1e18, lambda y, up, t: t if up and t - y >= 24 else y, ("up", "t"))
    return folds.run_machine(rows, crossing).select("session", "seq", (F.col("last") == F.col("t")).alias("crossing"))


@query(f", n AS (SELECT *, row_number() OVER {W} AS i FROM s), f AS (SELECT DISTINCT session, -1::BIGINT AS seq, 0::BIGINT AS i, false AS passed, true AS armed FROM n UNION ALL SELECT session, seq, i, ready AND strike AND x <= 80, ready AND NOT (strike AND x <= 80) FROM (SELECT n.session, n.seq, n.i, n.strike, n.x, f.armed OR n.x > 120 AS ready FROM f JOIN n ON n.session = f.session AND n.i = f.i + 1)) SELECT session, seq, passed::INT AS passed, armed::INT AS armed FROM f WHERE i > 0")
def belt_gate_rearm(spark, d):
    return folds.run_machine(samples(spark, d), folds.GateRearm(80.0, 120.0)).select("session", "seq", "passed", "armed")


@query(f", h AS (SELECT *, max(CASE WHEN strike THEN t END) OVER w AS hs, count(*) FILTER (WHERE strike) OVER w AS strikes FROM s WINDOW w AS (PARTITION BY session ORDER BY t, seq ROWS UNBOUNDED PRECEDING)), r AS (SELECT session, t AS hs, x AS ref FROM s WHERE strike) SELECT h.session, h.seq, strikes, round(CASE WHEN h.t - h.hs <= 8.4::DOUBLE THEN greatest(least(0.05::DOUBLE * (ref - h.x) - 0.01::DOUBLE * h.k + 2, 30), 0) ELSE 0 END, 6)::DOUBLE AS force FROM h LEFT JOIN r ON r.session = h.session AND r.hs = h.hs")
def impedance_window(spark, d):
    """Spring and damper about the length at the last strike, for a while after it, and the strikes so far."""
    upto = win(None, 0)
    last = lambda c: F.last(F.when(F.col("strike"), F.col(c)), ignorenulls=True).over(upto)
    rows = samples(spark, d).withColumn("hs", last("t")).withColumn("ref", last("x")).withColumn("strikes", F.sum(F.col("strike").cast("long")).over(upto))
    force = C.clip(0.05 * (F.col("ref") - F.col("x")) - 0.01 * F.col("k") + 2, 0.0, 30.0)
    return rows.select("session", "seq", "strikes", r6(F.when(F.col("t") - F.col("hs") <= 8.4, force).otherwise(0.0), "force"))


@query(f", g AS (SELECT session, t - lag(t) OVER (PARTITION BY session ORDER BY t, seq) AS gap FROM s WHERE strike), m AS (SELECT session, median(gap) AS period FROM g GROUP BY session), h AS (SELECT session, seq, t, max(CASE WHEN strike THEN t END) OVER (PARTITION BY session ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS hs FROM s) SELECT h.session, h.seq, CASE WHEN period > 0 THEN round(hs + period * (floor((t - hs) / period) + 1) - t, 6) END AS due_in FROM h LEFT JOIN m ON m.session = h.session")
def next_strike(spark, d):
    """Hours to the next strike that a session's median interval lets expect, rolled on while none comes."""
    strike = F.when(F.col("strike"), F.col("t"))
    rows = samples(spark, d).withColumn("hs", F.last(strike, ignorenulls=True).over(win(None, 0))).withColumn("before", F.last(strike, ignorenulls=True).over(win(None, -1)))
    gap = F.when(F.col("strike"), F.col("t") - F.col("before"))
    period = F.nullif(F.percentile(gap, 0.5).over(Window.partitionBy("session")), F.lit(0.0))
    rows = rows.withColumn("period", period)
    return rows.select("session", "seq", r6(F.col("hs") + F.col("period") * (F.floor((F.col("t") - F.col("hs")) / F.col("period")) + 1) - F.col("t"), "due_in"))


@query(_LOG + " SELECT session, round(p, 6) AS v0, round(q * sqrt(2), 6) AS v1, round(r, 6) AS v2, round(sqrt(p * p + 2 * q * q + r * r), 6) AS norm FROM l")
def vectorise_2x2(spark, d):
    v = C.vectorise_2x2(F.col("p"), F.col("q"), F.col("r"))
    rows = logs(spark, d).withColumn("v", v)
    return rows.select("session", *[r6(F.col("v")[i], f"v{i}") for i in range(3)], r6(C.distance(F.col("v"), F.array(*[F.lit(0.0)] * 3)), "norm"))


@query(_COV + ", e AS (SELECT session, (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS least, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS most FROM cv) SELECT session, round(least, 6) AS least, CASE WHEN least > 0 THEN round(most / least, 4) END AS condition, least > 1e-10 AS spd FROM e")
def spd_check_2x2(spark, d):
    """Eigenvalues of each session's covariance in closed form."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    half = F.sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)
    rows = covariances(spark, d).select("session", ((a + c) / 2 - half).alias("least"), ((a + c) / 2 + half).alias("most"))
    return rows.select("session", r6("least", "least"), F.when(F.col("least") > 0, F.round(F.col("most") / F.nullif(F.col("least"), F.lit(0.0)), 4)).alias("condition"), (F.col("least") > 1e-10).alias("spd"))


@query("SELECT own AS label, count(*) AS members, round(sum(d * d), 4) AS inertia, round(avg(d), 6) AS mean_distance FROM di WHERE own = label GROUP BY own", _EMB)
def single_cluster(spark, d):
    """The model of one cluster for each label: members, inertia and mean distance to their centre."""
    rows = table(spark, d, "embeddings").join(centroids(spark, d), "label").select("label", C.distance(F.col("embedding"), F.col("centre")).alias("d"))
    return rows.groupBy("label").agg(F.count("*").alias("members"), F.round(F.sum(F.col("d") * F.col("d")), 4).alias("inertia"), r6(F.avg("d"), "mean_distance"))


@query(f", h AS (SELECT *, lag(k) OVER {W} AS before FROM s) SELECT session, seq, k - before AS step FROM h WHERE k > before")
def counter_edges(spark, d):
    """Samples where a counter has risen."""
    rows = samples(spark, d).withColumn("before", F.lag("k").over(win())).where(F.col("k") > F.col("before"))
    return rows.select("session", "seq", (F.col("k") - F.col("before")).alias("step"))


def spd_check(spark, d):
    """Why a label's 64 x 64 covariance is not positive definite, with its least eigenvalue."""
    from strideline.functions.matrices import matrix_checks
    return matrix_checks(table(spark, d, "embeddings").select(F.col("label").alias("key"), F.col("embedding").alias("v")))


def pca_display(spark, d):
    """Vectors on the two main axes of the table; each axis points to where its largest loading is positive."""
    from strideline.operators.clusters import principal_plane
    return principal_plane(table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v")))


def adaptive_detector(spark, d):
    """Strikes, sides, cadence and assists of mock walks at two speeds, with the unit mounted at odd angles."""
    from strideline.operators.imu_steps import AdaptiveSteps
    from strideline.sources.mock import mock_walks
    rows = mock_walks(spark, 3).unionByName(mock_walks(spark, 3, 23.0, step=0.75).withColumn("session", F.col("session") + 100))
    found = folds.run_machine(rows, AdaptiveSteps())
    hit = F.col("event") == "heel_strike"
    return found.groupBy("session").agg(F.count_if(hit & (F.col("side") == "left")).alias("left"), F.count_if(hit & (F.col("side") == "right")).alias("right"), F.sum("assist").alias("assists"), F.max_by("cycle", "t").alias("cycle"), F.max_by("pulse", "t").alias("pulse"))


def telemetry_decode(spark, d):
    """Samples written as device frames between text lines, one capture a session, and read back."""
    from strideline.sources.telemetry import decode_captures, encode_captures
    return decode_captures(encode_captures(samples(spark, d))).select("path", "at", "kind", "seq", "values", "line")


def live_loop(spark, d):
    """The live loop over each session: a row for each closed stride, scored once the session's first five have made its model."""
    steps = folds.run_machine(samples(spark, d), LiveLoop(Config(baseline_strides=5, ood_streak=2, persist=2)))
    return steps.where("stride_id is not null").select("session", "stride_id", "reject_reason", "nth", "state", *[r6(c, c) for c in ("d", "e_b", "e_r", "gain")], "ood", "session_state")


QUERIES |= {"live_loop": live_loop, "spd_check": spd_check, "pca_display": pca_display, "adaptive_detector": adaptive_detector, "telemetry_decode": telemetry_decode}


# --- records and goals -------------------------------------------------------------------

@query(f"SELECT session, stride_id, gain, round(gain - coalesce(lag(gain) OVER (PARTITION BY session ORDER BY stride_id), 0), 6) AS gain_delta, round(mean_x - gain * 30, 6) AS target, state, stride_time, excursion FROM ({ORACLE['gain_policy']}) JOIN ({ORACLE['stride_metrics']}) USING (session, stride_id) JOIN ({ORACLE['decision_state']}) USING (session, stride_id)", "none AS (SELECT 1)")
def stride_records(spark, d):
    """The log row of each valid stride: gain, its change, the target it sets at 30 mm of travel, state and metrics."""
    key = ["session", "stride_id"]
    rows = gain_policy(spark, d).join(stride_metrics(spark, d), key).join(decision_state(spark, d), key)
    before = F.coalesce(F.lag("gain").over(Window.partitionBy("session").orderBy("stride_id")), F.lit(0.0))
    return rows.select(*key, "gain", r6(F.col("gain") - before, "gain_delta"), r6(F.col("mean_x") - F.col("gain") * 30, "target"), "state", "stride_time", "excursion")


@query(f"SELECT session, count(*) AS strides, count(*) FILTER (WHERE raw_gain > 0 AND gain = 0) AS blocked, count(*) FILTER (WHERE e_b > 0) AS deficits FROM ({ORACLE['assist_score']}) JOIN ({ORACLE['gain_policy']}) USING (session, stride_id) GROUP BY session", "none AS (SELECT 1)")
def gate_blocked(spark, d):
    """Strides whose raw gain the policy held back."""
    rows = assist_score(spark, d).join(gain_policy(spark, d).select("session", "stride_id", "gain"), ["session", "stride_id"])
    return rows.groupBy("session").agg(F.count("*").alias("strides"), F.count_if((F.col("raw_gain") > 0) & (F.col("gain") == 0)).alias("blocked"), F.count_if(F.col("e_b") > 0).alias("deficits"))


@query(f"SELECT session, strides >= 8 AS enough_strides, valid_strides >= 0.8::DOUBLE * strides AS mostly_valid, strides >= 8 AND valid_strides >= 0.8::DOUBLE * strides AS met FROM ({ORACLE['stride_summary']})", "none AS (SELECT 1)")
def stage_goals(spark, d):
    """Whether a session has met the goals of a stage."""
    enough, mostly = F.col("strides") >= 8, F.col("valid_strides") >= F.col("strides") * 0.8
    return stride_summary(spark, d).select("session", enough.alias("enough_strides"), mostly.alias("mostly_valid"), (enough & mostly).alias("met"))


@query(_level_sql(120, 40, 12, True).replace("SELECT session, seq, event FROM f", """, a AS (SELECT f.*, max(CASE WHEN event = 'toe_off' THEN t END) OVER w AS toe, max(CASE WHEN event = 'heel_strike' THEN t END) OVER w AS hs, max(CASE WHEN event = 'heel_strike' THEN t END) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f WINDOW w AS (PARTITION BY session ORDER BY i ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT *, last_value(CASE WHEN event = 'heel_strike' THEN t - toe END IGNORE NULLS) OVER w AS swing_time, last_value(CASE WHEN event = 'heel_strike' THEN t - before END IGNORE NULLS) OVER w AS period FROM a WINDOW w AS (PARTITION BY session ORDER BY i ROWS UNBOUNDED PRECEDING))
  SELECT session, seq, CASE WHEN toe IS NOT NULL AND (hs IS NULL OR toe > hs) THEN 'SWING' ELSE 'STANCE' END AS phase, round(CASE WHEN toe IS NOT NULL AND (hs IS NULL OR toe > hs) THEN CASE WHEN swing_time > 0 THEN least((t - toe) / swing_time, 1) END WHEN period IS NOT NULL THEN least((t - hs) / greatest(period - swing_time, 1e-3), 1) END, 6)::DOUBLE AS progress FROM b"""))
def phase_progress(spark, d):
    """Share of the present phase that has passed, by the lengths of the last swing and cycle; null until they are known."""
    rows = folds.run_machine(samples(spark, d), folds.LevelTrigger(120, 40, 12))
    upto, strike = win(None, 0), F.col("event") == "heel_strike"
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    rows = rows.withColumn("toe", last(F.when(F.col("event") == "toe_off", F.col("t")), upto)).withColumn("hs", last(F.when(strike, F.col("t")), upto)).withColumn("before", last(F.when(strike, F.col("t")), win(None, -1)))
    rows = rows.withColumn("swing_time", last(F.when(strike, F.col("t") - F.col("toe")), upto)).withColumn("period", last(F.when(strike, F.col("t") - F.col("before")), upto))
    swings = F.col("toe").isNotNull() & (F.col("hs").isNull() | (F.col("toe") > F.col("hs")))
    share = F.when(swings, F.when(F.col("swing_time") > 0, F.least((F.col("t") - F.col("toe")) / F.nullif(F.col("swing_time"), F.lit(0.0)), F.lit(1.0)))).when(F.col("period").isNotNull(), F.least((F.col("t") - F.col("hs")) / F.greatest(F.col("period") - F.col("swing_time"), F.lit(1e-3)), F.lit(1.0)))
    return rows.select("session", "seq", F.when(swings, "SWING").otherwise("STANCE").alias("phase"), r6(share, "progress"))


@query(_RANGES + " SELECT session, stride_id, metric, round(CASE WHEN value > upper THEN value - upper ELSE 0 END, 6)::DOUBLE AS excess, round(CASE WHEN value < lower THEN lower - value ELSE 0 END, 6)::DOUBLE AS deficit, value >= lower AND value <= upper AS inside FROM u JOIN rg USING (metric)")
def range_excess(spark, d):
    """How far each metric of each stride lies above or below its reference interval."""
    rows = unpivoted(spark, d).join(F.broadcast(ranges(spark, d)), "metric")  # a row a metric
    v, low, high = F.col("value"), F.col("lower"), F.col("upper")
    return rows.select("session", "stride_id", "metric", r6(F.greatest(v - high, F.lit(0.0)), "excess"), r6(F.greatest(low - v, F.lit(0.0)), "deficit"), ((v >= low) & (v <= high)).alias("inside"))


@query(", b AS (SELECT kind AS label, quantile_cont(x, 0.25) AS lower, quantile_cont(x, 0.75) AS upper FROM s GROUP BY kind) SELECT label, round(lower, 6) AS lower, round(upper, 6) AS upper, row_number() OVER (ORDER BY lower NULLS LAST, label)::INT AS place FROM b")
def bank_order(spark, d):
    """The labels of a bank by their lower bound; one without comes last."""
    bank = samples(spark, d).groupBy(F.col("kind").alias("label")).agg(F.percentile("x", 0.25).alias("lower"), F.percentile("x", 0.75).alias("upper"))
    return bank.select("label", r6("lower", "lower"), r6("upper", "upper"), F.row_number().over(Window.orderBy(F.col("lower").asc_nulls_last(), "label")).alias("place"))
