"""The engine's queries over the test tables, and the same in DuckDB SQL where SQL can say it.

The panel is events.value by user, ordered by (ts, event_id). Randomness in SQL is the same Philox stream as in Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import philox
from .operators import conformal, diagnostics, intervals, models, reduce, resample
from .operators.blocklength import block_lengths
from .operators.forecast import ar1_frame, forecast_frame
from .plans import api
from .plans.metadata import metadata_frame
from .sources.series import SeriesFrame, from_frame
from .specs import AR, ARIMA, IID, VAR, AgACI, BlockWild, CircularBlock, MethodSpec, MovingBlock, NonOverlappingBlock, ResidualBootstrap, SieveAR, StationaryBlock, TaperedBlock, Wild

Query = Callable[[SparkSession, str], DataFrame]
SEED, B, LENGTH, ALPHA = 42, 50, 5, 0.1
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> SeriesFrame:
    return from_frame(read(spark, sf_dir, "events"), "value", order=["ts", "event_id"], series="user_id", check=False)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, t, v."""
    return panel(spark, sf_dir).scalar().select("series_id", "t", "v")


def rounded(x: str, digits: int = 6):  # noqa: ANN201
    """Moved off the middle between two decimals first, where many exact results lie."""
    return F.round(F.col(x) + 1e-9, digits) + F.lit(0.0)


def named(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order give the same rows."""
    kinds = dict(df.dtypes)
    return df.select(*[rounded(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns or df.columns])


S = "s AS (SELECT user_id AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, value) - 1 AS INTEGER) AS t, CAST(value AS DOUBLE) AS v, user_id & 4294967295 AS slot FROM events)"
N = "z AS (SELECT series_id, slot, CAST(count(*) AS INTEGER) AS n FROM s GROUP BY ALL)"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round(({x}) + 1e-9, {digits}) + 0.0 AS {name}"


# ---- series, lags, autocovariance, block length -----------------------------------------------------------------------------


@query("series_index", f"WITH {S} SELECT series_id, t, {r('v', 'v')} FROM s")
def series_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(points(spark, sf_dir))


@query("series_check", f"WITH {S} SELECT series_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (v IS NULL OR NOT isfinite(v)) AS BIGINT) AS bad FROM s GROUP BY 1")
def series_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return points(spark, sf_dir).groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("bad"))


@query("lag_design", f"WITH {S}, d AS (SELECT series_id, t, v, lag(v, 1) OVER w AS lag1, lag(v, 2) OVER w AS lag2 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, t, {r('v', 'v')}, {r('lag1', 'lag1')}, {r('lag2', 'lag2')} FROM d WHERE lag2 IS NOT NULL")
def lag_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("t")
    return named(points(spark, sf_dir).withColumns({"lag1": F.lag("v", 1).over(w), "lag2": F.lag("v", 2).over(w)}).where("lag2 is not null"))


_ACF = "c AS (SELECT series_id, t, v - avg(v) OVER (PARTITION BY series_id) AS c, count(*) OVER (PARTITION BY series_id) AS n FROM s)"


@query("acf", f"WITH {S}, {_ACF} SELECT a.series_id, CAST(a.t - b.t AS INTEGER) AS k, {r('sum(a.c * b.c) / a.n', 'r')} FROM c a JOIN c b ON a.series_id = b.series_id AND a.t - b.t BETWEEN 0 AND 10 GROUP BY a.series_id, a.n, a.t - b.t")
def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(diagnostics.autocovariance_frame(points(spark, sf_dir), 10))


_LAG1 = f"WITH {S}, l AS (SELECT series_id, v, lag(v) OVER (PARTITION BY series_id ORDER BY t) AS p FROM s), d AS (SELECT series_id, CAST(count(*) AS BIGINT) AS n_obs, coalesce(abs(corr(v, p) FILTER (p IS NOT NULL)), 0) AS lag1 FROM l GROUP BY 1)"


@query("lag1_autocorr", f"{_LAG1} SELECT series_id, n_obs, {r('lag1', 'lag1')} FROM d")
def lag1_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(diagnostics.lag1_frame(points(spark, sf_dir)))


@query("diagnose", f"{_LAG1} SELECT series_id, n_obs, {r('lag1', 'lag1')}, lag1 > 0.2 AS dependent, lag1 > 0.95 AS nonstationary, CASE WHEN lag1 > 0.95 THEN 'ResidualBootstrap(model=ARIMA(...))' WHEN lag1 > 0.2 THEN 'StationaryBlock' ELSE 'IID' END AS recommended FROM d")
def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(diagnostics.diagnose_frame(points(spark, sf_dir)))


@query("difference", f"WITH {S}, d AS (SELECT series_id, t, v - lag(v) OVER (PARTITION BY series_id ORDER BY t) AS d FROM s) SELECT series_id, t, {r('d', 'd')} FROM d WHERE d IS NOT NULL")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("t")
    return named(points(spark, sf_dir).select("series_id", "t", (F.col("v") - F.lag("v").over(w)).alias("d")).where("d is not null"))


@query("integrate", f"WITH {S} SELECT series_id, t, {r('sum(v) OVER (PARTITION BY series_id ORDER BY t)', 'level', 4)} FROM s")
def integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return named(points(spark, sf_dir).select("series_id", "t", F.sum("v").over(w).alias("level")), digits=4)


_PW = f"""
WITH {S}, {_ACF},
b AS (SELECT DISTINCT series_id, n, greatest(5, CAST(floor(sqrt(log10(n))) AS INTEGER)) AS run FROM c),
b2 AS (SELECT *, CAST(least(ceil(sqrt(n)) + run, n - 1) AS INTEGER) AS most FROM b),
a AS (SELECT x.series_id, x.t - y.t AS k, sum(x.c * y.c) / max(x.n) AS r FROM c x JOIN b2 USING (series_id) JOIN c y ON x.series_id = y.series_id AND x.t - y.t BETWEEN 0 AND most GROUP BY 1, 2),
l AS (SELECT a.series_id, k, r, b2.n, run, most, max(r) FILTER (k = 0) OVER (PARTITION BY a.series_id) AS r0 FROM a JOIN b2 USING (series_id)),
f AS (SELECT *, k > 0 AND r0 > 0 AND abs(r) >= 2 * sqrt(log10(n) / n) * r0 AS loud FROM l),
q AS (SELECT f.series_id, min(k) AS quiet FROM f WHERE k > 0 AND k + run - 1 <= most AND NOT EXISTS (SELECT 1 FROM f g WHERE g.series_id = f.series_id AND g.loud AND g.k BETWEEN f.k AND f.k + f.run - 1) GROUP BY 1),
m AS (SELECT f.series_id, f.n, most, max(r0) AS r0, CASE WHEN max(r0) <= 0 THEN 1 ELSE greatest(1, least(2 * coalesce(max(quiet), max(k) FILTER (loud), 1), most)) END AS m FROM f LEFT JOIN q USING (series_id) GROUP BY 1, 2, 3),
g AS (SELECT m.series_id, m.n, m.m, sum(w * k * r) AS g, sum(w * r) AS s FROM (SELECT a.series_id, k, r, CASE WHEN k * 1.0 / m <= 0.5 THEN 1.0 ELSE 2 * (1 - k * 1.0 / m) END * CASE WHEN k = 0 THEN 1 ELSE 2 END AS w FROM a JOIN m USING (series_id) WHERE k <= m) JOIN m USING (series_id) GROUP BY 1, 2, 3),
o AS (SELECT series_id, CAST(n AS INTEGER) AS n, CAST(m AS INTEGER) AS m, ceil(least(3 * sqrt(n), n / 3.0)) AS top, g, s FROM g)
SELECT series_id, n, m, {r("CASE WHEN n < 4 OR s = 0 OR abs(g) <= 1e-12 THEN 1.0 ELSE least(greatest(cbrt(2 * g * g / (2.0 * s * s)) * cbrt(n), 1.0), top) END", "b_stationary")},
{r("CASE WHEN n < 4 OR s = 0 OR abs(g) <= 1e-12 THEN 1.0 ELSE least(greatest(cbrt(2 * g * g / (4.0 / 3.0 * s * s)) * cbrt(n), 1.0), top) END", "b_circular")} FROM o
"""


@query("pwsd_block_length", _PW)
def pwsd_block_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(block_lengths(points(spark, sf_dir)))


_WINDOW_SQL = " UNION ALL ".join(f"SELECT '{w}' AS window_name, t, {x} AS raw FROM p" for w, x in {
    "bartlett": "1 - abs(2 * x - 1)", "hann": "0.5 - 0.5 * cos(2 * pi() * x)", "hamming": "0.54 - 0.46 * cos(2 * pi() * x)", "blackman": "0.42 - 0.5 * cos(2 * pi() * x) + 0.08 * cos(4 * pi() * x)", "tukey": "CASE WHEN least(x, 1 - x) < 0.25 THEN 0.5 - 0.5 * cos(2 * pi() * least(x, 1 - x) / 0.5) ELSE 1 END"}.items())


@query("taper_windows", f"WITH p AS (SELECT CAST(i AS INTEGER) AS t, i / 11.0 AS x FROM range(12) q(i)), w AS ({_WINDOW_SQL}) SELECT window_name, t, {r('raw / sqrt(avg(raw * raw) OVER (PARTITION BY window_name))', 'weight')} FROM w")
def taper_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(w, t, float(x)) for w in ("bartlett", "blackman", "hamming", "hann", "tukey") for t, x in enumerate(resample.taper(w, 12, 0.5))]
    return named(spark.createDataFrame(rows, "window_name string, t int, weight double"))


@query("method_metadata", """SELECT * FROM (VALUES
('iid', 'exchangeable observations', true, false, true, true, false, 'Efron 1979', 'O(B*n)', 'wrong under serial dependence'),
('moving_block', 'stationarity; weak dependence', true, false, true, true, true, 'Kunsch 1989; Liu-Singh 1992', 'O(B*n)', 'depends on block length; ends of the series are drawn less often'),
('circular_block', 'stationarity; weak dependence', true, false, true, true, true, 'Politis-Romano 1992', 'O(B*n)', 'depends on block length'),
('stationary_block', 'stationarity; weak dependence', true, false, true, true, true, 'Politis-Romano 1994', 'O(B*n)', 'depends on mean block length'),
('non_overlapping_block', 'stationarity; weak dependence', true, false, true, true, true, 'Carlstein 1986', 'O(B*n)', 'more variance than overlapping blocks'),
('tapered_block', 'stationarity; weak dependence', true, false, true, true, true, 'Paparoditis-Politis 2001', 'O(B*n)', 'depends on window and block length'),
('residual', 'a well-specified model; exchangeable residuals', true, true, false, false, true, 'Freedman 1984; Bose 1988', 'O(B*n*p)', 'wrong model; unstable fit'),
('sieve_ar', 'linear process', false, false, false, false, true, 'Buhlmann 1997', 'O(B*n*p)', 'non-linear or long-memory series'))
t(name, assumptions, supports_multivariate, supports_exog, supports_indices, supports_oob, preserves_temporal_dependence, references_, complexity, failure_modes)""")
def method_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = metadata_frame(spark, registered=False).withColumnRenamed("references", "references_")
    return known.withColumns({c: F.array_join(c, "; ") for c in ("assumptions", "references_", "failure_modes")})


# ---- streams and indices ----------------------------------------------------------------------------------------------------


@query("philox_words", "WITH q AS (SELECT i AS k FROM range(1000) t(i)), " + philox.sql("q", ["k", "7", "3", "2"], SEED) + " SELECT k, CAST(w0 AS BIGINT) AS w0, CAST(w1 AS BIGINT) AS w1, CAST(w2 AS BIGINT) AS w2, CAST(w3 AS BIGINT) AS w3 FROM ph")
def philox_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return philox.add_words(spark.range(1000).withColumnRenamed("id", "k"), [F.col("k"), F.lit(7), F.lit(3), F.lit(2)], SEED)


def _spread(source: str, by: str) -> str:
    """Rows of source with one of w0..w3 as w and its place k * 4 + j as `by`."""
    return " UNION ALL ".join(f"SELECT * EXCLUDE (w0, w1, w2, w3, k4), CAST(k4 * 4 + {j} AS INTEGER) AS {by}, w{j} AS w FROM {source}" for j in range(4))


def start_sql(top: str, factor: str = "1", length: int = LENGTH, b: int = B, source: str = S) -> str:
    """CTEs up to st (series_id, b, k, start, n): starts of blocks."""
    return f"""{source}, {N},
bl AS (SELECT *, least({length}, n) AS len FROM z),
q AS (SELECT bl.*, b, k4 FROM bl, range({b}) r(b), range((SELECT max((n + len - 1) // len + 3) // 4 FROM bl)) k(k4) WHERE k4 * 4 < (n + len - 1) // len),
{philox.sql("q", ["k4", "b", "slot", str(philox.BLOCK_START)], SEED)},
d AS ({_spread("ph", "k")}),
st AS (SELECT series_id, b, k, n, len, CAST((w * ({top})::UBIGINT) >> 32 AS BIGINT) * ({factor}) AS start FROM d WHERE k < (n + len - 1) // len)"""


def block_index_sql(top: str, factor: str = "1", wrap: bool = False, length: int = LENGTH, **more: object) -> str:
    idx = "(start + o) % n" if wrap else "start + o"
    return start_sql(top, factor, length, **more) + f""",
ix AS (SELECT series_id, CAST(b AS INTEGER) AS b, CAST(k * len + o AS INTEGER) AS t, CAST({idx} AS INTEGER) AS idx FROM st, range({length}) x(o) WHERE o < len AND k * len + o < n)"""


_IID_IX = f"""{S}, {N}, q AS (SELECT z.*, b, k4 FROM z, range({B}) r(b), range((SELECT max(n) // 4 + 1 FROM z)) k(k4) WHERE k4 * 4 < n),
{philox.sql("q", ["k4", "b", "slot", str(philox.IID_INDEX)], SEED)}, d AS ({_spread("ph", "t")}),
ix AS (SELECT series_id, CAST(b AS INTEGER) AS b, t, CAST((w * n::UBIGINT) >> 32 AS INTEGER) AS idx FROM d WHERE t < n)"""
_STATIONARY_IX = f"""{S}, {N}, q AS (SELECT z.*, b, k4 FROM z, range({B}) r(b), range((SELECT max(n) // 4 + 1 FROM z)) k(k4) WHERE k4 * 4 < n),
{philox.sql("q", ["k4", "b", "slot", str(philox.RESTART)], SEED)}, {philox.sql("q", ["k4", "b", "slot", str(philox.SEGMENT_START)], SEED, "pg")},
d AS ({_spread("ph", "t")}), e AS ({_spread("pg", "t")}),
g AS (SELECT series_id, b, t, n, least(CASE WHEN least({LENGTH}, n) = 1 THEN 1 ELSE 1 + CAST(floor(ln((w + 0.5::DOUBLE) * pow(2.0::DOUBLE, -32)) / ln(1 - 1.0::DOUBLE / least({LENGTH}, n))) AS BIGINT) END, n) AS size FROM d WHERE t < n),
h AS (SELECT *, sum(size) OVER (PARTITION BY series_id, b ORDER BY t) - size AS bg FROM g),
ix AS (SELECT h.series_id, CAST(h.b AS INTEGER) AS b, CAST(bg + o AS INTEGER) AS t, CAST((CAST((e.w * h.n::UBIGINT) >> 32 AS BIGINT) + o) % h.n AS INTEGER) AS idx FROM h JOIN e ON e.series_id = h.series_id AND e.b = h.b AND e.t = h.t, range((SELECT max(n) FROM z)) x(o) WHERE bg < h.n AND o < size AND bg + o < h.n)"""
INDEX_SQL = {
    "iid": _IID_IX,
    "moving": block_index_sql("n - len + 1"),
    "circular": block_index_sql("n", wrap=True),
    "nonoverlap": block_index_sql("greatest(1, n // len)", "len"),
    "stationary": _STATIONARY_IX,
}
METHODS: dict[str, MethodSpec] = {"iid": IID(), "moving": MovingBlock(LENGTH), "circular": CircularBlock(LENGTH), "nonoverlap": NonOverlappingBlock(LENGTH), "stationary": StationaryBlock(LENGTH)}


def _indices(method: MethodSpec) -> Query:
    return lambda spark, d: resample.index_frame(api.with_lengths(panel(spark, d), method), method, B, SEED)


def _reduced(method: MethodSpec, statistic: object) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = api.bootstrap_reduce_panel(panel(spark, d), method=method, statistic=statistic, n_bootstraps=B, random_state=SEED)
        return named(out.frame.select("series_id", "b", F.col("theta")[0].alias("theta")))

    return run


_AGG = {"mean": ("mean", "avg(v)"), "var": ("var", "var_pop(v)"), "std": ("std", "stddev_pop(v)"), "quantile": (("quantile", 0.3), "quantile_cont(v, 0.3)"), "median": ("median", "quantile_cont(v, 0.5)")}
for _name, _method in METHODS.items():
    query(f"{_name}_indices", f"WITH {INDEX_SQL[_name]} SELECT * FROM ix")(_indices(_method))
    for _stat, (_given, _sql) in _AGG.items():
        _theta = f"WITH {INDEX_SQL[_name]} SELECT ix.series_id, ix.b, {r(_sql, 'theta')} FROM ix JOIN s ON s.series_id = ix.series_id AND s.t = ix.idx GROUP BY 1, 2"
        query(f"{_name}_{_stat}", _theta)(_reduced(_method, _given))


@query("moving_values", f"WITH {INDEX_SQL['moving']} SELECT ix.series_id, ix.b, ix.t, ix.idx, {r('s.v', 'v')} FROM ix JOIN s ON s.series_id = ix.series_id AND s.t = ix.idx")
def moving_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = api.bootstrap(panel(spark, sf_dir), method=MovingBlock(LENGTH), n_bootstraps=B, random_state=SEED, stream="counter").frame
    return named(out.select("series_id", "b", "t", "idx", F.col("x")[0].alias("v")))


@query("block_sum_mean", f"WITH {INDEX_SQL['circular']} SELECT ix.series_id, ix.b, {r('avg(v)', 'theta')} FROM ix JOIN s ON s.series_id = ix.series_id AND s.t = ix.idx GROUP BY 1, 2")
def block_sum_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, method = panel(spark, sf_dir), CircularBlock(LENGTH)
    starts = resample.start_frame(api.with_lengths(series, method), method, B, SEED)
    return named(reduce.block_sum_means(series.scalar().select("series_id", "t", "v"), starts, method))


_TAPER = "hann"
_TAPER_SQL = ", ".join(str(float(x)) for x in resample.taper(_TAPER, LENGTH))


@query("tapered_mean", f"WITH {INDEX_SQL['moving']}, m AS (SELECT series_id, avg(v) AS m FROM s GROUP BY 1) SELECT ix.series_id, ix.b, {r(f'avg(m + ([{_TAPER_SQL}])[ix.t % {LENGTH} + 1] * (v - m))', 'theta')} FROM ix JOIN s ON s.series_id = ix.series_id AND s.t = ix.idx JOIN m ON m.series_id = ix.series_id GROUP BY 1, 2")
def tapered_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(TaperedBlock(LENGTH, window=_TAPER), "mean")(spark, sf_dir)


LONG = 66  # about as long as the series: cut to the shorter ones


@query("tapered_values", f"""WITH {block_index_sql("n - len + 1", length=LONG)}, m AS (SELECT series_id, avg(v) AS m, least(count(*), {LONG}) AS len FROM s GROUP BY 1),
w AS (SELECT len, o, raw / sqrt(avg(raw * raw) OVER (PARTITION BY len)) AS w FROM (SELECT len, o, 0.5 - 0.5 * cos(2 * pi() * o / (len - 1)) AS raw FROM (SELECT DISTINCT len FROM m), range({LONG}) x(o) WHERE o < len))
SELECT ix.series_id, ix.b, ix.t, ix.idx, {r('m + w * (v - m)', 'v')} FROM ix JOIN s ON s.series_id = ix.series_id AND s.t = ix.idx JOIN m ON m.series_id = ix.series_id JOIN w ON w.len = m.len AND w.o = ix.t % m.len""")
def tapered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = api.bootstrap_frame(panel(spark, sf_dir), TaperedBlock(LONG, window=_TAPER), B, SEED)
    return named(out.select("series_id", "b", "t", "idx", F.col("x")[0].alias("v")))


@query("inbag_counts", f"WITH {INDEX_SQL['moving']}, c AS (SELECT series_id, b, idx, count(*) AS c FROM ix GROUP BY ALL) SELECT ix.series_id, ix.b, ix.t, CAST(coalesce(c, 0) AS BIGINT) AS n_inbag FROM ix LEFT JOIN c ON c.series_id = ix.series_id AND c.b = ix.b AND c.idx = ix.t")
def inbag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.bootstrap(panel(spark, sf_dir), method=MovingBlock(LENGTH), n_bootstraps=B, random_state=SEED, stream="counter").inbag_counts()


@query("oob_mask", f"WITH {INDEX_SQL['iid']} SELECT series_id, b, t FROM ix EXCEPT SELECT series_id, b, idx FROM ix")
def oob_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.bootstrap(panel(spark, sf_dir), method=IID(), n_bootstraps=B, random_state=SEED, stream="counter").out_of_bag()


@query("replicate_quantiles", f"WITH {INDEX_SQL['moving']}, h AS (SELECT ix.series_id, ix.b, avg(v) AS theta FROM ix JOIN s ON s.series_id = ix.series_id AND s.t = ix.idx GROUP BY 1, 2) SELECT series_id, {r('quantile_cont(theta, 0.1)', 'q10')}, {r('quantile_cont(theta, 0.9)', 'q90')} FROM h GROUP BY 1")
def replicate_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = api.bootstrap_reduce_panel(panel(spark, sf_dir), method=MovingBlock(LENGTH), statistic="mean", n_bootstraps=B, random_state=SEED).quantile(0.1, 0.9)
    return named(out.select("series_id", F.col("q")[0].alias("q10"), F.col("q")[1].alias("q90")))


# ---- intervals --------------------------------------------------------------------------------------------------------------


def _interval(kind: str, method: MethodSpec, **more: object) -> Query:
    return lambda spark, d: named(api.conf_int_panel(panel(spark, d), "mean", method=method, kind=kind, alpha=ALPHA, n_bootstraps=B, seed=SEED, **more), "series_id", "lower", "upper", "point")


_HATS = f"h AS (SELECT ix.series_id, ix.b, avg(v) AS theta FROM ix JOIN s ON s.series_id = ix.series_id AND s.t = ix.idx GROUP BY 1, 2), p AS (SELECT series_id, avg(v) AS point FROM s GROUP BY 1), c AS (SELECT series_id, quantile_cont(theta, {ALPHA / 2}) AS lo, quantile_cont(theta, {1 - ALPHA / 2}) AS hi FROM h GROUP BY 1)"
query("ci_percentile", f"WITH {INDEX_SQL['moving']}, {_HATS} SELECT series_id, {r('lo', 'lower')}, {r('hi', 'upper')}, {r('point', 'point')} FROM c JOIN p USING (series_id)")(_interval("percentile", MovingBlock(LENGTH)))
query("ci_basic", f"WITH {INDEX_SQL['moving']}, {_HATS} SELECT series_id, {r('2 * point - hi', 'lower')}, {r('2 * point - lo', 'upper')}, {r('point', 'point')} FROM c JOIN p USING (series_id)")(_interval("basic", MovingBlock(LENGTH)))
_BJ = "SELECT {k}, CASE WHEN count(*) >= 2 THEN sqrt((count(*) - 1) * var_pop(l)) END AS se FROM (SELECT {k}, (sum(s) OVER w - s) / (sum(c) OVER w - {n}) AS l, c FROM (SELECT {k}, t // {n} AS g, sum(v) AS s, count(*) AS c FROM {f} GROUP BY ALL) WINDOW w AS (PARTITION BY {k})) WHERE c = {n} GROUP BY {k}"
_STUDENT = f"""WITH {INDEX_SQL['moving']}, rep AS (SELECT ix.series_id, ix.b, ix.t, v FROM ix JOIN s ON s.series_id = ix.series_id AND s.t = ix.idx),
e AS ({_BJ.format(k='series_id, b', f='rep', n=LENGTH)}), e0 AS ({_BJ.format(k='series_id', f='s', n=LENGTH)}),
h AS (SELECT series_id, b, avg(v) AS theta FROM rep GROUP BY 1, 2), p AS (SELECT series_id, avg(v) AS point FROM s GROUP BY 1),
qq AS (SELECT h.series_id, point, e0.se, quantile_cont((theta - point) / e.se, {ALPHA / 2}) AS lo, quantile_cont((theta - point) / e.se, {1 - ALPHA / 2}) AS hi FROM h JOIN e ON e.series_id = h.series_id AND e.b = h.b JOIN e0 ON e0.series_id = h.series_id JOIN p ON p.series_id = h.series_id GROUP BY 1, 2, 3)
SELECT series_id, {r('point - hi * se', 'lower')}, {r('point - lo * se', 'upper')}, {r('point', 'point')} FROM qq"""
query("ci_studentized", _STUDENT)(_interval("studentized", MovingBlock(LENGTH), se_block_length=LENGTH))


def normal_sql(x: str) -> str:
    """The normal distribution function: its density times the series of x^(2k+1) / (2k+1)!!."""
    return f"(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * sign({x}) * list_sum(list_transform(range(150), lambda k: pow(abs({x}), 2 * k + 1) * exp(k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))))"


_NEWTON = ",\n".join(f"n{i} AS (SELECT * REPLACE (z - ({normal_sql('z')} - share) / (exp(-z * z / 2) / sqrt(2 * pi())) AS z) FROM n{i - 1})" for i in range(1, 13))
_BCA_LEVEL = "z + ({a}::DOUBLE + z) / (1 - acceleration * ({a}::DOUBLE + z))"
_LOW, _HIGH = (normal_sql(_BCA_LEVEL.format(a=repr(intervals.NORMAL.inv_cdf(x)))) for x in (ALPHA / 2, 1 - ALPHA / 2))
_AT = "th[CAST(floor({l} * (len(th) - 1)) AS INTEGER) + 1] + (th[least(CAST(floor({l} * (len(th) - 1)) AS INTEGER) + 2, len(th))] - th[CAST(floor({l} * (len(th) - 1)) AS INTEGER) + 1]) * ({l} * (len(th) - 1) - floor({l} * (len(th) - 1)))"
query("ci_bca", f"""WITH {INDEX_SQL['iid']}, h AS (SELECT ix.series_id, ix.b, avg(v) AS theta FROM ix JOIN s ON s.series_id = ix.series_id AND s.t = ix.idx GROUP BY 1, 2),
p AS (SELECT series_id, avg(v) AS point FROM s GROUP BY 1),
dv AS (SELECT series_id, (v - avg(v) OVER (PARTITION BY series_id)) / (count(*) OVER (PARTITION BY series_id) - 1) AS dv FROM s),
ac AS (SELECT series_id, CASE WHEN sum(dv * dv) > 0 THEN sum(dv * dv * dv) / (6 * pow(sum(dv * dv), 1.5)) ELSE 0.0 END AS acceleration FROM dv GROUP BY 1),
n0 AS (SELECT h.series_id, any_value(point) AS point, avg(CASE WHEN theta < point THEN 1.0 WHEN theta = point THEN 0.5 ELSE 0.0 END) AS share, list_sort(list(theta)) AS th, any_value(acceleration) AS acceleration, 0.0::DOUBLE AS z FROM h JOIN p ON p.series_id = h.series_id JOIN ac ON ac.series_id = h.series_id GROUP BY 1),
{_NEWTON}, lv AS (SELECT series_id, point, th, {_LOW} AS lo, {_HIGH} AS hi FROM n12)
SELECT series_id, {r(_AT.format(l='lo'), 'lower')}, {r(_AT.format(l='hi'), 'upper')}, {r('point', 'point')} FROM lv""")(_interval("bca", IID()))


@query("ci_columns", f"""WITH {INDEX_SQL['circular']}, l AS (SELECT series_id, t, dim, CASE dim WHEN 0 THEN v ELSE v * v END AS v FROM s, range(2) d(dim)),
h AS (SELECT ix.series_id, ix.b, dim, quantile_cont(l.v, 0.5) AS theta FROM ix JOIN l ON l.series_id = ix.series_id AND l.t = ix.idx GROUP BY 1, 2, 3),
p AS (SELECT series_id, dim, quantile_cont(v, 0.5) AS point FROM l GROUP BY 1, 2)
SELECT h.series_id, CAST(h.dim AS INTEGER) AS dim, {r(f'quantile_cont(theta, {ALPHA / 2})', 'lower')}, {r(f'quantile_cont(theta, {1 - ALPHA / 2})', 'upper')}, {r('any_value(point)', 'point')} FROM h JOIN p ON p.series_id = h.series_id AND p.dim = h.dim GROUP BY 1, 2""")
def ci_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median intervals of two columns side by side, the value and its square: a row for each."""
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").cast("double").alias("v")).withColumn("square", F.col("v") * F.col("v"))
    series = from_frame(events, ["v", "square"], order=["ts", "event_id"], series="user_id", check=False)
    return named(api.conf_int_panel(series, "median", method=CircularBlock(LENGTH), alpha=ALPHA, n_bootstraps=B, seed=SEED))


@query("block_jackknife_se", f"WITH {S}, e AS ({_BJ.format(k='series_id', f='s', n=LENGTH)}) SELECT series_id, {r('se', 'se')} FROM e")
def block_jackknife_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(intervals.block_jackknife_means(points(spark, sf_dir), LENGTH))


@query("jackknife", f"WITH {S} SELECT a.series_id, a.t, {r('avg(b.v)', 'left_mean')}, {r('var_pop(b.v)', 'left_var', 5)} FROM s a JOIN s b ON a.series_id = b.series_id AND a.t <> b.t GROUP BY 1, 2")
def jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.jackknife_frame(points(spark, sf_dir))
    return out.select("series_id", "t", rounded("left_mean").alias("left_mean"), rounded("left_var", 5).alias("left_var"))


@query("bca_acceleration", f"WITH {S}, d AS (SELECT series_id, (v - avg(v) OVER (PARTITION BY series_id)) / (count(*) OVER (PARTITION BY series_id) - 1) AS d FROM s) SELECT series_id, {r('CASE WHEN sum(d * d) > 0 THEN sum(d * d * d) / (6 * pow(sum(d * d), 1.5)) ELSE 0.0 END', 'acceleration')} FROM d GROUP BY 1")
def bca_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(intervals.acceleration_of_means(points(spark, sf_dir)))


# ---- models -----------------------------------------------------------------------------------------------------------------

_AR1 = f"{S}, l AS (SELECT series_id, t, v, lag(v) OVER (PARTITION BY series_id ORDER BY t) AS p FROM s), f AS (SELECT series_id, regr_intercept(v, p) AS const, regr_slope(v, p) AS phi, CAST(count(p) AS BIGINT) AS n FROM l WHERE p IS NOT NULL GROUP BY 1)"


@query("ar1_fit", f"WITH {_AR1} SELECT series_id, {r('const', 'const')}, {r('phi', 'phi')}, n FROM f")
def ar1_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(ar1_frame(points(spark, sf_dir)))


@query("ar1_residuals", f"WITH {_AR1} SELECT l.series_id, l.t, {r('v - const - phi * p', 'e')} FROM l JOIN f ON f.series_id = l.series_id WHERE p IS NOT NULL")
def ar1_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    lagged = rows.withColumn("p", F.lag("v").over(Window.partitionBy("series_id").orderBy("t"))).where("p is not null")
    return named(lagged.join(ar1_frame(rows), "series_id").select("series_id", "t", (F.col("v") - F.col("const") - F.col("phi") * F.col("p")).alias("e")))


_FORECAST = f"""WITH RECURSIVE {_AR1}, e0 AS (SELECT l.series_id, l.t - 1 AS i, v - const - phi * p AS e FROM l JOIN f ON f.series_id = l.series_id WHERE p IS NOT NULL),
e AS (SELECT series_id, i, e - avg(e) OVER (PARTITION BY series_id) AS e FROM e0),
z AS (SELECT s.series_id, slot, count(*) - 1 AS m, max_by(v, t) AS last FROM s GROUP BY 1, 2),
q AS (SELECT z.*, b, k4 FROM z, range({B}) r(b), range(1) k(k4)),
{philox.sql("q", ["k4", "b", "slot", str(philox.RESIDUAL)], SEED)}, d AS ({_spread("ph", "h")}),
w AS (SELECT d.series_id, d.b, d.h + 1 AS h, last, e.e, const, phi FROM d JOIN e ON e.series_id = d.series_id AND e.i = CAST((d.w * d.m::UBIGINT) >> 32 AS BIGINT) JOIN f ON f.series_id = d.series_id),
x AS (SELECT series_id, b, h, const + phi * last + e AS y FROM w WHERE h = 1 UNION ALL SELECT w.series_id, w.b, w.h, const + phi * x.y + w.e FROM x JOIN w ON w.series_id = x.series_id AND w.b = x.b AND w.h = x.h + 1)
SELECT series_id, CAST(h AS INTEGER) AS h, {r(f'quantile_cont(y, {ALPHA / 2})', 'lower')}, {r(f'quantile_cont(y, {1 - ALPHA / 2})', 'upper')}, {r('quantile_cont(y, 0.5)', 'median')} FROM x GROUP BY 1, 2"""


@query("forecast_ar1", _FORECAST)
def forecast_ar1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(forecast_frame(panel(spark, sf_dir), AR(), 4, B, ALPHA, SEED))


PATHS = 20


def _paths(method: MethodSpec, b: int = PATHS, source: Callable[[SparkSession, str], SeriesFrame] = panel) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = api.bootstrap(source(spark, d), method=method, n_bootstraps=b, random_state=SEED, stream="counter").frame
        return named(out.select("series_id", "b", "t", F.posexplode("x").alias("dim", "v")))

    return run


def hourly(spark: SparkSession, sf_dir: str) -> SeriesFrame:
    """One series of counts by hour of three event types, side by side."""
    wide = read(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).pivot("event_type", ["click", "view", "purchase"]).count().na.fill(0)
    return from_frame(wide, ["click", "view", "purchase"], order="hour", check=False)


def ols_sql(name: str, source: str, ys: list[str], xs: list[str]) -> str:
    """CTEs up to {name}: the rows of source with, for each y, least-squares residuals e_{y} and the series' c_{y} and b_{y}_{x}.

    Columns are centred and made orthogonal one after the other (Gram and Schmidt), by sums over each series; the
    coefficients follow by substitution from the last one back. s{j}_{y}: the sum of squares left after the first j of xs.
    """
    w = "(PARTITION BY series_id)"
    parts = [f"{name}_0 AS (SELECT *, {', '.join(f'avg({c}) OVER {w} AS m_{c}, {c} - avg({c}) OVER {w} AS z_{c}' for c in ys + xs)} FROM {source})"]
    for j, x in enumerate(xs):
        rest = xs[j + 1 :] + ys
        parts.append(f"{name}_{j}r AS (SELECT *, {', '.join(f'sum(z_{x} * z_{c}) OVER {w} / sum(z_{x} * z_{x}) OVER {w} AS r_{x}_{c}' for c in rest)} FROM {name}_{j})")
        parts.append(f"{name}_{j + 1} AS (SELECT * REPLACE ({', '.join(f'z_{c} - r_{x}_{c} * z_{x} AS z_{c}' for c in rest)}), {', '.join(f'sum((z_{y} - r_{x}_{y} * z_{x}) * (z_{y} - r_{x}_{y} * z_{x})) OVER {w} AS s{j + 1}_{y}' for y in ys)} FROM {name}_{j}r)")
    last = f"{name}_{len(xs)}"
    for j, x in reversed(list(enumerate(xs))):
        later = "".join(f" - r_{x}_{o} * b_{{y}}_{o}" for o in xs[j + 1 :])
        parts.append(f"{name}_{j}b AS (SELECT *, {', '.join(f'r_{x}_{y}{later.format(y=y)} AS b_{y}_{x}' for y in ys)} FROM {last})")
        last = f"{name}_{j}b"
    parts.append(f"{name} AS (SELECT *, {', '.join(f'z_{y} AS e_{y}, m_{y}' + ''.join(f' - b_{y}_{x} * m_{x}' for x in xs) + f' AS c_{y}' for y in ys)} FROM {last})")
    return ",\n".join(parts)


_STEPS = """z AS (SELECT series_id, slot, count(*) - 1 AS m FROM s GROUP BY 1, 2),
q AS (SELECT z.*, b, k4 FROM z, range({b}) r(b), range((SELECT max(m) // 4 + 1 FROM z)) k(k4) WHERE k4 * 4 < m)"""
_AR1_E = f"{_AR1}, e0 AS (SELECT l.series_id, l.t - 1 AS i, v - const - phi * p AS e FROM l JOIN f ON f.series_id = l.series_id WHERE p IS NOT NULL), e AS (SELECT series_id, i, e - avg(e) OVER (PARTITION BY series_id) AS e FROM e0)"


def ar1_paths_sql(purpose: int, innovation: str) -> str:
    """Paths of an AR(1) from each series' first value; innovation: CTE nu (series_id, b, t from 1, e) of the draws d (h, w, m)."""
    return f"""WITH RECURSIVE {_AR1_E}, {_STEPS.format(b=PATHS)},
{philox.sql("q", ["k4", "b", "slot", str(purpose)], SEED)}, d AS ({_spread("ph", "h")}),
nu AS ({innovation}),
x AS (SELECT s.series_id, b, 0 AS t, v AS y FROM s, range({PATHS}) r(b) WHERE s.t = 0
  UNION ALL SELECT x.series_id, x.b, x.t + 1, const + phi * x.y + nu.e FROM x JOIN nu ON nu.series_id = x.series_id AND nu.b = x.b AND nu.t = x.t + 1 JOIN f ON f.series_id = x.series_id)
SELECT series_id, CAST(b AS INTEGER) AS b, CAST(t AS INTEGER) AS t, 0 AS dim, {r('y', 'v')} FROM x"""


_MAMMEN = f"CASE WHEN (w + 0.5::DOUBLE) * pow(2.0::DOUBLE, -32) < {models.MAMMEN_P!r}::DOUBLE THEN {models.MAMMEN_LOW!r}::DOUBLE ELSE {models.MAMMEN_HIGH!r}::DOUBLE END"
query("ar1_residual_paths", ar1_paths_sql(philox.RESIDUAL, "SELECT d.series_id, b, h + 1 AS t, e FROM d JOIN e ON e.series_id = d.series_id AND e.i = CAST((d.w * d.m::UBIGINT) >> 32 AS BIGINT) WHERE h < m"))(_paths(ResidualBootstrap(AR())))
query("ar1_wild_paths", ar1_paths_sql(philox.MULTIPLIER, f"SELECT d.series_id, b, h + 1 AS t, e * {_MAMMEN} AS e FROM d JOIN e ON e.series_id = d.series_id AND e.i = h"))(_paths(ResidualBootstrap(AR(), Wild("mammen"))))
query("ar1_block_wild_paths", ar1_paths_sql(philox.MULTIPLIER, "SELECT e.series_id, b, i + 1 AS t, e * (CAST(w >> 31 AS DOUBLE) * 2 - 1) AS e FROM d JOIN e ON e.series_id = d.series_id AND e.i // 4 = d.h"))(_paths(ResidualBootstrap(AR(), BlockWild("rademacher", 4))))

SIEVE = 4  # most lags
_LAGS = [f"p{j}" for j in range(1, SIEVE + 1)]
_SIEVE_FITS = ",\n".join(f"i{k} AS (SELECT series_id, t, v, {', '.join(_LAGS[:k])} FROM l WHERE t >= {k}),\n" + ols_sql(f"o{k}", f"i{k}", ["v"], _LAGS[:k]) for k in range(1, SIEVE + 1))
_BIC = " UNION ALL ".join(f"SELECT DISTINCT series_id, {k} AS k, n * ln(greatest(s{k}_v / n, 1e-300)) + ln(n) * {k + 1} AS bic FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM oc)" for k in range(1, SIEVE + 1))
_SIEVE = f"""WITH RECURSIVE {S}, l AS (SELECT *, {', '.join(f'lag(v, {j}) OVER (PARTITION BY series_id ORDER BY t) AS p{j}' for j in range(1, SIEVE + 1))} FROM s),
ic AS (SELECT * FROM l WHERE t >= {SIEVE}), {ols_sql("oc", "ic", ["v"], _LAGS)},
bic AS ({_BIC}), pick AS (SELECT series_id, min_by(k, (bic, k)) AS p FROM bic GROUP BY 1),
{_SIEVE_FITS},
every AS ({" UNION ALL ".join(f"SELECT series_id, {k} AS k, t - {k} AS i, c_v, {', '.join(f'b_v_p{j}' if j <= k else f'0.0::DOUBLE AS b_v_p{j}' for j in range(1, SIEVE + 1))}, e_v FROM o{k}" for k in range(1, SIEVE + 1))}),
fit AS (SELECT every.*, p FROM every JOIN pick ON pick.series_id = every.series_id AND every.k = p),
f AS (SELECT DISTINCT series_id, p, c_v, {', '.join(f'b_v_p{j}' for j in range(1, SIEVE + 1))} FROM fit),
z AS (SELECT s.series_id, slot, p, count(*) - p AS m FROM s JOIN pick ON pick.series_id = s.series_id GROUP BY 1, 2, 3),
q AS (SELECT z.*, b, k4 FROM z, range({PATHS}) r(b), range((SELECT max(m) // 4 + 1 FROM z)) k(k4) WHERE k4 * 4 < m),
{philox.sql("q", ["k4", "b", "slot", str(philox.RESIDUAL)], SEED)}, d AS ({_spread("ph", "h")}),
nu AS (SELECT d.series_id, b, h + d.p AS t, e_v AS e FROM d JOIN fit ON fit.series_id = d.series_id AND fit.i = CAST((d.w * d.m::UBIGINT) >> 32 AS BIGINT) WHERE h < m),
x AS (SELECT s.series_id, b, s.t, v AS y1, {', '.join(f'coalesce(p{j - 1}, 0.0) AS y{j}' for j in range(2, SIEVE + 1))} FROM l s JOIN f ON f.series_id = s.series_id, range({PATHS}) r(b) WHERE s.t = p - 1
  UNION ALL SELECT x.series_id, x.b, x.t + 1, c_v + {' + '.join(f'b_v_p{j} * y{j}' for j in range(1, SIEVE + 1))} + nu.e, {', '.join(f'y{j - 1}' for j in range(2, SIEVE + 1))} FROM x JOIN nu ON nu.series_id = x.series_id AND nu.b = x.b AND nu.t = x.t + 1 JOIN f ON f.series_id = x.series_id),
own AS (SELECT s.series_id, b, s.t, v AS y1 FROM s JOIN f ON f.series_id = s.series_id, range({PATHS}) r(b) WHERE s.t < p - 1 UNION ALL SELECT series_id, b, t, y1 FROM x)
SELECT series_id, CAST(b AS INTEGER) AS b, CAST(t AS INTEGER) AS t, 0 AS dim, {r('y1', 'v')} FROM own"""
query("sieve_paths", _SIEVE)(_paths(SieveAR(max_lag=SIEVE)))

_Y, _YLAGS = ["v0", "v1", "v2"], [f"{v}_{j}" for j in (1, 2) for v in ("v0", "v1", "v2")]
_VAR = f"""WITH RECURSIVE h AS (SELECT date_trunc('hour', ts) AS hour, {', '.join(f"CAST(count(*) FILTER (event_type = '{e}') AS DOUBLE) AS v{i}" for i, e in enumerate(("click", "view", "purchase")))} FROM events GROUP BY 1),
s AS (SELECT 0::BIGINT AS series_id, 0::BIGINT AS slot, row_number() OVER (ORDER BY hour) - 1 AS t, v0, v1, v2 FROM h),
l AS (SELECT *, {', '.join(f'lag({v}, {j}) OVER (ORDER BY t) AS {v}_{j}' for j in (1, 2) for v in _Y)} FROM s), li AS (SELECT * FROM l WHERE t >= 2),
{ols_sql("o", "li", _Y, _YLAGS)},
f AS (SELECT DISTINCT {', '.join([f'c_{v}' for v in _Y] + [f'b_{v}_{x}' for v in _Y for x in _YLAGS])} FROM o),
z AS (SELECT series_id, slot, count(*) - 2 AS m FROM s GROUP BY 1, 2),
q AS (SELECT z.*, b, k4 FROM z, range(50) r(b), range((SELECT max(m) // 4 + 1 FROM z)) k(k4) WHERE k4 * 4 < m),
{philox.sql("q", ["k4", "b", "slot", str(philox.RESIDUAL)], SEED)}, d AS ({_spread("ph", "h")}),
nu AS (SELECT b, h + 2 AS t, e_v0, e_v1, e_v2 FROM d JOIN o ON o.t - 2 = CAST((d.w * d.m::UBIGINT) >> 32 AS BIGINT) WHERE h < m),
x AS (SELECT b, t, {', '.join(_Y)}, {', '.join(f'{v}_1 AS {v}_p' for v in _Y)} FROM l, range(50) r(b) WHERE t = 1
  UNION ALL SELECT x.b, x.t + 1, {', '.join(f'c_{v} + e_{v} + ' + ' + '.join([f'b_{v}_{y}_1 * x.{y}' for y in _Y] + [f'b_{v}_{y}_2 * x.{y}_p' for y in _Y]) for v in _Y)}, {', '.join(f'x.{v}' for v in _Y)} FROM x JOIN nu ON nu.b = x.b AND nu.t = x.t + 1, f),
own AS (SELECT b, t, v0, v1, v2 FROM s, range(50) r(b) WHERE t = 0 UNION ALL SELECT b, t, v0, v1, v2 FROM x)
SELECT 0::BIGINT AS series_id, CAST(b AS INTEGER) AS b, CAST(t AS INTEGER) AS t, CAST(dim AS INTEGER) AS dim, {r('v', 'v')} FROM (SELECT b, t, unnest([0, 1, 2]) AS dim, unnest([v0, v1, v2]) AS v FROM own)"""
query("var_paths", _VAR)(_paths(ResidualBootstrap(VAR(order=2)), 50, hourly))


@query("arima_paths")
def arima_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = read(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum(F.col("o_totalprice").cast("double") / 1e6).alias("v"))
    return _paths(ResidualBootstrap(ARIMA(order=(1, 1, 1))), 20, lambda s, d: from_frame(daily, "v", order="month", check=False))(spark, sf_dir)


# ---- conformal --------------------------------------------------------------------------------------------------------------


def residual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, pos, r: deviations from the mean of each series."""
    rows = points(spark, sf_dir)
    return rows.select("series_id", F.col("t").alias("pos"), (F.col("v") - F.avg("v").over(Window.partitionBy("series_id"))).alias("r"))


_R = f"{S}, e AS (SELECT series_id, t AS pos, v - avg(v) OVER (PARTITION BY series_id) AS r FROM s)"


@query("static_width", f"WITH {_R} SELECT series_id, {r(f'quantile_cont(abs(r), {1 - ALPHA})', 'width')} FROM e GROUP BY 1")
def static_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(conformal.static_frame(residual_rows(spark, sf_dir), ALPHA))


@query("sliding_width", f"WITH {_R} SELECT series_id, pos, {r(f'quantile_cont(abs(r), {1 - ALPHA}) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 'width')} FROM e")
def sliding_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(conformal.sliding_frame(residual_rows(spark, sf_dir), ALPHA, 20))


@query("nexcp_width", f"WITH {_R}, w AS (SELECT series_id, pos, abs(r) AS s, pow(0.97, max(pos) OVER (PARTITION BY series_id) - pos) AS w FROM e), u AS (SELECT series_id, s, sum(w) OVER (PARTITION BY series_id ORDER BY s, pos) AS upto, sum(w) OVER (PARTITION BY series_id) AS total FROM w) SELECT series_id, {r('min(s)', 'width')} FROM u WHERE upto >= {1 - ALPHA} * total GROUP BY 1")
def nexcp_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(conformal.nexcp_frame(residual_rows(spark, sf_dir), ALPHA, 0.97))


_ACI = f"""WITH RECURSIVE {_R}, cs AS (SELECT series_id, list(abs(r) ORDER BY abs(r)) FILTER (pos < 20) AS cs, list(abs(r) ORDER BY pos) FILTER (pos >= 20) AS line FROM e GROUP BY 1),
f AS (SELECT series_id, cs, line, 1 AS i, CAST({ALPHA} AS DOUBLE) AS level FROM cs WHERE len(line) > 0
 UNION ALL SELECT series_id, cs, line, i + 1, level + 0.05::DOUBLE * ({ALPHA}::DOUBLE - CASE WHEN line[i] > CASE WHEN level <= 0 THEN 'inf'::DOUBLE WHEN level >= 1 THEN 0.0::DOUBLE ELSE cs[CAST(floor((1 - level) * (len(cs) - 1)) AS INTEGER) + 1] + (cs[least(CAST(floor((1 - level) * (len(cs) - 1)) AS INTEGER) + 2, len(cs))] - cs[CAST(floor((1 - level) * (len(cs) - 1)) AS INTEGER) + 1]) * ((1 - level) * (len(cs) - 1) - floor((1 - level) * (len(cs) - 1))) END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM f WHERE i < len(line))
SELECT series_id, CAST(i + 19 AS INTEGER) AS pos, {r('greatest(least(level, 1.0), 0.0)', 'level')} FROM f"""


@query("aci_levels", _ACI)
def aci_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = residual_rows(spark, sf_dir)
    return named(conformal.aci_frame(rows.where("pos < 20"), rows.where("pos >= 20"), ALPHA, 0.05), "series_id", "pos", "level")


GAMMAS = (0.0, 0.01, 0.05)
_K = range(len(GAMMAS))


def _width_sql(level: str) -> str:
    """The calibration scores' quantile at 1 - level; cs is sorted."""
    h = f"((1 - {level}) * (len(cs) - 1))"
    at = f"CAST(floor({h}) AS INTEGER)"
    return f"CASE WHEN {level} <= 0 THEN 'inf'::DOUBLE WHEN {level} >= 1 THEN 0.0::DOUBLE ELSE cs[{at} + 1] + (cs[least({at} + 2, len(cs))] - cs[{at} + 1]) * ({h} - floor({h})) END"


def _each(pattern: str, between: str = ", ") -> str:
    return between.join(pattern.format(k=k) for k in _K)


_AGACI = f"""WITH RECURSIVE {_R}, c AS (SELECT series_id, list(abs(r) ORDER BY abs(r)) FILTER (pos < 20) AS cs, list(r ORDER BY pos) FILTER (pos >= 20) AS line FROM e GROUP BY 1),
lv AS (SELECT series_id, cs, line, 1 AS i, {', '.join(f'CAST({ALPHA} AS DOUBLE) AS l{k}' for k in _K)} FROM c WHERE len(line) > 0
  UNION ALL SELECT series_id, cs, line, i + 1, {', '.join(f'l{k} + {g}::DOUBLE * ({ALPHA}::DOUBLE - CASE WHEN abs(line[i]) > {_width_sql(f"l{k}")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)' for k, g in enumerate(GAMMAS))} FROM lv WHERE i < len(line)),
w AS (SELECT series_id, i, line[i] AS seen, {', '.join(f'{_width_sql(f"l{k}")} AS w{k}' for k in _K)} FROM lv),
sc AS (SELECT series_id, 10 * greatest({_each("coalesce(max(w{k}) FILTER (isfinite(w{k})), 0.0)")}, max(abs(seen))) AS top FROM w GROUP BY 1),
x AS (SELECT w.series_id, side, i, seen, CASE side WHEN -1 THEN {ALPHA / 2}::DOUBLE ELSE {1 - ALPHA / 2}::DOUBLE END AS tau, {_each("side * CASE WHEN isfinite(w{k}) THEN w{k} ELSE top END AS o{k}")} FROM w JOIN sc ON sc.series_id = w.series_id, (VALUES (-1), (1)) d(side)),
boa AS (SELECT series_id, side, 0 AS i, 0.0::DOUBLE AS given, {_each("0.0::DOUBLE AS r{k}, 0.0::DOUBLE AS e{k}")} FROM c, (VALUES (-1), (1)) d(side) WHERE len(line) > 0
  UNION ALL SELECT series_id, side, i, given, {_each("r{k} + CASE WHEN n{k} > 0 THEN g{k} - g{k} * g{k} / sqrt(n{k}) ELSE 0.0 END, n{k}")}
  FROM (SELECT *, {_each("e{k} + 2.2::DOUBLE * g{k} * g{k} AS n{k}")}
  FROM (SELECT *, {_each("(CASE WHEN seen < given THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - tau) * (given - o{k}) AS g{k}")}
  FROM (SELECT *, ({_each("o{k} * m{k}", " + ")}) / ({_each("m{k}", " + ")}) AS given
  FROM (SELECT *, {_each(f"CASE WHEN e{{k}} > 0 THEN ({_each('(e{k} > 0)::INTEGER', ' + ')}) * h{{k}} / ({_each('h{k}', ' + ')}) ELSE 1.0::DOUBLE END AS m{{k}}")}
  FROM (SELECT *, {_each("CASE WHEN e{k} > 0 THEN exp(a{k} - greatest(" + _each("a{k}") + ")) ELSE 0.0 END AS h{k}")}
  FROM (SELECT x.*, {_each("r{k}, e{k}, CASE WHEN e{k} > 0 THEN r{k} / sqrt(e{k}) - 0.5 * ln(e{k}) ELSE '-inf'::DOUBLE END AS a{k}")} FROM boa JOIN x ON x.series_id = boa.series_id AND x.side = boa.side AND x.i = boa.i + 1)))))))
SELECT series_id, CAST(i + 19 AS INTEGER) AS pos, {r("-max(given) FILTER (side = -1)", "lower")}, {r("max(given) FILTER (side = 1)", "upper")} FROM boa WHERE i > 0 GROUP BY 1, 2"""


@query("agaci_bounds", _AGACI)
def agaci_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = residual_rows(spark, sf_dir)
    return named(conformal.agaci_frame(rows.where("pos < 20"), rows.where("pos >= 20"), ALPHA, AgACI(gammas=GAMMAS, require_signed=False)))


_LAGGED = S.replace("s AS", "s0 AS", 1) + ", s AS (SELECT series_id, slot, CAST(t - 1 AS INTEGER) AS t, v, p FROM (SELECT *, lag(v) OVER (PARTITION BY series_id ORDER BY t) AS p FROM s0) WHERE p IS NOT NULL)"
_ENSEMBLE = f"""WITH {block_index_sql("n - len + 1", b=20, source=_LAGGED)},
f AS (SELECT ix.series_id, ix.b, regr_intercept(v, p) AS c, regr_slope(v, p) AS k FROM ix JOIN s ON s.series_id = ix.series_id AND s.t = ix.idx GROUP BY 1, 2),
o AS (SELECT series_id, b, t FROM ix EXCEPT SELECT series_id, b, idx FROM ix),
g AS (SELECT s.series_id, s.t, any_value(v) AS v, avg(c + k * p) AS pred FROM o JOIN s ON s.series_id = o.series_id AND s.t = o.t JOIN f ON f.series_id = o.series_id AND f.b = o.b GROUP BY 1, 2),
w AS (SELECT series_id, quantile_cont(abs(v - pred), {1 - ALPHA}) AS w FROM g GROUP BY 1)
SELECT g.series_id, t, {r('pred - w', 'lower')}, {r('pred + w', 'upper')}, {r('pred', 'point')} FROM g JOIN w ON w.series_id = g.series_id"""


@query("enbpi_intervals", _ENSEMBLE)
def enbpi_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = panel(spark, sf_dir).scalar()
    lag = F.lag("v").over(Window.partitionBy("series_id").orderBy("t"))
    rows = s.select("series_id", "slot", "t", F.col("v").alias("y"), lag.alias("p")).where("p is not null").select("series_id", "slot", (F.col("t") - 1).alias("t"), "y", F.array("p").alias("z"))
    return named(conformal.intervals(conformal.fit_ensemble(rows, MovingBlock(LENGTH), 20, SEED), ALPHA))
