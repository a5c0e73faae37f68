"""One query per operator, on whole tables, and its SQL for DuckDB where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.hashing import draw_sql, uniform_sql
from emberline.operators import cluster, density, ensemble, local, order, sequence, stats
from emberline.plans import dag, detectors, pinned
from emberline.session import work_folder
from emberline.sources import tables
from emberline.spec import DEFAULT, FOURTEEN, FeatureSpec

SPEC = FeatureSpec()
Z2 = ["z_value", "z_ugap_s"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# -- SQL that many queries start from --------------------------------------------------------------------------------
TELEMETRY = """f AS (SELECT event_id AS id, value::DOUBLE AS value,
  coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY event_id)) / 1e6, 0.0) AS gap_s,
  coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6, 0.0) AS ugap_s,
  (props ->> '$.k')::DOUBLE AS k FROM events)"""


def _moments(columns, of: str = "f", name: str = "m") -> str:
    return f"{name} AS (SELECT " + ", ".join(f"round(avg({c}), 9) AS m_{c}, round(stddev_pop({c}), 9) AS p_{c}, round(stddev_samp({c}), 9) AS s_{c}" for c in columns) + f" FROM {of})"


def _z(columns, of: str = "f", centre: bool = True) -> str:
    return f"{_moments(columns, of)}, z AS (SELECT {of}.*, " + ", ".join(f"CASE WHEN s_{c} > 0 THEN ({c}{f' - m_{c}' if centre else ''}) / s_{c} ELSE 0.0 END AS z_{c}" for c in columns) + f" FROM {of}, m)"


def _above(score: str, n: float, of: str) -> str:
    return f"({score} > (SELECT round(avg({score}), 9) + {n} * round(stddev_pop({score}), 9) FROM {of}))"


FEATURES = SPEC.features
Z = f"WITH {TELEMETRY}, {_z(FEATURES)}"
FAR = "greatest(" + ", ".join(f"abs(({c} - m_{c}) / greatest(p_{c}, 1e-10))" for c in FEATURES) + ")"
GRID = f"g AS (SELECT t.t AS threshold, count(*) FILTER (WHERE d.far > t.t)::BIGINT AS n_above, count(*)::BIGINT AS n_rows FROM (SELECT round(2.0 + i / 10.0, 1)::DOUBLE AS t FROM range(21) r(i)) t, d GROUP BY 1)"
CLUSTERED = "c AS (SELECT id, least(floor(value / 20), 9)::INT AS cluster FROM f)"
MINORITY = "(SELECT cluster FROM (SELECT cluster, count(*) AS n FROM c GROUP BY 1) ORDER BY n, cluster LIMIT 1)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.telemetry(tables.table(spark, sf_dir, "events"))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.standardise(telemetry(spark, sf_dir).cache(), SPEC)


# -- projection, statistics, flags -----------------------------------------------------------------------------------


@query("SELECT event_id AS id, value::DOUBLE AS value, event_type FROM events WHERE value > 10")
def project_features(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").where("value > 10").select(F.col("event_id").alias("id"), F.col("value").cast("double").alias("value"), "event_type")


@query(f"WITH {TELEMETRY} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n_rows, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c}) + 0.0 AS min, max({c}) + 0.0 AS max FROM f" for c in FEATURES))
def feature_stats(spark, sf_dir):
    return stats.feature_stats(telemetry(spark, sf_dir), SPEC)


@query(Z + " SELECT id, " + ", ".join(f"round(z_{c}, 6) AS z_{c}" for c in FEATURES) + " FROM z")
def zscore_features(spark, sf_dir):
    return scaled(spark, sf_dir).select("id", *(F.round(z, 6).alias(z) for z in SPEC.z))


@query(f"WITH {TELEMETRY} SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM f")
def score_stats(spark, sf_dir):
    return telemetry(spark, sf_dir).agg(F.round(F.mean("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.count("*").alias("n"))


@query(Z + f" SELECT id, {_above('z_value', 2.0, 'z')}::INT AS value_flag FROM z")
def threshold_flag(spark, sf_dir):
    return stats.above(scaled(spark, sf_dir), "z_value", "value_flag", 2.0).select("id", "value_flag")


@query(f"WITH {TELEMETRY}, s AS (SELECT id, CASE WHEN id % 10 <> 0 THEN value END AS score FROM f) SELECT id, {_above('score', 1.0, 's')}::INT AS strict_flag, CASE WHEN {_above('score', 1.0, 's')} THEN 1 ELSE 0 END AS zero_flag FROM s")
def case_flag(spark, sf_dir):
    rows = telemetry(spark, sf_dir).withColumn("score", F.when(F.col("id") % 10 != 0, F.col("value")))
    return stats.above_or_zero(stats.above(rows, "score", "strict_flag", 1.0), "score", "zero_flag", 1.0).select("id", "strict_flag", "zero_flag")


@query(Z + f" SELECT id, ({FAR} > 3.0)::INT AS static_flag FROM z, m")
def static_z(spark, sf_dir):
    return stats.static_z(telemetry(spark, sf_dir), SPEC).select("id", "static_flag")


@query(f"WITH {TELEMETRY}, {_moments(FEATURES)}, d AS (SELECT id, {FAR} AS far FROM f, m), {GRID} SELECT * FROM g")
def threshold_grid(spark, sf_dir):
    return stats.threshold_grid(telemetry(spark, sf_dir), SPEC)


@query(f"WITH {TELEMETRY}, {_moments(FEATURES)}, d AS (SELECT id, {FAR} AS far FROM f, m), {GRID}, t AS (SELECT threshold FROM g ORDER BY round(abs(n_above / n_rows - 0.05), 9), threshold LIMIT 1) SELECT id, (far > threshold)::INT AS adaptive_flag FROM d, t")
def adaptive_threshold(spark, sf_dir):
    return stats.adaptive(telemetry(spark, sf_dir), SPEC, 0.05).select("id", "adaptive_flag")


@query(f"WITH {TELEMETRY} SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN 1 END, 0) AS a_flag, coalesce(CASE WHEN id % 4 = 0 THEN 1 END, 0) AS b_flag FROM f")
def fill_flags(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, 1).alias("a_flag"), F.when(F.col("id") % 4 == 0, 1).alias("b_flag"))
    return rows.fillna({"a_flag": 0, "b_flag": 0})


def _clustered(spark, sf_dir):
    return telemetry(spark, sf_dir).select("id", F.least(F.floor(F.col("value") / 20), F.lit(9)).cast("int").alias("cluster"))


@query(f"WITH {TELEMETRY}, {CLUSTERED} SELECT cluster, count(*) AS n FROM c GROUP BY cluster")
def cluster_sizes(spark, sf_dir):
    return _clustered(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"WITH {TELEMETRY}, {CLUSTERED} SELECT id, cluster, (cluster = {MINORITY})::INT AS minority_flag FROM c")
def minority_cluster(spark, sf_dir):
    return stats.in_minority(_clustered(spark, sf_dir), "cluster", "minority_flag")


@query(f"WITH {TELEMETRY} SELECT " + ", ".join(f"round(sqrt(greatest(var_pop({c}), 1e-12)), 6) AS {c}" for c in FEATURES) + " FROM f")
def clamped_std(spark, sf_dir):
    return telemetry(spark, sf_dir).agg(*(F.round(stats.clamped_deviation(c), 6).alias(c) for c in FEATURES))


@query(Z + " " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_pop(z_{a}, z_{b}), 6) + 0.0 AS covariance FROM z" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i <= j))
def cov_matrix(spark, sf_dir):
    return stats.covariances(scaled(spark, sf_dir), SPEC.z).withColumn("covariance", F.col("covariance") + 0.0)


# -- order, windows, samples -----------------------------------------------------------------------------------------

GAPS = "h AS (SELECT id, CASE WHEN id % 7 <> 3 AND id > 2 AND id < (SELECT max(id) - 2 FROM f) THEN value END AS value, CASE WHEN id % 11 <> 5 THEN ugap_s END AS ugap_s, row_number() OVER (ORDER BY id) AS rn FROM f)"


def _gaps(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    last = rows.agg(F.max("id")).first()[0] or 0
    return rows.select("id", F.when((F.col("id") % 7 != 3) & (F.col("id") > 2) & (F.col("id") < last - 2), F.col("value")).alias("value"), F.when(F.col("id") % 11 != 5, F.col("ugap_s")).alias("ugap_s"))


def _line(c: str) -> str:
    before, after = "(ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "(ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = f"CASE WHEN {c} IS NOT NULL THEN rn END"
    b, a, bn, an = f"last_value({c} IGNORE NULLS) OVER {before}", f"first_value({c} IGNORE NULLS) OVER {after}", f"last_value({at} IGNORE NULLS) OVER {before}", f"first_value({at} IGNORE NULLS) OVER {after}"
    return f"round(CASE WHEN {c} IS NOT NULL THEN {c} WHEN {b} IS NULL THEN {a} WHEN {a} IS NULL THEN {b} ELSE {b} + ({a} - {b}) * (rn - {bn}) / ({an} - {bn}) END, 8) AS {c}"


@query(f"WITH {TELEMETRY}, {GAPS} SELECT id, {_line('value')}, {_line('ugap_s')} FROM h")
def interpolate_gaps(spark, sf_dir):
    return sequence.repair(_gaps(spark, sf_dir).cache(), "id", ["value", "ugap_s"]).select("id", F.round("value", 8).alias("value"), F.round("ugap_s", 8).alias("ugap_s"))


@query(f"WITH {TELEMETRY}, {GAPS} SELECT 'value' AS feature, count(*) FILTER (WHERE value IS NULL) AS n_missing FROM h UNION ALL SELECT 'ugap_s', count(*) FILTER (WHERE ugap_s IS NULL) FROM h")
def missing_counts(spark, sf_dir):
    return sequence.missing(_gaps(spark, sf_dir), ["value", "ugap_s"])


@query("SELECT event_id AS id, row_number() OVER (ORDER BY event_id) AS rn FROM events")
def seq_number(spark, sf_dir):
    return order.numbered(tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), "id")


SHARDED = "s AS (SELECT *, floor((row_number() OVER (ORDER BY id) - 1) / greatest(1, ceil((SELECT count(*) FROM f) / 3.0)))::INT AS _shard FROM f)"


@query(f"WITH {TELEMETRY}, {SHARDED} SELECT id, _shard FROM s")
def seq_shards(spark, sf_dir):
    return sequence.seq_shards(telemetry(spark, sf_dir).select("id"), "id", 3)


WINDOWED = "w AS (SELECT id, value, CASE WHEN count(*) OVER o = 5 THEN round(avg(value) OVER o, 6) END AS score FROM s WINDOW o AS (PARTITION BY _shard ORDER BY id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"


def _windowed(spark, sf_dir):
    rows = sequence.windows(sequence.seq_shards(telemetry(spark, sf_dir).select("id", "value"), "id", 3, "_rn"), "id", ["value"], 5, position="_rn")
    mean = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0]) / 5
    return rows.where("window is not null").select("id", F.round(mean, 6).alias("score"))


@query(f"WITH {TELEMETRY}, {SHARDED}, {WINDOWED} SELECT id, score FROM w WHERE score IS NOT NULL")
def sliding_windows(spark, sf_dir):
    return _windowed(spark, sf_dir)


@query(f"WITH {TELEMETRY}, {SHARDED}, {WINDOWED} SELECT id, value, score FROM w")
def seq_left_join(spark, sf_dir):
    return telemetry(spark, sf_dir).select("id", "value").join(_windowed(spark, sf_dir), "id", "left")


@query(f"SELECT event_id AS id, ({draw_sql('shard42', 'event_id')} % 4)::INT AS _shard FROM events")
def row_shards(spark, sf_dir):
    return sequence.row_shards(tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), "id", 4)


@query(f"SELECT _shard, count(*) AS n FROM (SELECT ({draw_sql('shard42', 'event_id')} % 4)::INT AS _shard FROM events) GROUP BY 1")
def shard_counts(spark, sf_dir):
    return row_shards(spark, sf_dir).groupBy("_shard").agg(F.count("*").alias("n"))


@query(f"SELECT event_id AS id, value FROM events ORDER BY {draw_sql('sample42', 'event_id')}, event_id LIMIT 500")
def hash_sample(spark, sf_dir):
    return sequence.hash_sample(tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value"), "id", 500)


@query("SELECT DISTINCT user_id FROM events")
def distinct_keys(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select("user_id").dropDuplicates(["user_id"])


@query("SELECT event_id AS id, value FROM events ORDER BY event_id")
def total_sort(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value").orderBy("id")


# -- ensembles -------------------------------------------------------------------------------------------------------

VOTES = f"""{Z}, {CLUSTERED}, d AS (SELECT id, {FAR} AS far FROM f, m), {GRID},
t AS (SELECT threshold FROM g ORDER BY round(abs(n_above / n_rows - 0.05), 9), threshold LIMIT 1),
j AS (SELECT z.id, z.value, (d.far > 3.0)::INT AS static_flag, (d.far > t.threshold)::INT AS adaptive_flag,
  {_above('z_value', 2.0, 'z')}::INT AS value_flag, (c.cluster = {MINORITY})::INT AS minority_flag
  FROM z JOIN d ON z.id = d.id JOIN c ON z.id = c.id, t),
v AS (SELECT *, static_flag + adaptive_flag + value_flag + minority_flag AS vote FROM j)"""
FLAGS = ["static_flag", "adaptive_flag", "value_flag", "minority_flag"]
VOTED = "id, value, static_flag, adaptive_flag, value_flag, minority_flag, vote, (vote >= 1)::INT AS ensemble"


def _joined(spark, sf_dir):
    rows = scaled(spark, sf_dir)
    found = {
        "static": (stats.static_z(rows, SPEC), "static_flag"),
        "adaptive": (stats.adaptive(rows, SPEC, 0.05), "adaptive_flag"),
        "value": (stats.above(rows, "z_value", "value_flag", 2.0), "value_flag"),
        "minority": (stats.in_minority(_clustered(spark, sf_dir), "cluster", "minority_flag"), "minority_flag"),
    }
    return ensemble.join_flags(rows.select("id", "value"), "id", found)


def _voted(spark, sf_dir):
    return ensemble.vote(_joined(spark, sf_dir), FLAGS)


@query(VOTES + " SELECT id, value, static_flag, adaptive_flag, value_flag, minority_flag FROM j")
def ensemble_join(spark, sf_dir):
    return _joined(spark, sf_dir)


@query(VOTES + f" SELECT {VOTED} FROM v")
def ensemble_vote(spark, sf_dir):
    return _voted(spark, sf_dir)


@query(VOTES + " SELECT sum(static_flag)::BIGINT AS static_flag, sum(adaptive_flag)::BIGINT AS adaptive_flag, sum(value_flag)::BIGINT AS value_flag, sum(minority_flag)::BIGINT AS minority_flag FROM v")
def flag_summary(spark, sf_dir):
    return ensemble.flag_totals(_voted(spark, sf_dir), FLAGS)


@query(VOTES + " SELECT (vote >= 1)::INT AS ensemble, count(*) AS n FROM v GROUP BY 1")
def ensemble_sizes(spark, sf_dir):
    return _voted(spark, sf_dir).groupBy("ensemble").agg(F.count("*").alias("n"))


@query(VOTES + f" SELECT {VOTED} FROM v ORDER BY vote DESC, id LIMIT 10")
def top_anomalies(spark, sf_dir):
    return ensemble.top(_voted(spark, sf_dir), "id")


@query(VOTES + f" SELECT {VOTED}, abs(vote - 2.0)::DOUBLE AS boundary_distance FROM v ORDER BY abs(vote - 2.0), vote DESC, id LIMIT 20")
def explore_exploit(spark, sf_dir):
    return ensemble.explore(_voted(spark, sf_dir), "id", 4, 20)


@query(VOTES + f", e AS (SELECT {VOTED}, abs(vote - 2.0)::DOUBLE AS boundary_distance FROM v) SELECT DISTINCT * FROM ((SELECT * FROM e ORDER BY boundary_distance, vote DESC, id LIMIT 20) UNION ALL (SELECT * FROM e ORDER BY {draw_sql('queue42', 'id')}, id LIMIT 5))")
def exploration_queue(spark, sf_dir):
    return ensemble.exploration_queue(_voted(spark, sf_dir), "id", 4)


# -- clusters and density --------------------------------------------------------------------------------------------


def _distance_sql(columns, centre) -> str:
    return "round(sqrt(0.0" + "".join(f" + ({c} - {x}) * ({c} - {x})" for c, x in zip(columns, centre)) + "), 9)"


def _lloyd_sql(of: str, columns, rounds: int = cluster.ROUNDS) -> str:
    """CTEs of Lloyd's rounds for two centres, the last named last_centres."""
    a, b = ([f"{p}_{c}" for c in columns] for p in "ab")
    parts = [f"l_a AS (SELECT {', '.join(f'{c} AS {x}' for c, x in zip(columns, a))} FROM {of} ORDER BY id LIMIT 1)"]
    parts.append(f"l0 AS (SELECT l_a.*, {', '.join(f'{c} AS {x}' for c, x in zip(columns, b))} FROM {of}, l_a ORDER BY {_distance_sql(columns, a)} DESC, id LIMIT 1)")
    for i in range(1, rounds + 1):
        near = f"{_distance_sql(columns, a)} <= {_distance_sql(columns, b)}"
        means = [f"coalesce(round(avg(CASE WHEN {'' if p == 'a' else 'NOT '}({near}) THEN {c} END), 9), any_value({p}_{c})) AS {p}_{c}" for p in "ab" for c in columns]
        parts.append(f"{'last_centres' if i == rounds else f'l{i}'} AS MATERIALIZED (SELECT {', '.join(means)} FROM {of}, l{i - 1})")
    return ", ".join(parts)


ZC = [f"z_{c}" for c in FEATURES]
NEAR = [_distance_sql(ZC, [f"{p}_{c}" for c in ZC]) for p in "ab"]
KMEANS = f"{Z}, {_lloyd_sql('z', ZC)}, k AS (SELECT id, least({NEAR[0]}, {NEAR[1]}) AS distance, CASE WHEN {NEAR[0]} <= {NEAR[1]} THEN 0 ELSE 1 END AS cluster FROM z, last_centres)"


@query(KMEANS + f" SELECT id, cluster, round(distance, 6) AS distance, {_above('distance', 2.0, 'k')}::INT AS kmeans_flag FROM k")
def kmeans_distance(spark, sf_dir):
    rows = cluster.kmeans(scaled(spark, sf_dir), "id", SPEC.z, 2, "distance", "cluster")
    return stats.above(rows, "distance", "kmeans_flag", 2.0).select("id", "cluster", F.round("distance", 6).alias("distance"), "kmeans_flag")


CENTRES = [[0.0, 0.0], [2.5, 0.5], [0.5, 3.0]]
FIXED = [_distance_sql(Z2, c) for c in CENTRES]


@query(Z + f" SELECT id, round(least({', '.join(FIXED)}), 6) AS distance, CASE WHEN {FIXED[0]} <= least({FIXED[1]}, {FIXED[2]}) THEN 0 WHEN {FIXED[1]} <= {FIXED[2]} THEN 1 ELSE 2 END AS centre FROM z")
def nearest_center(spark, sf_dir):
    far, at = cluster.nearest(Z2, CENTRES)
    return scaled(spark, sf_dir).select("id", F.round(far, 6).alias("distance"), at.alias("centre"))


TRAFFIC = tables.TRAFFIC
TRAFFIC_SPEC = FeatureSpec("id", TRAFFIC)
LITERAL = "f AS (SELECT * FROM (VALUES (1::BIGINT, 500.0::DOUBLE, 12.0::DOUBLE, 0.0::DOUBLE), (2, 512.0, 14.0, 0.0), (3, 490.0, 11.0, 0.0), (4, 9500.0, 120.0, 5.0)) t(id, packet_size, connection_time, failed_logins))"
TC = [f"z_{c}" for c in TRAFFIC]
TNEAR = [_distance_sql(TC, [f"{p}_{c}" for c in TC]) for p in "ab"]


def _micro_sql(rows: str) -> str:
    return f"WITH {rows}, {_z(TRAFFIC, centre=False)}, {_lloyd_sql('z', TC)}, k AS (SELECT id, CASE WHEN {TNEAR[0]} <= {TNEAR[1]} THEN 0 ELSE 1 END AS cluster FROM z, last_centres) SELECT id, cluster, CASE WHEN count(*) OVER (PARTITION BY cluster) = 1 THEN 1 ELSE 0 END AS micro_flag FROM k"


def _micro(rows: DataFrame) -> DataFrame:
    z = stats.standardise(rows, TRAFFIC_SPEC, centre=False)
    return cluster.micro_clusters(cluster.kmeans(z, "id", TRAFFIC_SPEC.z, 2, "distance", "cluster"), "cluster", "micro_flag").select("id", "cluster", "micro_flag")


@query(_micro_sql(LITERAL))
def micro_cluster_literal(spark, sf_dir):
    return _micro(tables.literal_traffic(spark))


def _synthetic_sql() -> str:
    bounds = {"packet_size": (6000, 4000, 400, 200, 10), "connection_time": (60, 80, 5, 20, 1), "failed_logins": (3, 5, 0, 1, 0)}
    return "SELECT id, " + ", ".join(f"greatest(floor(CASE WHEN id <= 250 THEN {a} + {uniform_sql(c, 'id')} * {b} ELSE {x} + {uniform_sql(c, 'id')} * {y} END + 0.5), {least})::DOUBLE AS {c}" for c, (a, b, x, y, least) in bounds.items()) + " FROM range(1, 5001) r(id)"


@query(_synthetic_sql())
def synth_traffic(spark, sf_dir):
    return tables.synthetic_traffic(spark)


@query(_micro_sql(f"f AS ({_synthetic_sql()})"))
def micro_cluster(spark, sf_dir):
    return _micro(tables.synthetic_traffic(spark))


@query(f"{Z}, s AS (SELECT id, z_value AS x, z_ugap_s AS y FROM z ORDER BY {draw_sql('eps42', 'id')}, id LIMIT 500), p AS (SELECT a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS r FROM s a, s b) SELECT round(quantile_cont(d, 0.97), 5) AS eps FROM p WHERE r = 6")
def kdist_percentile(spark, sf_dir):
    eps = density.estimate_eps(scaled(spark, sf_dir), "id", Z2, 6, 0.97, 500)
    return spark.range(1).select(F.round(F.lit(eps), 5).alias("eps"))


@query(f"{Z}, n AS (SELECT a.id, count(*) AS n FROM z a, z b WHERE 0.0 + (a.z_value - b.z_value) * (a.z_value - b.z_value) + (a.z_ugap_s - b.z_ugap_s) * (a.z_ugap_s - b.z_ugap_s) <= 0.1::DOUBLE * 0.1::DOUBLE GROUP BY a.id), core AS (SELECT z.* FROM z JOIN n ON z.id = n.id WHERE n.n >= 6), near AS (SELECT DISTINCT a.id FROM z a, core b WHERE 0.0 + (a.z_value - b.z_value) * (a.z_value - b.z_value) + (a.z_ugap_s - b.z_ugap_s) * (a.z_ugap_s - b.z_ugap_s) <= 0.1::DOUBLE * 0.1::DOUBLE) SELECT z.id, (near.id IS NULL)::INT AS dbscan_flag FROM z LEFT JOIN near ON z.id = near.id")
def dbscan_noise(spark, sf_dir):
    return density.noise(scaled(spark, sf_dir), "id", Z2, 0.1, 6, "dbscan_flag").select("id", "dbscan_flag")


@query("WITH p AS (SELECT event_id AS id, (event_id % 10) / 20.0 AS a FROM events) SELECT id, round(-ln(greatest(a, 1 - a) + 1e-12), 6) + 0.0 AS energy FROM p")
def membership_energy(spark, sf_dir):
    a = (F.col("event_id") % 10) / 20.0
    return tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.round(cluster.energy(F.array(a, 1 - a)), 6) + 0.0).alias("energy"))


# -- text sources ----------------------------------------------------------------------------------------------------

LINES = "l AS (SELECT event_id AS id, concat_ws(',', event_id::VARCHAR, CASE WHEN event_id % 5 = 0 THEN '' ELSE floor(value)::BIGINT::VARCHAR END, (user_id % 100)::VARCHAR) AS line FROM events)"


def _lines(spark, sf_dir):
    blank = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.floor("value").cast("string"))
    return tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat_ws(",", F.col("event_id").cast("string"), blank, (F.col("user_id") % 100).cast("string")).alias("line"))


@query(f"WITH {LINES} SELECT id, try_cast(nullif(string_split(line, ',')[1], '') AS DOUBLE) AS a, try_cast(nullif(string_split(line, ',')[2], '') AS DOUBLE) AS b, try_cast(nullif(string_split(line, ',')[3], '') AS DOUBLE) AS c FROM l")
def load_csv_positional(spark, sf_dir):
    return tables.parse_positional(_lines(spark, sf_dir), "line", ["a", "b", "c"]).drop("line")


@query(f"WITH {LINES} SELECT id, try_cast(regexp_extract_all(line, '[^,]+')[1] AS DOUBLE) AS a, try_cast(regexp_extract_all(line, '[^,]+')[2] AS DOUBLE) AS b, try_cast(regexp_extract_all(line, '[^,]+')[3] AS DOUBLE) AS c FROM l")
def load_csv_by_pattern(spark, sf_dir):
    return tables.parse_by_pattern(_lines(spark, sf_dir), "line", ["a", "b", "c"]).drop("line")


# -- components, merged models, one projection, the graph of steps ----------------------------------------------------


def _lloyd_k(of: str, columns, k: int, name: str, by: str = "0", rounds: int = cluster.ROUNDS, digits: int = stats.DIGITS) -> str:
    """CTEs of Lloyd's rounds for k centres in each group, the last named so; centre j's columns are c{j}_<column>."""
    held = lambda n: ", ".join(f"any_value(c{j}_{c}) AS c{j}_{c}" for j in range(n) for c in columns)
    far = lambda n: [_distance_sql(columns, [f"c{j}_{c}" for c in columns]) for j in range(n)]
    joined = lambda before: f"{of} JOIN {before} ON {by} = grp GROUP BY grp"
    parts = [f"{name}_s0 AS MATERIALIZED (SELECT {by} AS grp, {', '.join(f'first({c} ORDER BY id) AS c0_{c}' for c in columns)} FROM {of} GROUP BY 1)"]
    for n in range(1, k):
        least = f"least({', '.join(far(n))})"
        parts.append(f"{name}_s{n} AS MATERIALIZED (SELECT grp, {held(n)}, {', '.join(f'first({c} ORDER BY {least} DESC, id) AS c{n}_{c}' for c in columns)} FROM {joined(f'{name}_s{n - 1}')})")
    before = f"{name}_s{k - 1}"
    for i in range(1, rounds + 1):
        new = name if i == rounds else f"{name}_r{i}"
        means = ", ".join(f"coalesce(round(avg({c}) FILTER (WHERE near = {j}), {digits}), any_value(c{j}_{c})) AS c{j}_{c}" for j in range(k) for c in columns)
        parts.append(f"{new} AS MATERIALIZED (SELECT grp, {means} FROM (SELECT *, {_nearest_sql(columns, k)} AS near FROM {of} JOIN {before} ON {by} = grp) GROUP BY grp)")
        before = new
    return ", ".join(parts)


def _nearest_sql(columns, k: int) -> str:
    far = [_distance_sql(columns, [f"c{j}_{c}" for c in columns]) for j in range(k)]
    return "CASE " + " ".join(f"WHEN {d} <= least({', '.join(far)}) THEN {j}" for j, d in enumerate(far)) + " END"


def _axis_sql(of: str, name: str, d: int) -> str:
    """CTEs of the main axis of a matrix of columns m{i}{j}, i <= j, by squaring; ``name`` has x0.. and the value."""
    m = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    squared = ", ".join("(" + " + ".join(f"{m(i, q)} * {m(q, j)}" for q in range(d)) + f") / trace2 AS {m(i, j)}" for i, j in pairs)
    trace2 = " + ".join(f"{m(i, q)} * {m(q, i)}" for i in range(d) for q in range(d))
    trace = " + ".join(m(i, i) for i in range(d))
    cells = ", ".join(m(i, j) for i, j in pairs)
    scaled_cells = ", ".join(f"{m(i, j)} / ({trace}) AS {m(i, j)}" for i, j in pairs)
    top = f"greatest({', '.join(m(i, i) for i in range(d))})"
    axis = ", ".join("CASE " + " ".join(f"WHEN {m(j, j)} = {top} THEN {m(i, j)} / sqrt({m(j, j)})" for j in range(d)) + f" END AS x{i}" for i in range(d))
    value = " + ".join(f"x{i} * x{j} * {of}.{m(i, j)}" for i in range(d) for j in range(d))
    return (
        f"{name}_p(n, {cells}) AS (SELECT 0, {scaled_cells} FROM {of} UNION ALL SELECT n + 1, {squared} FROM (SELECT *, {trace2} AS trace2 FROM {name}_p) WHERE n < 60), "
        f"{name}_x AS (SELECT {axis} FROM {name}_p WHERE n = 60), {name} AS MATERIALIZED (SELECT {name}_x.*, {value} AS value FROM {name}_x, {of})"
    )


def _components_sql() -> str:
    """CTEs up to ``pc``: rows with the first two components of the z columns."""
    d = len(ZC)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    cov = ", ".join(f"round(covar_pop({ZC[i]}, {ZC[j]}), 9) AS m{i}{j}" for i, j in pairs)
    rest = ", ".join(f"m{i}{j} - value * x{i} * x{j} AS m{i}{j}" for i, j in pairs)
    dots = ", ".join("round(0.0 + " + " + ".join(f"{c} * round({a}.x{i}, 9)" for i, c in enumerate(ZC)) + f", 9) AS pc{n}" for n, a in enumerate(("ax1", "ax2")))
    return f"{Z.replace('WITH ', 'WITH RECURSIVE ', 1)}, cov AS MATERIALIZED (SELECT {cov} FROM z), {_axis_sql('cov', 'ax1', d)}, cov2 AS MATERIALIZED (SELECT {rest} FROM cov, ax1), {_axis_sql('cov2', 'ax2', d)}, pc AS MATERIALIZED (SELECT z.*, {dots} FROM z, ax1, ax2)"


PCS = ["pc0", "pc1"]
PCA = f"{_components_sql()}, {_lloyd_k('pc', PCS, DEFAULT.pca_k, 'pl')}, pk AS (SELECT pc.*, least({', '.join(_distance_sql(PCS, [f'c{j}_{c}' for c in PCS]) for j in range(DEFAULT.pca_k))}) AS pca_distance, {_nearest_sql(PCS, DEFAULT.pca_k)} AS pca_cluster FROM pc, pl)"
RARE = "(SELECT pca_cluster FROM pk GROUP BY 1 ORDER BY count(*), 1 LIMIT 1)"


@query(f"{PCA} SELECT id, pca_distance, pca_cluster, (pca_cluster = {RARE})::INT AS pca_kmeans_flag FROM pk")
def pca_kmeans(spark, sf_dir):
    found = detectors.DETECTORS["pca_kmeans"](detectors.inputs(telemetry(spark, sf_dir), SPEC))
    return found.select("id", "pca_distance", "pca_cluster", "pca_kmeans_flag")


@query(f"{_components_sql()} SELECT id, pc0, pc1 FROM pc")
def components(spark, sf_dir):
    rows = scaled(spark, sf_dir)
    return cluster.project(rows, SPEC.z, cluster.components(rows, SPEC.z, 2)).select("id", *PCS)


FUSED_FLAGS = ["kmeans_flag", "pca_kmeans_flag", "static_flag", "adaptive_flag"]
FUSED = f"""{PCA}, {_lloyd_sql('z', ZC)}, k AS (SELECT id, least({NEAR[0]}, {NEAR[1]}) AS distance FROM z, last_centres),
d AS (SELECT id, {FAR} AS far FROM f, m), {GRID}, t AS (SELECT threshold FROM g ORDER BY round(abs(n_above / n_rows - {DEFAULT.adaptive_target}), 9), threshold LIMIT 1),
j AS (SELECT pk.id, {_above('distance', DEFAULT.n_std['kmeans'], 'k')}::INT AS kmeans_flag, (pca_cluster = {RARE})::INT AS pca_kmeans_flag, (far > {DEFAULT.static_z})::INT AS static_flag, (far > t.threshold)::INT AS adaptive_flag FROM pk JOIN k ON pk.id = k.id JOIN d ON pk.id = d.id, t),
v AS (SELECT *, {' + '.join(FUSED_FLAGS)} AS vote FROM j)"""


@query(f"{FUSED} SELECT *, (vote >= 2)::INT AS ensemble FROM v")
def fused_flags(spark, sf_dir):
    return detectors.fused(detectors.inputs(telemetry(spark, sf_dir), SPEC)).select("id", *FUSED_FLAGS, "vote", "ensemble")


@query(f"{FUSED} SELECT " + ", ".join(f"sum({f})::BIGINT AS {f}" for f in ("kmeans_flag", "pca_kmeans_flag", "adaptive_flag")) + ", sum((kmeans_flag + pca_kmeans_flag + adaptive_flag >= 1)::INT)::BIGINT AS ensemble, count(*) AS n FROM v")
def step_totals(spark, sf_dir):
    """The graph of steps for three detectors, with saved results, up to the totals."""
    steps = dag.anomaly_steps(lambda: telemetry(spark, sf_dir), SPEC, names=["kmeans", "pca_kmeans", "adaptive"])
    return dag.run_steps(spark, steps, work_folder(spark))["totals"]


PARTS = 4
MERGED = f"{Z}, zs AS MATERIALIZED (SELECT *, ({draw_sql('shard42', 'id')} % {PARTS})::INT AS shard FROM z), {_lloyd_k('zs', ZC, 2, 'ls', 'shard')}, cs AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT 2 * grp + {j} AS id, {', '.join(f'c{j}_{c} AS {c}' for c in ZC)} FROM ls" for j in range(2)) + f"), {_lloyd_k('cs', ZC, 2, 'lg', digits=local.MERGED_DIGITS)}, k AS (SELECT z.id, least({', '.join(_distance_sql(ZC, [f'c{j}_{c}' for c in ZC]) for j in range(2))}) AS distance FROM z, lg)"


@query(f"{MERGED} SELECT id, distance, {_above('distance', 3.0, 'k')}::INT AS merged_flag FROM k")
def merged_kmeans(spark, sf_dir):
    rows = scaled(spark, sf_dir).cache()
    far, _ = cluster.nearest(SPEC.z, local.merged_centres(rows, "id", SPEC.z, 2, parts=PARTS))
    return stats.above(rows.withColumn("distance", far), "distance", "merged_flag", 3.0).select("id", "distance", "merged_flag")


@query()
def merged_pca_kmeans(spark, sf_dir):
    rows = scaled(spark, sf_dir).cache()
    rows = cluster.project(rows, SPEC.z, cluster.components(rows, SPEC.z, 2))
    _, at = cluster.nearest(PCS, local.merged_centres(rows, "id", PCS, 2, 4, PARTS))
    return stats.in_minority(rows.withColumn("cluster", at), "cluster", "merged_flag").select("id", "cluster", "merged_flag")


@query()
def local_mixture(spark, sf_dir):
    """1 in the least component of the row's own shard: components of two shards don't correspond."""
    rows = local.hard_mixture_labels(scaled(spark, sf_dir).select("id", *SPEC.z), "id", SPEC.z, 3, "component", PARTS)
    sizes = rows.groupBy("_shard", "component").count().groupBy("_shard").agg(F.min(F.struct("count", "component"))["component"].alias("_least"))
    return rows.join(F.broadcast(sizes), "_shard").select("id", "component", (F.col("component") == F.col("_least")).cast("int").alias("local_flag"))


@query()
def local_forests(spark, sf_dir):
    rows = scaled(spark, sf_dir).cache()
    scores = local.forest_mean(rows, SPEC.z, local.forests(rows, "id", SPEC.z, parts=PARTS), "iso_score")
    return stats.above(scores, "iso_score", "isolation_forest_flag", DEFAULT.n_std["isolation_forest"]).select("id", "iso_score", "isolation_forest_flag")


@query(f"WITH {TELEMETRY} SELECT id, value FROM f")
def spread_rows(spark, sf_dir):
    return local.spread(telemetry(spark, sf_dir).select("id", "value"), PARTS)


# -- networks with given weights -------------------------------------------------------------------------------------

WINDOW_SHARDS = "zw AS (SELECT *, floor((row_number() OVER (ORDER BY id) - 1) / greatest(1, ceil((SELECT count(*) FROM z) / 3.0)))::INT AS _shard FROM z)"
LAGS = [[f"{c}_{n}" for c in ZC] for n in range(pinned.SIZES["window"] - 1, -1, -1)]
LAGGED = "zl AS (SELECT * FROM (SELECT id, " + ", ".join(f"lag({c}, {n}) OVER o AS {c}_{n}" for n in range(pinned.SIZES["window"]) for c in ZC) + f" FROM zw WINDOW o AS (PARTITION BY _shard ORDER BY id)) WHERE {LAGS[0][0]} IS NOT NULL)"


def _pinned(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scaled(spark, sf_dir)
        if pinned.net_is_sequence(name):
            rows = sequence.windows(sequence.seq_shards(rows, "id", 3, "_rn"), "id", SPEC.z, pinned.SIZES["window"], position="_rn")
            rows = rows.where("window is not null").withColumnRenamed("window", "x")
        else:
            rows = rows.withColumn("x", F.array(*SPEC.z))
        return pinned.score(rows, "id", name, len(SPEC.features))

    return run


for _name in pinned.FORWARD:
    QUERIES[f"{_name}_pinned"] = _pinned(_name)
    SQL[f"{_name}_pinned"] = f"{Z}, {WINDOW_SHARDS}, {LAGGED}, {pinned.sql(_name, 'zl', LAGS)}" if pinned.net_is_sequence(_name) else f"{Z}, {pinned.sql(_name, 'z', ZC)}"


# -- detectors without a SQL form ------------------------------------------------------------------------------------


def _detector(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detectors.DETECTORS[name](detectors.inputs(telemetry(spark, sf_dir), SPEC))
        return found.select("id", *(c for c in found.columns if c.startswith((name, "iso", "pca", "deep")) and c not in ("latent", "x")))

    return run


for _key, _name in {"gmm_minority": "gmm", "isolation_forest": "isolation_forest", "deep_embedding": "deep_embedding", "dagmm": "dagmm", "vae": "vae", "gan": "gan", "usad": "usad", "transformer": "transformer", "lstm": "lstm", "omnianomaly": "omnianomaly"}.items():
    QUERIES[_key] = _detector(_name)


@query()
def full_ensemble(spark, sf_dir):
    return detectors.run_ensemble(telemetry(spark, sf_dir), SPEC, DEFAULT)


@query()
def fourteen_ensemble(spark, sf_dir):
    return detectors.run_ensemble(telemetry(spark, sf_dir), SPEC, FOURTEEN)


@query()
def four_ensemble(spark, sf_dir):
    from emberline.spec import FOUR

    return detectors.run_ensemble(telemetry(spark, sf_dir), SPEC, FOUR, list(detectors.FOUR))
