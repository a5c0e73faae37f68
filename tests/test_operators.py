import threading
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.functions.autodiff import Adam, Var
from emberline.functions.forest import Forest
from emberline.functions.networks import NETWORKS
from emberline.operators import cluster, density, ensemble, local, neural, order, sequence, stats
from emberline.operators.exchange import Exchange
from emberline.plans import dag, detectors
from emberline.sources import registry, tables
from emberline.spec import PRESETS, FeatureSpec, Preset
from emberline.streaming import scoring

AB = FeatureSpec("id", ("a", "b"))


def frame(spark, rows, columns="id long, a double, b double"):
    return spark.createDataFrame(rows, columns)


def random_rows(n, seed=0, d=2):
    rng = np.random.default_rng(seed)
    return [(i, *map(float, rng.normal(size=d))) for i in range(n)]


def test_numbering_and_previous_dont_depend_on_ranges(spark, monkeypatch):
    rows = [(int(i), float(i % 17), 0.0) for i in np.random.default_rng(1).permutation(500)]
    want = {i: (i + 1, float((i - 1) % 17) if i else None) for i in range(500)}
    for size in (7, 100, 10_000):
        monkeypatch.setattr(order.with_ranges, "__defaults__", (size,))
        df = order.previous(order.numbered(frame(spark, rows).repartition(5), "id"), "id", "a", "before")
        assert {r["id"]: (r["rn"], r["before"]) for r in df.collect()} == want


@pytest.mark.parametrize("size", [5, 10_000])
def test_repair_matches_pandas(spark, monkeypatch, size):
    monkeypatch.setattr(order.with_ranges, "__defaults__", (size,))
    rng = np.random.default_rng(2)
    a = np.where(rng.random(80) < 0.6, np.nan, rng.normal(size=80))
    a[:3], a[-4:] = np.nan, np.nan
    rows = [(i * 3, None if np.isnan(x) else float(x), 1.0) for i, x in enumerate(a)]
    got = sequence.repair(frame(spark, rows), "id", ["a", "b"]).orderBy("id").toPandas()
    want = pd.Series(a).interpolate(limit_direction="both").ffill().bfill()
    assert np.allclose(got["a"], want)


def test_repair_raises_without_any_value(spark):
    with pytest.raises(ValueError):
        sequence.repair(frame(spark, [(1, None, 1.0), (2, None, 2.0)]), "id", ["a", "b"])


def test_constant_column_has_z_zero_and_null_stays_null(spark):
    got = stats.standardise(frame(spark, [(1, 5.0, 1.0), (2, 5.0, None), (3, 5.0, 3.0)]), AB).orderBy("id").collect()
    assert [r["z_a"] for r in got] == [0.0] * 3 and got[1]["z_b"] is None


def test_one_row_and_empty(spark):
    one = stats.standardise(frame(spark, [(1, 5.0, 1.0)]), AB).first()
    assert (one["z_a"], one["z_b"]) == (0.0, 0.0)
    empty = frame(spark, [])
    assert stats.standardise(empty, AB).count() == 0 and detectors.run_ensemble(empty, AB).count() == 0
    assert cluster.kmeans(empty, "id", ["a"], 2, "s", "c").count() == 0
    assert stats.in_minority(empty.withColumn("c", F.lit(1)), "c", "f").count() == 0


def test_flags_shift_and_scale(spark):
    rows = random_rows(300)
    plain = stats.static_z(frame(spark, rows), AB, 1.5).collect()
    moved = stats.static_z(frame(spark, [(i, 3 * a + 7, -2 * b) for i, a, b in rows]), AB, 1.5).collect()
    assert {r["id"]: r["static_flag"] for r in plain} == {r["id"]: r["static_flag"] for r in moved}


def test_minority_ties_go_to_the_least_cluster(spark):
    df = frame(spark, [(1, 3), (2, 1), (3, 2), (4, 2)], "id long, c int")
    assert {r["id"]: r["f"] for r in stats.in_minority(df, "c", "f").collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_lloyd_doesnt_depend_on_partitions(spark):
    rows = random_rows(400, 3)
    got = [np.array(cluster.lloyd(frame(spark, rows).repartition(n), "id", ["a", "b"], 3)) for n in (1, 3, 7)]
    assert np.allclose(got[0], got[1]) and np.allclose(got[0], got[2])


def test_components_match_numpy(spark):
    rows = random_rows(300, 4, 2)
    x = np.array([(a, a + 0.1 * b) for _, a, b in rows])
    df = frame(spark, [(i, *map(float, v)) for i, v in enumerate(x)])
    axis = cluster.components(df, ["a", "b"], 1)[0]
    want = np.linalg.eigh(np.cov(x.T, bias=True))[1][:, -1]
    assert np.allclose(np.abs(axis), np.abs(want), atol=1e-6) and axis[np.abs(axis).argmax()] > 0


@pytest.mark.parametrize("d", [2, 4, 5])
def test_density_noise_is_exact(spark, d):
    rng = np.random.default_rng(d)
    x = np.vstack([rng.normal(0, 0.1, (120, d)), rng.normal(3, 1.0, (60, d))])
    cols = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for eps, least in ((0.3, 5), (0.9, 4)):
        core = (far <= eps).sum(axis=1) >= least
        want = ~(far[:, core] <= eps).any(axis=1)
        got = {r["id"]: r["f"] for r in density.noise(df, "id", cols, eps, least, "f").collect()}
        assert [got[i] for i in range(len(x))] == want.astype(int).tolist()


def test_kth_distance_counts_the_row_itself():
    x = np.array([[0.0], [1.0], [3.0]])
    assert density.kth_distances(x, 2).tolist() == [1.0, 1.0, 2.0]


def test_eps_is_estimated_on_five_thousand_rows(spark):
    rows = random_rows(5000, seed=3)
    x = np.array([r[1:] for r in rows])
    want = np.percentile(density.kth_distances(x, 12), 97)
    assert abs(density.estimate_eps(frame(spark, rows), "id", ["a", "b"], 12, 0.97) - want) < 1e-5


@pytest.mark.parametrize("d", [2, 4])
def test_eps_and_noise_are_of_all_rows_in_any_regions(spark, monkeypatch, d):
    rng = np.random.default_rng(d)
    x = np.vstack([rng.normal(0, 0.2, (3500, d)), rng.normal(2, 1.0, (2500, d)), np.repeat(rng.normal(0, 3, (40, d)), 7, axis=0)]).round(3)
    cols = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols)).cache()
    want = np.percentile(density.kth_distances(x, 12), 97)
    far = density._squares(x, x)
    for size in (300, 1 << 14):
        monkeypatch.setattr(density, "REGION", size)
        eps = density.estimate_eps(df, "id", cols, 12, 0.97)
        assert abs(eps - want) < 1e-6
        got = density.eps_and_noise(df, "id", cols, 12, 0.97, "f").orderBy("id").collect()
        near = far <= eps * eps
        assert [r["f"] for r in got] == (~near[:, near.sum(axis=1) >= 12].any(axis=1)).astype(int).tolist()


@pytest.mark.parametrize("n,want", [(4, 0), (5, 1), (6, 2)])
def test_windows_at_the_shard_size(spark, n, want):
    df = sequence.windows(sequence.seq_shards(frame(spark, random_rows(n)), "id", 1), "id", ["a"], 5)
    assert df.where("window is not null").count() == want and df.count() == n


@pytest.mark.parametrize("block", [1, 5, 7, 1000])
def test_windows_are_the_same_in_blocks_of_any_size(spark, block):
    sharded = sequence.seq_shards(frame(spark, random_rows(40)), "id", 3, "_rn")
    got = {r["id"]: r["window"] for r in sequence.windows(sharded, "id", ["a"], 5, position="_rn", block=block).collect()}
    rows = sequence.seq_shards(frame(spark, random_rows(40)), "id", 3).orderBy("id").collect()
    assert len(got) == 40
    for i, r in enumerate(rows):
        mine = [x["a"] for x in rows[max(0, i - 4) : i + 1] if x["_shard"] == r["_shard"]]
        assert got[r["id"]] == ([[x] for x in mine] if len(mine) == 5 else None)


def test_many_ranges_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(order, "STEP", 4)
    rows = order.with_ranges(spark.range(1000), "id", 10)
    per = rows.groupBy(order.BUCKET).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).orderBy(order.BUCKET).collect()
    assert len(per) == 100 and all(a["hi"] < b["lo"] for a, b in zip(per, per[1:])) and max(r["n"] for r in per) <= 12
    assert [r["rn"] for r in order.numbered(spark.range(1000), "id").orderBy("id").collect()] == list(range(1, 1001))


def test_shards_differ_by_the_ceiling_rule(spark):
    sizes = sequence.seq_shards(frame(spark, random_rows(10)), "id", 4).groupBy("_shard").count().orderBy("_shard").collect()
    assert [r["count"] for r in sizes] == [3, 3, 3, 1]


def test_vote_counts_missing_rows_as_zero(spark):
    base = frame(spark, random_rows(5))
    some = base.where("id < 2").select("id", F.lit(1).alias("f"))
    got = ensemble.vote(ensemble.join_flags(base, "id", {"x": (some, "f"), "y": (base.withColumn("g", F.lit(1)), "g")}), ["x_flag", "y_flag"], least=2)
    assert {r["id"]: (r["vote"], r["ensemble"]) for r in got.collect()} == {0: (2, 1), 1: (2, 1), 2: (1, 0), 3: (1, 0), 4: (1, 0)}


@pytest.mark.parametrize("name", [n for n in NETWORKS if n != "gan"])
def test_gradients_match_differences(name):
    net = neural.network(name, 3, hidden=4, window=3)
    rng = np.random.default_rng(5)
    w = net.init(rng)
    x = rng.normal(size=(4, 3, 3) if net.sequence else (4, 3))

    def value(weights):
        v = {k: Var(a) for k, a in weights.items()}
        if name == "usad":  # whose slope has a term that its value doesn't
            return sum((((y - x) * (y - x)).mean() * f for y, f in zip(net.three(v, Var(x)), (1.0, 1.0, 0.5))), Var(0.0))
        return net.loss(v, Var(x), np.random.default_rng(9))

    v = {k: Var(a) for k, a in w.items()}
    net.loss(v, Var(x), np.random.default_rng(9)).backward()
    for k, a in w.items():
        i = tuple(rng.integers(0, s) for s in a.shape)
        up, down = ({**w, k: a.copy()} for _ in range(2))
        up[k][i] += 1e-6
        down[k][i] -= 1e-6
        slope = (value(up).value - value(down).value) / 2e-6
        assert abs(slope - v[k].grad[i]) < 1e-5, k


def test_training_lowers_the_loss_and_weights_survive(spark, tmp_path):
    df = stats.standardise(frame(spark, random_rows(400)), AB).withColumn("x", F.array("z_a", "z_b"))
    net = neural.network("autoencoder", 2)
    trained = neural.train(df, "id", "x", net, epochs=20)
    tables.sink(trained, str(tmp_path / "model"))
    w = neural.load(spark.read.parquet(str(tmp_path / "model")), net)
    x = np.array([r["x"] for r in df.collect()])
    assert net.score(w, x).mean() < net.score(net.init(np.random.default_rng(42)), x).mean()
    got = neural.score(df, "x", "s", net, w).collect()
    assert np.allclose([r["s"] for r in got], net.score(w, np.array([r["x"] for r in got])))


def test_planted_rows_are_found(spark):
    spec = FeatureSpec("id", tables.TRAFFIC)
    z = stats.standardise(tables.synthetic_traffic(spark), spec)
    rows = np.array([[r[c] for c in spec.z] for r in z.orderBy("id").collect()])
    score = Forest(rows).score(rows)
    assert (np.argsort(-score)[:250] < 250).mean() > 0.95
    flagged = stats.static_z(tables.synthetic_traffic(spark), spec).where("static_flag = 1")
    assert flagged.where("id <= 250").count() > 200 and flagged.where("id > 250").count() == 0


def test_all_detectors_vote(spark):
    preset = Preset(epochs=2)
    got = detectors.run_ensemble(frame(spark, random_rows(200)), AB, preset)
    assert got.count() == 200 and {f"{n}_flag" for n in detectors.DETECTORS} <= set(got.columns)
    assert got.where("vote > 14 or vote < 0").count() == 0 and PRESETS["fourteen"].window == 10


def test_rounds_of_fits_have_as_many_tasks_as_slots_or_rows_ask_for(spark, monkeypatch):
    rows = frame(spark, random_rows(200)).repartition(40)
    slots = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(sequence, "repair", lambda df, *_: df)  # keeps the parts
    got = detectors.inputs(rows, AB).rows
    assert got.rdd.getNumPartitions() == slots and got.count() == 200
    monkeypatch.setattr(detectors, "PART_ROWS", 20)
    assert slots < detectors.inputs(rows, AB).rows.rdd.getNumPartitions() <= 40


def test_sink_replaces_and_one_shard_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (30, 40):
        tables.sink(sequence.row_shards(frame(spark, random_rows(n)), "id", 3), path, "_shard")
    assert spark.read.parquet(path).count() == 40
    one = tables.read_shard(spark, path, 1)
    assert "PartitionFilters: [isnotnull(_shard" in one._jdf.queryExecution().toString() and 0 < one.count() < 40


def test_csv_readers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,a,b\n1,,2.5\n2,3.5,\n")
    spec = FeatureSpec("id", ("a", "b"))
    assert tables.read_csv(spark, str(tmp_path / "x.csv"), tables.clean_schema(spec)).orderBy("id").collect()[0]["a"] is None
    assert tables.read_csv_inferred(spark, str(tmp_path / "x.csv")).select("ID").count() == 2


def test_positional_parse_keeps_blank_fields_in_place(spark):
    lines = spark.createDataFrame([("1,,3",)], "line string")
    assert tuple(tables.parse_positional(lines, "line", ["a", "b", "c"]).first()[1:]) == (1.0, None, 3.0)
    assert tuple(tables.parse_by_pattern(lines, "line", ["a", "b", "c"]).first()[1:]) == (1.0, 3.0, None)


def test_plans_push_down_and_have_no_single_task_window(spark):
    events = tables.table(spark, "/root/testdata/sf0.001", "events").where("value > 10").select("event_id")
    plan = events._jdf.queryExecution().toString()
    assert "GreaterThan(value,10.0)" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan
    rows = frame(spark, random_rows(50)).cache()
    rows.count()
    z = detectors.inputs(rows, AB)
    plan = detectors._static(z)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Window" not in plan


def test_stream_scoring(spark, tmp_path):
    rows = frame(spark, random_rows(100)).withColumn("ts", F.timestamp_seconds(F.col("id") * 60))
    rows.write.parquet(str(tmp_path / "in"))
    step = scoring.pinned(stats.moments(rows, ["a", "b"]), AB, 1.0)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = step(stream).writeStream.format("memory").queryName("flags").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"]: r["static_flag"] for r in spark.table("flags").collect()} == {r["id"]: r["static_flag"] for r in stats.static_z(rows, AB, 1.0).collect()}
    assert scoring.flag_rates(step(rows)).count() == 2


def test_merged_centres_match_lloyd_by_hand(spark):
    rows = frame(spark, random_rows(60))
    shard = {r["id"]: r["_shard"] for r in sequence.row_shards(rows, "id", 3).collect()}
    x = np.array([r[1:] for r in random_rows(60)])
    parts = [local.lloyd_rows(x[[shard[i] == s for i in range(60)]], 2) for s in range(3)]
    assert np.allclose(local.merged_centres(rows, "id", ["a", "b"], 2, parts=3), local.lloyd_rows(np.vstack(parts), 2))
    assert local.merged_centres(rows.where("id < 0"), "id", ["a", "b"], 2, parts=3) == []
    assert np.allclose(sorted(local.lloyd_rows(x, 2).tolist()), sorted(cluster.lloyd(rows, "id", ["a", "b"], 2)))


def test_hard_mixture_separates_and_survives_few_rows(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (80, 2)), rng.normal(12, 0.3, (40, 2))])
    means, covariances, weights = local.hard_mixture(x, 2)
    at = local.likeliest(x, means, covariances, weights)
    assert len(set(at[:80])) == 1 and len(set(at[80:])) == 1 and sorted(np.round(weights, 3)) == [0.333, 0.667]
    for few in (x[:0], x[:1], np.tile(x[:1], (5, 1))):
        assert np.isfinite(local.hard_mixture(few, 3)[1]).all()
    got = local.hard_mixture_labels(frame(spark, [(i, *map(float, r)) for i, r in enumerate(x)]), "id", ["a", "b"], 2, "component", 1).orderBy("id").collect()
    assert [r["component"] for r in got] == at.tolist()


def test_local_forests_match_their_shards(spark):
    rows = frame(spark, random_rows(90))
    shard = {r["id"]: r["_shard"] for r in sequence.row_shards(rows, "id", 3).collect()}
    x = np.array([r[1:] for r in random_rows(90)])
    want = np.mean([Forest(x[[shard[i] == s for i in range(90)]], 4).score(x) for s in range(3)], axis=0)
    grown = local.forests(rows, "id", ["a", "b"], trees=12, parts=3)
    got = local.forest_mean(rows, ["a", "b"], grown, "s").orderBy("id").collect()
    assert np.allclose([r["s"] for r in got], want)
    assert local.forest_mean(rows, ["a", "b"], [], "s").first()["s"] == 0.5


def test_spread_evens_out_partitions(spark):
    sizes = local.spread(frame(spark, random_rows(100)).coalesce(1), 4).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and all(abs(r["count"] - 25) <= 4 for r in sizes)  # each source task deals out from a place of its own


def test_registry_saves_replaces_and_lists(spark, tmp_path):
    folder = str(tmp_path / "scores")
    assert registry.names(spark, folder) == [] and not registry.saved(spark, folder, "a")
    for n in (3, 5):
        registry.save(frame(spark, random_rows(n)), folder, "a")
    assert registry.load(spark, folder, "a").count() == 5 and registry.names(spark, folder) == ["a"]
    with pytest.raises(KeyError):
        registry.load(spark, folder, "b")
    with pytest.raises(ValueError):
        registry.save(frame(spark, random_rows(1)), folder, "../b")


def test_steps_retry_and_go_on_from_saved_results(spark, tmp_path):
    runs = {"a": 0, "b": 0, "c": 0}

    def made(name, fails=0):
        def run(*given):
            runs[name] += 1
            if runs[name] <= fails:
                raise RuntimeError(name)
            return spark.range(sum(g.count() for g in given) + 1)

        return run

    folder = str(tmp_path / "w")
    steps = [dag.Step("c", made("c", 3), ("a", "b"), 1, 0), dag.Step("a", made("a")), dag.Step("b", made("b", 1), ("a",), 1, 0)]
    with pytest.raises(RuntimeError):
        dag.run_steps(spark, steps, folder)
    assert runs == {"a": 1, "b": 2, "c": 2} and registry.names(spark, folder) == ["a", "b"]
    assert dag.run_steps(spark, steps, folder)["c"].count() == 4 and runs == {"a": 1, "b": 2, "c": 4}
    assert dag.run_steps(spark, steps, folder, again=True)["c"].count() == 4 and runs["a"] == 2
    for bad in ([dag.Step("a", made("a"), ("x",))], [steps[1], steps[1]]):
        with pytest.raises(ValueError):
            dag.run_steps(spark, bad, folder)


def test_anomaly_steps_vote_as_the_ensemble_does(spark, tmp_path):
    rows = frame(spark, random_rows(80))
    done = dag.run_steps(spark, dag.anomaly_steps(lambda: rows, AB, names=["kmeans", "pca_kmeans", "static"], wait_seconds=0), str(tmp_path / "w"))
    want = detectors.run_ensemble(rows, AB, names=["kmeans", "pca_kmeans", "static"])
    assert sorted(map(tuple, done["votes"].collect())) == sorted(map(tuple, want.select(*done["votes"].columns).collect()))
    assert done["report"].count() == 10 and done["totals"].first()["n"] == 80


def test_fused_flags_are_those_of_the_detectors(spark):
    i = detectors.inputs(frame(spark, random_rows(150)), AB)
    got = {r["id"]: r for r in detectors.fused(i).collect()}
    for name, flag in (("kmeans", "kmeans_flag"), ("pca_kmeans", "pca_kmeans_flag"), ("adaptive", "adaptive_flag"), ("static", "static_flag")):
        assert all(got[r["id"]][flag] == r[flag] for r in (detectors.DETECTORS | detectors.FOUR)[name](i).collect())
    plan = detectors.fused(i)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryTableScan")[0] and "Join" not in plan.split("InMemoryTableScan")[0]


def test_jdbc_options_ask_for_ranges():
    class Reader:
        def __init__(self):
            self.read, self.options_, self.format_ = self, {}, None

        def format(self, f):
            self.format_ = f
            return self

        def option(self, k, v):
            self.options_[k] = v
            return self

        def options(self, **o):
            self.options_ |= o
            return self

        def load(self):
            return self

    got = tables.read_jdbc(Reader(), "jdbc:x", "t", "id", 1, 900, 16, fetchsize="1000")
    assert got.format_ == "jdbc" and got.options_ == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "1000", "partitionColumn": "id", "lowerBound": 1, "upperBound": 900, "numPartitions": 16}
    assert "partitionColumn" not in tables.read_jdbc(Reader(), "jdbc:x", "t").options_


@pytest.mark.parametrize("name", ["lstm", "omnianomaly", "vae", "transformer"])
def test_written_slopes_match_automatic_ones_and_keep_single_precision(name):
    net = neural.network(name, 3, hidden=5, window=4)
    rng = np.random.default_rng(11)
    w, x = net.init(rng), rng.normal(size=(7, 4, 3) if net.sequence else (7, 3))
    (loss, got), (want_loss, want) = (f(w, x, np.random.default_rng(2)) for f in (net.slopes, net.derived))
    assert type(net).slopes is not type(net).derived  # written out
    assert np.isclose(loss, want_loss) and got.keys() == want.keys()
    assert all(got[k].shape == w[k].shape and np.allclose(got[k], want[k], atol=1e-12) for k in w)
    single = {k: a.astype(np.float32) for k, a in w.items()}
    net.step(single, x.astype(np.float32), rng, Adam(net.rate))
    assert all(a.dtype == np.float32 for a in single.values())


class Stage:
    """A barrier stage's tasks as threads."""

    def __init__(self, n, host):
        self.n, self.host, self.said, self.gate, self.rounds = n, host, [""] * n, threading.Barrier(n), 0

    def task(self, rank):
        def gather(message=""):
            self.said[rank] = message
            self.gate.wait()
            self.rounds += rank == 0
            out = list(self.said)
            self.gate.wait()
            return out

        return SimpleNamespace(partitionId=lambda: rank, getTaskInfos=lambda: [SimpleNamespace(address=f"{self.host}:1")] * self.n, allGather=gather)


@pytest.mark.parametrize("host, rounds", [("localhost", 2), ("192.0.2.77", 2 + 30)])
def test_tasks_exchange_sums_by_sockets_or_all_gather(host, rounds):
    stage = Stage(3, host)

    def work(rank):
        exchange = Exchange(stage.task(rank), seconds=5)
        out = [exchange.total(np.array([rank + i, 0.1 * rank])) for i in range(30)]
        exchange.close()
        return out

    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(work, range(3)))
    assert all(np.array_equal(f, [[3 + 3 * i, 0.0 + 0.1 + 0.2] for i in range(30)]) for f in found)
    assert stage.rounds == rounds  # each of Spark's takes a second


def test_scores_skip_nulls_in_any_place(spark):
    net = neural.network("autoencoder", 2)
    w = net.init(np.random.default_rng(1))
    df = spark.createDataFrame([(i, None if i % 3 == 0 else [float(i), 1.0]) for i in range(20)], "id long, x array<double>")
    for kind in ("score", "latents"):
        got = {r["id"]: r["s"] for r in neural.score(df, "x", "s", net, w, kind).collect()}
        assert all((got[i] is None) == (i % 3 == 0) for i in range(20))
        assert all(np.allclose(got[i], getattr(net, kind)(w, np.array([[float(i), 1.0]]))[0]) for i in range(20) if i % 3)


def test_detectors_of_an_ensemble_are_made_together(spark, monkeypatch):
    gate, rows = threading.Barrier(2), frame(spark, random_rows(30))
    want = sorted(detectors.run_ensemble(rows, AB, names=["kmeans", "static"]).collect())
    for n in ("kmeans", "static"):
        monkeypatch.setitem(detectors.FOUR, n, lambda i, f=detectors.FOUR[n]: (gate.wait(60), f(i))[1])
    assert sorted(detectors.run_ensemble(rows, AB, names=["kmeans", "static"]).collect()) == want


def test_scores_of_networks_are_made_once(spark):
    found = detectors.DETECTORS["vae"](detectors.inputs(frame(spark, random_rows(40)), AB, Preset(epochs=1)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "vae_score" in plan[: plan.index("InMemoryRelation")].splitlines()[0] and "PythonUDF" not in plan[: plan.index("InMemoryRelation")]
    assert "vae_score" in next(x for x in plan.splitlines() if "InMemoryRelation" in x)
