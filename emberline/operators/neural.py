"""Training in a barrier stage and scoring of the small networks.

Each task of the stage holds one shard of all rows and steps through it; after each epoch all tasks exchange their
weights and go on from the mean. Steps are in single precision, as in the reference; means and scores in double.
Scoring covers every row, with the weights as constants of a vectorised map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.autodiff import Adam
from emberline.functions.networks import NETWORKS, Network, Weights
from emberline.operators.exchange import Exchange
from emberline.operators.sequence import row_shards
from emberline.session import workers_find_package

#: Tasks of a training stage, all of which run at once; fewer where there are fewer slots.
WORKERS = 8
#: Rows that are scored at once, so that what lies between stays in the processor's cache.
CHUNK = 2048


def task_count(spark: SparkSession) -> int:
    return max(1, min(WORKERS, spark.sparkContext.defaultParallelism))


def flatten(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unflatten(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def as_array(column: pa.Array, net: Network, dtype: type = np.float64) -> np.ndarray:
    """Rows of numbers (windows of them for sequence networks) without nulls -> ``[n, d]`` or ``[n, window, d]``."""
    n, shape = len(column), (net.window, net.d) if net.sequence else (net.d,)
    for _ in shape:
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, *shape)


def fit_shard(net: Network, w: Weights, x: np.ndarray, epochs: int, batch: int, rng: np.random.Generator, adam: Adam) -> tuple[Weights, float]:
    loss = 0.0
    for _ in range(epochs):
        order, loss = rng.permutation(len(x)), 0.0
        for i in range(0, len(x), batch):
            rows = x[order[i : i + batch]]
            if len(rows) >= 2:
                loss += net.step(w, rows, rng, adam) * len(rows)
    return w, loss / max(1, len(x))


def train(df: DataFrame, key: str, column: str, net: Network, epochs: int = 30, batch: int = 256, seed: int = 42, workers: int | None = None, together: int = 1) -> DataFrame:
    """Rows ``(layer, idx, value)`` of the trained weights; ``column`` is an array (of arrays, for sequence networks)."""
    workers_find_package(df.sparkSession)
    rows = df.where(F.col(column).isNotNull())
    workers = workers or task_count(df.sparkSession)
    dealt = row_shards(rows, key, workers, seed).repartitionById(workers, F.col("_shard")).select(key, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        rank = context.partitionId()
        got = [(b.column(0), as_array(b.column(1), net, np.float32)) for b in batches if b.num_rows]
        x = np.concatenate([v for _, v in got]) if got else np.empty(0, np.float32)
        if got:
            x = x[pc.sort_indices(pa.chunked_array([k for k, _ in got])).to_numpy()]
        del got
        exchange = Exchange(context)
        w, rng, adam = net.init(np.random.default_rng(seed)), np.random.default_rng([seed, rank]), Adam(net.rate)
        for start in range(0, epochs, together):
            if len(x) >= 2:
                w, _ = fit_shard(net, {k: v.astype(np.float32) for k, v in w.items()}, x, min(together, epochs - start), batch, rng, adam)
            total = exchange.total(len(x) * np.r_[1.0, flatten(w).astype(float)])
            if total[0]:
                w = unflatten(total[1:] / total[0], w)
        exchange.close()
        if rank == 0:
            for k in sorted(w):
                yield pa.record_batch({"layer": pa.array([k] * w[k].size, pa.string()), "idx": pa.array(np.arange(w[k].size), pa.int64()), "value": pa.array(w[k].ravel().astype(float))})

    return dealt.mapInArrow(run, "layer string, idx long, value double", barrier=True)


def load(weights: DataFrame, net: Network) -> Weights:
    """Weight rows -> arrays; their number depends on the network alone."""
    like = net.init(np.random.default_rng(0))
    out = {k: np.zeros(v.size) for k, v in like.items()}
    for r in weights.collect():
        out[r["layer"]][r["idx"]] = r["value"]
    return {k: v.reshape(like[k].shape) for k, v in out.items()}


def score(df: DataFrame, column: str, name: str, net: Network, w: Weights, kind: str = "score") -> DataFrame:
    """Adds the network's score (or ``latents`` or ``representation``, arrays) of the column; null where that is null."""
    workers_find_package(df.sparkSession)
    out = "double" if kind == "score" else "array<double>"

    @F.arrow_udf(out)
    def scored(v: pa.Array) -> pa.Array:
        have = v.drop_null()
        x = as_array(have, net)
        parts = [getattr(net, kind)(w, x[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]
        got = pa.array(np.concatenate(parts).ravel() if parts else [], pa.float64())
        each = len(got) // max(1, len(x))
        if kind != "score":
            got = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * each, pa.int32()), got)
        if len(have) == len(v):
            return got
        there = v.is_valid().to_numpy(zero_copy_only=False)
        return got.take(pa.array(np.cumsum(there) - 1, mask=~there))

    return df.withColumn(name, scored(F.col(column)))


def network(name: str, d: int, **sizes: int) -> Network:
    return NETWORKS[name](d, **sizes)
