"""Scoring by networks whose weights are given as rows, with the forward pass in SQL.

Weights follow a rule, so a query's result depends on its rows alone. Sizes are small, as each unit is a column of the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.networks import Network, Weights
from emberline.operators import neural

SIZES = {"hidden": 4, "latent": 2, "window": 3}


def pinned(net: Network) -> Weights:
    """Half the sine of a number by layer and place, to six digits."""
    like = net.init(np.random.default_rng(0))
    return {k: np.round(np.sin(3 * a + 1 + np.arange(like[k].size)) / 2, 6).reshape(like[k].shape) for a, k in enumerate(sorted(like))}


def weight_rows(spark: SparkSession, w: Weights) -> DataFrame:
    rows = [(k, i, float(x)) for k in sorted(w) for i, x in enumerate(w[k].ravel())]
    return spark.createDataFrame(rows, "layer string, idx long, value double")


def score(rows: DataFrame, key: str, name: str, d: int) -> DataFrame:
    """``(key, score)`` of rows with a column ``x``; the weights go the way that trained ones go."""
    net = neural.network(name, d, **SIZES)
    w = neural.load(weight_rows(rows.sparkSession, pinned(net)), net)
    return neural.score(rows, "x", "score", net, w).select(key, F.round("score", 6).alias("score"))


class Sheet:
    """Columns upon columns: each :meth:`let` is one more table over all before."""

    def __init__(self, of: str):
        self.of, self.parts, self.n = of, [], 0

    def let(self, exprs: list[str]) -> list[str]:
        names = [f"v{self.n + i}" for i in range(len(exprs))]
        self.n += len(exprs)
        self.parts.append(f"t{len(self.parts)} AS (SELECT *, {', '.join(f'{e} AS {n}' for e, n in zip(exprs, names))} FROM {self.of})")
        self.of = f"t{len(self.parts) - 1}"
        return names


def dot(xs: list[str], ws) -> str:
    return " + ".join(f"{x} * {w!r}::DOUBLE" for x, w in zip(xs, map(float, ws)))


def dense(w: Weights, name: str, xs: list[str]) -> list[str]:
    return [f"({dot(xs, w[name + '.w'][:, j])} + {float(b)!r}::DOUBLE)" for j, b in enumerate(w[name + ".b"])]


def relu(xs: list[str]) -> list[str]:
    return [f"greatest({x}, 0.0)" for x in xs]


def sigmoid(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def squares(a: list[str], b: list[str]) -> str:
    return "((" + " + ".join(f"({x} - {y}) * ({x} - {y})" for x, y in zip(a, b)) + f") / {len(a)}.0)"


def two(s: Sheet, w: Weights, name: str, xs: list[str]) -> list[str]:
    return s.let(dense(w, name + "1", s.let(relu(dense(w, name + "0", xs)))))


def _autoencoder(s, w, x):
    return squares(two(s, w, "dec", two(s, w, "enc", x)), x)


def _variational(s, w, h, target):
    mu, lv = s.let(dense(w, "mu0", h)), s.let(dense(w, "lv0", h))
    y = two(s, w, "dec", mu)
    return f"({squares(y, target)} - 0.05 * (" + " + ".join(f"1 + {b} - {a} * {a} - exp({b})" for a, b in zip(mu, lv)) + "))"


def _vae(s, w, x):
    return _variational(s, w, s.let(relu(dense(w, "in0", x))), x)


def _usad(s, w, x):
    first = two(s, w, "one", two(s, w, "enc", x))
    return f"(0.5 * {squares(x, first)} + 0.5 * {squares(x, two(s, w, 'two', two(s, w, 'enc', first)))})"


def _gan(s, w, x):
    return f"(1 - {sigmoid(two(s, w, 'dis', x)[0])})"


def _transformer(s, w, x):
    width, heads = w["q0.b"].size, 2
    per = width // heads

    def norm(name, tokens):
        out = []
        for t in tokens:
            mean = s.let(["(" + " + ".join(t) + f") / {width}.0"])[0]
            far = s.let([f"({u} - {mean})" for u in t])
            root = s.let(["sqrt((" + " + ".join(f"{u} * {u}" for u in far) + f") / {width}.0 + 1e-5)"])[0]
            out.append(s.let([f"{u} / {root} * {float(g)!r}::DOUBLE + {float(c)!r}::DOUBLE" for u, g, c in zip(far, w[name + ".g"], w[name + ".c"])]))
        return out

    tokens = [s.let([f"({e} + {float(p)!r}::DOUBLE)" for e, p in zip(dense(w, "embed0", [t]), w["pos"][i])]) for i, t in enumerate(x)]
    q, k, v = ([s.let(dense(w, m + "0", t)) for t in tokens] for m in "qkv")
    mixed = [[] for _ in tokens]
    for h in range(heads):
        at = slice(h * per, (h + 1) * per)
        for i in range(len(tokens)):
            e = s.let(["exp((" + " + ".join(f"{a} * {b}" for a, b in zip(q[i][at], kj[at])) + f") / sqrt({per}.0))" for kj in k])
            mixed[i] += s.let(["(" + " + ".join(f"{a} * {vj[u]}" for a, vj in zip(e, v)) + ") / (" + " + ".join(e) + ")" for u in range(at.start, at.stop)])
    tokens = norm("n1", [s.let([f"({a} + {b})" for a, b in zip(t, dense(w, "o0", m))]) for t, m in zip(tokens, mixed)])
    up = [s.let(relu(dense(w, "up0", t))) for t in tokens]
    tokens = norm("n2", [s.let([f"({a} + {b})" for a, b in zip(t, dense(w, "down0", u))]) for t, u in zip(tokens, up)])
    return squares([dense(w, "out0", t)[0] for t in tokens], x)


def _sum(a: list[str], b: list[str]) -> list[str]:
    return [f"({x} + {y})" for x, y in zip(a, b)]


def _lstm(s, w, x):
    h = c = s.let(["0.0::DOUBLE"] * SIZES["hidden"])
    for now in x:
        f, i, g, o = (s.let(_sum(dense(w, n + "x", now), dense(w, n + "h", h))) for n in "fico")
        c = s.let([f"({sigmoid(a)} * {b} + {sigmoid(d)} * tanh({e}))" for a, b, d, e in zip(f, c, i, g)])
        h = s.let([f"({sigmoid(a)} * tanh({b}))" for a, b in zip(o, c)])
    return squares(s.let(dense(w, "out0", h))[-len(x[-1]) :], x[-1])


def _omnianomaly(s, w, x):
    h = s.let(["0.0::DOUBLE"] * SIZES["hidden"])
    for now in x:
        r, z = (s.let([sigmoid(a) for a in _sum(dense(w, n + "x", now), dense(w, n + "h", h))]) for n in "rz")
        new = s.let([f"tanh({a} + {b} * {c})" for a, b, c in zip(dense(w, "nx", now), r, dense(w, "nh", h))])
        h = s.let([f"((1.0 - {a}) * {b} + {a} * {c})" for a, b, c in zip(z, new, h)])
    return _variational(s, w, h, x[-1])


FORWARD: dict[str, Callable] = {"autoencoder": _autoencoder, "vae": _vae, "usad": _usad, "gan": _gan, "transformer": _transformer, "lstm": _lstm, "omnianomaly": _omnianomaly}


def sql(name: str, of: str, columns: list) -> str:
    """Tables and the final select over ``of``; columns of a row, or lists of them from a window's first row to its last."""
    net = neural.network(name, len(columns[0]) if net_is_sequence(name) else len(columns), **SIZES)
    s = Sheet(of)
    found = FORWARD[name](s, pinned(net), columns)
    return f"{', '.join(s.parts)} SELECT id, round({found}, 6) AS score FROM {s.of}"


def net_is_sequence(name: str) -> bool:
    return neural.NETWORKS[name].sequence
