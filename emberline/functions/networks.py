"""The small networks of the reconstruction detectors: weights, losses and scores.

Each network is a function from weights and rows to what its loss and score need. Rows are ``[n, d]``, or
``[n, window, d]`` for the sequence networks. Scores are deterministic: latent means stand for samples.

Slopes come from automatic differentiation; the networks with many small operations a step (attention, recurrent and
variational ones) have them written out, with rows as the last axis and gates stacked. Both forms give the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from emberline.functions.autodiff import Adam, Var

Weights = dict[str, np.ndarray]


def _dense(rng: np.random.Generator, w: Weights, name: str, n_in: int, n_out: int) -> None:
    bound = 1 / np.sqrt(n_in)
    w[name + ".w"], w[name + ".b"] = rng.uniform(-bound, bound, (n_in, n_out)), rng.uniform(-bound, bound, n_out)


def _chain(rng, w: Weights, name: str, *sizes: int) -> None:
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        _dense(rng, w, f"{name}{i}", a, b)


def _apply(w, name: str, x, layers: int = 2):
    for i in range(layers):
        x = x @ w[f"{name}{i}.w"] + w[f"{name}{i}.b"]
        x = x.relu() if i < layers - 1 else x
    return x


def _square(a, b):
    return (a - b) * (a - b)


class Network:
    """init, loss, score by name; ``rate`` of Adam."""

    rate = 1e-3
    sequence = False

    def __init__(self, d: int, hidden: int = 16, latent: int = 2, window: int = 5):
        self.d, self.hidden, self.latent, self.window = d, hidden, latent, window

    def init(self, rng: np.random.Generator) -> Weights:
        raise NotImplementedError

    def loss(self, w, x, rng: np.random.Generator) -> Var:
        raise NotImplementedError

    def score(self, w: Weights, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def derived(self, w: Weights, x: np.ndarray, rng: np.random.Generator) -> tuple[float, Weights]:
        """Loss and its slopes by automatic differentiation."""
        v = {k: Var(a) for k, a in w.items()}
        loss = self.loss(v, Var(x, live=False), rng)
        loss.backward()
        return float(loss.value), {k: a.grad for k, a in v.items() if a.grad is not None}

    slopes = derived

    def step(self, weights: Weights, x: np.ndarray, rng: np.random.Generator, adam: Adam) -> float:
        loss, grads = self.slopes(weights, x, rng)
        adam.step(weights, grads)
        return loss


class Autoencoder(Network):
    def init(self, rng):
        w: Weights = {}
        _chain(rng, w, "enc", self.d, self.hidden, self.latent)
        _chain(rng, w, "dec", self.latent, self.hidden, self.d)
        return w

    def both(self, w, x):
        z = _apply(w, "enc", x)
        return z, _apply(w, "dec", z)

    def loss(self, w, x, rng):
        return _square(self.both(w, x)[1], x).mean()

    def latents(self, w: Weights, x: np.ndarray) -> np.ndarray:
        return self.both(_fixed(w), Var(x, live=False))[0].value

    def representation(self, w: Weights, x: np.ndarray) -> np.ndarray:
        """Latents, distance to the reconstruction, cosine with it."""
        z, y = (v.value for v in self.both(_fixed(w), Var(x, live=False)))
        far = np.linalg.norm(x - y, axis=1, keepdims=True)
        cosine = (x * y).sum(axis=1, keepdims=True) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True) * np.linalg.norm(y, axis=1, keepdims=True), 1e-8)
        return np.hstack([z, far, cosine])

    def score(self, w, x):
        return ((self.both(_fixed(w), Var(x, live=False))[1].value - x) ** 2).mean(axis=1)


def _slope(out: Weights, name: str, x: np.ndarray, g: np.ndarray) -> None:
    """Slopes of a dense layer, from its input and its output's slopes (units by rows)."""
    out[name + ".w"], out[name + ".b"] = x @ g.T, g.sum(axis=1)


def _fixed(w: Weights) -> dict[str, Var]:
    return {k: Var(a, live=False) for k, a in w.items()}


class Variational(Network):
    def init(self, rng):
        w: Weights = {}
        _dense(rng, w, "in0", self.d, self.hidden)
        _dense(rng, w, "mu0", self.hidden, self.latent)
        _dense(rng, w, "lv0", self.hidden, self.latent)
        _chain(rng, w, "dec", self.latent, self.hidden, self.d)
        return w

    def body(self, w, x):
        return _apply(w, "in", x, 1).relu()

    def loss(self, w, x, rng):
        h = self.body(w, x)
        mu, lv = _apply(w, "mu", h, 1), _apply(w, "lv", h, 1)
        y = _apply(w, "dec", mu + (lv * 0.5).exp() * rng.standard_normal(mu.value.shape))
        return _square(y, self.target(x)).mean() + (lv + 1.0 - mu * mu - lv.exp()).mean() * (-0.05)

    def target(self, x):
        return x

    def coded(self, w: Weights, x: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray, Weights], None]]:
        """The body's state, units by rows, and what adds the body's slopes for the state's."""
        x = x.T
        h = np.maximum(w["in0.w"].T @ x + w["in0.b"][:, None], 0)

        def back(dh, out):
            _slope(out, "in0", x, dh * (h > 0))

        return h, back

    def slopes(self, w, x, rng):
        h, back = self.coded(w, x)
        y, out = self.target(x).T, {}
        mu, lv = (w[k + ".w"].T @ h + w[k + ".b"][:, None] for k in ("mu0", "lv0"))
        noise = rng.standard_normal(mu.T.shape).T.astype(x.dtype)
        half, var = np.exp(lv * 0.5), np.exp(lv)
        z = mu + half * noise
        up = np.maximum(w["dec0.w"].T @ z + w["dec0.b"][:, None], 0)
        far = w["dec1.w"].T @ up + w["dec1.b"][:, None] - y
        dy = far * (2 / far.size)
        _slope(out, "dec1", up, dy)
        dup = (w["dec1.w"] @ dy) * (up > 0)
        _slope(out, "dec0", z, dup)
        dz, part = w["dec0.w"] @ dup, 0.05 / mu.size
        dmu, dlv = dz + 2 * part * mu, dz * noise * half * 0.5 - part * (1 - var)
        _slope(out, "mu0", h, dmu)
        _slope(out, "lv0", h, dlv)
        back(w["mu0.w"] @ dmu + w["lv0.w"] @ dlv, out)
        return float((far * far).mean() - 0.05 * (lv + 1 - mu * mu - var).mean()), out

    def score(self, w, x):
        w, x = _fixed(w), Var(x, live=False)
        h = self.body(w, x)
        mu, lv = _apply(w, "mu", h, 1), _apply(w, "lv", h, 1)
        kl = -0.5 * (1 + lv.value - mu.value**2 - np.exp(lv.value)).sum(axis=1)
        return ((_apply(w, "dec", mu).value - self.target(x).value) ** 2).mean(axis=1) + 0.1 * kl


class Usad(Network):
    def __init__(self, d, hidden=16, latent=4, window=5):
        super().__init__(d, hidden, 4, window)

    def init(self, rng):
        w: Weights = {}
        _chain(rng, w, "enc", self.d, self.hidden, self.latent)
        _chain(rng, w, "one", self.latent, self.hidden, self.d)
        _chain(rng, w, "two", self.latent, self.hidden, self.d)
        return w

    def three(self, w, x):
        z = _apply(w, "enc", x)
        first = _apply(w, "one", z)
        return first, _apply(w, "two", z), _apply(w, "two", _apply(w, "enc", first))

    def loss(self, w, x, rng):
        a, b, c = self.three(w, x)
        third = _square(c, x).mean()
        return _square(a, x).mean() + _square(b, x).mean() + third * 0.5 - 0.5 * third.value  # the third counts for the slope alone

    def score(self, w, x):
        a, _, c = (v.value for v in self.three(_fixed(w), Var(x, live=False)))
        return 0.5 * ((x - a) ** 2).mean(axis=1) + 0.5 * ((x - c) ** 2).mean(axis=1)


class Adversarial(Network):
    """A generator from noise and a discriminator; rows that look made up score high."""

    rate = 5e-5
    noise = 8

    def init(self, rng):
        w: Weights = {}
        _chain(rng, w, "gen", self.noise, self.hidden, self.d)
        _chain(rng, w, "dis", self.d, self.hidden, 1)
        return w

    def real(self, w, x):
        return _apply(w, "dis", x).sigmoid()

    def step(self, weights, x, rng, adam):
        total = 0.0
        for part in ("dis", "gen"):
            v = {k: Var(a, live=k.startswith(part)) for k, a in weights.items()}
            fake = self.real(v, _apply(v, "gen", Var(rng.standard_normal((len(x), self.noise)).astype(x.dtype), live=False)))
            if part == "dis":
                loss = -((self.real(v, Var(x, live=False)) + 1e-7).log().mean()) - (1.0 - fake + 1e-7).log().mean()
            else:
                loss = -((fake + 1e-7).log().mean())
            loss.backward()
            adam.t -= part == "gen"  # one step of time for both
            adam.step(weights, {k: a.grad for k, a in v.items() if k.startswith(part)})
            total += float(loss.value)
        return total

    def score(self, w, x):
        return 1 - self.real(_fixed(w), Var(x, live=False)).value[:, 0]


class Transformer(Network):
    """Each feature is a token; one layer of two heads of attention."""

    width, heads = 8, 2

    def init(self, rng):
        w: Weights = {"pos": rng.standard_normal((self.d, self.width)) * 0.01}
        for name, a, b in (("embed", 1, self.width), ("q", self.width, self.width), ("k", self.width, self.width), ("v", self.width, self.width), ("o", self.width, self.width), ("up", self.width, self.hidden), ("down", self.hidden, self.width), ("out", self.width, 1)):
            _dense(rng, w, name + "0", a, b)
        for name in ("n1", "n2"):
            w[name + ".g"], w[name + ".c"] = np.ones(self.width), np.zeros(self.width)
        return w

    @staticmethod
    def norm(w, name, x):
        far = x - x.mean(axis=-1, keepdims=True)
        return far / ((far * far).mean(axis=-1, keepdims=True) + 1e-5).root() * w[name + ".g"] + w[name + ".c"]

    def forward(self, w, x):
        n, d, h = x.value.shape[0], self.d, self.heads
        e = _apply(w, "embed", x.reshape(n, d, 1), 1) + w["pos"]
        q, k, v = (_apply(w, m, e, 1).reshape(n, d, h, self.width // h).swap(1, 2) for m in "qkv")
        a = ((q @ k.swap(-1, -2)) * (1 / np.sqrt(self.width / h))).softmax() @ v
        e = self.norm(w, "n1", e + _apply(w, "o", a.swap(1, 2).reshape(n, d, self.width), 1))
        e = self.norm(w, "n2", e + _apply(w, "down", _apply(w, "up", e, 1).relu(), 1))
        return _apply(w, "out", e, 1).reshape(n, d)

    def loss(self, w, x, rng):
        return _square(self.forward(w, x), x).mean()

    def slopes(self, w, x, rng):
        (n, d), h, width = x.shape, self.heads, self.width
        per, flat, x, out = width // h, (-1, n * d), np.ascontiguousarray(x.T), {}  # arrays are units by tokens by rows

        def dense(name, a):
            return w[name + "0.w"].T @ a + w[name + "0.b"][:, None]

        def normed(name, a):
            a = a - a.mean(axis=0)
            root = np.sqrt((a * a).mean(axis=0) + 1e-5)
            a /= root
            return a, root, a * w[name + ".g"][:, None] + w[name + ".c"][:, None]

        def back_normed(name, a, root, g):
            out[name + ".g"], out[name + ".c"] = (g * a).sum(axis=1), g.sum(axis=1)
            g = g * w[name + ".g"][:, None]
            return (g - g.mean(axis=0) - a * (g * a).mean(axis=0)) / root

        e0 = (w["embed0.w"].T[:, :, None] * x + (w["embed0.b"] + w["pos"]).T[:, :, None]).reshape(flat)
        qkv_w = np.concatenate([w[m + "0.w"] for m in "qkv"], axis=1)
        qkv = (qkv_w.T @ e0 + np.concatenate([w[m + "0.b"] for m in "qkv"])[:, None]).reshape(3, h, per, d, n)
        scale = float(1 / np.sqrt(width / h))
        q, k, v = qkv[0, :, :, :, None] * scale, qkv[1, :, :, None], qkv[2, :, :, None]  # head, unit, token, other token, row
        a = (q * k).sum(axis=1)
        np.exp(a - a.max(axis=2, keepdims=True), out=a)
        a /= a.sum(axis=2, keepdims=True)
        mixed = (a[:, None] * v).sum(axis=3).reshape(flat)
        y1, r1, e1 = normed("n1", e0 + dense("o", mixed))
        up = np.maximum(dense("up", e1), 0)
        y2, r2, e2 = normed("n2", e1 + dense("down", up))
        far = dense("out", e2) - x.reshape(flat)

        g = far * (2 / far.size)
        _slope(out, "out0", e2, g)
        g2 = back_normed("n2", y2, r2, w["out0.w"] @ g)
        _slope(out, "down0", up, g2)
        gu = (w["down0.w"] @ g2) * (up > 0)
        _slope(out, "up0", e1, gu)
        g1 = back_normed("n1", y1, r1, g2 + w["up0.w"] @ gu)
        _slope(out, "o0", mixed, g1)
        gm = (w["o0.w"] @ g1).reshape(h, per, d, 1, n)
        ga = (gm * v).sum(axis=1)
        gs = a * (ga - (a * ga).sum(axis=2, keepdims=True))
        gqkv = np.empty_like(qkv)
        np.multiply((gs[:, None] * k).sum(axis=3), scale, out=gqkv[0])
        np.sum(gs[:, None] * q, axis=2, out=gqkv[1])
        np.sum(a[:, None] * gm, axis=2, out=gqkv[2])
        gqkv = gqkv.reshape(flat)
        of_w, of_b = e0 @ gqkv.T, gqkv.sum(axis=1)
        for i, m in enumerate("qkv"):
            out[m + "0.w"], out[m + "0.b"] = of_w[:, i * width : (i + 1) * width], of_b[i * width : (i + 1) * width]
        g0 = (g1 + qkv_w @ gqkv).reshape(width, d, n)
        out["pos"] = g0.sum(axis=2).T
        out["embed0.b"], out["embed0.w"] = out["pos"].sum(axis=0), (g0 * x).reshape(width, -1).sum(axis=1)[None]
        return float((far * far).mean()), out

    def score(self, w, x):
        return ((self.forward(_fixed(w), Var(x, live=False)).value - x) ** 2).mean(axis=1)


def _stacked(w: Weights, names: str, hidden: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gates' weights side by side (rows: state, input, one), and by time what they apply to; the state's rows are still zero."""
    n, window, d = x.shape
    gates = np.concatenate([np.concatenate([w[g + "h.w"], w[g + "x.w"], (w[g + "x.b"] + w[g + "h.b"])[None]]) for g in names], axis=1)
    held = np.zeros((window + 1, hidden + d + 1, n), x.dtype)
    held[:-1, hidden:-1], held[:, -1] = x.transpose(1, 2, 0), 1
    return gates, held


def _gate(w, name, x, h):
    return x @ w[name + "x.w"] + w[name + "x.b"] + h @ w[name + "h.w"] + w[name + "h.b"]


class Lstm(Network):
    """Reconstructs a whole window from the last state; the score is of the window's last row."""

    sequence = True

    def init(self, rng):
        w: Weights = {}
        for g in "ifco":
            _dense(rng, w, g + "x", self.d, self.hidden)
            _dense(rng, w, g + "h", self.hidden, self.hidden)
        _dense(rng, w, "out0", self.hidden, self.window * self.d)
        return w

    def forward(self, w, x):
        n = x.value.shape[0]
        h = c = Var(np.zeros((n, self.hidden)), live=False)
        for t in range(self.window):
            now = x[:, t, :]
            c = _gate(w, "f", now, h).sigmoid() * c + _gate(w, "i", now, h).sigmoid() * _gate(w, "c", now, h).tanh()
            h = _gate(w, "o", now, h).sigmoid() * c.tanh()
        return _apply(w, "out", h, 1).reshape(n, self.window, self.d)

    def loss(self, w, x, rng):
        return _square(self.forward(w, x), x).mean()

    def slopes(self, w, x, rng):
        u, n, out = self.hidden, len(x), {}
        gates, held = _stacked(w, "fioc", u, x)
        half = np.r_[np.full(3 * u, 0.5), np.ones(u)].astype(x.dtype)  # a sigmoid is a tanh of half its input, moved
        scaled = np.ascontiguousarray((gates * half).T)
        c, kept = np.zeros((u, n), x.dtype), []
        for t in range(self.window):
            a = scaled @ held[t]
            np.tanh(a, out=a)
            a[: 3 * u] *= 0.5
            a[: 3 * u] += 0.5
            before, c = c, a[:u] * c + a[u : 2 * u] * a[3 * u :]
            far = np.tanh(c)
            np.multiply(a[2 * u : 3 * u], far, out=held[t + 1, :u])
            kept.append((a, before, far))
        last = held[-1, :u]
        miss = w["out0.w"].T @ last + w["out0.b"][:, None]
        miss -= x.reshape(n, -1).T
        g = miss * (2 / miss.size)
        _slope(out, "out0", last, g)
        dh, dc, total, da = w["out0.w"] @ g, 0.0, np.zeros_like(gates), np.empty((4 * u, n), x.dtype)
        for t in reversed(range(self.window)):
            a, before, far = kept[t]
            f, i, o, new = (a[j * u : (j + 1) * u] for j in range(4))
            dc = dc + dh * o * (1 - far * far)
            np.multiply(dc, before, out=da[:u])
            np.multiply(dc, new, out=da[u : 2 * u])
            np.multiply(dh, far, out=da[2 * u : 3 * u])
            da[: 3 * u] *= a[: 3 * u] * (1 - a[: 3 * u])
            np.multiply(dc * i, 1 - new * new, out=da[3 * u :])
            total += held[t] @ da.T
            dh, dc = gates[:u] @ da, dc * f
        for j, name in enumerate("fioc"):
            g = total[:, j * u : (j + 1) * u]
            out[name + "h.w"], out[name + "x.w"], out[name + "x.b"], out[name + "h.b"] = g[:u], g[u:-1], g[-1], g[-1]
        return float((miss * miss).mean()), out

    def score(self, w, x):
        return ((self.forward(_fixed(w), Var(x, live=False)).value[:, -1] - x[:, -1]) ** 2).mean(axis=1)


class Omni(Variational):
    """A gated recurrent encoder of the window, then a variational coder of its last row."""

    sequence = True

    def __init__(self, d, hidden=16, latent=4, window=5):
        super().__init__(d, hidden, 4, window)

    def init(self, rng):
        w: Weights = {}
        for g in "rzn":
            _dense(rng, w, g + "x", self.d, self.hidden)
            _dense(rng, w, g + "h", self.hidden, self.hidden)
        _dense(rng, w, "mu0", self.hidden, self.latent)
        _dense(rng, w, "lv0", self.hidden, self.latent)
        _chain(rng, w, "dec", self.latent, self.hidden, self.d)
        return w

    def body(self, w, x):
        h = Var(np.zeros((x.value.shape[0], self.hidden)), live=False)
        for t in range(self.window):
            now = x[:, t, :]
            r, z = _gate(w, "r", now, h).sigmoid(), _gate(w, "z", now, h).sigmoid()
            new = (now @ w["nx.w"] + w["nx.b"] + r * (h @ w["nh.w"] + w["nh.b"])).tanh()
            h = (1.0 - z) * new + z * h
        return h

    def coded(self, w, x):
        u, d = self.hidden, self.d
        gates, held = _stacked(w, "rzn", u, x)
        # the third gate's parts of input and state are apart, as the first gate weighs the latter
        gates = np.concatenate([gates, np.zeros((u + d + 1, u), x.dtype)], axis=1)
        gates[:u, 3 * u :], gates[-1, 3 * u :] = w["nh.w"], w["nh.b"]
        gates[:u, 2 * u : 3 * u], gates[-1, 2 * u : 3 * u] = 0, w["nx.b"]
        scaled = np.ascontiguousarray((gates * np.r_[np.full(2 * u, 0.5), np.ones(2 * u)].astype(x.dtype)).T)
        kept = []
        for t in range(self.window):
            a, h = scaled @ held[t], held[t, :u]
            np.tanh(a[: 2 * u], out=a[: 2 * u])
            a[: 2 * u] *= 0.5
            a[: 2 * u] += 0.5
            r, z, new, old = (a[j * u : (j + 1) * u] for j in range(4))
            new += r * old
            np.tanh(new, out=new)
            np.add(new, z * (h - new), out=held[t + 1, :u])
            kept.append(a)

        def back(dh, out):
            total, da = np.zeros_like(gates), np.empty((4 * u, dh.shape[1]), x.dtype)
            for t in reversed(range(self.window)):
                a, h = kept[t], held[t, :u]
                r, z, new, old = (a[j * u : (j + 1) * u] for j in range(4))
                dn = dh * (1 - z) * (1 - new * new)
                np.multiply(dn, old, out=da[:u])
                np.multiply(dh, h - new, out=da[u : 2 * u])
                da[: 2 * u] *= a[: 2 * u] * (1 - a[: 2 * u])
                da[2 * u : 3 * u] = dn
                np.multiply(dn, r, out=da[3 * u :])
                total += held[t] @ da.T
                dh = dh * z + gates[:u] @ da
            for j, name in enumerate("rz"):
                g = total[:, j * u : (j + 1) * u]
                out[name + "h.w"], out[name + "x.w"], out[name + "x.b"], out[name + "h.b"] = g[:u], g[u:-1], g[-1], g[-1]
            out["nx.w"], out["nx.b"] = total[u:-1, 2 * u : 3 * u], total[-1, 2 * u : 3 * u]
            out["nh.w"], out["nh.b"] = total[:u, 3 * u :], total[-1, 3 * u :]

        return held[-1, :u], back

    def target(self, x):
        return x[:, -1, :]


NETWORKS: dict[str, Callable[..., Network]] = {"autoencoder": Autoencoder, "vae": Variational, "usad": Usad, "gan": Adversarial, "transformer": Transformer, "lstm": Lstm, "omnianomaly": Omni}
