"""A bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BiGru:
    """Scores windows of word vectors: x[n, t, d] -> a logit for each window.

    Per direction r = s(x Wr + h Ur + br), z = s(x Wz + h Uz + bz), c = tanh(x Wc + bc + r * (h Uc)) and
    h' = (1 - z) c + z h. Both directions' states are pooled with weights softmax(h v), and the pool gives the logit.
    ``mask`` is 0 at padding: states pass through it and attention skips it.
    """

    def __init__(self, inputs: int, hidden: int, seed: int = 0) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.d, self.h = inputs, hidden
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p[f"W{side}"] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 3 * hidden))
            self.p[f"U{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            self.p[f"b{side}"] = np.zeros(3 * hidden)
        self.p["v"] = rng.normal(0, 0.5, 2 * hidden)
        self.p["w"] = rng.normal(0, 0.5, 2 * hidden)
        self.p["c"] = np.zeros(1)

    def _run(self, gates, order, side: str, mask: np.ndarray | None, keep: list | None) -> list[np.ndarray]:
        """States at each place; ``gates(t)`` is x Wt + b there. ``keep`` gets what the way back needs."""
        u, k = self.p[f"U{side}"], self.h
        states: dict[int, np.ndarray] = {}
        h = None
        for t in order:
            g = gates(t)
            if h is None:
                h = np.zeros((len(g), k), g.dtype)
            hu = h @ u
            rz = sigmoid(g[:, : 2 * k] + hu[:, : 2 * k])
            r, z = rz[:, :k], rz[:, k:]
            c = np.tanh(g[:, 2 * k :] + r * hu[:, 2 * k :])
            new = c + z * (h - c)
            if mask is not None:
                m = mask[:, t, None]
                new = m * new + (1 - m) * h
            if keep is not None:
                keep.append((t, h, r, z, c, hu[:, 2 * k :]))
            states[t] = h = new
        return [states[t] for t in range(len(states))]

    def _pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = states @ self.p["v"]
        if mask is not None:
            e = np.where(mask > 0, e, -30.0).astype(e.dtype)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        a = e / e.sum(axis=1, keepdims=True)
        pool = np.matmul(a[:, None, :], states)[:, 0, :]
        return a, pool, pool @ self.p["w"] + self.p["c"]

    def score(self, table: np.ndarray, rows: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Logits of windows given as rows of ``table``, which holds both directions' x W + b of each known word."""
        k, length = 3 * self.h, rows.shape[1]
        f = self._run(lambda t: table[rows[:, t], :k], range(length), "f", mask, None)
        b = self._run(lambda t: table[rows[:, t], k:], range(length - 1, -1, -1), "b", mask, None)
        states = np.concatenate([np.stack(f, 1), np.stack(b, 1)], axis=2)
        return self._pool(states, mask)[2]

    def gates(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], axis=1)

    def as_float32(self) -> BiGru:
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean weighted log loss, its gradient by parameter, and by x."""
        n, length, _ = x.shape
        k, p = self.h, self.p
        kept: dict[str, list] = {"f": [], "b": []}
        sides = {"f": range(length), "b": range(length - 1, -1, -1)}
        states = []
        for s, order in sides.items():
            pre = x @ p[f"W{s}"] + p[f"b{s}"]
            states.append(np.stack(self._run(lambda t, pre=pre: pre[:, t], order, s, mask, kept[s]), 1))
        both = np.concatenate(states, axis=2)
        a, pool, logit = self._pool(both, mask)
        prob = sigmoid(logit)
        loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / weight.sum())
        dlogit = weight * (prob - y) / weight.sum()
        g = {name: np.zeros_like(v) for name, v in p.items()}
        g["w"], g["c"] = pool.T @ dlogit, np.array([dlogit.sum()])
        dpool = dlogit[:, None] * p["w"]
        da = np.einsum("nk,ntk->nt", dpool, both)
        de = a * (da - (a * da).sum(1, keepdims=True))
        dboth = a[:, :, None] * dpool[:, None, :] + de[:, :, None] * p["v"]
        g["v"] = np.einsum("nt,ntk->k", de, both)
        dx = np.zeros_like(x)
        for i, s in enumerate("fb"):
            dh = np.zeros((n, k))
            own = dboth[:, :, i * k : (i + 1) * k]
            for t, h, r, z, c, hc in reversed(kept[s]):
                dnew = dh + own[:, t]
                dh = np.zeros_like(dnew)
                if mask is not None:
                    m = mask[:, t, None]
                    dh += (1 - m) * dnew
                    dnew = m * dnew
                dc = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (h - c) * z * (1 - z)
                dr = dc * hc * r * (1 - r)
                dg = np.concatenate([dr, dz, dc], axis=1)
                du = np.concatenate([dr, dz, dc * r], axis=1)
                g[f"W{s}"] += x[:, t].T @ dg
                g[f"b{s}"] += dg.sum(0)
                g[f"U{s}"] += h.T @ du
                dx[:, t] += dg @ p[f"W{s}"].T
                dh += dnew * z + du @ p[f"U{s}"].T
        return loss, g, dx


class Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)
