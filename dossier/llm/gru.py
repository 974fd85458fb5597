"""A bidirectional gated recurrent network in numpy: forward pass, backpropagation through time, Adam.

Arrays are (time, feature, batch), so that gates are contiguous blocks. A masked position resets the state. Numbers are of
the parameters' kind: fits in doubles repeat on other machines, where sums of 32 bits soon lead elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Params = dict[str, np.ndarray]
F4 = np.float32


def gates(rng: np.random.Generator, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """Recurrent weights (3 hidden, hidden) for update, reset and candidate, and their biases."""
    return (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(F4), np.zeros((3 * hidden, 1), F4)


def run(inputs: Callable[[int], np.ndarray], mask: np.ndarray, u: np.ndarray, b: np.ndarray, backwards: bool, keep: list | None = None) -> np.ndarray:
    """States (time, hidden, batch). inputs(t): the input's part of the three gates. keep: gets what backward() needs."""
    steps, batch = mask.shape
    hidden = u.shape[1]
    kind = u.dtype
    half = np.ones((3 * hidden, 1), kind)
    half[: 2 * hidden] = 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
    uh, bh = u * half, b * half
    out = np.empty((steps, hidden, batch), kind)
    h = np.zeros((hidden, batch), kind)
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        x = inputs(t)
        g = uh @ h
        g += bh
        zr = x[: 2 * hidden] * kind.type(0.5)
        zr += g[: 2 * hidden]
        np.tanh(zr, out=zr)
        zr *= kind.type(0.5)
        zr += kind.type(0.5)
        z, r = zr[:hidden], zr[hidden:]
        n = r * g[2 * hidden :]
        n += x[2 * hidden :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        new *= mask[t]
        if keep is not None:
            keep.append((t, h, z, r, n, g[2 * hidden :]))
        out[t] = h = new
    return out


def backward(d_out: np.ndarray, kept: list, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the gate inputs (time, 3 hidden, batch), of u and of b, from those of the states."""
    hidden = u.shape[1]
    d_in = np.zeros((len(mask), 3 * hidden, mask.shape[1]), u.dtype)
    d_u, d_b = np.zeros_like(u), np.zeros((3 * hidden, 1), u.dtype)
    d_h = np.zeros((hidden, mask.shape[1]), u.dtype)
    for t, h, z, r, n, g_n in reversed(kept):
        d = (d_h + d_out[t]) * mask[t]
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * g_n * r * (1 - r)
        d_in[t] = np.concatenate([d_z, d_r, d_n])
        d_g = np.concatenate([d_z, d_r, d_n * r])
        d_u += d_g @ h.T
        d_b += d_g.sum(axis=1, keepdims=True)
        d_h = d * z + u.T @ d_g
    return d_in, d_u, d_b


class Adam:
    def __init__(self, params: Params, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def scatter_rows(shape: tuple[int, int], ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (rows) by id into a table."""
    out = np.zeros(shape, values.dtype)
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    out[ids[head]] = np.add.reduceat(values, head, axis=0)
    return out
