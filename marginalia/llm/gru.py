"""Gated recurrent networks in numpy, forward and backward through time, shared by the language and toxicity models.

Arrays are feature-major, (features, sequences), so that gates are contiguous slices. The squashing function is
softsign, x / (1 + |x|), for the candidate state and half of it plus a half for the gates: it needs no exponential.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32
#: Projections of a padding step: the update gate is exactly 1, so the state stays as it is.
HOLD = F32(1e12)


def softsign(x: np.ndarray, out: np.ndarray, work: np.ndarray) -> np.ndarray:
    np.abs(x, out=work)
    work += 1
    return np.divide(x, work, out=out)


def pad_column(hidden: int) -> np.ndarray:
    return np.concatenate((np.zeros(hidden, F32), np.full(hidden, HOLD), np.zeros(hidden, F32)))


def run(table: np.ndarray, u: np.ndarray, ids: np.ndarray, reverse: bool, keep: bool = False) -> tuple[np.ndarray, list]:
    """table (3H, V): the input's share of reset, update and candidate for each symbol; ids (T, N). States (T, H, N)."""
    steps, n = ids.shape
    h3 = len(table)
    hidden = h3 // 3
    states, caches = np.empty((steps, hidden, n), F32), [None] * steps
    h, a, pre = np.zeros((hidden, n), F32), np.empty((h3, n), F32), np.empty((h3, n), F32)
    work = np.empty((2 * hidden, n), F32)
    for t in reversed(range(steps)) if reverse else range(steps):
        np.take(table, ids[t], axis=1, out=a, mode="clip")
        np.matmul(u, h, out=pre)
        gates = a[: 2 * hidden]
        gates += pre[: 2 * hidden]
        softsign(gates, gates, work)
        gates *= F32(0.5)
        gates += F32(0.5)
        cand = a[2 * hidden :]
        cand += gates[:hidden] * pre[2 * hidden :]
        softsign(cand, cand, work[:hidden])
        new = states[t]
        np.subtract(h, cand, out=new)
        new *= gates[hidden:]
        new += cand
        if keep:
            caches[t] = (h, a.copy(), pre[2 * hidden :].copy())
        h = new
    return states, caches


def backward(u: np.ndarray, ids: np.ndarray, caches: list, d_states: np.ndarray, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of u and of the table's column at every step, (T, 3H, N), from those of the states."""
    steps, hidden, n = d_states.shape
    d_u, d_a, carry = np.zeros_like(u), np.empty((steps, 3 * hidden, n), F32), np.zeros((hidden, n), F32)
    for t in range(steps) if reverse else reversed(range(steps)):
        h, a, pre = caches[t]
        r, z, c = a[:hidden], a[hidden : 2 * hidden], a[2 * hidden :]
        dh = d_states[t] + carry
        dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
        dz = dh * (h - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dc * pre * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_a[t] = np.concatenate((dr, dz, dc))
        d_pre = np.concatenate((dr, dz, dc * r))
        d_u += d_pre @ h.T
        carry = dh * z + u.T @ d_pre
    return d_u, d_a


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], rate: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            a, b = self.m[k]
            a += 0.1 * (g * clip - a)
            b += 0.01 * ((g * clip) ** 2 - b)
            self.params[k] -= self.rate * rate * (a / (1 - 0.9**self.t)) / (np.sqrt(b / (1 - 0.99**self.t)) + 1e-8)
