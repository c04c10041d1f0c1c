"""A small character tagger in numpy: bidirectional LSTM and a linear-chain CRF,
trained by back-propagation and Adam, decoded by Viterbi. Windows of a batch run
side by side, so a time step is one matrix product."""

from __future__ import annotations

import numpy as np

_NEVER = -1e4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """``classes`` input symbols, ``kinds`` kinds of spans; tags are 0 for
    outside, 1 + 2k for the first and 2 + 2k for a later character of kind k."""

    def __init__(self, classes: int, kinds: int, hidden: int, seed: int):
        r = np.random.default_rng(seed)
        self.hidden, self.tags = hidden, 1 + 2 * kinds
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = r.normal(0, 0.3, (classes, 4 * hidden)).astype(np.float32)
            self.p["x" + d][:, hidden:2 * hidden] += 1      # forget gates start open
            self.p["h" + d] = r.normal(0, 0.3 / np.sqrt(hidden) * 2, (hidden, 4 * hidden)).astype(np.float32)
            self.p["o" + d] = r.normal(0, 0.3, (hidden, self.tags)).astype(np.float32)
        self.p["bias"] = np.zeros(self.tags, np.float32)
        self.p["move"] = np.zeros((self.tags, self.tags), np.float32)
        self.allowed = np.zeros((self.tags, self.tags), np.float32)
        for to in range(2, self.tags, 2):                   # a later character follows its own kind only
            self.allowed[:, to] = _NEVER
            self.allowed[to - 1:to + 1, to] = 0

    # -- LSTM ------------------------------------------------------------------
    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states (L, B, H) of direction d over symbols (L, B)."""
        n, batch = x.shape
        k = self.hidden
        h = np.zeros((batch, k), np.float32)
        c = np.zeros((batch, k), np.float32)
        out = np.empty((n, batch, k), np.float32)
        tape = []
        steps = range(n) if d == "f" else range(n - 1, -1, -1)
        for t in steps:
            z = self.p["x" + d][x[t]] + h @ self.p["h" + d]
            s = _sigmoid(z[:, :3 * k])
            g = np.tanh(z[:, 3 * k:])
            i, f, o = s[:, :k], s[:, k:2 * k], s[:, 2 * k:]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                tape.append((t, h, c, i, f, o, g, tc))
            h, c = o * tc, c_new
            out[t] = h
        return out, tape

    def _back(self, x: np.ndarray, d: str, tape, dout: np.ndarray, grad: dict) -> None:
        dh = np.zeros_like(dout[0])
        dc = np.zeros_like(dh)
        w = self.p["h" + d]
        for t, h, c, i, f, o, g, tc in reversed(tape):
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o),
                                 dc * i * (1 - g * g)], axis=1)
            np.add.at(grad["x" + d], x[t], dz)
            grad["h" + d] += h.T @ dz
            dh, dc = dz @ w.T, dc * f

    def emissions(self, x: np.ndarray, keep: bool = False):
        hf, tf = self._run(x, "f", keep)
        hb, tb = self._run(x, "b", keep)
        e = hf @ self.p["of"] + hb @ self.p["ob"] + self.p["bias"]
        return e, (hf, tf, hb, tb)

    # -- CRF -------------------------------------------------------------------
    def _moves(self) -> np.ndarray:
        return self.p["move"] + self.allowed

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss and gradients for symbols x and tags y, both (L, B)."""
        n, batch = x.shape
        e, (hf, tf, hb, tb) = self.emissions(x, keep=True)
        move = self._moves()
        alpha = np.empty_like(e)
        alpha[0] = e[0]                             # a window may start within a span
        for t in range(1, n):
            alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + move, 1)
        beta = np.zeros_like(e)
        for t in range(n - 2, -1, -1):
            beta[t] = _logsum(move[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        dmove = np.zeros_like(move)
        for t in range(1, n):
            joint = alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - z[:, None, None]
            dmove += np.exp(joint).sum(0)
        rows = np.arange(batch)
        score = sum(e[t, rows, y[t]].sum() for t in range(n))
        score += sum(move[y[t - 1], y[t]].sum() for t in range(1, n))
        for t in range(n):
            de[t, rows, y[t]] -= 1
        for t in range(1, n):
            np.add.at(dmove, (y[t - 1], y[t]), -1)
        de = (de / batch).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["move"] = (dmove / batch * (self.allowed == 0)).astype(np.float32)
        grad["bias"] = de.sum((0, 1))
        flat = de.reshape(-1, self.tags)
        grad["of"] = hf.reshape(-1, self.hidden).T @ flat
        grad["ob"] = hb.reshape(-1, self.hidden).T @ flat
        self._back(x, "f", tf, de @ self.p["of"].T, grad)
        self._back(x, "b", tb, de @ self.p["ob"].T, grad)
        return float(z.sum() - score) / batch, grad

    def fit(self, batches, rate: float = 0.02) -> list[float]:
        """Adam over (x, y) batches, the rate falling to a tenth; the losses."""
        batches = list(batches)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses = []
        for t, (x, y) in enumerate(batches, 1):
            loss, grad = self.step(x, y)
            losses.append(loss)
            norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
            lr = rate * (0.1 + 0.9 * 0.5 * (1 + np.cos(np.pi * t / len(batches))))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (lr * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-6)).astype(np.float32)
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (L, B) by Viterbi."""
        e, _ = self.emissions(x)
        n, batch = x.shape
        move = self._moves()
        best = e[0]
        back = np.zeros((n, batch, self.tags), np.int8)
        for t in range(1, n):
            options = best[:, :, None] + move
            back[t] = options.argmax(1)
            best = options.max(1) + e[t]
        y = np.empty((n, batch), np.int8)
        y[-1] = best.argmax(1)
        rows = np.arange(batch)
        for t in range(n - 1, 0, -1):
            y[t - 1] = back[t, rows, y[t]]
        return y
