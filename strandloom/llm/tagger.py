"""Character tagger: a bidirectional LSTM with CRF transitions, in numpy.

Small on purpose: a worker tags many short windows at once, so every step is one
matrix product over the whole batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Symbols: ASCII as it is, then other letters, then everything else.
SYMBOLS = 130
KINDS = ["email", "ip", "card", "phone", "secret"]
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
_NEVER = -1e4


def symbols(texts: list[str], width: int) -> np.ndarray:
    """Symbol numbers of texts, padded with 0 to ``width``."""
    points = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width)
    letter = (points >= 0xC0) & (points < 0x2000) | (points >= 0x2C00) & (points < 0x1F000)
    return np.where(points < 128, points, np.where(letter, 128, 129)).astype(np.int64)


def allowed() -> np.ndarray:
    """Score 0 for tag pairs that may follow each other, else very low."""
    out = np.zeros((TAGS, TAGS))
    for inside in range(2, TAGS, 2):
        out[:, inside] = _NEVER
        out[[inside - 1, inside], inside] = 0
    return out


@dataclass
class Tagger:
    hidden: int = 16
    seed: int = 0
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.p:
            rng, h = np.random.default_rng(self.seed), self.hidden
            for side in "fb":
                self.p[f"x{side}"] = rng.normal(0, 0.3, (SYMBOLS, 4 * h))
                self.p[f"h{side}"] = rng.normal(0, 0.8 / np.sqrt(h), (h, 4 * h))
                self.p[f"x{side}"][:, h : 2 * h] += 1.0  # remember at first
            self.p["o"] = rng.normal(0, 0.3, (2 * h, TAGS))
            self.p["ob"], self.p["t"] = np.zeros(TAGS), np.zeros((TAGS, TAGS))

    def _side(self, side: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps x batch x hidden) of one direction over steps x batch symbols."""
        steps, batch = x.shape
        h, n = self.hidden, np.float32 if keep is None else np.float64
        wx, wh = self.p[f"x{side}"].astype(n), self.p[f"h{side}"].astype(n)
        state, cell, out = np.zeros((batch, h), n), np.zeros((batch, h), n), np.empty((steps, batch, h), n)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = wx[x[t]] + state @ wh
            z[:, : 3 * h] *= 0.5
            np.tanh(z, out=z)
            gate = 0.5 * z[:, : 3 * h] + 0.5
            before, new = cell, z[:, 3 * h :]
            cell = gate[:, h : 2 * h] * before + gate[:, :h] * new
            squashed = np.tanh(cell)
            if keep is not None:
                keep.append((t, state, before, gate, new, squashed))
            state = gate[:, 2 * h :] * squashed
            out[t] = state
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (steps x batch x tags)."""
        h = np.concatenate([self._side("f", x), self._side("b", x)], axis=2)
        return h @ self.p["o"].astype(np.float32) + self.p["ob"].astype(np.float32)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (batch x steps) of batch x steps symbols (Viterbi)."""
        e = self.emissions(np.ascontiguousarray(x.T))
        move = (self.p["t"] + allowed()).astype(np.float32)
        start = np.where(np.arange(TAGS) % 2 == 0, _NEVER, 0).astype(np.float32)
        start[0] = 0
        best, back = e[0] + start, np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            both = best[:, :, None] + move
            back[t] = both.argmax(axis=1)
            best = np.take_along_axis(both, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + e[t]
        tags = np.empty(x.shape, np.int8)
        now = best.argmax(axis=1)
        for t in range(len(e) - 1, -1, -1):
            tags[:, t] = now
            now = back[t][np.arange(len(now)), now] if t else now
        return tags

    def _loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per character and its gradients; x, y: steps x batch."""
        steps, batch = x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._side(s, x, kept[s]) for s in "fb"], axis=2)
        e = h @ self.p["o"] + self.p["ob"]
        move = self.p["t"] + allowed()
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + np.where((np.arange(TAGS) % 2 == 0) & (np.arange(TAGS) > 0), _NEVER, 0)
        for t in range(1, steps):
            both = alpha[t - 1][:, :, None] + move
            top = both.max(axis=1)
            alpha[t] = top + np.log(np.exp(both - top[:, None]).sum(axis=1)) + e[t]
        for t in range(steps - 2, -1, -1):
            both = move[None] + (e[t + 1] + beta[t + 1])[:, None, :]
            top = both.max(axis=2)
            beta[t] = top + np.log(np.exp(both - top[:, :, None]).sum(axis=2))
        top = alpha[-1].max(axis=1)
        total = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(axis=1))
        eye = np.eye(TAGS)
        de = np.exp(alpha + beta - total[None, :, None]) - eye[y]
        dt = np.zeros((TAGS, TAGS))
        gold = np.take_along_axis(e, y[:, :, None], axis=2).sum()
        for t in range(1, steps):
            pair = alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - total[:, None, None]
            dt += np.exp(pair).sum(axis=0)
            np.add.at(dt, (y[t - 1], y[t]), -1)
            gold += move[y[t - 1], y[t]].sum()
        g = {"t": dt, "ob": de.sum(axis=(0, 1)), "o": np.einsum("tbh,tbk->hk", h, de)}
        dh = de @ self.p["o"].T
        n = self.hidden
        for s, own in (("f", dh[:, :, :n]), ("b", dh[:, :, n:])):
            gh, steps_z, steps_x = np.zeros_like(self.p[f"h{s}"]), [], []
            dstate, dcell = np.zeros((batch, n)), np.zeros((batch, n))
            for t, state, before, gate, new, squashed in reversed(kept[s]):
                d = own[t] + dstate
                dcell = dcell + d * gate[:, 2 * n :] * (1 - squashed**2)
                dgate = np.concatenate([dcell * new, dcell * before, d * squashed], axis=1) * gate * (1 - gate)
                dz = np.concatenate([dgate, dcell * gate[:, :n] * (1 - new**2)], axis=1)
                steps_z.append(dz)
                steps_x.append(x[t])
                gh += state.T @ dz
                dstate, dcell = dz @ self.p[f"h{s}"].T, dcell * gate[:, n : 2 * n]
            cells = np.concatenate(steps_x)[:, None] * 4 * n + np.arange(4 * n)
            gx = np.bincount(cells.ravel(), np.concatenate(steps_z).ravel(), SYMBOLS * 4 * n)
            g[f"x{s}"], g[f"h{s}"] = gx.reshape(SYMBOLS, 4 * n), gh
        size = steps * batch
        return float((total.sum() - gold) / size), {k: v / batch for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int, batch: int = 64, rate: float = 0.02) -> list[float]:
        """Adam over random batches of the labelled windows (rows of x and y)."""
        rng, m, v, losses = np.random.default_rng(self.seed + 1), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, []
        for i in range(1, rounds + 1):
            pick = rng.integers(0, len(x), batch)
            loss, grads = self._loss(np.ascontiguousarray(x[pick].T), np.ascontiguousarray(y[pick].T))
            losses.append(loss)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            step = rate * (1 - i / (rounds + 1))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g**2
                self.p[k] = self.p[k] - step * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
        return losses
