"""A character-level bidirectional LSTM with a linear-chain CRF on top, in numpy.

Arrays are (time, batch, ...). Sequences of a batch are padded at the end; padded places neither
change the state nor count in the loss.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEVER = -1e4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Tagger:
    """Weights of the network. ``allowed`` marks the tag changes that can be; ``opening`` the first tags that can be."""

    weights: dict[str, np.ndarray]
    allowed: np.ndarray
    opening: np.ndarray

    @classmethod
    def start(cls, symbols: int, allowed: np.ndarray, opening: np.ndarray, width: int = 12, hidden: int = 24, seed: int = 1):
        rng, tags = np.random.default_rng(seed), len(opening)
        w = {"embed": rng.normal(0, 0.3, (symbols, width)), "out": rng.normal(0, 0.3, (2 * hidden, tags)),
             "bias": np.zeros(tags), "change": np.zeros((tags, tags))}
        for way in ("fore", "back"):
            w[f"{way}_in"] = rng.normal(0, 0.3, (width, 4 * hidden))
            w[f"{way}_own"] = rng.normal(0, 0.2, (hidden, 4 * hidden))
            w[f"{way}_bias"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)  # gates: in, keep, out, new
        return cls({k: v.astype(np.float32) for k, v in w.items()}, allowed, opening)

    def _lstm(self, x: np.ndarray, mask: np.ndarray, way: str):
        """States of one direction; ``x`` and ``mask`` already run that way."""
        own, hidden = self.weights[f"{way}_own"], self.weights[f"{way}_own"].shape[0]
        lead = x @ self.weights[f"{way}_in"] + self.weights[f"{way}_bias"]
        h = c = np.zeros((x.shape[1], hidden), np.float32)
        states, tape = np.empty((*x.shape[:2], hidden), np.float32), []
        for t in range(len(x)):
            z = lead[t] + h @ own
            gates, new = sigmoid(z[:, :3 * hidden]), np.tanh(z[:, 3 * hidden:])
            i, f, o = gates[:, :hidden], gates[:, hidden:2 * hidden], gates[:, 2 * hidden:]
            m = mask[t][:, None]
            grown = f * c + i * new
            squashed = np.tanh(grown)
            tape.append((h, c, i, f, o, new, squashed))
            c = np.where(m, grown, c)
            h = np.where(m, o * squashed, h)
            states[t] = h
        return states, tape

    def _lstm_gradient(self, x, mask, way, tape, d_states, out):
        own, hidden = self.weights[f"{way}_own"], self.weights[f"{way}_own"].shape[0]
        d_lead = np.zeros((*x.shape[:2], 4 * hidden), np.float32)
        d_h = d_c = np.zeros((x.shape[1], hidden), np.float32)
        d_own = np.zeros_like(own)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, new, squashed = tape[t]
            m = mask[t][:, None]
            d_h = d_h + d_states[t]
            d_out = np.where(m, d_h, 0)
            d_grown = np.where(m, d_c, 0) + d_out * o * (1 - squashed ** 2)
            dz = np.concatenate([d_grown * new * i * (1 - i), d_grown * c * f * (1 - f), d_out * squashed * o * (1 - o),
                                 d_grown * i * (1 - new ** 2)], 1)
            d_lead[t] = dz
            d_own += h.T @ dz
            d_c = np.where(m, d_grown * f, d_c)
            d_h = np.where(m, dz @ own.T, d_h)
        flat = d_lead.reshape(-1, 4 * hidden)
        out[f"{way}_own"], out[f"{way}_bias"] = d_own, flat.sum(0)
        out[f"{way}_in"] = x.reshape(-1, x.shape[-1]).T @ flat
        return d_lead @ self.weights[f"{way}_in"].T

    def emissions(self, symbols: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        x = self.weights["embed"][symbols]
        fore, fore_tape = self._lstm(x, mask, "fore")
        back, back_tape = self._lstm(x[::-1], mask[::-1], "back")
        both = np.concatenate([fore, back[::-1]], 2)
        if keep is not None:
            keep += [x, both, fore_tape, back_tape]
        return both @ self.weights["out"] + self.weights["bias"]

    def _changes(self) -> np.ndarray:
        return np.where(self.allowed, self.weights["change"], NEVER)

    def _chains(self, scores: np.ndarray, mask: np.ndarray):
        """Forward and backward log-sums of the CRF and its log-partition."""
        change, first = self._changes(), np.where(self.opening, 0, NEVER)
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + first
        for t in range(1, len(scores)):
            step = log_sum(alpha[t - 1][:, :, None] + change, 1) + scores[t]
            alpha[t] = np.where(mask[t][:, None], step, alpha[t - 1])
        for t in range(len(scores) - 2, -1, -1):
            step = log_sum(change + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[t + 1][:, None], step, beta[t + 1])
        return alpha, beta, log_sum(alpha[-1], 1)

    def marginals(self, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
        alpha, beta, z = self._chains(scores, mask)
        return np.exp(alpha + beta - z[None, :, None])

    def loss(self, symbols: np.ndarray, mask: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood of the tags, and its gradient."""
        keep: list = []
        scores = self.emissions(symbols, mask, keep)
        x, both, fore_tape, back_tape = keep
        change, (alpha, beta, z) = self._changes(), self._chains(scores, mask)
        n = symbols.shape[1]
        gold = (np.take_along_axis(scores, tags[..., None], 2)[..., 0] * mask).sum() \
            + (change[tags[:-1], tags[1:]] * mask[1:]).sum()
        d_scores = np.exp(alpha + beta - z[None, :, None])
        np.put_along_axis(d_scores, tags[..., None], np.take_along_axis(d_scores, tags[..., None], 2) - 1, 2)
        d_scores = (d_scores * mask[..., None] / n).astype(np.float32)
        pair = np.zeros(change.shape)
        for t in range(1, len(scores)):
            both_tags = np.exp(alpha[t - 1][:, :, None] + change + (scores[t] + beta[t] - z[:, None])[:, None, :])
            pair += (both_tags * mask[t][:, None, None]).sum(0)
        np.subtract.at(pair, (tags[:-1][mask[1:]], tags[1:][mask[1:]]), 1)
        out = {"change": np.where(self.allowed, pair / n, 0).astype(np.float32), "bias": d_scores.sum((0, 1))}
        flat = both.reshape(-1, both.shape[-1])
        out["out"] = flat.T @ d_scores.reshape(len(flat), -1)
        d_both = d_scores @ self.weights["out"].T
        hidden = both.shape[-1] // 2
        d_x = self._lstm_gradient(x, mask, "fore", fore_tape, d_both[..., :hidden], out)
        d_x = d_x + self._lstm_gradient(x[::-1], mask[::-1], "back", back_tape, d_both[::-1, :, hidden:], out)[::-1]
        out["embed"] = np.zeros_like(self.weights["embed"])
        np.add.at(out["embed"], symbols, d_x)
        return float((z.sum() - gold) / n), out

    def train(self, batches, rate: float = 0.02) -> list[float]:
        """Adam over the batches (symbols, mask, tags); the losses."""
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses = []
        for step, batch in enumerate(batches, 1):
            loss, gradient = self.loss(*batch)
            losses.append(loss)
            norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in gradient.values()))
            for k, g in gradient.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                pace = rate / np.sqrt(step / 100 + 1)
                self.weights[k] -= (pace * (first[k] / (1 - 0.9 ** step))
                                    / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Best tags of each sequence (Viterbi); padded places repeat the last tag."""
        change = self._changes()
        best = scores[0] + np.where(self.opening, 0, NEVER)
        back = np.empty(scores.shape, np.int16)
        own = np.arange(scores.shape[2], dtype=np.int16)
        for t in range(1, len(scores)):
            reach = best[:, :, None] + change
            back[t] = np.where(mask[t][:, None], reach.argmax(1), own)
            best = np.where(mask[t][:, None], reach.max(1) + scores[t], best)
        tags = np.empty(scores.shape[:2], np.int16)
        tags[-1] = best.argmax(1)
        for t in range(len(scores) - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(len(best)), tags[t]]
        return tags
