"""Linear-chain conditional random field over two labels, in numpy: fitting, marginals and Viterbi decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Emission weights of label 1 against 0 over standardised features, transition scores [from, to] and start scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]


def _padded(x: np.ndarray, y: np.ndarray, lengths: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (n, window), -1 where a sequence has ended, and labels; long sequences become several."""
    rows, at = [], 0
    for n in lengths:
        for lo in range(0, n, window):
            part = np.full(window, -1)
            take = min(window, n - lo)
            part[:take] = np.arange(at + lo, at + lo + take)
            rows.append(part)
        at += n
    rows = np.array(rows).reshape(-1, window)
    return rows, np.where(rows >= 0, y[rows], 0)


def _forward_backward(e: np.ndarray, mask: np.ndarray, steps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, marginals (n, L, 2) and expected transitions (2, 2) of padded sequences with emissions e (n, L)."""
    n, length = e.shape
    em = np.stack([np.zeros_like(e), e], axis=2)
    alpha = np.zeros((n, length, 2))
    alpha[:, 0] = start + em[:, 0]
    for t in range(1, length):
        new = np.logaddexp(alpha[:, t - 1, 0, None] + steps[0], alpha[:, t - 1, 1, None] + steps[1]) + em[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    beta, pairs = np.zeros((n, length, 2)), np.zeros((2, 2))
    for t in range(length - 2, -1, -1):
        after = beta[:, t + 1] + em[:, t + 1]
        new = np.logaddexp(steps[:, 0][None] + after[:, 0, None], steps[:, 1][None] + after[:, 1, None])
        go = mask[:, t + 1, None]
        beta[:, t] = np.where(go, new, beta[:, t + 1])
        p = np.exp(alpha[:, t, :, None] + steps[None] + after[:, None, :] - z[:, None, None])
        pairs += (p * go[:, :, None]).sum(axis=0)
    return z, np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None], pairs


def fit(x: np.ndarray, y: np.ndarray, lengths: list[int], rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3, window: int = 64, begin: Chain | None = None) -> Chain:
    """Maximum likelihood with a ridge penalty, by Adam over the whole sample, from another fit on the same rows if given; the same input gives the same model."""
    mean, scale = x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float) + 1e-6
    scaled = (x - mean) / scale
    window = max(2, min(window, max(lengths)))
    rows, labels = _padded(x, y.astype(int), lengths, window)
    mask, total = rows >= 0, len(x)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][mask[:, 1:]], labels[:, 1:][mask[:, 1:]]), 1)
    first = np.bincount(labels[:, 0], minlength=2).astype(float)
    p = np.zeros(1 + x.shape[1] + 4 + 2) if begin is None else np.concatenate([begin.weights, begin.steps.ravel(), begin.start])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, rounds + 1):
        w, steps, start = p[:-6], p[-6:-2].reshape(2, 2), p[-2:]
        e = np.where(mask, (scaled @ w[1:] + w[0])[rows], 0.0)
        _, marginal, pairs = _forward_backward(e, mask, steps, start)
        miss = np.zeros(total)
        miss[rows[mask]] = (marginal[:, :, 1] - labels)[mask]
        grad = np.concatenate([[miss.sum()], scaled.T @ miss, (pairs - seen).ravel(), marginal[:, 0].sum(axis=0) - first]) / total + ridge * p
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Chain(mean, scale, p[:-6], p[-6:-2].reshape(2, 2), p[-2:])


def marginals(chain: Chain, e: np.ndarray) -> np.ndarray:
    """Probability of label 1 at each place of one sequence with emissions e."""
    n = len(e)
    ratio = np.exp(np.clip(e, -30, 30))
    (a, b), (c, d) = np.exp(chain.steps - chain.steps.max()).tolist()
    forward, f1 = [], float(np.exp(np.clip(chain.start[1] - chain.start[0], -30, 30))) * float(ratio[0]) if n else 0.0
    f0 = 1.0
    for t in range(n):
        if t:
            f0, f1 = f0 * a + f1 * c, (f0 * b + f1 * d) * float(ratio[t])
        s = f0 + f1
        f0, f1 = f0 / s, f1 / s
        forward.append((f0, f1))
    out, b0, b1 = np.empty(n), 1.0, 1.0
    for t in range(n - 1, -1, -1):
        x0, x1 = forward[t][0] * b0, forward[t][1] * b1
        out[t] = x1 / (x0 + x1)
        r1 = b1 * float(ratio[t])
        b0, b1 = a * b0 + b * r1, c * b0 + d * r1
        s = b0 + b1
        b0, b1 = b0 / s, b1 / s
    return out


def viterbi(chain: Chain, e: np.ndarray) -> list[int]:
    """The best labelling of one sequence with emissions e; a tie goes to label 0."""
    if not len(e):
        return []
    (a, b), (c, d) = chain.steps.tolist()
    s0, s1, back = float(chain.start[0]), float(chain.start[1] + e[0]), []
    for x in e[1:].tolist():
        from0, from1 = int(s1 + c > s0 + a), int(s1 + d > s0 + b)
        s0, s1 = max(s0 + a, s1 + c), max(s0 + b, s1 + d) + x
        back.append((from0, from1))
    out = [int(s1 > s0)]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = 1e-2, prior: np.ndarray | None = None, rounds: int = 50) -> np.ndarray:
    """Weights (constant first) of a ridge logistic regression, by Newton steps; ridge may be given for each weight, and what they are drawn to."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag(np.broadcast_to(ridge, x.shape[1]).astype(float))
    if np.ndim(ridge) == 0:
        penalty[0, 0] = 1e-6
    prior = np.zeros(x.shape[1]) if prior is None else prior
    w = prior.astype(float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ (w - prior))
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w
