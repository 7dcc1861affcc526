"""Small numeric models that are fitted on bounded samples: ridge by normal equations, isotonic calibration."""

from __future__ import annotations

import numpy as np


def fourier_features(x: np.ndarray, weights: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, with a constant column; one row per row of x."""
    z = np.cos(x @ weights + phases) * np.sqrt(2.0 / weights.shape[1])
    return np.hstack([z, np.ones((len(x), 1))])


def fourier_basis(d_in: int, d_out: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, 1.0 / width, (d_in, d_out)), rng.uniform(0.0, 2 * np.pi, d_out)


def ridge(gram: np.ndarray, moment: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge weights from summed normal equations; the last (constant) feature is not shrunk."""
    penalty = np.full(len(gram), alpha)
    penalty[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(penalty), moment)


def isotonic_knots(score: np.ndarray, positives: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over points sorted by score; the knots (mean score, rate) of the increasing fit.

    Each block's rate is smoothed by half a row of either label, so that no score is 0 or 1 for certain.
    """
    blocks: list[list[float]] = []
    for s, p, w in zip(score, positives, weight, strict=True):
        blocks.append([s * w, p, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2] + a[2]]
    x, y = np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])
    return x, np.maximum.accumulate(y)


def calibrated(score: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Scores on the isotonic curve, linear between its knots."""
    return np.interp(score, *knots) if len(knots[0]) else np.full(len(score), 0.5)
