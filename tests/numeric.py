"""Independent numpy solutions the Spark fits are compared with."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def dummies(values, levels):
    return np.column_stack([(np.asarray(values) == v).astype(float) for v in levels[1:]])


def logistic(x, y, steps=30):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        mu = sigmoid(x @ beta)
        info = x.T @ (x * (mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(info, x.T @ (y - mu))
    return beta, np.sqrt(np.diag(np.linalg.inv(info)))


def lasso(x, y, penalty, steps=60_000):
    """Proximal gradient on standardised columns; x has no intercept column."""
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    b, b0 = np.zeros(x.shape[1]), 0.0
    lipschitz = 0.25 * np.linalg.eigvalsh(np.c_[np.ones(len(z)), z].T @ np.c_[np.ones(len(z)), z] / len(z))[-1]
    for _ in range(steps):
        r = sigmoid(b0 + z @ b) - y
        new0 = b0 - r.mean() / lipschitz
        step = b - z.T @ r / len(y) / lipschitz
        new = np.sign(step) * np.maximum(np.abs(step) - penalty / lipschitz, 0)
        done = max(np.abs(new - b).max(), abs(new0 - b0)) < 1e-13
        b, b0 = new, new0
        if done:
            break
    return b0 - np.sum(b * mean / sd), b / sd


def laplace_deviance(x, z, group, y, beta, sigma, steps=60):
    """-2 log-likelihood by the Laplace approximation, mode found for given beta."""
    groups, q = group.max() + 1, z.shape[1]
    precision = np.linalg.inv(sigma)
    total = 0.0
    for j in range(groups):
        rows = group == j
        off, zj, yj = x[rows] @ beta, z[rows], y[rows]
        u = np.zeros(q)
        for _ in range(steps):
            mu = sigmoid(off + zj @ u)
            h = zj.T @ (zj * (mu * (1 - mu))[:, None]) + precision
            u = u + np.linalg.solve(h, zj.T @ (yj - mu) - precision @ u)
        eta = off + zj @ u
        ll = np.sum(yj * eta - np.logaddexp(0, eta))
        total += -2 * ll + u @ precision @ u + np.linalg.slogdet(sigma @ h)[1]
    return total


def nelder_mead(f, start, step=0.1, iterations=1500):
    n = len(start)
    simplex = [np.array(start, float)] + [
        np.array(start, float) + step * np.eye(n)[i] for i in range(n)
    ]
    values = [f(p) for p in simplex]
    for _ in range(iterations):
        order = np.argsort(values)
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-8:
            break
        centre = np.mean(simplex[:-1], axis=0)
        away = centre + (centre - simplex[-1])
        fa = f(away)
        if fa < values[0]:
            far = centre + 2 * (centre - simplex[-1])
            ff = f(far)
            simplex[-1], values[-1] = (far, ff) if ff < fa else (away, fa)
        elif fa < values[-2]:
            simplex[-1], values[-1] = away, fa
        else:
            near = centre + 0.5 * (simplex[-1] - centre)
            fn = f(near)
            if fn < values[-1]:
                simplex[-1], values[-1] = near, fn
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (p - simplex[0]) for p in simplex[1:]]
                values = [values[0]] + [f(p) for p in simplex[1:]]
    return simplex[0], values[0]
