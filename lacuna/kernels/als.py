"""Bias-plus-low-rank alternating ridge regression on a list of cells, and the pipeline around it.

Any rank uses the same normal equations.  Small tables, of which refits need
thousands, and well filled ones are solved for all members of the ensemble at
once: the sums of the normal equations are one product of the mask with the
members' terms.  Others
take their sums over the observed cells (bincount by row or column), so that the
cost follows the number of cells.  Both give the same numbers.
"""

from __future__ import annotations

import numpy as np

RIDGE, ROUNDS, ENSEMBLES, SEED, START_SPREAD = 0.1, 40, 10, 42, 0.01
LOW, HIGH = 0.5, 99.5


def logit_percent(score: np.ndarray) -> np.ndarray:
    p = np.clip(score, LOW, HIGH) / 100.0
    return np.log(p / (1.0 - p))


def percent_of_logit(x: np.ndarray) -> np.ndarray:
    return 100.0 / (1.0 + np.exp(-x))


def _solve_side(side: np.ndarray, n: int, design: np.ndarray, target: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge solution of every row (or column): [bias, factors...]."""
    k = design.shape[1]
    gram = np.empty((n, k, k))
    for a in range(k):
        for b in range(a, k):
            gram[:, a, b] = gram[:, b, a] = np.bincount(side, design[:, a] * design[:, b], minlength=n)
    gram[:, np.arange(k), np.arange(k)] += ridge
    right = np.stack([np.bincount(side, design[:, a] * target, minlength=n) for a in range(k)], axis=1)
    if k == 1:
        return right / gram[:, 0]
    if k == 2:
        det = gram[:, 0, 0] * gram[:, 1, 1] - gram[:, 0, 1] ** 2
        first = (right[:, 0] * gram[:, 1, 1] - right[:, 1] * gram[:, 0, 1]) / det
        second = (right[:, 1] * gram[:, 0, 0] - right[:, 0] * gram[:, 0, 1]) / det
        return np.stack([first, second], axis=1)
    return np.linalg.solve(gram, right[..., None])[..., 0]


#: Tables up to so many places are solved as dense products, and up to ``WIDE_PLACES`` if one in ``DENSE_SHARE`` is observed; a block has so many sums.
DENSE_PLACES, WIDE_PLACES, DENSE_SHARE, BLOCK_SUMS = 1_000_000, 20_000_000, 10, 250_000


def _starts(n_rows: int, n_cols: int, rank: int, ensembles: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """[1 + rank, rows, members] and [1 + rank, columns, members]: biases 0, small normal factors, one generator a member."""
    left, right = np.zeros((1 + rank, n_rows, ensembles)), np.zeros((1 + rank, n_cols, ensembles))
    for member in range(ensembles):
        rng = np.random.RandomState(seed + member)
        left[1:, :, member] = rng.normal(0.0, START_SPREAD, size=(n_rows, rank)).T
        right[1:, :, member] = rng.normal(0.0, START_SPREAD, size=(n_cols, rank)).T
    return left, right


def _terms(side: np.ndarray) -> np.ndarray:
    """Bias, factors, bias x factors and products of factors: what the mask sums for the normal equations."""
    k = len(side) - 1
    return np.concatenate([side, side[:1] * side[1:], *[side[a : a + 1] * side[a:] for a in range(1, k + 1)]])


def _solve_terms(n: np.ndarray, total: np.ndarray, sums: np.ndarray, crossed: np.ndarray, mean: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge solutions [bias, factors...] from counts and totals, the sums of ``_terms`` and those of value x factor."""
    k = len(crossed)
    first = total - mean * n - sums[0]
    if not k:
        return (first / (n + ridge))[None]
    right = crossed - mean * sums[1 : k + 1] - sums[k + 1 : 2 * k + 1]
    if k == 1:
        g00, g01, g11 = n + ridge, sums[1], sums[3] + ridge
        det = g00 * g11 - g01**2
        return np.stack([first * g11 - right[0] * g01, right[0] * g00 - first * g01]) / det
    gram, at = np.empty((k + 1, k + 1, *first.shape)), 2 * k + 1
    gram[0, 0], gram[1:, 0] = n + ridge, sums[1 : k + 1]
    for a in range(1, k + 1):
        gram[a:, a] = sums[at : at + k + 1 - a]
        gram[a, a] += ridge
        at += k + 1 - a
    out = np.concatenate([first[None], right])
    for j in range(k):  # elimination below the diagonal of all systems at once; they are positive definite
        step = gram[j + 1 :, j] / gram[j, j]
        for i in range(j + 1, k + 1):
            gram[i, j + 1 : i + 1] -= step[i - j - 1] * gram[j + 1 : i + 1, j]
        out[j + 1 :] -= step * out[j]
    for j in range(k, -1, -1):
        out[j] = (out[j] - (gram[j + 1 :, j] * out[j + 1 :]).sum(axis=0)) / gram[j, j]
    return out


def _dense_als(rows, cols, values, n_rows: int, n_cols: int, rank: int, ridge: float, rounds: int, ensembles: int, seed: int, row: int | None = None) -> np.ndarray:
    """The rows are gone through in blocks: a block's solutions go into the sums of the columns while it is at hand."""
    place = rows.astype(np.int64) * n_cols + cols
    mask = np.bincount(place, minlength=n_rows * n_cols).astype(float).reshape(n_rows, n_cols)
    table = np.bincount(place, values, minlength=n_rows * n_cols).reshape(n_rows, n_cols)
    row_n, col_n = mask.sum(axis=1), mask.sum(axis=0)
    row_total, col_total = table.sum(axis=1), table.sum(axis=0)
    empty_rows, empty_cols = np.flatnonzero(row_n == 0), np.flatnonzero(col_n == 0)
    left, right = (np.ascontiguousarray(np.moveaxis(s, 1, 2)) for s in _starts(n_rows, n_cols, rank, ensembles, seed))  # members before places
    count = 1 + 2 * rank + rank * (rank + 1) // 2
    block = max(64, BLOCK_SUMS // (count * ensembles))
    mean = np.full((ensembles, 1), values.mean())
    for _ in range(rounds):
        terms, factors = _terms(right).reshape(count * ensembles, n_cols), right[1:].reshape(rank * ensembles, n_cols)
        sums, crossed, biases = np.zeros((count * ensembles, n_cols)), np.zeros((rank * ensembles, n_cols)), np.zeros(ensembles)
        for low in range(0, n_rows, block):
            m, x, n = mask[low : low + block], table[low : low + block], row_n[low : low + block]
            side = _solve_terms(n, row_total[low : low + block], (terms @ m.T).reshape(count, ensembles, len(n)), (factors @ x.T).reshape(rank, ensembles, len(n)), mean, ridge)
            if len(empty_rows):
                none = n == 0
                side[:, :, none] = left[:, :, low : low + block][:, :, none]
            left[:, :, low : low + block] = side
            sums += _terms(side).reshape(count * ensembles, len(n)) @ m
            crossed += side[1:].reshape(rank * ensembles, len(n)) @ x
            biases += side[0] @ n
        sums, crossed = sums.reshape(count, ensembles, n_cols), crossed.reshape(rank, ensembles, n_cols)
        side = _solve_terms(col_n, col_total, sums, crossed, mean, ridge)
        side[:, :, empty_cols] = right[:, :, empty_cols]
        right = side
        met = (right[1:] * sums[1 : rank + 1]).sum(axis=(0, 2))
        mean = ((values.sum() - biases - right[0] @ col_n - met) / len(values))[:, None]
    left = left if row is None else left[:, :, row : row + 1]
    fitted = mean.mean() + left[0].mean(axis=0)[:, None] + right[0].mean(axis=0)
    for k in range(1, 1 + rank):
        fitted += left[k].T @ right[k] / ensembles
    return fitted


def bias_als(rows, cols, values, n_rows: int, n_cols: int, rank: int, ridge: float = RIDGE, rounds: int = ROUNDS, ensembles: int = ENSEMBLES, seed: int = SEED, dense_places: int = DENSE_PLACES, row: int | None = None) -> np.ndarray:
    """Full table of fitted values, or one row of it (observed cells are not restored here).

    Rows or columns without cells keep bias 0 and their starting factor.  The
    ridge must be positive.
    """
    if ridge <= 0:
        raise ValueError("the ridge must be positive")
    rows, cols, values = np.asarray(rows), np.asarray(cols), np.asarray(values, dtype=float)
    fuller = dense_places and n_rows * n_cols <= min(WIDE_PLACES, DENSE_SHARE * len(values))
    if n_rows * n_cols <= dense_places or fuller:
        return _dense_als(rows, cols, values, n_rows, n_cols, rank, ridge, rounds, ensembles, seed, row)
    row_seen = np.bincount(rows, minlength=n_rows) > 0
    col_seen = np.bincount(cols, minlength=n_cols) > 0
    total = np.zeros((n_rows, n_cols))
    lefts, rights = _starts(n_rows, n_cols, rank, ensembles, seed)
    for member in range(ensembles):
        u, v = lefts[:, :, member].T.copy(), rights[:, :, member].T.copy()
        mean = values.mean()
        ones = np.ones((len(values), 1))
        for _ in range(rounds):
            side = _solve_side(rows, n_rows, np.hstack([ones, v[cols, 1:]]), values - mean - v[cols, 0], ridge)
            u[row_seen] = side[row_seen]
            side = _solve_side(cols, n_cols, np.hstack([ones, u[rows, 1:]]), values - mean - u[rows, 0], ridge)
            v[col_seen] = side[col_seen]
            mean = (values - u[rows, 0] - v[cols, 0] - (u[rows, 1:] * v[cols, 1:]).sum(axis=1)).mean()
        total += mean + u[:, :1] + v[:, 0] + u[:, 1:] @ v[:, 1:].T
    return (total if row is None else total[row : row + 1]) / ensembles


def column_moments(cols: np.ndarray, values: np.ndarray, n_cols: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population spread of each column; a spread below ``floor`` counts as 1."""
    n = np.maximum(np.bincount(cols, minlength=n_cols), 1)
    mean = np.bincount(cols, values, minlength=n_cols) / n
    spread = np.sqrt(np.bincount(cols, (values - mean[cols]) ** 2, minlength=n_cols) / n)
    return mean, np.where(spread < floor, 1.0, spread)


def complete(rows, cols, scores, n_rows: int, n_cols: int, rank: int, ridge: float = RIDGE, allow_empty_rows: bool = False, row: int | None = None) -> np.ndarray:
    """Completed table of percent scores, or one row of it: logit, column z-scores, bias ALS, back; observed cells stay, all in 0..100."""
    rows, cols, scores = np.asarray(rows), np.asarray(cols), np.asarray(scores, dtype=float)
    if not len(scores):
        raise ValueError("there are no observed cells")
    if rank < 0:
        raise ValueError("the rank must not be negative")
    if (np.bincount(cols, minlength=n_cols) == 0).any():
        raise ValueError("a column has no observed cell")
    if not allow_empty_rows and (np.bincount(rows, minlength=n_rows) == 0).any():
        raise ValueError("a row has no observed cell")
    x = logit_percent(scores)
    mean, spread = column_moments(cols, x, n_cols, 1e-12)
    fitted = bias_als(rows, cols, (x - mean[cols]) / spread[cols], n_rows, n_cols, rank, ridge, row=row)
    table = percent_of_logit(fitted * spread + mean)
    if row is None:
        table[rows, cols] = scores
    else:
        table[0, cols[rows == row]] = scores[rows == row]
    return np.clip(table, 0.0, 100.0)
