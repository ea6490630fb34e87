"""The pairs of two blocks of vectors that are close enough, in numpy (the kernel of the similarity join).

A block product in single precision, with a bound of its rounding errors, tells which pairs may count;
only those are scored exactly. The k closest of a row are kept as the columns come by, so
their worst score soon leaves out nearly every pair, and no more than a tile of the product is held.
Where single precision can't tell the pairs apart (one vector much longer than the others), the product
is taken in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

_ROWS, _COLS = 256, 1024  # a tile of the product
_PAIRS_AT_ONCE = 1 << 11  # pairs scored at once


def equal_codes(left: np.ndarray, right: np.ndarray, nulls_match: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the values are; -1 for nulls that match nothing."""
    both = pd.factorize(np.concatenate([np.asarray(left, object), np.asarray(right, object)]), use_na_sentinel=not nulls_match)[0]
    return both[: len(left)], both[len(left) :]


class Skipped:
    """Pairs that don't count: equal ids (nulls included), or equal values of a column that is not null."""

    def __init__(self, codes: list[tuple[np.ndarray, np.ndarray]]):
        self.codes = codes

    def flipped(self) -> Skipped:
        return Skipped([(b, a) for a, b in self.codes])

    def tile(self, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((len(rows), hi - lo), dtype=bool)
        for a, b in self.codes:
            own = a[rows][:, None]
            out |= (own == b[None, lo:hi]) & (own >= 0)
        return out

    def kept(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.ones(len(i), dtype=bool)
        for a, b in self.codes:
            out &= (a[i] != b[j]) | (a[i] < 0)
        return out


class _Product:
    """Keys (squared distances, or inner products negated) of tiles, over ``scale`` squared."""

    def __init__(self, a: np.ndarray, b: np.ndarray, dot: bool, kind=np.float32):
        x, y = a, b
        if not dot:  # distances don't change, and far from the origin the product keeps its digits
            centre = np.median(b[:: max(1, len(b) // 1024)], axis=0)
            x, y = a - centre, b - centre
        scale = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)) * np.sqrt(a.shape[1])
        self.scale = float(scale) if scale > 0 else 1.0
        x, y = x / self.scale, y / self.scale
        xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        room = 4.0 * (a.shape[1] + 4)
        self.xx, self.yy, self.unit, self.far = xx, yy, room * np.finfo(kind).eps, 0.0
        if not dot:  # the centre itself is rounded
            self.far = room * np.finfo(np.float64).eps * (np.abs(a).max(initial=0.0) + np.abs(b).max(initial=0.0)) / self.scale
            x = np.column_stack([-2.0 * x, xx, np.ones(len(x))])
            y = np.column_stack([y, np.ones(len(y)), yy])
        else:
            x = -x
        self.kind, self.x, self.y = kind, x.astype(kind), y.astype(kind)

    def tile(self, start: int, stop: int, lo: int, hi: int) -> np.ndarray:
        return self.x[start:stop] @ self.y[lo:hi].T

    def slack(self, start: int, stop: int, lo: int, hi: int) -> np.ndarray:
        """What each row's keys may be off by."""
        size = self.xx[start:stop] + self.yy[lo:hi].max(initial=0.0)
        return self.unit * size + 4 * self.far * np.sqrt(size + self.far * self.far) + 1e-30


def exact_scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, dot: bool) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), _PAIRS_AT_ONCE):
        x, y = a[i[at : at + _PAIRS_AT_ONCE]], b[j[at : at + _PAIRS_AT_ONCE]]
        if not dot:
            x -= y
            y = x
        score = np.einsum("ij,ij->i", x, y)
        out[at : at + len(x)] = score if dot else np.sqrt(score)
    return out


def _few(hit: np.ndarray, product: _Product) -> bool:
    """Whether single precision tells enough apart."""
    return product.kind is np.float64 or np.count_nonzero(hit) * 8 <= hit.size


def within(
    a: np.ndarray, b: np.ndarray, radius: float, skipped: Skipped, once: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, distance)`` of the pairs at most ``radius`` apart, some at a time.

    ``once``: ``a`` and ``b`` are the same rows, and a pair comes from one end only (``i <= j``).
    """
    product = _Product(a, b, False)
    for start in range(0, len(a), _ROWS):
        stop = min(start + _ROWS, len(a))
        for lo in range(start if once else 0, len(b), _COLS):
            hi = min(lo + _COLS, len(b))
            while True:
                limit = (radius / product.scale) ** 2 + product.slack(start, stop, lo, hi)
                hit = product.tile(start, stop, lo, hi) <= limit[:, None].astype(product.kind)
                if _few(hit, product):
                    break
                product = _Product(a, b, False, np.float64)
            at = np.flatnonzero(hit)
            i, j = at // (hi - lo) + start, at % (hi - lo) + lo
            keep = skipped.kept(i, j)
            if once:
                keep &= i <= j
            i, j = i[keep], j[keep]
            score = exact_scores(a, b, i, j, False)
            keep = score <= radius
            if keep.any():
                yield i[keep], j[keep], score[keep]


def nearest(a: np.ndarray, b: np.ndarray, k: int, dot: bool, names: np.ndarray, skipped: Skipped) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, score)`` of the k closest rows of ``b`` for each row of ``a`` by score, then by ``names`` of ``b``; some at a time."""
    product = _Product(a, b, dot)
    for start in range(0, len(a), _ROWS):
        stop = min(start + _ROWS, len(a))
        rows = np.arange(start, stop)
        i, j, bad = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)  # the best so far; smaller is better
        worst = np.full(len(rows), np.inf)  # of k rows, exact
        lo = 0
        while lo < len(b):
            hi = min(lo + _COLS, len(b))
            while True:
                slack = product.slack(start, stop, lo, hi)
                limit = (worst / product.scale**2 if dot else (worst / product.scale) ** 2) + slack
                key = product.tile(start, stop, lo, hi)
                open_ = np.flatnonzero(np.isinf(limit))
                if len(open_):
                    own = np.where(skipped.tile(rows[open_], lo, hi), np.inf, key[open_])
                    take = min(k, hi - lo) - 1
                    limit[open_] = np.partition(own, take, axis=1)[:, take] + 2 * slack[open_]
                hit = key <= limit[:, None].astype(product.kind)
                if hi - lo < 16 * k or _few(hit, product):
                    break
                product = _Product(a, b, dot, np.float64)
            at = np.flatnonzero(hit)
            ni, nj = at // (hi - lo) + start, at % (hi - lo) + lo
            keep = skipped.kept(ni, nj)
            ni, nj = ni[keep], nj[keep]
            lo = hi
            if not len(ni):
                continue
            score = exact_scores(a, b, ni, nj, dot)
            i, j, bad = np.concatenate([i, ni]), np.concatenate([j, nj]), np.concatenate([bad, -score if dot else score])
            order = np.lexsort((names[j], bad, i))
            i, j, bad = i[order], j[order], bad[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            last = place == k - 1
            worst[i[last] - start] = bad[last]
            keep = place < k
            i, j, bad = i[keep], j[keep], bad[keep]
        if len(i):
            yield i, j, -bad if dot else bad
