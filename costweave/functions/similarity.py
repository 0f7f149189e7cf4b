"""Similarities of many pairs of texts at once, as array work."""

from __future__ import annotations

import numpy as np

POPULAR_FROM = 200  # fixed value: from this length on the sequence ratio ignores popular characters
CELLS = 1 << 22  # table cells that one step of the sequence ratio holds


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points of each text as a row, filled with -1."""
    out = np.full((len(texts), width), -1, np.int32)
    for row, x in zip(out, texts, strict=True):
        row[: len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _matched(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of the pairs of rows: the longest common block first (earliest in a, then in b), then left and right of it."""
    total = np.zeros(len(a), np.int64)
    loose = np.zeros(b.shape, bool)  # popular characters of long texts start no block, but extend one
    for p in np.flatnonzero(nb >= POPULAR_FROM):
        value, at, count = np.unique(b[p, : nb[p]], return_inverse=True, return_counts=True)
        loose[p, : nb[p]] = (count > nb[p] // 100 + 1)[at]
    pair, zero = np.arange(len(a)), np.zeros(len(a), np.int64)
    todo = np.stack([pair, zero, na, zero, nb], axis=1)
    columns = np.arange(b.shape[1])
    while len(todo):
        todo = todo[(todo[:, 2] > todo[:, 1]) & (todo[:, 4] > todo[:, 3])]
        step, todo = todo[: max(1, CELLS // max(b.shape[1], 1))], todo[max(1, CELLS // max(b.shape[1], 1)) :]
        if not len(step):
            break
        p, a0, a1, b0, b1 = step.T
        other = np.where((columns >= b0[:, None]) & (columns < b1[:, None]) & ~loose[p], b[p], -2)
        run = np.zeros((len(step), b.shape[1] + 1), np.int16 if b.shape[1] < 32_000 else np.int32)
        best, end_a, end_b = np.zeros(len(step), np.int64), a0.copy(), b0.copy()
        for i in range(int((a1 - a0).max())):
            here = np.where(a0 + i < a1, a[p, np.minimum(a0 + i, a.shape[1] - 1)], -3)
            run[:, 1:] = np.where(other == here[:, None], run[:, :-1] + 1, 0)
            j = run.argmax(axis=1)
            longest = run[np.arange(len(step)), j]
            new = longest > best
            best[new], end_a[new], end_b[new] = longest[new], (a0 + i + 1)[new], j[new]
        start_a, start_b = end_a - best, end_b - best
        while True:  # leftwards, then rightwards, over any equal characters
            grow = (best > 0) | loose.any()
            grow = grow & (start_a > a0) & (start_b > b0) & (a[p, start_a - 1] == b[p, start_b - 1])
            if not grow.any():
                break
            start_a, start_b = start_a - grow, start_b - grow
        while True:
            grow = (end_a < a1) & (end_b < b1) & (a[p, np.minimum(end_a, a.shape[1] - 1)] == b[p, np.minimum(end_b, b.shape[1] - 1)]) & ((best > 0) | loose.any())
            if not grow.any():
                break
            end_a, end_b = end_a + grow, end_b + grow
        size = end_a - start_a
        np.add.at(total, p, size)
        found = size > 0
        left = np.stack([p, a0, start_a, b0, start_b], axis=1)[found]
        right = np.stack([p, end_a, a1, end_b, b1], axis=1)[found]
        todo = np.concatenate([todo, left, right])
    return total


def sequence_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Twice the matching characters over both lengths for each pair, many pairs at once; two empty texts are equal."""
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.ones(len(a))
    some = np.flatnonzero(na + nb)
    order = some[np.argsort(np.maximum(na, nb)[some], kind="stable")]  # alike lengths together, so that little is filled up
    start = 0
    while start < len(order):
        own = order[start : start + 2048]
        while len(own) > 1 and len(own) * max(int(na[own].max()), int(nb[own].max())) ** 2 > 64 * CELLS:
            own = own[: len(own) // 2]
        x, y = _codes([a[i] for i in own], max(1, int(na[own].max()))), _codes([b[i] for i in own], max(1, int(nb[own].max())))
        out[own] = 2 * _matched(x, y, na[own], nb[own]) / (na[own] + nb[own])
        start += len(own)
    return out


def common_characters(a: list[str], b: list[str], classes: int = 64) -> np.ndarray:
    """Characters that two texts share at most, counted by their code modulo ``classes``: never fewer than they do share."""

    def bags(texts: list[str]) -> np.ndarray:
        lengths = [len(x) for x in texts]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % classes
        return np.bincount(np.repeat(np.arange(len(texts)), lengths) * classes + codes, minlength=len(texts) * classes).reshape(-1, classes)

    return np.minimum(bags(a), bags(b)).sum(axis=1)


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, many pairs at once."""
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.zeros(len(a), np.int64)
    some = np.flatnonzero((na > 0) & (nb > 0))
    order = some[np.argsort(na[some], kind="stable")]
    start = 0
    while start < len(order):
        own = order[start : start + 16384]
        while len(own) > 1 and len(own) * int(nb[own].max()) > CELLS:
            own = own[: len(own) // 2]
        x, y = _codes([a[i] for i in own], int(na[own].max())), _codes([b[i] for i in own], int(nb[own].max()))
        row = np.zeros((len(own), y.shape[1] + 1), np.int32)
        for i in range(x.shape[1]):
            here = (y == x[:, i : i + 1]) & (x[:, i : i + 1] >= 0)
            row[:, 1:] = np.maximum(row[:, 1:], np.where(here, row[:, :-1] + 1, 0))
            np.maximum.accumulate(row, axis=1, out=row)
        out[own] = row[:, -1]
        start += len(own)
    return out
