"""The clustering rule, point by point in numpy float32: quadratic, for small inputs."""

import numpy as np

from cellweave.params import Params


def brute_labels(X, eps, min_samples, ids=None, numbering="cell"):
    k = Params.of(eps, min_samples)
    X = np.asarray(X, np.float32)
    n = len(X)
    ids = np.arange(n) if ids is None else np.asarray(ids)
    inv, sq = np.float32(k.inv_r), np.float32(k.eps_sq)
    cell = np.floor(X * inv).astype(np.int64)
    dx, dy = X[None, :, 0] - X[:, None, 0], X[None, :, 1] - X[:, None, 1]
    d2 = dx * dx + dy * dy
    apart = np.abs(cell[None] - cell[:, None]).max(axis=2)
    within = (d2 <= sq) & (apart <= 2)
    is_core = (within | (apart == 0)).sum(axis=1) >= min_samples
    key = cell[:, 0] * (1 << 32) + (cell[:, 1] & 0xFFFFFFFF)
    cores = np.flatnonzero(is_core)
    root = {int(c): int(c) for c in key[cores]}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i in cores:
        for j in cores[within[i, cores]]:
            a, b = find(int(key[i])), find(int(key[j]))
            root[max(a, b)] = min(a, b)
    first = {}
    for i in cores:
        r = find(int(key[i]))
        first[r] = min(first.get(r, ids[i]), ids[i]) if numbering == "first_core" else r
    number = {r: x for x, r in enumerate(sorted(first, key=first.get))}
    out = np.full(n, -1, np.int32)
    for i in range(n):
        if is_core[i]:
            out[i] = number[find(int(key[i]))]
        elif near := [(d2[i, j], ids[j], j) for j in cores[within[i, cores]]]:
            out[i] = number[find(int(key[min(near)[2]]))]
    return out
