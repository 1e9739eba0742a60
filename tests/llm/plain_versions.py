"""Plain versions to hold operators against."""

import hashlib
from collections import Counter

import numpy as np


def components(values, linked):
    """Union-find over all pairs; smallest index of each component."""
    top = list(range(len(values)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [find(i) for i in range(len(values))]


def plain_repeats(data, least=400):
    """(n_bytes, n_removed, n_spans, digest of what stays) of each of some byte strings."""
    windows = [[d[i : i + least] for i in range(len(d) - least + 1)] for d in data]
    counts = Counter(w for ws in windows for w in ws)
    out = []
    for d, ws in zip(data, windows, strict=True):
        covered = np.zeros(len(d), bool)
        for i, w in enumerate(ws):
            if counts[w] > 1:
                covered[i : i + least] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], covered.astype(int)])) == 1))
        kept = np.frombuffer(d, np.uint8)[~covered].tobytes()
        out.append((len(d), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
