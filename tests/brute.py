"""Plain numpy versions of the clustering definitions, used only to check the Spark operators."""

import numpy as np


def distances(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


def dbscan(x, ids, eps, min_samples):
    near = distances(x) <= eps
    core = near.sum(axis=1) >= min_samples
    labels = np.full(len(x), -1)
    nxt = 0
    for i in sorted(range(len(x)), key=lambda k: ids[k]):
        if not core[i] or labels[i] >= 0:
            continue
        stack, seen = [i], {i}
        while stack:
            p = stack.pop()
            if labels[p] < 0:
                labels[p] = nxt
            if core[p]:
                for q in np.flatnonzero(near[p]):
                    if q not in seen and labels[q] < 0:
                        seen.add(q)
                        stack.append(q)
        nxt += 1
    return core, labels


def silhouette(x, labels):
    names = np.unique(labels)
    if len(names) < 2 or len(names) >= len(x):
        return None
    far = distances(x)
    out = []
    for i in range(len(x)):
        mine = labels == labels[i]
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = far[i][mine].sum() / (mine.sum() - 1)
        b = min(far[i][labels == n].mean() for n in names if n != labels[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))
