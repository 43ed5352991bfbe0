"""All trials of a grid for one group from one distance matrix.

The level of a pair is the smallest tried eps that reaches it. A place is a core place for min_samples from the first
eps at which enough rows lie within reach; under min_samples the level of a pair is the largest of its own and
those of its two ends. The minimum spanning tree of these levels is grown once per min_samples, and the order in which it
takes up the places is the merge tree of all clusterings: cut at an eps, every cluster is a run of
neighbours in that order. So all eps of a min_samples share one tree.

The sums of distances to the clusters of all labellings are matrix products of the same distances with the labellings.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from tradearea.operators.tiles import pair_distances

#: numbers in one product
PRODUCT = 1 << 22


def pair_levels(far: np.ndarray, eps: Sequence[float]) -> np.ndarray:
    """Index of the smallest eps that reaches each pair; len(eps) if none does."""
    level = np.zeros(far.shape, np.uint8)
    for e in eps:
        level += far > e
    return level


def core_levels(level: np.ndarray, weight: np.ndarray, steps: int, min_samples: Sequence[int]) -> np.ndarray:
    """For each min_samples (rows) the first eps index at which each place is a core place; `steps` if never."""
    n = len(weight)
    at = np.arange(n)[:, None] * (steps + 1) + level
    counts = np.bincount(at.ravel(), np.broadcast_to(weight, level.shape).ravel(), minlength=n * (steps + 1)).reshape(n, steps + 1)
    upto = np.cumsum(counts[:, :steps], axis=1)
    out = np.empty((len(min_samples), n), np.uint8)
    for k, m in enumerate(min_samples):
        reached = upto >= m
        out[k] = np.where(reached.any(1), reached.argmax(1), steps)
    return out


def merge_trees(level: np.ndarray, core: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of `core`: the order in which a spanning tree takes up the places, and the level of each step (0th: unreached)."""
    trees, n = core.shape
    # the level of every pair under each min_samples, a row per tree and place
    pairs = np.maximum(np.maximum(level, core[:, :, None]), core[:, None, :]).reshape(trees * n, n)
    base, reach = np.arange(trees) * n, np.empty((trees, n), np.uint8)
    order, joins = np.empty((n, trees), np.int64), np.empty((n, trees), np.uint8)
    # unvisited places carry their best level; 200 marks the visited ones
    best, seen = np.full((trees, n), steps, np.uint8), np.zeros((trees, n), np.uint8)
    flat, done = best.reshape(-1), seen.reshape(-1)
    for step in range(n):
        pick = best.argmin(1)
        at = base + pick
        order[step], joins[step] = pick, flat.take(at)
        done[at] = 200
        pairs.take(at, axis=0, out=reach, mode="clip")
        np.minimum(best, reach, out=best)
        np.maximum(best, seen, out=best)
    joins[0] = steps
    return order.T, joins.T


def grid_labels(level: np.ndarray, core: np.ndarray, steps: int) -> np.ndarray:
    """Labels (steps, min_samples, places) of every trial; places must stand in the order of their ids.

    Cluster 0 owns the smallest core id, the others follow; a border place joins the lowest cluster in reach; -1 is noise.
    """
    trees, n = core.shape
    order, joins = merge_trees(level, core, steps)
    out = np.full((steps, trees, n), -1, np.int32)
    for k in range(trees):
        for s in range(steps):
            is_core = core[k] <= s
            if not is_core.any():
                continue
            run = np.empty(n, np.int64)
            run[order[k]] = np.cumsum(joins[k] > s)
            inside = np.flatnonzero(is_core)
            of_run = run[inside]
            # the last one written is the smallest id of its run
            first = np.full(n + 1, n, np.int64)
            first[of_run[::-1]] = inside[::-1]
            heads = np.sort(first[first < n])
            label = np.searchsorted(heads, first[of_run])
            out[s, k, inside] = label
            rest = np.flatnonzero(~is_core)
            if len(rest):
                # core places by label: the first one in reach has the lowest
                by_label = np.argsort(label, kind="stable")
                near = level[rest][:, inside[by_label]] <= s
                at = near.argmax(1)
                out[s, k, rest] = np.where(near[np.arange(len(rest)), at], label[by_label][at], -1)
    return out


def silhouettes(far: np.ndarray, weight: np.ndarray, labellings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean score, number of labels) of each row of `labellings`; no score (nan) for one label or as many labels as rows."""
    n, total = len(weight), weight.sum()
    own = np.asarray(labellings) - np.asarray(labellings).min(1, keepdims=True)
    for t, row in enumerate(own):
        used = np.bincount(row) > 0
        own[t] = (np.cumsum(used) - 1)[row]
    clusters = own.max(1) + 1
    scores = np.full(len(own), np.nan)
    first: dict[bytes, int] = {}
    same = np.array([first.setdefault(row.tobytes(), t) for t, row in enumerate(np.ascontiguousarray(own))], np.int64)
    # equal labellings are scored once
    valid = np.flatnonzero((clusters > 1) & (clusters < total) & (same == np.arange(len(own))))
    if not len(valid):
        return scores[same], clusters
    # clusters that several labellings share are added up once: two sums of random numbers (88 bits together, 64 in large groups) tell them apart
    begins = np.concatenate([[0], np.cumsum(clusters[valid])])
    flat = (own[valid] + begins[:-1, None]).ravel()
    names = np.random.default_rng(1).integers(0, 1 << 44, (2, n)).astype(float)
    sums = [np.bincount(flat, np.tile(x, len(valid)), begins[-1]) for x in names] if n < 512 else [
        np.bincount(flat, np.tile(np.floor(x / 4096), len(valid)), begins[-1]) for x in names]
    _, of, column = np.unique(sums[0] + 1j * sums[1], return_index=True, return_inverse=True)
    labelling = np.searchsorted(begins, of, side="right") - 1
    label = of - begins[labelling]
    step = max(1, PRODUCT // n)
    sizes, far_sums = np.empty(len(of)), np.empty((len(of), n))
    for at in range(0, len(of), step):
        member = np.asfortranarray((own[valid[labelling[at:at + step]]] == label[at:at + step, None]) * weight).T
        sizes[at:at + step] = member.sum(0)
        far_sums[at:at + step] = (far @ member).T
    means, places = far_sums / sizes[:, None], np.arange(n)
    for begin, end, t in zip(begins[:-1], begins[1:], valid):
        mine = column[begin:end][own[t]]
        size, lone = sizes[mine], sizes[mine] == 1
        mean = means[column[begin:end]]
        mean[own[t], places] = np.inf
        other = mean.min(0)
        inner = np.divide(far_sums[mine, places], size - 1, out=np.zeros(n), where=~lone)
        top = np.maximum(inner, other)
        value = np.where(lone | (top == 0), 0.0, np.divide(other - inner, top, out=np.zeros(n), where=top > 0))
        scores[t] = (value * weight).sum() / total
    return scores[same], clusters


def grid_of_group(coords: np.ndarray, weight: np.ndarray, eps: Sequence[float], min_samples: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, scores, clusters) of all trials, eps by eps; places in the order of their ids."""
    far = pair_distances(coords, coords)
    level = pair_levels(far, eps)
    core = core_levels(level, weight, len(eps), min_samples)
    labels = grid_labels(level, core, len(eps)).reshape(-1, len(weight))
    return labels, *silhouettes(far, weight, labels)
