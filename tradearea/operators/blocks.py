"""Blocks of near places and the steps inside them, for exact nearest rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import count

import numpy as np
import pyarrow as pa

#: entries of a distance matrix held at a time
ENTRIES = 1 << 20
#: what rounding may take off a distance to a box
SAFE = 1 - 1e-9
BEST = "array<struct<distance:double,neighbour:bigint,n:bigint>>"


def tree_of(x: np.ndarray, most: int, number: Iterator[int] | None = None):
    """Halves of sampled places along the widest coordinate: (coordinate, border, below, rest), or a number for a block."""
    number = number or count()
    wide = x.max(axis=0) - x.min(axis=0)
    d = int(wide.argmax())
    if len(x) <= most or not wide[d] > 0:
        return next(number)
    values = np.sort(x[:, d])
    border = values[len(values) // 2]
    if border == values[0]:
        border = values[values > border][0]
    below = x[:, d] < border
    return d, border, tree_of(x[below], most, number), tree_of(x[~below], most, number)


def routed(tree, x: np.ndarray) -> np.ndarray:
    """The block of each place."""
    out = np.zeros(len(x), dtype=np.int32)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if not isinstance(node, tuple):
            out[at] = node
        elif len(at):
            below = x[at, node[0]] < node[1]
            todo += [(node[2], at[below]), (node[3], at[~below])]
    return out


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def places(rows: pa.Table | pa.RecordBatch, name: str = "x") -> np.ndarray:
    flat = _whole(rows.column(name)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows.num_rows, -1)


def best_of(asked: np.ndarray, x: np.ndarray, heads: pa.Array | pa.ChunkedArray, keep: int) -> tuple[np.ndarray, ...]:
    """(position in asked, distance, row, n): for each asked place the `keep` nearest rows of the places x, ties to the smaller row."""
    heads = _whole(heads)
    sizes = heads.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start, entries = np.cumsum(sizes) - sizes, heads.flatten()
    rows, ns = (entries.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    found, step = [], max(1, ENTRIES // len(x))
    for low in range(0, len(asked), step):
        part = asked[low:low + step]
        far = np.zeros((len(part), len(x)))
        for d in range(x.shape[1]):  # one coordinate after the other, as SQL adds them up
            far += (part[:, d, None] - x[None, :, d]) ** 2
        far = np.sqrt(far)
        reach = np.partition(far, keep - 1, axis=1)[:, keep - 1, None] if len(x) > keep else np.inf
        i, j = np.nonzero(far <= reach)
        times = sizes[j]
        at = np.repeat(start[j] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        i, distance, row, n = np.repeat(i, times), np.repeat(far[i, j], times), rows[at], ns[at]
        order = np.lexsort((row, distance, i))
        i, distance, row, n = i[order], distance[order], row[order], n[order]
        stay = np.arange(len(i)) - np.searchsorted(i, i) < keep
        found.append((i[stay] + low, distance[stay], row[stay], n[stay]))
    return tuple(np.concatenate(c) for c in zip(*found))


def listed(size: int, i: np.ndarray, distance: np.ndarray, row: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """One list of entries per asked place."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=size))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(distance), pa.array(row), pa.array(n)], ["distance", "neighbour", "n"]))


def within_block(keep: int):
    """A block's places with their best lists inside it, and `u`: no nearer list of `keep` rows reaches farther."""
    def step(block: pa.Table) -> pa.Table:
        x = places(block)
        i, distance, row, n = best_of(x, x, block.column("heads"), keep)
        u = np.full(len(x), np.inf)
        last = np.arange(len(i)) - np.searchsorted(i, i) == keep - 1
        u[i[last]] = distance[last]
        return pa.table({**{c: block.column(c) for c in ("_g", "_block", "_p", "x")}, "u": pa.array(u), "best": listed(len(x), i, distance, row, n)})
    return step


def to_blocks(trees: Mapping[str, object]):
    """Places with the number of their block; a group that the sample missed is one block."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, groups = places(batch), np.array(batch.column("_g").to_pylist(), dtype=object)
            block = np.zeros(len(x), dtype=np.int32)
            for g in set(groups) & set(trees):
                mine = groups == g
                block[mine] = routed(trees[g], x[mine])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], [*batch.schema.names, "_block"])
    return step


def to_others(boxes: Mapping[str, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """A row per place and other block whose box is no farther than `u`."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, u, home = places(batch), batch.column("u").to_numpy(), batch.column("_block").to_numpy()
            groups = np.array(batch.column("_g").to_pylist(), dtype=object)
            for g, b in sorted(set(zip(groups, home.tolist()))):
                at = np.nonzero((groups == g) & (home == b))[0]
                block, low, high = boxes[g]
                mine = x[at]
                gap = np.maximum(np.maximum(low - mine.max(axis=0), mine.min(axis=0) - high), 0)
                close = np.nonzero((np.sqrt((gap ** 2).sum(axis=1)) * SAFE <= u[at].max()) & (block != b))[0]
                for few in range(0, len(close), 256):
                    c = close[few:few + 256]
                    far = np.zeros((len(at), len(c)))
                    for d in range(x.shape[1]):
                        far += np.maximum(np.maximum(low[None, c, d] - mine[:, d, None], mine[:, d, None] - high[None, c, d]), 0) ** 2
                    i, j = np.nonzero(np.sqrt(far) * SAFE <= u[at, None])
                    for some in range(0, len(i), 4096):
                        pick, to = pa.array(at[i[some:some + 4096]]), block[c[j[some:some + 4096]]]
                        yield pa.RecordBatch.from_arrays([batch.column("_g").take(pick), pa.array(to.astype(np.int32)), *[batch.column(n).take(pick) for n in ("_p", "x", "u")]], ["_g", "_block", "_p", "x", "u"])
    return step


def across_blocks(keep: int):
    """Best lists of places that came to a block, of rows no farther than their `u`."""
    def step(asked: pa.Table, block: pa.Table) -> pa.Table:
        if not asked.num_rows or not block.num_rows:
            return pa.table({"_p": pa.array([], pa.int64()), "best": listed(0, *[np.zeros(0, dtype=t) for t in (np.int64, float, np.int64, np.int64)])})
        i, distance, row, n = best_of(places(asked), places(block), block.column("heads"), keep)
        near = distance <= asked.column("u").to_numpy()[i]
        return pa.table({"_p": asked.column("_p"), "best": listed(asked.num_rows, i[near], distance[near], row[near], n[near])})
    return step
