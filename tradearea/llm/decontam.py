"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a megabyte of whole documents inside one task. Its words become numbers: the words of
the test windows are numbered, all others share the number 0. Runs of numbered words long enough for the
shortest window are written one after another, each behind a separator of its own, and indexed: suffix
order by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions. All
windows are searched backwards together, the rows found are walked to the next sampled position, and the
spans of words are merged per document. A run of words that no window holds can't contain an occurrence, so
leaving it out loses nothing.

Nothing is shuffled: each document is answered by the task that reads it. The windows are sent to every
task; a benchmark above half of `limit` bytes is searched in several passes of at most that size, so what is built and sent is
bounded for any benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradearea.llm.words import PLAIN, Piece, row_of, slices

WINDOW = 10
SAMPLE = 8
#: bytes of benchmark text of a pass, twice over; a window takes about 60 bytes, so a pass sends at most some 40 MB
LIMIT = 2 << 20
SHARD_BYTES = 1 << 20
ADDED = ("_words", "_spans", "_items")


class Windows:
    """The distinct test windows as rows of word numbers, and the items that hold them."""

    def __init__(self, items: list[str], texts: list[str | None], size: int = WINDOW):
        piece = Piece(pa.array(texts, pa.large_string()), lower=True)
        starts, ends, first = piece.spans(PLAIN)
        hashed = piece.hashes(starts, ends)
        self.words = np.unique(hashed)  # word i + 1 has hash words[i]
        numbers = (np.searchsorted(self.words, hashed) + 1).astype(np.int32)
        counts = np.diff(first)
        many = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
        of = np.repeat(np.arange(len(items), dtype=np.int32), many)
        begin = np.repeat(first[:-1], many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(counts, size)[of]
        padded = np.concatenate((numbers, np.zeros(1, np.int32)))
        # one column at a time: a row of `size` numbers, zeros behind short items
        rows = np.empty((len(of), size), ">i4")
        for k in range(size):
            rows[:, k] = np.where(k < length, padded[np.minimum(begin + k, len(numbers))], 0)
        packed = rows.view(f"S{4 * size}").ravel()
        order = np.lexsort((of, packed))
        new = np.ones(len(order), bool)
        new[1:] = packed[order[1:]] != packed[order[:-1]]
        heads = order[new]
        self.items = items
        self.lengths = length[heads].astype(np.int64)
        self.numbers = rows[heads].astype(np.int32)
        window = np.cumsum(new) - 1
        held = new.copy()
        held[1:] |= of[order[1:]] != of[order[:-1]]
        self.holders = of[order[held]]
        self.first_holder = np.searchsorted(window[held], np.arange(len(heads) + 1))


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; only suffixes not yet told apart are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while True:
        border = np.append(new, True)
        places = np.flatnonzero(~(border[:-1] & border[1:]))  # groups of more than one
        if not len(places):
            return order
        at = order[places]
        second = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        by = np.lexsort((second, rank[at]))
        at, group, second = at[by], rank[at][by], second[by]
        order[places] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        new[places] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, places, 0))
        step *= 2


class Wavelet:
    """Sequence of numbers below 2^bits with rank and access, a bit plane after the other (wavelet matrix)."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.ones, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1
            count = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(self.n - int(count[-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value stands before each place."""
        begin = np.zeros_like(at)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((value >> (self.bits - 1 - level)) & 1).astype(bool)
            begin = np.where(bit, zeros + ones[begin], begin - ones[begin])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each place, and how often it stands before it."""
        begin, value = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = (ones[at + 1] - ones[at]).astype(bool)
            value = value * 2 + bit
            begin = np.where(bit, zeros + ones[begin], begin - ones[begin])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return value, at - begin


class Index:
    """FM-index of runs of numbers (each at least 1). Run j is run[starts[j]:starts[j + 1]]."""

    def __init__(self, numbers: np.ndarray, starts: np.ndarray, top: int):
        runs = len(starts) - 1
        # text: separator j, then run j; separators differ and are smaller than all numbers
        separators = starts[:-1] + np.arange(runs)
        symbols = np.empty(len(numbers) + runs, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[separators] = False
        symbols[separators] = np.arange(runs)
        symbols[inside] = numbers + runs
        self.n = len(symbols)
        order = suffix_order(symbols)
        plain = np.where(inside, symbols - runs, 0)
        self.last = Wavelet(plain[order - 1], max(1, int(top).bit_length()))
        self.below = np.concatenate(([0], np.cumsum(np.bincount(plain, minlength=top + 2))))
        self.sampled = (order % SAMPLE == 0) | ~inside[order - 1] | ~inside[order]
        self.samples = order[self.sampled]
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose suffix begins with each pattern, by backward search of all patterns together."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        patterns = patterns.astype(np.int64, copy=False)
        for step in range(patterns.shape[1]):
            live = np.flatnonzero((step < lengths) & (low < high))
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - step]
            low[live] = self.below[c] + self.last.rank(c, low[live])
            high[live] = self.below[c] + self.last.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the text of each row's suffix: back to the next sampled place, counting the steps."""
        out, rows, left = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.samples[self.sample_rank[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            value, before = self.last.access(rows)
            rows = self.below[value] + before
            steps += 1
        return out


def occurrences(piece: Piece, windows: Windows) -> tuple[np.ndarray, np.ndarray, tuple]:
    """First word and window of each occurrence in a piece, and the piece's words (starts, ends, first)."""
    starts, ends, first = spans = piece.spans(PLAIN)
    none = np.zeros(0, np.int64)
    if not len(starts) or not len(windows.lengths):
        return none, none, spans
    hashed = piece.hashes(starts, ends)
    at = np.minimum(np.searchsorted(windows.words, hashed), len(windows.words) - 1)
    numbers = np.where(windows.words[at] == hashed, at + 1, 0)
    known = np.concatenate(([False], numbers > 0, [False]))
    edge = np.zeros(len(numbers) + 1, bool)
    edge[first] = True
    begins = np.flatnonzero(known[1:] & (~known[:-1] | edge))
    stops = np.flatnonzero(known[:-1] & (~known[1:] | edge))
    long = stops - begins >= windows.lengths.min()
    begins, stops = begins[long], stops[long]
    if not len(begins):
        return none, none, spans
    borders = np.concatenate(([0], np.cumsum(stops - begins)))
    words = np.arange(borders[-1]) + np.repeat(begins - borders[:-1], np.diff(borders))
    index = Index(numbers[words], borders, len(windows.words))
    low, high = index.search(windows.numbers, windows.lengths)
    which = np.repeat(np.arange(len(low)), high - low)
    rows = np.arange(len(which)) + np.repeat(low - np.concatenate(([0], np.cumsum(high - low)))[:-1], high - low)
    place = index.locate(rows)
    run = np.searchsorted(borders[:-1] + np.arange(len(begins)), place, side="right") - 1
    return begins[run] + place - (borders[run] + run + 1), which, spans


def _cut(column: pa.Array, piece: Piece, spans: tuple, hit: list[list[int]]) -> pa.Array:
    """The texts without the bytes from the first to the last word of each hit span."""
    starts, ends, first = spans
    whole = column.to_pylist()
    for row, own in enumerate(hit):
        if own:
            raw, zero = whole[row].encode("utf-8"), int(piece.borders[row])
            left, at = [], 0
            for a, b in zip(own[::2], own[1::2]):
                left.append(raw[at:int(starts[first[row] + a]) - zero])
                at = int(ends[first[row] + b - 1]) - zero
            whole[row] = b"".join([*left, raw[at:]]).decode("utf-8")
    return pa.array(whole, column.type)


def _pass(docs: DataFrame, windows: Windows, text: str, cut: bool = False) -> DataFrame:
    """Adds to _spans (first and past-the-last word, in turn) and _items what the windows hit; with `cut`, then takes
    the spans out of the text and leaves the three columns away."""
    sent = docs.sparkSession.sparkContext.broadcast(windows)
    kinds = StructType([f for f in docs.schema.fields if not cut or f.name not in ADDED])
    names = kinds.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        for batch in slices(batches, text, SHARD_BYTES):
            piece = Piece(batch.column(text), lower=True)
            word, which, (starts, ends, first) = occurrences(piece, windows)
            rows = np.searchsorted(first, word, side="right") - 1
            spans = [[] if s is None else s for s in batch.column("_spans").to_pylist()]
            items = [set(s or ()) for s in batch.column("_items").to_pylist()] if not cut else []
            for row, at, w in zip(rows.tolist(), (word - first[rows]).tolist(), which.tolist()):
                spans[row] += (at, at + int(windows.lengths[w]))
                if not cut:
                    items[row].update(windows.items[j] for j in windows.holders[windows.first_holder[w]:windows.first_holder[w + 1]])
            merged = [merge(s) for s in spans]
            if cut:
                new = {text: _cut(batch.column(text), piece, (starts, ends, first), merged)} if any(merged) else {}
            else:
                new = {"_spans": pa.array(merged, pa.list_(pa.int64())), "_items": pa.array([sorted(s) for s in items], pa.list_(pa.string())),
                       "_words": pa.array(np.diff(first).astype(np.int64))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    return docs.mapInArrow(run, kinds)


def merge(spans: list[int]) -> list[int]:
    """Overlapping and touching spans joined, in order."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def window_sets(tests: DataFrame, item: str, text: str, window: int, limit: int) -> Iterator[Windows]:
    """The benchmark's windows in sets of at most about `limit` bytes of text (or one item); only one set is held at a time."""
    rows = tests.select(F.col(item).cast("string").alias("_item"), F.col(text).cast("string").alias("_text")).filter("_text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(total) // max(1, limit // 2)))
    for part in range(parts):
        own = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(parts)) == part)
        found = sorted({(r["_item"] or "", r["_text"]) for r in own.toLocalIterator()})
        yield Windows([i for i, _ in found], [t for _, t in found], window)


def hits(docs: DataFrame, tests: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = WINDOW, limit: int = LIMIT, cut: bool = False) -> DataFrame:
    """docs with _words (word count), _spans (merged hit spans, in words) and _items (items found, sorted); with `cut`,
    docs without the spans' words instead.

    Null texts have no words. An item of fewer words than `window`, but not none, is one window. Items
    without id count under the empty id. Columns of docs with these three names are replaced.
    """
    out = docs.drop(*ADDED).withColumns({
        "_words": F.lit(0).cast("bigint"), "_spans": F.array().cast("array<bigint>"), "_items": F.array().cast("array<string>")})
    # one set ahead: the last pass also cuts
    held = None
    for windows in window_sets(tests, item, item_text, window, limit):
        out, held = (out if held is None else _pass(out, held, text)), windows
    return _pass(out, held, text, cut)


def contamination(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of docs: key, n_words, n_hit, items, spans. Other columns are passed over."""
    found = hits(docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_body")), tests, text="_body", **options)
    hit = F.aggregate(F.transform("_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(F.col("_key").alias(key), F.col("_words").alias("n_words"), hit.alias("n_hit"),
                        F.col("_items").alias("items"), F.col("_spans").alias("spans"))


def without_hits(docs: DataFrame, tests: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with the hit words cut out of the text, from the first to the last word of each merged span.

    All other columns and all rows stay; a text without hits is unchanged, a null text stays null. Rows that repeat are
    answered row by row, texts of any length are searched whole; an empty table or benchmark changes nothing.
    """
    return hits(docs, tests, text=text, cut=True, **options)
