"""Quality classifier without labels: overlapping heuristic labellers, their accuracies, and a hashed linear scorer.

1. Every labeller votes good, bad or not at all on each whole text.
2. Votes are counted by pattern (at most 3^labellers rows, whatever the corpus holds). Expectation-
   maximisation on these counts gives the share of good documents and how often each labeller says what on good
   and on bad ones; so the accuracies come from all documents.
3. The posterior of a document's pattern is its label. A linear scorer over hashed words, word shapes and
   measure bins is fitted to the labels of a bounded sample (`sample` documents with the smallest
   hashes) and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tradearea.llm.rules import SYMBOLS, counts
from tradearea.llm.words import SPACED, Piece, in_row, per_row, row_of, slices
from tradearea.sources.scratch import cut

BUCKETS = 4096
SAMPLE = 4000
GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("symbols", "odd_words", "upper_case", "shouting", "repeated_windows", "few_distinct", "copied_lines", "plain_prose", "sentences")
ODD = np.zeros(256, bool)
ODD[list(b"#$%&*+/<=>@[\\]^_`{|}~!")] = True


def measures(piece: Piece) -> tuple[dict[str, np.ndarray], tuple]:
    """Shares per row, and the words (hashes, first of each row, shape of each word)."""
    found = counts(piece)
    starts, ends, first = piece.spans(SPACED)
    row, n = row_of(first), np.maximum(found["n_words"], 1)
    words = piece.hashes(starts, ends)

    def has(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(kind[piece.data], dtype=np.int64)))
        return sums[ends] > sums[starts]

    bang, lower, upper, wide, symbol = np.zeros((5, 256), bool)
    bang[0x21], lower[0x61:0x7B], upper[0x41:0x5B], wide[0x80:] = True, True, True, True
    odd, shout, stop = has(ODD), has(bang), np.isin(piece.data[ends - 1], list(b".!?")) if len(ends) else np.zeros(0, bool)
    shape = (odd * 1 + shout * 2 + has(SYMBOLS) * 4 + has(lower) * 8 + has(upper) * 16 + has(wide) * 32 + stop * 64
             + np.minimum(np.ceil(np.log2(np.maximum(ends - starts, 1))), 7).astype(np.int64) * 128)
    one = np.unique(in_row(words, row), return_index=True)[1]
    distinct = np.bincount(row[one], minlength=piece.rows)
    # capitals that do not begin a word; short texts say nothing about the number of distinct words
    inner = np.zeros(len(piece.data), bool)
    inner[1:] = upper[piece.data[1:]] & (upper | lower)[piece.data[:-1]]
    return {
        "n_words": found["n_words"], "symbols": found["n_symbols"] / n, "odd": per_row(odd, first) / n, "shout": per_row(shout, first) / n,
        "upper": per_row(inner, piece.borders) / np.maximum(found["n_letters"], 1), "repeat": found["n_repeat_words"] / n,
        "distinct": np.where(n >= 50, distinct / np.sqrt(n), 8), "copied": found["n_dup_lines"] / np.maximum(found["n_lines"], 1), "stops": per_row(stop, first) / n,
    }, (words, first, shape)


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One column per labeller: GOOD, BAD or NONE."""
    prose = (m["n_words"] > 0) & (m["odd"] < 0.05) & (m["upper"] < 0.2) & (m["repeat"] < np.where(m["n_words"] < 50, 0.7, 0.2)) & (m["copied"] < 0.4)
    sentences = (m["stops"] > 0.01) & ((m["stops"] < 0.5) | (m["n_words"] < 20)) & (m["odd"] < 0.2)
    bad = [m["symbols"] > 0.2, m["odd"] > 0.3, m["upper"] > 0.4, m["shout"] > 0.3, m["repeat"] > 0.5,
           m["distinct"] < 1.5, m["copied"] > 0.5]
    out = [np.where(b, BAD, NONE) for b in bad] + [np.where(g, GOOD, NONE) for g in (prose, sentences)]
    return np.stack(out, axis=1).astype(np.int64)


def pattern(v: np.ndarray) -> np.ndarray:
    """The votes of a row as one number in base 3."""
    return v @ (3 ** np.arange(v.shape[1]))


def unpattern(p: np.ndarray, labellers: int) -> np.ndarray:
    return (p[:, None] // 3 ** np.arange(labellers)) % 3


def estimate(patterns: np.ndarray, weight: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 100) -> tuple[np.ndarray, dict]:
    """Expectation-maximisation over vote patterns with counts: P(good) of each pattern, and the model.

    Labellers are independent given the class; each has its own chances of the three votes on either class. It
    starts from the majority of the votes, which fixes which class is the good one.
    """
    v, w = unpattern(patterns, labellers), weight.astype(float)
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    p = (good + 0.8) / (good + 2 * bad + 1)
    model: dict = {}
    for _ in range(rounds):
        prior = ((p * w).sum() + 1) / (w.sum() + 2)
        chances = np.empty((2, labellers, 3))
        for c, q in ((GOOD, p), (BAD, 1 - p)):
            for vote in range(3):
                chances[c, :, vote] = ((v == vote) * (q * w)[:, None]).sum(0) + 0.5
        chances /= chances.sum(2, keepdims=True)
        logs = np.log(chances)
        odds = np.log(prior) - np.log1p(-prior) + sum(logs[GOOD, j, v[:, j]] - logs[BAD, j, v[:, j]] for j in range(labellers))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done, p = np.abs(new - p).max(initial=0) < 1e-9, new
        model = {"prior": prior, "chances": chances}
        if done:
            break
    return p, model


BINS = {"symbols": (0, .05, .2, .5, 1), "odd": (.01, .05, .1, .3, .6), "upper": (.05, .1, .2, .4, .7), "shout": (.01, .05, .1, .3, .6),
        "repeat": (.02, .1, .2, .35, .5, .75), "distinct": (.5, 1, 1.5, 2, 4), "copied": (.1, .3, .5, .8), "stops": (.005, .01, .1, .3, .5),
        "n_words": (5, 20, 50, 100, 1000)}


def buckets_of(m: dict[str, np.ndarray], words: tuple, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word and word shape (both weigh 1 / words of the row), and of each row's measure bins (weight 1)."""
    hashed, _, shape = words
    by_word = (hashed & np.uint64(BUCKETS // 2 - 1)).astype(np.int64)
    by_shape = BUCKETS // 2 + shape % (BUCKETS // 4)
    bins = np.stack([3 * BUCKETS // 4 + 16 * i + np.searchsorted(np.array(edges), m[name], side="left") for i, (name, edges) in enumerate(BINS.items())], 1)
    return by_word, by_shape, bins.reshape(rows, len(BINS))


def _mapped(docs: DataFrame, key: str, text: str, make, fields: str, names: list[str], until: int | None = None) -> DataFrame:
    """_hash and what `make` gets from each text; with `until`, only of documents whose hash is at most that."""
    source = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("_hash"), F.col(text).cast("string").alias("_text"))
    if until is not None:
        source = source.filter(F.col("_hash") <= until)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            m, words = measures(Piece(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([batch.column("_hash"), *make(m, words, batch.num_rows)], names=["_hash", *names])

    return source.mapInArrow(run, f"_hash bigint, {fields}")


def voted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_hash and the vote pattern of each document."""
    return _mapped(docs, key, text, lambda m, words, rows: [pa.array(pattern(votes(m)))], "pattern bigint", ["pattern"])


def _features(m: dict[str, np.ndarray], words: tuple, rows: int) -> list[pa.Array]:
    by_word, by_shape, bins = buckets_of(m, words, rows)
    row = row_of(words[1])
    cells = np.concatenate([row * BUCKETS + by_word, row * BUCKETS + by_shape])
    cell, count = np.unique(cells, return_counts=True)
    of = cell // BUCKETS
    value = count / np.maximum(m["n_words"], 1)[of]
    cell = np.concatenate([cell % BUCKETS, bins.reshape(-1)])
    of = np.concatenate([of, np.repeat(np.arange(rows), bins.shape[1])])
    value = np.concatenate([value, np.ones(bins.size)])
    order = np.argsort(of, kind="stable")
    borders = np.searchsorted(of[order], np.arange(rows + 1))
    spans = list(zip(borders[:-1], borders[1:]))
    cell, value = cell[order].astype(np.int32), value[order].astype(np.float32)
    return [pa.array(pattern(votes(m))), pa.array([cell[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([value[a:b].tobytes() for a, b in spans], pa.binary())]


def fit(cells: list[np.ndarray], weights: list[np.ndarray], posterior: np.ndarray, rounds: int = 150, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights of the linear scorer (the last one is the constant) by accelerated gradient steps on the log loss of soft labels.

    Only the cells that a document has are kept, so memory follows the sample's words.
    """
    n = len(cells)
    w, last = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    if not n:
        return w
    sizes = np.array([len(c) for c in cells])
    cell, value, row = np.concatenate(cells), np.concatenate(weights), np.repeat(np.arange(n, dtype=np.int32), sizes)
    for step in range(rounds):
        ahead = w + (step / (step + 3)) * (w - last)
        total = np.bincount(row, value * ahead[cell], minlength=n) + ahead[BUCKETS]
        miss = 1 / (1 + np.exp(-np.clip(total, -50, 50))) - posterior
        slope = np.bincount(cell, value * miss[row], minlength=BUCKETS + 1)
        slope[BUCKETS] += miss.sum()
        last, w = w, ahead - rate * (slope / n + decay * ahead)
    return w


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, dict]:
    """Weights and the labellers' model. The driver sees the vote patterns and `sample` feature rows, never more."""
    votes_of = cut(voted(docs, key, text), "votes")
    table = votes_of.groupBy("pattern").count().collect()  # at most 3^9 rows
    if not table:
        return np.zeros(BUCKETS + 1), {}
    patterns = np.array([r["pattern"] for r in table])
    order = np.argsort(patterns)
    p, model = estimate(patterns[order], np.array([r["count"] for r in table])[order])
    posterior = dict(zip(patterns[order].tolist(), p.tolist()))
    last = votes_of.select("_hash").orderBy("_hash").limit(sample).agg(F.max("_hash")).first()[0]
    features = _mapped(docs, key, text, _features, "pattern bigint, cells binary, weights binary", ["pattern", "cells", "weights"], until=last)
    rows = features.orderBy("_hash", "cells").limit(sample).select("pattern", "cells", "weights").toArrow()
    label = np.array([posterior[v] for v in rows.column("pattern").to_pylist()])
    packed = [[np.frombuffer(v.as_buffer(), kind) for v in rows.column(name)] for name, kind in (("cells", np.int32), ("weights", np.float32))]
    return fit(*packed, label), model


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs with _words and _score (chance of being good, six digits) of every text."""
    w = weights.astype(np.float64)
    source = docs.drop("_words", "_score")
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            m, words = measures(Piece(batch.column(text)))
            by_word, by_shape, bins = buckets_of(m, words, batch.num_rows)
            sums = np.bincount(row_of(words[1]), w[by_word] + w[by_shape], minlength=batch.num_rows) / np.maximum(m["n_words"], 1)
            total = sums + w[bins].sum(1) + w[BUCKETS]
            new = [pa.array(m["n_words"].astype(np.int64)), pa.array(np.round(1 / (1 + np.exp(-np.clip(total, -50, 50))), 6))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "_words", "_score"])

    added = [StructField("_words", LongType()), StructField("_score", DoubleType())]
    return source.mapInArrow(run, StructType([*source.schema.fields, *added]))


def classified(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """One row per row of docs: key, n_words, score (chance of being good), kept (score at least `least`).

    Null and empty texts are texts without words and get the score of such. Rows that repeat a document get the same
    score. Other columns are passed over; an empty table gives no rows.
    """
    own = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    found = scored(own, train(docs, key, text, sample)[0], "_text")
    return found.select(F.col("_key").alias(key), F.col("_words").alias("n_words"), F.col("_score").alias("score"), (F.col("_score") >= least).alias("kept"))


def accepted(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """docs without the rejected rows; all columns as they were."""
    return scored(docs, train(docs, key, text, sample)[0], text).filter(F.col("_score") >= least).drop("_words", "_score")
