"""Quality rules whose cutoffs carry a guarantee: at most a stated share of good documents is rejected.

Each rule compares a measure of the whole text with a cutoff. Cutoffs are tried from the most lenient
to the strictest on labelled good documents of a stratum. A cutoff passes when the exact binomial test
rejects "more than `risk` of the good documents would go": P(Bin(n, risk) <= k) <= level, k of n good
documents being rejected. The first failure ends a sequence, so the level of one sequence needs no
correction for its length; strata and rules share `error` by Bonferroni, and `risk` is split over the
rules. With probability 1 - error the rules then together reject at most `risk` of the good documents in
every stratum. A stratum with too few labels gets no cutoff, and its documents are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradearea.llm.words import SPACED, Piece, in_row, per_row, row_of, shingles, slices
from tradearea.sources.scratch import cut

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: measure (as SQL over the counts) and its cutoffs, lenient first; a document above a cutoff is rejected
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": ("n_symbols / n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1)),
    "repeated_share": ("n_repeat_words / n_words", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "duplicate_line_share": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    "upper_share": ("n_upper / greatest(n_letters, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    "mean_word_chars": ("word_chars / n_words", (30.0, 25.0, 20.0, 15.0, 12.0, 10.0)),
}


def counts(piece: Piece) -> dict[str, np.ndarray]:
    """The counts of each row of a piece."""
    starts, ends, first = piece.spans(SPACED)
    row = row_of(first)
    words = piece.hashes(starts, ends)
    lead = (piece.data & 0xC0) != 0x80
    grams, at = shingles(words, first, 3)
    key = in_row(grams, row[at])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 3, bool)
    for k in range(3):
        covered[at[twice[:-1]] + k] = True
    begins, stops, lines = piece.lines()
    word_bytes = np.concatenate(([0], np.cumsum(SPACED[piece.data], dtype=np.int64)))
    full = word_bytes[stops] > word_bytes[begins]
    line_row = row_of(lines)[full]
    seen = np.unique(in_row(piece.hashes(begins[full], stops[full]), line_row), return_index=True)[1]
    distinct = np.bincount(line_row[seen], minlength=piece.rows)
    upper = (piece.data >= 0x41) & (piece.data <= 0x5A)
    lower = (piece.data >= 0x61) & (piece.data <= 0x7A)
    return {
        "n_words": np.diff(first),
        "word_chars": per_row(lead & SPACED[piece.data], piece.borders),
        "n_symbols": per_row(SYMBOLS[piece.data], piece.borders),
        "n_dup_lines": np.bincount(line_row, minlength=piece.rows) - distinct,
        "n_repeat_words": per_row(covered[:len(words)], first),
        "n_lines": np.bincount(line_row, minlength=piece.rows),
        "n_upper": per_row(upper, piece.borders),
        "n_letters": per_row(upper | lower, piece.borders),
    }


def measured(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The `keep` columns and the counts of each text. Other columns are left out; a null text counts as empty."""
    names = list(keep)
    source = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = counts(Piece(batch.column("_text")))
            arrays = [batch.column(i) for i in range(len(names))] + [pa.array(found[c].astype(np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"_k{i}" for i in range(len(names))] + list(COUNTS))

    kinds = ", ".join([f"_k{i} {source.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(names))] + [f"{c} bigint" for c in COUNTS])
    out = source.mapInArrow(run, kinds)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)], *COUNTS)


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tail(n: int, k: int, share: float) -> float:
    """P(Bin(n, share) <= k), exact up to rounding."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
            + i * math.log(share) + (n - i) * math.log1p(-share) for i in range(int(k) + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def allowed(n: int, share: float, level: float) -> int:
    """The largest k with P(Bin(n, share) <= k) <= level; -1 if there is none."""
    low, high = -1, int(n * share) + 1
    while low < high - 1:
        middle = (low + high) // 2
        low, high = (middle, high) if tail(n, middle, share) <= level else (low, middle)
    return low


def certified(good: DataFrame, stratum: str, rules: Mapping[str, tuple[str, tuple[float, ...]]] = RULES,
              risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """Per stratum one column cut_<rule>: the strictest certified cutoff, or null.

    `good` holds the counts of labelled good documents that pass the base rules. Rejections are counted
    for all rules and cutoffs in one aggregate, so a stratum with most of the rows is no bottleneck. A
    null stratum is a stratum.
    """
    names = list(rules)
    sums = [F.sum((F.expr(rules[r][0]) > F.lit(float(c))).cast("long")).alias(f"k_{i}_{j}")
            for i, r in enumerate(names) for j, c in enumerate(rules[r][1])]
    table = cut(good.groupBy(F.col(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias("n"), *sums), "holdout")
    level = error / max(1, table.count() * len(names))
    share = risk / len(names)
    wide = [rules[r][1] for r in names]

    def strictest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            limits = [allowed(int(n), share, level) for n in frame["n"]]
            out = {"_stratum": frame["_stratum"]}
            for i, cutoffs in enumerate(wide):
                chosen = np.full(len(frame), np.nan)
                open_ = np.ones(len(frame), bool)
                for j, c in enumerate(cutoffs):
                    open_ &= frame[f"k_{i}_{j}"].to_numpy() <= np.array(limits)
                    chosen[open_] = c
                out[f"cut_{i}"] = chosen
            yield pd.DataFrame(out)

    kind = table.schema["_stratum"].dataType.simpleString()
    found = table.mapInPandas(strictest, f"_stratum {kind}, " + ", ".join(f"cut_{i} double" for i in range(len(names))))
    return found.select("_stratum", *[F.when(~F.isnan(f"cut_{i}"), F.col(f"cut_{i}")).alias(f"cut_{r}") for i, r in enumerate(names)])


def judge(counted: DataFrame, cutoffs: DataFrame, stratum: str, rules: Mapping[str, tuple[str, tuple[float, ...]]] = RULES) -> DataFrame:
    """The counts with base_failed, the rules each document breaks, and kept."""
    limits = cutoffs.withColumnRenamed("_stratum", "_of")
    failing = F.filter(F.array(*[
        F.when(F.expr(rules[r][0]) > F.col(f"cut_{r}"), F.lit(r)) for r in rules]), lambda x: x.isNotNull())
    joined = counted.join(limits, F.col(stratum).eqNullSafe(F.col("_of")), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "broken_rules", F.when(F.col("n_words") > 0, failing).otherwise(F.array().cast("array<string>"))).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)).drop("_of", *[f"cut_{r}" for r in rules])


def risk_controlled(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """One row per document: doc_id, stratum, the counts, base_failed, broken_rules, kept.

    `labels` has doc_id and quality (1: good). Of several labels of a document the lowest counts; labels
    without id or quality are passed over. Repeated documents are judged row by row, but equal texts of a stratum are one
    holdout case: copies say nothing new about the risk. Null or empty texts fail the base rules. Empty tables give no rows.
    """
    named = docs.select("doc_id", F.col(stratum).alias("stratum"), F.xxhash64("text").alias("_same"), "text")
    counted = cut(measured(named, ["doc_id", "stratum", "_same"]), "measures")
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("_quality")).filter("_quality = 1").select("doc_id")
    holdout = counted.filter(~base_failed()).join(good, "doc_id", "left_semi").dropDuplicates(["stratum", "_same", *COUNTS])
    return judge(counted, certified(holdout, "stratum", risk=risk, error=error), "stratum").drop("_same")
