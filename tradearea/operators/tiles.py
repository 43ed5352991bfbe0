"""Pairwise work over groups of any size: bounded blocks of rows, met block by block."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 2048


def into_blocks(df: DataFrame, key: Sequence[str], part: Column, fields: Sequence[str]) -> DataFrame:
    """Pack the rows of each (key, part) into one row holding an array of structs."""
    return df.withColumn("part", part).groupBy(*key, "part").agg(
        F.collect_list(F.struct(*fields)).alias("rows"))


def block_pairs(blocks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every ordered pair of blocks of a group: key, part, rows, other_part, other_rows.

    First only the block names meet; the packed rows then follow by (key, part), so the tiles of a
    large group are spread over as many tasks as it has blocks.
    """
    key = list(key)
    names = blocks.select(*key, "part")
    pairs = names.join(names.withColumnRenamed("part", "other_part"), key)
    other = blocks.select(*key, F.col("part").alias("other_part"), F.col("rows").alias("other_rows"))
    return pairs.join(blocks, [*key, "part"]).join(other, [*key, "other_part"])


def field_arrays(tiles: DataFrame, fields: Sequence[str], other_fields: Sequence[str]) -> list[Column]:
    """Columns i_<field> and j_<field>: one flat array per field of the two blocks."""
    return [F.col(f"rows.{f}").alias(f"i_{f}") for f in fields] + [
        F.col(f"other_rows.{f}").alias(f"j_{f}") for f in other_fields]


def list_values(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """One numpy array per row of a list column."""
    column = batch.column(batch.schema.get_field_index(name))
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def with_lists(batch: pa.RecordBatch, keep: Sequence[str], lists: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    """The kept columns of a batch plus new list columns, of whole numbers or doubles as the arrays are."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    for arrays in lists.values():
        ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
        flat = np.concatenate(arrays) if arrays else np.empty(0)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
    return pa.RecordBatch.from_arrays(columns, names=[*keep, *lists])


def pair_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two small matrices, one coordinate at a time."""
    total = np.zeros((len(left), len(right)))
    for k in range(left.shape[1]):
        step = left[:, k, None] - right[None, :, k]
        step *= step
        total += step
    return np.sqrt(total, out=total)


Batches = Iterator[pa.RecordBatch]
