"""Integer codes for categories, and correlation of features with a target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tradearea.operators.grouped import running_total
from tradearea.sources.scratch import cut


def vocabulary(column: str, *tables: DataFrame) -> DataFrame:
    """(value, code): the distinct values of a column in all tables, numbered from 0 in sorted order."""
    values = tables[0].select(F.col(column).cast("string").alias("value"))
    for table in tables[1:]:
        values = values.unionByName(table.select(F.col(column).cast("string").alias("value")))
    known = values.filter("value is not null").distinct().withColumn("one", F.lit(1))
    ranked = running_total(known, [], "value", {"upto": "one"}, slot=F.left("value", F.lit(2)))
    return ranked.select("value", (F.col("upto") - 1).cast("int").alias("code"))


#: values of a vocabulary that is looked up as one map instead of joined, and shares of a value's rows otherwise
MAPPED, SALTS = 256, 16


def encode(df: DataFrame, columns: dict[str, DataFrame], suffix: str = "_cat") -> DataFrame:
    """Add <column>_cat from its vocabulary; a value the vocabulary lacks is an error.

    A vocabulary of up to MAPPED values, by its counted size, is one map that every row reads: no row moves, though a value may
    have most of them. A larger one is joined, each value's rows spread over SALTS tasks.
    """
    for column, vocab in columns.items():
        vocab = cut(vocab, "vocabulary")
        unseen = F.raise_error(F.concat(F.lit(f"unseen {column}: "), F.coalesce(F.col(column), F.lit("NULL")))).cast("int")
        if vocab.limit(MAPPED + 1).count() <= MAPPED:
            codes = vocab.agg(F.map_from_entries(F.collect_list(F.struct("value", "code"))).alias("m")).scalar()
            df = df.withColumn(f"{column}{suffix}", F.coalesce(F.try_element_at(codes, F.col(column)), unseen))
            continue
        rows = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
        names = vocab.select(F.col("value").alias("_value"), F.col("code").alias(f"{column}{suffix}"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_of"))
        df = rows.join(names, (F.col(column) == F.col("_value")) & (F.col("_salt") == F.col("_of")), "left").withColumn(
            f"{column}{suffix}", F.coalesce(F.col(f"{column}{suffix}"), unseen)).drop("_salt", "_value", "_of")
    return df


def numeric_columns(df: DataFrame, leave_out: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in leave_out]


def corr_with(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, correlation, abs_correlation) of every numeric column, from one aggregate pass.

    A column without spread has no correlation (NULL).
    """
    names = list(columns) if columns is not None else numeric_columns(df, [target])
    def one(name: str):
        both = F.col(name).isNotNull() & F.col(target).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (name, target))
        spread = F.when((F.min(x) != F.max(x)) & (F.min(y) != F.max(y)), F.stddev_pop(x) * F.stddev_pop(y))
        return F.try_divide(F.covar_pop(x, y), spread).alias(name)

    wide = df.agg(*[one(c) for c in names])
    long = wide.unpivot([], list(names), "column_name", "correlation")
    return long.withColumn("abs_correlation", F.abs("correlation"))


def top_correlated(correlations: DataFrame, n: int) -> DataFrame:
    return correlations.filter("correlation is not null").orderBy(F.desc("abs_correlation"), "column_name").limit(n)
