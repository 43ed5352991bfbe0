"""Column expressions for census codes, channels, flags, weeks and dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradearea.schemas import CODE_WIDTHS, HOLIDAY_WEEKS, NEAR_CODES, NEAR_KINDS


def pad_code(code: Column, width: int) -> Column:
    """Zero-pad on the left without ever shortening; '36.0' counts as 36; NULL stays NULL."""
    text = code.cast("string")
    text = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), "0")


def fips_normalize(df: DataFrame) -> DataFrame:
    """Pad the three census codes and add the tract id built from them."""
    padded = df.withColumns({c: pad_code(F.col(c), w) for c, w in CODE_WIDTHS.items()})
    return padded.withColumn("geoid", F.concat(*CODE_WIDTHS))


def cut_last(text: Column) -> Column:
    """Drop the last character (block-group id to tract id)."""
    return F.left(text, F.length(text) - 1)


def month_date(year: Column, month: Column) -> Column:
    """First day of a month."""
    return F.make_date(year, month, F.lit(1))


def iso_week(moment: Column) -> Column:
    return F.weekofyear(moment)


def days_open(opened: Column, as_of: str) -> Column:
    """Days since opening on a fixed day, so that results can be repeated."""
    return F.datediff(F.lit(as_of).cast("date"), opened)


def holiday_flag(week: Column, weeks: Sequence[int] = HOLIDAY_WEEKS) -> Column:
    return F.coalesce(week.isin(*weeks), F.lit(False)).cast("int")


def channel(source: Column, instore_sources: Sequence[str]) -> Column:
    """Order source to 'instore' or 'online'; an unknown source is online."""
    return F.when(source.isin(*instore_sources), "instore").otherwise("online")


def near_flags(prefix: str = "", kinds: Sequence[str] = NEAR_KINDS,
               codes: Sequence[str] = NEAR_CODES) -> dict[str, Column]:
    """One 0/1 column per kind and code, for example all_near_n."""
    return {
        f"{kind}_{code.lower()}": F.when(F.col(f"{prefix}{kind}") == code, 1).otherwise(0)
        for kind in kinds for code in codes
    }


def clean_names(df: DataFrame) -> DataFrame:
    """Blanks and dots in column names become underscores; names in lower case."""
    return df.toDF(*[c.replace(" ", "_").replace(".", "_").lower() for c in df.columns])


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns whose names are listed, in the table's own order."""
    wanted = set(names)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in wanted])


def fill_gaps(df: DataFrame, number: float = 0, text: str = "UNKNOWN") -> DataFrame:
    """NULL numbers become 0 and NULL texts become 'UNKNOWN'."""
    return df.na.fill(number).na.fill(text)
