"""Column builders: cleaning, label semantics, normalisation and weighted scores. NaN counts as missing everywhere."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DESCRIPTORS = "mw logp tpsa hbd hba rot rings hac fsp3 bertz balaban chi0v chi1v chi2v kappa1 kappa2 kappa3".split()


def known(c: str | Column) -> Column:
    """A number, null where it is NaN, so that no comparison takes NaN for large."""
    return F.nanvl(F.col(c) if isinstance(c, str) else c, F.lit(None).cast("double"))


def at_least(c: str, limit: float) -> Column:
    """c >= limit, which NaN does not pass although Spark takes it for the largest number; the comparison itself reaches the scan."""
    return (F.col(c) >= limit) & ~F.isnan(c)


def at_most(c: str, limit: float) -> Column:
    """c <= limit; NaN is above every limit."""
    return F.col(c) <= limit


def without_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: known(c) for c, kind in df.dtypes if kind in ("double", "float")})


def tidy(c: str) -> Column:
    """Text without surrounding whitespace of any kind, null where nothing is left."""
    return F.nullif(F.regexp_replace(F.col(c).cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def key_of(c: str) -> Column:
    """Identifiers that differ in case and punctuation only are one: upper-case letters and digits, null where there are none."""
    return F.nullif(F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")), F.lit(""))


def number(c: str | Column) -> Column:
    """A lenient number: null where the text is none."""
    return known((F.col(c) if isinstance(c, str) else c).cast("string").try_cast("double"))


def require_known(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if none of these numbers is null or NaN; else an error that says how many of each are. One scan."""
    row = df.agg(*[F.count_if(known(c).isNull()).alias(c) for c in columns]).collect()[0]  # one row
    unknown = {c: row[c] for c in columns if row[c]}
    if unknown:
        raise ValueError(f"Numeric parsing failed: {unknown}")
    return df


def label_flags(code: Column) -> dict[str, Column]:
    """Independent flags of a label code: above 0 measured, 0 active without number, -1 inactive; other codes set none."""
    flags = {"is_measured": code > 0, "is_active_unmeasured": code == 0, "is_inactive": code == -1, "is_assigned": code.isin(0, -1)}
    return {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}


@F.pandas_udf(T.StringType())
def four_digits(x: pd.Series) -> pd.Series:
    """%.4g as C and Python print it; the JVM's formatter keeps trailing zeros and rounds ties up."""
    return x.map(lambda v: None if pd.isna(v) else format(v, ".4g"))


def violations(*tests: Column) -> Column:
    """How many tests are true; an unknown one is not."""
    return reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(False)).cast("long") for t in tests])


def closeness(c: str | Column, target: float, tolerance: float) -> Column:
    x = known(c)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(x - target) / tolerance)) + x * 0  # null stays null


def micromolar(pic50: Column) -> Column:
    return F.pow(F.lit(10.0), 6 - pic50)


def row_mean(cols: list[Column]) -> Column:
    """Mean over the known values of a row."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols]), n)


def row_spread(cols: list[Column]) -> Column:
    """Population standard deviation over the known values of a row."""
    mean = row_mean(cols)
    return F.sqrt(row_mean([(c - mean) * (c - mean) for c in cols]))


def weighted(*terms: tuple[float, Column]) -> Column:
    return reduce(lambda a, b: a + b, [w * c for w, c in terms])


def population(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: minimum, maximum, mean and population deviation of each column. What is normalised is relative to this frame."""
    out = []
    for c in cols:
        x = known(c)
        out += [F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}"), F.avg(x).alias(f"mean_{c}"), F.stddev_pop(x).alias(f"std_{c}")]
    return df.agg(*out)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a frame of exactly one row (an aggregate without groups)."""
    return df.crossJoin(F.broadcast(one_row))


def higher(c: str) -> Column:
    """(x - min) / (max - min) over the population beside the row; 1 where the population has one value."""
    low, high = F.col(f"min_{c}"), F.col(f"max_{c}")
    same = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return F.when(same, known(c) * 0 + 1.0).otherwise(F.try_divide(known(c) - low, high - low))


def lower(c: str) -> Column:
    return 1 - higher(c)


def distance_to_training(cols: list[str]) -> Column:
    """Root mean square of the z scores against the training population beside the row, over the descriptors that are known."""
    z = [(known(c) - F.col(f"mean_{c}")) / F.coalesce(F.nullif(F.col(f"std_{c}"), F.lit(0.0)), F.lit(1.0)) for c in cols]
    return F.sqrt(row_mean([x * x for x in z]))
