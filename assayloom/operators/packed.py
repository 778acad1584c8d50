"""Several values packed in one field: one row per value, with position.

The cell grammar, alternatives tried in this order and undone when they fail:

    cell   <- gap* (value (gap value)*)? gap* end         gap <- ws* (separator ws*)+
    value  <- list / quoted / bare
    list   <- '[' ws* (quoted (ws* ',' ws* quoted)*)? ws* ']' &(ws* (separator / end))
    quoted <- quote (doubled quote / escape / any but quote)* quote &(ws* (separator / end))
    bare   <- any but separator, trimmed

Inside a list a backslash escapes the next character; outside, a quote is written twice (or after a backslash). A quote that is
never closed, or closed before other text, fails `quoted`; the parser goes back and reads the value as bare with an error flag.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ";,|/\t\n\r"
PARSED = T.ArrayType(
    T.StructType(
        [
            T.StructField("value", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("kind", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\", "/": "/"}


def grammar(separators: str = SEPARATORS):
    """The parser of one cell: text -> list of (value, start, kind, error)."""
    sep = "[" + re.escape(separators) + "]"
    ws = rf"[^\S{re.escape(separators)}]*"
    gap = re.compile(rf"{ws}(?:{sep}{ws})*")
    after = rf"(?={ws}(?:{sep}|\Z))"
    quoted = re.compile(rf"\"((?:[^\"\\]|\"\"|\\\"|\\(?!\"))*)\"{after}|'((?:[^'\\]|''|\\'|\\(?!'))*)'{after}", re.S)
    listed = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'", re.S)
    comma, closing, opening = re.compile(r"\s*,\s*"), re.compile(rf"\s*\]{after}"), re.compile(r"\[\s*")
    bare = re.compile(rf"(?:(?!{sep}).)+", re.S)
    escaped = re.compile(r"\\(.)", re.S)

    def unescape(text: str) -> str:
        return escaped.sub(lambda m: _ESCAPES.get(m[1], m[0]), text)

    def parse_list(text: str, at: int):
        out, m = [], opening.match(text, at)
        at = m.end()
        while m := listed.match(text, at):
            inner = m[1] if m[1] is not None else m[2]
            out.append((unescape(inner).strip(), at, "list", None))
            at = m.end()
            if not (m := comma.match(text, at)):
                break
            at = m.end()
        m = closing.match(text, at)
        return (out, m.end()) if m else None

    def parse(text: str):
        out, at = [], gap.match(text).end()
        while at < len(text):
            if text[at] == "[" and (found := parse_list(text, at)):
                out += found[0]
                at = found[1]
            elif m := quoted.match(text, at):
                q, inner = text[at], m[1] if m[1] is not None else m[2]
                out.append((inner.replace(q + q, q).replace("\\" + q, q).strip(), at, "quoted", None))
                at = m.end()
            else:
                m = bare.match(text, at)
                value, error = m[0].strip(), None
                if value[:1] in "\"'" and value:
                    value, error = value.strip("\"'").strip(), "malformed quote"
                out.append((value, at, "bare", error))
                at = m.end()
            at = gap.match(text, at).end()
        return [v for v in out if v[0]]

    return parse


def parse_cells(separators: str = SEPARATORS):
    @F.pandas_udf(PARSED)
    def packed_values(cells: pd.Series) -> pd.Series:
        parse = grammar(separators)
        return cells.map(lambda c: None if c is None else [dict(zip(("value", "start", "kind", "error"), v)) for v in parse(c)])

    return packed_values.asNondeterministic()  # its result is used twice; so it is computed once


def unpack(df: DataFrame, row_id: str, fields: list[str], separators: str = SEPARATORS, least: int = 1) -> DataFrame:
    """One row per value: row_id, field_name, pos (from 1, in cell order), value, n_values, start, kind, error.

    Null and blank cells give nothing; empty pieces are no values and take no position; repeated values count each. Cells with fewer
    than `least` values are left out. Other columns of df, whatever their names, are not read. A cell of any length is one value of
    one row; nothing is gathered across rows, so a column that is the same everywhere is no hot spot.
    """
    cells = df.select(F.col(row_id).alias("_row"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("cell")) for f in fields])).alias("c"))
    cells = cells.select("_row", "c.field_name", "c.cell").where(F.trim("cell") != "")
    if least > 1:  # without a separator or a list, whose commas separate whatever the separators are, a cell has one value at most
        cells = cells.where(F.col("cell").rlike(r"[\[" + re.escape(separators) + "]"))
    parsed = cells.select("_row", "field_name", parse_cells(separators)("cell").alias("_values"))
    parsed = parsed.where(F.size("_values") >= least).withColumn("n_values", F.size("_values").cast("long"))
    return parsed.select("_row", "field_name", "n_values", F.posexplode("_values").alias("_pos", "_v")).select(
        F.col("_row").alias(row_id), "field_name", (F.col("_pos") + 1).cast("long").alias("pos"), "_v.value", "n_values", "_v.start", "_v.kind", "_v.error"
    )
