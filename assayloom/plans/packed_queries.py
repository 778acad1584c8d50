"""Queries of problem 4: values packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators.packed import unpack
from assayloom.shared import table

FIELDS = ["parent_ids", "methods", "transforms"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = unpack(table(spark, sf_dir, "lead_selection_relaxed_pool"), "row_id", FIELDS, least=2)
    return values.select("row_id", "field_name", "pos", "value")


def p4_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each packed value occurs, by field, with the rows that hold it and malformed spellings."""
    values = unpack(table(spark, sf_dir, "lead_selection_relaxed_pool"), "row_id", FIELDS)
    return values.groupBy("field_name", "value").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("pos") == 1).alias("n_first"), F.count("error").alias("n_malformed")
    )


_SPACE = r"[\s\p{Z}]"
_IN_LIST = r'"(?:[^"\\]|\\.)*"|' + r"''(?:[^''\\]|\\.)*''"
#: The grammar as far as regular expressions reach, over the spellings that the tables hold: a list of quoted values, else quoted and bare
#: values one after the other, whichever alternative stands first.
_LISTED = rf"^\[\s*(?:{_IN_LIST})(?:\s*,\s*(?:{_IN_LIST}))*\s*\]$"
_PIECE = r"[\x0b\x0c\p{Z}]*(" + '"(?:[^"]|"")*"|' + "''(?:[^'']|'''')*''|" + r"[^;,|/\t\n\r]+)"


def values_sql(fields: list[str]) -> str:
    """(row_id, field_name, pos, value, n_values) of the packed fields of the pool."""
    names, cells = ", ".join(f"'{f}'" for f in fields), ", ".join(fields)
    trim = lambda c: f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    unescape = r"replace(replace(replace(x[2:-2], '\\', chr(1)), '\"', '" + '"' + r"'), chr(1), '\')"
    listed = f"list_transform(regexp_extract_all(cell, '({_IN_LIST})', 1), lambda x: {unescape})"
    quoted = "CASE WHEN x LIKE '\"%\"' AND length(x) > 1 THEN replace(x[2:-2], '\"\"', '\"') WHEN x LIKE '''%''' AND length(x) > 1 THEN replace(x[2:-2], '''''', '''') ELSE x END"
    plain = f"list_transform(list_transform(regexp_extract_all(cell, '{_PIECE}', 1), lambda x: {trim('x')}), lambda x: {quoted})"
    return f"""
SELECT row_id, field_name, unnest(range(1, len(vs) + 1)) AS pos, unnest(vs) AS value, len(vs) AS n_values FROM (
  SELECT row_id, field_name, list_filter(list_transform(CASE WHEN regexp_matches(cell, '{_LISTED}') THEN {listed} ELSE {plain} END, lambda x: {trim('x')}), lambda x: x <> '') AS vs
  FROM (SELECT row_id, field_name, {trim('cell')} AS cell FROM (SELECT row_id, unnest([{names}]) AS field_name, unnest([{cells}]) AS cell FROM lead_selection_relaxed_pool)) WHERE cell <> '')"""


SQL = {
    "p4_found": f"SELECT row_id, field_name, pos, value FROM ({values_sql(FIELDS)}) WHERE n_values >= 2",
    "p4_value_counts": f"""SELECT field_name, value, count(*) AS n_values, count_if(pos = 1)::BIGINT AS n_first, count_if(value[1] IN ('"', ''''))::BIGINT AS n_malformed
FROM ({values_sql(FIELDS)}) GROUP BY ALL""",
}
QUERIES = {"p4_found": p4_found, "p4_value_counts": p4_value_counts}
