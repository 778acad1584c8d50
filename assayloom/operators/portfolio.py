"""Constrained portfolios: the greedy choice of a few rows in a given order, under caps.

The choice depends on what was chosen before, so it cannot be a window. It needs no more than a prefix of the order, though, whose length
is unknown: the frame is read in ordered blocks of bounded size, each one filtered by the caps that are already reached and by what is
chosen, until the portfolio is full or nothing is left. The first row of a block passes all tests, so each scan adds a row and there are at
most wanted + 1 scans a pass, whatever the size of the frame. The portfolio itself and one block at a time reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2_000


def tanimoto(a: list[int], b: list[int]) -> float:
    """Of two fingerprints; 0 where both are empty."""
    mask = (1 << 64) - 1
    both = sum(((x & y) & mask).bit_count() for x, y in zip(a, b))
    either = sum(((x | y) & mask).bit_count() for x, y in zip(a, b))
    return both / either if either else 0.0


def greedy_portfolio(
    df: DataFrame, order: list[tuple[str, bool]], wanted: int, caps: dict[str, int], spread: str | None = None, prints: str | None = None, ceiling: float = 1.0, exempt: int = 3,
    only: dict[str, list] | None = None,
) -> DataFrame:
    """df's rows that are chosen, with place (from 1).

    order: (column, descending), the last one unique; nulls come last. caps: at most so many rows of one value of a column (null is a
    value), of the values that `only` names for it if it does. First pass, in order: a row is taken if no cap is reached and, after the first `exempt`, its value of `spread` is not chosen
    yet or its fingerprint (`prints`, an array of 64-bit words) is less similar than `ceiling` to all that are chosen. Second pass: the free
    places are filled in order under the caps alone. An empty frame gives no rows.
    """
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    unique = order[-1][0]
    chosen: list = []

    def full(column: str) -> list:
        held = [r[column] for r in chosen]
        return [v for v in dict.fromkeys(held) if held.count(v) >= caps[column] and capped(column, v)]

    def capped(column: str, value) -> bool:
        return not only or column not in only or value in only[column]

    def excluded(column: str, values: list) -> Column:
        plain = [v for v in values if v is not None]
        keep = F.lit(True) if not plain else F.coalesce(~F.col(column).isin(plain), F.lit(True))
        return keep & F.col(column).isNotNull() if None in values else keep

    def after(row) -> Column:
        """Rows behind a row in the order, compared column by column."""
        cond = F.lit(False)
        same = F.lit(True)
        for c, down in order:
            v = row[c]
            if v is None:
                same = same & F.col(c).isNull()
                continue
            behind = (F.col(c) < F.lit(v) if down else F.col(c) > F.lit(v)) | F.col(c).isNull()
            cond = cond | (same & F.coalesce(behind, F.lit(False)))
            same = same & F.coalesce(F.col(c) == F.lit(v), F.lit(False))
        return cond

    def fresh() -> Column:
        """varied_enough of what is chosen so far, so that rows too similar to it never reach the driver."""
        cond = excluded(spread, [r[spread] for r in chosen]) if spread else F.lit(False)
        if not prints:
            return cond
        apart = F.lit(True)
        for r in chosen:
            both = sum((F.bit_count(F.col(prints)[i].bitwiseAND(F.lit(w))) for i, w in enumerate(r[prints])), F.lit(0))
            either = sum((F.bit_count(F.col(prints)[i].bitwiseOR(F.lit(w))) for i, w in enumerate(r[prints])), F.lit(0))
            apart = apart & (F.coalesce(F.try_divide(both.cast("double"), either.cast("double")), F.lit(0.0)) < ceiling)
        return cond | apart

    def varied_enough(row) -> bool:
        if spread and all(r[spread] != row[spread] for r in chosen):
            return True
        return bool(prints) and all(tanimoto(row[prints], r[prints]) < ceiling for r in chosen)

    for varied in ([True, False] if spread or prints else [False]):
        last = None
        while len(chosen) < wanted:
            left = df.where(reduce(lambda a, b: a & b, [excluded(c, full(c)) for c in caps], F.lit(True)))
            left = left.where(excluded(unique, [r[unique] for r in chosen]))
            if varied and len(chosen) >= exempt:
                left = left.where(fresh())
            if last is not None:
                left = left.where(after(last))
            block = left.orderBy(*keys).limit(BLOCK_ROWS).collect()
            if not block:
                break
            for row in block:
                if len(chosen) == wanted:
                    break
                held = {c: sum(r[c] == row[c] for r in chosen) for c in caps}
                if any(held[c] >= caps[c] and capped(c, row[c]) for c in caps):
                    continue
                if varied and len(chosen) >= exempt and not varied_enough(row):
                    continue
                chosen.append(row)
            last = block[-1]
    place = {r[unique]: k + 1 for k, r in enumerate(chosen)}
    if not place:
        return df.where(F.lit(False)).withColumn("place", F.lit(0).cast("long"))
    at = F.create_map(*[x for k, v in place.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return df.where(F.col(unique).isin(list(place))).withColumn("place", at[F.col(unique)])
