"""Counts that can be read off a SMILES string by pattern, as native expressions. They do not parse the molecule: hydrogens, aromaticity
and valence are out of reach, and whatever needs them takes a table of descriptors instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ATOM = r"\[[^\]]*\]|Br|Cl|[BCNOSPFIbcnosp]"
# Standard atomic weights of the elements that can stand outside brackets.
WEIGHTS = {"B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "P": 30.974, "S": 32.06, "Cl": 35.45, "Br": 79.904, "I": 126.904}


def atoms(smiles: Column) -> Column:
    """The atom tokens in order, brackets whole."""
    return F.regexp_extract_all(smiles, F.lit(f"({ATOM})"), F.lit(1))


def element(atom: Column) -> Column:
    """The symbol of an atom token, in the upper-case spelling."""
    return F.initcap(F.regexp_extract(atom, r"^\[?\d*(Br|Cl|[A-Z][a-gi-z]?|[a-z])", 1))


def heavy_atoms(smiles: Column) -> Column:
    return F.size(F.filter(atoms(smiles), lambda a: ~a.rlike(r"^\[\d*H[+\-\d]*\]$"))).cast("long")


def components(smiles: Column) -> Column:
    return F.size(F.filter(F.split(smiles, r"\."), lambda p: p != "")).cast("long")


def rings(smiles: Column) -> Column:
    """Ring closures: their digits come in pairs; %nn is one digit."""
    outside = F.regexp_replace(smiles, r"\[[^\]]*\]", "")
    return F.floor(F.regexp_count(outside, F.lit(r"%\d\d|\d")) / 2).cast("long")


def charge(smiles: Column) -> Column:
    """Sum of the formal charges in brackets: [O-], [N+], [Ca+2], [Ca++]."""
    marks = F.regexp_extract_all(smiles, F.lit(r"\[[^\]+\-]*([+\-]+\d*)\]"), F.lit(1))
    size = lambda m: F.coalesce(F.regexp_extract(m, r"(\d+)$", 1).try_cast("int"), F.length(m))
    return F.aggregate(F.transform(marks, lambda m: F.when(m.startswith("-"), -size(m)).otherwise(size(m))), F.lit(0), lambda a, x: a + x).cast("long")


def heavy_weight(smiles: Column) -> Column:
    """Weight of the atoms other than hydrogen; null where an element is not in WEIGHTS."""
    table = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.aggregate(F.transform(atoms(smiles), lambda a: table[element(a)]), F.lit(0.0), lambda s, w: s + w)


def one_molecule(s: Column) -> Column:
    """Whether a SMILES is of one component and has no open site (a dummy atom, *); null and blank strings are of none."""
    return F.coalesce((F.trim(s) != "") & ~F.contains(s, F.lit(".")) & ~F.contains(s, F.lit("*")), F.lit(False))
