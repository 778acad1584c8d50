"""The canonical spelling of a molecule: a SMILES with its formatting set aside."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators.skew import salted_lookup
from assayloom.shared import stored

# Symbols of the chemical elements with two letters.
ELEMENTS = (
    "He Li Be Ne Na Mg Al Si Cl Ar Ca Sc Ti Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te Xe Cs "
    "Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa Np Pu Am Cm Bk Cf Es Fm "
    "Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
# Typographic signs and the ASCII sign that each stands for.
STAND_INS = {
    "-": "‐‑‒–—―−⁃˗﹘﹣⁻₋",
    "+": "⁺₊﹢➕",
    "=": "⁼₌﹦꞊═",
    "#": "﹟⌗",
    "/": "⁄∕⧸",
    "\\": "∖⧵﹨",
    ".": "·•∙⋅․・",
    "'": "‘’‚‛′ʼ",
    '"': "“”„‟″«»",
    "<": "‹〈⟨",
    ">": "›〉⟩",
}
#: Marks without width that are not of the Unicode categories space, control and format.
BLANKS = "ᅟᅠㅤﾠ⠀͏︎️"
_TWO = {e.lower(): e for e in ELEMENTS}


def _plain() -> dict[int, str | None]:
    signs = {ord(c): k for k, v in STAND_INS.items() for c in v}
    signs |= {0xFEE0 + i: chr(i) for i in range(0x21, 0x7F)}  # full-width forms
    return signs | {ord(c): None for c in BLANKS}


def smiles_parts() -> Callable[[str], list[str]]:
    """The parts of a SMILES in canonical spelling: its dot-separated components. Blank strings have none."""
    signs = _plain()
    bracket = re.compile(r"(\[\d*)([A-Za-z])([a-zA-Z])")
    organic = re.compile(r"[Cc][Ll]|[Bb][Rr]")
    # What can stand before or after a letter, an aromatic one too, inside brackets: H counts are no second letters.
    hydrogen = {c + "h" for c in "bcnosp"} | {c.upper() + "h" for c in "bcnosp"}

    def element(m: re.Match) -> str:
        pair = m[2] + m[3]
        if m[2] + m[3].lower() in hydrogen and m[3] == "H":
            return m[0]
        return m[1] + _TWO.get(pair.lower(), pair)

    def visible(c: str) -> bool:
        return not (c.isspace() or unicodedata.category(c) in ("Cc", "Cf", "Zs", "Zl", "Zp"))

    def one_pair(text: str) -> bool:
        """Whether the first bracket is closed by the last character."""
        depth = 0
        for i, c in enumerate(text):
            depth += (c == "(") - (c == ")")
            if not depth:
                return i == len(text) - 1
        return False

    def parts(text: str) -> list[str]:
        if not text.isascii():
            text = text.translate(signs)
        text = "".join(text.split())
        if not (text.isascii() and text.isprintable()):
            text = "".join(filter(visible, text))
        while True:
            cut = text.strip("\"'`<>{}").rstrip(",;.:!?")
            if cut.startswith("(") and cut.endswith(")") and one_pair(cut):
                cut = cut[1:-1]
            if cut == text:
                break
            text = cut
        text = bracket.sub(element, organic.sub(lambda m: m[0].capitalize(), text))
        return [p for p in text.split(".") if p]

    return parts


def with_molecule(df: DataFrame, value: str, spread: str, name: str = "molecule") -> DataFrame:
    """df's rows that name a molecule, with its canonical spelling: components in order, joined by dots. Null and blank strings name none.

    Each distinct string is spelled once and looked up, hot ones spread by a hash of column spread.
    """

    @F.pandas_udf("string")
    def canonical(values: pd.Series) -> pd.Series:
        f = smiles_parts()
        return values.map(lambda v: ".".join(sorted(f(v))) or None)

    canonical = canonical.asNondeterministic()  # filtered by its result; so it is computed once
    distinct = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    spelled = stored(distinct.withColumn(name, canonical(value)).where(F.col(name).isNotNull()), "molecules")  # read thrice
    return salted_lookup(df, spelled, value, spread, "_n").drop("_n")


def canonical_sql(c: str) -> str:
    """The same rules as nested ANSI SQL, for comparison: spaces and marks, stand-ins, wrapping, letter case, component order."""
    c = rf"regexp_replace({c}, '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]', '', 'g')"
    c = f"translate({c}, '\u2013\u2212\u201c\u201d', '--\"\"')"
    c = rf"""regexp_replace(regexp_replace({c}, '^["''`<>{{}}]+', ''), '["''`<>{{}},;.:!?]+$', '')"""
    c = f"regexp_replace(regexp_replace({c}, 'cl', 'Cl', 'gi'), 'br', 'Br', 'gi')"
    for e in (e for e in ELEMENTS if e not in ("Cl", "Br") and not (e[1] == "h" and e[0] in "BNCOSP")):
        c = rf"regexp_replace({c}, '\[(\d*){e}', '[\1{e}', 'gi')"
    return f"array_to_string(list_sort(string_split({c}, '.')), '.')"
