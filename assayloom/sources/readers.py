"""File sources: typed CSV, structure files (fixed-width PDB), docking logs, SMILES lists and key = value settings, all as Spark text or CSV
scans with native column expressions. Order inside a file comes from the file itself, never from row numbers after a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.shared import stored

PATH = "_metadata.file_path"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str] = ()) -> DataFrame:
    """A CSV with a header and a declared schema; its header is checked for the required columns, extra columns are left out.

    Values that do not parse are null.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(required) - set(header))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    text = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path)
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """df as CSV with a header; columns that CSV cannot hold (arrays, maps, structs, binary) are left out with those named."""
    flat = [f.name for f in df.schema if f.name not in drop and not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType)]
    df.select(*flat).write.option("header", True).option("escape", '"').csv(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value"), F.col(PATH).alias("file"))


def _field(start: int, length: int) -> Column:
    return F.nullif(F.trim(F.substring("value", start, length)), F.lit(""))


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """ATOM and HETATM records: file, record, serial, atom, residue, chain, number, x, y, z, element. The element column may be blank, then
    it is the first letter of the atom's name. Lines with malformed numbers keep their row with nulls."""
    lines = _lines(spark, path).where(F.col("value").rlike("^(ATOM  |HETATM)"))
    name = _field(13, 4)
    return lines.select(
        "file", F.trim(F.substring("value", 1, 6)).alias("record"), _field(7, 5).try_cast("long").alias("serial"), name.alias("atom"), _field(18, 3).alias("residue"),
        _field(22, 1).alias("chain"), _field(23, 4).try_cast("long").alias("number"), *[_field(31 + 8 * i, 8).try_cast("double").alias(a) for i, a in enumerate("xyz")],
        F.coalesce(_field(77, 2), F.regexp_extract(name, "([A-Za-z])", 1)).alias("element"),
    )


def read_bonds(spark: SparkSession, path: str) -> DataFrame:
    """CONECT records as (file, serial, partner), one row per pair and direction."""
    lines = _lines(spark, path).where(F.col("value").startswith("CONECT"))
    partners = F.array(*[_field(7 + 5 * i, 5).try_cast("long") for i in range(1, 5)])
    return lines.select("file", _field(7, 5).try_cast("long").alias("serial"), F.explode(partners).alias("partner")).where("partner IS NOT NULL")


def ligand(atoms: DataFrame, chain: str, residue: str, number: int) -> DataFrame:
    """The atoms of one ligand: HETATM records of that chain, residue name and number."""
    return atoms.where((F.col("record") == "HETATM") & (F.col("chain") == chain) & (F.col("residue") == residue) & (F.col("number") == number))


def heavy(atoms: DataFrame) -> DataFrame:
    """Atoms without hydrogen (and deuterium)."""
    return atoms.where(~F.upper("element").isin("H", "D"))


def ligand_bonds(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """(file, serial, partner) of the bonds both ends of which are among the atoms, each pair once."""
    ends = atoms.select("file", "serial")
    inside = bonds.join(ends, ["file", "serial"], "left_semi").join(ends.withColumnRenamed("serial", "partner"), ["file", "partner"], "left_semi")
    return inside.select("file", F.least("serial", "partner").alias("serial"), F.greatest("serial", "partner").alias("partner")).distinct()


def read_pose_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Coordinates of docked poses (PDBQT): file, model, serial, atom, x, y, z, kind, affinity of the model (from its remark). Models are told
    apart by their MODEL lines, in the order of the file; the atoms of a file without such lines are of model 1."""
    lines = _lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    lines = stored(lines.where(F.col("value").rlike("^(MODEL|ATOM  |HETATM|REMARK VINA RESULT:)")), "poses")
    so_far = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # a file is one docking run of a few poses
    model = F.greatest(F.lit(1), F.count_if(F.col("value").startswith("MODEL")).over(so_far)).cast("long")
    lines = lines.withColumn("model", model)
    scores = lines.where(F.col("value").startswith("REMARK")).groupBy("file", "model").agg(F.min(F.regexp_extract("value", r"RESULT:\s+(-?\d+(?:\.\d+)?)", 1).try_cast("double")).alias("affinity"))
    atoms = lines.where(F.col("value").rlike("^(ATOM  |HETATM)")).select(
        "file", "model", _field(7, 5).try_cast("long").alias("serial"), _field(13, 4).alias("atom"), *[_field(31 + 8 * i, 8).try_cast("double").alias(a) for i, a in enumerate("xyz")], _field(78, 2).alias("kind")
    )
    return atoms.join(scores, ["file", "model"], "left")


def write_matrix(cells: DataFrame, row: str, column: str, value: str, path: str, most: int = 10_000) -> None:
    """A table of cells (row, column, value) as CSV with row labels: one line per row, one column per label in ascending order, blank where
    there is no cell. The labels make the header, so there may be at most `most` different ones."""
    labels = [r[0] for r in cells.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(labels) > most:
        raise ValueError(f"a matrix has at most {most} columns")
    wide = cells.groupBy(row).pivot(column, labels).agg(F.first(value))
    wide.repartitionByRange(row).sortWithinPartitions(row).write.option("header", True).option("escape", '"').csv(path)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """The table of modes in docking logs: file, mode, affinity, rmsd_low, rmsd_high."""
    lines = _lines(spark, path)
    number = r"(-?\d+(?:\.\d+)?)"
    row = rf"^\s*(\d+)\s+{number}\s+{number}\s+{number}\s*$"
    take = lambda i, kind: F.regexp_extract("value", row, i).cast(kind)
    return lines.where(F.col("value").rlike(row)).select("file", take(1, "long").alias("mode"), *[take(i, "double").alias(c) for i, c in enumerate(("affinity", "rmsd_low", "rmsd_high"), 2)])


def docking_scores(spark: SparkSession, path: str) -> DataFrame:
    """(file, score): the affinity of the first mode of each log; null for a log without one."""
    files = _lines(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    best = read_poses(spark, path).groupBy("file").agg(F.min_by("affinity", "mode").alias("score"))
    return files.join(best, "file", "left").select("file", "score")


def read_smiles_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, smiles): a line each; blank lines are left out but counted in the name cmpd_<line>.

    Files of any size are read in splits. Lines are numbered within their split, in the order of the file, and get the number of lines in the
    splits before it; the lines are stored once, so that both see the same splits.
    """
    lines = spark.read.text(path).select("value", F.col(PATH).alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = stored(lines, "lines")
    sizes = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))  # one row per split
    before = sizes.select("file", "start", (F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "start").orderBy("at"))
    numbered = lines.join(before, ["file", "start"]).withColumn("line", F.col("before") + place)
    smiles = F.trim(F.regexp_replace("value", "\r$", ""))
    return numbered.where(smiles != "").select("file", F.concat(F.lit("cmpd_"), "line").alias("name"), smiles.alias("smiles"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, value) of lines name = value; comments after # and other lines are left out."""
    lines = _lines(spark, path).withColumn("value", F.regexp_replace("value", "#.*$", ""))
    return lines.where(F.col("value").contains("=")).select("file", F.trim(F.split("value", "=", 2)[0]).alias("name"), F.trim(F.split("value", "=", 2)[1]).alias("value"))
