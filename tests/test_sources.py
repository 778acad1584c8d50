import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.sources import readers as R
from assayloom.streaming.rolling import append_closed, drain, windowed_counts

PDB = """\
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00           N
HETATM 2357  C1  ZQ1 A 301       1.000  -2.500   3.250  1.00  0.00
CONECT 2357 2358 2360
TER
"""
LOG = """\
mode |   affinity | dist from best mode
-----+------------+----------+----------
   1       -6.9      0.000      0.000
   2       -6.1      1.530      2.871
"""


def test_structures(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    atoms = R.read_atoms(spark, str(tmp_path)).orderBy("serial").drop("file").collect()
    assert tuple(atoms[0]) == ("ATOM", 1, "N", "ALA", "A", 1, 11.104, 6.134, -6.504, "N")
    assert tuple(atoms[1]) == ("HETATM", 2357, "C1", "ZQ1", "A", 301, 1.0, -2.5, 3.25, "C")
    assert {(r.serial, r.partner) for r in R.read_bonds(spark, str(tmp_path)).collect()} == {(2357, 2358), (2357, 2360)}


def test_logs_lists_and_settings(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "cmpd_1.log").write_text(LOG)
    (logs / "cmpd_2.log").write_text("nothing docked\n")
    got = {r.file.rsplit("/", 1)[1]: r.score for r in R.docking_scores(spark, str(logs)).collect()}
    assert got == {"cmpd_1.log": -6.9, "cmpd_2.log": None}
    assert R.read_poses(spark, str(logs)).count() == 2
    (tmp_path / "list.smi").write_text("CCO\n\n c1ccccc1 \n")
    assert [(r.name, r.smiles) for r in R.read_smiles_list(spark, str(tmp_path / "list.smi")).collect()] == [("cmpd_1", "CCO"), ("cmpd_3", "c1ccccc1")]
    (tmp_path / "conf.txt").write_text("size_x = 25 # wide\n# none\nmodes=10\n")
    assert {(r.name, r.value) for r in R.read_settings(spark, str(tmp_path / "conf.txt")).collect()} == {("size_x", "25"), ("modes", "10")}


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", b', 1.5, [1]), (2, None, None, None)], "id long, s string, x double, l array<int>")
    R.write_csv(df, str(tmp_path / "out"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("new", T.LongType())])
    got = {tuple(r) for r in R.read_csv(spark, str(tmp_path / "out"), schema, ["id"]).collect()}
    assert got == {(1, 1.5, 'a "quoted", b', None), (2, None, None, None)}
    with pytest.raises(ValueError, match="Missing required columns"):
        R.read_csv(spark, str(tmp_path / "out"), schema, ["pIC50"])
    (tmp_path / "bad.csv").write_text("id,x\n1,soon\n")
    assert R.read_csv(spark, str(tmp_path / "bad.csv"), schema, ["id"]).collect()[0].x is None


def test_windows_of_a_stream(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") * 60).cast("timestamp").alias("ts"), (F.col("id") % 2).alias("kind"), F.col("id").cast("double").alias("v"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = drain(spark, windowed_counts(stream, "ts", ["kind"], "v", "30 minutes", "10 minutes"), "test")
    assert out.agg(F.sum("n_rows"), F.sum("total"), F.max("largest"), F.count("*")).collect()[0] == (100, 4950.0, 99.0, 8)


def test_order_of_files_does_not_matter(spark, tmp_path):
    for name, text in (("b.smi", "CC\n"), ("a.smi", "\nCCC\r\nN\n")):
        (tmp_path / name).write_text(text)
    got = {(r.file.rsplit("/", 1)[1], r.name, r.smiles) for r in R.read_smiles_list(spark, str(tmp_path)).collect()}
    assert got == {("b.smi", "cmpd_1", "CC"), ("a.smi", "cmpd_2", "CCC"), ("a.smi", "cmpd_3", "N")}


def test_lines_are_numbered_over_splits(spark, tmp_path):
    names = [f"C{i}" if i % 3 else "" for i in range(2000)]
    (tmp_path / "long.smi").write_text("\n".join(names) + "\n")
    (tmp_path / "short.smi").write_text("N\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(str(tmp_path / "long.smi")).rdd.getNumPartitions() > 3
        got = {(r.file.rsplit("/", 1)[1], r.name, r.smiles) for r in R.read_smiles_list(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("long.smi", f"cmpd_{i + 1}", n) for i, n in enumerate(names) if n} | {("short.smi", "cmpd_1", "N")}


def test_ligand_of_a_structure(spark, tmp_path):
    more = "HETATM 2358  H1  ZQ1 A 301       1.000  -2.000   3.250  1.00  0.00           H\nHETATM 2359  C1  ZQ1 B 301       9.000  -2.000   3.250  1.00  0.00\n"
    (tmp_path / "a.pdb").write_text(PDB.replace("CONECT 2357 2358 2360", "CONECT 2357 2358 2360\nCONECT 2358 2357") + more)
    atoms, bonds = R.read_atoms(spark, str(tmp_path)), R.read_bonds(spark, str(tmp_path))
    own = R.ligand(atoms, "A", "ZQ1", 301)
    assert sorted(r.serial for r in own.collect()) == [2357, 2358] and [r.serial for r in R.heavy(own).collect()] == [2357]
    assert {(r.serial, r.partner) for r in R.ligand_bonds(bonds, own).collect()} == {(2357, 2358)}
    assert R.ligand(atoms, "A", "ZQ1", 1).count() == 0


def test_pose_coordinates(spark, tmp_path):
    atom = "ATOM      {n}  C   LIG A   1      {x:6.3f}   6.134  -6.504  1.00  0.00     0.123 C \n"
    text = "".join(f"MODEL {m}\nREMARK VINA RESULT:    {-7.5 + m}      0.000      0.000\nROOT\n" + atom.format(n=1, x=m) + atom.format(n=2, x=m + 5) + "ENDMDL\n" for m in (1, 2))
    (tmp_path / "a.pdbqt").write_text(text)
    (tmp_path / "b.pdbqt").write_text(atom.format(n=1, x=3))
    got = {(r.file.rsplit("/", 1)[1], r.model, r.serial, r.x, r.kind, r.affinity) for r in R.read_pose_atoms(spark, str(tmp_path)).collect()}
    assert got == {("a.pdbqt", m, n, m + 5.0 * (n - 1), "C", -7.5 + m) for m in (1, 2) for n in (1, 2)} | {("b.pdbqt", 1, 1, 3.0, "C", None)}


def test_matrix_with_row_labels(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", 1.5), ("a", "y", 2.0), ("a", "x", None), ("c", None, 3.0)], "r string, c string, v double")
    R.write_matrix(df, "r", "c", "v", str(tmp_path / "m"))
    got = [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "m")).orderBy("r").collect()]
    assert got == [("a", None, "2.0"), ("b", "1.5", None), ("c", None, None)]
    with pytest.raises(ValueError):
        R.write_matrix(df, "r", "c", "v", str(tmp_path / "n"), most=1)


def test_late_rows_of_closed_windows_are_left_out(spark, tmp_path):
    schema = "minute long, v double"
    folder, parts = str(tmp_path / "closed"), tmp_path / "in"

    def arrive(name, rows):
        spark.createDataFrame(rows, schema).select((F.col("minute") * 60).cast("timestamp").alias("ts"), "v").coalesce(1).write.mode("append").parquet(str(parts))

    def run():
        stream = spark.readStream.schema("ts timestamp, v double").parquet(str(parts))
        out = append_closed(spark, windowed_counts(stream, "ts", [], "v", "30 minutes", "10 minutes"), folder)
        return {(int(r.window_start.timestamp()) // 60, r.n_rows, r.total) for r in out.collect()}

    arrive("a", [(1, 1.0), (29, 2.0), (31, 4.0), (75, 8.0)])
    assert run() == {(0, 2, 3.0), (30, 1, 4.0)}  # the newest is 75, so windows that end by 65 are closed
    arrive("b", [(5, 100.0), (64, 16.0), (200, 32.0)])  # the first is late, the second is not
    assert run() == {(0, 2, 3.0), (30, 1, 4.0), (60, 2, 24.0)}
