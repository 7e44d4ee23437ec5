import os

import pytest
from pyspark.sql import functions as F

from assayloom.functions.scores import risk_level
from assayloom.plans import jobs as P
from assayloom.session import stage_path, work_root
from assayloom.sources import structures as X
from assayloom.sources import tables as T
from assayloom.sources.assays import union_all
from assayloom.streaming import jobs

PDB = """HEADER    X
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00           N
ATOM      2  CA  PHE A   1      11.639   6.071  -5.147  1.00  0.00           C
ATOM      3  CD1 PHE A   1      10.639   6.071  -5.147  1.00  0.00           C
ATOM      4  NE2 HIS A   2       9.639   6.071  -5.147  1.00  0.00           N
ATOM      5  O   ALA B   1       8.639   6.071  -5.147  1.00  0.00           O
HETATM    6  O   HOH A   3       7.639   6.071  -5.147  1.00  0.00           O
HETATM    7 FE   HEM A   4       6.639   6.071  -5.147  1.00  0.00          FE
HETATM    8 ZN   LIG A   5       5.639   6.071  -5.147  1.00  0.00          ZN
HETATM    9 CL1  LIG A   5       4.639   6.071  -5.147  1.00  0.00          Cl
ATOM     10  HG  SER A   6       3.639   6.071  -5.147  1.00  0.00           H
TER
"""


def test_receptor_file(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    rows = X.fixed_width_atoms(spark, str(tmp_path / "a.pdb")).orderBy("pos").collect()
    assert [(r.atom_name, r.atom_type) for r in rows] == [("N", "N"), ("CA", "C"), ("CD1", "A"), ("NE2", "NA"), ("CL1", "CL"), ("HG", "HD")]
    assert rows[0].x == 11.104 and rows[0].z == -6.504 and rows[0].pos == 1


def test_docking_logs(spark, tmp_path):
    log = "x\nmode |   affinity | dist\n     | (kcal/mol) | rmsd\n-----+----\n   1       -7.5      0.000      0.000\n   2       -7.1      1.5      2.5\nabc 1 2 3\n 3 -1\n"
    (tmp_path / "a.log").write_text(log)
    (tmp_path / "b.log").write_text("no table\n1 2 3 4\n")
    rows = X.parse_dock_logs(spark, str(tmp_path)).collect()
    assert [(r.pose_id, r.affinity, r.rmsd_ub) for r in rows] == [(1, -7.5, 0.0), (2, -7.1, 2.5)]
    logs = spark.createDataFrame([("a", log), ("b", "nothing")], "k string, t string")
    got = {r.k: (r.affinity, r.num_poses) for r in X.pose_summary(logs, "t").collect()}
    assert got == {"a": (-7.5, 2), "b": (None, 0)}


def test_sdf(spark, tmp_path):
    (tmp_path / "a.sdf").write_text("first\n b\n\nM  END\n>  <p>\n1\n\n$$$$\n\n b\n\nM  END\n$$$$\n")
    rows = X.sdf_records(spark, str(tmp_path / "a.sdf")).orderBy("pos").collect()
    assert [(r.name, len(r.properties)) for r in rows] == [("first", 1), ("compound_2", 0)]


def test_positions_follow_lines_over_many_splits(spark, tmp_path):
    (tmp_path / "l.txt").write_text("\n".join("" if i % 10 == 3 else f" line{i} " for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = T.read_lines(spark, str(tmp_path / "l.txt")).collect()
        assert len(rows) == 4500 and all(r["item"] == f"line{r.pos}" for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_union_fills_missing_columns(spark):
    out = union_all(spark.range(1).select("id"), spark.range(1).withColumn("x", F.lit(1)))
    assert sorted((r.id, r.x is None) for r in out.collect()) == [(0, False), (0, True)]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_round_trips(spark, tmp_path, kind):
    path = T.write_table(spark.range(3), str(tmp_path / f"t.{kind}"))
    assert T.read_table(spark, path, "id long").count() == 3


def test_work_folder_follows_the_session(spark):
    class Conf:
        def get(self, name, default=None):
            return "/shared/folder/" if name == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert work_root(Session()) == "/shared/folder"
    assert stage_path(Session(), "x").startswith("/shared/folder/stages/x-")
    assert os.path.isdir(work_root(spark)) and work_root(spark) == work_root(spark)


def feed(spark, folder, name, rows):
    spark.createDataFrame(rows, "id long, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/{name}")


SCHEMA = "id long, ts timestamp, v double"


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    feed(spark, src, "a", [(1, "2024-01-01 00:00:00", 0.1), (2, "2024-01-01 00:01:00", 0.9)])
    jobs.stream_score(source(spark, src), F.col("v"), out, state).awaitTermination()
    feed(spark, src, "b", [(3, "2024-01-02 00:00:00", 0.5)])
    jobs.stream_score(source(spark, src), F.col("v"), out, state).awaitTermination()
    assert sorted((r.id, r.level) for r in spark.read.parquet(out).collect()) == [(1, "low"), (2, "high"), (3, "moderate")]


def test_stream_drops_repeats_within_the_delay(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, src, "a", [(1, "2024-01-01 00:00:00", 0.1), (1, "2024-01-01 00:05:00", 0.2), (2, "2024-01-01 00:06:00", 0.3)])
    jobs.stream_dedup_score(source(spark, src), ["id"], "ts", "1 hour", F.col("v"), out).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_stream_counts_keep_the_last_value(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    leveled = lambda: source(spark, src).withColumn("level", risk_level(F.col("v")))
    feed(spark, src, "a", [(1, "2024-01-01 00:00:00", 0.1), (2, "2024-01-01 03:00:00", 0.2)])
    jobs.stream_risk_counts(leveled(), "ts", "level", out, checkpoint=state).awaitTermination()
    feed(spark, src, "b", [(3, "2024-01-01 04:00:00", 0.1), (4, "2024-01-02 00:00:00", 0.8)])
    jobs.stream_risk_counts(leveled(), "ts", "level", out, checkpoint=state).awaitTermination()
    got = {(str(r.window_start)[:10], r.level): r.n for r in jobs.latest_counts(spark, out).collect()}
    assert got == {("2024-01-01", "low"): 3, ("2024-01-02", "high"): 1}


def test_screen_job(spark):
    compounds = spark.createDataFrame([(0, "a", "C"), (1, "b", "N"), (2, "c", "C")], "pos long, name string, smiles string")
    scored = spark.createDataFrame([("C", "herg", True, -9.0), ("C", "ar", False, None), ("N", "ar", True, -5.0)], "smiles string, target string, success boolean, affinity double")
    out = P.screen(compounds, "pos", ["herg", "ar"], lambda r: r.select("smiles", "target").join(scored, ["smiles", "target"]))
    wide = {r.name: (r.best_target, r.herg_success, r.ar_success) for r in out["wide"].collect()}
    assert wide == {"a": ("herg", True, False), "b": ("ar", False, True), "c": ("herg", True, False)}
    d = out["distribution"].first()
    assert [d.high_risk, d.moderate_risk, d.low_risk, d.no_binding_data] == [2, 0, 1, 0]
    assert {r.target: r.success_rate for r in out["summary"].collect()}["herg"] == pytest.approx(200 / 3)
