"""Stored briefs."""

from datetime import datetime

from pyspark.sql import functions as F

from factloom import schemas
from factloom.operators import briefs

ROWS = [
    ("1", "Who paid?", "b", ["j [E1]"], ["d1"], "low", None, "model", datetime(2025, 1, 1)),
    ("2", "who  PAID? ", "b", [], [], None, "a gap", "model", datetime(2025, 1, 2)),
    ("3", "Who paid?", "b", None, None, None, None, "template", datetime(2025, 1, 3)),
    ("4", "hi", None, None, None, None, None, "triage", None),
    ("5", "x", None, None, None, None, None, None, None),
]


def table(spark):
    return spark.createDataFrame(ROWS, schemas.BRIEFS)


def test_store(spark, tmp_path):
    path = str(tmp_path / "b")
    for _ in range(2):
        briefs.append(table(spark), path)
    assert spark.read.parquet(path).count() == 8
    briefs.rebuild(table(spark).limit(1), path)
    assert spark.read.parquet(path).count() == 1


def test_read(spark):
    b = table(spark)
    assert [r.brief_id for r in briefs.saved(b, " WHO paid?", 5).collect()] == ["2", "1"]
    assert [r.brief_id for r in briefs.snapshot(b).orderBy("brief_id").collect()] == ["1", "2"]
    text = {r.brief_id: r.t for r in b.select("brief_id", briefs.render(b).alias("t")).collect()}
    assert text["1"] == "QUESTION: Who paid?\n\nKEY JUDGMENTS\n- j [E1]\n\nCONFIDENCE\nlow\n\nCITED\n- d1"
    assert text["2"].endswith("INTELLIGENCE GAPS\na gap") and text["5"] == "QUESTION: x"
    assert b.where("brief_id = '2'").select(briefs.null_if_empty("citations")).first()[0] is None


def test_triage(spark):
    rows = [("hi", 9), ("harvest", 0), ("harvest", None), ("harvest", 2), ("harvest", 3), (None, 3)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string, n int").select(briefs.triage(F.col("q"), F.col("n"))).collect()]
    assert got == ["capabilities", "no_reporting", "no_reporting", "collect", "brief", "brief"]


def test_report():
    block = briefs.report({"recall": 0.5})
    once = briefs.replace_block("# Title\n", block)
    assert "| recall | 0.500 |" in once and briefs.replace_block(once, block) == once
