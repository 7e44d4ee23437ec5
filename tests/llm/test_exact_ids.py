"""Ids beyond the integers of a double stay exact beside nulls; odd vectors and null ids in searches and scores."""

from pyspark.sql import functions as F

from assayloom.llm import ann, html_extract, packing, queries

BIG = 2**53 + 1


def test_extraction_keeps_ids(spark):
    page = "<article><p>Some text, long enough to be kept as it is.</p></article>"
    rows = spark.createDataFrame([(BIG, "u", page), (None, None, page), (BIG + 2, "v", None)], "page_id long, url string, html string").coalesce(1)
    got = {(r.page_id, r.url, bool(r.text)) for r in html_extract.extract_main_text(rows).collect()}
    assert got == {(BIG, "u", True), (None, None, True), (BIG + 2, "v", False)}


def test_packing_keeps_ids_through_all_rounds(spark):
    rows = spark.createDataFrame([(BIG + 2 * i if i % 5 else None, "word " * (i % 40)) for i in range(400)], "doc_id long, text string").repartition(7)
    got = packing.pack(rows, capacity=64, slack=0).collect()
    assert {r.doc_id for r in got} == {BIG + 2 * i for i in range(400) if i % 5} | {None}
    names = spark.createDataFrame([("a", "x y"), (None, "z")], "doc_id string, text string").coalesce(1)
    assert {r.doc_id for r in packing.pack(names).collect()} == {"a", None}


def test_the_table_alone_decides_the_width(spark):
    table = spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in range(1, 10)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0, 0.0]), (100, [3.0, 1.0]), (150, [1.0, 3.0, 2.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(table, asked).collect()
    assert {r.query_id for r in got} == {150} and len(got) == 5 and got[0].vec_id == 3


def test_rows_that_share_an_id_are_all_candidates(spark):
    table = spark.createDataFrame([(1, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(table, spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 1] and got[0].score > 0.99 and got[2].score == 0.0


def test_a_null_id_is_not_held_out(spark):
    rows = spark.createDataFrame([(None,), (3,)], "doc_id long").select(F.coalesce(queries.held_out(), F.lit(False)).alias("h"))
    assert all(r.h is not None for r in rows.collect())
