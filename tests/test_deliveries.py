"""Deliveries of other columns and types than declared, corrupt lines, and values that a table does not allow."""

import json

from pyspark.sql import functions as F

from larder.sources import deliveries as D


def test_deliveries(spark, tmp_path):
    root = tmp_path / "dish_reports"
    spark.createDataFrame([("1", "a", "open"), ("2", "b", "odd"), ("3", None, None)], "id string, dish_id string, status string").write.parquet(str(root / "d1"))
    # numbers for texts, texts for times, a column that is not declared
    spark.createDataFrame([(4, 7, "2024-01-02 03:04:05", 1), (5, 8, "yesterday", 2), (6, 9, None, 3)], "id int, dish_id int, created_at string, extra int").write.parquet(str(root / "d2"))
    (root / "d3.json").write_text('{"id":"7","status":"open","created_at":"2024-01-02"}\n{"id":"8", broken\n{"id":9,"created_at":"never"}\n{"id":"10","notes":{"a":1},"status":"dismissed"}\n{"id":"11","status":"x"}\n')
    (root / "_tmp").mkdir()
    got = D.read_deliveries(spark, str(root), "dish_reports")
    assert got.rows.columns == [*D.declared("dish_reports").names, "delivery"]
    assert [f.dataType for f in got.rows.schema.fields[:-1]] == [f.dataType for f in D.declared("dish_reports").fields]
    rows = {r.id: (r.dish_id, r.status, r.created_at is not None, r.delivery) for r in got.rows.collect()}
    assert rows == {"1": ("a", "open", False, "d1"), "3": (None, None, False, "d1"), "4": ("7", None, True, "d2"), "6": ("9", None, False, "d2"), "7": (None, "open", True, "d3.json"), "10": (None, "dismissed", False, "d3.json")}
    assert got.rows.filter("id = '10'").first().notes == '{"a":1}'
    aside = sorted((r.delivery, r.reason, r.content) for r in got.aside.collect())
    assert [(d, r) for d, r, _ in aside] == [("d1", "not allowed: status"), ("d2", "drift: created_at"), ("d3.json", "corrupt"), ("d3.json", "drift: created_at"), ("d3.json", "not allowed: status")]
    contents = [json.loads(c) for _, _, c in aside]
    assert contents[1]["extra"] == 2 and "broken" in contents[2]["_corrupt_record"] and contents[3]["id"] == "9"


def test_no_deliveries(spark, tmp_path):
    got = D.read_deliveries(spark, str(tmp_path), "pages")
    assert got.rows.collect() == [] and got.aside.collect() == [] and got.rows.columns == ["page_id", "url", "html", "delivery"]
    spark.range(0).select(F.col("id").alias("page_id")).write.parquet(str(tmp_path / "d1"))
    assert D.read_deliveries(spark, str(tmp_path), "pages").rows.count() == 0
