import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import workbook as wb

COLUMNS = ("sheet string, row_id long, query string, expected_company string, gold string, "
           "pred_k1 string, pred_k3 string")           # no pred_k5


def rows_of(spark, names, n=4):
    return spark.createDataFrame([(s, i, f"q{i}", None, "g", None if i else "a", "b")
                                  for s in names for i in range(n)], COLUMNS)


def test_sheets_names_and_order_come_from_the_listing(spark, tmp_path, monkeypatch):
    root, order = str(tmp_path / "book"), ["Zeta", "known!", "Empty", "Known"]
    df = rows_of(spark, ["Zeta", "known!", "Known"]).repartition(3)
    wb.write_workbook(df, root, order)
    with pytest.raises(ValueError):
        wb.write_workbook(df, root, order)
    with monkeypatch.context() as m:                   # names and cohorts read no file
        m.setattr(wb.WorkbookReader, "read", None)
        assert wb.sheet_names(spark, root) == order
        assert wb.resolve_names(wb.sheet_names(spark, root)) == {"Known": "Known"}    # the last
    back = wb.read_workbook(spark, root)
    want = df.withColumn("pred_k5", F.lit(None).cast("string")).select(back.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))
    assert wb.read_cohorts(spark, root).select("sheet", "cohort").distinct().collect() == [
        ("Known", "Known")]


def test_only_the_sheets_asked_for_are_opened(spark, tmp_path):
    root = str(tmp_path / "book")
    wb.write_workbook(rows_of(spark, ["A", "B", "C"]), root, ["A", "B", "C"])
    for entry in wb._listing(spark, root):
        if entry["sheet"] == "C":
            for file in entry["files"]:
                (tmp_path / "book" / file).write_bytes(b"not a table")
    some = wb.read_workbook(spark, root, sheets=["A", "B", "Z"])
    # one frame under several filters
    assert {r.sheet for r in some.where("sheet = 'B'").collect()} == {"B"}
    assert some.count() == 8 and some.where("sheet = 'A' and row_id = 1").count() == 1
    assert some.where("sheet is null").isEmpty()
    assert wb.read_workbook(spark, root, sheets=[]).isEmpty()
    with pytest.raises(Exception, match="Parquet|magic"):
        wb.read_workbook(spark, root).count()


def test_unfinished_or_unknown(spark, tmp_path):
    with pytest.raises(ValueError):
        wb.read_workbook(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        wb.write_workbook(rows_of(spark, ["A"]), str(tmp_path / "b"), ["B"])
    with pytest.raises(RuntimeError, match="Available: A, B"):
        wb.resolve_names(["B", "A"])
