from ledgerlens.constants import COMPANY_SHEET_HEADINGS
from ledgerlens.operators import charts
from ledgerlens.session import scratch_path
from ledgerlens.sources import company_sheet


def test_sheet_roundtrip_keeps_headings_and_values(spark):
    rows = [("Acme Ltd", "AC1", 1.5e7, None), (" Beta ", None, 0.000125, 2.0)]
    df = spark.createDataFrame(rows, "company_name string, company_code string, "
                                     "rev_fy_2025 double, pe double")
    path = scratch_path(spark, "sheet-test")
    company_sheet.write_company_sheet(df, path)
    raw = spark.read.option("header", True).csv(path)
    heading = dict(COMPANY_SHEET_HEADINGS)
    assert raw.columns == [heading[c] for c in df.columns]   # trailing space of P/E kept
    back = company_sheet.read_company_sheet(spark, path)
    assert back.columns == df.columns                        # absent headings skipped
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_filter_companies_is_case_insensitive_literal(spark):
    comp = spark.createDataFrame([(1, "Alpha Mining"), (2, "ALPHA MINING HOLDINGS"),
                                  (3, "Beta (Alpha) Mining"), (4, None)],
                                 "row_id long, company_name string")
    req = spark.createDataFrame([("alpha mining",), ("(alpha)",), ("a.pha",), (None,)],
                                "company string")
    got = {(r.company, r.row_id) for r in charts.filter_companies(req, comp).collect()}
    assert got == {("alpha mining", 1), ("alpha mining", 2), ("(alpha)", 3)}
