import os

import pytest

from ledgerlens import session as S


def test_spread_only_rebalances_few_files(spark, tmp_path):
    par = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert S.spread(one).rdd.getNumPartitions() == par
    spark.range(100).repartition(par * 2).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert S.spread(many) is many


def test_cut_lineage_writes_under_checkpoint_dir(spark):
    df = spark.range(10).selectExpr("id", "id * 2 AS x")
    cut = S.cut_lineage(df)
    base = S.ensure_checkpoint_dir(spark).rstrip("/")
    files = cut.inputFiles()
    assert files and all(f.replace("file://", "file:").split(":", 1)[-1].lstrip("/")
                         .startswith(base.split(":", 1)[-1].lstrip("/")) for f in files)
    assert sorted(r.x for r in cut.collect()) == [2 * i for i in range(10)]


def test_size_check_and_bounded_broadcast(spark):
    small, big = spark.range(5), spark.range(50)
    assert S.rows_at_most(small, 5) and not S.rows_at_most(big, 5)
    plan = S.bounded_broadcast(big, 5).join(small, "id")._jdf.queryExecution() \
        .logical().toString()
    assert "broadcast" not in plan.lower()


def test_scratch_tables_go_with_their_scope(spark):
    def there(df):
        return os.path.exists(df.inputFiles()[0].replace("file://", ""))

    before = S.cut_lineage(spark.range(3))
    with S.scratch_scope(spark):
        outer = S.cut_lineage(spark.range(4))
        with S.scratch_scope(spark):
            inner = S.cut_lineage(spark.range(5))
            assert inner.count() == 5 and there(inner)
            gone = inner.inputFiles()[0].replace("file://", "")
        assert not os.path.exists(gone)
        assert outer.count() == 4 and there(outer)
        unused = S.scratch_path(spark, "never-written")
        gone = outer.inputFiles()[0].replace("file://", "")
    assert not os.path.exists(gone) and not os.path.exists(unused)
    assert before.count() == 3


def test_scratch_tables_go_after_an_error(spark):
    with pytest.raises(ZeroDivisionError):
        with S.scratch_scope(spark):
            gone = S.cut_lineage(spark.range(4)).inputFiles()[0].replace("file://", "")
            raise ZeroDivisionError
    assert not os.path.exists(gone)
