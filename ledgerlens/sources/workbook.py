"""A workbook of sheets as a Spark data source.

A workbook is a folder with one Parquet file set per sheet and a listing, written last,
that names the sheets in their order with their files. As a data source (format
``workbook``) every file of a sheet is a partition of its own, so a sheet that holds
most rows is read by many tasks; of other sheets than those asked for (``sheets=``) no
file is opened; only the columns of the schema are read, in Arrow batches. The choice of
sheets is an argument and not a pushed filter, because Spark 4.1 keeps the partitions of
the first filter for later queries on the same frame (found by a test that
still stands).

Which sheet belongs to which cohort, and whether there is any at all, follows from the
names alone: ``resolve_names`` and ``sheet_names`` read the listing and no rows. Of
sheets whose names normalise alike, the last in the workbook's order counts.

Defined cases: an absent column reads as null; a sheet without rows is a sheet; a
workbook that was not finished has no listing and is an error; a null name is not a
sheet name and is refused when written.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..constants import (ALIASES_INFERRED, ALIASES_KNOWN, ALIASES_OUT_OF_KB, COHORT_INFERRED,
                         COHORT_KNOWN, COHORT_OUT_OF_KB)
from .index import Folder
from .sheets import SHEET_SCHEMA

LISTING = "sheets.json"


def write_workbook(df: DataFrame, root: str, order: list[str]) -> None:
    """Writes the rows of ``df`` (with a column ``sheet``) as a workbook whose sheets
    stand in ``order``; a name in ``order`` without rows is an empty sheet."""
    if df.where(F.col("sheet").isNull() | ~F.col("sheet").isin(order)).limit(1).count():
        raise ValueError("a row names a sheet that the workbook does not list")
    spark, version = df.sparkSession, f"version-{uuid.uuid4().hex}"
    number = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("sheet"))
    (df.withColumn("sheet_no", number).drop("sheet").write.partitionBy("sheet_no")
     .parquet(f"{root.rstrip('/')}/{version}"))
    listing = []
    for i, name in enumerate(order, 1):
        at = f"{version}/sheet_no={i}"
        files = (sorted(f"{at}/{n}" for n in Folder(spark, f"{root.rstrip('/')}/{at}").names()
                        if n.endswith(".parquet"))
                 if Folder(spark, root).exists(at) else [])
        listing.append({"sheet": name, "files": files})
    if not Folder(spark, root).commit(LISTING, json.dumps(listing)):
        raise ValueError(f"there is a workbook at {root} already")


def _listing(spark: SparkSession, root: str) -> list[dict]:
    folder = Folder(spark, root)
    if not folder.exists(LISTING):
        raise ValueError(f"no workbook at {root}: no listing")
    return json.loads(folder.read(LISTING))


def sheet_names(spark: SparkSession, root: str) -> list[str]:
    """The sheets in their order; reads the listing only."""
    return [entry["sheet"] for entry in _listing(spark, root)]


def resolve_names(names: list[str]) -> dict[str, str]:
    """S3: sheet of each cohort. Per cohort the first alias that a sheet's normalised
    name equals counts, and of sheets that normalise alike the last. S4: an error that
    lists the names, if no cohort finds a sheet."""
    def norm(name: str) -> str:
        return re.sub("[^a-z0-9]+", "", name.strip(" ").lower())

    latest = {norm(n): n for n in names}
    found = {}
    for cohort, aliases in ((COHORT_KNOWN, ALIASES_KNOWN), (COHORT_INFERRED, ALIASES_INFERRED),
                            (COHORT_OUT_OF_KB, ALIASES_OUT_OF_KB)):
        hit = next((latest[norm(a)] for a in aliases if norm(a) in latest), None)
        if hit is not None:
            found[cohort] = hit
    if not found:
        raise RuntimeError("no sheet name fits a cohort. Available: " + ", ".join(sorted(names)))
    return found


@dataclass
class SheetFile(InputPartition):
    sheet: str
    path: str


class WorkbookReader(DataSourceReader):
    """``listing``: the sheets to be read, with their files."""

    def __init__(self, root: str, listing: list[dict], schema: T.StructType):
        self.root, self.listing, self.schema = root, listing, schema

    def partitions(self) -> list[SheetFile]:
        return [SheetFile(entry["sheet"], f"{self.root}/{file}") for entry in self.listing
                for file in entry["files"]] or [SheetFile("", "")]

    def read(self, partition: SheetFile) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        schema = to_arrow_schema(self.schema)
        system, path = file_system(partition.path)
        with system.open_input_file(path) as stream:
            file = pq.ParquetFile(stream)
            there = set(file.schema_arrow.names)
            names = [n for n in schema.names if n in there]
            for batch in file.iter_batches(batch_size=10_000, columns=names):
                columns = [
                    pa.array([partition.sheet] * batch.num_rows, pa.string()) if f.name == "sheet"
                    else batch.column(f.name).cast(f.type) if f.name in there
                    else pa.nulls(batch.num_rows, f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


def file_system(path: str):
    """Arrow's file system for a path, and the path in it."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("root", ...).option("listing", ...)``;
    ``read_workbook`` fills in both."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("sheet", T.StringType()), *SHEET_SCHEMA.fields])

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(self.options["root"], json.loads(self.options["listing"]), schema)


def read_workbook(spark: SparkSession, root: str, schema: T.StructType = SHEET_SCHEMA,
                  sheets: list[str] | None = None) -> DataFrame:
    """All sheets, or those named, with a column ``sheet``."""
    spark.dataSource.register(WorkbookSource)
    listing = [entry for entry in _listing(spark, root)
               if sheets is None or entry["sheet"] in sheets]
    full = T.StructType([T.StructField("sheet", T.StringType()), *schema.fields])
    return (spark.read.format("workbook").schema(full).option("root", root.rstrip("/"))
            .option("listing", json.dumps(listing)).load())


def read_cohorts(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the sheets that belong to a cohort, with ``sheet`` and ``cohort``; other
    sheets are not opened."""
    found = resolve_names(sheet_names(spark, root))
    cohort = F.create_map(*[x for c, s in found.items() for x in (F.lit(s), F.lit(c))])
    rows = read_workbook(spark, root, sheets=list(found.values()))
    return rows.withColumn("cohort", cohort[F.col("sheet")])
