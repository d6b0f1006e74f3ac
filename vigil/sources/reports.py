"""Report sources: landed page files, a paged Python data source, resume.

S1 re-aimed: pages fetched from the report service are landed as files
(``{"results": [...]}`` per page); Spark reads them with the declared
schema.  The Python ``DataSource`` below plans one partition per page, so
page reads run in parallel on executors instead of one serial client loop;
``paged`` reads a service page by page, also as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import RAW_PAGE, RAW_REPORT
from .paged import DEFAULT_PAGE_SIZE, PageStore, report_row


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page files -> one row per raw report (PERMISSIVE,
    declared schema; ``_page`` and ``_pos`` keep the delivery order).  A page
    that holds no report array makes the read fail, not its reports vanish."""
    pages = (spark.read.schema(RAW_PAGE).option("multiLine", True).option("mode", "PERMISSIVE")
             .json(path).withColumn("_page", F.input_file_name()))
    broken = F.raise_error(F.concat(F.lit("no report array in page "), F.col("_page"))).cast(pages.schema["results"].dataType)
    pages = pages.withColumn("results", F.when(F.col("results").isNull(), broken).otherwise(F.col("results")))
    return pages.select("_page", F.posexplode("results").alias("_pos", "r")).select("_page", "_pos", "r.*")


def read_report_array(spark: SparkSession, path: str) -> DataFrame:
    """A file holding one JSON array of raw reports."""
    return (spark.read.schema(RAW_REPORT).option("multiLine", True).option("mode", "PERMISSIVE").json(path))


def new_reports(landed: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """S2 + W3: rows not yet in the existing table, one per id."""
    return landed.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def first_n(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """S3: target row count (ordered, so the same n rows every run)."""
    return df.orderBy(key).limit(n)


# ---- Python data source over a known number of pages: one partition per page ----
class _PagePartition(InputPartition):
    def __init__(self, skip: int):
        super().__init__(skip)
        self.skip = skip


class ReportPagesReader(DataSourceReader):
    """Every page must be there: a missing or failed one raises, so that no report is lost silently
    (``paged`` has the reader for a service whose end isn't known and whose pages may fail)."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        limit = int(self.options.get("limit", str(DEFAULT_PAGE_SIZE)))
        return [_PagePartition(s) for s in range(0, int(self.options["total"]), limit)]

    def read(self, partition) -> Iterator[tuple]:
        store = PageStore(self.options["dir"])
        try:
            rows = store.load(partition.skip, "")
        except (FileNotFoundError, ValueError) as e:
            raise ValueError(f"page-{partition.skip:09d}: {e}") from e
        return (report_row(r) for r in rows)


class ReportPagesSource(DataSource):
    """``spark.read.format("report_pages").option("dir", d).option("total", n)``"""

    @classmethod
    def name(cls):
        return "report_pages"

    def schema(self):
        return RAW_REPORT

    def reader(self, schema):
        return ReportPagesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReportPagesSource)
