"""Paged report service as a Python data source, batch and streaming.

``spark.read.format("paged_reports")`` and ``spark.readStream.format("paged_reports")`` read ``limit`` reports a page, some
pages a task.  A page either holds reports, or is past the end of the data (no such page), or has failed: then it gives one
row with ``page_error`` and no report, and the pages after it are still read.  Offsets of the stream are page starts,
kept in the query's checkpoint, so a restarted query reads what it had not finished and what has been added.

Filters that reports have reactions or drugs (``patient.reaction is not null``) are sent to the service with each
request, as the ``search`` it knows, where Spark pushes them (``spark.sql.python.filterPushdown.enabled``).

The service behind it is a ``PageStore``: landed pages in any file system that Arrow can open (local, HDFS, S3, ...).
Another service takes the same two methods.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, InputPartition, IsNotNull
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..schemas import RAW_REPORT

# ---- fixed values --------------------------------------------------------------
#: Predicate sent with every page request: reports with reactions and drugs.
REQUIRED_FIELDS_SEARCH = "_exists_:patient.reaction AND _exists_:patient.drug"
MAX_FAILED_PAGES = 5  # a fetch stops after so many failed pages in a row
DEFAULT_PAGE_SIZE = 100
# --------------------------------------------------------------------------------
SEARCHABLE = {("patient", "reaction"), ("patient", "drug")}
PAGED_REPORT = StructType([StructField("page_skip", LongType()), StructField("page_error", StringType()), *RAW_REPORT.fields])


def _text(v) -> str | None:
    return None if v is None else str(v)


def report_row(r: dict) -> tuple:
    """A raw report as a row of ``RAW_REPORT``."""
    p = r.get("patient") or {}

    def entries(name: str) -> list[tuple] | None:
        fields = RAW_REPORT["patient"].dataType[name].dataType.elementType.names
        return None if p.get(name) is None else [tuple(_text(x.get(f)) for f in fields) for x in p[name]]

    return (*(_text(r.get(f.name)) for f in RAW_REPORT.fields[:-1]),
            (_text(p.get("patientonsetage")), _text(p.get("patientsex")), entries("reaction"), entries("drug")))


def page_batch(skip: int, reports: list[dict | None], error: str | None = None) -> pa.RecordBatch:
    """Reports of a page as rows of ``PAGED_REPORT``; None is a row without a report."""
    schema = to_arrow_schema(PAGED_REPORT)
    kind = pa.struct(list(schema)[2:])
    try:
        rows = pa.array([r if r is None else {**r, "patient": r.get("patient") or {}} for r in reports], kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError):  # values that aren't text
        rows = pa.array([r if r is None else _named(report_row(r), RAW_REPORT) for r in reports], kind)
    n = len(reports)
    return pa.RecordBatch.from_arrays([pa.array([skip] * n, pa.int64()), pa.array([error] * n, pa.string()), *rows.flatten()], schema=schema)


def _named(v, kind):
    """Rows as dictionaries, which Arrow takes for structs."""
    if isinstance(kind, StructType):
        return None if v is None else {f.name: _named(x, f.dataType) for f, x in zip(kind.fields, v)}
    return [_named(x, kind.elementType) for x in v] if isinstance(kind, ArrayType) and v is not None else v


class PageStore:
    """Pages landed as ``page-<skip>.json``, or by Spark as a folder ``page=<skip>`` with one file."""

    def __init__(self, uri: str):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:"):]
        self.files, self.root = fs.FileSystem.from_uri(uri)

    def _path(self, skip: int) -> str | None:
        single, folder = self.files.get_file_info([f"{self.root}/page-{skip:09d}.json", f"{self.root}/page={skip}"])
        if single.type == fs.FileType.File:
            return single.path
        if folder.type != fs.FileType.Directory:
            return None
        found = [x.path for x in self.files.get_file_info(fs.FileSelector(folder.path)) if x.base_name.startswith("part-")]
        return found[0] if found else None

    def has(self, skip: int) -> bool:
        return self._path(skip) is not None

    def load(self, skip: int, search: str) -> list[dict]:
        """Reports of a page that match; a page that has failed raises."""
        path = self._path(skip)
        if path is None:
            raise FileNotFoundError(f"no page at {skip}")
        with self.files.open_input_stream(path) as f:
            page = json.loads(f.read())
        rows = page.get("results") if isinstance(page, dict) else None
        if rows is None:
            raise ValueError(f"no report array in page {skip}")
        wanted = [part.removeprefix("_exists_:").split(".") for part in search.split(" AND ") if part]
        return [r for r in rows if all(self._exists(r, path) for path in wanted)]

    @staticmethod
    def _exists(r, path: list[str]) -> bool:
        for name in path:
            r = (r or {}).get(name)
        return bool(r)

    def end(self, limit: int) -> int:
        """The first page start past the data: doubling, then halving, so a few probes at any size."""
        if not self.has(0):
            return 0
        low, step = 0, 1
        while self.has((low + step) * limit):
            low, step = low + step, step * 2
        high = low + step  # page ``low`` is there, ``high`` isn't
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.has(mid * limit) else (low, mid)
        return high * limit


class Pages(InputPartition):
    def __init__(self, skips: Sequence[int]):
        super().__init__(skips[0])
        self.skips = list(skips)


class _Paged:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict):
        self.uri = options["path"]
        self.limit = int(options.get("limit", DEFAULT_PAGE_SIZE))
        self.pages = int(options.get("pagespertask", options.get("pagesPerTask", "10")))
        self.search = options.get("search", "")
        self.upto = int(options.get("upto", "0"))  # a stream reads no further for now; 0: all that is there

    def planned(self, start: int, end: int) -> list[Pages]:
        skips = range(start, end, self.limit)
        return [Pages(skips[i:i + self.pages]) for i in range(0, len(skips), self.pages)]

    def rows(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        """An Arrow batch a page."""
        store = PageStore(self.uri)
        for skip in partition.skips:
            try:
                found = store.load(skip, self.search)
            except Exception as e:  # noqa: BLE001 - a failed page is a row, not the end of the fetch
                yield page_batch(skip, [None], f"{type(e).__name__}: {e}")
                continue
            if found:
                yield page_batch(skip, found)


class PagedReader(_Paged, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        told = []
        for f in filters:
            if isinstance(f, IsNotNull) and tuple(f.attribute) in SEARCHABLE:
                told.append("_exists_:" + ".".join(f.attribute))
            yield f  # an empty array exists for Spark, not for the service; failed pages' rows have neither
        self.search = " AND ".join(dict.fromkeys([*filter(None, self.search.split(" AND ")), *told]))

    def partitions(self) -> list[Pages]:
        return self.planned(0, PageStore(self.uri).end(self.limit))

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class PagedStreamReader(_Paged, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"skip": 0}

    def latestOffset(self) -> dict:
        end = PageStore(self.uri).end(self.limit)
        return {"skip": min(end, self.upto) if self.upto else end}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.planned(start["skip"], end["skip"])

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """The service keeps its pages: there is nothing to release; the query's checkpoint has the offset."""


class PagedReports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_reports"

    def schema(self) -> StructType:
        return PAGED_REPORT

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedReports)


class FetchStopped(RuntimeError):
    """Too many failed pages in a row."""


def stop_page(errors: DataFrame, limit: int, in_a_row: int = MAX_FAILED_PAGES) -> int | None:
    """Start of the first page that ends a run of ``in_a_row`` failed pages; ``errors`` has ``page_skip``.

    Every failed page votes for the page that it may end a run at: no order over all pages is needed."""
    failed = errors.select("page_skip", F.explode(F.sequence(F.lit(0), F.lit(in_a_row - 1))).alias("k")).distinct()
    votes = failed.select((F.col("page_skip") + F.col("k") * limit).alias("at"))
    ends = votes.groupBy("at").count().where(F.col("count") == in_a_row)
    return ends.agg(F.min("at")).first()[0]


def land_pages(reports: DataFrame, page: str, path: str, mode: str = "errorifexists") -> None:
    """Raw reports as page folders of one compressed file each, a row that the grouping has made; ``page`` is the column of the page's start."""
    body = F.to_json(F.struct(F.collect_list(F.struct(*RAW_REPORT.names)).alias("results")))
    reports.groupBy(F.col(page).alias("page")).agg(body.alias("value")).write.mode(mode).partitionBy("page").text(path, compression="gzip")
