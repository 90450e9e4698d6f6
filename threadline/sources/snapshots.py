"""Readers of page snapshots and run events, and writers of exports."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import export_name
from ..functions.urls import page_family

SNAPSHOTS = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("snapshot_seq", T.LongType()), T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("captured_at", T.TimestampType()),
])
RUN_EVENTS = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("action", T.StringType()), T.StructField("limit", T.IntegerType()),
])
DEFAULT_LIMIT = 500
FORMATS = ("txt", "json")
_PACKAGES = "part long, package string"


def read_snapshots(spark: SparkSession, path: str, family: str | None = None) -> DataFrame:
    """Snapshots of Parquet files; family routes before any page is cut up."""
    rows = spark.read.schema(SNAPSHOTS).parquet(path)
    return rows.filter(page_family(F.col("url")) == family) if family else rows


def stream_snapshots(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(SNAPSHOTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_run_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RUN_EVENTS).parquet(path)


def pages_as_snapshots(pages: DataFrame, run_id: str = "pages") -> DataFrame:
    """A crawl table (page_id, url, html) as one snapshot for each page."""
    return pages.select(F.lit(run_id).alias("run_id"), F.lit(0).cast("long").alias("snapshot_seq"), "page_id", "url", "html", F.lit(None).cast("timestamp").alias("captured_at"))


def valid_request(limit: int = DEFAULT_LIMIT, form: str = "txt") -> tuple[int, str]:
    if limit <= 0 or form not in FORMATS:
        raise ValueError(f"limit must be over 0 and the format one of {FORMATS}: {limit}, {form}")
    return limit, form


def write_exports(exports: DataFrame, path: str) -> None:
    """Exports (name, body) as text files, a folder for each name; runs in parallel by name."""
    exports.select("name", F.col("body").alias("value")).write.partitionBy("name").option("lineSep", "\n").text(path)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path that a URI, or a local path, names."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class _Package:
    """A ZIP file that is written document by document, a member of it each."""

    def __init__(self, uri: str):
        system, path = _opened(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        self.member, self.name, self.size, self.names = None, None, 0, 0

    def add(self, name: str, value: bytes) -> None:
        """A line of the document ``name``; lines of one document follow each other."""
        if name != self.name:
            self._end_member()
            self.name, self.names = name, self.names + 1
            self.member = self.zip.open(name, "w", force_zip64=True)
        self.member.write(value + b"\n")
        self.size += len(value) + 1

    def _end_member(self) -> None:
        if self.member:
            self.member.close()

    def close(self) -> None:
        self._end_member()
        self.zip.close()
        self.out.close()


def write_export_lines(lines: DataFrame, titles: DataFrame, form: str, path: str, most: int = 16 << 20, most_names: int = 20_000) -> None:
    """Exports of any size: lines(run_id, arrival_seq, value) of export_lines(), as documents in ZIP packages, so that the
    number of files follows the size of the exports and not the number of their names. Rows are range-partitioned and sorted by
    name and arrival, so a large run is written by many tasks and lies in several packages (of about ``most`` bytes of text or
    ``most_names`` names each); its members in order of their packages, end to end, are its document. Runs that share a name
    follow each other. Below path lie the packages and, as a Parquet table, the list of those that tasks committed."""
    named = lines.join(titles, "run_id", "left").select(export_name(F.col("title"), form).alias("name"), "run_id", "arrival_seq", "value")
    order = ("name", "run_id", "arrival_seq")
    folder = f"{path.rstrip('/')}/packages"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, package, done = TaskContext.get().partitionId(), 0, None, []
        uri = ""
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if package and (package.size >= most or package.names >= most_names and package.name != name):
                    package.close()
                    done.append(((task << 32) + part, uri))
                    package, part = None, part + 1
                if not package:
                    uri = f"{folder}/exports-{task:05}-{part:05}-{uuid.uuid4().hex}.zip"
                    package = _Package(uri)
                package.add(name, value or b"")
        if package:
            package.close()
            done.append(((task << 32) + part, uri))
        yield pa.RecordBatch.from_pylist([{"part": p, "package": u} for p, u in done], pa.schema([("part", pa.int64()), ("package", pa.string())]))

    sorted_lines = named.repartitionByRange(*order).sortWithinPartitions(*order).select("name", "value")
    sorted_lines.mapInArrow(run, _PACKAGES).write.parquet(f"{path.rstrip('/')}/committed")


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(name, part, value) of exports in packages: the whole text of each member; part gives the order of a name's members.
    Packages are read by tasks, one after the other."""
    schema = pa.schema([("name", pa.string()), ("part", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, at = _opened(row["package"])
                with system.open_input_file(at) as file, zipfile.ZipFile(file) as package:
                    rows, size = [], 0
                    for member in package.infolist():
                        rows.append({"name": member.filename, "part": row["part"], "value": package.read(member).decode()})
                        size += member.file_size
                        if size >= 4 << 20 or len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    packages = spark.read.schema(_PACKAGES).parquet(f"{path.rstrip('/')}/committed")
    return packages.repartition(spark.sparkContext.defaultParallelism, "package").mapInArrow(run, "name string, part long, value string")


def write_comments(comments: DataFrame, path: str) -> None:
    """The comments of many runs as JSON lines, a folder for each run."""
    comments.write.partitionBy("run_id").option("ignoreNullFields", "false").json(path)


def empty_exports(requested: DataFrame, comments: DataFrame) -> DataFrame:
    """(run_id, error) of requested runs without a row to export."""
    return requested.select("run_id").distinct().join(comments.select("run_id").distinct(), "run_id", "left_anti").select("run_id", F.lit("No data to download.").alias("error"))
