"""Report files, one a row: ``<root>/<id>/report.md``.

Tasks write below a folder of their own job, ``<root>/_staging-<job>``, beside a table of what they wrote; when all have ended, the
tasks of a second job move the files into place and add their ids to the table ``<root>-ids``. When a task that writes fails for good
the folder goes, so such a job leaves nothing. A repeated job replaces the files it wrote. Reading goes by the table of ids. So names
and files are only ever met by tasks, and the driver's share doesn't grow with the reports.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "report.md"
FILES = 4096  # files that a task moves or reads, about
BATCH = 4 << 20  # bytes of reports that a batch holds, about

Tasks = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with the scheme of its file system: the default one, where it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return fs.FileSystem.from_uri(uri)


def _ids(root: str) -> str:
    return f"{root.rstrip('/')}-ids"


def _stage(staging: str) -> Tasks:
    """Rows (id, text) to files ``<staging>/<attempt>/<id>``; gives (attempt, id)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _opened(staging)
        attempt, made = uuid.uuid4().hex, False
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, text in zip(names, batch.column(1), strict=True):
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"no folder can be named {name!r}")
                if not made:
                    files.create_dir(f"{base}/{attempt}", recursive=False)
                    made = True
                with files.open_output_stream(f"{base}/{attempt}/{name}") as out:
                    out.write((text.as_py() or "").encode())
            yield pa.RecordBatch.from_pydict({"attempt": [attempt] * len(names), "id": names}, pa.schema([("attempt", pa.string()), ("id", pa.string())]))

    return write


def _place(staging: str, root: str) -> Tasks:
    """Rows (id, attempt): their files from the staging folder to where they stay; gives (id). A task that is run again finds some
    of its files moved."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, staged = _opened(staging)
        _, base = _opened(root)
        there = lambda path: files.get_file_info(path).type != fs.FileType.NotFound
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, attempt in zip(names, batch.column(1).to_pylist(), strict=True):
                source, target = f"{staged}/{attempt}/{name}", f"{base}/{name}/{NAME}"
                if there(source):
                    files.create_dir(f"{base}/{name}", recursive=True)
                    if there(target):
                        files.delete_file(target)
                    files.move(source, target)
                elif not there(target):
                    raise FileNotFoundError(source)
            yield pa.RecordBatch.from_pydict({"id": names}, pa.schema([("id", pa.string())]))

    return move


def _read(root: str) -> Tasks:
    """Rows (id) to (id, content); a report that is gone since, or empty, is no row."""
    schema = pa.schema([("id", pa.string()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _opened(root)
        rows: dict[str, list] = {"id": [], "content": []}
        size = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with files.open_input_stream(f"{base}/{name}/{NAME}") as file:
                        content = file.read()
                except FileNotFoundError:
                    continue
                if content:
                    rows["id"].append(name)
                    rows["content"].append(content)
                    size += len(content)
                if size >= BATCH:
                    yield pa.RecordBatch.from_pydict(rows, schema)
                    rows, size = {"id": [], "content": []}, 0
        yield pa.RecordBatch.from_pydict(rows, schema)

    return read


def _dealt(ids: DataFrame) -> DataFrame:
    """Rows by their id over as many tasks as their number asks for."""
    return ids.repartition(max(1, -(-ids.count() // FILES)), "id")


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """id and content of a folder that has no table of ids: Spark's own reader lists it, in the driver."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", NAME).option("recursiveFileLookup", "true").load(root)
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("id"), "content")


def write(df: DataFrame, root: str) -> None:
    """Rows (id, text) as files; of rows of one id, one stays. What others left in a folder without a table of ids is listed once."""
    spark = df.sparkSession
    root = qualified(spark, root)
    if _exists(spark, root) and not _exists(spark, _ids(root)):
        _listed(spark, root).select("id").write.parquet(_ids(root))
    staging = f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    files, base = _opened(staging)
    files.create_dir(base, recursive=True)
    try:
        df.mapInArrow(_stage(staging), "attempt string, id string").write.parquet(f"{staging}/ids")
        staged = _dealt(spark.read.parquet(f"{staging}/ids")).groupBy("id").agg(F.max("attempt").alias("attempt"))
        staged.mapInArrow(_place(staging, root), "id string").write.mode("append").parquet(_ids(root))
    finally:
        files.delete_dir(base)


def read(spark: SparkSession, root: str) -> DataFrame:
    """id and content (bytes) of every report below ``root`` that is not empty."""
    root = qualified(spark, root)
    if not _exists(spark, _ids(root)):
        return _listed(spark, root)
    ids = spark.read.schema("id string").parquet(_ids(root))
    return _dealt(ids).distinct().mapInArrow(_read(root), "id string, content binary")
