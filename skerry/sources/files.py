"""Files beside Spark's own formats, the folder that driver and executors share, and tables kept in it.

`write_files` is a data source writer with a commit: a task writes under a folder of its own attempt and moves each file to
its place when it has them all, the driver then lists the parts and leaves the marker `_COMMITTED`. So no half file is ever
seen under its name, an attempt that is lost or runs twice changes nothing, and a job that fails takes back what its tasks
had moved and leaves no marker.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

COMMITTED, PARTS, STAGING = "_COMMITTED", "_parts", "_staging"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the store it is in: a plain one is in the session's default store."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Only a local session may leave it unset (as in tests)."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if own is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return qualified(spark, own or "file://" + tempfile.mkdtemp(prefix="skerry-checkpoint-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, which goes when the session's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return path


def once(rows: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint(eager=True)


def kept(rows: DataFrame, name: str = "rows") -> DataFrame:
    """The rows, computed once and kept in the shared folder by column, so who reads them reads the columns that it needs."""
    path = f"{scratch(rows.sparkSession, name)}/table"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def store_of(path: str):
    """The store that a path is in, as Python sees it, and the path there. s3a is s3; a plain path is a local one."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if path.startswith("/") or scheme == "file":
        return fs.LocalFileSystem(), path if path.startswith("/") else "/" + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else path)
    except (ValueError, OSError) as wrong:
        raise ValueError(f"files cannot be written to {path}: {wrong}; local, s3, gs, abfs and hdfs stores can") from wrong


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: the file that lists it, how many files and how many bytes."""

    part: str
    files: int
    bytes: int


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        store_of(path)  # a store that cannot be written to is an error before any work
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, root = store_of(self.path)
        attempt = uuid.uuid4().hex
        staging, names, size = f"{root}/{STAGING}-{self.job}/{attempt}", [], 0
        for name, content in iterator:
            if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
                raise ValueError(f"{name!r} is no name for a file")
            _put(store, f"{staging}/{name}", bytes(content or b""))
            names.append(name)
            size += len(content or b"")
        part = f"{PARTS}/{self.job}-{attempt}.json"
        if names:  # what is about to be moved is listed first, so it can be taken back whatever becomes of this attempt
            _put(store, f"{root}/{part}", "".join(json.dumps({"name": n}) + "\n" for n in names).encode())
        for name in names:
            store.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
            store.move(f"{staging}/{name}", f"{root}/{name}")
        return Written(part, len(names), size)

    def _listed(self, store, root: str) -> list[str]:
        """The lists of all attempts of this job."""
        from pyarrow import fs

        found = store.get_file_info(fs.FileSelector(f"{root}/{PARTS}", allow_not_found=True))
        return [x.path for x in found if x.base_name.startswith(self.job)]

    def _clear(self) -> None:
        store, root = store_of(self.path)
        try:
            store.delete_dir(f"{root}/{STAGING}-{self.job}")
        except FileNotFoundError:
            pass

    def commit(self, messages: list) -> None:
        """List the parts, drop the lists of attempts that do not count; the marker comes last."""
        self._clear()
        done = [m for m in messages if m is not None]
        listed = {
            "files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done), "parts": sorted(m.part for m in done if m.files),
            "job": self.job
        }
        store, root = store_of(self.path)
        for path in self._listed(store, root):
            if f"{PARTS}/{path.rpartition('/')[2]}" not in listed["parts"]:
                store.delete_file(path)
        _put(store, f"{root}/{COMMITTED}", json.dumps(listed).encode())

    def abort(self, messages: list) -> None:
        """Drop what lies in staging, so nothing more is moved, and take back what any attempt has moved."""
        self._clear()
        store, root = store_of(self.path)
        for path in self._listed(store, root):
            with store.open_input_stream(path) as part:
                names = [json.loads(x)["name"] for x in part.read().splitlines()]
            for gone in (*(f"{root}/{n}" for n in names), path):
                try:
                    store.delete_file(gone)
                except FileNotFoundError:  # not moved yet
                    pass


def _put(store, path: str, content: bytes) -> None:
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(content)


class Files(DataSource):
    """`rows.write.format("small_files")`: a file a row (name, content) below the option path."""

    @classmethod
    def name(cls) -> str:
        return "small_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"])


def write_files(rows: DataFrame, path: str) -> int:
    """Write a file a row (name, content: binary) below path and give their number. name may have folders but none that
    begin with an underscore at the top; equal names are an error of the caller's."""
    spark = rows.sparkSession
    spark.dataSource.register(Files)
    own = qualified(spark, path)
    rows.select("name", F.col("content").cast("binary")).write.format("small_files").mode("append").option("path", own).save()
    return committed(spark, path)["files"]


def committed(spark: SparkSession, path: str) -> dict:
    """What the last commit below a path wrote: files, bytes, and the lists of their names (a list a task)."""
    if not exists(spark, f"{path}/{COMMITTED}"):
        raise ValueError(f"{path} has no commit")
    store, root = store_of(qualified(spark, path))
    with store.open_input_stream(f"{root}/{COMMITTED}") as marker:  # Spark's readers pass over names with an underscore
        return json.loads(marker.read())


def write_text(spark: SparkSession, path: str, name: str, text: str) -> None:
    """One small file, by the driver."""
    store, root = store_of(qualified(spark, path))
    _put(store, f"{root}/{name}", text.encode())


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
