"""Text files as a sink and a source: a file for each row, under the row's name."""

from __future__ import annotations

import fnmatch
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of files that one read task takes; a larger file is a task.
PART_BYTES = 16 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))


@dataclass
class _Task(WriterCommitMessage):
    folder: str | None


class _Writer(DataSourceArrowWriter):
    """Tasks write to folders of their own below a staging folder; the commit moves the files of the tasks that count and deletes the
    rest, so that a failed or repeated task leaves nothing. Names that are taken fail the write before any file is moved. The staging
    folder is made once, in the driver, so that a task that outlives a failed write can't bring it back."""

    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f"_staging-{uuid.uuid4().hex}"
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Task:
        fs, root = _open(self.path)
        folder = None
        for batch in iterator:
            for name, text in zip(batch["name"], batch["text"], strict=True):
                name = name.as_py()
                if not name or name in (".", "..") or "/" in name:
                    raise ValueError(f"{name!r} is no file name")
                if folder is None:
                    folder = f"{self.staging}/{uuid.uuid4().hex}"
                    fs.create_dir(f"{root}/{folder}", recursive=False)
                with fs.open_output_stream(f"{root}/{folder}/{name}", compression=None) as out:
                    out.write(text.as_buffer() if text.is_valid else b"")
        return _Task(folder)

    def commit(self, messages: list[_Task | None]) -> None:
        fs, root = _open(self.path)
        folders = [f"{root}/{m.folder}" for m in messages if m and m.folder]
        try:
            taken = {f.base_name for f in _files(fs, root)}
            for folder in folders:
                for f in _files(fs, folder):
                    if f.base_name in taken:
                        raise FileExistsError(f"{f.base_name} is taken in {self.path}")
                    taken.add(f.base_name)
            for folder in folders:
                for f in _files(fs, folder):
                    fs.move(f.path, f"{root}/{f.base_name}")
        finally:
            self.abort(messages)

    def abort(self, messages: list[_Task | None]) -> None:
        fs, root = _open(self.path)
        for left in reversed(range(50)):
            try:
                if fs.get_file_info(f"{root}/{self.staging}").type != pafs.FileType.NotFound:
                    fs.delete_dir(f"{root}/{self.staging}")
                return
            except OSError:  # a task that Spark is about to kill still writes there
                if not left:
                    raise
                time.sleep(0.1)


@dataclass
class _Part(InputPartition):
    names: list


class _Reader(DataSourceReader):
    """Files right below the path, empty ones too, which Spark's own file sources pass over."""

    def __init__(self, options):
        self.path, self.pattern = options["path"].rstrip("/"), options.get("pattern", "*")

    def partitions(self) -> list[_Part]:
        fs, root = _open(self.path)
        parts, size = [_Part([])], 0
        for f in sorted(_files(fs, root), key=lambda f: f.base_name):
            if f.is_file and fnmatch.fnmatchcase(f.base_name, self.pattern):
                if size and size + f.size > PART_BYTES:
                    parts.append(_Part([]))
                    size = 0
                parts[-1].names.append(f.base_name)
                size += f.size + 1024
        return parts

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.path)
        for name in part.names:
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                text = f.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([text], pa.string())], ["name", "text"])


class NamedFiles(DataSource):
    """The format `named_files`: rows (name, text) become files below the path, and files become rows; null text is an empty file."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, text string"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("named files are only added: use mode('append')")
        return _Writer(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Write files (name, text) below path. A name that repeats, or that path has already, fails the write and leaves path as it was."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select(F.col("name").cast("string").alias("name"), F.col("text").cast("string").alias("text")).write.format("named_files").mode("append").save(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, text of the files right below path whose names match the pattern. Empty files have an empty text; bytes that are no
    UTF-8 become replacement characters."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").option("pattern", pattern).load(path)
