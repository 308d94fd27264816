"""Frame lines of many runs in few files, with an index, as a data source that commits once.

A task writes one file of lines and, beside it, an index with the place of every stretch of a run in it. What
counts is named by a manifest that the driver writes when all tasks have succeeded: it lists files, not
runs, and is a new file each time, so a reader sees all of a write or nothing. A failed or repeated
task attempt leaves files that no manifest names; an aborted write removes those it knows of. Rows are dealt by ranges of
``(run_id, seq)``, so the number of files is that of the tasks, and a run that holds much of all lines is
spread over several of them.

Files are reached through ``pyarrow.fs``: a plain path or ``file:`` must be shared by all machines; for
others the file system's library has to be there.
"""

from __future__ import annotations

import json
import posixpath
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# tasks get the source by value, so that executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "run_frames"
SCHEMA = "run_id string, seq bigint, line string"
_MANIFEST = "_manifest-"
_INDEX = pa.schema(
    [("run_id", pa.string()), ("first_seq", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("n_lines", pa.int64()), ("seqs", pa.list_(pa.int64()))]
)
#: Lines of a stretch; longer stretches of a run are several in the index.
STRETCH = 4_096


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def _names(store: fs.FileSystem, root: str, start: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.startswith(start))


def committed_files(path: str) -> list[str]:
    """Names of the files that the newest manifest lists; none where nothing was committed."""
    store, root = _store(path)
    names = _names(store, root, _MANIFEST)
    if not names:
        return []
    with store.open_input_stream(posixpath.join(root, names[-1])) as f:
        return json.loads(f.read())["files"]


@dataclass
class _Written(WriterCommitMessage):
    """What the driver is told of a task: its file, which may be none."""

    file: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """Lines as they come, a run's in its order; the index row of a stretch when it ends."""
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        at, stretch, rows = 0, None, []

        def index_rows(close: bool) -> pa.RecordBatch | None:
            nonlocal rows
            if close or len(rows) >= 256:
                batch = pa.RecordBatch.from_pylist(rows, schema=_INDEX)
                rows = []
                return batch
            return None

        lines = index = None
        try:
            for batch in iterator:
                if lines is None and batch.num_rows:
                    lines = store.open_output_stream(posixpath.join(root, name))
                    index = pq.ParquetWriter(store.open_output_stream(posixpath.join(root, name + ".index")), _INDEX)
                for run, seq, line in zip(*(batch[c].to_pylist() for c in ("run_id", "seq", "line")), strict=True):
                    data = (line or "").replace("\n", " ").encode() + b"\n"
                    if stretch is None or stretch["run_id"] != run or stretch["n_lines"] >= STRETCH:
                        if stretch is not None:
                            rows.append(stretch)
                            if (full := index_rows(False)) is not None:
                                index.write_batch(full)
                        stretch = {"run_id": run, "first_seq": seq, "start": at, "length": 0, "n_lines": 0, "seqs": []}
                    lines.write(data)
                    at += len(data)
                    stretch["length"] += len(data)
                    stretch["n_lines"] += 1
                    stretch["seqs"].append(seq)
            if lines is not None:
                rows.append(stretch)
                index.write_batch(index_rows(True))
        finally:
            for sink in (index, lines):
                if sink is not None:
                    sink.close()
        return _Written(name if lines is not None else None)

    def commit(self, messages: list[_Written | None]) -> None:
        """Names the files of this write, beside those before it unless it overwrites."""
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        before = committed_files(self.path)
        files = sorted(m.file for m in messages if m is not None and m.file)
        number = len(_names(store, root, _MANIFEST))
        manifest = posixpath.join(root, f"{_MANIFEST}{number:08d}")
        with store.open_output_stream(manifest + ".tmp") as f:
            f.write(json.dumps({"files": files if self.overwrite else before + files}).encode())
        store.move(manifest + ".tmp", manifest)

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            for end in ("", ".index") if m is not None and m.file else ():
                store.delete_file(posixpath.join(root, m.file + end))


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, run_id: str | None):
        self.path, self.run_id = path, run_id

    def partitions(self) -> list[_File]:
        return [_File(name) for name in committed_files(self.path)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = _store(self.path)
        wanted = [("run_id", "=", self.run_id)] if self.run_id is not None else None
        with store.open_input_file(posixpath.join(root, partition.name)) as lines:
            # the index's own statistics leave out stretches of other runs
            found = pq.read_table(posixpath.join(root, partition.name + ".index"), filesystem=store, filters=wanted)
            for stretch in found.to_pylist():
                texts = lines.read_at(stretch["length"], stretch["start"]).decode().split("\n")[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([stretch["run_id"]] * len(texts), pa.string()), pa.array(stretch["seqs"], pa.int64()), pa.array(texts, pa.string())],
                    ["run_id", "seq", "line"],
                )


class FramesSource(DataSource):
    """``spark.read.format("run_frames").load(path)``, with the option ``run_id`` for the lines of one run."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self.options.get("run_id"))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def write_frame_files(frames: DataFrame, path: str, files: int | None = None, mode: str = "append") -> None:
    """Write ``(run_id, seq, line)`` rows in the order of each run; ``files`` bounds the number of files.

    ``run_id`` is written as text. A line break inside a line becomes a blank, as a frame is one line.
    """
    frames.sparkSession.dataSource.register(FramesSource)
    rows = frames.selectExpr("CAST(run_id AS STRING) AS run_id", "CAST(seq AS BIGINT) AS seq", "line")
    by = ("run_id", "seq")
    dealt = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.format(NAME).mode(mode).save(path)


def read_frame_files(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """All committed lines ``(run_id, seq, line)``, or those of one run, of which only its stretches are read."""
    spark.dataSource.register(FramesSource)
    reader = spark.read.format(NAME)
    return (reader.option("run_id", str(run_id)) if run_id is not None else reader).load(path)
