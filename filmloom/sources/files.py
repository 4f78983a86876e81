"""Files as data sources: one file a name written from ordered rows, and files of frames of one size read by byte ranges."""

from __future__ import annotations

import contextlib
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes read or written at once.
STEP = 4 << 20
#: Tasks that short ranges are dealt to, about, and bytes that make a task of their own however many tasks there are.
TASKS, TASK_BYTES = 1024, 64 << 20


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a plain path of this machine, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class NamedFiles(DataSource):
    """Sink of rows (name, body): bodies of a name, in the order of rows, are one file. Use ``write_files``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite):
        return _NamedWriter(self.options["path"], overwrite)


class _NamedWriter(DataSourceArrowWriter):
    """Tasks write under a staging folder; files move to their place once all tasks are done, and none does if one fails."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.stage = path, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _opened(self.path)
        folder = posixpath.join(root, self.stage, uuid.uuid4().hex)  # an attempt's own
        files.create_dir(folder, recursive=True)
        names, stream, now = {}, None, None  # in order, and found without a walk
        try:
            for b in iterator:
                for name, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if name != now:
                        if name in names or not name:
                            raise ValueError(f"rows of a file must have a name and be in one run: {name!r}")
                        if stream is not None:
                            stream.close()
                        names[name] = None
                        stream, now = files.open_output_stream(posixpath.join(folder, quote(name, safe="-_. "))), name
                    if body.is_valid:
                        stream.write(body.as_buffer())
        finally:
            if stream is not None:
                stream.close()
        return _Staged(folder, list(names))

    def commit(self, messages) -> None:
        files, root = _opened(self.path)
        staged = [(m.folder, n) for m in messages if m is not None for n in m.names]
        twice = len(staged) - len({n for _, n in staged})
        there = [] if self.overwrite else [n for _, n in staged if files.get_file_info(posixpath.join(root, quote(n, safe="-_. "))).type != fs.FileType.NotFound]
        if twice or there:
            self.abort(messages)
            raise ValueError(f"files would be written twice: {twice or there[:5]}")
        for folder, n in staged:
            own = quote(n, safe="-_. ")
            files.move(posixpath.join(folder, own), posixpath.join(root, own))
        self._cleared(files, root)

    def abort(self, messages) -> None:
        self._cleared(*_opened(self.path))

    def _cleared(self, files: fs.FileSystem, root: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            files.delete_dir(posixpath.join(root, self.stage))


def write_files(rows: DataFrame, path: str, name: Column, order: list[Column], body: Column, overwrite: bool = False) -> None:
    """Write a file for each ``name``: the bodies of its rows by ``order``, streamed from sorted partitions, null as nothing.

    A file's rows are never held together, so a file may be of any size. All files appear once all are written; if a task
    fails for good, none does. Without ``overwrite`` a file that is there is an error.
    """
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    own = rows.select(name.cast("string").alias("name"), body.cast("binary").alias("body"), *[o.alias(f"o{k}") for k, o in enumerate(order)])
    own = own.repartition("name").sortWithinPartitions("name", *[f"o{k}" for k in range(len(order))]).select("name", "body")
    own.write.format("named_files").option("path", path).mode("overwrite" if overwrite else "append").save()


@dataclass
class _Range:
    path: str
    first: int
    frames: int
    rest: int


@dataclass
class _Ranges(InputPartition):
    ranges: list[_Range]


class FrameFiles(DataSource):
    """Files of frames of ``frame_bytes`` each, in ranges of about ``partition_bytes``. Use ``raw_frames``."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "file string, frame_no bigint, frame binary, status string"

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options["path"], int(self.options["frame_bytes"]), int(self.options.get("partition_bytes", 64 << 20)))


class _FrameReader(DataSourceReader):
    def __init__(self, path: str, frame_bytes: int, partition_bytes: int):
        if frame_bytes <= 0:
            raise ValueError("a frame must have bytes")
        self.path, self.size, self.most = path, frame_bytes, max(1, partition_bytes // frame_bytes)

    def partitions(self) -> list[_Ranges]:
        """A range a partition; where there would be far more than ``TASKS``, neighbouring ranges share one."""
        files, root = _opened(self.path)
        info = files.get_file_info(root)
        there = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        sizes = sorted((f.path, *divmod(f.size, self.size)) for f in there if f.type == fs.FileType.File and not posixpath.basename(f.path).startswith(("_", ".")))
        most = max(1, sum(-(-whole // self.most) + (rest > 0) for _, whole, rest in sizes) // TASKS)
        enough = max(self.most * self.size, min(TASK_BYTES, sum(whole * self.size + rest for _, whole, rest in sizes) // TASKS))
        out, n, held = [], most, 0
        for path, whole, rest in sizes:
            parts = [(k, min(self.most, whole - k), 0) for k in range(0, whole, self.most)] + [(whole, 0, rest)] * (rest > 0)
            for first, frames, rest in parts:
                if n == most or held + frames * self.size + rest > enough:
                    out.append(_Ranges([]))
                    n = held = 0
                n, held = n + 1, held + frames * self.size + rest
                own = out[-1].ranges
                if own and frames and own[-1].path == path:
                    own[-1].frames += frames
                else:
                    own.append(_Range(path, first, frames, rest))
        return out or [_Ranges([])]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("frame_no", pa.int64()), ("frame", pa.binary()), ("status", pa.string())])
        files, _ = _opened(self.path)
        for r in partition.ranges:
            file = posixpath.basename(r.path)
            if r.rest:
                yield pa.RecordBatch.from_pydict({"file": [file], "frame_no": [r.first], "frame": [None], "status": ["partial"]}, kinds)
                continue
            with files.open_input_file(r.path) as f:
                f.seek(r.first * self.size)
                done, at_once = 0, max(1, STEP // self.size)
                while done < r.frames:
                    n = min(at_once, r.frames - done)
                    data = f.read(n * self.size)
                    if len(data) < n * self.size:
                        raise OSError(f"{r.path} is shorter than it was")
                    frames = [data[k * self.size : (k + 1) * self.size] for k in range(n)]
                    yield pa.RecordBatch.from_pydict({"file": [file] * n, "frame_no": list(range(r.first + done, r.first + done + n)), "frame": frames, "status": ["ok"] * n}, kinds)
                    done += n


def raw_frames(spark: SparkSession, path: str, width: int, height: int, partition_bytes: int = 64 << 20) -> DataFrame:
    """(file, frame_no, frame, status) of files of frames of three bytes a pixel and nothing between them.

    Long files are read by several tasks, each from its own offset; a task reads several short ranges or files where there
    are many. Bytes that do not fill a frame are one row with status ``partial`` and no frame; an empty file has no rows.
    """
    spark.dataSource.register(FrameFiles)
    return spark.read.format("frame_files").option("path", path).option("frame_bytes", width * height * 3).option("partition_bytes", partition_bytes).load()


def wav_rows(samples: DataFrame, key: str, header: Column) -> DataFrame:
    """``samples`` (key, order, body) with the header's row before those of each key; ``header`` is over ``n``, the key's bytes."""
    sizes = samples.groupBy(key).agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n"))
    return sizes.select(key, F.lit(-1).cast("bigint").alias("order"), header.alias("body")).unionByName(samples.select(key, F.col("order").cast("bigint").alias("order"), "body"))
