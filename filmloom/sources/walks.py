"""Records of binary rows that can only be found one behind the other, as each tells its own size."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Walk = Callable[[bytes], Iterator[tuple]]


def tags(data: bytes) -> Iterator[tuple]:
    """(tag, offset, size, ok) of tagged chunks; the size includes the eight bytes before the body. A chunk of a wrong size is the last."""
    at = 0
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        ok = 8 <= size <= len(data) - at
        yield data[at : at + 4].decode("latin-1"), at, size, ok
        if not ok:
            return
        at += size


def sized_blocks(data: bytes) -> Iterator[tuple]:
    """(offset, body) of blocks with their size before and behind; a size of 0, or a wrong one, ends the walk."""
    at = 0
    while at + 4 <= len(data):
        size = struct.unpack_from("<I", data, at)[0]
        if not 8 <= size <= len(data) - at:
            return
        yield at + 4, data[at + 4 : at + size - 4]
        at += size


#: Bytes that a wrapper's size counts besides the frame; the frame is 16 bytes behind the wrapper's beginning.
WRAPPERS = {"moviefs": 12, "videofs": 28}


def wrapped(kind: str) -> Walk:
    """(offset, body) of the frames of a payload in wrappers of ``kind``, zero words between them; the first bad wrapper ends the walk."""
    extra = WRAPPERS[kind]

    def walk(data: bytes) -> Iterator[tuple]:
        at = 0
        while True:
            while data[at : at + 4] == b"\0\0\0\0":
                at += 4
            if at + 16 > len(data):
                return
            size = struct.unpack_from("<I", data, at)[0] - extra
            if size <= 0 or at + 16 + size > len(data):
                return
            yield at + 16, data[at + 16 : at + 16 + size]
            at += 16 + size

    return walk


def walked(rows: DataFrame, content: str, walk: Walk, fields: dict[str, str], no: str) -> DataFrame:
    """The other columns of ``rows`` with a row for each record of ``content``: its number ``no`` and its ``fields`` (name: type).

    A null or empty content has no records. Rows are walked apart from each other; a column named like a new one is replaced.
    """
    keep = [c for c in rows.columns if c not in (content, no, *fields)]
    own = rows.select(*[f"`{c}`" for c in keep], f"`{content}`")
    kinds = [(n, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in fields.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                found = list(walk(b.column(content)[r].as_py() or b""))
                own = b.select(keep).take(pa.array([r] * len(found), pa.int64()))
                columns = [pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(range(len(found)), pa.int64()), *columns], [*keep, no, *fields])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != content), f"`{no}` bigint", *(f"`{n}` {t}" for n, t in fields.items())])
    return own.mapInArrow(run, schema)
