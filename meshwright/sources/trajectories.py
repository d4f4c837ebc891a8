"""Particle trajectories in binary files of frames, as a data source.

A file is a header, an index of chunks and the chunks: a chunk is an array with a
name and a frame. Positions are the chunk ``particles/position``; a chunk that a
frame lacks is the first frame's. The driver reads the header and the index only;
frames are dealt into partitions of about ``option("bytes", ...)`` each, which
tasks read side by side, each only the chunks of the columns it is asked for:

    frames_of(spark, path, "frame int, pid long, x double").where("frame < 10")

is ``spark.read.format("particle_frames").schema(...).load(path)`` once the format
is registered. Filters on ``frame`` are taken over, so other frames are not read;
Spark must be set to offer them. Paths are what pyarrow's file systems take: a
folder all executors see, or a store.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "frame int, pid long, typeid int, x double, y double, z double, lx double, ly double, lz double"

# Fixed values of the file format: the first eight bytes, the header, an entry of the index (frame, rows, place, columns, name, kind, flags), a name's share of the list of names, and numpy's kinds by number.
MAGIC = 0x65DF65DF65DF65DF
HEADER, ENTRY, NAME = struct.Struct("<QQQQQII64s64s80s"), np.dtype([("frame", "<u8"), ("rows", "<u8"), ("at", "<i8"), ("columns", "<u4"), ("name", "<u2"), ("kind", "u1"), ("flags", "u1")]), 64
KINDS = {1: "u1", 2: "<u2", 3: "<u4", 4: "<u8", 5: "i1", 6: "<i2", 7: "<i4", 8: "<i8", 9: "<f4", 10: "<f8"}
COUNT, POSITION, TYPE, BOX = "particles/N", "particles/position", "particles/typeid", "configuration/box"
#: The chunk that each column comes from.
FROM = {"typeid": TYPE, **dict.fromkeys("xyz", POSITION), **dict.fromkeys(("lx", "ly", "lz"), BOX)}

Chunk = tuple[int, int, int, int]  # place, rows, columns, kind


def opened(path: str) -> pa.NativeFile:
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(name)


def index(path: str) -> list[dict[str, Chunk]]:
    """The chunks of every frame, by name."""
    with opened(path) as f:
        head = f.read(HEADER.size)
        if len(head) < HEADER.size or HEADER.unpack(head)[0] != MAGIC:
            raise ValueError(f"{path} is no file of frames")
        _, at, n, names_at, n_names, _, version, *_ = HEADER.unpack(head)
        f.seek(names_at)
        raw = f.read(n_names * NAME)
        shares = raw.split(b"\0") if version >= 0x20000 else [raw[k : k + NAME].split(b"\0")[0] for k in range(0, len(raw), NAME)]
        names = [x.decode() for x in shares if x]
        f.seek(at)
        entries = np.frombuffer(f.read(n * ENTRY.itemsize), ENTRY)
    entries = entries[entries["at"] > 0]
    frames: list[dict[str, Chunk]] = [{} for _ in range(int(entries["frame"].max(initial=0)) + 1 if len(entries) else 0)]
    for e in entries:
        frames[e["frame"]][names[e["name"]]] = int(e["at"]), int(e["rows"]), int(e["columns"]), int(e["kind"])
    return [{**frames[0], **own} for own in frames]


def chunk(f: pa.NativeFile, c: Chunk) -> np.ndarray:
    at, rows, columns, kind = c
    if kind not in KINDS:
        raise ValueError(f"chunks of kind {kind} hold no numbers")
    f.seek(at)
    return np.frombuffer(f.read(rows * columns * np.dtype(KINDS[kind]).itemsize), KINDS[kind]).reshape(rows, columns)


@dataclass
class Frames(InputPartition):
    """Frames that one task reads: their numbers and chunks."""

    held: list[tuple[int, dict[str, Chunk]]]

    def __init__(self, held: list[tuple[int, dict[str, Chunk]]]) -> None:
        super().__init__(held)
        self.held = held


class ParticleFrames(DataSource):
    """Format ``particle_frames``."""

    @classmethod
    def name(cls) -> str:
        return "particle_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options["path"], int(self.options.get("bytes", 64 << 20)), schema)


def frames_of(spark: SparkSession, path: str, schema: str = SCHEMA, size: int = 64 << 20) -> DataFrame:
    """The points of all frames of a file, with the columns of ``schema``; registers the format and has Spark offer filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ParticleFrames)
    return spark.read.format("particle_frames").schema(schema).option("bytes", size).load(path)


class FrameReader(DataSourceReader):
    def __init__(self, path: str, size: int, schema: StructType) -> None:
        self.path, self.size, self.columns = path, size, [f.name for f in schema.fields]
        self.kinds = {f.name: pa.float64() if f.name in "xyz" or f.name[0] == "l" else pa.int64() if f.name == "pid" else pa.int32() for f in schema.fields}
        self.low, self.high = 0, None
        if unknown := set(self.columns) - {"frame", "pid", *FROM}:
            raise ValueError(f"files of frames have no columns {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the name is Spark's
        for f in filters:
            steps = {EqualTo: (0, 0), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0)}.get(type(f))
            if steps is None or f.attribute != ("frame",):
                yield f
                continue
            low, high = steps
            self.low = max(self.low, f.value + low) if low is not None else self.low
            if high is not None:
                self.high = f.value + high if self.high is None else min(self.high, f.value + high)

    def partitions(self) -> list[Frames]:
        out, held, size = [], [], 0
        for k, chunks in enumerate(index(self.path)):
            if k < self.low or (self.high is not None and k > self.high):
                continue
            held.append((k, chunks))
            size += chunks.get(POSITION, (0, 0, 0, 0))[1] * 24 + 1
            if size >= self.size:
                out.append(Frames(held))
                held, size = [], 0
        return out + [Frames(held)] if held or not out else out

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as f:
            for k, chunks in partition.held:
                n = int(chunk(f, chunks[COUNT])[0, 0]) if COUNT in chunks else chunks[POSITION][1]
                held = {name: chunk(f, chunks[name]) for name in {FROM[c] for c in self.columns if c in FROM} if name in chunks}
                own = {"frame": np.full(n, k), "pid": np.arange(n), TYPE: np.zeros((n, 1), int), **held}
                value = {"typeid": lambda own=own: own[TYPE][:, 0]}
                value |= {a: (lambda own=own, i=i: own[POSITION][:, i]) for i, a in enumerate("xyz")}
                value |= {f"l{a}": (lambda own=own, i=i, n=n: np.full(n, own[BOX].ravel()[i])) for i, a in enumerate("xyz")}
                arrays = [pa.array(own[c] if c in own else value[c]()).cast(self.kinds[c]) for c in self.columns]
                yield pa.RecordBatch.from_arrays(arrays, self.columns)
