"""The binary motion-vector format as a Python data source, and a writer of its bytes.

Header of 60 bytes: magic `FTMV`, eight little-endian 32-bit integers (version, duration in ms, frame rate
times 1000, frames, width, height, blocks across, blocks down), 24 reserved bytes. Then for each
frame: number and time in ms as 32-bit integers, a type character, 11 reserved bytes, and the x
and y motions of all blocks as signed bytes."""

from __future__ import annotations

import io
import os
import struct

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

HEADER, FRAME = struct.Struct("<4s8i24x"), struct.Struct("<iic11x")


def encode(frames: list[tuple[int, int, str, bytes, bytes]], across: int, down: int, fps: float = 25.0) -> bytes:
    """Bytes of a whole file from `(number, ms, type, x motions, y motions)`."""
    last = frames[-1][1] if frames else 0
    out = io.BytesIO()
    out.write(HEADER.pack(b"FTMV", 1, last, round(fps * 1000), len(frames), across * 16, down * 16, across, down))
    for number, ms, kind, x, y in frames:
        out.write(FRAME.pack(number, ms, kind.encode()))
        out.write(x)
        out.write(y)
    return out.getvalue()


def decode(data: bytes) -> list[tuple[int, int, str, bytes, bytes]]:
    """Frames of a whole file's bytes; a file cut short ends before its partial frame."""
    head = HEADER.unpack_from(data)
    if head[0] != b"FTMV":
        raise ValueError("not a motion file")
    blocs = head[7] * head[8]
    return [_frame(data[at : at + FRAME.size + 2 * blocs], blocs) for at in range(HEADER.size, len(data) - FRAME.size - 2 * blocs + 1, FRAME.size + 2 * blocs)]


def _frame(raw: bytes, blocs: int) -> tuple[int, int, str, bytes, bytes]:
    number, ms, kind = FRAME.unpack_from(raw)
    return number, ms, kind.decode("latin-1"), raw[FRAME.size : FRAME.size + blocs], raw[FRAME.size + blocs :]


class FrameRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class MotionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("framespartition", 1000))
        with open(self.path, "rb") as f:
            head = HEADER.unpack(f.read(HEADER.size))
        if head[0] != b"FTMV":
            raise ValueError("not a motion file")
        self.blocs, self.frames = head[7] * head[8], head[4]
        self.first = max(0, int(options.get("firstframe", 0)))
        self.last = min(self.frames, int(options.get("lastframe", self.frames - 1)) + 1)

    def partitions(self):
        """Ranges of frames, each read by a seek."""
        return [FrameRange(i, min(i + self.step, self.last)) for i in range(self.first, self.last, self.step)] or [FrameRange(0, 0)]

    def read(self, partition: FrameRange):
        size = FRAME.size + 2 * self.blocs
        with open(self.path, "rb") as f:
            f.seek(HEADER.size + partition.first * size)
            for _ in range(partition.first, partition.last):
                raw = f.read(size)
                if len(raw) < size:  # a file cut short ends here
                    return
                yield _frame(raw, self.blocs)


class PushingReader(MotionReader):
    """A reader that takes its range from the query's own filters."""

    def pushFilters(self, filters):
        """Bounds of the frame number become the range that is read; files number frames from 0. Spark
        checks them again, as it does all other filters."""
        for f in filters:
            if getattr(f, "attribute", None) == ("frame",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value + isinstance(f, LessThanOrEqual))
            yield f


class MotionSource(DataSource):
    """`spark.dataSource.register(MotionSource)`, then `spark.read.format("motion").load(path)`; the
    path must be reachable by every executor. Options: framesPartition, frames of one partition;
    firstFrame and lastFrame, the range to read; pushdown, to take it from filters on `frame`, for
    sessions whose spark.sql.python.filterPushdown.enabled is true."""

    @classmethod
    def name(cls):
        return "motion"

    def schema(self):
        return "frame int, t_ms int, type string, mx binary, my binary"

    def reader(self, schema):
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else MotionReader)(self.options)


def write(files: DataFrame, folder: str, name: str, content: str) -> None:
    """Write each row's content as `folder/name.mvs`, from the executors; a file that is written again after
    a failure replaces itself. The folder must be a path that every executor reaches."""
    os.makedirs(folder, exist_ok=True)

    def run(rows):
        for batch in rows:
            for n, data in zip(batch[name], batch[content]):
                path = os.path.join(folder, f"{n}.mvs")
                with open(path + ".tmp", "wb") as f:
                    f.write(data)
                os.replace(path + ".tmp", path)
            yield batch[[name]]

    files.select(name, content).mapInPandas(run, f"{name} {files.schema[name].dataType.simpleString()}").count()
