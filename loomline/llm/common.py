"""Helpers shared by the training-data operators: reading, cutting lineage, splits, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomline.session import scratch, shared_folder, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store Spark reaches will do."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 512):
    """Record batches in slices of some rows, so that only these texts are Python strings at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def release() -> None:
    """Give back to the system what this worker's allocators keep of memory that is free."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """For `mapInArrow`: `run`, and then `release`. Workers wait for their next task beside the others of an
    executor, several to a core, so what each of them keeps counts. The package is sent to the
    executors, if it wasn't, whatever the table was read by."""
    session = SparkSession.getActiveSession()
    if session is not None:
        ship_package(session)

    def go(batches):
        yield from run(batches)
        release()

    return go


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder named by spark.checkpoint.dir.

    Executors may be lost at any time: the files are in shared storage, so nothing before this
    point is computed again. A folder is set only where the session names none (tests)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut the lineage with a Parquet table in the shared folder: compressed, and read by column, which
    suits whole texts better than a checkpoint. Returns it with its path, for `discard`; what is not
    discarded goes when the driver ends."""
    path = f"{scratch(df.sparkSession, 'stored')}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bitmap(ids: DataFrame) -> tuple[Callable[[np.ndarray], np.ndarray], Callable[[Column], Column]]:
    """Which of some places hold an id of `ids(id)`, and the place of an id: a filter, for workers, that passes
    all these ids and about one of 64 others (more beyond four million ids).

    64 bits or more for each id but at most 2**28, so at most 32 MB reach the driver and the workers
    whatever the number of ids."""
    n = ids.count()
    bits = 1 << min(28, max(15, (64 * n).bit_length()))
    place = lambda i: F.pmod(F.xxhash64(i, F.lit(5)), F.lit(bits))
    held = np.zeros(bits // 8, dtype=np.uint8)
    parts = ids.select(place(F.col("id")).alias("p")).groupBy(F.expr("p div 32768").alias("b")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("m"))
    for r in parts.collect():
        held[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(r["m"], dtype=np.uint8)
    return lambda p: (held[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool), place


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text leaves remainder 2 by 4; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Alternating large-star and small-star over `edges(u, v)`; returns `(id, component)`.

    Component is the smallest id reachable. Only ids that occur in an edge between two
    different ids are returned; an empty edge table gives an empty result. Every round is one
    partial-aggregated minimum and one join between two plain exchanges, so a node with very
    many neighbours is split by the adaptive skew join. Nothing but one flag a round reaches
    the driver.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    for _ in range(max_rounds):
        if _stars(e):
            break
        e = _star(_star(e, large=True), large=False)
    else:
        raise RuntimeError("connected components did not settle")
    members = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every id has one edge to a smaller id or only edges to larger ones, which settles all."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One half round: link neighbours to the smallest neighbour instead of to each other."""
    sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
    least = cut(sym.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    both = sym.join(least, "u")
    if large:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return cut(out.where("u <> v").distinct())
