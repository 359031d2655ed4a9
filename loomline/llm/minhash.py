"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bitmap, connected_components, cut, lean, release

#: 32 bands of 5 rows: at a similarity of 0.8 a pair shares no band once in 300,000 times.
BANDS, ROWS = 32, 5
#: Members and shingles of one block of a bucket, about; a task compares two blocks at most, so that
#: its memory is bounded by both, whatever the length of the texts. A longer text is alone all the same.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Columns and rows of what a task that compares a cell counts at a time.
COLUMNS, STRIPE = 1024, 256
#: Bytes of text that are hashed together.
CHUNK = 1 << 19
_M = BANDS * ROWS
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _step(j: int) -> np.uint64:
    return np.uint64(j * int(_GOLD) % (1 << 64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, b % (1 << 64), dtype=np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its `size`-word shingles.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased. Fewer
    words than `size` are one shingle; no word gives the empty set."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(raw):
        hi, n = lo, 0
        while hi < len(raw) and (hi == lo or n + len(raw[hi]) < CHUNK):
            n += len(raw[hi]) + 1
            hi += 1
        out += _chunk_sets(raw[lo:hi], size)
        lo = hi
    return out


def _chunk_sets(raw: list[bytes], size: int) -> list[np.ndarray]:
    b = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white)).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw]))))
    up, down = _power(len(b))
    total = np.concatenate(([np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])))
    word = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _GOLD)
    n = len(word)
    out = []
    run = None
    if n >= size:
        run = word[: n - size + 1].copy()
        for k in range(1, size):
            run = _mix(run * np.uint64(_BASE) + word[k : n - size + 1 + k])
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if j - i >= size:
            out.append(np.unique(run[i : j - size + 1]))
        elif j > i:
            h = word[i : i + 1]
            for k in range(i + 1, j):
                h = _mix(h * np.uint64(_BASE) + word[k : k + 1])
            out.append(_mix(h + np.uint64(j - i)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def superminhash(sets: list[np.ndarray], m: int = _M) -> np.ndarray:
    """SuperMinHash signatures, one row of m values for each set (empty: all ones).

    Each element walks its own random permutation of the m places; in round j it offers j plus a
    random fraction to the place it reaches, so a place filled in an earlier round is never
    bettered in a later one: a set stops after the round that leaves no place empty. Rounds are
    done for all elements of all unfinished sets at once."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), m), empty, dtype=np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(row):
        return out
    h = np.concatenate(sets)
    flat = out.ravel()
    walk = None
    for j in range(m):
        r = _mix(h + _step(2 * j + 1))
        k = j + (_mix(h + _step(2 * j + 2)) % np.uint64(m - j)).astype(np.int64)
        if walk is None:
            place = k
        else:
            at = np.arange(len(h))
            place = walk[at, k].astype(np.int64)
            walk[at, k] = walk[at, j]
        np.minimum.at(flat, row * m + place, (np.uint64(j) << np.uint64(48)) | (r >> np.uint64(16)))
        go = (out == empty).any(1)[row]
        if not go.any():
            break
        if walk is None:
            walk = np.broadcast_to(np.arange(m, dtype=np.uint16), (int(go.sum()), m)).copy()
            walk[np.arange(len(walk)), k[go]] = 0
            row, h = row[go], h[go]
        elif not go.all():
            row, h, walk = row[go], h[go], walk[go]
    return out


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    s = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _GOLD, s.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key + s[:, :, r])
    return key


def _identity(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two 64-bit sums of each set: equal for equal sets, and 128 bits apart for others."""
    plain = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
    mixed = np.array([_mix(s + _GOLD).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(plain), pa.array(mixed)]


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """`(id, text_hash, n, h, g, bands)`: the set's size and identity, and its band keys."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sets = shingle_sets(batch.column(2).slice(lo, 256).to_pylist(), size)
                sig = np.concatenate([superminhash(sets[k : k + 64]) for k in range(0, len(sets), 64)]) if sets else np.zeros((0, _M), np.uint64)
                bands = bands_of(sig).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, len(sets)), batch.column(1).slice(lo, len(sets)), *_identity(sets),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands.ravel())),
                ], names=["id", "text_hash", "n", "h", "g", "bands"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col)).mapInArrow(lean(run), f"id {kind}, text_hash long, n long, h long, g long, bands array<bigint>")


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, wanted: DataFrame) -> DataFrame:
    """`(c, shingles)` of the classes in `wanted(c, rep, h, g, n)`.

    A bitmap of hashed ids of bounded size picks documents as they are read, so no text is shuffled.
    What it picks is told apart by its whole set, not by its id: an id that several texts share, and
    one picked in vain, give the set of each class that is wanted and no other."""
    holds, at = bitmap(wanted.select(F.col("rep").alias("id")).distinct())

    def run(batches):
        for batch in batches:
            take = np.flatnonzero(holds(batch.column(1).to_numpy()))
            for lo in range(0, len(take), 256):
                sets = shingle_sets(batch.column(0).take(pa.array(take[lo : lo + 256])).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([*_identity(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["n", "h", "g", "shingles"])

    found = docs.select(F.col(text_col), at(F.col(id_col)).alias("p")).mapInArrow(lean(run), "n long, h long, g long, shingles binary")
    return found.dropDuplicates(["h", "g", "n"]).join(wanted.select("c", "h", "g", "n"), ["h", "g", "n"]).select("c", "shingles")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The `(u, v)` whose whole sets satisfy 100 * intersection >= percent * union."""
    joined = pairs.join(sets.select(F.col("c").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("c").alias("v"), F.col("shingles").alias("b")), "v")
    most, least = F.greatest(F.length("a"), F.length("b")), F.least(F.length("a"), F.length("b"))

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return joined.where(100 * least >= percent * most).select("u", "v", "a", "b").mapInArrow(lean(run), "u long, v long")


def link_cell(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links between different groups (and sides) of one cell, as few as join the same groups.

    Shingles that two sets share are columns of a 0/1 matrix, taken some hundreds at a time, whose
    product with itself counts all intersections. Products and links are taken by stripes of rows: beside
    the counts, memory is a few numbers a shingle and a stripe, however many links there are."""
    n = len(sets)
    lengths = np.array([len(s) for s in sets])
    row, column = _shared(sets, lengths)
    both = np.zeros((n, n), dtype=np.float32)  # above the diagonal
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        m = np.zeros((n, COLUMNS), dtype=np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        for at in range(0, n, STRIPE):
            both[at : at + STRIPE, at:] += m[at : at + STRIPE] @ m[at:].T
    n_groups = int(group.max()) + 1
    root = list(range(n_groups))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for at in range(0, n, STRIPE):
        own = slice(at, at + STRIPE)
        common = both[own, at:].astype(float)
        linked = 100 * common >= percent * (lengths[own, None] + lengths[None, at:] - common)
        linked &= group[own, None] != group[None, at:]
        if side is not None:
            linked &= side[own, None] != side[None, at:]
        r, c = np.nonzero(np.triu(linked, 1))
        r, c = r + at, c + at
        a, b = np.minimum(group[r], group[c]), np.maximum(group[r], group[c])
        _, first = np.unique(a.astype(np.int64) * n_groups + b, return_index=True)
        for k in first.tolist():
            x, y = top(int(a[k])), top(int(b[k]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(r[k]), int(c[k])))
    return out


def _shared(sets: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set and column of each shingle that two sets share, by column; columns are numbered from 0."""
    h = np.concatenate(sets)
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    del h
    before, after = np.concatenate(([False], same)), np.concatenate((same, [False]))
    shared = before | after
    row = np.repeat(np.arange(len(sets), dtype=np.int32), lengths)[order[shared]]
    return row, np.cumsum(after & ~before, dtype=np.int32)[shared] - 1


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose sets of `size`-word shingles have a Jaccard similarity of `percent` / 100 or more.

    Equal sets are one class, numbered by the checkpoint that holds it. Classes that share a band key are
    candidates. First each is confirmed on the whole sets against the smallest of its bucket, which
    is linear; components of these links follow. Buckets that still hold several components
    are then compared whole, two blocks of members to a task: a task counts all intersections
    and gives only links that join components, fewer than its members, which are confirmed on the whole sets again.
    So no pairs of what is already linked, and none that fail, are ever emitted, and no bucket is capped.

    Returns `id_col, n_shingles, component_id, kept, text_hash` (Spark's xxhash64, which tells rows of
    one id apart); component_id is the smallest id of all rows
    of the component's classes. Null and empty texts and texts without a word have an empty set
    and link with nothing; null ids link with nothing; rows that repeat an id are documents of
    their own that bear one name: each links by its own text, and the name joins nothing; an empty
    table gives an empty result; other columns are ignored."""
    made = cut(sketches(docs, id_col, text_col, size))
    named = made.where("n > 0 and id is not null")
    key = ["h", "g", "n"]
    # Partial minima make one row of each class before the shuffle, however many copies there are.
    classes = cut(named.groupBy(*key).agg(F.min(F.struct("id", "bands")).alias("m")).select(F.monotonically_increasing_id().alias("c"), *key, F.col("m.id").alias("rep"), "m.bands"))
    postings = classes.select("c", "n", F.posexplode("bands").alias("_b", "_k")).select(F.xxhash64("_b", "_k").alias("key"), "c", "n")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    buckets = cut(postings.groupBy("key").agg(F.min("c").alias("centre"), F.max("c").alias("_last"), blocks.alias("blocks")).where("centre <> _last").drop("_last"))
    members = cut(postings.drop("n").join(buckets, "key").select("key", "centre", "blocks", "c"))
    sets = cut(_sets(docs.where(F.col(id_col).isNotNull()), id_col, text_col, size, classes.drop("bands").join(members.select("c").distinct(), "c", "left_semi")))
    pairs = members.where("c <> centre").select(F.col("centre").alias("u"), F.col("c").alias("v")).distinct()
    components = cut(connected_components(_confirm(pairs, sets, percent)))
    state = cut(members.join(components.withColumnRenamed("id", "c"), "c", "left").select("key", "blocks", "c", F.coalesce("component", "c").alias("component")))
    mixed = cut(state.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_z")).where("_a <> _z").select("key"))
    links = cut(_confirm(_cells(state.join(mixed, "key"), sets, percent).distinct(), sets, percent))
    if not links.isEmpty():
        # The components so far are a spanning forest of all links confirmed before.
        components = cut(connected_components(links.unionByName(components.select(F.col("id").alias("u"), F.col("component").alias("v")))))
    placed = cut(classes.select("c", *key, "rep").join(components.withColumnRenamed("id", "c"), "c", "left").select(*key, "rep", F.coalesce("component", "c").alias("component")))
    names = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_class = cut(placed.join(names, "component").select(*key, "component_id"))
    # Null ids and empty sets keep their own id.
    out = made.select("id", "text_hash", *key).join(per_class, key, "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")


def _cells(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links `(u, v)` that join different components within buckets `(key, blocks, c, component)`.

    A shingle travels as 48 bits of its hash: a link missed for want of the others is less likely
    than one in a thousand million, and one found in vain fails the confirmation that follows."""

    def shorten(batches):
        for batch in batches:
            short = [np.frombuffer(s, dtype=np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["c", "short"])

    rows = rows.join(sets.mapInArrow(lean(shorten), "c long, short binary"), "c").withColumn("own", F.pmod(F.xxhash64("c", F.lit(3)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "c", "component", "short")

    def compare(key, t):
        t = t.combine_chunks().sort_by("c")
        _, group = np.unique(t.column("component").to_numpy(), return_inverse=True)
        sets = []
        for s in t.column("short"):
            wide = np.zeros((s.as_buffer().size // 6, 8), dtype=np.uint8)
            wide[:, :6] = np.frombuffer(s.as_buffer(), dtype=np.uint8).reshape(-1, 6)
            sets.append(wide.reshape(-1).view("<u8"))
        side = None if key[1].as_py() == key[2].as_py() else t.column("own").to_numpy()
        found = link_cell(sets, group, side, percent)
        if len(sets) > STRIPE:  # what a large cell took isn't kept for the next
            del sets
            release()
        c = t.column("c").combine_chunks()
        return pa.table([c.take(pa.array([i for i, _ in found], pa.int64())), c.take(pa.array([j for _, j in found], pa.int64()))], names=["u", "v"])

    return dealt.groupBy("key", "a", "b").applyInArrow(compare, "u long, v long")
