"""Cost-balanced packing of tokenised documents into sequences of a fixed token capacity."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import tokenizer
from .common import lean, slices

#: Documents packed together; bounds a task's memory whatever the size of the input.
GROUP_DOCS = 1024
#: A cut inside a document falls on a multiple of this many tokens.
BLOCK = 32
_PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def _crc_append(crc: int, other: int, n_bytes: int) -> int:
    """crc32 of a concatenation from the parts' crc32 and the second part's length."""
    zeros = bytes(n_bytes)
    return zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ other


def tokenise_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, seq_len: int, eos: int) -> DataFrame:
    """One row per piece of at most `seq_len` tokens, with its checksum and, for the last short piece,
    the checksums of its blocks. The ids themselves go no further, so what is shuffled is small.
    `again` counts rows of the same id and text before a row in its record batch."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = tokenizer(path)
        tail = int(eos).to_bytes(4, "little")
        for batch, seen in ((part, seen) for whole, seen in ((b, Counter()) for b in batches) for part in slices([whole])):
            rows, start, length, crc, total, blocks, again = [], [], [], [], [], [], []
            names = batch.column(0).to_pylist()
            for k, ids in enumerate(enc.encode_batch(batch.column(1).to_pylist())):
                ids = memoryview(ids + tail)
                n = len(ids) // 4
                own = names[k], n, zlib.crc32(ids)
                seen[own] += 1
                for s in range(0, n, seq_len):
                    m = min(seq_len, n - s)
                    part = ids[4 * s : 4 * (s + m)]
                    rows.append(k)
                    start.append(s)
                    length.append(m)
                    again.append(seen[own] - 1)
                    total.append(n)
                    crc.append(zlib.crc32(part))
                    blocks.append(None if m == seq_len else np.array([zlib.crc32(part[i : i + 4 * BLOCK]) for i in range(0, len(part), 4 * BLOCK)], dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(blocks, pa.binary()), pa.array(again, pa.int32())], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "blocks", "again"])
        enc.forget()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"`{id_col}` {kind}, {_PIECE}, blocks binary, again int")


def assign(lengths: np.ndarray, seq_len: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int, int]]]:
    """Pieces of one group into sequences.

    Whole sequences' worth of tokens are opened; pieces in descending cost each go to the
    lowest-cost sequence with room. A piece that fits nowhere is cut at a block so that its head
    fills the lowest-cost sequence that has room for a block, and its tail goes on. Returns for
    each piece its parts `(from token, tokens, sequence, offset)`."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    n_full = 0
    cost_of = lambda n: linear * n + quadratic * n * n
    rest = []
    for k in range(len(lengths)):
        if lengths[k] == seq_len:
            out[k].append((0, seq_len, n_full, 0))
            n_full += 1
        else:
            rest.append(k)
    rest.sort(key=lambda k: (-cost_of(float(lengths[k])), k))
    bins = -(-int(sum(int(lengths[k]) for k in rest)) // seq_len)
    room, cost = np.full(bins, seq_len, dtype=np.int64), np.zeros(bins)

    def put(k: int, at: int, n: int, j: int) -> None:
        out[k].append((at, n, n_full + j, seq_len - int(room[j])))
        room[j] -= n
        cost[j] += cost_of(float(n))

    for k in rest:
        at, left = 0, int(lengths[k])
        while left:
            fits = room >= left
            if fits.any():
                put(k, at, left, int(np.where(fits, cost, np.inf).argmin()))
                break
            some = room >= BLOCK
            if not some.any():
                room, cost = np.append(room, seq_len), np.append(cost, 0.0)
                continue
            j = int(np.where(some, cost, np.inf).argmin())
            n = int(room[j]) // BLOCK * BLOCK
            put(k, at, n, j)
            at, left = at + n, left - n
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048, eos: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> DataFrame:
    """Tokenise documents, append `eos`, cut and pack them into sequences of `seq_len` tokens.

    Cost of a piece of n tokens: `linear * n + quadratic * n * n`. Documents are dealt at random
    into groups of about GROUP_DOCS, each packed by `assign` in one task, so padding is under one
    sequence a group and memory doesn't grow with the input. Returns per piece `id_col, start,
    length, ids_crc32, doc_tokens, sequence_id, offset`; each token is in exactly one piece.

    A null or empty text is one piece holding `eos`; repeated rows are packed each for itself;
    null ids are kept; an empty table gives an empty result; other columns are ignored."""
    pieces = tokenise_pieces(docs, path, id_col, text_col, seq_len, eos)
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    # Rows that repeat id and text would all meet in one group but for their task and place in it.
    salt = F.when(F.col("again") > 0, F.xxhash64(F.spark_partition_id(), "again"))
    keyed = pieces.withColumn("_group", F.pmod(F.xxhash64(id_col, "doc_tokens", "start", "ids_crc32", salt), F.lit(groups))).drop("again")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(key, rows):
        group = key[0].as_py()
        rows = rows.combine_chunks().sort_by([(id_col, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length, start, crc = (rows.column(c).to_numpy() for c in ("length", "start", "ids_crc32"))
        blocks = rows.column("blocks").to_pylist()
        at, starts, lengths, crcs, seqs, offsets = [], [], [], [], [], []
        for k, parts in enumerate(assign(length, seq_len, linear, quadratic)):
            for first, n, seq, offset in parts:
                check = int(crc[k])
                if n != length[k]:
                    check, sums = 0, np.frombuffer(blocks[k], dtype="<u4")[first // BLOCK : -(-(first + n) // BLOCK)]
                    for i, c in enumerate(sums.tolist()):
                        check = _crc_append(check, c, 4 * min(BLOCK, n - i * BLOCK))
                at.append(k)
                starts.append(int(start[k]) + first)
                lengths.append(n)
                crcs.append(check)
                seqs.append((group << 32) + seq)
                offsets.append(offset)
        take = pa.array(at, pa.int64())
        cols = [rows.column(id_col).take(take).combine_chunks(), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs)), rows.column("doc_tokens").take(take).combine_chunks(), pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64())]
        return pa.table(cols, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return keyed.groupBy("_group").applyInArrow(run, f"`{id_col}` {kind}, {_PIECE}, sequence_id long, offset long")
