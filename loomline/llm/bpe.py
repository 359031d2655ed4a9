"""Byte-level BPE by forced boundaries.

A byte pair that occurs inside no vocabulary token can never lie inside an output token, so it
marks a certain cut: the fragments between such cuts are encoded independently and their ids
concatenated. Two kinds of certain cuts are used, coarse ones found with plain string search
(a white-space character after a visible one: the pre-tokenizer always splits there), then the
byte pairs within each pre-token. Fragments and chunks are memoised in bounded tables.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean, slices

# The public pre-tokenizer pattern of this vocabulary, and Unicode White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


class _Memo(dict):
    """A bounded memo: computed on a miss, emptied when full."""

    def __init__(self, compute, entries: int):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.entries:
            self.clear()
        self[key] = value
        return value


class ForcedBoundaryBPE:
    """Encoder and decoder for a byte-level BPE `tokenizer.json`.

    Encoding equals the tokenizers library with add_special_tokens=False, truncation and padding
    unused: the text of a special token gives its id. Decoding keeps special tokens.
    """

    def __init__(self, path: str, entries: int = 300_000):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(back[c] for c in t) for t in vocab if all(c in back for c in t)}
        ranks = {bytes([b]): i for i, b in enumerate(sorted(back[c] for c in back))}
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(raw[left] + raw[right], len(ranks))
        ids = {v: vocab[k] for k, v in raw.items()}
        order = [ids.get(t, 0) for t in ranks]
        self._id_of_rank = None
        if sorted(order[256:]) == order[256:] and len(set(order)) == len(order) and order[255] < 256:
            ranks = {t: ids.get(t, 0) for t in ranks}  # the ids already follow the merge order
        else:
            self._id_of_rank = np.array(order, dtype="<u4")
        core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._piece = core._core_bpe.encode_single_piece
        self._words = regex.compile(PATTERN).findall
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self._added = added
        self._special = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        size = max([*vocab.values(), *added.values(), -1]) + 1
        self._bytes = [b""] * size
        for t, i in [*vocab.items(), *added.items()]:
            self._bytes[i] = t.encode() if t in added else raw.get(t, t.encode())
        self._never = np.ones(1 << 16, dtype=bool)  # by byte pair: inside no vocabulary token
        self._never[[x << 8 | y for t in ids for x, y in zip(t, t[1:])]] = False
        self._chunk = _Memo(self._encode_chunk, entries // 8)
        self._after_space: dict[str, bytes] = {}
        self._entries = entries
        self._runs = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall

    def fragments(self, word: bytes) -> list[bytes]:
        """Cut a pre-token at every byte pair that no vocabulary token contains."""
        at = [0, *(i for i, (x, y) in enumerate(zip(word, word[1:]), 1) if self._never[x << 8 | y]), len(word)]
        return [word[i:j] for i, j in zip(at, at[1:])]

    def _encode_chunk(self, chunk: str) -> bytes:
        ranks: list[int] = []
        for w in self._words(chunk):
            for f in self.fragments(w.encode()):
                ranks += self._piece(f)
        return self._ids(ranks).tobytes()

    def _ids(self, ranks: list[int]) -> np.ndarray:
        out = np.array(ranks, dtype="<u4")
        return out if self._id_of_rank is None else self._id_of_rank[out]

    def _learn(self, words: list[str]) -> None:
        """Encode words that each follow one space, all together: the cuts come from one vector pass. A word
        of letters alone is one pre-token with its space; the others are split by the pattern."""
        plain, others = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        text = " ".join(["", *plain, *others])
        raw = text.encode()
        tokens = self._words(" ".join(["", *others])) if others else []
        sized = (plain, tokens) if len(raw) == len(text) else (map(str.encode, plain), map(str.encode, tokens))
        lengths = np.concatenate((np.fromiter(map(len, sized[0]), dtype=np.int64, count=len(plain)) + 1, np.fromiter(map(len, sized[1]), dtype=np.int64, count=len(tokens))))
        first = np.concatenate((np.ones(len(plain), dtype=bool), np.fromiter((t[0] == " " for t in tokens), dtype=bool, count=len(tokens))))
        b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint16)
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[1:-1] = self._never[b[:-1] << 8 | b[1:]]
        ends = np.cumsum(lengths)
        cut[ends] = True
        start = np.zeros(len(raw) + 1, dtype=bool)  # of a word: pre-tokens that begin with the joining space
        start[(ends - lengths)[first]] = True
        ends = np.flatnonzero(cut)
        starts = np.concatenate(([0], ends[:-1]))
        piece, ranks, bounds = self._piece, [], []
        for i, j, word in zip(starts.tolist(), ends.tolist(), start[starts].tolist()):
            if word:
                bounds.append(len(ranks))
            ranks += piece(raw[i:j])
        bounds.append(len(ranks))
        ids = self._ids(ranks).tobytes()
        self._after_space.update(zip(plain + others, [ids[4 * i : 4 * j] for i, j in zip(bounds, bounds[1:])]))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null is empty."""
        special, known, white = self._special, self._after_space, WHITE
        out: list[bytes] = []
        for lo in range(0, len(texts), 64):  # a bounded number of words at a time
            block = texts[lo : lo + 64]
            parts: list[list[str] | None] = []
            for text in block:
                split = text.split(" ") if text else []
                if len(split) > 1 and (not split[0] or split[0][-1] in white) or split and special and any(t in text for t in self._added):
                    split = None
                parts.append(split)
            words = set().union(*(p[1:] for p in parts if p))
            need = [w for w in words.difference(known) if w and w[-1] not in white]
            if len(known) + len(need) > self._entries:  # the memo starts anew and must hold what this block uses
                known.clear()
                need = [w for w in words if w and w[-1] not in white]
            if need:
                self._learn(need)
            for p, text in zip(parts, block):
                if p:
                    try:
                        out.append(self._chunk[p[0]] + b"".join(map(known.__getitem__, p[1:])))
                        continue
                    except KeyError:  # white space before a space: not a certain cut
                        pass
                out.append(self._slow(text) if text else b"")
        return out

    def _slow(self, text: str) -> bytes:
        """Texts with runs of white space or special tokens: cut before white space that follows a visible character."""
        out = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self._added:
                out.append(self._added[part].to_bytes(4, "little"))
            else:
                out += map(self._chunk.__getitem__, self._runs(part))
        return b"".join(out)

    def encode_bytes(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def forget(self) -> None:
        """Empty the memos, so that a worker that waits for its next task holds no words."""
        self._after_space.clear()
        self._chunk.clear()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    def decode_bytes(self, ids) -> bytes:
        """UTF-8 of the decoded text; bytes that form no character become U+FFFD."""
        table = self._bytes
        raw = b"".join([table[i] for i in np.asarray(ids).tolist() if i < len(table)])
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode()


def _byte_alphabet() -> dict[int, str]:
    """Byte to character: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ForcedBoundaryBPE:
    """One encoder for each Python worker and file."""
    return ForcedBoundaryBPE(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns `id_col, n_tokens, ids (binary, little-endian u32; with keep_ids), ids_sha256,
    decoded (with keep_ids), decoded_sha256`. Null and empty texts have no tokens and decode to
    the empty text; repeated rows stay repeated; other columns are ignored; an empty table gives
    an empty result. Narrow: no shuffle, one record batch in memory."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep_ids else "")
    kind = docs.schema[id_col].dataType

    def run(batches):
        enc = tokenizer(path)
        for batch in slices(batches):
            n, ids_sha, text_sha, ids_out, text_out = [], [], [], [], []
            for ids in enc.encode_batch(batch.column(1).to_pylist()):
                back = enc.decode_bytes(np.frombuffer(ids, dtype="<u4"))
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                if keep_ids:
                    ids_out.append(ids)
                    text_out.append(back.decode())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array(ids_out, pa.binary()), pa.array(text_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        enc.forget()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"`{id_col}` {kind.simpleString()}, {schema}")
