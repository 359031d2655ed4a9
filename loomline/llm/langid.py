"""Language identification by hierarchical discrimination: family first, then one-versus-one SVMs."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, lean, slices

#: Hashed dimensions of letter 1- to 3-grams.
DIMS = 2048
#: The families of common languages; any other language is its own family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "pa", "ur"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def ngrams(text: str | None) -> np.ndarray | None:
    """Unit vector of hashed letter n-grams of a whole text; null if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, 32)
    c = np.concatenate(([32], c[(c != 32) | (np.concatenate(([0], c[:-1])) != 32)], [32])).astype(np.uint32)
    out = np.zeros(DIMS)
    key = c
    for n in range(1, 4):
        h = key * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        counts = np.bincount((h * np.uint32(0x85EBCA77) >> np.uint32(16)) % DIMS, minlength=DIMS)
        out += np.sqrt(counts / len(key))
        if len(c) <= n:
            break
        key = key[:-1] * np.uint32(0x01000193) + c[n:]
    return out / np.linalg.norm(out)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300, settled: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss and balanced classes (y: +1, -1).

    Accelerated gradient steps, started afresh where they turn uphill, until none moves a weight by
    `settled` of the largest, or `rounds` are done."""
    x, y = np.asarray(x, dtype=np.float32), y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, dtype=np.float32)  # the last is the bias
    step, t = np.float32(1 / (4 + penalty)), 1
    for _ in range(rounds):
        pull = 2 * weight * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        new = v - step * (np.float32(penalty) * v - np.append(pull @ x, pull.sum()))
        moved = new - w
        t = 1 if (v - new) @ moved > 0 else t + 1
        v, w = new + np.float32((t - 1) / (t + 2)) * moved, new
        if np.abs(moved).max() <= settled * np.abs(w).max():
            break
    return w[:-1].astype(float), float(w[-1])


class HierarchicalLanguages:
    """Family by one-versus-rest SVMs (one, where there are two), then the language by votes of
    one-versus-one SVMs. They are fitted in threads, which share the rows."""

    def __init__(self, x: np.ndarray, langs: list[str], threads: int = 4):
        family = np.array([_FAMILY.get(g, g) for g in langs])
        lang = np.array(langs)
        self.families = sorted(set(family.tolist()))
        self.members = {f: sorted(set(lang[family == f].tolist())) for f in self.families}
        rest = self.families[:1] if len(self.families) == 2 else self.families if len(self.families) > 2 else []
        problems = [(None, np.where(family == f, 1.0, -1.0)) for f in rest]
        names = [pair for f in self.families for pair in combinations(self.members[f], 2)]
        for a, b in names:
            own = np.flatnonzero((lang == a) | (lang == b))
            problems.append((own, np.where(lang[own] == a, 1.0, -1.0)))
        with ThreadPoolExecutor(threads) as pool:
            solved = list(pool.map(lambda p: linear_svm(x if p[0] is None else x[p[0]], p[1]), problems))
        self.family = solved[: len(rest)]
        if len(rest) == 1:
            self.family.append((-self.family[0][0], -self.family[0][1]))
        self.pairs = dict(zip(names, solved[len(rest) :]))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score in 0..1 of each row: the family's share times the language's."""
        if not self.families:
            return ["und"] * len(x), np.zeros(len(x))
        squash = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
        if self.family:
            margins = np.stack([x @ w + b for w, b in self.family], 1)
            chosen, score = margins.argmax(1), squash(margins.max(1))
        else:
            chosen, score = np.zeros(len(x), int), np.ones(len(x))
        out = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(chosen == k)
            names = self.members[f]
            votes = np.zeros((len(rows), len(names)))
            for (a, b), (w, bias) in self.pairs.items():
                if a in names and b in names and len(rows):
                    p = squash(x[rows] @ w + bias)
                    votes[:, names.index(a)] += p + (p >= 0.5)
                    votes[:, names.index(b)] += 1 - p + (p < 0.5)
            best = votes.argmax(1)
            out[rows] = [names[i] for i in best]
            if len(names) > 1 and len(rows):
                score[rows] = score[rows] * (votes.max(1) - (len(names) - 1)).clip(0, len(names) - 1) / (len(names) - 1)
        return out.tolist(), np.clip(score, 0, 1)


#: Texts of all languages that the models are fitted on at most, and languages among them.
SAMPLE, LANGUAGES = 8192, 64


def _draw(docs: DataFrame, text_col: str, lang_col: str, docs_a_language: int, seed: int) -> list[tuple[bytes, str]]:
    """Vectors and languages of the sample, in one fixed order."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("g")).withColumn("k", F.xxhash64("t", F.lit(seed)))
    hashes = cut(known.select("g", "k").distinct())
    counts = {r["g"]: r["n"] for r in hashes.groupBy("g").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "g").limit(LANGUAGES).collect()}
    if not counts:
        return []
    each = min(docs_a_language, SAMPLE // len(counts))
    # Of each language some four times as many as wanted lie under a bound on their hash's low bits; the
    # smallest of these are taken, so that few are ranked, whatever the number of texts.
    bound = F.create_map(*(F.lit(v) for g, n in counts.items() for v in (g, min(1 << 20, (4 * each + 64) * (1 << 20) // n + 1))))
    low = F.pmod("k", F.lit(1 << 20))
    ranked = hashes.where(low < bound[F.col("g")]).withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(low, "k")))
    chosen = ranked.where(F.col("r") <= each).select("g", "k")

    def run(batches):
        seen = set()
        for batch in slices(batches):
            made = []
            for t, g, k in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (g, k) not in seen:
                    seen.add((g, k))
                    made.append((ngrams(t), g, k))
            made = [(v.astype("<f4").tobytes(), g, k) for v, g, k in made if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.binary()), pa.array([x[1] for x in made], pa.string()), pa.array([x[2] for x in made], pa.int64())], names=["v", "g", "k"])

    # At most SAMPLE rows are broadcast, and as many come back.
    drawn = known.join(F.broadcast(chosen), ["g", "k"]).select("t", "g", "k").mapInArrow(lean(run), "v binary, g string, k long").dropDuplicates(["g", "k"])
    return sorted((bytes(r["v"]), r["g"]) for r in drawn.select("v", "g").collect())


def fit(docs: DataFrame, text_col: str, lang_col: str, docs_a_language: int = 800, seed: int = 17) -> HierarchicalLanguages:
    """Fit on a bounded sample: the `docs_a_language` distinct texts of each language with the smallest
    seeded hashes, at most SAMPLE in all and of the LANGUAGES with the most texts. A language with fewer
    gives all its texts, and copies count once, however many there are. Null texts and languages teach
    nothing."""
    rows = _draw(docs, text_col, lang_col, docs_a_language, seed)
    x = np.frombuffer(b"".join(v for v, _ in rows), dtype="<f4").reshape(-1, DIMS)
    return HierarchicalLanguages(x, [g for _, g in rows])


def identify(docs: DataFrame, model: HierarchicalLanguages, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`id_col, *keep, lang_pred, score` for every whole text.

    Null texts and texts without a letter are `und` with score 0; repeated rows are predicted
    each; null ids are kept; an empty table gives an empty result; a model without languages
    predicts `und`. Narrow: no shuffle; the model is a few vectors of DIMS numbers."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep)) + ", lang_pred string, score double"

    def run(batches):
        for batch in slices(batches):
            lang, score = _predict(model, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(lang, pa.string()), pa.array(score)], names=[id_col, *keep, "lang_pred", "score"])

    return docs.select(F.col(id_col), *keep, F.col(text_col).alias("_text")).mapInArrow(lean(run), schema)


def _predict(model: HierarchicalLanguages, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    for lo in range(0, len(texts), 512):
        made = [(lo + i, v) for i, v in enumerate(map(ngrams, texts[lo : lo + 512])) if v is not None]
        if made:
            found, s = model.predict(np.array([v for _, v in made]))
            for (i, _), g, p in zip(made, found, s):
                lang[i], score[i] = g, p
    return lang, score


def keep(docs: DataFrame, model: HierarchicalLanguages, text_col: str = "text", least: float = 0.2, langs: tuple[str, ...] | None = None) -> DataFrame:
    """The documents in one of `langs` (any but `und` by default) with a score of `least` or more,
    with all their columns. Narrow; nulls and empty tables are treated as in `identify`."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            lang, score = _predict(model, batch.column(at).to_pylist())
            ok = np.array([g != "und" and (langs is None or g in langs) for g in lang], dtype=bool)
            yield batch.filter(pa.array(ok & (score >= least)))

    return docs.mapInArrow(lean(run), docs.schema)
