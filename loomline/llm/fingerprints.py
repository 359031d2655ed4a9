"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A fingerprint is a wide vector of unsigned 32-bit lanes, the sum modulo 2**32 of one vector for
each paragraph, so it doesn't depend on the paragraphs' order, and adding or subtracting a
paragraph's vector inserts or deletes it. A paragraph's vector has

* 8 lanes hashed from the whole paragraph, and its count: equality of the multisets;
* the count of its word trigrams (with both ends marked), and for each of 64 lanes how many of
  them have that bit in their hash: twice a lane less the count is a sum of random signs, whose
  products estimate the overlap of two multisets of trigrams.

It is written as hexadecimal digits, eight for each lane.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

STRONG, SIGNS = 8, 64
LANES = STRONG + 2 + SIGNS
_LOW = 0xFFFFFFFF
_PAIR = (1 << 32) | 1


def sketch(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """`keys, fingerprint, signs` for each distinct key; rows of one key are one document. `signs`
    are the fingerprint's sign lanes as numbers, twice a lane less the count.

    Null texts count as empty: one empty paragraph. If `texts` is already partitioned by some of
    the keys there is no shuffle; otherwise sums are made before it."""
    seeds = [F.xxhash64("_p", F.lit(s)).alias(f"_h{s}") for s in range(STRONG // 2)]
    paragraphs = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_p"))
    marked = F.concat(F.array(F.lit("\x02")), F.filter(F.split("_p", r"\s+"), lambda w: w != ""), F.array(F.lit("\x03")))
    worded = paragraphs.select(*keys, *seeds, marked.alias("_w"))
    trigrams = F.when(F.size("_w") > 2, F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(F.get("_w", i - 1), F.get("_w", i), F.get("_w", i + 1))))
    units = worded.select(*keys, *(f"_h{s}" for s in range(STRONG // 2)), F.posexplode_outer(trigrams).alias("_i", "_u"))
    first = F.coalesce(F.col("_i"), F.lit(0)) == 0
    sums = [F.sum(F.when(first, x)) for s in range(STRONG // 2) for x in (F.col(f"_h{s}").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(f"_h{s}", 32))]
    sums += [F.sum(F.when(first, 1).otherwise(0)), F.count("_u")]
    sums += [F.coalesce(F.sum(F.shiftrightunsigned("_u", i).bitwiseAND(F.lit(_PAIR))), F.lit(0)) for i in range(SIGNS // 2)]
    wide = units.groupBy(*keys).agg(*(x.alias(f"_s{i}") for i, x in enumerate(sums)))
    low, high = [F.col(f"_s{i}") for i in range(STRONG + 2)], []
    for i in range(STRONG + 2, STRONG + 2 + SIGNS // 2):
        low.append(F.col(f"_s{i}"))
        high.append(F.shiftrightunsigned(f"_s{i}", 32))
    count = F.col(f"_s{STRONG + 1}")
    centred = F.array(*((x.bitwiseAND(F.lit(_LOW)) * 2 - count).cast("double") for x in (*low[STRONG + 2 :], *high)))
    return wide.select(*keys, _text(F.array(*low, *high)).alias("fingerprint"), centred.alias("signs"))


def _text(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(_LOW))), 8, "0")), "")


def lanes(fingerprint: Column) -> Column:
    """The lanes of a fingerprint as an array of longs."""
    return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: F.conv(F.substring(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def insert(fingerprint: Column, part: Column) -> Column:
    """The fingerprint with the paragraphs of `part` added."""
    return _text(F.zip_with(lanes(fingerprint), lanes(part), lambda a, b: a + b))


def delete(fingerprint: Column, part: Column) -> Column:
    """The fingerprint with the paragraphs of `part` taken away."""
    return _text(F.zip_with(lanes(fingerprint), lanes(part), lambda a, b: a - b + F.lit(_LOW + 1)))


def signs(fingerprint: Column) -> Column:
    """The sign lanes of a fingerprint as numbers; give it a column of its own before comparing."""
    lane = lambda i: F.conv(F.substring(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(STRONG + 2), F.lit(LANES - 1)), lambda i: lane(i) * 2 - lane(F.lit(STRONG + 1)))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Overlap of two documents' trigrams from 0 to 1, from their fingerprints' signs: twice their
    product by the sum of their squares; 1 for the `same` fingerprint, null where one is missing."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    value = F.coalesce(F.try_divide(2 * dot(a, b), dot(a, a) + dot(b, b)), F.lit(0.0))
    return F.when(same, F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col, fingerprint` for each document.

    Null texts count as empty; equal texts have equal fingerprints; rows that repeat an id are
    fingerprinted together, as paragraphs of one document; null ids are one document; an empty
    table gives an empty result; other columns are ignored."""
    return sketch(docs.select(F.col(id_col), F.col(text_col).alias("_text")), [id_col], "_text").drop("signs")


#: Children of a node of the tree that ranges are searched through.
_FAN = 64


def range_bounds(keys: DataFrame, rows_a_range: int, most_ranges: int) -> DataFrame:
    """One row with the sorted lower bounds of ranges of about `rows_a_range` rows, in array `b`, and two
    thinner levels above them, `a2` and `a1`. `keys(key)` may hold anything that can be ordered.

    Keys drawn by hash, eight a range, are sorted and every eighth is a bound, so a range is as
    wide as its rows are sparse: none holds many more rows than others, however the ids lie, but
    for rows of one and the same key. Bounds are at most about `most_ranges`."""
    n = keys.count()
    step = max(rows_a_range, -(-n // most_ranges)) // 8
    drawn = keys.where(F.pmod(F.xxhash64("key", F.lit(23)), F.lit(max(1, step))) == 0).distinct()
    every = lambda x, k: F.filter(x, lambda _, i: i % k == 0)
    bounds = drawn.agg(F.sort_array(F.collect_list("key")).alias("b")).select(every(F.col("b"), 8).alias("b"))
    return bounds.select(F.struct("b", every(F.col("b"), _FAN).alias("a2"), every(F.col("b"), _FAN * _FAN).alias("a1")))


def constant(row: DataFrame) -> Column:
    """The one value of a table of one row and column as a constant of later plans, whatever its type:
    a session variable, which a plan that is analysed here holds by its value."""
    spark, name = row.sparkSession, f"loomline_{uuid.uuid4().hex}"
    row.createOrReplaceTempView(name)
    try:
        spark.sql(f"DECLARE VARIABLE {name} {row.schema[0].dataType.simpleString()}")
        spark.sql(f"SET VAR {name} = (SELECT * FROM {name})")
    finally:
        spark.catalog.dropTempView(name)
    return F.expr(f"session.{name}")


def range_of(key: Column, bounds: Column) -> Column:
    """How many of the bounds are at or under a key, by descent from `a1` through `a2` to `b`."""
    under = lambda x: F.size(F.filter(x, lambda y: y <= key))
    after = lambda above: F.greatest((above - 1) * _FAN, F.lit(0))
    first = under(bounds["a1"])
    second = after(first) + under(F.slice(bounds["a2"], after(first) + 1, _FAN))
    return after(second) + under(F.slice(bounds["b"], after(second) + 1, _FAN))


def successors(docs: DataFrame, id_col: str, text_col: str, rows_a_range: int = 256, most_ranges: int = 100_000) -> DataFrame:
    """Each document with the text of the next by descending id; after the last comes the first.

    Returns `bucket, rank, ghost, id_col, text_col, next_text`. Documents are cut by id and text hash into
    ranges of near equal numbers of rows (`range_bounds`), whatever the type of the id and wherever ids lie; the
    largest document of a range also goes to the next higher range, as a ghost behind its last row, so
    one shuffle of the texts by range suffices and no task holds more than a range. Rows that repeat
    an id are ordered by their text's hash; null ids come last."""
    key = F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
    bounds = constant(range_bounds(docs.select(key.alias("key")), rows_a_range, most_ranges))  # at most about `most_ranges` keys
    ranged = lambda rows: rows.withColumn("_own", range_of(F.col("_key"), bounds))
    rows = ranged(docs.select(F.col(id_col), F.col(text_col), key.alias("_key")))
    # One row for each range from here to the broadcast.
    tops = ranged(docs.select(key.alias("_key"))).groupBy("_own").agg(F.max("_key").alias("_top"))
    order = Window.orderBy("_own")
    tops = tops.select("_own", "_top", F.coalesce(F.lead("_own").over(order), F.first("_own").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_up"))
    up = F.when(F.col("_key").eqNullSafe(F.col("_top")), F.array("_own", "_up")).otherwise(F.array("_own"))
    placed = rows.join(F.broadcast(tops), "_own").select("*", F.posexplode(up).alias("_copy", "bucket")).withColumn("ghost", F.col("_copy") == 1)
    by = Window.partitionBy("bucket").orderBy("ghost", F.col("_key").desc())
    return placed.select("bucket", F.row_number().over(by).alias("rank"), "ghost", id_col, text_col, F.lead(text_col).over(by).alias("next_text"))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text, and compare it with that and with the next document.

    The edited text has its last floor(n / 3) code points replaced by the first as many (or all)
    of the next document by descending id. Returns `id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next`. Null texts count as empty; each repeated row is a
    document of its own; a lone document is its own next; an empty table gives an empty result;
    other columns are ignored. The texts are shuffled once; sums, fingerprints and comparisons
    all stay in that partitioning."""
    docs = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = successors(docs, id_col, "_t")
    n = F.length("_t")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.substring("_t", F.lit(1), n - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third)))
    both = rows.select("bucket", "rank", "ghost", id_col, "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), F.posexplode(F.when(F.col("ghost"), F.array("_t")).otherwise(F.array("_t", "_edited"))).alias("version", "_text"))
    keys = ["bucket", "rank", "version", "ghost", id_col, "n_chars", "edited_sha256"]
    made = sketch(both, keys, "_text")
    by = Window.partitionBy("bucket").orderBy("rank", "version")
    for name, ahead in (("edited", 1), ("next", 2)):
        made = made.withColumn(f"{name}_fingerprint", F.lead("fingerprint", ahead).over(by)).withColumn(f"_{name}", F.lead("signs", ahead).over(by))
    made = made.where("version = 0 and not ghost")
    near = lambda name: likeness(F.col("signs"), F.col(f"_{name}"), F.col("fingerprint") == F.col(f"{name}_fingerprint")).alias(f"near_{name}")
    return made.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited"), near("next"))
