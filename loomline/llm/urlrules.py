"""URL filter: stated rules first, association rules mined by FP-growth for the rest."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from .common import lean

_LABELS = ("block", "allow")
#: Rows of its label that a rule needs, however few there are: one or two urls are no association.
_LEAST = 3
#: Spark's FP-growth has no bound on the length of what it mines: a row gives it all 2 ** n combinations of its n
#: frequent tokens. It gets the rows of at most so many; what longer ones hold is grown to the length of a rule alone.
WIDTH = 8
#: Partial counts that a task holds before it gives them away.
_HELD = 200_000


def host_of(url) -> F.Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url) -> F.Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def stated(host: F.Column, path: F.Column, rules: list[tuple[str, str, str]]) -> tuple[F.Column, F.Column]:
    """Rule text and verdict of the longest fitting `(verdict, host, path)`; null where none fits.

    A rule fits its host and every subdomain if the url's path starts with the rule's."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer one is tested later and wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(host: F.Column, path: F.Column, url: F.Column) -> F.Column:
    """Distinct tokens of a url: host suffixes (those of over 127 labels, more than a name in the DNS has, by their
    hash, as written out they would grow with the square of the host), path segments (numbers by their first digit), query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    name = lambda whole, i: F.call_function("substring_index", whole, F.lit("."), -i)
    token = lambda whole, i: F.concat(F.lit("host:"), F.when(i > 127, F.concat(F.lit("#"), F.sha2(name(whole, i), 256))).otherwise(name(whole, i)))
    named = F.transform(F.array(F.array_join(labels, ".")), lambda whole: F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: token(whole, i)))
    suffixes = F.when(F.size(labels) > 0, named[0]).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("number:"), F.substring(x, 1, 1))).otherwise(F.concat(F.lit("path:"), x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, "^[^=]*", 0)))
    return F.array_distinct(F.concat(suffixes, segments, keys))


def general_hosts(rules: list[tuple[str, str, str]]) -> frozenset:
    """Tokens of the stated rules' hosts and of all above them: they tell which rule fits, not of a site."""
    return frozenset("host:" + ".".join(h.split(".")[i:]) for _, h, _ in rules for i in range(h.count(".") + 1))


def _frequent(rows: DataFrame, support: float) -> tuple[dict[str, int], DataFrame | None]:
    """The rows of each label that a token or combination needs, and the tokens that have them in one:
    `token, block, allow, rest, lo, hi, gain`.

    Rows are counted by label, `rest` without one; `lo` and `hi` are sums of a hash of the rows, so that
    tokens of the same rows, and no others, agree in all five; `gain` is the information gain on the label."""
    marked = _marked(rows)
    sizes = {r["label"]: r["n"] for r in rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    least = {what: max(_LEAST, math.ceil(support * sizes.get(what, 0))) for what in _LABELS}
    if not total:
        return least, None
    n = {what: F.sum(F.col("label").eqNullSafe(what).cast("long")) for what in _LABELS}
    seen = marked.select("label", "lo", "hi", F.explode("items").alias("token")).groupBy("token").agg(*(n[what].alias(what) for what in _LABELS), F.sum(F.col("label").isNull().cast("long")).alias("rest"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    own = F.col("block") + F.col("allow")
    plogp = lambda a, b: F.when((a > 0) & (b > 0), a * F.log2(a / F.nullif(b, F.lit(0)))).otherwise(0.0)
    inside, outside = F.lit(0.0), F.lit(0.0)
    for what in _LABELS:
        rest = F.lit(sizes.get(what, 0)) - F.col(what)
        inside, outside = inside + plogp(F.col(what), own), outside + plogp(rest, F.lit(total) - own)
    return least, seen.where(_enough(least)).withColumn("gain", F.round(inside + outside, 6))


def _enough(least: dict[str, int]) -> F.Column:
    return (F.col("block") >= least["block"]) | (F.col("allow") >= least["allow"])


def _marked(rows: DataFrame) -> DataFrame:
    """`items, label, lo, hi`: the rows with the halves of a hash of their tokens."""
    h = F.xxhash64("items")
    return rows.where(F.size("items") > 0).select("items", "label", h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"), F.shiftrightunsigned(h, 32).alias("hi"))


def vocabulary(rows: DataFrame, support: float) -> list[str]:
    """All tokens with the support of a label, those that tell most of the label by information gain first, ties by
    the token. Counted over all labelled rows."""
    seen = _frequent(rows, support)[1]
    return [] if seen is None else [r["token"] for r in seen.select("token", "gain").orderBy(F.desc("gain"), "token").collect()]


def _counts(rows: DataFrame, sets: list[frozenset]) -> dict[int, Counter]:
    """For each token set its urls by label (null among them), counted over all rows."""
    index = defaultdict(list)
    for k, items in enumerate(sets):
        index[max(items, key=lambda t: (t.startswith("host:"), len(t), t))].append(k)

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for items, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(items)
                seen.update((k, label) for token in own for k in index.get(token, ()) if sets[k] <= own)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int32()), pa.array([v for _, v in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["k", "label", "n"])

    out: dict[int, Counter] = defaultdict(Counter)
    for r in rows.select("items", "label").mapInArrow(lean(run), "k int, label string, n long").groupBy("k", "label").agg(F.sum("n").alias("n")).collect():
        out[r["k"]][r["label"]] = r["n"]
    return out


def _grown(rows: DataFrame, singles: list[tuple], roots: int, least: dict[str, int], longest: int, width: int) -> dict[tuple, tuple]:
    """Frequent combinations of 2 to `longest` tokens, the first one of the first `roots`, that some labelled row of
    more than `width` tokens holds, with their rows by label. `rows` are `items, label, lo, hi` of token numbers in
    order, `singles` each token's rows by label.

    Pattern growth, a token longer in each pass over all rows: a combination is counted where both that
    it joins are frequent. Tasks count in parts, which are summed by combination. A token that all rows of a
    combination hold already tells nothing more of them, and of tokens that the same rows of it
    hold the first stands for all; so copies of one long row grow no further."""
    counts: dict[tuple, tuple] = {(k,): n for k, n in enumerate(singles[:roots])}
    known: set[tuple] = set()
    for size in range(2, longest + 1):

        def joined(q: tuple, after: list[int]):
            if len(q) == size - 2:
                yield from (q + pair for pair in combinations(after, 2))
            else:
                for n, a in enumerate(after):
                    yield from joined((*q, a), [y for y in after[n + 1 :] if (*q, a, y) in known])

        def run(batches):
            held: dict[tuple, list[int]] = {}

            def given():
                columns = [pa.array([list(k) for k in held], pa.list_(pa.int32())), *(pa.array([x[i] for x in held.values()], pa.int64()) for i in range(6))]
                held.clear()
                return pa.RecordBatch.from_arrays(columns, names=["items", "block", "allow", "rest", "lo", "hi", "long"])

            for batch in batches:
                for items, label, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                    i, long = (_LABELS.index(label) if label in _LABELS else 2), int(label is not None and len(items) > width)
                    for n, a in enumerate(items):
                        if a >= roots:
                            break
                        after = items[n + 1 :]
                        for found in ((a, y) for y in after) if size == 2 else joined((a,), [y for y in after if (a, y) in known]):
                            x = held.get(found)
                            if x is None:
                                if len(held) >= _HELD:
                                    yield given()
                                x = held[found] = [0] * 6
                            x[i] += 1
                            x[3] += lo
                            x[4] += hi
                            x[5] |= long
            yield given()

        schema = "items array<int>, block long, allow long, rest long, lo long, hi long, long long"
        sums = rows.mapInArrow(lean(run), schema).groupBy("items").agg(*(F.sum(c).alias(c) for c in ("block", "allow", "rest", "lo", "hi")), F.max("long").alias("long"))
        new: dict[tuple, tuple] = {}
        for r in sums.where((F.col("long") > 0) & _enough(least)).collect():
            found, n = tuple(r["items"]), (r["block"], r["allow"], r["rest"])
            if n not in (counts.get(found[:-1]), counts.get(found[:-2] + found[-1:])):
                same = (found[:-1], *n, r["lo"], r["hi"])
                new[same] = min(new.get(same, (found, n)), (found, n))
        if not new:
            break
        counts.update(new.values())
        known |= {found for found, _ in new.values()}
    return {found: counts[found] for found in known}


def mine(rows: DataFrame, support: float = 0.01, confidence: float = 0.8, longest: int = 3, general: frozenset | None = None, width: int = WIDTH) -> list[tuple[frozenset, str, float]]:
    """Rules `(tokens, verdict, confidence)` from `(items, label)` rows; a null label votes for nothing.

    Rules are made of all combinations of at most `longest` tokens that hold a share of `support` of a label's
    rows (_LEAST rows at least), whatever their number and that of a row's tokens. Of tokens that occur in the
    same rows one stands for all (a host before others, then the shortest), as rules of any of them fit the
    same rows. Spark FP-growth mines each label's rows of at most `width` such tokens; what
    the longer ones hold is grown beside it (`_grown`). A combination in no longer row is frequent in the
    others, so nothing is lost between the two. Confidence is the verdict's share of the labelled rows with the
    tokens. Kept are confident rules whose tokens the labelled rows speak for, as at least half
    of all rows with them, and only where no rule with fewer of the same tokens and the same
    verdict is as confident. With `general` a rule needs a host token outside it that they speak
    for by itself, so that it tells of a site. What reaches the driver is bounded by `support`: the
    frequent combinations, of which a row of n tokens holds 2 ** n if short and n ** `longest` at most if longer."""
    least, seen = _frequent(rows, support)
    if seen is None:
        return []
    site = F.lit(False) if general is None else F.col("token").startswith("host:") & ~F.col("token").isin(*general)
    one = F.struct(~site, F.length("token"), "token")
    counted = ("block", "allow", "rest")
    found = seen.groupBy(*counted, "lo", "hi", "gain").agg(F.min_by("token", one).alias("token"), F.max(site).alias("site")).collect()
    # Roots come first, a host before those that end it, as it holds all that they tell.
    root = lambda r: general is None or r["site"] and 2 * (r["block"] + r["allow"]) >= r["block"] + r["allow"] + r["rest"]
    found.sort(key=lambda r: (not root(r), -r["token"].count(".") if r["site"] else 0, -len(r["token"]) if r["site"] else 0, -r["gain"], r["token"]))
    order = [r["token"] for r in found]
    rank = {token: k for k, token in enumerate(order)}
    if not rank:
        return []

    def narrow(batches):
        for batch in batches:
            own = [sorted(rank[t] for t in items if t in rank) for items in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), *batch.columns[1:]], names=["items", "label", "lo", "hi"])

    short = _marked(rows).mapInArrow(lean(narrow), "items array<int>, label string, lo long, hi long").where(F.size("items") > 0)
    told = short.where(F.col("label").isNotNull()).select("items", "label")
    n = {(r["label"], r["long"]): r["n"] for r in told.groupBy("label", (F.size("items") > width).alias("long")).agg(F.count("*").alias("n")).collect()}
    counts = {frozenset([r["token"]]): Counter({"block": r["block"], "allow": r["allow"], None: r["rest"]}) for r in found}
    roots = sum(map(root, found))
    if any(long for _, long in n):
        grown = _grown(short, [tuple(r[c] for c in counted) for r in found], roots, least, longest, width)
        counts |= {frozenset(order[k] for k in s): Counter(dict(zip((*_LABELS, None), c))) for s, c in grown.items()}
    sets: set[frozenset] = set()
    for label in _LABELS:
        have = n.get((label, False), 0)
        if have >= least[label]:
            own = told.where((F.col("label") == label) & (F.size("items") <= width)).select("items")
            mined = FPGrowth(itemsCol="items", minSupport=(least[label] - 0.5) / have).fit(own).freqItemsets.where(F.size("items") <= longest)
            sets |= {frozenset(order[k] for k in r["items"]) for r in mined.where(F.array_min("items") < roots).select("items").collect()}
    uncounted = sorted(sets - counts.keys(), key=sorted)
    if uncounted:
        more = _counts(rows, uncounted)
        counts |= {items: more[k] for k, items in enumerate(uncounted)}
    spoken = {items for items, n in counts.items() if 2 * sum(n[label] for label in _LABELS) >= n.total() > 0}
    out: list[tuple[frozenset, str, float]] = []
    kept: dict[frozenset, list[tuple[str, float]]] = defaultdict(list)
    for items in sorted(spoken, key=lambda s: (len(s), sorted(s))):
        if general is not None and not any(t.startswith("host:") and t not in general and frozenset([t]) in spoken for t in items):
            continue
        told = sum(counts[items][label] for label in _LABELS)
        for what in _LABELS:
            share = counts[items][what] / told
            fewer = (frozenset(c) for n in range(1, len(items)) for c in combinations(items, n))
            if share >= confidence and not any(w == what and c >= share for f in fewer for w, c in kept.get(f, ())):
                kept[items].append((what, share))
                out.append((items, what, share))
    return out


def matcher(rules: list[tuple[frozenset, str, float]], default: str):
    """Verdict of a token list: an inverted index from token to rules counts each rule's matched
    tokens; of the complete ones the most confident wins, then the longer, then `block`."""
    index = defaultdict(list)
    for k, (items, _, _) in enumerate(rules):
        for token in items:
            index[token].append(k)
    need = [len(items) for items, _, _ in rules]

    def verdict(found: list[str]) -> str:
        hits = Counter(k for token in found for k in index.get(token, ()))
        full = [(rules[k][2], need[k], rules[k][1] == "block", rules[k][1]) for k, n in hits.items() if n == need[k]]
        return max(full)[3] if full else default

    return verdict


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", support: float = 0.01, confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """Judge every url: `id_col, host, path, rule, verdict`.

    Urls that a stated rule fits take its verdict. FP-growth mines rules over host suffixes, path
    segments and query keys from these urls alone; urls that no rule fits only weigh against tokens
    that labelled ones do not speak for. Urls without a stated rule take the verdict of the mined
    rules, or `default` where none is complete. Null urls and urls without `://` have
    empty host and path and no rule; repeated rows are judged each; an empty table gives an empty
    result; other columns are ignored. Only frequent tokens, combinations and the mined rules, bounded by `support`, are broadcast."""
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    rule, verdict = stated(F.col("host"), F.col("path"), rules)
    parts = pages.select(F.col(id_col), url.alias("_url"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("verdict", verdict).withColumn("items", tokens(F.col("host"), F.col("path"), F.col("_url"))).drop("_url")
    decide = matcher(mine(parts.select("items", F.col("verdict").alias("label")), support, confidence, general=general_hosts(rules)), default)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            said = [v or decide(items) for v, items in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(said, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    return parts.mapInArrow(lean(run), f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
