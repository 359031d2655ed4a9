"""Text and metadata rules as column expressions, and the few that need plain Python."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

# The mark of a line that a person should look at, and where a long line may be cut,
# in order of preference: pattern, and whether the cut is before it.
REVIEW = "[!REVIEW]"
CUTS = (("[,.?!。、！:？-]+", False), (r"\b(?:and|but|or)\b", True), (r"\s", True))


def rewrite(value: Column, generic: tuple[str, str] | None, specific: tuple[str, str] | None) -> Column:
    """Apply the generic rule if there is one, else the specific one: ignoring case, line by line."""
    rule = generic or specific
    return F.regexp_replace(value, f"(?im){rule[0]}", rule[1]) if rule else value


def ignored_by(value: Column, patterns: list[tuple[str, str]]) -> Column:
    """Name of the first pattern that matches the whole value, ignoring case; null if none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        out = F.when(value.rlike(f"(?i)^({pattern})$"), F.lit(name)).otherwise(out)
    return out


def respects(metadata: Column, rules: str | None) -> Column:
    """Whether metadata meets a comma list: `!name` must be absent, any other entry must match some
    key, unanchored and ignoring case. An empty list isn't respected."""
    names = [r.strip() for r in (rules or "").split(",") if r.strip()]
    out = F.lit(bool(names))
    for r in names:
        keys = F.map_keys(metadata)
        out = out & (~F.array_contains(keys, r[1:]) if r[0] == "!" else F.exists(keys, _matches(r)))
    return out


def _matches(pattern: str):
    return lambda key: key.rlike(f"(?i){pattern}")


def rename_keys(metadata: Column, generic: dict[str, str | None], specific: dict[str, str | None]) -> Column:
    """Rename keys by the generic table, else the specific one; a name mapped to null drops the key."""
    table = {**specific, **generic}
    gone = [k for k, v in table.items() if v is None]
    kept = F.map_filter(metadata, lambda k, v: ~k.isin(gone)) if gone else metadata
    renamed = {k: v for k, v in table.items() if v is not None}
    if not renamed:
        return kept
    names = F.create_map(*(F.lit(x) for pair in renamed.items() for x in pair))
    return F.transform_keys(kept, lambda k, v: F.coalesce(names[k], k))


def merge_maps(*maps: Column) -> Column:
    """Merge maps with keys compared without case; a later map wins. Keys come out in lower case."""
    entries = F.flatten(F.array(*(F.map_entries(m) for m in maps)))
    lower = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.aggregate(lower, F.filter(lower, lambda e: F.lit(False)), lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(last)


def find_metadata(text: Column, name: str) -> Column:
    """Value of the last `{name}` or `{name: value}` in a text, ignoring case; empty for a bare name, null if absent."""
    hits = F.regexp_extract_all(text, F.lit(rf"(?i)\{{\s*({re.escape(name)}\s*(?::[^}}]*)?)\}}"), F.lit(1))
    last = F.element_at(hits, -1)
    return F.when(F.size(hits) > 0, F.trim(F.regexp_replace(last, r"^[^:]*:?", "")))


def tempo_chain(speed: float, low: float = 0.5, high: float = 100.0) -> list[float]:
    """Factors within `[low, high]` whose product is the speed; 1 for a speed that isn't positive."""
    if not speed > 0:
        return [1.0]
    out = []
    while speed > high:
        out.append(high)
        speed /= high
    while speed < low:
        out.append(low)
        speed /= low
    return [*out, speed]


def tempo_steps(speed: Column) -> Column:
    """How many limiting factors a speed needs before its last one."""
    up, down = F.ceil(F.log10(speed) / 2) - 1, F.ceil(-F.log2(speed)) - 1
    return F.when(speed > 100, up).when((speed > 0) & (speed < 0.5), down).otherwise(0).cast("long")


def break_line(text: str, most: int = 50, cuts=CUTS) -> str:
    """Break a text at the permitted cut nearest to its middle so that both lines fit, by order of
    the cut patterns; without any the text is flagged for review."""
    lo, hi = sorted((max(0, len(text) - most), min(len(text), most)))
    middle = len(text) // 2
    for pattern, before in cuts:
        at = [m.start() if before else m.end() for m in re.finditer(pattern, text)]
        at = [p for p in at if lo <= p <= hi]
        if at:
            p = min(at, key=lambda p: abs(p - middle))
            return text[:p].strip() + "\n" + text[p:].strip()
    return text + REVIEW


def fit_line(text: str, most: int = 50, review: bool = True) -> str:
    """A text that is short or already broken stays; another is broken, and flagged if over twice too long."""
    if len(text) <= most or "\n" in text:
        return text
    out = break_line(text, most)
    return out + REVIEW if review and len(text) > 2 * most and REVIEW not in out else out


def merged_text(a: dict, b: dict, most: int = 50, gap_same: int = 1000, gap_other: int = 1200, longest: int = 6000) -> str | None:
    """Text of two neighbours shown together: lines of one speaker, or a dialogue; null if they may not be merged."""
    same = (a["speaker"] or "undefined").lower() == (b["speaker"] or "undefined").lower()
    room = most if same else most - 2
    if b["s"] - a["e"] >= (gap_same if same else gap_other) or b["e"] - a["s"] >= longest or max(len(a["text"]), len(b["text"])) > room:
        return None
    return f"{a['text']}\n{b['text']}" if same else f"- {a['text']}\n- {b['text']}"


# HTTP codes and words by which errors of engines are told apart.
QUOTA_CODES, DOWN_CODES = (402, 429), (500, 502, 503, 504)
QUOTA_WORDS = "rate limit|rate_limit|quota|exceeded|too many requests|billing|credit|limit reached"
DOWN_WORDS = "service unavailable|temporarily unavailable|overloaded|capacity|server error"


def classify_error(code: Column, message: Column) -> Column:
    """`quota`, `unavailable` or `other` from an HTTP code, else from words of a message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    by_words = F.when(low.rlike(QUOTA_WORDS), "quota").when(low.rlike(DOWN_WORDS), "unavailable").otherwise("other")
    return F.when(code.isin(*QUOTA_CODES), "quota").when(code.isin(*DOWN_CODES), "unavailable").otherwise(by_words)


def tokens_estimate(modality: Column, units: Column) -> Column:
    """Tokens by modality: text characters / 3.5, audio seconds * 32, images * 120."""
    return F.when(modality == "text", units / 3.5).when(modality == "audio", units * 32.0).when(modality == "image", units * 120.0)


def cost_of(tokens: Column, rate: Column, saving: Column | float = 1.0) -> Column:
    """Price of tokens at a rate for a million."""
    return tokens / 1e6 * rate * saving


def escape_drawtext(text: Column) -> Column:
    """Backslash, quote, colon and percent sign each with a backslash before it."""
    return F.regexp_replace(text, r"([\\':%])", r"\\$1")


def language_tag(name: Column) -> Column:
    """The two letters of `[xx]` in a name, in lower case; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(name, r"\[([a-zA-Z]{2})\]", 1), F.lit("")))


def common_affixes(first: str, last: str) -> tuple[str, str]:
    """Common prefix and suffix of two names, not overlapping in the shorter one."""
    n = 0
    while n < min(len(first), len(last)) and first[n] == last[n]:
        n += 1
    k = 0
    while k < min(len(first), len(last)) - n and first[-1 - k] == last[-1 - k]:
        k += 1
    return first[:n], first[len(first) - k :]


def repair_json(text: str) -> list:
    """Objects of an answer that should be a JSON array.

    Thinking and quoted lines go, what precedes the first bracket goes, quotes inside a string
    are escaped where no delimiter follows them, missing commas between objects are added, and a
    tail after the last whole object is cut. Returns an empty list if no object is whole."""
    text = re.sub(r"<think>.*</think>", "", text)
    text = re.sub(r"(?m)^\s*>.*$", "", text)
    text = text[text.find("[") + 1 :] if "[" in text else text
    objects, depth, start, out, i = [], 0, -1, [], 0
    while i < len(text):
        c = text[i]
        if c == '"':
            j, body = i + 1, []
            while j < len(text):
                if text[j] == "\\" and j + 1 < len(text):
                    body.append(text[j : j + 2])
                    j += 2
                elif text[j] == '"':
                    rest = text[j + 1 :].lstrip()
                    if not rest or rest[0] in ",}]:":
                        break
                    body.append('\\"')
                    j += 1
                else:
                    body.append(text[j])
                    j += 1
            out.append('"' + "".join(body) + '"')
            i = j + 1
            continue
        if c == "{":
            if depth == 0:
                out, start = [], i
            depth += 1
        out.append(c)
        if c == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    objects.append(json.loads("".join(out), strict=False))
                except ValueError:
                    pass
                out = []
        i += 1
    return objects
