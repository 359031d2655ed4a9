"""Hybrid configuration text: JSON with comment lines and fenced long strings; and time notes in answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

_FENCE = re.compile(r"```\n?(.*?)\n?```", re.S)


def read_config(text: str):
    """Parse JSON after removing lines that start with `//` and turning fenced blocks into strings."""
    text = re.sub(r"(?m)^\s*//.*$\n?", "", text)
    return json.loads(_FENCE.sub(lambda m: json.dumps(m[1]), text))


def flat_config(text: str) -> dict[str, str]:
    """A flat configuration whose names are compared without case."""
    return {k.lower(): str(v) for k, v in read_config(text).items()}


_TIME = r'"(?:StartTime|EndTime)":\s*"[^"]*"'


def annotate_times(answer: Column, place: Callable[[Column], Column]) -> Column:
    """Add what `place(time text)` gives, in brackets, to each start and end time of an answer; a time for
    which it gives null stays as it is."""
    hits = F.regexp_extract_all(answer, F.lit(_TIME), F.lit(0))

    def noted(hit: Column) -> Column:
        where = place(F.regexp_extract(hit, r':\s*"([^"]*)"$', 1))
        return F.when(where.isNull(), hit).otherwise(F.concat(F.substring(hit, F.lit(1), F.length(hit) - 1), F.lit(" ["), where, F.lit(']"')))

    pieces = F.split(answer, _TIME, -1)
    return F.array_join(F.transform(pieces, lambda x, i: F.concat(x, F.when(i < F.size(hits), noted(F.get(hits, i))).otherwise(""))), "")
