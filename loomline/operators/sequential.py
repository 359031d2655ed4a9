"""Operators that are inherently sequential: pure functions on one group's ordered rows.

Each takes and returns plain lists, so it runs in `applyInPandas` per group and in tests alike. A
group is one script, document or pair of signals: bounded by its nature, not by the input."""

from __future__ import annotations

import numpy as np


def suppressed_peaks(index: list[int], rise: list[float], k: int, spacing: int) -> list[int]:
    """Up to k indices of largest rise, greedily, each at least `spacing` from those taken; ties by index."""
    taken: list[int] = []
    for i in sorted(range(len(index)), key=lambda i: (-rise[i], index[i])):
        if all(abs(index[i] - t) >= spacing for t in taken):
            taken.append(index[i])
            if len(taken) == k:
                break
    return sorted(taken)


def peak_settings(length: int, rate: int, per_minute: int) -> tuple[int, int]:
    """How many peaks a minute, and their spacing, for a section of that many samples."""
    minutes = length // (rate * 60) + 1
    return (per_minute, rate) if minutes > 15 else (2 * per_minute, rate // 2) if minutes >= 3 else (3 * per_minute, rate // 3)


def section_peaks(x: np.ndarray, start: int, length: int, rate: int, per_minute: int) -> list[int]:
    """Peaks of a section, relative to its start, minute by minute of the whole signal."""
    k, spacing = peak_settings(length, rate, per_minute)
    rise = np.diff(x, prepend=x[:1]) if rate >= 20 else np.zeros(len(x))
    out: list[int] = []
    at = np.arange(start, start + length)
    for minute in np.unique(at // (rate * 60)):
        own = at[at // (rate * 60) == minute]
        out += suppressed_peaks(own.tolist(), rise[own].tolist(), k, spacing)
    return [i - start for i in sorted(out)]


def pad_and_split(spans: list[tuple[int, int]], before: int, after: int) -> list[tuple[int, int]]:
    """Pad intervals, then part overlapping neighbours at the middle of their overlap, in order, each
    against its already changed predecessor."""
    out = [[s - before, e + after] for s, e in spans]
    for a, b in zip(out, out[1:]):
        if a[1] > b[0]:
            middle = b[0] + (a[1] - b[0]) // 2
            a[1] = b[0] = middle
    return [tuple(x) for x in out]


def merge_pairs(rows: list[dict], merged) -> list[dict]:
    """Greedy merging of neighbours: candidates ranked by same speaker first, then the shorter text,
    then position; a pair is merged if both are still free and `merged` gives a text."""
    ranked = []
    for i, (a, b) in enumerate(zip(rows, rows[1:])):
        text = merged(a, b)
        if text is not None and "\n" not in a["text"] and "\n" not in b["text"]:
            ranked.append(((a["speaker"] or "").lower() != (b["speaker"] or "").lower(), len(a["text"]) + len(b["text"]), i, text))
    free, into = [True] * len(rows), {}
    for _, _, i, text in sorted(ranked):
        if free[i] and free[i + 1]:
            free[i] = free[i + 1] = False
            into[i] = text
    out, skip = [], False
    for i, r in enumerate(rows):
        if skip:
            skip = False
        elif i in into:
            out.append({**r, "text": into[i], "e": rows[i + 1]["e"]})
            skip = True
        else:
            out.append(dict(r))
    return out


def assign_words(words: list[tuple[int, int, str]], timings: list[tuple[int, int]]) -> list[int]:
    """The timing of each word of one item: none overlaps, the nearest middle; one, that; several, the
    one covered most, then by the word's share. A word that ends in punctuation stays with the word
    before it, and then the next one prefers what comes later."""
    out: list[int] = []
    stuck = False
    for s, e, text in words:
        if out and text.endswith((",", "、", ".", "。", "?", "!")):
            out.append(out[-1])
            stuck = True
            continue
        over = []
        for i, (ts, te) in enumerate(timings):
            n = min(e, te) - max(s, ts)
            if n > 0 and e > s and te > ts:
                over.append((n / (te - ts), n / (e - s), i))
        middle = s + (e - s) // 2
        if over:
            best = over[-1][2] if stuck and len(over) > 1 else min(over, key=lambda o: (-o[0], -o[1], o[2]))[2]
        else:
            near = [(abs(ts + (te - ts) // 2 - middle), i) for i, (ts, te) in enumerate(timings) if not stuck or ts + (te - ts) // 2 > middle]
            best = min(near)[1] if near else len(timings) - 1
        out.append(best)
        stuck = False
    return out


#: What a speed over the limit costs, beside which all other errors are small.
_OVER_LIMIT = 27_000_000


def _steep(error: int) -> int:
    """The weight of an error in whole units: its square under 3, its cube from there."""
    return error * error if error < 3 else error**3


def strokes(pos: list[int]) -> list[tuple[int, int]]:
    """Runs of points `(first, last)` that move one way; a point that stays where it is belongs to
    the run before it. Points before the first move are a run of their own."""
    out, way = [[0, 0]] if pos else [], 0
    for i in range(1, len(pos)):
        step = (pos[i] > pos[i - 1]) - (pos[i] < pos[i - 1])
        if step in (0, way):
            out[-1][1] = i
        else:
            out.append([i, i])
            way = step
    return [tuple(x) for x in out]


def limit_speed(at: list[int], pos: list[int], scale: float, add: float, most: float | None, sweeps: int = 100) -> list[int]:
    """Positions of a script whose strokes are scaled under a speed limit, by nudging ends of strokes.

    A stroke (`strokes`) is one node, at its last point. Wanted is its distance times `scale` plus
    `add`, within 100 either way. Its error is the steep weight of the missed distance and seven, and
    that distance; the steep weight of how far its end moved, twice where it got no slower, once where
    it got slower and its middle lies in the half that it runs into; and, over the limit `most`, the speed's
    excess times _OVER_LIMIT and the steep weight of the missed distance. In order, each node tries one
    unit up with its predecessor, up alone, down with its predecessor, down alone, and keeps the
    first that lowers the summed error of itself and two nodes on either side; sweeps end when none
    moved. Points within a stroke are put in proportion, halves to even, within 0 to 100; those before
    the first move keep their positions."""
    runs = strokes(pos)
    n = len(runs)
    end = [pos[last] for _, last in runs]
    time = [at[last] for _, last in runs]
    new = list(end)
    wanted, speed, pulled = [max(-100.0, min(100.0, float(add)))] + [0.0] * (n - 1), [0.0] * n, [0] * n
    for k in range(1, n):
        d, t = end[k] - end[k - 1], time[k] - time[k - 1]
        wanted[k] = max(-100.0, min(100.0, d * scale + add))
        speed[k] = 1000.0 * d / t if t else 0.0
        middle = (end[k - 1] + end[k]) // 2
        pulled[k] = int(d > 0 and middle > 50 or d < 0 and middle < 50)

    def error(k: int) -> float:
        d = new[k] - new[k - 1] if k else 0
        t = time[k] - time[k - 1] if k else 0
        now = 1000.0 * d / t if t else 0.0
        missed, moved = abs(wanted[k] - d), _steep(abs(end[k] - new[k]))
        out = (abs(now) - most) * _OVER_LIMIT + _steep(int(missed)) if most is not None and abs(now) > most else 0.0
        return out + moved * (2 if abs(speed[k]) <= abs(now) else pulled[k]) + _steep(int(missed) + 7) + missed

    errors = [error(k) for k in range(n)]

    def around(k: int) -> float:
        return sum(errors[max(0, k - 2) : k + 3])

    def nudged(k: int) -> bool:
        before = around(k)
        for step in (1, -1):
            for first in (k - 1, k) if k else (k,):
                if any(not 0 <= new[j] + step <= 100 for j in range(first, k + 1)):
                    continue
                touched = range(first, min(k + 2, n))
                kept = errors[first : k + 2]
                for j in range(first, k + 1):
                    new[j] += step
                for j in touched:
                    errors[j] = error(j)
                if around(k) < before:
                    return True
                for j in range(first, k + 1):
                    new[j] -= step
                errors[first : k + 2] = kept
        return False

    for _ in range(sweeps):
        if not sum([nudged(k) for k in range(n)]):
            break
    out: list[int] = []
    for k, (first, last) in enumerate(runs):
        a, b = (end[k - 1], new[k - 1]) if k else (pos[first], pos[first])
        if first == last:
            out.append(new[k])
        elif end[k] == a:
            out += pos[first : last + 1]
        else:
            out += [max(0, min(100, round(b + (pos[i] - a) / (end[k] - a) * (new[k] - b)))) for i in range(first, last + 1)]
    return out


def least_error_peaks(a: np.ndarray, b: np.ndarray, section_a: tuple[int, int], section_b: tuple[int, int], rate: int, least: int, per_minute: int) -> tuple[int, int] | None:
    """The pair of peaks of two sections, as places in the signals, from which on `least` samples differ
    least in all; ties to that nearest the middle of a's section, then the earlier. None without one."""
    (a0, a1), (b0, b1) = section_a, section_b
    starts = [a0 + i for i in section_peaks(a, a0, a1 - a0, rate, per_minute) if a0 + i + least <= a1]
    others = [b0 + j for j in section_peaks(b, b0, b1 - b0, rate, per_minute) if b0 + j + least <= b1]
    if not starts or not others:
        return None
    windows = np.stack([b[j : j + least] for j in others])
    middle = (a0 + a1) // 2
    _, _, k, i = min((e, abs(middle - (2 * i + least) // 2), k * len(others) + j, i) for k, i in enumerate(starts) for j, e in enumerate(np.abs(windows - a[i : i + least]).sum(1)))
    return i, others[k % len(others)]


def align(a: np.ndarray, b: np.ndarray, rate: int, least_seconds: float = 60, per_minute: int = 5) -> list[tuple[int, int, int | None]]:
    """Stretches `(start, end, offset)` that partition signal a: where they are in b, or None.

    Sections are matched at the pair of peaks of least error over the shortest allowed stretch, refined
    by up to three samples, then what lies left and right of it is matched in turn. The first and the
    last match grow to the ends of a signal, borders are settled (`settle_borders`), and the ends
    grow again. Signals without a match give one stretch without an offset."""
    least = int(least_seconds * rate)
    a, b = np.asarray(a, float), np.asarray(b, float)
    found: list[list[int]] = []
    todo = [((0, len(a)), (0, len(b)))]
    while todo:
        own, other = todo.pop()
        if min(own[1] - own[0], other[1] - other[0]) < least:
            continue
        best = least_error_peaks(a, b, own, other, rate, least, per_minute)
        if best is None:
            continue
        i, j = best
        near = [j, *(j + step for step in (-3, -2, -1, 1, 2, 3) if 0 <= j + step <= len(b) - least)]
        errors = [float(np.abs(a[i : i + least] - b[k : k + least]).sum()) for k in near]
        j = near[errors.index(min(errors))]
        found.append([i, i + least, j - i])
        todo += [((own[0], i), (other[0], j)), ((i + least, own[1]), (j + least, other[1]))]
    if not found:
        return [(0, len(a), None)]

    def grow(blocks: list[list[int]]) -> None:
        blocks[0][0] -= min(blocks[0][0], blocks[0][0] + blocks[0][2])
        blocks[-1][1] += min(len(a) - blocks[-1][1], len(b) - blocks[-1][1] - blocks[-1][2])

    blocks = sorted(found)
    grow(blocks)
    blocks = settle_borders(a, b, blocks)
    grow(blocks)
    result, at = [], 0
    for s, e, off in blocks:
        if s > at:
            result.append((at, s, None))
        result.append((s, e, off))
        at = e
    return [*result, *([(at, len(a), None)] if at < len(a) else [])]


def settle_borders(a: np.ndarray, b: np.ndarray, blocks: list[list[int]]) -> list[list[int]]:
    """Blocks `[start, end, offset]` with the border of each two neighbours where they cost least in all.

    What two neighbours span, in the signal where it is shorter, is shared out: its first samples to
    the first block from its start, the others to the second up to its end. Ties go to the larger
    block, then to the longer first one. A block that gets nothing, or whose offset the next one has,
    is joined to it, and then all borders are settled again."""
    joined = True
    while joined:
        joined, out, last = False, [], list(blocks[0])
        for block in blocks[1:]:
            s, p, e, q = last[0], last[2], block[1], block[2]
            span = min(e - s, e + q - s - p)
            head = np.abs(a[s : s + span] - b[s + p : s + p + span])
            tail = np.abs(a[e - span : e] - b[e - span + q : e + q])
            cost = np.r_[0.0, np.cumsum(head)] + np.r_[np.cumsum(tail[::-1])[::-1], 0.0]
            keep = np.arange(span + 1)
            first = int(np.lexsort((-keep, -np.maximum(keep, span - keep), cost))[0])
            if first == 0 or p == q:
                joined, last = True, [e - span, e, q]
            else:
                out.append([s, s + first, p])
                last = [e - span + first, e, q]
        if last[1] > last[0]:
            out.append(last)
        blocks = out
    return blocks
