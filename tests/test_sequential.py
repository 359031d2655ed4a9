"""Sequential operators against slow second forms and cases worked by hand."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from loomline.operators import sequential as sq


def cube(x):
    return x * x if x < 3 else x * x * x


class Node:
    """A stroke's end with its neighbours; every error is computed afresh."""

    def __init__(self, at, pos, before, scale, add, most):
        self.at, self.pos, self.new, self.before, self.after, self.most = at, pos, pos, before, None, most
        self.length = pos - before.pos if before else 0
        self.wanted = min(100.0, max(-100.0, self.length * scale + add))
        if before:
            before.after = self

    def speed(self, length):
        t = self.at - self.before.at if self.before else 0
        return 1000 * length / t if t else 0.0

    def error(self):
        length = self.new - self.before.new if self.before else 0
        old, now, miss = abs(self.speed(self.length)), abs(self.speed(length)), abs(self.wanted - length)
        e = miss + cube(int(miss) + 7)
        if self.most is not None and now > self.most:
            e += (now - self.most) * 300**3 + cube(int(miss))
        mid = (self.before.pos + self.pos) // 2 if self.before else None
        for half in (self.length > 0 and mid > 50, self.length < 0 and mid < 50):
            if old <= now or half:
                e += cube(abs(self.pos - self.new))
        return e

    def local(self):
        near = [self, self.before, self.before and self.before.before, self.after, self.after and self.after.after]
        return sum(x.error() for x in near if x)

    def nudge(self):
        now = self.local()
        for d in (1, -1):
            for group in ([self, self.before], [self]):
                if None in group or any(not 0 <= x.new + d <= 100 for x in group):
                    continue
                for x in group:
                    x.new += d
                if self.local() < now:
                    return True
                for x in group:
                    x.new -= d
        return False


def slow_limit(at, pos, scale, add, most):
    """Only for scripts whose strokes are single points."""
    nodes = []
    for t, p in zip(at, pos):
        nodes.append(Node(t, p, nodes[-1] if nodes else None, scale, add, most))
    for _ in range(100):
        if not any([x.nudge() for x in nodes]):
            break
    return [x.new for x in nodes]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(30, 900), st.integers(1, 60)), min_size=2, max_size=9), st.sampled_from([0.5, 1.0, 1.2, 2.0]), st.sampled_from([0, 5]), st.sampled_from([None, 80.0, 300.0]))
def test_speed_limit_equals_a_slow_form(steps, scale, add, most):
    at, pos, up = [0], [40], 1
    for t, d in steps:
        p = max(0, min(100, pos[-1] + up * d))
        if p == pos[-1]:
            up, p = -up, max(0, min(100, pos[-1] - up * d))
        at.append(at[-1] + t)
        pos.append(p)
        up = -1 if pos[-1] > pos[-2] else 1
    assert sq.limit_speed(at, pos, scale, add, most) == slow_limit(at, pos, scale, add, most)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(30, 900), st.integers(0, 10)), min_size=2, max_size=12), st.sampled_from([0.5, 1.2]), st.sampled_from([None, 100.0]))
def test_ends_of_strokes_of_any_script_equal_a_slow_form(points, scale, most):
    at, pos = [], []
    for t, p in points:
        at.append((at[-1] if at else 0) + t)
        pos.append(p * 10)
    runs = sq.strokes(pos)
    ends = slow_limit([at[z] for _, z in runs], [pos[z] for _, z in runs], scale, 0, most)
    new = sq.limit_speed(at, pos, scale, 0, most)
    # Points before the first move keep their positions, if there are several.
    assert [new[z] for a, z in runs if (a, z) != runs[0] or a == z] == [e for e, (a, z) in zip(ends, runs) if (a, z) != runs[0] or a == z]
    assert all(0 <= x <= 100 for x in new)


def test_strokes_and_points_within_them():
    assert sq.strokes([0, 50, 100, 100, 60, 60, 20, 80]) == [(0, 0), (1, 3), (4, 6), (7, 7)]
    assert sq.strokes([5, 5, 5]) == [(0, 2)] and sq.strokes([]) == []
    # Nothing to scale and no limit: all points stay, those of one stroke too.
    pos = [5, 5, 30, 60, 60, 10, 90]
    assert sq.limit_speed([i * 500 for i in range(7)], pos, 1.0, 0, None) == pos
    # A stroke of two equal steps that shrinks keeps them equal.
    new = sq.limit_speed([0, 1000, 2000, 4000], [0, 50, 100, 0], 1.0, 0, 30.0)
    assert new[1] == round((new[0] + new[2]) / 2) and max(abs(b - a) for a, b in zip(new[::2], new[2::2])) <= 62


def test_border_between_two_offsets():
    """b lacks a[40:60]: the border lies at 40 under the first offset, and the rest follows from 60."""
    a = np.random.default_rng(3).integers(0, 1000, 100).astype(float)
    b = np.r_[a[:40], a[60:]]
    assert sq.settle_borders(a, b, [[0, 10, 0], [70, 100, -20]]) == [[0, 40, 0], [60, 100, -20]]
    # Equal offsets are joined, and ties go to the larger block: of a flat signal the second takes all.
    assert sq.settle_borders(a, a, [[0, 10, 0], [50, 100, 0]]) == [[0, 100, 0]]
    flat = np.zeros(50)
    assert sq.settle_borders(flat, flat, [[0, 10, 0], [30, 45, 5]]) == [[0, 45, 0]]


def slow_cut(a, b, p, q):
    """Every share of the span tried from the longest first block on."""
    span = min(q[1] - p[0], q[1] + q[2] - p[0] - p[2])
    best = None
    for k in range(span, -1, -1):
        cost = sum(abs(a[p[0] + i] - b[p[0] + p[2] + i]) for i in range(k)) + sum(abs(a[q[1] - i] - b[q[1] + q[2] - i]) for i in range(1, span - k + 1))
        if best is None or cost < best[0] or cost == best[0] and max(k, span - k) > best[1]:
            best = cost, max(k, span - k), k
    return span, best[2]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 6), st.integers(-3, 3))
def test_border_equals_a_slow_form(seed, start, shift):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, 40).astype(float), rng.integers(0, 3, 40).astype(float)
    p, q = [start, start + 5, 0], [25, 34, shift or 1]
    span, k = slow_cut(a, b, p, q)
    got = sq.settle_borders(a, b, [p, q])
    want = [[q[1] - span, q[1], q[2]]] if k == 0 else [[p[0], p[0] + k, 0], *([[q[1] - span + k, q[1], q[2]]] if k < span else [])]
    assert got == want


def test_least_error_ties_go_to_the_middle():
    """Every place of a flat signal is as good: the peak pair nearest the middle of the section wins."""
    flat = np.zeros(4000)
    i, j = sq.least_error_peaks(flat, flat, (0, 4000), (0, 4000), 20, 200, 5)
    peaks = [p for p in sq.section_peaks(flat, 0, 4000, 20, 5) if p + 200 <= 4000]
    assert i == min(peaks, key=lambda p: (abs(2000 - (2 * p + 200) // 2), p)) and j == 0


@pytest.mark.parametrize("cut", [(700, 1100), (1500, 1500), (0, 900)])
def test_alignment_finds_what_was_cut_and_put_in(cut):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1000, 4000).astype(float)
    b = np.r_[a[: cut[0]], rng.integers(0, 1000, 300), a[cut[1] :]]
    got = sq.align(a, b, 20, least_seconds=20)
    assert got[0][0] == 0 and got[-1][1] == 4000 and all(x[1] == y[0] for x, y in zip(got, got[1:]))
    shift = 300 - (cut[1] - cut[0])
    # Right but for a stretch beside the cut, over which a block may grow to the end of a signal.
    for place, want in [*((p, 0) for p in range(0, cut[0] - 400, 50)), *((p, shift) for p in range(cut[1] + 400, 4000, 50))]:
        assert [o for s, e, o in got if s <= place < e] == [want]
