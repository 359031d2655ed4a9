"""Generated actions against a slow form, batch jobs, files that are moved."""

import os

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from loomline.operators import requests as rq, virtual as vi
from loomline.sources import listing as ls


def slow_place(at, pos, old, frame, top, bottom, low, high, filled, extra, centre):
    """The four steps one after the other, on one list of points."""
    tops = []
    for i in range(len(at)):
        tops.append((pos[0] > pos[1] if len(pos) > 1 else False) if i == 0 else tops[-1] if pos[i] == pos[i - 1] else pos[i] > pos[i - 1])
    t, p = [a + frame * (top if x else bottom) for a, x in zip(at, tops)], list(pos)
    for i in range(1, len(t)):
        k = i
        while k > 0 and t[k - 1] >= t[k] - frame / 2:
            t[k - 1] = t[k] - frame
            k -= 1
    full, last = high - low, pos[0]
    for i in range(1, len(p)):
        now, d = pos[i], abs(last - pos[i])
        if d > 0:
            size = (filled * full / 100 + d * (100 - filled) * full / 100 / 100) * (1 + extra / 100)
            a, b = low, high
            if full - size > 0:
                a = low + (full - size) * centre / 100
                b = a + size
            p[i - 1], p[i] = (a, b) if last < now else (b, a)
            last = now
    start = min(old, key=lambda x: (abs(x - at[0]), x), default=0.0)
    end = min((x for x in old if x > at[0] + frame / 2), default=1e7)
    return [(i, t[i], p[i]) for i in range(len(t)) if start < t[i] < end and not any(abs(x - t[i]) < frame / 2 for x in old)]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 20), st.integers(0, 10)), min_size=1, max_size=8), st.lists(st.integers(0, 120), max_size=4), st.integers(-2, 2), st.integers(-2, 2), st.sampled_from([0, 20, 60]), st.sampled_from([0, 30]), st.sampled_from([0, 50, 100])
)
def test_placed_actions_equal_a_slow_form(steps, old, top, bottom, filled, extra, centre):
    at, pos = [], []
    for d, p in steps:
        at.append((at[-1] if at else 10.0) + d)
        pos.append(p * 10.0)
    settings_ = {"top": top, "bottom": bottom, "low": 10, "high": 90, "filled": filled, "extra": extra, "centre": centre}
    got, want = vi.placed(at, pos, [float(x) for x in old], 4.0, **settings_), slow_place(at, pos, [float(x) for x in old], 4.0, **settings_)
    assert [i for i, *_ in got] == [i for i, *_ in want]
    assert all(a[1:] == pytest.approx(b[1:]) for a, b in zip(got, want))


class Job:
    """A batch engine that fails some polls and ends after some."""

    def __init__(self, fails, ends):
        self.fails, self.ends, self.polls, self.cancelled = fails, ends, 0, False

    def poll(self, job):
        self.polls += 1
        if self.polls <= self.fails:
            raise rq.Unavailable()
        return self.polls >= self.ends

    def cancel(self, job):
        self.cancelled = True

    def run(self, **more):
        now = iter(range(0, 10**6, 10))
        return rq.batch_answers([1, 2], list, self.poll, lambda job: [x * 2 for x in job], self.cancel, sleep=lambda s: None, clock=lambda: next(now), **more)


def test_batches_end_fail_and_time_out():
    assert Job(2, 6).run() == [2, 4]
    for job, more in ((Job(99, 100), {"errors": 3}), (Job(0, 10**6), {"longest": 200})):
        with pytest.raises(rq.Unavailable):
            job.run(**more)
        assert job.cancelled
    assert rq.batch_answers([], None, None, None, None) == []


@pytest.mark.parametrize("pause", [0, 5])
def test_a_failure_between_clock_and_check_skips_no_other_call(pause):
    """Another call fails while the first one reads the clock: its engine is still asked."""
    now, other = [0], []

    def clock():
        now[0] += 1
        t = now[0]
        if not other:
            other.append("started")
            other.append(engines("error"))
        return t

    def first(x):
        if x.startswith("e"):
            raise rq.Unavailable(pause=pause)
        return x.upper()

    engines = rq.Failover([first, lambda x: x[::-1]], clock=clock)
    assert engines("view") == "VIEW" and other[1] == "rorre"
    assert engines("view") == ("weiv" if pause else "VIEW")  # a pause holds from then on


def test_nulls_are_not_sent():
    out = list(rq.answered(lambda: str.upper, "x", "y")(iter([pd.DataFrame({"x": ["a", None, "b"]}), pd.DataFrame({"x": [None]}, dtype=object)])))
    assert [o.y.tolist() for o in out] == [["A", None, "B"], [None]]


def test_files_are_moved_whole(spark, tmp_path):
    for n in (3, 5):
        ls.save_replacing(spark.range(n), f"{tmp_path}/t")
        assert spark.read.parquet(f"{tmp_path}/t").count() == n and not os.path.exists(f"{tmp_path}/t.tmp")
    for _ in range(2):
        (tmp_path / "a.srt").write_text("x")
        aside = ls.soft_delete(spark, str(tmp_path / "a.srt"))
        assert aside == str(tmp_path / "a.2d711642b726.srt") and os.listdir(tmp_path).count("a.2d711642b726.srt") == 1 and not (tmp_path / "a.srt").exists()
    assert ls.soft_delete(spark, str(tmp_path / "none")) is None
    for name in ("v1.mp4", "v2.mp4", "w.txt"):
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / name).write_text("x")
    assert ls.listing(spark, str(tmp_path / "sub"), "*.mp4").count() == 2 and ls.listing(spark, str(tmp_path), "*.mp4", recursive=True, skip_folder="ub").count() == 0
