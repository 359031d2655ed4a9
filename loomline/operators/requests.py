"""Calls to outside engines from executors: bounded concurrency, retries, fail-over; and chunked scans."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


class Unavailable(Exception):
    """An engine can't answer for now; `pause` seconds should pass before it is tried again."""

    def __init__(self, message: str = "", pause: float = 120.0):
        super().__init__(message)
        self.pause = pause


def with_retry(call: Callable, attempts: int = 3, first_wait: float = 1.0, sleep: Callable = time.sleep) -> Callable:
    """The call, tried again after waits that double; the last failure is raised."""

    def run(x):
        for n in range(attempts):
            try:
                return call(x)
            except Unavailable:
                if n + 1 == attempts:
                    raise
                sleep(first_wait * 2**n)

    return run


class Failover:
    """Engines in order of preference; one that is unavailable is skipped until its pause is over. One without a
    pause is never skipped, whatever calls in other threads run into."""

    def __init__(self, engines: list[Callable], clock: Callable = time.monotonic):
        self.engines, self.clock, self.skip_until = engines, clock, [0.0] * len(engines)

    def __call__(self, x):
        last: Exception = Unavailable("every engine is paused")
        for i, engine in enumerate(self.engines):
            until = self.skip_until[i]  # read before the clock: another call may set it between the two
            if self.clock() < until:
                continue
            try:
                return engine(x)
            except Unavailable as e:
                last = e
                if e.pause > 0:
                    self.skip_until[i] = self.clock() + e.pause
        raise last


def answered(make: Callable[[], Callable], column: str, out: str, in_flight: int = 5) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For `mapInPandas`: rows with the engine's answer, at most `in_flight` calls at once, consumed
    oldest first. At the first failure the answers before it are kept and the rest stay null. A null is
    not sent and has no answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                answers, failed = [], False
                for f in [None if pd.isna(x) else pool.submit(call, x) for x in batch[column]]:
                    try:
                        answers.append(None if failed or f is None else f.result())
                    except Unavailable:
                        failed = True
                        answers.append(None)
                yield batch.assign(**{out: answers})

    return run


#: Events of an answer's stream: what kind, and the pieces of the answer and of the thoughts behind it.
EVENT = "type string, delta struct<text: string, thinking: string>"


def accumulate(lines: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """Answers from the lines of event streams: `by, answer, thoughts, done`.

    An empty line sends the last `data: ` line since the one before it; events of type
    `content_block_delta` add their text to the answer or the thoughts, `message_stop` ends the
    stream, others and broken ones tell nothing. One window over a stream's lines, then one sum."""
    w = Window.partitionBy(*by).orderBy(order)
    sent = lines.withColumn("_data", F.when(F.col(line).startswith("data: "), F.trim(F.substring(F.col(line), F.lit(7), F.length(line)))))
    sent = sent.withColumn("_n", F.coalesce(F.sum(F.when(F.col(line) == "", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    events = sent.groupBy(*by, "_n").agg(F.max_by("_data", F.when(F.col("_data").isNotNull(), F.col(order))).alias("_data"), F.bool_or(F.col(line) == "").alias("_sent")).where("_sent and _data is not null")
    e = events.select(*by, "_n", F.from_json("_data", EVENT).alias("_e"))
    piece = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("_e.type") == "content_block_delta") & F.col(f"_e.delta.{name}").isNotNull(), F.struct("_n", F.col(f"_e.delta.{name}").alias("_t"))))), lambda x: x["_t"]), "")
    return e.groupBy(*by).agg(piece("text").alias("answer"), piece("thinking").alias("thoughts"), F.coalesce(F.bool_or(F.col("_e.type") == "message_stop"), F.lit(False)).alias("done"))


def batch_answers(requests: list, submit: Callable, poll: Callable, fetch: Callable, cancel: Callable, every: float = 10.0, longest: float = 86_400.0, errors: int = 5, sleep: Callable = time.sleep, clock: Callable = time.monotonic) -> list:
    """Send requests as one batch job, ask for its state until it has ended, and fetch its results.

    `poll` gives True once ended; it may be Unavailable up to `errors` times in a row. A job that
    takes over `longest` seconds, or that stays unavailable, is cancelled and Unavailable raised."""
    if not requests:
        return []
    job, start, missed = submit(requests), clock(), 0
    while True:
        try:
            if poll(job):
                return fetch(job)
            missed = 0
        except Unavailable:
            missed += 1
        if missed > errors or clock() - start > longest:
            cancel(job)
            raise Unavailable("the batch did not end")
        sleep(every)


def chunked_scan(end: int, scan: Callable[[int, int], list[tuple[int, int]]], chunk: int = 900_000, buffer: int = 10_000, start: int = 0) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Scan `[start, end)` in chunks that restart at the last item found.

    An item that ends in the last `buffer` of a chunk is left to the next one, which starts at the
    end of the item before it or at the buffer, whichever is later. Yields `(next start, items so
    far)` after each chunk, all that is needed to resume."""
    items: list[tuple[int, int]] = []
    while start < end:
        stop = start + chunk
        items += scan(start, min(stop, end))
        zone = stop - buffer
        last = items[-1][1] if items else start
        if stop < end and last >= zone and items:
            items.pop()
            last = items[-1][1] if items else zone
        start = max(last, zone)
        yield start, list(items)


def adjust_actions(at: list[float], pos: list[float], frame: float, top: int = 0, bottom: int = 0, low: float = 0, high: float = 100, filled: float = 0, extra: float = 0, centre: float = 50) -> tuple[list[float], list[float]]:
    """Offset tops and bottoms by frames, keep neighbours a frame apart by moving earlier ones back,
    and rescale each stroke into `[low, high]`, what it leaves unused split by `centre`."""
    n = len(at)
    rises = [b - a for a, b in zip(pos, pos[1:])]
    way = -rises[0] if n > 1 else -1
    t = []
    for i in range(n):  # a flat step keeps the way of the one before; the first point is a top if what follows falls
        way = rises[i - 1] if i and rises[i - 1] else way
        t.append(at[i] + frame * (top if way > 0 else bottom))
    for i in range(n - 1, 0, -1):
        if t[i] - t[i - 1] <= frame / 2:
            t[i - 1] = t[i] - frame
    room, new = high - low, list(pos)
    for i, rise in enumerate(rises):
        if rise:
            used = room * (filled + abs(rise) * (1 - filled / 100)) / 100 * (1 + extra / 100)
            base = low + max(0.0, room - used) * centre / 100
            ends = (base, min(base + used, high) if room > used else high)
            new[i], new[i + 1] = ends if rise > 0 else ends[::-1]
    return t, new
