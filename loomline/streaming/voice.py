"""Voice activity over streams of probabilities: hysteresis and a voting gate, streaming and batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

#: Defaults of the automata, in samples at 16 kHz.
RATE, WINDOW, MARGIN = 16_000, 512, 0.15


class Hysteresis:
    """Enters at a probability of `threshold`, leaves when it has been under `threshold` less MARGIN for
    `silence` samples; emits `(kind, sample)` padded by `pad`. The state is three values."""

    def __init__(self, threshold: float = 0.5, silence: float = 1600, pad: float = 480, state: tuple = (False, 0, 0)):
        self.threshold, self.silence, self.pad = threshold, silence, pad
        self.triggered, self.end, self.sample = state

    @property
    def state(self) -> tuple:
        return self.triggered, self.end, self.sample

    def step(self, p: float, n: int = WINDOW) -> tuple[str, int] | None:
        self.sample += n
        if p >= self.threshold:
            self.end = 0
            if not self.triggered:
                self.triggered = True
                return "start", int(self.sample - self.pad)
        elif p < self.threshold - MARGIN and self.triggered:
            self.end = self.end or self.sample
            if self.sample - self.end >= self.silence:
                at, self.end, self.triggered = self.end, 0, False
                return "end", int(at + self.pad)
        return None


def speech_spans(p: list[float], threshold: float = 0.5, speech: float = 4000, silence: float = 1600, pad: float = 480, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of speech of a whole signal: longer than `speech`, parted by at least `silence`, padded;
    a silence shorter than two pads is shared by its neighbours."""
    gate, total, edges = Hysteresis(threshold, silence, pad=0), window * len(p), []
    for x in p:  # the automaton counts samples heard, a span those before the frame
        event = gate.step(x, window)
        if event:
            edges.append(event[1] - window)
    if len(edges) % 2:
        edges.append(total)
    spans = [(s, e) for s, e in zip(edges[::2], edges[1::2]) if e - s > speech]
    gaps = [b[0] - a[1] for a, b in zip(spans, spans[1:])]
    inner = [g // 2 if g < 2 * pad else pad for g in gaps]
    return [(int(max(0, s - left)), int(min(total, e + right))) for (s, e), left, right in zip(spans, [pad, *inner], [*inner, pad])]


class VotingGate:
    """Opens when more than `ratio` of the last `size` frames vote for speech, and closes when more
    than that vote against; the ring is emptied at each change."""

    def __init__(self, size: int = 10, ratio: float = 0.75, ring=(), opened: bool = False):
        self.size, self.ratio, self.ring, self.opened = size, ratio, deque(ring, maxlen=size), opened

    def step(self, speech: bool) -> str | None:
        self.ring.append(speech)
        votes = sum(self.ring)
        if (len(self.ring) - votes if self.opened else votes) > self.ratio * self.size:
            self.opened = not self.opened
            self.ring.clear()
            return "open" if self.opened else "close"
        return None


def hysteresis_stream(stream: DataFrame, key: str, order: str, probability: str, **settings) -> DataFrame:
    """`key, kind, sample` from a stream; state is kept by key across micro-batches.

    Rows of a key are taken in `order` within a micro-batch; one that arrives in a later batch is
    taken then, as the automaton has no notion of late data."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        gate = Hysteresis(**settings, state=state.get if state.exists else (False, 0, 0))
        rows = pd.concat(list(parts)).sort_values(order)
        found = [e for e in (gate.step(float(p)) for p in rows[probability]) if e]
        state.update(tuple(gate.state))
        yield pd.DataFrame({key: [k[0]] * len(found), "kind": [e[0] for e in found], "sample": [e[1] for e in found]})

    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` long, kind string, sample long", "triggered boolean, fin long, sample long", "append", GroupStateTimeout.NoTimeout)


def gate_stream(stream: DataFrame, key: str, order: str, probability: str, size: int = 10, ratio: float = 0.75) -> DataFrame:
    """`key, kind, ord` of the voting gate over a stream, the ring kept as state."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, ring = state.get if state.exists else (False, "")
        gate = VotingGate(size, ratio, [c == "1" for c in ring], opened)
        rows = pd.concat(list(parts)).sort_values(order)
        found = [(kind, o) for kind, o in ((gate.step(p > 0.5), o) for p, o in zip(rows[probability], rows[order])) if kind]
        state.update((gate.opened, "".join("1" if x else "0" for x in gate.ring)))
        yield pd.DataFrame({key: [k[0]] * len(found), "kind": [x for x, _ in found], "ord": [o for _, o in found]})

    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` long, kind string, ord long", "opened boolean, ring string", "append", GroupStateTimeout.NoTimeout)
