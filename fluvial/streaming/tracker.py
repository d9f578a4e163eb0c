"""Track association as a stream in event time: the same rule as in batch, open frames and open tracks kept as state."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fluvial.operators.events import CANDIDATE, OpenTracks, plain_row

#: Session setting that stateful processors with timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Association(StatefulProcessor):
    """One sequence's state: rows of frames that may still grow (`open`), and its open tracks (`tracks`).

    A frame is associated when the watermark has passed its time, so rows of one frame may come in any number
    of batches. Open tracks are those of the last max_gap + 1 frames; forget_ms after a sequence's last frame
    both states go.
    """

    def __init__(self, fields: list[str], types: str, forget_ms: int, options: dict):
        self.fields, self.types, self.forget_ms, self.options = fields, types, forget_ms, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.types)
        self.tracks = handle.getValueState("tracks", "kept string, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            part = part[["ms", *self.fields]]
            self.open.appendList([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in part.itertuples(index=False)])
            low = int(part["ms"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first)  # one for all of a batch's frames: the earliest is due first and sets the next
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # the first timer of a batch takes all frames that the watermark has passed; the others find none
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [tuple(r) for r in self.open.get()]
        ready, waiting = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        if not ready:
            if not waiting and self.tracks.exists() and self.tracks.get()[1] + self.forget_ms <= now:
                self.tracks.clear()
                self.open.clear()
            return
        tracks, last = OpenTracks(**self.options), None
        if self.tracks.exists():
            text, last = self.tracks.get()
            kept = json.loads(text)
            tracks.count, tracks.last = kept["count"], {int(t): c for t, c in kept["open"].items()}
        at = 1 + self.fields.index("frame"), 1 + self.fields.index("candidate_id")
        found = []
        for (ms, frame), own in itertools.groupby(sorted(ready, key=lambda r: (r[0], r[at[0]], r[at[1]])), key=lambda r: (r[0], r[at[0]])):
            if last is not None and ms - last > self.forget_ms:  # a new sequence, however batches fell
                tracks = OpenTracks(**self.options)
            own, last = list(own), int(ms)
            chosen = tracks.step(int(frame), [plain_row(dict(zip(self.fields, r[1:]))) for r in own])
            found += [(key[0], *r[1:], t) for r, t in zip(own, chosen)]
        if not waiting and last + self.forget_ms <= now:
            self.tracks.clear()
            self.open.clear()
        else:
            self.tracks.update((json.dumps({"count": tracks.count, "open": tracks.last}), last))
            self.open.clear()
            if waiting:
                self.open.put(waiting)
                self.handle.registerTimer(int(min(r[0] for r in waiting)))
            self.handle.registerTimer(last + self.forget_ms)
        yield pd.DataFrame(found, columns=["sequence_key", *self.fields, "track"])

    def close(self) -> None:
        pass


def stream_associate(candidates: DataFrame, sequence: str, time: str, late: str = "0 seconds", forget_ms: int = 3_600_000, **options) -> DataFrame:
    """candidates (a stream) with track, in append mode: each frame once, when the watermark has passed its time.

    time is the frame's time, the same in all of its rows; rows later than `late` behind the newest time seen
    are dropped, as Spark's watermark does. A sequence that goes on more than forget_ms after its last frame
    is a new one, whose tracks count from 0. The session must use the state store of PROVIDER. Times are whole
    milliseconds; null times and null sequences are left out.
    """
    rows = candidates.where(F.col(time).isNotNull() & F.col(sequence).isNotNull()).withWatermark(time, late)
    rows = rows.select(F.col(sequence).alias("sequence_key"), time, F.unix_millis(time).alias("ms"), *CANDIDATE)
    types = dict(rows.dtypes)
    fields = ", ".join(f"`{n}` {types[n]}" for n in CANDIDATE)
    found = rows.groupBy("sequence_key").transformWithStateInPandas(
        Association(list(CANDIDATE), f"ms long, {fields}", forget_ms, options), f"sequence_key {types['sequence_key']}, {fields}, track int", "append", "eventtime"
    )
    return found.withColumnRenamed("sequence_key", sequence)
