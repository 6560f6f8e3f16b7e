"""Loop guards and packing as streams with typed state: maps and lists by key, which go when their run is over.

They give what the operators on whole runs give (error_streaks and call_repeat_stop, pack_chunks), batch by batch. State
is in RocksDB, so a run's calls needn't fit in memory, and a call is read and written alone.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_rocks(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df


def _time(idle_ms: int | None) -> str:
    """State that expires needs processing time, with which a stream that takes what is there and ends doesn't end."""
    return "None" if idle_ms is None else "ProcessingTime"


class Guard(StatefulProcessor):
    """State of a run: how often each call came (map), the streak of failed observations, and whether it was stopped.

    At its fourth equal call a run stops and its map is cleared at once; a row that says it is the last clears all.
    """

    def __init__(self, repeats: int, errors: int, idle_ms: int | None):
        self.repeats, self.errors, self.idle_ms = repeats, errors, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getMapState("calls", "call string", "n long", ttlDurationMs=self.idle_ms)
        self.streak = handle.getValueState("streak", "streak long, stopped boolean", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        streak, stopped = self.streak.get() if self.streak.exists() else (0, False)
        for row in pd.concat(list(rows)).sort_values("turn").itertuples(index=False):
            if not stopped:
                n = 1 + (self.calls.getValue((row.call,))[0] if self.calls.containsKey((row.call,)) else 0)
                if n >= self.repeats:
                    out.append((key[0], row.turn, "repeat"))
                    stopped = True
                    self.calls.clear()
                else:
                    self.calls.updateValue((row.call,), (n,))
                    streak = streak + 1 if row.obs.startswith("ERROR") else 0
                    if streak == self.errors:
                        out.append((key[0], row.turn, "errors"))
                        streak = 0
            if row.last:
                streak, stopped = 0, False
                self.calls.clear()
        if row.last:
            self.streak.clear()
        else:
            self.streak.update((streak, stopped))
        yield pd.DataFrame(out, columns=["run", "turn", "signal"])

    def close(self) -> None:
        pass


def guards(stream: DataFrame, repeats: int = 4, errors: int = 3, idle_ms: int | None = None) -> DataFrame:
    """(run, turn, signal) of stream (run, turn, call, obs, and last if there is such a column): "repeat" at a run's fourth
    equal call, where it stops, and "errors" at every third failed observation in a row. A run's state goes with the row
    whose last is true and, in a stream that runs on, after idle_ms without a change, if that is given. Rows of one batch
    are taken by turn; a null call is a call like others, a null obs is an empty one."""
    last = F.coalesce("last", F.lit(False)) if "last" in stream.columns else F.lit(False)
    rows = stream.select("run", "turn", F.coalesce("call", F.lit("")).alias("call"), F.coalesce("obs", F.lit("")).alias("obs"), last.alias("last"))
    return _with_rocks(rows).groupBy("run").transformWithStateInPandas(Guard(repeats, errors, idle_ms), "run long, turn long, signal string", "Append", _time(idle_ms))


class Packer(StatefulProcessor):
    """State of a shard: the ids that are left of its last window (list, size at most), and the next window's number."""

    def __init__(self, size: int, vocabulary: int, idle_ms: int | None):
        self.size, self.vocabulary, self.idle_ms = size, vocabulary, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getListState("rest", "id int", ttlDurationMs=self.idle_ms)
        self.next = handle.getValueState("next", "chunk long", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        left = [x[0] for x in self.rest.get()] if self.rest.exists() else []
        chunk = self.next.get()[0] if self.next.exists() else 0
        out = []
        for text in pd.concat(list(rows)).sort_values("place")["text"]:
            left.extend(ord(c) % self.vocabulary for c in text)
            at = 0
            while len(left) - at > self.size:
                out.append((key[0], chunk, left[at : at + self.size + 1]))
                chunk, at = chunk + 1, at + self.size
            left = left[at:]
        if left:
            self.rest.put([(x,) for x in left])
        self.next.update((chunk,))
        yield pd.DataFrame(out, columns=["shard", "chunk", "ids"])

    def close(self) -> None:
        pass


def packed(stream: DataFrame, size: int, vocabulary: int = 1 << 21, idle_ms: int | None = None) -> DataFrame:
    """(shard, chunk, ids) of stream (shard, place, text): windows of size + 1 character tokens with stride size. Texts of
    one batch are taken by place."""
    rows = stream.where("text is not null").select("shard", "place", "text")
    return _with_rocks(rows).groupBy("shard").transformWithStateInPandas(Packer(size, vocabulary, idle_ms), "shard int, chunk long, ids array<int>", "Append", _time(idle_ms))
