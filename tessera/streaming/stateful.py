"""Stateful streams: packing that carries its remainder on, and the guards that stop a run that goes round in circles."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .log import AppendLog


def sharded(stream: DataFrame, shards: int, key: str = "place") -> DataFrame:
    """stream with shard, its place modulo shards, and text (or else content); rows with neither go."""
    text = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("content")) if "content" in stream.columns else F.nullif(F.col("text"), F.lit(""))
    return stream.withColumn("text", text).where("text <> ''").withColumn("shard", F.pmod(F.col(key), F.lit(shards)).cast("int"))


def pack_stream(stream: DataFrame, size: int, vocabulary: int = 1 << 21) -> DataFrame:
    """(shard, chunk, ids) of stream (shard, place, text): windows of size + 1 character tokens with stride size.

    What a shard has left is its state, size ids at most, which goes on with its next text. Texts of one batch are taken
    by place; batches come as they come.
    """

    def pack(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, chunk = state.get if state.exists else ([], 0)
        left = list(left)
        rows = pd.concat(list(batches)).sort_values("place")
        out = []
        for text in rows["text"]:
            left.extend(ord(c) % vocabulary for c in text)
            at = 0
            while len(left) - at > size:
                out.append((key[0], chunk, left[at : at + size + 1]))
                chunk, at = chunk + 1, at + size
            left = left[at:]
        state.update((left, chunk))
        yield pd.DataFrame(out, columns=["shard", "chunk", "ids"])

    grouped = stream.select("shard", "place", "text").groupBy("shard")
    return grouped.applyInPandasWithState(pack, "shard int, chunk long, ids array<int>", "left array<int>, chunk long", "append", GroupStateTimeout.NoTimeout)


def first_rows(stream: DataFrame, most: int, target: str, checkpoint: str):
    """Keeps at most `most` rows of the stream in the append log at target, over all batches and restarts, and ends."""
    return AppendLog(stream.sparkSession, target).start(stream, checkpoint, most=most)


def guard_stream(stream: DataFrame, repeats: int = 4, errors: int = 3) -> DataFrame:
    """(run, turn, signal) of stream (run, turn, call, obs): "repeat" at a run's fourth equal call, where it stops, and
    "errors" at every third failed observation in a row. The state holds how often each call of the run came."""

    def guard(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls, counts, streak, stopped = state.get if state.exists else ([], [], 0, False)
        seen = dict(zip(calls, counts))
        out = []
        for row in pd.concat(list(batches)).sort_values("turn").itertuples(index=False):
            if stopped:
                break
            seen[row.call] = seen.get(row.call, 0) + 1
            if seen[row.call] >= repeats:
                out.append((key[0], row.turn, "repeat"))
                stopped = True
                continue
            streak = streak + 1 if row.obs.startswith("ERROR") else 0
            if streak == errors:
                out.append((key[0], row.turn, "errors"))
                streak = 0
        state.update((list(seen), list(seen.values()), streak, stopped))
        yield pd.DataFrame(out, columns=["run", "turn", "signal"])

    grouped = stream.select("run", "turn", "call", F.coalesce("obs", F.lit("")).alias("obs")).groupBy("run")
    return grouped.applyInPandasWithState(guard, "run long, turn long, signal string", "calls array<string>, counts array<long>, streak long, stopped boolean", "append", GroupStateTimeout.NoTimeout)
