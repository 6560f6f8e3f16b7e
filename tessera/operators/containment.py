"""Which of many items lie, letter by letter, in which texts: hashed runs of words for long items, automata for short ones."""

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the run that leads a long item to the texts that may contain it.
RUN = 6
#: UTF-8 bytes of short items that one automaton holds, and rows of a batch that is sent back.
SHARD_BYTES, ROWS = 4 << 20, 65536


def _by_runs(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str) -> DataFrame:
    """An item's words but its first and last lie whole in every text that contains it. The first RUN of them are its key;
    texts send out hashes of their runs, and go along once themselves for pairs that share one."""
    keyed = items.select(item_key, "_item", F.xxhash64(F.array_join(F.slice("_w", 2, RUN), " ")).alias("_key"))
    w = docs.select(key, F.split(text, r"[ \n]").alias("_w")).where(F.size("_w") >= RUN)
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (RUN - 1)), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, RUN), " ")))
    met = w.select(key, F.explode(F.array_distinct(runs)).alias("_key")).join(keyed, "_key").select(key, item_key, "_item").distinct()
    return docs.select(key, text).join(met, key).where(F.contains(text, "_item")).select(item_key, key)


def _scan(shared, key_type: pa.DataType):
    """Batches of (key, text) to (key, item) of the items of one shard that lie in the text, each once."""
    schema = pa.schema([("key", key_type), ("item", pa.string())])

    def scan(batches):
        found = ahocorasick.Automaton()
        for item in shared.value:
            found.add_word(item, item)
        found.make_automaton()
        for batch in batches:
            keys, items = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for item in {item for _, item in found.iter(text)}:
                    keys.append(key)
                    items.append(item)
                if len(keys) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(items, pa.string())], schema=schema)
                    keys, items = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(items, pa.string())], schema=schema)

    return scan


def _by_automata(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, shard_bytes: int) -> DataFrame:
    """Distinct short items are dealt to shards of a bounded size, one automaton each, so there may be any number of them;
    texts are read once a shard and never shuffled. Items that share their text are met by a join."""
    spark = docs.sparkSession
    distinct = items.select("_item").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("_item")), F.lit(0))).first()[0]
    shards = -(-size // shard_bytes)
    texts = docs.where(F.col(text).isNotNull()).select(key, text)
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[dict(docs.dtypes)[key]]
    out = docs.select(key, F.col(text).alias("_item")).where("false")
    for i in range(shards):
        mine = [r["_item"] for r in distinct.where(F.pmod(F.xxhash64("_item"), F.lit(shards)) == i).collect()]  # about shard_bytes
        met = texts.mapInArrow(_scan(spark.sparkContext.broadcast(mine), key_type), f"`{key}` {dict(docs.dtypes)[key]}, _item string") if mine else None
        out = out.union(met) if met is not None else out
    return out.join(items, "_item").select(item_key, key)


def contained(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_key, key) of each item whose text lies in a document's text. Keys are unique in both; a null or empty item
    lies in none, and nothing lies in a null text. Items of RUN inner words or more are found by a run of words, others by
    an automaton."""
    told = items.select(item_key, F.col(item_text).alias("_item")).where("_item <> ''").withColumn("_w", F.split("_item", r"[ \n]"))
    long, short = told.where(F.size("_w") >= RUN + 2), told.where(F.size("_w") < RUN + 2).select(item_key, "_item")
    return _by_runs(docs, key, text, long, item_key).union(_by_automata(docs, key, text, short, item_key, shard_bytes))
