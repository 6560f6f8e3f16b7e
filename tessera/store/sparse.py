"""A TF-IDF index that is built once and searched often, without reading what can't matter.

Stored are each document's words and length (forward), lengths alone (sizes), postings in buckets of terms, sorted by term,
and each term's document frequency (terms). A row of postings holds the documents of a term, a
long list in several rows, and how often they have it; a score is the sum of the weights, by the document's length.

Postings are shuffled once, to their buckets, a slice of texts in packs: a term goes once for a slice, not once for each
document that has it. Frequencies are those of the whole lists, and lengths are summed up from the stored lists.

A search reads the lists of all its queries' terms once, each by itself, and keeps their weights, by documents' lengths,
and each term's largest. For each query it adds up the weights of the rarest terms first; the k-th best sum is a bar that no final score of a hit
falls below. Then terms go, the most frequent first, as long as the largest scores they could all add stay below the
bar: no document without one of the other terms can be a hit. Only those others' weights are added for all documents. Documents
that can still reach the bar get the rest of their scores from their own rows, if these hold fewer terms than the
frequent terms have postings, and from the postings otherwise. Results are exact.
"""

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .terms import counted, counted_rows, lists_of, one_a_key, slices

#: Documents for each bucket of terms, and buckets at most: few documents need few files.
BUCKET_DOCS, BUCKETS = 1250, 1024
#: Postings that a query reads at most before it has a bar, and by which bounds are taken wider.
SEED, SLACK = 4096, 1e-8
GENTLE = 1e-8
#: Documents of a term in a row of postings at most, and rows of postings that are sent on at once.
LONG, ROWS = 1 << 16, 1 << 14
#: What a pack holds of a bucket's terms in a slice: all terms in one string, as none has a blank, how many documents each
#: has, and the ids of all, cut in two as the upper parts hardly differ.
PACK = pa.schema([("terms", pa.string()), ("n", pa.list_(pa.int32())), ("upper", pa.list_(pa.int64())), ("lower", pa.list_(pa.uint16())), ("tf", pa.list_(pa.int32()))])
#: Documents up to which their lengths are sent to all tasks; those of more meet by a shuffle.
SENT = 1 << 22


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def _joined(terms: pa.Array) -> str:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(terms)]), terms), pa.scalar(" ", terms.type))[0].as_py()


def packs(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, pack) of rows (id, ws), whose ids don't repeat: a row for each slice of texts and bucket of its terms."""

    def deal(batches):
        for b in batches:
            for at, lists in slices(b):
                terms, begin, row, tf = lists_of(lists)
                if not len(terms):
                    continue
                spelt = np.array(_joined(terms).encode().split(b" "), object)
                of = np.fromiter(map(crc32, spelt), np.int64, len(terms)) % buckets
                order = np.argsort(of, kind="stable")
                n = np.diff(begin)[order]
                end = np.cumsum(n)
                j = np.arange(len(row)) + np.repeat(begin[:-1][order] - end + n, n)
                ids = b["id"].cast(pa.int64()).to_numpy()[row[j] + at]
                spelt, each = spelt[order], [ids >> 16, ids & 0xFFFF, tf[j]]
                found, cuts = np.unique(of[order], return_index=True)
                out = []
                for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
                    part = slice(end[lo] - n[lo], end[hi - 1])
                    made = [pa.array([v], k.type) for v, k in zip([n[lo:hi], *[x[part] for x in each]], list(PACK)[1:])]
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, PACK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                        to.write_batch(pa.record_batch([pa.array([b" ".join(spelt[lo:hi]).decode()]), *made], schema=PACK))
                    out.append(sink.getvalue().to_pybytes())
                yield pa.record_batch([pa.array(found, pa.int32()), pa.array(out, pa.binary())], ["bucket", "pack"])

    return rows.select("id", "ws").mapInArrow(deal, "bucket int, pack binary")


def lists_of_bucket(table: pa.Table) -> pa.Table:
    """(bucket, term, df, part, ids, tfs) of a bucket's packs: the lists of its terms, in rows of LONG documents at most."""
    found = [pa.ipc.open_stream(p.as_buffer()).read_next_batch() for p in table["pack"]]
    found.sort(key=lambda p: p["upper"][0][0].as_py() * 65536 + p["lower"][0][0].as_py())
    whole = lambda name: pa.concat_arrays([p[name].flatten() for p in found])
    number = lambda name: whole(name).to_numpy().astype(np.int64)
    coded, n = pa.concat_arrays([pc.split_pattern(p["terms"], " ").flatten() for p in found]).dictionary_encode(), number("n")
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    of = np.repeat(place[coded.indices.to_numpy()], n)
    df, j = np.bincount(of, minlength=len(order)), np.argsort(of, kind="stable")
    rows = -(-df // LONG)
    term = np.repeat(np.arange(len(order)), rows)
    part = np.arange(len(term)) - np.repeat(np.cumsum(rows) - rows, rows)
    ends = pa.array(np.append((np.cumsum(df) - df)[term] + part * LONG, len(of)), pa.int32())
    ids, tfs = (number("upper") * 65536 + number("lower"))[j], number("tf")[j]
    columns = {
        "bucket": pa.array(np.full(len(term), table["bucket"][0].as_py()), pa.int32()), "term": coded.dictionary.take(pa.array(order[term])), "df": pa.array(df[term], pa.int64()),
        "part": pa.array(part, pa.int32()),
        "ids": pa.ListArray.from_arrays(ends, pa.array(ids)), "tfs": pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())),
    }
    made = pa.record_batch(columns)
    return pa.Table.from_batches([made.slice(i, ROWS) for i in range(0, len(made), ROWS)])


def _sent(sizes: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sizes) if n <= SENT else sizes


class Sparse:
    """terms (bucket, term, df), postings (bucket, term, df, part, ids, tfs), forward (id, ws, size) and sizes
    (id, size) of n documents. ids: whole numbers."""

    NAMES = ("terms", "postings", "forward", "sizes")

    def __init__(self, n: int, buckets: int, size: int, terms: DataFrame, postings: DataFrame, forward: DataFrame, sizes: DataFrame):
        """size: of all postings."""
        self.n, self.buckets, self.size, self.terms, self.postings, self.forward, self.sizes = n, buckets, size, terms, postings, forward, sizes

    @staticmethod
    def build(docs: DataFrame, key: str, text: str, store: Callable, buckets: int | None = None) -> "Sparse":
        """store(df, name, by): writes a table, in folders by the column `by` if given, and reads it back. Terms are counted
        once. Documents without a term aren't found by any search, but count."""
        n = docs.count()
        buckets = buckets or max(1, min(BUCKETS, n // BUCKET_DOCS))
        idf = F.log((n + 1.0) / (F.col("df") + 1)) + 1
        dealt = packs(one_a_key(docs.where(F.col(key).isNotNull()), key, text), buckets).repartitionById(buckets, "bucket")
        lists = dealt.groupBy("bucket").applyInArrow(lists_of_bucket, "bucket int, term string, df bigint, part int, ids array<bigint>, tfs array<int>")
        postings = store(lists, "postings", "bucket")
        terms = store(postings.where("part = 0").select("bucket", "term", "df"), "terms", "bucket")
        each = postings.select(idf.alias("idf"), F.explode(F.arrays_zip("ids", "tfs")).alias("p")).select(F.col("p.ids").alias("id"), (F.col("p.tfs") * F.col("idf")).alias("w"))
        length = each.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
        sizes = store(length.withColumn("size", F.when(F.col("size") < GENTLE, 1.0).otherwise(F.col("size"))), "sizes", None)
        # Texts are cut into words behind the join: they are smaller than their words.
        forward = store(one_a_key(docs.join(_sent(sizes, n).withColumnRenamed("id", key), key), key, text, "size"), "forward", None)
        return Sparse(n, buckets, terms.agg(F.sum("df")).first()[0] or 0, terms, postings, forward.select("id", "ws", "size"), sizes)

    def search(self, queries: DataFrame, key: str, text: str, k: int, store: Callable) -> DataFrame:
        """(key, rank, id, score): the k most similar documents by cosine, with the query counted as one more document for
        its own weights; ties by id. Documents that share no term with a query aren't returned."""
        # Stored first, so that their size is known and terms needn't be shuffled to meet them.
        asked = store(counted(queries, key, text).withColumn("bucket", bucket(F.col("term"), self.buckets)), "counted", None).join(self.terms, ["bucket", "term"])
        asked = asked.withColumn("wq", F.col("tf") * (F.log((F.lit(self.n) + 2) / (F.col("df") + 2)) + 1))
        size = F.sqrt(F.sum(F.col("wq") * F.col("wq")).over(W.partitionBy(key)))
        asked = asked.withColumn("_s", size).withColumn("wq", F.col("wq") / F.when(F.col("_s") < GENTLE, 1.0).otherwise(F.col("_s")))
        rare = W.partitionBy(key).orderBy("df", "term")
        asked = store(asked.withColumn("seen", F.sum("df").over(rare)).select(key, "bucket", "term", "df", "wq", "seen"), "asked", None)
        u = F.col("tf") * (F.log((F.lit(self.n) + 1) / (F.col("df") + 1)) + 1) / F.col("size")
        lists = self.postings.join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        each = lists.select("bucket", "term", "df", F.explode(F.arrays_zip("ids", "tfs")).alias("p")).select("bucket", "term", "df", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"))
        weights = store(each.join(_sent(self.sizes, self.n), "id").select("bucket", "term", "id", u.alias("u")), "weights", None)
        tops = weights.groupBy("bucket", "term").agg(F.max("u").alias("top"))
        score = F.sum(F.col("wq") * F.col("u"))
        rank = lambda d: d.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.round("score", 9).desc(), "id"))).where(F.col("rank") <= k)

        def summed(terms: DataFrame) -> DataFrame:
            # Weights go by document, once for all queries, so sums need no shuffle and ranks only one of the best.
            own = weights.join(terms.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").repartition("id")
            return own.join(terms.select(key, "bucket", "term", "wq"), ["bucket", "term"]).groupBy(key, "id").agg(score.alias("score"))

        bars = rank(summed(asked.where(F.col("seen") <= SEED))).where(F.col("rank") == k).select(key, F.col("score").alias("bar"))
        # The most frequent terms go first; `more` is the most that they can add together.
        frequent = W.partitionBy(key).orderBy(F.desc("df"), "term")
        split = asked.join(tops, ["bucket", "term"]).join(bars, key, "left").withColumn("more", F.sum(F.col("wq") * F.col("top")).over(frequent))
        split = split.withColumn("late", F.coalesce(F.col("more") < F.col("bar") - SLACK, F.lit(False)))
        split = store(split.withColumn("rest", F.coalesce(F.max(F.when(F.col("late"), F.col("more"))).over(W.partitionBy(key)), F.lit(0.0))), "split", None)
        facts = split.groupBy(key).agg(F.first("bar").alias("bar"), F.first("rest").alias("rest"))
        part = summed(split.where("not late")).join(facts, key)
        reach = store(part.where(F.col("bar").isNull() | (F.col("score") + F.col("rest") >= F.col("bar") - SLACK)).select(key, "id", "score"), "reach", None)
        late = split.where("late").select(key, "bucket", "term", "wq", "df")
        held = reach.groupBy(key).agg((F.count("*") * (self.size / max(1, self.n))).alias("own"))
        way = late.groupBy(key).agg(F.sum("df").alias("lists")).join(held, key).select(key, (F.col("own") < F.col("lists")).alias("by_row"))
        late = store(late.join(way, key).select(key, "bucket", "term", "wq", "df", "by_row"), "late", None)
        by_row = late.where("by_row").select(key, "term", "wq", "df")
        rows = reach.select(key, "id").join(by_row.select(key).distinct(), key, "left_semi")
        texts = self.forward.join(rows.select("id").distinct(), "id", "left_semi")
        known = counted_rows(texts, "size").join(rows, "id").join(by_row, [key, "term"])
        added = known.withColumn("u", u).groupBy(key, "id").agg(score.alias("added"))
        by_list = late.where("not by_row").select(key).distinct()
        near = reach.join(by_list, key, "left_anti").join(added, [key, "id"], "left").select(key, "id", (F.col("score") + F.coalesce("added", F.lit(0.0))).alias("score"))
        return rank(near.unionByName(summed(split.join(by_list, key, "left_semi")))).select(key, "rank", "id", "score")

    def shares(self, queries: DataFrame, key: str, text: str) -> DataFrame:
        """(key, all): the postings of each query's terms, which a search without bars would read."""
        asked = counted(queries, key, text).withColumn("bucket", bucket(F.col("term"), self.buckets)).join(self.terms, ["bucket", "term"])
        return asked.groupBy(key).agg(F.sum("df").alias("all"))
