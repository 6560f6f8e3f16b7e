"""Terms of texts, counted in the tasks that read them, and their TF-IDF weights with one shuffle of the rare ones.

A text's counts need no other text, so postings aren't shuffled to be counted. Document frequencies need all texts: terms
that a sample shows to be frequent are counted in the tasks as well and their frequencies sent back to all; only postings
of the others meet by term. Which terms the sample shows changes the cost, not the result.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import words

#: Words that are counted at once.
SLICE = 1 << 20
#: Texts of the sample, and how many of them a term is in that counts as frequent.
SAMPLE, OFTEN = 4096, 20


def one_a_key(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(id, ws, and the columns of more, of which a key has one value): the words of each key's texts. Texts of one key are
    put together with an empty word between them, which no text has: bigrams don't reach over it."""
    rows = df.select(F.col(key).alias("id"), words(F.col(text)).alias("ws"), *more)
    if df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    apart = F.concat(F.coalesce("ws", F.array().cast("array<string>")), F.array(F.lit("")))
    return rows.groupBy("id").agg(F.flatten(F.collect_list(apart)).alias("ws"), *[F.first(x).alias(x) for x in more])


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.ListArray]]:
    """The lists `ws` of a batch, about SLICE words at a time, each with the row it begins at."""
    lists = batch["ws"]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(lists):
        seen = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, seen + SLICE, "right")))
        yield at, lists.slice(at, to - at)
        at = to


def terms_of(lists: pa.ListArray, bigrams: bool) -> tuple[np.ndarray, pa.Array]:
    """(row, term) of all words, and of every two neighbours joined by an underscore."""
    w, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(w, "")
    out_row, out = [row], [w]
    if bigrams and len(w) > 1:
        near = pc.and_(pc.and_(real[:-1], real[1:]), pa.array(row[1:] == row[:-1]))
        out.append(pc.binary_join_element_wise(w[:-1], w[1:], "_").filter(near))
        out_row.append(row[1:][near.to_numpy(zero_copy_only=False)])
    if not pc.all(real).as_py() and len(w):
        out[0], out_row[0] = w.filter(real), row[real.to_numpy(zero_copy_only=False)]
    return np.concatenate(out_row), pa.concat_arrays([x.cast(pa.large_string()) for x in out])


def counts(lists: pa.ListArray, bigrams: bool, known: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, tf, terms): how often each row has terms[code]; of known terms only, if given, which are terms then."""
    row, term = terms_of(lists, bigrams)
    if known is None:
        coded = term.dictionary_encode()
        code, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    else:
        code, terms = pc.fill_null(pc.index_in(term, known), -1).to_numpy().astype(np.int64), known
        row, code = row[code >= 0], code[code >= 0]
    size = max(1, len(terms))
    both, tf = np.unique(row.astype(np.int64) * size + code, return_counts=True)
    return both // size, both % size, tf, terms


def lists_of(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, begin, row, tf): terms[i] is tf[j] times in row[j], for each j from begin[i] to begin[i + 1]. What is counted
    are numbers of words and of pairs of them; only distinct ones are spelt."""
    w, row, m = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64), max(1, len(lists))
    coded = w.cast(pa.large_string()).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    names, code = coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]
    real, size = pc.not_equal(w, "").to_numpy(zero_copy_only=False), len(names) + 1
    near = real[:-1] & real[1:] & (row[1:] == row[:-1])
    pair = np.concatenate([code[real] * size, code[:-1][near] * size + code[1:][near] + 1])  # without a second word: 0
    both, tf = np.unique(pair * m + np.concatenate([row[real], row[1:][near]]), return_counts=True)
    pair, row = both // m, both % m
    begin = np.flatnonzero(np.diff(pair, prepend=-1))
    first, second = pair[begin] // size, pair[begin] % size - 1
    terms = pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second, mask=second < 0)), pa.scalar("_", pa.large_string()), null_handling="skip")
    begin = np.append(begin, len(row))
    if not pc.any(pc.match_substring(names, "_")).as_py():
        return terms, begin, row, tf
    same = terms.dictionary_encode()  # a word with an underscore may be spelt as two others are
    both, of = np.unique(np.repeat(same.indices.to_numpy().astype(np.int64), np.diff(begin)) * m + row, return_inverse=True)
    code = both // m
    return same.dictionary, np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code)), both % m, np.bincount(of, tf).astype(np.int64)


def counted_rows(rows: DataFrame, *more: str, bigrams: bool = True) -> DataFrame:
    """(id, term, tf, and the columns of more) of rows (id, ws), whose ids don't repeat."""
    names = ["id", *more]

    def count(batches):
        for b in batches:
            for at, lists in slices(b):
                row, code, tf, terms = counts(lists, bigrams)
                for i in range(0, len(row), SLICE):
                    part, of = slice(i, i + SLICE), pa.array(row[i : i + SLICE] + at)
                    own = [terms.take(pa.array(code[part])).cast(pa.string()), pa.array(tf[part], pa.int64())]
                    yield pa.record_batch([*[b[x].take(of) for x in names], *own], [*names, "term", "tf"])

    kind = T.StructType([*[rows.schema[x] for x in names], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return rows.select(*names, "ws").mapInArrow(count, kind)


def counted(df: DataFrame, key: str, text: str, bigrams: bool = True) -> DataFrame:
    """(key, term, tf): how often each word, and bigram, occurs in the texts of a key."""
    return counted_rows(one_a_key(df, key, text), bigrams=bigrams).select(F.col("id").alias(key), "term", "tf")


def seen(df: DataFrame, key: str, text: str, bigrams: bool = True) -> DataFrame:
    """(term, df) of all terms: a task sends a term once for each slice of its texts."""
    rows = one_a_key(df, key, text)

    def count(batches):
        for b in batches:
            for _, lists in slices(b):
                _, code, _, terms = counts(lists, bigrams)
                if len(terms):
                    yield pa.record_batch([terms.cast(pa.string()), pa.array(np.bincount(code, minlength=len(terms)), pa.int64())], ["term", "n"])

    return rows.select("ws").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def known_frequencies(rows: DataFrame, terms: pa.Array, bigrams: bool) -> np.ndarray:
    """How many rows (id, ws) have each of the terms, a bounded list; each task sends one number for each."""

    if not len(terms):
        return np.zeros(0, np.int64)

    def count(batches):
        n = np.zeros(len(terms), np.int64)
        for b in batches:
            for _, lists in slices(b):
                n += np.bincount(counts(lists, bigrams, terms)[1], minlength=len(terms))
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at])], ["at", "n"])

    found, n = rows.select("ws").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow(), np.zeros(len(terms), np.int64)
    n[found["at"].to_numpy()] = found["n"].to_numpy()
    return n


def frequent(rows: DataFrame, bigrams: bool) -> pa.Array:
    """Terms that at least OFTEN of about SAMPLE rows have, drawn by a hash of their ids; at most a mean row's terms times SAMPLE / OFTEN."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(F.monotonically_increasing_id().alias("id"), "ws")

    def tell(batches):
        for b in batches:
            for _, lists in slices(b):
                _, code, _, terms = counts(lists, bigrams)
                if len(terms):
                    yield pa.record_batch([terms.cast(pa.string()), pa.array(np.bincount(code, minlength=len(terms)), pa.int64())], ["term", "n"])

    often = drawn.select("ws").mapInArrow(tell, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    return often.select("term").toArrow()["term"].combine_chunks().cast(pa.large_string())


def common_grams(rows: DataFrame, n: int) -> DataFrame:
    """(id, shared, total) of each row (id, ws), where ws holds the words of a text, an empty word and those of another: how
    many n-grams the first has, and how many of them the other has too, each as often as both have it."""

    def codes(x):
        coded = x.dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def count(batches):
        for b in batches:
            for at, lists in slices(b):
                w, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
                apart = pc.equal(w, "").to_numpy(zero_copy_only=False)
                first = np.cumsum(apart) == row  # each row before has one empty word
                gram, words = codes(w)
                for word in [gram[i:] for i in range(1, n)]:
                    gram, _ = codes(pa.array(gram[:-1] * len(words) + word))
                k, size = len(gram), max(1, len(w))
                whole = (row[:k] == row[n - 1 :]) & (first[:k] == first[n - 1 :]) & ~apart[:k]
                own = first[:k][whole]
                each, keys = codes(pa.array(row[:k][whole] * size + gram[whole]))
                tf, other = (np.bincount(each[x], minlength=len(keys)) for x in (own, ~own))
                of = keys.to_numpy() // size
                shared, total = (pa.array(np.bincount(of, x, minlength=len(lists)).astype(np.int64)) for x in (np.minimum(tf, other), tf))
                yield pa.record_batch([b["id"].slice(at, len(lists)), shared, total], ["id", "shared", "total"])

    kind = T.StructType([rows.schema["id"], T.StructField("shared", T.LongType()), T.StructField("total", T.LongType())])
    return rows.select("id", "ws").mapInArrow(count, kind)


def sums(df: DataFrame, key: str, text: str, idf: Callable, bigrams: bool = True) -> DataFrame:
    """(key, squares, total, top, terms) of each key's weights w = tf * idf(df): the sum of w * w and of w, the largest, and how many.

    idf(df) works on columns and on numpy arrays alike: idf(df, log). Keys without a term have no row.
    """
    rows = one_a_key(df, key, text)
    hot = frequent(rows, bigrams)
    hot = hot.take(pa.array(np.argsort(hot.to_numpy(zero_copy_only=False))))
    weight = idf(known_frequencies(rows, hot, bigrams).astype(float), np.log)

    def deal(batches):
        for b in batches:
            for at, lists in slices(b):
                row, code, tf, terms = counts(lists, bigrams)
                place = pc.fill_null(pc.index_in(terms, hot), -1).to_numpy().astype(np.int64)[code] if len(terms) else code
                n, w = len(lists), tf * weight[place] if len(hot) else tf * 0.0
                often = place >= 0
                sure, w = row[often], w[often]
                top = np.zeros(n)
                np.maximum.at(top, sure, w)
                size = np.bincount(sure, minlength=n)
                there = np.flatnonzero(size)
                none = lambda x, t: pa.nulls(len(x), t)
                numbers = [*[np.bincount(sure, x, minlength=n).astype(float)[there] for x in (w * w, w)], top[there], size[there]]
                yield pa.record_batch([b["id"].take(pa.array(there + at)), none(there, pa.string()), none(there, pa.int64()), *map(pa.array, numbers)], names)
                row, code, tf = row[~often], code[~often], tf[~often]
                for i in range(0, len(row), SLICE):
                    part = slice(i, i + SLICE)
                    term = terms.take(pa.array(code[part])).cast(pa.string())
                    yield pa.record_batch([b["id"].take(pa.array(row[part] + at)), term, pa.array(tf[part], pa.int64()), *[none(term, pa.float64())] * 3, none(term, pa.int64())], names)

    names = ["id", "term", "tf", "squares", "total", "top", "terms"]
    kind = T.StructType([rows.schema["id"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), *[T.StructField(x, T.DoubleType()) for x in names[3:6]], T.StructField("terms", T.LongType())])
    dealt = rows.mapInArrow(deal, kind)
    # Rows of frequent terms are spread by their id: no term is in all of them.
    by = F.when(F.col("term").isNull(), F.xxhash64("id")).otherwise(F.xxhash64("term"))
    met = dealt.withColumn("_by", by).withColumn("df", F.count("*").over(W.partitionBy("_by", "term")))
    w = F.col("tf") * idf(F.col("df"), F.log)
    rare = F.col("term").isNotNull()
    pick = lambda c, other: F.when(rare, c).otherwise(F.col(other))
    each = met.select("id", pick(w * w, "squares").alias("s"), pick(w, "total").alias("t"), pick(w, "top").alias("m"), pick(F.lit(1), "terms").alias("n"))
    out = each.groupBy("id").agg(F.sum("s").alias("squares"), F.sum("t").alias("total"), F.max("m").alias("top"), F.sum("n").alias("terms"))
    return out.withColumnRenamed("id", key)
