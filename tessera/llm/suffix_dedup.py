"""Removal of byte strings of SPAN bytes that start more than once, by difference-cover suffix sorting.

Only texts that can repeat are sorted. Each string of SPAN bytes is represented by one gram of GRAM bytes in it, that
with the smallest hash (leftmost on ties), so equal strings have equal grams at equal places. The strings that share a
gram's occurrence form a window of at most 2 SPAN - GRAM bytes. A gram that occurs once represents no repeated string,
and nothing is lost by leaving its window out.

The windows that are left are dealt out by their gram, equal windows counted as one, and each task sorts their
suffixes by the difference cover {1, 2} modulo 3: it sorts the triples at sampled places, names them, recurses on the
names, until they are unique or cover SPAN bytes, merges the remaining suffixes, and compares neighbours' first SPAN
bytes. A gram with more than MOST windows doesn't fit one task; its strings are digested one by one and counted.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, stored, table
from .shingles import _powers_to, mix

SPAN, GRAM = 200, 100
NO_ID = -(1 << 63)
#: Windows of one gram that one task sorts, and bytes that are sorted at once (names must fit 21 bits).
MOST = 2000
SORTED = 1 << 20
PLACE_BITS = 24


def prefix_sums(b: np.ndarray) -> np.ndarray:
    power, _ = _powers_to(len(b) + 1)
    return np.r_[np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])]


def digests(sums: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n bytes."""
    m = len(sums) - n
    return mix((sums[n:] - sums[:m]) * _powers_to(len(sums))[1][:m])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from the running minima of blocks of w."""
    n = len(x)
    pad = np.pad(x, (0, -n % w), constant_values=np.iinfo(x.dtype).max).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def windows(raw: bytes):
    """(gram hashes, first starts, last starts, gram places): every start of SPAN bytes lies in one window."""
    none = np.empty(0, np.int64)
    if len(raw) < SPAN:
        return none, none, none, none
    g = digests(prefix_sums(np.frombuffer(raw, np.uint8)), GRAM)
    low = np.uint64((1 << PLACE_BITS) - 1)
    place = np.arange(len(g), dtype=np.uint64) & low
    best = sliding_min((g & ~low) | place, SPAN - GRAM + 1)
    start = np.arange(len(best))
    at = start + ((best & low).astype(np.int64) - start) % (1 << PLACE_BITS)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return g[at[first]].astype(np.int64), first, last, at[first]


def suffix_ranks(s: np.ndarray, covers: int = 1) -> np.ndarray:
    """Ranks, from 1, of the suffixes of s (values 1 to 2^21 - 1); equal ones have SPAN / covers symbols in common or
    more. covers: bytes that a symbol of s stands for."""
    n = len(s)
    pad = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.uint64)
    place = np.arange(n)
    one, two, zero = place[1::3], place[2::3], place[0::3]
    sample = np.concatenate([one, two])
    triple = pad[sample] << np.uint64(42) | pad[sample + 1] << np.uint64(21) | pad[sample + 2]
    known, name = np.unique(triple, return_inverse=True)
    name = name + 1
    if len(known) < len(sample) and 3 * covers < SPAN:
        inner = suffix_ranks(np.concatenate([name[: len(one)] + 1, [1], name[len(one) :] + 1]), 3 * covers)
        name = np.concatenate([inner[: len(one)], inner[len(one) + 1 :]])
    rank = np.zeros(n + 3, np.uint64)
    rank[sample] = name
    a = lambda i: pad[i] << np.uint64(32) | rank[i + 1]
    b = lambda i: pad[i] << np.uint64(43) | pad[i + 1] << np.uint64(22) | rank[i + 2]
    # Both sides of each count are sorted: searching for sorted values stays in the cache.
    a0, a1, b0, b2 = a(zero), a(one), b(zero), b(two)
    oa, ob, o1, o2 = (np.argsort(x) for x in (a0, b0, a1, b2))
    sa0, sb0, sa1, sb2 = a0[oa], b0[ob], a1[o1], b2[o2]
    rank0 = np.empty(len(zero), np.int64)
    rank0[oa] = np.searchsorted(sa0, sa0) + np.searchsorted(sa1, sa0)
    add = np.empty(len(zero), np.int64)
    add[ob] = np.searchsorted(sb2, sb0)
    # How many names lie below each is a running sum.
    below = np.cumsum(np.bincount(name + 1))
    smaller = np.empty(n, np.int64)
    smaller[zero] = rank0 + add
    before = np.empty(len(one), np.int64)
    before[o1] = np.searchsorted(sa0, sa1)
    smaller[one] = below[name[: len(one)]] + before
    before = np.empty(len(two), np.int64)
    before[o2] = np.searchsorted(sb0, sb2)
    smaller[two] = below[name[len(one) :]] + before
    return smaller + 1


def repeated_starts(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text: the places where SPAN bytes start that also start elsewhere in one of the texts."""
    sizes = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    begin = np.cumsum(np.r_[0, sizes[:-1] + 1])
    s = joined.astype(np.int64) + 2
    s[begin + sizes] = 1
    order = np.argsort(suffix_ranks(s), kind="stable")
    room = np.zeros(len(s), bool)
    for at, n in zip(begin, sizes):
        room[at : at + max(0, n - SPAN + 1)] = True
    order = order[room[order]]
    repeated = np.zeros(len(s), bool)
    if len(order) > 1:
        view = np.lib.stride_tricks.sliding_window_view(joined, SPAN)
        for lo in range(0, len(order) - 1, 1 << 14):
            x, y = order[lo : lo + (1 << 14)], order[lo + 1 : lo + 1 + (1 << 14)]
            x = x[: len(y)]
            same = (view[x] == view[y]).all(axis=1)
            repeated[x[same]] = repeated[y[same]] = True
    return [np.flatnonzero(repeated[at : at + n]) for at, n in zip(begin, sizes)]


def runs(starts: np.ndarray) -> list[int]:
    """First and last of each run of neighbouring starts, flat."""
    if not len(starts):
        return []
    edge = np.flatnonzero(np.r_[True, starts[1:] != starts[:-1] + 1])
    return np.stack([starts[edge], starts[np.r_[edge[1:], len(starts)] - 1]], axis=1).ravel().tolist()


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: removed has the maximal runs (start, end) of bytes that went, kept
    the bytes that are left.

    A byte goes if a string of SPAN bytes that covers it also starts anywhere else in df, judged on the texts as given.
    A null text counts as empty; a text of fewer than SPAN bytes stays. Repeated rows with one id and text are texts
    of their own, so both lose all that is long enough; those with one id and other texts, and those with a null id, are
    texts like others. Other columns are ignored; an empty df gives no rows. Texts may be any length.
    """
    spark = df.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    doc_id = F.col(id_col).cast("bigint")
    # A row's key: id and print, so that a null id is one more id.
    docs = df.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("id"), doc_id.isNull().alias("no_id"), text.alias("text"))
    docs = docs.withColumn("print", F.xxhash64("no_id", "text"))

    def find(batches):
        for b in batches:
            out = [windows(raw.as_py()) for raw in b["text"]]
            often = [len(x[0]) for x in out]
            if sum(often):
                h, first, last, at = (np.concatenate(x) for x in zip(*out))
                ids, prints = (np.repeat(b[c].to_numpy(), often) for c in ("id", "print"))
                yield pa.record_batch({"id": ids, "print": prints, "gram": h, "first": first.astype(np.int32), "more": (last - first).astype(np.int32), "lead": (at - first).astype(np.int32)})

    grams = stored(docs.select("id", "print", "text").mapInArrow(find, "id bigint, print bigint, gram bigint, first int, more int, lead int"), "grams")
    # Stored, as a join with an aggregation of its own key is never split; a passage in many texts makes a hot gram.
    often = stored(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "often")
    # A window's first start, how many starts follow it, and where its gram lies: three short columns in a file (they
    # have few values), but one number in a shuffled row.
    place = F.expr("shiftleft(cast(first as bigint), 16) | shiftleft(more, 8) | lead").alias("place")
    places = grams.select("id", "print", "gram", place).join(often.hint("merge"), "gram").groupBy("id", "print").agg(F.collect_set(F.struct("gram", "place")).alias("places"))

    def cut(batches):
        for b in batches:
            listed, often = b["places"].flatten(), b["places"].value_lengths().to_numpy()
            gram, place = (listed.field(c).to_numpy() for c in ("gram", "place"))
            # Repeated rows list each place once, as sets are collected; a text's places differ in their first start.
            pick = np.lexsort((place >> 16, np.repeat(np.arange(len(often)), often)))
            gram, place = gram[pick], place[pick]
            first, lead = (place >> 16).astype(np.int32), (place & 0xFF).astype(np.int32)
            last = first + (place >> 8 & 0xFF)
            ids, prints = (np.repeat(b[c].to_numpy(), often) for c in ("id", "print"))
            ends, cuts = np.cumsum(often), []
            for raw, lo, hi in zip(b["text"], ends - often, ends):
                raw = raw.as_py()
                cuts += [raw[x : y + SPAN] for x, y in zip(first[lo:hi].tolist(), last[lo:hi].tolist())]
            yield pa.record_batch({"id": ids, "print": prints, "gram": gram, "first": first, "lead": lead, "text": pa.array(cuts, pa.binary())})

    found = docs.join(places, ["id", "print"]).select("id", "print", "text", "places").mapInArrow(cut, "id bigint, print bigint, gram bigint, first int, lead int, text binary")
    found = stored(found.withColumn("window", F.unhex(F.md5("text"))), "windows")
    dropped(grams, often)
    alike = found.groupBy("gram", "window", "lead").agg(F.count("*").alias("n"), F.any_value("text").alias("text"))
    alike = stored(alike, "distinct-windows")
    groups = stored(alike.groupBy("gram").agg(F.count("*").alias("windows")).where("windows > 1"), "gram-windows")
    todo = alike.join(groups.hint("merge"), "gram")

    schema = "gram bigint, window binary, lead int, runs array<int>"

    def answer(rows, found_runs):
        return pa.record_batch({"gram": pa.array([r[0] for r in rows], pa.int64()), "window": pa.array([r[1] for r in rows], pa.binary()), "lead": pa.array([r[2] for r in rows], pa.int32()), "runs": pa.array(found_runs, pa.list_(pa.int32()))})

    def sort(batches):
        held, size = [], 0

        def flush():
            out = [(r, runs(s)) for r, s in zip(held, repeated_starts([r[3] for r in held]))]
            out = [(r, x) for r, x in out if x]
            return answer([r for r, _ in out], [x for _, x in out])

        for b in batches:
            for r in zip(*(b[c].to_pylist() for c in ("gram", "window", "lead", "text"))):
                if held and r[0] != held[-1][0] and size >= SORTED // 2:  # a gram's windows stay together
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r[3]) + 1
        if held:
            yield flush()

    few = todo.where(F.col("windows") <= MOST).select("gram", "window", "lead", "text").repartition("gram").sortWithinPartitions("gram")
    marked = few.mapInArrow(sort, schema)

    def strings(batches):
        for b in batches:
            for r in zip(*(b[c].to_pylist() for c in ("gram", "window", "lead", "text"))):
                raw = np.frombuffer(r[3], np.uint8)
                d, e = digests(prefix_sums(raw), SPAN), digests(prefix_sums(raw[::-1]), SPAN)[::-1]
                n = len(d)
                yield pa.record_batch({"gram": pa.array([r[0]] * n), "window": pa.array([r[1]] * n, pa.binary()), "lead": pa.array([r[2]] * n, pa.int32()), "start": pa.array(np.arange(n, dtype=np.int32)), "d": pa.array(d.astype(np.int64)), "e": pa.array(e.astype(np.int64))})

    each = stored(todo.where(F.col("windows") > MOST).select("gram", "window", "lead", "text").mapInArrow(strings, "gram bigint, window binary, lead int, start int, d bigint, e bigint"), "strings")
    twice = each.groupBy("d", "e").agg(F.count("*").alias("n")).where("n > 1").select("d", "e")
    hot = each.join(twice, ["d", "e"]).groupBy("gram", "window", "lead").agg(F.flatten(F.collect_list(F.array("start", "start"))).alias("runs"))
    # A window that occurs twice repeats as a whole; then its other marks add nothing.
    whole = alike.where("n > 1").select("gram", "window", "lead", F.array(F.lit(0), (F.octet_length("text") - SPAN).cast("int")).alias("runs"))
    marks = whole.union(marked.union(hot).join(whole.select("gram", "window", "lead"), ["gram", "window", "lead"], "left_anti"))
    spans = found.select("id", "print", "gram", "first", "lead", "window").join(marks, ["gram", "window", "lead"])
    spans = stored(spans.groupBy("id", "print").agg(F.flatten(F.collect_set(F.transform("runs", lambda r: r + F.col("first")))).alias("marks")), "spans")
    dropped(found, alike, groups, each)

    def remove(batches):
        for b in batches:
            removed, kept = [], []
            for raw, marks in zip(b["text"].to_pylist(), b["marks"].to_pylist()):
                gone: list[list[int]] = []
                for lo, hi in sorted(zip((marks or [])[::2], (marks or [])[1::2])):
                    if gone and lo <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], hi + SPAN)
                    else:
                        gone.append([lo, hi + SPAN])
                removed.append([{"start": lo, "end": hi} for lo, hi in gone])
                at, parts = 0, []
                for lo, hi in gone:
                    parts.append(raw[at:lo])
                    at = hi
                kept.append(b"".join([*parts, raw[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch({"doc_id": b["id"], "n_bytes": b["n_bytes"], "removed": pa.array(removed, kind), "kept": pa.array(kept, pa.binary())})

    joined = docs.join(spans.hint("merge"), ["id", "print"], "left").select(F.when(~F.col("no_id"), F.col("id")).alias("id"), F.octet_length("text").cast("bigint").alias("n_bytes"), "text", "marks")
    return joined.mapInArrow(remove, "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")


def op8_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
