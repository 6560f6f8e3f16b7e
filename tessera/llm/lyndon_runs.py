"""Periodic runs of words, found in linear time over a general ordered alphabet, in the way of Ellert and Fischer.

A run is a maximal stretch in which words a period apart are identical. Each run has a Lyndon root: for one of the two
orders of the alphabet some longest Lyndon word lambda(i) = [i, nss(i)) lies in it and has its period, nss(i) being the
start of the next smaller suffix. So all runs come from the Lyndon arrays of both orders: the edge (i, nss(i)) with its
longest common extension to the right, and one to the left.

Both the Lyndon array and the extensions come from one pass with a stack of the suffixes that have no smaller one yet.
Words are only compared, never numbered or hashed, and what has been matched is not matched again:

* The comparison (p, i) that has reached furthest so far shows that what follows i is a copy of what follows p. Inside
  the copy, comparisons come out as they did d = i - p words earlier, as long as they end before its end (`reach`); one
  that gets to the end goes on from there, and moves it.
* When the top p of the stack is popped by i, the extension of i with the next entry q follows from those of (q, p) and
  (p, i): it is the lesser of the two unless they are equal, and then it goes on from there.

So matching moves `reach` on, and a mismatch ends a comparison: both happen at most twice a word.
"""

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table


def edges(t: list, up: bool) -> list[tuple[int, int, int]]:
    """(i, nss(i), extension) of all i whose next smaller suffix begins with an equal word; up: by the words' own order,
    else by its reverse. The end of the text is smaller than any word in either order."""
    n = len(t)
    nss, lce = [n] * n, [0] * n  # next smaller suffix, and the extension with it
    pss, ple = [-1] * n, [0] * n  # previous smaller suffix, and the extension with it
    found = []
    reach = d = base = 0  # t[base:reach] is a copy of what stands d words earlier
    for i in range(1, n):
        p, e = i - 1, 0
        if i < reach:
            m = i - d
            while p >= base:
                q = p - d
                if nss[q] == m:
                    e = lce[q]
                    if i + e >= reach:
                        break
                    nss[p], lce[p] = i, e
                    if e:
                        found.append((p, i, e))
                    last, p = p, pss[p]
                else:  # the copy's suffix stayed on the stack below m
                    e = ple[m] if pss[m] == q else reach
                    break
            if p >= base:
                if i + e < reach:
                    pss[i], ple[i] = p, e
                    continue
                e = reach - i
            elif p < 0:
                continue
            elif ple[last] < e:
                pss[i], ple[i] = p, ple[last]
                continue
            # Else the extension with p is e at least, and the loop below finds it.
        while True:
            if i + e < n and (a := t[i + e]) == t[p + e]:
                e += 1
                while i + e < n and (a := t[i + e]) == t[p + e]:
                    e += 1
            if i + e >= reach:
                reach, d, base = i + e, i - p, i
            if i + e < n and (t[p + e] < a) is up:
                pss[i], ple[i] = p, e
                break
            while True:
                nss[p], lce[p] = i, e
                if e:
                    found.append((p, i, e))
                known, p = ple[p], pss[p]
                if p < 0 or known <= e:
                    break
                if i + e >= reach:
                    d = i - p
            if p < 0:
                break
            if known < e:
                pss[i], ple[i] = p, known
                break
    return found


def runs(t: list, least_exponent: int = 2, least_length: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period), sorted by start and period, of all runs of t with the given least length, which are also
    least_exponent (2 or more) times as long as their period. t: comparable values, such as words."""
    out = []
    for up in (True, False):
        right = {}  # where the run of a root that was seen goes on: (next root's start, period)
        for i, j, e in sorted(edges(t, up)):
            p = j - i
            if e >= p:
                right[j] = p
            if right.pop(i, 0) == p:  # not the run's first root
                continue
            if e + p + p - 1 < max(least_length, least_exponent * p):
                continue
            left = 0
            while left < i and left < p and t[i - left - 1] == t[j - left - 1]:
                left += 1
            if p + e + left >= max(least_length, least_exponent * p):
                out.append((i - left, p + e + left, p))
    out.sort(key=lambda r: (r[0], r[2]))
    return [r for k, r in enumerate(out) if not k or r != out[k - 1]]  # a run that ends the text is found in both orders


def tandem(words: list, key: int) -> list:
    """words, of which one in ten keys has its tail replaced by a repeat of what begins there."""
    h, n = key, len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


#: What is reported: runs of at least this many periods and words.
EXPONENT, LENGTH = 4, 6


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """words without what any of the runs repeats after its first period."""
    out, at = [], 0
    for lo, hi in sorted((s + q, s + n) for s, n, q in found):
        out += words[at:lo]
        at = max(at, hi)
    return out + words[at:]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", change=None) -> DataFrame:
    """A row for each row of df: id, the number of its text's runs of EXPONENT periods and LENGTH words or more; start,
    length, period and floor(1000 * length / period) of the longest (of equally long ones the first, then the one with
    the least period), null if there is none; the digest of all runs, and that of the text without what they repeat.

    change(words, id), if given, alters the words first. A null text has no words. Null and repeated ids, and equal
    texts, count each; other columns are ignored, whatever their names; an empty df gives no rows. Words are what
    stands between ASCII white space; texts may be of any length, as the work grows with their words.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def digest(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def find(batches):
        for b in batches:
            rows = []
            for key, text in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                words = text.split() if text else []
                if change:
                    words = change(words, key)
                found = runs(words, EXPONENT, LENGTH)
                s, n, q = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
                rows.append((len(found), s, n, q, 1000 * n // q if found else None, digest(listed), digest(b" ".join(collapsed(words, found)))))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b["id"], *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(find, f"id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
    return out.withColumnRenamed("id", "doc_id")


def op12_periodic_runs(spark, sf_dir):
    """Rows with a null doc_id are not changed."""
    planted = lambda words, key: words if key is None else tandem(words, zlib.crc32(str(key).encode()))
    return periodic_runs(table(spark, sf_dir, "documents"), change=planted)
