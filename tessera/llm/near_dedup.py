"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles of five words. A shingle's weight is its count in the document times its
inverse document frequency, which is the mean of its words'. Words' document frequencies are counted over all documents
by a distributed aggregation; one of fewer than one in RARE documents counts as that many, so the table of the others,
which every task needs, has at most RARE entries for each distinct word of a mean document. Improved consistent weighted sampling draws BANDS x ROWS samples that
two documents share with the probability of their weighted Jaccard similarity. Documents that share all ROWS samples of
a band meet in a bucket, and links between them are verified by the exact weighted Jaccard similarity of their shingles.

A bucket may hold a third of all documents, so its pairs are not listed. Equal texts are one node from the start. In
each bucket all nodes are first compared with the one that shares most buckets with others; this settles copies of one
original. Nodes that do not join its component go on: of the pairs that they form only those are compared that share a
rare shingle, by the prefix filter, and whose similarities with a common hub don't rule them out: one minus the weighted
Jaccard similarity is a metric, so two nodes whose distances from a hub differ by more than the threshold allows are
further apart than that. Neither loses a pair that reaches the threshold.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import dropped, small_batches, stored, table
from .components import components
from .shingles import Numbers, mix, shingles, words

THRESHOLD = 0.8
BANDS, ROWS = 12, 3
#: Words of fewer than one in RARE documents are equally rare.
RARE = 1000
#: Shingles sampled at once, and members that a hub's text is sent out once for.
CHUNK = 1 << 17
MEMBERS = 400
TEXT_BYTES = 1 << 20


def _gamma_table(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1), by bisection of its distribution function 1 - (1 + x) exp(-x)."""
    q = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return ((lo + hi) / 2).astype(np.float32)


_GAMMA = _gamma_table()
_LOG_GAMMA = np.log(_GAMMA)


class Rarity:
    """Inverse document frequency of word hashes: ln((1 + N) / (1 + df)) + 1, df being least or more."""

    def __init__(self, words: np.ndarray, df: np.ndarray, n: int, least: int):
        weigh = lambda d: np.log((1 + n) / (1 + np.asarray(d, float))) + 1
        # The last entry is that of all other words, which the table numbers -1.
        self.values = np.r_[weigh(df), weigh(least)].astype(np.float32)
        self.numbers = Numbers(max(4, (2 * len(words)).bit_length()))
        self.numbers.add(words, 0)

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.values[self.numbers.find(h)]


def weighted_set(h: np.ndarray, idf: Rarity) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles, weights) of a text's word hashes."""
    s, value = shingles(h, idf.of(h))
    found, first, often = np.unique(s, return_index=True, return_counts=True)
    return found, value[first] * often.astype(np.float32)


def samples(sets: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """n consistent weighted samples, as hashes, of each of the sets, none of which is empty."""
    s, w = np.concatenate([x for x, _ in sets]), np.concatenate([y for _, y in sets])
    begin = np.cumsum([0] + [len(x) for x, _ in sets])[:-1]
    log_w, place, out = np.log(w), np.arange(len(s), dtype=np.uint64), np.empty((len(sets), n), np.uint64)
    low16 = np.uint64(0xFFFF)
    for k in range(n):
        u = mix(s + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r = _GAMMA[(u & low16).astype(np.int64)]
        beta = ((u >> np.uint64(16)) & low16).astype(np.float32) / np.float32(65536)
        t = np.floor(log_w / r + beta)
        cost = _LOG_GAMMA[((u >> np.uint64(32)) & low16).astype(np.int64)] - r * (t - beta + 1)
        bits = cost.view(np.uint32)  # as integers of the same order
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
        best = (np.minimum.reduceat(bits.astype(np.uint64) << np.uint64(32) | place, begin) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[:, k] = s[best] + t[best].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    shared = np.minimum(x, y).sum()
    return float(shared / (a[1].sum(dtype=float) + b[1].sum(dtype=float) - shared)) if len(a[0]) and len(b[0]) else 0.0


def grouped(texts: list[str]):
    """Ranges of texts of at most TEXT_BYTES characters, or one text."""
    lo = 0
    while lo < len(texts):
        hi, held = lo + 1, len(texts[lo])
        while hi < len(texts) and held + len(texts[hi]) <= TEXT_BYTES:
            held += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def word_hashes(texts: list[str]):
    for lo, hi in grouped(texts):
        h, ends = words(texts[lo:hi])
        for a, b in zip(np.r_[0, ends[:-1]], ends):
            yield h[a:b]


def rarity(docs: DataFrame) -> Rarity:
    """Document frequencies of all words; those of RARE-th of the documents or more go to the driver and the tasks."""

    def count(batches):
        held, n = [], 0

        def settle():
            words, place = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return words, np.bincount(place, np.concatenate([d for _, d in held]), len(words)).astype(np.int64)

        for b in batches:
            for h in word_hashes(b["text"].to_pylist()):
                own = np.unique(h)
                held.append((own, np.ones(len(own), np.int64)))
                n += 1
            if len(held) > 4096:
                held = [settle()]
        if held:
            words, df = settle()
            for lo in range(0, len(words), CHUNK):
                yield pa.record_batch({"word": pa.array(words[lo : lo + CHUNK].astype(np.int64)), "df": pa.array(df[lo : lo + CHUNK])})
        yield pa.record_batch({"word": pa.array([None], pa.int64()), "df": pa.array([n], pa.int64())})

    seen = docs.select("text").mapInArrow(count, "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df"))
    seen = stored(seen, "word-frequencies")
    total = seen.where("word is null").first()
    n = total.df if total else 0
    least = max(1, n // RARE)
    rows = seen.where(F.col("word").isNotNull() & (F.col("df") > least)).toArrow()
    dropped(seen)
    return Rarity(rows["word"].to_numpy().astype(np.uint64), rows["df"].to_numpy(), n, least)


def signatures(docs: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    """(id, print, digest, keys): digest of the words of the text, null if it has none, and a key for each band."""

    def sign(batches):
        for b in batches:
            ids, texts = b["id"].to_pylist(), b["text"].to_pylist()
            digests, keys, held, at = [], [], [], []

            def flush():
                if held:
                    drawn = samples(held, bands * rows).reshape(len(held), bands, rows)
                    for i, d in zip(at, drawn):
                        key = np.arange(1, bands + 1, dtype=np.uint64)
                        for r in range(rows):
                            key = mix(key * np.uint64(0xA0761D6478BD642F) + d[:, r])
                        keys[i] = key.astype(np.int64)
                held.clear()
                at.clear()

            size = 0
            for i, h in enumerate(word_hashes(texts)):
                keys.append(np.empty(0, np.int64))
                digests.append(None)
                if len(h):
                    order = np.arange(1, len(h) + 1, dtype=np.uint64)
                    two = mix(h * np.uint64(0xE7037ED1A0B428DB) + order).sum(), mix(h ^ (order * np.uint64(0x94D049BB133111EB))).sum()
                    digests[-1] = b"".join(int(x).to_bytes(8, "little") for x in two)
                    held.append(weighted_set(h, idf.value))
                    at.append(i)
                    size += len(held[-1][0])
                    if size >= CHUNK:
                        flush()
                        size = 0
            flush()
            ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.record_batch({"id": pa.array(ids, pa.int64()), "print": b["print"], "digest": pa.array(digests, pa.binary()), "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    return docs.mapInArrow(sign, "id bigint, print bigint, digest binary, keys array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b, similarity) of the distinct pairs (hub, node) whose texts reach the threshold.

    A hub's text is sent to each MEMBERS of its members, ahead of them, and they are read one after another.
    """
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    member = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "node")
    hub = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("hub").alias("node"))
    rows = member.union(hub).join(texts, "node").select("hub", "salt", "kind", "node", "text")
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind", "node")

    def compare(batches):
        current, mine = None, None
        for b in batches:
            out = []
            kinds, hubs, nodes = b["kind"].to_pylist(), b["hub"].to_pylist(), b["node"].to_pylist()
            for kind, h, node, x in zip(kinds, hubs, nodes, word_hashes(b["text"].to_pylist())):
                x = weighted_set(x, idf.value)
                if kind == 0:
                    current, mine = h, x
                elif current == h and (found := similarity(mine, x)) >= threshold:
                    out.append((h, node, found))
            yield pa.record_batch({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64()), "similarity": pa.array([o[2] for o in out], pa.float64())})

    return dealt.mapInArrow(compare, "a bigint, b bigint, similarity double")


def prefixes(nodes: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(node, token, df, all, rest): the shared shingles of each node's prefix, the node's weight, and that of its shared
    shingles from this one on, in the order of (df, token). Two nodes that reach the threshold have a token in common.

    Shingles are taken from the rarest on, until those not taken weigh less than the threshold's share of the node.
    """

    def explode(batches):
        for b in batches:
            for node, h in zip(b["node"].to_pylist(), word_hashes(b["text"].to_pylist())):
                s, w = weighted_set(h, idf.value)
                yield pa.record_batch({"node": pa.array(np.full(len(s), node), pa.int64()), "token": pa.array(s.astype(np.int64)), "weight": pa.array(w.astype(np.float64))})

    tokens = stored(texts.join(nodes, "node").select("node", "text").mapInArrow(explode, "node bigint, token bigint, weight double"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(often, "token", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    order = W.partitionBy("node").orderBy("df", "token").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    whole = W.partitionBy("node")
    shared = F.when(F.col("df") > 1, F.col("weight")).otherwise(0.0)
    rest = F.sum(shared).over(whole) - F.coalesce(F.sum(shared).over(order), F.lit(0.0))
    ranked = ranked.withColumn("before", before).withColumn("all", F.sum("weight").over(whole)).withColumn("rest", rest)
    kept = ranked.where((F.col("before") <= (1 - threshold + 1e-6) * F.col("all")) & (F.col("df") > 1))
    kept = stored(kept.select("node", "token", "df", "all", "rest"), "prefixes")
    dropped(tokens)
    return kept


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) of every row of df: documents of one class are linked by pairs that reach the threshold.

    class_id is the class's smallest doc_id, null if none of its documents has one. A text with fewer than five words has
    one shingle, all its words; a null text, or one without words, is a class of its own. Rows are documents each, also
    those that share an id or have none; equal texts are always one class. Other columns are ignored; an empty df gives
    no rows. Ids must be integers.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
    idf = spark.sparkContext.broadcast(rarity(docs))
    signed = stored(signatures(docs, idf, bands, rows), "signatures")
    # Equal word sequences are one node: its number, its smallest id, and the print of one of its texts.
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print", "keys"))
    nodes = signed.where("digest is not null").groupBy("digest").agg(one.alias("x")).select("digest", "x.id", "x.print", "x.keys")
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    placed = nodes.select("node", F.explode("keys").alias("key"))
    # Both are stored, as a join with an aggregation of its own key is never split, and a bucket may be hot.
    full = stored(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "full-buckets")
    met = stored(placed.join(full.hint("merge"), "key"), "buckets")
    degree = met.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = met.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("x")).select("key", (-F.col("x.minus")).alias("hub"))
    hubs = stored(hubs, "hubs")
    star = stored(met.join(hubs.hint("merge"), "key").select("key", "hub", "node"), "stars")
    asked = nodes.join(met.select("node").distinct(), "node").select("node", "id", "print")
    named = docs.select(F.col("id").alias("d_id"), F.col("print").alias("d_print"), "text")
    texts = stored(named.join(asked, F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_print") == F.col("print"))).dropDuplicates(["node"]).select("node", "text"), "texts")
    rays = stored(verified(star.where("hub <> node").select("hub", "node").distinct(), texts, idf, 0.0), "rays")
    links = rays.where(F.col("similarity") >= threshold).select("a", "b")

    label = components(links)
    of = lambda c, name: label.select(F.col("node").alias(c), F.col("class_id").alias(name))
    labelled = star.join(of("node", "mine"), "node", "left").join(of("hub", "hubs"), "hub", "left")
    labelled = stored(labelled.select("key", "hub", "node", F.coalesce("mine", "node").alias("mine"), F.coalesce("hubs", "hub").alias("hubs")), "labelled")
    rest = labelled.where("mine <> hubs")
    keys = rest.select("key").distinct()
    there = labelled.join(keys, "key", "left_semi")
    # Nodes that meet in no bucket with one of the rest need no tokens, nor does a bucket of two, which its hub settled.
    many = there.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").select("key")
    there = there.join(many, "key", "left_semi").select("key", "hub", "node", "mine", "hubs")
    working = [nodes, full, met, hubs, star, texts, rays, labelled]
    if not there.isEmpty():
        prefix = prefixes(there.select("node").distinct(), texts, idf, threshold)
        of_node = there.groupBy("node").agg(F.any_value("mine").alias("mine"), F.bool_or(F.col("mine") != F.col("hubs")).alias("open"))
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"])
        listed = prefix.groupBy("node").agg(in_order.alias("tokens"))
        # A node's distances from its buckets' hubs, of which there are as many as bands at most, and from itself as one.
        away = rays.select(F.col("b").alias("node"), F.col("a").alias("hub"), (1 - F.col("similarity")).alias("d"))
        away = away.union(rays.select(F.col("a").alias("node"), F.col("a").alias("hub"), F.lit(0.0).alias("d")).distinct())
        away = away.groupBy("node").agg(F.collect_list(F.struct("hub", "d")).alias("away"))
        tagged = stored(of_node.join(listed, "node").join(away, "node", "left").join(prefix, "node"), "tagged")
        side = lambda n: tagged.select("token", F.col("node").alias(n), F.col("mine").alias(f"{n}_class"), F.col("open").alias(f"{n}_open"), F.col("all").alias(f"{n}_all"), F.col("rest").alias(f"{n}_rest"), F.col("tokens").alias(f"{n}_tokens"), F.col("away").alias(f"{n}_away"))
        # Of the tokens that two nodes share, the first in order makes their row. What they share lies from it on, and is
        # at most what either shares with any node there: copies with edits of their own go no further.
        once = F.get(F.array_intersect("x_tokens", "y_tokens"), F.lit(0)) == F.col("token")
        most = F.least("x_rest", "y_rest")
        reach = most >= (threshold - 1e-6) * (F.col("x_all") + F.col("y_all") - most)
        apart = F.exists("x_away", lambda h: F.exists("y_away", lambda g: (g["hub"] == h["hub"]) & (F.abs(g["d"] - h["d"]) > 1 - threshold + 1e-6)))
        near = ~F.coalesce(apart, F.lit(False))
        shared = side("x").join(side("y"), "token").where(F.expr("x < y and x_class <> y_class and (x_open or y_open)") & reach & near & once)
        pairs = stored(shared.select(F.col("x").alias("hub"), F.col("y").alias("node")), "pairs")
        more = verified(pairs, texts, idf, threshold)
        label = components(links.union(more.select("a", "b")))
        working += [prefix, tagged, pairs]
    member = nodes.select("digest", "node", "id").join(label, "node", "left").select("digest", "id", F.coalesce("class_id", "node").alias("class"))
    least = stored(member.groupBy("class").agg(F.min("id").alias("class_id")), "classes")
    classes = stored(member.join(least.hint("merge"), "class").select("digest", "class_id"), "digest-classes")
    dropped(*working, least)
    out = signed.join(classes, "digest", "left").select(F.col("id").alias("doc_id"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))
    return out


def op1_near_dedup(spark, sf_dir):
    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))
