"""Hierarchical language identification: first the family, then one-versus-one linear SVMs within it.

A text is described by the relative frequencies of its hashed byte n-grams (one to three bytes of the lower-cased
text, runs of characters that aren't letters taken as one space). Families compete in one-versus-one linear support
vector machines; the languages of the winning family then do so among themselves. All machines are trained on the
driver from a bounded sample: at most PER_LANG labelled documents of each language, those with the smallest hash of
their id and text; equal rows count once there. The whole text of each is read on the executors, and only its SLOTS
frequencies go to the driver.
"""

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import small_batches, table

PER_LANG = 300
SLOTS = 4096
#: Bytes whose n-grams are counted at once.
PIECE = 1 << 21
NOT_LETTERS = regex.compile(r"\P{L}+")
UNKNOWN = "und"
#: ISO 639-1 codes by family. Other codes form one more family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "indo-iranian": "hi ur bn fa pa gu mr ne ps ku si".split(),
    "semitic": "ar he mt am".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tt".split(),
    "east asian": "zh ja ko".split(),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


def letters(text: str | None) -> bytes:
    """The lower-cased letters in UTF-8, other runs as one space; empty if there is no letter."""
    out = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {out}  ".encode() if out else b""


def frequencies(texts: list[bytes]) -> np.ndarray:
    """A row of SLOTS relative n-gram frequencies for each text of letters()."""
    out, lo = np.zeros((len(texts), SLOTS), np.float32), 0
    while lo < len(texts):
        hi, held = lo + 1, len(texts[lo])
        while hi < len(texts) and hi - lo < 256 and held + len(texts[hi]) <= PIECE:
            held += len(texts[hi])
            hi += 1
        for i in range(lo, hi) if hi == lo + 1 else (None,):  # one long text is counted in pieces, several at once
            group = texts[lo:hi]
            size = np.array([len(t) for t in group])
            b = np.frombuffer(b"".join(group), np.uint8).astype(np.uint32)
            owner = np.repeat(np.arange(len(group)), size)
            end = np.repeat(np.cumsum(size), size)
            counts = np.zeros(len(group) * SLOTS)
            for at in range(0, len(b), PIECE):
                p = slice(at, min(at + PIECE, len(b)))
                x, own, left = b[p.start : p.stop + 2], owner[p], end[p] - np.arange(p.start, p.stop)
                n = p.stop - p.start
                x = np.pad(x, (0, max(0, n + 2 - len(x))))
                inside = left > 2
                one, two, three = x[:n], x[:n] | x[1 : n + 1] << 8 | 1 << 24, x[:n] | x[1 : n + 1] << 8 | x[2 : n + 2] << 16 | 2 << 24
                for gram in (one, two, three):
                    slot = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
                    counts += np.bincount((own * SLOTS + slot)[inside], minlength=len(counts))
            counts = counts.reshape(len(group), SLOTS)
            out[lo:hi] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        lo = hi
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by accelerated gradient descent; y is 1 or -1."""
    a = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    v = np.ones(a.shape[1], np.float32)
    for _ in range(10):
        v = a.T @ (weight * (a @ v))
        v /= np.linalg.norm(v) or 1
    rate = 1 / (2 * float(np.linalg.norm(a.T @ (weight * (a @ v)))) * 1.1 + penalty)
    w = z = np.zeros(a.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (a @ z))
        new = z - rate * (penalty * z - 2 * a.T @ (weight * y * slack))
        z, w = new + k / (k + 3) * (new - w), new
    return w


class Model:
    """langs by family, and for each pair of families, and of languages of one family, a weight vector."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        langs = sorted(set(labels))
        self.families = sorted({FAMILY.get(c, "other") for c in langs})
        self.members = [[c for c in langs if FAMILY.get(c, "other") == f] for f in self.families]
        spread = x.std(axis=0)
        self.scale = (1 / (spread + spread.mean() + 1e-9)).astype(np.float32)
        self.mean = x.mean(axis=0)
        z, label = (x - self.mean) * self.scale / np.sqrt(SLOTS), np.array(labels)
        family = np.array([FAMILY.get(c, "other") for c in labels])
        self.groups = [(z, family, self.families), *((z, label, m) for m in self.members)]
        self.groups = [self._fit(*g) for g in self.groups]

    @staticmethod
    def _fit(z, label, names):
        pairs = [(i, j) for i in range(len(names)) for j in range(i)]
        out = []
        for i, j in pairs:
            rows = (label == names[i]) | (label == names[j])
            out.append(fit_svm(z[rows], np.where(label[rows] == names[i], 1, -1).astype(np.float32)))
        return pairs, np.array(out, np.float32).reshape(len(pairs), SLOTS + 1)

    def _contest(self, z: np.ndarray, group: int, n: int):
        """The winner of each row among n, and how sure its closest victory is."""
        pairs, weights = self.groups[group]
        if n == 1:
            return np.zeros(len(z), int), np.ones(len(z))
        margin = z @ weights[:, :-1].T + weights[:, -1]
        wins, total, least = np.zeros((len(z), n)), np.zeros((len(z), n)), np.full((len(z), n), np.inf)
        for k, (i, j) in enumerate(pairs):
            m = margin[:, k]
            wins[:, i] += m > 0
            wins[:, j] += m <= 0
            for c, v in ((i, m), (j, -m)):
                total[:, c] += v
                least[:, c] = np.minimum(least[:, c], v)
        best = np.argmax(wins + np.tanh(total) / 4, axis=1)
        return best, 1 / (1 + np.exp(-3 * np.clip(least[np.arange(len(z)), best], -50, 50)))

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        z = (x - self.mean) * self.scale / np.sqrt(SLOTS)
        family, sure = self._contest(z, 0, len(self.families))
        out: list = [None] * len(x)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(family == f)
            if len(rows):
                best, within = self._contest(z[rows], f + 1, len(members))
                for r, b, s in zip(rows, best, within):
                    out[r] = members[b], float(sure[r] * s)
        return out


def remainder(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def smallest_draws(rows: DataFrame, per_lang: int) -> DataFrame:
    """(lang, draw): the per_lang smallest distinct draws of each language; each task sends on so many at most."""

    def least(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            draws, langs = b["draw"].to_numpy(), b["lang"].dictionary_encode()
            code = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                held[lang] = np.unique(np.concatenate([held.get(lang, draws[:0]), draws[code == i]]))[:per_lang]
        for lang, draws in held.items():
            yield pa.record_batch({"lang": pa.array([lang] * len(draws), pa.string()), "draw": pa.array(draws, pa.int64())})

    kept = rows.select("lang", "draw").mapInArrow(least, "lang string, draw bigint").distinct()
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw"))
    return kept.withColumn("_n", place).where(F.col("_n") <= per_lang).drop("_n")


def train(df: DataFrame, id_col: str, text_col: str, lang_col: str, learnable: Column, per_lang: int = PER_LANG) -> Model | None:
    """A model of at most per_lang learnable documents of each language; None if there is none."""
    labelled = df.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("draw"), F.col(text_col).alias("text"))

    def features(batches):
        for b in batches:
            x = frequencies([letters(t) for t in b["text"].to_pylist()])
            yield pa.record_batch({"lang": b["lang"], "draw": b["draw"], "x": pa.array([r.tobytes() for r in x], pa.binary())})

    small_batches(df.sparkSession)
    draws = smallest_draws(labelled, per_lang)  # per_lang rows a language
    drawn = labelled.join(F.broadcast(draws), ["lang", "draw"]).mapInArrow(features, "lang string, draw bigint, x binary")
    kept = sorted(drawn.dropDuplicates(["lang", "draw"]).toLocalIterator(), key=lambda r: (r.lang, r.draw))
    if not kept:
        return None
    return Model(np.array([np.frombuffer(r.x, np.float32) for r in kept]), [r.lang for r in kept])


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of df with lang_pred and score (0 to 1) added.

    A null text, or one without a letter, is `und` with score 0, and so is every text if there was nothing to learn
    from. Repeated rows and null ids are judged like others; columns named like those added are replaced; an empty df
    gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = df.drop("lang_pred", "score")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def judge(batches):
        for b in batches:
            texts = [letters(t) for t in b[text_col].to_pylist()]
            some = [i for i, t in enumerate(texts) if t]
            out = [(UNKNOWN, 0.0)] * len(texts)
            if some and shared.value is not None:
                for i, p in zip(some, shared.value.predict(frequencies([texts[i] for i in some]))):
                    out[i] = p
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(judge, schema)


def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, "doc_id", "text", "lang", remainder("doc_id") != 2)
    judged = identify(docs.select("doc_id", "text", (remainder("doc_id") == 2).alias("held_out")), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score")
