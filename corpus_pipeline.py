"""The corpus pipeline: language ID, exact dedup, near-duplicate dedup, substring dedup, packing.

Each stage takes what its predecessor kept; all but the last return the columns of documents, and other columns of its
input are dropped. Every stage gives no rows for an empty table, and takes null and repeated ids, null texts, languages
and sources, and texts of any length; what becomes of them is said at each.
"""

from pyspark.sql import functions as F

from tessera.llm import byte_bpe, exact_dedup, language, near_dedup, packing, substring_dedup
from tessera.llm.common import dropped, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark, docs, sf_dir):
    """Learns from the labelled documents; those in no language (`und`: null texts and those without a letter) go.

    Short texts are close calls between languages, so a low score alone rejects none. Repeated rows, and rows with a
    null id, are judged each; without any labelled document all are `und`.
    """
    model = language.train(docs, "doc_id", "text", "lang", language.remainder("doc_id") != 2)
    judged = language.identify(docs.select(*COLUMNS), model)
    return judged.where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def numbered(docs):
    """docs with a number of its own for each row, as doc_id may be null or repeated; stored, so that it stays the same."""
    return stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")


def drop_copies(spark, docs, sf_dir):
    """Of equal texts the one row that exact_dedup keeps stays: the longest as given, then the smallest doc_id, null after
    all others, then the first row. Null texts are equal to empty ones. Other texts stay, whatever ids they share."""
    docs = numbered(docs)
    keep = exact_dedup.exact_dedup(docs, row_col="_row").where("kept").select("_row")
    return docs.join(keep, "_row", "left_semi").select(*COLUMNS)


def drop_near_copies(spark, docs, sf_dir):
    """Of each class of near-duplicates the row with the smallest doc_id stays; a null doc_id comes after all others, and
    of rows with one id the first. Null texts, and texts without a word, are classes of their own and stay."""
    docs = numbered(docs)
    classes = near_dedup.near_dedup(docs, id_col="_row").select(F.col("doc_id").alias("_row"), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    keep = classes.join(docs.select("_row", "doc_id"), "_row").groupBy("class_id").agg(first.alias("x")).select(F.col("x._row").alias("_row"))
    return docs.join(keep, "_row", "left_semi").select(*COLUMNS)


def drop_lines(spark, docs, sf_dir):
    """Repeated passages go, as in op5; every row stays, also one left without text, with the length of what is left. A
    null text stays null. Rows lose text each by themselves, whatever ids they share."""
    out = substring_dedup.substring_dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack(spark, docs, sf_dir):
    """One row per piece of a row's text in a sequence, as in op7. Null texts are empty: their end id alone."""
    pieces = packing.pack(docs, byte_bpe.default_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_lines),
    ("packing", pack),
]

#: Learned models, sampling and a tokenizer can't be expressed in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(*before)  # its successor is stored
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
