"""Substring deduplication by hashing lines, cut at sentence ends.

A unit is a line of a text, or a part of one that ends where a sentence does: at a full stop, question or exclamation
mark that white space follows. A passage that was pasted into a line is thus found by all its sentences but the one
that runs on from the words before it. Units are normalised (lower case, white space runs become one space, ends
trimmed) and digested; equal digests form a group over all documents. Its earliest unit by (document id, place) stays.
The others are repeats. A run of neighbouring repeats goes if it holds LEAST_RUN words or more: so a passage goes whose
sentences are short, and a short stock line that many documents share stays. What is left of a text is unchanged, and
the offsets of what went are kept.
"""

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, small_batches, stored, table

#: Units of fewer words repeat by chance ("Yes.") and stay.
LEAST_WORDS = 5
#: Words of a run of neighbouring repeats that goes. Measured on 51,282 documents: see the README.
LEAST_RUN = 20
GAP = r"[\x20\x09-\x0D]+"
#: A unit with the white space that ends it; units joined are the text.
PIECE = r"(?s).*?(?:[.!?][\x20\x09-\x0D]+|\n|\z)"
#: What of a unit lies between it and the next.
END = r"([.!?])[\x20\x09-\x0D]+\z|\n\z"


def pieces(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda x: x != "")


def normal_unit(unit: Column) -> Column:
    return F.trim(F.regexp_replace(unit, GAP, " "))


def units_of(rows: DataFrame, least_words: int) -> DataFrame:
    """(row, id, pos, words, digest) of each unit with least_words words or more; rows has row, id and text."""
    units = F.transform(pieces(F.lower("text")), lambda x, i: F.struct(i.alias("pos"), normal_unit(x).alias("unit")))
    sized = F.transform(units, lambda u: F.struct(u["pos"].alias("pos"), F.size(F.split(u["unit"], " ")).alias("words"), u["unit"].alias("unit")))
    long_ones = F.filter(sized, lambda u: u["words"] >= least_words)
    unit = F.explode(F.transform(long_ones, lambda u: F.struct(u["pos"].alias("pos"), u["words"].alias("words"), F.unhex(F.md5(u["unit"].cast("binary"))).alias("digest"))))
    return rows.select("row", "id", unit.alias("u")).select("row", "id", "u.pos", "u.words", "u.digest")


#: PIECE and END for Python, and without a step for each character.
_PIECE = re.compile(r"(?:[^.!?\n]++|[.!?](?![\x20\x09-\x0D]))*+(?:[.!?][\x20\x09-\x0D]++|\n|\Z)")
_END = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+\Z|\n\Z")


def long_runs(repeats: list[tuple[int, int]], least_run: int) -> list[int]:
    """Places of the repeats (pos, words), in order, that lie in runs of neighbours with least_run words or more."""
    out, run, words = [], [], 0
    for pos, n in [*sorted(repeats), (-1, 0)]:
        if run and pos != run[-1] + 1:
            out += run if words >= least_run else []
            run, words = [], 0
        run.append(pos)
        words += n
    return out


def cut_out(text: str, gone: list[int]) -> tuple[str, list[dict]]:
    """(what is left of a text without its units at the places in gone, which are in order; the spans of these in code
    points, without the white space that ends them)."""
    kept, spans, left, at = [], [], iter(gone), 0
    going = next(left, None)
    for i, piece in enumerate(x for x in _PIECE.findall(text) if x):
        if i == going:
            spans.append({"start": at, "end": at + len(_END.sub("", piece))})
            going = next(left, None)
        else:
            kept.append(piece)
        at += len(piece)
    return "".join(kept), spans


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_run: int = LEAST_RUN) -> DataFrame:
    """Rows of df with text replaced, and n_removed (units) and removed (start, end of each removed unit in the
    original text, in code points) added.

    The earliest unit is the one with the smallest id, then row, then place; a null id comes after all others. A null
    or empty text stays as it is. Each row loses what repeats in itself, whatever other rows have its id; of repeated
    rows the first keeps its text. Texts may have any number of units, as the
    work grows with them. Columns of df named like those added are replaced; an empty df gives no rows.
    """
    small_batches(df.sparkSession)
    mine = fresh_name(df, "row"), fresh_name(df, "gone")
    numbered = stored(df.drop("n_removed", "removed").withColumn(mine[0], F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(mine[0]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    units = stored(units_of(rows, least_words), "units")
    rank = F.struct(F.col("id").isNull(), "id", "row", "pos")
    # Stored, as a join with an aggregation of its own key is never split; a stock line makes a hot digest. Both joins
    # are merge joins at every size, so that a small run shows what a large one shuffles.
    repeated = units.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = stored(repeated.select("digest", F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos")), "repeated-units")
    lost = units.select("row", "pos", "words", "digest").join(repeated.hint("merge"), "digest").where("row <> first_row or pos <> first_pos")
    lists = lost.groupBy("row").agg(F.collect_list(F.struct("pos", "words")).alias("gone"), F.sum("words").alias("n")).where(F.col("n") >= least_run)
    gone = stored(lists.select(F.col("row").alias(mine[0]), F.col("gone").alias(mine[1])), "gone-units")
    out = numbered.join(gone.hint("merge"), mine[0], "left").drop(mine[0])
    kept = [f for f in out.schema.fields if f.name != mine[1]]
    schema = T.StructType([*kept, T.StructField("removed", T.ArrayType(T.StructType.fromDDL("start int, end int"))), T.StructField("n_removed", T.LongType())])

    def cut(batches):
        for b in batches:
            texts, removed = b[text_col].to_pylist(), []
            for i, (text, repeats) in enumerate(zip(texts, b[mine[1]].to_pylist())):
                places = long_runs([(r["pos"], r["words"]) for r in repeats], least_run) if repeats else []
                spans = []
                if places:
                    texts[i], spans = cut_out(text, places)
                removed.append(spans)
            new = [pa.array(texts, b[text_col].type) if f.name == text_col else b[f.name] for f in kept]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*new, pa.array(removed, kind), pa.array([len(r) for r in removed], pa.int64())], schema.names)

    return out.mapInArrow(cut, schema)


def op5_substring_dedup(spark, sf_dir):
    """Per document: doc_id, n_removed, the removed spans as start-end pairs, and the text that is left."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_removed", spans.alias("removed_spans"), "text")


_UNITS = rf"""
cut AS (SELECT doc_id, list_filter(regexp_extract_all(text, '{PIECE}'), lambda x: x <> '') AS pieces FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS pos FROM cut),
placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  trim(regexp_replace(lower(piece), '{GAP}', ' ', 'g')) AS unit FROM pieces),
sized AS (SELECT *, len(string_split(unit, ' ')) AS words FROM placed),
judged AS (SELECT *, words >= {LEAST_WORDS} AND row_number() OVER (PARTITION BY unit ORDER BY doc_id, pos) > 1 AS repeat FROM sized),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, repeat ORDER BY pos) AS island FROM judged),
final AS (SELECT *, repeat AND sum(words) OVER (PARTITION BY doc_id, repeat, island) >= {LEAST_RUN} AS gone FROM islands)"""

_LENGTH = r"CASE WHEN regexp_matches(piece, '[.!?][\x20\x09-\x0D]+\z') THEN length(rtrim(piece, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) WHEN suffix(piece, chr(10)) THEN length(piece) - 1 ELSE length(piece) END"

OP5_SQL = rf"""
WITH {_UNITS}
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_spans, '') AS removed_spans,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed,
    string_agg(start::BIGINT || '-' || (start + length(regexp_replace(piece, '{END}', '')))::BIGINT, ',' ORDER BY pos) FILTER (gone) AS removed_spans,
    string_agg(piece, '' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM final GROUP BY doc_id) USING (doc_id)
"""
