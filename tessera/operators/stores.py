"""Queries through stored tables: numbered appends, embeddings and indexes that are written, opened by tag and searched."""

import uuid

from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.storage import stored, working_dir
from ..store.cells import Cells
from ..store.embedder import DIMS, GENTLE, SLOTS, forget, open_embedder, train
from ..store.keyed import KeyedTable
from ..store.memory_index import load_index, merged, save_index
from . import memory


def _place(t, name: str) -> str:
    return f"{working_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("append_numbered", """WITH d AS (SELECT doc_id, md5(text) AS h, doc_id % 2 AS odd FROM documents), a AS (SELECT h, min(doc_id) AS doc_id FROM d WHERE odd = 0 GROUP BY h),
b AS (SELECT h, min(doc_id) AS doc_id FROM d WHERE odd = 1 AND h NOT IN (SELECT h FROM a) GROUP BY h)
SELECT h, doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS vec_index FROM a UNION ALL SELECT h, doc_id, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY doc_id) - 1 FROM b""")
def append_numbered(t):
    """Two batches of documents, the second sent twice, added to a keyed table by the digest of their text."""
    rows = t.documents.select(F.md5(F.col("text").cast("binary")).alias("h"), "doc_id")
    table = KeyedTable.create(t.spark, _place(t, "appended"), rows.withColumn("vec_index", F.lit(0).cast("bigint")).schema, "h")
    for n, part in enumerate(("doc_id % 2 = 0", "doc_id % 2 = 1", "doc_id % 2 = 1")):
        table.append(rows.where(part), "doc_id", "vec_index", ("documents", min(n, 1)))
    return table.read()


_SLOTS = lambda table: f"SELECT id, ('0x' || left(md5(term), 8))::BIGINT % {SLOTS} AS slot, count(*) AS tf FROM ({memory._TERMS.format(tok=memory._TOK.format(t=table))}) GROUP BY 1, 2"
_VECTORS = lambda slots: f"""SELECT id, d, (x / CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY id)) < {GENTLE} THEN 1 ELSE sqrt(sum(x * x) OVER (PARTITION BY id)) END)::FLOAT::DOUBLE AS v FROM
  (SELECT id, slot % {DIMS} AS d, sum(tf * coalesce(idf, ln(n + 1) + 1) * CASE WHEN slot // {DIMS} % 2 = 0 THEN 1 ELSE -1 END) AS x FROM {slots} LEFT JOIN idf USING (slot), n GROUP BY 1, 2)"""  # noqa: E731
_EMBEDDED = f"""n AS (SELECT count(*) AS n FROM documents), ds AS ({_SLOTS('documents')}), idf AS (SELECT slot, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM ds, n GROUP BY slot), dv AS ({_VECTORS('ds')})"""


def _model(t):
    path = _place(t, "embedder")
    train(t.documents, "text", path)
    return open_embedder(t.spark, path)


@query("embed_documents", f"WITH {_EMBEDDED} SELECT doc_id, round(coalesce(sum((d + 1) * v), 0), 4) + 0.0 AS checksum FROM documents LEFT JOIN dv ON id = doc_id GROUP BY doc_id")
def embed_documents(t):
    """Every document's vector, by a model that is learned, stored and opened, as an index by the model's tag holds it."""
    path, model = _place(t, "vectors"), _model(t)
    save_index(t.documents.select("doc_id", "text"), "doc_id", "text", path, model)
    index = load_index(t.spark, path, model)
    v = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return index.records.join(index._in.members, F.col("vec_index") == F.col("id")).select("doc_id", (F.round(v, 4) + 0.0).alias("checksum"))


@query("dense_index_topk", f"""WITH {_EMBEDDED}, qs AS ({_SLOTS('(SELECT item_id AS doc_id, text FROM benchmark)')}), qv AS ({_VECTORS('qs')}),
s AS (SELECT qv.id AS item_id, dv.id AS doc_id, sum(qv.v * dv.v) AS score FROM qv JOIN dv USING (d) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 4) AS score FROM s QUALIFY rank <= 4""")
def dense_index_topk(t):
    """The four documents nearest to each benchmark passage, in a stored dense index."""
    path, model = _place(t, "dense-index"), _model(t)
    save_index(t.documents.select("doc_id", "text"), "doc_id", "text", path, model)
    asked = t.benchmark.select("item_id", F.col("text").alias("asked"))
    return load_index(t.spark, path, model).search(asked, "item_id", "asked", 4).select("item_id", "rank", "doc_id", F.round("score", 4).alias("score"))


@query("stored_index_topk", memory._TOPK + " SELECT item_id, rank, doc_id, round(score, 6) AS score FROM topk")
def stored_index_topk(t):
    """The same by TF-IDF, as there is no model at the path that is asked for one."""
    path, nowhere = _place(t, "sparse-index"), _place(t, "no-embedder")
    forget()
    save_index(t.documents.select("doc_id", "text"), "doc_id", "text", path, open_embedder(t.spark, nowhere))
    asked = t.benchmark.select("item_id", F.col("text").alias("asked"))
    return load_index(t.spark, path).search(asked, "item_id", "asked", 4).select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query("cells_topk", memory._DENSE.replace("ON q.vec_id", "ON q.vec_id % 100 = 0 AND q.vec_id") + " SELECT query, rank, vec_id, round(score, 6) AS score FROM top")
def cells_topk(t):
    """The vectors most similar to each one whose id is divisible by 100, of all."""
    hits, _ = Cells.build(t.embeddings, "vec_id", "embedding", stored).search(t.embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", 4, stored)
    return hits.select("query", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("index_merge_rebuild", "WITH m AS (SELECT 'base' AS file, doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'repair_base', doc_id FROM documents WHERE doc_id % 5 = 0) SELECT file, doc_id, row_number() OVER (ORDER BY file, doc_id) - 1 AS vec_index FROM m")
def index_merge_rebuild(t):
    """The records of an index made anew of two parts, the second's files renamed by a prefix; repeated records stay."""
    part = lambda keep: t.documents.where(keep).select(F.lit("base").alias("file"), "doc_id", "text")
    path = _place(t, "merged-index")
    save_index(merged({"": part("doc_id % 2 = 0"), "repair": part("doc_id % 5 = 0")}), ["file", "doc_id"], "text", path)
    return load_index(t.spark, path).records.select("file", "doc_id", "vec_index")
