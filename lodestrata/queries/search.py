"""Text and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.scalars import tokens
from lodestrata.operators import joins as J
from lodestrata.operators import search as T
from lodestrata.operators import vector as V
from lodestrata.queries.registry import query, t
from lodestrata.sources.tables import shared_folder
from lodestrata.types import TableSpec

DOCS = TableSpec("documents", creation="n_chars", id="doc_id").search_index("by_text", "text", "lang", "source")
VECTORS = TableSpec("embeddings", creation="vec_id", id="vec_id").vector_index("by_embedding", "embedding", 64, "label")

_TOKENS = "[substring(x, 1, 32) FOR x IN regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')]"


def bm25_sql(words: list[str], prefix: str, where: str = "true", table: str = "documents", limit: int = 20, digits: int = 5) -> str:
    """The scoring rule in SQL, independent of the Column version: positions as rows, spans by windows."""
    groups = len(words) + 1
    tests = [f"CASE WHEN term = '{w}' THEN {k} END" for k, w in enumerate(words)] + [f"CASE WHEN starts_with(term, '{prefix}') THEN {groups - 1} END"]
    hits = " UNION ALL ".join(f"SELECT doc_id, pos, {x} AS g FROM toks WHERE {x} IS NOT NULL" for x in tests)
    span = ""
    if groups > 1:
        lasts = ", ".join(f"max(CASE WHEN g = {k} THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos, g ROWS UNBOUNDED PRECEDING) AS l{k}" for k in range(groups))
        low = "least(" + ", ".join(f"l{k}" for k in range(groups)) + ")"
        present = " AND ".join(f"l{k} IS NOT NULL" for k in range(groups))
        span = f", spans AS (SELECT doc_id, min(pos - {low} + 1) AS span FROM (SELECT doc_id, pos, {lasts} FROM hits) WHERE {present} GROUP BY doc_id)"
    bonus = f" + {T.EXACT_BONUS} * sum(CASE WHEN g < {groups - 1} THEN tf ELSE 0 END)" if groups > 1 else ""
    near = f" + {T.NEAR_BONUS} / any_value(span)" if groups > 1 else ""
    return (
        f"WITH docs AS (SELECT *, {_TOKENS} AS w FROM {table}), lens AS (SELECT doc_id, len(w) AS len FROM docs), st AS (SELECT count(*) AS n, avg(len) AS a FROM lens), "
        f"toks AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM docs), hits AS ({hits}), tf AS (SELECT doc_id, g, count(*) AS tf FROM hits GROUP BY doc_id, g), df AS (SELECT g, count(*) AS df FROM tf GROUP BY g){span}, "
        f"sc AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {T.K1 + 1}) / (tf + {T.K1} * (CASE WHEN len = 0 OR a = 0 THEN 1 ELSE {1 - T.B} + {T.B} * len / a END))){bonus}{near} AS s, count(*) AS k "
        f"FROM tf JOIN df USING (g) JOIN lens USING (doc_id) CROSS JOIN st{' JOIN spans USING (doc_id)' if groups > 1 else ''} GROUP BY doc_id) "
        f"SELECT doc_id, round(s, {digits}) AS score FROM sc JOIN docs USING (doc_id) WHERE k = {groups} AND {where} ORDER BY round(s, {digits}) DESC, n_chars DESC, doc_id LIMIT {limit}"
    )


_INDEXES: dict[tuple, T.SearchIndex] = {}


def _index(spark, d) -> T.SearchIndex:
    """The documents' index, made once in a session for each state of their files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, str(d), fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength())
    if key not in _INDEXES:
        _INDEXES[key] = T.SearchIndex(spark, shared_folder(spark, "search-index"), "text", "doc_id").add(t(spark, d, "documents"))
    return _INDEXES[key]


def _search(df, index: T.SearchIndex, text: str, filters: dict | None = None, limit: int = 20, visible=None):
    plan = T.plan_search(DOCS, "by_text", "text", text, filters)
    return T.search_index(df, index, plan, "n_chars", visible, limit=limit, digits=5).select("doc_id", F.col("_score").alias("score"))


@query(bm25_sql([], "pathetic"))
def search_single(spark, d):
    return _search(t(spark, d, "documents"), _index(spark, d), "Pathetic")


@query(bm25_sql([], "lic"))
def search_prefix(spark, d):
    return _search(t(spark, d, "documents"), _index(spark, d), "lic")


@query(bm25_sql(["the"], "an", "lang = 'en' AND source = 'src0'"))
def search_multi_filter(spark, d):
    return _search(t(spark, d, "documents"), _index(spark, d), "the an", {"lang": "en", "source": "src0"})


@query(bm25_sql(["of", "the"], "th"))
def search_proximity(spark, d):
    return _search(t(spark, d, "documents"), _index(spark, d), "of THE th")


@query(bm25_sql(["the"], "an", "lang = 'en' AND n_chars % 3 <> 0"))
def search_visible(spark, d):
    """Of what is found, what a reader may see."""
    return _search(t(spark, d, "documents"), _index(spark, d), "the an", visible=(F.col("lang") == "en") & (F.col("n_chars") % 3 != 0))


_OVERLAID = "(SELECT doc_id, CASE WHEN lang = 'de' THEN 'the worth of ' || source ELSE text END AS text, lang, source, n_chars FROM documents WHERE lang <> 'fr')"


def _overlaid(spark, d):
    """Documents, pending writes over them, and both together."""
    docs = t(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    text = F.concat(F.lit("the worth of "), F.col("source"))
    pending = docs.where("lang IN ('de', 'fr')").withColumn("_deleted", F.col("lang") == "fr").withColumn("text", text)
    return docs, pending, J.overlay(docs, pending, "doc_id")


@query(bm25_sql(["the"], "wor", table=_OVERLAID))
def search_overlay(spark, d):
    plan = T.plan_search(DOCS, "by_text", "text", "the wor")
    return T.search(_overlaid(spark, d)[2], plan, "doc_id", "n_chars", limit=20, digits=5).select("doc_id", F.col("_score").alias("score"))


@query(bm25_sql(["the"], "wor", table=_OVERLAID))
def search_index_delta(spark, d):
    """The same from an index of the first state, to which changed documents were added and from which others were removed."""
    docs, pending, now = _overlaid(spark, d)
    index = T.SearchIndex(spark, shared_folder(spark, "search-delta"), "text", "doc_id").add(docs)
    index.add(pending.where("NOT _deleted")).remove(pending.where("_deleted"))
    return _search(now, index, "the wor")


@query(f"SELECT doc_id, len({_TOKENS}) AS n, array_to_string({_TOKENS}[1:5], ' ') AS head FROM documents")
def tokens_of(spark, d):
    w = tokens(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(F.slice(w, 1, 5), " ").alias("head"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def doc_freq(spark, d):
    return T.document_frequencies(t(spark, d, "documents"), "text", "doc_id")


@query(f"SELECT item_id, term, count(*) AS tf, min(pos) AS first FROM (SELECT item_id, unnest({_TOKENS}) AS term, generate_subscripts({_TOKENS}, 1) - 1 AS pos FROM benchmark) GROUP BY item_id, term")
def postings(spark, d):
    return T.postings(t(spark, d, "benchmark"), "text", "item_id").select("item_id", "term", "tf", F.get("positions", F.lit(0)).cast("long").alias("first"))


@query(f"SELECT count(*) AS n_docs, round(avg(len({_TOKENS})), 6) AS mean_len FROM documents")
def corpus_stats(spark, d):
    return T.corpus_stats(t(spark, d, "documents"), "text").withColumn("mean_len", F.round("mean_len", 6))


@query(f"SELECT DISTINCT term FROM (SELECT unnest({_TOKENS}) AS term FROM documents) WHERE starts_with(term, 'wor')")
def prefix_terms(spark, d):
    return T.prefix_terms(t(spark, d, "documents"), "text", "wor")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) WHERE list_contains(w, 'under') AND list_contains(w, 'the') AND len([x FOR x IN w IF starts_with(x, 'lic')]) > 0")
def posting_intersection(spark, d):
    return T.combined(t(spark, d, "documents"), "text", "doc_id", ["under", "the"], "lic")


def _vector(spark, d) -> list[float]:
    return [((7 * i) % 13 - 6) / 10 for i in range(64)]


def cosine_sql(vector: list[float], where: str = "true", table: str = "embeddings", limit: int = 10) -> str:
    """Unit vectors rounded to 32 bits, products summed in 64 bits."""
    size = sum(x * x for x in _f32(vector)) ** 0.5
    q = ", ".join(repr(x) for x in (_f32([x / size for x in _f32(vector)]) if size else vector))
    norm = "sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding]))"
    return (
        f"WITH v AS (SELECT *, {norm} AS size FROM {table} WHERE {where}), u AS (SELECT vec_id, [CAST(CAST(CASE WHEN size = 0 THEN x ELSE CAST(x AS DOUBLE) / size END AS FLOAT) AS DOUBLE) FOR x IN embedding] AS e FROM v) "
        f"SELECT vec_id, round(list_sum([p[1] * p[2] FOR p IN list_zip(e, [{q}]::DOUBLE[])]), 5) AS score FROM u ORDER BY score DESC, vec_id LIMIT {limit}"
    )


def _f32(xs: list[float]) -> list[float]:
    import struct

    return [struct.unpack("f", struct.pack("f", x))[0] for x in xs]


_QUERY = _vector(None, "")


def _nearest(df, vector, limit=10, condition=None):
    plan = V.plan_vector(VECTORS, "by_embedding", vector, limit, condition)
    return V.vector_search(df, plan, "vec_id", digits=5).select("vec_id", F.col("_score").alias("score"))


@query(cosine_sql(_QUERY))
def vector_topk(spark, d):
    return _nearest(t(spark, d, "embeddings"), _QUERY)


@query(cosine_sql(_QUERY, "label = 3"))
def vector_filtered(spark, d):
    return _nearest(t(spark, d, "embeddings"), _QUERY, condition=V.eq(V.field("label"), 3))


@query(cosine_sql(_QUERY, "label IN (1, 4, 7)", limit=25))
def vector_or(spark, d):
    return _nearest(t(spark, d, "embeddings"), _QUERY, 25, V.any_of(V.eq(V.field("label"), 1), V.any_of(V.eq(V.field("label"), 4), V.eq(7, V.field("label")))))


@query("SELECT vec_id, 0.0::DOUBLE AS score FROM embeddings ORDER BY vec_id LIMIT 10")
def vector_zero(spark, d):
    return _nearest(t(spark, d, "embeddings"), [0.0] * 64)


_REPLACED = "(SELECT vec_id, CASE WHEN label = 2 THEN [CAST(-x AS FLOAT) FOR x IN embedding] ELSE embedding END AS embedding FROM embeddings WHERE label <> 5)"


@query(cosine_sql(_QUERY, table=_REPLACED))
def vector_index_delta(spark, d):
    """From an index of the first state, to which changed vectors were added and from which others were removed."""
    e = t(spark, d, "embeddings")
    index = V.VectorIndex(spark, shared_folder(spark, "vector-delta"), VECTORS, "by_embedding").add(e)
    index.add(e.where("label = 2").withColumn("embedding", F.transform("embedding", lambda x: -x))).remove(e.where("label = 5"))
    return index.search(_QUERY, digits=5).select("vec_id", F.col("_score").alias("score"))


@query(cosine_sql(_QUERY, table=_REPLACED))
def vector_overlay(spark, d):
    e = t(spark, d, "embeddings")
    pending = e.where("label IN (2, 5)").withColumn("_deleted", F.col("label") == 5).withColumn("embedding", F.transform("embedding", lambda x: -x))
    return _nearest(J.overlay(e, pending, "vec_id"), _QUERY)
