"""Full-text search: BM25 over words, a prefix for the last word, bonuses for exact words and nearness.

A query's words but the last must stand in a document; some word must begin with the
last. Each word, and the prefix with all words it covers, is a group. A document's
score sums each group's BM25, 0.1 for each occurrence of an exact group, and with two
groups or more 0.2 over the shortest span that holds them all. Results are ordered by
score, then newest, then id.

Statistics (number of documents, mean length, documents per group) cover the whole
table; filters and visibility apply to results. Texts are normalised (NFKC) and cut
into words once, when they go into an index: a folder of segments with a row for each
word's place in each document, sorted by word within each file. Texts are dealt to tasks
by their bytes first, however few files they come in, so no task grows with the table. A
query reads the words it asks for once, by filters that the Parquet reader gets, shuffles
those rows alone, and keeps what each document holds of them as a written table.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.scalars import nfkc, query_tokens, tokens
from lodestrata.sources.tables import Segments, shared_folder
from lodestrata.types import TableSpec

# Fixed values of the scoring rule.
K1, B = 1.2, 0.75
EXACT_BONUS, NEAR_BONUS = 0.1, 0.2
#: Bytes of text that a task cuts into words, and places of words that a task of a query may get.
TASK_BYTES, TASK_PLACES = 8 << 20, 4_000_000


@dataclass(frozen=True)
class SearchPlan:
    field: str
    exact: tuple[str, ...]
    prefix: str
    filters: tuple[tuple[str, object], ...] = ()

    @property
    def groups(self) -> int:
        return len(self.exact) + 1


def plan_search(spec: TableSpec, index: str, field: str, query: str, filters: dict[str, object] | None = None) -> SearchPlan | None:
    """None for a query without words, which matches nothing."""
    if index not in spec.search:
        raise ValueError(f"search index {spec.name}.{index} not found")
    declared, filter_fields = spec.search[index]
    if field != declared:
        raise ValueError(f"search index {index} searches {declared}, not {field}")
    for name in filters or {}:
        if name not in filter_fields:
            raise ValueError(f"{name} is not a filter field of {index}")
    words = query_tokens(query)
    if not words:
        return None
    return SearchPlan(field, tuple(dict.fromkeys(words[:-1])), words[-1], tuple((filters or {}).items()))


def min_span(places: Column, groups: int) -> Column:
    """The shortest stretch of positions with all groups, both ends included.

    places: (pos, g) sorted by position. For every place the latest position of each
    group so far is known; the stretch that ends there begins at the least of them.
    """
    start = F.struct(F.array_repeat(F.lit(-1), groups).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(a: Column, x: Column) -> Column:
        last = F.transform(a["last"], lambda p, k: F.when(k == x["g"], x["pos"]).otherwise(p))
        low = F.array_min(last)
        return F.struct(last.alias("last"), F.when(low >= 0, F.least(a["best"], x["pos"] - low + 1)).otherwise(a["best"]).alias("best"))

    return F.aggregate(places, start, step, lambda a: a["best"])


# Postings


def postings(df: DataFrame, field: str, id_column: str) -> DataFrame:
    """(term, id, tf, positions) for every word of every document. Words are grouped by word and document, so a common word is in no one task."""
    words = df.select(id_column, F.posexplode(tokens(F.col(field))).alias("pos", "term"))
    return words.groupBy("term", id_column).agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


class SearchIndex(Segments):
    """A stored index of one text column.

    ``add`` writes the words of new and changed documents, ``remove`` the ids of
    documents that go; a document counts as its newest segment has it. ``compact`` writes
    all live rows as one segment. The word "", which no text has, stands for a document's end: its
    place is the document's length, or -1 for a document that goes.
    """

    def __init__(self, spark: SparkSession, path: str, field: str, id_column: str):
        super().__init__(spark, path)
        self.field, self.id_column = field, id_column

    def _write(self, rows: DataFrame) -> SearchIndex:
        self.append(rows.select("term", self.id_column, "pos").sortWithinPartitions("term"))
        return self

    def add(self, df: DataFrame, normalised: bool = False) -> SearchIndex:
        """Documents to add, or to replace where their ids are there; null texts count as empty. normalised: the texts are in NFKC already."""
        text = F.col(self.field) if normalised else nfkc(F.col(self.field))
        size = df.agg(F.sum(F.octet_length(self.field))).first()[0] or 0
        dealt = df.select(self.id_column, self.field).repartition(max(self.spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES)), self.id_column)
        return self._write(dealt.select(self.id_column, F.posexplode(F.concat(tokens(text), F.array(F.lit("")))).alias("pos", "term")))

    def remove(self, ids: DataFrame) -> SearchIndex:
        return self._write(ids.select(self.id_column, F.lit(-1).alias("pos"), F.lit("").alias("term")))

    def docs(self) -> DataFrame:
        """id, len, segment of every live document."""
        rows = self.rows(F.col("term") == "")
        if len(self.segments()) > 1:
            rows = rows.groupBy(self.id_column).agg(F.max_by(F.struct("pos", "segment"), "segment").alias("d")).select(self.id_column, "d.*")
        return rows.where("pos >= 0").select(self.id_column, F.col("pos").cast("long").alias("len"), "segment")

    def postings(self, condition: Column | None = None) -> DataFrame:
        """term, id, pos of live documents' words."""
        rows = self.rows((F.col("term") != "") if condition is None else (F.col("term") != "") & condition)
        return rows.drop("segment") if len(self.segments()) == 1 else rows.join(self.docs().select(self.id_column, "segment"), [self.id_column, "segment"]).drop("segment")

    def compact(self) -> SearchIndex:
        """All live rows as a new folder's only segment."""
        out = SearchIndex(self.spark, f"{self.path}-{uuid.uuid4().hex}", self.field, self.id_column)
        return out._write(self.postings().unionByName(self.docs().select(self.id_column, F.col("len").cast("int").alias("pos"), F.lit("").alias("term"))))


def search_index(df: DataFrame, index: SearchIndex, plan: SearchPlan | None, creation: str, visible: Column | None = None, limit: int | None = 1024, digits: int | None = None) -> DataFrame:
    """The rows of df that the plan finds in the index, with ``_score``, best first. digits rounds scores before ranking, for comparison with other engines."""
    if plan is None:
        return df.withColumn("_score", F.lit(0.0)).where("false")
    n_groups, key = plan.groups, index.id_column
    term = F.col("term")
    wanted = reduce(lambda a, b: a | b, [term.startswith(plan.prefix), *([term.isin(*plan.exact)] if plan.exact else [])])
    # A word may be in an exact group and in the prefix group.
    groups = F.array_compact(F.array(*[F.when(term == w, F.lit(k)) for k, w in enumerate(plan.exact)], F.when(term.startswith(plan.prefix), F.lit(n_groups - 1))))
    rows = index.postings(wanted).select(key, "pos", F.explode(groups).alias("g"))
    size = index.docs().agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()  # two numbers, over the whole table
    n, mean = size["n"], size["mean"] or 0.0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * mean / TASK_PLACES))
    whole = " AND ".join(f"_tf{k} > 0" for k in range(n_groups))
    places = [F.array_sort(F.collect_list(F.struct("pos", "g"))).alias("_places")] if n_groups > 1 else []
    held = rows.repartition(parts, key).groupBy(key).agg(*[F.count_if(F.col("g") == k).alias(f"_tf{k}") for k in range(n_groups)], *places)
    if places:
        held = held.withColumn("_places", F.when(F.expr(whole), F.col("_places")))
    path = shared_folder(df.sparkSession, "hits")
    held.write.parquet(path)
    hits = df.sparkSession.read.schema(held.schema).parquet(path)
    df_of = hits.agg(*[F.count_if(F.col(f"_tf{k}") > 0) for k in range(n_groups)]).first()  # one number for each group
    found = hits.where(whole).join(index.docs().select(key, F.col("len").alias("_len")), key)
    norm = F.when(F.col("_len") == 0, 1.0).otherwise(1 - B + B * F.col("_len") / F.lit(mean)) if mean else F.lit(1.0)
    score = F.lit(0.0)
    for k in range(n_groups):
        df_k = df_of[k]
        idf = F.lit(math.log(1 + (n - df_k + 0.5) / (df_k + 0.5)))
        score = score + idf * (F.col(f"_tf{k}") * (K1 + 1)) / (F.col(f"_tf{k}") + K1 * norm)
        if k < n_groups - 1:
            score = score + EXACT_BONUS * F.col(f"_tf{k}")
    if n_groups > 1:
        score = score + NEAR_BONUS / min_span(F.col("_places"), n_groups)
    scored = found.select(key, (score if digits is None else F.round(score, digits)).alias("_score"))
    asked = df
    for name, value in plan.filters:
        asked = asked.where(F.col(name).eqNullSafe(F.lit(value)))
    if visible is not None:
        asked = asked.where(visible)
    ranked = asked.join(scored, key).select(*df.columns, "_score").orderBy(F.col("_score").desc(), F.col(creation).desc_nulls_last(), F.col(key).asc())
    return ranked if limit is None else ranked.limit(limit)


def search(df: DataFrame, plan: SearchPlan | None, id_column: str, creation: str, visible: Column | None = None, limit: int | None = 1024, digits: int | None = None) -> DataFrame:
    """A search over rows without an index, through one made for it."""
    if plan is None:
        return df.withColumn("_score", F.lit(0.0)).where("false")
    index = SearchIndex(df.sparkSession, shared_folder(df.sparkSession, "search"), plan.field, id_column).add(df)
    return search_index(df, index, plan, creation, visible, limit, digits)


# Other readings of a text column


def corpus_stats(df: DataFrame, field: str) -> DataFrame:
    """Number of documents and mean number of words; texts that are null count as empty."""
    return df.select(F.size(tokens(F.col(field))).alias("len")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("mean_len"))


def document_frequencies(df: DataFrame, field: str, id_column: str) -> DataFrame:
    """Documents per word; words are made distinct within each document first, so no id is shuffled."""
    return df.select(F.explode(F.array_distinct(tokens(F.col(field)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def prefix_terms(df: DataFrame, field: str, prefix: str) -> DataFrame:
    """The distinct words that begin with prefix."""
    listed = F.filter(F.array_distinct(tokens(F.col(field))), lambda t: t.startswith(prefix))
    return df.select(F.explode(listed).alias("term")).distinct()


def combined(df: DataFrame, field: str, id_column: str, words: list[str], prefix: str) -> DataFrame:
    """Ids of documents that hold all words and one that begins with prefix: the intersection of posting sets."""
    t = tokens(F.col(field))
    every = F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(t, w)) if words else F.lit(True)
    return df.where(every & F.exists(t, lambda x: x.startswith(prefix))).select(id_column)
