"""Keyword, vector and hybrid search over transcripts and documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from havenlens.functions.numeric import fixed

K1, B = 1.2, 0.75
FUSION = 60
#: Candidates of one query are ranked in this many parts first, so that no task gets all of them whatever k is.
PARTS = 64
#: Vectors and query vectors that one task multiplies at a time.
VECTOR_ROWS, QUERY_ROWS = 16_384, 2_048
#: What is shown of a customer of a cohort, besides the calls cited.
COHORT = ("customer_id", "full_name", "risk_band", "risk_score", "action", "channel")


@dataclass(frozen=True)
class SearchQuery:
    """A text and the equality filters that a result must meet."""

    query_id: str
    text: str
    filters: Mapping[str, str] = field(default_factory=dict)

    @property
    def terms(self) -> Counter:
        return Counter(t for t in re.split(r"[\W_]+", self.text.lower()) if t)


def search_corpus(insights: DataFrame) -> DataFrame:
    """One searchable text per call: its summary, then the dialogue."""
    return insights.select(
        "transcript_id", "customer_id", F.coalesce("policy_id", F.lit("")).alias("policy_id"),
        F.date_format("call_ts", "yyyy-MM-dd").alias("call_date"), "primary_intent", "sentiment_label",
        fixed(F.col("sentiment_score"), 2).alias("sentiment_score"), "summary", "transcript_text",
        F.concat(F.coalesce("summary", F.lit("")), F.lit("\n"), F.coalesce("transcript_text", F.lit("")))
        .alias("search_text"))


def spaced_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, each with a space of its own on either side."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))


def occurrences(spaced: Column, term: str) -> Column:
    """How often a token occurs in a spaced text."""
    token = F.lit(f" {term} ")
    return F.when(F.contains(spaced, token), (
        F.length(spaced) - F.length(F.replace(spaced, token, F.lit("")))) / F.lit(len(term) + 2)).otherwise(F.lit(0.0))


def refresh_corpus(insights: DataFrame, stored: DataFrame) -> DataFrame:
    """Corpus rows for calls not indexed yet, to be appended."""
    new = insights.join(stored.select("transcript_id"), "transcript_id", "left_anti")
    return search_corpus(new)


def _meets(filters: Mapping[str, str]) -> Column:
    return reduce(and_, [F.col(name) == value for name, value in filters.items()], F.lit(True))


def keyword_search(corpus: DataFrame, queries: Sequence[SearchQuery], k: int = 5, id_column: str = "transcript_id",
                   text_column: str = "search_text", per: str | None = None,
                   members: DataFrame | None = None) -> DataFrame:
    """BM25 top k per query (and per value of `per`, if given).

    Term counts and scores are worked out inside each document's own row, so documents are never exploded or shuffled:
    one pass gathers document frequencies for the query terms, a second scores, and only ranked candidates move.
    Statistics cover the whole corpus; filters limit the candidates and reach the scan, and `members` limits them to
    the `per` values it lists.
    """
    vocabulary = sorted({term for query in queries for term in query.terms})

    def counted(docs: DataFrame) -> DataFrame:
        spaced = F.col("spaced")
        blanks = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
        empty_ends = (F.startswith(spaced, F.lit("   ")).cast("int") + F.endswith(spaced, F.lit("   ")).cast("int"))
        return docs.withColumn("spaced", spaced_tokens(F.col(text_column))).withColumns({
            "doc_len": F.when(F.trim(spaced) == "", 0).otherwise(blanks / 2 - empty_ends).cast("long"),
            "tf": F.array(*[occurrences(spaced, term) for term in vocabulary])}).drop("spaced")

    n_docs, total_len = F.count("*").alias("n_docs"), F.sum("doc_len").alias("total_len")
    freq = F.array(*[F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(vocabulary))]).alias("freq")
    stats = counted(corpus.select(text_column)).agg(F.struct(n_docs, total_len, freq)).scalar()

    wanted = reduce(or_, [_meets(query.filters) for query in queries])
    carried = [id_column, *[c for c in ([per] if per else []) if c != id_column]]
    needed = list(dict.fromkeys([*carried, text_column, *[c for q in queries for c in q.filters]]))
    candidates = corpus.select(*needed).where(wanted)
    if members is not None:
        candidates = candidates.join(members.select(per), per, "left_semi")
    docs = counted(candidates).withColumn("stats", stats)
    average = F.col("stats.total_len") / F.col("stats.n_docs")
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("doc_len") / average)

    def term_score(i: int, weight: int) -> Column:
        tf, df = F.get("tf", F.lit(i)), F.get("stats.freq", F.lit(i))
        idf = F.log(F.lit(1.0) + (F.col("stats.n_docs") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + norm) * weight).otherwise(F.lit(0.0))

    scores = F.array(*[
        F.struct(F.lit(query.query_id).alias("query_id"), F.when(_meets(query.filters), reduce(
            lambda a, b: a + b, [term_score(vocabulary.index(t), n) for t, n in sorted(query.terms.items())],
            F.lit(0.0))).alias("score"))
        for query in queries])
    hits = docs.select(*carried, F.inline(F.filter(scores, lambda s: s.getField("score") > 0)))
    keys = ["query_id", *([per] if per else [])]
    return _ranked(hits, keys, id_column, k)


def _ranked(hits: DataFrame, keys: Sequence[str], id_column: str, k: int) -> DataFrame:
    """Top k by score: first what each map task has best, in some parts of tasks, then of what these leave.

    A part is told by the task, so Spark keeps k rows of a query in each task before the exchange, and no task gets what all
    tasks have left of a query.
    """
    def best(*by) -> Column:
        return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), id_column))

    part = F.pmod(F.spark_partition_id(), F.lit(PARTS))
    some = hits.withColumn("part", part).withColumn("rank", best(*keys, "part")).where(F.col("rank") <= k).drop("part", "rank")
    return some.withColumn("rank", best(*keys)).where(F.col("rank") <= k)


def customer_evidence_search(corpus: DataFrame, query: SearchQuery, k: int = 3) -> DataFrame:
    """Best k calls of every customer for one text."""
    return keyword_search(corpus, [query], k, per="customer_id")


def cohort_with_evidence(cohort: DataFrame, corpus: DataFrame, query: SearchQuery, k: int = 5) -> DataFrame:
    """Cohort rows with up to k supporting calls each and the recommended action; cites only calls found."""
    return with_citations(cohort, keyword_search(corpus, [query], k, per="customer_id", members=cohort))


def with_citations(cohort: DataFrame, found: DataFrame) -> DataFrame:
    """Cohort rows with the calls found for each customer, best first."""
    cited = found.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct("rank", "transcript_id")))
                                             .alias("found"))
    ids = F.transform("found", lambda c: F.concat(F.lit("["), c.getField("transcript_id"), F.lit("]")))
    return cohort.join(cited, "customer_id", "left").select(
        *COHORT, F.coalesce(F.array_join(ids, " "), F.lit("")).alias("citations"))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 5, on: Sequence[str] = (),
                  id_column: str = "vec_id", vector_column: str = "embedding", vector_rows: int = VECTOR_ROWS,
                  query_rows: int = QUERY_ROWS) -> DataFrame:
    """Exact cosine top k per query. `queries` holds (query_id, query_vector) and the filter columns in `on`.

    Both sides stay tables, dealt by a hash of the id into blocks of about `vector_rows` and `query_rows`. Every block of
    vectors meets every block of queries, with equal filter columns, in a task of its own, which multiplies them and
    keeps the k best of each query; so memory is set by the blocks, pairs are never written out and nothing is collected.
    Null and zero vectors match nothing.
    """
    used = vectors.select(id_column, vector_column, *on).where(F.col(vector_column).isNotNull())
    asked = queries.select("query_id", "query_vector", *on).where(F.col("query_vector").isNotNull())

    def blocks(rows: DataFrame, size: int) -> Column:
        return F.ceil(F.greatest(rows.select(F.count("*")).scalar(), F.lit(1)) / size).cast("int")

    def own(column: str, name: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(name)).cast("int")

    v, q = blocks(used, vector_rows), blocks(asked, query_rows)
    left = used.withColumns({"v_blocks": v, "q_blocks": q}).withColumn("v", own(id_column, "v_blocks")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))).drop("v_blocks", "q_blocks")
    right = asked.withColumns({"v_blocks": v, "q_blocks": q}).withColumn("q", own("query_id", "q_blocks")).withColumn(
        "v", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1))).drop("v_blocks", "q_blocks")
    types = {f.name: f.dataType.simpleString() for f in (*used.schema.fields, *asked.schema.fields)}
    keys = [*on, "v", "q"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _best_of_block(k, id_column, vector_column),
        f"query_id {types['query_id']}, {id_column} {types[id_column]}, score double")
    return _ranked(scored, ["query_id"], id_column, k)


def _best_of_block(k: int, id_column: str, vector_column: str):
    def unit(column: pa.ChunkedArray) -> np.ndarray:
        data = np.array(column.to_pylist(), dtype="float64")
        with np.errstate(invalid="ignore", divide="ignore"):
            return data / np.linalg.norm(data, axis=1, keepdims=True)

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if vectors.num_rows and queries.num_rows:
            data, asked = unit(vectors[vector_column]), unit(queries["query_vector"])
            known = ~np.isnan(data).any(axis=1)
            data, ids = data[known], np.array(vectors[id_column].to_pylist())[known]
            for start in range(0, len(asked), 256):
                scores = asked[start:start + 256] @ data.T
                for row, query_id in zip(scores, queries["query_id"][start:start + 256].to_pylist()):
                    if np.isnan(row).any() or not len(row):
                        continue
                    if len(row) > k:  # all that tie with the k-th after rounding, then in order of score and id
                        places = np.flatnonzero(np.round(row, 9) >= np.round(np.partition(row, -k)[-k], 9))
                    else:
                        places = np.arange(len(row))
                    places = places[np.lexsort((ids[places], -np.round(row[places], 9)))[:k]]
                    for kept, values in zip(found, ([query_id] * len(places), ids[places].tolist(), row[places].tolist())):
                        kept += values
        kinds = (queries.schema.field("query_id").type, vectors.schema.field(id_column).type, pa.float64())
        return pa.table([pa.array(v, kind) for v, kind in zip(found, kinds)], ["query_id", id_column, "score"])

    return best


def hybrid_search(keyword: DataFrame, vector: DataFrame, k: int = 5, id_column: str = "doc_id") -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: one grouping over a few rows per query."""
    lists = keyword.select("query_id", id_column, "rank").unionByName(vector.select("query_id", id_column, "rank"))
    fused = lists.groupBy("query_id", id_column).agg(F.sum(F.lit(1.0) / (F.lit(FUSION) + F.col("rank"))).alias("score"))
    return _ranked(fused, ["query_id"], id_column, k)
