"""A stored keyword index: built once, kept up with new, changed and deleted calls, searched without reading any text."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from havenlens.operators.search import B, K1, _ranked
from havenlens.session import scratch_path, shuffles_dropped
from havenlens.sources.versions import drop, size_of, whole_versions

#: What is kept of a call, by which of these a query may filter, and what a result shows besides the summary.
CARRIED = ("customer_id", "policy_id", "call_date", "primary_intent", "sentiment_label")
FILTERS = ("customer_id", "policy_id", "primary_intent", "sentiment_label")
SHOWN = ("customer_id", "call_date", "primary_intent", "sentiment_label")
#: A term lies in one of TERM_PARTS folders; within a join its documents are dealt into DOC_PARTS, so a stop word splits.
TERM_PARTS, DOC_PARTS = 64, 16
#: Up to so many terms reach the scan as literals; more are only joined.
PUSHED_TERMS = 1000
#: A term's postings lie in blocks by how much one can score, told by its count and length at a usual length in words. What
#: a block may score holds at any average length; it is tightest if that is near the usual one.
BLOCKS, USUAL_WORDS = 32, 100
#: Up to so many terms reach the scan with the least block that each needs; more with the least of all.
PUSHED_BLOCKS = 100
#: What rounding may add to a sum of scores.
SLACK = 1e-6
#: Loads after which an index is rewritten as one, so that neither files nor superseded rows pile up.
MOST_LOADS = 32
#: Bytes of a row group of what a load works out of its documents.
GROUP_BYTES = 8 << 20
#: Postings are exchanged and written in this many slices of their folders at most, one for so many bytes of what they come
#: from; what a slice has exchanged is dropped before the next one begins.
SLICES, SLICE_BYTES = 4, 16 << 20


def _packed(*distinct: str) -> dict[str, str]:
    """Options of a writer: small pages, and differences instead of a dictionary for columns with a value of its own in most rows."""
    return {"compression": "zstd", "parquet.writer.version": "v2", **{f"parquet.enable.dictionary#{c}": "false" for c in distinct}}


ENTRIES, DOCS = _packed("doc"), _packed("doc", "id", "policy_id", "print")


@dataclass(frozen=True)
class Index:
    """The rows of the newest generation that count: of loads that ended, and of documents the versions that are not gone."""

    folder: str
    loads: DataFrame
    entries: DataFrame
    terms: DataFrame
    blocks: DataFrame
    docs: DataFrame
    gone: DataFrame

    @property
    def live_docs(self) -> DataFrame:
        return self.docs.join(self.gone, ["id", "load"], "left_anti")

    @property
    def postings(self) -> DataFrame:
        """The entries with the documents that their numbers stand for."""
        return self.entries.drop("doc_len", "load").join(self.docs.select("run", "doc", "id", *CARRIED, "doc_len", "load"), ["run", "doc"])


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def folder_of(spark: SparkSession, path: str) -> str:
    """The folder of the newest whole generation of the index at `path`."""
    return f"{path}/data-{max(whole_versions(spark, f'{path}/generations'))}"


def _columns(ids: str) -> dict[str, str]:
    """The columns of each table of a generation, for ids of a type."""
    carried = ", ".join(f"{c} string" for c in CARRIED)
    return {"docs": f"id {ids}, {carried}, summary string, doc_len bigint, print bigint, load string, run bigint, doc bigint",
            "postings": "run bigint, doc bigint, doc_len bigint, load string, term string, tf bigint, block int, term_part int",
            "blocks": "term string, block int, n bigint, most_tf bigint, least_spread double, least_cost double, load string, term_part int",
            "terms": "term string, n_docs bigint, load string, term_part int",
            "gone": f"id {ids}, doc_len bigint, load string, by string",
            "loads": "load string, n_docs bigint, total_len bigint"}


def _begin(spark: SparkSession, path: str, generation: int, ids: T.DataType) -> str:
    """An empty generation; it is not read before _publish."""
    folder = f"{path}/data-{generation}"
    for name, columns in _columns(ids.simpleString()).items():
        writer = spark.createDataFrame([], columns).write.mode("overwrite")
        (writer.partitionBy("term_part") if "term_part" in columns else writer).parquet(f"{folder}/{name}")
    return folder


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a generation, whole; one in folders by term has no file while it is empty."""
    held = spark.read.parquet(f"{folder}/docs").schema
    if "doc" not in held.names:
        raise ValueError(f"{folder} is of an earlier form, without numbers of documents: build the index anew")
    return spark.read.schema(_columns(held["id"].dataType.simpleString())[name]).parquet(f"{folder}/{name}")


def _publish(spark: SparkSession, path: str, generation: int) -> None:
    spark.range(1).write.mode("overwrite").parquet(f"{path}/generations/version={generation}")


def open_index(spark: SparkSession, path: str) -> Index:
    """The index as it is now. Loads are MOST_LOADS at most, so that they are broadcast; what a broken load left is not read."""
    folder = folder_of(spark, path)
    loads = _read(spark, folder, "loads")
    ended = F.broadcast(loads.select("load"))

    def table(name: str) -> DataFrame:
        return _read(spark, folder, name).join(ended, "load", "left_semi")

    gone = _read(spark, folder, "gone").join(ended.withColumnRenamed("load", "by"), "by", "left_semi").select("id", "load")
    return Index(folder, loads, table("postings"), table("terms"), table("blocks"), table("docs"), gone)


def append_index(corpus: DataFrame, path: str, id_column: str = "transcript_id", text_column: str = "search_text") -> None:
    """Index the rows of a search corpus whose ids the index at `path` does not hold; the first call builds it."""
    _load(corpus, path, id_column, text_column, False, None)


def refresh_index(corpus: DataFrame, path: str, deleted: DataFrame | None = None, id_column: str = "transcript_id",
                  text_column: str = "search_text") -> None:
    """Index new rows of a corpus, put rows that have changed in the place of those with their id, and drop `deleted` ids.

    `corpus` may hold everything or only what has arrived. A row has changed if its text, summary or any carried column has;
    of the others nothing is written. Ids of `deleted` that the corpus holds stay.
    """
    _load(corpus, path, id_column, text_column, True, deleted)


def _load(corpus: DataFrame, path: str, id_column: str, text_column: str, replace: bool, deleted: DataFrame | None) -> None:
    """One load: postings has a row per term of a document, in folders by term, sorted by term and block; blocks says what
    each block of a term holds at most; terms counts documents per term; docs has a row per version of a document; gone names
    versions that count no more, for which terms and the load's totals count backwards. Postings know a document by its number
    in the run, the load that counted it, and docs says whose it is. The load's own row is written last: until then nothing of
    it is read. What a step has exchanged is dropped once the step is written."""
    with shuffles_dropped(corpus.sparkSession):
        _load_steps(corpus, path, id_column, text_column, replace, deleted)


def _load_steps(corpus: DataFrame, path: str, id_column: str, text_column: str, replace: bool, deleted: DataFrame | None) -> None:
    spark = corpus.sparkSession
    if not whole_versions(spark, f"{path}/generations"):
        _begin(spark, path, 1, corpus.schema[id_column].dataType)
        _publish(spark, path, 1)
    index, load, run = open_index(spark, path), uuid.uuid4().hex, uuid.uuid4().int >> 65
    old = index.live_docs.select("id", F.col("load").alias("old_load"), F.col("doc_len").alias("old_len"), F.col("print").alias("old_print"))
    if not replace:
        corpus = corpus.join(old.select(F.col("id").alias(id_column)), id_column, "left_anti")
    rows = corpus.select(F.col(id_column).alias("id"), *CARRIED, "summary", F.sort_array(_tokens(F.col(text_column))).alias("tokens"),
                         F.xxhash64(*CARRIED, "summary", text_column).alias("print"))
    fresh = rows
    if replace:
        fresh = rows.join(old, "id", "left").where(F.col("old_load").isNull() | (F.col("print") != F.col("old_print")))
    kept = scratch_path(spark, "fresh")
    _write_counted(fresh, f"{kept}/docs")
    fresh = spark.read.parquet(f"{kept}/docs")
    if replace:
        superseded = fresh.where("old_load IS NOT NULL").select("id", "old_load", "old_len")
        if deleted is not None:
            dropped = deleted.select(F.col(deleted.columns[0]).alias("id")).distinct().join(
                corpus.select(F.col(id_column).alias("id")), "id", "left_anti")
            superseded = superseded.unionByName(old.join(dropped, "id").select("id", "old_load", "old_len"))
        superseded.select("id", F.col("old_len").alias("doc_len"), F.col("old_load").alias("load"), F.lit(load).alias("by")).write.mode(
            "append").parquet(f"{index.folder}/gone")
    gone = _read(spark, index.folder, "gone").where(F.col("by") == load)
    _write_postings(fresh.withColumn("run", F.lit(run)), index.folder, load, kept)
    _write_blocks(spark, index.folder, load)
    counts = _read(spark, index.folder, "blocks").where(F.col("load") == load).select("term_part", "term", "n")
    if replace:
        lost = index.entries.join(index.docs.join(gone.select("id", "load"), ["id", "load"], "left_semi").select("run", "doc"), ["run", "doc"], "left_semi")
        counts = counts.unionByName(lost.select("term_part", "term", F.lit(-1).alias("n")))
    _write_terms(counts.groupBy("term_part", "term").agg(F.sum("n").alias("n_docs")).withColumn("load", F.lit(load)), index.folder)
    fresh.select("id", *CARRIED, "summary", "doc_len", "print", F.lit(load).alias("load"), F.lit(run).alias("run"), "doc").write.mode(
        "append").options(**DOCS).parquet(f"{index.folder}/docs")
    added = _read(spark, index.folder, "docs").where(F.col("load") == load)
    _write_load(added.select("doc_len", F.lit(1).alias("n")).unionByName(
        gone.select((-F.col("doc_len")).alias("doc_len"), F.lit(-1).alias("n"))), load, index.folder)
    drop(spark, kept)
    if _read(spark, index.folder, "loads").count() >= MOST_LOADS:
        compact_index(spark, path)


def _write_counted(docs: DataFrame, path: str) -> None:
    """Each document of a load with a number, its length and the counts of its different terms, worked out once and in its own row.

    `tokens` are sorted, so a term is a run of them: no token becomes a row, and postings are as many rows as they hold.
    """
    tokens = F.col("tokens")
    starts = F.filter(F.transform(tokens, lambda t, i: F.when((i == 0) | (t != F.get(tokens, i - 1)), i)), lambda i: i.isNotNull())
    counts = F.transform("starts", lambda at, i: F.struct(
        F.get(tokens, at).alias("term"), (F.coalesce(F.get("starts", i + 1), F.size(tokens)) - at).cast("long").alias("tf")))
    counted = docs.withColumns({"doc_len": F.size(tokens).cast("long"), "starts": starts}).withColumn("counts", counts)
    own = F.xxhash64("id", *CARRIED, "doc_len").alias("own")
    # small row groups, so that what follows is as many tasks however few files the corpus came from
    counted.drop("tokens", "starts").select("*", own, F.monotonically_increasing_id().alias("doc")).write.options(
        **DOCS, **{"parquet.block.size": GROUP_BYTES}).parquet(path)


def _write_postings(docs: DataFrame, folder: str, load: str, scratch: str) -> None:
    """Rows that agree in id and all that is kept of a call count as one document, under one of their numbers; no others need
    to meet to be counted."""
    spark, own = docs.sparkSession, ["id", *CARRIED, "doc_len"]
    docs.groupBy("own").agg(F.count("*").alias("n")).where("n > 1").select("own").write.parquet(f"{scratch}/repeated")
    repeated = spark.read.parquet(f"{scratch}/repeated")
    entry = ["run", "doc", "doc_len"]
    entries = docs.select(*entry, F.inline("counts"))
    if not repeated.isEmpty():
        of_one = docs.join(repeated, "own", "left_anti").select(*entry, F.inline("counts"))
        of_more = docs.join(repeated, "own", "left_semi").select(*own, "run", "doc", F.inline("counts")).groupBy(*own, "run", "term").agg(
            F.min("doc").alias("doc"), F.sum("tf").alias("tf")).select(*entry, "term", "tf")
        entries = of_one.unionByName(of_more)
    entries = entries.withColumn("term_part", _part("term", TERM_PARTS))
    block = F.floor(BLOCKS * _worth(F.col("tf"), F.col("doc_len"), F.lit(USUAL_WORDS))).cast("int")
    _write_entries(entries, block, folder, load, size_of(spark, f"{scratch}/docs"))


def _write_entries(entries: DataFrame, block: Column, folder: str, load: str, size: int) -> None:
    """Postings into their folders, slice by slice: a slice is some of the folders, and the rows come from `size` bytes."""
    slices = min(SLICES, TERM_PARTS, 1 + size // SLICE_BYTES)
    for n in range(slices):
        rows = entries.where(F.pmod("term_part", F.lit(slices)) == n) if slices > 1 else entries
        _by_term(rows.withColumn("block", block), "block", "run", "doc").withColumn("load", F.lit(load)).write.mode("append").options(
            **ENTRIES).partitionBy("term_part").parquet(f"{folder}/postings")


def _worth(tf: Column, doc_len: Column, average: Column) -> Column:
    """The part of a term's weight that a document gets: more with its count, less with the document's length."""
    return tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * doc_len / average))


def _cost(tf: Column, spread: Column, average: Column) -> Column:
    """What _worth, as 1 / (1 + cost), loses for a count and a number of words per occurrence."""
    return F.lit(K1 * (1 - B)) / tf + F.lit(K1 * B) * spread / average


def _write_blocks(spark: SparkSession, folder: str, load: str) -> None:
    """What the load's postings, already written, hold by term and block."""
    spread = F.col("doc_len") / F.col("tf")
    found = _read(spark, folder, "postings").where(F.col("load") == load).groupBy("term_part", "term", "block").agg(
        F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min(spread).alias("least_spread"),
        F.min(_cost(F.col("tf"), spread, F.lit(USUAL_WORDS))).alias("least_cost")).withColumn("load", F.lit(load))
    _by_term(found).write.mode("append").partitionBy("term_part").parquet(f"{folder}/blocks")


def _by_term(rows: DataFrame, *then: str) -> DataFrame:
    return rows.hint("rebalance", F.col("term_part")).sortWithinPartitions("term_part", "term", *then)


def _write_terms(counts: DataFrame, folder: str) -> None:
    _by_term(counts.where("n_docs <> 0")).write.mode("append").partitionBy("term_part").parquet(f"{folder}/terms")


def _write_load(lengths: DataFrame, load: str, folder: str) -> None:
    lengths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len")).select(
        F.lit(load).alias("load"), "n_docs", "total_len").coalesce(1).write.mode("append").parquet(f"{folder}/loads")


def compact_index(spark: SparkSession, path: str) -> None:
    """Write what counts as a new generation of one load. Searches read the old one until it is whole, then it is the
    newest; the generation before the old one is dropped. No text is read and no term is counted anew."""
    with shuffles_dropped(spark):
        _compact_steps(spark, path)


def _compact_steps(spark: SparkSession, path: str) -> None:
    index, load = open_index(spark, path), uuid.uuid4().hex
    before = max(whole_versions(spark, f"{path}/generations"))
    folder = _begin(spark, path, before + 1, index.docs.schema["id"].dataType)
    own = F.lit(load).alias("load")
    dead = index.docs.join(index.gone, ["id", "load"], "left_semi").select("run", "doc")
    live = index.entries.join(dead, ["run", "doc"], "left_anti").drop("load")
    _write_entries(live, F.col("block"), folder, load, size_of(spark, f"{index.folder}/postings"))
    _write_blocks(spark, folder, load)
    _write_terms(index.terms.groupBy("term_part", "term").agg(F.sum("n_docs").alias("n_docs")).withColumn("load", own), folder)
    index.live_docs.withColumn("load", own).select("id", *CARRIED, "summary", "doc_len", "print", "load", "run", "doc").write.mode(
        "append").options(**DOCS).parquet(f"{folder}/docs")
    _write_load(_read(spark, folder, "docs").select("doc_len", F.lit(1).alias("n")), load, folder)
    _publish(spark, path, before + 1)
    for version in whole_versions(spark, f"{path}/generations"):
        if version < before:
            drop(spark, f"{path}/generations/version={version}")
            drop(spark, f"{path}/data-{version}")


def search_index(queries: DataFrame, path: str, k: int = 5, per: str | None = None, members: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rank, score, customer_id, call_date, primary_intent, sentiment_label, summary): BM25 top k per query.

    `queries` holds (query_id, text) and any of the FILTERS; a null filter lets all documents pass, any other column is
    refused. Statistics cover the whole index and come from the rows of its loads. Only the folders of the queries' terms are
    read, and in their sorted files the row groups that hold the terms; a term's documents are dealt over DOC_PARTS. What a
    document scores is summed under its number before it meets its row, which says whose it is. With `per` the top k are per
    query and value of that column, limited to those that `members` lists, if given; without it only the blocks of a term are
    read that can still change a query's top k.
    """
    unknown = set(queries.columns) - {"query_id", "text", *FILTERS}
    if unknown:
        raise ValueError(f"no filters of this index: {', '.join(sorted(unknown))}")
    spark = queries.sparkSession
    index = open_index(spark, path)
    asked = [c for c in FILTERS if c in queries.columns]
    wanted = (queries.select("query_id", *[F.col(c).alias(f"only_{c}") for c in asked], F.explode(_tokens(F.col("text"))).alias("term"))
              .groupBy("query_id", *[f"only_{c}" for c in asked], "term").agg(F.count("*").alias("n"))
              .withColumn("term_part", _part("term", TERM_PARTS)))
    few = wanted.select("term_part", "term").distinct().limit(PUSHED_TERMS + 1).collect()
    if len(few) <= PUSHED_TERMS:
        named = F.col("term_part").isin(sorted({r.term_part for r in few})) & F.col("term").isin(sorted({r.term for r in few}))
    else:
        named = F.col("term_part").isin([r.term_part for r in wanted.select("term_part").distinct().collect()])
    entries, counts = index.entries.where(named), index.terms.where(named)
    frequency = counts.join(wanted.select("term_part", "term").distinct(), ["term_part", "term"], "left_semi").groupBy(
        "term_part", "term").agg(F.sum("n_docs").alias("df")).where("df > 0")
    size = index.loads.agg(F.struct(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))).scalar()
    weighed = (wanted.join(frequency, ["term_part", "term"]).withColumn("size", size)
               .withColumn("idf", F.log(F.lit(1.0) + (F.col("size.n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
               .withColumn("average", F.col("size.total_len") / F.col("size.n_docs")).drop("size", "df"))

    whose = index.live_docs.select("run", "doc", "id", "load", *dict.fromkeys([*asked, *([per] if per else [])]))
    if members is not None:
        whose = whose.join(members.select(per).distinct(), per, "left_semi")
    keys = ["query_id", *([per] if per else [])]

    def scored(entries: DataFrame, weighed: DataFrame, on: list[str]) -> DataFrame:
        dealt = weighed.withColumn("doc_part", F.explode(F.sequence(F.lit(0), F.lit(DOC_PARTS - 1))))
        matched = entries.withColumn("doc_part", _part("doc", DOC_PARTS)).join(dealt, [*on, "doc_part"])
        score = F.col("n") * F.col("idf") * (K1 + 1) * _worth(F.col("tf"), F.col("doc_len"), F.col("average"))
        only = [f"only_{c}" for c in asked]
        sums = matched.select("query_id", *only, "run", "doc", score.alias("score")).repartition("run", "doc").groupBy(
            "query_id", *only, "run", "doc").agg(F.sum("score").alias("score"))
        passes = reduce(and_, [F.col(f"only_{c}").isNull() | (F.col(f"only_{c}") == F.col(c)) for c in asked], F.lit(True))
        return sums.join(whose, ["run", "doc"]).where(passes).groupBy(*keys, "id", "load").agg(F.sum("score").alias("score"))

    on = ["term_part", "term"]
    if per is None and members is None:
        on = [*on, "block"]
        weighed = _needed_blocks(weighed, index, named, k, scored)
        entries = entries.where(_least_blocks(weighed))
    hits = scored(entries, weighed, on).where(F.col("score") > 0)
    best = _ranked(hits, keys, "id", k).select("query_id", "id", "load", "rank", "score")
    return best.join(index.docs.select("id", "load", *SHOWN, "summary"), ["id", "load"]).select(
        "query_id", "id", "rank", "score", *SHOWN, "summary")


def _needed_blocks(weighed: DataFrame, index: Index, named: Column, k: int, scored) -> DataFrame:
    """The rows of `weighed` with every block of the term that may hold one of the query's top k, written once.

    First the best blocks of each term are scored, as many as hold k postings. The k-th sum found for a query is a floor: what
    is counted of a document can only grow. A document of some block scores at most what the block may and what the best
    blocks of the query's other terms may; blocks that stay below the floor are left out, whole, so every document that
    reaches it is scored in full. Queries that find fewer than k have no floor.
    """
    spark = weighed.sparkSession
    held = index.blocks.where(named).groupBy("term_part", "term", "block").agg(
        F.sum("n").alias("held"), F.max("most_tf").alias("most_tf"), F.min("least_spread").alias("least_spread"),
        F.min("least_cost").alias("least_cost"))
    # both parts of the cost at their least; or the least sum at the usual length, which shrinks no faster than lengths do
    cost = F.greatest(_cost(F.col("most_tf"), F.col("least_spread"), F.col("average")),
                      F.col("least_cost") * F.least(F.lit(1.0), F.lit(USUAL_WORDS) / F.col("average")))
    may = F.col("n") * F.col("idf") * (K1 + 1) / (F.lit(1.0) + cost)
    of_term = Window.partitionBy("query_id", "term_part", "term")
    before = of_term.orderBy(F.desc("may"), "block").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("may").over(of_term)
    bounded = weighed.join(held, ["term_part", "term"]).withColumn("may", may).withColumns(
        {"best": best, "before": F.coalesce(F.sum("held").over(before), F.lit(0))})
    of_query = bounded.groupBy("query_id", "term").agg(F.first("best").alias("best")).groupBy("query_id").agg(F.sum("best").alias("all"))
    bounded = bounded.join(of_query, "query_id").drop("held", "most_tf", "least_spread", "least_cost")
    path = scratch_path(spark, "blocks")
    with shuffles_dropped(spark):
        bounded.write.parquet(f"{path}/bounded")
    bounded = spark.read.parquet(f"{path}/bounded")
    first = bounded.where(F.col("before") < k)
    sums = scored(index.entries.where(named & _least_blocks(first)), first, ["term_part", "term", "block"])
    floors = _ranked(sums, ["query_id"], "id", k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    reach = F.col("floor").isNull() | (F.col("may") + F.col("all") - F.col("best") >= F.col("floor") - SLACK)
    with shuffles_dropped(spark):
        bounded.join(floors, "query_id", "left").where(reach).drop("may", "best", "all", "before", "floor").write.parquet(f"{path}/needed")
    return spark.read.parquet(f"{path}/needed")


def _least_blocks(needed: DataFrame) -> Column:
    """A condition for the scan: of each term only blocks from the least one that any query needs."""
    least = needed.groupBy("term").agg(F.min("block").alias("block"))
    terms = least.limit(PUSHED_BLOCKS + 1).collect()
    if len(terms) > PUSHED_BLOCKS:
        return F.col("block") >= F.lit(least.agg(F.min("block")).first()[0])
    return reduce(or_, [(F.col("term") == r.term) & (F.col("block") >= r.block) for r in terms], F.lit(False))
