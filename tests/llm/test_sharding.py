from __future__ import annotations

import zlib

from llm.corpus_rows import edge_rows
from havenlens.llm import sharding


def check(rows, texts, n):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    total = sum(r["size"] for r in rows)
    assert all(0 <= r["shard"] < n for r in rows)
    bounds = []
    for shard in range(n):
        own = [r for r in rows if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        size, longest = sum(r["size"] for r in own), max((r["size"] for r in rows), default=0)
        assert abs(size - total / n) <= longest
        bounds += [(min(r["doc_id"] or -1 for r in own), max(r["doc_id"] or -1 for r in own))] if own else []
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))


def test_edge_rows(edge_docs, no_docs):
    texts = [(i, t) for i, t, _ in edge_rows()]
    for n in (1, 3, 8):
        check([r.asDict() for r in sharding.shard_by_bytes(edge_docs, n).collect()], texts, n)
    assert sharding.shard_by_bytes(no_docs).count() == 0


def test_one_id_holds_most_rows(spark):
    texts = [(7 if i % 3 else i, "x" * (i % 50)) for i in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    check([r.asDict() for r in sharding.shard_by_bytes(docs, 8).collect()], texts, 8)


def test_no_text_is_shuffled(edge_docs):
    plan = sharding.shard_by_bytes(edge_docs, 8)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan


def test_whole_table(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in entry.queries()["op2_byte_shards"](spark, folder).collect()]
    check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()], 8)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
