"""The registered queries of the corpus operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from havenlens.llm import ann, binpack, bpe, hardneg, langid, linededup, packing, quality, sharding, simhash, spelling, substring, warc
from havenlens.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return add


@query("op2_byte_shards")
def _(spark, folder):
    return sharding.shard_by_bytes(read(spark, folder, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: Runs of anything but blanks, as each engine writes them.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op4_rule_ledger", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
wins AS (SELECT r, i, list_slice(w, i, i + 7) AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(8) t(k) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
             coalesce(dups.n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
      FROM d LEFT JOIN dups USING (r) LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT 100 * n_symbols > 10 * n_words AND NOT 100 * n_dup_lines > 50 * n_lines
       AND NOT word_chars < 2 * n_words AND NOT word_chars > 15 * n_words AS kept
FROM b""")
def _(spark, folder):
    book = quality.ledger(read(spark, folder, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.POLICIES["base"])).alias("base_failed"),
        quality.passes(quality.POLICIES["v1"]).alias("kept"))


#: The rows held out of learning: a quarter, by a checksum of the id.
FOLD = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 4, 0)"


@query("op6_language_id")
def _(spark, folder):
    docs = read(spark, folder, "documents")
    model = langid.fit(docs, F.expr(f"{FOLD} != 2"))
    return langid.identify(docs, model).select("doc_id", F.expr(f"{FOLD} = 2").alias("held_out"), "lang_pred", "score")


@query("op3_simhash_groups")
def _(spark, folder):
    return simhash.near_duplicates(read(spark, folder, "documents"), shingle=3, most_bits=2).select(
        "doc_id", "fingerprint", "component_id")


def _told(cut: DataFrame) -> DataFrame:
    """The kept text, with what was removed as text, so that both engines compare plain values."""
    return cut.select(
        "doc_id", "text", F.size("spans").alias("n_spans"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.getField("first"), s.getField("last"))), ",").alias("removed"),
        F.array_join("origins", ",").alias("origins"))


#: A line or sentence as it is compared: A-Z in lower case, runs of blanks as one space.
NORMAL = (r"trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[\x20\x09-\x0D]+', ' ', 'g'), ' ')")
#: From `tiles` (doc_id, i, first, tile) and `taken` (doc_id, first, last, origin), the kept text and what was removed.
KEPT = """
islands AS (SELECT doc_id, first, last, sum(fresh) OVER (PARTITION BY doc_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS g
            FROM (SELECT doc_id, first, last, CASE WHEN first <= max(last) OVER (PARTITION BY doc_id ORDER BY first, last
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
                  FROM (SELECT DISTINCT doc_id, first, last FROM taken) t) t),
spans AS (SELECT doc_id, g, min(first) AS first, max(last) AS last FROM islands GROUP BY doc_id, g),
removed AS (SELECT doc_id, count(*) AS n_spans, string_agg(first::BIGINT || '-' || last::BIGINT, ',' ORDER BY first) AS removed
            FROM spans GROUP BY doc_id),
origins AS (SELECT doc_id, string_agg(origin::VARCHAR, ',' ORDER BY origin) AS origins
            FROM (SELECT DISTINCT doc_id, origin FROM taken) t GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(tile, '' ORDER BY i) AS text FROM tiles t
         WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = t.doc_id AND s.first <= t.first AND t.first < s.last)
         GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(n_spans, 0)::INTEGER AS n_spans,
       coalesce(removed, '') AS removed, coalesce(origins, '') AS origins
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id) LEFT JOIN origins USING (doc_id)"""


@query("op7_line_windows", f"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, len(a) AS n, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM cut),
parts AS (SELECT doc_id, i, line || CASE WHEN i < n THEN chr(10) ELSE '' END AS tile FROM lines),
tiles AS (SELECT doc_id, i, tile, sum(strlen(tile)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(tile) AS first, {NORMAL.format('tile')} AS norm
          FROM parts),
windows AS (SELECT doc_id, i, first, lead(first + strlen(tile), 2) OVER w AS last,
                   norm || chr(10) || lead(norm) OVER w || chr(10) || lead(norm, 2) OVER w AS win
            FROM tiles WHERE norm <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
taken AS (SELECT doc_id, first, last, origin FROM (
            SELECT *, first_value(doc_id) OVER v AS origin, row_number() OVER v AS nth FROM windows WHERE last IS NOT NULL
            WINDOW v AS (PARTITION BY win ORDER BY doc_id, i)) t WHERE nth > 1),
{KEPT}""")
def _(spark, folder):
    return _told(linededup.without_repeated_lines(read(spark, folder, "documents")))


@query("op8_repeated_passages", rf"""
WITH cut AS (SELECT doc_id, regexp_extract_all(text, '^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS a
             FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, n, token, {NORMAL.format('token')} AS word
           FROM (SELECT doc_id, unnest(a) AS token, generate_subscripts(a, 1) AS n FROM cut) t),
ends AS (SELECT *, word <> '' AND (contains(token, chr(10)) OR (7 * instr('123456789ABCDEF', substr(hex(word), 2, 1))
                + 13 * instr('123456789ABCDEF', right(hex(word), 1)) + 5 * strlen(word)) % 16 < 3) AS last FROM tokens),
numbered AS (SELECT *, coalesce(sum(last::INTEGER) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING
                                                         AND 1 PRECEDING), 0) AS i FROM ends),
parts AS (SELECT doc_id, i, string_agg(token, '' ORDER BY n) AS tile, string_agg(word, ' ' ORDER BY n) FILTER (word <> '') AS norm,
                 count(*) FILTER (word <> '') AS words FROM numbered GROUP BY doc_id, i),
tiles AS (SELECT *, sum(strlen(tile)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(tile) AS first FROM parts),
units AS (SELECT doc_id, i AS place, first, first + strlen(tile) AS last, norm, words FROM tiles WHERE norm IS NOT NULL),
later AS (SELECT * FROM (SELECT *, first_value(doc_id) OVER v AS origin, row_number() OVER v AS nth FROM units
                         WINDOW v AS (PARTITION BY norm ORDER BY doc_id, place)) t WHERE nth > 1),
runs AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM later),
taken AS (SELECT doc_id, first, last, origin FROM runs QUALIFY sum(words) OVER (PARTITION BY doc_id, run) >= 25),
{KEPT}""")
def _(spark, folder):
    return _told(substring.without_repeated_passages(read(spark, folder, "documents")))


@query("op1_byte_bpe")
def _(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(read(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"))


@query("op5_tiered_packing")
def _(spark, folder):
    pieces = packing.pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed(pieces)


def packed(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "window", "step_group")


@query("op9_warc_salvage", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f""")
def _(spark, folder):
    return warc.round_trip(read(spark, folder, "pages")).where(F.col("reason").isNull()).select(
        warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        warc.page_number("refers_to").alias("refers_to"))


@query("op10_cross_polytope")
def _(spark, folder):
    return ann.search(read(spark, folder, "embeddings"), "vec_id % 20 = 0", k=20)


@query("op11_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""")
def _(spark, folder):
    rows = read(spark, folder, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hardneg.mine(hardneg.scaled(rows, 256), "vec_id % 100 = 0", positives=5, negatives=10, low=30, high=90)


@query("op12_minimum_slack")
def _(spark, folder):
    return binpack.pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024).drop("ids")


@query("op13_spelling_variants")
def _(spark, folder):
    words = spelling.count_words(read(spark, folder, "documents"), least_length=7, least_count=2, damage=31)
    return spelling.variants(words, ratio=10)
