"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the frequent form each of them stands for."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from havenlens.llm.common import join_keys, slices, stored, texts

#: Letters a to z and from À to ÿ; A to Z are a to z by then.
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Candidate pairs for each row of a chunk's group above which the group is cut into finer chunks.
CROWDED = 16
#: Different words of a batch that a task holds at a time.
HELD = 200_000


def damaged(word: str, start: int, every: int) -> str:
    """The word, or, if `every` divides its checksum, the word without one code point. `start`: checksum of what stands before."""
    h = zlib.crc32(word.encode(), start)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def count_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, damage: int | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of letters in all whole texts, only A-Z in lower case, and how often they occur.

    Words of fewer code points than `least_length` or fewer occurrences than `least_count` are left out. With `damage` one
    occurrence in so many, told by crc32 of `<doc_id>:<word>`, is counted with one code point deleted. Tasks count before
    anything is shuffled, so no word is hot. Null texts have no words, a null id reads as empty, repeated rows count again.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts(batch["text"])):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(_RUN.findall(text.lower().decode())).items():
                    if len(word) >= least_length:
                        word = damaged(word, start, damage) if damage else word
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) >= HELD:
                    yield told()
                    held.clear()
        yield told()

    found = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _chunks(rows: DataFrame) -> DataFrame:
    """Each row's two halves of what is left: one becomes part of the key, the other is left.

    `first` and `last` bound what is left of the word, `longer` tells by how much it is longer than its partner's. The
    partner's halves fix where its chunks lie: the first at the same place, the second shifted by `longer`.
    """
    left = F.col("last") - F.col("first") - F.col("longer")
    head = F.floor(left / 2).cast("int")
    tail = left - head

    def gram(at: Column, size: Column, side: int) -> Column:
        return F.xxhash64("key", F.lit(side), F.substring("word", at + 1, size))

    def half(key: Column, first: Column, last: Column) -> Column:
        return F.struct(key.alias("key"), first.alias("first"), last.alias("last"))

    return rows.select("word", "n", "longer", F.inline(F.array(
        half(gram(F.col("first"), head, 0), F.col("first") + head, F.col("last")),
        half(gram(F.col("last") - tail, tail, 1), F.col("first"), F.col("last") - tail))))


def near_words(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, a_n, b, b_n): every two different words (word, n) that one inserted, deleted or replaced code point parts, once.

    A word of n code points contributes two disjoint chunks, its halves; a partner of n or n + 1 code points contributes its
    grams of these sizes. One edit preserves a chunk, and as the lengths tell by how much it can be shifted (the first half
    not at all, the second by the difference), only the grams at those places are joined. What shares a chunk is verified.

    Where a chunk is so common that its group has more than `crowded` pairs for each row, the halves that are left over
    are cut in two again: the edit lies in one of them, so the other joins the key. This ends at one code point, where a
    group has no more words than the alphabet has letters or pairs of letters. So no pair is lost, and none but those that
    agree in all chunks of such a key is compared, however many words begin or end alike.
    """
    size = F.length("word")
    rows = words.select("word", "n", F.inline(F.array(*[
        F.struct(F.lit(longer).alias("longer"), F.xxhash64(size - longer).alias("key"), F.lit(0).alias("first"), size.alias("last"))
        for longer in (0, 1)])))
    found = []
    while True:
        rows = stored(_chunks(rows), "chunks")
        own, longer = F.count_if(F.col("longer") == 0), F.count_if(F.col("longer") == 1)
        sizes = rows.groupBy("key").agg(
            own.alias("own"), longer.alias("far"), F.max(F.col("last") - F.col("first") - F.col("longer")).alias("left"))
        pairs = F.col("own") * (F.col("own") - 1) / 2 + F.col("own") * F.col("far")
        keys = stored(sizes.where(pairs > 0).select(
            "key", (F.col("own") + F.col("far")).alias("size"),
            ((pairs > crowded * (F.col("own") + F.col("far"))) & (F.col("left") > 1)).alias("crowded")), "chunk_keys")
        calm = keys.where("NOT crowded").drop("crowded")
        shared = join_keys(rows, calm, "key", "size").select("key", "word", "n", "longer")
        left = shared.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        right = shared.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
        found.append(stored(
            left.join(right, "key").where("(longer = 1 OR a < b) AND levenshtein(a, b, 1) = 1").select("a", "a_n", "b", "b_n"), "near"))
        dense = keys.where("crowded").drop("crowded")
        if dense.isEmpty():
            break
        rows = join_keys(rows, dense, "key", "size").drop("size")
    return reduce(DataFrame.unionByName, found).dropDuplicates(["a", "b"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) without circles: the end of each word's chain of forms. Chains halve in every round."""
    ends = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(ends.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                           F.col("further").isNotNull().alias("moved")), "roots")
        ends = step.drop("moved")
        if step.where("moved").isEmpty():
            return ends


def variants(words: DataFrame, ratio: int = 10, crowded: int = CROWDED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word in (word, n), with one row per word and no nulls.

    A word's form is its near word of largest n, ties to the smallest in code-point order, if that n is at least `ratio`
    times its own; else null. root is the last word of the chain of forms, the word itself if it has no form. `ratio` must
    be over 1, so that chains end. An empty table gives no rows.
    """
    words = stored(words, "words")
    pairs = stored(near_words(words, crowded), "pairs")
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("rank"), F.col("b").alias("near")).alias("best")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("rank"), F.col("a").alias("near")).alias("best")))))
    nearest = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    frequent = -F.col("best.rank") >= ratio * F.col("n")
    told = stored(words.join(nearest, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"),
        F.when(frequent, -F.col("best.rank")).alias("form_n")), "forms")
    return told.join(roots(told.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
