"""SimHash fingerprints and their near-duplicate groups, by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from havenlens.llm.common import done_with, join_keys, slices, stored, texts, with_row
from havenlens.llm.components import connected_components

SEED = 42
#: Bits of one step when a crowded pair of nodes is split into pairs of their descendants.
STEP_BITS = 5
#: Rows of a pair of nodes that one task takes; a pair with more is split.
CROWDED = 4096


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a whole text: a bit is set if more than half of its shingles' hashes have it.

    Words are runs of anything but ASCII blanks, after A-Z became a-z; a text of fewer words is one shingle, and one
    without words has fingerprint 0.
    """
    words = text.lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    runs = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), dtype="<u8", count=n)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[start:start + (1 << 16)].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, fp) of every row, without a shuffle; fp is the fingerprint as a signed bigint. Null is empty."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in texts(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], pa.array(found)], ["doc_id", "row_key", "fp"])

    rows = with_row(docs, text_col, id_col).select("doc_id", "row_key", "text")
    return rows.mapInArrow(make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, row_key bigint, fp bigint")


def links(fps: DataFrame, most_bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(a, b) over distinct fingerprints fp: enough links to connect all that differ in at most `most_bits` bits.

    Two such fingerprints agree wholly in one of `most_bits` + 1 blocks of bits. For each block the bits are turned until
    it leads, and the tries below equal blocks are joined with themselves: pairs of nodes go down together, add up the
    bits in which they differ and stop once these are too many. Blocks spread the tries over tasks. A pair of nodes with
    more than `crowded` rows becomes the pairs of their descendants some bits below, again pruned, until none is crowded;
    so no task gets a group of unbounded size however alike the fingerprints are. Of the pairs that a node pair holds,
    those that connect them are returned, one per fingerprint at most.
    """
    blocks = [64 // (most_bits + 1) + (i < 64 % (most_bits + 1)) for i in range(most_bits + 1)]
    turns = [(sum(blocks[:i]), width) for i, width in enumerate(blocks)]
    rotated = fps.select("fp", F.inline(F.array(*[
        F.struct(F.lit(i).alias("turn"), F.lit(width).alias("depth"),
                 _turn(F.col("fp"), shift).alias("key")) for i, (shift, width) in enumerate(turns)])))
    # spent: the bits in which the two nodes differ so far; side 0: a pair of a node with itself, 1 and 2: of two nodes
    pairs = rotated.select(
        F.xxhash64("turn", F.expr("shiftrightunsigned(key, 64 - depth)")).alias("pair"),
        F.lit(0).alias("spent"), F.lit(0).alias("side"), "depth", "key", "turn")
    pairs = stored(pairs, "nodes")
    calm = []
    while True:
        sizes = pairs.groupBy("pair").agg(F.count("*").alias("size"), F.max("depth").alias("at"),
                                          F.min("side").alias("low"), F.max("side").alias("high"))
        big = stored(sizes.where((F.col("size") > crowded) & (F.col("at") < 64)).select(
            "pair", ((F.col("low") == 0) | (F.col("low") < F.col("high"))).alias("both")), "crowded")
        if big.isEmpty():
            calm.append(pairs)
            break
        calm.append(pairs.join(big, "pair", "left_anti"))
        pairs = stored(_descend(pairs.join(big.where("both").select("pair"), "pair"), most_bits), "nodes")
    found = [group.repartition("pair").sortWithinPartitions("pair").mapInArrow(
        _trie_joiner(turns, most_bits), "a bigint, b bigint") for group in calm]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _turn(column, shift: int):
    return column if shift == 0 else F.shiftleft(column, shift).bitwiseOR(F.shiftrightunsigned(column, 64 - shift))


def _descend(pairs: DataFrame, most_bits: int) -> DataFrame:
    """Each row of a pair of nodes, once for every pair of their descendants STEP_BITS below that it can belong to."""
    sized = pairs.withColumn("width", F.least(F.lit(STEP_BITS), 64 - F.col("depth")))
    apart = F.bit_count(F.col("own").bitwiseXOR(F.col("other")))
    steps = (
        sized.withColumn("own", F.expr("cast(shiftrightunsigned(shiftleft(key, depth), 64 - width) AS int)"))
        .withColumn("other", F.explode(F.filter(
            F.expr("sequence(0, shiftleft(1, width) - 1)"),
            lambda w: F.bit_count(F.col("own").bitwiseXOR(w)) <= F.lit(most_bits) - F.col("spent")))))
    low = F.when(F.col("side") == 0, F.least("own", "other")).when(F.col("side") == 1, F.col("own")).otherwise(F.col("other"))
    high = F.when(F.col("side") == 0, F.greatest("own", "other")).when(F.col("side") == 1, F.col("other")).otherwise(F.col("own"))
    side = F.when((F.col("side") != 0), F.col("side")).when(F.col("own") == F.col("other"), 0).when(
        F.col("own") < F.col("other"), 1).otherwise(2)
    return steps.select(
        F.xxhash64("pair", low, high).alias("pair"), (F.col("spent") + apart).cast("int").alias("spent"),
        side.alias("side"), (F.col("depth") + F.col("width")).alias("depth"), "key", "turn")


def _trie_joiner(turns: list[tuple[int, int]], most_bits: int, rows_at_once: int = 1 << 17):
    """Batches sorted by pair; whole pairs are gathered to some thousands of rows and their tries go down together."""
    names = ["pair", "spent", "side", "depth", "key", "turn"]

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        pair, spent, side, depth, key, turn = (table[c].to_numpy() for c in names)
        key = key.view(np.uint64)
        order = np.lexsort((key, side, pair))
        pair, spent, side, depth, key, turn = (x[order] for x in (pair, spent, side, depth, key, turn))
        root = np.arange(len(key))
        for a, b in trie_pairs(pair, spent, side, depth, key, most_bits):
            root = _joined(root, a, b)
        member = np.flatnonzero(root != np.arange(len(root)))
        if not len(member):
            return
        back = np.array([shift for shift, _ in turns], np.uint64)[turn]
        fp = np.where(back == 0, key, (key >> back) | (key << ((np.uint64(64) - back) & np.uint64(63)))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(fp[member]), pa.array(fp[root[member]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch]).select(names)
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows >= rows_at_once:
                last = held["pair"][-1].as_py()
                whole = pc.index(held["pair"], last).as_py()  # rows before the pair that may go on
                if whole:
                    yield from solve(held.slice(0, whole).combine_chunks())
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from solve(held.combine_chunks())

    return run


def trie_pairs(pair, spent, side, depth, key, most_bits: int, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of places (a, b) of keys that differ in at most most_bits bits within each pair of nodes.

    Rows are sorted by pair, side and key. A node is a run of rows that share their leading bits; the pairs of nodes at
    one depth are taken together, a bit at a time, in blocks of about `at_once`, deepest first.
    """
    n = len(key)
    heads = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (side[1:] != side[:-1])])
    ends = np.r_[heads[1:], n]
    alone = side[heads] == 0
    two = np.flatnonzero((side[heads[:-1]] == 1) & (side[heads[1:]] == 2) & (pair[heads[:-1]] == pair[heads[1:]]))
    alo, ahi = np.r_[heads[alone], heads[two]], np.r_[ends[alone], ends[two]]
    blo, bhi = np.r_[heads[alone], heads[two + 1]], np.r_[ends[alone], ends[two + 1]]
    start = np.stack([alo, ahi, blo, bhi, spent[alo], depth[alo]]).astype(np.int64)
    todo = [start[:, start[5] == d] for d in np.unique(start[5])]
    ones: dict[int, np.ndarray] = {}
    while todo:
        front = todo.pop()
        alo, ahi, blo, bhi, diff, at = front
        own, left, right = alo == blo, ahi - alo, bhi - blo
        open_ = (left > 0) & (right > 0) & (diff <= most_bits) & ~(own & (left < 2))
        single = open_ & np.where(own, left == 2, (left == 1) & (right == 1))
        i, j = alo[single], np.where(own, alo + 1, blo)[single]
        near = np.bitwise_count(key[i] ^ key[j]) <= most_bits
        yield i[near], j[near]
        front = front[:, open_ & ~single]
        if not front.shape[1]:
            continue
        if front.shape[1] > at_once:
            todo += np.array_split(front, front.shape[1] // at_once + 1, axis=1)
            continue
        alo, ahi, blo, bhi, diff, at = front
        d, own = int(at[0]), alo == blo
        if d not in ones:
            ones[d] = np.r_[0, np.cumsum((key >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)]
        amid, bmid = ahi - (ones[d][ahi] - ones[d][alo]), bhi - (ones[d][bhi] - ones[d][blo])
        other = ~own
        todo.append(np.concatenate([
            np.stack([alo, amid, blo, bmid, diff, at + 1]), np.stack([amid, ahi, bmid, bhi, diff, at + 1]),
            np.stack([alo, amid, bmid, bhi, diff + 1, at + 1]),
            np.stack([amid, ahi, blo, bmid, diff + 1, at + 1])[:, other]], axis=1))


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each place is linked to, directly or not, once the links (a, b) are added."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root = root[root]


def groups(fps: DataFrame, most_bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(fp, n, root, component_id): each distinct fingerprint, its rows, its group's name and smallest doc_id.

    Exact copies meet in one row before anything is joined. Null ids never name a component unless all its ids are null.
    """
    distinct = stored(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "fingerprints")
    members = stored(connected_components(links(distinct.select("fp"), most_bits, crowded)), "members")
    least = members.join(distinct.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(
        F.min("least").alias("component"), F.count("*").alias("size"))
    named = join_keys(members, least, "root", "size").select(F.col("node").alias("fp"), "root", "component")
    told = stored(distinct.join(named, "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id")), "components")
    done_with(distinct, members)
    return told


def near_duplicates(docs: DataFrame, shingle: int = 3, most_bits: int = 2, id_col: str = "doc_id", text_col: str = "text",
                    crowded: int = CROWDED) -> DataFrame:
    """(doc_id, row_key, fingerprint, root, component_id) of every row.

    fingerprint is 16 lower-case hex digits; component_id the smallest doc_id whose text can be reached over steps of at
    most `most_bits` differing bits, itself included. Null and empty texts have fingerprint zero and link like any other.
    Repeated rows and ids are told row by row. An empty table gives no rows; other columns are ignored.
    """
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "rows")
    return join_keys(fps, groups(fps, most_bits, crowded), "fp", "n").select(
        "doc_id", "row_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "root", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, most_bits: int = 2, id_col: str = "doc_id", text_col: str = "text",
               crowded: int = CROWDED) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: the smallest doc_id (nulls last), then row_key.

    Of rows equal in id and text one stays.
    """
    marked = near_duplicates(docs, shingle, most_bits, id_col, text_col, crowded)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    kept = marked.groupBy("root").agg(F.min(order).alias("first"))
    firsts = kept.select("first.doc_id", "first.row_key").withColumnsRenamed({"doc_id": "kept_id", "row_key": "kept_key"})
    rows = with_row(docs, text_col, id_col)
    return (rows.join(firsts, rows["doc_id"].eqNullSafe(F.col("kept_id")) & (rows["row_key"] == F.col("kept_key")), "left_semi")
            .groupBy("doc_id", "row_key").agg(F.first("row").alias("row")).select("row.*"))
