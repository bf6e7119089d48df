from __future__ import annotations

import numpy as np
import pytest
import xxhash

from llm.corpus_rows import edge_rows, prose
from havenlens.llm import simhash
from havenlens.llm.components import connected_components


def brute_fingerprint(text, n=3):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ")
             .replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    runs = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, bits):
    left, groups = set(values), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= bits}
            left -= near
            todo += near
        groups.append(frozenset(group))
    return set(groups)


@pytest.mark.parametrize("text", [None, "", " \n", "One", "One two", "A b C d", prose(5, 300), "É b\tc\x0bd\x0ce f", "a " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


@pytest.mark.parametrize(("bits", "crowded"), [(2, 4096), (2, 12), (0, 4096), (3, 25)])
def test_groups_are_those_of_all_pairs(spark, bits, crowded):
    chance = np.random.default_rng(bits + crowded)
    values = {0, 1, 2**64 - 1, 2**64 - 2}
    for centre in chance.integers(0, 2**63, 4):  # crowds whose members differ in few bits, and chains of them
        for _ in range(70):
            x = int(centre)
            for bit in chance.integers(0, 64, chance.integers(0, 6)):
                x ^= 1 << int(bit)
            values.add(x)
    values |= {int(v) for v in chance.integers(0, 2**63, 100)}
    signed = [v - 2**64 if v >= 2**63 else v for v in sorted(values)]
    fps = spark.createDataFrame([(i, i, v) for i, v in enumerate(signed)], "doc_id long, row_key long, fp long").repartition(4)
    rows = simhash.groups(fps, bits, crowded).collect()
    got = {}
    for r in rows:
        got.setdefault(r.root, set()).add(r.fp % 2**64)
    assert set(map(frozenset, got.values())) == brute_groups(values, bits)
    place = {v: i for i, v in enumerate(signed)}
    assert all(r.component_id == min(place[v - 2**64 if v >= 2**63 else v] for v in got[r.root]) for r in rows)


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(100, 160)] + [(5, 5)]
    rows = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    got = {r.node: r.root for r in rows}
    assert len(rows) == len(got) == 61 + 61
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in [*range(100, 160), 1000]} == {100}
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_components_of_a_hub_are_whole_and_leave_one_step(spark):
    """One node with nearly all links, as larger and as smaller end, and a chain behind it."""
    from pathlib import Path

    from havenlens.session import shared_folder

    pairs = [(5000, i) for i in range(2000, 4500)] + [(1, i) for i in range(6000, 8500)] + [(8499, 9000), (9000, 9001), (4499, 10)]
    rows = connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(5), "hublinks").collect()
    got = {r.node: r.root for r in rows}
    assert len(rows) == len(got) == 2502 + 2503
    assert {got[i] for i in (5000, 10, *range(2000, 4500))} == {10} and {got[i] for i in (1, 9000, 9001, *range(6000, 8500))} == {1}
    assert len(list(Path(shared_folder(spark).removeprefix("file:")).glob("hublinks-*"))) == 1


def expected_rows():
    rows = [(i, t, brute_fingerprint(t)) for i, t, _ in edge_rows()]
    groups = {fp: g for g in brute_groups([r[2] for r in rows], 2) for fp in g}
    least = {g: min((i for i, _, fp in rows if fp in g and i is not None), default=None) for g in set(groups.values())}
    return rows, groups, least


def test_edge_rows(edge_docs, no_docs):
    rows, groups, least = expected_rows()
    want = sorted(((i, f"{fp:016x}", least[groups[fp]]) for i, _, fp in rows), key=repr)
    got = sorted((tuple(r) for r in simhash.near_duplicates(edge_docs).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == want
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0


def test_one_row_of_each_group_stays_with_its_columns(edge_docs):
    rows, groups, least = expected_rows()
    kept = simhash.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    kept = kept.collect()
    assert len(kept) == len(set(groups.values()))
    fp = {t: f for _, t, f in rows}
    assert {groups[fp[r.text]] for r in kept} == set(groups.values())
    assert all(r.doc_id == least[groups[fp[r.text]]] and r.row_key == "other" for r in kept)
