"""Spelling variants against all pairs in memory."""
from __future__ import annotations

import re
import zlib
from collections import Counter

from llm.corpus_rows import edge_rows
from havenlens.llm import spelling


def edits(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point parts them."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, damage=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % damage == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(counts, ratio=10):
    # words one edit apart share one of them without a code point
    without = {}
    for w in counts:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            without.setdefault(v, []).append(w)
    near = {w: set() for w in counts}
    for group in without.values():
        for a in group:
            near[a].update(b for b in group if b not in near[a] and edits(a, b))
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def told(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return [tuple(r) for r in df.collect()]


def words_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)


def test_edits_at_every_place_forms_ties_and_chains(spark):
    counts = {"original": 1000, "orginal": 100, "orignal": 9, "orignla": 3, "xoriginal": 2, "originalx": 2, "origxinal": 100, "origyinal": 100,
              "origynal": 10, "Ãriginal": 5, "aaaaaaaa": 20, "aaaaaaa": 2, "aaaaaaaab": 200, "baaaaaaaa": 200, "élégante": 40, "élegante": 4,
              "elegante": 4, "abcdefghij": 1000, "abcdefghi": 100, "abcdefgh": 10, "abcdefg": 10, "abcdefh": 10, "abcdegf": 99, "lonely_": 5, "a" * 5000: 3, "a" * 2500 + "b" + "a" * 2499: 30}
    got = told(spelling.variants(words_of(spark, counts)))
    assert len(got) == len(set(got)) and set(got) == brute(counts)
    by = {r[0]: r for r in got}
    assert by["abcdefgh"][1:3] == ("abcdefghi", "abcdefghij") and by["aaaaaaaa"][1] == "aaaaaaaab"
    assert by["abcdefg"][1] is None and by["lonely_"][4] == 0 and by["a" * 5000][1] is not None


def test_words_that_begin_and_end_alike_are_cut_finer(spark):
    """A third of all words share a long beginning, a third a long end; and all words of two letters at two places."""
    import itertools

    letters = "abcdefghij"
    words = ["commonstart" + "".join(p) for p in itertools.product("abcdefg", repeat=4)]
    words += ["".join(p) + "commonend" for p in itertools.product("hijklmn", repeat=4)]
    words += [f"{a}middle{b}" for a in letters for b in letters] + [f"{a}middl{b}" for a in letters for b in letters]
    counts = {w: 2 + 7 * (zlib.crc32(w.encode()) % 40 == 0) * (zlib.crc32(w.encode()) % 9) for w in words}
    want = brute(counts)
    for crowded in (1, spelling.CROWDED):
        assert set(told(spelling.variants(words_of(spark, counts), crowded=crowded))) == want
    assert any(r[1] for r in want)


def test_counting(spark, edge_docs, no_docs):
    rows = [(i, t) for i, t, _ in edge_rows()]
    counted = {r.word: r.n for r in spelling.count_words(edge_docs, damage=31).collect()}
    assert counted == brute_words(rows) and "x" * 50_000 not in counted
    assert spelling.count_words(edge_docs, least_count=1, least_length=1).where("length(word) = 50000").count() == 1
    assert set(told(spelling.variants(spelling.count_words(edge_docs, damage=31)))) == brute(brute_words(rows))
    assert spelling.variants(spelling.count_words(no_docs)).count() == 0


def test_query(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = told(entry.queries()["op13_spelling_variants"](spark, folder))
    assert len(got) == len(set(got)) and set(got) == brute(brute_words(docs))
    assert any(r[1] for r in got)
