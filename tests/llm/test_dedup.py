"""Line windows and repeated passages against plain versions in memory."""
from __future__ import annotations

import random
import re

from llm.corpus_rows import edge_rows, prose
from havenlens.llm import linededup, spans, substring

BLANKS = " \t\n\x0b\x0c\r"


def normal(part: str) -> str:
    low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in part)
    return " ".join(w for w in re.split(f"[{BLANKS}]+", low) if w)


def ranked(rows):
    """Distinct (id, text) in rank order; the order among unequal texts of one id is told by the operator's own key."""
    return sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0))


def brute(rows, units_of, least_words):
    seen, out = {}, {}
    for i, text in ranked(rows):
        units, hits = units_of(text), []
        for place, (first, last, words, key) in enumerate(units):
            if key in seen:
                hits.append((place, first, last, words))
            else:
                seen[key] = (i, place)
        taken, run = [], []
        for hit in [*hits, None]:
            if run and (hit is None or hit[0] != run[-1][0] + 1):
                if sum(h[3] for h in run) >= least_words:
                    taken += [(h[1], h[2]) for h in run]
                run = []
            run.append(hit)
        out[i, text] = spans.merged(taken)
    return out


def line_units(text):
    lines, at = [], 0
    parts = text.split("\n")
    for n, line in enumerate(parts):
        end = at + len(line.encode()) + (n < len(parts) - 1)
        if normal(line):
            lines.append((at, end, normal(line)))
        at = end
    return [(a[0], c[1], 0, (a[2], b[2], c[2])) for a, b, c in zip(lines, lines[1:], lines[2:])]


def part_units(text):
    units, at, words, start = [], 0, [], 0
    for token in re.findall(f"^[{BLANKS}]+|[^{BLANKS}]+[{BLANKS}]*", text):
        word = normal(token)
        at += len(token.encode())
        words += [word] * bool(word)
        raw = word.encode()
        if word and ("\n" in token or (7 * raw[0] + 13 * raw[-1] + 5 * len(raw)) % 16 < 3):
            units.append((start, at, len(words), " ".join(words)))
            start, words = at, []
    return units + [(start, at, len(words), " ".join(words))] * bool(words)


def without(text, cut):
    raw, ends = text.encode(), [0, *[x for s in cut for x in s], len(text.encode())]
    return b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])).decode()


def texts():
    passage = prose(50, 60)
    own = [prose(60 + i, 40) for i in range(6)]
    block = "\n".join(prose(70 + i, 8) for i in range(5))
    return [
        (1, own[0] + " " + passage + " " + own[1]), (2, own[2] + " " + passage + " " + own[3]), (3, passage), (4, own[4] + " Yes. " + own[5]),
        (5, "Yes. No.\n" + block), (6, "A line\n\n" + block.upper() + "\n\nÜber allen"), (7, block + "\n" + block), (8, "x\n" * 9), (9, "Yes."),
        (10, None), (11, ""), (None, passage + "\n" + block), (12, "é " + passage.replace(" ", "  ")), (13, "a\nb"), (14, "Only\nthree\nlines"),
        (15, "only \n three\nLINES\nand more")] + [(i, t) for i, t, _ in edge_rows() if i is not None and i >= 8 and i != 3 and i < 13]


def rows_of(spark, pairs):
    unique = {}
    for i, t in pairs:
        unique.setdefault(i, t)
    return list(unique.items()), spark.createDataFrame(list(unique.items()), "doc_id long, text string").repartition(4)


def agree(cut, want):
    got = {(r.doc_id, r.row.text): (r.text, [tuple(s) for s in r.spans]) for r in cut.collect()}
    for (i, text), taken in want.items():
        assert got[i, text] == (without(text, taken), taken), i
    assert all(new == old and not s for (i, old), (new, s) in got.items() if (i, old) not in want)


def test_line_windows(spark):
    pairs, docs = rows_of(spark, texts())
    want = brute(pairs, line_units, 0)
    assert sum(map(bool, want.values())) >= 5
    agree(linededup.without_repeated_lines(docs), want)


def test_passages(spark):
    pairs, docs = rows_of(spark, texts())
    want = brute(pairs, part_units, 25)
    assert sum(map(bool, want.values())) >= 4
    cut = substring.without_repeated_passages(docs)
    agree(cut, want)
    rows = {r.doc_id: r for r in cut.collect()}
    assert rows[2].origins == [1] and len(rows[3].text.split()) < 20 and rows[9].text == "Yes." and "Yes." in rows[5].text


def test_other_units(spark):
    long = prose(90, 30)
    docs = spark.createDataFrame([(1, f"{long}\n\nown words here"), (2, f"first\n\n{long.upper()} \n\nlast")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in substring.without_repeated_passages(docs, "paragraph").collect()}
    assert rows[2] == "first\n\nlast"
    docs = spark.createDataFrame([(1, f"{long}\nx"), (2, f"first\n{long}\nlast")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in substring.without_repeated_passages(docs, "line").collect()}
    assert rows[2] == "first\nlast"


def test_edge_rows_keep_their_columns_and_repeated_rows_share_a_fate(edge_docs, no_docs):
    for operator in (linededup.deduplicate, substring.deduplicate):
        kept = operator(edge_docs)
        assert kept.columns == edge_docs.columns
        rows = kept.collect()
        assert all(r.row_key == "other" and r.spans == "other" for r in rows)
        twins = [r.text for r in rows if r.doc_id == 3]  # two equal rows and one that only adds a word
        assert len(twins) == 3 and len(set(twins)) == 2 if operator is linededup.deduplicate else len(twins) in (1, 2, 3)
        assert any(r.text is None for r in rows) and any(r.text == "" for r in rows)
        assert next(r.text for r in rows if r.doc_id == 9) == "x" * 50_000
        assert operator(no_docs).count() == 0
    emptied = {r.doc_id for r in substring.deduplicate(edge_docs).collect()}
    assert 1 in emptied and 2 not in emptied


def test_a_line_of_a_third_of_all_documents(spark):
    docs = spark.createDataFrame([(i, f"common one\ncommon two\ncommon three\nown {i}") for i in range(3000)], "doc_id long, text string").repartition(6)
    rows = linededup.deduplicate(docs).collect()
    assert {r.text for r in rows} == {"common one\ncommon two\ncommon three\nown 0"} | {f"own {i}" for i in range(1, 3000)}


def test_merged():
    assert spans.merged([(5, 7), (0, 2), (2, 3), (6, 9), (6, 6)]) == [(0, 3), (5, 9)]


def flat(seed: int, n: int) -> str:
    """Prose of n words without a stop."""
    return " ".join(prose(seed, n).replace(".", "").split()[:n])


def test_passages_inside_other_words(spark):
    """Passages without a stop, glued to other words at both ends, all but some words of their ends go; short ones stay."""
    chance = random.Random(6)
    docs, planted = [], {}
    for i in range(120):
        n = chance.choice([18, 55, 70, 120, 400])
        passage, own = flat(1000 + i, n), [flat(5000 + 3 * i + k, 20) for k in range(3)]
        docs.append((2 * i, f"{own[0]} {passage} {own[1]}"))
        docs.append((2 * i + 1, f"{own[2]}, {passage.upper() if i % 2 else passage.replace(' ', '  ')} and {flat(9000 + i, 20)}"))
        planted[2 * i + 1] = (n, own[2])
    docs += [(900, " ".join(["again"] * 300)), (None, f"a {docs[0][1]}")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    cut = substring.without_repeated_passages(df)
    agree(cut, brute(docs, part_units, 25))
    rows = {r.doc_id: r for r in cut.collect()}
    caught = 0
    for i, (n, before) in planted.items():
        left = len(rows[i].text.split()) - 41  # without the words that are its own
        assert before in " ".join(rows[i].text.split()) and not rows[i - 1].spans
        if n < 25:
            assert not rows[i].spans
        elif rows[i].spans:
            caught += 1
            assert left < 45 and i - 1 in rows[i].origins
    assert caught >= 0.97 * sum(n > 50 for n, _ in planted.values()) and not rows[900].spans and rows[None].spans
