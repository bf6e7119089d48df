from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from havenlens.llm import warc


def pages():
    same, short = "<p>" + "same " * 40 + "</p>", "tiny"
    rows = [(1, "http://a/1", "<html>one</html>" * 20), (2, None, same), (3, "http://a/3 ü\n", same), (4, "http://a/4", same), (5, "u", short),
            (6, "u", short), (7, "u", None), (8, "u", ""), (9, "u", "x" * 99), (10, "u", "x" * 99), (11, "u", "é" * 50), (12, "u", "é" * 50),
            (13, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5), (14, "u", "z" * 400_000), (15, "u", "\r\n\r\n" * 30), (None, "u", same),
            (16, "u", "😀" * 40), (16, "u", "😀" * 40)]
    return rows + [(20 + i, f"http://b/{i}", f"<p>page {i}</p>" * 12) for i in range(60)]


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        of = first.get(html)
        again = i is not None and of is not None and i > of
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", of if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    """Pages with a clashing column, written to archives; the bytes of the largest."""
    path = str(tmp_path_factory.mktemp("warc") / "out")
    df = spark.createDataFrame([(*r, "x") for r in pages()], "page_id long, url string, html string, digest string").repartition(3)
    warc.write_pages(df, path, records_per_file=25)
    return path


def test_round_trip(spark, archive):
    rows = warc.read_archives(spark, archive)
    assert rows.where("reason IS NOT NULL").count() == 0
    got = rows.select(warc.page_number("record_id"), "payload_bytes", "payload_digest", "type", warc.page_number("refers_to")).collect()
    assert sorted(map(tuple, got), key=repr) == expected(pages())
    payload = {r.record_id: bytes(r.payload) for r in rows.collect()}
    assert payload["<urn:havenlens:page:3>"] == b"" and payload["<urn:havenlens:page:14>"] == b"z" * 400_000
    assert rows.where("record_id = '<urn:havenlens:page:3>'").first().target_uri == "http://a/3%20ü%0A"


def test_archives_are_gzip_that_any_reader_takes(archive):
    import glob

    files = [f for f in glob.glob(f"{archive}/part-*")]
    text = b"".join(gzip.open(f).read() for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type") >= len(pages())


def test_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, str(tmp_path / "none")).count() == 0


def made(n=12):
    parts = [warc.record(i, f"http://x/{i}", (f"payload {i} " * 200).encode(), hashlib.sha256((f"payload {i} " * 200).encode()).hexdigest(), None, "2020-01-01T00:00:00Z")
             for i in range(n)]
    return parts, [gzip.compress(p, mtime=0) for p in parts]


def read(data):
    found, gaps, covered = [], [], 0
    for first, last, item in warc.salvage(data):
        if isinstance(item, str):
            gaps.append((first, last))
        else:
            found.append(int(item.fields["warc-record-id"].split(":")[-1][:-1]))
    return found, gaps


@pytest.mark.parametrize("zipped", [True, False])
def test_damage_in_one_record_costs_that_record_only(zipped):
    plain, members = made()
    parts = members if zipped else plain
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    for broken in (0, 5, 11):
        for how in ("flip", "cut", "zero"):
            data = bytearray(b"".join(parts))
            middle = (starts[broken] + starts[broken + 1]) // 2
            if how == "flip":
                data[middle] ^= 0x55
            elif how == "zero":
                data[starts[broken]:starts[broken] + 4] = b"\0\0\0\0"
            else:
                del data[middle:starts[broken + 1] - 3]
            found, gaps = read(bytes(data))
            assert found == [i for i in range(12) if i != broken]
            assert len(gaps) == 1 and gaps[0][0] == starts[broken]
            assert gaps[0][1] == (len(data) if broken == 11 else starts[broken + 1] - (len(b"".join(parts)) - len(data)))


def test_garbage_around_mixed_records_is_logged_as_gaps():
    plain, members = made(4)
    data = b"junk WARC/ junk" + members[0] + b"\x1f\x8b\x08 no member\n" + plain[1] + plain[2] + b"tail" + members[3] + b"\x1f\x8b"
    found, gaps = read(data)
    assert found == [0, 1, 2, 3] and len(gaps) == 4 and gaps[0] == (0, 15) and gaps[-1][1] == len(data)
    assert read(b"") == ([], []) and read(b"nothing here") == ([], [(0, 12)])


def test_no_bytes_are_lost_under_any_damage():
    chance = random.Random(2)
    _, members = made()
    whole = b"".join(members)
    for _ in range(60):
        data = bytearray(whole)
        for _ in range(chance.randint(1, 6)):
            data[chance.randrange(len(data))] = chance.randrange(256)
        at = 0
        for first, last, _ in warc.salvage(bytes(data)):
            assert first == at and last > first
            at = last
        assert at == len(data)


def test_quarantine_shows_in_the_table(spark, tmp_path):
    _, members = made(6)
    data = bytearray(b"".join(members))
    data[len(members[0]) + 60] ^= 1
    (tmp_path / "a.warc.gz").write_bytes(bytes(data))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    gap = [r for r in rows if r.reason]
    assert len(rows) == 6 and len(gap) == 1 and (gap[0].first, gap[0].last) == (len(members[0]), len(members[0]) + len(members[1]))


def test_a_very_long_url(spark, tmp_path):
    """A header of over a MiB is read, alone and between others; one without an end does not take the next record along."""
    url = "http://x/" + "ü b" * 600_000
    df = spark.createDataFrame([(1, "u", "one"), (2, url, "two"), (3, "u", "three")], "page_id long, url string, html string")
    rows = {r.record_id: r for r in warc.round_trip(df.coalesce(1), str(tmp_path / "long")).collect()}
    assert len(rows) == 3 and not any(r.reason for r in rows.values())
    got = rows["<urn:havenlens:page:2>"]
    assert bytes(got.payload) == b"two" and got.target_uri == url.replace(" ", "%20")
    plain, _ = made(3)
    assert read(plain[0] + b"WARC/1.1\r\nWARC-Target-URI: " + b"x" * 2_000_000 + b"\n" + plain[1])[0] == [0, 1]
