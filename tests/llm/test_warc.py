import base64
import gzip
import hashlib
import io

import pytest

from docloom.llm import warc
from docloom.llm.common import read


def check(df, rows):
    first = {}
    for page_id, _, page in rows:
        p = (page or "").encode()
        if page_id is not None:
            first[p] = min(page_id, first.get(p, page_id))
    want = []
    for page_id, _, page in rows:
        p = (page or "").encode()
        revisit = p in first and page_id != first[p]
        want.append((str(page_id), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response",
                first[p] if revisit else None))
    got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tables(spark, sf):
    pages = read(spark, sf, "pages")
    check(warc.round_trip(pages), [tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_odd_rows(spark):
    rows = [(k, f"http://h/{k % 3}", "same" if k % 2 else f"page {k} é" * (k + 1)) for k in range(20)]
    rows += [(50, None, None), (51, "a\r\nb: c", ""), (None, None, "lone"), (None, "u", "same"), (60, "u", "WARC/1.1\r\n\r\n" * 5), (60, "u", "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha int")
    check(warc.round_trip(df), rows)
    assert warc.round_trip(df.where("false")).count() == 0


def test_any_cut_reads_every_record_once():
    data = b"".join(warc.member(k, f"http://h/{k}", bytes(str(k), "ascii") * (k * 37 % 900)) for k in range(60))
    data = data[:500] + data[500:]
    for step in (1, 7, 100, 4096, 10**6):
        if step == 1:
            spans = [(a, a + 1) for a in range(0, 3000)] + [(3000, len(data))]
        else:
            spans = [(a, a + step) for a in range(0, len(data), step)]
        got = [r["headers"]["warc-record-id"] for a, b in spans for r in warc.read_range(io.BytesIO(data), len(data), a, min(b, len(data)))]
        assert got == [warc.record_id(k) for k in range(60)]


def test_magic_in_other_data_is_no_record():
    junk = warc.MAGIC * 50 + gzip.compress(b"not a record") + b"\x1f\x8b"
    data = junk + warc.member(1, "u", b"payload") + junk + warc.member(2, None, b"")
    got = list(warc.read_range(io.BytesIO(data), len(data), 0, len(data)))
    assert [r["headers"]["warc-record-id"] for r in got] == [warc.record_id(1), warc.record_id(2)]
    assert got[0]["block"].endswith(b"payload")


def test_gzip_reads_the_archive():
    data = warc.member(1, "u", b"one") + warc.member(2, "v", b"one", 1, True)
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1") == 2 and b"WARC-Refers-To: <urn:docloom:page:1>" in text


def test_a_damaged_member_does_not_go_unseen(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"page {k} " * 50) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    files = warc.write(pages, f"file://{tmp_path}/archives")
    assert sum(n for *_, n in files) == 40
    assert warc.complete(warc.digest(warc.read(spark, files)), files).count() == 40
    path = files[0][0].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="40 records were written and 39 read"):
        warc.complete(warc.digest(warc.read(spark, files)), files)
