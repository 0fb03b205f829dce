import gzip
import hashlib
import io
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terraspan.llm import warc
from terraspan.llm.common import shared_path

LONG = "x" * 200


def page_rows():
    return [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, "http://b", "short"), (4, "http://b", "short"), (5, None, None), (6, "u\r\nWARC-Type: evil", "é" * 70),
            (7, "http://c", "é" * 70), (8, "", ""), (9, "http://d", "big " * 200_000), (10, "http://e", "a\r\n\r\nb" * 40), (0, "http://late", LONG), (11, "http://dup", "y" * 150), (11, "http://dup", "y" * 150)]


def truth():
    first = {}
    for p, _, h in page_rows():
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h in page_rows():
        b = (h or "").encode()
        origin = first.get(b, p)
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "response" if origin == p else "revisit", None if origin == p else origin))
    return Counter(out)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, 5) for r in page_rows()], "page_id long, url string, html string, digest int").repartition(3)
    assert Counter(map(tuple, warc.round_trip(pages).collect())) == truth()
    packages = warc.write(pages, shared_path(spark, "t"))
    texts = {r["page_id"]: r["payload"] for r in warc.read(packages).filter("record_type = 'response'").collect()}
    assert all(bytes(texts[p]) == (h or "").encode() for p, _, h in page_rows() if p in texts)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_shuffled_join_answers_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    assert Counter(map(tuple, warc.round_trip(pages).collect())) == truth()


def test_null_ids_and_names_that_clash(spark, monkeypatch):
    data = [(None, "u", LONG, 1), (4, "u", LONG, 2), (None, "v", "z" * 120, 3), (None, "v", "z" * 120, 4), (5, None, "z", 5)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, first int").withColumns({"n": F.lit(1), "of": F.lit("x"), "payload": F.lit("y")})
    want = Counter({(None, 200, "revisit", 4): 1, (4, 200, "response", None): 1, (None, 120, "response", None): 2, (5, 1, "response", None): 1})
    for bound in (500_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
        assert Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()) == want


def test_names_of_stores(tmp_path):
    names = {"s3a://b/k": "s3://b/k", "s3://b/k": "s3://b/k", "hdfs://n:9000/x": "hdfs://n:9000/x", "file:/a/b": "file:///a/b", "file:///a/b": "file:///a/b", "/a/b": "file:///a/b", "gs://b": "gs://b"}
    assert {k: warc.store_uri(k) for k in names} == names
    (tmp_path / "p.zip").write_bytes(warc.pack([]))
    for uri in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        with warc.open_package(f"{uri}/p.zip") as package:
            assert list(warc.records(package)) == []
    assert package.file.closed


def test_zip64_structures_are_read(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = warc.pack([(i, gzip.compress(warc.record(i, "u", b"p" * 90, hashlib.sha256(b"p" * 90).hexdigest(), None))) for i in range(20)])
    assert warc.END64 in data and warc.LOCATOR64 in data
    # force the 32-bit fields full, so that only the wide ones tell
    end = data.rfind(warc.END)
    full = data[: end + 10] + b"\xff" * 10 + data[end + 20 :]
    package = warc.Package(io.BytesIO(full), len(full))
    assert [r.page_id for r in warc.records(package)] == list(range(20))


def test_comments_and_broken_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(warc.DATA, b"abcdef")
        z.comment = b"a comment with PK\x05\x06 inside"
    data = out.getvalue()
    package = warc.Package(io.BytesIO(data), len(data))
    assert package.read(warc.DATA, 2, 3) == b"cde"
    for bad in (b"", b"PK", data[:-5], data[:40]):
        with pytest.raises(warc.ArchiveError):
            warc.Package(io.BytesIO(bad), len(bad))
    with pytest.raises(warc.ArchiveError):
        package.read(warc.DATA, 4, 9)
    with pytest.raises(warc.ArchiveError):
        package.read("none")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.DATA, b"abcdef" * 50)
    with pytest.raises(warc.ArchiveError):
        warc.Package(io.BytesIO(out.getvalue()), len(out.getvalue())).start(warc.DATA)
