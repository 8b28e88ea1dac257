import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from hitwatch.llm import common, warc


def sha1(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def pages(spark):
    rows = [(5, "http://a/x y", "same"), (3, "http://b", "same"), (9, None, "same"), (7, "http://c", "x\r\n\r\ny\nWARC/1.1"), (8, "", None), (2, "http://d", ""), (None, "http://e", "same"), (4, "http://f", "é" * 200_000), (4, "http://f", "same"), (3, "http://b", "same"), (None, "http://g", "HTTP/1.1 200 OK")]
    return spark.createDataFrame([(*r, "extra", 1, "f", 2) for r in rows], "page_id long, url string, html string, payload_digest string, _id int, file string, n int")


@pytest.mark.parametrize("version", [1, 2, None])
def test_round_trip(spark, version):
    folder = common.scratch(spark, "test-warc")
    df = pages(spark)
    got = warc.read(spark, folder, warc.write(df.coalesce(2), folder, version=version, file_bytes=700)).collect()
    first = {}
    for r in df.collect():
        body = (r["html"] or "").encode()
        if r["page_id"] is not None:
            first[body] = min(r["page_id"], first.get(body, r["page_id"]))
    want = []
    for r in df.collect():
        body = (r["html"] or "").encode()
        revisit = r["page_id"] is not None and first[body] < r["page_id"]
        want.append((r["page_id"], len(body), sha1(body), "revisit" if revisit else "response", first[body] if revisit else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    assert {r["date"] for r in got} == {"2024-01-01T00:00:00Z"} and "http://a/x%20y" in {r["target_uri"] for r in got}
    assert len({r["record_id"] for r in got}) == len(got)  # also of rows with one id or none


def test_files_hold_many_records_of_either_version(spark):
    folder = common.scratch(spark, "test-warc")
    df = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://h").alias("url"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("html"), F.lit("20020304050607").alias("d"))
    index = warc.write_arc(df.coalesce(1), folder, date_col="d", file_bytes=2500).collect()
    names = sorted({r["file"] for r in index})
    assert 1 < len(names) < 20 and len(index) == 40
    versions = set()
    for name in names:
        data = gzip.decompress(open(f"{folder.removeprefix('file://')}/{name}", "rb").read())
        versions.add(int(data.split(b"\n")[1].split()[0]))
        assert [at for at, _ in warc.arc_records(io.BytesIO(data))] == [r["offset"] for r in index if r["file"] == name]
    assert versions == {1, 2}


def test_small_payloads_can_be_left_alone(spark):
    folder = common.scratch(spark, "test-warc")
    got = warc.read(spark, folder, warc.write(pages(spark), folder, least=1000))
    assert got.filter("record_type = 'revisit'").count() == 0


def test_empty_table(spark):
    folder = common.scratch(spark, "test-warc")
    assert warc.read(spark, folder, warc.write(pages(spark).limit(0), folder)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_of_several_records(version):
    bodies = [b"one\nhttp://x 0 0 t 3\n", b"", b"\n\n", bytes(range(256))]
    data = warc.arc_version_block(version, "a file.arc", "20240101000000") + b"".join(warc.arc_record(version, f"http://h/{i}", "20020304050607", "text/html", b, offset=i) for i, b in enumerate(bodies))
    got = list(warc.parse_arc(data))
    assert [g["document"] for g in got] == bodies and [g["URL"] for g in got] == [f"http://h/{i}" for i in range(4)]
    assert set(got[0]) == {*warc.ARC_FIELDS[version], "document"}


def test_damaged_arc():
    good = warc.arc_version_block(1, "f", "20240101000000") + warc.arc_record(1, "http://h", "20240101000000", "t/h", b"body")
    for bad in (good[:-8], good.replace(b" 4\nbody", b" 999\nbody"), good.replace(b" 4\nbody", b" x\nbody"), good[good.index(b"http://h") :], good.replace(b"t/h 4", b"t/h more 4")):
        with pytest.raises(ValueError, match="ARC"):
            list(warc.parse_arc(bad))


def test_dates():
    assert warc.iso_date("20020304050607") == "2002-03-04T05:06:07Z"
    assert warc.iso_date("2002") == "2002-01-01T00:00:00Z" and warc.iso_date("-") == "1970-01-01T00:00:00Z"


def test_records_of_other_kinds():
    record = next(warc.parse_arc(warc.arc_version_block(1, "f", "2024") + warc.arc_record(1, "dns:h", "2024", "text/dns", b"body")))
    [(head, block)] = warc.warc_records(io.BytesIO(warc.warc_record(record, "f@0")))
    assert (head["WARC-Type"], head["Content-Type"], block) == ("resource", "text/dns", b"body")
    [(head, block)] = warc.warc_records(io.BytesIO(warc.warcinfo("f.warc.gz", "f.arc.gz", "2024")))
    assert head["WARC-Type"] == "warcinfo" and b"conformsTo" in block


def test_broken_digest_is_noticed(spark, tmp_path):
    record = next(warc.parse_arc(warc.arc_version_block(1, "f", "2024") + warc.arc_record(1, "http://h", "2024", "t/h", warc.http_message(b"body", "t/h"))))
    raw = warc.warc_record(record, "f@0", 1)
    (tmp_path / "warc").mkdir()
    (tmp_path / "warc" / f"a{warc.SUFFIX}").write_bytes(gzip.compress(raw.replace(b"\r\n\r\nbody", b"\r\n\r\nbOdy")))
    files = spark.createDataFrame([(f"a{warc.SUFFIX}",)], "file string")
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, f"file://{tmp_path}", files).collect()


def test_lengths_that_messages_declare():
    assert [warc.declared_length(h) for h in (b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\nX: 1", b"HTTP/1.0 200 OK", b"content-length:7", b"Content-Length: many", b"")] == [12, None, 7, None, None]
