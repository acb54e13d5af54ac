import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from quillstage.llm import warc
from quillstage.llm.common import local_path, shared_dir, written
from tests.conftest import SF, same_rows


def archive(spark, pages):
    folder = shared_dir(spark)
    index = written(warc.write_archives(pages, f"{folder}-whole"))
    done = written(warc.normalise(warc.decide(index), f"{folder}-whole", f"{folder}-members"))
    return done, f"{folder}-members"


def test_query_equals_oracle(spark, duck):
    same_rows(warc.QUERIES["op4_warc"](spark, SF), duck, warc.SQL["op4_warc"])


def test_round_trip(spark):
    rows = [
        (1, "http://a/é?x=1 2", "<p>é</p>"), (2, None, None), (3, "http://b", "<p>é</p>"), (4, "http://c", ""), (5, "u", "x" * 200_000),
        (6, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (3, "http://b", "<p>é</p>")
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit("own"))
    done, folder = archive(spark, pages.coalesce(1))
    out = warc.read_archives(done, folder, with_payload=True).collect()
    assert len(out) == 7
    by = {}
    for r in out:
        by.setdefault(int(r.page), []).append(r)
    assert [r.record_type for r in by[3]] == ["response", "response"] and by[1][0].record_type == "revisit" and by[1][0].refers_to == "3"
    assert by[2][0].record_type == "revisit" and by[2][0].refers_to == "4"
    for page, _, html in rows:
        raw = (html or "").encode()
        for r in by[page]:
            assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r.payload_bytes == len(raw)
            assert r.payload == (raw if r.record_type == "response" else b"")


def test_header_lines_are_copied(spark):
    urls = ["http://e.x/a%2Fb?q=1%262", "http://e.x/a%2Fb?q=1%262", "http://e.x/é b\r\nWARC-Type: no", None]
    pages = spark.createDataFrame([(i, u, "<p>same</p>" if i < 2 else f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    done, folder = archive(spark, pages.coalesce(1))
    out = {int(r.page): r for r in warc.read_archives(done, folder).collect()}
    assert (out[0].record_type, out[0].refers_to, out[0].url) == ("revisit", "1", urls[0]) and (out[1].record_type, out[1].url) == ("response", urls[1])
    assert out[2].url == "http://e.x/%C3%A9%20b%0D%0AWARC-Type:%20no" and out[3].url is None
    head, fields, block = next(warc.records(iter([b"WARC/1.0\r\nwarc-type:  response\r\nX-Odd:  A%2fb \r\nContent-Length: 8\r\n\r\nA\r\n\r\nxyz\r\n\r\n"])))
    assert warc.revisit(head, block, "<urn:page:1:a:0>").startswith(b"WARC/1.0\r\nWARC-Type: revisit\r\nX-Odd:  A%2fb \r\nContent-Length: 5\r\n")


def test_record_ids_differ(spark):
    done, folder = archive(
        spark,
        spark.createDataFrame([(i % 2 or None, "u", f"<p>{i % 3}</p>") for i in range(30)], "page_id long, url string, html string").repartition(3)
    )
    ids, referred = [], set()
    for r in done.collect():
        raw = gzip.decompress(open(f"{local_path(folder)}/{r.archive}", "rb").read())
        for _, fields, _ in warc.records(iter([raw])):
            ids.append(fields["warc-record-id"])
            referred |= {fields["warc-refers-to"]} if "warc-refers-to" in fields else set()
    assert len(set(ids)) == len(ids) == 30 and referred and referred <= set(ids)


def test_members_and_sidecar(spark):
    done, folder = archive(spark, spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(50)], "page_id long, url string, html string").coalesce(2))
    for r in done.collect():
        raw = open(f"{local_path(folder)}/{r.archive}", "rb").read()
        entries = [line.split("\t") for line in open(f"{local_path(folder)}/{r.archive}.idx")]
        assert sum(int(e[1]) for e in entries) == len(raw) == r.bytes and len(entries) == r.records
        for offset, length, kind, _ in entries:
            member = gzip.decompress(raw[int(offset) : int(offset) + int(length)])
            assert member.startswith(b"WARC/1.1\r\n") and f"WARC-Type: {kind}".encode() in member and member.count(b"WARC/1.1") == 1


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "http://a", "<p>x</p>"), (2, "http://a", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string")
    clashes = [
        "archive", "at", "page", "payload_bytes", "payload_digest", "refers_to", "refers_at", "other", "place", "p", "u", "h", "__n",
        "__first", "records", "bytes"
    ]
    done, folder = archive(spark, rows.withColumns({c: F.lit(f"own {c}") for c in clashes}))
    out = {r.page: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(done, folder).collect()}
    assert out == {"1": ("revisit", "2", 8), "2": ("response", None, 8), None: ("response", None, 0)}


def test_empty(spark):
    done, folder = archive(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(done, folder).count() == 0
