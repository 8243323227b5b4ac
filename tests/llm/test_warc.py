import gzip
import hashlib
import os

from pyspark.sql import functions as F

from tests.llm.helpers import clashing, prose, rows_of
from tidewater.llm.warc import archive_pages, lookup, parse_record, url_key, write_archive

BIG = "<p>" + prose(1, 60) + "</p>"


def brute(rows):
    sha = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[sha(h)] = min(i, first.get(sha(h), i))
    out = []
    for i, _, h in rows:
        n = len((h or "").encode())
        f = first.get(sha(h)) if n >= 100 and i is not None else None
        copy = f is not None and f != i
        out.append((i, n, sha(h), "revisit" if copy else "response", f if copy else None))
    return sorted(out, key=repr)


def run(spark, rows, **settings):
    df = archive_pages(clashing(spark, rows, "page_id bigint, url string, html string"), **settings)
    return rows_of(df, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_cases(spark):
    rows = [(5, "http://a.com/x", BIG), (3, "http://b.org/y", BIG), (9, None, BIG), (7, "no scheme", "short"), (8, "http://a.com/x", "short"),
            (10, "", None), (11, "http://sp ace/é\n\r\x00", ""), (12, "http://漢字.com/?q=1", "漢字é" * 500), (13, "http://a.com/x", "x" * 100),
            (14, "http://a.com/x", "x" * 100), (15, "http://a.com/x", "x" * 99), (16, "http://a.com/x", "x" * 99), (3, "http://b.org/y", BIG),
            (17, "http://a.com/\r\n\r\nWARC/1.1", "a\r\n\r\nb" * 40)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_null_ids_are_read_back(spark):
    rows = [(None, "http://a.com/1", "some text"), (2, "http://a.com/1", "other")]
    assert run(spark, rows) == brute(rows)


def test_one_host_with_a_third_of_all_rows(spark):
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i}'}.example.com/{i % 5}", BIG + str(i % 50 if i % 2 else i)) for i in range(600)]
    rows.append((10_000, "http://hot.example.com/0", prose(5, 50_000)))
    assert run(spark, rows) == brute(rows)


def test_files_are_gzipped_warc_records(spark):
    rows = [(i, f"http://h{i}.com/", BIG + str(i // 2)) for i in range(40)]
    archive = write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), block_lines=4)
    payloads, kinds = {}, []
    for name in os.listdir(archive.folder):
        if name.endswith(".warc.gz"):
            data = gzip.decompress(open(f"{archive.folder}/{name}", "rb").read())
            while data:
                head, _, rest = data.partition(b"\r\n\r\n")
                size = int(next(x.split(b": ")[1] for x in head.split(b"\r\n") if x.startswith(b"Content-Length")))
                record, data = data[:len(head) + 4 + size], data[len(head) + 4 + size + 4:]
                headers, payload = parse_record(record)
                kinds.append(headers["warc-type"])
                if headers["warc-type"] == "response":
                    payloads[int(headers["x-capture-id"])] = payload.decode()
                else:
                    assert payload == b"" and headers["warc-profile"].endswith("identical-payload-digest")
    assert payloads == {i: h for i, _, h in rows if i % 2 == 0} and kinds.count("revisit") == 20
    blocks = archive.directory.collect()
    assert sum(b.lines for b in blocks) == 40 and max(b.lines for b in blocks) == 4


def test_lookup_finds_what_is_asked_and_nothing_else(spark):
    rows = [(i, f"http://h{i % 9}.com/{i % 4}", BIG + str(i)) for i in range(200)]
    archive = write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), block_lines=7)
    asked = spark.createDataFrame([(17, "http://h8.com/1"), (18, "http://h8.com/1"), (150, "http://h6.com/2"), (1, "http://zz.com/")],
                                  "_id bigint, url string").select("_id", url_key(F.col("url")).alias("_key"))
    assert rows_of(lookup(archive, asked), "_id") == [(17,), (150,)] or rows_of(lookup(archive, asked), "_id") == [(150,), (17,)]


def test_keys(spark):
    df = spark.createDataFrame([("http://WWW.Example.com:80/A?b c",), (None,), ("x",)], "u string").select(url_key(F.col("u")).alias("k"))
    assert [r.k for r in df.collect()] == ["com:80,example,www)/A?b_c", ")", ")x"]


def test_parts_follow_the_bytes(spark):
    rows = [(i, f"http://h{i % 3}.com/{i % 7}", BIG) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    directory = write_archive(pages, part_bytes=len(BIG) * 10).directory
    parts = directory.select("part").distinct().count()
    assert 25 <= parts <= 41                                       # ten payloads each, whatever the session's partitions
