"""WARC archives with a two-level capture index.

``write_archive`` sorts captures by reversed-host URL key (range partitioning, so one host may fill
many parts), writes each part as a ``.warc.gz`` (one gzip member a record) and as index lines in
compressed blocks of ``block_lines``, and keeps a sparse directory: one row a block.  ``lookup``
binary-searches the directory, range-reads one block, binary-searches its lines and range-reads the
record.  Equal payloads of at least ``min_dedup_bytes`` are written once; the others are ``revisit``
records that point at the capture with the smallest id.

Files go to the shared folder; a task writes under a name of its own and only the directory rows of
tasks that Spark committed are ever read, so a repeated or lost task leaves no trace in the archive.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import ascii_lower, new_folder, written

BLOCK_LINES = 256
#: Payload bytes of a part, about; small tables have as many parts as the session has shuffle partitions.
PART_BYTES = 512 * 1024 * 1024
MIN_DEDUP_BYTES = 100
#: Captures carry no time of their own; archives need one.
CAPTURED = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for a null id in keys, where ids are sorted.
NO_ID = -(2 ** 63)

_DIRECTORY = ("part string, warc string, first_key string, first_id bigint, last_key string, last_id bigint, "
              "offset bigint, length bigint, lines int")


@dataclass(frozen=True)
class Archive:
    """A written archive: its folder and its block directory (a small DataFrame, one row a block)."""

    folder: str
    directory: DataFrame


def url_key(url):
    """Reversed-host key of a URL column: ``com,example,www)/path?query``; null or no ``://``: what
    there is behind ``)``.  White space and controls are written as ``_`` (a key is one word)."""
    raw = F.coalesce(url, F.lit(""))
    has = F.instr(raw, "://") > 0
    after = F.when(has, F.regexp_replace(raw, r"(?s)\A.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"\A([^/?#]*)", 1)
    rest = F.when(has, F.regexp_replace(after, r"\A[^/?#]*", "")).otherwise(raw)
    key = F.concat(F.array_join(F.reverse(F.split(ascii_lower(host), "[.]")), ","), F.lit(")"), rest)
    return F.regexp_replace(key, r"[\x00-\x20\x7f]", "_")


def _filesystem(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def _clean(text: str) -> str:
    return "".join(c if " " < c and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'capture:{page_id}')}>"


def _record(page_id: int, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    kind = "response" if refers is None else "revisit"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    body = http + payload if refers is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {CAPTURED}",
            f"WARC-Target-URI: {_clean(url or 'about:blank')}", f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Capture-Id: {page_id}"]
    if refers is not None:
        head += [f"WARC-Refers-To: {_record_id(refers)}", f"WARC-Profile: {REVISIT_PROFILE}",
                 f"X-Refers-To-Capture-Id: {refers}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and payload of one decompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[:int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(5, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _write_part(folder: str, block_lines: int):
    def run(batches):
        fs, root = _filesystem(folder)
        name = uuid.uuid4().hex
        warc = index = None
        at = index_at = 0
        block: list[tuple[str, int, str]] = []
        rows = []
        mark: tuple = ()

        def close_block():
            nonlocal index_at
            data = _gzip("".join(f"{k} {i} {j}\n" for k, i, j in block).encode("utf-8", "surrogatepass"))
            index.write(data)
            rows.append([f"{name}.cdx.gz", f"{name}.warc.gz", *block[0][:2], *block[-1][:2], index_at, len(data), len(block)])
            index_at += len(data)
            block.clear()

        for b in batches:
            for key, sid, url, html, digest, first in zip(b._key, b._id.tolist(), b._url, b._html, b._digest, b._first):
                if html is None:                     # a mark: the next captures under this key are copies
                    mark = (key, sid, digest, int(first))
                    continue
                if warc is None:
                    fs.create_dir(root, recursive=True)
                    warc = fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None)
                    index = fs.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
                refers = mark[3] if mark[:3] == (key, sid, digest) else None
                member = _gzip(_record(sid, url, html.encode("utf-8"), digest, refers))
                warc.write(member)
                block.append((key, sid, json.dumps({"offset": at, "length": len(member)})))
                at += len(member)
                if len(block) >= block_lines:
                    close_block()
        if block:
            close_block()
        for f in (warc, index):
            if f is not None:
                f.close()
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _DIRECTORY.split(", ")])

    return run


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_dedup_bytes: int = MIN_DEDUP_BYTES, block_lines: int = BLOCK_LINES, part_bytes: int = PART_BYTES) -> Archive:
    """Write one record per row of ``pages`` (null html: an empty payload; null url: key ``)``; null
    ids sort first; repeated rows: a record each, all ``response`` if they hold the smallest id).

    Payloads cross the network once, for the sort.  Copies are found on ids and digests alone; a copy's
    mark sorts in right before its capture (same key, id and digest) and tells the writer what it
    refers to."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.col(url_col).cast("string")
    rows = pages.select(url_key(url).alias("_key"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id"),
                        url.alias("_url"), html.alias("_html"), F.sha2(html.cast("binary"), 256).alias("_digest"))
    thin = rows.where(F.octet_length("_html") >= min_dedup_bytes).select("_key", "_id", "_digest")
    firsts = thin.groupBy("_digest").agg(F.min(F.when(F.col("_id") != NO_ID, F.col("_id"))).alias("_first"),
                                         F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _first IS NOT NULL").drop("_n")
    marks = thin.join(firsts, "_digest").where("_id <> _first").distinct().select(
        "_key", "_id", F.lit(None).cast("string").alias("_url"), F.lit(None).cast("string").alias("_html"), "_digest", "_first")
    captures = rows.withColumn("_first", F.lit(None).cast("bigint")).unionByName(marks)
    # parts of a bounded size: one task writes one, and readers seek in one, however large the table
    total = rows.agg(F.sum(F.octet_length("_html").cast("bigint"))).first()[0] or 0
    count = -(-total // part_bytes)
    more = (count,) if count > int(spark.conf.get("spark.sql.shuffle.partitions")) else ()
    parts = captures.repartitionByRange(*more, "_key", "_id").sortWithinPartitions(
        "_key", "_id", "_digest", F.col("_html").isNotNull())
    return Archive(folder, written(parts.mapInPandas(_write_part(folder, block_lines), _DIRECTORY), "warc-directory"))


class _Part:
    """One part opened for reading: its directory rows, the block read last, and a window of the archive."""

    WINDOW = 1 << 20

    def __init__(self, fs, root: str, blocks: list[tuple]):
        self.blocks = sorted(blocks)                       # (first_key, first_id, last_key, last_id, offset, length)
        self.firsts = [b[:2] for b in self.blocks]
        self.index = fs.open_input_file(f"{root}/{blocks[0][6]}")
        self.warc = fs.open_input_file(f"{root}/{blocks[0][7]}")
        self.at, self.lines = -1, []
        self.start, self.window = 0, b""

    def block(self, i: int) -> list[tuple[str, int, dict]]:
        if i != self.at:
            _, _, _, _, offset, length = self.blocks[i][:6]
            self.index.seek(offset)
            text = zlib.decompress(self.index.read(length), 31).decode("utf-8", "surrogatepass")
            self.lines = [(k, int(s), j) for k, s, j in (x.split(" ", 2) for x in text.split("\n")[:-1])]
            self.at = i
        return self.lines

    def find(self, key: str, sid: int):
        """Every capture under (key, sid): directory first, then its block's lines."""
        i = max(0, bisect.bisect_left(self.firsts, (key, sid)) - 1)
        while i < len(self.blocks) and self.firsts[i] <= (key, sid):
            lines = self.block(i)
            j = bisect.bisect_left(lines, (key, sid))
            while j < len(lines) and lines[j][:2] == (key, sid):
                at = json.loads(lines[j][2])
                yield self.record(at["offset"], at["length"])
                j += 1
            i += 1

    def record(self, offset: int, length: int) -> bytes:
        lo = offset - self.start
        if lo < 0 or lo + length > len(self.window):
            self.warc.seek(offset)
            self.window, self.start, lo = self.warc.read(max(length, self.WINDOW)), offset, 0
        return zlib.decompress(self.window[lo:lo + length], 31)

    def close(self):
        self.index.close()
        self.warc.close()


def lookup(archive: Archive, keys: DataFrame) -> DataFrame:
    """Read the captures under the distinct ``(_key, _id)`` pairs of ``keys``:
    ``_id, record_type, _refers, header_digest, n_bytes, digest, payload`` with the last three of what
    was read (null for a revisit, which holds no payload).

    The driver sees one row a part (its first key), never a row a block or a capture; each task loads
    the directory of the part it reads."""
    parts = archive.directory.groupBy("part").agg(F.min(F.struct("first_key", "first_id")).alias("lo"),
                                                 F.max(F.struct("last_key", "last_id")).alias("hi")).collect()
    parts.sort(key=lambda p: (tuple(p.lo), tuple(p.hi)))
    lows = [tuple(p.lo) for p in parts]
    highs = [tuple(p.hi) for p in parts]
    names = [p.part for p in parts]

    @F.pandas_udf("array<string>")
    def part_of(key: pd.Series, sid: pd.Series) -> pd.Series:
        out = []
        for k in zip(key, sid):
            i = bisect.bisect_left(highs, k)
            hits = []
            while i < len(lows) and lows[i] <= k:
                hits.append(names[i])
                i += 1
            out.append(hits)
        return pd.Series(out, dtype=object)

    count = max(1, len(names))                 # reading costs by the part, whatever the size of the keys
    wanted = keys.select("_key", "_id").distinct().select("_key", "_id", F.explode(part_of("_key", "_id")).alias("part")) \
        .repartition(count, "part")
    blocks = archive.directory.groupBy("part").agg(F.collect_list(F.struct(
        "first_key", "first_id", "last_key", "last_id", "offset", "length", "part", "warc")).alias("_blocks")).repartition(count, "part")
    folder = archive.folder

    def read(key, left, right):
        fs, root = _filesystem(folder)
        part = _Part(fs, root, [tuple(b[c] for c in ("first_key", "first_id", "last_key", "last_id", "offset", "length",
                                                     "part", "warc")) for b in right["_blocks"].iloc[0]])
        rows = []
        for k, sid in sorted(zip(left["_key"], left["_id"].tolist())):
            for raw in part.find(k, sid):
                head, payload = parse_record(raw)
                own = head["warc-type"] == "response"
                refers = head.get("x-refers-to-capture-id")
                rows.append([int(head["x-capture-id"]), head["warc-type"], None if refers is None else int(refers),
                             head["warc-payload-digest"].partition(":")[2], len(payload) if own else None,
                             hashlib.sha256(payload).hexdigest() if own else None])
        part.close()
        out = pd.DataFrame(rows, columns=["_id", "record_type", "_refers", "header_digest", "n_bytes", "digest"])
        return out.astype({"_refers": "Int64", "n_bytes": "Int64"})

    return wanted.groupBy("part").cogroup(blocks.groupBy("part")).applyInPandas(
        read, "_id bigint, record_type string, _refers bigint, header_digest string, n_bytes bigint, digest string")


def archive_pages(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` to an archive and read every capture back through the index:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``.  Size and digest are of the
    payload as read; a revisit takes them from the response it refers to."""
    archive = write_archive(pages, **columns)
    id_col, url_col = columns.get("id_col", "page_id"), columns.get("url_col", "url")
    keys = pages.select(url_key(F.col(url_col).cast("string")).alias("_key"),
                        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id"))
    read = written(lookup(archive, keys), "warc-read")
    originals = read.where("record_type = 'response'").select(
        F.col("_id").alias("_refers"), F.col("digest").alias("header_digest"), F.col("n_bytes").alias("_n")).distinct()
    revisits = read.where("record_type = 'revisit'").join(originals, ["_refers", "header_digest"], "left") \
        .select("_id", "record_type", "_refers", F.col("_n").alias("n_bytes"), F.col("header_digest").alias("digest"))
    return read.where("record_type = 'response'").select("_id", "record_type", "_refers", "n_bytes", "digest") \
        .unionByName(revisits).select(
            F.when(F.col("_id") != NO_ID, F.col("_id")).alias("page_id"), F.col("n_bytes").alias("payload_bytes"),
            F.col("digest").alias("payload_digest"), "record_type", F.col("_refers").alias("refers_to"))
