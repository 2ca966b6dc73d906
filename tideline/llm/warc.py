"""WARC archives: writing with payload deduplication, and reading verified by the chain of record boundaries.

A reader that trusts the magic "WARC/1." finds records inside payloads too. Here every occurrence is only a candidate: it
emits its own offset and that of its successor, computed from its header. Pointer jumping from the start of the
file, log2(n) rounds of array lookups, marks what the chain reaches; the rest is payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.shared import shared_folder, table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r\n|$)", re.I)
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest):
    """Upper-case base32 of a hex digest of 40 digits, as an expression."""
    out = []
    for g in range(8):
        v = F.conv(F.substring(hex_digest, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write_archives(pages: DataFrame, path: str, least: int = 0, per_file: int = 2000, date: str = "2020-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each row into gzip archives of at most `per_file` records under `path`.

    Of rows with equal payloads of at least `least` bytes, those with the smallest id are response records, the others revisit
    records that refer to it; smaller payloads are all responses. A null payload is empty. A null id is largest; where no id is given
    all such rows are responses. A null url leaves out its field; line breaks in urls are percent-encoded. An empty table writes no record.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A")
    digest = F.sha1(html.cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"), digest.alias("digest"), F.octet_length(html).alias("size"))
    # hashes of the payloads only: no text is shuffled for this side
    first = pages.select(F.col(id_col).cast("long").alias("page_id"), digest.alias("digest"), F.octet_length(html).alias("size")).where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "digest", "left")
    again = F.coalesce((F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("size"))
    field = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))), field("WARC-Record-ID", name("page_id")), field("WARC-Date", F.lit(date)),
        F.coalesce(field("WARC-Target-URI", F.col("url")), F.lit("")), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(again, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", name("first")))).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")), field("Content-Length", block.cast("string")), F.lit("\r\n"), http, F.when(again, F.lit("")).otherwise(F.col("html")), F.lit("\r\n\r"),
    )  # the writer's line separator is the record's last byte
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, list]:
    """Offsets of all magics, the offset after each one's record (-1: its header isn't one), and (header, block start, block end)."""
    off, after, parts = [], [], []
    for m in MAGIC.finditer(data):
        stop = data.find(END, m.end())
        length = LENGTH.search(data, m.end() - 2, stop) if stop >= 0 else None
        to = stop + 4 + int(length[1]) if length else -1
        ok = length is not None and data[to : to + 4] == END
        off.append(m.start())
        after.append(to + 4 if ok else -1)
        parts.append((m.end(), stop, to))
    return np.array(off, dtype=np.int64), np.array(after, dtype=np.int64), parts


def reachable(off: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the sorted candidate offsets the chain from offset 0 reaches, by pointer jumping."""
    n = len(off)
    reach = np.zeros(n + 1, dtype=bool)
    if not n or off[0] != 0:
        return reach[:n]
    to = np.minimum(np.searchsorted(off, after), n - 1)
    jump = np.append(np.where((after >= 0) & (off[to] == after), to, n), n)  # n: the end, or a broken chain
    reach[0] = True
    for _ in range(max(1, int(n).bit_length())):
        reach[jump[np.flatnonzero(reach)]] = True
        jump = jump[jump]
    return reach[:n] & (after >= 0)


def _fields(header: bytes) -> dict[str, str]:
    out = {}
    for line in header.split(b"\r\n"):
        k, sep, v = line.partition(b":")
        if sep:
            out.setdefault(k.strip().lower().decode("latin-1"), v.strip().decode("utf-8", "replace"))
    return out


def _unpacked(data: bytes) -> bytes:
    """A gzip file of any number of members, or plain bytes."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
    return b"".join(out)


def _page(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under `path` that the boundary chain reaches.

    -> file, offset, page_id, record_type, target_uri, payload_bytes, payload_digest (computed from the payload where the record has it, otherwise
    taken from the fields), refers_to, intact (the digest is the one declared), and the payload if asked for. A task holds one archive at a
    time; a file whose chain breaks gives the records before the break. An empty folder gives an empty result.
    """
    shape = "file string, offset long, page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, intact boolean" + ", payload binary" * payload
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()] + [pa.binary()] * payload
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0), b.column(1)):
                data = _unpacked(content.as_py())
                off, after, parts = candidates(data)
                rows = []
                for k in np.flatnonzero(reachable(off, after)).tolist():
                    head, stop, to = parts[k]
                    f = _fields(data[head:stop])
                    a, http = stop + 4, {}
                    if f.get("content-type", "").startswith("application/http"):
                        x = data.find(END, a, to)
                        if x >= 0:
                            http, a = _fields(data[a:x]), x + 4
                    told = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if f.get("warc-type") == "revisit":
                        body, size, digest = None, int(http["content-length"]) if http.get("content-length", "").isdigit() else None, told
                    else:
                        body = data[a:to]
                        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    rows.append((file.as_py(), int(off[k]), _page(f.get("warc-record-id")), f.get("warc-type"), f.get("warc-target-uri"), size, digest, _page(f.get("warc-refers-to")), told in (None, digest), body)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, shape)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes `pages` to archives in the shared folder and reads their records back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    return read_archives(spark, path, payload=False)


def op5_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, written and read back; equal payloads of any size are revisits."""
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")




ORACLE_OP5 = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
f as (select *, min(page_id) over (partition by html) as first from p)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from f
"""
