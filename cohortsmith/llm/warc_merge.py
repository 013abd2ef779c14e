"""WARC archives of pages, and the merge of their capture runs into one ordered index.

Writing. A page whose payload (the UTF-8 html) equals that of another page is a revisit of the page
with the smallest page_id among them; the others are responses. Equality is decided on the narrow
table of payload digests. Records go to the shared folder through Spark's text writer with the
record terminator as line separator, so an archive is a gzip file of plain WARC/1.1 records and
a lost task is written again like any other.

Reading. The archives are read back as files and parsed record by record by their lengths; payload
digests are computed anew and must equal those of the headers.

Index. Each archive yields one run of captures, sorted by URL key, timestamp and page. The runs are
cut at common splitters into segments, a segment is one row, and every key range merges its
segments by a loser tree: one comparison a level and capture, no sort across runs. Splitters come
from evenly spaced keys of the runs, so a range holds a bounded number of captures, and one URL that
holds a third of all captures is cut by timestamp and page. Ranges and places within them number
the captures of the whole index.

Defined cases: a null html is the empty payload; payloads shorter than ``least_bytes`` are never
revisits; rows that repeat a page_id and payload are records of their own, all of them responses if
they are the smallest; a null url has the empty key and no target header; a null page_id counts as
larger than any other; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, shared_dir, stored

CRLF = "\r\n"
#: Records of an archive at most, and captures for each key range of the index.
ARCHIVE, RANGE = 5_000, 20_000
#: Evenly spaced keys taken from a run for the choice of splitters, keys and splitters at most.
SPACED, SAMPLED, SPLITTERS = 64, 50_000, 4096
#: A page without capture time is dated by its number from here.
EPOCH = "2024-01-01 00:00:00"
LAST = 2**63 - 1

_CAPTURE = "urlkey string, timestamp string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, place long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """A sortable key: the host's labels reversed, then path and query, lower-cased, no fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        name = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return f"{','.join(reversed(name.split('.')))}{port}){(parts.path or '/').lower()}{'?' + query if query else ''}"


def described(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_sha1, first): ``first`` is the smallest page_id of
    an equal payload of at least ``least_bytes`` bytes."""
    payload = F.coalesce("html", F.lit(""))
    own = need(pages, "page_id", "url", "html").select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(LAST)).alias("page_id"), "url", payload.alias("html"))
    own = own.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_sha1": F.sha1(F.col("html").cast("binary"))})
    # only payloads that stand more than once need a join; the rest of the table is left alone by it
    firsts = own.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_sha1", "payload_bytes").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return own.join(firsts, ["payload_sha1", "payload_bytes"], "left")


def _headers(fields: list) -> F.Column:
    """Header lines; a null value leaves its line out."""
    lines = [F.concat(F.lit(f"{k}: "), v) if k else v for k, v in fields]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def _safe_url(c: F.Column) -> F.Column:
    return F.when(F.length(c) > 0, F.regexp_replace(c, r"[\r\n]", " "))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Gzip archives of at most ``ARCHIVE`` WARC records."""
    rows = described(pages, least_bytes)
    revisit = F.col("first").isNotNull() & (F.col("first") < F.col("page_id"))
    digest = F.concat(F.lit("sha1-hex:"), F.col("payload_sha1"))
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.pmod("page_id", F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = _headers([("", F.lit("HTTP/1.1 200 OK")), ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("payload_bytes").cast("string"))])
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    header = _headers([
        ("", F.lit("WARC/1.1")), ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        ("WARC-Target-URI", _safe_url(F.col("url"))), ("WARC-Date", date), ("WARC-Payload-Digest", digest),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length("block").cast("string"))])
    out = rows.select("*", block.alias("block")).select(F.concat(header, "block").alias("value"))
    out.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE).text(folder)


_LENGTH = re.compile(rb"(?im)^content-length:\s*(\d+)\s*$")


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-cased name, block) of the records of an archive, in order."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("the archive ends within a record")
        yield fields, block


def _captures(raw: bytes, archive: str) -> Iterator[tuple]:
    """The archive's captures, as rows of the index."""
    with gzip.open(io.BytesIO(raw)) as stream:
        for place, (fields, block) in enumerate(records(stream)):
            number = lambda name: int(fields[name].removeprefix("<urn:page:").rstrip(">")) if name in fields else None
            head, _, payload = block.partition(b"\r\n\r\n")
            want = fields["warc-payload-digest"].removeprefix("sha1-hex:")
            n = int(_LENGTH.search(head + b"\n").group(1))
            if fields["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != want or len(payload) != n):
                raise ValueError(f"{archive}, record {place}: the payload isn't what its digest says")
            url = fields.get("warc-target-uri")
            yield (url_key(url), fields["warc-date"], number("warc-record-id"), url, fields["warc-type"], number("warc-refers-to"),
                   n, base64.b32encode(bytes.fromhex(want)).decode(), archive, place)


class LoserTree:
    """The k-way merge of sorted runs: inner nodes hold the losers of their matches, so the next
    least entry costs one comparison for each level. Equal keys come in the order of the runs."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        k = len(runs)
        self.heads = [self._next(i) for i in range(k)]
        self.tree = [-1] * max(k, 1)
        for i in range(k):
            self._play(i)

    def _next(self, i: int):
        entry = next(self.runs[i], None)
        return (1, (), i) if entry is None else (0, entry[:3], i, entry)

    def _play(self, i: int) -> None:
        node = (i + len(self.heads)) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # the first to come waits for its match
                self.tree[node] = i
                return
            if self.heads[other][:3] < self.heads[i][:3]:
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        if not self.heads:
            return
        while not (head := self.heads[i := self.tree[0]])[0]:
            yield head[3]
            self.heads[i] = self._next(i)
            self._play(i)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, captures): each archive's captures as one sorted run."""
    fields = [f.split()[0] for f in _CAPTURE.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                archive = path.rpartition("/")[2]
                run = sorted(_captures(bytes(raw), archive), key=lambda c: (c[:3], c[9]))
                yield pd.DataFrame({"archive": [archive], "captures": [[dict(zip(fields, c)) for c in run]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    return files.mapInPandas(each, f"archive string, captures array<struct<{_CAPTURE.replace(' ', ':').replace(',:', ',')}>>")


def splitters(runs: DataFrame) -> list[tuple]:
    """Keys (urlkey, timestamp, page_id) that cut the index into ranges of about ``RANGE`` captures."""
    n, archives = runs.agg(F.sum(F.size("captures")), F.count("*")).first()
    want = min(SPLITTERS, (n or 0) // RANGE)
    if not want:
        return []
    # a bounded sample of keys: from every run, or beyond SAMPLED keys from fewer keys and runs
    spaced, one_in = max(1, min(SPACED, SAMPLED // archives)), -(-archives // SAMPLED)
    size = F.size("captures")
    take = F.least(size, F.lit(spaced))
    keys = runs.where((size > 0) & (F.pmod(F.xxhash64("archive"), F.lit(one_in)) == 0)).select(F.explode(F.transform(
        F.sequence(F.lit(0), take - 1), lambda i: F.get("captures", F.floor(i * size / take).cast("int")))).alias("c"))
    sample = sorted(map(tuple, keys.select("c.urlkey", "c.timestamp", "c.page_id").collect()))
    step = max(1, len(sample) // (want + 1))
    return sorted(set(sample[step - 1::step]))[:want]


def merge_runs(runs: DataFrame) -> DataFrame:
    """The captures of all runs, with key_range and place_in_range: the order of the whole index."""
    cuts = splitters(runs)
    fields = [f.split()[0] for f in _CAPTURE.split(", ")]
    struct = f"array<struct<{_CAPTURE.replace(' ', ':').replace(',:', ',')}>>"

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_left

        for b in batches:
            for archive, run in zip(b["archive"], b["captures"]):
                run = [dict(c) for c in run]
                keys = [(c["urlkey"], c["timestamp"], c["page_id"]) for c in run]
                bounds = [0, *(bisect_left(keys, c) for c in cuts), len(run)]
                rows = [(r, archive, run[a:z]) for r, (a, z) in enumerate(zip(bounds, bounds[1:])) if z > a]
                yield pd.DataFrame(rows, columns=["key_range", "archive", "captures"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("archive")
        merged = LoserTree([[tuple(c[f] for f in fields) for c in run] for run in frame["captures"]])
        out = pd.DataFrame(list(merged), columns=fields)
        out["key_range"], out["place_in_range"] = int(frame["key_range"].iloc[0]), range(len(out))
        out["refers_to"] = out["refers_to"].astype("Int64")
        return out

    cut = runs.mapInPandas(segments, f"key_range int, archive string, captures {struct}")
    return cut.groupBy("key_range").applyInPandas(merge, f"{_CAPTURE}, key_range int, place_in_range long")


def capture_index(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives of ``pages``, read them back, and merge their runs into the index."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc"
    write_archives(pages, folder, least_bytes)
    return merge_runs(stored(read_runs(pages.sparkSession, folder), "runs"))


def page_records(index: DataFrame) -> DataFrame:
    """One row for each page of the index, the contract's columns first."""
    missing = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return index.select(missing("page_id"), "payload_bytes", "payload_digest", "record_type", missing("refers_to"),
                        "urlkey", "timestamp", "archive", "key_range", "place_in_range")
