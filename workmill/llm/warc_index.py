"""WARC archives and their capture index, merged externally.

Pages are written as WARC records, equal payloads once: the page with the
smallest id is the response, the others are revisits. Reading the archives back
gives one sorted run of captures per archive file. The runs are cut at range
boundaries of (URL key, timestamp, id), which Spark draws from the data, and
each range merges its slices of all runs by a loser tree: over the ranges the
capture histories are globally ordered. The ids in the boundary key split the
history of a hot URL over several ranges.

Records travel as text with the record separator as line end, so Spark's own
writer commits the archives and a lost task leaves nothing behind.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workmill.session import cut, shared_folder

_END = "\r\n\r\n"
# The base 32 alphabet.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SCHEMA = "url_key string, timestamp string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"


def payload_digest(text: Column) -> Column:
    """Upper-case base 32 of the SHA-1 of the text in UTF-8."""
    digits = F.sha1(text)
    parts = []
    for k in range(8):  # 20 bits each
        value = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.lit(_BASE32).substr(F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def url_key(url: Column) -> Column:
    """Host labels reversed, then what follows; scheme and fragment dropped."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "(?s)^[^:/?#]*://|#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.regexp_replace(rest, "^[^/?]*", ""))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per page, gzip-compressed. A revisit has headers only."""
    text = F.coalesce(F.col("html"), F.lit(""))
    row = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\r\n]", "").alias("url"), text.alias("payload"), payload_digest(text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    several = row.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = row.join(several, ["digest", "bytes"], "left")
    revisit = F.col("page_id") > F.col("first")
    header = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nWARC-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nX-Url-Key: "), url_key(F.col("url")),
        F.lit("\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string")), F.lit(_END),
    ]
    record = F.concat(*header, F.when(revisit, "").otherwise(F.col("payload")))
    known.select(record.alias("value")).write.option("lineSep", _END).option("compression", "gzip").text(path)


class _Stream:
    """Bytes of a gzip file, unpacked as they are asked for."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.held, self.unpack = packed, 0, b"", zlib.decompressobj(31)
        self.offset = 0

    def more(self) -> bool:
        while self.at < len(self.packed):
            part = self.unpack.decompress(self.packed[self.at : self.at + (1 << 18)])
            self.at += 1 << 18
            if part:
                self.held += part
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (end := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                return None
        return self.take(end + len(mark))

    def take(self, size: int) -> bytes:
        while len(self.held) < size and self.more():
            pass
        out, self.held = self.held[:size], self.held[size:]
        self.offset += size
        return out


def read_records(packed: bytes):
    """(offset, headers, payload) of each record of one archive."""
    stream, end = _Stream(packed), _END.encode()
    while True:
        offset = stream.offset
        head = stream.until(end)
        if head is None:
            return
        lines = head.decode().split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in lines if ": " in line)
        payload = stream.take(int(headers["Content-Length"]))
        stream.take(len(end))
        yield offset, headers, payload, stream.offset - offset


def _identity(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def _run(batches):
    """One sorted run of captures per archive file."""
    for batch in batches:
        for name, packed in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = []
            for offset, head, payload, length in read_records(packed.as_py()):
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{name}: payload at {offset} does not match its digest")
                size = len(payload) if kind == "response" else int(head["WARC-Payload-Length"])
                rows.append((head.get("X-Url-Key", ""), head["WARC-Date"], _identity(head["WARC-Record-ID"]), head.get("WARC-Target-URI", ""), kind, _identity(head.get("WARC-Refers-To")), size, digest, name, offset, length))
            rows.sort(key=_order)
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


class LoserTree:
    """Merge sorted lists: each inner node keeps the loser of its match."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.losers = [-1] * max(1, len(runs))
        for leaf in range(len(runs)):
            self._replay(leaf, building=True)

    def _before(self, a: int, b: int) -> bool:
        """Does run a's head come before run b's? Ended runs come last."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        return (self.key(self.runs[a][self.at[a]]), a) < (self.key(self.runs[b][self.at[b]]), b)

    def _replay(self, winner: int, building: bool = False) -> None:
        node = (winner + len(self.runs)) // 2
        while node:
            other = self.losers[node]
            if building and other < 0:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.runs and self.at[winner := self.losers[0]] < len(self.runs[winner]):
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            self._replay(winner)


def _merge(batches):
    """Merge this range's slices of all runs."""
    slices: dict[str, list] = {}
    for batch in batches:
        rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
        for archive, part in groupby(rows, key=lambda r: r[8]):
            slices.setdefault(archive, []).extend(part)
    for part in slices.values():
        part.sort(key=_order)  # blocks of a slice may arrive in any order
    out = []
    for row in LoserTree(list(slices.values()), _order):
        out.append(row)
        if len(out) == 4096:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def capture_index(path: str, spark, archive_filter: str = "*.gz") -> DataFrame:
    """Captures of all archives under `path`, ordered over and within partitions.

    Columns: url_key, timestamp, page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, archive, offset and length (in the unpacked
    archive). A response whose payload does not match its digest is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", archive_filter).load(path).select("path", "content")
    runs = cut(files.mapInArrow(_run, _SCHEMA))
    return runs.repartitionByRange("url_key", "timestamp", "page_id").mapInArrow(_merge, _SCHEMA)


def archive_and_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files, read them back, merge the index.

    Null html: an empty payload. Null url: an empty target. A null page_id is
    never a revisit nor referred to. Repeated rows: equal ids with equal payloads
    are all responses. No rows: no records. Other columns are left out.
    """
    import uuid

    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4()}"
    write_archives(pages, path)
    return capture_index(path, spark)
