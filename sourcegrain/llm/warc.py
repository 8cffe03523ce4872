"""WARC archives and their capture index by external index merge.

Pages are written as WARC records through Spark's own writer, so any store that Spark knows will do. Reading parses each
file by its content lengths and sorts the file's captures: a run. Runs are cut at the same keys, and each key range
merges its pieces of all runs with a loser tree by URL key, timestamp and page: ranges in order give the global order.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcegrain.llm.common import utf8
from sourcegrain.session import checkpoint_dir, stored

LEAST = 100  # bytes from which equal payloads are stored once
PER_FILE = 2000
KEYS = 20_000  # keys at most that the cuts of the ranges are taken from
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_END = "\r\n\r\n"
_CAPTURE = ("run string, urlkey string, stamp string, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
            "payload_digest string, sound boolean")


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A")


def write(pages: DataFrame, path: str | None = None) -> str:
    """Write one record per page and return the folder. Needs page_id (whole number), url and html.

    Null html is an empty payload. Of equal payloads of ``LEAST`` bytes or more the smallest page_id is the response and
    the others revisit it; without any id all are responses. The date of a record is its page_id in seconds from 2020.
    """
    spark = pages.sparkSession
    path = path or f"{checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha2(utf8("html"), 256))
    firsts = rows.where(F.col("n") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    firsts = firsts.where("copies > 1").select("digest", "first")
    joined = rows.join(firsts, "digest", "left").withColumn("again", F.coalesce(F.col("page_id") > F.col("first"), F.col("first").isNotNull()))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10 ** 10))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    common = F.concat(F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Target-URI: "), _clean(F.col("url")), F.lit("\r\nWARC-Date: "), stamp,
                      F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"))
    head = F.concat(F.lit(_HTTP), F.col("n").cast("string"), F.lit(_END))
    response = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response"), common, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
                        (F.octet_length(head) + F.col("n")).cast("string"), F.lit(_END), head, F.col("html"))
    revisit = F.concat(F.lit("WARC/1.1\r\nWARC-Type: revisit"), common, F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
                       F.col("first").cast("string"), F.lit(">\r\nContent-Length: 0\r\n\r\n"))
    joined.select(F.when(F.col("again"), revisit).otherwise(response).alias("value")).write.option("lineSep", _END).option("compression", "gzip").option(
        "maxRecordsPerFile", PER_FILE).text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def url_key(url: str) -> str:
    """Host labels from the top, then path and query; text that is no URL is its own key."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query}" if parts.query else "")


def _inflate(data: bytes) -> Iterator[bytes]:
    """The parts of one or more gzip members."""
    while data:
        box = zlib.decompressobj(31)
        for at in range(0, len(data), 1 << 20):
            part = box.decompress(data[at:at + (1 << 20)])
            if part:
                yield part
            if box.eof:
                data = box.unused_data + data[at + (1 << 20):]
                break
        else:
            return


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip-compressed archive."""
    held = bytearray()
    parts = _inflate(data)

    def more(until: int) -> bool:
        while len(held) < until:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while more(1):
        end = held.find(b"\r\n\r\n")
        while end < 0:
            if not more(len(held) + 1):
                raise ValueError("archive ends inside a header")
            end = held.find(b"\r\n\r\n")
        lines = held[:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(headers["Content-Length"])
        if not more(end + 8 + size):
            raise ValueError("archive ends inside a record")
        yield headers, bytes(held[end + 4:end + 4 + size])
        del held[:end + 8 + size]


def _page(urn: str | None) -> int | None:
    digits = (urn or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def _order(r: dict) -> tuple:
    return r["urlkey"], r["stamp"], -1 if r["page_id"] is None else r["page_id"], r["page_id"] is not None


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the archives; each file's are in key order. ``sound``: the payload has the digest of its header."""
    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for head, block in records(content.as_py()):
                    payload = block[block.find(b"\r\n\r\n") + 4:] if head["WARC-Type"] == "response" else None
                    digest, n = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                    if payload is not None:
                        stated = digest
                        digest, n = hashlib.sha256(payload).hexdigest(), len(payload)
                    rows.append({"run": name, "urlkey": url_key(head["WARC-Target-URI"]), "stamp": head["WARC-Date"], "page_id": _page(head["WARC-Record-ID"]),
                                 "url": head["WARC-Target-URI"], "record_type": head["WARC-Type"], "refers_to": _page(head.get("WARC-Refers-To")),
                                 "payload_bytes": n, "payload_digest": digest, "sound": payload is None or digest == stated})
                rows.sort(key=_order)
                for at in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[at:at + 5000], schema)
    names = [f.split(" ") for f in _CAPTURE.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in names])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, _CAPTURE)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next winner costs one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.size
        for i in range(self.size):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.size) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.head[self.tree[0]] is not None:
            w = self.tree[0]
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            self._play(w)


def merged(captures: DataFrame) -> DataFrame:
    """The captures with (range, place): their place in the history ordered by URL key, timestamp and page.

    Ranges are cut at quantiles of at most ``KEYS`` sampled keys that include the page, so one host or URL may fill many.
    """
    spark = captures.sparkSession
    kept = stored(captures)
    total = kept.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 100_000 + 1)
    key = ["urlkey", "stamp", "page_id"]
    sample = sorted(_order(r.asDict()) for r in kept.select(*key).orderBy(F.xxhash64(*key), *key).limit(KEYS).collect())
    cuts = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    names = kept.columns
    schema = kept.schema

    def split(batches):
        for b in batches:
            rows = b.to_pylist()
            at = [bisect_right(cuts, _order(r)) for r in rows]
            # one message for each range and stretch of a sorted run
            start = 0
            out = []
            for i in range(1, len(rows) + 1):
                if i == len(rows) or at[i] != at[start] or rows[i]["run"] != rows[start]["run"]:
                    out.append((at[start], rows[start]["run"], start, i))
                    start = i
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string()),
                 pa.array([_pack(b.slice(s, e - s)) for _, _, s, e in out], pa.binary())], ["range", "run", "piece"])

    def merge(key_, table):
        pieces = [_unpack(p).to_pylist() for p in table["piece"].to_pylist()]
        def ordered(piece):
            return iter([(_order(r), r) for r in piece])
        rows = [r for _, r in LoserTree([ordered(p) for p in pieces])]
        out = pa.Table.from_pylist(rows, arrow)
        return out.append_column("range", pa.array([key_[0].as_py()] * len(rows), pa.int32())).append_column("place", pa.array(range(len(rows)), pa.int64()))

    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    arrow = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])
    pieces = kept.select(*names).mapInArrow(split, "range int, run string, piece binary")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", range int, place long"
    return pieces.repartition(ranges, "range").groupBy("range").applyInArrow(merge, ddl)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def histories(pages: DataFrame) -> DataFrame:
    """Archive the pages, read the archives back and return their captures in global order (columns of ``read_runs`` with
    ``range`` and ``place``). Repeated rows give repeated captures; an empty table gives none."""
    return merged(read_runs(pages.sparkSession, write(pages)))
