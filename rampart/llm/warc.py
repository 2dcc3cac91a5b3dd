"""WARC archives: writing, reading back, and an external merge of capture indexes.

Each task writes one archive of gzip members, one record a page. Reading an archive back gives
its captures as a locally sorted run (URL key, time). Regular samples of the runs cut the key
space into ranges of bounded size; a range's slices of all runs are merged by a loser tree, so
ranges in order hold the globally ordered capture histories.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.llm.shared_files import Publish, new_folder, open_file
from rampart.session import materialize

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
CAPTURES = ("run long, seq long, url_key string, captured string, url string, page_id long, payload_bytes long, payload_digest string, "
            "record_type string, refers_to long, uri string, offset long, length long")
_TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
_NAMES = [c.split()[0] for c in CAPTURES.split(", ")]
_SCHEMA = pa.schema([(n, _TYPES[k]) for n, k in (c.split() for c in CAPTURES.split(", "))])
RANGE_ROWS = 50_000


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, lower case, no scheme, "www." or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")"
    return (key + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def _safe(value: str) -> str:
    """A header value without line breaks or blanks (percent-encoded)."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id, url, date: str, payload: bytes, digest: str, refers_to, serial: str) -> bytes:
    """One record: a response with its HTTP head and payload, or a revisit without payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{serial}>", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(f, chunk: int = 1 << 18) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of each gzip member; one member is held."""
    raw, offset = f.read(chunk), 0
    while raw:
        d, out, used = zlib.decompressobj(31), [], 0
        while True:
            out.append(d.decompress(raw))
            if d.eof:
                used += len(raw) - len(d.unused_data)
                raw = d.unused_data or f.read(chunk)
                break
            used += len(raw)
            raw = f.read(chunk)
            if not raw:
                raise ValueError("archive ends inside a record")
        yield offset, used, b"".join(out)
        offset += used


def parse_record(content: bytes) -> tuple[dict[str, str], bytes, int]:
    """(WARC headers in lower case, HTTP payload, payload length the HTTP head states)."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    return fields, payload, stated


def captures_of(uri: str, run: int) -> list[tuple]:
    """Every record of an archive, verified, sorted by (URL key, time, page): a run."""
    rows = []
    with open_file(uri) as f:
        for offset, length, content in members(f):
            h, payload, stated = parse_record(content)
            digest = h["warc-payload-digest"].removeprefix("sha256:")
            if h["warc-type"] == "response" and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"{uri} at {offset}: payload does not match its digest")
            page = int(h["x-page-id"]) if "x-page-id" in h else None
            refers = int(h["warc-refers-to"].removeprefix("<urn:x-page:").removesuffix(">")) if "warc-refers-to" in h else None
            url = h.get("warc-target-uri")
            rows.append((url_key(url), h["warc-date"], url, page, stated, digest, h["warc-type"], refers, uri, offset, length))
    rows.sort(key=_order)
    return [(run, i, *r) for i, r in enumerate(rows)]


def _order(row: tuple) -> tuple:
    """URL key, time, page (null first), then place, so no two captures compare equal."""
    return row[0], row[1], -1 if row[3] is None else row[3], row[8], row[9]


class LoserTree:
    """Merges k sorted iterables. Inner nodes hold the loser of the match played there, so each
    output replays one path of about log2(k) matches."""

    def __init__(self, runs: list[Iterable], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(runs))
        self.head = [self._next(i) for i in range(len(runs))]
        self.loser = [-1] * self.k
        for i in range(len(runs)):
            self._replay(i)

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), item)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        if a is None or b is None:
            return b is None and a is not None
        return (a[0], i) < (b[0], j)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.loser[node]
            if other == -1:  # first arrival waits here while the tree is being built
                self.loser[node] = i
                return
            if self._before(other, i):
                self.loser[node], i = i, other
            node //= 2
        self.loser[0] = i

    def __iter__(self):
        while self.runs and self.head[w := self.loser[0]] is not None:
            yield self.head[w][1]
            self.head[w] = self._next(w)
            self._replay(w)


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 100, captured: Column | None = None) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html); returns the written manifest
    (part, uri, records). Payloads of at least ``min_revisit`` bytes that equal one of a
    smaller page_id become revisits of the smallest."""
    # by default pages carry times that follow their ids
    when = captured if captured is not None else F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce("page_id", F.lit(0)) % 100_000_000)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"), F.unix_timestamp(when).alias("at"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = p.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"))
    # a digest held by many pages is a skewed join key: adaptive execution splits the page side
    rows = p.join(first, "digest", "left").withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")))

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        to = Publish(folder, f"part-{part:06d}.warc.gz")
        with to as out:
            for b in batches:
                for r in b.select(["page_id", "url", "payload", "at", "digest", "refers_to"]).to_pylist():
                    date = datetime.datetime.fromtimestamp(r["at"] or 0, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
                    serial = f"{part}-{n}" if r["page_id"] is None else str(r["page_id"])
                    c = zlib.compressobj(4, zlib.DEFLATED, 31)
                    out.write(c.compress(record_bytes(r["page_id"], r["url"], date, r["payload"], r["digest"], r["refers_to"], serial)) + c.flush())
                    n += 1
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [to.uri], "records": [n]})

    return materialize(rows.mapInArrow(run, "part long, uri string, records long"), "warc-manifest")


def read_runs(manifest: DataFrame) -> DataFrame:
    """The captures of all archives, one sorted run each (a task an archive)."""
    files = manifest.where("records > 0").orderBy("part").collect()  # a row per archive
    uris = [f.uri for f in files]

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                rows = captures_of(uris[i], i)
                for k in range(0, len(rows), 10_000):
                    yield _batch(rows[k:k + 10_000])

    return manifest.sparkSession.range(0, len(uris), 1, max(1, len(uris))).mapInArrow(run, CAPTURES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCHEMA.types)], schema=_SCHEMA)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Globally ordered histories: the captures with ``key_range`` and ``place`` in it; ranges
    in order, and places within them, follow (URL key, time, page)."""
    runs = materialize(runs, "warc-runs")
    total = runs.count()
    ranges = max(1, -(-total // range_rows))
    cuts = sorted(_order(tuple(s)) for s in _cut_rows(runs, total, ranges).collect()) if ranges > 1 else []

    def assign(batches):
        for b in batches:
            rows = [tuple(r[n] for n in _NAMES) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bisect_right(cuts, _order(r[2:])) for r in rows], pa.int64())], names=[*_NAMES, "key_range"])

    def merge(t: pa.Table) -> pa.Table:
        run, seq = np.asarray(t.column("run")), np.asarray(t.column("seq"))
        t = t.take(pa.array(np.lexsort((seq, run))))
        rows = list(zip(*(t.column(n).to_pylist() for n in _NAMES)))
        edge = np.flatnonzero(np.diff(np.sort(run))) + 1
        slices = [rows[a:b] for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(rows)])]
        merged = list(LoserTree(slices, lambda r: _order(r[2:])))
        out = pa.Table.from_batches([_batch(merged)])
        return out.append_column("key_range", t.column("key_range")).append_column("place", pa.array(range(len(merged)), pa.int64()))

    dealt = runs.mapInArrow(assign, CAPTURES + ", key_range long")
    return dealt.groupBy("key_range").applyInArrow(merge, CAPTURES + ", key_range long, place long")


def _cut_rows(runs: DataFrame, total: int, ranges: int) -> DataFrame:
    """About one row a range, evenly spaced in the order of the keys: of a sample by hash (about 64
    rows a range, from runs of any size) that Spark sorts."""
    cols = _NAMES[2:]
    some = runs.where(F.pmod(F.xxhash64("run", "seq"), F.lit(max(1, total // (64 * ranges)))) == 0).select(*cols)
    ordered = materialize(some.orderBy(*cols).select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "warc-sample")
    sizes = {r["p"]: r["count"] for r in ordered.groupBy("p").count().collect()}
    before = {p: sum(n for q, n in sizes.items() if q < p) for p in sizes}
    if not sizes:
        return ordered.select(*cols)
    offset = F.element_at(F.create_map(*[F.lit(int(x)) for kv in before.items() for x in kv]), F.col("p"))
    step = max(1, sum(sizes.values()) // ranges)
    return ordered.where(F.pmod(offset + F.col("i"), F.lit(step)) == step - 1).select(*cols)


def capture_histories(pages: DataFrame, min_revisit: int = 100, captured: Column | None = None) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and merge their runs.

    One row per input row. A null html is an empty payload; a null url has no target and the
    empty key; payloads under ``min_revisit`` bytes are always responses. Rows that share the
    smallest page_id of equal payloads are all responses. A row with a null page_id can only
    revisit; equal payloads that all lack one are all responses. Other columns are ignored; an
    empty table gives no rows.
    """
    folder = new_folder(pages.sparkSession, "warc")
    return merge_runs(read_runs(write_archives(pages, folder, min_revisit, captured)))


def op7_warc_histories(spark, sf_dir: str) -> DataFrame:
    """Thin query: the whole pages table written, read back and merged."""
    got = capture_histories(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "key_range", "place")
