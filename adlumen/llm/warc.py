"""Web archives: pages to records, records to captures, captures to a global index.

Every task writes its pages as an archive, one gzip member per record. A payload that an earlier page has becomes a
revisit record that refers to it. The archives are then read back, each by one task, which yields its captures sorted
by URL key and time: a run. For the global index the key space is cut into ranges, and each range merges its share of
all runs with a loser tree.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from adlumen.llm.common import map_rows, slices, utf8, written
from adlumen.session import shared_dir

LEAST_BYTES = 100  # smaller payloads are never revisits
ROLL_BYTES = 512 * 1024 * 1024
LEVEL = 3
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = (
    "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, "
    "url_key string, captured string, archive string, offset long, length long")


def url_key(url: str | None) -> str:
    """Host reversed and comma-joined, then path and query; lower case, without scheme, port 80/443, www and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{place}){(parts.path or '/').lower()}" + (f"?{parts.query.lower()}" if parts.query else "")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


# --- records ------------------------------------------------------------------------------------


def _field(value: str) -> bytes:
    """Header value: line breaks and other controls, which would end the line, are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\x7f%" else c for c in value).encode("utf-8", "surrogatepass")


def _unfield(value: bytes) -> str:
    parts = value.split(b"%")
    raw = parts[0] + b"".join(bytes([int(p[:2], 16)]) + p[2:] for p in parts[1:])
    return raw.decode("utf-8", "surrogatepass")


def record(kind: str, page: str | None, refers_to: str | None, url: str | None, captured: str, digest: str, payload: bytes) -> bytes:
    """One uncompressed record. A revisit has the HTTP header but no payload."""
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n")
    block = http + payload if kind == "response" else http
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{url}')}>"), ("WARC-Date", captured),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block)))]
    fields += [(name, value) for name, value in (("WARC-Target-URI", url), ("X-Page-ID", page)) if value is not None]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", refers_to)]
    head = b"".join(name.encode() + b": " + _field(value) + b"\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """``CAPTURE`` values of a record up to ``captured``; the digest of a response is checked against its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.decode(): _unfield(v) for k, _, v in (line.partition(b": ") for line in lines[1:])}
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of page {fields.get('X-Page-ID')}")
    url = fields.get("WARC-Target-URI")
    return (
        fields.get("X-Page-ID"), size, digest, fields["WARC-Type"], fields.get("X-Refers-To-Page-ID"), url, url_key(url), fields["WARC-Date"])


# --- writing ------------------------------------------------------------------------------------


def _decided(pages: DataFrame) -> DataFrame:
    """Pages with digest and the first page of equal payloads. A frequent payload is one aggregate and a join that can be split."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.length(payload).alias("bytes"))
    firsts = written(rows.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-firsts")
    return rows.join(firsts, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("first").cast("string").alias("first"),
        F.coalesce(
            F.col("page_id").try_cast("long"),
            F.when(F.col("page_id").isNotNull(), F.pmod(F.xxhash64("page_id"), F.lit(1 << 31))), F.lit(0).cast("long")).alias("second"))


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archives and return (``archive``, ``records``, ``bytes``), one row per file.

    A file gets its name from the attempt that writes it; the files of attempts that failed are in no row.
    """
    columns = ["page_id", "url", "html", "digest", "first", "second"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, name, records, size, done = None, "", 0, 0, []
        for batch in slices(batches):
            for page, url, html, digest, first, second in zip(*[batch.column(c).to_pylist() for c in columns]):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                kind = "response" if first is None or page == first else "revisit"
                captured = (EPOCH + timedelta(seconds=second % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                data = gzip.compress(record(kind, page, first, url, captured, digest, utf8(html)), LEVEL, mtime=0)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    rows = _decided(pages).select(*columns).mapInArrow(run, "archive string, records long, bytes long")
    return written(rows, "warc-archives")


# --- reading ------------------------------------------------------------------------------------


def members(stream, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of every gzip member; one member is in memory at a time."""
    offset, buffer = 0, b""
    while True:
        machine, taken, parts = zlib.decompressobj(31), 0, []
        while not machine.eof:
            if not buffer:
                buffer = stream.read(block)
                if not buffer:
                    if taken:
                        raise ValueError("archive ends inside a record")
                    return
            parts.append(machine.decompress(buffer))
            taken += len(buffer) - len(machine.unused_data)
            buffer = machine.unused_data
        yield offset, taken, b"".join(parts)
        offset += taken


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Captures of all records, sorted by (``url_key``, ``captured``) within each archive."""

    def make() -> Callable[..., Iterator[tuple]]:
        store, base = _store(folder)

        def run(archive: str) -> Iterator[tuple]:
            with store.open_input_stream(f"{base}/{archive}", compression=None) as stream:
                captures = [(*parsed(data), archive, offset, length) for offset, length, data in members(stream)]
            yield from sorted(captures, key=_order)

        return run

    spread = archives.repartition(max(1, archives.count()), "archive")
    return map_rows(spread, CAPTURE, make, ["archive"]).select(*[c.split()[0] for c in CAPTURE.split(", ")])


def _order(capture: tuple) -> tuple:
    return capture[6], capture[7], capture[0] or "", capture[8], capture[9]


class LoserTree:
    """Merges sorted runs: each inner node holds the loser of its match, a path to the root replays them."""

    def __init__(self, runs: list[list[tuple]], key: Callable[[tuple], tuple] = _order):
        self.runs = [iter(run) for run in runs]
        self.key, self.k = key, len(runs)
        self.heads: list[tuple | None] = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(self.k):
            self._advance(i)
        self.tree = [-1] * max(1, self.k)
        winners = {self.k + i: i for i in range(self.k)}
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winners.get(1, 0)

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None
        return (self.keys[a], a) < (self.keys[b], b)

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[winner := self.tree[0]] is not None:
            yield self.heads[winner]
            self._advance(winner)
            node = (winner + self.k) // 2
            while node:
                if self._before(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


def merged_index(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """Captures in global order of (``url_key``, ``captured``, ``page_id``): the k-way merge of the runs of all archives.

    The ranges are cut on the whole order, so a URL with a large part of all captures is spread over several.
    """
    columns, schema = captures.columns, captures.schema
    n = partitions or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = captures.repartitionByRange(n, "url_key", "captured", "page_id", "archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[list[tuple]]] = {}
        arrow = None
        for batch in batches:
            arrow = batch.schema
            for row in zip(*[batch.column(c).to_pylist() for c in columns]):
                of = runs.setdefault(row[8], [[]])
                if of[-1] and _order(row) < _order(of[-1][-1]):
                    of.append([])  # a part of the run that came from another task
                of[-1].append(row)
        held: list[tuple] = []
        for row in LoserTree([run for of in runs.values() for run in of]) if runs else ():
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), arrow)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), arrow)], schema=arrow)

    return ranges.mapInArrow(run, schema)


def archived(pages: DataFrame, folder: str | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``) to archives, read them back, return the global index.

    A null html is an empty payload, a null url the empty key; rows with the id of a payload's first page are all
    responses; other columns are not read; an empty table writes no archive and gives no rows. Ids keep their type and
    order (strings as strings); the capture time is the id as a number, else comes from its hash. A page without id
    revisits the first page with its payload that has one; if none has, all are responses.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/archives/{uuid.uuid4().hex}"
    captures = written(read_archives(write_archives(pages, folder, roll_bytes), folder), "warc-runs")
    kind = pages.schema["page_id"].dataType
    index = merged_index(captures)
    return index.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def read_record(folder: str, archive: str, offset: int, length: int) -> bytes:
    """The bytes of one record, by its place in the index."""
    store, base = _store(folder)
    with store.open_input_file(f"{base}/{archive}") as file:
        return gzip.GzipFile(fileobj=io.BytesIO(file.read_at(length, offset))).read()
