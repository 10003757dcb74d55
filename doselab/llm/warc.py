"""WARC archives and their capture index, merged externally.

Pages are written as gzip-compressed WARC records, a member each, into archives in the shared folder; records whose
payload another record of the same digest keeps are revisits. Each archive is read back record by record, its
payloads are verified, and its captures form a run: a file in the shared folder, sorted by URL key and timestamp. While
there are more than ``FAN_IN`` runs, groups of them are merged into longer ones. Then the keys are cut into ranges, and
each range's task opens all runs where the range begins and merges them with a loser tree, which gives capture histories
in one global order. A merge holds one row group (``GROUP`` rows) of every run, whatever the runs' length. Archives and
runs count only if the task that wrote them was committed, so lost executors and repeated tasks do no harm.

Defined results: null html is an empty payload, very long html a record of its own; a null url has an empty key; rows
without page_id are responses; rows that share a page_id are each written and decided by their own payload, and of equal
payloads all records of the largest page_id are responses; an empty table gives an empty index; extra columns are ignored.
Pages bring no time of capture: it is page_id seconds after 2024-01-01T00:00:00Z.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doselab.llm.common import bounded_batches, materialise, scratch, small, split_join

#: Payloads under this are never revisits; an archive is closed after so many bytes.
MIN_REVISIT, ARCHIVE_BYTES = 1000, 64 << 20
#: Runs that one merge opens; rows in a run's row group; captures in a range of the last merge; keys of a run that ranges are cut from.
FAN_IN, GROUP, PER_RANGE, MARKS = 64, 500, 200_000, 64
EPOCH = dt.datetime(2024, 1, 1)
INDEX = "urlkey string, timestamp string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long, length long, run string"
_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def file_system(uri: str):
    """The Arrow file system of a folder's URI, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def url_key(url: str | None) -> str:
    """Sort-friendly form: host parts reversed, no scheme, www, port or fragment; query parameters sorted."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return (url or "").lower()
    host = host.removeprefix("www.")
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    path = parts.path.rstrip("/") or "/"
    return (",".join(reversed(host.split("."))) + ")" + path + (f"?{query}" if query else "")).lower() if host else (url or "").lower()


def _when(page_id: int | None) -> dt.datetime:
    try:
        return EPOCH + dt.timedelta(seconds=page_id or 0)
    except OverflowError:
        return dt.datetime.max.replace(microsecond=0) if page_id > 0 else dt.datetime.min


def _record(page_id: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """One gzip member. A revisit keeps the HTTP header and leaves the payload out."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {_when(page_id).isoformat()}Z", f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers)}"]
    block = http + (payload if refers is None else b"")
    data = ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_archive(stream) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, block) of each record of an open archive, holding one record at a time."""
    at, rest, ended = 0, b"", False
    while True:
        member, out, used = zlib.decompressobj(31), [], 0
        while not member.eof:
            if not rest:
                rest = stream.read(1 << 18)
                if not rest:
                    ended = True
                    break
            out.append(member.decompress(rest))
            used += len(rest) - len(member.unused_data)
            rest = member.unused_data
        if ended:
            if used:
                raise ValueError(f"record at {at} is cut off")
            return
        head, _, body = b"".join(out).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        if body[size:] != b"\r\n\r\n":
            raise ValueError(f"record at {at} has no end")
        yield at, used, fields, body[:size]
        at += used


def write_archives(pages: DataFrame) -> DataFrame:
    """archive: the paths written. pages: page_id, url, html, refers_to (null: response)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = scratch(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        fs.create_dir(top)
        out, size, done = None, 0, []
        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    done.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{top}/{done[-1]}", compression=None), 0
                data = _record(page_id, url, (html or "").encode(), refers)
                out.write(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in done], pa.string())], names=["archive"])

    return materialise(pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, "archive string"), "archives")


def _page(name: str) -> int | None:
    return int(n) if (n := name[len("<urn:x-page:") : -1]) else None


def _order(row: tuple) -> str:
    """The row's place: URL key, timestamp, page (none first), archive and offset, as text that sorts alike."""
    page = "0" if row[2] is None else f"1{row[2] + (1 << 63):020d}"
    return f"{row[0]}\0{row[1]}\0{page}\0{row[7]}\0{row[8]:020d}"


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
_RUN_SCHEMA = pa.schema([("place", pa.string()), *zip(_NAMES, _TYPES, strict=True)])
RUNS = "run string, rows long, marks array<string>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def write_run(folder: str, rows: Iterator[tuple]) -> tuple[str, int, list[str]]:
    """A run of sorted rows in a file of row groups: its path, its rows, and MARKS of its places at even distances."""
    path, n, marks, step, group = f"{folder}/{uuid.uuid4().hex}.parquet", 0, [], 1, []
    fs, at = file_system(path)
    with fs.open_output_stream(at, compression=None) as stream, pq.ParquetWriter(stream, _RUN_SCHEMA) as out:

        def flush() -> None:
            if group:
                places = [_order(r) for r in group]
                cols = [pa.array(places, pa.string()), *(pa.array(c, t) for c, t in zip(zip(*group, strict=True), _TYPES, strict=True))]
                out.write_table(pa.Table.from_arrays(cols, schema=_RUN_SCHEMA))
                group.clear()

        for row in rows:
            if n % step == 0:
                marks.append(_order(row))
                if len(marks) == 2 * MARKS:
                    marks, step = marks[::2], 2 * step
            group.append(row)
            n += 1
            if len(group) == GROUP:
                flush()
        flush()
    return path, n, marks


def read_run(path: str, low: str | None = None, high: str | None = None) -> Iterator[tuple]:
    """The rows of a run with low <= place < high, one row group at a time; groups outside are skipped by their statistics."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as stream:
        run = pq.ParquetFile(stream)
        for k in range(run.num_row_groups):
            known = run.metadata.row_group(k).column(0).statistics
            if known is not None and known.has_min_max:
                if low is not None and known.max < low:
                    continue
                if high is not None and known.min >= high:
                    return
            for place, *row in zip(*(c.to_pylist() for c in run.read_row_group(k).columns), strict=True):
                if (low is None or place >= low) and (high is None or place < high):
                    yield tuple(row)


def index_archives(archives: DataFrame) -> DataFrame:
    """Reads the archives back; each gives a run. RUNS: the runs, their rows and some of their places."""
    folder = scratch(archives.sparkSession, "runs")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        fs.create_dir(top)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                fs, path = file_system(archive)
                rows = []  # one archive's captures: ARCHIVE_BYTES bounds them
                with fs.open_input_stream(path, compression=None) as stream:
                    for offset, length, fields, block in read_archive(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kind = fields["WARC-Type"]
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{archive}, {offset}: the payload does not match its digest")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        page_id = _page(fields["WARC-Record-ID"])
                        refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((url_key(fields["WARC-Target-URI"]), re.sub(r"\D", "", fields["WARC-Date"]), page_id, kind, digest, size, refers, archive, offset, length, archive))
                rows.sort(key=_order)
                yield _run_rows([write_run(folder, iter(rows))])

    n = max(1, archives.count())
    return materialise(archives.repartition(n, "archive").mapInArrow(index, RUNS), "runs")


def _run_rows(found: list[tuple]) -> pa.RecordBatch:
    cols = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["run", "rows", "marks"])


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next row costs one climb."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources, self.k = sources, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.keys = [None if h is None else _order(h) for h in self.heads]
        self.losers = [0] * max(1, self.k)
        winner = list(range(self.k))
        # Play from the leaves up: nodes k-1..1 have children 2i and 2i+1, leaves are k..2k-1.
        best = [0] * self.k + winner
        for i in range(self.k - 1, 0, -1):
            a, b = best[2 * i], best[2 * i + 1]
            best[i], self.losers[i] = (a, b) if self._first(a, b) else (b, a)
        self.winner = best[1] if self.k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None
        return self.keys[a] <= self.keys[b]

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = head = next(self.sources[w], None)
            self.keys[w] = None if head is None else _order(head)
            i = (w + self.k) // 2
            while i:
                if self._first(self.losers[i], w):
                    self.losers[i], w = w, self.losers[i]
                i //= 2
            self.winner = w


def join_runs(runs: DataFrame) -> DataFrame:
    """Groups of up to FAN_IN runs merged into one longer run each."""
    spark = runs.sparkSession
    folder = scratch(spark, "runs")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        fs.create_dir(top)
        for batch in batches:
            for paths in batch.column("paths").to_pylist():
                yield _run_rows([write_run(folder, iter(LoserTree([read_run(p) for p in paths])))])

    groups = -(-runs.count() // FAN_IN)
    # Ranks deal the runs into groups of even size; the window's rows are one a run.
    dealt = runs.select("run", ((F.row_number().over(W.orderBy("run")) - 1) % groups).alias("_g"))
    grouped = dealt.groupBy("_g").agg(F.sort_array(F.collect_list("run")).alias("paths"))
    return materialise(grouped.repartition(groups, "_g").select("paths").mapInArrow(merge, RUNS), "runs")


def merge_runs(runs: DataFrame) -> DataFrame:
    """The captures in global order of URL key and timestamp: ranges in partition order, each merged from its slices of all runs."""
    spark = runs.sparkSession
    while runs.count() > FAN_IN:
        runs = join_runs(runs)
    # At most FAN_IN runs with 2 * MARKS places each.
    known = [(r[0], r[1], r[2]) for r in runs.collect()]
    paths, rows = sorted(r[0] for r in known if r[1]), sum(r[1] for r in known)
    marks = sorted(m for r in known for m in r[2])
    n = max(1, min(len(marks), max(spark.sparkContext.defaultParallelism, -(-rows // PER_RANGE))))
    cuts = [None, *(marks[len(marks) * k // n] for k in range(1, n)), None]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                low, high, out = cuts[k], cuts[k + 1], []
                if low is not None and low == high:
                    continue
                for row in LoserTree([read_run(p, low, high) for p in paths]):
                    out.append(row)
                    if len(out) == 5000:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    return spark.range(0, n, 1, n).mapInArrow(merge, INDEX)


def _digests(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.withColumn("digest", F.sha1(payload)).withColumn("size", F.octet_length(payload))


def decide_revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest and refers_to of the pages whose payload a larger page_id keeps."""
    seen = _digests(pages.where("page_id is not null")).select("page_id", "digest", "size").where(F.col("size") >= MIN_REVISIT)
    seen = materialise(seen, "digests")
    keep = seen.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least")).where("_least < refers_to").drop("_least")
    keep = materialise(keep, "kept")
    found = seen.join(F.broadcast(keep), ["digest", "size"]) if small(keep) else split_join(seen, keep, ["digest", "size"])
    return materialise(found.where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write, read back, index and merge. pages: page_id, url, html."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    revisits = decide_revisits(pages)
    # By page and payload: rows that share a page_id may differ, and rows without one spread by their payload.
    decided = _digests(pages).join(F.broadcast(revisits) if small(revisits) else revisits, ["page_id", "digest"], "left")
    return merge_runs(index_archives(write_archives(decided)))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p
), u AS (
  SELECT *, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '#.*$', '') AS rest FROM m
), h AS (
  SELECT *, regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*'), ':[0-9]*$', ''), '^www\.', '') AS host, regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path, regexp_extract(rest, '\?(.*)$', 1) AS query FROM u
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to,
       lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
         || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END) AS urlkey,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y%m%d%H%M%S') AS "timestamp"
FROM h
"""
