"""WARC archives of pages and their index.

write() makes WARC 1.1 files: a record per page, `response` for the first page (smallest page_id) with a payload, and
`revisit` for later ones with an equal payload, which refer to it and hold no payload. Each record is a gzip member of its own,
so that a capture can be read alone, by its place and size. read() parses the files by their Content-Length.

index() is an external merge. The index lines of the files that a task reads are sorted by URL key and time where they are: a run. Runs
are cut into
blocks of BLOCK_LINES lines, and where one of the ranges of keys that a sample has set ends. A range gets its blocks in the order of
their first lines; each block joins a tree of losers when the merge has come to its first line, and leaves when it is used up.
So a task holds only the blocks that overlap where it stands, and reading the ranges in order gives every URL's capture
history in global order.

Defined results: a null html is an empty payload; null urls are written as an empty target; rows without a page_id, or that
repeat one, each get a record (without one they come last and are never referred to, unless no other has the payload);
an empty table gives no record; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from base64 import b32encode
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.llm.common import by_hash, materialize, scratch, shuffle_partitions, small_batches

#: Bytes of records after which a file ends; the writer and the reader hold one file at a time.
FILE_BYTES = 16 << 20
#: Lines of a run that are sorted together, lines of a block, and about how many lines set the ranges of keys. Lines that a range has
#: at least, so that a run's part of it is a block of some length.
RUN_LINES, BLOCK_LINES, SAMPLE, RANGE_LINES = 100_000, 512, 20_000, 1000
#: The capture time of page 0; page n was captured n seconds (modulo 10**9) later, unless the table has times of its own.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"
_PAD = "\0"


def _sha1(payload: Column) -> Column:
    """The bare base32 SHA-1: five hex digits are four base32 digits."""
    digits = []
    for k in range(8):
        value = F.conv(F.substring(F.sha1(payload), 5 * k + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(_BASE32), F.shiftright(value, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*digits)


def _pages(pages: DataFrame, time: str | None) -> DataFrame:
    moment = F.col(time) if time else F.lit(EPOCH.replace(tzinfo=None)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.pmod(F.coalesce("page_id", F.lit(0)).cast("long"), F.lit(10**9)).cast("decimal(18,6)"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    )


def _name(page: Column, digest: Column) -> Column:
    """A URN from the page and its payload."""
    h = F.md5(F.concat_ws(" ", F.coalesce(page.cast("string"), F.lit("-")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(first_page: Column, first_url: Column, first_date: Column) -> Column:
    """The record but for the blank lines that end it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length("payload").cast("string"), F.lit(_END)).cast("binary")
    again = first_page.isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), _name(F.col("page_id"), F.col("digest"))),
        F.concat(F.lit("WARC-Date: "), "date"), F.concat(F.lit("WARC-Target-URI: "), "url"), F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.concat(F.lit("X-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _name(first_page, F.col("digest")), F.lit("\r\nWARC-Refers-To-Target-URI: "), first_url, F.lit("\r\nWARC-Refers-To-Date: "), first_date, F.lit("\r\nX-Refers-To-Page-Id: "), first_page.cast("string"))),
        F.concat(F.lit("Content-Length: "), F.length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines).cast("binary"), F.lit(_END).cast("binary"), block)


def write(pages: DataFrame, path: str, least: int = 0, time: str | None = None) -> None:
    """Payloads of fewer than `least` bytes are all responses."""
    rows = _pages(pages, time).withColumn("digest", _sha1(F.col("payload")))
    seen = materialize(rows.select("page_id", "url", "date", "digest", F.length("payload").alias("n")), "pages")
    first = seen.filter(F.col("n") >= least).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "date", "url")).alias("first"), F.count("*").alias("k"))
    later = first.filter("k > 1 AND first.page_id IS NOT NULL").select(F.col("digest").alias("same"), "first")
    later = seen.filter(F.col("n") >= least).join(later, F.col("digest") == F.col("same")).filter(~F.col("page_id").eqNullSafe(F.col("first.page_id"))).select(F.col("page_id").alias("again"), F.col("digest").alias("same"), "first").distinct()
    joined = rows.join(later, F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("same")), "left")
    records = joined.select(_record(F.col("first.page_id"), F.col("first.url"), F.col("first.date")).alias("record"))
    small_batches(pages.sparkSession)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, held = [], 0
        for batch in batches:
            for record in batch.column("record"):
                raw = record.as_py() + _END.encode()
                members.append(gzip.compress(raw, 6, mtime=0))
                held += len(raw)
                if held >= FILE_BYTES:
                    yield pa.record_batch([pa.array([b"".join(members)], pa.binary())], ["file"])
                    members, held = [], 0
        if members:
            yield pa.record_batch([pa.array([b"".join(members)], pa.binary())], ["file"])

    # The text writer puts a value's bytes as they are, on any file system that Spark knows, and commits whole tasks. A file is one
    # value, and ends with a zero byte, which readers of gzip pass over.
    out = records.mapInArrow(files, "file binary").select(F.col("file").cast("string").alias("value"))
    out.write.option("lineSep", _PAD).option("maxRecordsPerFile", 1).text(path)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(place, size, content) of each gzip member of a file."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        one, out, fed = zlib.decompressobj(31), [], at
        while not one.eof:
            if fed >= len(data):
                raise ValueError(f"the gzip member at byte {at} is cut")
            part = view[fed : fed + (1 << 14)]
            out.append(one.decompress(part))
            fed += len(part)
        end = fed - len(one.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of each record."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        end = head + 4 + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut")
        yield at, fields, data[head + 4 : end]
        at = end + 4


PARSED = "file string, position long, size long, page_id long, url string, date string, record_type string, digest string, payload_bytes long, refers_to long, payload binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record; position and size are those of its gzip member. payload_bytes and payload of a revisit are null. A
    response's digest is computed and compared."""
    small_batches(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("position", pa.int64()), ("size", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for at, size, f, block in ((at, size, f, block) for at, size, raw in members(content.as_py()) for _, f, block in records(raw)):
                    again, payload = f["warc-type"] == "revisit", None
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if not again:
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if digest != b32encode(hashlib.sha1(payload).digest()).decode():
                            raise ValueError(f"{name}: the payload at byte {at} doesn't have its digest")
                    page = f["x-page-id"]
                    rows.append((name, at, size, None if page == "-" else int(page), f["warc-target-uri"].encode("utf-8", "surrogateescape").decode("utf-8", "replace"), f["warc-date"], f["warc-type"], digest, None if again else len(payload), int(f["x-refers-to-page-id"]) if again else None, payload))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, PARSED)


def url_key(url: str) -> str:
    """The host's labels in reverse order, then the path, lower-cased: pages of one site stand together."""
    m = re.match(r"[a-z]+://(?:[^/@]*@)?([^/:?#]*)(?::\d+)?([^#]*)", url.lower())
    if not m:
        return url.lower()
    host = m[1].removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){m[2] or '/'}"


class Losers:
    """A tree of losers over sorted runs, to which runs can be added: the next item, and a new run, cost one comparison for each level."""

    def __init__(self, runs: Iterable[Iterable] = ()):
        self.k, self.free, self.head, self.runs = 0, [], [], []  # k: runs that are not used up; free: leaves without a run
        self.won, self.lost = [], []  # by node; the leaves' own numbers follow
        for run in runs:
            self.add(run)

    def add(self, run: Iterable) -> None:
        run = iter(run)
        first = next(run, None)
        if first is None:
            return
        if not self.free:
            self._grow()
        leaf = self.free.pop()
        self.runs[leaf], self.head[leaf], self.k = run, first, self.k + 1
        node = (leaf + len(self.head)) // 2
        while node:
            self._match(node)
            node //= 2

    def _grow(self) -> None:
        had = len(self.head)
        size = max(1, 2 * had)
        self.head += [None] * (size - had)
        self.runs += [iter(())] * (size - had)
        self.free += range(size - 1, had - 1, -1)
        self.won, self.lost = [0] * size + [*range(size)], [0] * size
        for node in range(size - 1, 0, -1):
            self._match(node)

    def _less(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        return a is not None and (b is None or (a, i) < (b, j))

    def _match(self, node: int) -> None:
        a, b = self.won[2 * node], self.won[2 * node + 1]
        self.won[node], self.lost[node] = (b, a) if self._less(b, a) else (a, b)

    def first(self):
        """The least item, or nothing."""
        return self.head[self.won[1]] if self.k else None

    def take(self):
        winner = self.won[1]
        item, self.head[winner] = self.head[winner], next(self.runs[winner], None)
        if self.head[winner] is None:
            self.free.append(winner)
            self.k -= 1
        node = (winner + len(self.head)) // 2
        while node:  # at each match the loser stays, the winner goes on
            if self._less(self.lost[node], winner):
                self.lost[node], winner = winner, self.lost[node]
            self.won[node] = winner
            node //= 2
        return item

    def __iter__(self):
        while self.k:
            yield self.take()


LINE = "url_key string, date string, page_id long, file string, position long, url string, record_type string, digest string, size long, payload_bytes long, refers_to long"
INDEX = f"range int, place long, {LINE}"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_LINE = pa.struct([(x.split()[0], _ARROW[x.split()[1]]) for x in LINE.split(", ")])
#: What orders lines; a missing page_id comes last.
_ORDER = ["url_key", "date", "none", "page", "file", "position"]


def _order(line: tuple) -> tuple:
    """line: in the order of LINE."""
    return line[0], line[1], line[2] is None, line[2] or 0, line[3], line[4]


def merged(blocks: Iterator[list[tuple]]) -> Iterator[tuple]:
    """Sorted blocks of (order, line) pairs, in the order of their first pairs, as one sorted sequence."""
    tree = Losers()
    for block in blocks:
        while tree.k and tree.first() < block[0]:
            yield tree.take()
        tree.add(block)
    yield from tree


def index(parsed: DataFrame) -> DataFrame:
    """Index lines with range and place: ordered by both, they are ordered by url_key, date and page_id."""
    spark, names = parsed.sparkSession, [f.name for f in _LINE]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Sorted runs of (order, line) pairs, of all files that a task reads."""
        run = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names[1:]]
            for row in zip(*columns, strict=True):
                line = (url_key(row[names.index("url") - 1]), *row)
                if len(run) >= RUN_LINES:
                    yield sorted(run)
                    run = []
                run.append((_order(line), line))
        if run:
            yield sorted(run)

    total = parsed.count()
    ranges = max(1, min(shuffle_partitions(spark), total // RANGE_LINES))
    few = parsed.filter(by_hash(SAMPLE / max(1, total), "file", "position")).select("url", "date", "page_id", "file", "position")
    keys = sorted(_order((url_key(r["url"]), r["date"], r["page_id"], r["file"], r["position"])) for r in few.collect())  # about SAMPLE rows
    ends = [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in lines(batches):
            at = 0
            while at < len(run):
                own = bisect_right(ends, run[at][0])
                to = min(at + BLOCK_LINES, bisect_left(run, (ends[own],)) if own < len(ends) else len(run))
                block = [dict(zip(names, line, strict=True)) for _, line in run[at:to]]
                first = run[at][0]
                columns = [pa.array([own], pa.int32()), *(pa.array([x], t) for x, t in zip(first, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64()), strict=True)), pa.array([block], pa.list_(_LINE))]
                yield pa.RecordBatch.from_arrays(columns, ["range", *_ORDER, "lines"])
                at = to

    blocks = parsed.select(*names[1:]).mapInArrow(cut, f"range int, url_key string, date string, none boolean, page long, file string, position long, lines array<struct<{LINE.replace(' ', ':').replace(',:', ',')}>>")
    # Keys that share a first byte or a site still spread: a range holds as many lines of the sample as another.
    dealt = blocks.repartition(ranges, "range").sortWithinPartitions("range", *_ORDER).select("range", "lines")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((own, block) for batch in batches for own, block in zip(batch.column("range").to_pylist(), batch.column("lines"), strict=True))
        for own, group in groupby(rows, key=lambda r: r[0]):
            runs = ([(_order(line), line) for line in zip(*(block.values.field(c).to_pylist() for c in names), strict=True)] for _, block in group)
            place, ordered = 0, merged(runs)
            while out := [*islice(ordered, 5000)]:
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(out), pa.int32()), pa.array(range(place, place + len(out)), pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*(line for _, line in out), strict=True), _LINE, strict=True))], ["range", "place", *names])
                place += len(out)

    return dealt.mapInArrow(merge, INDEX)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and the place of each record, all from the merged index."""
    with scratch(spark):
        history = materialize(index(materialize(read(spark, path).drop("payload"), "records")), "history", outlive=True)
    # A revisit's payload is as long as that of the response with its digest.
    sizes = history.filter("record_type = 'response'").groupBy(F.col("digest").alias("d")).agg(F.first("payload_bytes").alias("length"))
    rows = history.join(sizes, F.col("digest") == F.col("d"), "left")
    return rows.select("page_id", F.coalesce("payload_bytes", "length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url_key", F.col("range").alias("index_range"), F.col("place").alias("index_place"))
