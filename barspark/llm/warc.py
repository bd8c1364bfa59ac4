"""WARC archives: writing with revisit records, reading back, and the external merge of capture indexes.

Writing: one record per page, as text with the line separator CR LF CR LF, which is how WARC records end, so
Spark's own text writer (and its committer) writes the archives to any store it knows. Each archive starts with a
``warcinfo`` record. Pages are written by size class, so that an archive's records are bounded in number and in bytes:
it is read as one row. Compression is that writer's, one gzip member a file, so an offset counts in the uncompressed
archive. Payload equal to another page's (by SHA-1) is written once, as the ``response`` of the smallest page id; the
others are ``revisit`` records without a payload that name it, its address and its date. Reading parses each archive by
its Content-Length fields, one record at a time, and takes digest and length of responses from the bytes it finds.

Index: each archive gives a run of captures, sorted by (url key, time) within its task. The key space is cut into
ranges (url key, time, archive, offset), so that a url with most captures is cut as well; the bounds come from a sample
of bounded size, which moves the cuts and nothing else. A run's rows of one range travel in chunks, which reach their
task in the order of their first keys (Spark sorts them, on disk where needed); a loser tree merges the open chunks, and
a chunk is opened only when the merge gets to its first key. So a task holds about one chunk of each run, however long
the runs are. The ranges, one after the other, are the globally ordered capture history.

Defined results: a null html is an empty payload; payloads of fewer than ``min_revisit_bytes`` bytes are all
responses; rows that repeat the smallest page id of a payload are all responses; a null page id is never referred
to while another page has the payload, and alone it is a response; a null url has the key ''. Without a column of
capture times (``time_col``) each page gets one made from a hash of its id, in 2024. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import join_counted, materialize, scratch, shared_folder

CRLF = "\r\n"
#: (payload bytes below which a page is of this class, records in one archive): at most about 320 MB before compression.
CLASSES = ((1 << 16, 5_000), (1 << 22, 78), (1 << 31, 1))
_FIELDS = "page_id string, url string, captured_at string, payload_bytes long, payload_digest string, record_type string, refers_to string, ok boolean, archive string, offset long"
#: The order of captures; unique, as an archive has one record at an offset.
KEYS = ["url_key", "captured_at", "archive", "offset"]
RUN_ROWS = "url_key string, captured_at string, page_id string, archive string, offset long, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, ok boolean"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary or string column: 5 bytes are 8 digits, in four parts."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def capture_plan(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Each page with its payload's digest and length, its record type and the id it refers to."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    when = F.date_format(F.col(time_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if time_col else F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(F.xxhash64(id_col), F.lit(0)), F.lit(31536000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), when.alias("captured_at"), F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(html).alias("payload_digest"))
    # Only payloads that more than one page has need the join; counts and minima are pre-aggregated, hot payloads are split.
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct(F.col("page_id").alias("id"), "url", F.col("captured_at").alias("at"))))
    shared = rows.groupBy("payload_digest").agg(first.alias("first"), F.count("*").alias("n"), F.max("payload_bytes").alias("b")).where(f"n > 1 AND first IS NOT NULL AND b >= {min_revisit_bytes}")
    joined = join_counted(rows, materialize(shared.select("payload_digest", "first", "n")), ["payload_digest"], "n", F.col("page_id"), "left")
    again = F.col("first").isNotNull() & ~F.col("first.id").eqNullSafe(F.col("page_id"))
    of = lambda c: F.when(again, F.col(f"first.{c}"))
    return joined.select("page_id", "url", "html", "captured_at", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), of("id").alias("refers_to"), of("url").alias("refers_url"), of("at").alias("refers_at"))


def _field(name: str, value: Column) -> Column:
    """A header line, left out where the value is null; line breaks in values would break the record."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]", " "), F.lit(CRLF)), F.lit(""))


def record_text(plan: DataFrame) -> DataFrame:
    """One ``value`` per page: its WARC record without the closing CR LF CR LF."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    whole = F.when(F.col("record_type") == "response", F.concat(http, F.col("html"))).otherwise(http)
    uid = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url", "payload_digest"))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(uid, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", urn), _field("WARC-Date", F.col("captured_at")), _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")).otherwise(F.lit("")),
        _field("WARC-Refers-To-Target-URI", F.col("refers_url")), _field("WARC-Refers-To-Date", F.col("refers_at")),
        _field("X-Page-Id", F.col("page_id")), _field("X-Refers-To-Page-Id", F.col("refers_to")), _field("X-Full-Payload-Length", F.col("payload_bytes")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _field("Content-Length", F.octet_length(whole)),
        F.lit(CRLF),
    )
    return plan.select(F.concat(head, whole).alias("value"))


def with_info(records: DataFrame, most: int) -> DataFrame:
    """``records`` with a ``warcinfo`` record before each ``most`` of a task: where the writer begins an archive."""
    body = f"software: barspark{CRLF}format: WARC File Format 1.1{CRLF}"
    info = f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:%s>{CRLF}WARC-Date: 2024-01-01T00:00:00Z{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: {len(body)}{CRLF}{CRLF}{body}"
    number = F.monotonically_increasing_id()  # the task's number above, the row's number within the task in 33 bits
    before, after = info.split("%s")
    uid = F.regexp_replace(F.md5(F.col("at").cast("string")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    starts = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) % most == 0
    both = F.when(starts, F.array(F.concat(F.lit(before), uid, F.lit(after)), "value")).otherwise(F.array("value"))
    return records.withColumn("at", number).select(F.explode(both).alias("value"))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, classes: tuple[tuple[int, int], ...] = CLASSES, html_col: str = "html", **columns) -> None:
    """Write gzip-compressed WARC files below ``path``, a folder for each size class that has pages.

    Equal payloads have equal lengths, so revisits are found within a class.
    """
    size = F.coalesce(F.octet_length(html_col), F.lit(0))
    of = F.coalesce(*[F.when(size < most, i) for i, (most, _) in enumerate(classes)])
    for i in sorted(pages.select(of.alias("c")).agg(F.collect_set("c")).first()[0]) or [0]:
        most = classes[i][1]
        plan = capture_plan(pages.where(of == i), min_revisit_bytes, html_col=html_col, **columns)
        with_info(record_text(plan), most).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", most + 1).text(f"{path}/class-{i}")


def records_in(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(header fields, block, offset in the uncompressed archive) of each record."""
    at = 0
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}: {line[:40]!r}")
        start, fields = at, {}
        at += len(line)
        while (line := stream.readline()) not in (b"\r\n", b""):
            at += len(line)
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            fields[name] = value
        at += len(line)
        length = int(fields["Content-Length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {start} is cut short")
        at += length + 4
        yield fields, block, start


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, then path and query: captures of a site sort together."""
    rest = (url or "").split("#", 1)[0].partition("://")[2] or (url or "")
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].lower().partition(":")[0].removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + slash + path if url else ""


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RUN_ROWS.split(", ")]
    types = [pa.int64() if x.endswith(" long") else pa.bool_() if x.endswith(" boolean") else pa.string() for x in RUN_ROWS.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            run = []
            name = path.rsplit("/", 1)[-1]
            for fields, block, offset in records_in(gzip.open(io.BufferedReader(io.BytesIO(content.as_buffer())))):
                if fields["WARC-Type"] == "warcinfo":
                    continue
                payload = block.partition(b"\r\n\r\n")[2]
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                n, found = int(fields["X-Full-Payload-Length"]), digest
                if kind == "response":
                    n, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                url = fields.get("WARC-Target-URI")
                run.append((url_key(url), fields["WARC-Date"], fields.get("X-Page-Id"), name, offset, url, n, found, kind, fields.get("X-Refers-To-Page-Id"), found == digest))
            run.sort(key=lambda r: (r[0], r[1], r[4]))
            for i in range(0, len(run), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*run[i : i + 5_000], strict=True), types, strict=True)], names)


def read_runs(spark, path: str) -> DataFrame:
    """The captures in the archives below ``path``: each archive is one locally sorted run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_read, RUN_ROWS)


class LoserTree:
    """Merges sorted iterables: an inner node keeps the loser of its match, so each row costs one path of matches."""

    def __init__(self, runs: Iterable[Iterable[tuple]] = ()) -> None:
        self.runs: list[Iterator[tuple]] = []
        self.heads: list[tuple | None] = []
        self.tree: list[int] = [0]
        for run in runs:
            self._open(run)
        self._build()

    def _open(self, run: Iterable[tuple]) -> None:
        it = iter(run)
        self.runs.append(it)
        self.heads.append(next(it, None))

    def _build(self) -> None:
        self.k = len(self.runs)
        self.tree = [0] * max(self.k, 1)
        winners = [*([0] * self.k), *range(self.k)]
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winners[1] if self.k > 1 else 0

    def add(self, run: Iterable[tuple]) -> None:
        """One more run; those that have ended are dropped. Plays all matches again, which a chunk of rows makes up for."""
        live = [i for i, h in enumerate(self.heads) if h is not None]
        self.runs, self.heads = [self.runs[i] for i in live], [self.heads[i] for i in live]
        self._open(run)
        self._build()

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) <= (y, b)

    def until(self, limit: tuple | None) -> Iterator[tuple]:
        """The next rows in order, while they are below ``limit`` (None: all)."""
        while self.k and (row := self.heads[win := self.tree[0]]) is not None and (limit is None or row < limit):
            yield row
            self.heads[win] = next(self.runs[win], None)
            node = (win + self.k) // 2
            while node:
                if self._before(self.tree[node], win):
                    win, self.tree[node] = self.tree[node], win
                node //= 2
            self.tree[0] = win

    def __iter__(self) -> Iterator[tuple]:
        return self.until(None)


def _chunks(bounds: list[tuple], most: int):
    """Cuts sorted runs at the ``bounds`` of the ranges and after ``most`` rows: one row (range, first key, chunk) each."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEYS), strict=True))
            ranges = [bisect_right(bounds, k) for k in keys]
            at = [i for i in range(len(keys)) if i == 0 or ranges[i] != ranges[i - 1] or keys[i][2] != keys[i - 1][2] or keys[i] < keys[i - 1]]
            at = sorted({x for a, b in zip(at, [*at[1:], len(keys)], strict=True) for x in range(a, b, most)})
            if not at:
                continue
            rows = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
            chunk = pa.ListArray.from_arrays(pa.array([*at, len(keys)], pa.int32()), rows)
            first = [pa.array([keys[i][c] for i in at], batch.schema.field(name).type) for c, name in enumerate(KEYS)]
            yield pa.RecordBatch.from_arrays([pa.array([ranges[i] for i in at], pa.int32()), *first, chunk], ["rng", *KEYS, "chunk"])

    return cut


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges chunks that come in the order of (range, first key)."""
    tree, of, out = LoserTree(), None, []
    names: list[str] = []
    types: list[pa.DataType] = []

    def rows_of(chunk: pa.StructScalar) -> Iterator[tuple]:
        cols = [chunk.values.field(i).to_pylist() for i in range(len(names))]
        at = [names.index(c) for c in KEYS]
        return ((*key, row) for *key, row in zip(*(cols[i] for i in at), zip(*cols, strict=True), strict=True))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        chunks = batch.column("chunk")
        inner = chunks.type.value_type
        names, types = [f.name for f in inner], [f.type for f in inner]
        for i, (rng, *key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rng", *KEYS)), strict=True)):
            for row in tree.until(tuple(key) if rng == of else None):
                out.append(row[-1])
                if len(out) >= 5_000:
                    yield packed(out)
                    out = []
            tree.add(rows_of(chunks[i]))
            of = rng
    out += [row[-1] for row in tree]
    for i in range(0, len(out), 5_000):
        yield packed(out[i : i + 5_000])


def merge_runs(runs: DataFrame, range_rows: int = 50_000, chunk: int = 1_000, sample_rows: int = 200_000) -> DataFrame:
    """The captures of ``runs`` (a written table of sorted runs) in global order of (url_key, captured_at).

    Key ranges have about ``range_rows`` captures; their bounds come from 50 rows a range, at most about ``sample_rows``.
    """
    total = runs.count()
    ranges = total // range_rows + 1
    share = F.pmod(F.xxhash64("archive", "offset"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, min(sample_rows, 50 * ranges) / max(total, 1)))
    keys = sorted(tuple(r) for r in runs.select(*KEYS).where(share).toLocalIterator())
    ranges = min(ranges, max(1, len(keys)))
    bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})
    types = dict(runs.dtypes)
    row = "struct<" + ", ".join(f"{c}: {t}" for c, t in runs.dtypes) + ">"
    cut = runs.mapInArrow(_chunks(bounds, chunk), f"rng int, {', '.join(f'{c} {types[c]}' for c in KEYS)}, chunk array<{row}>")
    return cut.repartitionById(len(bounds) + 1, F.col("rng")).sortWithinPartitions("rng", *KEYS).mapInArrow(_merge, runs.schema)


def archive(pages: DataFrame, min_revisit_bytes: int = 0, path: str | None = None, **columns) -> DataFrame:
    """Write the pages' archives, read them back and return the ordered capture history.

    The archives stay where a ``path`` is given; without one they go with the intermediate tables.
    """
    spark = pages.sparkSession
    with scratch(spark):
        where = path or shared_folder(spark)
        write_archives(pages, where, min_revisit_bytes, **columns)
        return merge_runs(materialize(read_runs(spark, where), outer=True))


def digest(history: DataFrame, id_type: str = "long") -> DataFrame:
    return history.select(F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"), "url_key", F.col("ok").alias("digest_ok"))
