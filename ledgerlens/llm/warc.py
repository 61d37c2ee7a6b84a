"""Web archives (WARC/1.1) written and read by Spark, with a globally ordered capture index.

Writing is Spark's text writer: a record is one text whose line separator is the record's
end, so tasks that are lost or repeated leave no half files. The archives are read back
record by record along their lengths. Every archive gives a locally sorted run of captures;
the runs are cut at common range bounds and each range is merged from its runs with a loser
tree by URL key, timestamp and record, so the ranges in order are the capture histories.

Defined cases: a null payload is empty; a null URL has an empty target and key; of records
with equal payloads of at least `min_bytes` bytes those with the smallest id are responses
and the others revisit it (rows that repeat the smallest id are all responses, as are all
if every id is null); an empty table gives archives without records and an empty index;
line breaks in a URL are percent-encoded in the header.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ascii_lower, batch_of, bounded, stage
from ledgerlens.session import scratch_path

END = "\r\n"
RECORDS_PER_FILE = 20_000
RECORD = "url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, position long"
FIELDS = [
    ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("position", pa.int64()),
]


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four base32 digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: Column | None = None, min_bytes: int = 0) -> DataFrame:
    """One column `value`: the text of a WARC record per row."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    page_id = F.col(id_col).cast("long")
    if date is None:  # a table without capture times: one second per id
        date = F.timestamp_seconds(F.lit(1_577_836_800) + F.coalesce(page_id, F.lit(0)))
    rows = df.select(
        page_id.alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), date.alias("captured"),
        F.octet_length(payload).cast("long").alias("n"), base32_sha1(payload.cast("binary")).alias("digest"),
    )
    repeated = rows.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    repeated = stage(repeated.filter("copies > 1").drop("copies"), "payloads")
    rows = rows.join(bounded(repeated), "digest", "left")
    revisit = (F.col("n") >= min_bytes) & F.coalesce(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.lit(False))
    body = F.when(revisit, "").otherwise(F.col("payload"))
    target = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return rows.select(F.concat(
        F.lit("WARC/1.1" + END), F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"), F.lit(END),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        _header("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")), _header("WARC-Target-URI", target),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), _header("X-Payload-Length", F.col("n").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + END), _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8" + END), _header("Content-Length", F.octet_length(body).cast("string")), F.lit(END), body,
    ).alias("value"))


def write_archives(record_texts: DataFrame, path: str | None = None, per_file: int = RECORDS_PER_FILE) -> str:
    """Writes gzip archives of at most `per_file` records below `path` (by default in the shared folder)."""
    path = path or scratch_path(record_texts.sparkSession, "warc")
    record_texts.write.option("lineSep", END + END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)
    return path


def _stream(content: bytes) -> Iterator[bytes]:
    """The unpacked bytes of an archive, piece by piece."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:  # a gzip file may have many members
        unpack = zlib.decompressobj(wbits=31)
        for i in range(0, len(content), 1 << 20):
            yield unpack.decompress(content[i : i + (1 << 20)])
            if unpack.eof:
                content = unpack.unused_data + content[i + (1 << 20) :]
                break
        else:
            raise ValueError("an archive ends within a gzip member")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers, block and position of each record, along the lengths that the records state."""
    pieces, held, at = _stream(content), bytearray(), 0

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("an archive ends within a record")
                return
            end = held.find(b"\r\n\r\n")
        lines = held[:end].decode("utf-8").split(END)
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        stop = end + 4 + int(headers["Content-Length"])
        if not lines[0].startswith("WARC/") or not fill(stop):
            raise ValueError(f"no whole record at {at}")
        yield headers, bytes(held[end + 4 : stop]), at
        fill(stop + 4)
        at += stop + 4
        del held[: stop + 4]


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then the path and query: one site's captures stand together."""
    scheme, mark, rest = url.partition("://")
    host, slash, path = (rest if mark else url).partition("/")
    return ",".join(reversed(host.lower().split("."))) + ")" + slash + path if url else ""


def _id(value: str) -> int | None:
    digits = value.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One locally sorted run of captures per archive."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            run = []
            for headers, block, position in parse(content.as_py()):
                kind, url = headers["WARC-Type"], headers["WARC-Target-URI"]
                digest, n = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                if kind == "response":
                    n, real = len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()
                    if real != digest:
                        raise ValueError(f"the payload at {position} of {path} does not have its digest")
                refers = _id(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None
                run.append((url_key(url), headers["WARC-Date"], _id(headers["WARC-Record-ID"]), url, kind, refers, n, digest, path.as_py(), position))
            run.sort(key=_order)
            yield batch_of(pa.schema(FIELDS), *([list(c) for c in zip(*run)] or [[] for _ in FIELDS]))


def _order(row: tuple) -> tuple:
    """URL key, timestamp, id (null first), then the record's place."""
    return row[0], row[1], -1 if row[2] is None else row[2], row[8], row[9]


def read_captures(spark, path: str) -> DataFrame:
    """A row per record of all archives, checked against its digest; each archive's rows are a sorted run."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("path").rlike(r"/part-[^/]*$"))
    return files.select("path", "content").mapInArrow(_captures, RECORD)


class LoserTree:
    """Merges k sorted iterators: inner nodes hold the loser of their match, so a step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]], key: Callable[[tuple], tuple]):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads: list[tuple | None] = [None] * self.k  # (key, row), None when a run has ended
        for i in range(self.k):
            self._next(i)
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _next(self, i: int) -> None:
        row = next(self.runs[i], None)
        self.heads[i] = None if row is None else (self.key(row), row)

    def _beats(self, i: int, j: int) -> bool:
        """Whether run i comes first; an ended run comes last, and -1 (no run yet) waits for its partner."""
        if self.heads[i] is None or self.heads[j] is None:
            return self.heads[j] is None
        return (self.heads[i][0], i) < (self.heads[j][0], j)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # while the tree is built: the first to arrive waits here
                self.losers[node] = winner
                return
            if not self._beats(winner, other):
                winner, self.losers[node] = other, winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner][1]
            self._next(winner)
            self._replay(winner)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of one range, each already in order, merged; a range is bounded by the partition size."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(row[8], []).append(row)
    merged, held = LoserTree([iter(r) for r in runs.values()], _order), []
    for row in merged:
        held.append(row)
        if len(held) == 10_000:
            yield batch_of(pa.schema(FIELDS), *map(list, zip(*held)))
            held = []
    if held:
        yield batch_of(pa.schema(FIELDS), *map(list, zip(*held)))


def capture_index(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """All captures in global order of URL key, timestamp and id.

    The runs are stored once, then dealt by range; the bounds hold the id and the record's
    place too, so one hot URL is spread over many ranges. Within a range every archive's
    rows are put in run order and merged.
    """
    runs = stage(captures, "runs")
    keys = ["url_key", "captured", "page_id", "archive", "position"]
    dealt = runs.repartitionByRange(ranges, *keys) if ranges else runs.repartitionByRange(*keys)
    return dealt.sortWithinPartitions("archive", *keys).mapInArrow(_merge, RECORD)
