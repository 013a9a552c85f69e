"""WARC writing and reading, and an external merge of capture indexes.

Writing: one record for each page; of pages with equal payloads the one with the
largest id is a ``response``, the others are ``revisit`` records that refer to it.
Digests are computed in the scan; only (digest, id) pairs are aggregated, so payloads
are never shuffled.  Records are written by Spark's text writer (uncompressed
WARC/1.1; the record ends in the writer's line end).  A file is closed with the record
that reaches ``FILE_BYTES``, so it is at most that and one record long.

Reading: every archive is parsed by its Content-Length fields, response payloads are
hashed and compared with their digest field, and the captures of an archive form a run
sorted by URL key and timestamp.

Index merge: the runs are cut at common key ranges of about ``RANGE_ROWS`` captures; each
range merges its piece of all runs with a loser tree.  Range bounds include timestamp and id, so one URL or host that
holds a third of all captures is spread over many ranges.  Partition order times row
order is the global order of the capture histories.

Defined cases: null html is an empty payload; a null URL gives an empty key and no
target field; line ends in URLs are percent-encoded; repeated rows of the largest id are all
responses; a null id never represents its group unless all ids in it are null, when
all are responses.  Pages carry no time, so the capture time is a fixed instant plus
the id in seconds unless a column is named.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FILE_BYTES = 16 << 20
#: Captures of a key range, which one task merges.
RANGE_ROWS = 50_000
#: Bound of a broadcast table of repeated digests.
BROADCAST_BYTES = 32 << 20
EPOCH = 1_704_067_200
_ENTRY = "run string, seq int, urlkey string, timestamp string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, offset long, length long"


def base32_of_hex(h: Column) -> Column:
    """Upper-case base32 of 40 hex digits: 20 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def planned(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int, captured_at: str | None) -> DataFrame:
    """(page_id, url, html, stamp, digest, largest): the record plan; payloads stay where they are."""
    body = F.coalesce(F.col(html), F.lit(""))
    when = F.unix_timestamp(captured_at) if captured_at else F.lit(EPOCH) + F.coalesce(F.col(page_id).cast("long"), F.lit(0))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("html"), when.alias("at"), base32_of_hex(F.sha1(body.cast("binary"))).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    same = rows.groupBy("digest", "size").agg(F.max("page_id").alias("largest"), F.count("*").alias("k")).where(f"k > 1 AND size >= {least_bytes} AND largest IS NOT NULL").drop("k")
    same = C.materialize(same, "repeated")
    return rows.join(C.small_side(same, BROADCAST_BYTES, 64), ["digest", "size"], "left")


def records(rows: DataFrame) -> Column:
    """The text of a record without its last line feed."""
    crlf = "\r\n"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(crlf))
    maybe = lambda c, text: F.when(c, text).otherwise(F.lit(""))
    stamp = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    own = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    revisit = F.col("largest").isNotNull() & ~F.col("largest").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("size").cast("string"), F.lit(crlf + crlf))
    block = F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("size"))
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1" + crlf),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(own)),
        line("WARC-Date", stamp),
        maybe(F.col("url") != "", line("WARC-Target-URI", address)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        maybe(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + crlf), line("WARC-Refers-To", urn(F.coalesce("largest", F.lit(0)))))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(crlf),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
        F.lit(crlf + "\r"),
    )


def _rolled(batches: Iterator[pa.RecordBatch], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records with the number of the file of this task that takes them."""
    file, used = 0, 0
    for batch in batches:
        numbers = []
        for size in pc.binary_length(batch.column(0)).to_pylist():
            numbers.append(file)
            used += size + 1
            if used >= file_bytes:
                file, used = file + 1, 0
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32())], ["value", "part"])


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, captured_at: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write the pages as WARC files of about ``file_bytes`` in folders under ``path``."""
    C.narrow_batches(pages.sparkSession)
    rows = planned(pages, page_id, url, html, least_bytes, captured_at)
    rows = rows.select(records(rows).alias("value")).mapInArrow(lambda it: _rolled(it, file_bytes), "value string, part int")
    rows.write.option("lineSep", "\n").partitionBy("part").text(path)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, no scheme, no www, lower case, no default port."""
    m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url.strip(), re.I)
    if not m:
        return url.strip().lower()
    host, port, rest = m.groups()
    host = re.sub(r"^www\d*\.", "", host.lower())
    port = "" if port in (None, "80", "443") else ":" + port
    return ",".join(reversed(host.split("."))) + port + ")" + (rest.lower() or "/")


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, block) of every record of an archive."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        if head < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for line in content[at:head].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        begin = head + 4
        end = begin + int(fields["content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, end + 4 - at, fields, content[begin:end]
        at = end + 4


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            name = "/".join(batch.column(0)[k].as_py().rsplit("/", 2)[-2:])  # folder and file
            rows = []
            for offset, length, f, block in parse(batch.column(1)[k].as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?mi)^content-length: *(\d+)", http)[1])
                digest = f["warc-payload-digest"].removeprefix("sha1:")
                kind = f["warc-type"]
                if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{name}: the payload at byte {offset} is not what its digest says")
                page, refers = (re.sub(r"^<urn:page:|>$", "", f.get(x, "none")) for x in ("warc-record-id", "warc-refers-to"))
                number = lambda x: None if x == "none" else int(x)
                stamp = re.sub(r"\D", "", f["warc-date"])
                rows.append((url_key(f.get("warc-target-uri", "")), stamp, number(page), kind, digest, size, number(refers), offset, length))
            rows.sort(key=_order)
            if rows:
                cols = list(zip(*rows, strict=True))
                types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int32()), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [x.split()[0] for x in _ENTRY.split(", ")])


def _order(row: tuple) -> tuple:
    """URL key, timestamp, then id (null first): as bytes, like Spark's own order of strings."""
    return row[0].encode(), row[1], row[2] is not None, row[2] or 0, row[4], row[7]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The capture index of every archive under ``path``, one sorted run for each archive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_runs, _ENTRY)


class LoserTree:
    """k-way merge: inner places hold the losers of their games, the top holds the winner."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * self.k
        self.heads = [r[0] if r else None for r in runs] or [None]
        self.lost = [0] * self.k
        self.lost[0] = self._play(1)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.lost[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) in merged order."""
        win = self.lost[0]
        while self.heads[win] is not None:
            yield win, self.at[win]
            self.at[win] += 1
            run = self.runs[win]
            self.heads[win] = run[self.at[win]] if self.at[win] < len(run) else None
            node = (win + self.k) // 2
            while node:  # replay only the games on the way up
                if self._less(self.lost[node], win):
                    self.lost[node], win = win, self.lost[node]
                node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range: pieces of all runs, one after another, merged."""
    parts = list(batches)
    table = pa.Table.from_batches(parts) if parts else None
    if table is None or not table.num_rows:
        return
    names = table.column("run").to_pylist()
    rows = list(zip(*[table.column(c).to_pylist() for c in ("urlkey", "timestamp", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "offset")], strict=True))
    keys = [_order(r) for r in rows]
    edge = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
    runs = [keys[a:b] for a, b in zip(edge, edge[1:], strict=False)]
    order = [edge[r] + i for r, i in LoserTree(runs)]
    yield from table.take(pa.array(order)).combine_chunks().to_batches()


def merged_index(runs: DataFrame) -> DataFrame:
    """The runs, which are a work table, as one globally ordered index."""
    cut = runs.repartitionByRange(max(1, -(-runs.count() // RANGE_ROWS)), F.col("urlkey"), F.col("timestamp"), F.col("page_id"), F.col("run"), F.col("seq"))
    return cut.sortWithinPartitions("run", "seq").mapInArrow(_merge, _ENTRY)


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    runs = C.materialize(read(spark, path), "runs")
    C.delete(spark, path)  # the runs hold all that is asked for
    return merged_index(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
