"""WARC archives as tables of chunks, written and read chunk by chunk in bounded memory.

An archive is a table (record, chunk, data): the chunks of a record in order are its bytes as WARC 1.1 writes them, and
all records one after another are a WARC file. Payloads are cut into chunk rows as they are scanned, and writer and reader
see one chunk at a time, with the digest carried along: the header, which names it, is the first chunk of its record and
is written last. Equal payloads are stored once: the record with the smallest id keeps the payload, the others are
revisits that refer to it. A record whose chunks lie together is read where it lies; only records that are cut over
several tasks meet in a shuffle.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm import frames
from shelfline.session import stored as stored_table

CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
# The profile WARC 1.1 names for records whose payload was stored before
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

CHUNKS = "record long, chunk int, data binary"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
_CHUNKS = pa.schema([("record", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary())])


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


NO_DIGEST = _base32(bytes(20))


def _line(value: object) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def _head(row: dict) -> bytes:
    revisit = row.get("refers_to") is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"X-Payload-Length: {row['size']}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_line(row['url'])}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    lines.append(f"Content-Length: {0 if revisit else row['size']}")
    return ("\r\n".join(lines)).encode() + END


_STREAMED = pa.schema(
    [*_CHUNKS, ("page_id", pa.int64()), ("url", pa.string()), ("size", pa.int64()), ("digest", pa.string())]
)
STREAMED = f"{CHUNKS}, page_id long, url string, size long, digest string"


def _cut(data: bytes, chunk: int) -> list[bytes]:
    return [data[i : i + chunk] for i in range(0, len(data), chunk)]


def _streamed(batches, chunk: int):
    """Rows of (record, page_id, url, size, part, data), the parts of a payload in order, to the chunks of a response.

    The number of header chunks is known before the digest is, so the parts pass through under their final numbers; the
    header follows the last part, and with it what the archive has to know of the record.
    """
    digest, heads = hashlib.sha1(), 0
    for batch in batches:
        rows, held = [], 0
        names = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for i, (record, page, url, size, part) in enumerate(zip(*names, strict=True)):
            data = batch.column(5)[i].as_py()
            known = {"page_id": page, "url": url, "size": size, "digest": NO_DIGEST}
            if part == 0:
                digest = hashlib.sha1()
                heads = -(-len(_head(known)) // chunk)
            digest.update(data)
            last = part * chunk + len(data) >= size
            tail = END if last else b""
            if last:
                known["digest"] = _base32(digest.digest())
                head = _head(known)
                if part == 0 and len(head) + len(data) <= chunk:  # all in one
                    rows.append((record, 0, head + data + tail, page, url, size, known["digest"]))
                    data = tail = b""
                else:
                    after = b"" if data else tail
                    pieces = _cut(head, chunk)
                    pieces[-1] += after
                    rows += [(record, n, x, page, url, size, known["digest"] if n == 0 else None) for n, x in enumerate(pieces)]
            if data:
                rows.append((record, heads + part, data + tail, page, None, size, None))
            held += len(data) + len(rows[-1][2])
            if held > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _STREAMED, strict=True)], schema=_STREAMED)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _STREAMED, strict=True)], schema=_STREAMED)


def _revisits(batches, chunk: int):
    for batch in batches:
        rows: list[tuple[int, int, bytes]] = []
        for row in batch.to_pylist():
            pieces = _cut(_head(row), chunk)
            pieces[-1] += END
            rows += [(row["record"], n, x) for n, x in enumerate(pieces)]
        if rows:
            yield _arrow(rows)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(_CHUNKS.names, map(list, zip(*rows, strict=True)), strict=True)), _CHUNKS)


def write(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK, least: int = 0
) -> DataFrame:
    """The archive of the pages as a table of chunks. Payloads of fewer than `least` bytes are never revisits.

    A null payload is an empty one. A row without an id never gets a revisit of its own payload: where all rows of a
    payload lack an id, each is a response. Rows that repeat the id of a response are responses as well. Payloads and urls
    of any size go over as many chunks as they take. An empty table gives an empty archive. Other columns of the input are
    ignored.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.monotonically_increasing_id().alias("record"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("size", F.octet_length("payload").cast("long"))
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("size") / chunk) - 1).cast("long"))
    rows = rows.select("record", "page_id", "url", "size", F.explode(parts).alias("part"), "payload")
    data = F.substring("payload", (F.col("part") * chunk + 1).cast("int"), F.lit(chunk))
    rows = rows.select("record", "page_id", "url", "size", "part", data.alias("data"))
    responses = stored_table(rows.mapInArrow(lambda it: _streamed(it, chunk), STREAMED), "warc-responses")
    heads = responses.where("chunk = 0").select("record", "page_id", "url", "size", "digest")
    # pre-aggregated: a payload that a third of all pages have is one row of each task here
    first = heads.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    first = first.where((F.col("n") > 1) & (F.col("size") >= least) & F.col("refers_to").isNotNull()).drop("n")
    again = heads.join(first, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    # written, so that Spark knows their size: as long as they are few they are sent to all tasks and no payload is shuffled
    again = stored_table(again, "warc-revisits")
    kept = responses.select("record", "chunk", "data").join(again.select("record"), "record", "left_anti")
    kept = kept.sortWithinPartitions("record", "chunk")
    return kept.union(again.mapInArrow(lambda it: _revisits(it, chunk), CHUNKS))


def _beyond(head: bytearray, data: memoryview) -> memoryview | None:
    """Adds to a header what the chunk has of it; what follows it, or None while its end is not there."""
    before = len(head)
    head += data
    end = head.find(END, max(0, before - len(END) + 1))
    if end < 0:
        return None
    del head[end:]
    return data[end + len(END) - before :]


class CutShort(ValueError):
    """The bytes of a record end too early, or go on after its end."""


class _Record:
    """A record that is being read: header first, over as many chunks as it takes, then payload bytes into the digest."""

    def __init__(self) -> None:
        self.head = bytearray()
        self.fields: dict[str, str] | None = None
        self.left = 0
        self.seen = 0
        self.hash = hashlib.sha1()
        self.tail = b""

    def feed(self, data: memoryview) -> None:
        if self.fields is None:
            rest = _beyond(self.head, data)
            if not self.head.startswith(b"WARC/"[: len(self.head)]):
                raise ValueError(f"not a WARC record: {bytes(self.head[:40])!r}")
            if rest is None:
                return
            lines = self.head.decode().split("\r\n")
            self.fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
            self.left = int(self.fields["content-length"])
            data, self.head = rest, bytearray()
        body = data[: self.left]
        self.hash.update(body)
        self.left -= len(body)
        self.seen += len(body)
        self.tail += bytes(data[len(body) :])

    def result(self) -> dict:
        if self.fields is None or self.left or self.tail != END:
            raise CutShort("WARC record is cut short")
        kind, digest = self.fields["warc-type"], self.fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and _base32(self.hash.digest()) != digest:
            raise ValueError("payload does not have the digest its record names")
        own = self.fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
        refers = self.fields.get("warc-refers-to")
        return {
            "page_id": int(own) if own else None,
            "url": self.fields.get("warc-target-uri"),
            "record_type": kind,
            "payload_bytes": self.seen if kind == "response" else int(self.fields["x-payload-length"]),
            "payload_digest": digest,
            "refers_to": int(refers.removeprefix("<urn:page:").removesuffix(">")) if refers else None,
        }


_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
)


_PARTED = pa.schema([*_RECORDS, ("record", pa.int64()), ("whole", pa.bool_())])


class _Cut(Exception):
    """A record of which a task does not have all chunks."""


def _read(batches, parted: bool = False):
    """The records of a task, whose chunks come in order. With `parted`, records that are not whole are only named."""
    now, record, following = None, None, 0
    none = dict.fromkeys(_RECORDS.names)

    def ended() -> dict:
        try:
            if record is None:
                raise _Cut
            return record.result() | {"record": now, "whole": True}
        except (_Cut, CutShort):
            if not parted:
                raise
            return none | {"record": now, "whole": False}

    schema = _PARTED if parted else _RECORDS
    some = False
    for batch in batches:
        out = []
        for name, chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if not some or name != now:
                if some:
                    out.append(ended())
                some, now, record, following = True, name, _Record(), 0
            if parted and (record is None or chunk != following):
                record = None
                continue
            following = chunk + 1
            record.feed(memoryview(data.as_buffer()))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if some:
        yield pa.RecordBatch.from_pylist([ended()], schema)


def read(chunks: DataFrame) -> DataFrame:
    """One row per record of an archive, digests verified. Chunks may lie in any order.

    Records whose chunks a task has whole are read there. The others are read again after a shuffle of their chunks: a
    few where an archive is read as it was written, all of them where it was not.
    """
    here = chunks.sortWithinPartitions("record", "chunk").mapInArrow(lambda it: _read(it, True), f"{RECORDS}, record long, whole boolean")
    here = stored_table(here, "warc-records")
    parted = here.where("NOT whole").select("record").distinct()
    whole = here.where("whole")
    if parted.isEmpty():
        return whole.drop("record", "whole")
    rest = chunks.join(parted, "record", "left_semi").select("record", "chunk", "data")
    ordered = rest.repartition(frames.partitions(chunks.sparkSession), "record").sortWithinPartitions("record", "chunk")
    return whole.join(parted, "record", "left_anti").drop("record", "whole").union(ordered.mapInArrow(_read, RECORDS))


def payloads(chunks: DataFrame) -> DataFrame:
    """(record, chunk, data): the payload bytes of the responses, chunk by chunk, headers and ends taken off."""
    ordered = chunks.repartition(frames.partitions(chunks.sparkSession), "record").sortWithinPartitions("record", "chunk")

    def bodies(batches):
        now, left, number, head = None, 0, 0, None
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                raw = memoryview(data.as_buffer())
                if name != now:
                    now, number, head = name, 0, bytearray()
                if head is not None:
                    raw = _beyond(head, raw)
                    if raw is None:
                        continue
                    left = int(head.rpartition(b"Content-Length: ")[2])
                    head = None
                rows.append((name, number, bytes(raw[:left])))
                left -= min(left, len(raw))
                number += 1
            if rows:
                yield _arrow(rows)

    return ordered.mapInArrow(bodies, CHUNKS)


def stored(chunks: DataFrame, path: str) -> DataFrame:
    """Writes an archive and opens it again."""
    chunks.write.parquet(path)
    return chunks.sparkSession.read.schema(CHUNKS).parquet(path)


