"""WARC archives: writing, reading, and revisit resolution.

Headers without payloads are shuffled by payload digest; of equal payloads one is the original
response and the others become revisit records that refer to it. Archives are written by Spark's own
committers, so a task that is run again leaves no second copy, on any Hadoop file system. Each file is
a gzip stream of whole records; readers follow Content-Length, so payloads may hold anything. The number
of records in a file falls with the size of their payloads, so that a file fits in memory.

A record is named by its id and digest, and, where rows repeat both, by a number of its own; so no two
records of an archive share a WARC-Record-ID, and a revisit names the one response that it repeats.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.runtime import fresh_path, written

EOL = "\r\n"
URN = "urn:cuesheet:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URI = "urn:cuesheet:no-uri"
RECORDS_PER_FILE = 2000
#: Payloads of up to so many bytes are written together; each step up, a file takes a sixteenth of the records.
SIZE_STEPS = (1 << 16, 1 << 20, 1 << 24)

_RECORD = "record_id string, type string, uri string, date string, digest string, refers_to string, payload_bytes bigint, urn string, refers_urn string"


def with_headers(df: DataFrame, id_col: str, uri_col: str, payload_col: str, date_col: str | None = None) -> DataFrame:
    """(id, uri, date, payload, payload_bytes, digest): null payloads are empty, digest is bare hex SHA-1."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    date = F.col(date_col).cast("string") if date_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), date.alias("date"), payload.alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))


def resolve_revisits(headers: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(id, digest, payload_bytes, refers_to) of the records that repeat another's payload.

    headers: id, digest, payload_bytes. Of equal payloads of at least min_bytes, the record with the
    largest id is the response; the others refer to it. Smaller payloads are always responses. A record
    with a null id is never referred to. Groups are counted map-side, so a digest that a third of all
    records share is one row per task before the shuffle; the join back may be split by Spark.
    """
    large = headers.filter(F.col("payload_bytes") >= min_bytes).select("id", "digest", "payload_bytes")
    firsts = large.groupBy("digest", "payload_bytes").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null")
    return large.join(firsts.drop("n"), ["digest", "payload_bytes"]).filter(~F.col("id").eqNullSafe(F.col("refers_to")))


def _header(name: str, value: Column) -> Column:
    safe = F.regexp_replace(value, r"[\r\n]+", " ")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), safe, F.lit(EOL))).otherwise(F.lit(""))


def _name(record_id: Column, serial: Column | None = None) -> Column:
    name = F.concat(F.lit(f"<{URN}"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(":"), F.col("digest"))
    return F.concat(name, F.lit(">") if serial is None else F.concat(F.coalesce(F.concat(F.lit(":"), serial.cast("string")), F.lit("")), F.lit(">")))


def as_records(rows: DataFrame, date: str) -> DataFrame:
    """One string column: whole WARC/1.1 records but for the last line end. rows: those of `deduplicated`."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(EOL + EOL),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    block = F.concat(http, body)
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(EOL),
        _header("WARC-Record-ID", _name(F.col("id"), F.col("serial"))),
        _header("WARC-Date", F.coalesce("date", F.lit(date))),
        _header("WARC-Target-URI", F.coalesce("uri", F.lit(NO_URI))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, _name(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}{EOL}")).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{EOL}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(EOL + EOL),
    )
    return rows.select(F.concat(head, block, F.lit(EOL)).alias("record"))


def _step(payload_bytes: Column) -> Column:
    """The number of SIZE_STEPS that a payload is over."""
    return sum(((payload_bytes > n).cast("int") for n in SIZE_STEPS), F.lit(0))


def write_archives(rows: DataFrame, path: str, date: str | None = None, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write rows (of `deduplicated`) as gzip archives under a new path.

    A file has at most records_per_file records with payloads of up to 64 KB, and a sixteenth of that for each
    further factor of 16; a larger payload than the last step has a file for itself. Records without a date
    get `date`, or else the present time.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    step = _step(F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0))
    steps = [r["step"] for r in rows.select(step.alias("step")).distinct().orderBy("step").collect()] or [0]  # at most one more than SIZE_STEPS
    for i, n in enumerate(steps):
        part = rows if len(steps) == 1 else rows.filter(step == n)
        most = max(1, records_per_file >> 4 * n) if n < len(SIZE_STEPS) else 1
        as_records(part, date).write.mode("append" if i else "error").option("lineSep", EOL).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def deduplicated(rows: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """rows (of with_headers) with refers_to: null for responses, the response's id for revisits; and serial.

    serial is null but for all except one of the rows that repeat an id and payload: those get numbers.
    """
    heads = written(rows.select("id", "digest", "payload_bytes"), "warc-heads")
    # Written first, so that their true sizes decide between a broadcast and a shuffle of the payloads.
    again = written(resolve_revisits(heads, min_bytes).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "refers_to").distinct(), "warc-revisits")
    twins = written(heads.groupBy(F.col("id").alias("__id"), F.col("digest").alias("__digest")).count().filter("count > 1").select("__id", "__digest"), "warc-twins")

    def of(table: DataFrame) -> Column:
        return F.col("id").eqNullSafe(table["__id"]) & (F.col("digest") == table["__digest"])

    single = rows.withColumn("serial", F.lit(None).cast("long"))
    if twins.limit(1).count():
        # Few rows are expected here. They are numbered as they are written, so a task run again changes nothing.
        numbered = written(rows.join(twins, of(twins), "left_semi").withColumn("serial", F.monotonically_increasing_id()), "warc-numbered")
        first = numbered.groupBy(F.col("id").alias("__id"), F.col("digest").alias("__digest")).agg(F.min("serial").alias("__first"))
        numbered = numbered.join(first, of(first)).withColumn("serial", F.when(F.col("serial") != F.col("__first"), F.col("serial"))).drop("__id", "__digest", "__first")
        single = single.join(twins, of(twins), "left_anti").unionByName(numbered)
    return single.join(again, of(again), "left").drop("__id", "__digest")


class _Stream:
    """Reads a gzip (of one member or many) or plain byte string piece by piece."""

    def __init__(self, raw: bytes, piece: int = 1 << 20):
        self._raw, self._at, self._piece = raw, 0, piece
        self._zip = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None
        self._buffer = bytearray()
        self._from = 0

    def _more(self) -> bool:
        if self._at >= len(self._raw):
            return False
        part = self._raw[self._at : self._at + self._piece]
        self._at += len(part)
        while part:
            if self._zip is None:
                self._buffer += part
                break
            self._buffer += self._zip.decompress(part)
            part = self._zip.unused_data
            if part:
                self._zip = zlib.decompressobj(31)
        return True

    def _compact(self) -> None:
        if self._from > 1 << 22:
            del self._buffer[: self._from]
            self._from = 0

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before the next mark, which is passed over; None at the end."""
        searched = self._from
        while (i := self._buffer.find(mark, searched)) < 0:
            searched = max(self._from, len(self._buffer) - len(mark))
            if not self._more():
                return None
        out = bytes(self._buffer[self._from : i])
        self._from = i + len(mark)
        self._compact()
        return out

    def take(self, n: int) -> bytes:
        while len(self._buffer) - self._from < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self._buffer[self._from : self._from + n])
        self._from += n
        self._compact()
        return out


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of one archive file."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split(EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield headers, stream.take(int(headers["content-length"]))
        stream.take(4)


#: What follows the id in the names that as_records gives.
_SUFFIX = re.compile(r":[0-9a-f]{40}(:\d+)?$")


def _urn(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _id(urn: str | None) -> str | None:
    if not urn or not urn.startswith(URN):
        return urn
    return _SUFFIX.sub("", urn.removeprefix(URN)) or None


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The response and revisit records under path: _RECORD's columns, and payload if asked for.

    record_id and refers_to are the ids that rows had when they were written, urn and refers_urn the whole names.
    Digest and length of a response are taken from the payload that was read; a digest header that
    differs is an error. Of a revisit they are the header's digest and null.
    """
    schema = _RECORD + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for headers, block in parse(batch.column(0)[i].as_py()):
                    kind = headers.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    payload = size = None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
                        actual = hashlib.sha1(payload).hexdigest()
                        if digest not in (None, actual):
                            raise ValueError(f"{headers.get('warc-record-id')}: payload has digest {actual}, the header {digest}")
                        digest, size = actual, len(payload)
                    urn, to = _urn(headers.get("warc-record-id")), _urn(headers.get("warc-refers-to"))
                    rows.append((_id(urn), kind, headers.get("warc-target-uri"), headers.get("warc-date"), digest, _id(to), size, urn, to, payload)[: len(names)])
                    held += len(block) if payloads else 200
                    if held > 4 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    # The binary files of one task come one to a batch: a batch of many could exceed a worker's memory.
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, schema)


def _referred(records: DataFrame, value: str) -> DataFrame:
    """revisits of records with __value: the `value` of the response that has the name, and the digest if it has one, that they refer to."""
    revisits = records.filter("type = 'revisit'").drop(value)
    named = revisits.filter("refers_urn is not null").select(F.col("refers_urn").alias("__to")).distinct()
    bodies = records.filter("type = 'response'").join(named, F.col("urn") == F.col("__to"), "left_semi")
    # One row for each name and digest, and one for each name, for revisits without a digest: rows never multiply.
    by_digest = bodies.groupBy(F.col("urn").alias("__urn"), F.col("digest").alias("__digest")).agg(F.any_value(value).alias(value))
    by_name = by_digest.groupBy("__urn").agg(F.min_by(value, "__digest").alias(value)).withColumn("__digest", F.lit(None).cast("string"))
    found = by_digest.unionByName(by_name)
    return revisits.join(found, (F.col("refers_urn") == F.col("__urn")) & F.col("digest").eqNullSafe(F.col("__digest")), "left").drop("__urn", "__digest")


def joined_revisits(records: DataFrame) -> DataFrame:
    """records, a row each, with the length of each revisit taken from the response that it refers to."""
    return records.filter("type = 'response'").unionByName(_referred(records, "payload_bytes"))


def dedupe_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 1000, date: str | None = None) -> None:
    """Read the archives under source and write them anew under target, repeated payloads as revisits.

    Revisits of the source get the payload of the response that they refer to, and are resolved afresh; one
    whose response is not among the archives is written with an empty payload of its own digest. Records
    keep their dates; those without get `date` or the present time.
    """
    records = read_archives(spark, source, payloads=True)
    names = ["record_id", "uri", "date", "payload"]
    all_ = records.filter("type = 'response'").select(names).unionByName(_referred(records, "payload").select(names))
    write_archives(deduplicated(with_headers(all_, "record_id", "uri", "payload", "date"), min_bytes), target, date)


def round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 1000, path: str | None = None) -> DataFrame:
    """Write a record per row, repeated payloads as revisits, read the archives back, and report each record.

    Columns: id, payload_bytes, payload_digest, record_type, refers_to, uri. Null payloads are empty;
    rows that repeat an id and payload are reported each, all as the response if they have the largest
    id; rows that repeat an id with other payloads are records of their own. Null ids come back as null. Extra columns are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(deduplicated(with_headers(pages, id_col, uri_col, payload_col), min_bytes), path)
    out = joined_revisits(read_archives(spark, path))
    kind = pages.schema[id_col].dataType
    return out.select(
        F.col("record_id").cast(kind).alias(id_col),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
        "uri",
    )
