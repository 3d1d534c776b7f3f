"""WARC archives: pages written as records, long ones in segments, and read back by segment reassembly.

Writing: one response record per page, its payload in chunked transfer framing. Records over SEGMENT bytes are split
into a first record and continuation records. Of equal payloads of MIN_REVISIT bytes and more only one is
stored; the others become revisit records that refer to it. Reading: continuation records are grouped by their
origin's identifier, put in order by segment number, checked against the total length and freed of chunk framing.

Defined cases: null payloads count as empty; null ids come after all others and stay null; of repeated rows with one
id and equal payloads the first by its place in the source is the response; an empty table gives an empty result; a missing
or doubled segment, a wrong total length or broken framing raises ValueError.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import located, materialise, new_path, small_enough

SEGMENT, CHUNK, MIN_REVISIT = 16_384, 4096, 100
RECORDS_PER_FILE = 2048
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"])).encode() + END + block


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c := payload[i : i + size]), c) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:line].partition(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("no HTTP header")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record_id(place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"


def page_records(page: str | None, url: str | None, payload: bytes, digest: str, own: str, origin: str | None, segment: int) -> Iterator[bytes]:
    """The records of one page; origin: the place of the response that it revisits."""
    uri = (url or "").encode("unicode_escape").decode().replace(" ", "%20") or None
    common = {"WARC-Record-ID": record_id(own), "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-ID": page}
    if origin is not None:
        yield record({"WARC-Type": "revisit", **common, "WARC-Refers-To": record_id(origin), "WARC-Profile": SAME, "Content-Type": "application/http; msgtype=response"}, HTTP + END)
        return
    block = HTTP + END + chunked(payload)
    common = {"WARC-Type": "response", **common, "Content-Type": "application/http; msgtype=response"}
    if len(block) <= segment:
        yield record(common, block)
        return
    for number, at in enumerate(range(0, len(block), segment), 1):
        part = block[at : at + segment]
        total = str(len(block)) if at + segment >= len(block) else None
        if number == 1:
            yield record({**common, "WARC-Segment-Number": "1"}, part)
        else:
            yield record({"WARC-Type": "continuation", "WARC-Record-ID": record_id(f"{own}#{number}"), "WARC-Date": common["WARC-Date"], "WARC-Segment-Origin-ID": common["WARC-Record-ID"], "WARC-Segment-Number": str(number), "WARC-Segment-Total-Length": total}, part)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        head = data.find(END, at)
        if head < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) for line in data[at:head].decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        start = head + 4
        at = start + int(fields["content-length"])
        if data[at : at + 4] != END:
            raise ValueError(f"record not closed at {at}")
        yield fields, data[start:at]
        at += 4


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT) -> None:
    """Gzipped archives under path, at most RECORDS_PER_FILE records each."""
    pages = located(pages)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(payload, "UTF-8").alias("payload"), F.sha2(payload, 256).alias("digest"), place.alias("place"))
    keys = rows.select("digest", F.octet_length("payload").alias("size"), F.struct(F.col("id").isNull().alias("none"), "id", "place").alias("at"))
    # Only digests that occur more than once need a decision; they are few or else shuffled.
    groups = keys.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = materialise(groups.select("digest", F.col("first.place").alias("origin")), "revisits")
    side = F.broadcast(groups) if small_enough(groups, 300) else groups.hint("merge")
    decided = rows.join(side, "digest", "left").select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", "place", F.when(F.col("origin") != F.col("place"), F.col("origin")).alias("origin"))
    arrow = to_arrow_schema(StructType.fromDDL("value binary"))

    def run(batches):
        for batch in batches:
            columns = [batch.column(k) for k in range(6)]
            out, size = [], 0
            for row in zip(*columns, strict=True):
                page, url, payload, digest, own, origin = (x.as_py() for x in row)
                for r in page_records(page, url, payload, digest, own, origin, segment):
                    out.append(r)
                    size += len(r)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pydict({"value": out}, schema=arrow)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"value": out}, schema=arrow)

    records = decided.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every response and revisit record."""
    more = ", payload binary" * with_payload
    whole = "record string, type string, page string, refers string, digest string, size bigint" + more
    raw = whole + ", origin string, number int, total bigint, block binary"

    raw_arrow, whole_arrow = to_arrow_schema(StructType.fromDDL(raw)), to_arrow_schema(StructType.fromDDL(whole))

    def decoded(block: bytes, claimed: str | None) -> tuple:
        payload = payload_of(block)
        digest = hashlib.sha256(payload).hexdigest()
        if claimed and claimed != f"sha256:{digest}":
            raise ValueError(f"payload digest {digest} instead of {claimed}")
        return (digest, len(payload), *([payload] if with_payload else []))

    def scan(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse(gzip.decompress(content.as_py())):
                    number, claimed = h.get("warc-segment-number"), h.get("warc-payload-digest")
                    row = {"record": h["warc-record-id"], "type": h["warc-type"], "page": h.get("x-page-id"), "refers": h.get("warc-refers-to"), "digest": claimed}
                    if number:
                        total = h.get("warc-segment-total-length")
                        row |= {"origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "number": int(number), "total": int(total) if total else None, "block": block}
                    elif h["warc-type"] == "response":
                        row |= dict(zip(("digest", "size", "payload"), decoded(block, claimed), strict=False))
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=raw_arrow)

    def assemble(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                parts = row["parts"]
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError(f"segments missing or doubled: {row['record']}")
                block = b"".join([p["block"] for p in parts])
                if row["total"] != len(block):
                    raise ValueError(f"total length {row['total']} instead of {len(block)}: {row['record']}")
                got = dict(zip(("digest", "size", "payload"), decoded(block, row["digest"]), strict=False))
                rows.append({"record": row["record"], "type": "response", "page": row["page"], "refers": None} | got)
            yield pa.RecordBatch.from_pylist(rows, schema=whole_arrow)

    records = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(scan, raw)
    # Records as read, so that the archives are parsed once.
    records = materialise(records, "records")
    columns = whole.replace(",", "").split()[::2]
    segments = records.filter("number IS NOT NULL").groupBy(F.col("origin").alias("record")).agg(
        F.max("page").alias("page"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts")
    )
    responses = records.filter("number IS NULL AND type = 'response'").select(columns).unionByName(segments.mapInArrow(assemble, whole))
    responses = materialise(responses, "responses")
    last = [F.col("payload")] if with_payload else []
    plain = responses.select(F.col("page").cast(id_type).alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast(id_type).alias("refers_to"), *last)
    visits = records.filter("type = 'revisit'").select("page", "refers", F.substring_index("digest", ":", -1).alias("claimed"))
    joined = visits.join(responses.select(F.col("record").alias("refers"), F.col("page").alias("target"), "digest", "size", *last).hint("merge"), "refers", "left")
    again = joined.select(F.col("page").cast(id_type).alias("page_id"), F.col("size").alias("payload_bytes"), F.coalesce("digest", "claimed").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("target").cast(id_type).alias("refers_to"), *last)
    return plain.unionByName(again)


def round_trip(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, id_col)
    return read_archives(spark, path, pages.schema[id_col].dataType.simpleString())
