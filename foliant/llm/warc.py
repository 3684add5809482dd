"""WARC archives: writing, normalising whole-file gzip streams, reading by offset.

Spark's own text writer makes the monolithic archives: a record is a line that ends in the two line ends after a WARC record, and
a file is one gzip stream. The normaliser inflates each such stream once, from start to end in one pass, finds records by their
Content-Length, writes every record as a gzip member of its own, and returns the sidecar index: file, offset and length of each
member. Readers then fetch members by the index, in any order and on any machine.
"""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.files import attempt_name, new_folder, open_place

END = "\r\n\r\n"
#: Level of the members; a higher one costs more time than it saves space.
LEVEL = 2
OUT_BYTES = 4 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "archive string, offset long, length long, record_id string, record_type string, target_uri string, payload_digest string"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in base 32: eight groups of five hexadecimal digits, four letters each."""
    def letters(digest: Column) -> Column:
        found = []
        for group in range(8):
            bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
            found += [F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
        return F.concat(*found)

    # A one-element transform binds the digest, which would else be computed for every letter.
    return F.get(F.transform(F.array(F.sha1(payload)), letters), F.lit(0))


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, first): first is the smallest page_id with the same payload, null
    for payloads under ``least_bytes``. A null html is an empty payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload")), "_same": F.sha2("payload", 256)})
    # Only payloads that occur again are looked up. One of them may hold a third of all pages: its rows are counted inside tasks
    # first, and an adaptive join splits them.
    again = rows.groupBy("_same").agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    found = rows.join(again, "_same", "left").drop("_same")
    own = F.coalesce("first", "page_id")
    return found.withColumn("first", F.when(F.col("payload_bytes") >= least_bytes, own))


def record_text(rows: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: the record of every row of ``with_revisits`` without its closing line ends.

    A response holds an HTTP head and the payload; a revisit the head alone, with the digest and length of the payload it
    stands for. A null url becomes the name of the page; white space and control characters in a url are cut out.
    """
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    url = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))), r"[\x00-\x20\x7f]", "")
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                 line("WARC-Refers-To", name(F.col("first"))))).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")), line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), (F.octet_length("_head") + F.octet_length("_body")).cast("string"), F.lit(END))
    return rows.withColumns({"_head": head, "_body": body}).select(F.concat(header, "_head", "_body").alias("value"))


def write_monolithic(records: DataFrame, folder: str) -> None:
    """Archives of one gzip stream each, one per partition."""
    records.write.option("compression", "gzip").option("lineSep", END).text(folder)


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    fields = {}
    for text in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = text.partition(":")
        fields[key.strip().lower()] = value.strip()
    return fields


class Records:
    """Cuts a stream of bytes into WARC records by their Content-Length."""

    def __init__(self) -> None:
        self.buffer, self.need = bytearray(), 0

    def feed(self, data: bytes) -> list[bytes]:
        self.buffer += data
        found, at, end = [], 0, END.encode()
        while True:
            if len(self.buffer) - at < self.need:  # nothing to look for before so much is there
                break
            while self.buffer[at:at + 2] == b"\r\n":
                at += 2
            head = self.buffer.find(end, at)
            if head < 0:
                self.need = 0
                break
            start = bytes(self.buffer[at:head])
            if not start.startswith(b"WARC/"):
                raise ValueError(f"no WARC record where one should begin: {start[:60]!r}")
            whole = head + 4 + int(parse_head(start)["content-length"]) - at
            if len(self.buffer) - at < whole:
                self.need = whole
                break
            found.append(bytes(self.buffer[at:at + whole]))
            at += whole
            self.need = 0
        del self.buffer[:at]
        return found

    def close(self) -> None:
        if self.buffer.strip(b"\r\n"):
            raise ValueError("the stream ends inside a record")


def normalise(spark: SparkSession, monolithic: str, folder: str) -> DataFrame:
    """Rewrites the archives under ``monolithic`` record by record into ``folder`` and returns the sidecar index, which is also
    written there. A stream cannot be entered in the middle, so one task reads a whole file, but only a few records of it at a
    time. An archive without records gives no rows; a stream that breaks off inside a record is an error."""
    lines = spark.read.option("lineSep", END).text(monolithic).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").cast("binary").alias("value"))

    def rewrite(batches):
        place, path = open_place(folder)
        source = out = records = name = None
        offset, rows = 0, []

        def pack(found):
            nonlocal offset
            for record in found:
                head = parse_head(record[:record.find(b"\r\n\r\n")])
                member = gzip.compress(record + b"\r\n\r\n", LEVEL, mtime=0)
                out.write(member)
                rows.append((f"{folder}/{name}", offset, len(member), head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"),
                             head.get("warc-payload-digest")))
                offset += len(member)

        def drain():
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in INDEX.split(", ")])
            rows.clear()
            return batch

        for batch in batches:
            for file, value in zip(batch.column("source").to_pylist(), batch.column("value")):
                if file != source:
                    if out:
                        records.close()
                        out.close()
                    source, records, offset = file, Records(), 0
                    name = attempt_name(file.rsplit("/", 1)[-1].split(".")[0], ".warc.gz")
                    out = place.open_output_stream(f"{path}/{name}", compression=None)
                pack(records.feed(value.as_py() + b"\r\n\r\n"))
            yield drain()
        if out:
            records.close()
            out.close()
        yield drain()

    # The folder must be there before tasks write to it; on stores without folders this does nothing.
    place, path = open_place(folder)
    place.create_dir(path, recursive=True)
    index = lines.mapInArrow(rewrite, INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame) -> DataFrame:
    """The records an index names: their fields and payload (null for a revisit). Each task reads the members of its rows."""
    wanted = index.select("archive", "offset", "length")

    def fetch(batches):
        name = source = None
        rows, size = [], 0

        def drain():
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [*[pa.string()] * 5, pa.int64(), pa.binary()]
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in RECORD.split(", ")])
            rows.clear()
            return batch

        for batch in batches:
            for archive, offset, length in zip(*[batch.column(c).to_pylist() for c in ("archive", "offset", "length")]):
                if archive != name:
                    if source:
                        source.close()
                    folder, _, file = archive.rpartition("/")
                    place, path = open_place(folder)
                    name, source = archive, place.open_input_file(f"{path}/{file}")
                record = zlib.decompress(source.read_at(length, offset), 31)
                end = record.find(b"\r\n\r\n")
                head = parse_head(record[:end])
                block = record[end + 4:end + 4 + int(head["content-length"])]
                payload = None if head["warc-type"] == "revisit" else block[block.find(b"\r\n\r\n") + 4:]
                rows.append((head.get("warc-record-id"), head["warc-type"], head.get("warc-target-uri"), head.get("warc-refers-to"),
                             head.get("warc-payload-digest", "").removeprefix("sha1:"), int(head.get("x-payload-length", -1)), payload))
                size += len(record)
                if size > OUT_BYTES:
                    yield drain()
                    size = 0
        if source:
            source.close()
        yield drain()

    return wanted.mapInArrow(fetch, RECORD)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes a record per page, normalises the archives and returns the sidecar index.

    A null html is an empty payload and a null url the name of the page. Of pages with equal payloads of at least
    ``least_bytes`` bytes, those with the smallest page_id are responses (repeated rows of it all are), the others revisit it; a null page_id is
    never the smallest, and pages without any id are all responses. An empty table gives an empty index; other columns are not read.
    """
    spark = pages.sparkSession
    monolithic, folder = new_folder(spark, "warc-monolithic"), new_folder(spark, "warc")
    write_monolithic(record_text(with_revisits(pages, least_bytes)), monolithic)
    return normalise(spark, monolithic, folder)


def page_of(name: Column) -> Column:
    """The page_id in a record's name."""
    return F.regexp_extract(name, r"x-page:(-?\d+)>", 1).try_cast("long")
