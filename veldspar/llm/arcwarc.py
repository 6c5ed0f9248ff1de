"""From legacy ARC archives to WARC.

An ARC file starts with a version block, which names the fields of all later header lines: five in version 1, ten in
version 2. Each record is such a line, the declared number of bytes, and a newline. The converter reads the version,
parses the lines by its fields, takes the declared bytes, and synthesises a WARC record: an identifier, a UTC
timestamp (missing parts of a short date are its first month, day or hour), a type and block and payload digests. The
type is response for an HTTP answer, revisit where an equal payload is archived already, and resource for other blocks.

``archived`` makes archives of a table of pages and reads them back; ``convert`` takes stored ``.arc`` and ``.arc.gz``
files. WARC files are written by Spark's text writer, whose line separator is the two line ends after a WARC record,
and read by Spark's text reader with the same separator: gzip files aren't split, so a task gets the parts of a file in
their order, puts them together again and parses them by the declared lengths. A task holds one record at a time, never
a file, so neither the size nor the number of a file's records is bounded. Compressed ARC files are read likewise;
plain ones come as one value each, and those above ``largest`` bytes raise an error (compress them).

Payloads of pages are the html in UTF-8, however long; a null html is empty, a null url is written as an empty one.
Of the records with equal payloads of ``least_bytes`` or more the smallest page_id's is the response and the others
revisit it; repeated rows of that page_id are responses too, and where all ids are null all are. Shorter payloads are
always responses. An empty table gives archives without records and an empty result; other columns aren't read. Of
stored ARC records with equal payloads the earliest is the response, ties to the file's name and the place in it. A
record that is shorter than it declares, a header line that isn't one, and an unknown version raise errors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.common import bounded_broadcast, new_path, pieces, written

# The header fields of the two ARC versions, and the record separator of WARC.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Pages carry no crawl date; records get this one.
DATE = "20200101000000"


def arc_file(name: str, version: int, records: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, block) records."""
    body = f"{version} 0 legacy\n{' '.join(FIELDS[version])}\n\n".encode()

    def line(url: str, ip: str, date: str, kind: str, offset: int, length: int) -> bytes:
        short = [url, ip, date, kind]
        return " ".join([*short, *([] if version == 1 else ["200", "-", "-", str(offset), name]), str(length)]).encode() + b"\n"

    out = [line(f"filedesc://{name}", "0.0.0.0", DATE, "text/plain", 0, len(body)), body, b"\n"]
    at = sum(map(len, out))
    for url, ip, date, kind, block in records:
        out += [line(url, ip, date, kind, at, len(block)), block, b"\n"]
        at += sum(map(len, out[-3:]))
    return b"".join(out)


class _Bytes:
    """The bytes of one file, which come in parts; only what isn't taken yet is held."""

    def __init__(self, parts: bytes | Iterable[bytes]):
        self.parts, self.held, self.taken = iter([parts] if isinstance(parts, bytes) else parts), bytearray(), 0

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is not None:
            self.held += part
        return part is not None

    def _cut(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        self.taken += n
        return out

    def at_record(self) -> bool:
        """Pass line ends; whether anything follows."""
        while True:
            n = len(self.held) - len(self.held.lstrip(b"\r\n"))
            self._cut(n)
            if self.held:
                return True
            if not self._more():
                return False

    def until(self, end: bytes) -> bytes:
        """The bytes before end, which is passed."""
        seen = 0
        while (at := self.held.find(end, seen)) < 0:
            seen = max(len(self.held) - len(end) + 1, 0)
            if not self._more():
                raise ValueError("a record's header has no end")
        return self._cut(at + len(end))[: -len(end)]

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError(f"a record declares {n} bytes and has {len(self.held)}")
        return self._cut(n)


def arc_records(data: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an ARC file but the version block."""
    source, fields, first = _Bytes(data), FIELDS[1], True
    while source.at_record():
        parts = source.until(b"\n").decode("utf-8", "replace").rstrip("\r").split(" ")
        block = source.take(int(parts[-1]))
        if first and parts[0].startswith("filedesc:"):  # the version block; later a url may begin so too
            first = False
            head = block.decode("utf-8", "replace").split("\n")
            version = int(head[0].split(" ")[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = head[1].split() or FIELDS[version]
            continue
        first = False
        if len(parts) > len(fields):  # spaces inside the url
            parts = [" ".join(parts[: len(parts) - len(fields) + 1]), *parts[len(parts) - len(fields) + 1 :]]
        yield dict(zip(fields, parts, strict=True)), block


def record_id(page_id: int | None, url: str) -> str:
    """A custom (version 8) UUID made of the page id, or of the url where there is none."""
    known = page_id is not None
    number = page_id & (1 << 64) - 1 if known else int.from_bytes(hashlib.sha256(url.encode("utf-8", "surrogatepass")).digest()[:8], "big")
    hi, lo = number >> 56, number & (1 << 56) - 1
    h = f"{0x76656C64 if known else 0x75726C73:08x}{0x7370:04x}8{hi:03x}{0x80:02x}{lo:014x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(identifier: str) -> int | None:
    h = identifier.strip("<>").removeprefix("urn:uuid:").replace("-", "")
    number = int(h[13:16], 16) << 56 | int(h[18:], 16)
    return None if (h[:12], h[16:18]) != (f"{0x76656C64:08x}7370", "80") else number - (1 << 64) if number >> 63 else number


def stored_id(file: str, position: int) -> str:
    """The identifier of a stored record: a name-based (version 8) UUID of its file's name and its number there."""
    h = hashlib.sha256(f"{file} {position}".encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def _payload(block: bytes) -> tuple[bytes, bytes]:
    """Head and payload of a block: those of an HTTP answer; other blocks are payload alone."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    found = re.search(rb"\r?\n\r?\n", block)
    return (block[: found.end()], block[found.end() :]) if found else (block, b"")


def timestamp(date: str) -> str:
    """An ARC date of 4 to 14 digits as a WARC date."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(fields: dict[str, str], block: bytes, identifier: str, original: str | None) -> bytes:
    """The WARC record of an ARC record, without the final line ends; original: the record that holds the payload."""
    head, payload = _payload(block)
    digest = hashlib.sha256(payload).hexdigest()
    revisit = original is not None and original != identifier
    kind = "revisit" if revisit else "response" if head else "resource"
    body = head if revisit else block
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {timestamp(fields['Archive-date'])}", f"WARC-Target-URI: {fields['URL']}", f"WARC-IP-Address: {fields['IP-address']}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}"]
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {original}"] if revisit else []
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else fields['Content-type']}", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + body


def warc_records(data: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    source = _Bytes(data)
    while source.at_record():
        head = source.until(END).decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in head[1:])
        yield fields, source.take(int(fields["Content-Length"]))


def _parts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, part): the gzip files under path, cut at every END, each file's parts in their order in one task."""
    lines = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", glob).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("part"))


def _files(batches: Iterator[pa.RecordBatch], end: bytes = END) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(file, its bytes in parts) of batches of (file, part)."""
    rows = ((f.as_py(), p.as_py() + end) for b in batches for f, p in zip(b.column(0), b.column(1), strict=True))
    for file, group in groupby(rows, lambda r: r[0]):
        yield file, (p for _, p in group)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 4 << 20, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows as batches; the bytes counted are those of a row's last value, where it has any."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if size >= most_bytes or len(held) >= most_rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def _response(page_id: int | None, payload: bytes) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", *([] if page_id is None else [f"X-Page-Id: {page_id}"]), f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + END + payload


def write_archives(pages: DataFrame, path: str, per_file: int = 4096, least_bytes: int = 100) -> None:
    """Pages -> ARC files of both versions in memory, a few megabytes each -> WARC files under path."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.unhex(F.sha2("html", 256))
    equal = written(rows.filter(F.octet_length("html") >= least_bytes).select("page_id", digest.alias("digest")).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("original")).filter("n > 1").select("digest", "original"), "equal-payloads")
    marked = rows.withColumn("digest", digest).join(bounded_broadcast(equal, 64), "digest", "left").select("page_id", "url", "html", F.when(F.octet_length("html") >= least_bytes, F.col("original")).alias("original"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in enumerate(pieces(batches, "html")):
            ids, urls, payloads, originals = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), part.column(3).to_pylist()
            version = 1 + number % 2
            arc = arc_file(f"pages-{number}.arc", version, [(re.sub(r"[\r\n]", "", u), "0.0.0.0", DATE, "text/html", _response(i, p)) for i, u, p in zip(ids, urls, payloads, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([to_warc(f, b, record_id(i, f["URL"]), None if o is None else record_id(o, "")) for (f, b), i, o in zip(arc_records(arc), ids, originals, strict=True)], pa.binary())], ["value"])

    _write(marked.mapInArrow(run, "value binary"), path, per_file)


def _write(records: DataFrame, path: str, per_file: int) -> None:
    """records: value, without the final line ends."""
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def convert(spark: SparkSession, path: str, out: str, per_file: int = 4096, least_bytes: int = 100, largest: int = 1 << 30) -> None:
    """Convert the stored ARC files under path (.arc.gz, .arc) into WARC files under out. They are parsed twice: for the
    digests of the payloads, and for the records."""
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc").load(path)
    above = plain.agg(F.max("length").alias("n")).first().n or 0
    if above > largest:
        raise ValueError(f"an ARC file of {above} bytes isn't compressed")

    def stored(columns: pa.Schema, row) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row(file.rsplit("/", 1)[-1], k, f, b) for file, parts in _files(batches) for k, (f, b) in enumerate(arc_records(parts)))
            yield from _batches(rows, columns)

        names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
        schema = ", ".join(f"`{c.name}` {names[c.type]}" for c in columns)
        compressed = _parts(spark, path, "*.arc.gz").mapInArrow(run, schema)
        return compressed.union(plain.select(F.col("path").alias("file"), F.col("content").alias("part")).mapInArrow(run, schema))

    def digest(block: bytes) -> bytes:
        return hashlib.sha256(_payload(block)[1]).digest()

    keys = stored(pa.schema([("file", pa.string()), ("position", pa.int64()), ("date", pa.string()), ("bytes", pa.int64()), ("digest", pa.binary())]), lambda file, k, f, b: (file, k, timestamp(f["Archive-date"]), len(_payload(b)[1]), digest(b)))
    equal = keys.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("date", "file", "position")).alias("first")).filter("n > 1")
    equal = written(equal.select("digest", F.col("first.file").alias("first_file"), F.col("first.position").alias("first_position")), "equal-payloads")

    def whole(file: str, k: int, f: dict[str, str], block: bytes) -> tuple:
        long = len(_payload(block)[1]) >= least_bytes
        return file, k, f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], digest(block) if long else b"", block

    columns = pa.schema([("file", pa.string()), ("position", pa.int64()), ("URL", pa.string()), ("IP-address", pa.string()), ("Archive-date", pa.string()), ("Content-type", pa.string()), ("digest", pa.binary()), ("block", pa.binary())])
    marked = stored(columns, whole).join(bounded_broadcast(equal, 128), "digest", "left").select(*[f"`{c}`" for c in columns.names if c != "digest"], "first_file", "first_position")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "block"):
            rows = part.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([to_warc(r, r["block"], stored_id(r["file"], r["position"]), None if r["first_file"] is None else stored_id(r["first_file"], r["first_position"])) for r in rows], pa.binary())], ["value"])

    _write(marked.mapInArrow(records, "value binary"), out, per_file)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, warc_date, payload_bytes, payload_digest, record_type, refers_to, record, refers_to_record) of the
    WARC files under path; page_id and refers_to are null where the identifier isn't that of a page, payload_bytes is
    null for a revisit whose head doesn't tell it."""
    schema = "page_id long, url string, warc_date string, payload_bytes long, payload_digest string, record_type string, refers_to long, record string, refers_to_record string"
    names = [x.split()[0] for x in schema.split(", ")]
    columns = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in names])

    def row(f: dict[str, str], block: bytes) -> tuple:
        head, payload = _payload(block)
        revisit, digest = f["WARC-Type"] == "revisit", f["WARC-Payload-Digest"].removeprefix("sha256:")
        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {f['WARC-Record-ID']} doesn't have its digest")
        told = re.search(rb"\nContent-Length: *(\d+)", head, re.I) if revisit else None
        size = int(told[1]) if told else None if revisit else len(payload)
        refers = f["WARC-Refers-To"] if revisit else None
        return page_of(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["WARC-Date"], size, digest, f["WARC-Type"], page_of(refers) if refers else None, f["WARC-Record-ID"], refers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((row(f, b) for _, parts in _files(batches) for f, b in warc_records(parts)), columns)

    return _parts(spark, path, "*.gz").mapInArrow(run, schema)


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages' WARC files into the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


def oracle() -> str:
    return """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM m"""
