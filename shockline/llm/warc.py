"""WARC records in ZIP packages: written from pages, read back by range.

A package (WACZ) holds ``archive/data.warc.gz``, each record a gzip member of
its own, and ``indexes/index.cdxj``, a line per record that says where it lies;
both are stored.  Equal payloads are written once; the other records revisit it.

Packages are files.  A reader opens one, reads its end, its directory and its
indexes, and then, spread over the cluster, the ranges of the records alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockline.llm.shared import cut, shared_dir
from shockline.llm.zipread import BadPackage, Package, build

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
#: Letters of a CDX header for the fields that are read.
CDX_FIELDS = {"V": "offset", "S": "length", "g": "filename"}
MANY = 100_000


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a file named by a URI (file, hdfs, s3, gs and others that Arrow knows) or a local path."""
    if m := re.match("file:/*", uri):
        return pafs.LocalFileSystem(), "/" + uri[m.end() :]
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    """A record id from which the page_id can be read again."""
    return f"urn:page:{'none' if page_id is None else page_id}"


def page_of(urn: str | None) -> int | None:
    """page_id of a record id; null if it is that of a record without one, or not one of ours."""
    m = re.fullmatch(r"<?urn:page:(-?[0-9]+)>?", urn or "")
    return int(m[1]) if m else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}"]
    head.append("WARC-Target-URI: " + " ".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{record_id(refers_to)}>")
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def fields(lines: list[bytes]) -> dict[str, str]:
    """Header lines by name in lower case."""
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, which may be a gzip member."""
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = zlib.decompress(raw, wbits=31)
        except zlib.error as e:
            raise BadPackage("a record is no gzip member") from e
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/"):
        raise BadPackage("not a WARC record")
    headers = fields(lines[1:])
    n = headers.get("content-length", "")
    if not n.isdecimal() or len(rest) < int(n) or rest[int(n) :] not in (b"\r\n\r\n", b"\r\n", b""):
        raise BadPackage("a record's length is wrong")
    return headers, rest[: int(n)]


def located(lines: Iterator[str]) -> Iterator[tuple[str | None, int, int]]:
    """(archive name, offset, length) of the lines of an index: CDXJ, or CDX with a header line."""
    names: list[str] | None = None
    for line in lines:
        try:
            if line.startswith((" CDX", "CDX ")):
                names = [CDX_FIELDS.get(x, x) for x in line.split()[1:]]
            elif line.strip() and not line.startswith("!"):
                told = dict(zip(names, line.split(), strict=False)) if names else json.loads(line[line.index("{") :])
                yield told.get("filename"), int(told["offset"]), int(told["length"])
        except (KeyError, ValueError, AttributeError, TypeError) as e:
            raise BadPackage(f"a line of an index can't be read: {line[:100]}") from e


def ranges(package: Package) -> Iterator[tuple[int, int]]:
    """Where the records of a package lie in its file, in the order of its indexes."""
    archives = [m for m in package.members if m.startswith("archive/") and not m.endswith("/")]
    indexes = [m for m in package.members if re.match(r"indexes/.*\.cdxj?(\.gz)?$", m)]
    if not indexes:
        raise BadPackage("no index")
    begins = {m: package.range(m) for m in archives}
    for name in sorted(indexes):
        for archive, offset, length in located(package.lines(name)):
            member = f"archive/{archive}" if archive else archives[0] if len(archives) == 1 else ""
            begin, size = begins.get(member, (0, -1))
            if not 0 <= offset <= offset + length <= size:
                raise BadPackage(f"a record lies outside of {member or 'the archives'}")
            yield begin + offset, length


def decide(pages: DataFrame, least_bytes: int = 0, many: int = MANY) -> DataFrame:
    """page_id, url, html, digest (hex), payload_bytes, response_id: the largest page_id of those with an equal payload, null if it has no equal.

    Equal payloads are found by digests alone.  Those that occur more than once
    are broadcast up to ``many``; beyond that they and the pages meet by digest
    and one of 16 parts of the pages, so a very common payload isn't one task's.
    """
    digest, size = F.sha1(F.coalesce("html", F.lit("")).cast("binary")), F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    light = pages.select("page_id", digest.alias("digest"), size.alias("payload_bytes"))
    best = light.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    best = cut(best.where("n > 1").drop("n"))
    full = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), digest.alias("digest"), size.alias("payload_bytes"))
    if best.count() <= many:
        return full.join(F.broadcast(best), "digest", "left")
    parts = 16
    best = best.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return full.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(parts)).cast("int")).join(best, ["digest", "part"], "left").drop("part")


def write_packages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, package_bytes: int = 8 << 20, zip64: bool = False) -> DataFrame:
    """uri, size: ZIP packages of about ``package_bytes`` with a record per row of pages, files in a new folder of the
    shared one, or in ``folder``.

    Of rows with equal payloads of at least ``least_bytes`` that with the
    largest page_id is the response and the others revisit it.  Rows that repeat
    that page_id with that payload are responses too; null ids are smaller than
    all others.  A null html is the empty payload, a null url the empty one.
    A task that is run again writes other files; only those named in the result
    count.  An empty table gives no packages.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/packages-{uuid.uuid4().hex}"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = store(folder)
        files.create_dir(place, recursive=True)
        data, index = bytearray(), []

        def package() -> pa.RecordBatch:
            body = build([(INDEX, "".join(sorted(index)).encode()), (DATA, bytes(data))], zip64)
            name = f"{uuid.uuid4().hex}.wacz"
            with files.open_output_stream(f"{place}/{name}") as out:
                out.write(body)
            data.clear()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(body)])], ["uri", "size"])

        for batch in batches:
            ids, urls, best, hexes, sizes = (batch.column(c).to_pylist() for c in ("page_id", "url", "response_id", "digest", "payload_bytes"))
            html = batch.column("html")
            for k, page_id in enumerate(ids):
                revisit = best[k] is not None and page_id != best[k]
                payload = b"" if revisit else html[k].as_py().encode()
                digest = base64.b32encode(bytes.fromhex(hexes[k])).decode()
                raw = record(page_id, urls[k], payload, digest, sizes[k], best[k], revisit)
                pack = zlib.compressobj(1, wbits=31)
                body = pack.compress(raw) + pack.flush()
                told = {"url": urls[k], "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": f"sha1:{digest}", "length": str(len(body)), "offset": str(len(data)), "filename": DATA.removeprefix("archive/")}
                index.append(f"{'+'.join(urls[k].lower().split()) or '-'} {re.sub('[^0-9]', '', DATE)} {json.dumps(told)}\n")
                data += body
                if len(data) >= package_bytes:
                    yield package()
        if index:
            yield package()

    return cut(decide(pages, least_bytes).mapInArrow(mapped, "uri string, size long"))


RECORDS = "page_id long, record_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload string"


def told(raw: bytes, payloads: bool) -> tuple:
    """The columns RECORDS of a record."""
    headers, block = parse(raw)
    kind, digest, n = headers.get("warc-type", ""), headers.get("warc-payload-digest"), None
    http = "application/http" in headers.get("content-type", "")
    head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    if kind == "revisit":
        size = fields(head.split(b"\r\n")[1:]).get("content-length", "")
        n = int(size) if size.isdecimal() else None
    else:
        n, own = len(payload), base32_sha1(payload)
        if kind == "response" and digest and digest.startswith("sha1:") and digest.removeprefix("sha1:").upper() != own:
            raise BadPackage("a payload differs from its digest")
        digest = digest or own
    text = payload.decode("utf-8", "replace") if payloads and kind != "revisit" else None
    refers = page_of(headers.get("warc-refers-to")) if kind == "revisit" else None
    return page_of(headers.get("warc-record-id")), headers.get("warc-record-id", "").strip("<>"), headers.get("warc-target-uri"), kind, digest and digest.removeprefix("sha1:"), n, refers, text


def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of RECORDS as batches of bounded size."""
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], [c.split()[0] for c in RECORDS.split(", ")])
    for row in rows:
        held.append(row)
        size += len(row[-1] or "")
        if size >= 4 << 20 or len(held) >= 10_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def read_packages(packages: DataFrame, payloads: bool = True, spread: int = 8 << 20, ahead: int = 1 << 20) -> DataFrame:
    """The records of packages (a column ``uri``), columns RECORDS.

    One step reads each package's end, directory and indexes, which say where
    its records lie; those ranges are dealt out, about ``spread`` bytes of a
    package to a task, and read by seeking, neighbours together up to ``ahead``
    bytes.  A response's digest is checked against its payload; a broken package
    is an error.  ``payload`` is null for revisits, and for all records if
    ``payloads`` is false.  Records of other writers have a null page_id.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, place = store(uri)
                with files.open_input_file(place) as file:
                    rows: list[tuple[int, int]] = []
                    for row in ranges(Package.at(file)):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield located_batch(uri, rows)
                            rows = []
                    if rows:
                        yield located_batch(uri, rows)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        uri, file, body, at = None, None, b"", 0
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("uri", "begin", "length")), strict=True))
            for k, (name, begin, length) in enumerate(rows):
                if name != uri:
                    if file is not None:
                        file.close()
                    files, place = store(name)
                    uri, file, body = name, files.open_input_file(place), b""
                if not at <= begin <= begin + length <= at + len(body):
                    end = begin + length
                    for other, b, n in rows[k + 1 :]:
                        if other != uri or b != end or b + n - begin > ahead:
                            break
                        end += n
                    at, body = begin, file.read_at(end - begin, begin)
                yield told(body[begin - at : begin - at + length], payloads)
        if file is not None:
            file.close()

    found = packages.select("uri").mapInArrow(find, "uri string, begin long, length long")
    dealt = found.withColumn("share", F.floor(F.col("begin") / spread)).repartition("uri", "share").drop("share").sortWithinPartitions("uri", "begin")
    return dealt.mapInArrow(lambda batches: batches_of(records(batches)), RECORDS)


def located_batch(uri: str, rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([uri] * len(rows)), pa.array([b for b, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], ["uri", "begin", "length"])


def read_contents(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """The same of small packages (a column ``content``, as spark.read.format("binaryFile") gives) in a store that only Spark reads."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column(0):
                package = Package.of(content.as_py())
                for begin, length in ranges(package):
                    yield told(package.read(begin, length), payloads)

    return packages.select("content").mapInArrow(lambda batches: batches_of(records(batches)), RECORDS)


def digest(pages: DataFrame) -> DataFrame:
    """The result of op8: what the archives say of each page."""
    found = read_packages(write_packages(pages, least_bytes=0), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of SHA-1 from its hex: 40 hex digits are 160 bits, 32 groups of 5.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
b AS (SELECT *, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', h[i]) - 1), 4, '0')), lambda x, y: x || y) AS bits,
    max(page_id) OVER (PARTITION BY h) AS best FROM d)
SELECT page_id, payload_bytes,
    list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_reduce(list_transform(range(1, 6), lambda k: CAST(bits[5 * i + k] AS INTEGER)), lambda x, y: 2 * x + y) AS INTEGER), 1)), lambda x, y: x || y) AS payload_digest,
    CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM b
"""
