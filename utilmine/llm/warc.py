"""WARC archives: monolithic gzip writer, normaliser with a sidecar offset index, indexed reader.

A monolithic archive is one gzip stream over many records, so no record can be reached without
inflating all before it. The normaliser inflates such a file once, front to back, holds one record
at a time, rewrites every record as a gzip member of its own and notes offset, length and identity
of each member in a sidecar index (``.idx``, one tab-separated line per record). Any record can then be
read by its offset alone.

While it rewrites, the normaliser turns records whose payload was seen elsewhere into ``revisit``
records (identical payload digest). Which record of a digest stays the response is a plain
aggregate over the small rows that the writer returns; payloads are never shuffled.

Edge cases: null html is an empty payload, which is a payload like any other; a null or blank url
leaves out the target header; control characters and spaces in urls are percent-encoded; a null
page id is read back as null and is the response of its digest only if no row with an id is; rows repeated in full are
records of their own, of which one is the response. An empty table yields no archive and no rows.
Columns other than the three named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilmine.llm.common import fresh_path, materialise, remove_path, spread

WRITTEN = "archive string, ordinal long, page_id long, payload_bytes long, payload_digest string"
NORMALISED = "archive string, index string, records long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_IO = 1 << 20


def file_system(uri: str):
    """(file system, path) of a shared folder, on whichever store it is."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, archive: str, ordinal: int) -> str:
    """The id of a page's record follows from the page id, so a revisit can name a response in another archive."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{ordinal}')}>"
    return f"<urn:uuid:{uuid.UUID(int=(1 << 64) | (page_id & (1 << 64) - 1))}>"


def page_of(identity: str) -> int | None:
    number = uuid.UUID(identity.strip("<>").removeprefix("urn:uuid:")).int
    if number >> 64 != 1:
        return None
    number &= (1 << 64) - 1
    return number - (1 << 64) if number >> 63 else number


def _clean_url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "")


def encode_record(kind: str, identity: str, url: str, digest: str, http: bytes, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identity}", f"WARC-Date: {date}"]
    if url:
        lines.append(f"WARC-Target-URI: {url}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return b"".join(("\r\n".join(lines).encode(), http, payload, b"\r\n\r\n"))


def decode_head(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def inflate(source, chunk: int = _IO) -> Iterator[bytes]:
    """A gzip file as bytes, one pass, whether it holds one member or many."""
    inflater = zlib.decompressobj(31)
    while data := source.read(chunk):
        while data:
            if inflater.eof:
                inflater = zlib.decompressobj(31)
            out = inflater.decompress(data, 8 * chunk)
            if out:
                yield out
            data = inflater.unconsumed_tail or (inflater.unused_data if inflater.eof else b"")
    if not inflater.eof and (rest := inflater.flush()):
        yield rest


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream; one record is in memory at a time."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record head")
                return
        head = decode_head(bytes(held[:end]))
        size = int(head["content-length"])
        start = end + 4
        while len(held) < start + size + 4:
            if not more():
                raise ValueError("the archive ends inside a record")
        block = bytes(held[start : start + size])
        del held[: start + size + 4]
        yield head, block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    end = block.find(b"\r\n\r\n") + 4
    return block[:end], block[end:]


def write_monolithic(pages: DataFrame, folder: str, id_col="page_id", url_col="url", html_col="html", max_bytes: int = 64 << 20, max_records: int = 50_000) -> DataFrame:
    """Write each partition as whole-file gzip archives; one row per record. A new file starts beyond a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        out, packer, name, size, count = None, None, "", 0, 0

        def close():
            if out is not None:
                out.write(packer.flush())
                out.close()

        for b in batches:
            rows = []
            for page, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if out is None or size >= max_bytes or count >= max_records:
                    close()
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(root, recursive=True)
                    out, packer = store.open_output_stream(f"{root}/{name}", compression=None, buffer_size=_IO), zlib.compressobj(1, zlib.DEFLATED, 31)
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                digest = digest_of(payload)
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                record = encode_record("response", record_id(page, name, count), _clean_url(url), digest, http, payload)
                out.write(packer.compress(record))
                rows.append((name, count, page, len(payload), digest))
                size, count = size + len(record), count + 1
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=["archive", "ordinal", "page_id", "payload_bytes", "payload_digest"])
        close()

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return spread(chosen).mapInArrow(run, WRITTEN)


def plan_revisits(written: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records that repeat a payload of at least ``min_bytes``: (archive, ordinal, first page id)."""
    large = written.where(F.col("payload_bytes") >= min_bytes)
    order = F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "archive", "ordinal")
    first = large.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = large.join(first, ["payload_digest", "payload_bytes"])
    return again.where(order != F.col("first")).select("archive", "ordinal", F.col("first.page_id").alias("response_id"), F.col("first.archive").alias("response_archive"), F.col("first.ordinal").alias("response_ordinal"))


#: Most tasks over archives.
MAX_TASKS = 100_000


def one_task_each(archives: DataFrame) -> DataFrame:
    """Archives are names to Spark but many megabytes to read, so they are dealt out by number, not by the size of their rows."""
    return archives.repartition(max(1, min(archives.count(), MAX_TASKS)))


def normalise(archives: DataFrame, revisits: DataFrame, folder: str, into: str, level: int = 6) -> DataFrame:
    """Rewrite each archive with a member per record and a sidecar index; one row per archive, one task per archive.

    ``archives`` has a row per archive; ``revisits`` is what ``plan_revisits`` gives. An archive's
    revisits go along with its name; the writer bounds how many records an archive has.
    """

    def rewrite(archive: str, revisits: list) -> tuple[str, str, int]:
        repeat = {x["ordinal"]: (x["response_id"], x["response_archive"], x["response_ordinal"]) for x in revisits or ()}
        source_fs, source_root = file_system(folder)
        store, root = file_system(into)
        store.create_dir(root, recursive=True)
        name, offset, lines = f"{uuid.uuid4().hex}.warc.gz", 0, []
        with source_fs.open_input_stream(f"{source_root}/{archive}", compression=None, buffer_size=_IO) as source, store.open_output_stream(f"{root}/{name}", compression=None, buffer_size=_IO) as out:
            for ordinal, (head, block) in enumerate(records(inflate(source))):
                http, payload = split_http(block)
                digest, kind, refers = digest_of(payload), head["warc-type"], None
                if ordinal in repeat:
                    kind, refers, payload = "revisit", record_id(*repeat[ordinal]), b""
                record = encode_record(kind, head["warc-record-id"], head.get("warc-target-uri", ""), digest, http, payload, refers, head["warc-date"])
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record) + packer.flush()
                out.write(member)
                lines.append(f"{offset}\t{len(member)}\t{kind}\t{head['warc-record-id']}\t{digest}\n")
                offset += len(member)
        with store.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
            index.write("".join(lines).encode())
        return name, f"{name}.idx", len(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, again in zip(b.column(0).to_pylist(), b.column(1)):
                columns = zip(rewrite(archive, again.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["archive", "index", "records"])

    listed = revisits.groupBy("archive").agg(F.collect_list(F.struct("ordinal", "response_id", "response_archive", "response_ordinal")).alias("revisits"))
    return one_task_each(materialise(archives.select("archive").join(listed, "archive", "left"), "warc-plan")).mapInArrow(run, NORMALISED)


def read_by_index(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record of normalised archives, each inflated alone from its offset, digests verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        store, root = file_system(folder)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)

        for b in batches:
            for archive in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{archive}.idx", compression=None) as index:
                    lines = index.read().decode().splitlines()
                with store.open_input_file(f"{root}/{archive}") as data:
                    for line in lines:
                        offset, size, *_ = line.split("\t")
                        member = zlib.decompress(data.read_at(int(size), int(offset)), 31)
                        (head, block), = records(iter([member]))
                        http, payload = split_http(block)
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        length = int(decode_head(http)["content-length"])
                        if head["warc-type"] == "response" and (len(payload) != length or digest_of(payload) != digest):
                            raise ValueError(f"{archive}: the payload at offset {offset} does not match its digest")
                        refers = head.get("warc-refers-to")
                        rows.append((page_of(head["warc-record-id"]), head.get("warc-target-uri"), length, digest, head["warc-type"], refers and page_of(refers), payload if payloads else None))
                        held += len(payload) * payloads + 200
                        if held > 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    return one_task_each(archives.select("archive")).mapInArrow(run, READ)


def round_trip(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write, normalise with revisits, and read back by offset; the monolithic files go in between."""
    spark = pages.sparkSession
    raw, final = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    written = materialise(write_monolithic(pages, raw, id_col, url_col, html_col), "warc-records")
    done = materialise(normalise(written.select("archive").distinct(), plan_revisits(written, min_bytes), raw, final), "warc-files")
    remove_path(spark, raw)
    return read_by_index(done, final, payloads)
