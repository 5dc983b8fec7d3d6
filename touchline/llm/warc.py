"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Archives are gzip files of one member per record, rolled at a size bound. The reader checks each member's checksum, its
version line, its lengths and its block digest. Where a check fails it looks for the next gzip member that opens with a
version line (in an uncompressed file: the next version line), goes on from there, and logs the bytes in between. A
member may hold several records; of a damaged one the records before the damage are kept.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import materialise, shared_dir

_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_EARLY = "gzip: member ends early"
_CHUNK = 1 << 16
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry one fixed date: archives of the same pages are then the same bytes, and a task run again writes the same.
_DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT = 100

PLAN = "page_id long, url string, payload binary, digest string, revisit boolean, refers_to long"
RECORD = (
    "path string, start long, length long, kind string, page_id long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary, reason string"
)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit's block is empty; its payload is the one of the record it refers to."""
    block = b"" if revisit else payload
    head = {
        "WARC-Type": "revisit" if revisit else "resource" if url is None else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": _DATE,
        "WARC-Target-URI": None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Profile": _REVISIT if revisit else None,
        "WARC-Refers-To": record_id(refers_to) if revisit else None,
        "X-Page-Id": None if page_id is None else str(page_id),
        "X-Refers-To-Page-Id": str(refers_to) if revisit else None,
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def plan_records(pages: DataFrame) -> DataFrame:
    """Which page is a response and which a revisit: equal payloads of MIN_REVISIT bytes or more refer to the least page_id.

    Null html is an empty payload. Rows that repeat a page_id are records of their own; of equal payloads with the least
    page_id all are responses. Payloads without any page_id are all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= MIN_REVISIT)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").drop("n")
    groups = materialise(groups, "repeats")
    joined = rows.join(groups, "digest", "left")
    revisit = F.coalesce(F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least")), F.lit(False))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", revisit.alias("revisit"),
        F.when(revisit, F.col("least")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, max_bytes: int = 16 << 20) -> DataFrame:
    """Write plan_records() rows as .warc.gz files of at most about max_bytes; (path, records, bytes) of each file.

    A file gets its name once it is complete, and its name and bytes follow from the task's rows, so a task that runs
    again after a loss leaves the same file. folder is a URI that pyarrow's file systems reach from every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        held, size, done = [], 0, []

        def flush() -> None:
            nonlocal held, size
            if held:
                body = b"".join(held)
                path = f"{base}/{hashlib.sha256(body).hexdigest()[:32]}.warc.gz"
                draft = f"{path}.{uuid.uuid4().hex}.draft"
                with files.open_output_stream(draft, compression=None) as out:
                    out.write(body)
                files.move(draft, path)
                done.append((path.rsplit("/", 1)[1], len(held), size))
                held, size = [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, payload, digest, revisit, refers_to = row
                held.append(_member(encode_record(page_id, url, payload or b"", digest, refers_to, revisit)))
                size += len(held[-1])
                if size >= max_bytes:
                    flush()
        flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "bytes"])

    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    columns = [c.split()[0] for c in PLAN.split(", ")]
    return materialise(records.select(*columns).mapInArrow(run, "path string, records long, bytes long"), "archives")


def _digest_holds(said: str, block: bytes) -> bool | None:
    """Whether a block has the digest that its header states; None if it states none of a known kind."""
    kind, _, value = said.partition(":")
    if kind.lower() not in ("sha256", "sha1"):
        return None
    found = hashlib.new(kind.lower(), block).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def _parse(data: bytes, at: int, proven: bool = False) -> tuple[dict | None, bytes, int, str | None]:
    """(headers, block, end, what is wrong) of a record that begins at a place; proven: only with a block digest that holds."""
    if not data.startswith(_VERSION, at):
        return None, b"", at, "no version line"
    # Headers end before the next version line; no search goes on beyond it, so many broken ones in a row cost no more than one.
    limit = data.find(b"\r\n" + _VERSION, at + 1)
    end = data.find(b"\r\n\r\n", at, limit + 2 if limit >= 0 else len(data))
    if end < 0:
        return None, b"", at, "no end of headers"
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        length = int(head["content-length"])
    except (KeyError, ValueError):
        return None, b"", at, "no content length"
    block = data[end + 4 : end + 4 + length] if length >= 0 else b""
    if length < 0 or len(block) < length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
        return None, b"", at, "block and content length differ"
    holds = _digest_holds(head.get("warc-block-digest", ""), block)
    if holds is False or (proven and not holds):
        return None, b"", at, "no block digest" if holds is None else "block digest differs"
    return head, block, end + 8 + length, None


def _records(data: bytes, proven: bool = False) -> Iterator[tuple[int, int, dict | None, bytes, str | None]]:
    """(start, end, headers, block, reason) of the records in plain bytes, and of the gaps between them."""
    at, gap, why = 0, None, None
    while at < len(data):
        head, block, end, wrong = _parse(data, at, proven)
        if wrong:
            gap, why = (at, wrong) if gap is None else (gap, why)
            at = data.find(b"\r\n" + _VERSION, at + 1)
            at = len(data) if at < 0 else at + 2
            continue
        if gap is not None:
            yield gap, at, None, b"", why
            gap = None
        yield at, end, head, block, None
        at = end
    if gap is not None:
        yield gap, len(data), None, b"", why


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """(content, end, what is wrong) of the gzip member at a place; zlib checks its CRC-32 and length.

    Of a damaged member the content is what inflates before the damage.
    """
    z, view, pos, step, parts = zlib.decompressobj(31), memoryview(data), at, 2048, []
    try:
        while not z.eof and pos < len(data):
            # Small members end in a short chunk, so that zlib copies little of what follows them.
            parts.append(z.decompress(view[pos : pos + step]))
            pos, step = pos + step, min(2 * step, _CHUNK)
    except zlib.error as e:
        again = zlib.decompressobj(31)
        again.decompress(view[at:pos])
        try:
            for i in range(pos, min(pos + step, len(data))):
                parts.append(again.decompress(view[i : i + 1]))
        except zlib.error:
            pass
        return b"".join(parts), at, f"gzip: {str(e).split(':')[0]}"
    if not z.eof:
        return b"".join(parts), at, _EARLY
    return b"".join(parts), min(pos, len(data)) - len(z.unused_data), None


def _opens_record(data: bytes, at: int) -> bool:
    """Whether a gzip member that opens with a version line starts at a place; cheap, without reading it to its end."""
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 4096], len(_VERSION)).startswith(_VERSION)
    except zlib.error:
        return False


def _next_member(data: bytes, at: int) -> int:
    """The first place from `at` on where a gzip member opens with a version line; the end if there is none."""
    at = data.find(_MAGIC, at)
    while at >= 0 and not _opens_record(data, at):
        at = data.find(_MAGIC, at + 1)
    return len(data) if at < 0 else at


def _is_zipped(data: bytes) -> bool:
    """Whether a file is one of gzip members, whatever its first bytes have become: a member opens before any plain version line."""
    if data.startswith((_MAGIC, _VERSION)):
        return data.startswith(_MAGIC)
    plain = data.find(b"\r\n" + _VERSION)
    member = _next_member(data, 0)
    return member < (len(data) if plain < 0 else plain)


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, bytes, str | None]]:
    """(start, length, headers, block, reason): records in order, and gaps with null headers and the failed check.

    Places are those in the file; in a gzip file a record, and a gap inside a member, has the place of its member. A
    member that fails its CRC gives the records whose block digest holds, one that ends early those that end before, and
    both are logged as a gap too.
    """
    if not _is_zipped(data):
        for start, end, head, block, why in _records(data):
            yield start, end - start, head, block, why
        return
    at, gap, why = 0, None, None
    while at < len(data):
        body, end, wrong = _inflate(data, at) if data.startswith(_MAGIC, at) else (b"", at, "no gzip member")
        found = list(_records(body, proven=bool(wrong) and wrong != _EARLY))
        whole = any(head is not None for _, _, head, _, _ in found)
        if wrong:
            end = _next_member(data, at + 1)
        if whole:
            if gap is not None:
                yield gap, at - gap, None, b"", why
                gap = None
            for _, _, head, block, reason in found:
                if head is not None or not wrong:
                    yield at, end - at, head, block, reason
        if wrong or not whole:
            reason = wrong or (found[0][4] if found else "empty member")
            gap, why = (at, reason) if gap is None else (gap, why)
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, b"", why


def read_archives(files: DataFrame, keep_payload: bool = True) -> DataFrame:
    """RECORD rows of archive files (path, content), kind `record` or `gap`; a gap row has its place and reason.

    payload_bytes and payload_digest are measured on a response's block; a revisit has the digest its header states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[c.split()[1]] for c in RECORD.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for start, length, head, block, reason in salvage(content.as_buffer().to_pybytes()):
                    if head is None:
                        rows.append((path, start, length, "gap", *[None] * 7, reason))
                        continue
                    number = lambda name, head=head: int(head[name]) if head.get(name, "").lstrip("-").isdigit() else None
                    kind = "revisit" if head.get("warc-type") == "revisit" else "response"
                    plain = kind == "response"
                    digest = hashlib.sha256(block).hexdigest() if plain else head.get("warc-payload-digest", "").removeprefix("sha256:")
                    rows.append((path, start, length, "record", number("x-page-id"), head.get("warc-target-uri"), kind, len(block) if plain else None, digest, number("x-refers-to-page-id"), block if plain and keep_payload else None, None))
                    held += len(block)
                    if len(rows) >= 2000 or held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages to archives and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    payload_bytes of a revisit is the size of the payload it refers to, looked up by page and digest among the responses
    read, as rows may repeat a page_id. A gap in
    archives just written is an error. An empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(plan_records(pages), folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    read = materialise(read_archives(files, keep_payload=False), "records")
    if read.where("kind = 'gap'").limit(1).count():
        raise ValueError(f"archives in {folder} have damaged records")
    found = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("target"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("target_bytes"))
    asked = read.where("record_type = 'revisit'").select(F.col("refers_to").alias("target"), F.col("payload_digest").alias("digest")).distinct()
    sizes = asked.join(found, ["target", "digest"])
    return read.join(sizes, (F.col("refers_to") == F.col("target")) & (F.col("payload_digest") == F.col("digest")), "left").select(
        "page_id", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
