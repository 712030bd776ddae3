"""WARC archives: writing, normalising to a gzip member a record, and reading by offset.

Writers often gzip an archive as one stream, which can only be read from its start. The normaliser
inflates such a stream once, writes every record as a gzip member of its own and keeps a sidecar
index of offsets, so that any record can be read alone. Records whose payload another record
already has become revisits on the way.

Archives live in the folder that driver and executors share. A task names its files anew in each
attempt and the table of what was written is stored before it is used, so a lost executor or a
repeated task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import over_batches, parts, shared_dir, stored

_READ = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file given as a path or URI."""
    return pafs.FileSystem.from_uri(uri)


def record(kind: str, record_id: str, url: str | None, payload: bytes, sha: str, size: int, refers_to: str | None = None) -> bytes:
    """One WARC record. A revisit has the HTTP head alone, and the size and digest of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members."""
    d, inside = zlib.decompressobj(31), False
    while data := stream.read(_READ):
        while data:
            inside = True
            yield d.decompress(data)
            data = d.unused_data
            if d.eof:
                d, inside = zlib.decompressobj(31), False
    if inside:
        raise ValueError("the gzip stream breaks off")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record; memory is that of one record."""
    buffer, chunks = bytearray(), iter(chunks)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            more = next(chunks, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not fill(len(buffer) + 1):
                if buffer.strip():
                    raise ValueError("the archive breaks off in a record's head")
                return
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if not fill(end + 8 + size):
            raise ValueError("the archive breaks off in a record's block")
        yield head, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 8 + size]


def payload_of(block: bytes) -> bytes:
    """What stands behind the HTTP head of a block."""
    return block.partition(b"\r\n\r\n")[2]


def write(pages: DataFrame, folder: str, roll_bytes: int = 32 << 20, level: int = 1) -> DataFrame:
    """Write a response record per row of `pages` (page_id, url, html) to archives in `folder`, each
    one gzip stream of about roll_bytes of payload; return (archive, seq, page_id, payload_bytes,
    payload_digest) of each record. Null html is an empty payload; null urls give no target header."""
    arrow = to_arrow_schema(StructType.fromDDL("archive string, seq int, page_id long, payload_bytes long, payload_digest string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = open_fs(folder)
        where.create_dir(base, recursive=True)
        out, name, rows, filled, pack = None, "", [], 0, None

        def close() -> pa.RecordBatch:
            out.write(pack.flush())
            out.close()
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if out is None:
                    name, rows, filled = f"{uuid.uuid4().hex}.warc.gz", [], 0
                    out, pack = where.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                payload = (html or "").encode("utf-8", "surrogatepass")
                sha = digest(payload)
                out.write(pack.compress(record("response", f"urn:page:{page_id}:{name}:{len(rows)}", url, payload, sha, len(payload))))
                rows.append({"archive": name, "seq": len(rows), "page_id": page_id, "payload_bytes": len(payload), "payload_digest": sha})
                filled += len(payload)
                if filled >= roll_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return pages.select("page_id", "url", "html").mapInArrow(run, "archive string, seq int, page_id long, payload_bytes long, payload_digest string")


def revisits(written: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive, seq, refers_to): for each record of `written`, the id of the record it revisits, or null.

    Of records with equal payloads of at least min_bytes the one with the smallest page_id (null
    last; of equal ids the first by archive and place) stays a response. Only ids and digests are
    shuffled; a digest that many records share is summed up before the shuffle, and the join's
    large partitions can be split."""
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "seq")
    first = written.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = written.join(first, "payload_digest", "left")
    other = (F.col("payload_bytes") >= min_bytes) & F.col("first").isNotNull() & ~((F.col("first.archive") == F.col("archive")) & (F.col("first.seq") == F.col("seq")))
    ident = F.concat(F.lit("urn:page:"), F.coalesce(F.col("first.page_id").cast("string"), F.lit("None")), F.lit(":"), "first.archive", F.lit(":"), "first.seq")
    return joined.select("archive", "seq", F.when(other, ident).alias("refers_to"))


def normalise(archives: DataFrame, source: str, folder: str, level: int = 1) -> DataFrame:
    """Rewrite archives of folder `source` into `folder`, a gzip member a record.

    archives: (archive, seq, refers_to), a row a record; records with a refers_to become revisits.
    Beside each archive stands its index, <name>.idx, a line a record: offset, length, type and id.
    Returns (archive, seq, offset, length), a row a member. An archive is one group: it was closed
    at a fixed size, and is read and written as a stream."""
    arrow = to_arrow_schema(StructType.fromDDL("archive string, seq int, offset long, length long"))

    def run(group: pa.Table) -> pa.Table:
        name = group.column("archive")[0].as_py()
        refers = dict(zip(group.column("seq").to_pylist(), group.column("refers_to").to_pylist(), strict=True))
        (there, base), (where, to) = open_fs(source), open_fs(folder)
        where.create_dir(to, recursive=True)
        new = f"{uuid.uuid4().hex}.warc.gz"
        at, rows, index = 0, [], []
        with there.open_input_stream(f"{base}/{name}", compression=None) as stream, where.open_output_stream(f"{to}/{new}", compression=None) as out:
            for seq, (head, block) in enumerate(records(inflate(stream))):
                ident, sha, size = head["warc-record-id"].strip("<>"), head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                ref = refers.get(seq)
                url = head.get("warc-target-uri")
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(record("revisit" if ref else "response", ident, url, b"" if ref else payload_of(block), sha, size, ref)) + pack.flush()
                out.write(member)
                rows.append({"archive": new, "seq": seq, "offset": at, "length": len(member)})
                index.append(f"{at} {len(member)} {'revisit' if ref else 'response'} {ident}\n")
                at += len(member)
        with where.open_output_stream(f"{to}/{new}.idx", compression=None) as side:
            side.write("".join(index).encode())
        return pa.Table.from_pylist(rows, schema=arrow)

    return archives.repartition(parts(archives.sparkSession), "archive").groupBy("archive").applyInArrow(run, "archive string, seq int, offset long, length long")


def read(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of the members that `index`
    (archive, offset, length) names. Of responses, size and digest are taken from the payload itself
    and must equal the head's."""

    def f(batch: pa.RecordBatch) -> Iterator[dict]:
        where, base = open_fs(folder)
        out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")}
        number = lambda ident: None if (x := ident.strip("<>").split(":")[2]) == "None" else int(x)
        handle, opened = None, None
        for name, at, n in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
            if opened != name:
                handle, opened = where.open_input_file(f"{base}/{name}"), name
            head, block = next(records([zlib.decompress(handle.read_at(n, at), 31)]))
            size, sha, kind = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
            if kind == "response" and ((p := payload_of(block)) is None or len(p) != size or digest(p) != sha):
                raise ValueError(f"{name} at {at}: the payload is not what its head says")
            for k, v in zip(out, (number(head["warc-record-id"]), size, sha, kind, number(head["warc-refers-to"]) if kind == "revisit" else None, head.get("warc-target-uri")), strict=True):
                out[k].append(v)
        yield out

    return over_batches(index.select("archive", "offset", "length"), f, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write `pages` (page_id, url, html) as whole-stream archives, normalise them, read them back by index.

    One row per row of `pages`. Null html is an empty payload; null page ids stay responses or revisit
    like others and are null in the result; an empty table gives no rows; other columns are not
    read. Only ids and digests are shuffled, never payloads."""
    spark = pages.sparkSession
    home = f"{shared_dir(spark)}/waymark-warc-{uuid.uuid4().hex}"
    written = stored(write(pages, f"{home}/stream"), "warc-written")
    index = stored(normalise(revisits(written, min_bytes), f"{home}/stream", f"{home}/members"), "warc-index")
    where, base = open_fs(home)
    if where.get_file_info(f"{base}/stream").type == pafs.FileType.Directory:
        where.delete_dir(f"{base}/stream")
    return read(index.repartition(parts(spark), "archive").sortWithinPartitions("archive", "offset"), f"{home}/members")
