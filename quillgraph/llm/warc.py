"""WARC records in ZIP packages, written by many tasks and read by range.

A package is a ZIP file with two stored (not deflated) members: `archive/data.warc.gz`, in which every record is a gzip
member of its own, and `indexes/index.cdx`, one line of JSON for each record with its offset and length in the archive
member. The reader parses the central directory (the ZIP64 one where there is one), finds both members, reads the index,
and then reads each record by its range; nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: A package is closed once its records take so many bytes, which bounds a task's memory.
PACKAGE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record ids are UUIDs made of this prefix and the page's id.
ID_PREFIX = 0x5175696C6C576172

# Fixed values of the ZIP format: signatures and structures of its records.
LOCAL_SIG, CENTRAL_SIG, END_SIG, END64_SIG, LOCATOR_SIG = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
LOCAL = struct.Struct("<IHHHHHIIIHH")
CENTRAL = struct.Struct("<IHHHHHHIIIHHHHHII")
END = struct.Struct("<IHHHHIIH")
END64 = struct.Struct("<IQHHIIQQQQ")
LOCATOR = struct.Struct("<IIQI")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int
    crc: int


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """A ZIP file of stored members. With zip64, sizes and offsets are in ZIP64 fields, whatever their size."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        key, crc, at = name.encode(), zlib.crc32(data), len(out)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if zip64 else b""
        short = FULL32 if zip64 else len(data)
        out += LOCAL.pack(LOCAL_SIG, 45, 0, 0, 0, 0x21, crc, short, short, len(key), len(extra)) + key + extra + data
        more = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if zip64 else b""
        central += CENTRAL.pack(
            CENTRAL_SIG, 45, 45, 0, 0, 0, 0x21, crc, short, short, len(key), len(more), 0, 0, 0, 0, FULL32 if zip64 else at
        ) + key + more
    at, n = len(out), len(members)
    out += central
    if zip64:
        end64 = len(out)
        out += END64.pack(END64_SIG, END64.size - 12, 45, 45, 0, 0, n, n, len(central), at)
        out += LOCATOR.pack(LOCATOR_SIG, 0, end64, 1)
    out += END.pack(END_SIG, 0, 0, *(2 * [FULL16 if zip64 else n]), *((2 * [FULL32]) if zip64 else [len(central), at]), 0)
    return bytes(out)


class ZipReader:
    """Members of a ZIP file, and ranges of those that are stored."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        self.members = {m.name: m for m in self._central()}

    def _at(self, offset: int, n: int) -> bytes:
        data = self.file.read_at(n, offset)
        if len(data) != n:
            raise ValueError("the ZIP file ends early")
        return data

    def _central(self) -> Iterator[Member]:
        size = self.file.size()
        tail_at = max(0, size - END.size - FULL16)  # a comment of 64 kB may follow the end record
        tail = self._at(tail_at, size - tail_at)
        found = tail.rfind(struct.pack("<I", END_SIG))
        if found < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        end_at = tail_at + found
        _, _, _, _, n, length, at, _ = END.unpack_from(tail, found)
        if FULL16 == n or FULL32 in (length, at):
            sig, _, end64_at, _ = LOCATOR.unpack(self._at(end_at - LOCATOR.size, LOCATOR.size))
            if sig == LOCATOR_SIG:
                sig, _, _, _, _, _, _, n, length, at = END64.unpack(self._at(end64_at, END64.size))
                if sig != END64_SIG:
                    raise ValueError("the ZIP64 end of central directory is damaged")
        data, p = self._at(at, length), 0
        for _ in range(n):
            sig, _, _, _, method, _, _, crc, packed, size, n_name, n_extra, n_note, _, _, _, head = CENTRAL.unpack_from(data, p)
            if sig != CENTRAL_SIG:
                raise ValueError("the central directory is damaged")
            p += CENTRAL.size
            name, extra = data[p : p + n_name], data[p + n_name : p + n_name + n_extra]
            p += n_name + n_extra + n_note
            wide, q = b"", 0
            while q + 4 <= len(extra):
                tag, n_tag = struct.unpack_from("<HH", extra, q)
                if tag == 1:
                    wide = extra[q + 4 : q + 4 + n_tag]
                q += 4 + n_tag
            fields = [size, packed, head]  # those that are full stand in the ZIP64 field, in this order
            for i, x in enumerate(fields):
                if x == FULL32 and len(wide) >= 8:
                    fields[i], wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            yield Member(name.decode(), method, fields[0], fields[2], crc)

    def start(self, name: str) -> int:
        """Offset of a stored member's first byte."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is not stored; its ranges can't be read")
        head = LOCAL.unpack(self._at(m.header_at, LOCAL.size))
        if head[0] != LOCAL_SIG:
            raise ValueError(f"the header of {name} is damaged")
        return m.header_at + LOCAL.size + head[-2] + head[-1]

    def read(self, name: str, offset: int = 0, n: int | None = None) -> bytes:
        return self._at(self.start(name) + offset, self.members[name].size - offset if n is None else n)


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=ID_PREFIX << 64 | page_id & (1 << 64) - 1)}>"


def page_of(record: str) -> int:
    low = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def one_line(text: str) -> str:
    return " ".join(text.split())


def warc_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, revisit: bool) -> bytes:
    payload = (html or "").encode()
    block = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    # A page without an id gets a record id of its own, from its content; readers see that it isn't one of ours.
    own = record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}\n{html}')}>"
    head += [f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url or 'about:blank')}"]
    head += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"WARC-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: {record_id(refers_to)}")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


def with_roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Add revisit and refers_to to (page_id, url, html).

    Only digests and ids are grouped, and grouped before the shuffle; the page's text moves once, to the join with them.
    """
    digest = F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn(
        "_digest", F.when(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes, digest)
    )
    heads = (
        rows.where("_digest IS NOT NULL").groupBy("_digest").agg(F.max("page_id").alias("_head"), F.count("*").alias("_n"))
        .where("_n > 1").drop("_n")
    )
    revisit = F.col("_head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_head"))
    # Short pages have no digest and take no part in the join: their nulls would all meet in one task.
    judged = rows.where("_digest IS NOT NULL").join(heads, "_digest", "left").select(
        "page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("_head")).alias("refers_to")
    )
    short = rows.where("_digest IS NULL").select("page_id", "url", "html", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to"))
    return judged.unionByName(short)


PACKAGES = "path string, records long, bytes long"


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 1000, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write each row of pages (page_id, url, html) as a record; returns one row for each package written.

    Of records with equal payloads of at least least_bytes the one with the largest page_id is a response, the others are
    revisits of it; smaller ones are all responses. Null html is an empty payload; a null url is about:blank; a row whose
    page_id is null is a response unless another row of its group has an id, and is read back with a null id. Rows repeated
    with the largest page_id are all responses. An empty table makes no package. Other columns are not read.
    A package gets its name when it is whole, and a repeated task writes the same name, so lost tasks leave no half files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        data, index = bytearray(), []

        def close() -> None:
            name = f"part-{context.stageId()}-{context.partitionId():06d}-{len(done):04d}.zip"
            whole = zip_bytes([(DATA, bytes(data)), (INDEX, "\n".join(map(json.dumps, index)).encode())])
            hidden = f"{root}/.{name}.{context.taskAttemptId()}"
            with fs.open_output_stream(hidden) as out:
                out.write(whole)
            fs.move(hidden, f"{root}/{name}")
            done.append((f"{folder}/{name}", len(index), len(whole)))
            data.clear()
            index.clear()

        for batch in batches:
            for row in batch.to_pylist():
                packed = gzip.compress(warc_record(row["page_id"], row["url"], row["html"], row["refers_to"], row["revisit"]), 6, mtime=0)
                index.append({"url": row["url"], "offset": len(data), "length": len(packed)})
                data.extend(packed)
                if len(data) >= package_bytes:
                    close()
        if index:
            close()
        paths, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return with_roles(pages, least_bytes).mapInArrow(write, PACKAGES)


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the packages whose paths stand in column `path`: RECORDS; payload is null for revisits, or for all if payloads is false.

    A response's digest is computed anew from its payload and must be the one in its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as file:
                    package, rows = ZipReader(file), []
                    start = package.start(DATA)
                    for line in package.read(INDEX).decode().splitlines():
                        entry = json.loads(line)
                        fields, block = parse_record(gzip.decompress(file.read_at(entry["length"], start + entry["offset"])))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = fields["WARC-Type"]
                        if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                            raise ValueError(f"{path}: damaged payload of {fields['WARC-Record-ID']}")
                        page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To")
                        rows.append((
                            None if page is None else int(page), fields["WARC-Target-URI"], int(fields["WARC-Payload-Length"]), digest, kind,
                            None if refers is None else page_of(refers), block if payloads and kind == "response" else None,
                        ))
                        if len(rows) >= 256:
                            yield batch_of(rows)
                            rows = []
                    yield batch_of(rows)

    return packages.mapInArrow(read, RECORDS)
