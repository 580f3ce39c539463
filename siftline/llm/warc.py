"""Web archives packed in ZIP files, and a reader that takes records out by range.

A package is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``, WARC
records with a gzip member each, and ``indexes/index.cdxj``, a JSON line per record with its offset
and length in the first member. The reader parses the end record, the ZIP64 end record and the
central directory, finds where the members' bytes begin, reads the index, and then reads ranges of
records straight from the package; nothing is unpacked.

Records with equal payloads of at least ``least`` bytes are stored once: the one with the smallest
page_id is a ``response``, the others are ``revisit`` records that keep digest and length of the
payload and name the response. Smaller payloads are always responses.

Edge cases: null html is an empty payload; a null url gives a record without target; a null page_id
stays null, comes after all others, and so is the response only where no other holds the payload;
repeated rows with the smallest page_id are all responses; an empty table gives no packages; other
columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import filesystem, materialise, travels

travels(__name__)

LEAST_BYTES = 100
RANGE_BYTES = 4 << 20
#: Groups of equal payloads whose digests are broadcast; beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 200_000

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


# ---- writing -----------------------------------------------------------------------------------


def with_responses(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Pages with the payload's digest and, for copies, the page they refer to; ids as text."""
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    groups = materialise(
        keyed.where(F.octet_length("html") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies"),
        "payload-groups",
    )
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    differs = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return keyed.join(groups, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest",
        F.when(differs, F.col("first_id")).cast("string").alias("refers_to"),
    )


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packer(folder: str):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        name, lines, place, sink = f"{uuid.uuid4().hex}.zip", [], 0, None
        for batch in batches:
            if sink is None:
                sink = fs.open_output_stream(f"{root}/{name}")
                package = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                data = package.open(DATA, "w", force_zip64=True)
            for page, url, html, digest, refers in batch.itertuples(index=False):
                page, refers = (None if x is None else int(x) for x in (page, refers))
                packed = gzip.compress(_record(page, url, html.encode(), digest, refers), 6, mtime=0)
                data.write(packed)
                lines.append(json.dumps({"page": page, "offset": place, "length": len(packed)}))
                place += len(packed)
        if sink is None:
            return
        data.close()
        package.writestr(INDEX, "".join(x + "\n" for x in lines))
        package.close()
        sink.close()
        yield pd.DataFrame([{"package": name, "records": len(lines)}])

    return pack


def write_packages(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Write all pages into packages under ``folder``; returns the list of packages.

    A package gets a name of its own per attempt and counts once Spark has committed the list, so
    what a lost task left is not read.
    """
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    marked = with_responses(pages, least)
    marked.mapInPandas(_packer(folder), "package string, records long").write.parquet(f"{folder}/packages")
    return pages.sparkSession.read.schema("package string, records long").parquet(f"{folder}/packages")


# ---- reading -----------------------------------------------------------------------------------


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """Where the bytes of each stored member of a ZIP file are: name -> (offset, length).

    ``read(offset, length)`` reads a range of the file.
    """
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<H2L", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (end64,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        count, length, start = struct.unpack("<3Q", read(end64 + 32, 24))
    directory, found, at = read(start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack("<2H", directory[at + 8 : at + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<2L3H", directory[at + 20 : at + 34])
        (local,) = struct.unpack("<L", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<2H", extra[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        if method == 0:
            n_name_here, n_extra_here = struct.unpack("<2H", read(local + 26, 4))
            found[name] = (local + 30 + n_name_here + n_extra_here, packed)
        at += 46 + n_name + n_extra + n_comment
    return found


def _ranges(folder: str):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        for batch in batches:
            for package in batch["package"]:
                with fs.open_input_file(f"{root}/{package}") as f:
                    where = members(lambda at, n: f.read_at(n, at), f.size())
                    base, _ = where[DATA]
                    at, n = where[INDEX]
                    spans: list[list[int]] = []
                    for line in f.read_at(n, at).splitlines():
                        entry = json.loads(line)
                        begin = base + entry["offset"]
                        if not spans or spans[-1][1] - spans[-1][0] >= RANGE_BYTES:
                            spans.append([begin, begin])
                        spans[-1][1] = begin + entry["length"]
                yield pd.DataFrame({"package": package, "begin": [x for x, _ in spans], "end": [x for _, x in spans]})

    return find


def records_in(block: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and content of each record in a run of gzip members."""
    while block:
        z = zlib.decompressobj(31)
        raw = z.decompress(block) + z.flush()
        block = z.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def _record_row(fields: dict[str, str], content: bytes, with_html: bool) -> tuple:
    http, _, payload = content.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page, refers = (int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page"))
    row = (page, fields.get("WARC-Target-URI"), size, digest, kind, refers)
    return (*row, payload.decode() if kind == "response" else None) if with_html else row


def _record_reader(folder: str, with_html: bool):
    names = [x.split()[0] for x in RECORD.split(", ")] + ["html"] * with_html

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        for batch in batches:
            for package, begin, end in batch[["package", "begin", "end"]].itertuples(index=False):
                with fs.open_input_file(f"{root}/{package}") as f:
                    block = f.read_at(end - begin, begin)
                rows = [_record_row(*x, with_html) for x in records_in(block)]
                # Ids as nullable integers from the start: large ones would lose digits as floats.
                columns = dict(zip(names, zip(*rows)))
                yield pd.DataFrame({k: pd.array(v, "Int64") if k in ("page_id", "refers_to") else v for k, v in columns.items()})

    return read


def read_packages(spark: SparkSession, folder: str, html: bool = False) -> DataFrame:
    """A row per record of the packages under ``folder``; revisits have no html of their own."""
    packages = spark.read.schema("package string, records long").parquet(f"{folder}/packages")
    tasks = min(max(packages.count(), 1), 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = packages.select("package").repartition(tasks).mapInPandas(_ranges(folder), "package string, begin long, end long")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(width).mapInPandas(_record_reader(folder, html), RECORD + ", html string" * html)
