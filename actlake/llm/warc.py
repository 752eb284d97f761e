"""WARC archives with a Zstandard dictionary.

The writer fits one dictionary to a bounded sample of the records, puts it in a skippable frame at the start of every
archive and compresses each record as a frame of its own, so that a record can be read alone (WARC's Zstandard
profile). Archives are files in a folder all executors reach, written under a temporary name and then renamed: a task
that runs again writes the same file. The reader takes the archives as binary files, with the dictionary from each
file's first frame.

Of records with equal payloads of at least 1000 bytes, that with the largest page_id is a response (rows that repeat
this id and payload all are), the others revisit it. Null html is an empty payload. Rows with null page_id are written
with an empty id; they revisit like others and never are revisited while a row with an id has the same payload.
An empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

SKIPPABLE = 0x184D2A5D  # fixed value: the skippable frame that holds a dictionary
FRAME = 0xFD2FB528  # fixed value: a compressed frame
LEAST_REVISITED = 1000
SAMPLE_RECORDS = 400  # records to which the dictionary is fitted, of at most SAMPLE_BYTES each
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
ARCHIVE_BYTES = 32 << 20  # an archive is closed when its compressed records exceed this
LEVEL = 3
STEP_BYTES = 1 << 14


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit holds no payload."""
    name = "" if page_id is None else str(page_id)
    revisit = refers_to is not None
    target = "".join(c for c in url or "" if c not in "\r\n")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if revisit else payload
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, body


def fit_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for ``samples``; empty where they are too few or too short for one."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one frame after the other."""
    magic, length = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("an archive starts with its dictionary")
    dictionary = content[8 : 8 + length]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    at, view = 8 + length, memoryview(content)
    while at < len(content):
        # in steps, since what follows a frame is copied
        frame, data = reader.decompressobj(), []
        while not frame.eof:
            step = view[at : at + STEP_BYTES]
            if not step:
                raise ValueError("an archive ends within a record")
            data.append(frame.decompress(step))
            at += len(step)
        at -= len(frame.unused_data)
        yield parse(b"".join(data))


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html with payload_digest, payload_bytes and refers_to (null for responses).

    Only digests are grouped; those of one page never leave the map side's partial count as a join partner.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    large = rows.filter(F.col("payload_bytes") >= LEAST_REVISITED).groupBy("payload_digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("kept"))
    rows = rows.join(large.filter("copies > 1").drop("copies"), "payload_digest", "left")
    return rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))).drop("kept")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``rows`` (of ``with_revisits``) as archives into ``folder``; a lazy frame of file, records, bytes.

    The dictionary is fitted to ``SAMPLE_RECORDS`` records, at most ``SAMPLE_BYTES`` of each, on the driver.
    """
    # the first payloads by digest: a bounded sample, the same in each run; chosen before any payload is gathered
    chosen = [r[0] for r in rows.select("payload_digest").distinct().orderBy("payload_digest").limit(SAMPLE_RECORDS).collect()]
    cut = F.struct("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html"))
    sample = rows.filter(F.col("payload_digest").isin(chosen)).groupBy("payload_digest").agg(F.min(cut).alias("r")).orderBy("payload_digest").select("payload_digest", "r.*")
    dictionary = fit_dictionary([record(r["page_id"], r["url"], r["html"].encode(), r["payload_digest"], None) for r in sample.collect()])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base)
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        pack = zstandard.ZstdCompressor(level=LEVEL, **options)
        start = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
        part, number = TaskContext.get().partitionId(), 0
        frames: list[bytes] = []
        held = 0

        def close() -> pd.DataFrame:
            nonlocal number, held
            name = f"{base}/part-{part:05d}-{number:05d}.warc.zst"
            draft = f"{base}/_draft-{uuid.uuid4().hex}"
            with store.open_output_stream(draft, compression=None) as out:
                out.write(start)
                for frame in frames:
                    out.write(frame)
            store.move(draft, name)
            done = pd.DataFrame({"file": [name], "records": [len(frames)], "bytes": [held + len(start)]})
            frames.clear()
            number, held = number + 1, 0
            return done

        for frame in batches:
            for row in frame.itertuples(index=False):
                known = [None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to)]
                frames.append(pack.compress(record(known[0], row.url, row.html.encode(), row.payload_digest, known[1])))
                held += len(frames[-1])
                if held >= archive_bytes:
                    yield close()
        if frames:
            yield close()

    # ids as text: pandas would turn a column of ids with nulls into doubles
    ids = rows.select(F.col("page_id").cast("string"), "url", "html", "payload_digest", F.col("refers_to").cast("string"))
    return ids.mapInPandas(write, "file string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``folder``: page_id, payload_bytes, payload_digest, record_type, refers_to, html.

    Without ``payloads``, html is null. A response's length and digest are taken from the payload read, which must be what its header says.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for content in frame["content"]:
                out = []
                for headers, body in read_archive(content):
                    digest, refers = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers.get("WARC-Refers-To")
                    size = int(headers["WARC-Payload-Length"])
                    if headers["WARC-Type"] == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != size):
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
                    out.append((headers["WARC-Record-ID"][10:-1] or None, size, digest, headers["WARC-Type"], refers[10:-1] if refers else None, body.decode() if payloads and headers["WARC-Type"] == "response" else None))
                    if len(out) == 1000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=columns)

    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    rows = files.mapInPandas(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string")
    return rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def archive_pages(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html) into new archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "llm-warc")
    done = write_archives(with_revisits(pages), folder)
    done.write.parquet(f"{folder}-files")  # which files, with how many records
    if spark.read.schema(done.schema).parquet(f"{folder}-files").isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")
    return read_archives(spark, folder, payloads)
