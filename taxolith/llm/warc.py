"""WARC archives as a chunked record table.

Writing: a page is split into rows (record, chunk number, bytes) by column expressions; each task streams its chunks
into one .warc.gz file of its own, one gzip member per record, under a name no other attempt shares, and returns a row
per record for the manifest; a retried task leaves at most a file that no manifest row names. Reading: each task
streams the files the manifest names, member by member, block by block, and yields rows (record, chunk number, bytes)
with the digest of the payload so far, so that no record is held whole, neither compressed nor plain.

Records with equal payloads of at least REVISIT_BYTES: the one with the smallest identifier is a response with the
payload, the others are revisits that refer to it and carry no payload.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.llm import common

REVISIT_BYTES = 100
#: Payload bytes per chunk row.
CHUNK = 65_536
#: Bytes read from a file at a time.
BLOCK = 65_536
MANIFEST = "path string, page_id long, position long, stored long"
CHUNKS = "page_id long, warc_type string, refers_to long, declared_bytes long, declared_digest string, chunk_no long, n_bytes long, digest_so_far string, last boolean"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, body, payload_bytes, payload_digest, record_type, refers_to; hot payloads are one row a task before they are shuffled."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("payload_bytes", F.octet_length("body").cast("long")).withColumn("payload_digest", F.sha2("body", 256))
    repeated = (
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first_id")
    )
    repeated = common.kept(repeated, "repeated_payloads")
    joined = rows.join(common.small(repeated, repeated.count()), "payload_digest", "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(False))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id")


def chunked(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row per chunk of what is stored: a revisit stores nothing, but has its one, empty chunk."""
    stored = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("body"))
    last = F.greatest(F.ceil(F.octet_length("_stored") / F.lit(size)) - 1, F.lit(0)).cast("long")
    numbered = records.withColumn("_stored", stored).withColumn("_last", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    return numbered.select(
        "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no",
        F.substring(F.col("_stored"), (F.col("chunk_no") * size + 1).cast("int"), F.lit(size)).alias("chunk"),
        F.octet_length("_stored").cast("long").alias("stored"), (F.col("chunk_no") == F.col("_last")).alias("last"),
    )


def head(row: dict) -> bytes:
    """The header block of a record; the payload digest is hexadecimal SHA-256."""
    clean = " ".join(row["url"].split())
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}", f"Content-Length: {row['stored']}",
    ]
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows, the chunks of a record adjacent and in order, to files in folder; the manifest."""

    def run(batches):
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        path, out, packer = f"{root}/{uuid.uuid4().hex}.warc.gz", None, None
        try:
            for b in batches:
                paths, ids, positions, sizes = [], [], [], []
                for row in b.to_pylist():
                    out = out or store.open_output_stream(path, compression=None)
                    if row["chunk_no"] == 0:
                        packer, start = zlib.compressobj(6, zlib.DEFLATED, 31), out.tell()
                        out.write(packer.compress(head(row)))
                    out.write(packer.compress(row["chunk"]))
                    if row["last"]:
                        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                        paths.append(path), ids.append(row["page_id"]), positions.append(start), sizes.append(row["stored"])
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(ids, pa.int64()), pa.array(positions, pa.int64()), pa.array(sizes, pa.int64())], ["path", "page_id", "position", "stored"])
        finally:
            if out:
                out.close()

    return chunks.mapInArrow(run, MANIFEST)


def records(stream, block: int = BLOCK, chunk: int = CHUNK):
    """(header, chunk number, bytes, last) of each record of a .warc.gz stream; at most a block and a chunk are held."""
    unpacker, plain, raw = zlib.decompressobj(31), b"", b""

    def more() -> bool:
        nonlocal unpacker, plain, raw
        while True:
            raw = raw or stream.read(block)
            if not raw:
                return False
            if unpacker.eof:
                unpacker = zlib.decompressobj(31)
            found = unpacker.decompress(raw, chunk)
            raw = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
            if found:
                plain += found
                return True

    while True:
        while b"\r\n\r\n" not in plain:
            if not more():
                if plain.strip():
                    raise ValueError("a record breaks off")
                return
        block_, _, plain = plain.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in block_.decode().split("\r\n")[1:])
        left, number = int(fields["Content-Length"]), 0
        while True:
            want = min(left, chunk)
            while len(plain) < want:
                if not more():
                    raise ValueError("a record breaks off")
            part, plain, left = plain[:want], plain[want:], left - want
            yield fields, number, part, not left
            number += 1
            if not left:
                break
        while len(plain) < 4:
            if not more():
                raise ValueError("a record breaks off")
        if plain[:4] != b"\r\n\r\n":
            raise ValueError("a record has no end")
        plain = plain[4:]


def read(files: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of the archives named in files(path), with the digest of the payload up to each chunk."""
    names = CHUNKS.replace(",", "").split()[::2]

    def run(batches):
        store, _ = filesystem(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, digest = [], None
                with store.open_input_stream(path, compression=None) as stream:
                    for fields, number, part, last in records(stream, chunk=chunk):
                        digest = hashlib.sha256() if number == 0 else digest
                        digest.update(part)
                        page = fields["WARC-Record-ID"][10:-1]
                        refers = fields.get("WARC-Refers-To", "")[10:-1]
                        rows.append((int(page) if page else None, fields["WARC-Type"], int(refers) if refers else None, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][7:], number, len(part), digest.hexdigest(), last))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                            rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("page_id", pa.int64()), ("warc_type", pa.string()), ("refers_to", pa.int64()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("chunk_no", pa.int64()), ("n_bytes", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])
    return files.select("path").mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Write a record per row of pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; payloads under REVISIT_BYTES bytes are always responses; rows that repeat an
    identifier give a record each, and of equal payloads those with the smallest identifier are all responses. A null
    identifier is written as an empty one and is never referred to while its payload has another; rows with it and a
    repeated payload are responses. Sizes and digests of responses are taken from the bytes read back and must equal
    those declared in the header; a revisit's are those its header declares. An empty table writes no file.
    """
    spark = pages.sparkSession
    folder = common.new_folder(spark, "warc")
    manifest = common.kept(write(chunked(typed(pages), chunk), folder), "warc_manifest")
    files = manifest.select("path").distinct()
    files = files.repartition(max(1, min(files.count(), 100_000)))  # a task per file, whatever their names hash to
    ends = read(files, folder, chunk).where("last")
    whole = ends.withColumn("read_bytes", F.when(F.col("chunk_no") == 0, F.col("n_bytes")).otherwise(F.col("chunk_no") * chunk + F.col("n_bytes")))
    revisit = F.col("warc_type") == "revisit"
    broken = ~revisit & ((F.col("read_bytes") != F.col("declared_bytes")) | (F.col("digest_so_far") != F.col("declared_digest")))
    return whole.select(
        "page_id",
        F.when(broken, F.raise_error(F.concat(F.lit("payload differs: "), F.col("page_id").cast("string")))).otherwise(F.when(revisit, F.col("declared_bytes")).otherwise(F.col("read_bytes"))).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), "refers_to",
    )


def op5_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
t AS (SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM t
"""
