"""Operator 10: media columns with content-addressed payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG, 64 samples a row, as a member of a tar
shard; the member's name is the payload's SHA-256.  Rows carry digest, shard, offset and
length.  Metadata columns come from a range read of the member's head alone (tar header,
PNG signature and IHDR); features come from a range read of the whole member.

Each task writes shards of its own name under a new folder in the shared place, so a task
run twice can't harm another's shard; rows name the shard of the attempt that returned
them.  Equal payloads of a task are stored once, and the catalog keeps one place for each
digest.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweft.llm.common import begin_task, new_path, written

UNIT = 64
SHARD_BYTES = 128 << 20
#: Fixed value: the PNG signature.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEAD = 512 + len(SIGNATURE) + 25


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "replace")
    return raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    filtered = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()  # filter 0 before each row
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered, 6)) + _chunk(b"IEND", b"")


def png_head(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) of the first bytes of a PNG."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` made; every checksum is verified."""
    width, height, _ = png_head(data)
    at, idat = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            idat += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


#: Fixed value: Hadoop's names of the S3 scheme.
S3_SCHEMES = ("s3a://", "s3n://")


def _store(folder: str):
    """(file system, path) of a folder named as Spark names it."""
    for scheme in S3_SCHEMES:
        if folder.startswith(scheme):
            folder = "s3://" + folder[len(scheme) :]
    return fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length); offset is that of the member's tar header, length that of the PNG."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        begin_task(__name__)
        filesystem, root = _store(folder)
        filesystem.create_dir(root, recursive=True)
        out, name, at, seen = None, "", 0, {}
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                p = payload_of(t or "")
                digest = hashlib.sha256(p).digest()
                if digest not in seen:
                    if out is None or at > SHARD_BYTES:
                        if out is not None:
                            out.write(bytes(1024))
                            out.close()
                        name, at, seen = f"{uuid.uuid4().hex}.tar", 0, {}
                        out = filesystem.open_output_stream(f"{root}/{name}")
                    media = to_png(p)
                    info = tarfile.TarInfo(digest.hex())
                    info.size = len(media)
                    member = info.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % 512)
                    out.write(member)
                    seen[digest] = (name, at, len(media))
                    at += len(member)
                rows.append((len((t or "").encode("utf-8", "replace")), digest, *seen[digest]))
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, digest binary, shard string, offset long, length long")


def _located(batches, folder: str):
    """Readers of ranges: the last shard stays open."""
    filesystem, root = _store(folder)
    name, file = None, None
    for b in batches:
        digests, shards, offsets, lengths = (b.column(c).to_pylist() for c in ("digest", "shard", "offset", "length"))

        def read(i: int, most: int | None, d=digests, s=shards, o=offsets, n=lengths) -> bytes:
            nonlocal name, file
            if s[i] != name:
                if file is not None:
                    file.close()
                name, file = s[i], filesystem.open_input_file(f"{root}/{s[i]}")
            size = 512 + n[i]
            data = file.read_at(size if most is None else min(most, size), o[i])
            if tarfile.TarInfo.frombuf(data[:512], "ascii", "strict").name != d[i].hex():
                raise ValueError("the member found there is another")
            return data[512:]

        yield digests, read
    if file is not None:
        file.close()


def metadata(catalog: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height, bits) from the heads alone."""

    def run(batches):
        for digests, read in _located(batches, folder):
            rows = [png_head(read(i, HEAD)) for i in range(len(digests))]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *(pa.array([r[k] for r in rows], pa.int32()) for k in range(3))], ["digest", "width", "height", "bits"])

    return catalog.select("digest", "shard", "offset", "length").mapInArrow(run, "digest binary, width int, height int, bits int")


def feature_of(payload: bytes) -> str:
    """Mean, spread and eight-bin histogram of the samples, as text."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    return f"{x.mean():.4f}|{x.std():.4f}|" + ",".join(map(str, bins.tolist()))


def payload_features(catalog: DataFrame, folder: str) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, width, height, bits, feature), read back from the shards."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "bits", "feature"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches):
        for digests, read in _located(batches, folder):
            rows = []
            for i, d in enumerate(digests):
                head = png_head(read(i, HEAD))
                media = read(i, None)
                p = from_png(media)
                rows.append((d, len(p), hashlib.sha256(p).digest(), zlib.crc32(p[-UNIT:]), len(media), hashlib.sha256(media).digest(), *head, feature_of(p)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    schema = "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, width int, height int, bits int, feature string"
    return catalog.select("digest", "shard", "offset", "length").mapInArrow(run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, then shard, offset, length, width, height, bits.

    A null text counts as empty: its payload is 64 zero bytes.  Null or repeated ids pass
    through; equal texts have equal values, place included.  An empty table gives an empty
    table.  Other columns of ``docs`` are not read.
    """
    folder = new_path(docs.sparkSession, "shards")
    rows = written(write_shards(docs, folder), "media")
    catalog = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    # a range of (shard, offset) for each task: shards are read forward, each by few tasks
    spread = catalog.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    found = payload_features(spread, folder)
    # written, so that both sides of the next join are plain shuffles and a hot digest's rows can be split
    places = written(catalog.join(found, "digest"), "places")
    out = rows.select("doc_id", "n_bytes", "digest").join(places, "digest")
    spell = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_bytes", "payload_bytes", spell("payload_sha256"), "tail_crc32", "media_bytes", spell("media_sha256"), "feature", "shard", "offset", "length", "width", "height", "bits")
