"""Media columns: payloads as images in tar shards, addressed by the digest of their content.

A text's bytes, filled up with zero bytes to a multiple of 64, are the samples of a grey 8-bit PNG 64 samples wide. Each
task writes its images to one tar shard, a repeated one once, and gives rows of digest, shard, offset and length. If several
shards hold one digest, all its rows go by the first copy; the others are unreferenced and `unreferenced` lists them.
Metadata columns come from range reads of the 33 bytes of signature and header; contents from reads of whole members.

Shards are files in the shared folder, through any file system that pyarrow opens (file, hdfs, s3, gs). A shard's name is that
of the attempt that wrote it and stands in its rows, so rows that are kept go with the shard that belongs to them, even if a
task runs again or twice; what other attempts leave behind is referred to by no row. Contents are read shard by shard, one
task for each, in the order of offsets; rows of a digest that many rows share are dealt to several tasks.

Defined results: null texts are empty payloads: 64 zero bytes. Equal texts have equal values in all columns but doc_id.
Null and repeated ids are carried as they are. An empty table writes no shards.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, store_of, with_text, work_path, written

WIDTH = 64
HEADER = 33
#: Rows of one digest that one task reads contents for, about.
HOT_ROWS = 20_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(raw: bytes) -> bytes:
    """raw and zero bytes up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes) -> bytes:
    """A grey image, 8 bits a sample, WIDTH samples a row, rows unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits, colour type) from the first HEADER bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not the header of a PNG file")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(data: bytes) -> bytes:
    """The samples of an image that encode_png wrote."""
    width, height, bits, colour = read_header(data[:HEADER])
    if (bits, colour) != (8, 0):
        raise ValueError("not an 8-bit grey image")
    at, packed = HEADER, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Height, mean, deviation, and a 64-bit average hash of the image's 8 x 8 cells."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    edges = np.linspace(0, len(x), 9).astype(int)
    sums = np.concatenate((np.zeros((1, 8)), np.cumsum(x.reshape(len(x), 8, 8).sum(2, dtype=np.int64), axis=0)))
    cells = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(np.diff(edges), 1)[:, None] / 8
    bits = (cells > cells.mean()).ravel()
    total = x.astype(np.int64)
    mean = total.sum() / total.size
    return f"{len(x)}:{mean:.4f}:{max((total * total).sum() / total.size - mean * mean, 0) ** 0.5:.4f}:{int(''.join(map(str, bits.astype(int))), 2):016x}"


def write_shards(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes one tar shard for each task; gives (doc_id, n_bytes, digest, shard, offset, length, first) as a table.

    first marks the row for which the shard took the member in.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(path)
        shard = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:16]}.tar"
        seen: dict[bytes, tuple[int, int, str]] = {}
        out = None
        at = 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{shard}")
                rows = []
                for t in batch.column("text"):
                    raw = t.as_py().encode()
                    key = hashlib.sha256(raw).digest()
                    known = seen.get(key)
                    first = known is None
                    if first:
                        image = encode_png(payload(raw))
                        digest = hashlib.sha256(image).hexdigest()
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(image)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + image + bytes(-len(image) % 512))
                        known = seen[key] = (at + len(head), len(image), digest)
                        at += len(head) + len(image) + -len(image) % 512
                    rows.append((len(raw), known[2], known[0], known[1], first))
                size, digests, offsets, lengths, firsts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digests), pa.array([shard] * len(rows)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(firsts)],
                    ["doc_id", "n_bytes", "digest", "shard", "offset", "length", "first"],
                )
        if out is not None:
            out.write(bytes(1024))
            out.close()

    rows = map_arrow(with_text(docs, doc_id, text), work, f"doc_id {kind}, n_bytes long, digest string, shard string, offset long, length long, first boolean")
    return written(rows, "media-rows")


def addressed(rows: DataFrame) -> DataFrame:
    """Rows by the first copy of their digest: copies in other shards are found by (shard, digest), so one hot digest has
    a row for each shard to look up, not for each document."""
    kept = rows.where("first").select("digest", "shard", "offset", "length")
    home = kept.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("home"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    moved = kept.join(home, "digest").where("shard <> home.shard").select("digest", "shard", "home")
    moved = written(moved, "media-moved")
    both = rows.join(moved, ["digest", "shard"], "left")
    pick = lambda c: F.coalesce(F.col(f"home.{c}"), F.col(c)).alias(c)
    return both.select("doc_id", "n_bytes", "digest", pick("shard"), pick("offset"), pick("length"))


def by_shard(rows: DataFrame) -> DataFrame:
    """Addressed rows, dealt to one task for each shard and sorted by offset; rows of a hot digest go to the tasks that follow."""
    number = F.substring("shard", 1, 6).cast("int")
    shards = (rows.agg(F.max(number)).first()[0] or 0) + 1
    hot = written(rows.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select(F.col("digest").alias("hot"), F.ceil(F.col("n") / HOT_ROWS).alias("ways")), "media-hot")
    dealt = rows.join(hot, F.col("digest") == F.col("hot"), "left")
    way = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("ways")), F.lit(0))
    return dealt.withColumn("at", F.pmod(number + way, F.lit(shards)).cast("int")).drop("hot", "ways").repartitionById(shards, F.col("at")).sortWithinPartitions("shard", "offset").drop("at")


def unreferenced(rows: DataFrame) -> DataFrame:
    """(digest, shard, offset, length) of members that no row goes by."""
    kept = rows.where("first").select("digest", "shard", "offset", "length")
    home = kept.groupBy("digest").agg(F.min("shard").alias("home"))
    return kept.join(home, "digest").where("shard <> home").drop("home")


CONTENT = "n_bytes long, digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, bits int"


def with_content(rows: DataFrame, path: str, *, contents: bool = True) -> DataFrame:
    """Addressed rows with the columns of header and, if asked, of content, read back from the shards.

    Each task reads its rows shard by shard in the order of offsets, a member once for rows that share it.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(path)
        known: dict[str, tuple] = {}
        opened: dict[str, object] = {}
        for batch in batches:
            shards, offsets, lengths, digests = (batch.column(c).to_pylist() for c in ("shard", "offset", "length", "digest"))
            for i in sorted(range(batch.num_rows), key=lambda i: (shards[i], offsets[i])):
                if digests[i] in known:
                    continue
                if shards[i] not in opened:
                    if len(opened) >= 16:
                        opened.pop(next(iter(opened))).close()
                    opened[shards[i]] = store.open_input_file(f"{top}/{shards[i]}")
                file = opened[shards[i]]
                width, height, bits, _ = read_header(file.read_at(HEADER, offsets[i]))
                if contents:
                    data = file.read_at(lengths[i], offsets[i])
                    samples = decode_png(data)
                    got = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples), width, height, bits)
                else:
                    got = (width * height, None, None, lengths[i], digests[i], None, width, height, bits)
                known[digests[i]] = got
            columns = list(zip(*(known[d] for d in digests), strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), batch.column("digest"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_bytes", "digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits"],
            )
            if len(known) > 50_000:
                known.clear()

    return map_arrow(rows, work, f"doc_id {kind}, {CONTENT}")


def media_columns(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Writes all payloads and gives one row for each row of docs, with digest, place and the columns read back."""
    path = path or work_path(docs.sparkSession, "media")
    return with_content(by_shard(addressed(write_shards(docs, path, doc_id=doc_id, text=text))), path)


def members(data: bytes) -> list[str]:
    """Names in a tar shard, by Python's own reader."""
    return tarfile.open(fileobj=io.BytesIO(data)).getnames()
