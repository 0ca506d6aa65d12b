"""What the operators share: the shared folder, written tables, and texts as blocks of bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of array code handles; temporaries are about 50 times as large.
BLOCK_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset (tests) a temporary one."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, as pyarrow opens it (file, hdfs, s3, gs), and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else (path if not path.startswith("file:") else "file://" + path[5:]))


def opened(path: str, mode: str = "r"):
    """A file of the shared folder, to be read or written."""
    store, place = store_of(path)
    if mode == "r":
        return store.open_input_file(place)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    return store.open_output_stream(place)


def written(df: DataFrame, tag: str, **parts) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors cost nothing that was done before."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path, **parts)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hands memory that a worker has freed back to the system; idle workers stay alive beside an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Rows of texts that go to a worker at a time.
BATCH_ROWS = 2_000
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Sets the session to batches of BATCH_ROWS, if it has Spark's own default: an executor and a worker hold each batch
    several times over, and texts are long. A session that says otherwise is left alone."""
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def map_arrow(df: DataFrame, work, shape) -> DataFrame:
    """mapInArrow in small batches, whose workers give their memory back when a task ends."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(run, shape)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts as empty ones."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def text_blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows of about `most` bytes; a longer text is alone in its block."""
    texts = texts.fill_null("") if texts.null_count else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes up to which words are hashed together, eight at a time; longer ones go to xxh3 one by one.
LANES = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: eight bytes at a time go through a mixer that isn't linear.

    Spans of the same length up to 8 never collide; others do by chance alone.
    """
    out = mix64(lengths.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(0x8CB92BA72F3D8DD7))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = np.flatnonzero((lengths > 0) & (lengths <= LANES))
    at = 0
    while len(left):
        rest = lengths[left] - at
        out[left] = mix64((out[left] ^ (eight[starts[left] + at] & _MASKS[np.minimum(rest, 8)])) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at))
        at += 8
        left = left[rest > 8]
    for i in np.flatnonzero(lengths > LANES).tolist():
        out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes(), seed=0x2545F491))
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: (hash, text's number, first byte); A-Z lowered first if asked.

    Equal words have equal hashes; different ones share a 64-bit hash by chance alone.
    """
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts_at = np.zeros(len(data) + 1, bool)
    starts_at[offsets] = True
    edge = starts_at[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:]
    ends = np.flatnonzero(last) + 1
    return hash_spans(data, starts, ends - starts), np.searchsorted(offsets, starts, "right") - 1, starts
