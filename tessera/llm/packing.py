"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths, and each piece is a sequence of its own.

A document of n tokens gives n // longest pieces of the longest length and then one piece for each bit of n % longest,
longest first. A piece of length 2 ** k goes to bucket k; a training job draws whole batches from one bucket, so no
sequence crosses documents and none needs padding.

Defined results: a null or empty text is a document of the end token alone. Rows with equal or null ids are packed each
by itself; sequence ids are unique all the same. Other columns are ignored. An empty table gives an empty table.
The plan is one scan and a map: no shuffle, no state across tasks, and a lost task is simply run again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, with_text

PIECES = "doc_id {id}, piece int, start long, length long, bucket int, doc_tokens long, ids binary"


def spans(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; longest must be a power of two."""
    out = [(at, longest) for at in range(0, n - n % longest, longest)]
    at, rest = n - n % longest, n % longest
    for k in range(longest.bit_length() - 2, -1, -1):
        if rest >> k & 1:
            out.append((at, 1 << k))
            at += 1 << k
    return out


class ByteEncoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, as little-endian unsigned 32-bit bytes.

    Texts in Latin letters are encoded by the rank table of the same vocabulary, which is several times as fast; what
    holds special tokens or other letters, where two libraries' Unicode tables might differ, goes to the library itself,
    and so do texts that the other encoder gives up on (a run of about a million blanks exceeds its pattern's stack).
    """

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocabulary)
        self.full.no_truncation()
        self.full.no_padding()
        special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.special_in = re.compile("|".join(map(re.escape, special))).search if special else lambda _: None
        self.quick = None
        if ranks and pattern:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.quick is not None and not self.special_in(text):
            try:
                if not text.isascii():
                    text.encode("latin-1")
                return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # letters beyond Latin-1 are one, too
                pass
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[tuple, ByteEncoder] = {}


def encoder(*files: str | None) -> ByteEncoder:
    """One for each worker process."""
    if files not in _ENCODERS:
        _ENCODERS[files] = ByteEncoder(*files)
    return _ENCODERS[files]


def pack(docs: DataFrame, vocabulary: str, *, ranks: str | None = None, pattern: str | None = None, longest: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, bucket, doc_tokens, ids (little-endian uint32), sequence_id, offset.

    vocabulary is a tokenizers file with a byte-level model; ranks and pattern, where given, are the same vocabulary as
    ranks. Both must lie at that path on every executor. Sequence ids are unique and stable for given input files.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    plain = with_text(docs, doc_id, text)
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                row, piece, start, length, total, ids = [], [], [], [], [], []
                for i, t in enumerate(batch.column("text")):
                    got = encode(t.as_py()) + end
                    n = len(got) // 4
                    for k, (s, size) in enumerate(spans(n, longest)):
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(size)
                        total.append(n)
                        ids.append(got[4 * s : 4 * (s + size)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([x.bit_length() - 1 for x in length], pa.int32()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "piece", "start", "length", "bucket", "doc_tokens", "ids"],
                )

    cut_up = map_arrow(plain, cut, PIECES.format(id=kind))
    return cut_up.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces as files by bucket; readers of one bucket get sequences of one length."""
    pieces.write.partitionBy("bucket").parquet(path)


def crc(pieces: DataFrame) -> DataFrame:
    """ids_crc32 of each piece, computed from its ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
