"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences that reaches `least_words` words is hashed, the shortest such run from each
sentence on and up to each sentence (a sentence that long by itself is a run too); runs are joined over all documents by
96 bits of hash, and sentences that a run other than the first of its kind covers are removed. A passage of at least
twice that many words that repeats is covered whole, wherever it stands in the texts around it, if it begins and ends
with a sentence; the text left and right of it stays.

Sentences end at . ! ? with white space behind, at line breaks, and wherever a capital letter follows a space, so that a
passage set into the middle of a sentence still starts a sentence of its own, behind whatever sign it stands. A word counts once
for every `WORD_BYTES` bytes it has in full, at least once, so texts of languages without spaces have words, too.

First is the occurrence with the smallest (id, hash of the text, place); ids that are null come last. Defined results:
null texts stay null, empty ones empty; a document whose every sentence is covered becomes an empty text. Rows equal in id
and text count as one document and keep the same text. A sentence is compared without the white space around it.

The spans of all documents are grouped with map-side partial sums, so a passage that a third of the documents hold is one
row for each task; its occurrences then meet that row in a join that Spark may split. Only spans, never texts, are
shuffled but for the one join that brings the cuts back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_arrow, text_blocks, written

LEAST_WORDS = 25
WORD_BYTES = 15

_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words, text's number) of each sentence in the bytes of texts; white space around it is left out."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    space = _SPACE[data]
    after = np.zeros(n + 2, np.uint8)
    after[:n] = data
    before = np.zeros(n, np.uint8)
    before[1:] = data[:-1]
    upper = _UPPER[after[1 : n + 1]] | ((after[1 : n + 1] == 0xC3) & (after[2 : n + 2] >= 0x80) & (after[2 : n + 2] <= 0x9E))
    cut = space & (_STOP[before] | (data == 10) | (upper & (data == 32)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1] | edge[1:-1]
    word_at = np.flatnonzero(begins)
    if not len(word_at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    breaks = np.cumsum(cut)
    text = np.searchsorted(offsets, word_at, "right") - 1
    first = np.ones(len(word_at), bool)
    first[1:] = (breaks[word_at[1:]] != breaks[word_at[:-1]]) | (text[1:] != text[:-1])
    which = np.flatnonzero(first)
    last = np.append(which[1:], len(word_at)) - 1
    ends_at = inside.copy()
    ends_at[:-1] &= space[1:] | edge[1:-1]
    word_end = np.flatnonzero(ends_at) + 1
    weight = np.concatenate(([0], np.cumsum(np.maximum(1, (word_end - word_at) // WORD_BYTES))))
    return word_at[which], word_end[last], weight[last + 1] - weight[which], text[which]


def runs(count: np.ndarray, least: int) -> set[tuple[int, int]]:
    """(first, last) of the shortest runs of one text's sentences with at least so many words, from each and up to each."""
    n = len(count)
    total = np.concatenate(([0], np.cumsum(count)))
    ahead = np.searchsorted(total, total[:n] + least, "left")  # the run is first .. ahead - 1
    behind = np.searchsorted(total, total[1:] - least, "right") - 1
    out = {(i, int(e) - 1) for i, e in enumerate(ahead) if e <= n}
    out.update((int(b), j) for j, b in enumerate(behind) if b >= 0)
    return out


def spans(docs: DataFrame, least: int, doc_id: str, text: str) -> DataFrame:
    """(h, c, doc_id, th, at): the hash of each run, its document and start << 32 | length in bytes."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for first, _, data, offsets in text_blocks(batch.column("text")):
                start, end, count, owner = sentences(data, offsets)
                raw = data.tobytes()
                row, low, high, place = [], [], [], []
                cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if count[a:b].sum() < least:
                        continue
                    s, e = start[a:b].tolist(), end[a:b].tolist()
                    one = [digest(raw[x:y]).to_bytes(8, "little") for x, y in zip(s, e, strict=True)]
                    at, i = int(offsets[owner[a]]), first + int(owner[a])
                    for x, y in runs(count[a:b], least):
                        key = xxhash.xxh3_128_digest(b"".join(one[x : y + 1]))
                        row.append(i)
                        low.append(key[:8])
                        high.append(key[8:12])
                        place.append((s[x] - at) << 32 | (e[y] - s[x]))
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b"".join(low), "<i8")), pa.array(np.frombuffer(b"".join(high), "<i4")), batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(place, pa.int64())],
                    ["h", "c", "doc_id", "th", "at"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text")).where("text is not null")
    return map_arrow(rows, work, f"h long, c int, doc_id {kind}, th long, at long")


def _cut(text: bytes, places: list[int]) -> bytes:
    """text without the spans; what is left is joined by the white space that stood before each span, if any."""
    out, last = [], 0
    for p in sorted(places):
        start, end = p >> 32, (p >> 32) + (p & 0xFFFFFFFF)
        if start > last:
            out.append(text[last:start])
        last = max(last, end)
    out.append(text[last:])
    return b"".join(out).strip(b" \t\n\r\f\v")


def cuts(docs: DataFrame, *, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, places): for each document with repeated spans the spans to remove, as start << 32 | length in bytes."""
    all_spans = spans(docs, least_words, doc_id, text)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "at")
    repeated = all_spans.groupBy("h", "c").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1").select("h", "c", "first")
    repeated = written(repeated, "repeated")
    later = all_spans.join(repeated, ["h", "c"]).where(order != F.col("first"))
    return written(later.groupBy("doc_id", "th").agg(F.collect_set("at").alias("places")), "cuts")


def dedup(docs: DataFrame, *, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated spans cut from the text, and the columns removed_spans and removed_bytes."""
    found = cuts(docs, least_words=least_words, doc_id=doc_id, text=text)
    k, th, places, n_spans, n_bytes = fresh(docs, "cut_id", "cut_hash", "places", "removed_spans", "removed_bytes")
    found = found.select(F.col("doc_id").alias(k), F.col("th").alias(th), F.col("places").alias(places))
    both = docs.join(found, F.col(doc_id).eqNullSafe(F.col(k)) & (F.xxhash64(F.col(text)) == F.col(th)), "left").drop(k, th)
    at, to = both.columns.index(text), both.columns.index(places)
    names = [*docs.columns, n_spans, n_bytes]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.column(to)
            texts, spans_, gone = [], [], []
            for t, p in zip(batch.column(at), where, strict=True):
                if not p.is_valid:
                    texts.append(t.as_py())
                    spans_.append(0)
                    gone.append(0)
                else:
                    raw = t.as_py().encode()
                    left = _cut(raw, p.as_py())
                    texts.append(left.decode())
                    spans_.append(len(p))
                    gone.append(len(raw) - len(left))
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns[:to], pa.array(spans_, pa.int32()), pa.array(gone, pa.int64())], names)

    shape = T.StructType([*docs.schema.fields, T.StructField(n_spans, T.IntegerType()), T.StructField(n_bytes, T.LongType())])
    return map_arrow(both, work, shape)
