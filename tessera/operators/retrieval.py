"""Lexical and hashed-vector retrieval: many queries at once, documents and queries as tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import text as T
from tessera.sources.shared import if_small, kept

K1, B, RRF = 1.5, 0.75, 60


def postings(docs: DataFrame, id_: str, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, dl): terms, or those that are wanted, with their counts and the document's length in terms."""
    words = docs.select(id_, T.tokens(F.col(text)).alias("w_")).select(id_, F.size("w_").alias("dl"), F.explode("w_").alias("term"))
    if wanted is not None:
        words = words.join(wanted, "term", "left_semi")
    return words.groupBy(id_, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: n documents and their mean length; documents without terms count too."""
    return docs.select(F.size(T.tokens(F.col(text))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequency(post: DataFrame, id_: str) -> DataFrame:
    return post.groupBy("term").agg(F.count(id_).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25(docs: DataFrame, queries: DataFrame, *, id_: str, text: str, query_id: str, query_text: str, k: int | None = 10, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best documents for each query, or all that score; ties to the smaller id.

    A query's terms count once. Only they are joined, and their postings are kept as a table, since documents are counted in
    it too; statistics are over the whole corpus even where only some documents are allowed. Scores are rounded to 6 places
    before they are ranked, so that the order of sums can't decide a tie.
    """
    terms = kept(queries.select(query_id, F.explode(F.array_distinct(T.tokens(F.col(query_text)))).alias("term")), "terms")
    post = kept(postings(docs, id_, text, if_small(terms.select("term").distinct())), "postings")
    stats = corpus_stats(docs, text).first()  # two numbers
    n, avgdl = F.lit(stats["n"]), F.lit(float(stats["avgdl"] or 0.0))
    df = if_small(document_frequency(post, id_))
    weighted = post.join(df, "term").select(id_, "term", (idf(n, F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.greatest(F.col("dl"), F.lit(1)) / F.greatest(avgdl, F.lit(1e-9))))).alias("w"))
    if allowed is not None:
        weighted = weighted.join(allowed.select(id_), id_, "left_semi")
    scored = weighted.join(if_small(terms), "term").groupBy(query_id, id_).agg(F.round(F.sum("w"), 6).alias("score"))
    return ranked(scored, query_id, id_, k)


def ranked(scored: DataFrame, query_id: str, id_: str, k: int | None) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), id_)
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def features(text: Column) -> Column:
    """Words and character n-grams of 3 to 5, told apart by a prefix."""
    w = F.transform(T.tokens(text), lambda t: F.concat(F.lit("w:"), t))
    return F.concat(w, F.transform(T.char_ngrams(text, 3, 5), lambda g: F.concat(F.lit("c:"), g)))


def embed(docs: DataFrame, id_: str, text: str, dim: int = 1024) -> DataFrame:
    """(id, idx, w): a sparse unit vector from hashed features, signed, with 1 + ln of their counts."""
    counts = docs.select(id_, F.explode(features(F.col(text))).alias("f")).groupBy(id_, "f").agg(F.count("*").alias("tf"))
    sign = F.when(T.bucket_of(F.col("f"), 2, 2) == 1, 1.0).otherwise(-1.0)
    cells = counts.groupBy(id_, T.bucket_of(F.col("f"), 1, dim).alias("idx")).agg(F.sum(sign * (1.0 + F.log(F.col("tf").cast("double")))).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(id_)))
    return cells.withColumn("norm", norm).where("norm > 0 and v <> 0").select(id_, "idx", (F.col("v") / F.col("norm")).alias("w"))


class Hashing:
    """The same vectors as `embed`, in array code: hashes of features are kept in a bounded table."""

    KEPT = 1_000_000

    def __init__(self, dim: int):
        self.dim, self.known = dim, {}

    def _place(self, feature: str) -> tuple[int, float]:
        got = self.known.get(feature)
        if got is None:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            number = lambda seed: int(hashlib.md5(f"{seed}:{feature}".encode()).hexdigest()[:16], 16)
            got = self.known[feature] = (number(1) % self.dim, 1.0 if number(2) & 1 else -1.0)
        return got

    def vector(self, text: str | None) -> np.ndarray:
        words = [w for w in _NOT_PLAIN.split((text or "").lower()) if len(w) > 2 and w not in T.STOP_WORDS]
        packed = _NOT_PLAIN.sub("", (text or "").lower())
        counts = Counter("w:" + w for w in words)
        for n in (3, 4, 5):
            counts.update("c:" + packed[i : i + n] for i in range(len(packed) - n + 1))
        out = np.zeros(self.dim)
        if counts:
            place, sign = zip(*map(self._place, counts), strict=True)
            np.add.at(out, list(place), np.array(sign) * (1.0 + np.log(np.fromiter(counts.values(), float, len(counts)))))
        norm = math.sqrt(float(out @ out))
        return out / norm if norm > 0 else out


_NOT_PLAIN = re.compile(r"[^a-z0-9]+")
#: Queries that one pass over the documents scores; more take further passes.
QUERIES_A_PASS = 5_000


def dense(docs: DataFrame, queries: DataFrame, *, id_: str, text: str, query_id: str, query_text: str, k: int | None = 10, least: float = 0.12, dim: int = 1024) -> DataFrame:
    """(query_id, id, score, rank) by cosine of the hashed vectors, those under the floor left out.

    Each pass broadcasts the vectors of at most `QUERIES_A_PASS` queries; documents are embedded where they lie and multiplied
    with them in blocks, so only pairs above the floor leave their task, and with k only each block's k best.
    """
    few = [tuple(r) for r in queries.select(query_id, query_text).orderBy(query_id).collect()]
    spark, kinds = docs.sparkSession, (queries.schema[query_id].dataType.simpleString(), docs.schema[id_].dataType.simpleString())
    shape, id_type = f"{query_id} {kinds[0]}, {id_} {kinds[1]}, score double", to_arrow_type(queries.schema[query_id].dataType)
    scored = spark.createDataFrame([], shape)
    for at in range(0, len(few), QUERIES_A_PASS):
        shared = spark.sparkContext.broadcast(few[at : at + QUERIES_A_PASS])

        def work(batches, shared=shared):
            import pyarrow as pa

            embed_ = Hashing(dim)
            wanted = np.stack([embed_.vector(t) for _, t in shared.value])
            names = pa.array([i for i, _ in shared.value], id_type)
            for whole in batches:
                for first in range(0, whole.num_rows, 256):
                    batch = whole.slice(first, 256)
                    mine = np.stack([embed_.vector(t) for t in batch.column(text).to_pylist()])
                    score = np.round(wanted @ mine.T, 9)
                    q, d = np.nonzero(score >= least)
                    if k is not None and len(q):
                        order = np.lexsort((d, -score[q, d], q))
                        q, d = q[order], d[order]
                        begin = np.searchsorted(q, q)
                        near = score[q, d] >= score[q, d[np.minimum(begin + k - 1, np.searchsorted(q, q, "right") - 1)]]
                        q, d = q[near], d[near]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column(id_).take(pa.array(d)), pa.array(score[q, d])], [query_id, id_, "score"])

        scored = scored.union(docs.select(id_, text).mapInArrow(work, shape))
    return ranked(scored, query_id, id_, k)


def fuse(rankings: list[DataFrame], query_id: str, id_: str, k: int = 10, authority: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of rankings that list everything they found, with a last ten-thousandth for authority (id, authority)."""
    all_ = rankings[0].select(query_id, id_, "rank")
    for r in rankings[1:]:
        all_ = all_.unionByName(r.select(query_id, id_, "rank"))
    fused = all_.groupBy(query_id, id_).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"))
    if authority is not None:
        fused = fused.join(authority.select(id_, "authority"), id_, "left").withColumn("score", F.col("score") + 1e-4 * F.coalesce("authority", F.lit(0.0))).drop("authority")
    return ranked(fused.withColumn("score", F.round("score", 12)), query_id, id_, k)


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the query's."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(T.tokens(a), T.tokens(b))).cast("double"), F.size(F.array_distinct(T.tokens(a))).cast("double")), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def recall_and_mrr(results: DataFrame, truth: DataFrame, query_id: str, id_: str) -> DataFrame:
    """top1, mrr and n over the queries of a golden set (query_id, id)."""
    found = truth.join(results.select(query_id, id_, "rank"), [query_id, id_], "left").groupBy(query_id).agg(F.min("rank").alias("rank"))
    return found.agg(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("top1"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n"))


def compact(text: Column, longest: int = 480) -> Column:
    tidy = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(tidy) > longest, F.concat(F.left(tidy, F.lit(longest)), F.lit("…"))).otherwise(tidy)
