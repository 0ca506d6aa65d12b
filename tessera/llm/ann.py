"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform turn a unit vector pseudo-randomly; its bucket is the signed
axis nearest to it, or a pair of axes of two turns, so that a bucket has about `PART_ROWS` rows. Every vector lies in one bucket
of each table; a query probes, in each table, the buckets in the order of its own coordinates on their axes. What the probed buckets hold is
scored by the exact inner product of the original vectors, bucket by bucket in blocks, and only each bucket's best go on
to the final ranking. Nearness is the inner product: if norms differ, vectors get one more coordinate that makes them
equally long, so the largest inner product is the nearest direction.

How many buckets are probed is measured, not guessed: `CALIBRATE` queries are compared with every row, and the number of
probes is the smallest that finds `target` of their true neighbours in these tables; it may be all buckets, which is exact.
Queries that have found fewer than k rows although there are more are compared with every row, in blocks of queries.

Equal vectors are equally near, so of each group of them only the k + 1 smallest ids can be among anyone's nearest; the
rest needs no index, and equal queries are searched once. Large buckets are dealt into parts of their rows and of their queries,
each of the one meeting each of the other. Vectors travel in the table's own precision and are compared in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those whose
length isn't the most common one. Ties go to the smaller id. Fewer candidates than k: all that are found. Rows with
null ids take no part; rows with equal ids and equal vectors count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, mix64, written

TABLES = 8
CALIBRATE = 48
#: Rows, and queries, that a part of a bucket holds at most, about.
PART_ROWS = 20_000
TARGET = 0.97
#: Queries that one pass over all rows compares.
EXACT_QUERIES = 2_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two, kept at the same norm."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class Hash:
    """The turns of all tables; pickled as its parameters."""

    def __init__(self, dim: int, tables: int, axes: int, longest: float, seed: int = 1):
        self.dim, self.tables, self.axes, self.longest = dim, tables, axes, longest
        self.width = 1 << max(1, (dim + (longest > 0) - 1).bit_length())
        bits = mix64(np.arange(tables * axes * 3 * self.width, dtype=np.uint64) + np.uint64(seed << 32))
        self.signs = np.where(bits & np.uint64(1), 1.0, -1.0).reshape(tables, axes, 3, self.width)

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rows of equal length in self.width dimensions; longest > 0 is the largest norm, for inner products."""
        out = np.zeros((len(x), self.width))
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if self.longest and not query:
            out[:, : self.dim] = x / self.longest
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / self.longest) ** 2))
        else:
            out[:, : self.dim] = x / norm
        return out

    def turned(self, x: np.ndarray, table: int, axis: int) -> np.ndarray:
        for k in range(3):
            x = hadamard(x * self.signs[table, axis, k])
        return x

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row in a table."""
        out = np.zeros(len(unit), np.int64)
        for a in range(self.axes):
            y = self.turned(unit, table, a)
            at = np.abs(y).argmax(1)
            out = out * 2 * self.width + 2 * at + (y[np.arange(len(y)), at] < 0)
        return out

    @property
    def most(self) -> int:
        """Buckets of a table."""
        return (2 * self.width) ** self.axes

    def sums(self, unit: np.ndarray, table: int) -> np.ndarray:
        """How near each row is to each bucket of a table."""
        total = None
        for a in range(self.axes):
            y = self.turned(unit, table, a)
            now = np.stack((y, -y), axis=2).reshape(len(y), -1)
            total = now if total is None else (total[:, :, None] + now[:, None, :]).reshape(len(y), -1)
        return total

    def probes(self, unit: np.ndarray, table: int, many: int) -> np.ndarray:
        """The first `many` buckets of each row, nearest first."""
        out = np.zeros((len(unit), min(many, self.most)), np.int64)
        step = max(1, (1 << 22) // self.most)
        for at in range(0, len(unit), step):
            near = -self.sums(unit[at : at + step], table)
            if many < self.most:
                few = np.argpartition(near, many - 1, axis=1)[:, :many]
                order = np.lexsort((few, np.take_along_axis(near, few, 1)), axis=1)
                out[at : at + step] = np.take_along_axis(few, order, 1)
            else:
                out[at : at + step] = np.argsort(near, axis=1, kind="stable")
        return out

    def place(self, unit: np.ndarray, table: int, bucket: np.ndarray) -> np.ndarray:
        """The place of one bucket in each row's order of probes, or a later one of equal nearness."""
        out = np.zeros(len(unit), np.int64)
        step = max(1, (1 << 22) // self.most)
        for at in range(0, len(unit), step):
            near = self.sums(unit[at : at + step], table)
            own = np.take_along_axis(near, bucket[at : at + step, None], 1)
            out[at : at + step] = (near >= own - 1e-12).sum(1) - 1
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors in double precision; four or eight bytes a component as they were packed."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, f"<f{len(raw) // max(1, dim * len(column))}" if len(column) else "<f8").reshape(-1, dim).astype(np.float64)


def exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of one vector with rows; equal rows give equal values wherever they stand."""
    return (rows * q).sum(axis=1)


def best_of(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) of its k best rows, ties to smaller ids."""
    out = []
    if not len(ids):
        return [(ids, np.zeros(0))] * len(queries)
    for at in range(0, len(queries), 256):
        rough = queries[at : at + 256] @ rows.T
        edge = np.partition(rough, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))] - 1e-9
        for q, line, low in zip(queries[at : at + 256], rough, edge, strict=True):
            near = np.flatnonzero(line >= low)
            value = exact(q, rows[near])
            order = np.lexsort((ids[near], -value))[:k]
            out.append((ids[near][order], value[order]))
    return out


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v: array<double>, vec: its bytes) of the rows that take part."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0.0)).distinct()


def _packed(rows: DataFrame, single: bool, *keep: str) -> DataFrame:
    """v as bytes, in the column vec: of floats where the table has such, else of doubles."""
    names, kind = [*keep], "<f4" if single else "<f8"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            at = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], [*names, "vec"])

    return map_arrow(rows.select(*names, "v"), work, ", ".join(f"{n} long" for n in names) + ", vec binary")


def _calibrated(rows: DataFrame, queries: DataFrame, hash_: Hash, k: int, target: float) -> int:
    """The number of probes that finds the target share of true neighbours of a few queries."""
    few = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATE).collect()
    if not few:
        return 1
    own = np.array([r["vec_id"] for r in few])
    dim = hash_.dim
    q = _matrix(pa.array([bytes(r["vec"]) for r in few], pa.binary()), dim)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("vec"), dim)
            found = best_of(q, ids, x, k + 1)
            at = {int(i): n for n, i in enumerate(ids)}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(q)), [len(i) for i, _ in found]), pa.int32()),
                    pa.array(np.concatenate([i for i, _ in found])),
                    pa.array(np.concatenate([s for _, s in found])),
                    pa.array([x[at[int(j)]].tobytes() for i, _ in found for j in i], pa.binary()),
                ],
                ["q", "vec_id", "score", "vec"],
            )

    ranked = map_arrow(rows, work, "q int, vec_id long, score double, vec binary").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    truth = [r for r in ranked.collect() if r["vec_id"] != own[r["q"]]]
    if not truth:
        return 1
    who = np.array([r["q"] for r in truth])
    x = hash_.unit(_matrix(pa.array([bytes(r["vec"]) for r in truth], pa.binary()), dim), False)
    u = hash_.unit(q, True)[who]
    first = np.full(len(truth), hash_.most - 1)
    for t in range(hash_.tables):
        first = np.minimum(first, hash_.place(u, t, hash_.buckets(x, t)))
    return int(np.sort(first)[min(len(first) - 1, int(np.ceil(target * len(first))))]) + 1


def _exact(index: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """(class, vec_id, score): the k + 1 best of all rows for each query (vec_id, vec), in blocks of queries."""
    out = index.sparkSession.createDataFrame([], "class long, vec_id long, score double")
    blocks = -(-queries.count() // EXACT_QUERIES)
    for n in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).orderBy("vec_id").collect()
        if not block:
            continue
        ids, q = np.array([r["vec_id"] for r in block]), _matrix(pa.array([bytes(r["vec"]) for r in block], pa.binary()), dim)

        def work(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                if batch.num_rows:
                    found = best_of(q, batch.column("vec_id").to_numpy(), _matrix(batch.column("vec"), dim), k + 1)
                    best = found if best is None else [_merge(x, y, k + 1) for x, y in zip(best, found, strict=True)]
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(i) for i, _ in best])), pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["class", "vec_id", "score"])

        out = out.union(map_arrow(index.select("vec_id", "vec"), work, "class long, vec_id long, score double"))
    return out


def axes_for(rows: int, width: int) -> int:
    """One axis as long as its buckets have about PART_ROWS rows, else two."""
    return 1 if rows <= PART_ROWS * 2 * width else 2


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, tables: int = TABLES, target: float = TARGET, probes: int | None = None, axes: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query (a condition on vec_id) its k nearest other rows."""
    spark = vectors.sparkSession
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    rows = valid(vectors, vec_id, embedding)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("high"), F.min(square).alias("low")).orderBy(F.desc("n"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], out)
    dim, total = lengths["d"], lengths["n"]
    longest = float(np.sqrt(lengths["high"])) if lengths["low"] < 0.998 * lengths["high"] else 0.0
    hash_ = Hash(dim, tables, 1, longest)
    hash_ = Hash(dim, tables, axes or axes_for(total, hash_.width), longest)
    rows = rows.where(F.size("v") == dim)
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    index = written(_packed(rows.withColumn("nth", nth).where(F.col("nth") <= k + 1), single, "vec_id"), "vectors")
    asked = rows.where(is_query)
    classes = asked.groupBy("v").agg(F.min("vec_id").alias("class"))
    members = written(asked.join(classes, "v").select(F.col("vec_id").alias("query_id"), "class"), "queries")
    queries = written(_packed(classes.withColumnRenamed("class", "vec_id"), single, "vec_id"), "classes")
    many = min(hash_.most, probes or _calibrated(index, queries, hash_, k, target))

    def keyed(query: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    u = hash_.unit(_matrix(batch.column("vec"), dim), query)
                    for t in range(hash_.tables):
                        b = hash_.probes(u, t, many) if query else hash_.buckets(u, t)[:, None]
                        take = pa.array(np.repeat(np.arange(len(b)), b.shape[1]))
                        yield pa.RecordBatch.from_arrays([pa.array((b * hash_.tables + t).ravel()), batch.column("vec_id").take(take), batch.column("vec").take(take)], ["key", "id", "vec"])

        return work

    shape = "key long, id long, vec binary"
    held, asking = map_arrow(index, keyed(False), shape), map_arrow(queries, keyed(True), shape)
    parts = lambda rows, name: rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PART_ROWS).select(F.col("key").alias("k"), F.ceil(F.col("n") / PART_ROWS).cast("int").alias(name))
    large = written(parts(held, "parts").join(parts(asking, "sides"), "k", "full"), "parts")
    own = lambda n: F.coalesce(F.pmod(F.xxhash64("id"), F.col(n)).cast("int"), F.lit(0))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    held = held.join(large, F.col("key") == F.col("k"), "left").select("key", own("parts").alias("part"), each("sides").alias("side"), F.lit(1).alias("kind"), "id", "vec")
    asking = asking.join(large, F.col("key") == F.col("k"), "left").select("key", each("parts").alias("part"), own("sides").alias("side"), F.lit(0).alias("kind"), "id", "vec")
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * tables // 100_000))
    met = held.union(asking).repartition(n_parts, "key", "part", "side").sortWithinPartitions("key", "part", "side", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of a part come first and stay; its vectors stream past them."""
        state: dict = {"key": None, "ids": [], "vecs": [], "best": None}

        def flush():
            if state["best"] is None:
                return None
            found = state["best"]
            n = [len(i) for i, _ in found]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.concatenate(state["ids"]), n)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["class", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, side, kind, ids = (batch.column(c).to_numpy() for c in ("key", "part", "side", "kind", "id"))
            vec = _matrix(batch.column("vec"), dim)
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
                now = (int(key[a]), int(part[a]), int(side[a]))
                if now != state["key"]:
                    done = flush()
                    if done is not None:
                        yield done
                    state.update(key=now, ids=[], vecs=[], best=None)
                if kind[a] == 0:
                    state["ids"].append(ids[a:b])
                    state["vecs"].append(vec[a:b])
                elif state["ids"]:
                    if len(state["vecs"]) > 1:
                        state["vecs"] = [np.concatenate(state["vecs"])]
                    found = best_of(state["vecs"][0], ids[a:b], vec[a:b], k + 1)
                    if state["best"] is not None:
                        found = [_merge(x, y, k + 1) for x, y in zip(state["best"], found, strict=True)]
                    state["best"] = found
        done = flush()
        if done is not None:
            yield done

    near = map_arrow(met, search, "class long, vec_id long, score double").distinct()
    order = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    first = lambda rows: rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    best = written(first(near), "nearest")
    found = best.groupBy("class").agg(F.count("*").alias("n"))
    short = written(queries.join(found, F.col("vec_id") == F.col("class"), "left").where(F.coalesce("n", F.lit(0)) < min(k + 1, index.count())).select("vec_id", "vec"), "short")
    if not short.isEmpty():
        best = best.join(short.select(F.col("vec_id").alias("class")), "class", "left_anti").unionByName(first(_exact(index, short, dim, k)))
    mine = members.join(best, "class").where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _merge(a: tuple, b: tuple, k: int) -> tuple:
    ids, value = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.lexsort((ids, -value))[:k]
    return ids[order], value[order]
