"""MinHash-style near-duplicate detection with SetSketch registers.

A document's set holds its distinct word shingles. For each of m registers, every shingle draws an exponential variate; the
register keeps the smallest, on a logarithmic scale with base `BASE` and cut to 16 bits. Registers of unions are maxima of
registers, so sketches merge, and two registers are equal with about the Jaccard similarity of the sets.

The plan: one map over the texts gives sketches; equal sets become one class, stood for by its smallest id, and a member
whose text differs from that of its class is confirmed against it on the full sets. Bands of registers give buckets, and links are
found in two rounds, so no pair within a group is written out. First each class is compared with one other class only: the
centre (smallest id) that most of its buckets share. Then buckets that still hold several components are resolved:

* up to `SMALL` members: all pairs of different components, so at most `SMALL` for each row of a bucket;
* larger: an exact join on differences from a reference set. The reference is the component that most members are in, as the
  shingles that most of a sample of it have; any set would give right results, a near one gives short differences. Two sets
  x and y reach the threshold t only if their differences from the reference, X and Y, have |X xor Y| <= (1 - t) / (1 + t) * (|x| + |y|),
  so they share so many elements that one is among the first few of each, the rarest ones coming first. Only sets outside the
  reference's component look for partners. A large group of copies edited apart shares its common text with the reference, so
  what is left to join on are its edits, which hardly any two have in common.

A pair counts as a candidate if the likelihood of its register comparison (greater, smaller, equal; cardinalities known) at the
best similarity doesn't speak clearly against the threshold, and candidates are confirmed on the full shingle sets. Components
come from minimum labels with pointer jumping, as tables.

At similarity 0.8, 32 bands of 5 registers miss a pair with probability 3e-6; above that, less.

Defined results: null or empty texts, and texts of white space, have no shingles, are linked with nothing and kept. Fewer
words than a shingle has: the whole sequence is the one shingle. Rows with equal ids are one node. Rows with a null id
take part in nothing: component null, kept true. Ties don't arise: classes and components take their smallest id.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, map_arrow, mix64, text_blocks, words, written

BASE, RATE, TOP = 1.001, 20.0, 65535
BANDS, ROWS = 32, 5
#: Twice the log of the likelihood ratio at which a pair is no candidate: for a pair at the threshold, chance below 1e-7.
AGAINST = 30.0
#: Members of a bucket up to which the last round compares them in pairs.
SMALL = 16
#: Members of a component whose shingles are counted for its reference set; it decides how fast, not what, is found.
REFERENCE = 33
#: Ids of rows whose texts are looked at again, up to which they are broadcast to fetch the texts; beyond it, a join by shuffle.
BROADCAST_IDS = 250_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _draws(m: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:m] | np.uint64(1), seeds[m:]


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingle hashes of one text's word hashes."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = hashes[: n - size + 1]
    for k in range(1, size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - size + 1 + k])
    return np.unique(mix64(out ^ np.uint64(size)))


def registers(elements: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes."""
    least = np.full(len(mul), np.uint64(2**64 - 1))
    for at in range(0, len(elements), 1024):
        least = np.minimum(least, (np.multiply.outer(elements[at : at + 1024], mul) + add).min(axis=0))
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(smallest, 1e-300)) / math.log(BASE)), 0, TOP).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def log_likelihood(j, greater, smaller, equal, n_u, n_v):
    """Of similarity j, given how many registers of u are greater, smaller and equal, and the cardinalities."""
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1)
    up, down = p(u - v * j), p(v - u * j)
    return greater * np.log(up) + smaller * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))


def plausible(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sketches (rows) may reach the threshold, and their likeliest similarities."""
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    greater, smaller = (regs_a > regs_b).sum(1), (regs_a < regs_b).sum(1)
    equal = regs_a.shape[1] - greater - smaller
    best, likeliest = np.full(len(n_a), -np.inf), np.zeros(len(n_a))
    for part in np.linspace(0.005, 1, 120):
        now = log_likelihood(part * most, greater, smaller, equal, n_a, n_b)
        likeliest = np.where(now > best, part * most, likeliest)
        best = np.maximum(best, now)
    at = np.full(len(n_a), -np.inf)
    for part in np.linspace(0, 1, 40):
        at = np.maximum(at, log_likelihood(threshold + part * np.maximum(most - threshold, 0), greater, smaller, equal, n_a, n_b))
    return (most >= threshold - 1e-9) & (2 * (best - at) <= AGAINST), likeliest


def shingle_set(text: str, size: int) -> set:
    found = _WORD.findall(text.translate(_LOWER))
    size = min(size, len(found))
    return set(zip(*(found[k:] for k in range(size)), strict=False)) if found else set()


def sketches(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, regs, th); d1 and d2 are 128 bits of a digest of the set, th of the text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _draws(BANDS * ROWS)
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column("text")):
                hashes, owner, _ = words(data, offsets)
                cuts = np.searchsorted(owner, np.arange(end - first + 1))
                raw, ends = data.tobytes(), offsets.tolist()
                count, digest, regs, own = [], [], [], []
                for i in range(end - first):
                    own.append(hashlib.blake2b(raw[ends[i] : ends[i + 1]], digest_size=16).digest())
                    found = shingles(hashes[cuts[i] : cuts[i + 1]], size)
                    count.append(len(found))
                    digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    regs.append(registers(found, mul, add).tobytes() if len(found) else None)
                halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(count, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(regs, pa.binary()), pa.array(own, pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "regs", "th"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, work, f"doc_id {kind}, n_shingles long, d1 long, d2 long, regs binary, th binary")


def _candidates(pairs: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """Of distinct pairs (a, b) those whose sketches don't speak against a link, with the likeliest similarity j."""
    side = lambda c: sketch.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("regs").alias(f"r_{c}"))
    kind = sketch.schema["rep"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(n, -1) for c in ("r_a", "r_b"))
            good, j = plausible(ra, rb, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j)], ["a", "b", "j"]).filter(pa.array(good))

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-6)
    return map_arrow(both.select("a", "b", "n_a", "n_b", "r_a", "r_b"), work, f"a {kind}, b {kind}, j double")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose full sets reach the threshold."""
    kind = texts.schema["rep"].dataType.simpleString()
    hundredths = round(threshold * 100)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            good = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("t_a"), batch.column("t_b"), strict=True):
                if a != last or len(left) > 100_000:
                    last, left = a, shingle_set(ta.as_py(), size)
                right = shingle_set(tb.as_py(), size)
                both = len(left & right)
                good.append(100 * both >= hundredths * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda c: texts.select(F.col("rep").alias(c), F.col("text").alias(f"t_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return map_arrow(both.select("a", "b", "t_a", "t_b"), work, f"a {kind}, b {kind}")


def _texts(source: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, text) of the ids, each different text of an id once."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    rows = source.join(ids, "rep", "left_semi")
    return written(rows.groupBy("rep", F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text")).select("rep", "text"), "texts")


def classes_of(sketch: DataFrame, source: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(d1, d2, rep, other, n_shingles, regs): the classes of equal digests, and (rep): the ids that their class's set doesn't confirm.

    Equal texts need no comparison; other members of a class are compared with its representative on the full sets.
    """
    real = sketch.where("doc_id is not null and n_shingles > 0")
    found = real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"), F.min_by(F.struct("n_shingles", "regs", "th"), "doc_id").alias("s"))
    classes = written(found.select("d1", "d2", "rep", "other", "s.*"), "classes")
    copied = classes.where("rep <> other").select("d1", "d2", F.col("rep").alias("a"), F.col("th").alias("t"))
    doubtful = real.join(copied, ["d1", "d2"]).where("doc_id <> a and th <> t").select("a", F.col("doc_id").alias("b")).distinct()
    doubtful = written(doubtful, "doubtful")
    if doubtful.isEmpty():
        return classes, doubtful.select(F.col("b").alias("rep"))
    texts = _texts(source, doubtful.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    sure = _confirmed(doubtful, texts, size, threshold)
    return classes, written(doubtful.join(sure, ["a", "b"], "left_anti").select(F.col("b").alias("rep")).distinct(), "unconfirmed")


def _hashed_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashed shingle set) of the column text."""
    for first, end, data, offsets in text_blocks(batch.column("text")):
        hashes, owner, _ = words(data, offsets)
        cuts = np.searchsorted(owner, np.arange(end - first + 1))
        for i in range(end - first):
            yield first + i, shingles(hashes[cuts[i] : cuts[i + 1]], size)


def _small_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components within buckets of at most SMALL rows."""
    held = buckets.groupBy("key").agg(F.collect_list(F.struct("rep", "component")).alias("held"))
    pairs = F.transform("held", lambda x: F.transform(F.filter("held", lambda y: (y["rep"] > x["rep"]) & (y["component"] != x["component"])), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b"))))
    return held.select(F.explode(F.flatten(pairs)).alias("p")).select("p.a", "p.b")


def _differences(buckets: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(ref, rep, component, n, q, order): for each rep of large buckets and each reference, its set's size, and its q
    differences from the reference, those that fewest reps of this reference have first."""
    kind = texts.schema["rep"].dataType.simpleString()
    votes = buckets.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("ref"))
    members = written(buckets.join(votes, "key").select("ref", "rep", "component").distinct(), "members")
    nth = F.row_number().over(Window.partitionBy("ref").orderBy(F.xxhash64("rep"), "rep"))
    sample = members.where("component = ref").select("ref", "rep", nth.alias("nth")).where(F.col("nth") <= REFERENCE)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in _hashed_sets(batch, size):
                yield pa.RecordBatch.from_arrays([batch.column("ref").take(pa.array(np.full(len(found), i))), pa.array(found.view(np.int64))], ["ref", "e"])

    chosen = written(sample.join(texts, "rep").select("ref", "text"), "sample")
    many = chosen.groupBy("ref").agg(F.count("*").alias("many"))
    common = map_arrow(chosen, hashed, f"ref {kind}, e long").groupBy("ref", "e").agg(F.count("*").alias("times")).join(many, "ref").where("2 * times > many")
    cores = written(common.groupBy("ref").agg(F.collect_list("e").alias("core")), "cores")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores_, last, core = batch.column("core"), None, None
            refs = batch.column("ref").to_pylist()
            for i, found in _hashed_sets(batch, size):
                if core is None or refs[i] != last:
                    last, core = refs[i], np.sort(cores_[i].values.to_numpy().view(np.uint64)) if cores_[i].is_valid else np.zeros(0, np.uint64)
                out = np.setxor1d(found, core, assume_unique=True).view(np.int64)
                if not len(out):  # one row says that there is none
                    out = pa.nulls(1, pa.int64())
                    q = 0
                else:
                    q = len(out)
                    out = pa.array(out)
                take = pa.array(np.full(len(out), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("ref", "rep", "component", "h")), pa.array(np.full(len(out), len(found))), pa.array(np.full(len(out), q)), out], ["ref", "rep", "component", "h", "n", "q", "e"])

    rows = members.join(texts, "rep").join(cores, "ref", "left").select("ref", "rep", "component", F.xxhash64("text").alias("h"), "text", "core")
    rows = written(map_arrow(rows, work, f"ref {kind}, rep {kind}, component {kind}, h long, n long, q long, e long"), "differences")
    times = rows.where("e is not null").groupBy("ref", "e").agg(F.count("*").alias("times"))
    ranked = rows.join(times, ["ref", "e"], "left").groupBy("ref", "rep", "component", "h", "n", "q").agg(F.sort_array(F.collect_list(F.when(F.col("e").isNotNull(), F.struct("times", "e")))).alias("order"))
    return written(ranked.select("ref", "rep", "component", "n", "q", F.col("order.e").alias("order")), "ordered")


def _large_pairs(buckets: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, for buckets of any size, by differences from references.

    With k = (1 - t) / (1 + t) and g = q - k * n, two sets are linked only if |X xor Y| <= k * (n_x + n_y), which makes the
    elements that X and Y share at least (g_x + g_y) / 2. Where that is positive, their first shared element in the common order
    has at least so many elements of each behind it or in it. Where it isn't, both are linked for sure, and each of
    them to the set of the least g, which stands in for all such pairs.
    """
    k = (1 - threshold) / (1 + threshold)
    sets = _differences(buckets, texts, size).withColumn("g", F.col("q") - F.lit(k) * F.col("n"))
    outside = F.col("component") != F.col("ref")
    bounds = sets.groupBy("ref").agg(F.min("g").alias("least"), F.min(F.when(outside, F.col("g"))).alias("least_out"), F.min_by(F.struct("rep", "component"), "g").alias("near"))
    sets = sets.join(bounds, "ref")
    shared = lambda total: F.greatest(F.lit(1), F.ceil(total / 2 - 1e-6))  # noqa: E731  elements that a pair must share

    def heads(rows: DataFrame, least: str, c: str) -> DataFrame:
        many = F.col("q") - shared(F.col("g") + F.col(least)) + 1
        cut = rows.where(many > 0).select("ref", F.posexplode(F.slice("order", F.lit(1), many.cast("int"))).alias("i", "e"), "rep", "component", "n", "q", "g")
        return cut.select("ref", "e", F.col("rep").alias(c), F.col("component").alias(f"c{c}"), F.col("n").alias(f"n{c}"), (F.col("q") - F.col("i")).alias(f"l{c}"), F.col("g").alias(f"g{c}"))

    x, y = heads(sets.where(outside), "least", "x"), heads(sets.where("least_out is not null"), "least_out", "y")
    met = x.join(y, ["ref", "e"]).where((F.col("cx") != F.col("cy")) & (F.least("nx", "ny") >= threshold * F.greatest("nx", "ny") - 1e-6) & (F.least("lx", "ly") >= shared(F.col("gx") + F.col("gy"))))
    stars = sets.where((F.col("g") + F.col("least") <= 1e-6) & (F.col("component") != F.col("near.component"))).select(F.col("rep").alias("x"), F.col("near.rep").alias("y"))
    return met.select("x", "y").union(stars).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, component) for the ids of edges (a, b); the component is the smallest id reachable.

    Each round takes the least label of the neighbours and then the label of that label, so paths halve; every round's
    labels are a table in the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("component")), "labels")
    for _ in range(most_rounds):
        low = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("low"))
        step = labels.join(low, "id").select("id", F.col("component").alias("old"), F.least("component", "low").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("far"))
        after = written(step.join(jump, "new").select("id", "old", F.least("new", "far").alias("component")), "labels")
        changed = after.where("component <> old").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components aren't settled after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, *, size: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    sketch = written(sketches(docs, size, doc_id, text), "sketches")
    source = docs.select(F.col(doc_id).alias("rep"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("rep is not null")
    real = sketch.where("doc_id is not null and n_shingles > 0")
    classes, unconfirmed = classes_of(sketch, source, size, threshold)
    alone = not unconfirmed.isEmpty()
    reps = classes.select("rep", "n_shingles", "regs")
    if alone:
        reps = reps.union(real.join(unconfirmed, F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", "n_shingles", "regs"))

    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("regs", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)])
    bands = reps.select("rep", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    members = written(bands.join(shared.select("key"), "key", "left_semi"), "members")
    involved = written(members.select("rep").distinct(), "involved")
    texts = _texts(source, involved)
    sketch_in = written(reps.join(involved, "rep", "left_semi"), "sketches-in")

    # ids shared by different texts tie the classes of these texts
    ties = real.select("d1", "d2", "doc_id").join(classes, ["d1", "d2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    again = real.groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x <> y").select(F.col("doc_id").alias("b"))
    ties = written(ties.join(again, "b", "left_semi").distinct(), "ties")

    def links(pairs: DataFrame) -> DataFrame:
        likely = written(_candidates(pairs.distinct(), sketch_in, threshold).select("a", "b"), "candidates")
        return written(_confirmed(likely, texts, size, threshold), "links")

    # first, the one centre that most buckets of a class share
    centres = members.groupBy("key").agg(F.min("rep").alias("a"))
    counted = members.join(centres, "key").where("rep <> a").groupBy("rep", "a").agg(F.count("*").alias("n"))
    total = ties.unionByName(links(counted.groupBy(F.col("rep").alias("b")).agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")))
    labels = components(total)

    # then whatever is in one bucket and in different components
    labelled = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("many")).where("x < y").select("key", "many")
    apart = written(labelled.join(mixed, "key"), "apart")
    last = links(_small_pairs(apart.where(F.col("many") <= SMALL)).union(_large_pairs(apart.where(F.col("many") > SMALL), texts, size, threshold)))
    if not last.isEmpty():
        labels = components(total.unionByName(last))

    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"), F.expr("rep < other or component is not null").alias("moved")).where("moved").drop("moved")
    linked = sketch.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    if alone:
        own = unconfirmed.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("rep").alias("doc_id"), F.coalesce("component", "rep").alias("own"))
        linked = linked.join(own, "doc_id", "left").withColumn("component_id", F.coalesce("own", "component_id")).drop("own")
    part = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(part, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, size: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that aren't kept; one row of each id stays."""
    out = near_duplicates(docs, size=size, threshold=threshold, doc_id=doc_id, text=text)
    (key,) = fresh(docs, "kept_id")
    kept = written(out.where("kept and doc_id is not null").select(F.col("doc_id").alias(key)).distinct(), "kept")
    named = docs.where(F.col(doc_id).isNotNull()).join(kept, F.col(doc_id) == F.col(key), "left_semi").dropDuplicates([doc_id])
    return named.unionByName(docs.where(F.col(doc_id).isNull()))
