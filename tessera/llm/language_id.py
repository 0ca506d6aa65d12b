"""Language identification by Bayesian evidence fusion.

Text gives a likelihood for each language from byte trigrams (other signs than letters count as spaces, A-Z as a-z), fitted on
a bounded sample of labelled rows. It is tempered by the square root of the number of trigrams, since neighbouring ones
aren't independent. The priors come from the corpus itself: text-only posteriors are summed by host, by address suffix
and over all rows, and each level is smoothed towards the one above it; a declared markup language counts by how often
rows of each language declare it. All these sums are grouped aggregations over all rows.

A row is rejected (accepted = false) if no trigram of it has a letter, if at least `JUDGED_TRIGRAMS` of them fit no known
language (mean log-likelihood below the floor seen in fitting), or if the best posterior is under one half. Rows with
fewer than `LEAST_TRIGRAMS` don't count in the priors.

A host without counted rows has its suffix's prior, and a suffix without any that of the whole corpus.

Defined results: null or empty texts have no evidence and are rejected, with that prior as posterior. A null host,
suffix or declaration is a value like any other, shared by the rows that have none. A model fitted without any labelled
row knows no language: every row is accepted, language null. Repeated rows get equal results and
count each in the sums. Ties between languages go to the first in the alphabet. Rows stay as they are, in any columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, small_batches, text_blocks, written

BUCKETS = 1 << 16
LEAST_TRIGRAMS = 8
JUDGED_TRIGRAMS = 50
#: Labelled rows that a fit may use for each language, the first by hash.
SAMPLE = 400
#: Pseudo-rows that a level of the hierarchy takes from the level above it.
STRENGTH = 20.0
#: Rows of the tables of hosts, suffixes and declarations up to which each is broadcast; beyond it, they are joined by shuffle.
BROADCAST_ROWS = 100_000

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text's number) of each trigram that holds a letter and lies within one text."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = _FOLD[data].astype(np.uint32)
    a, b, c = x[:-2], x[1:-1], x[2:]
    ok = (a != 32) | (b != 32) | (c != 32)
    ends = offsets[1:-1]
    for back in (1, 2):
        at = ends - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    at = np.flatnonzero(ok)
    code = (a[at] << np.uint32(16)) | (b[at] << np.uint32(8)) | c[at]
    code = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    return code, np.searchsorted(offsets, at, "right") - 1


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: log-likelihoods
    floor: float

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """For each text: tempered log-likelihoods, the number of trigrams, the best mean log-likelihood."""
        k = len(self.languages)
        out = np.zeros((len(texts), k + 2))
        for first, end, data, offsets in text_blocks(texts):
            code, owner = trigrams(data, offsets)
            n = np.bincount(owner, minlength=end - first)
            cuts = np.concatenate(([0], np.cumsum(n)))
            for j in range(k):
                total = np.concatenate(([0.0], np.cumsum(self.table[code, j], dtype=np.float64)))
                out[first:end, j] = total[cuts[1:]] - total[cuts[:-1]]
            out[first:end, k] = n
            mean = out[first:end, :k] / np.maximum(n, 1)[:, None]
            out[first:end, k + 1] = mean.max(axis=1)
            out[first:end, :k] = mean * np.sqrt(n)[:, None]
        return out


def fit(docs: DataFrame, *, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> TextModel:
    """A text model from at most `sample` labelled rows of each language, the first by hash of id and text."""
    rows = docs.where(F.col(label).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(label).alias("label"), F.xxhash64(doc_id, text, F.lit(3)).alias("h"), F.col(text).alias("text"))
    languages = sorted(r[0] for r in rows.select("label").distinct().collect())
    counts = np.full((BUCKETS, len(languages)), 0.02)
    seen = []
    for j, language in enumerate(languages):
        own = rows.where(F.col("label") == language)
        last = own.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # hashes first: no task sends texts that aren't taken
        chosen = sorted(r[0] for r in own.where(F.col("h") <= last).select("text").limit(sample).collect())
        seen.append(pa.array(chosen, pa.string()))
        for _, _, data, offsets in text_blocks(seen[-1]):
            code, owner = trigrams(data, offsets)
            length = np.bincount(owner, minlength=len(offsets) - 1)
            counts[:, j] += np.bincount(code, weights=1000.0 / np.maximum(length[owner], 200), minlength=BUCKETS)
    table = np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32) if languages else counts.astype(np.float32)
    model = TextModel(languages, table, 0.0)
    means = np.concatenate([e[e[:, -2] >= JUDGED_TRIGRAMS, -1] for e in map(model.evidence, seen)]) if languages else np.zeros(0)
    model.floor = float(means.min() - 1.0) if len(means) else 0.0
    return model


def text_evidence(model: TextModel, spark):
    """The model as a function of a text column, giving array<double>; the model goes out once, as a broadcast of 1 MB at most a language."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        found = shared.value.evidence(texts)
        give_back()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))

    # else a filter on what follows from it moves below the joins with a second copy of it: more work, and two workers for each task
    return evidence.asNondeterministic()


def _log_sum(x: Column, k: int) -> Column:
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def _share(total: Column, n: Column, above: Column) -> Column:
    """Counts by language, smoothed towards the shares of the level above."""
    return F.zip_with(total, above, lambda t, a: (t + F.lit(STRENGTH) * a) / (n + F.lit(STRENGTH)))


@dataclass
class Priors:
    hosts: DataFrame  # host, suffix, prior
    suffixes: DataFrame  # suffix, prior
    overall: list[float]
    declared: DataFrame  # declared, weight (log)


def _if_small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def priors(rows: DataFrame, k: int) -> Priors:
    """From rows (host, suffix, declared, ev) over the whole corpus."""
    logs = F.slice("ev", 1, k)
    p = rows.where(F.col("ev")[k] >= LEAST_TRIGRAMS).select("host", "suffix", "declared", F.transform(logs, lambda v: F.exp(v - _log_sum(logs, k))).alias("p"))
    sums = [F.sum(F.col("p")[j]).alias(f"s{j}") for j in range(k)]
    total = F.array(*[F.coalesce(F.col(f"s{j}"), F.lit(0.0)) for j in range(k)])
    cells = written(p.groupBy("host", "suffix", "declared").agg(*sums).select("host", "suffix", "declared", total.alias("t")), "cells")

    def level(*keys: str) -> DataFrame:
        rolled = cells.groupBy(*keys).agg(*[F.sum(F.col("t")[j]).alias(f"s{j}") for j in range(k)]).select(*keys, total.alias("t"))
        return rolled.withColumn("n", F.aggregate("t", F.lit(0.0), lambda a, v: a + v))

    everywhere = level().first()
    n = everywhere["n"] if everywhere else 0.0
    shares = [((everywhere["t"][j] if everywhere else 0.0) + 1.0) / (n + k) for j in range(k)]
    overall = F.array(*[F.lit(x) for x in shares])
    suffixes = written(level("suffix").select("suffix", _share(F.col("t"), F.col("n"), overall).alias("prior")), "suffixes")
    hosts = level("host", "suffix").join(_if_small(suffixes.select(F.col("suffix").alias("sx"), F.col("prior").alias("above"))), F.col("suffix").eqNullSafe(F.col("sx")))
    hosts = written(hosts.select("host", "suffix", _share(F.col("t"), F.col("n"), F.col("above")).alias("prior")), "hosts")
    of_language = F.array(*[F.lit(float(everywhere["t"][j]) if everywhere else 0.0) for j in range(k)])
    declared = level("declared").select("declared", F.zip_with("t", of_language, lambda t, m: F.log((t + F.lit(0.5)) / (m + F.lit(1.0)))).alias("weight"))
    return Priors(hosts, suffixes, shares, written(declared, "declared"))


def address_suffix(url: Column) -> Column:
    """The last label of a URL's host."""
    return F.lower(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), r"([^.]+)$", 1))


def markup_language(html: Column) -> Column:
    """The primary language that the html element declares, or null."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """Without scripts, styles and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")


def identify(docs: DataFrame, model: TextModel, *, text: Column | None = None, host: Column | None = None, suffix: Column | None = None, declared: Column | None = None) -> DataFrame:
    """docs and, as the last four columns, __language, __posterior (of that language), __text_language and __accepted; with more
    underscores where docs has columns of these names.

    Reads the texts twice, for the corpus's priors and for the rows, and shuffles none: the priors of hosts are broadcast up
    to BROADCAST_ROWS hosts, and joined by shuffle (of the rows, with AQE's skew handling) beyond it.
    """
    spark, k = docs.sparkSession, len(model.languages)
    null = F.lit(None).cast("string")
    names_out = fresh(docs, "__language", "__posterior", "__text_language", "__accepted")
    if not k:
        return docs.select("*", *(c.alias(n) for c, n in zip((null, F.lit(None).cast("double"), null, F.lit(True)), names_out, strict=True)))
    evidence = text_evidence(model, spark)
    ev, h, s, d, hh, ss, dd, prior, wide, weight, ws, logs_, best = fresh(docs, "ev_", "host_", "suffix_", "declared_", "hh_", "ss_", "dd_", "prior_", "wide_", "weight_", "ws_", "logs_", "best_")
    own = docs.columns
    keyed = docs.select("*", evidence(text if text is not None else F.col("text")).alias(ev), (host if host is not None else null).alias(h), (suffix if suffix is not None else null).alias(s), (declared if declared is not None else null).alias(d))
    rows = written(keyed.select(F.col(h).alias("host"), F.col(s).alias("suffix"), F.col(d).alias("declared"), F.col(ev).alias("ev")), "evidence")
    known = priors(rows, k)
    hosts = _if_small(known.hosts.select(F.col("host").alias(hh), F.col("suffix").alias(ss), F.col("prior").alias(prior)))
    suffixes = _if_small(known.suffixes.select(F.col("suffix").alias(ws), F.col("prior").alias(wide)))
    # declarations are short codes; texts that claim otherwise are cut by markup_language
    both = keyed.join(hosts, F.col(h).eqNullSafe(F.col(hh)) & F.col(s).eqNullSafe(F.col(ss)), "left")
    both = both.join(suffixes, F.col(s).eqNullSafe(F.col(ws)), "left") if suffix is not None else both.withColumn(wide, F.lit(None).cast("array<double>"))
    zeros = F.array(*[F.lit(0.0)] * k)
    if declared is not None:
        both = both.join(_if_small(known.declared.select(F.col("declared").alias(dd), F.col("weight").alias(weight))), F.col(d).eqNullSafe(F.col(dd)), "left")
    else:
        both = both.withColumn(weight, zeros)
    overall = F.array(*[F.lit(x) for x in known.overall])
    logs = F.zip_with(F.zip_with(F.slice(ev, 1, k), F.coalesce(prior, wide, overall), lambda e, p: e + F.log(p)), F.coalesce(weight, zeros), lambda a, w: a + w)
    both = both.withColumn(logs_, logs).withColumn(best, F.array_position(logs_, F.array_max(logs_)).cast("int"))
    names = F.array(*[F.lit(x) for x in model.languages])
    posterior = F.exp(F.array_max(logs_) - _log_sum(F.col(logs_), k))
    text_best = F.array_position(F.slice(ev, 1, k), F.array_max(F.slice(ev, 1, k))).cast("int")
    accepted = (F.col(ev)[k] > 0) & ((F.col(ev)[k] < JUDGED_TRIGRAMS) | (F.col(ev)[k + 1] >= model.floor)) & (posterior >= 0.5)
    found = (F.element_at(names, F.col(best)), posterior, F.element_at(names, text_best), accepted)
    return both.select(*own, *(c.alias(n) for c, n in zip(found, names_out, strict=True)))
