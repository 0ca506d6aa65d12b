"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread

from . import ann, bpe, language_id, media, near_dedup, packing, quality, secret_scan, sharding, substring_dedup
from .files import tokenizer_file, tokenizer_pattern

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def documents(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    """Documents over all cores, even if they lie in one row group."""
    return spread(table(spark, base, "documents").select(*columns))


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir, "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), ranks=tokenizer_file("byte_bpe_50k.tiktoken"), pattern=tokenizer_pattern())
    return packing.crc(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), size=2, threshold=0.8)


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, from 16 shards to 24 of near equal bytes; the columns come from the rewritten files."""
    placed, plan = sharding.reshard(table(spark, sf_dir, "documents").select("doc_id", "text"), old_shards=16, new_shards=24)
    plan.affected.update(range(24))  # the old shards have no files yet: every shard is written
    stored = sharding.rewrite(placed, plan)
    text = F.coalesce("text", F.lit(""))
    return stored.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("__old").alias("old_shard"),
    )


def language_model(docs: DataFrame) -> language_id.TextModel:
    """Fitted on rows outside the fifth that is held out."""
    return language_id.fit(docs.where("crc32(cast(doc_id as string)) % 5 <> 0"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no address: the source stands for the host."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source", "lang")
    found = language_id.identify(docs.drop("lang"), language_model(docs), host=F.col("source"))
    return found.select("doc_id", F.col("__language").alias("language"), F.col("__posterior").alias("posterior"), F.col("__text_language").alias("text_language"), F.col("__accepted").alias("accepted"))


@query
def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with all its evidence: markup language, address suffix and host."""
    pages, html, url = table(spark, sf_dir, "pages").select("page_id", "url", "html"), F.col("html"), F.col("url")
    found = language_id.identify(pages, language_model(table(spark, sf_dir, "documents")), text=language_id.visible_text(html), host=F.try_parse_url(url, F.lit("HOST")), suffix=language_id.address_suffix(url), declared=language_id.markup_language(html))
    return found.select("page_id", F.col("__language").alias("language"), F.col("__posterior").alias("posterior"), F.col("__text_language").alias("text_language"), F.col("__accepted").alias("accepted"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir, "doc_id", "text"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled rows outside the held-out fifth; scores every document."""
    held_out = "crc32(cast(doc_id as string)) % 5 = 0"
    docs, labels = documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(f"not ({held_out})"))
    scored = docs.withColumn("score", quality.score(model, spark, F.col("text")))
    return scored.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits")


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir, "doc_id", "text"), tokenizer_file("word_bpe_49k.json"), digests=True)


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    return secret_scan.findings_of(secret_scan.scan(docs, secret_scan.train(spark), path="source"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLES["op9_near_dedup"] = """with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws from documents),
s as (select doc_id, case when len(ws) < 2 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end sh from w),
x as (select doc_id, len(sh) n, unnest(sh) g from s),
shared as (select a.doc_id p, b.doc_id q, any_value(a.n) np, any_value(b.n) nq, count(*) c from x a join x b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.doc_id, b.doc_id),
links as (select p, q from shared where 100 * c >= 80 * (np + nq - c)),
edges as (select p, q from links union all select q, p from links),
reach(id, other) as (select doc_id, doc_id from documents union select id, q from reach join edges on p = other)
select s.doc_id, len(sh)::bigint n_shingles, component_id, s.doc_id = component_id as kept from s join (select id, min(other) component_id from reach group by id) c on c.id = s.doc_id"""
