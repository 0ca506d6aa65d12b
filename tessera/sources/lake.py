"""Bronze, silver and gold as tables: raw payloads by content, records with provenance and quality, and tables made from them.

Everything is written by Spark's own commit, so a table is there as a whole or not at all. Places are folders that driver
and executors share; a folder or table is given by the caller.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dedupe, quality
from tessera.sources.shared import kept


def readable(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The Parquet table at a path, or None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def replace_table(df: DataFrame, name: str) -> DataFrame:
    """Creates a table from df or takes its place; df may read the table itself, since it is computed first."""
    kept(df, "table").write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def replace_folder(df: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """Replaces what a folder holds; df may read from it."""
    spark = df.sparkSession
    kept(df, "folder").write.mode("overwrite").format(kind).save(path)
    return spark.read.schema(df.schema).format(kind).load(path)


def versioned_csv(df: DataFrame, root: str, name: str, version: str) -> str:
    """A report as name@version, with a header; a version that is written again takes the old one's place."""
    path = f"{root.rstrip('/')}/{name}@{version}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def append_audit(df: DataFrame, path: str, run_id: str) -> None:
    """Adds a run's rows to an audit; a run that is written twice is in it once, and other runs stay as they are."""
    df.drop("run_id").withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


MANIFEST = "source_id string, resource_id string, filename string, sha256 string, bytes long, retrieved_at string, ingestion_method string, meta string"


def write_bronze(payloads: DataFrame, root: str, *, source: str, method: str = "live", now: Column | None = None) -> DataFrame:
    """Stores payloads (resource_id, filename, payload, meta) that this source hasn't stored yet, and gives a manifest row for each.

    Content decides: a payload whose digest is known for its source and resource is not written again. Payloads and manifest are
    tables beside each other, added to and never changed.
    """
    spark, at = payloads.sparkSession, (now if now is not None else F.current_timestamp()).cast("string")
    known = readable(spark, f"{root}/manifest")
    new = payloads.withColumn("sha256", F.sha2(F.col("payload").cast("binary"), 256)).dropDuplicates(["resource_id", "sha256"])
    if known is not None:
        new = new.join(known.where(F.col("source_id") == source).select("resource_id", "sha256").distinct(), ["resource_id", "sha256"], "left_anti")
    new = kept(new.select(F.lit(source).alias("source_id"), "resource_id", "filename", "sha256", F.octet_length("payload").cast("long").alias("bytes"), at.alias("retrieved_at"), F.lit(method).alias("ingestion_method"), F.col("meta").cast("string").alias("meta"), F.col("payload").cast("binary").alias("payload")), "bronze")
    new.write.mode("append").partitionBy("source_id").parquet(f"{root}/payloads")
    manifest = new.drop("payload")
    manifest.write.mode("append").parquet(f"{root}/manifest")
    return manifest


def silver(rows: DataFrame, *, run_id: str, method: str, source: str, licence: str, authority: str, today: Column, published: str | None = None) -> DataFrame:
    """Records with what they lack of source, licence and authority, a quality struct, and run provenance (run_id, ingestion_method, record_hash)."""
    have = set(rows.columns)
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v)
    out = rows.withColumns({"source": default("source", source), "source_id": default("source_id", source), "license": default("license", licence), "authority": default("authority", authority), "authority_level": default("authority_level", authority), "ingested_at": today.cast("string")})
    cols = lambda names: [F.col(c).cast("string") for c in names if c in have]
    signals = quality.quality_signals(
        authority=F.col("authority"), published=F.to_date(published) if published else F.lit(None).cast("date"), today=today.cast("date"), required=[F.col("source"), F.col("license"), F.col("ingested_at")],
        location=cols(("state", "district", "location")), crop=cols(("crop", "crop_id")), evidence=cols(("source_url", "evidence", "document", "page", "references")),
        verified=F.col("expert_verified") if "expert_verified" in have else F.lit(False), licence=F.col("license"),
    )
    hash_ = dedupe.record_hash([c for c in rows.columns if not c.startswith("_")])
    made = F.struct(*[v.alias(k) for k, v in signals.items()], quality.quality_score(signals).alias("quality_score"))
    return out.withColumns({"quality": made, "record_hash": hash_, "run_id": F.lit(run_id), "ingestion_method": F.lit(method)})


def gold(records: DataFrame, path: str, name: str) -> DataFrame:
    """A gold table from silver records: the latest record of each hash."""
    return replace_folder(records.dropDuplicates(["record_hash"]), f"{path}/{name}")


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's schema and rows that doesn't depend on their order: a sum of 128 bits of hash, and the count."""
    cells = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}) if df.columns else F.lit("")
    half = lambda seed: F.sum(F.xxhash64(cells, F.lit(seed)).cast("decimal(38,0)"))
    r = df.agg(half(1).alias("a"), half(2).alias("b"), F.count("*").alias("n")).first()
    shape = ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields))
    import hashlib

    return hashlib.sha256(f"{shape}|{r['a']}|{r['b']}|{r['n']}".encode()).hexdigest()


def rebuilt(spark: SparkSession, state: str, name: str, inputs: list[DataFrame], build: Callable[[], None]) -> bool:
    """Runs build unless the inputs' fingerprints are those of its last run, which the table at `state` holds; says whether it ran."""
    now = "+".join(map(fingerprint, inputs))
    past = readable(spark, state)
    if past is not None and not past.where((F.col("name") == name) & (F.col("digest") == now)).isEmpty():
        return False
    build()
    fresh = spark.createDataFrame([(name, now)], "name string, digest string")
    replace_folder(fresh if past is None else past.where(F.col("name") != name).select("name", "digest").unionByName(fresh), state)
    return True


def json_schema(df: DataFrame, title: str) -> str:
    """A JSON Schema of a table's rows."""
    kinds = {"string": "string", "boolean": "boolean", "double": "number", "float": "number", "int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer"}

    def of(t) -> dict:
        name = t.simpleString()
        if name.startswith("array"):
            return {"type": "array", "items": of(t.elementType)}
        if name.startswith("struct"):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in t.fields}}
        if name.startswith("decimal"):
            return {"type": "number"}
        return {"type": kinds[name]} if name in kinds else {"type": "string", "format": "date" if name == "date" else "date-time"} if name.startswith(("date", "timestamp")) else {"type": "object"}

    fields = df.schema.fields
    return json.dumps({"title": title, "type": "object", "properties": {f.name: of(f.dataType) for f in fields}, "required": [f.name for f in fields if not f.nullable]}, indent=2)


def discovered(df: DataFrame, path: str, source: str) -> DataFrame:
    """Keeps a source's fields (field, type, position) as its latest snapshot; other sources' stay."""
    spark = df.sparkSession
    rows = spark.createDataFrame([(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)], "field string, type string, position int")
    rows.withColumn("source_id", F.lit(source)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)
    return spark.read.parquet(path)
