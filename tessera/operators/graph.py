"""A property graph as two tables: nodes (id, type, label) and edges (source, target, type)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import lake
from tessera.sources.shared import if_small, kept


def nodes_of(table: DataFrame, kind: str, id_: Column, label: Column) -> DataFrame:
    return table.select(F.concat(F.lit(f"{kind}:"), id_.cast("string")).alias("id"), F.lit(kind).alias("type"), label.cast("string").alias("label"))


def edges_of(table: DataFrame, kind: str, source: tuple[str, Column], target: tuple[str, Column]) -> DataFrame:
    end = lambda x: F.concat(F.lit(f"{x[0]}:"), x[1].cast("string"))
    return table.select(end(source).alias("source"), end(target).alias("target"), F.lit(kind).alias("type"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each id: of several, the smallest type and label. Edges are kept as often as they come."""
    return nodes.groupBy("id").agg(F.min(F.struct("type", "label")).alias("n")).select("id", "n.type", "n.label")


def neighbours(nodes: DataFrame, edges: DataFrame, start: Column, direction: str = "out") -> DataFrame:
    """(relation, direction, id, type, label) next to the nodes that meet the condition."""
    parts = []
    if direction in ("out", "both"):
        hit = edges.join(nodes.where(start).select(F.col("id").alias("source")), "source", "left_semi")
        parts.append(hit.select(F.col("type").alias("relation"), F.lit("out").alias("direction"), F.col("target").alias("id")))
    if direction in ("in", "both"):
        hit = edges.join(nodes.where(start).select(F.col("id").alias("target")), "target", "left_semi")
        parts.append(hit.select(F.col("type").alias("relation"), F.lit("in").alias("direction"), F.col("source").alias("id")))
    return union(parts).join(nodes, "id").select("relation", "direction", "id", "type", "label")


def two_hops(edges: DataFrame, first: list[str], second: str, most: int = 8) -> DataFrame:
    """(start, relation, middle, ends): for each edge of the first kinds the targets of its target's edges, sorted, cut."""
    a = edges.where(F.col("type").isin(*first)).select(F.col("source").alias("start"), F.col("type").alias("relation"), F.col("target").alias("middle")).distinct()
    b = edges.where(F.col("type") == second).select(F.col("source").alias("middle"), F.col("target").alias("end"))
    return a.join(b, "middle", "left").groupBy("start", "relation", "middle").agg(F.slice(F.array_sort(F.collect_set("end")), 1, most).alias("ends"))


def by_evidence(edges: DataFrame, relation: str, evidence: DataFrame, most: int = 8) -> DataFrame:
    """(source, matched, evidence): sources with the most edges of a kind to given targets (column target)."""
    hit = edges.where(F.col("type") == relation).join(if_small(evidence.select("target").distinct()), "target")
    return hit.groupBy("source").agg(F.count("*").alias("matched"), F.array_sort(F.collect_list("target")).alias("evidence")).orderBy(F.desc("matched"), "source").limit(most)


def shortest_paths(edges: DataFrame, starts: DataFrame, most: int = 5) -> DataFrame:
    """(start, id, depth, path): a shortest path to every node within so many steps; the start itself isn't reached.

    Each step joins the frontier with the edges and keeps first visits, so cycles end and no path is walked twice. Of
    several shortest paths the one with the smallest list of ids stays. Every frontier is a table, so a step costs one join
    with the edges and one with what was seen, however many came before it; an empty frontier ends the walk.
    """
    arcs = kept(edges.select("source", "target").distinct(), "arcs")
    frontier = starts.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("depth"), F.array("id").alias("path"))
    seen = [frontier]
    for depth in range(1, most + 1):
        step = frontier.join(arcs, frontier["id"] == arcs["source"]).select("start", F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path"))
        step = step.groupBy("start", "id").agg(F.min("path").alias("path"))
        known = functools.reduce(DataFrame.union, [s.select("start", "id") for s in seen])
        new = step.join(known, ["start", "id"], "left_anti").select("start", "id", F.lit(depth).alias("depth"), "path")
        frontier = kept(new, "frontier")
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return functools.reduce(DataFrame.unionByName, seen).where("depth > 0")


def reachable(edges: DataFrame, most: int = 3) -> DataFrame:
    """(start, id): every pair that a walk of one to so many edges joins, once. What a recursive query gives, in SQL level by level.

    Spark ends a recursive query with an error beyond spark.sql.cteRecursionRowLimit rows, and walks a pair once for each of
    its walks. Here a level is a table of first visits, so nothing is bounded by rows and cycles end. Null ends are kept as they
    come; no walk goes on from one.
    """
    spark = edges.sparkSession
    arcs = kept(edges.select(F.col("source").alias("start"), F.col("target").alias("id")).distinct(), "arcs")
    levels = [arcs]
    for _ in range(1, most):
        seen = functools.reduce(DataFrame.union, levels)
        new = kept(spark.sql("select distinct w.start, a.id from {walk} w join {arcs} a on a.start = w.id left anti join {seen} s on s.start <=> w.start and s.id <=> a.id", walk=levels[-1], arcs=arcs, seen=seen), "level")
        if new.isEmpty():
            break
        levels.append(new)
    return functools.reduce(DataFrame.union, levels)


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n")).withColumn("of", F.lit("node")).unionByName(edges.groupBy("type").agg(F.count("*").alias("n")).withColumn("of", F.lit("edge")))


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _label(kind: Column) -> Column:
    """A node label: letters, digits and _, the first one a capital and the others small; Node if nothing is left."""
    plain = F.trim(F.regexp_replace(kind, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.when(plain == "", "Node").otherwise(F.concat(F.upper(F.left(plain, F.lit(1))), F.lower(F.substring(plain, F.lit(2), F.length(plain)))))


def _relation(kind: Column) -> Column:
    plain = F.regexp_replace(kind, "[^A-Za-z0-9]+", "_")
    return F.when(plain == "", "RELATED").when(plain.rlike("^[0-9]"), F.concat(F.lit("r_"), plain)).otherwise(plain)


def _merges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements (s) that merge nodes, and that merge edges between them. An edge needs both its ends."""
    name = F.coalesce(F.nullif("label", F.lit("")), "id")
    made = nodes.select(F.format_string("MERGE (n:%s {id: %s}) SET n.name = %s", _label(F.col("type")), _quoted(F.col("id")), _quoted(name)).alias("s"))
    types = nodes.select("id", _label(F.col("type")).alias("t"))
    tied = edges.join(types.select(F.col("id").alias("source"), F.col("t").alias("a")), "source").join(types.select(F.col("id").alias("target"), F.col("t").alias("b")), "target")
    return made, tied.select(F.format_string("MATCH (a:%s {id: %s}), (b:%s {id: %s}) MERGE (a)-[r:%s]->(b)", "a", _quoted(F.col("source")), "b", _quoted(F.col("target")), _relation(F.col("type"))).alias("s"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, statement): constraints, nodes and edges as Cypher text; n puts constraints before nodes before edges."""
    made, tied = _merges(nodes, edges)
    constraints = nodes.select("type").distinct().select(F.lit(0).alias("n"), F.format_string("CREATE CONSTRAINT node_id_%s IF NOT EXISTS FOR (n:%s) REQUIRE n.id IS UNIQUE;", "type", _label(F.col("type"))).alias("statement"))
    ended = lambda rows, n: rows.select(F.lit(n).alias("n"), F.concat("s", F.lit(";")).alias("statement"))
    return constraints.union(ended(made, 1)).union(ended(tied, 2))


def age_sql(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """(n, statement): the same merges as SQL for a graph extension that takes Cypher in a function; nodes before edges."""
    made, tied = _merges(nodes, edges)
    call = lambda rows, n: rows.select(F.lit(n).alias("n"), F.concat(F.lit(f"SELECT * FROM cypher('{graph}', $$ "), "s", F.lit(" $$) AS (a agtype);")).alias("statement"))
    return call(made, 1).union(call(tied, 2))


def stored(spark, path: str, build) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from the tables at a path; where they aren't there yet, build() makes them first."""
    found = lake.readable(spark, f"{path}/nodes"), lake.readable(spark, f"{path}/edges")
    if None in found:
        nodes, edges = build()
        found = lake.replace_folder(nodes, f"{path}/nodes"), lake.replace_folder(edges, f"{path}/edges")
    return found
