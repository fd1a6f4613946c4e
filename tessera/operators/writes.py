"""Updates: every write returns a new graph and its counters."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.storage import materialize

#: Rows that one task of a MERGE of relationships sorts or hashes.
_TASK_ROWS = 250_000


@dataclass(frozen=True)
class Counters:
    nodes_created: int = 0
    nodes_deleted: int = 0
    rels_created: int = 0
    rels_deleted: int = 0
    properties_set: int = 0


def create_nodes(graph: PropertyGraph, label: str, rows: DataFrame) -> tuple[PropertyGraph, Counters]:
    """One node for each row of ``rows(id, properties)``."""
    rows = materialize(rows, "created")
    table = rows if label not in graph.nodes else graph.nodes[label].unionByName(rows, allowMissingColumns=True)
    return graph.with_nodes(label, table), Counters(nodes_created=rows.count())


def create_rels(graph: PropertyGraph, kind: str, rows: DataFrame) -> tuple[PropertyGraph, Counters]:
    """One relationship for each row of ``rows(rid, src, dst, properties)``."""
    rows = materialize(rows, "created")
    table = rows if kind not in graph.rels else graph.rels[kind].unionByName(rows, allowMissingColumns=True)
    return graph.with_rels(kind, table), Counters(rels_created=rows.count())


def merge_nodes(
    graph: PropertyGraph, label: str, rows: DataFrame, keys: list[str], new_id: Column,
    on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None,
) -> tuple[PropertyGraph, DataFrame, Counters]:
    """MERGE on ``keys``: the new graph, the matches of every row, and the counters.

    Rows that repeat a missing key create it once, and the later ones match it.  A row comes back
    for each node it matches.  ``new_id`` makes the id of a created node from its keys; a null key
    is an error, as it could never match.
    """
    rows = materialize(rows, "merged")
    for k in keys:
        if not rows.filter(F.col(k).isNull()).isEmpty():
            raise ValueError(f"MERGE with a null {k}")
    table = graph.label_scan(label)
    wanted = rows.select(*keys).distinct()
    missing = wanted.join(table.select(*keys), keys, "left_anti") if set(keys) <= set(table.columns) else wanted
    made = missing.withColumn("id", new_id)
    for name, value in (on_create or {}).items():
        made = made.withColumn(name, value)
    made = materialize(made, "made")
    sets = 0
    if on_match and label in graph.nodes:
        hit = table.join(wanted.withColumn("__hit", F.lit(True)), keys, "left")
        sets = hit.filter("__hit").count() * len(on_match)
        for name, value in on_match.items():
            old = F.col(name) if name in table.columns else F.lit(None)
            hit = hit.withColumn(name, F.when(F.col("__hit"), value).otherwise(old))
        table = hit.drop("__hit")
    merged = made if label not in graph.nodes else table.unionByName(made, allowMissingColumns=True)
    merged = materialize(merged, "nodes")
    created = made.count()
    counters = Counters(nodes_created=created, properties_set=sets + created * (len(keys) + len(on_create or {})))
    return graph.with_nodes(label, merged), rows.join(merged.select("id", *keys), keys), counters


def set_properties(graph: PropertyGraph, label: str, values: DataFrame, names: list[str]) -> tuple[PropertyGraph, Counters]:
    """SET: ``values(id, names...)`` overwrite the properties of the nodes they name; a null removes.

    Ids that no node has are ignored; an id given twice is an error, since its value is not defined.
    """
    values = materialize(values.select("id", *names).filter("id IS NOT NULL"), "values")
    if not values.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("SET names a node twice")
    table = graph.label_scan(label)
    new = values.select("id", F.lit(True).alias("__set"), *(F.col(n).alias(f"__{n}") for n in names))
    joined = table.join(new, "id", "left")
    for n in names:
        old = F.col(n) if n in table.columns else F.lit(None)
        joined = joined.withColumn(n, F.when(F.col("__set"), F.col(f"__{n}")).otherwise(old))
    hits = table.select("id").join(values.select("id"), "id", "left_semi").count()
    # Only the values are stored: a reader joins the columns it needs, instead of all being written anew.
    out = joined.drop("__set", *(f"__{n}" for n in names))
    return graph.with_nodes(label, out), Counters(properties_set=hits * len(names))


def remove_properties(graph: PropertyGraph, label: str, ids: DataFrame, names: list[str]) -> tuple[PropertyGraph, Counters]:
    """REMOVE: the named properties become null on the nodes of ``ids(id)``."""
    table = graph.label_scan(label)
    nulls = ids.select("id").distinct()
    for n in names:
        nulls = nulls.withColumn(n, F.lit(None).cast(table.schema[n].dataType))
    return set_properties(graph, label, nulls, names)


def set_map(graph: PropertyGraph, label: str, ids: DataFrame, values: dict[str, Column], add: bool = False) -> tuple[PropertyGraph, Counters]:
    """``n = map``, or ``n += map`` with ``add``, on the nodes of ``ids(id)``.

    ``values`` are columns of the node's own table.  Without ``add`` every property that the map
    does not name is removed; a null in the map removes its property.
    """
    table = graph.label_scan(label)
    hit = table.join(ids.select("id").distinct(), "id", "left_semi")
    names = list(values) if add else [*values, *(c for c in table.columns if c not in values and c != "id")]
    empty = {n: F.lit(None).cast(table.schema[n].dataType) for n in names if n not in values}
    rows = hit.select("id", *((values.get(n, empty.get(n))).alias(n) for n in names))
    return set_properties(graph, label, rows, names)


def merge_rels(graph: PropertyGraph, kind: str, rows: DataFrame, new_rid: Column, directed: bool = True) -> tuple[PropertyGraph, DataFrame, Counters]:
    """MERGE ``(src)-[:kind]->(dst)`` for the bound ends of ``rows(src, dst)``.

    A pair that has such a relationship matches all of them; a pair without gets one, which its
    later rows match.  Undirected, one the other way round matches too.  Rows with a null end are
    an error.  ``new_rid`` makes the id of a created relationship from its ends.
    """
    rows = materialize(rows, "merged")
    if not rows.filter("src IS NULL OR dst IS NULL").isEmpty():
        raise ValueError("MERGE of a relationship with a null end")
    table = graph.rels[kind] if kind in graph.rels else graph.spark.createDataFrame([], "rid long, src long, dst long")
    known = table.select("src", "dst")
    # As many parts as the rows ask for, so that a task's share doesn't grow with them.
    rows = rows.repartition(rows.count() // _TASK_ROWS + 1, "src", "dst")
    wanted = rows.select("src", "dst").distinct()
    if not directed:
        known = known.unionByName(known.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        wanted = wanted.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    made = materialize(wanted.join(known, ["src", "dst"], "left_anti").withColumn("rid", new_rid.cast("long")), "made")
    merged = table.unionByName(made, allowMissingColumns=True)
    ends = merged.select("rid", "src", "dst")
    if not directed:
        ends = ends.unionByName(ends.filter("src <> dst").select("rid", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.with_rels(kind, materialize(merged, "rels")), rows.join(ends, ["src", "dst"]), Counters(rels_created=made.count())


def set_rel_properties(graph: PropertyGraph, kind: str, values: DataFrame, names: list[str]) -> tuple[PropertyGraph, Counters]:
    """SET on relationships: ``values(rid, names...)``, as ``set_properties`` does for nodes; nulls remove."""
    as_nodes = PropertyGraph(graph.spark, {kind: graph.rels[kind].withColumnRenamed("rid", "id")}, {})
    done, counters = set_properties(as_nodes, kind, values.withColumnRenamed("rid", "id"), names)
    return graph.with_rels(kind, done.nodes[kind].withColumnRenamed("id", "rid")), counters


def relabel(graph: PropertyGraph, ids: DataFrame, add: str | None = None, remove: str | None = None) -> PropertyGraph:
    """SET n:Label and REMOVE n:Label: moves nodes into or out of a label's table."""
    ids = ids.select("id").distinct()
    if add is not None:
        rows = None
        for table in graph.nodes.values():
            hit = table.join(ids, "id", "left_semi")
            rows = hit if rows is None else rows.unionByName(hit, allowMissingColumns=True)
        fresh = rows.join(graph.label_scan(add).select("id"), "id", "left_anti").dropDuplicates(["id"])
        table = fresh if add not in graph.nodes else graph.nodes[add].unionByName(fresh, allowMissingColumns=True)
        graph = graph.with_nodes(add, materialize(table, "nodes"))
    if remove is not None and remove in graph.nodes:
        graph = graph.with_nodes(remove, materialize(graph.nodes[remove].join(ids, "id", "left_anti"), "nodes"))
    return graph


def delete_nodes(graph: PropertyGraph, ids: DataFrame, detach: bool = False) -> tuple[PropertyGraph, Counters]:
    """DELETE, or DETACH DELETE with the nodes' relationships; without ``detach`` these are an error."""
    ids = materialize(ids.select("id").filter("id IS NOT NULL").distinct(), "deleted")
    rels, gone = {}, 0
    for kind, table in graph.rels.items():
        touched = table.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("rid").unionByName(
            table.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("rid")
        ).distinct()
        touched = materialize(touched, "touched")
        hits = touched.count()
        if hits and not detach:
            raise ValueError(f"a deleted node still has {kind} relationships")
        gone += hits
        rels[kind] = materialize(table.join(touched, "rid", "left_anti"), "rels") if hits else table
    nodes, deleted = {}, 0
    for label, table in graph.nodes.items():
        hits = table.join(ids, "id", "left_semi").count()
        deleted += hits
        nodes[label] = materialize(table.join(ids, "id", "left_anti"), "nodes") if hits else table
    return replace(graph, nodes=nodes, rels=rels), Counters(nodes_deleted=deleted, rels_deleted=gone)


def delete_rels(graph: PropertyGraph, kind: str, rids: DataFrame) -> tuple[PropertyGraph, Counters]:
    table = graph.rels[kind]
    hits = table.join(rids.select("rid").distinct(), "rid", "left_semi").count()
    return graph.with_rels(kind, materialize(table.join(rids, "rid", "left_anti"), "rels")), Counters(rels_deleted=hits)


def foreach(rows: DataFrame, items: str, name: str) -> DataFrame:
    """The rows an update inside FOREACH sees: one for each element; a null list has none."""
    return rows.select("*", F.explode(items).alias(name))


def unwind(rows: DataFrame, items: Column, name: str, scalar: bool = False) -> DataFrame:
    """UNWIND: one row for each element; null and empty lists give none, a scalar one."""
    return rows.select("*", F.explode(F.when(items.isNotNull(), F.array(items)) if scalar else items).alias(name))


def violations_unique(table: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that break a uniqueness constraint, with their counts; rows with a null don't count."""
    return table.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def violations_exist(table: DataFrame, name: str) -> DataFrame:
    return table.filter(F.col(name).isNull()).select("id")


def violations_node_key(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that repeat or hold a null, with their counts."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | null)


def violations_type(table: DataFrame, name: str, kind: str) -> DataFrame:
    """Nodes whose value can't be read as ``kind``."""
    return table.filter(F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()).select("id")
