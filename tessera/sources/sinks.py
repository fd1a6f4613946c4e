"""Results out: columnar files, JSON lines, cold segments, and the graph view of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import properties


def write_columnar(rows: DataFrame, path: str) -> None:
    """Parquet, whose encodings (dictionary, bit packing, delta) do the columnar codecs' work."""
    rows.write.parquet(path, mode="overwrite")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path, mode="overwrite", ignoreNullFields=False)


def write_cold(readings: DataFrame, path: str, partitions: int) -> None:
    """Time-ordered segments: ranges of ``ts``, sorted inside, so a time range skips files and row groups."""
    readings.repartitionByRange(partitions, "ts").sortWithinPartitions("ts", "seq").write.parquet(path, mode="overwrite")


def read_cold(spark, path: str, start: int, stop: int) -> DataFrame:
    """Readings with ``start <= ts < stop``; the bounds reach the scan."""
    return spark.read.parquet(path).filter((F.col("ts") >= start) & (F.col("ts") < stop))


def full_graph_view(graph, rows: DataFrame, nodes: list[str], rels: list[str]) -> tuple[DataFrame, DataFrame]:
    """The graph view with content: nodes ``(id, labels, properties)`` and relationships
    ``(rid, type, src, dst, properties)``; properties are maps from name to text, without nulls."""
    ids, rids = graph_view(rows, nodes, rels)

    def packed(table: DataFrame, fixed: list[str]) -> DataFrame:
        return table.select(*fixed, properties([c for c in table.columns if c not in fixed]).alias("properties"))

    found = None
    for label in sorted(graph.nodes):
        one = packed(graph.nodes[label], ["id"]).join(ids, "id", "left_semi").withColumn("labels", F.array(F.lit(label)))
        found = one if found is None else found.unionByName(one)
    links = None
    for kind in sorted(graph.rels) if rels else []:
        one = packed(graph.rels[kind], ["rid", "src", "dst"]).join(rids, "rid", "left_semi").withColumn("type", F.lit(kind))
        links = one if links is None else links.unionByName(one)
    return found, links if links is not None else rids


def graph_view(rows: DataFrame, nodes: list[str], rels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes ``(id)`` and relationships ``(rid)`` that the named variables of a result bind."""
    ids = rows.select(F.explode(F.array(*(F.col(f"{n}__id") for n in nodes))).alias("id")).filter("id IS NOT NULL").distinct()
    if not rels:
        return ids, rows.sparkSession.createDataFrame([], "rid long")
    rids = rows.select(F.explode(F.array(*(F.col(f"{r}__rid") for r in rels))).alias("rid")).filter("rid IS NOT NULL").distinct()
    return ids, rids
