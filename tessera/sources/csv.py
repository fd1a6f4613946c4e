"""CSV in and out: LOAD CSV, typed bulk import with header grammar, and dumps."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph

_KINDS = {
    "string": "string", "int": "bigint", "integer": "bigint", "long": "bigint", "float": "double", "double": "double",
    "boolean": "boolean", "bool": "boolean", "date": "date", "localdatetime": "timestamp_ntz", "datetime": "timestamp",
}


def load_csv(spark: SparkSession, path: str, headers: bool = True, delimiter: str = ",") -> DataFrame:
    """LOAD CSV: one column ``row``, a map by header name or a list of strings.

    Every value is a string, line breaks in quotes included.  A short record has nulls, extra fields
    are dropped; of two headers of one name each gets its place behind the name.
    """
    raw = spark.read.csv(path, header=headers, sep=delimiter, inferSchema=False, escape='"', multiLine=True)
    columns = [F.col(f"`{c}`").cast("string") for c in raw.columns]
    if not headers:
        return raw.select(F.array(*columns).alias("row"))
    return raw.select(F.map_from_arrays(F.array(*map(F.lit, raw.columns)), F.array(*columns)).alias("row"))


@dataclass(frozen=True)
class Field:
    """A header field ``name:type[]``, or one of the roles ID, LABEL, START_ID, END_ID, TYPE."""

    column: str
    name: str
    role: str | None
    kind: str = "string"
    many: bool = False


_ROLES = {"ID", "LABEL", "START_ID", "END_ID", "TYPE", "IGNORE"}


def parse_header(columns: list[str]) -> list[Field]:
    """Fields of a bulk file's header; an unknown type or two fields of a role are errors."""
    out: list[Field] = []
    for column in columns:
        name, _, kind = column.partition(":")
        role = re.sub(r"\(.*\)$", "", kind)
        if role in _ROLES:
            if any(f.role == role and role != "IGNORE" for f in out):
                raise ValueError(f"two fields with the role {role}")
            out.append(Field(column, name, role))
            continue
        many = kind.endswith("[]")
        kind = (kind.removesuffix("[]") or "string").lower()
        if kind not in _KINDS:
            raise ValueError(f"field {column!r} has an unknown type")
        if not name:
            raise ValueError(f"field {column!r} has no name")
        out.append(Field(column, name, None, _KINDS[kind], many))
    return out


def _cell(f: Field, separator: str) -> Column:
    """An empty cell is an absent property; a cell that isn't of its type is an error."""
    raw = F.when(F.col(f"`{f.column}`") != "", F.col(f"`{f.column}`"))
    value = F.split(raw, re.escape(separator)).cast(f"array<{f.kind}>") if f.many else raw.cast(f.kind)
    return value.alias(f.name)


def _read(spark: SparkSession, path: str, delimiter: str) -> tuple[DataFrame, dict[str, Field], list[Field]]:
    raw = spark.read.csv(path, header=True, sep=delimiter, inferSchema=False, escape='"', multiLine=True)
    fields = parse_header(raw.columns)
    return raw, {f.role: f for f in fields if f.role}, [f for f in fields if not f.role]


def bulk_nodes(
    spark: SparkSession, path: str, label: str | None = None, delimiter: str = ",", separator: str = ";", duplicates: str = "strict"
) -> DataFrame:
    """``id, external_id, labels, properties`` of a node file.

    ``id`` is the hash of the external id.  A repeated external id is an error (``strict``), or the
    further rows are nodes with ids of their own to which no relationship leads (``skip``).
    """
    raw, roles, properties = _read(spark, path, delimiter)
    if "ID" not in roles:
        raise ValueError("a node file needs an :ID field")
    labels = F.lit(label) if "LABEL" not in roles else F.coalesce(F.col(f"`{roles['LABEL'].column}`"), F.lit(label))
    key = F.col(f"`{roles['ID'].column}`")
    rows = raw.select(key.alias("external_id"), F.array_remove(F.split(F.coalesce(labels, F.lit("")), re.escape(separator)), "").alias("labels"), *(_cell(f, separator) for f in properties))
    if roles["ID"].name:
        rows = rows.withColumn(roles["ID"].name, F.col("external_id"))
    if duplicates == "strict":
        again = rows.groupBy("external_id").count().filter("count > 1").limit(1).collect()
        if again:
            raise ValueError(f"id {again[0][0]!r} is given twice")
        return rows.withColumn("id", F.xxhash64("external_id"))
    order = Window.partitionBy("external_id").orderBy(F.xxhash64(*[c for c in rows.columns if c != "external_id"]))
    rows = rows.withColumn("copy", F.row_number().over(order))
    return rows.withColumn("id", F.when(F.col("copy") == 1, F.xxhash64("external_id")).otherwise(F.xxhash64("external_id", "copy"))).drop("copy")


def bulk_rels(spark: SparkSession, path: str, nodes: DataFrame, kind: str | None = None, delimiter: str = ",", separator: str = ";") -> DataFrame:
    """``rid, src, dst, type, properties`` of a relationship file; ends that no node has are an error."""
    raw, roles, properties = _read(spark, path, delimiter)
    for role in ("START_ID", "END_ID"):
        if role not in roles:
            raise ValueError(f"a relationship file needs a :{role} field")
    types = F.lit(kind) if "TYPE" not in roles else F.coalesce(F.col(f"`{roles['TYPE'].column}`"), F.lit(kind))
    start, end = (F.col(f"`{roles[r].column}`") for r in ("START_ID", "END_ID"))
    rows = raw.select(
        F.xxhash64(start).alias("src"), F.xxhash64(end).alias("dst"), types.alias("type"), *(_cell(f, separator) for f in properties)
    )
    for side in ("src", "dst"):
        lost = rows.join(nodes.select(F.col("id").alias(side)), side, "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"a relationship's {side} is not a node")
    # Parallel relationships with equal properties are numbered, so that each has an id of its own.
    whole = F.xxhash64(*rows.columns)
    rows = rows.withColumn("whole", whole)
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("whole").orderBy("src")))
    return rows.withColumn("rid", F.when(F.col("copy") == 1, F.col("whole")).otherwise(F.xxhash64("whole", "copy"))).drop("whole", "copy")


def graph_from_bulk(spark: SparkSession, nodes: list[str], rels: list[str], **options) -> PropertyGraph:
    """A graph from bulk files; each file of nodes has one label in all rows, each of relationships one type."""
    tables, everything = {}, None
    for path in nodes:
        table = bulk_nodes(spark, path, **options)
        for label in sorted(x for (ls,) in table.select("labels").distinct().collect() for x in ls):
            own = table.filter(F.array_contains("labels", label))
            tables[label] = own if label not in tables else tables[label].unionByName(own, allowMissingColumns=True)
        ids = table.select("id")
        everything = ids if everything is None else everything.unionByName(ids)
    graph = PropertyGraph(spark, tables, {})
    for path in rels:
        table = bulk_rels(spark, path, everything)
        for (kind,) in table.select("type").distinct().collect():
            own = table.filter(F.col("type") == kind).drop("type")
            graph = graph.with_rels(kind, own if kind not in graph.rels else graph.rels[kind].unionByName(own, allowMissingColumns=True))
    return graph


def dump_csv(table: DataFrame, path: str, separator: str = ";") -> None:
    """Writes a table as CSV with a header; lists are joined by ``separator``, nulls are empty cells."""
    columns = [
        F.array_join(F.col(c).cast("array<string>"), separator).alias(c) if kind.startswith("array") else F.col(c)
        for c, kind in table.dtypes
    ]
    table.select(*columns).write.csv(path, header=True, emptyValue="", nullValue="", mode="overwrite")
