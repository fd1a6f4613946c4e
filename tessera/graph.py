"""The property graph: one typed DataFrame for each label and each relationship type."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids are ``ordinal of the label * SPACE + key``, so that keys of different labels don't meet.
SPACE = 1 << 48


def prop(variable: str, name: str) -> Column:
    """The column that holds property ``name`` of a bound variable."""
    return F.col(f"{variable}__{name}")


def bind(table: DataFrame, variable: str) -> DataFrame:
    """``table`` with its columns named after the variable they belong to."""
    return table.select(*(F.col(c).alias(f"{variable}__{c}") for c in table.columns))


class Tables(Mapping):
    """Tables by name, each opened when it is first asked for: a query reads only what it names."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers = makers
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self._makers[name]()
        return self._open[name]

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def having(self, name: str, table: DataFrame) -> Tables:
        return Tables({**self._makers, name: lambda: table})


def _having(tables: Mapping[str, DataFrame], name: str, table: DataFrame) -> Mapping[str, DataFrame]:
    return tables.having(name, table) if isinstance(tables, Tables) else {**tables, name: table}


@dataclass(frozen=True)
class PropertyGraph:
    """``nodes[label]`` has ``id`` and properties; ``rels[type]`` has ``rid``, ``src``, ``dst`` and properties.

    A value never changes: writes return a new graph.  A directed multigraph: parallel
    relationships and self-loops are told apart by ``rid``.  ``links`` says which labels a type
    joins, so that a hop reads only the tables it can reach.
    """

    spark: SparkSession
    nodes: Mapping[str, DataFrame]
    rels: Mapping[str, DataFrame]
    links: dict[str, tuple[frozenset, frozenset]] = field(default_factory=dict)

    def with_nodes(self, label: str, table: DataFrame) -> PropertyGraph:
        return replace(self, nodes=_having(self.nodes, label, table))

    def with_rels(self, kind: str, table: DataFrame, ends: tuple[Iterable, Iterable] | None = None) -> PropertyGraph:
        links = {**self.links, kind: (frozenset(ends[0]), frozenset(ends[1]))} if ends else self.links
        return replace(self, rels=_having(self.rels, kind, table), links=links)

    def label_scan(self, label: str) -> DataFrame:
        """Nodes of one label; a label that nothing has gives no rows."""
        found = self.nodes.get(label)
        return found if found is not None else self.spark.createDataFrame([], "id long")

    def all_nodes(self, properties: Iterable[str] | None = None) -> DataFrame:
        """``id``, ``labels`` and properties of every node; a property its label lacks is null."""
        out = None
        for label, table in sorted(self.nodes.items()):
            if properties is not None:
                table = table.select("id", *(c for c in properties if c in table.columns))
            table = table.withColumn("labels", F.array(F.lit(label)))
            out = table if out is None else out.unionByName(table, allowMissingColumns=True)
        return out if out is not None else self.spark.createDataFrame([], "id long, labels array<string>")

    def rel_scan(self, types: Iterable[str] = (), properties: Iterable[str] = ()) -> DataFrame:
        """``rid, src, dst, type`` and ``properties`` of the relationships of ``types``; no type means any."""
        out = None
        for kind in types or sorted(self.rels):
            if kind not in self.rels:
                continue
            table = self.rels[kind]
            table = table.select("rid", "src", "dst", F.lit(kind).alias("type"), *(c for c in properties if c in table.columns))
            out = table if out is None else out.unionByName(table, allowMissingColumns=True)
        return out if out is not None else self.spark.createDataFrame([], "rid long, src long, dst long, type string")

    def hops(self, types: Iterable[str] = (), direction: str = "out", properties: Iterable[str] = ()) -> DataFrame:
        """Relationships as steps ``start -> stop``: along, against or either way; a self-loop is one step."""
        rels = self.rel_scan(types, properties)
        along = rels.withColumn("start", F.col("src")).withColumn("stop", F.col("dst"))
        against = rels.withColumn("start", F.col("dst")).withColumn("stop", F.col("src"))
        if direction == "out":
            return along
        if direction == "in":
            return against
        if direction != "both":
            raise ValueError(f"direction {direction!r} is not out, in or both")
        return along.unionByName(against.filter("src <> dst"))

    def reaches(self, types: Iterable[str], direction: str = "out") -> frozenset:
        """Labels that ``links`` names at the far end of a step; none where it says nothing."""
        ends = {"out": (1,), "in": (0,), "both": (0, 1)}[direction]
        known = [self.links[kind] for kind in types or self.rels if kind in self.links]
        return frozenset().union(*(pair[end] for pair in known for end in ends))

    def labels(self) -> DataFrame:
        """Labels that some node has."""
        return self._in_use("label", self.nodes)

    def relationship_types(self) -> DataFrame:
        """Types that some relationship has."""
        return self._in_use("relationshipType", self.rels)

    def _in_use(self, column: str, tables: Mapping[str, DataFrame]) -> DataFrame:
        out = None
        for name in sorted(tables):
            one = tables[name].select(F.lit(name).alias(column)).limit(1)
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], f"{column} string")

    def property_keys(self) -> DataFrame:
        skip = {"id", "rid", "src", "dst"}
        keys = {c for t in (*self.nodes.values(), *self.rels.values()) for c in t.columns if c not in skip}
        return self._names("propertyKey", keys)

    def _names(self, column: str, names: Iterable[str]) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(names)], f"{column} string")


_TABLES = {
    "Region": ("region", "r_regionkey"),
    "Nation": ("nation", "n_nationkey"),
    "Customer": ("customer", "c_custkey"),
    "Supplier": ("supplier", "s_suppkey"),
    "Part": ("part", "p_partkey"),
    "Order": ("orders", "o_orderkey"),
    "User": ("events", "user_id"),
    "Event": ("events", "event_id"),
    "Doc": ("documents", "doc_id"),
}
_ORDINAL = {label: k for k, label in enumerate(_TABLES)}


def node_id(label: str, key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return key.cast("long") + F.lit(_ORDINAL[label] * SPACE)


def from_tables(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The driver's tables as a graph; every table keeps its columns as properties.

    Relationship ids come from the child's key, or from the 64-bit hash of the whole row where a
    table has no key, so they don't depend on partitioning.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def nodes_of(label: str) -> DataFrame:
        name, key = _TABLES[label]
        rows = table(name)
        if label == "User":
            rows = rows.select("user_id").distinct()
        return rows.withColumn("id", node_id(label, key))

    def keyed(name: str, number: int, key: str, start: tuple[str, str], stop: tuple[str, str]) -> DataFrame:
        return table(name).select(
            (F.col(key).cast("long") + F.lit(number * SPACE)).alias("rid"), node_id(*start).alias("src"), node_id(*stop).alias("dst")
        )

    def in_nation() -> DataFrame:
        customers = keyed("customer", 2, "c_custkey", ("Customer", "c_custkey"), ("Nation", "c_nationkey"))
        return customers.unionByName(keyed("supplier", 3, "s_suppkey", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey")))

    def contains() -> DataFrame:
        lines = table("lineitem")
        ends = node_id("Order", "l_orderkey").alias("src"), node_id("Part", "l_partkey").alias("dst")
        return lines.select(F.xxhash64(*lines.columns).alias("rid"), *ends, *lines.columns)

    def supplies() -> DataFrame:
        pairs = table("lineitem").select("l_suppkey", "l_partkey").distinct()
        ends = node_id("Supplier", "l_suppkey").alias("src"), node_id("Part", "l_partkey").alias("dst")
        return pairs.select(F.xxhash64("l_suppkey", "l_partkey").alias("rid"), *ends)

    rels = {
        "IN_REGION": lambda: keyed("nation", 1, "n_nationkey", ("Nation", "n_nationkey"), ("Region", "n_regionkey")),
        "IN_NATION": in_nation,
        "PLACED": lambda: keyed("orders", 4, "o_orderkey", ("Customer", "o_custkey"), ("Order", "o_orderkey")),
        "CONTAINS": contains,
        "SUPPLIES": supplies,
        "DID": lambda: keyed("events", 6, "event_id", ("User", "user_id"), ("Event", "event_id")),
    }
    links = {
        "IN_REGION": ("Nation", "Region"), "IN_NATION": ("Customer Supplier", "Nation"), "PLACED": ("Customer", "Order"),
        "CONTAINS": ("Order", "Part"), "SUPPLIES": ("Supplier", "Part"), "DID": ("User", "Event"),
    }
    return PropertyGraph(
        spark,
        Tables({label: lambda label=label: nodes_of(label) for label in _TABLES}),
        Tables(rels),
        {kind: (frozenset(a.split()), frozenset(b.split())) for kind, (a, b) in links.items()},
    )
