"""Procedures and user functions by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.graph import PropertyGraph
from tessera.operators import algorithms, fulltext

_BUILT_IN = set("id labels type properties keys startnode endnode nodes relationships length size head last tail reverse range coalesce exists tointeger tofloat tostring toboolean tobooleanornull abs ceil floor round sqrt sign rand toupper tolower trim ltrim rtrim substring replace split left right count sum avg min max collect percentilecont percentiledisc stdev stdevp".split())


def _typed(name: str, procedure: Callable[..., DataFrame], inputs: Sequence[tuple[str, type]] | None, outputs: str | None) -> Callable[..., DataFrame]:
    """``procedure`` with its arguments and the columns of its rows checked at a call."""

    def run(*arguments) -> DataFrame:
        if inputs is not None:
            if len(arguments) != len(inputs):
                raise TypeError(f"{name} takes {len(inputs)} arguments, not {len(arguments)}")
            for value, (argument, kind) in zip(arguments, inputs, strict=True):
                # An integer passes for a number; a truth value doesn't.
                kinds = (int, float) if kind is float else (kind,)
                if value is not None and (not isinstance(value, kinds) or (isinstance(value, bool) and kind is not bool)):
                    raise TypeError(f"{name}: {argument} has to be {kind.__name__}")
        rows = procedure(*arguments)
        if outputs is not None:
            wanted = [(f.name, f.dataType) for f in StructType.fromDDL(outputs).fields]
            if [(f.name, f.dataType) for f in rows.schema.fields] != wanted:
                raise TypeError(f"{name} gave {rows.schema.simpleString()}, not {outputs}")
        return rows

    return run


class Procedures:
    """``call(name, ...)`` gives a DataFrame; further procedures and functions can be registered."""

    def __init__(self, graph: PropertyGraph) -> None:
        self.graph = graph
        self.catalog = algorithms.Catalog()
        self._own: dict[str, Callable[..., DataFrame]] = {}
        self.functions: dict[str, Callable[..., Column]] = {}
        self.aggregates: set[str] = set()
        self._indexes: dict[str, tuple[str, str]] = {}

    def register(
        self, name: str, procedure: Callable[..., DataFrame],
        inputs: Sequence[tuple[str, type]] | None = None, outputs: str | None = None,
    ) -> None:
        """``inputs`` names the arguments with their Python types (None passes as any of them), and
        ``outputs`` is the schema of the rows, such as "id long, score double"; a call checks both."""
        if name in self._table() or name in self._own:
            raise ValueError(f"procedure {name} exists")
        self._own[name] = procedure if inputs is None and outputs is None else _typed(name, procedure, inputs, outputs)

    def register_function(self, name: str, function: Callable[..., Column], arity: int | None = None, aggregate: bool = False) -> None:
        """A scalar or aggregate function of columns; built-in names are refused.

        With ``arity`` a call with another number of arguments is an error.  An ``aggregate`` gives
        an aggregate column, from built-in aggregates or a grouped pandas UDF, for use in ``agg``.
        """
        if name.lower() in _BUILT_IN:
            raise ValueError(f"{name} is built in")

        def checked(*arguments: Column) -> Column:
            if arity is not None and len(arguments) != arity:
                raise TypeError(f"{name} takes {arity} arguments, not {len(arguments)}")
            return function(*arguments)

        self.functions[name.lower()] = checked
        (self.aggregates.add if aggregate else self.aggregates.discard)(name.lower())

    def function(self, name: str, *arguments: Column) -> Column:
        """A registered function of some columns."""
        if name.lower() not in self.functions:
            raise KeyError(f"no function {name}")
        return self.functions[name.lower()](*arguments)

    def fulltext_index(self, name: str, label: str, text: str) -> None:
        self._indexes[name] = (label, text)

    def _table(self) -> dict[str, Callable[..., DataFrame]]:
        def on(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            return lambda name, **config: f(self.catalog.get(name), **config)

        spark = self.graph.spark

        def one(row: dict, kind: str) -> DataFrame:
            return spark.createDataFrame([tuple(row.values())], kind)

        stats = "graphName string, nodeCount long, relationshipCount long"
        return {
            "db.labels": self.graph.labels,
            "db.relationshipTypes": self.graph.relationship_types,
            "db.propertyKeys": self.graph.property_keys,
            "db.index.fulltext.queryNodes": self._query_nodes,
            "gds.graph.project": lambda name, *a, **k: one(self.catalog.project(name, self.graph, *a, **k), stats),
            "gds.graph.list": lambda: spark.createDataFrame([(n,) for n in self.catalog.names()], "graphName string"),
            "gds.graph.exists": lambda name: one({"e": self.catalog.exists(name)}, "exists boolean"),
            "gds.graph.drop": lambda name: one(self.catalog.drop(name), stats),
            "gds.pageRank.stream": on(algorithms.pagerank),
            "gds.degree.stream": on(algorithms.degree),
            "gds.closeness.stream": on(algorithms.closeness),
            "gds.betweenness.stream": on(algorithms.betweenness),
            "gds.wcc.stream": on(algorithms.wcc),
            "gds.scc.stream": on(algorithms.scc),
            "gds.labelPropagation.stream": on(algorithms.label_propagation_in_order),
            "gds.labelPropagation.synchronous": on(algorithms.label_propagation),
            "gds.triangleCount.stream": on(algorithms.triangles),
            "gds.localClusteringCoefficient.stream": on(algorithms.clustering),
            "gds.dijkstra.stream": on(algorithms.dijkstra),
            "gds.bellmanFord.stream": on(algorithms.bellman_ford),
            "ext.double": lambda n: spark.range(1).select(F.lit(2 * n).alias("out")),
            "ext.range": lambda a, b: spark.range(a, b + 1).select(F.col("id").alias("value")),
        }

    def _query_nodes(self, index: str, query: str) -> DataFrame:
        label, text = self._indexes[index]
        return fulltext.query_nodes(self.graph.label_scan(label), text, query)

    def names(self) -> list[str]:
        return sorted({*self._table(), *self._own})

    def call(self, name: str, *arguments, **config) -> DataFrame:
        found = self._own.get(name) or self._table().get(name)
        if found is None:
            raise KeyError(f"no procedure {name}")
        return found(*arguments, **config)


def lookup(rows: DataFrame, table: DataFrame, arguments: dict[str, Column]) -> DataFrame:
    """A fixture-table procedure: rows of ``table`` whose inputs are equivalent to the arguments (null = null)."""
    condition = F.lit(True)
    for name, value in arguments.items():
        condition = condition & value.eqNullSafe(table[name])
    return rows.join(table, condition).drop(*(table[n] for n in arguments))


def sample_functions(spark: SparkSession) -> None:
    """Registers ``ext_double`` for SQL text, as an example of a user function."""
    from pyspark.sql.functions import pandas_udf

    spark.udf.register("ext_double", pandas_udf(lambda s: 2 * s, "long"))
