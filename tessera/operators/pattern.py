"""Graph patterns as joins.

A match is a DataFrame with columns ``variable__property``; a bound node has at least
``variable__id``, a bound relationship ``variable__rid``.  Within one match no relationship is bound
twice; separate matches may bind it again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph, bind, prop
from tessera.storage import materialize


@dataclass(frozen=True)
class Match:
    """Rows of one MATCH under construction; every method returns a new match."""

    graph: PropertyGraph
    rows: DataFrame
    rels: tuple[tuple[str, frozenset], ...] = ()

    def where(self, condition: Column | str) -> Match:
        """Rows for which the condition is true; false and null are dropped."""
        return replace(self, rows=self.rows.filter(condition))

    def node(self, variable: str, label: str | None = None, properties: Iterable[str] | None = None) -> Match:
        """One more pattern part: a node that is not connected to the others yet (all combinations)."""
        return replace(self, rows=self.rows.crossJoin(bind(_nodes(self.graph, label, properties), variable)))

    def hop(
        self, start: str, rel: str, stop: str, types: Iterable[str] = (), direction: str = "out",
        label: str | None = None, properties: Iterable[str] | None = None, rel_properties: Iterable[str] = (),
    ) -> Match:
        """``(start)-[rel:types]->(stop:label)``.

        If ``stop`` is bound already the hop joins on both ends; otherwise it binds it.  A null
        ``start`` has no hops.  Parallel relationships count each.
        """
        types = frozenset([types] if isinstance(types, str) else types)
        step = self.graph.hops(sorted(types), direction, rel_properties)
        step = bind(step.select("rid", "start", "stop", "type", *rel_properties), rel)
        on = prop(start, "id") == F.col(f"{rel}__start")
        bound = f"{stop}__id" in self.rows.columns
        if bound:
            rows = self.rows.join(step, on & (prop(stop, "id") == F.col(f"{rel}__stop")))
        else:
            if label is None and properties is None:
                rows = self.rows.join(step, on).withColumn(f"{stop}__id", F.col(f"{rel}__stop"))
            else:
                nodes, there = bind(_nodes(self.graph, label, properties), stop), F.col(f"{rel}__stop") == prop(stop, "id")
                if label is not None and self.graph.reaches(types, direction) - {label}:
                    # The label leaves part of the steps, and fewer steps meet at a shared start.
                    rows = self.rows.join(step.join(nodes, there), on)
                else:
                    rows = self.rows.join(step, on).join(nodes, there)
        for other, kinds in self.rels:
            if not types or not kinds or types & kinds:
                rows = rows.filter(F.col(f"{rel}__rid") != F.col(f"{other}__rid"))
        return replace(self, rows=rows, rels=(*self.rels, (rel, types)))

    def bound_hop(self, rel: str, start: str, stop: str, direction: str = "out") -> Match:
        """``(start)-[rel]->(stop)`` over a relationship that an earlier match has bound with its ends,
        ``rel__src`` and ``rel__dst``: binds the ends that are not bound yet and compares the others."""
        src, dst = F.col(f"{rel}__src"), F.col(f"{rel}__dst")
        ways = {"out": [(src, dst)], "in": [(dst, src)], "both": [(src, dst), (dst, src)]}[direction]
        out = None
        for k, (a, b) in enumerate(ways):
            rows = self.rows if k == 0 else self.rows.filter(src != dst)
            for variable, end in ((start, a), (stop, b)):
                name = f"{variable}__id"
                rows = rows.filter(F.col(name) == end) if name in rows.columns else rows.withColumn(name, end)
            out = rows if out is None else out.unionByName(rows)
        return replace(self, rows=out)

    def along(self, start: str, rels: str, stop: str, types: Iterable[str] = ()) -> Match:
        """``(start)-[rels*]->(stop)`` over a bound list of relationship ids ``rels__rids``: the rows in
        which they form a path from ``start`` on, with ``stop`` bound to its end.  An empty list stays
        at ``start``; a null list gives no row."""
        steps = self.graph.hops([types] if isinstance(types, str) else sorted(types)).select("rid", F.col("start").alias("src"), F.col("stop").alias("dst"))
        kept = self.rows.columns
        rows = self.rows.filter(F.col(f"{rels}__rids").isNotNull()).withColumn("row_no", F.monotonically_increasing_id())
        rows = materialize(rows, "bound-lists")
        parts = rows.select("row_no", F.posexplode(f"{rels}__rids").alias("place", "rid")).join(steps, "rid")
        paths = parts.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("place", "src", "dst"))).alias("path"))
        rows = rows.join(paths, "row_no", "left").withColumn("path", F.coalesce("path", F.array().cast(paths.schema["path"].dataType)))
        chained = F.forall(F.sequence(F.lit(1), F.size("path")), lambda k: (k == 1) | (F.get("path", k - 1)["src"] == F.get("path", k - 2)["dst"]))
        first = F.when(F.size("path") > 0, F.get("path", F.lit(0))["src"]).otherwise(prop(start, "id"))
        rows = rows.filter(F.size("path") == F.size(f"{rels}__rids")).filter((F.size("path") == 0) | chained).filter(prop(start, "id") == first)
        end = F.when(F.size("path") > 0, F.get("path", F.size("path") - 1)["dst"]).otherwise(prop(start, "id"))
        return replace(self, rows=rows.withColumn(f"{stop}__id", end).select(*kept, f"{stop}__id"))

    def part(self, other: Match) -> Match:
        """A second comma-separated part: joined on the variables both bind, else all combinations."""
        shared = [c for c in self.rows.columns if c in other.rows.columns]
        keys = [c for c in shared if c.endswith(("__id", "__rid"))]
        right = other.rows.drop(*(c for c in shared if c not in keys))
        rows = self.rows.join(right, keys) if keys else self.rows.crossJoin(right)
        return self._apart(other, rows)

    def _keys(self, inner: Match) -> list[str]:
        return [c for c in self.rows.columns if c in inner.rows.columns and c.endswith(("__id", "__rid"))]

    def part_less(self, other: Match, low: Column, high: Column, bins: int = 64) -> Match:
        """As ``part`` on shared variables, where ``low`` of these rows is less than ``high`` of the other's.

        The other's rows are cut into ranges of ``high``; a row meets only the ranges that can hold a
        larger value, so that hardly any pair is made in vain, and the work spreads over ranges even
        where few values are shared.  Only the limits of the ranges reach the driver.
        """
        keys = self._keys(other)
        right = other.rows.drop(*(c for c in other.rows.columns if c in self.rows.columns and c not in keys)).withColumn("__high", high)
        left = self.rows.withColumn("__low", low)
        right, left = right.filter("__high IS NOT NULL"), left.filter("__low IS NOT NULL")
        shares = [k / bins for k in range(1, bins)]
        limits = right.agg(F.percentile_approx("__high", shares, 10_000).alias("limits")).first()["limits"]
        limits = sorted({x for x in limits or [] if x == x})

        def place(value: str) -> Column:
            """Number of limits up to a value, which never falls as the value grows."""
            known = F.array(*map(F.lit, limits)) if limits else F.array().cast("array<double>")
            return F.size(F.filter(known, lambda x: x <= F.col(value)))

        left = left.withColumn("__bin", F.explode(F.sequence(place("__low"), F.lit(len(limits)))))
        right = right.withColumn("__bin", place("__high"))
        # A number of its own keeps small but fruitful partitions apart.
        parts = max(2 * bins, int(self.graph.spark.conf.get("spark.sql.shuffle.partitions")))
        left, right = (side.repartition(parts, *keys, "__bin") for side in (left, right))
        rows = left.join(right, [*keys, "__bin"]).filter("__low < __high").drop("__low", "__high", "__bin")
        return self._apart(other, rows)

    def _apart(self, other: Match, rows: DataFrame) -> Match:
        """Rows of this match and another in which no relationship is bound twice."""
        for a, kinds in self.rels:
            for b, others in other.rels:
                if a != b and (not kinds or not others or kinds & others):
                    rows = rows.filter(F.col(f"{a}__rid") != F.col(f"{b}__rid"))
        return replace(self, rows=rows, rels=(*self.rels, *other.rels))

    def optional(self, inner: Match) -> Match:
        """OPTIONAL MATCH: rows of ``inner`` on the shared variables, or nulls where there are none.

        ``inner`` is a match on its own that starts from the shared variables and holds the
        optional part's conditions.
        """
        keys = self._keys(inner)
        extra = inner.rows.drop(*(c for c in inner.rows.columns if c in self.rows.columns and c not in keys))
        return replace(self, rows=self.rows.join(extra, keys, "left_outer"))

    def exists(self, inner: Match) -> Match:
        return replace(self, rows=self.rows.join(inner.rows, self._keys(inner), "left_semi"))

    def not_exists(self, inner: Match) -> Match:
        return replace(self, rows=self.rows.join(inner.rows, self._keys(inner), "left_anti"))

    def collect_matches(self, inner: Match, value: Column, name: str) -> Match:
        """Pattern comprehension: the sorted list of ``value`` over the matches of ``inner`` for each row."""
        keys = self._keys(inner)
        lists = inner.rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))
        rows = self.rows.join(lists, keys, "left_outer")
        empty = F.array().cast(lists.schema[name].dataType)
        return replace(self, rows=rows.withColumn(name, F.coalesce(F.col(name), empty)))

    def trail_path(self, name: str, rels: str) -> Match:
        """A named path over the variable-length hop ``rels``."""
        whole = F.struct(F.col(f"{rels}__nodes").alias("nodes"), F.col(f"{rels}__rids").alias("rels"))
        return replace(self, rows=self.rows.withColumn(name, whole))

    def path(self, name: str, nodes: list[str], rels: list[str]) -> Match:
        """A named path: struct of node ids and relationship ids; null if a part is unmatched."""
        whole = F.struct(
            F.array(*(prop(n, "id") for n in nodes)).alias("nodes"), F.array(*(F.col(f"{r}__rid") for r in rels)).alias("rels")
        )
        missing = F.lit(False)
        for n in nodes:
            missing = missing | prop(n, "id").isNull()
        return replace(self, rows=self.rows.withColumn(name, F.when(~missing, whole)))

    def trails(
        self, start: str, rels: str, stop: str, types: Iterable[str] = (), low: int = 1, high: int | None = None,
        direction: str = "out", where: str | None = None,
    ) -> Match:
        """``(start)-[rels:types*low..high]->(stop)``: all trails, that is, no relationship twice.

        Binds ``stop__id``, the list of relationship ids ``rels__rids``, and ``rels__nodes``, the ids of the
        path's nodes in order, so that ``path`` can name it.  ``where`` is a condition
        on each relationship (over ``rid, src, dst, type``).  Without ``high`` it goes on until no
        trail can be longer; the frontier is written out every round.
        """
        types = [types] if isinstance(types, str) else list(types)
        step = self.graph.hops(types, direction)
        step = (step if where is None else step.filter(where)).select("rid", "start", "stop")
        ids, stops = f"{rels}__rids", f"{stop}__id"
        front = self.rows.withColumn(ids, F.array().cast("array<long>")).withColumn(stops, prop(start, "id"))
        walked = f"{rels}__nodes"
        front = front.filter(F.col(stops).isNotNull()).withColumn(walked, F.array(F.col(stops)))
        columns = front.columns
        found = front if low == 0 else front.limit(0)
        hop = 0
        while high is None or hop < high:
            hop += 1
            front = front.join(step, F.col(stops) == F.col("start")).filter(~F.array_contains(ids, F.col("rid")))
            front = front.withColumn(ids, F.array_append(ids, F.col("rid"))).withColumn(stops, F.col("stop"))
            front = front.withColumn(walked, F.array_append(walked, F.col("stop"))).select(*columns)
            if high is None:
                front = materialize(front, "trails")
                if front.isEmpty():
                    break
            if hop >= low:
                found = found.unionByName(front)
        return replace(self, rows=found)


def match(graph: PropertyGraph, variable: str, label: str | None = None, properties: Iterable[str] | None = None) -> Match:
    """The start of a match: all nodes, or the nodes of a label."""
    return Match(graph, bind(_nodes(graph, label, properties), variable))


def match_rels(graph: PropertyGraph, start: str, rel: str, stop: str, types: Iterable[str] = (), direction: str = "out") -> Match:
    """Every relationship with its two ends."""
    types = [types] if isinstance(types, str) else list(types)
    rows = graph.hops(types, direction).select(
        F.col("rid").alias(f"{rel}__rid"), F.col("type").alias(f"{rel}__type"), F.col("src").alias(f"{rel}__src"), F.col("dst").alias(f"{rel}__dst"),
        F.col("start").alias(f"{start}__id"), F.col("stop").alias(f"{stop}__id"),
    )
    return Match(graph, rows, ((rel, frozenset(types)),))


def _nodes(graph: PropertyGraph, label: str | None, properties: Iterable[str] | None) -> DataFrame:
    if label is None:
        return graph.all_nodes(() if properties is None else properties)
    table = graph.label_scan(label)
    return table if properties is None else table.select("id", *properties)


def shortest_paths(
    graph: PropertyGraph, pairs: DataFrame, types: Iterable[str] = (), direction: str = "out",
    low: int = 1, high: int | None = None, every: bool = False,
) -> DataFrame:
    """``(source, target, length, nodes, rels)``: a shortest path, or all, for each distinct pair.

    ``pairs`` has ``source`` and ``target``.  The search starts from the side with fewer distinct ends,
    here its roots, and looks for the other ends, its goals.  Level by level the frontier of each root
    grows by one join, visited nodes are dropped by an anti-join, and every node keeps its steps from the
    level before; paths are then joined together from the goals back to the roots.  On the last level
    that ``high`` allows only the steps onto goals still open are made.  Without ``every`` the path
    with the smallest list of relationship ids is kept.  No path, one longer than ``high``, or a
    shortest one shorter than ``low`` gives no row; so does a null end.  Parallel relationships
    make different paths.
    """
    pairs = pairs.select("source", "target").filter("source IS NOT NULL AND target IS NOT NULL").distinct()
    pairs = materialize(pairs, "pairs")
    ends = pairs.agg(F.approx_count_distinct("source").alias("s"), F.approx_count_distinct("target").alias("t")).first()
    forward = ends["s"] <= ends["t"]
    root, goal = ("source", "target") if forward else ("target", "source")
    start, stop = ("start", "stop") if forward else ("stop", "start")
    step = graph.hops([types] if isinstance(types, str) else list(types), direction)
    step = step.select("rid", F.col(start).alias("near"), F.col(stop).alias("far"))
    trivial = pairs.filter("source = target").select(
        "source", "target", F.lit(0).alias("length"), F.array("source").alias("nodes"), F.array().cast("array<long>").alias("rels")
    )
    out = trivial if low == 0 else None
    open_pairs = pairs.filter("source <> target").select(F.col(root).alias("root"), F.col(goal).alias("goal"))
    level = materialize(open_pairs.select("root", F.col("root").alias("node")).distinct(), "level")
    seen, steps, depth = level, [], 0
    while (high is None or depth < high) and not open_pairs.isEmpty():
        depth += 1
        taken = level.join(step, F.col("node") == F.col("near")).select("root", "rid", "near", "far")
        if depth == high:
            # A goal that is open has not been seen, so that its join drops what has.
            met = open_pairs
        else:
            taken = taken.join(seen.withColumnRenamed("node", "far"), ["root", "far"], "left_anti")
            taken = materialize(taken, "steps")
            level = materialize(taken.select("root", F.col("far").alias("node")).distinct(), "level")
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
            met = materialize(open_pairs.join(level.withColumnRenamed("node", "goal"), ["root", "goal"], "left_semi"), "met")
        steps.append(taken)
        if depth != high:
            if met.isEmpty():
                continue
            open_pairs = materialize(open_pairs.join(met, ["root", "goal"], "left_anti"), "open-pairs")
        if depth < low:
            continue
        # ``at`` stands beside the lists, so that a caller who needs no lists carries none.
        none = F.array().cast("array<long>")
        paths = met.select("root", "goal", F.col("goal").alias("at"), F.array("goal").alias("nodes"), none.alias("rels"))
        for back in reversed(steps):
            one, rid = F.array("near"), F.array("rid")
            paths = paths.join(back.withColumnRenamed("far", "at"), ["root", "at"]).select(
                "root", "goal", F.col("near").alias("at"), (F.concat(one, "nodes") if forward else F.concat("nodes", one)).alias("nodes"),
                (F.concat(rid, "rels") if forward else F.concat("rels", rid)).alias("rels"),
            )
            if not every:
                # Among the ways between a goal and one node, the smallest list of relationships stays.
                paths = paths.groupBy("root", "goal", "at").agg(F.min_by(F.struct("nodes", "rels"), "rels").alias("p"))
                paths = paths.select("root", "goal", "at", "p.nodes", "p.rels")
        found = paths.select(F.col("root").alias(root), F.col("goal").alias(goal), F.lit(depth).alias("length"), "nodes", "rels")
        found = found.select("source", "target", "length", "nodes", "rels")
        out = found if out is None else out.unionByName(found)
    return trivial.limit(0) if out is None else out
