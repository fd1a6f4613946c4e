"""Graph algorithms over a projected edge frame.

A projection is a snapshot with frames ``nodes(id)`` and ``edges(src, dst, weight)``.  An undirected
one holds both directions of an edge and a self-loop once.  Iterations are joins and aggregations
whose result is rewritten to the shared folder, so lineage stays one round long and a lost executor
costs one round.  Only scalars (sums, counts, changes) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.graph import SPACE, PropertyGraph
from tessera.operators.components import connected_components
from tessera.storage import materialize

_UNSETTLED = "{} did not settle in {} rounds"
#: Numbers of labels that an id has room for, and pairs of labels that a plan names at most.
_LABELS, _MAX_KINDS = (1 << 64) // SPACE, 200


@dataclass(frozen=True)
class Projection:
    """``once`` holds each edge of an undirected projection in one direction only."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool
    once: DataFrame | None = None


class Catalog:
    """Named projections; projecting a name again replaces it."""

    def __init__(self) -> None:
        self._graphs: dict[str, Projection] = {}

    def project(
        self, name: str, graph: PropertyGraph, label: str | None = None, kind: str | None = None,
        orientation: str = "UNDIRECTED", weight: str | None = None,
    ) -> dict:
        """Nodes of one label and relationships of one type (None: all) whose two ends are among them.

        Undirected unless ``orientation`` is NATURAL; a missing weight is 1.0.
        """
        nodes = graph.all_nodes(()).select("id") if label is None else graph.label_scan(label).select("id")
        nodes = materialize(nodes.distinct(), "projected-nodes")
        rels = graph.rel_scan([] if kind is None else [kind], [] if weight is None else [weight])
        w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight in rels.columns else F.lit(1.0)
        edges = rels.select("src", "dst", w.alias("weight"))
        for end in ("src", "dst"):
            edges = edges.join(nodes.withColumnRenamed("id", end), end, "left_semi")
        made = project_edges(nodes, edges, directed=orientation == "NATURAL")
        self._graphs[name] = made
        return {"graphName": name, "nodeCount": made.nodes.count(), "relationshipCount": made.edges.count()}

    def get(self, name: str) -> Projection:
        if name not in self._graphs:
            raise KeyError(f"no projection {name}")
        return self._graphs[name]

    def names(self) -> list[str]:
        return sorted(self._graphs)

    def exists(self, name: str) -> bool:
        return name in self._graphs

    def drop(self, name: str) -> dict:
        gone = self.get(name)
        del self._graphs[name]
        return {"graphName": name, "nodeCount": gone.nodes.count(), "relationshipCount": gone.edges.count()}


def project_edges(nodes: DataFrame, edges: DataFrame, directed: bool = False, stored: bool = True) -> Projection:
    """A projection; one that is not ``stored`` reads its edges anew each time, for edges that a scan gives."""
    edges = edges.select("src", "dst", "weight")
    edges = materialize(edges, "projected-edges") if stored else edges
    if directed:
        return Projection(nodes.select("id"), edges, True)
    both = edges.unionByName(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return Projection(nodes.select("id"), both, False, edges)


def _simple(p: Projection) -> DataFrame:
    """Each undirected pair of different nodes once, as ``(a, b)`` with a < b."""
    edges = p.edges if p.once is None else p.once
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _neighbours(p: Projection) -> DataFrame:
    pairs = _simple(p)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def degree(p: Projection) -> DataFrame:
    """``(nodeId, score)``: outgoing edges, parallel ones counted each."""
    counts = p.edges.groupBy(F.col("src").alias("nodeId")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return p.nodes.withColumnRenamed("id", "nodeId").join(counts, "nodeId", "left").fillna(0.0, ["score"])


def pagerank(
    p: Projection, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-9, restart: DataFrame | None = None
) -> DataFrame:
    """``(nodeId, score)``, summing to 1.

    Weights set the shares of a node's outgoing edges; what nodes without outgoing weight hold goes
    to the restart distribution, which is uniform, or uniform over ``restart(id)`` (personalised).
    Stops when the scores change by less than ``tolerance`` in all.
    """
    count = p.nodes.count()
    if not count:
        return p.nodes.select(F.col("id").alias("nodeId"), F.lit(0.0).alias("score"))
    if restart is None:
        base = p.nodes.withColumn("base", F.lit(1.0 / count))
    else:
        seeds = restart.select("id").distinct().join(p.nodes, "id", "left_semi")
        share = 1.0 / seeds.count()
        base = p.nodes.join(seeds.withColumn("base", F.lit(share)), "id", "left").fillna(0.0, ["base"])
    totals = p.edges.groupBy("src").agg(F.sum("weight").alias("total")).filter("total > 0")
    shares = p.edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(totals, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("part"))
    shares = materialize(shares, "transitions")
    base = materialize(base.join(totals.select(F.col("src").alias("id"), F.lit(True).alias("sends")), "id", "left"), "restart")
    ranks = base.select("id", "base", "sends", F.col("base").alias("score"), F.lit(0.0).alias("change"))
    for _ in range(max_iterations):
        stuck = ranks.filter("sends IS NULL").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        sent = ranks.select(F.col("id").alias("src"), "score").join(shares, "src")
        sent = sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("part")).alias("got"))
        new = F.lit(1 - damping) * F.col("base") + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(stuck) * F.col("base"))
        ranks = ranks.join(sent, "id", "left").select("id", "base", "sends", new.alias("score"), F.abs(new - F.col("score")).alias("change"))
        ranks = materialize(ranks, "ranks")
        if ranks.agg(F.sum("change")).first()[0] < tolerance:
            break
    return ranks.select(F.col("id").alias("nodeId"), "score")


def wcc(p: Projection) -> DataFrame:
    """``(nodeId, componentId)``: the smallest node id of the weakly connected component."""
    found = connected_components(p.edges).withColumnRenamed("node", "id")
    return p.nodes.join(found, "id", "left").select(F.col("id").alias("nodeId"), F.coalesce("component", "id").alias("componentId"))


def _reach_least(edges: DataFrame, start: DataFrame, max_rounds: int) -> DataFrame:
    """For each node the smallest ``mark`` of ``start(id, mark)`` that reaches it along ``edges(src, dst)``."""
    marks, before = start, None
    for _ in range(max_rounds):
        sent = marks.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "mark")
        marks = materialize(marks.unionByName(sent).groupBy("id").agg(F.min("mark").alias("mark")), "marks")
        after = marks.agg(F.sum(F.hash("id", "mark").cast("long")), F.bit_xor(F.xxhash64("id", "mark"))).first()
        if after == before:
            return marks
        before = after
    raise RuntimeError(_UNSETTLED.format("reachability", max_rounds))


def scc(p: Projection, max_rounds: int = 1000) -> DataFrame:
    """``(nodeId, componentId)``: the smallest node id of the strongly connected component.

    Colouring: every open node takes the smallest id that reaches it; going backwards from each
    such id inside its colour finds one component a colour, which is then closed.
    """
    open_nodes = materialize(p.nodes, "open")
    edges = materialize(p.edges.filter("src <> dst").select("src", "dst").distinct(), "arcs")
    found = None
    for _ in range(max_rounds):
        if open_nodes.isEmpty():
            break
        colour = _reach_least(edges, open_nodes.withColumn("mark", F.col("id")), max_rounds)
        inside = edges.join(colour.select(F.col("id").alias("src"), F.col("mark").alias("a")), "src").join(
            colour.select(F.col("id").alias("dst"), F.col("mark").alias("b")), "dst"
        )
        back = materialize(inside.filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        roots = colour.filter("id = mark")
        closed = materialize(_reach_least(back, roots, max_rounds).select("id", "mark"), "closed")
        found = closed if found is None else found.unionByName(closed)
        open_nodes = materialize(open_nodes.join(closed, "id", "left_anti"), "open")
        for end in ("src", "dst"):
            edges = edges.join(open_nodes.withColumnRenamed("id", end), end, "left_semi")
        edges = materialize(edges, "arcs")
    if found is None:
        return p.nodes.select(F.col("id").alias("nodeId"), F.col("id").alias("componentId"))
    return found.select(F.col("id").alias("nodeId"), F.col("mark").alias("componentId"))


def _label(c: str) -> Column:
    return F.shiftright(F.col(c), SPACE.bit_length() - 1)


def _kind(u: str, v: str) -> Column:
    """One number for the labels of two nodes."""
    return _label(u) * _LABELS + _label(v)


def _kinds(arcs: DataFrame) -> tuple[set, set, set] | None:
    """Kinds of the arcs u-a, u-b and a-b that a triangle can have, by the labels that ids begin with.

    None (any kind) where there are more pairs of labels than a plan should name.
    """
    found = arcs.select(_label("u").alias("u"), _label("v").alias("v")).distinct().limit(_MAX_KINDS + 1).collect()
    if len(found) > _MAX_KINDS:
        return None
    known = {(r["u"], r["v"]) for r in found}
    whole = [((u, a), (u, b), (a, b)) for u, a in known for c, b in known if a == c and (u, b) in known]
    first, second, closing = ({u * _LABELS + v for u, v in (w[k] for w in whole)} for k in range(3))
    return first, second, closing


def _corners(p: Projection) -> tuple[DataFrame, DataFrame]:
    """``(id, d)``, the neighbours of each node that has any, and ``(id, n)``, the triangles of each that has any.

    Edges are directed from the end with the smaller degree, which bounds the arcs out of a hub.  A
    triangle u, a, b has the arcs u-a, u-b and a-b: two arcs of u make a pair a, b, which is looked up
    among the arcs, so that no list of neighbours is read more than once.  Only nodes with arcs both in
    and out can be a, and only pairs are made whose labels some arc joins.
    """
    pairs = materialize(_simple(p), "pairs")
    sizes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d")), "sizes")
    size_of = lambda end: sizes.select(F.col("id").alias(end), F.col("d").alias(f"d{end}")).hint("shuffle_hash")
    ranked = pairs.join(size_of("a"), "a").join(size_of("b"), "b")
    forward = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = ranked.select(
        F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"), F.greatest("da", "db").alias("d")
    )
    arcs = materialize(arcs, "forward")
    kinds = _kinds(arcs)
    first, second, closing = (F.lit(True) if kinds is None else _kind("u", "v").isin(k) for k in kinds or (None,) * 3)
    middle = arcs.filter(closing).select("u").distinct().join(arcs.filter(first).select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    middle = materialize(middle, "middle")
    near = arcs.filter(first).join(middle.withColumnRenamed("u", "v").hint("shuffle_hash"), "v", "left_semi").select("u", F.col("v").alias("a"), F.col("d").alias("da"))
    far = arcs.filter(second).select("u", F.col("v").alias("b"), F.col("d").alias("db"))
    ahead = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    joined = F.lit(True) if kinds is None else _kind("a", "b").isin(kinds[2])
    open_pairs = near.join(far, "u").filter(ahead & joined).select("a", "b", "u")
    closed = open_pairs.join(arcs.filter(closing).select(F.col("u").alias("a"), F.col("v").alias("b")).hint("shuffle_hash"), ["a", "b"])
    counts = closed.select(F.explode(F.array("u", "a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return sizes, counts


def triangles(p: Projection) -> DataFrame:
    """``(nodeId, triangleCount)`` on the simple undirected graph."""
    _, counts = _corners(p)
    counts = counts.select(F.col("id").alias("nodeId"), F.col("n").alias("triangleCount"))
    return p.nodes.withColumnRenamed("id", "nodeId").join(counts, "nodeId", "left").fillna(0, ["triangleCount"])


def clustering(p: Projection) -> DataFrame:
    """``(nodeId, coefficient)``: triangles over pairs of neighbours; 0 below two neighbours."""
    sizes, counts = _corners(p)
    both = p.nodes.join(counts, "id", "left").join(sizes, "id", "left")
    share = F.when(F.col("d") >= 2, F.coalesce("n", F.lit(0)) / (F.col("d") * (F.col("d") - 1) / 2)).otherwise(F.lit(0.0))
    return both.select(F.col("id").alias("nodeId"), share.cast("double").alias("coefficient"))


def _relax(edges: DataFrame, start: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """Distances ``(source, id, distance)`` after up to ``rounds`` rounds, and whether they settled.

    Only nodes whose distance fell in the last round send again.
    """
    known = materialize(start.withColumn("fresh", F.lit(True)), "distances")
    for _ in range(rounds):
        sent = known.filter("fresh").join(edges, F.col("id") == F.col("src"))
        sent = sent.select("source", F.col("dst").alias("id"), (F.col("distance") + F.col("weight")).alias("offer"))
        sent = sent.groupBy("source", "id").agg(F.min("offer").alias("offer"))
        better = F.col("distance").isNull() | (F.col("offer") < F.col("distance"))
        joined = known.drop("fresh").join(sent, ["source", "id"], "full_outer")
        known = materialize(
            joined.select("source", "id", F.least("distance", "offer").alias("distance"), F.coalesce(F.col("offer").isNotNull() & better, F.lit(False)).alias("fresh")),
            "distances",
        )
        if known.filter("fresh").isEmpty():
            return known.drop("fresh"), True
    return known.drop("fresh"), False


def dijkstra(p: Projection, source: int) -> DataFrame:
    """``(nodeId, distance)`` of the nodes that ``source`` reaches; a negative weight is an error."""
    if not p.edges.filter("weight < 0").isEmpty():
        raise ValueError("a weight is negative; use bellman_ford")
    return bellman_ford(p, source)


def bellman_ford(p: Projection, source: int) -> DataFrame:
    """``(nodeId, distance)``; weights may be negative, a reachable negative cycle is an error."""
    start = p.nodes.filter(F.col("id") == source).select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance"))
    found, settled = _relax(p.edges, start, max(1, p.nodes.count()))
    if not settled:
        raise ValueError("a negative cycle can be reached")
    return found.select(F.col("id").alias("nodeId"), "distance")


def closeness(p: Projection, weighted: bool = False, max_nodes: int = 100_000) -> DataFrame:
    """``(nodeId, score)``: (r-1)/(n-1) * (r-1)/sum of distances, over the r nodes that a node reaches.

    All pairs are needed, so graphs of more than ``max_nodes`` nodes are refused.
    """
    count = p.nodes.count()
    if count > max_nodes:
        raise ValueError(f"{count} nodes; closeness takes at most {max_nodes}")
    edges = p.edges if weighted else p.edges.withColumn("weight", F.lit(1.0))
    edges = materialize(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "arcs")
    start = p.nodes.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance"))
    found, _ = _relax(edges, start, max(1, count))
    sums = found.groupBy(F.col("source").alias("nodeId")).agg((F.count(F.lit(1)) - 1).alias("r"), F.sum("distance").alias("far"))
    score = F.when((F.col("r") > 0) & (F.col("far") > 0), F.col("r") / F.lit(max(1, count - 1)) * F.col("r") / F.col("far")).otherwise(F.lit(0.0))
    return sums.select("nodeId", score.cast("double").alias("score"))


def betweenness(p: Projection, max_nodes: int = 20_000) -> DataFrame:
    """``(nodeId, score)`` by Brandes on the simple graph; halved for an undirected one.

    Level by level all sources advance at once and count their shortest paths; the dependencies then
    flow back one level at a time.  All pairs are needed, so larger graphs are refused.
    """
    count = p.nodes.count()
    if count > max_nodes:
        raise ValueError(f"{count} nodes; betweenness takes at most {max_nodes}")
    arcs = p.edges.filter("src <> dst").select("src", "dst").distinct()
    arcs = materialize(arcs if p.directed else _neighbours(p), "arcs")
    level = p.nodes.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths"))
    seen, levels = level.select("s", "v"), [materialize(level, "level")]
    while True:
        ahead = levels[-1].join(arcs, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        ahead = materialize(ahead.join(seen, ["s", "v"], "left_anti"), "level")
        if ahead.isEmpty():
            break
        seen = materialize(seen.unionByName(ahead.select("s", "v")), "seen")
        levels.append(ahead)
    flow = levels[-1].withColumn("due", F.lit(0.0))
    total = flow.filter("s <> v")
    for level in reversed(levels[:-1]):
        back = flow.select("s", F.col("v").alias("w"), ((1 + F.col("due")) / F.col("paths")).alias("share"))
        back = back.join(arcs, F.col("w") == F.col("dst")).select("s", F.col("src").alias("v"), "share")
        back = level.join(back, ["s", "v"], "left").groupBy("s", "v", "paths").agg((F.coalesce(F.sum("share"), F.lit(0.0)) * F.col("paths")).alias("due"))
        flow = materialize(back, "flow")
        total = total.unionByName(flow.filter("s <> v"))
    half = 1.0 if p.directed else 0.5
    sums = total.groupBy(F.col("v").alias("nodeId")).agg((F.sum("due") * half).alias("score"))
    return p.nodes.withColumnRenamed("id", "nodeId").join(sums, "nodeId", "left").fillna(0.0, ["score"])


def label_propagation(p: Projection, max_iterations: int = 100) -> DataFrame:
    """``(nodeId, communityId)``: synchronous label propagation on the simple undirected graph.

    Every round each node takes the most frequent label among its neighbours and itself, ties going
    to the smallest.  The reference updates node by node in id order; that order can't be kept in
    parallel rounds, so ``label_propagation_in_order`` does it for small graphs.
    """
    start = p.nodes.select("id", F.col("id").alias("mark"))
    if max_iterations < 1:
        return start.select(F.col("id").alias("nodeId"), F.col("mark").alias("communityId"))
    pairs = materialize(_simple(p), "pairs")
    arcs = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    # In the first round every label occurs once, so that the smallest wins.
    least = arcs.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("least"))
    marks = materialize(start.join(least, "id", "left").select("id", F.least("mark", "least").alias("mark")), "marks")
    past = []
    for done in range(1, max_iterations + 1):
        after = marks.agg(F.sum(F.hash("id", "mark").cast("long")), F.bit_xor(F.xxhash64("id", "mark"))).first()
        found = next((k for k, (state, _) in enumerate(past) if state == after), None)
        if found is not None:
            # The labels go in a circle from here on; the last round falls on one of its states.
            marks = past[found + (max_iterations - found - 1) % (len(past) - found)][1]
            break
        past.append((after, marks))
        if done == max_iterations:
            break
        votes = arcs.join(marks, F.col("dst") == F.col("id")).select(F.col("src").alias("id"), "mark").unionByName(marks)
        tally = votes.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n"))
        marks = materialize(tally.groupBy("id").agg(F.max_by("mark", F.struct("n", -F.col("mark"))).alias("mark")), "marks")
    return marks.select(F.col("id").alias("nodeId"), F.col("mark").alias("communityId"))


def label_propagation_in_order(p: Projection, max_iterations: int = 100, max_edges: int = 2_000_000) -> DataFrame:
    """Asynchronous label propagation in ascending node order, ties to the smallest label.

    Each step depends on the one before, so one task does it; more than ``max_edges`` are refused.
    """
    arcs = _neighbours(p)
    if arcs.count() > max_edges:
        raise ValueError(f"more than {max_edges} edges; use label_propagation")
    lists = p.nodes.join(arcs.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("near")), "id", "left")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        label = {i: i for i in frame["id"]}
        near = {i: list(x) if x is not None else [] for i, x in zip(frame["id"], frame["near"], strict=True)}
        for _ in range(max_iterations):
            changed = False
            for i, others in near.items():
                if others:
                    votes: dict[int, int] = {}
                    for j in others:
                        votes[label[j]] = votes.get(label[j], 0) + 1
                    best = min(votes, key=lambda k: (-votes[k], k))
                    changed |= best != label[i]
                    label[i] = best
            if not changed:
                break
        return pd.DataFrame({"nodeId": list(label.keys()), "communityId": list(label.values())})

    return lists.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "nodeId long, communityId long")
