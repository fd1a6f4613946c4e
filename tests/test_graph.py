"""Hand-computed graphs: patterns, paths, algorithms, writes, functions and files."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as fn
from tessera.functions import spatial, temporal
from tessera.graph import SPACE, PropertyGraph, prop
from tessera.operators import algorithms as alg
from tessera.operators import fulltext, writes
from tessera.operators.pattern import match, match_rels, shortest_paths
from tessera.operators.procedures import Procedures, lookup
from tessera.sources import csv, sinks


def edges(spark, pairs):
    rows = [(a, b, float(w[0]) if w else 1.0) for a, b, *w in pairs]
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def projection(spark, n, pairs, directed=False):
    return alg.project_edges(spark.range(n), edges(spark, pairs), directed)


def values(df):
    a, b = df.columns
    return {r[a]: r[b] for r in df.collect()}


@pytest.fixture(scope="module")
def chain(spark):
    """a -> b -> c -> a, b -> c twice, and a loop at c."""
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id long, name string")
    rels = [(10, 1, 2), (11, 2, 3), (12, 2, 3), (13, 3, 1), (14, 3, 3)]
    return PropertyGraph(spark, {"N": nodes}, {"R": spark.createDataFrame(rels, "rid long, src long, dst long")})


def test_self_loop_counts_once_either_way(chain):
    rows = match(chain, "n", "N").hop("n", "r", "m", "R", "both").rows
    assert rows.filter(prop("n", "id") == 3).count() == 4
    assert match_rels(chain, "a", "r", "b").rows.count() == 5


def test_no_relationship_twice_in_a_match(chain):
    m = match(chain, "a", "N").hop("a", "x", "b", "R").hop("b", "y", "a", "R", "in")
    assert sorted((r["x__rid"], r["y__rid"]) for r in m.rows.collect()) == [(11, 12), (12, 11)]


def test_trails_end_on_cycles(chain):
    rows = match(chain, "n", "N").where("n__id = 1").trails("n", "r", "m", "R").rows.collect()
    want = {(10,), (10, 11), (10, 12)}
    for first, other in ((11, 12), (12, 11)):
        want |= {(10, first, 14), (10, first, 13), (10, first, 14, 13)}
    assert {tuple(r["r__rids"]) for r in rows} == want


def test_zero_length_trails_hold_the_anchor(chain):
    rows = match(chain, "n", "N").trails("n", "r", "m", "R", 0, 0).rows.collect()
    assert {(r["n__id"], r["m__id"]) for r in rows} == {(i, i) for i in (1, 2, 3, 4)}


def test_shortest_paths(chain, spark):
    pairs = spark.createDataFrame([(1, 3), (1, 4), (3, 2), (None, 1)], "source long, target long")
    one = {(r["source"], r["target"]): (r["length"], r["nodes"], r["rels"]) for r in shortest_paths(chain, pairs, "R").collect()}
    assert one == {(1, 3): (2, [1, 2, 3], [10, 11]), (3, 2): (2, [3, 1, 2], [13, 10])}
    every = shortest_paths(chain, pairs, "R", every=True).collect()
    assert sorted(r["rels"] for r in every) == [[10, 11], [10, 12], [13, 10]]
    assert shortest_paths(chain, pairs, "R", low=3).count() == 0
    assert shortest_paths(chain, pairs, "R", high=1).count() == 0


def test_shortest_paths_from_the_smaller_side(spark, monkeypatch):
    """Forty leaves of a hub to one far end: the search goes from that end and never from leaf to leaf."""
    from tessera.operators import pattern

    leaves = range(100, 140)
    rels = [(1000 + i, i, 1) for i in leaves] + [(1, 1, 2), (2, 2, 3), (3, 2, 3)]
    g = PropertyGraph(spark, {"N": spark.range(200)}, {"R": spark.createDataFrame(rels, "rid long, src long, dst long")})
    written = {}

    def counting(df, tag):
        stored = materialize(df, tag)
        written[tag] = written.get(tag, 0) + stored.count()
        return stored

    materialize = pattern.materialize
    monkeypatch.setattr(pattern, "materialize", counting)
    pairs = spark.createDataFrame([(i, 3) for i in leaves], "source long, target long")
    one = shortest_paths(g, pairs, "R", "both").collect()
    assert sorted((r["source"], r["length"], r["nodes"], r["rels"]) for r in one) == [(i, 3, [i, 1, 2, 3], [1000 + i, 1, 2]) for i in leaves]
    assert written["steps"] < 100
    every = shortest_paths(g, pairs, "R", "both", every=True).collect()
    assert sorted(r["rels"] for r in every) == sorted([1000 + i, 1, k] for i in leaves for k in (2, 3))


def test_counting_shortest_paths_carries_no_lists(chain, spark):
    found = shortest_paths(chain, spark.createDataFrame([(1, 3)], "source long, target long"), "R", high=2, every=True)
    counts = found.groupBy("source", "target", "length").count()
    assert [tuple(r) for r in counts.collect()] == [(1, 3, 2, 2)]
    assert "concat(" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_part_less_pairs_as_brute_force_does(spark):
    nan = float("nan")
    low = [(i, i % 3, v) for i, v in enumerate([0.5, 1.0, 1.0, -2.0, nan, None, 9.0, 3.0, 0.0, 2.0])]
    high = [(100 + i, i % 3, v) for i, v in enumerate([1.0, 1.0, 1.0, 2.5, nan, None, -3.0, 9.0, 9.5, 0.0, 1.0])]
    nodes = spark.createDataFrame(low + high, "id long, hub long, v double")
    rels = nodes.selectExpr("id AS rid", "id AS src", "1000 + hub AS dst")
    g = PropertyGraph(spark, {"N": nodes.filter("id < 100"), "M": nodes.filter("id >= 100")}, {"R": rels}, {"R": (frozenset("NM"), frozenset("H"))})
    a, b = match(g, "a", "N", ["v"]).hop("a", "x", "h", "R"), match(g, "b", "M", ["v"]).hop("b", "y", "h", "R")
    want = sorted((r["a__id"], r["b__id"]) for r in a.part(b).where(prop("a", "v") < prop("b", "v")).rows.collect())
    for bins in (1, 4, 64):
        rows = a.part_less(b, prop("a", "v"), prop("b", "v"), bins).rows
        assert sorted((r["a__id"], r["b__id"]) for r in rows.collect()) == want and want
    # A label that not all steps reach is joined before the steps meet the rows.
    plan = a.hop("h", "y", "b", "R", "in", "M").rows._jdf.queryExecution().analyzed().toString()
    assert plan.index("Join Inner, (h__id") < plan.index("Join Inner, (y__stop")


def test_optional_and_lists(chain):
    inner = match(chain, "n", "N", []).hop("n", "r", "m", "R")
    assert match(chain, "n", "N").optional(inner).rows.filter("m__id IS NULL").count() == 1
    rows = match(chain, "n", "N").collect_matches(inner, prop("m", "id"), "to").rows
    assert {r["n__id"]: r["to"] for r in rows.collect()} == {1: [2], 2: [3, 3], 3: [1, 3], 4: []}


def test_pagerank_ring_dangling_and_weights(spark):
    ring = values(alg.pagerank(projection(spark, 4, [(0, 1), (1, 2), (2, 3), (3, 0)], True), tolerance=1e-6))
    assert all(v == pytest.approx(0.25, abs=1e-5) for v in ring.values())
    dangling = values(alg.pagerank(projection(spark, 3, [(0, 1), (1, 2)], True), max_iterations=8, tolerance=1e-3))
    assert sum(dangling.values()) == pytest.approx(1) and dangling[2] > dangling[1] > dangling[0]
    weighted = values(alg.pagerank(projection(spark, 3, [(0, 1, 9.0), (0, 2, 1.0)], True), max_iterations=8, tolerance=1e-3))
    assert weighted[1] > weighted[2]
    own = alg.pagerank(projection(spark, 3, [(0, 1), (1, 0)], True), max_iterations=8, tolerance=1e-3, restart=spark.range(1))
    assert values(own)[2] == 0


def test_components_and_cycles(spark):
    assert values(alg.wcc(projection(spark, 6, [(5, 4), (4, 3), (1, 0)]))) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 3}
    arcs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5)]
    assert values(alg.scc(projection(spark, 6, arcs, True))) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_degree_triangles_and_clustering(spark):
    multi = projection(spark, 4, [(0, 1), (0, 1), (1, 2), (2, 0), (2, 2), (2, 3)])
    assert values(alg.degree(multi)) == {0: 3.0, 1: 3.0, 2: 4.0, 3: 1.0}
    assert values(alg.triangles(multi)) == {0: 1, 1: 1, 2: 1, 3: 0}
    assert values(alg.clustering(multi)) == {0: 1.0, 1: 1.0, 2: pytest.approx(1 / 3), 3: 0.0}


def test_triangles_send_lists_only_to_middles(spark, monkeypatch):
    """Sixty fans of one pair of hubs, without an edge between these: nothing is in the middle."""
    pairs = [(k, hub) for k in range(2, 62) for hub in (0, 1)]
    written = {}

    def keeping(df, tag):
        written[tag] = stored = materialize(df, tag)
        return stored

    materialize = alg.materialize
    monkeypatch.setattr(alg, "materialize", keeping)
    assert set(values(alg.triangles(projection(spark, 62, pairs))).values()) == {0}
    assert written["middle"].count() == 0 and written["projected-edges"].count() == len(pairs)
    got = values(alg.triangles(projection(spark, 62, [*pairs, (0, 1), (1, 0)])))
    assert got == {0: 60, 1: 60, **{k: 1 for k in range(2, 62)}}


def test_clustering_finds_its_pairs_once(spark, monkeypatch):
    tags, materialize = [], alg.materialize
    monkeypatch.setattr(alg, "materialize", lambda df, tag: tags.append(tag) or materialize(df, tag))
    found = alg.clustering(projection(spark, 5, [(0, 1), (1, 2), (2, 0), (2, 3)]))
    assert values(found) == {0: 1.0, 1: 1.0, 2: pytest.approx(1 / 3), 3: 0.0, 4: 0.0}
    # Degrees come from a stored table, so that the plan makes no pairs again.
    assert tags.count("sizes") == 1 and "distinct" not in found._jdf.queryExecution().analyzed().toString().lower()


def test_triangles_as_brute_force_finds_them(spark, monkeypatch):
    """Labelled nodes, hubs and repeated edges; no list of a node's neighbours is gathered and read for each arc into it."""
    rng = random.Random(5)
    ids = [label * SPACE + k for label, count in ((-2, 3), (0, 6), (5, 12), (8, 25)) for k in range(count)]
    pairs = [tuple(rng.choice(ids) for _ in range(2)) for _ in range(400)] + [(ids[0], x) for x in ids]
    near = {x: {b if a == x else a for a, b in pairs if x in (a, b)} - {x} for x in ids}
    want = {x: sum(b in near[a] for a in near[x] for b in near[x] if a < b) for x in ids}
    nodes = spark.createDataFrame([(x,) for x in ids], "id long")
    p = alg.project_edges(nodes, edges(spark, pairs))
    split = [(a, b) for a, b in pairs if a < SPACE <= b]
    assert set(values(alg.triangles(alg.project_edges(nodes, edges(spark, split)))).values()) == {0}
    for most in (alg._MAX_KINDS, 1):
        monkeypatch.setattr(alg, "_MAX_KINDS", most)
        found = alg.triangles(p)
        assert values(found) == want and any(want.values())
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "array_intersect" not in plan
        assert ("shiftright" in plan) == (most > 1)


def test_centralities(spark):
    path = projection(spark, 3, [(0, 1), (1, 2)])
    assert values(alg.betweenness(path)) == {0: 0.0, 1: 1.0, 2: 0.0}
    assert values(alg.closeness(path)) == {0: pytest.approx(2 / 3), 1: 1.0, 2: pytest.approx(2 / 3)}


def test_distances(spark):
    g = projection(spark, 4, [(0, 1, 4), (0, 2, 1), (2, 1, 2)], True)
    assert values(alg.dijkstra(g, 0)) == {0: 0.0, 1: 3.0, 2: 1.0}
    negative = projection(spark, 3, [(0, 1, 4), (1, 2, -3), (0, 2, 2)], True)
    assert values(alg.bellman_ford(negative, 0)) == {0: 0.0, 1: 4.0, 2: 1.0}
    with pytest.raises(ValueError):
        alg.dijkstra(negative, 0)
    with pytest.raises(ValueError):
        alg.bellman_ford(projection(spark, 2, [(0, 1, 1), (1, 0, -2)], True), 0)


def test_label_propagation_of_two_cliques(spark):
    cliques = [(a, b) for k in (0, 4) for a in range(k, k + 4) for b in range(a + 1, k + 4)] + [(3, 4)]
    for run in (alg.label_propagation, alg.label_propagation_in_order):
        got = values(run(projection(spark, 9, cliques)))
        assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(4, 8)}) == 1 and got[8] == 8


def test_label_propagation_stops_in_a_circle(spark, monkeypatch):
    """Two hubs of four leaves whose labels change sides: as many rounds as asked for, in a few."""
    pairs = [(0, 5), (0, 6), (0, 7), (0, 8), (1, 5), (1, 6), (1, 7), (1, 8), (2, 3)]
    by_hand = {i: i for i in range(10)}
    near = {i: [b for a, b in pairs if a == i] + [a for a, b in pairs if b == i] for i in range(10)}
    for rounds in range(1, 8):
        votes = {i: [by_hand[j] for j in (*near[i], i)] for i in range(10)}
        by_hand = {i: min(v, key=lambda k: (-v.count(k), k)) for i, v in votes.items()}
        assert values(alg.label_propagation(projection(spark, 10, pairs), rounds)) == by_hand
    tags, materialize = [], alg.materialize
    monkeypatch.setattr(alg, "materialize", lambda df, tag: tags.append(tag) or materialize(df, tag))
    alg.label_propagation(projection(spark, 10, pairs), 99)
    assert tags.count("marks") < 8 and tags.count("arcs") == 0


def test_writes(chain, spark):
    g, c = writes.create_nodes(chain, "N", spark.createDataFrame([(5, "e")], "id long, name string"))
    assert c.nodes_created == 1 and g.label_scan("N").count() == 5 and chain.label_scan("N").count() == 4
    rows = spark.createDataFrame([("a",), ("z",), ("z",)], "name string")
    g, matched, c = writes.merge_nodes(g, "N", rows, ["name"], F.xxhash64("name"), on_match={"seen": F.lit(True)})
    assert c.nodes_created == 1 and matched.count() == 3
    g, c = writes.set_properties(g, "N", spark.createDataFrame([(1, None), (99, "x")], "id long, name string"), ["name"])
    assert c.properties_set == 1 and g.label_scan("N").filter("id = 1").first()["name"] is None
    with pytest.raises(ValueError):
        writes.delete_nodes(g, spark.createDataFrame([(1,)], "id long"))
    g, c = writes.delete_nodes(g, spark.createDataFrame([(1,)], "id long"), detach=True)
    assert (c.nodes_deleted, c.rels_deleted) == (1, 2)
    assert writes.relabel(g, spark.createDataFrame([(2,)], "id long"), add="M").label_scan("M").count() == 1


def test_set_writes_only_its_values(chain, spark, monkeypatch):
    written, materialize = [], writes.materialize
    monkeypatch.setattr(writes, "materialize", lambda df, tag: written.append((tag, df.columns)) or materialize(df, tag))
    g, c = writes.set_rel_properties(chain, "R", spark.createDataFrame([(11, True), (99, True)], "rid long, heavy boolean"), ["heavy"])
    assert written == [("values", ["id", "heavy"])] and c.properties_set == 1
    assert {r["rid"]: r["heavy"] for r in g.rels["R"].collect()} == {10: None, 11: True, 12: None, 13: None, 14: None}
    g, _ = writes.set_rel_properties(g, "R", spark.createDataFrame([(11, None), (12, False)], "rid long, heavy boolean"), ["heavy"])
    assert {r["rid"]: r["heavy"] for r in g.rels["R"].collect()} == {10: None, 11: None, 12: False, 13: None, 14: None}


def test_merge_spreads_its_rows(chain, spark, monkeypatch):
    monkeypatch.setattr(writes, "_TASK_ROWS", 100)
    rows = spark.range(3000).selectExpr("id % 500 AS src", "id % 500 + 1000 AS dst")
    g, matched, c = writes.merge_rels(chain, "S", rows, F.xxhash64("src", "dst"))
    assert (c.rels_created, matched.count(), g.rels["S"].count()) == (500, 3000, 500)
    assert "REPARTITION_BY_NUM" in matched._jdf.queryExecution().executedPlan().toString()


def test_procedures(chain, spark):
    p = Procedures(chain)
    assert [r[0] for r in p.call("db.labels").collect()] == ["N"]
    made = p.call("gds.graph.project", "g").first()
    assert (made["nodeCount"], made["relationshipCount"]) == (4, 9)
    assert p.call("gds.wcc.stream", "g").select("componentId").distinct().count() == 2
    p.register("own.ids", lambda: chain.label_scan("N").select("id"))
    assert p.call("own.ids").count() == 4 and "own.ids" in p.names()
    with pytest.raises(ValueError):
        p.register_function("toUpper", F.upper)
    p.register("own.upto", lambda n: spark.range(n).toDF("id"), [("n", int)], "id long")
    assert p.call("own.upto", 3).count() == 3
    for wrong in ((), (1, 2), ("3",), (True,)):
        with pytest.raises(TypeError):
            p.call("own.upto", *wrong)
    p.register("own.mistyped", lambda: spark.range(1), [], "id string")
    with pytest.raises(TypeError):
        p.call("own.mistyped")
    p.register_function("twice", lambda x: 2 * x, arity=1)
    p.register_function("spread", lambda x: F.max(x) - F.min(x), arity=1, aggregate=True)
    got = spark.range(5).agg(p.function("SPREAD", p.function("twice", F.col("id"))).alias("s")).first()["s"]
    assert got == 8 and p.aggregates == {"spread"}
    with pytest.raises(TypeError):
        p.function("twice", F.lit(1), F.lit(2))
    with pytest.raises(KeyError):
        p.function("thrice", F.lit(1))
    table = spark.createDataFrame([(None, "none"), (1, "one")], "k long, v string")
    rows = spark.createDataFrame([(None,), (1,), (2,)], "x long")
    assert {(r["x"], r["v"]) for r in lookup(rows, table, {"k": F.col("x")}).collect()} == {(None, "none"), (1, "one")}


def test_value_rules(spark):
    nan = float("nan")
    row = spark.range(1).select(
        fn.equal(F.lit(nan), F.lit(nan)).alias("eq"), fn.less(F.lit(1.0), F.lit(nan)).alias("lt"),
        fn.int_divide(F.lit(-7), F.lit(2)).alias("q"), fn.float_divide(F.lit(-1.0), F.lit(0.0)).alias("inf"),
        fn.float_divide(F.lit(0.0), F.lit(0.0)).alias("nan"), fn.slice_(F.array(*map(F.lit, range(5))), 1, -1).alias("sl"),
        fn.range_(F.lit(3), F.lit(1)).alias("r0"), fn.range_(F.lit(3), F.lit(1), -1).alias("r1"),
        fn.to_integer(F.lit(" 12.9 ")).alias("i"), fn.to_integer(F.lit("x")).alias("ix"), fn.to_boolean(F.lit(" TRUE")).alias("b"),
        fn.trim(F.lit("  a\t")).alias("t"), fn.replace(F.lit("ab"), "", "-").alias("rep"), fn.split(F.lit("a.b"), ".").alias("sp"),
        fn.split(F.lit("ab"), "").alias("ch"), fn.right(F.lit("abc"), 2).alias("ri"), fn.substring(F.lit("hello"), 1, 3).alias("su"),
        fn.is_in(F.lit(1), F.array(F.lit(2), F.lit(None))).alias("in"), fn.single_of(F.array(F.lit(1), F.lit(1)), lambda x: x == 1).alias("si"),
        fn.tail(F.lit(None).cast("array<int>")).alias("ta"),
    ).first()
    assert (row["eq"], row["lt"], row["q"], row["inf"]) == (False, False, -3, -math.inf) and math.isnan(row["nan"])
    assert (row["sl"], row["r0"], row["r1"], row["i"], row["ix"], row["b"]) == ([1, 2, 3], [], [3, 2, 1], 12, None, True)
    assert (row["t"], row["rep"], row["sp"], row["ch"], row["ri"], row["su"]) == ("a", "-a-b-", ["a", "b"], ["a", "b"], "bc", "ell")
    assert row["in"] is None and row["si"] is False and row["ta"] == []


def test_time_and_space(spark):
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-31 10:00:00", "2024-03-01 09:00:00"))
    row = spark.range(1).select(
        temporal.between(a, b).alias("d"), temporal.add(a, temporal.duration(months=1, seconds=1)).cast("string").alias("t"),
        temporal.truncate("century", a).cast("string").alias("c"), temporal.truncate("weekYear", a).cast("string").alias("w"),
        spatial.distance(spatial.point(F.lit(0), F.lit(0)), spatial.point(F.lit(3), F.lit(4))).alias("m"),
        spatial.distance(spatial.point(F.lit(0), F.lit(0)), spatial.point(F.lit(3), F.lit(4), srid=4326)).alias("x"),
    ).first()
    assert tuple(row["d"]) == (1, 0, 23 * 3600, 0) or tuple(row["d"])[0] == 1
    assert (row["t"], row["c"][:10], row["w"][:10], row["m"], row["x"]) == ("2024-02-29 10:00:01", "2000-01-01", "2024-01-01", 5.0, None)


@pytest.mark.parametrize("parse", [temporal.parse_duration, temporal.parse_datetime])
def test_texts_are_read_once(spark, parse):
    """A pattern is applied a few times for each text, not once for each use of each part."""
    frame = spark.createDataFrame([("P1Y2M3W4DT5H6M7.5S",), ("2024-07-01T10:00[Europe/Berlin]",), ("PT1S\n",), ("x",), (None,)], "t string")
    frame = frame.select(parse(F.col("t")).alias("d"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_") < 10
    got = [r["d"] for r in frame.collect()]
    if parse is temporal.parse_duration:
        assert [None if r is None else tuple(r) for r in got] == [(14, 25, 18367, 500_000_000), None, (0, 0, 1, 0), None, None]
    else:
        assert [None if r is None else (str(r["local"]), r["offset"], r["zone"]) for r in got] == [None, ("2024-07-01 10:00:00", 7200, "Europe/Berlin"), None, None, None]


def test_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id:ID,:LABEL,name:string,age:int,tags:string[]\n1,Person,Ann,30,a;b\n2,Person,Bob,,\n")
    (tmp_path / "r.csv").write_text(":START_ID,:END_ID,:TYPE,since:int\n1,2,KNOWS,2001\n")
    g = csv.graph_from_bulk(spark, [str(tmp_path / "n.csv")], [str(tmp_path / "r.csv")])
    rows = {r["name"]: (r["age"], r["tags"]) for r in g.label_scan("Person").collect()}
    assert rows == {"Ann": (30, ["a", "b"]), "Bob": (None, None)}
    m = match(g, "a", "Person", ["name"]).hop("a", "r", "b", "KNOWS", label="Person", properties=["name"])
    assert [(r["a__name"], r["b__name"]) for r in m.rows.collect()] == [("Ann", "Bob")]
    ids, rids = sinks.graph_view(m.rows, ["a", "b"], ["r"])
    assert (ids.count(), rids.count()) == (2, 1)
    assert [r["row"]["name:string"] for r in csv.load_csv(spark, str(tmp_path / "n.csv")).collect()] == ["Ann", "Bob"]
    (tmp_path / "d.csv").write_text("id:ID,name\n1,x\n1,y\n")
    with pytest.raises(ValueError):
        csv.bulk_nodes(spark, str(tmp_path / "d.csv"))
    assert csv.bulk_nodes(spark, str(tmp_path / "d.csv"), duplicates="skip").select("id").distinct().count() == 2
    with pytest.raises(ValueError):
        csv.parse_header(["x:decimal"])
    csv.dump_csv(g.label_scan("Person").select("name", "tags"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    sinks.write_cold(spark.range(100).selectExpr("id AS seq", "id * 10 AS ts", "1.0 AS value"), str(tmp_path / "cold"), 4)
    assert sinks.read_cold(spark, str(tmp_path / "cold"), 100, 200).count() == 10


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "The red Fox"), (2, "a fox, a FOX and a dog"), (3, None)], "id long, text string")
    assert values(fulltext.query_nodes(docs, "text", "fox dog the")) == {1: 1, 2: 2}
    assert values(fulltext.query_nodes(docs, "text", "fox dog", every=True)) == {2: 2}
