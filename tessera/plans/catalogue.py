"""The registered graph queries and the SQL that gives the same rows.

Every query reads the driver's tables as a property graph; ``SPACE`` in the SQL is the distance
between the id ranges of two labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import aggregates as agg
from tessera.functions import scalar as fn
from tessera.functions import spatial, temporal
from tessera.graph import SPACE, from_tables, node_id, prop
from tessera.operators import algorithms, fulltext, writes
from tessera.operators.pattern import match, match_rels, shortest_paths
from tessera.operators.procedures import lookup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a graph under its name, with its SQL where there is one."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(from_tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.replace("SPACE", str(SPACE))
        return f

    return add


# Scans and filters


@query("SELECT label, count(*) AS n FROM (SELECT 'Region' AS label FROM region UNION ALL SELECT 'Nation' FROM nation UNION ALL SELECT 'Customer' FROM customer UNION ALL SELECT 'Supplier' FROM supplier UNION ALL SELECT 'Part' FROM part UNION ALL SELECT 'Order' FROM orders UNION ALL SELECT 'User' FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT 'Event' FROM events UNION ALL SELECT 'Doc' FROM documents) GROUP BY label")
def all_nodes_scan(g):
    """MATCH (n) RETURN labels(n)[0], count(*)"""
    return g.all_nodes(()).groupBy(F.col("labels")[0].alias("label")).agg(agg.count().alias("n"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def label_scan(g):
    return g.label_scan("Customer").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 7")
def index_seek(g):
    """MATCH (p:Part {p_size: 7})"""
    return match(g, "p", "Part").where(prop("p", "p_size") == 7).rows.select(prop("p", "p_partkey").alias("p_partkey"), prop("p", "p_name").alias("p_name"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 400000")
def range_seek(g):
    rows = match(g, "o", "Order").where(prop("o", "o_totalprice") >= 400000).rows
    return rows.select(prop("o", "o_orderkey").alias("o_orderkey"), prop("o", "o_totalprice").alias("o_totalprice"))


@query("SELECT p_partkey FROM part WHERE sqrt(pow(p_size - 25, 2) + pow(p_retailprice / 100 - 12, 2)) <= 5")
def spatial_seek(g):
    """Parts whose point (size, price / 100) lies within 5 of (25, 12)."""
    rows = g.label_scan("Part").withColumn("px", F.col("p_size").cast("double")).withColumn("py", F.col("p_retailprice") / 100)
    return spatial.within(rows, "px", "py", (25, 12), 5).select("p_partkey")


@query("SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'DID', count(*) FROM events")
def all_relationships_scan(g):
    """MATCH ()-[r]->() RETURN type(r), count(*)"""
    return match_rels(g, "a", "r", "b").rows.groupBy(F.col("r__type").alias("type")).agg(agg.count().alias("n"))


@query("SELECT n_nationkey * 2 AS n FROM nation UNION ALL SELECT n_nationkey * 2 + 1 FROM nation")
def unwind(g):
    """UNWIND [2k, 2k + 1] AS n"""
    k = F.col("n_nationkey")
    rows = writes.unwind(g.label_scan("Nation").select("n_nationkey"), F.array(k * 2, k * 2 + 1), "n")
    return rows.select("n")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def procedure_lookup(g):
    """A procedure whose rows are looked up by an argument; nulls are equivalent."""
    table = g.label_scan("Nation").select("n_nationkey", "n_name")
    return lookup(g.label_scan("Customer").select("c_custkey", "c_nationkey"), table, {"n_nationkey": F.col("c_nationkey")}).select("c_custkey", "n_name")


# Hops


@query("SELECT c_custkey AS id, count(*) AS deg FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY deg DESC, id LIMIT 5")
def top_degree(g):
    """MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS deg RETURN c.c_custkey, deg ORDER BY deg DESC, id LIMIT 5"""
    rows = match(g, "c", "Customer", ["c_custkey"]).hop("c", "r", "o", "PLACED").rows
    rows = rows.groupBy(prop("c", "c_custkey").alias("id")).agg(agg.count(prop("o", "id")).alias("deg"))
    return rows.orderBy(F.desc("deg"), "id").limit(5)


@query("SELECT r_name, n_name, count(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name")
def two_hops_back(g):
    """MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)"""
    m = match(g, "r", "Region").hop("r", "x", "n", "IN_REGION", "in", "Nation").hop("n", "y", "c", "IN_NATION", "in", "Customer", [])
    return m.rows.groupBy(prop("r", "r_name").alias("r_name"), prop("n", "n_name").alias("n_name")).agg(agg.count().alias("customers"))


@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + 1 AS deg FROM nation")
def undirected_degree(g):
    """MATCH (n:Nation)--() RETURN n, count(*)"""
    rows = match(g, "n", "Nation", ["n_nationkey"]).hop("n", "r", "x", ["IN_REGION", "IN_NATION"], "both").rows
    return rows.groupBy(prop("n", "n_nationkey").alias("n_nationkey")).agg(agg.count().alias("deg"))


@query("SELECT s_suppkey, count(*) AS n FROM supplier JOIN (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT DISTINCT l_suppkey + 0 * l_partkey FROM lineitem WHERE false UNION ALL SELECT l_suppkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) ON k = s_suppkey GROUP BY s_suppkey")
def type_alternatives(g):
    """MATCH (s:Supplier)-[:IN_NATION|SUPPLIES]->()"""
    rows = match(g, "s", "Supplier", ["s_suppkey"]).hop("s", "r", "x", ["IN_NATION", "SUPPLIES"]).rows
    return rows.groupBy(prop("s", "s_suppkey").alias("s_suppkey")).agg(agg.count().alias("n"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def relationship_uniqueness(g):
    """MATCH (a:Nation)-[x:IN_REGION]->()<-[y:IN_REGION]-(b:Nation): x and y differ, so a is never b."""
    m = match(g, "a", "Nation", ["n_nationkey"]).hop("a", "x", "r", "IN_REGION").hop("r", "y", "b", "IN_REGION", "in", "Nation", ["n_nationkey"])
    return m.rows.select(prop("a", "n_nationkey").alias("a"), prop("b", "n_nationkey").alias("b"))


@query("SELECT c_nationkey AS nation, count(DISTINCT (c_custkey, s_suppkey)) AS pairs, count(*) AS trades FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_suppkey AS sk, l_partkey AS pk FROM lineitem) s ON s.pk = l_partkey JOIN supplier ON s_suppkey = s.sk AND s_nationkey = c_nationkey GROUP BY c_nationkey")
def expand_into(g):
    """MATCH (c:Customer)-[:PLACED]->()-[:CONTAINS]->()<-[:SUPPLIES]-(s:Supplier)-[:IN_NATION]->(n), (c)-[:IN_NATION]->(n)"""
    m = match(g, "c", "Customer", []).hop("c", "v", "n", "IN_NATION").hop("c", "p", "o", "PLACED").hop("o", "l", "part", "CONTAINS")
    m = m.hop("part", "q", "s", "SUPPLIES", "in").hop("s", "w", "n", "IN_NATION")
    rows = m.rows.withColumn("nation", (prop("n", "id") % SPACE).cast("int"))
    return rows.groupBy("nation").agg(F.count_distinct(prop("c", "id"), prop("s", "id")).alias("pairs"), agg.count().alias("trades"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
def optional_match(g):
    """OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE o.o_totalprice > 300000: the condition stays inside."""
    outer = match(g, "c", "Customer", ["c_custkey"])
    inner = match(g, "c", "Customer", []).hop("c", "r", "o", "PLACED", label="Order", properties=["o_totalprice"]).where(prop("o", "o_totalprice") > 300000)
    rows = outer.optional(inner).rows
    return rows.groupBy(prop("c", "c_custkey").alias("c_custkey")).agg(agg.count(prop("o", "id")).alias("orders"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists_pattern(g):
    inner = match(g, "c", "Customer", []).hop("c", "r", "o", "PLACED", label="Order", properties=["o_orderstatus"]).where(prop("o", "o_orderstatus") == "F")
    return match(g, "c", "Customer", ["c_custkey"]).exists(inner).rows.select(prop("c", "c_custkey").alias("c_custkey"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def not_exists_pattern(g):
    inner = match(g, "c", "Customer", []).hop("c", "r", "o", "PLACED", label="Order", properties=["o_totalprice"]).where(prop("o", "o_totalprice") > 250000)
    return match(g, "c", "Customer", ["c_custkey"]).not_exists(inner).rows.select(prop("c", "c_custkey").alias("c_custkey"))


@query("SELECT r_name, s_suppkey FROM region, supplier WHERE r_regionkey > 2 AND s_acctbal > 5000")
def cartesian_parts(g):
    """MATCH (r:Region), (s:Supplier)"""
    m = match(g, "r", "Region").where(prop("r", "r_regionkey") > 2).part(match(g, "s", "Supplier").where(prop("s", "s_acctbal") > 5000))
    return m.rows.select(prop("r", "r_name").alias("r_name"), prop("s", "s_suppkey").alias("s_suppkey"))


@query("SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def shared_variable_parts(g):
    """MATCH (n:Nation)<--(c:Customer), (n)<--(s:Supplier)"""
    one = match(g, "n", "Nation", ["n_name"]).hop("n", "x", "c", "IN_NATION", "in", "Customer", [])
    two = match(g, "n", "Nation", []).hop("n", "y", "s", "IN_NATION", "in", "Supplier", [])
    return one.part(two).rows.groupBy(prop("n", "n_name").alias("n_name")).agg(agg.count().alias("n"))


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal + 4000 < s_acctbal")
def theta_predicate(g):
    m = match(g, "c", "Customer", ["c_custkey", "c_acctbal"]).hop("c", "x", "n", "IN_NATION")
    sellers = match(g, "s", "Supplier", ["s_suppkey", "s_acctbal"]).hop("s", "y", "n", "IN_NATION")
    m = m.part_less(sellers, prop("c", "c_acctbal") + 4000, prop("s", "s_acctbal"))
    return m.rows.select(prop("c", "c_custkey").alias("c_custkey"), prop("s", "s_suppkey").alias("s_suppkey"))


# Variable length and paths


@query("SELECT c_custkey, count(*) AS reached FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT 1 UNION ALL SELECT 2) ON true GROUP BY c_custkey")
def var_length_bounded(g):
    """MATCH (c:Customer)-[:IN_NATION|IN_REGION*1..2]->(x)"""
    rows = match(g, "c", "Customer", ["c_custkey"]).trails("c", "r", "x", ["IN_NATION", "IN_REGION"], 1, 2).rows
    return rows.groupBy(prop("c", "c_custkey").alias("c_custkey")).agg(agg.count().alias("reached"))


@query("SELECT n_nationkey, count(*) AS reached, max(len) AS longest FROM (SELECT n_nationkey, 0 AS len FROM nation UNION ALL SELECT n_nationkey, 1 FROM nation UNION ALL SELECT a.n_nationkey, 2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey) GROUP BY n_nationkey")
def var_length_unbounded(g):
    """MATCH (n:Nation)-[:IN_REGION*0..]-(x): trails, so a region's relationships are used once each."""
    rows = match(g, "n", "Nation", ["n_nationkey"]).trails("n", "r", "x", "IN_REGION", 0, None, "both").rows
    return rows.groupBy(prop("n", "n_nationkey").alias("n_nationkey")).agg(agg.count().alias("reached"), F.max(F.size("r__rids")).alias("longest"))


@query("SELECT c_custkey, 3 AS nodes, 2 AS rels, n_regionkey AS last FROM customer JOIN nation ON c_nationkey = n_nationkey")
def named_path(g):
    m = match(g, "c", "Customer", ["c_custkey"]).hop("c", "x", "n", "IN_NATION").hop("n", "y", "r", "IN_REGION").path("p", ["c", "n", "r"], ["x", "y"])
    return m.rows.select(
        prop("c", "c_custkey").alias("c_custkey"), F.size("p.nodes").alias("nodes"), F.size("p.rels").alias("rels"),
        (fn.last(F.col("p.nodes")) % SPACE).cast("int").alias("last"),
    )


def _nation_pairs(g):
    """Every supplier with every nation of its region."""
    m = match(g, "s", "Supplier", []).hop("s", "x", "n", "IN_NATION").hop("n", "y", "r", "IN_REGION")
    others = match(g, "r", "Region", []).hop("r", "z", "t", "IN_REGION", "in")
    return m.rows.join(others.rows.select("r__id", "t__id"), "r__id").select(F.col("s__id").alias("source"), F.col("t__id").alias("target"))


@query("SELECT s_suppkey AS source, b.n_nationkey AS target, CASE WHEN a.n_nationkey = b.n_nationkey THEN 1 ELSE 3 END AS length FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey")
def shortest_path(g):
    """shortestPath((s:Supplier)-[:IN_NATION|IN_REGION*..4]-(n:Nation))"""
    found = shortest_paths(g, _nation_pairs(g), ["IN_NATION", "IN_REGION"], "both", high=4)
    return found.select((F.col("source") % SPACE).alias("source"), (F.col("target") % SPACE).cast("int").alias("target"), "length")


@query("SELECT c.c_custkey AS source, p.p_partkey AS target, 2 AS length, count(*) AS paths FROM customer c JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part p ON p_partkey = l_partkey GROUP BY ALL")
def all_shortest_paths(g):
    """allShortestPaths((c:Customer)-[:PLACED|CONTAINS*..2]->(p:Part)); parallel lines make paths of their own."""
    bought = match(g, "c", "Customer", []).hop("c", "x", "o", "PLACED").hop("o", "y", "p", "CONTAINS").rows
    pairs = bought.select(F.col("c__id").alias("source"), F.col("p__id").alias("target"))
    found = shortest_paths(g, pairs, ["PLACED", "CONTAINS"], "out", high=2, every=True)
    counts = found.groupBy("source", "target", "length").agg(agg.count().alias("paths"))
    return counts.select((F.col("source") % SPACE).alias("source"), (F.col("target") % SPACE).alias("target"), "length", "paths")


# Projection, order, sets


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def projection_distinct(g):
    return g.label_scan("Customer").select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT c_custkey, big, row_number() OVER (ORDER BY big ASC NULLS LAST, c_custkey) AS place FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS big FROM customer) ORDER BY big ASC NULLS LAST, c_custkey LIMIT 40 OFFSET 5")
def order_skip_limit(g):
    """ORDER BY with null as the largest value, SKIP 5, LIMIT 40."""
    rows = g.label_scan("Customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("big"))
    top = rows.orderBy(fn.asc(F.col("big")), "c_custkey").limit(45)
    order = Window.orderBy(fn.asc(F.col("big")), "c_custkey")
    return top.withColumn("place", F.row_number().over(order).cast("long")).filter("place > 5")


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 HAVING avg(c_acctbal) > 0 AND count(*) > 2")
def with_where(g):
    """WITH c.c_mktsegment AS segment, avg(..) AS a, count(*) AS n WHERE a > 0 AND n > 2"""
    rows = g.label_scan("Customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(agg.avg(F.col("c_acctbal")).alias("a"), agg.count().alias("n"))
    return rows.filter("a > 0 AND n > 2").select("segment", "n")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def union_all(g):
    r = g.label_scan("Region").select(F.col("r_name").alias("name"))
    return g.label_scan("Nation").select(F.col("n_name").alias("name")).unionByName(r).unionByName(r)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(g):
    a, b = g.label_scan("Customer").select(F.col("c_nationkey").alias("k")), g.label_scan("Supplier").select(F.col("s_nationkey").alias("k"))
    return a.unionByName(b).distinct()


# Aggregation


@query("SELECT o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 2) AS mean, min(o_orderdate) AS first, max(o_totalprice) AS top FROM orders GROUP BY 1")
def grouped_aggregates(g):
    rows = g.label_scan("Order").groupBy(F.col("o_orderpriority").alias("priority"))
    return rows.agg(
        agg.count().alias("n"), agg.count(F.col("o_custkey"), distinct=True).alias("customers"),
        F.round(agg.avg(F.col("o_totalprice")), 2).alias("mean"), F.min("o_orderdate").alias("first"), F.max("o_totalprice").alias("top"),
    )


@query("SELECT CAST(0 AS BIGINT) AS total, CAST(NULL AS DOUBLE) AS mean, CAST(0 AS BIGINT) AS n FROM (SELECT 1)")
def aggregates_of_nothing(g):
    """sum of no rows is 0, avg null, count 0; without keys there is one row."""
    rows = g.label_scan("Part").filter("p_size < 0")
    return rows.agg(agg.sum_(F.col("p_size").cast("long")).alias("total"), agg.avg(F.col("p_size")).alias("mean"), agg.count().alias("n"))


@query("SELECT p_brand, array_to_string(list(p_size ORDER BY p_size), ',') AS sizes, array_to_string(list(DISTINCT p_size ORDER BY p_size), ',') AS kinds FROM part GROUP BY p_brand")
def collect_lists(g):
    rows = g.label_scan("Part").groupBy("p_brand")
    return rows.agg(
        F.array_join(agg.collect(F.col("p_size")).cast("array<string>"), ",").alias("sizes"),
        F.array_join(agg.collect(F.col("p_size"), distinct=True).cast("array<string>"), ",").alias("kinds"),
    )


@query("SELECT p_brand, quantile_cont(p_size, 0.4) AS cont, CAST(quantile_disc(p_size, 0.4) AS BIGINT) AS disc, round(stddev_samp(p_size), 6) AS sd, round(stddev_pop(p_size), 6) AS sdp FROM part GROUP BY p_brand HAVING count(*) > 1")
def percentiles_and_deviations(g):
    rows = g.label_scan("Part").groupBy("p_brand").agg(
        agg.percentile_cont(F.col("p_size"), 0.4).alias("cont"), agg.percentile_disc("p_size", 0.4, "BIGINT").alias("disc"),
        F.round(agg.stdev(F.col("p_size")), 6).alias("sd"), F.round(agg.stdevp(F.col("p_size")), 6).alias("sdp"), agg.count().alias("n"),
    )
    return rows.filter("n > 1").drop("n")


@query("SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'rich' END AS band, count(*) AS n, count(*) + 100 AS more FROM customer GROUP BY 1")
def case_bands(g):
    """CASE as a grouping key, and an aggregate inside an expression."""
    b = F.col("c_acctbal")
    rows = g.label_scan("Customer").groupBy(F.when(b < 0, "debt").when(b < 5000, "middle").otherwise("rich").alias("band"))
    return rows.agg(agg.count().alias("n")).withColumn("more", F.col("n") + 100)


@query("SELECT n_name, list_aggregate(list_sort(list(s_name)), 'string_agg', ',') AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT n_name, '' FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def pattern_comprehension(g):
    """RETURN n.n_name, [(n)<-[:IN_NATION]-(s:Supplier) | s.s_name]"""
    inner = match(g, "n", "Nation", []).hop("n", "r", "s", "IN_NATION", "in", "Supplier", ["s_name"])
    rows = match(g, "n", "Nation", ["n_name"]).collect_matches(inner, prop("s", "s_name"), "names").rows
    return rows.select(prop("n", "n_name").alias("n_name"), F.array_join("names", ",").alias("suppliers"))


# Expressions and functions


@query("SELECT p_partkey, p_size // 4 AS quotient, p_size % 4 AS rest, CAST(pow(p_size, 2) AS DOUBLE) AS square, CAST(CASE WHEN p_size % 5 = 0 THEN NULL ELSE 1.0 / (p_size % 5) END AS DOUBLE) AS share, CASE WHEN (p_size > 10) <> (p_size < 20) THEN 1 ELSE 0 END AS either FROM part")
def arithmetic(g):
    s = F.col("p_size")
    share = fn.float_divide(F.lit(1.0), (s % 5).cast("double"))
    return g.label_scan("Part").select(
        "p_partkey", fn.int_divide(s, F.lit(4)).cast("int").alias("quotient"), (s % 4).alias("rest"), fn.power(s, F.lit(2)).alias("square"),
        F.when(share != float("inf"), share).alias("share"), F.when(fn.xor(s > 10, s < 20), 1).otherwise(0).alias("either"),
    )


@query("SELECT p_partkey, upper(p_name) AS up, p_name[2:4] AS sub, string_split(p_name, ' ')[1] AS first, replace(p_name, 'a', '$1') AS rep, reverse(p_name) AS rev, left(p_name, 3) AS l, right(p_name, 3) AS r, CAST(length(p_name) AS BIGINT) AS n, starts_with(p_name, 'p') AS sw, contains(p_name, '1') AS has, regexp_full_match(p_name, '[a-z ]+.*') AS m FROM part")
def string_functions(g):
    p = F.col("p_name")
    return g.label_scan("Part").select(
        "p_partkey", F.upper(p).alias("up"), fn.substring(p, 1, 3).alias("sub"), fn.head(fn.split(p, " ")).alias("first"),
        fn.replace(p, "a", "$1").alias("rep"), F.reverse(p).alias("rev"), fn.left(p, 3).alias("l"), fn.right(p, 3).alias("r"),
        F.char_length(p).cast("long").alias("n"), p.startswith("p").alias("sw"), p.contains("1").alias("has"), fn.matches(p, "[a-z ]+.*").alias("m"),
    )


@query("SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS DOUBLE) AS c, CAST(floor(c_acctbal) AS DOUBLE) AS f, CAST(sign(c_acctbal) AS BIGINT) AS s, round(sqrt(abs(c_acctbal)), 6) AS q, TRY_CAST(c_mktsegment AS BIGINT) AS none, CAST(c_custkey AS VARCHAR) AS t FROM customer")
def math_functions(g):
    b = F.col("c_acctbal")
    return g.label_scan("Customer").select(
        "c_custkey", F.abs(b).alias("a"), fn.ceil(b).alias("c"), fn.floor(b).alias("f"), fn.sign(b).alias("s"),
        F.round(F.sqrt(F.abs(b)), 6).alias("q"), fn.to_integer(F.col("c_mktsegment")).alias("none"), F.col("c_custkey").cast("string").alias("t"),
    )


@query("SELECT p_partkey, len(range(1, p_size + 1, 3)) AS n, coalesce(list_sum(list_filter(range(1, p_size + 1, 3), lambda x: x % 2 = 0)), 0)::BIGINT AS even, CAST(range(1, p_size + 1, 3)[-1] AS BIGINT) AS last, CAST(len(range(1, p_size + 1, 3)[2:]) AS INTEGER) AS rest, len(list_filter(range(1, p_size + 1, 3), lambda x: x = 4)) = 1 AS single, len(list_filter(range(1, p_size + 1, 3), lambda x: x > 30)) > 0 AS any_big FROM part")
def list_functions(g):
    """range, list comprehension, indexing, tail and quantifiers."""
    xs = F.col("xs")
    rows = g.label_scan("Part").select("p_partkey", fn.range_(F.lit(1), F.col("p_size"), 3).alias("xs"))
    even = F.aggregate(F.filter(xs, lambda x: x % 2 == 0), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "p_partkey", F.size(xs).cast("long").alias("n"), even.alias("even"), fn.last(xs).alias("last"), F.size(fn.slice_(xs, 1, None)).alias("rest"),
        fn.single_of(xs, lambda x: x == 4).alias("single"), F.exists(xs, lambda x: x > 30).alias("any_big"),
    )


@query("SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, CAST(week(o_orderdate) AS INTEGER) AS w, CAST(isodow(o_orderdate) AS INTEGER) AS wd, dayofyear(o_orderdate) AS od, isoyear(o_orderdate) AS wy, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(date_trunc('decade', o_orderdate) AS TIMESTAMP) AS d, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS k FROM orders")
def temporal_parts(g):
    t = F.col("o_orderdate")
    return g.label_scan("Order").select(
        "o_orderkey", *(temporal.part(t, n).cast("bigint").alias(a) for n, a in (("year", "y"), ("quarter", "q"))),
        temporal.part(t, "week").cast("int").alias("w"), temporal.part(t, "weekDay").cast("int").alias("wd"),
        temporal.part(t, "ordinalDay").cast("bigint").alias("od"), temporal.part(t, "weekYear").cast("bigint").alias("wy"),
        temporal.truncate("month", t).alias("m"), temporal.truncate("decade", t).alias("d"), temporal.truncate("week", t).alias("k"),
    )


@query("SELECT o_orderkey, CAST(datediff('day', TIMESTAMP '1992-01-01', o_orderdate) AS BIGINT) AS days, CAST(epoch(o_orderdate) - epoch(TIMESTAMP '1992-01-01') AS BIGINT) AS seconds, CAST(o_orderdate + INTERVAL 1 MONTH + INTERVAL 3 DAY AS TIMESTAMP) AS later FROM orders")
def temporal_arithmetic(g):
    t, start = F.col("o_orderdate"), F.lit("1992-01-01").cast("timestamp_ntz")
    return g.label_scan("Order").select(
        "o_orderkey", temporal.in_days(start, t).alias("days"), temporal.in_seconds(start, t).alias("seconds"),
        temporal.add(t, temporal.duration(months=1, days=3)).alias("later"),
    )


@query("SELECT s_suppkey, round(2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(s_nationkey * 2 - 40) / 2 - radians(10) / 2), 2) + cos(radians(s_nationkey * 2 - 40)) * cos(radians(10)) * pow(sin(radians(s_suppkey % 180 - 20) / 2), 2)))), 3) AS metres, round(sqrt(pow(s_nationkey - 3, 2) + pow(s_suppkey - 4, 2)), 6) AS flat FROM supplier")
def spatial_distance(g):
    here = spatial.point(F.col("s_suppkey") % 180, F.col("s_nationkey") * 2 - 40, srid=spatial.WGS84)
    there = spatial.point(F.lit(20), F.lit(10), srid=spatial.WGS84)
    flat = spatial.distance(spatial.point(F.col("s_nationkey"), F.col("s_suppkey")), spatial.point(F.lit(3), F.lit(4)))
    return g.label_scan("Supplier").select("s_suppkey", F.round(spatial.distance(here, there), 3).alias("metres"), F.round(flat, 6).alias("flat"))


@query("SELECT doc_id, CAST(n AS BIGINT) AS score FROM (SELECT doc_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')), ['der', 'und', 'that', 'les'])) AS n FROM documents) WHERE n > 0".replace("'that', ", ""))
def fulltext_lookup(g):
    """CALL db.index.fulltext.queryNodes('docs', 'der und that les'); 'that' is a stop word."""
    found = fulltext.query_nodes(g.label_scan("Doc"), "text", "Der und, that les")
    return found.select((F.col("node") % SPACE).alias("doc_id"), "score")


@query("SELECT 'Customer' AS label WHERE EXISTS (SELECT 1 FROM customer) UNION ALL SELECT 'Doc' AS label WHERE EXISTS (SELECT 1 FROM documents) UNION ALL SELECT 'Event' AS label WHERE EXISTS (SELECT 1 FROM events) UNION ALL SELECT 'Nation' AS label WHERE EXISTS (SELECT 1 FROM nation) UNION ALL SELECT 'Order' AS label WHERE EXISTS (SELECT 1 FROM orders) UNION ALL SELECT 'Part' AS label WHERE EXISTS (SELECT 1 FROM part) UNION ALL SELECT 'Region' AS label WHERE EXISTS (SELECT 1 FROM region) UNION ALL SELECT 'Supplier' AS label WHERE EXISTS (SELECT 1 FROM supplier) UNION ALL SELECT 'User' AS label WHERE EXISTS (SELECT 1 FROM events)")
def db_labels(g):
    return g.labels()


@query("SELECT 'CONTAINS' AS \"relationshipType\" WHERE EXISTS (SELECT 1 FROM lineitem) UNION ALL SELECT 'DID' AS \"relationshipType\" WHERE EXISTS (SELECT 1 FROM events) UNION ALL SELECT 'IN_NATION' AS \"relationshipType\" WHERE EXISTS (SELECT 1 FROM customer) UNION ALL SELECT 'IN_REGION' AS \"relationshipType\" WHERE EXISTS (SELECT 1 FROM nation) UNION ALL SELECT 'PLACED' AS \"relationshipType\" WHERE EXISTS (SELECT 1 FROM orders) UNION ALL SELECT 'SUPPLIES' AS \"relationshipType\" WHERE EXISTS (SELECT 1 FROM lineitem)")
def db_relationship_types(g):
    return g.relationship_types()


# Algorithms


def _project(g, kind, **options):
    catalog = algorithms.Catalog()
    catalog.project("g", g, None, kind, **options)
    return catalog.get("g")


def _only(frame, *labels):
    low = F.lit(False)
    for label in labels:
        first = node_id(label, F.lit(0))
        low = low | ((F.col("nodeId") >= first) & (F.col("nodeId") < first + SPACE))
    return frame.filter(low)


@query("SELECT c_custkey + 2 * SPACE AS \"nodeId\", CAST(count(o_orderkey) AS DOUBLE) AS score FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def degree_centrality(g):
    return _only(algorithms.degree(_project(g, "PLACED", orientation="NATURAL")), "Customer")


_WCC_SQL = """
WITH RECURSIVE e AS (
  SELECT c_custkey + 2 * SPACE AS a, c_nationkey + 1 * SPACE AS b FROM customer UNION ALL
  SELECT s_suppkey + 3 * SPACE, s_nationkey + 1 * SPACE FROM supplier
)
SELECT x AS "nodeId", min(least(x, b)) AS "componentId" FROM (SELECT a AS x, b FROM e UNION ALL SELECT b, b FROM e) GROUP BY x
"""


@query(_WCC_SQL)
def weak_components(g):
    """The components of customers and suppliers with their nations."""
    rows = algorithms.wcc(_project(g, "IN_NATION"))
    linked = match_rels(g, "a", "r", "b", "IN_NATION").rows
    ids = linked.select(F.explode(F.array("a__id", "b__id")).alias("nodeId")).distinct()
    return rows.join(ids, "nodeId", "left_semi")


_RANK_ROUNDS = 12


def _rank_sql() -> str:
    """The rounds of PageRank written out one by one, over the undirected tree of regions to customers."""
    steps = ["n AS (SELECT a AS id FROM t UNION SELECT b FROM t UNION SELECT CAST(r_regionkey AS BIGINT) FROM region)",
             "e AS (SELECT a, b FROM t UNION ALL SELECT b, a FROM t)", "d AS (SELECT a, count(*) AS deg FROM e GROUP BY a)",
             "c AS (SELECT count(*) AS n FROM n)", "p0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / c.n AS s FROM n, c)"]
    for k in range(_RANK_ROUNDS):
        # What nodes without an edge hold is shared by all.
        lost = f"(SELECT coalesce(sum(s), 0) FROM p{k} WHERE id NOT IN (SELECT a FROM d))"
        got = f"SELECT e.b AS id, sum(p{k}.s / d.deg) AS g FROM e JOIN p{k} ON p{k}.id = e.a JOIN d ON d.a = e.a GROUP BY e.b"
        steps.append(f"g{k} AS MATERIALIZED ({got})")
        steps.append(f"p{k + 1} AS MATERIALIZED (SELECT n.id, 0.15 / c.n + 0.85 * (coalesce(g, 0) + {lost} / c.n) AS s FROM n CROSS JOIN c LEFT JOIN g{k} ON g{k}.id = n.id)")
    return f"WITH {_TREE_SQL}, {', '.join(steps)} SELECT id AS \"nodeId\", round(s, 9) AS score FROM p{_RANK_ROUNDS}"


_TREE_SQL = """t AS (
  SELECT n_nationkey + SPACE AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation UNION ALL
  SELECT c_custkey + 2 * SPACE, c_nationkey + SPACE FROM customer UNION ALL SELECT s_suppkey + 3 * SPACE, s_nationkey + SPACE FROM supplier
)"""


@query(_rank_sql())
def page_rank(g):
    """Twelve rounds on regions, nations, suppliers and customers."""
    nodes, edges = _tree(g)
    edges = edges.withColumn("weight", F.lit(1.0))
    found = algorithms.pagerank(algorithms.project_edges(nodes, edges), max_iterations=_RANK_ROUNDS, tolerance=0.0)
    return found.select("nodeId", F.round("score", 9).alias("score"))


def _trade(g):
    """Orders, parts and suppliers: what a line has ordered from whom, so that every line is a triangle."""
    lines = g.rels["CONTAINS"].select(F.col("src").alias("o"), F.col("dst").alias("p"), node_id("Supplier", "l_suppkey").alias("s"))
    edges = None
    for a, b in (("o", "p"), ("o", "s"), ("s", "p")):
        one = lines.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(1.0).alias("weight"))
        edges = one if edges is None else edges.unionByName(one)
    nodes = g.label_scan("Order").select("id").unionByName(g.label_scan("Part").select("id")).unionByName(g.label_scan("Supplier").select("id"))
    # What is asked of it is asked of its simple graph, in which repeated edges count once.
    return algorithms.project_edges(nodes, edges, stored=False)


_TRADE_SQL = """op AS (SELECT DISTINCT l_orderkey + 5 * SPACE AS o, l_partkey + 4 * SPACE AS p FROM lineitem),
os AS (SELECT DISTINCT l_orderkey + 5 * SPACE AS o, l_suppkey + 3 * SPACE AS s FROM lineitem),
sp AS (SELECT DISTINCT l_suppkey + 3 * SPACE AS s, l_partkey + 4 * SPACE AS p FROM lineitem),
n AS (SELECT o_orderkey + 5 * SPACE AS id FROM orders UNION ALL SELECT p_partkey + 4 * SPACE FROM part UNION ALL SELECT s_suppkey + 3 * SPACE FROM supplier),
t AS (SELECT op.o, op.p, os.s FROM op JOIN os ON os.o = op.o JOIN sp ON sp.s = os.s AND sp.p = op.p),
u AS (SELECT o AS v FROM t UNION ALL SELECT p FROM t UNION ALL SELECT s FROM t), k AS (SELECT v, count(*) AS n FROM u GROUP BY v)"""


@query(f"""WITH {_TRADE_SQL} SELECT id AS "nodeId", coalesce(k.n, 0) AS "triangleCount" FROM n LEFT JOIN k ON v = id""")
def triangle_count(g):
    return algorithms.triangles(_trade(g))


@query(f"""WITH {_TRADE_SQL}, e AS (SELECT o AS a, p AS b FROM op UNION ALL SELECT o, s FROM os UNION ALL SELECT s, p FROM sp),
d AS (SELECT v, count(*) AS d FROM (SELECT a AS v FROM e UNION ALL SELECT b FROM e) GROUP BY v)
SELECT id AS "nodeId", CASE WHEN d >= 2 THEN round(coalesce(k.n, 0) / (d * (d - 1) / 2), 9) ELSE 0.0 END AS coefficient
FROM n LEFT JOIN k ON k.v = id LEFT JOIN d ON d.v = id""")
def clustering_coefficient(g):
    return algorithms.clustering(_trade(g)).select("nodeId", F.round("coefficient", 9).alias("coefficient"))


def _tree(g):
    """Regions, nations, suppliers and customers as a weighted tree towards the regions."""
    nodes = g.label_scan("Region").select("id")
    for label in ("Nation", "Supplier", "Customer"):
        nodes = nodes.unionByName(g.label_scan(label).select("id"))
    edges = g.rel_scan(["IN_REGION", "IN_NATION"]).select("src", "dst", (F.col("src") % 10 + 1).cast("double").alias("weight"))
    return nodes, edges



@query(f"""WITH RECURSIVE {_TREE_SQL}, w AS (SELECT a, b, CAST(a % 10 + 1 AS DOUBLE) AS w FROM t UNION ALL SELECT b, a, CAST(a % 10 + 1 AS DOUBLE) FROM t),
r AS (SELECT CAST(0 AS BIGINT) AS id, CAST(-1 AS BIGINT) AS came, 0.0::DOUBLE AS d UNION ALL SELECT w.b, r.id, r.d + w.w FROM r JOIN w ON w.a = r.id AND w.b <> r.came)
SELECT id AS "nodeId", d AS distance FROM r""")
def dijkstra(g):
    """Distances from region 0 over the undirected tree."""
    return algorithms.dijkstra(algorithms.project_edges(*_tree(g)), 0)


@query(f"""WITH RECURSIVE {_TREE_SQL}, r AS (SELECT CAST(5 + 2 * SPACE AS BIGINT) AS id, 0.0::DOUBLE AS d UNION ALL SELECT t.b, r.d + CAST(t.a % 10 + 1 AS DOUBLE) - 4 FROM r JOIN t ON t.a = r.id)
SELECT id AS "nodeId", d AS distance FROM r""")
def bellman_ford(g):
    """Distances from customer 5 along the directed tree, with negative weights."""
    nodes, edges = _tree(g)
    edges = edges.withColumn("weight", F.col("weight") - 4)
    return algorithms.bellman_ford(algorithms.project_edges(nodes, edges, directed=True), 5 + 2 * SPACE)


@query(f"""WITH RECURSIVE {_TREE_SQL} SELECT a AS "nodeId", a AS "componentId" FROM t UNION SELECT b, b FROM t UNION SELECT r_regionkey, r_regionkey FROM region""")
def strong_components(g):
    """The directed tree has no cycle: every node is its own component."""
    return algorithms.scc(algorithms.project_edges(*_tree(g), directed=True))


def _places(g):
    nodes = g.label_scan("Region").select("id").unionByName(g.label_scan("Nation").select("id"))
    return algorithms.project_edges(nodes, g.rels["IN_REGION"].select("src", "dst", F.lit(1.0).alias("weight")))


_SIZES = "s AS (SELECT r_regionkey AS r, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS k FROM region), c AS (SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n)"


@query(f"""WITH {_SIZES} SELECT CAST(r AS BIGINT) AS "nodeId", round(CASE WHEN k > 0 THEN k / (n - 1) * k / k ELSE 0 END, 9) AS score FROM s, c
UNION ALL SELECT n_nationkey + SPACE, round(k / (n - 1) * k / (2 * k - 1), 9) FROM nation JOIN s ON r = n_regionkey, c""")
def closeness_centrality(g):
    """Regions are the centres of stars."""
    return algorithms.closeness(_places(g)).select("nodeId", F.round("score", 9).alias("score"))


@query(f"""WITH {_SIZES} SELECT CAST(r AS BIGINT) AS "nodeId", CAST(k * (k - 1) / 2 AS DOUBLE) AS score FROM s UNION ALL SELECT n_nationkey + SPACE, 0.0 FROM nation""")
def betweenness_centrality(g):
    return algorithms.betweenness(_places(g))


@query()
def label_propagation(g):
    """Synchronous variant; see its docstring."""
    return algorithms.label_propagation(_trade(g))


# Writes


@query("SELECT count(*) AS nodes, count(DISTINCT id) AS ids FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT 1000000 + n_nationkey FROM nation)")
def create_nodes(g):
    """CREATE a customer for each nation, then count."""
    new = g.label_scan("Nation").select((F.col("n_nationkey") + 1_000_000 + 2 * SPACE).alias("id"), (F.col("n_nationkey") + 1_000_000).cast("long").alias("c_custkey"))
    g, _ = writes.create_nodes(g, "Customer", new)
    return g.label_scan("Customer").agg(agg.count().alias("nodes"), agg.count(F.col("id"), distinct=True).alias("ids"))


@query("SELECT CAST(k AS INTEGER) AS p_size, count(*) AS n FROM (SELECT p_size AS k FROM part UNION ALL SELECT DISTINCT o_custkey % 80 AS k FROM orders WHERE o_custkey % 80 NOT IN (SELECT p_size FROM part)) GROUP BY k")
def merge_nodes(g):
    """MERGE (p:Part {p_size: o.o_custkey % 80}) for every order: a missing size is created once."""
    rows = g.label_scan("Order").select((F.col("o_custkey") % 80).cast("int").alias("p_size"))
    g, _, _ = writes.merge_nodes(g, "Part", rows, ["p_size"], new_id=F.col("p_size") + 9 * SPACE)
    return g.label_scan("Part").groupBy("p_size").agg(agg.count().alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier")
def set_property(g):
    """SET s.s_acctbal = null where it is negative: the property is removed."""
    ids = g.label_scan("Supplier").filter("s_acctbal < 0").select("id")
    g, _ = writes.remove_properties(g, "Supplier", ids, ["s_acctbal"])
    return g.label_scan("Supplier").select("s_suppkey", "s_acctbal")


@query("SELECT (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS customers, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)) AS placed")
def detach_delete(g):
    """MATCH (c:Customer) WHERE c.c_acctbal < 0 DETACH DELETE c"""
    g, _ = writes.delete_nodes(g, g.label_scan("Customer").filter("c_acctbal < 0").select("id"), detach=True)
    return g.label_scan("Customer").agg(agg.count().alias("customers")).crossJoin(g.rels["PLACED"].agg(agg.count().alias("placed")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def node_key_violations(g):
    return writes.violations_unique(g.rels["CONTAINS"], ["l_orderkey", "l_linenumber"])


# Workload shapes of the reference's benchmark


@query("SELECT a.c_custkey AS a, b.c_custkey AS b, count(DISTINCT la.l_partkey) AS parts FROM customer a JOIN orders oa ON oa.o_custkey = a.c_custkey JOIN lineitem la ON la.l_orderkey = oa.o_orderkey JOIN lineitem lb ON lb.l_partkey = la.l_partkey JOIN orders ob ON ob.o_orderkey = lb.l_orderkey JOIN customer b ON b.c_custkey = ob.o_custkey WHERE a.c_custkey < b.c_custkey AND a.c_nationkey = 3 AND b.c_nationkey = 3 GROUP BY 1, 2")
def common_purchases(g):
    """Pairs of customers of one nation with the number of parts that both ordered."""
    def side(c, x, o, y):
        return match(g, c, "Customer", ["c_custkey", "c_nationkey"]).where(prop(c, "c_nationkey") == 3).hop(c, x, o, "PLACED").hop(o, y, "p", "CONTAINS")

    rows = side("a", "x", "o", "y").part(side("b", "v", "q", "w")).where(prop("a", "c_custkey") < prop("b", "c_custkey")).rows
    keys = prop("a", "c_custkey").alias("a"), prop("b", "c_custkey").alias("b")
    return rows.groupBy(*keys).agg(agg.count(prop("p", "id"), distinct=True).alias("parts"))


@query("SELECT r_name, o_orderpriority AS priority, count(*) AS orders, round(sum(o_totalprice) / 1000) AS volume FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def region_rollup(g):
    m = match(g, "o", "Order", ["o_orderpriority", "o_totalprice"]).hop("o", "x", "c", "PLACED", "in").hop("c", "y", "n", "IN_NATION").hop("n", "z", "r", "IN_REGION", label="Region", properties=["r_name"])
    rows = m.rows.groupBy(prop("r", "r_name").alias("r_name"), prop("o", "o_orderpriority").alias("priority"))
    return rows.agg(agg.count().alias("orders"), F.round(F.sum(prop("o", "o_totalprice")) / 1000).alias("volume"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND hour(ts) BETWEEN 6 AND 11 GROUP BY 1")
def window_events(g):
    """A time window over a user's events, grouped by kind."""
    m = match(g, "u", "User", []).hop("u", "r", "e", "DID", label="Event", properties=["ts", "event_type"])
    m = m.where((prop("e", "ts") >= F.lit("2024-01-01").cast("timestamp_ntz")) & temporal.part(prop("e", "ts"), "hour").between(6, 11))
    return m.rows.groupBy(prop("e", "event_type").alias("event_type")).agg(agg.count().alias("n"), agg.count(prop("u", "id"), distinct=True).alias("users"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def isolated_nodes(g):
    """MATCH (p:Part) WHERE NOT (p)<-[:CONTAINS]-()"""
    inner = match(g, "p", "Part", []).hop("p", "r", "o", "CONTAINS", "in")
    return match(g, "p", "Part", ["p_partkey"]).not_exists(inner).rows.select(prop("p", "p_partkey").alias("p_partkey"))
