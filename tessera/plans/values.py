"""Registered queries of values, constructors, writes, files and bound paths, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import aggregates as agg
from tessera.functions import scalar as fn
from tessera.functions import spatial, temporal
from tessera.graph import SPACE, node_id, prop
from tessera.operators import writes
from tessera.operators.pattern import match, match_rels
from tessera.plans.catalogue import query
from tessera.sources import csv, sinks
from tessera.storage import shared_dir


def _flag(c):
    return F.when(c, 1).when(~c, 0).cast("int")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS eq, CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS ge, CASE WHEN c_acctbal <= 100 THEN 1 ELSE 0 END AS le, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS gt, 0 AS nan FROM customer")
def comparisons(g):
    b = F.col("c_acctbal").cast("double")
    return g.label_scan("Customer").select(
        "c_custkey", _flag(fn.same(F.col("c_mktsegment"), F.lit("BUILDING"))).alias("eq"), _flag(fn.greater_equal(b, F.lit(0.0))).alias("ge"),
        _flag(fn.less_equal(b, F.lit(100.0))).alias("le"), _flag(fn.greater(b, F.lit(5000.0))).alias("gt"), _flag(fn.equal(b * float("nan"), b)).alias("nan"),
    )


@query("SELECT p_partkey, CASE WHEN p_size IN (1, 7) THEN 1 ELSE NULL END AS maybe, CASE WHEN p_size IN (1, 7) THEN 1 ELSE 0 END AS found, 0 AS nothing FROM part")
def membership(g):
    """IN with a null in the list is null unless the value is found; in an empty list it is false."""
    s = F.col("p_size")
    empty = F.array().cast("array<int>")
    return g.label_scan("Part").select(
        "p_partkey", _flag(fn.is_in(s, F.array(F.lit(1), F.lit(7), F.lit(None).cast("int")))).alias("maybe"),
        _flag(fn.is_in(s, F.array(F.lit(1), F.lit(7)))).alias("found"), _flag(fn.is_in(s, empty)).alias("nothing"),
    )


@query("SELECT p_partkey, CAST(list_extract(range(0, 50), p_size % 5 + 1) AS BIGINT) AS item, CAST(list_extract(range(0, 50), -1 - p_size % 5) AS BIGINT) AS back, CAST(len(range(p_size % 5, 10)) AS BIGINT) AS part, CAST(p_size + 100 AS BIGINT) AS appended, CAST(p_size AS BIGINT) AS prepended, CAST(p_size AS BIGINT) AS by_key, 'a,b' AS keys, p_name || p_size AS text FROM part")
def list_access(g):
    """Index and slice by expression, + with lists and strings, a map's index and keys."""
    s, xs = F.col("p_size").cast("int"), F.sequence(F.lit(0), F.lit(49))
    both = F.create_map(F.lit("b"), s, F.lit("a"), s + 1)
    return g.label_scan("Part").select(
        "p_partkey", fn.index(xs, s % 5).cast("long").alias("item"), fn.index(xs, -1 - s % 5).cast("long").alias("back"),
        F.size(fn.slice_(xs, s % 5, 10)).cast("long").alias("part"), fn.last(fn.list_plus(xs, s + 100, b_is_list=False)).cast("long").alias("appended"),
        fn.head(fn.list_plus(s, xs, a_is_list=False)).cast("long").alias("prepended"), fn.map_index(both, "b").cast("long").alias("by_key"),
        F.array_join(fn.keys(both), ",").alias("keys"), fn.text_plus(F.col("p_name"), s).alias("text"),
    )


@query("SELECT p_partkey, CASE WHEN p_size >= 1 THEN 1 ELSE 0 END AS every, CASE WHEN p_size >= 9 THEN 1 ELSE 0 END AS some, CASE WHEN p_size < 9 THEN 1 ELSE 0 END AS no, CAST(-p_size AS BIGINT) AS minus, CASE WHEN p_name IS NOT NULL THEN 1 ELSE 0 END AS there, CAST(p_size - 1 AS BIGINT) AS tail, 1 AS chance FROM part")
def quantifiers(g):
    xs, s = F.sequence(F.lit(1), F.col("p_size").cast("int")), F.col("p_size")
    r = F.rand(3)
    return g.label_scan("Part").select(
        "p_partkey", _flag(F.forall(xs, lambda x: x >= 1)).alias("every"), _flag(F.exists(xs, lambda x: x == 9)).alias("some"),
        _flag(fn.none_of(xs, lambda x: x == 9)).alias("no"), (-s).cast("long").alias("minus"), _flag(fn.exists(F.col("p_name"))).alias("there"),
        F.size(fn.tail(xs)).cast("long").alias("tail"), _flag((r >= 0) & (r < 1)).alias("chance"),
    )


@query("SELECT c_custkey, c_name AS both, c_name || '  ' AS l, '  ' || c_name AS r, lower(c_name) AS low, CAST(c_acctbal AS DOUBLE) AS f, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS t, CAST(NULL AS INTEGER) AS none FROM customer")
def conversions(g):
    padded = F.concat(F.lit("  "), F.col("c_name"), F.lit("  "))
    return g.label_scan("Customer").select(
        "c_custkey", fn.trim(padded).alias("both"), fn.ltrim(padded).alias("l"), fn.rtrim(padded).alias("r"), F.lower("c_name").alias("low"),
        fn.to_float(F.col("c_acctbal").cast("string")).alias("f"), _flag(fn.to_boolean(F.when(F.col("c_acctbal") > 0, " TRUE").otherwise("false"))).alias("t"),
        _flag(fn.to_boolean(F.col("c_name"))).alias("none"),
    )


@query("SELECT (SELECT count(*) FROM customer) AS customers, CAST(0 AS BIGINT) AS both, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS nodes")
def label_predicate(g):
    """n:Customer, n:Customer:Nation"""
    tables = {k: g.nodes[k] for k in ("Region", "Nation", "Customer")}
    some = type(g)(g.spark, tables, {}).all_nodes(())
    one, two = fn.has_labels(F.col("labels"), "Customer"), fn.has_labels(F.col("labels"), "Customer", "Nation")
    return some.agg(F.count_if(one).alias("customers"), F.count_if(two).alias("both"), F.count(F.lit(1)).alias("nodes"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'c_name' ELSE 'c_acctbal,c_name' END AS keys, c_name AS name FROM customer")
def property_maps(g):
    rows = g.label_scan("Customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    rows = rows.withColumn("m", fn.properties(["c_name", "c_acctbal"]))
    return rows.select("c_custkey", F.array_join(fn.keys(F.col("m")), ",").alias("keys"), fn.map_index(F.col("m"), "c_name").alias("name"))


@query("SELECT n_nationkey AS start, n_regionkey AS stop FROM nation")
def ends_of_relationships(g):
    """MATCH (r)<-[x:IN_REGION]-(n) RETURN startNode(x), endNode(x)"""
    rows = match_rels(g, "a", "x", "b", "IN_REGION", "in").rows
    return rows.select((fn.start_node("x") % SPACE).cast("int").alias("start"), (fn.end_node("x") % SPACE).cast("int").alias("stop"))


# Temporal values

#: Rows whose texts one task reads.
_TASK_TEXTS = 50_000


def _spread(rows):
    """``rows`` in as many parts as their number asks for: few bytes hold many texts, and a file may be a single part."""
    return rows.repartition(rows.count() // _TASK_TEXTS + 1)


_DAY = "CAST(o_orderdate AS DATE)"


@query(f"SELECT o_orderkey, {_DAY} AS plain, {_DAY} AS basic, {_DAY} AS week, {_DAY} AS ordinal, {_DAY} AS quarter, {_DAY} AS by_map, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(NULL AS DATE) AS none FROM orders")
def date_constructors(g):
    """date('...') in its forms, and date({year, week, dayOfWeek})."""
    t = F.col("o_orderdate").cast("date")
    year, week, day = temporal.part(t, "weekYear"), temporal.part(t, "week"), temporal.part(t, "weekDay")
    q = temporal.part(t, "dayOfQuarter")
    return _spread(g.label_scan("Order").select("o_orderkey", "o_orderdate")).select(
        "o_orderkey", temporal.parse_date(F.date_format(t, "yyyy-MM-dd")).alias("plain"), temporal.parse_date(F.date_format(t, "yyyyMMdd")).alias("basic"),
        temporal.parse_date(F.format_string("%04d-W%02d-%d", year, week, day)).alias("week"),
        temporal.parse_date(F.format_string("%04d-%03d", F.year(t), F.dayofyear(t))).alias("ordinal"),
        temporal.parse_date(F.format_string("%04d-Q%d-%d", F.year(t), F.quarter(t), q)).alias("quarter"),
        temporal.date_of(year, week=week, day_of_week=day).alias("by_map"), temporal.parse_date(F.date_format(t, "yyyy-MM")).alias("month"),
        temporal.parse_date(F.lit("not a date")).alias("none"),
    )


@query("SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS m, CAST(second(ts) AS BIGINT) AS s, CAST(microsecond(ts) % 1000000 AS BIGINT) AS us, ts AS back, CAST(epoch_us(ts) // 1000000 AS BIGINT) - 7200 AS epoch, '+02:00' AS off, CAST(120 AS BIGINT) AS minutes, 'Europe/Berlin' AS zone FROM events")
def time_and_zone(g):
    """localtime, localdatetime and datetime from text, and their components."""
    t = F.col("ts").cast("timestamp_ntz")
    text = F.date_format(t, "HH:mm:ss.SSSSSS")
    day = F.date_format(t, "yyyy-MM-dd")
    # Columns of their own, so that each text is read once.
    moment, at = F.col("moment"), F.col("at")
    rows = _spread(g.label_scan("Event").select("event_id", "ts")).select("event_id", day.alias("day"), text.alias("text"))
    rows = rows.withColumn("at", temporal.parse_time(F.col("text")))
    rows = rows.withColumn("moment", temporal.parse_datetime(F.concat("day", F.lit("T"), "text", F.lit("+02:00[Europe/Berlin]"))))
    return rows.select(
        "event_id", *(temporal.time_part(at, n).alias(a) for n, a in (("hour", "h"), ("minute", "m"), ("second", "s"), ("microsecond", "us"))),
        temporal.parse_local_datetime(F.concat("day", F.lit("T"), "text")).alias("back"), temporal.zone_part(moment, "epochSeconds").alias("epoch"),
        temporal.zone_part(moment, "offset").alias("off"), temporal.zone_part(moment, "offsetMinutes").cast("long").alias("minutes"),
        temporal.zone_part(moment, "timezone").alias("zone"),
    )


@query("SELECT p_partkey, CAST(12 * p_size + 2 AS BIGINT) AS months, CAST((12 * p_size + 2) // 3 AS BIGINT) AS quarters, CAST(2 AS BIGINT) AS of_year, CAST(7 * p_size + 1 AS BIGINT) AS days, CAST(p_size AS BIGINT) AS weeks, CAST(1 AS BIGINT) AS of_week, CAST(3600 * 5 + 60 * (p_size % 60) + 7 AS BIGINT) AS seconds, CAST(p_size % 60 AS BIGINT) AS of_hour, CAST(500 AS BIGINT) AS millis, CAST(p_size AS BIGINT) AS from_map FROM part")
def duration_components(g):
    """duration('P..') and duration({...}), and the components of both."""
    s = F.col("p_size")
    d = temporal.parse_duration(F.format_string("P%dY2M%dW1DT5H%dM7.5S", s, s, s % 60))
    names = {"months": "months", "quarters": "quarters", "of_year": "monthsOfYear", "days": "days", "weeks": "weeks", "of_week": "daysOfWeek",
             "seconds": "seconds", "of_hour": "minutesOfHour", "millis": "millisecondsOfSecond"}
    parts = [temporal.duration_part(d, n).alias(a) for a, n in names.items()]
    rows = _spread(g.label_scan("Part").select("p_partkey", "p_size"))
    return rows.select("p_partkey", *parts, temporal.duration_part(temporal.duration_of(minutes=s * 60), "hours").alias("from_map"))


@query("SELECT o_orderkey, CAST(o_orderdate - INTERVAL 1 MONTH - INTERVAL 3 DAY AS TIMESTAMP) AS before, CAST(date_sub('month', TIMESTAMP '1990-01-15', o_orderdate) AS BIGINT) AS months, CAST(date_sub('day', TIMESTAMP '1990-01-15' + to_months(CAST(date_sub('month', TIMESTAMP '1990-01-15', o_orderdate) AS INTEGER)), o_orderdate) AS BIGINT) AS days, CAST(1 AS BIGINT) AS half, CAST(15 AS BIGINT) AS half_days, CAST(-2 AS BIGINT) AS less, 1 AS longer FROM orders")
def duration_arithmetic(g):
    """Minus, division, differences and order of durations."""
    t, start = F.col("o_orderdate"), F.lit("1990-01-15").cast("timestamp_ntz")
    between = temporal.between(start, t.cast("timestamp_ntz"))
    one, three = temporal.duration(months=1), temporal.duration(months=3)
    half = temporal.divide(temporal.duration(months=3), 2.0)
    return g.label_scan("Order").select(
        "o_orderkey", temporal.subtract(t, temporal.duration(months=1, days=3)).alias("before"), between["months"].alias("months"), between["days"].alias("days"),
        half["months"].alias("half"), half["days"].alias("half_days"), temporal.minus(one, three)["months"].alias("less"),
        _flag(temporal.order_key(one) > temporal.order_key(temporal.duration(days=30))).alias("longer"),
    )


@query("SELECT o_orderkey, CAST(date_trunc('year', o_orderdate) AS DATE) AS y, CAST(date_trunc('quarter', o_orderdate) AS DATE) + 4 AS q, to_timestamp(o_orderkey * 1000)::TIMESTAMP AS s, make_timestamp(o_orderkey * 1000000) AS ms FROM orders")
def truncation_and_epochs(g):
    """date.truncate with a day to set, datetime.fromEpoch and fromEpochMillis."""
    t, k = F.col("o_orderdate"), F.col("o_orderkey")
    return g.label_scan("Order").select(
        "o_orderkey", temporal.truncate_date("year", t).alias("y"), temporal.truncate_date("quarter", t, 5).alias("q"),
        temporal.from_epoch_seconds(k * 1000).cast("timestamp_ntz").alias("s"), temporal.from_epoch_millis(k * 1000).cast("timestamp_ntz").alias("ms"),
    )


@query("SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS lon, CAST(s_suppkey % 90 AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS h, 'wgs-84' AS crs, CASE WHEN s_nationkey = 3 AND s_suppkey % 90 = 4 THEN 1 ELSE 0 END AS eq, row_number() OVER (ORDER BY s_nationkey, s_suppkey % 90, s_suppkey) AS place FROM supplier ORDER BY place LIMIT 50")
def points(g):
    """point({longitude, latitude}), its components, equality, and the order of points."""
    p = spatial.point_of({"longitude": F.col("s_nationkey"), "latitude": F.col("s_suppkey") % 90})
    there = spatial.point_of({"longitude": F.lit(3), "latitude": F.lit(4)})
    from pyspark.sql import Window

    rows = g.label_scan("Supplier").withColumn("p", p).orderBy(spatial.order_key(F.col("p")), "s_suppkey").limit(50)
    q = F.col("p")
    return rows.select(
        "s_suppkey", spatial.component(q, "longitude").alias("lon"), spatial.component(q, "latitude").alias("lat"), spatial.component(q, "height").alias("h"),
        spatial.component(q, "crs").alias("crs"), _flag(spatial.equal(q, there)).alias("eq"),
        F.row_number().over(Window.orderBy(spatial.order_key(q), "s_suppkey")).cast("long").alias("place"),
    )


# Writes


@query("SELECT s_suppkey, CAST(NULL AS VARCHAR) AS s_name, s_acctbal FROM supplier")
def remove_property(g):
    g, _ = writes.remove_properties(g, "Supplier", g.label_scan("Supplier").select("id"), ["s_name"])
    return g.label_scan("Supplier").select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT CASE WHEN s_acctbal < 0 THEN NULL ELSE s_suppkey END AS s_suppkey, CASE WHEN s_acctbal < 0 THEN 'none' ELSE s_name END AS s_name, CASE WHEN s_acctbal < 0 THEN 1 ELSE s_nationkey END AS s_nationkey FROM supplier")
def set_property_map(g):
    """SET s = {s_name: 'none'} where the balance is negative, then s += {s_nationkey: 1}."""
    ids = g.label_scan("Supplier").filter("s_acctbal < 0").select("id")
    g, _ = writes.set_map(g, "Supplier", ids, {"s_name": F.lit("none")})
    g, _ = writes.set_map(g, "Supplier", ids, {"s_nationkey": F.lit(1)}, add=True)
    return g.label_scan("Supplier").select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT (SELECT count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem) AS rels, (SELECT count(*) FROM lineitem) AS matched, CAST(0 AS BIGINT) AS again")
def merge_relationships(g):
    """MERGE (s)-[:SELLS]->(p) for every order line: a pair is created once, all lines match it."""
    ends = g.rels["CONTAINS"].select(node_id("Supplier", "l_suppkey").alias("src"), node_id("Part", "l_partkey").alias("dst"))
    g, matched, _ = writes.merge_rels(g, "SELLS", ends, F.xxhash64("src", "dst"))
    g, _, again = writes.merge_rels(g, "SELLS", ends, F.xxhash64("src", "dst"))
    return g.rels["SELLS"].agg(F.count(F.lit(1)).alias("rels")).crossJoin(matched.agg(F.count(F.lit(1)).alias("matched"))).withColumn(
        "again", F.lit(again.rels_created).cast("long")
    )


@query("SELECT l_linenumber, count(*) AS n, count(CASE WHEN l_quantity > 40 THEN 1 END) AS heavy FROM lineitem GROUP BY 1")
def set_relationship_property(g):
    """SET r.heavy = true on the lines with over 40 pieces."""
    heavy = g.rels["CONTAINS"].filter("l_quantity > 40").select("rid", F.lit(True).alias("heavy"))
    g, _ = writes.set_rel_properties(g, "CONTAINS", heavy, ["heavy"])
    return g.rels["CONTAINS"].groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count("heavy").alias("heavy"))


@query("SELECT CAST(2 * (SELECT count(*) FROM nation) AS BIGINT) AS created, (SELECT count(*) FROM customer) AS removed, (SELECT count(*) FROM customer) AS unlinked")
def update_counters(g):
    """FOREACH (x IN [1, 2] | CREATE ...) for each nation, then all customers' IN_NATION deleted, and what was counted."""
    rows = g.label_scan("Nation").select("n_nationkey", F.array(F.lit(1), F.lit(2)).alias("xs"))
    rows = writes.foreach(rows, "xs", "x").select((F.col("n_nationkey") * 2 + F.col("x") + 12 * SPACE).alias("id"))
    g, made = writes.create_nodes(g, "Mark", rows)
    rids = g.rels["IN_NATION"].filter(F.col("src").between(2 * SPACE, 3 * SPACE - 1)).select("rid")
    g, unlinked = writes.delete_rels(g, "IN_NATION", rids)
    g, gone = writes.delete_nodes(type(g)(g.spark, {"Customer": g.nodes["Customer"]}, {}), g.nodes["Customer"].select("id"))
    counted = g.spark.range(1)
    return counted.select(
        F.lit(made.nodes_created).cast("long").alias("created"), F.lit(gone.nodes_deleted).cast("long").alias("removed"), F.lit(unlinked.rels_deleted).cast("long").alias("unlinked")
    )


# Files


def _folder(g, name):
    return f"{shared_dir(g.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name || chr(10) || '\"x\", ' || c_mktsegment AS c_name FROM customer")
def load_csv_rows(g):
    """Customers written as CSV with quotes and line breaks, and read by LOAD CSV."""
    path = _folder(g, "csv")
    name = F.concat("c_name", F.lit('\n"x", '), "c_mktsegment").alias("name")
    g.label_scan("Customer").select("c_custkey", name).write.csv(path, header=True, escape='"', quoteAll=True)
    rows = csv.load_csv(g.spark, path)
    return rows.select(F.col("row")["c_custkey"].cast("long").alias("c_custkey"), F.col("row")["name"].alias("c_name"))


@query("SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM customer) * 2 AS rels, (SELECT count(*) FROM customer) * 2 AS rids, (SELECT round(sum(c_acctbal), 2) FROM customer) AS balance")
def bulk_import(g):
    """Node and relationship files; every customer knows itself twice, so that parallel relationships are equal."""
    nodes, rels = _folder(g, "nodes"), _folder(g, "rels")
    people = g.label_scan("Customer")
    people.select(F.col("c_custkey").alias("key:ID"), F.col("c_acctbal").alias("balance:double")).write.csv(nodes, header=True)
    both = people.select(F.col("c_custkey").alias(":START_ID"), F.col("c_custkey").alias(":END_ID"), F.lit("KNOWS").alias(":TYPE"))
    both.unionByName(both).write.csv(rels, header=True)
    found = csv.bulk_nodes(g.spark, nodes, label="Person")
    links = csv.bulk_rels(g.spark, rels, found)
    counts = links.agg(F.count(F.lit(1)).alias("rels"), F.count_distinct("rid").alias("rids"))
    return found.agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sum("balance"), 2).alias("balance")).crossJoin(counts)


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def cold_segments(g):
    """Events as time-ordered segments, and a time range of them."""
    path = _folder(g, "cold")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    sinks.write_cold(g.label_scan("Event").select(micros.alias("ts"), F.col("event_id").alias("seq"), "event_type"), path, 8)
    day = 86_400_000_000
    return sinks.read_cold(g.spark, path, 19_727 * day, 19_742 * day).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def written_results(g):
    """A result as JSON lines and as Parquet, read back and compared row by row."""
    lines, columns = _folder(g, "json"), _folder(g, "columns")
    rows = g.label_scan("Customer").select("c_custkey", "c_mktsegment")
    sinks.write_json_lines(rows, lines)
    sinks.write_columnar(rows, columns)
    both = g.spark.read.schema(rows.schema).json(lines).join(g.spark.read.parquet(columns), ["c_custkey", "c_mktsegment"])
    return both.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'Nation' AS label, count(*) AS n, count(*) AS links FROM nation UNION ALL SELECT 'Region', count(*), 0 FROM region")
def graph_view(g):
    """The graph view of a result, with labels, types, ends and properties."""
    small = type(g)(g.spark, {k: g.nodes[k] for k in ("Region", "Nation")}, {"IN_REGION": g.rels["IN_REGION"]})
    rows = match_rels(small, "n", "x", "r", "IN_REGION").rows
    nodes, links = sinks.full_graph_view(small, rows, ["n", "r"], ["x"])
    out = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    named = nodes.filter(F.size(fn.keys(F.col("properties"))) > 1).join(out, "id", "left").fillna(0, ["links"])
    return named.groupBy(F.col("labels")[0].alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("links").alias("links"))


# Bound relationships and paths


@query("SELECT count(*) AS hops, count(DISTINCT n_nationkey) AS nations FROM nation JOIN customer ON c_nationkey = n_nationkey")
def bound_relationship(g):
    """MATCH ()-[x:IN_NATION]->() WITH x MATCH (c:Customer)-[x]->(n)"""
    rows = match_rels(g, "p", "x", "q", "IN_NATION")
    m = type(rows)(g, rows.rows.select("x__rid", "x__src", "x__dst")).bound_hop("x", "c", "n")
    m = type(m)(g, m.rows.join(g.label_scan("Customer").select(F.col("id").alias("c__id")), "c__id", "left_semi"))
    return m.rows.agg(agg.count().alias("hops"), agg.count(F.col("n__id"), distinct=True).alias("nations"))


@query("SELECT c_custkey, n_regionkey AS last, 3 AS nodes FROM customer JOIN nation ON n_nationkey = c_nationkey")
def bound_list(g):
    """A list of relationships from a variable-length hop, walked again from its start; the path has a name."""
    m = match(g, "c", "Customer", ["c_custkey"]).trails("c", "r", "x", ["IN_NATION", "IN_REGION"], 2, 2).trail_path("p", "r")
    again = m.along("c", "r", "y", ["IN_NATION", "IN_REGION"]).where("x__id = y__id")
    return again.rows.select(prop("c", "c_custkey").alias("c_custkey"), (F.col("y__id") % SPACE).cast("int").alias("last"), F.size("p.nodes").alias("nodes"))
