"""Queries on the road network: edge risk, contraction, shortest and least-risk routes, nearest nodes, search, corridors. All use the whole grid and every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import constants as K
from gridloom.functions.geo import cell_centre, in_ring
from gridloom.operators import contraction, network, noding, roads, search
from gridloom.plans.layers import rounded
from gridloom.plans.registry import query
from gridloom.plans.scoring import RISK_SQL, risk
from gridloom.session import table, written
from gridloom.sources.surrogates import COLS, NORTH, ROWS, STEP, WEST

LON_SQL, LAT_SQL = f"({WEST}e0 + ({{}}) * {STEP}e0)", f"({NORTH}e0 - ({{}}) * {STEP}e0)"
LATTICE_SQL = (
    RISK_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", nodes AS (SELECT r * {COLS} + c AS id, r, c, r + 0.5e0 AS y, c + 0.5e0 AS x, {LON_SQL.format('c + 0.5e0')} AS lon, {LAT_SQL.format('r + 0.5e0')} AS lat, risk AS node_risk FROM risk),
bare AS (SELECT a.id AS src, b.id AS dst, a.y AS y0, a.x AS x0, b.y AS y1, b.x AS x1, 1000 + (a.id * 37 + b.id * 91) % 211 + 10 * a.node_risk AS length
  FROM nodes a JOIN (SELECT * FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) t(dr, dc)) o ON true JOIN nodes b ON b.r = a.r + dr AND b.c = a.c + dc),
samples AS (SELECT src, dst, CAST(floor(y0 + (i / (n - 1)) * (y1 - y0)) AS BIGINT) AS r, CAST(floor(x0 + (i / (n - 1)) * (x1 - x0)) AS BIGINT) AS c
  FROM (SELECT *, greatest(2, CAST(ceil(length / 50e0) AS INTEGER) + 1) AS n FROM bare) e, range(60) s(i) WHERE i < n),
edges AS (SELECT bare.src, bare.dst, length, er.risk, er.risk_max, length * (1 + 3 * er.risk) AS cost FROM bare JOIN (
  SELECT src, dst, coalesce(avg(k.risk), (SELECT avg(risk) FROM risk)) AS risk, coalesce(max(k.risk), (SELECT avg(risk) FROM risk)) AS risk_max FROM samples s LEFT JOIN risk k ON k.r = s.r AND k.c = s.c GROUP BY src, dst) er ON er.src = bare.src AND er.dst = bare.dst)"""
)


class Lattice:
    """The grid as a road network, made once for a query: ``nodes``, ``edges`` with risk and cost, and the ``grid``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.grid = risk(spark, sf_dir).select("r", "c", "risk")
        self.nodes = self.grid.select(
            (F.col("r") * COLS + F.col("c")).alias("id"), "r", "c", (F.col("r") + 0.5).alias("y"), (F.col("c") + 0.5).alias("x"), cell_centre(F.col("c"), WEST, STEP).alias("lon"), cell_centre(F.col("r"), NORTH, -STEP).alias("lat"), F.col("risk").alias("node_risk")
        )
        step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
        ahead = self.nodes.withColumn("o", step).select(F.col("id").alias("src"), "node_risk", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
        joined = ahead.join(self.nodes.select("r", "c", F.col("id").alias("dst")), ["r", "c"])
        self.bare = joined.select("src", "dst", (1000 + (F.col("src") * 37 + F.col("dst") * 91) % 211 + F.col("node_risk") * 10).alias("length"))
        self.edges = written(network.edge_risk(self.bare, self.nodes.select("id", "x", "y"), self.grid), "edge-risk")
        self.places = self.nodes.select("id", "x", "y")

    def origins(self) -> DataFrame:
        """The origins that are nodes."""
        return self.nodes.where(F.col("id").isin(*ORIGINS)).select(F.col("id").alias("origin"))


@query(f"{LATTICE_SQL} SELECT src, dst, round(length, 4) AS length, round(risk, 6) AS risk, round(risk_max, 6) AS risk_max, round(cost, 4) AS cost FROM edges")
def edge_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Lattice(spark, sf_dir).edges
    return found.select("src", "dst", F.round("length", 4).alias("length"), F.round("risk", 6).alias("risk"), F.round("risk_max", 6).alias("risk_max"), F.round("cost", 4).alias("cost"))


ORIGINS = (0, 305, 561, 1234, 1999)


def _paths_sql(name: str, weight: str) -> str:
    origins = ", ".join(f"({o})" for o in ORIGINS)
    return f"""{name}(o, n, d) USING KEY (o, n) AS (
  SELECT o, o, 0e0 FROM (VALUES {origins}) t(o) WHERE o IN (SELECT id FROM nodes)
  UNION SELECT p.o, e.dst, min(p.d + e.{weight}) FROM {name} p JOIN edges e ON e.src = p.n LEFT JOIN recurring.{name} q ON q.o = p.o AND q.n = e.dst WHERE q.d IS NULL OR p.d + e.{weight} < q.d GROUP BY p.o, e.dst)"""


@query(f"{LATTICE_SQL}, {_paths_sql('by_length', 'length')}, {_paths_sql('by_cost', 'cost')} SELECT CAST(a.o AS BIGINT) AS origin, CAST(a.n AS BIGINT) AS node, round(a.d, 4) AS shortest, round(b.d, 4) AS safest FROM by_length a JOIN by_cost b ON a.o = b.o AND a.n = b.n")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Lattice(spark, sf_dir)
    found = network.distances(net.edges, net.origins(), "length", net.places).withColumnRenamed("distance", "shortest").join(network.distances(net.edges, net.origins(), "cost", net.places).withColumnRenamed("distance", "safest"), ["origin", "node"])
    return rounded(found, 4)


#: Places on the lattice by kind: of several on a node, the last name stays; without a name it is called by its kind.
DEST_SQL = f"""spots AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Hospital' ELSE 'Shelter' END AS kind, (p_partkey * 11 % {ROWS}) * {COLS} + p_partkey * 7 % {COLS} AS node FROM part),
dests AS (SELECT kind, node, coalesce(nullif(arg_max(name, id), ''), kind || ' (unnamed)') AS name FROM spots WHERE node IN (SELECT id FROM nodes) GROUP BY kind, node)"""


def destinations(net: Lattice, parts: DataFrame) -> DataFrame:
    """``kind``, ``node`` and ``name`` of the places that lie on nodes."""
    k = F.col("p_partkey")
    spots = parts.select(k.alias("id"), F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(k % 2 == 0, "Hospital").otherwise("Shelter").alias("kind"), ((k * 11 % ROWS) * COLS + k * 7 % COLS).alias("node"))
    found = spots.join(net.nodes.select(F.col("id").alias("node")), "node", "left_semi").groupBy("kind", "node").agg(F.max_by("name", "id").alias("name"))
    return found.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.concat("kind", F.lit(" (unnamed)"))))


NEAREST_SQL = """near AS (SELECT o AS origin, kind, arg_min(n, (round(d, 6), n)) AS dest, min(d) AS d FROM by_length JOIN dests ON dests.node = n WHERE n <> o GROUP BY o, kind)"""


def pairs(net: Lattice, parts: DataFrame) -> DataFrame:
    """Each origin with its nearest place of each kind by length: ``origin``, ``kind``, ``dest`` and ``name``."""
    dests = destinations(net, parts)
    reached = network.distances(net.edges, net.origins(), "length", net.places).where("origin <> node")
    best = reached.join(dests, "node").groupBy("origin", "kind").agg(F.min(F.struct(F.round("distance", 6).alias("d"), F.col("node").alias("dest"))).alias("m"))
    return best.select("origin", "kind", F.col("m.dest").alias("dest")).join(dests.withColumnRenamed("node", "dest"), ["kind", "dest"])


@query(f"{LATTICE_SQL}, {_paths_sql('by_length', 'length')}, {DEST_SQL}, {NEAREST_SQL} SELECT CAST(origin AS BIGINT) AS origin, near.kind, CAST(dest AS BIGINT) AS dest, name FROM near JOIN dests ON dests.kind = near.kind AND dests.node = near.dest")
def nearest_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(Lattice(spark, sf_dir), table(spark, sf_dir, "part")).select("origin", "kind", "dest", "name")


def _routes_sql(name: str, weight: str) -> str:
    """Least-weight routes with the sums and nodes along them; a struct's first field decides."""
    start = ", ".join(f"({o})" for o in ORIGINS)
    step = "struct_pack(d := p.s.d + e.{w}, len := p.s.len + e.length, expo := p.s.expo + e.length * e.risk, mx := greatest(p.s.mx, e.risk_max), path := p.s.path || ' ' || e.dst)".format(w=weight)
    return f"""{name}(o, n, s) USING KEY (o, n) AS (
  SELECT o, o, struct_pack(d := 0e0, len := 0e0, expo := 0e0, mx := 0e0, path := o::VARCHAR) FROM (VALUES {start}) t(o) WHERE o IN (SELECT id FROM nodes)
  UNION SELECT p.o, e.dst, min({step}) FROM {name} p JOIN edges e ON e.src = p.n LEFT JOIN recurring.{name} q ON q.o = p.o AND q.n = e.dst WHERE q.s IS NULL OR p.s.d + e.{weight} < q.s.d GROUP BY p.o, e.dst)"""


BOTH_SQL = f"""{LATTICE_SQL}, {_paths_sql('by_length', 'length')}, {DEST_SQL}, {NEAREST_SQL}, {_routes_sql('short', 'length')}, {_routes_sql('safe', 'cost')},
both_ AS (SELECT near.origin, near.kind, near.dest, a.s.len / 1000 AS skm, b.s.len / 1000 AS lkm, a.s.expo / a.s.len AS sr, b.s.expo / b.s.len AS lr, a.s.mx AS smax, b.s.mx AS lmax, a.s.expo AS se, b.s.expo AS le, a.s.path AS sp, b.s.path AS lp
  FROM near JOIN short a ON a.o = near.origin AND a.n = near.dest JOIN safe b ON b.o = near.origin AND b.n = near.dest)"""


@query(f"""{BOTH_SQL}
SELECT CAST(origin AS BIGINT) AS origin, kind, CAST(dest AS BIGINT) AS dest, round(skm, 4) AS shortest_km, round(lkm, 4) AS least_risk_km, round(coalesce(100 * (lkm - skm) / nullif(skm, 0), 0e0), 4) AS distance_increase_pct,
round(sr, 4) AS shortest_mean_risk, round(lr, 4) AS least_risk_mean_risk, round(smax, 4) AS shortest_max_risk, round(lmax, 4) AS least_risk_max_risk,
round(coalesce(100 * (sr - lr) / nullif(sr, 0), 0e0), 4) AS mean_risk_reduction_pct, round(coalesce(100 * (se - le) / nullif(se, 0), 0e0), 4) AS exposure_reduction_pct, sp = lp AS same_route FROM both_""")
def route_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Lattice(spark, sf_dir)
    wanted = written(pairs(net, table(spark, sf_dir, "part")).select("origin", "kind", "dest"), "pairs")
    return rounded(tradeoff(network.routes(net.edges, wanted, "length", net.places), network.routes(net.edges, wanted, "cost", net.places)), 4)


def tradeoff(short: DataFrame, safe: DataFrame) -> DataFrame:
    """Shortest against least-risk routes of the same pairs; percentages are 0 where the base is not positive."""
    names = ("km", "mean_risk", "max_risk", "exposure", "path")
    both = short.select("origin", "kind", "dest", *[F.col(n).alias(f"s_{n}") for n in names]).join(safe.select("origin", "kind", "dest", *[F.col(n).alias(f"l_{n}") for n in names]), ["origin", "kind", "dest"])

    def percent(a: str, b: str, base: str):
        return F.when(F.col(base) > 0, (F.col(a) - F.col(b)) * 100 / F.col(base)).otherwise(0.0)

    return both.select(
        "origin", "kind", "dest", F.col("s_km").alias("shortest_km"), F.col("l_km").alias("least_risk_km"), percent("l_km", "s_km", "s_km").alias("distance_increase_pct"),
        F.col("s_mean_risk").alias("shortest_mean_risk"), F.col("l_mean_risk").alias("least_risk_mean_risk"), F.col("s_max_risk").alias("shortest_max_risk"), F.col("l_max_risk").alias("least_risk_max_risk"),
        percent("s_mean_risk", "l_mean_risk", "s_mean_risk").alias("mean_risk_reduction_pct"), percent("s_exposure", "l_exposure", "s_exposure").alias("exposure_reduction_pct"), (F.col("s_path") == F.col("l_path")).alias("same_route"),
    )


def route_rows(net: Lattice, wanted: DataFrame) -> DataFrame:
    """A row for each pair (``origin``, ``kind``, ``dest``, ``name``) and route type, with its sums, ``path`` and ``points``."""
    edges = network.edge_points(net.edges, net.nodes.select("id", F.col("lon").alias("x"), F.col("lat").alias("y")))
    out = []
    for kind, weight in (("shortest", "length"), ("least_risk", "cost")):
        found = written(network.routes(net.edges, wanted, weight, net.places), "route-rows")
        steps = network.path_steps(found.select("origin", "dest", "path").distinct(), edges, weight)
        placed = steps.join(net.nodes.select(F.col("id").alias("src"), F.col("lon").alias("sx"), F.col("lat").alias("sy")), "src")
        out.append(found.join(network.path_lines(placed), ["origin", "dest"], "left").withColumn("route_type", F.lit(kind)))
    return out[0].unionByName(out[1])


_ROUTE = "CAST(origin AS BIGINT) AS origin, both_.kind AS destination_type, name AS destination, '{}' AS route_type, round({}, 3) AS distance_km, round({}, 4) AS mean_risk, round({}, 4) AS max_risk, {} AS path, len(string_split({}, ' ')) AS vertices"


@query(f"""{BOTH_SQL}, named AS (SELECT both_.*, name FROM both_ JOIN dests ON dests.kind = both_.kind AND dests.node = both_.dest)
SELECT {_ROUTE.format("shortest", "skm", "sr", "smax", "sp", "sp").replace("both_.", "named.")} FROM named UNION ALL SELECT {_ROUTE.format("least_risk", "lkm", "lr", "lmax", "lp", "lp").replace("both_.", "named.")} FROM named""")
def route_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Lattice(spark, sf_dir)
    found = route_rows(net, written(pairs(net, table(spark, sf_dir, "part")), "pairs"))
    return found.select(
        "origin", F.col("kind").alias("destination_type"), F.col("name").alias("destination"), "route_type", F.round("km", 3).alias("distance_km"), F.round("mean_risk", 4).alias("mean_risk"), F.round("max_risk", 4).alias("max_risk"),
        F.array_join(F.col("path").cast("array<string>"), " ").alias("path"), F.size("points").cast("long").alias("vertices"),
    )


POINTS_SQL = f"""points AS (SELECT p_partkey AS id, p_type AS category, (p_partkey * 17 % 500) / 10e0 + 0.0317e0 AS x, (p_partkey * 13 % 400) / 10e0 + 0.0413e0 AS y,
  {LON_SQL.format('(p_partkey * 17 % 500) / 10e0 + 0.0317e0')} AS lon, {LAT_SQL.format('(p_partkey * 13 % 400) / 10e0 + 0.0413e0')} AS lat FROM part)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point over the grid for each part row: ``id``, ``category``, and lon ``x`` and lat ``y``."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_type").alias("category"), (F.lit(WEST) + (k * 17 % 500 / 10.0 + 0.0317) * STEP).alias("x"), (F.lit(NORTH) - (k * 13 % 400 / 10.0 + 0.0413) * STEP).alias("y"))


def _haversine_sql(a: str, b: str) -> str:
    return f"2 * 6371000e0 * asin(sqrt(least(power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2), 1e0)))"


def _planar_sql(a: str, b: str) -> str:
    return f"sqrt(power(({b}.lon - {a}.lon) * cos(radians(({a}.lat + {b}.lat) / 2)) * 111320e0, 2) + power(({b}.lat - {a}.lat) * 110570e0, 2))"


@query(f"""{LATTICE_SQL}, {POINTS_SQL}, d AS (SELECT points.id, nodes.id AS node, {_haversine_sql('points', 'nodes')} AS d FROM points, nodes)
SELECT id, arg_min(node, (d, node)) AS node, round(min(d), 4) AS distance FROM d GROUP BY id""")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = Lattice(spark, sf_dir).nodes.select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return rounded(network.nearest_any(points(spark, sf_dir), nodes, "node"), 4)


SUPPLIERS_SQL = f"places AS (SELECT s_suppkey AS id, s_name AS name, {LON_SQL.format('CAST(s_suppkey * 7 % 50 AS DOUBLE)')} AS lon, {LAT_SQL.format('CAST(s_suppkey * 3 % 40 AS DOUBLE)')} AS lat FROM supplier)"


@query(f"""WITH {POINTS_SQL}, {SUPPLIERS_SQL}, d AS (SELECT points.id, places.name, places.id AS place, {_haversine_sql('points', 'places')} AS d FROM points, places)
SELECT points.id, coalesce(m.name, '') AS name FROM points LEFT JOIN (SELECT id, arg_min(name, (d, place)) AS name FROM d WHERE d <= {K.PLACE_LIMIT_M}e0 GROUP BY id) m ON m.id = points.id""")
def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the suppliers at one spot the least id answers, as in a tie: the join holds each spot once."""
    k = F.col("s_suppkey")
    spots = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), (F.lit(WEST) + (k * 7 % 50).cast("double") * STEP).alias("x"), (F.lit(NORTH) - (k * 3 % 40).cast("double") * STEP).alias("y"))
    one = written(spots.groupBy("x", "y").agg(F.min(F.struct("id", "name")).alias("p")).select("p.*", "x", "y"), "places")
    found = network.nearest(points(spark, sf_dir), one, K.PLACE_LIMIT_M, "place", network.haversine_m)
    return found.join(one.select(F.col("id").alias("place"), "name"), "place", "left").select("id", F.coalesce("name", F.lit("")).alias("name"))


@query(f"{LATTICE_SQL}, u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, length, risk FROM edges WHERE src <> dst AND length > 0) SELECT a, b, round(min(length), 4) AS length, round(arg_min(risk, length), 6) AS risk FROM u GROUP BY a, b")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = network.undirected(Lattice(spark, sf_dir).edges.select("src", "dst", "length", "risk"))
    return found.select("a", "b", F.round("length", 4).alias("length"), F.round("risk", 6).alias("risk"))


#: A sparse road graph with long chains: each customer has a road to one other.
LINKS_SQL = "links AS (SELECT c_custkey AS src, (c_custkey * 7 + c_nationkey + 1) % (SELECT count(*) FROM customer) AS dst, 100e0 + c_custkey % 37 AS length, c_nationkey % 10 / 10e0 AS risk, c_nationkey % 5 AS rank, c_nationkey < 8 AS both_ways FROM customer)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A road from each customer to another: ``src``, ``dst``, ``length``, ``risk``, ``rank`` and ``both_ways``."""
    rows, k, n = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    return rows.select(k.alias("src"), ((k * 7 + n + 1) % rows.count()).alias("dst"), (k % 37 + 100.0).alias("length"), (n % 10 / 10.0).alias("risk"), (n % 5).alias("rank"), (n < 8).alias("both_ways"))


#: Nodes of two edges are taken from a queue, as a program for one machine would: all that there are now, least first, then those that there are after it.
_OWN, _FROM = "lambda x: x.a = todo[1] OR x.b = todo[1]", "CASE WHEN {e}.path[1] = {n} THEN {e}.path ELSE list_reverse({e}.path) END"
CONTRACT_SQL = f"""chain AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_min(struct_pack(risk := risk, rank := rank), (length, risk, rank)) AS v, min(length) AS length FROM links WHERE src <> dst GROUP BY 1, 2),
state(i, todo, e) AS (
  SELECT 0, []::BIGINT[], list(struct_pack(a := a, b := b, length := length, risk := v.risk, rank := v.rank, path := [a, b])) FROM chain
  UNION ALL
  SELECT i + 1, CASE WHEN len(todo) > 0 THEN todo[2:] ELSE pairs END, CASE WHEN len(own) <> 2 THEN e WHEN len(old) > 0 AND old[1].length <= new.length THEN others ELSE list_append(list_filter(others, lambda x: x.a <> p OR x.b <> q), new) END
  FROM (SELECT *, struct_pack(a := p, b := q, length := x.length + y.length, risk := (x.length * x.risk + y.length * y.risk) / (x.length + y.length), rank := least(x.rank, y.rank),
      path := list_concat({_FROM.format(e='x', n='p')}, ({_FROM.format(e='y', n='todo[1]')})[2:])) AS new, list_filter(others, lambda z: z.a = p AND z.b = q) AS old
    FROM (SELECT *, CASE WHEN p1 < p2 THEN own[1] ELSE own[2] END AS x, CASE WHEN p1 < p2 THEN own[2] ELSE own[1] END AS y, least(p1, p2) AS p, greatest(p1, p2) AS q
      FROM (SELECT *, own[1].a + own[1].b - todo[1] AS p1, own[2].a + own[2].b - todo[1] AS p2
        FROM (SELECT *, list_filter(e, {_OWN}) AS own, list_filter(e, lambda x: x.a <> todo[1] AND x.b <> todo[1]) AS others,
            (SELECT list(id ORDER BY id) FROM (SELECT id FROM (SELECT unnest(list_concat(list_transform(e, lambda x: x.a), list_transform(e, lambda x: x.b))) AS id) GROUP BY id HAVING count(*) = 2)) AS pairs
          FROM state WHERE todo IS NOT NULL) s) t) u) v
), contracted AS (SELECT x.a AS a, x.b AS b, x.length AS length, x.risk AS risk, x.rank AS rank, x.path AS path FROM (SELECT unnest(e) AS x FROM state WHERE i = (SELECT max(i) FROM state)))"""


@query(f"""WITH RECURSIVE {LINKS_SQL}, {CONTRACT_SQL}
SELECT a, b, round(length, 4) AS length, round(risk, 6) AS risk, CAST(rank AS BIGINT) AS rank, CAST(len(path) - 1 AS BIGINT) AS segments, array_to_string(list_transform(path, lambda k: (k * 37 % 500) || ' ' || (k * 53 % 400)), ',') AS line FROM contracted""")
def contracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' roads without nodes of two edges, and the line of each road that is left."""
    spot = lambda k: F.struct((k * 37 % 500).cast("double").alias("x"), (k * 53 % 400).cast("double").alias("y"))
    lined = network.undirected(links(spark, sf_dir).drop("both_ways")).withColumn("points", F.array(spot(F.col("a")), spot(F.col("b"))))
    found = contraction.contract(lined)
    line = F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["x"].cast("long"), p["y"].cast("long"))), ",")
    return found.select("a", "b", F.round("length", 4).alias("length"), F.round("risk", 6).alias("risk"), F.col("rank").cast("long").alias("rank"), "segments", line.alias("line"))


@query(f"""WITH RECURSIVE {LINKS_SQL}, {CONTRACT_SQL}, both_ AS (SELECT a AS x, b AS y FROM contracted UNION ALL SELECT b, a FROM contracted),
label(id, component) USING KEY (id) AS (SELECT DISTINCT x, x FROM both_ UNION SELECT n.y, min(p.component) FROM label p JOIN both_ n ON n.x = p.id JOIN recurring.label q ON q.id = n.y WHERE p.component < q.component GROUP BY n.y),
best AS (SELECT component FROM label GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
number AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM label WHERE component = (SELECT component FROM best))
SELECT row_number() OVER (ORDER BY u.n, v.n) - 1 AS edge, u.n AS u, v.n AS v, CAST(round(length) AS BIGINT) AS length, CAST(greatest(0, least(254, round(risk * 254))) AS INTEGER) AS risk, CASE WHEN rank <= 0 THEN 0 WHEN rank <= 2 THEN 1 ELSE 2 END AS class FROM contracted JOIN number u ON u.id = a JOIN number v ON v.id = b""")
def web_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact graph of the largest component; its lines, made simpler, are tested by themselves."""
    found = contraction.contract(network.undirected(links(spark, sf_dir).drop("both_ways")))
    return contraction.web_graph(found, 0.0)[1].drop("points")


@query(f"""WITH RECURSIVE {LINKS_SQL}, arcs AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links WHERE both_ways), nodes_ AS (SELECT src AS id FROM arcs UNION SELECT dst FROM arcs),
reach(a, b) AS (SELECT id, id FROM nodes_ UNION SELECT reach.a, arcs.dst FROM reach JOIN arcs ON arcs.src = reach.b) SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a""")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = links(spark, sf_dir)
    return network.strong_components(rows.select("src", "dst").union(rows.where("both_ways").select("dst", "src")))


LINE = ((2.0, 1.0), (16.0, 4.0), (31.0, 14.5), (45.0, 32.0), (18.0, 36.0))
_LINE_SQL = ", ".join(f"({i}, {LON_SQL.format(f'{a[0]}e0')}, {LAT_SQL.format(f'{a[1]}e0')}, {LON_SQL.format(f'{b[0]}e0')}, {LAT_SQL.format(f'{b[1]}e0')})" for i, (a, b) in enumerate(zip(LINE, LINE[1:], strict=False)))
CORRIDOR_SQL = f"""WITH {POINTS_SQL}, seg AS (SELECT * FROM (VALUES {_LINE_SQL}) t(seg, ax, ay, bx, by_)),
long_ AS (SELECT *, sqrt(power((bx - ax) * cos(radians((ay + by_) / 2)) * 111320e0, 2) + power((by_ - ay) * 110570e0, 2)) AS metres FROM seg), run AS (SELECT *, sum(metres) OVER (ORDER BY seg) - metres AS before FROM long_),
plane AS (SELECT id, category, seg, before, (ax - lon) * cos(radians(lat)) * 111320e0 AS ax, (ay - lat) * 110570e0 AS ay, (bx - lon) * cos(radians(lat)) * 111320e0 AS bx, (by_ - lat) * 110570e0 AS by_ FROM points, run),
hit AS (SELECT *, coalesce(greatest(least(-(ax * (bx - ax) + ay * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 1e0), 0e0), 0e0) AS t FROM plane),
near_ AS (SELECT id, category, seg, sqrt(power(ax + t * (bx - ax), 2) + power(ay + t * (by_ - ay), 2)) AS d, before + t * sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS a FROM hit),
found AS (SELECT id, category, min(d) AS distance, arg_min(a, (d, seg)) AS along FROM near_ WHERE d <= 1500e0 GROUP BY id, category)"""


def corridor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within 1,500 m of a polyline over the grid."""
    line = spark.createDataFrame([(1, [{"x": WEST + x * STEP, "y": NORTH - y * STEP} for x, y in LINE])], "line long, points array<struct<x: double, y: double>>")
    here = points(spark, sf_dir)
    return network.corridor(line, here.select("id", "x", "y"), 1500.0).join(here.select("id", "category"), "id")


@query(f"{CORRIDOR_SQL} SELECT id, round(distance, 4) AS distance, round(along, 4) AS along, CAST(row_number() OVER (ORDER BY along, id) AS INTEGER) AS position FROM found")
def corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(corridor_rows(spark, sf_dir).select("id", "distance", "along", "position"), 4)


@query(f"{CORRIDOR_SQL} SELECT category, count(*) AS n FROM found GROUP BY category")
def corridor_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.category_hits(corridor_rows(spark, sf_dir).withColumn("query", F.lit(1))).select("category", "n")


@query(f"""WITH {POINTS_SQL}, ring AS (SELECT * FROM (VALUES {", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(LINE, LINE[1:] + LINE[:1], strict=True))}) t(ax, ay, bx, by_))
SELECT id, count(*) FILTER (WHERE (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / nullif(by_ - ay, 0) + ax) % 2 = 1 AS inside FROM points, ring GROUP BY id""")
def points_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in LINE])
    return table(spark, sf_dir, "part").select(k.alias("id"), in_ring(k * 17 % 500 / 10.0 + 0.0317, k * 13 % 400 / 10.0 + 0.0413, ring).alias("inside"))


@query()
def simplified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("line")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("double").alias("x"), F.col("o_totalprice").alias("y")))).alias("points"))
    return network.simplify(moves, 50_000.0).select("line", F.size("points").cast("long").alias("kept"))


# ---------------------------------------------------------------- point-to-point search

#: Segments between neighbouring nodes with a bend in the middle, and risk in 254ths as the search holds it.
ROADS_SQL = f"""u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(length) AS length, round(arg_min(risk, length) * 254) / 254 AS risk FROM edges GROUP BY 1, 2),
roads AS (SELECT u.a * {ROWS * COLS} + u.b AS edge, u.a, u.b, length, u.risk, n.lon AS lon0, n.lat AS lat0, (n.lon + m.lon) / 2 + 0.0011e0 AS lon1, (n.lat + m.lat) / 2 + 0.0007e0 AS lat1, m.lon AS lon2, m.lat AS lat2 FROM u JOIN nodes n ON n.id = u.a JOIN nodes m ON m.id = u.b),
vertices AS (SELECT edge, 0 AS v, lon0 AS lon, lat0 AS lat FROM roads UNION ALL SELECT edge, 1, lon1, lat1 FROM roads UNION ALL SELECT edge, 2, lon2, lat2 FROM roads)"""
TARGET = (WEST + 40.2 * STEP, NORTH - 33.3 * STEP)
_M = "sqrt(power((r.lon{1} - r.lon{0}) * cos(radians((r.lat{0} + r.lat{1}) / 2)) * 111320e0, 2) + power((r.lat{1} - r.lat{0}) * 110570e0, 2))"
SNAP_SQL = f"""target AS (SELECT {TARGET[0]!r}e0 AS lon, {TARGET[1]!r}e0 AS lat),
far_points AS (SELECT id, lon, lat FROM points UNION ALL SELECT -1 - s_suppkey, 77e0 + s_suppkey * 0.001e0, 12.5e0 FROM supplier),
pd AS (SELECT p.id, v.edge, v.v, {_planar_sql('p', 'v')} AS d FROM far_points p JOIN vertices v ON abs(p.lat - v.lat) <= 0.03e0 AND abs(p.lon - v.lon) <= 0.03e0),
hits AS (SELECT id, arg_min(struct_pack(edge := edge, v := v), (d, edge, v)) AS h FROM pd WHERE d <= {K.SNAP_LIMIT_M}e0 GROUP BY id),
td AS (SELECT v.edge, v.v, {_planar_sql('t', 'v')} AS d FROM target t, vertices v),
offsets AS (SELECT edge, a, b, length, risk, {_M.format(0, 1)} AS m0, {_M.format(1, 2)} AS m1 FROM roads r),
goal AS (SELECT o.edge, o.a, o.b, o.risk, CASE t.v WHEN 0 THEN 0e0 WHEN 1 THEN m0 ELSE m0 + m1 END * length / (m0 + m1) AS to_a, CASE t.v WHEN 0 THEN m0 + m1 WHEN 1 THEN m1 ELSE 0e0 END * length / (m0 + m1) AS to_b
  FROM (SELECT arg_min(struct_pack(edge := edge, v := v), (d, edge, v)) AS h FROM td) g, LATERAL (SELECT g.h.v AS v, g.h.edge AS edge) t JOIN offsets o ON o.edge = t.edge),
starts AS (SELECT hits.id, o.edge, o.a, o.b, o.risk, CASE h.v WHEN 0 THEN 0e0 WHEN 1 THEN m0 ELSE m0 + m1 END * length / (m0 + m1) AS to_a, CASE h.v WHEN 0 THEN m0 + m1 WHEN 1 THEN m1 ELSE 0e0 END * length / (m0 + m1) AS to_b FROM hits JOIN offsets o ON o.edge = h.edge),
two_way AS (SELECT a AS src, b AS dst, length, risk FROM roads UNION ALL SELECT b, a, length, risk FROM roads)"""


def _search_sql(name: str, alpha: float) -> str:
    """Ways to the goal from every node, grown backwards from both ends of its segment, and their best continuation to each start."""
    seed = "struct_pack(d := {m} * (1 + {al} * risk), len := {m}, expo := {m} * risk, mx := CASE WHEN {m} > 0 THEN risk ELSE 0e0 END)"
    step = f"struct_pack(d := p.s.d + e.length * (1 + {alpha} * e.risk), len := p.s.len + e.length, expo := p.s.expo + e.length * e.risk, mx := greatest(p.s.mx, e.risk))"
    out = f"struct_pack(d := w.s.d + s.{{m}} * (1 + {alpha} * s.risk), len := w.s.len + s.{{m}}, expo := w.s.expo + s.{{m}} * s.risk, mx := greatest(w.s.mx, CASE WHEN s.{{m}} > 0 THEN s.risk ELSE 0e0 END))"
    return f"""{name}(n, s) USING KEY (n) AS (
  SELECT n, min(s) FROM (SELECT a AS n, {seed.format(m='to_a', al=alpha)} AS s FROM goal UNION ALL SELECT b, {seed.format(m='to_b', al=alpha)} FROM goal) GROUP BY n
  UNION SELECT e.dst, min({step}) FROM {name} p JOIN two_way e ON e.src = p.n LEFT JOIN recurring.{name} q ON q.n = e.dst WHERE q.s IS NULL OR p.s.d + e.length * (1 + {alpha} * e.risk) < q.s.d GROUP BY e.dst),
{name}_far AS (SELECT id, min(x) AS s FROM (SELECT s.id, {out.format(m='to_a')} AS x FROM starts s JOIN {name} w ON w.n = s.a WHERE s.edge <> (SELECT edge FROM goal) UNION ALL SELECT s.id, {out.format(m='to_b')} FROM starts s JOIN {name} w ON w.n = s.b WHERE s.edge <> (SELECT edge FROM goal)) GROUP BY id),
{name}_all AS (SELECT id, s.len AS len, CASE WHEN s.len > 0 THEN s.expo / s.len ELSE 0e0 END AS mean_risk, s.mx AS max_risk FROM {name}_far
  UNION ALL SELECT s.id, abs(s.to_a - g.to_a), CASE WHEN s.to_a <> g.to_a THEN s.risk ELSE 0e0 END, CASE WHEN s.to_a <> g.to_a THEN s.risk ELSE 0e0 END FROM starts s JOIN goal g ON g.edge = s.edge)"""


def road_segments(net: Lattice) -> DataFrame:
    """The lattice's undirected segments with a bend in the middle, as search() takes them."""
    pairs_ = network.undirected(net.edges.select("src", "dst", "length", "risk"))
    spot = net.nodes.select("id", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p"))
    both = pairs_.join(spot.select(F.col("id").alias("a"), F.col("p").alias("p0")), "a").join(spot.select(F.col("id").alias("b"), F.col("p").alias("p2")), "b")
    bend = F.struct(((F.col("p0.x") + F.col("p2.x")) / 2 + 0.0011).alias("x"), ((F.col("p0.y") + F.col("p2.y")) / 2 + 0.0007).alias("y"))
    return written(both.select((F.col("a") * (ROWS * COLS) + F.col("b")).alias("edge"), "a", "b", "length", (F.round(F.col("risk") * 254) / 254).alias("risk"), F.array("p0", bend, "p2").alias("points")), "road-segments")


def search_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search to one target from each part's point, and from each supplier's, which lies far from all roads."""
    far = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("id"), (F.col("s_suppkey") * 0.001 + 77.0).alias("ax"), F.lit(12.5).alias("ay"))
    near = points(spark, sf_dir).select("id", F.col("x").alias("ax"), F.col("y").alias("ay"))
    return near.unionByName(far).withColumns({"bx": F.lit(TARGET[0]), "by": F.lit(TARGET[1])})


@query(f"""{LATTICE_SQL}, {ROADS_SQL}, {POINTS_SQL}, {SNAP_SQL}, {_search_sql('safe', K.ALPHA)}, {_search_sql('short', 0)}
SELECT p.id, CASE WHEN a.id IS NULL THEN 'straight' ELSE 'route' END AS mode, round(coalesce(a.len, {_planar_sql('p', 't')}), 3) AS least_risk_m, round(a.mean_risk, 6) AS least_risk_mean, round(a.max_risk, 6) AS least_risk_max,
round(coalesce(b.len, {_planar_sql('p', 't')}), 3) AS shortest_m, round(b.mean_risk, 6) AS shortest_mean, round(b.max_risk, 6) AS shortest_max FROM far_points p JOIN target t ON true LEFT JOIN safe_all a ON a.id = p.id LEFT JOIN short_all b ON b.id = p.id""")
def route_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point to point for every point: snapped to vertices, the least-risk and the shortest way, or a straight line where a point can't be snapped."""
    segments, wanted = road_segments(Lattice(spark, sf_dir)), search_ends(spark, sf_dir)
    different = search.one_each(wanted)
    ends = search.snapped_ends(different, segments)
    safe, short = (search.search(different, segments, alpha, ends=ends).select("id", "mode", F.col("length").alias(f"{n}_m"), F.col("mean_risk").alias(f"{n}_mean"), F.col("max_risk").alias(f"{n}_max")) for alpha, n in ((K.ALPHA, "least_risk"), (0.0, "shortest")))
    both = search.for_all(safe.join(short.drop("mode"), "id"), different, wanted)
    return both.select("id", "mode", *[F.round(c, 3 if c.endswith("_m") else 6).alias(c) for c in both.columns[2:]])


@query(f"""{LATTICE_SQL}, {ROADS_SQL}, {POINTS_SQL}, {SNAP_SQL} SELECT p.id, s.edge, round(s.to_a, 4) AS to_a, round(s.to_b, 4) AS to_b FROM far_points p LEFT JOIN starts s ON s.id = p.id""")
def snapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = search_ends(spark, sf_dir).select("id", F.col("ax").alias("x"), F.col("ay").alias("y"))
    return search.snap(ends, road_segments(Lattice(spark, sf_dir))).select("id", "edge", F.round("to_a", 4).alias("to_a"), F.round("to_b", 4).alias("to_b"))


@query()
def search_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within a kilometre of the least-risk way of each supplier's search, and how many of each category."""
    segments = road_segments(Lattice(spark, sf_dir))
    k = F.col("s_suppkey")
    ends = table(spark, sf_dir, "supplier").select(k.alias("id"), (F.lit(WEST) + (k * 7 % 50 + 0.3) * STEP).alias("ax"), (F.lit(NORTH) - (k * 3 % 40 + 0.2) * STEP).alias("ay"), F.lit(TARGET[0]).alias("bx"), F.lit(TARGET[1]).alias("by"))
    different = search.one_each(ends)
    ways = written(search.search(different, segments, K.ALPHA), "ways")
    return search.for_all(search.categories_along(ways, segments, points(spark, sf_dir), 1000.0), different, ends, "query")


@query(f"""{LATTICE_SQL} SELECT src, dst, CASE WHEN (src + dst) % 3 = 0 THEN 'primary' ELSE 'secondary' END AS highway, round(risk, 3) AS risk, CAST(2 AS BIGINT) AS vertices FROM edges WHERE (src + dst) % 3 < 2""")
def display_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice's displayed roads; a third are residential and not shown."""
    net = Lattice(spark, sf_dir)
    highway = F.when((F.col("src") + F.col("dst")) % 3 == 0, "primary").when((F.col("src") + F.col("dst")) % 3 == 1, "['tertiary', 'secondary']").otherwise("residential")
    lined = network.edge_points(net.edges, net.nodes.select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))).withColumn("highway", highway)
    return roads.display_roads(lined).select("src", "dst", "highway", "risk", F.size("points").cast("long").alias("vertices"))


@query(f"""WITH RECURSIVE {LINKS_SQL}, piece AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_min(struct_pack(length := length, risk := risk), (src, dst)) AS v FROM links WHERE src <> dst GROUP BY 1, 2),
inner_ AS (SELECT id FROM (SELECT a AS id FROM piece UNION ALL SELECT b FROM piece) GROUP BY id HAVING count(*) = 2),
joint AS (SELECT a AS x, b AS y FROM piece WHERE a IN (SELECT id FROM inner_) AND b IN (SELECT id FROM inner_)), both_ AS (SELECT x, y FROM joint UNION ALL SELECT y, x FROM joint),
label(id, component) USING KEY (id) AS (SELECT id, id FROM inner_ UNION SELECT n.y, min(p.component) FROM label p JOIN both_ n ON n.x = p.id JOIN recurring.label q ON q.id = n.y WHERE p.component < q.component GROUP BY n.y),
keyed AS (SELECT piece.*, coalesce(p.component, q.component) AS component FROM piece LEFT JOIN label p ON p.id = a LEFT JOIN label q ON q.id = b)
SELECT coalesce('c' || component, 'e-' || a || '-' || b) AS line, count(*) AS pieces, round(sum(v.length), 4) AS length, round(sum(v.length * v.risk) / sum(v.length), 6) AS risk, count(*) + 1 AS vertices FROM keyed GROUP BY 1""")
def merged_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' roads merged to polylines: their ends, pieces, length and vertices."""
    rows = links(spark, sf_dir).where("src <> dst")
    spot = lambda k: F.struct((F.lit(WEST) + k * 37 % 500 / 1000.0).alias("x"), (F.lit(NORTH) - k * 53 % 400 / 1000.0).alias("y"))
    lines = roads.merged_lines(rows.select("src", "dst", "length", "risk", F.array(spot(F.col("src")), spot(F.col("dst"))).alias("points")))
    return lines.select("line", "pieces", F.round("length", 4).alias("length"), F.round("risk", 6).alias("risk"), F.size("points").cast("long").alias("vertices"))


#: Short roads that cross, touch and overlap without shared nodes, in whole places of a ten-millionth of a degree: every seventh one lies on the one before and goes on for its length.
SHORT_SQL = """short AS (SELECT k, f, base, 760000000 + base * 37 % 500 * 10000 AS x, 110000000 + base * 53 % 400 * 10000 AS y FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS f, CASE WHEN c_custkey % 7 = 0 THEN c_custkey - 1 ELSE c_custkey END AS base FROM customer)),
segment AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM (SELECT struct_pack(x := x, y := y) AS p, struct_pack(x := x + (base * 31 % 7 - 3) * 50030 * f, y := y + (base * 17 % 5 - 2) * 50030 * f) AS q FROM short) WHERE p <> q),
pair AS (SELECT s.a AS a, s.b AS b, o.a AS c, o.b AS d, s.b.x - s.a.x AS dx, s.b.y - s.a.y AS dy, o.b.x - o.a.x AS ex, o.b.y - o.a.y AS ey, o.a.x - s.a.x AS cx, o.a.y - s.a.y AS cy FROM segment s JOIN segment o ON (s.a, s.b) <> (o.a, o.b)
  AND o.a.x <= s.b.x AND o.b.x >= s.a.x AND least(o.a.y, o.b.y) <= greatest(s.a.y, s.b.y) AND greatest(o.a.y, o.b.y) >= least(s.a.y, s.b.y)),
crossed AS (SELECT *, sign(dx * ey - dy * ex)::BIGINT AS g, dx * ey - dy * ex AS den, cx * ey - cy * ex AS t, cx * dy - cy * dx AS u FROM pair),
turned AS (SELECT a, b, c, d, dx, dy, CASE WHEN g < 0 THEN -den ELSE den END AS den, CASE WHEN g < 0 THEN -t ELSE t END AS t, CASE WHEN g < 0 THEN -u ELSE u END AS u FROM crossed),
cut AS (SELECT a, b, CASE WHEN t = 0 THEN a WHEN t = den THEN b WHEN u = 0 THEN c WHEN u = den THEN d ELSE struct_pack(x := a.x + floor(t::DOUBLE / den::DOUBLE * dx + 0.5e0)::BIGINT, y := a.y + floor(t::DOUBLE / den::DOUBLE * dy + 0.5e0)::BIGINT) END AS p FROM turned WHERE den <> 0 AND t BETWEEN 0 AND den AND u BETWEEN 0 AND den AND (a, b) < (c, d)
  UNION SELECT c, d, CASE WHEN t = 0 THEN a WHEN t = den THEN b WHEN u = 0 THEN c WHEN u = den THEN d ELSE struct_pack(x := a.x + floor(t::DOUBLE / den::DOUBLE * dx + 0.5e0)::BIGINT, y := a.y + floor(t::DOUBLE / den::DOUBLE * dy + 0.5e0)::BIGINT) END FROM turned WHERE den <> 0 AND t BETWEEN 0 AND den AND u BETWEEN 0 AND den AND (a, b) < (c, d)
  UNION SELECT a, b, c FROM turned WHERE den = 0 AND u = 0 UNION SELECT a, b, d FROM turned WHERE den = 0 AND u = 0),
stop AS (SELECT a, b, p FROM cut WHERE p > a AND p < b UNION SELECT a, b, a FROM segment UNION SELECT a, b, b FROM segment),
piece AS (SELECT DISTINCT least(p, q) AS p, greatest(p, q) AS q FROM (SELECT p, lead(p) OVER (PARTITION BY a, b ORDER BY (p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y), p) AS q FROM stop) WHERE q IS NOT NULL AND p <> q)"""


def short_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short road for each customer, as a line of lon and lat."""
    k = F.col("c_custkey")
    base, f = k - F.when(k % 7 == 0, 1).otherwise(0), F.when(k % 7 == 0, 2).otherwise(1)
    x, y = F.lit(760000000) + base * 37 % 500 * 10000, F.lit(110000000) + base * 53 % 400 * 10000
    spot = lambda a, b: F.struct((a / 10000000.0).alias("x"), (b / 10000000.0).alias("y"))
    return table(spark, sf_dir, "customer").select(F.array(spot(x, y), spot(x + (base * 31 % 7 - 3) * 50030 * f, y + (base * 17 % 5 - 2) * 50030 * f)).alias("points"))


@query(f"WITH {SHORT_SQL} SELECT p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM piece")
def noded_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noding.noded(noding.segments(short_roads(spark, sf_dir))).withColumnRenamed("by", "by_")


@query(f"""WITH RECURSIVE {SHORT_SQL}, ends AS (SELECT p AS n FROM piece UNION ALL SELECT q FROM piece), inner_ AS (SELECT n FROM ends GROUP BY n HAVING count(*) = 2),
both_ AS (SELECT p AS x, q AS y FROM piece WHERE p IN (SELECT n FROM inner_) AND q IN (SELECT n FROM inner_) UNION ALL SELECT q, p FROM piece WHERE p IN (SELECT n FROM inner_) AND q IN (SELECT n FROM inner_)),
label(n, component) USING KEY (n) AS (SELECT n, n FROM inner_ UNION SELECT b.y, min(l.component) FROM label l JOIN both_ b ON b.x = l.n JOIN recurring.label r ON r.n = b.y WHERE l.component < r.component GROUP BY b.y),
keyed AS (SELECT p, q, coalesce(l.component, r.component) AS component, {_M.format(0, 1)} AS metres FROM (SELECT p, q, p.x / 10000000e0 AS lon0, p.y / 10000000e0 AS lat0, q.x / 10000000e0 AS lon1, q.y / 10000000e0 AS lat1 FROM piece) r LEFT JOIN label l ON l.n = r.p LEFT JOIN label r2 ON r2.n = r.q)
SELECT pieces, vertices, round(length, 3) AS length FROM (SELECT count(*) AS pieces, count(*) + 1 AS vertices, sum(metres) AS length FROM keyed GROUP BY component, CASE WHEN component IS NULL THEN p END, CASE WHEN component IS NULL THEN q END)""".replace("coalesce(l.component, r.component)", "coalesce(l.component, r2.component)"))
def merged_noded_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines between the places where not just two pieces meet."""
    pieces = noding.noded(noding.segments(short_roads(spark, sf_dir)))
    lines = roads.merged_lines(noding.as_edges(pieces))
    return lines.select("pieces", F.size("points").cast("long").alias("vertices"), F.round("length", 3).alias("length"))


@query(f"{LATTICE_SQL}, {POINTS_SQL} SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT round(sum(length), 2) FROM edges) AS metres FROM nodes")
def graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Lattice(spark, sf_dir)
    return net.nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(net.edges.agg(F.count("*").alias("edges"), F.round(F.sum("length"), 2).alias("metres"))), how="cross")


def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names as places."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), (k % 4 == 0).alias("is_place"), (k % 50 * 0.01 + 76.0).alias("x"), (k % 40 * 0.01 + 11.0).alias("y"))


@query("""WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN (5 + c_custkey % 10) || ', 7' || (c_custkey % 10) || '.5' WHEN 1 THEN 'SUPPLIER  ' || lpad((c_custkey % 10)::VARCHAR, 2, '0') ELSE 'nothing like it ' || c_custkey END AS text FROM customer),
n AS (SELECT s_suppkey AS id, s_name AS name, lower(s_name) AS n, s_suppkey % 4 = 0 AS is_place, s_suppkey % 50 * 0.01e0 + 76e0 AS x, s_suppkey % 40 * 0.01e0 + 11e0 AS y FROM supplier),
m AS (SELECT t.id, arg_min(struct_pack(name := n.name, x := n.x, y := n.y), (CASE WHEN starts_with(n.n, lower(text)) THEN 0e0 WHEN contains(n.n, ' ' || lower(text)) THEN 1e0 ELSE 2e0 END - CASE WHEN is_place THEN 0.6e0 ELSE 0e0 END + length(n.n) / 400e0, n.id)) AS b
  FROM t JOIN n ON contains(n.n, 'supplier') AND contains(n.n, lpad((t.id % 10)::VARCHAR, 2, '0')) WHERE t.id % 3 = 1 GROUP BY t.id)
SELECT t.id, round(CASE WHEN t.id % 3 = 0 THEN ('7' || (t.id % 10) || '.5')::DOUBLE ELSE m.b.x END, 6) AS x, round(CASE WHEN t.id % 3 = 0 THEN (5 + t.id % 10)::DOUBLE ELSE m.b.y END, 6) AS y, m.b.name AS label FROM t LEFT JOIN m ON m.id = t.id""")
def resolved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are coordinates, names of places, or neither. Of coordinates the label is left out: it is made up of them."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(k % 10 + 5, F.lit(", 7"), k % 10, F.lit(".5"))).when(k % 3 == 1, F.concat(F.lit("SUPPLIER  "), F.lpad((k % 10).cast("string"), 2, "0"))).otherwise(F.concat(F.lit("nothing like it "), k))
    found = search.resolved(table(spark, sf_dir, "customer").select(k.alias("id"), text.alias("text")), resolve_names(spark, sf_dir))
    return found.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.when(F.col("id") % 3 != 0, F.col("label")).alias("label"))
