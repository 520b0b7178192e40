"""Queries on places and tags: categories, dedupe, filters, road classes, name search and parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import constants as K
from gridloom.operators import network, places
from gridloom.plans.registry import query
from gridloom.session import table

AMENITIES = ("hospital", "clinic", "police", "shelter", "school", "townhall", "bank", "fuel", "bus_station", "marketplace", "place_of_worship", "bench")
SHOPS = ("supermarket", "mall", "kiosk")
STEMS = ("District Hospital", "Dental Care", "Green High School", "Taluk Clinic", "Lake View", "Lower Primary", "Medical College", "Referral Centre")
HIGHWAYS = ("primary", "residential", "footway", "service", "track", "trunk_link", "['secondary', 'tertiary']", "unclassified; road", "motorway")
SHELTERS = ("public_transport", "picnic_shelter", "basic_hut", "building")
#: The study area, as a ring of lon and lat.
RING = ((76.0, 11.5), (76.0113, 11.4987), (76.0121, 11.5079), (76.0049, 11.5093))


def _pick(values: tuple[str, ...], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({index}) % {len(values)} + 1]"


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged points from the parts table: ``id``, ``tags``, ``lon`` and ``lat``."""
    k = F.col("p_partkey")
    tags = F.map_filter(
        F.create_map(
            F.lit("amenity"), F.when(k % 3 != 0, _pick(AMENITIES, F.floor(k / 5))), F.lit("shop"), F.when(k % 3 == 0, _pick(SHOPS, k / 3)), F.lit("place"), F.when(k % 29 == 0, "village"),
            F.lit("emergency"), F.when(k % 31 == 0, "assembly_point").when(k % 6 == 1, F.when(k % 4 == 1, "yes").otherwise("no")), F.lit("shelter_type"), F.when(k % 4 != 3, _pick(SHELTERS, F.floor(k / 2))),
            F.lit("tourism"), F.when(k % 17 == 0, "hotel"), F.lit("healthcare"), F.when(k % 19 == 0, "clinic"),
            F.lit("name"), F.when(k % 7 != 0, F.concat(_pick(STEMS, k), F.lit(" "), (k % 40).cast("string"))),
        ),
        lambda _, v: v.isNotNull(),
    )
    return table(spark, sf_dir, "part").select(k.alias("id"), tags.alias("tags"), (k % 13 / 1000.0 + 76.0).alias("lon"), (k % 11 / 1000.0 + 11.5).alias("lat"))


_RING_SQL = ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(RING, RING[1:] + RING[:1], strict=True))
FACILITY_SQL = f"""fac AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN {_pick_sql(AMENITIES, 'p_partkey // 5')} END AS amenity, CASE WHEN p_partkey % 3 = 0 THEN {_pick_sql(SHOPS, 'p_partkey // 3')} END AS shop,
  CASE WHEN p_partkey % 29 = 0 THEN 'village' END AS place, CASE WHEN p_partkey % 31 = 0 THEN 'assembly_point' WHEN p_partkey % 6 = 1 THEN CASE WHEN p_partkey % 4 = 1 THEN 'yes' ELSE 'no' END END AS emergency,
  CASE WHEN p_partkey % 4 <> 3 THEN {_pick_sql(SHELTERS, 'p_partkey // 2')} END AS shelter_type, CASE WHEN p_partkey % 17 = 0 THEN 'hotel' END AS tourism, CASE WHEN p_partkey % 19 = 0 THEN 'clinic' END AS healthcare,
  CASE WHEN p_partkey % 7 <> 0 THEN {_pick_sql(STEMS, 'p_partkey')} || ' ' || (p_partkey % 40) END AS name, p_partkey % 13 / 1000e0 + 76e0 AS lon, p_partkey % 11 / 1000e0 + 11.5e0 AS lat FROM part),
ring AS (SELECT * FROM (VALUES {_RING_SQL}) t(ax, ay, bx, by_)),
inside AS (SELECT id, count(*) FILTER (WHERE (ay > lat) <> (by_ > lat) AND lon < (bx - ax) * (lat - ay) / nullif(by_ - ay, 0) + ax) % 2 = 1 AS inside FROM fac, ring GROUP BY id),
cat AS (SELECT *, CASE WHEN category = 'place' THEN place ELSE coalesce(amenity, healthcare, tourism, shop, emergency, '') END AS sub FROM (SELECT *, CASE WHEN place IS NOT NULL AND name IS NOT NULL THEN 'place'
  WHEN amenity = 'shelter' AND shelter_type IN ('public_transport', 'picnic_shelter', 'basic_hut') THEN NULL
  WHEN amenity IN ('hospital', 'clinic') OR healthcare = 'clinic' THEN 'health' WHEN amenity = 'police' OR emergency = 'assembly_point' THEN 'emergency'
  WHEN amenity = 'shelter' AND name IS NOT NULL THEN 'shelter' WHEN amenity = 'school' AND name IS NOT NULL THEN 'education' WHEN amenity = 'townhall' AND name IS NOT NULL THEN 'government' WHEN amenity = 'bank' THEN 'finance'
  WHEN amenity = 'fuel' THEN 'fuel' WHEN amenity = 'bus_station' THEN 'transport' WHEN (amenity = 'marketplace' OR shop IN ('supermarket', 'mall')) AND name IS NOT NULL THEN 'market'
  WHEN amenity = 'place_of_worship' AND name IS NOT NULL THEN 'worship' WHEN tourism = 'hotel' AND name IS NOT NULL THEN 'tourism' END AS category FROM fac))"""


def ring() -> Column:
    """RING as a column."""
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])


def categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities that have a category."""
    cat = places.facility_category()
    return facilities(spark, sf_dir).select("id", cat.alias("cat"), places.sub_type(cat).alias("sub"), F.coalesce(places.tag("name"), F.lit("")).alias("name"), "lon", "lat").where("cat IS NOT NULL")


@query(f"WITH {FACILITY_SQL} SELECT id, category AS cat, sub, coalesce(name, '') AS name FROM cat WHERE category IS NOT NULL")
def facility_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorised(spark, sf_dir).select("id", "cat", "sub", "name")


@query(f"WITH {FACILITY_SQL} SELECT min(id) AS id, category AS cat FROM cat WHERE category IS NOT NULL GROUP BY category, lower(coalesce(name, '')), round(lon, 4), round(lat, 4)")
def facility_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.dedupe_facilities(categorised(spark, sf_dir), "id").select("id", "cat")


@query(f"WITH {FACILITY_SQL}, here AS (SELECT category AS cat, sub, coalesce(name, '') AS name, round(lon, 5) AS lon, round(lat, 5) AS lat, id FROM cat JOIN inside USING (id) WHERE category IS NOT NULL AND inside) SELECT min(id) AS id, cat, arg_min(sub, id) AS sub, arg_min(name, id) AS name FROM here GROUP BY cat, lower(name), round(lon, 4), round(lat, 4)")
def facility_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From tagged points to facilities: classified, inside the study area, each once."""
    return places.scan_facilities(facilities(spark, sf_dir), ring()).select("id", "cat", "sub", "name")


CATEGORIES = [c for c, _, _ in K.FACILITIES] + ["place"]


@query(f"WITH {FACILITY_SQL}, known AS (SELECT * FROM (VALUES {', '.join(f'({i}, {c!r})' for i, c in enumerate(CATEGORIES))}) t(position, category)) SELECT known.category, CAST(position AS BIGINT) AS position, count(cat.id) AS n FROM known LEFT JOIN cat ON cat.category = known.category GROUP BY 1, 2")
def facility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.category_counts(categorised(spark, sf_dir), CATEGORIES)


@query(f"WITH {FACILITY_SQL} SELECT id, category AS cat FROM cat WHERE category IN ('health', 'fuel', 'market')")
def enabled_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorised(spark, sf_dir).where(F.col("cat").isin("health", "fuel", "market")).select("id", "cat")


@query(f"WITH {FACILITY_SQL}, poi AS (SELECT id, unnest([CASE WHEN amenity = 'hospital' THEN 'hospital' END, CASE WHEN amenity = 'clinic' THEN 'clinic' END, CASE WHEN amenity IN ('shelter', 'school') OR emergency = 'assembly_point' THEN 'shelter' END, CASE WHEN place IS NOT NULL THEN 'place' END]) AS kind FROM fac) SELECT id, kind FROM poi WHERE kind IS NOT NULL")
def poi_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kind_rows(spark, sf_dir).select("id", "kind")


def kind_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each kind of a facility."""
    is_ = lambda k, *v: F.coalesce(places.tag(k).isin(*v), F.lit(False))
    rules = {"hospital": is_("amenity", "hospital"), "clinic": is_("amenity", "clinic"), "shelter": is_("amenity", "shelter", "school") | is_("emergency", "assembly_point"), "place": places.tag("place").isNotNull()}
    return facilities(spark, sf_dir).select(
        "id", F.explode(places.kinds(rules)).alias("kind"), places.tag("name").alias("name"), places.tag("amenity").alias("amenity"), places.tag("shelter_type").alias("shelter_type"), (F.coalesce(places.tag("emergency") == "yes", F.lit(False))).alias("emergency"), "lon", "lat"
    )


@query(f"""WITH {FACILITY_SQL}, fit AS (SELECT id, name, regexp_matches(coalesce(name, ''), '(?i){K.HOSPITAL_MAJOR}') OR coalesce(emergency = 'yes', false) AS major FROM fac WHERE amenity = 'hospital' AND NOT regexp_matches(coalesce(name, ''), '(?i){K.HOSPITAL_EXCLUDED}'))
SELECT id, coalesce(name, '') AS name FROM fit WHERE major OR (SELECT count(*) FROM fit WHERE major) < 5
UNION ALL SELECT id, coalesce(name, '') FROM fac WHERE amenity = 'clinic' AND (SELECT count(*) FROM fit) = 0""")
def poi_regex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.hospitals(kind_rows(spark, sf_dir)).select("id", F.coalesce("name", F.lit("")).alias("name"))


@query(f"WITH {FACILITY_SQL} SELECT id FROM fac WHERE (amenity IN ('shelter', 'school') OR emergency = 'assembly_point') AND coalesce(shelter_type, '') NOT IN ('public_transport', 'picnic_shelter', 'basic_hut') AND (coalesce(amenity, '') <> 'school' OR regexp_matches(coalesce(name, ''), '(?i){K.SCHOOL_SHELTER}'))")
def shelter_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kind_rows(spark, sf_dir).where("kind = 'shelter'").where(places.shelter_fit(F.col("shelter_type"), F.col("amenity"), F.col("name"))).select("id")


@query(f"""WITH {FACILITY_SQL}, rows_ AS (SELECT id, unnest([CASE WHEN amenity = 'hospital' THEN 'hospital' END, CASE WHEN amenity = 'clinic' THEN 'clinic' END, CASE WHEN amenity IN ('shelter', 'school') OR emergency = 'assembly_point' THEN 'shelter' END, CASE WHEN place IS NOT NULL THEN 'place' END]) AS kind, name, lon, lat FROM fac JOIN inside USING (id) WHERE inside)
SELECT min(id) AS id, kind, name FROM rows_ WHERE kind IS NOT NULL GROUP BY kind, name, lon, lat""")
def poi_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.poi_frame(kind_rows(spark, sf_dir), ring()).select("id", "kind", "name")


@query(f"WITH {FACILITY_SQL} SELECT id FROM fac WHERE amenity = 'hospital' AND EXISTS (SELECT 1 FROM fac e WHERE e.amenity = 'hospital' AND e.emergency = 'yes' AND round(e.lon, 5) = round(fac.lon, 5) AND round(e.lat, 5) = round(fac.lat, 5))")
def emergency_hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hospitals at the place of one that takes emergencies."""
    rows = kind_rows(spark, sf_dir).where("kind = 'hospital'").withColumns({"x": F.round("lon", 5), "y": F.round("lat", 5)})
    return rows.join(rows.where("emergency").select("x", "y"), ["x", "y"], "left_semi").select("id")


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged ways between numbered nodes from the orders table."""
    k = F.col("o_orderkey")
    tags = F.map_filter(F.create_map(F.lit("highway"), F.when(k % 11 != 0, _pick(HIGHWAYS, k)), F.lit("access"), F.when(k % 5 == 0, "private"), F.lit("motor_vehicle"), F.when(k % 10 == 0, "yes"), F.lit("service"), F.when(k % 13 == 0, "alley"), F.lit("area"), F.when(k % 17 == 0, "yes")), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "orders").select(k.alias("id"), tags.alias("tags"), (k % 50).alias("a"), (F.col("o_custkey") % 50).alias("b"), F.when(k % 3 == 0, "yes").when(k % 3 == 1, F.when(k % 4 == 0, "-1")).alias("oneway"), F.when(k % 19 == 0, "roundabout").alias("junction"))


WAYS_SQL = f"""ways AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN {_pick_sql(HIGHWAYS, 'o_orderkey')} END AS highway, o_orderkey % 5 = 0 AS private, o_orderkey % 10 = 0 AS permitted, o_orderkey % 13 = 0 AS alley, o_orderkey % 17 = 0 AS area,
  o_orderkey % 50 AS a, o_custkey % 50 AS b, CASE WHEN o_orderkey % 3 = 0 THEN 'yes' WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 = 0 THEN '-1' END AS oneway, CASE WHEN o_orderkey % 19 = 0 THEN 'roundabout' END AS junction FROM orders),
drive AS (SELECT * FROM ways WHERE highway IS NOT NULL AND highway NOT IN ('footway', 'track') AND NOT area AND NOT alley AND NOT (private AND NOT permitted))"""


@query(f"WITH {WAYS_SQL} SELECT id FROM drive")
def drivable_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways(spark, sf_dir).where(places.drivable()).select("id")


@query(f"""WITH {WAYS_SQL}, ends_ AS (SELECT a, b, coalesce(oneway = 'yes', false) OR junction IS NOT NULL OR highway = 'motorway' AS forward_only, coalesce(oneway = '-1', false) AS reverse_only FROM drive),
arcs AS (SELECT a AS src, b AS dst FROM ends_ WHERE NOT reverse_only UNION SELECT b, a FROM ends_ WHERE NOT forward_only)
SELECT src, dst FROM arcs WHERE src <> dst""")
def directed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.directed_edges(ways(spark, sf_dir).where(places.drivable()).select("a", "b", places.tag("highway").alias("highway"), "oneway", "junction"))


RANK_SQL = "CASE " + " ".join(f"WHEN h = '{h}' THEN {r}" for h, r in K.ROAD_RANK.items()) + " ELSE 4 END"


@query(f"""WITH {WAYS_SQL}, parts AS (SELECT id, unnest(CASE WHEN starts_with(highway, '[') THEN string_split(regexp_replace(highway, '[\\[\\]''\\s]', '', 'g'), ',') ELSE [highway] END) AS p FROM ways WHERE highway IS NOT NULL),
ranks AS (SELECT id, min({RANK_SQL}) AS rank, bool_or(p IN ('primary', 'secondary', 'tertiary')) AS shown FROM (SELECT id, p, replace(p, '_link', '') AS h FROM parts) GROUP BY id)
SELECT id, CAST(rank AS INTEGER) AS rank, CAST(CASE WHEN rank <= 0 THEN 0 WHEN rank <= 2 THEN 1 ELSE 2 END AS INTEGER) AS code, shown FROM ranks""")
def road_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ways(spark, sf_dir).select("id", places.tag("highway").alias("highway")).where("highway IS NOT NULL")
    rank = places.road_rank(F.col("highway"))
    return rows.select("id", rank.alias("rank"), places.class_code(rank).alias("code"), places.shows(F.col("highway"), ("primary", "secondary", "tertiary")).alias("shown"))


#: Spellings of one town, with composed and with combining marks, outside Latin-1 too.
TOWNS = ("Kōṭṭayam", "Köttayam", "KOTTAYAM", "Ko\u0304t\u0323t\u0323ayam", "Kozhikode", "Älvsborg Kottayam", "Sultan Bathery")


@query(f"""WITH n AS (SELECT s_suppkey AS id, {_pick_sql(TOWNS, 's_suppkey')} || ' ' || s_suppkey AS name, s_suppkey % 4 = 0 AS is_place FROM supplier), p AS (SELECT *, strip_accents(lower(name)) AS n FROM n),
f AS (SELECT id, name, CASE WHEN starts_with(n, 'kottayam 1') THEN 0e0 WHEN contains(n, ' kottayam 1') THEN 1e0 ELSE 2e0 END - CASE WHEN is_place THEN 0.6e0 ELSE 0e0 END + length(n) / 400e0 AS score FROM p WHERE contains(n, 'kottayam') AND contains(n, '1'))
SELECT id, name, round(score, 6) AS score, row_number() OVER (ORDER BY score, id) AS rank FROM f ORDER BY score, id LIMIT 8""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    names = table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(_pick(TOWNS, k), F.lit(" "), k).alias("name"), (k % 4 == 0).alias("is_place"))
    return places.suggestions(names, " Kōṭtäyam 1").withColumn("score", F.round("score", 6))


@query("""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 30) || ', 7' || (p_partkey % 10) || '.5' WHEN 1 THEN '7' || (p_partkey % 10) || '.25;' || (p_partkey % 25) WHEN 2 THEN 'near ' || p_partkey ELSE (p_partkey % 20) || ' ' || (p_partkey % 90) END AS s FROM part),
m AS (SELECT id, TRY_CAST(regexp_extract(s, '^\\s*(-?\\d+(?:\\.\\d+)?)\\s*[,;\\s]\\s*(-?\\d+(?:\\.\\d+)?)\\s*$', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(s, '^\\s*(-?\\d+(?:\\.\\d+)?)\\s*[,;\\s]\\s*(-?\\d+(?:\\.\\d+)?)\\s*$', 2) AS DOUBLE) AS b FROM t)
SELECT id, CASE WHEN a BETWEEN 5 AND 20 AND b BETWEEN 70 AND 82 THEN a WHEN b BETWEEN 5 AND 20 AND a BETWEEN 70 AND 82 THEN b END AS lat, CASE WHEN a BETWEEN 5 AND 20 AND b BETWEEN 70 AND 82 THEN b WHEN b BETWEEN 5 AND 20 AND a BETWEEN 70 AND 82 THEN a END AS lon FROM m""")
def parsed_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(k % 30, F.lit(", 7"), k % 10, F.lit(".5"))).when(k % 4 == 1, F.concat(F.lit("7"), k % 10, F.lit(".25;"), k % 25)).when(k % 4 == 2, F.concat(F.lit("near "), k)).otherwise(F.concat(k % 20, F.lit(" "), k % 90))
    found = table(spark, sf_dir, "part").select(k.alias("id"), places.coordinates(text).alias("p"))
    return found.select("id", "p.lat", "p.lon")


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html, sha256(replace(to_json(struct_pack(html := html))::VARCHAR, '</', '<\\/')) AS script_sha256 FROM pages")
def escaped_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", places.escape_html(F.col("html")).alias("html"), F.sha2(places.escape_script(F.to_json(F.struct("html"))), 256).alias("script_sha256"))
