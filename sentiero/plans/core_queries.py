"""Queries of the territorial operators over the driver's tables, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import geometry as G
from ..operators import facets, graph, indices, joins, matching, ranking, raster, transit
from ..runtime import table
from ..sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rank_sql(source: str, value: str, by: str = "") -> str:
    """Expression of the average rank percentage of a column, null for null."""
    part = f"PARTITION BY {by}, {value} IS NULL" if by else f"PARTITION BY {value} IS NULL"
    rank = f"(rank() OVER ({part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{value}) - 1) / 2.0)"
    return f"CASE WHEN {value} IS NOT NULL THEN 100.0 * {rank} / count(*) OVER ({part}) END"


SECTION_MORE = {"score_servizi": ("servizi_5_min", "servizi_15_min"), "score_trasporto_pubblico": ("passaggi_totali",), "score_residenza": ("popolazione_rif", "famiglie_rif")}
SECTION_LESS = {"score_servizi": ("tempo_associazioni_min", "tempo_cultura_min"), "score_trasporto_pubblico": ("tempo_fermata_min",), "score_facilita_territoriale": ("dislivello_sezione_m",)}
_SECTION_COLUMNS = [c for g in (*SECTION_MORE.values(), *SECTION_LESS.values()) for c in g]


def _index_sql() -> str:
    score = lambda c, more: f"coalesce({_rank_sql('s', c)}, 50.0)" if more else f"coalesce(100.0 - ({_rank_sql('s', c)}), 50.0)"
    names = {"score_servizi": "a", "score_trasporto_pubblico": "b", "score_facilita_territoriale": "c", "score_residenza": "d"}
    parts = []
    for s, short in names.items():
        cols = [score(c, True) for c in SECTION_MORE.get(s, ())] + [score(c, False) for c in SECTION_LESS.get(s, ())]
        parts.append(f"({' + '.join(cols)}) / {len(cols)}.0 AS {short}")
    cls = lambda c: f"CASE WHEN {c} <= 25 THEN 'bassa' WHEN {c} <= 50 THEN 'medio-bassa' WHEN {c} <= 75 THEN 'medio-alta' ELSE 'alta' END"
    return f"""
WITH s AS (SELECT DISTINCT sez21_id, {', '.join(_SECTION_COLUMNS)} FROM assegnazione_cluster_sezioni),
p AS (SELECT sez21_id, {', '.join(parts)} FROM s),
i AS (SELECT *, 0.40 * a + 0.35 * b + 0.25 * c AS acc FROM p),
r AS (SELECT sez21_id, round_even(a, 1) AS score_servizi, round_even(b, 1) AS score_trasporto_pubblico, round_even(c, 1) AS score_facilita_territoriale,
  round_even(d, 1) AS score_residenza, round_even(acc, 1) AS indice_accessibilita, round_even(0.65 * acc + 0.35 * d, 1) AS indice_sociofunzionale FROM i)
SELECT *, {cls('indice_accessibilita')} AS classe_accessibilita, {cls('indice_sociofunzionale')} AS classe_sociofunzionale FROM r"""


@query(_index_sql())
def index_composite_sections(spark: SparkSession, d: str) -> DataFrame:
    """Scores, indices and classes of census sections."""
    sections = table(spark, d, "assegnazione_cluster_sezioni").select("sez21_id", *_SECTION_COLUMNS).distinct()
    return indices.composite_index(sections, "sez21_id", SECTION_MORE, SECTION_LESS)


@query(f"""WITH x AS (SELECT c_custkey, c_nationkey, {_rank_sql('customer', 'c_acctbal', 'c_nationkey')} AS p FROM customer)
SELECT c_custkey, round_even(p, 4) AS score, round_even(100.0 - p, 4) AS inverse FROM x""")
def percentile_score_customers(spark: SparkSession, d: str) -> DataFrame:
    """Average-rank scores by nation, both directions."""
    c = table(spark, d, "customer")
    up = ranking.percentile_score(c, "c_acctbal", "score", ["c_nationkey"], constant=None)
    both = ranking.percentile_score(up, "c_acctbal", "inverse", ["c_nationkey"], higher_is_better=False, constant=None)
    return both.select("c_custkey", F.bround("score", 4).alias("score"), F.bround("inverse", 4).alias("inverse"))


@query(f"""WITH x AS (SELECT p_partkey, {_rank_sql('part', 'p_retailprice')} AS p FROM part)
SELECT p_partkey, CASE WHEN p <= 25 THEN 'Q1' WHEN p <= 50 THEN 'Q2' WHEN p <= 75 THEN 'Q3' ELSE 'Q4' END AS quartile FROM x""")
def quartile_class_parts(spark: SparkSession, d: str) -> DataFrame:
    """Quartile classes of the rank percentage."""
    scored = ranking.percentile_score(table(spark, d, "part"), "p_retailprice", "pct")
    return scored.select("p_partkey", ranking.rank_quartile(F.col("pct")).alias("quartile"))


@query("""WITH m AS (SELECT median(s_acctbal) AS m FROM supplier), d AS (SELECT median(abs(s_acctbal - m)) AS mad FROM supplier, m)
SELECT s_suppkey, round_even(0.67448975 * (s_acctbal - m) / mad, 6) AS z FROM supplier, m, d""")
def robust_z_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Robust z-scores."""
    return ranking.robust_z(table(spark, d, "supplier"), "s_acctbal", "z").select("s_suppkey", F.bround("z", 6).alias("z"))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, round_even(ln(1 + greatest(least(l_extendedprice, hi), lo)), 6) AS price FROM lineitem, q""")
def winsorize_log_price(spark: SparkSession, d: str) -> DataFrame:
    """Values held within their 1 % and 99 % quantiles, then log1p."""
    w = ranking.log_scale(ranking.winsorize(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"]), ["l_extendedprice"])
    return w.select("l_orderkey", "l_linenumber", F.bround("l_extendedprice", 6).alias("price"))


@query("""WITH q AS (SELECT quantile_cont(p_size, [0.25, 0.5, 0.75]) AS a, quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS b FROM part)
SELECT p_partkey, round_even((p_size - a[2]) / (a[3] - a[1]), 6) AS size, round_even((p_retailprice - b[2]) / (b[3] - b[1]), 6) AS price FROM part, q""")
def robust_scale_parts(spark: SparkSession, d: str) -> DataFrame:
    """Median-imputed, interquartile-scaled features (L1 L2)."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    s = ranking.robust_scale(ranking.impute_median(p, ["size", "price"]), ["size", "price"])
    return s.select("p_partkey", F.bround("size", 6).alias("size"), F.bround("price", 6).alias("price"))


@query("""WITH e AS (SELECT user_id, event_type, (epoch_us(ts) % 86400000000) / 1000000.0 AS s FROM events), w AS (SELECT * FROM e WHERE s BETWEEN 25200 AND 72000)
SELECT user_id, count(*) AS passaggi, round_even(min(s), 3) AS prima_s, round_even(max(s), 3) AS ultima_s,
  CASE WHEN count(*) > 1 THEN round_even((max(s) - min(s)) / 60 / (count(*) - 1), 4) END AS frequenza_media_min, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS linee
FROM w GROUP BY user_id""")
def stop_passages_headway(spark: SparkSession, d: str) -> DataFrame:
    """Passages, headway and line list per key within a closed time window (A1 A2 P5)."""
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("line"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.extract(F.lit("SECOND"), F.col("ts")).cast("double")).alias("seconds"))
    p = transit.stop_passages(e, 25_200, 72_000, ["user_id"])
    return p.select("user_id", "passaggi", F.bround("prima_s", 3).alias("prima_s"), F.bround("ultima_s", 3).alias("ultima_s"), F.bround("frequenza_media_min", 4).alias("frequenza_media_min"), "linee")


@query("""WITH x AS (SELECT c_nationkey AS section_id, o_orderkey AS stop_id, CASE WHEN o_orderstatus = 'O' THEN 'urbano' ELSE 'extraurbano' END AS feed, o_orderpriority AS line FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT n_nationkey AS section_id, coalesce(string_agg(DISTINCT line, ' | ' ORDER BY line) FILTER (feed = 'urbano'), '') AS linee_urbano, count(DISTINCT stop_id) FILTER (feed = 'urbano') AS fermate_urbano,
  coalesce(string_agg(DISTINCT line, ' | ' ORDER BY line) FILTER (feed = 'extraurbano'), '') AS linee_extraurbano, count(DISTINCT stop_id) FILTER (feed = 'extraurbano') AS fermate_extraurbano
FROM nation LEFT JOIN x ON section_id = n_nationkey GROUP BY n_nationkey""")
def lines_by_section(spark: SparkSession, d: str) -> DataFrame:
    """Line lists and stop counts per section and feed, empty sections kept."""
    stops = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("section_id"), F.col("o_orderkey").alias("stop_id"), F.when(F.col("o_orderstatus") == "O", "urbano").otherwise("extraurbano").alias("feed"), F.col("o_orderpriority").alias("linee"))
    return transit.lines_by_section(stops, table(spark, d, "nation").select(F.col("n_nationkey").alias("section_id")), ["urbano", "extraurbano"])


_CALENDAR = """SELECT o_custkey AS service_id, strftime(min(o_orderdate), '%Y%m%d') AS start_date, strftime(max(o_orderdate), '%Y%m%d') AS end_date, o_custkey % 7 AS off FROM orders GROUP BY o_custkey"""


@query(f"""WITH c AS ({_CALENDAR}), d AS (SELECT unnest(['19960315', '19960316', '19970609']) AS date),
x AS (SELECT date, service_id FROM c, d WHERE date BETWEEN start_date AND end_date AND isodow(strptime(date, '%Y%m%d')) - 1 <> off),
e AS (SELECT DISTINCT o_custkey AS service_id, strftime(l_shipdate, '%Y%m%d') AS date, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 2 END AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT date, service_id FROM (SELECT * FROM x UNION SELECT date, service_id FROM e WHERE t = 1 AND date IN (SELECT date FROM d)) u
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.t = 2 AND e.date = u.date AND e.service_id = u.service_id)""")
def service_active_dates(spark: SparkSession, d: str) -> DataFrame:
    """Calendar with added and removed dates."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    cal = o.groupBy(F.col("o_custkey").alias("service_id")).agg(F.date_format(F.min("o_orderdate"), "yyyyMMdd").alias("start_date"), F.date_format(F.max("o_orderdate"), "yyyyMMdd").alias("end_date"))
    cal = cal.select("*", *[F.when(F.col("service_id") % 7 == i, "0").otherwise("1").alias(day) for i, day in enumerate(transit.WEEKDAYS)])
    exc = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("service_id"), F.date_format("l_shipdate", "yyyyMMdd").alias("date"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(2).alias("exception_type")).distinct()
    return transit.active_services(cal, exc, spark.createDataFrame([("19960315",), ("19960316",), ("19970609",)], "date string"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN printf('%02d:%02d:%02d', 20 + event_id % 9, event_id % 60, (event_id * 7) % 60) WHEN 1 THEN '7:60:00' WHEN 2 THEN '' WHEN 3 THEN 'abc' ELSE printf('%d:%02d:%02d', event_id % 24, event_id % 60, 0) END AS t FROM events),
y AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN (20 + event_id % 9) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60 WHEN 4 THEN (event_id % 24) * 3600 + (event_id % 60) * 60 END AS s FROM x)
SELECT event_id, CAST(s AS DOUBLE) AS s, printf('%02d:%02d', CAST(round_even(s / 60.0, 0) AS INT) // 60, CAST(round_even(s / 60.0, 0) AS INT) % 60) AS hhmm,
  CASE WHEN s / 3600.0 <= 5 AND s > 0 THEN '0-5' WHEN s > 0 AND s / 3600.0 <= 10 THEN '5-10' WHEN s > 0 AND s / 3600.0 <= 15 THEN '10-15' WHEN s > 0 AND s / 3600.0 <= 20 THEN '15-20' WHEN s > 0 THEN '>20' END AS fascia,
  CASE WHEN s / 3600.0 <= 10 THEN 1 ELSE 0 END AS entro_10 FROM y""")
def clock_parse_and_bands(spark: SparkSession, d: str) -> DataFrame:
    """Clock texts with hours past 24 and invalid ones, bands and flags."""
    i = F.col("event_id")
    text = F.when(i % 5 == 0, F.format_string("%02d:%02d:%02d", 20 + i % 9, i % 60, (i * 7) % 60)).when(i % 5 == 1, "7:60:00").when(i % 5 == 2, "").when(i % 5 == 3, "abc").otherwise(F.format_string("%d:%02d:00", i % 24, i % 60))
    e = table(spark, d, "events").select("event_id", X.clock_seconds(text).alias("s"))
    hours = F.col("s") / 3600
    return e.select("event_id", "s", X.clock_text(F.col("s")).alias("hhmm"), X.time_band(hours).alias("fascia"), X.within_flag(hours, 10).alias("entro_10"))


@query("""WITH f AS (SELECT o_custkey, bool_or(o_totalprice > 200000) AS crosses, bool_or(o_orderstatus = 'F') AS inner_stop, bool_or(o_orderpriority = '1-URGENT') AS outer_stop FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN coalesce(crosses, false) AND coalesce(inner_stop, false) THEN 'attraversa_con_fermata_interna' WHEN coalesce(crosses, false) THEN 'attraversa_senza_fermata_interna'
  WHEN coalesce(inner_stop, false) THEN 'fermata_interna' WHEN coalesce(outer_stop, false) THEN 'solo_fermata_esterna_accessibile' ELSE 'non_pertinente' END AS relazione FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def route_relation_case(spark: SparkSession, d: str) -> DataFrame:
    """Any-flags per route, left-joined, as a chain of cases."""
    f = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 200000).alias("c"), F.bool_or(F.col("o_orderstatus") == "F").alias("i"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("o"))
    j = table(spark, d, "customer").join(f, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", transit.route_relation(F.col("c"), F.col("i"), F.col("o")).alias("relazione"))


@query("""WITH o AS (SELECT o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
SELECT CAST(c_custkey AS VARCHAR) AS chiave, o_custkey IS NOT NULL AS trovato, coalesce(o_totalprice, c_acctbal, 0) AS valore FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def census_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Left join to the first row of each normalised key with a match flag and fallbacks."""
    left = table(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("k"), "c_acctbal")
    right = table(spark, d, "orders").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("k"), "o_orderkey", "o_totalprice")
    j = joins.join_first(left, right, "k", "o_orderkey")
    return j.select("chiave", "trovato", F.coalesce(X.first_number(F.col("o_totalprice"), F.col("c_acctbal")), F.lit(0.0)).alias("valore"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def census_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a match."""
    return joins.unmatched(table(spark, d, "customer").withColumn("k", F.col("c_custkey")), table(spark, d, "orders").where("o_totalprice > 250000").withColumn("k", F.col("o_custkey")), "k").select("c_custkey", "c_name")


@query("""SELECT n_name, count(*) FILTER (c_acctbal <= 0) AS entro_0, count(*) FILTER (c_acctbal <= 5000) AS entro_5000, round_even(sum(CASE WHEN c_acctbal <= 5000 THEN c_acctbal ELSE 0 END), 2) AS somma FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def threshold_population(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts and sums per group."""
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count_if(F.col("c_acctbal") <= 0).alias("entro_0"), F.count_if(F.col("c_acctbal") <= 5000).alias("entro_5000"), F.bround(F.sum(F.when(F.col("c_acctbal") <= 5000, F.col("c_acctbal")).otherwise(0.0)), 2).alias("somma"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings), c AS (SELECT label AS node, avg(x) AS nx, avg(y) AS ny FROM e GROUP BY label),
p AS (SELECT vec_id, node, sqrt((x - nx) ** 2 + (y - ny) ** 2) AS d FROM e, c)
SELECT vec_id AS id, node, round_even(d, 6) AS metri FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, node) = 1""")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Nearest node of each point, searched in widening rings of grid cells."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")
    nodes = e.groupBy(F.col("label").alias("node")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("ord", F.col("node"))
    return graph.nearest_node(e, nodes, 0.25).select("id", "node", F.bround("metri", 6).alias("metri"))


@query("""WITH p AS (SELECT n_nationkey AS k, 40 + n_nationkey * 0.5 AS lat, 7 + (n_nationkey * 7 % 11) * 0.3 AS lon FROM nation)
SELECT a.k AS a, b.k AS b, round_even(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS metri FROM p a JOIN p b ON b.k = a.k + 1""")
def haversine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Great-circle distances (M7)."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (40 + F.col("n_nationkey") * 0.5).alias("lat"), (7 + (F.col("n_nationkey") * 7 % 11) * 0.3).alias("lon"))
    a, b = n.select(*[F.col(c).alias(f"a_{c}") for c in n.columns]), n.select(*[F.col(c).alias(f"b_{c}") for c in n.columns])
    return a.join(b, F.col("b_k") == F.col("a_k") + 1).select(F.col("a_k").alias("a"), F.col("b_k").alias("b"), F.bround(X.haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")), 3).alias("metri"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity * 10 AS len, (l_discount - 0.05) * l_quantity * 20 AS dz FROM lineitem),
g AS (SELECT *, CASE WHEN len > 0 THEN greatest(least(dz / len, 1.5), -1.5) ELSE 0 END AS grade FROM s)
SELECT l_orderkey, l_linenumber, round_even(grade, 6) AS grade, round_even(6 * exp(-3.5 * abs(grade + 0.05)), 6) AS kmh, round_even(greatest(dz, 0), 6) AS salita, round_even(len / (greatest(6 * exp(-3.5 * abs(grade + 0.05)), 0.5) / 3.6), 4) AS secondi FROM g""")
def tobler_edges(spark: SparkSession, d: str) -> DataFrame:
    """Grades, walking speeds, gains and times of edges (M1 M4 M5)."""
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 10).alias("len"), ((F.col("l_discount") - 0.05) * F.col("l_quantity") * 20).alias("dz"))
    g = s.withColumn("grade", X.grade(F.col("dz"), F.col("len")))
    return g.select("l_orderkey", "l_linenumber", F.bround("grade", 6).alias("grade"), F.bround(X.tobler_kmh(F.col("grade")), 6).alias("kmh"), F.bround(F.greatest(F.col("dz"), F.lit(0.0)), 6).alias("salita"), F.bround(F.col("len") / (X.tobler_kmh(F.col("grade"), 0.5) / 3.6), 4).alias("secondi"))


def _nation_edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"))
    return n.select("src", F.explode(F.array((F.col("src") * 7 + 3) % 25, (F.col("src") + 1) % 25)).alias("dst")).withColumn("t", (1 + (F.col("src") * 3 + F.col("dst")) % 5).cast("double")).where("src <> dst")


@query("""WITH RECURSIVE e AS (SELECT src, dst, CAST(1 + (src * 3 + dst) % 5 AS DOUBLE) AS t FROM (SELECT n_nationkey AS src, unnest([(n_nationkey * 7 + 3) % 25, (n_nationkey + 1) % 25]) AS dst FROM nation) WHERE src <> dst),
r AS (SELECT s_nationkey AS source, s_nationkey AS id, 0.0::DOUBLE AS cost FROM (SELECT DISTINCT s_nationkey FROM supplier) UNION
  SELECT source, dst, cost + t FROM r JOIN e ON r.id = e.src WHERE cost + t <= 8)
SELECT source, id, min(cost) AS cost FROM r GROUP BY source, id""")
def shortest_path_reach(spark: SparkSession, d: str) -> DataFrame:
    """Bounded single-source costs from several sources."""
    seeds = table(spark, d, "supplier").select(F.col("s_nationkey").alias("source"), F.col("s_nationkey").alias("id"), F.lit(0.0).alias("cost")).distinct()
    return graph.shortest_paths(_nation_edges(spark, d), seeds, cutoff=8.0).select("source", "id", "cost")


@query("""WITH RECURSIVE e AS (SELECT src, dst, CAST(1 + (src * 3 + dst) % 5 AS DOUBLE) AS t FROM (SELECT n_nationkey AS src, unnest([(n_nationkey * 7 + 3) % 25, (n_nationkey + 1) % 25]) AS dst FROM nation) WHERE src <> dst),
r AS (SELECT n_nationkey AS target, n_nationkey AS id, 0.0::DOUBLE AS cost FROM nation WHERE n_regionkey = 2 UNION SELECT target, src, cost + t FROM r JOIN e ON r.id = e.dst WHERE cost + t <= 20)
SELECT id, min(cost) AS cost, arg_min(target, (cost, target)) AS via FROM r GROUP BY id""")
def nearest_target(spark: SparkSession, d: str) -> DataFrame:
    """Cost to the closest of many targets and which one: one search over turned edges."""
    seeds = table(spark, d, "nation").where("n_regionkey = 2").select(F.lit(0).alias("source"), F.col("n_nationkey").alias("id"), F.lit(0.0).alias("cost"))
    return graph.shortest_paths(graph.reverse(_nation_edges(spark, d)), seeds).select("id", "cost", "via")


@query("""WITH RECURSIVE e AS (SELECT src, dst, CAST(1 + (src * 3 + dst) % 5 AS DOUBLE) AS t FROM (SELECT n_nationkey AS src, unnest([(n_nationkey * 7 + 3) % 25, (n_nationkey + 1) % 25]) AS dst FROM nation) WHERE src <> dst),
r AS (SELECT n_nationkey AS source, n_nationkey AS id, 0.0::DOUBLE AS cost FROM nation UNION SELECT source, dst, cost + t FROM r JOIN e ON r.id = e.src WHERE cost + t <= 15),
b AS (SELECT source, id, min(cost) AS cost FROM r GROUP BY source, id), p AS (SELECT s_nationkey AS id, count(*) AS m FROM supplier GROUP BY s_nationkey)
SELECT source, CAST(coalesce(sum(m) FILTER (cost <= 5), 0) AS BIGINT) AS entro_5, CAST(coalesce(sum(m) FILTER (cost <= 10), 0) AS BIGINT) AS entro_10, CAST(coalesce(sum(m) FILTER (cost <= 15), 0) AS BIGINT) AS entro_15 FROM b JOIN p USING (id) GROUP BY source""")
def reach_counts(spark: SparkSession, d: str) -> DataFrame:
    """Targets reached within limits, repeated ones counted each."""
    seeds = table(spark, d, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_nationkey").alias("id"), F.lit(0.0).alias("cost"))
    return graph.reach_counts(graph.shortest_paths(_nation_edges(spark, d), seeds, cutoff=15.0), table(spark, d, "supplier").select(F.col("s_nationkey").alias("id")))


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), z AS (SELECT unnest(generate_series(0, 5)) AS zone), r AS (SELECT zone, -0.3 + zone * 0.1 AS cx, 0.02 * zone AS cy, 0.15 AS h FROM z)
SELECT zone, count(vec_id) AS punti FROM r JOIN e ON abs(x - cx) + abs(y - cy) < h GROUP BY zone""")
def point_in_polygon_count(spark: SparkSession, d: str) -> DataFrame:
    """Points strictly inside diamond-shaped zones."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    z = spark.range(6).select(F.col("id").alias("zone"), (-0.3 + F.col("id") * 0.1).alias("cx"), (0.02 * F.col("id")).alias("cy"))
    ring = F.array(G.point(F.col("cx") - 0.15, F.col("cy")), G.point(F.col("cx"), F.col("cy") - 0.15), G.point(F.col("cx") + 0.15, F.col("cy")), G.point(F.col("cx"), F.col("cy") + 0.15))
    zones = z.select("zone", ring.alias("ring")).withColumn("b", G.bounds(F.col("ring")))
    # The zones are a fixed few; box first, ring after.
    near = e.join(F.broadcast(zones), F.col("x").between(F.col("b.x0"), F.col("b.x1")) & F.col("y").between(F.col("b.y0"), F.col("b.y1")))
    return near.where(G.within(F.col("ring"), F.col("x"), F.col("y"))).groupBy("zone").agg(F.count("*").alias("punti"))


@query("""SELECT s_suppkey, CAST(20 * (1 + s_suppkey % 9) AS DOUBLE) AS area, CAST(2 * (10 + 2 * (1 + s_suppkey % 9)) AS DOUBLE) AS perimetro, CAST(s_suppkey + 5 AS DOUBLE) AS cx, CAST(s_nationkey + 1 + s_suppkey % 9 AS DOUBLE) AS cy FROM supplier""")
def ring_measures(spark: SparkSession, d: str) -> DataFrame:
    """Area, perimeter and centre of rectangles."""
    x, y, h = F.col("s_suppkey"), F.col("s_nationkey"), 2 * (1 + F.col("s_suppkey") % 9)
    s = table(spark, d, "supplier").withColumn("ring", F.array(G.point(x, y), G.point(x + 10, y), G.point(x + 10, y + h), G.point(x, y + h)))
    c = G.centroid(F.col("ring"))
    return s.select("s_suppkey", G.area(F.col("ring")).alias("area"), G.perimeter(F.col("ring")).alias("perimetro"), F.bround(c["x"], 6).alias("cx"), F.bround(c["y"], 6).alias("cy"))


_GRID = "SELECT p_partkey // 40 AS r, p_partkey % 40 AS c, p_retailprice AS v FROM part"


@query(f"""WITH p AS ({_GRID}), g AS (SELECT a.r, a.c, a.v, e.v AS e, w.v AS w, s.v AS s, n.v AS n FROM p a LEFT JOIN p e ON e.r = a.r AND e.c = a.c + 1 LEFT JOIN p w ON w.r = a.r AND w.c = a.c - 1 LEFT JOIN p s ON s.r = a.r + 1 AND s.c = a.c LEFT JOIN p n ON n.r = a.r - 1 AND n.c = a.c),
z AS (SELECT r, c, CASE WHEN e IS NOT NULL AND w IS NOT NULL THEN (e - w) / 20 WHEN e IS NOT NULL THEN (e - v) / 10 WHEN w IS NOT NULL THEN (v - w) / 10 END AS dx, CASE WHEN s IS NOT NULL AND n IS NOT NULL THEN (s - n) / 20 WHEN s IS NOT NULL THEN (s - v) / 10 WHEN n IS NOT NULL THEN (v - n) / 10 END AS dy FROM g)
SELECT r AS "row", c AS col, round_even(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS gradi, round_even(100 * sqrt(dx * dx + dy * dy), 6) AS percento FROM z WHERE dx IS NOT NULL AND dy IS NOT NULL""")
def raster_slope_grid(spark: SparkSession, d: str) -> DataFrame:
    """Slope of a pixel table by central differences."""
    px = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).alias("row"), (F.col("p_partkey") % 40).alias("col"), F.col("p_retailprice").alias("v"))
    g = raster.gradient(px, 10.0).where("dz_dx is not null and dz_dy is not null")
    return g.select("row", "col", F.bround(raster.slope_degrees(F.col("dz_dx"), F.col("dz_dy")), 6).alias("gradi"), F.bround(raster.slope_percent(F.col("dz_dx"), F.col("dz_dy")), 6).alias("percento"))


@query("""SELECT s_suppkey AS zone, count(l_quantity) AS n, min(l_quantity) AS minimo, quantile_cont(l_quantity, 0.25) AS p25, round_even(avg(l_quantity), 6) AS media, quantile_cont(l_quantity, 0.5) AS mediana, quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS massimo, round_even(stddev_pop(l_quantity), 6) AS dev
FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey""")
def zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of pixels by zone, empty zones kept."""
    px = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("zone"), F.col("l_quantity").alias("v"))
    z = raster.zonal_stats(px, table(spark, d, "supplier").select(F.col("s_suppkey").alias("zone")))
    return z.withColumn("media", F.bround("media", 6)).withColumn("dev", F.bround("dev", 6))


@query("""WITH t AS (SELECT l_linenumber % 3 AS rank, l_orderkey % 200 AS r, l_partkey % 20 AS c, floor(l_extendedprice) AS v, l_orderkey, l_linenumber FROM lineitem), o AS (SELECT r, c, rank, max(v) AS v FROM t GROUP BY r, c, rank), m AS (SELECT r, c, arg_min(v, rank) AS v FROM o GROUP BY r, c)
SELECT r // 4 AS "row", c // 4 AS col, round_even(avg(v), 6) AS v FROM m GROUP BY 1, 2""")
def raster_mosaic_overview(spark: SparkSession, d: str) -> DataFrame:
    """First tile wins on overlaps, then block means."""
    t = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 200).alias("row"), (F.col("l_partkey") % 20).alias("col"), (F.col("l_linenumber") % 3).alias("rank")).agg(F.max(F.floor("l_extendedprice").cast("double")).alias("v"))
    return raster.overview(raster.mosaic(t), 4).select(F.col("row").cast("bigint"), F.col("col").cast("bigint"), F.bround("v", 6).alias("v"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS snake, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS words, regexp_replace(upper(trim(p_partkey || '.0')), '\\.0$', '') AS route FROM part""")
def name_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Normalised names, words and route names."""
    return table(spark, d, "part").select("p_partkey", X.snake_name(F.col("p_name")).alias("snake"), X.plain_words(F.col("p_name")).alias("words"), X.route_name(F.concat(F.col("p_partkey").cast("string"), F.lit(".0"))).alias("route"))


@query("""WITH c AS (SELECT DISTINCT service_row, rank AS r0, score, poi_id FROM servizi_povo_candidati_match WHERE score IS NOT NULL), o AS (SELECT service_row, poi_id, score, row_number() OVER w AS rank, score - lead(score, 1, 0.0) OVER w AS gap FROM (SELECT service_row, poi_id, max(score) AS score FROM c GROUP BY 1, 2) WINDOW w AS (PARTITION BY service_row ORDER BY score DESC, poi_id DESC))
SELECT service_row, poi_id, CAST(rank AS INTEGER) AS rank, score, round_even(gap, 6) AS gap, CASE WHEN score >= 86 AND (gap >= 4 OR score >= 94) THEN 'automatico' ELSE 'da_verificare' END AS stato FROM o WHERE rank <= 3""")
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Best candidates per service with gap and status."""
    c = table(spark, d, "servizi_povo_candidati_match").where("score is not null").groupBy("service_row", "poi_id").agg(F.max("score").alias("score"))
    t = ranking.top_per_key(c, ["service_row"], "score", F.desc("poi_id"), 3)
    return t.select("service_row", "poi_id", "rank", "score", F.bround("gap", 6).alias("gap"), matching.match_status(F.col("score"), F.col("gap")).alias("stato"))


@query()
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Token-set, weighted and partial ratios of services against POIs, five best each."""
    t = table(spark, d, "servizi_povo_candidati_match")
    s = t.select("service_row", X.plain_words(F.col("service_name")).alias("name"), X.plain_words(F.col("service_address")).alias("address")).distinct()
    p = t.select("poi_id", X.plain_words(F.col("poi_name")).alias("name"), X.plain_words(F.col("poi_address")).alias("address")).distinct()
    return matching.fuzzy_candidates(s, p, 60.0, 5)


@query()
def external_matches(spark: SparkSession, d: str) -> DataFrame:
    """Best row of the municipality's POIs for each POI of the other sources, by name ratio and nearness, with distance and
    status (F17 J13 P12)."""
    t = table(spark, d, "servizi_povo_candidati_match").where("latitude is not null")
    pois = t.select("poi_id", "poi_source", X.plain_words(F.col("poi_name")).alias("name"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).distinct()
    of_base = F.col("poi_source") == "poi_mappa_comunale.csv"
    base, ext = pois.where(of_base).withColumnRenamed("poi_id", "base_id"), pois.where(~of_base).withColumnRenamed("poi_id", "ext_id")
    best = matching.best_external(base, ext)
    at = lambda df, key, s: df.groupBy(key).agg(F.min(F.struct("lat", "lon")).alias(s))
    placed = best.join(at(ext, "ext_id", "a"), "ext_id").join(at(base, "base_id", "b"), "base_id", "left")
    metres = X.haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return placed.select("ext_id", "base_id", "score", F.bround(metres, 1).alias("metri"), matching.external_status(F.col("score"), metres).alias("stato"))


@query("""SELECT n_nationkey, 1 AS posizione, '/doc/' || n_name || '.pdf' AS url, n_name || '.pdf' AS file FROM nation UNION ALL SELECT n_nationkey, 2, 'https://example.org/n?id=' || n_nationkey, 'n' FROM nation""")
def html_link_extract(spark: SparkSession, d: str) -> DataFrame:
    """Distinct link targets of stored HTML in order, and file names."""
    html = F.concat(F.lit('<p><a class="x" href="/doc/'), F.col("n_name"), F.lit('.pdf">a</a> <A HREF=\'https://example.org/n?id='), F.col("n_nationkey").cast("string"), F.lit("'>b</A><a href=\"/doc/"), F.col("n_name"), F.lit('.pdf">c</a></p>'))
    pages = table(spark, d, "nation").withColumn("html", html)
    links = readers.html_links(pages, "n_nationkey", "html")
    url = F.when(F.col("url").startswith("/"), F.concat(F.lit("https://example.org"), F.regexp_replace("url", " ", "%20"))).otherwise(F.col("url"))
    return links.withColumn("file", F.regexp_replace(readers.file_name(F.lit(""), url), "%20", " "))


@query("""WITH o AS (SELECT o_orderstatus AS stato, o_orderpriority AS priorita, CASE WHEN o_totalprice > 200000 THEN 'alto' WHEN o_totalprice > 50000 THEN 'medio' END AS prezzo FROM orders),
f AS (SELECT coalesce(stato, 'Non classificato') AS stato, coalesce(priorita, 'Non classificato') AS priorita, coalesce(prezzo, 'Non classificato') AS prezzo FROM o),
u AS (SELECT 'stato' AS dimensione, stato AS valore, count(*) AS n FROM f WHERE priorita IN ('1-URGENT', '2-HIGH') GROUP BY 2 UNION ALL SELECT 'priorita', priorita, count(*) FROM f WHERE stato IN ('O') GROUP BY 2 UNION ALL SELECT 'prezzo', prezzo, count(*) FROM f WHERE stato IN ('O') AND priorita IN ('1-URGENT', '2-HIGH') GROUP BY 2)
SELECT *, n / sum(n) OVER (PARTITION BY dimensione) AS quota FROM u""")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per facet under the other facets' filters, with shares."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("stato"), F.col("o_orderpriority").alias("priorita"), F.when(F.col("o_totalprice") > 200000, "alto").when(F.col("o_totalprice") > 50000, "medio").alias("prezzo"))
    return facets.facet_counts(o, ["stato", "priorita", "prezzo"], {"stato": ["O"], "priorita": ["1-URGENT", "2-HIGH"], "prezzo": []})


@query("""WITH s AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part), k AS (SELECT unnest(generate_series(0, 7)) AS k)
SELECT CAST(min(k) AS INTEGER) AS classe, v AS soglia FROM s JOIN k ON i = floor((n - 1) * k / 7.0 + 0.5) GROUP BY v""")
def quantile_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank class breaks."""
    return ranking.quantile_breaks(table(spark, d, "part"), "p_retailprice", 7)


@query("""SELECT c_custkey, replace(printf('%.1f', round_even(c_acctbal, 1)), '.', ',') || ' m' AS quota, CAST(c_custkey % 4 AS VARCHAR) || CASE WHEN c_custkey % 4 = 1 THEN ' servizio' ELSE ' servizi' END AS conto FROM customer""")
def italian_labels(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with decimal commas and counted nouns."""
    return table(spark, d, "customer").select("c_custkey", X.decimal_comma(F.col("c_acctbal"), 1, " m").alias("quota"), X.count_label((F.col("c_custkey") % 4).cast("double"), "servizio", "servizi").alias("conto"))


@query("""SELECT user_id, event_type AS giorno, CAST(hour(ts) AS INTEGER) AS ora, CAST(count(*) AS INTEGER) AS percentuale FROM events GROUP BY ALL""")
def unpivot_long(spark: SparkSession, d: str) -> DataFrame:
    """Nested days of hourly values as rows."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.array(*[F.count_if(F.hour("ts") == h).cast("int") for h in range(24)]).alias("data"))
    nested = e.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("name"), "data")).alias("days"))
    return readers.popular_times(nested, "user_id", "days").where("percentuale > 0")


@query("""SELECT p_partkey, 'N' || p_partkey AS name, p_partkey % 90 + 0.5 AS lat, p_partkey % 180 + 0.25 AS lon FROM part""")
def json_elements(spark: SparkSession, d: str) -> DataFrame:
    """POI elements in JSON: name fallback, point or centre."""
    k = F.col("p_partkey").cast("string")
    lat, lon = ((F.col("p_partkey") % 90 + 0.5).cast("string")), ((F.col("p_partkey") % 180 + 0.25).cast("string"))
    node = F.concat(F.lit('{"elements":[{"type":"node","id":'), k, F.lit(',"lat":'), lat, F.lit(',"lon":'), lon, F.lit(',"tags":{"name":" ","brand":"N'), k, F.lit('","shop":"x"}}]}'))
    way = F.concat(F.lit('{"elements":[{"type":"way","id":'), k, F.lit(',"center":{"lat":'), lat, F.lit(',"lon":'), lon, F.lit('},"tags":{"name":"N'), k, F.lit('"}}]}'))
    raw = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, node).otherwise(way).alias("value"))
    return readers.osm_elements(raw).select(F.col("id").alias("p_partkey"), "name", "lat", "lon")


@query("""SELECT cluster_v3, count(*) AS n, round_even(avg(popolazione_rif), 4) AS popolazione_rif, round_even(avg(servizi_15_min), 4) AS servizi_15_min FROM (SELECT DISTINCT sez21_id, cluster_v3, popolazione_rif, servizi_15_min FROM assegnazione_cluster_sezioni WHERE cluster_v3 IS NOT NULL) GROUP BY cluster_v3""")
def cluster_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Means and sizes by cluster."""
    from ..operators.clustering import profiles

    a = table(spark, d, "assegnazione_cluster_sezioni").select("sez21_id", "cluster_v3", "popolazione_rif", "servizi_15_min").where("cluster_v3 is not null").distinct()
    return profiles(a, "cluster_v3", ["popolazione_rif", "servizi_15_min"]).select("cluster_v3", "n", F.bround("popolazione_rif", 4).alias("popolazione_rif"), F.bround("servizi_15_min", 4).alias("servizi_15_min"))


@query()
def ward_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Ward's hierarchy and silhouette over nation profiles."""
    from ..operators.clustering import ward_groups

    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"), F.count("*").cast("double").alias("n"), F.stddev_pop("c_acctbal").alias("s"))
    return ward_groups(ranking.robust_scale(c, ["a", "n", "s"]), "c_nationkey", ["a", "n", "s"], 4)


@query()
def kmeans_profiles(spark: SparkSession, d: str) -> DataFrame:
    """k-means on standardised features with restarts (L3)."""
    from ..operators.clustering import kmeans_groups

    vectors = table(spark, d, "embeddings")
    wide = vectors.agg(F.max(F.size("embedding"))).first()[0]
    e = vectors.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(wide)])
    return kmeans_groups(e, "vec_id", [f"e{i}" for i in range(wide)], 4)


@query()
def merge_stops(spark: SparkSession, d: str) -> DataFrame:
    """Stops merged greedily within 35 m in order of their id, with a summary per cluster."""
    from ..functions.coords import position_of, usual_region

    stops = table(spark, d, "fermate_gtfs")
    region = usual_region(stops, F.col("stop_lat"), F.col("stop_lon"))
    s = stops.select(F.col("stop_id").cast("bigint").alias("id"), "stop_name", F.col("feed_source").alias("feed"), "passaggi", position_of(F.col("stop_lat"), F.col("stop_lon"), region).alias("p")).where("p is not null").distinct()
    s = s.select("id", F.col("id").alias("ord"), "stop_name", "feed", "passaggi", G.to_metric(F.col("p.lat"), F.col("p.lon")).alias("m")).select("*", "m.x", "m.y").drop("m")
    one = ranking.deduplicate(s, ["id"], "stop_name")
    return transit.cluster_summary(one.join(transit.merge_stops(one.select("id", "ord", "x", "y")), "id"))


@query("""SELECT 'clienti' AS indicatore, CAST(count(*) AS DOUBLE) AS valore FROM customer UNION ALL SELECT 'saldo_medio', round_even(avg(c_acctbal), 4) FROM customer UNION ALL SELECT 'saldo_mediano', median(c_acctbal) FROM customer UNION ALL SELECT 'saldo_p90', quantile_cont(c_acctbal, 0.9) FROM customer""")
def summary_key_value(spark: SparkSession, d: str) -> DataFrame:
    """A one-row summary as key and value (K5 K6)."""
    one = table(spark, d, "customer").agg(F.count("*").alias("clienti"), F.bround(F.avg("c_acctbal"), 4).alias("saldo_medio"), F.median("c_acctbal").alias("saldo_mediano"), F.percentile("c_acctbal", F.lit(0.9)).alias("saldo_p90"))
    return facets.unpivot_summary(one)


@query("""SELECT p_partkey, CASE WHEN row_number() OVER w = 1 THEN p_brand ELSE p_brand || '_' || row_number() OVER w END AS nome FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)""")
def numbered_names(spark: SparkSession, d: str) -> DataFrame:
    """Repeated names numbered in order."""
    return ranking.numbered_names(table(spark, d, "part"), "p_brand", "p_partkey", "nome").select("p_partkey", "nome")


@query("""SELECT l_orderkey AS trip_id, count(*) AS punti, CAST(list(l_suppkey ORDER BY l_linenumber, l_suppkey, l_partkey)[1] AS DOUBLE) AS x0, CAST(list(l_partkey ORDER BY l_linenumber, l_suppkey, l_partkey)[-1] AS DOUBLE) AS y1 FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2""")
def trip_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines from stops in sequence."""
    li = table(spark, d, "lineitem")
    times = li.select(F.col("l_orderkey").alias("trip_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"))
    stops = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("stop_id"), F.col("l_suppkey").cast("double").alias("x"), F.col("l_partkey").cast("double").alias("y")).distinct()
    t = transit.trip_lines(times, stops)
    return t.select("trip_id", F.size("line").cast("bigint").alias("punti"), F.col("line")[0]["x"].alias("x0"), F.element_at("line", -1)["y"].alias("y1"))


@query("""SELECT DISTINCT o_custkey AS route_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3))""")
def routes_near(spark: SparkSession, d: str) -> DataFrame:
    """Routes by a chain of semi-joins."""
    return transit.routes_near(table(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("stop_id")), table(spark, d, "lineitem").select(F.col("l_suppkey").alias("stop_id"), F.col("l_orderkey").alias("trip_id")), table(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id")))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS finestra, event_type, count(*) AS passaggi, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS prima, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ultima FROM events GROUP BY date_trunc('hour', ts), event_type""")
def windowed_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages per hour and key; the same plan runs as a stream (extension of A1)."""
    from ..streaming.passages import windowed_passages as windowed

    w = windowed(table(spark, d, "events"), "ts", "event_type")
    exact = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return w.select(F.date_format("finestra", exact[:19]).alias("finestra"), "event_type", "passaggi", F.date_format("prima", exact).alias("prima"), F.date_format("ultima", exact).alias("ultima"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
