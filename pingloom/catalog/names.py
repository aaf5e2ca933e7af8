"""Name and key resolution (K*)."""

from pyspark.sql import functions as F

from pingloom.catalog.registry import near, query
from pingloom.operators import joins, resolve


@query("k1_map_by_name", """
    WITH d AS (SELECT trim(s_name) AS name, min(s_suppkey) AS supp_id FROM supplier GROUP BY 1)
    SELECT c_custkey, supp_id FROM (SELECT c_custkey, 'Supplier#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') || ' ' AS n FROM customer)
    LEFT JOIN d ON trim(n) = d.name""")
def _(t):
    names = t.raw("customer").select("c_custkey", F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0"), F.lit(" ")).alias("n"))
    return resolve.map_by_name(names, "n", t.raw("supplier"), "s_name", "s_suppkey", "supp_id").select("c_custkey", "supp_id")


@query("k1_unmatched_names", """
    WITH n AS (SELECT trim('Supplier#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') || ' ') AS name FROM customer)
    SELECT name, count(*) AS n_rows FROM n WHERE name NOT IN (SELECT trim(s_name) FROM supplier) GROUP BY name""")
def _(t):
    names = t.raw("customer").select(F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0"), F.lit(" ")).alias("n"))
    return resolve.unmatched_names(names, "n", t.raw("supplier"), "s_name")


@query("k2_normalize_name", "SELECT stop_id, trim(replace(replace(lower(' ' || stop_name || '-X '), '&', 'and'), '-', ' ')) AS name FROM stops")
def _(t):
    from pingloom.functions.scalars import normalize_name

    return t.stops.select("stop_id", normalize_name(F.concat(F.lit(" "), F.col("stop_name"), F.lit("-X "))).alias("name"))


MESSY = """
    SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '-') ELSE 'the ' || p_name || CASE WHEN p_partkey % 8 = 3 THEN 'gate' ELSE ' hall' END END AS name FROM part"""


def messy(t):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    return t.raw("part").select(
        F.when(k == 0, n).when(k == 1, F.upper(n)).when(k == 2, F.replace(n, F.lit(" "), F.lit("-")))
        .otherwise(F.concat(F.lit("the "), n, F.when(F.col("p_partkey") % 8 == 3, "gate").otherwise(" hall"))).alias("name"))


@query("k3_map_cascade", f"""
    WITH m AS ({MESSY}), d AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1),
         r AS (SELECT m.name, trim(replace(replace(lower(m.name), '&', 'and'), '-', ' ')) AS nn, d0.id AS i0, d1.id AS i1, d2.id AS i2
               FROM m LEFT JOIN d d0 ON d0.p_name = trim(m.name)
               LEFT JOIN (SELECT lower(p_name) AS k, min(id) AS id FROM d GROUP BY 1) d1 ON d1.k = lower(trim(m.name))
               LEFT JOIN (SELECT trim(replace(replace(lower(p_name), '&', 'and'), '-', ' ')) AS k, min(id) AS id FROM d GROUP BY 1) d2
                 ON d2.k = trim(replace(replace(lower(m.name), '&', 'and'), '-', ' '))),
         dn AS (SELECT trim(replace(replace(lower(p_name), '&', 'and'), '-', ' ')) AS dd, min(id) AS id FROM d GROUP BY 1),
         c AS (SELECT nn, min(dn.id) AS i3 FROM (SELECT DISTINCT nn FROM r WHERE coalesce(i0, i1, i2) IS NULL AND nn <> '') x
               JOIN dn ON dd <> '' AND (contains(nn, dd) OR contains(dd, nn)) GROUP BY nn)
    SELECT name, coalesce(i0, i1, i2, i3) AS id, CASE WHEN i0 IS NOT NULL THEN 'exact' WHEN i1 IS NOT NULL THEN 'case' WHEN i2 IS NOT NULL THEN 'normalized'
           WHEN i3 IS NOT NULL THEN 'contains' ELSE 'unmatched' END AS match_type
    FROM r LEFT JOIN c USING (nn)""")
def _(t):
    return resolve.map_cascade(messy(t), "name", t.raw("part"), "p_name", "p_partkey")


@query("k4_fuzzy_match", f"""
    WITH m AS ({MESSY}), d AS (SELECT trim(p_name) AS entry, min(p_partkey) AS entry_id FROM part GROUP BY 1),
         p AS (SELECT name, entry, entry_id, 1 - levenshtein(lower(name), lower(entry)) / greatest(length(name), length(entry)) AS score FROM m, d),
         k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, (name = entry) DESC, entry, entry_id) AS rn FROM p WHERE score >= 0.65 - 1e-12),
         b AS (SELECT name, any_value(entry_id) FILTER (rn = 1) AS entry_id, any_value(entry) FILTER (rn = 1) AS entry, any_value(score) FILTER (rn = 1) AS score,
                      string_agg(entry, '|' ORDER BY rn) FILTER (rn <= 3) AS alternatives FROM k GROUP BY name)
    SELECT name, entry_id, CASE WHEN score IS NULL THEN 'unmatched' WHEN name = entry THEN 'exact' WHEN lower(name) = lower(entry) THEN 'case_insensitive' ELSE 'fuzzy' END AS match_type,
           CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.65 THEN 'medium' WHEN score IS NOT NULL THEN 'low' ELSE 'none' END AS confidence,
           round(score, 6) AS score, alternatives
    FROM m LEFT JOIN b USING (name)""")
def _(t):
    out = resolve.fuzzy_match(messy(t), "name", t.raw("part"), "p_name", "p_partkey")
    return out.withColumn("score", near(F.col("score"))).withColumn("alternatives", F.array_join("alternatives", "|"))


# names that are far from every entry, and entries spelled backwards
FAR = "SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN reverse(p_name) ELSE substr(p_name, 3) || 'zz' || (c_custkey % 50) END AS name FROM customer JOIN part ON p_partkey = c_custkey % 400 + 1"


@query("k4_wide_net", f"""
    WITH m AS ({FAR}), d AS (SELECT trim(p_name) AS entry, min(p_partkey) AS entry_id FROM part GROUP BY 1),
         p AS (SELECT trim(name) AS name, entry, entry_id, 1 - levenshtein(lower(trim(name)), lower(entry)) / greatest(length(trim(name)), length(entry)) AS score FROM m, d),
         h AS (SELECT name, max(score) >= 0.5 - 1e-12 AS matched FROM p GROUP BY name),
         k AS (SELECT p.*, matched, row_number() OVER (PARTITION BY name ORDER BY score DESC, (name = entry) DESC, entry, entry_id) AS rn
               FROM p JOIN h USING (name) WHERE score >= CASE WHEN matched THEN 0.5 ELSE 0.3 END - 1e-12),
         b AS (SELECT name, any_value(entry_id) FILTER (rn = 1 AND matched) AS entry_id, round(any_value(score) FILTER (rn = 1 AND matched), 6) AS score,
                      string_agg(entry, '|' ORDER BY rn) FILTER (rn <= 3) AS alternatives FROM k GROUP BY name)
    SELECT n.name, entry_id, CASE WHEN score IS NULL THEN 'unmatched' WHEN score = 1 THEN 'other' ELSE 'fuzzy' END AS match_type, score, alternatives
    FROM (SELECT DISTINCT trim(name) AS name FROM m) n LEFT JOIN b USING (name)""")
def _(t):
    c = F.col("c_custkey")
    rows = t.raw("customer").join(t.raw("part"), F.col("p_partkey") == c % 400 + 1)
    far = rows.select(F.when(c % 3 == 0, F.col("c_name")).when(c % 3 == 1, F.reverse("p_name")).otherwise(F.concat(F.expr("substr(p_name, 3)"), F.lit("zz"), (c % 50).cast("string"))).alias("name"))
    out = resolve.fuzzy_match(far, "name", t.raw("part"), "p_name", "p_partkey", cutoff=0.5, wide=0.3)
    kind = F.when(F.col("match_type").isin("exact", "case_insensitive"), "other").otherwise(F.col("match_type"))
    return out.select("name", "entry_id", kind.alias("match_type"), near(F.col("score")).alias("score"), F.array_join("alternatives", "|").alias("alternatives"))


@query("k5_key_overlap_report", """
    SELECT 'route_id' AS key, count(*) AS n_common, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS ok FROM (SELECT route_id FROM pings INTERSECT SELECT route_id FROM arrivals)
    UNION ALL SELECT 'vehicle_id', count(*), CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM (SELECT vehicle_id FROM pings INTERSECT SELECT vehicle_id FROM arrivals)""")
def _(t):
    return resolve.key_overlap_report(t.pings, t.arrivals, ["route_id", "vehicle_id"])


@query("k6_backfill_route", """
    SELECT order_id, supp_id, sum(route)::BIGINT AS route_sum, count(*) AS n FROM (
      SELECT p.order_id, p.supp_id, CASE WHEN p.order_id % 3 = 0 THEN t.route_id ELSE p.route_id END AS route FROM predictions p LEFT JOIN trips t ON t.trip_id = p.order_id)
    GROUP BY ALL""")
def _(t):
    rows = t.predictions.select(F.col("order_id").alias("trip_id"), "supp_id", F.when(F.col("order_id") % 3 != 0, F.col("route_id")).alias("route_id"))
    out = joins.backfill_route(rows, t.trips)
    return out.groupBy(F.col("trip_id").alias("order_id"), "supp_id").agg(F.sum("route_id").alias("route_sum"), F.count(F.lit(1)).alias("n"))
