"""Distances, snapping and route geometry (G*)."""

from pyspark.sql import functions as F

from pingloom.catalog.registry import near, query, rounded
from pingloom.functions import geo as G
from pingloom.operators import geometry, network
from pingloom.plans.slices import lag_across

HAV = "2 * {r} * asin(sqrt(least(1, sin(radians({c} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2)))"


def hav(a, b, c, d, r=6371000.0):
    return HAV.format(a=a, b=b, c=c, d=d, r=r)


SEGMENTS = """
    segs AS (SELECT shape_id, seq, lat AS lat1, lon AS lon1, dist AS dist1, coalesce(lead(lat) OVER w, lat) AS lat2, coalesce(lead(lon) OVER w, lon) AS lon2,
                    coalesce(lead(dist) OVER w, dist) AS dist2, lead(seq) OVER w IS NULL AS is_last FROM shapes WINDOW w AS (PARTITION BY shape_id ORDER BY seq))"""
T_SQL = "CASE WHEN (lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1) < {tiny} THEN 0 ELSE least(1, greatest(0, ((lon - lon1) * (lon2 - lon1) + (lat - lat1) * (lat2 - lat1)) / ((lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1)))) END"
CHORD = "sin(radians(lat1 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(lat1)) * sin(radians(lon1 - lon) / 2) ** 2"
SNAPPED = f"""
    {SEGMENTS},
    cand AS (SELECT p.event_id, p.shape_id, seq, dist1 + {T_SQL.format(tiny='1e-12')} * (dist2 - dist1) AS along,
                    {hav('lat', 'lon', 'lat1', 'lon1', 3959.0)} AS off, {CHORD} AS m
             FROM (SELECT event_id, route_id AS shape_id, lat, lon FROM rough) p LEFT JOIN segs s ON s.shape_id = p.shape_id),
    snapped AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY event_id, shape_id ORDER BY m, seq) = 1)"""


def points(t):
    """Some without a shape, some far outside the service area."""
    return t.rough.select("event_id", F.col("route_id").alias("shape_id"), "lat", "lon")


def snapped(t):
    return geometry.snap_to_shape(points(t), geometry.shape_segments(t.shapes), ["event_id", "shape_id"])


@query("g1_haversine", f"""
    SELECT event_id, round({hav('lat', 'lon', '32.6', '-85.5')}, 3) AS meters, round({hav('lat', 'lon', '32.6', '-85.5', 3958.8)}, 6) AS miles,
           round({hav('lat', 'lon', '32.6', '-85.5', 3959.0)}, 6) AS miles_round FROM pings""")
def _(t):
    at = ("lat", "lon", F.lit(32.6), F.lit(-85.5))
    return t.pings.select("event_id", near(G.haversine(*at), 3).alias("meters"), near(G.haversine(*at, 3958.8)).alias("miles"), near(G.haversine(*at, 3959.0)).alias("miles_round"))


BEAR = "((degrees(atan2(sin(radians(-85.5 - lon)) * cos(radians(32.6)), cos(radians(lat)) * sin(radians(32.6)) - sin(radians(lat)) * cos(radians(32.6)) * cos(radians(-85.5 - lon)))) + 360) % 360)"
PLANAR = "((degrees(atan2(-85.5 - lon, 32.6 - lat)) + 360) % 360)"


@query("g2_bearing", f"SELECT event_id, round({BEAR}, 6) + 0.0 AS bearing, round({PLANAR}, 6) + 0.0 AS planar FROM pings")
def _(t):
    at = ("lat", "lon", F.lit(32.6), F.lit(-85.5))
    return t.pings.select("event_id", near(G.bearing(*at)).alias("bearing"), near(G.planar_heading(*at)).alias("planar"))


@query("g3_heading_alignment", f"SELECT event_id, round(cos(radians(least(abs(heading - {BEAR}) % 360, 360 - abs(heading - {BEAR}) % 360))), 8) + 0.0 AS alignment FROM pings")
def _(t):
    b = G.bearing("lat", "lon", F.lit(32.6), F.lit(-85.5))
    return t.pings.select("event_id", near(G.heading_alignment("heading", b), 8).alias("alignment"))


@query("g4_shape_segments", f"WITH {SEGMENTS} SELECT shape_id, seq, round(lat2, 9) AS lat2, round(lon2, 9) AS lon2, round(dist2, 6) AS dist2, CASE WHEN is_last THEN 1 ELSE 0 END AS is_last FROM segs")
def _(t):
    s = geometry.shape_segments(t.shapes)
    return s.select("shape_id", "seq", near(F.col("lat2"), 9).alias("lat2"), near(F.col("lon2"), 9).alias("lon2"), near(F.col("dist2")).alias("dist2"), F.col("is_last").cast("int").alias("is_last"))


@query("g5_snap_to_shape", f"WITH {SNAPPED} SELECT event_id, shape_id, seq, round(along, 6) + 0.0 AS along, CASE WHEN seq IS NOT NULL THEN round(off, 6) END AS off FROM snapped")
def _(t):
    return rounded(snapped(t))


PROJECT = f"""
    {SEGMENTS},
    cand AS (SELECT p.event_id, p.shape_id, seq, lat, lon, lat1, lon1, lat2, lon2, {T_SQL.format(tiny='1e-300')} AS f
             FROM (SELECT event_id, route_id AS shape_id, lat, lon FROM rough) p LEFT JOIN (SELECT * FROM segs WHERE NOT is_last) s ON s.shape_id = p.shape_id),
    foot AS (SELECT *, lat1 + f * (lat2 - lat1) AS flat, lon1 + f * (lon2 - lon1) AS flon FROM cand),
    best AS (SELECT *, (lat - flat) * (lat - flat) + (lon - flon) * (lon - flon) AS m FROM foot
             QUALIFY row_number() OVER (PARTITION BY event_id, shape_id ORDER BY m, seq) = 1)"""


@query("g6_project_onto_polyline", f"WITH {PROJECT} SELECT event_id, shape_id, seq, CASE WHEN seq IS NOT NULL THEN round(f, 6) + 0.0 END AS fraction, round(flat, 8) AS foot_lat, round(flon, 8) AS foot_lon, round(sqrt(m), 8) AS distance FROM best")
def _(t):
    out = geometry.project_onto_polyline(points(t), geometry.shape_segments(t.shapes), ["event_id", "shape_id"])
    return rounded(out.select("event_id", "shape_id", "seq", "fraction", "foot_lat", "foot_lon", "distance"), 8, fraction=6)


@query("g7_interpolate_along", f"""
    WITH {SEGMENTS},
    l AS (SELECT *, sqrt((lat2 - lat1) ** 2 + (lon2 - lon1) ** 2) AS len FROM segs WHERE NOT is_last),
    c AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY shape_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM l),
    top AS (SELECT shape_id, max(seq) AS n FROM c GROUP BY shape_id),
    mv AS (SELECT event_id, top.shape_id, event_id % (n + 1) AS s0, least(n, event_id % (n + 1) + event_id % 9) AS s1, (event_id % 10)::DOUBLE / 10 AS f0, 0.95::DOUBLE AS f1, (event_id % 7)::DOUBLE / 7 + 0.05::DOUBLE AS tt
           FROM pings JOIN top ON top.shape_id = pings.route_id),
    tg AS (SELECT mv.*, a.bef + f0 * a.len + tt * (b.bef + f1 * b.len - (a.bef + f0 * a.len)) AS target FROM mv JOIN c a ON a.shape_id = mv.shape_id AND a.seq = s0 JOIN c b ON b.shape_id = mv.shape_id AND b.seq = s1),
    h AS (SELECT tg.event_id, target, c.* FROM tg JOIN c ON c.shape_id = tg.shape_id AND bef + len >= target AND c.seq BETWEEN s0 AND s1
          QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY c.seq) = 1)
    SELECT event_id, round(lat1 + (target - bef) / len * (lat2 - lat1), 7) AS lat, round(lon1 + (target - bef) / len * (lon2 - lon1), 7) AS lon FROM h""")
def _(t):
    segments = geometry.shape_segments(t.shapes)
    top = segments.where(~F.col("is_last")).groupBy("shape_id").agg(F.max("seq").alias("n"))
    e = F.col("event_id")
    start = e % (F.col("n") + 1)
    moves = t.pings.select("event_id", F.col("route_id").alias("shape_id")).join(top, "shape_id").select(
        "event_id", "shape_id", start.alias("from_seq"), F.least("n", start + e % 9).alias("to_seq"), (e % 10 / F.lit(10.0)).alias("from_fraction"),
        F.lit(0.95).alias("to_fraction"), ((e % 7) / F.lit(7.0) + F.lit(0.05)).alias("t"))
    return rounded(geometry.interpolate_along(moves, segments, "event_id"), 7)


@query("g8_tangent_heading", f"WITH {SEGMENTS} SELECT shape_id, seq, round((degrees(atan2(lon2 - lon1, lat2 - lat1)) + 360) % 360, 5) + 0.0 AS heading FROM segs WHERE NOT is_last")
def _(t):
    s = geometry.shape_segments(t.shapes).where(~F.col("is_last"))
    return s.select("shape_id", "seq", near(G.planar_heading("lat1", "lon1", "lat2", "lon2"), 5).alias("heading"))


@query("g9_route_distance", f"""
    WITH {SNAPPED}, tot AS (SELECT shape_id, max(dist) AS total FROM shapes GROUP BY shape_id),
    x AS (SELECT s.event_id, along, total, CASE WHEN s.event_id % 5 = 0 THEN NULL ELSE (s.event_id % 200)::DOUBLE * 0.6::DOUBLE END AS stop_dist, {hav('p.lat', 'p.lon', '32.6', '-85.5', 3958.8)} AS straight
          FROM snapped s LEFT JOIN tot USING (shape_id) JOIN rough p USING (event_id))
    SELECT event_id, round(CASE WHEN stop_dist IS NULL OR along IS NULL THEN straight ELSE greatest(CASE WHEN stop_dist - along < 0 THEN total + stop_dist - along ELSE stop_dist - along END, 0) END, 5) + 0.0 AS route_distance FROM x""")
def _(t):
    lengths = t.shapes.groupBy("shape_id").agg(F.max("dist").alias("shape_length"))
    e = F.col("event_id")
    straight = t.rough.select("event_id", G.haversine("lat", "lon", F.lit(32.6), F.lit(-85.5), 3958.8).alias("straight"))
    rows = snapped(t).join(straight, "event_id").withColumn("stop_dist", F.when(e % 5 != 0, (e % 200).cast("double") * F.lit(0.6)))
    return rounded(geometry.route_distance(rows, lengths).select("event_id", "route_distance"), 5)


@query("g10_route_distance_multi", f"""
    WITH {SEGMENTS},
    two AS (SELECT event_id, lat, lon, unnest([route_id, (route_id + 1) % 10, (route_id + 2) % 10]) AS shape_id FROM rough),
    cand AS (SELECT p.event_id, p.shape_id, seq, dist1 + {T_SQL.format(tiny='1e-12')} * (dist2 - dist1) AS along,
                    {hav('lat', 'lon', 'lat1', 'lon1', 3959.0)} AS off, {CHORD} AS m FROM two p JOIN segs s ON s.shape_id = p.shape_id),
    sn AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY event_id, shape_id ORDER BY m, seq) = 1),
    tot AS (SELECT shape_id, max(dist) AS total FROM shapes GROUP BY shape_id),
    w AS (SELECT event_id, shape_id, off, (event_id % 200)::DOUBLE * 0.6::DOUBLE - along AS rest, total FROM sn JOIN tot USING (shape_id) WHERE off <= 0.4),
    c AS (SELECT *, CASE WHEN rest >= 0 THEN rest WHEN rest < -0.1 THEN total + rest ELSE 0 END AS way, rest < -0.1 AS wrapped FROM w),
    r AS (SELECT *, CASE WHEN NOT wrapped AND off < 0.2 THEN 0 WHEN NOT wrapped THEN 1 ELSE 2 END AS cls FROM c WHERE NOT wrapped OR way > 0),
    b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY cls, CASE WHEN cls = 1 THEN off ELSE way END, CASE WHEN cls = 1 THEN way ELSE off END) = 1)
    SELECT event_id, round(CASE WHEN cls = 2 AND way > 30 THEN NULL ELSE way END, 5) + 0.0 AS route_distance FROM b""")
def _(t):
    shapes_of = F.explode(F.array(F.col("route_id"), (F.col("route_id") + 1) % 10, (F.col("route_id") + 2) % 10)).alias("shape_id")
    pts = t.rough.select("event_id", "lat", "lon", shapes_of)
    near_shape = geometry.snap_to_shape(pts, geometry.shape_segments(t.shapes), ["event_id", "shape_id"])
    lengths = t.shapes.groupBy("shape_id").agg(F.max("dist").alias("shape_length"))
    rows = near_shape.join(lengths, "shape_id").withColumn("stop_dist", (F.col("event_id") % 200).cast("double") * F.lit(0.6))
    return rounded(geometry.route_distance_multi(rows, ["event_id"], gate=0.4, close=0.2, far=30.0), 5)


TRIPSTOPS = "ts AS (SELECT trip_id, list(stop_id ORDER BY stop_sequence) AS l FROM stop_times GROUP BY trip_id), q AS (SELECT event_id, event_id % 15000 AS trip_id, last_stop_id, (last_stop_id + 5) % 12 AS target FROM pings)"


def trip_asks(t):
    return t.pings.select("event_id", (F.col("event_id") % 15000).alias("trip_id"), "last_stop_id", ((F.col("last_stop_id") + 5) % 12).alias("target"))


@query("g11_stops_remaining", f"""
    WITH {TRIPSTOPS}, i AS (SELECT q.event_id, len(l) AS n, list_position(l, last_stop_id) AS a, list_position(l, target) AS b FROM q LEFT JOIN ts USING (trip_id))
    SELECT event_id, CASE WHEN a > 0 AND b > 0 THEN CASE WHEN b > a THEN b - a ELSE n - a + b END ELSE 0 END::BIGINT AS stops_remaining FROM i""")
def _(t):
    return network.stops_remaining(trip_asks(t), network.trip_stop_index(t.stop_times), "last_stop_id", "target").select("event_id", "stops_remaining")


@query("g12_next_n_stops", f"""
    WITH {TRIPSTOPS}, i AS (SELECT q.event_id, l, list_position(l, last_stop_id) AS a FROM q LEFT JOIN ts USING (trip_id))
    SELECT event_id, CASE WHEN a > 0 THEN array_to_string(l[a + 1 : a + 3], ',') ELSE '' END AS next_stops FROM i""")
def _(t):
    out = network.next_n_stops(trip_asks(t), network.trip_stop_index(t.stop_times), "last_stop_id", 3)
    return out.select("event_id", F.array_join(F.col("next_stops").cast("array<string>"), ",").alias("next_stops"))


@query("g13_stop_seq_norm", "SELECT route_id, stop_id, seq, round(seq / max(seq) OVER (PARTITION BY route_id), 9) AS seq_norm FROM (SELECT route_id, stop_id, min(stop_sequence) AS seq FROM stop_times GROUP BY ALL)")
def _(t):
    return rounded(network.stop_seq_norm(t.stop_times), 9)


@query("g14_learn_pattern_trip", "SELECT pattern_id, arg_max(event_id % 500, ts_ms * 1000 + event_id % 500) AS trip_id FROM pings GROUP BY pattern_id")
def _(t):
    return network.learn_pattern_trip(t.pings.withColumn("trip_id", F.col("event_id") % 500), "ts_ms")


@query("g1_step_distance", f"""
    WITH p AS (SELECT event_id, lat, lon, lag(lat) OVER w AS a, lag(lon) OVER w AS b FROM pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts_ms, event_id))
    SELECT event_id, round({hav('a', 'b', 'lat', 'lon')}, 3) AS step_m FROM p WHERE a IS NOT NULL""")
def _(t):
    prev = lag_across(t.pings, ["vehicle_id"], "ts_ms", ["ts_ms", "event_id"], {"a": "lat", "b": "lon"}).where("a IS NOT NULL")
    return prev.select("event_id", near(G.haversine("a", "b", "lat", "lon"), 3).alias("step_m"))
