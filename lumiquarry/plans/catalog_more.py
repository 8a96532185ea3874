"""Further registered queries: projections, work lists, recaps, names and themed stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumiquarry.functions import faces, geo, scores, texts, vec
from lumiquarry.operators import aggregate, cluster, islands, joins, rank
from lumiquarry.plans import export, places, stories, taste
from lumiquarry.plans.catalog import LAT, LON, SECONDS, VISITS, events, photos, visits, with_vectors
from lumiquarry.plans.registry import query
from lumiquarry.session import table
from lumiquarry.sources import pictures, side_files


@query("photo_cards", "SELECT event_id AS id, '/api/thumb/' || event_type || '-' || event_id AS thumb_url, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS taken_at, CASE WHEN event_id % 4 > 0 THEN value END AS iqa FROM events")
def photo_cards(spark, d):
    """The card of the list, optional columns left joined."""
    side = events(spark, d).where("event_id % 4 > 0").select(F.col("event_id").alias("id"), F.col("value").alias("iqa"))
    e = events(spark, d)
    cards = e.select(F.col("event_id").alias("id"), F.concat(F.lit("/api/thumb/"), "event_type", F.lit("-"), F.col("event_id").cast("string")).alias("thumb_url"), texts.iso(F.col("ts")).alias("taken_at"))
    return joins.star(cards, side, on="id")


@query("sql_day_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def sql_day_counts(spark, d):
    """The same engine through SQL text."""
    return spark.sql("SELECT date_format(ts, 'yyyy-MM-dd') AS day, count(*) AS n FROM {e} GROUP BY 1", e=events(spark, d))


@query("pending_work", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0) AND lang = 'en'")
def pending_work(spark, d):
    """What a stage has not done yet."""
    done = table(spark, d, "labels").where("toxic = 0")
    return table(spark, d, "documents").where("lang = 'en'").join(done, "doc_id", "left_anti").select("doc_id")


@query("known_hashes", "SELECT DISTINCT sha256(x) AS sha256 FROM (SELECT text AS x FROM documents UNION ALL SELECT text FROM benchmark)")
def known_hashes(spark, d):
    """The hashes of photos and videos together."""
    both = table(spark, d, "documents").select("text").union(table(spark, d, "benchmark").select("text"))
    return both.select(F.sha2("text", 256).alias("sha256")).distinct()


@query("recap_stats", f"""WITH k AS (SELECT *, {LAT} AS lat, {LON} AS lon FROM events WHERE value > 150),
 l AS (SELECT 2 * 6371.0088 * asin(sqrt(sin(radians(lat - lag(lat) OVER w) / 2) ** 2 + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * sin(radians(lon - lag(lon) OVER w) / 2) ** 2)) AS leg FROM k WINDOW w AS (ORDER BY ts, event_id))
 SELECT (SELECT count(DISTINCT event_id) FROM k) AS kept, (SELECT count(*) FROM events) AS taken, (SELECT count(DISTINCT strftime(ts, '%Y-%m-%d')) FROM k) AS days, round(sum(leg), 5) AS km FROM l""")
def recap_stats(spark, d):
    """A trip's numbers. A trip is one route, measured by ranges of its time."""
    p = photos(spark, d)
    kept = p.where("ap25 > 150")
    km = islands.whole_route_km(kept, ["taken_at", "photo_id"], "lat", "lon")
    stats = kept.agg(F.count_distinct("photo_id").alias("kept"), F.count_distinct("day").alias("days"))
    return stats.join(km.select(F.round("km", 5).alias("km")), F.lit(True)).join(p.agg(F.count("*").alias("taken")), F.lit(True))


@query("route_points", f"""WITH p AS (SELECT user_id, event_id, {LAT} AS lat, {LON} AS lon FROM events),
 b AS (SELECT user_id, min(lat) AS la, max(lat) AS lb, min(lon) AS oa, max(lon) AS ob FROM p GROUP BY 1)
 SELECT event_id, round(24 + (lon - oa) * 252.0 / greatest(lb - la, ob - oa, 1e-6), 5) AS x, round(300 - 24 - (lat - la) * 252.0 / greatest(lb - la, ob - oa, 1e-6), 5) AS y FROM p JOIN b USING (user_id)""")
def route_points(spark, d):
    """A route's points in its picture."""
    p = photos(spark, d)
    b = p.groupBy("user_id").agg(F.min("lat").alias("la"), F.max("lat").alias("lb"), F.min("lon").alias("oa"), F.max("lon").alias("ob"))
    x, y = geo.svg_xy(*[F.col(c) for c in ("lat", "lon", "la", "lb", "oa", "ob")])
    return p.join(b, "user_id").select(F.col("photo_id").alias("event_id"), F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


@query("name_functions", r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(' ' || p_name || '!  ' || p_type), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')) AS canonical,
 list_has_any(string_split(lower(p_name), ' '), ['ring', 'lane']) OR len(p_name) < 4 AS generic, regexp_replace(p_brand || '/' || p_name, '[^\p{L}\p{N}\-_ ]', '_', 'g') AS clean FROM part""")
def name_functions(spark, d):
    """X3, X7, X9."""
    p = table(spark, d, "part")
    return p.select("p_partkey", texts.canonical(F.concat(F.lit(" "), "p_name", F.lit("!  "), "p_type")).alias("canonical"), texts.is_generic(F.col("p_name"), ["ring", "lane"]).alias("generic"), texts.clean_name(F.concat("p_brand", F.lit("/"), "p_name")).alias("clean"))


@query("array_picks", "SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS best, list_sort(list_distinct(list(l_returnflag))) AS flags FROM lineitem GROUP BY 1")
def array_picks(spark, d):
    """The best element of an array, its distinct values."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_returnflag"))).alias("items")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(items)
    return g.select("l_orderkey", vec.argmax(F.col("items"), lambda x: x["l_extendedprice"])["l_linenumber"].alias("best"), F.sort_array(F.array_distinct(F.transform("items", lambda x: x["l_returnflag"]))).alias("flags"))


@query("video_order", "SELECT event_id, pos FROM (SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 3 > 0 THEN ts END ASC NULLS LAST, event_type, event_id) AS pos FROM events)")
def video_order(spark, d):
    """Rows without a time last, then by path."""
    e = events(spark, d).select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("at"), "event_type")
    order = [F.col("at").asc_nulls_last(), F.col("event_type"), F.col("event_id")]
    return rank.global_rank(e, order, "pos").select("event_id", (F.col("pos") + 1).alias("pos"))


@query("strongest_in_time", f"SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rank FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 30)")
def strongest_in_time(spark, d):
    """The strongest of each group, numbered in time."""
    strong = rank.top_per_group(events(spark, d), ["user_id"], [F.desc("value"), F.col("event_id")], 30)
    return rank.top_per_group(strong, ["user_id"], [F.col("ts"), F.col("event_id")], 30, rank="at").select("event_id", (F.col("at") - 1).alias("rank"))


@query("people_stories", """WITH n AS (SELECT user_id % 7 AS p, count(DISTINCT event_id) AS n FROM events GROUP BY 1 ORDER BY n DESC, p LIMIT 2), t AS (SELECT p, row_number() OVER (ORDER BY n DESC, p) AS r FROM n),
 s AS (SELECT event_id, ts, CASE WHEN user_id % 7 IN (SELECT p FROM t) THEN 'people:Solo ' || (user_id % 7) END AS story FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY ts, event_id) AS pos FROM s WHERE story IS NOT NULL)
 SELECT story, event_id AS photo_id, pos - 1 AS rank FROM r WHERE pos <= 600""")
def people_stories(spark, d):
    """C17, J22, T6."""
    p = photos(spark, d).select("photo_id", "taken_at", (F.col("user_id") % 7).alias("person_id"))
    return stories.people_stories(p.select("photo_id", "taken_at"), p.select("photo_id", "person_id"))


def _with_vectors(spark, d):
    return with_vectors(spark, d).select("photo_id", "at", "v", (F.col("ap25") / 500).alias("iqa"), "blur", F.lit(0.0).alias("face"), "tag")


@query("place_stories")
def place_stories(spark, d):
    """C17, J9."""
    return stories.place_stories(_with_vectors(spark, d), visits(spark, d))


@query("pattern_stories")
def pattern_stories(spark, d):
    """C17, X8."""
    p = _with_vectors(spark, d)
    tags = p.select("photo_id", "tag", F.lit(None).cast("string").alias("source"))
    return stories.pattern_stories(p, tags, {"Looking": ["view"], "Trouble": ["err"]})


@query("numbered_places", """WITH RECURSIVE v AS (SELECT event_id, 'Place' || (user_id % 9) AS base, 34 + (event_id % 97) * 0.001 AS lat, 77 + (event_id % 89) * 0.001 AS lon, row_number() OVER (PARTITION BY user_id % 9 ORDER BY ts, event_id) AS i FROM events),
 g AS (SELECT DISTINCT base, 0::BIGINT AS i, []::STRUCT(lat DOUBLE, lon DOUBLE)[] AS heads, NULL::BIGINT AS event_id, 0::BIGINT AS hit FROM v
       UNION ALL SELECT base, i, CASE WHEN hit > len(heads) THEN list_append(heads, {'lat': lat, 'lon': lon}) ELSE heads END, event_id, hit
       FROM (SELECT v.*, g.heads, coalesce(nullif(list_position(list_transform(g.heads, lambda h: sqrt(((h.lat - v.lat) * 111.0) ** 2 + ((h.lon - v.lon) * 111.32 * cos(radians((h.lat + v.lat) / 2))) ** 2) <= 2), true), 0), len(g.heads) + 1)::BIGINT AS hit
             FROM g JOIN v ON v.base = g.base AND v.i = g.i + 1))
 SELECT event_id AS visit_id, CASE WHEN hit > 1 THEN base || ' (' || hit || ')' ELSE base END AS name FROM g WHERE i > 0""")
def numbered_places(spark, d):
    """Every event as a visit."""
    p = photos(spark, d).select(F.col("photo_id").alias("visit_id"), F.concat(F.lit("Place"), (F.col("user_id") % 9).cast("string")).alias("name"), "lat", "lon", F.col("taken_at").alias("arrived_at"))
    return cluster.numbered_places(p)


@query("numbered_per_day", """WITH v AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, 'Place' || (user_id % 9) AS name, 34 + (event_id % 97) * 0.001 AS lat, 77 + (event_id % 89) * 0.001 AS lon, ts FROM events),
 f AS (SELECT a.day, a.name FROM v a JOIN v b ON a.day = b.day AND a.name = b.name AND a.event_id < b.event_id
       WHERE sqrt(((a.lat - b.lat) * 111.0) ** 2 + ((a.lon - b.lon) * 111.32 * cos(radians((a.lat + b.lat) / 2))) ** 2) > 2 GROUP BY 1, 2),
 n AS (SELECT v.*, row_number() OVER (PARTITION BY day, name ORDER BY ts, event_id) AS pos FROM v)
 SELECT event_id AS visit_id, CASE WHEN pos > 1 AND (day, name) IN (SELECT (day, name) FROM f) THEN name || ' (' || pos || ')' ELSE name END AS name FROM n""")
def numbered_per_day(spark, d):
    """W14 within days."""
    p = photos(spark, d).select(F.col("photo_id").alias("visit_id"), "day", F.concat(F.lit("Place"), (F.col("user_id") % 9).cast("string")).alias("name"), "lat", "lon", F.col("taken_at").alias("arrived_at"))
    return cluster.numbered_per_day(p)


@query("merged_names")
def merged_names(spark, d):
    """Nations as places, some with landmark words, a few kilometres apart."""
    k = F.col("n_nationkey")
    name = F.concat("n_name", F.when(k % 4 == 0, " Pass").when(k % 7 == 0, " Tso").otherwise(""))
    return cluster.merged_names(table(spark, d, "nation").select(name.alias("name"), (34 + k * 0.03).alias("lat"), (77 + k % 3 * 0.02).alias("lon"), (k * 37 % 11).alias("photos")))


@query("taste_report")
def taste_report(spark, d):
    """C11: samples, AUC on a held-out fifth of each class, weight, and the model."""
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "photo_id")
    swipes = e.select("photo_id", F.when(F.col("label") < 5, "keep").otherwise("reject").alias("decision"))
    return taste.taste_report(taste.labelled(e.select("photo_id", "embedding"), swipes))


def _linked_faces(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("person_id"), (F.col("l_orderkey") % 500).alias("photo_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("face_id"), F.col("l_extendedprice").alias("confidence"))


LINKED = "f AS (SELECT l_suppkey AS person_id, l_orderkey % 500 AS photo_id, l_orderkey * 10 + l_linenumber AS face_id, l_extendedprice AS confidence FROM lineitem)"


@query("person_list", f"WITH {LINKED} SELECT person_id, arg_max(face_id, (confidence, -face_id)) AS cover_face_id, count(DISTINCT photo_id) AS photo_count FROM f GROUP BY 1 HAVING count(DISTINCT photo_id) >= 2")
def person_list(spark, d):
    """Persons with cover and number of photos."""
    return aggregate.person_tables(_linked_faces(spark, d))[0]


@query("person_photos", f"WITH {LINKED} SELECT photo_id, person_id, arg_max(face_id, (confidence, -face_id)) AS face_id, max(confidence) AS confidence FROM f WHERE person_id IN (SELECT person_id FROM f GROUP BY 1 HAVING count(DISTINCT photo_id) >= 2) GROUP BY 1, 2")
def person_photos(spark, d):
    """The surest face of each person in each photo."""
    return aggregate.person_tables(_linked_faces(spark, d))[1]


@query("story_export", f"SELECT event_id AS photo_id, printf('%02d_%s', event_id % 60, event_type || '.jpg') AS target FROM events WHERE user_id = 7")
def story_export(spark, d):
    """A story's files with two-digit ranks."""
    e = events(spark, d).select(F.col("event_id").alias("photo_id"), F.col("user_id").alias("story_id"), F.concat(F.lit("/x/"), "event_type", F.lit(".jpg")).alias("path"), F.lit(None).cast("string").alias("day"), (F.col("event_id") % 60).alias("rank"))
    chosen = export.verdicts(e.select("photo_id", F.lit("keep").alias("decision")), "story:7", e)
    return export.export_plan(e.join(chosen, "photo_id", "left_semi"), digits=2).select("photo_id", "target")


@query("face_rollups", "SELECT l_orderkey AS photo_id, coalesce(bool_or(l_discount * 10 < 0.35), false) AS any_closed, coalesce(bool_and(abs((l_quantity - 25) * 4) > 45), false) AS all_away FROM lineitem GROUP BY 1")
def face_rollups(spark, d):
    """A21."""
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("photo_id"), (F.col("l_discount") * 10).alias("eyes_open"), ((F.col("l_quantity") - 25) * 4).alias("yaw"))
    return faces.rollup(f)


@query("best_overlap", """WITH s AS (SELECT l_orderkey AS p, l_linenumber AS s, round(l_discount * 100) AS x, round(l_tax * 100) AS y FROM lineitem),
 i AS (SELECT a.p, a.s, b.s AS t, greatest(0, least(a.x, b.x) + 8 - greatest(a.x, b.x)) * greatest(0, least(a.y, b.y) + 8 - greatest(a.y, b.y)) AS i FROM s a JOIN s b ON a.p = b.p AND a.s % 2 = 0 AND b.s % 2 = 1)
 SELECT p AS photo_id, s AS stored_id, arg_max(t, (i / (128 - i), -t)) AS found_id, round(max(i / (128 - i)), 9) AS iou FROM i WHERE i / (128 - i) >= 0.3 GROUP BY 1, 2""")
def best_overlap(spark, d):
    """A photo's boxes with even numbers are stored, the others found."""
    box = [F.round(F.col("l_discount") * 100).alias("bbox_x"), F.round(F.col("l_tax") * 100).alias("bbox_y"), F.lit(8.0).alias("bbox_w"), F.lit(8.0).alias("bbox_h")]
    boxes = lambda odd, name: table(spark, d, "lineitem").where(F.col("l_linenumber") % 2 == odd).select(F.col("l_orderkey").alias("photo_id"), F.col("l_linenumber").alias(name), *box)
    out = joins.best_overlap(boxes(0, "stored_id"), boxes(1, "found_id"), "photo_id", "stored_id", "found_id")
    return out.withColumn("iou", F.round("iou", 9))


@query("planned_seconds", "SELECT l_suppkey, round(count(*) * (0.03 + 0.12 + 0.9 + 0.5 + 0.02), 6) AS seconds FROM lineitem GROUP BY 1")
def planned_seconds(spark, d):
    """M12."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(scores.stage_seconds(F.count("*")), 6).alias("seconds"))


@query("top_locations", f"WITH v AS ({VISITS}), p AS (SELECT event_id, {SECONDS} AS pos FROM events), f AS (SELECT event_id, arg_min(name, (arrived, visit_id)) AS place FROM p JOIN v ON pos BETWEEN arrived AND departed GROUP BY 1) SELECT place, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 10 ORDER BY n DESC, place LIMIT 12")
def top_locations(spark, d):
    """Photos by the first visit in time that holds them, the twelve fullest places."""
    of = joins.first_interval(photos(spark, d).select("photo_id", "at"), visits(spark, d), "at", "arrived", "departed", 1800, "photo_id", ["arrived", "visit_id"], "name")
    return of.groupBy(F.col("name").alias("place")).agg(F.count("*").alias("n")).where("n >= 10").orderBy(F.desc("n"), "place").limit(12)


@query("mean_vectors", "SELECT label, n, round(c[1] / s, 6) AS first, round(c[64] / s, 6) AS last FROM (SELECT label, max(n) AS n, list(m ORDER BY i) AS c, sqrt(sum(m * m)) AS s FROM (SELECT label, i, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)")
def mean_vectors(spark, d):
    """A13."""
    out = aggregate.mean_vectors(table(spark, d, "embeddings"), ["label"], "embedding")
    return out.select("label", "n", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.get("centroid", F.lit(63)), 6).alias("last"))


@query("geocode_order", f"""WITH p AS (SELECT event_id, {LAT} AS lat, {LON} AS lon, round_even({LAT}, 3) AS la, round_even({LON}, 3) AS lo FROM events),
 c AS (SELECT la, lo, CASE WHEN count(*) FILTER (event_id % 3 = 0) = count(*) THEN NULL ELSE 'cached' END AS name FROM p WHERE event_id % 7 = 0 GROUP BY 1, 2),
 f AS (SELECT la, lo, arg_min(lat, event_id) AS lat, arg_min(lon, event_id) AS lon FROM p GROUP BY 1, 2),
 m AS (SELECT n_name AS name, 34 + n_nationkey * 0.004 AS plat, 77 + n_nationkey * 0.0035 AS plon, CASE WHEN n_nationkey % 4 = 0 THEN 1500 ELSE least(300 + n_nationkey * 100, 1500) END AS radius FROM nation),
 n AS (SELECT la, lo, arg_min(name, (round(d, 9), name)) AS mark FROM (SELECT la, lo, name, radius, 1000 * sqrt(((lat - plat) * 111.0) ** 2 + ((lon - plon) * 111.32 * cos(radians((lat + plat) / 2))) ** 2) AS d FROM f, m) WHERE round(d, 9) <= radius GROUP BY 1, 2)
 SELECT event_id, CASE WHEN c.la IS NOT NULL THEN coalesce(c.name, 'Unknown location') WHEN mark IS NOT NULL THEN mark WHEN round(p.lat * 1000)::BIGINT % 3 = 0 THEN 'Unknown location' ELSE 'Cell ' || round(p.lat * 1000)::BIGINT END AS display_name,
        CASE WHEN c.la IS NOT NULL THEN 'cache' WHEN mark IS NOT NULL THEN 'landmark' ELSE 'look-up' END AS source
 FROM p LEFT JOIN c USING (la, lo) LEFT JOIN n USING (la, lo)""")
def geocode_order(spark, d):
    """Names from the cache, landmarks, then a look-up that fails for every third row of latitude."""
    p = photos(spark, d).select(F.col("photo_id").alias("event_id"), "lat", "lon")
    at = [texts.geo_key(F.col("lat")).alias("lat_round"), texts.geo_key(F.col("lon")).alias("lon_round")]
    cache = p.where("event_id % 7 = 0").groupBy(*at).agg(F.when(F.count_if(F.col("event_id") % 3 == 0) < F.count("*"), "cached").alias("display_name"))
    k = F.col("n_nationkey")
    marks = table(spark, d, "nation").select(F.col("n_name").alias("name"), (34 + k * 0.004).alias("lat"), (77 + k * 0.0035).alias("lon"), F.when(k % 4 != 0, F.least(300 + k * 100, F.lit(1500))).cast("double").alias("radius_m"))
    row = F.round(F.col("lat") * 1000).cast("long")
    answer = F.when(row % 3 != 0, F.to_json(F.struct(F.concat(F.lit("Cell "), row.cast("string")).alias("name"))))
    return places.resolved(p, cache, marks, lambda asked: asked.select("lat_round", "lon_round", answer.alias("payload")), key="event_id")[0]


@query("prompt_quality", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT vec_id, list_sum(v) / 8 AS a, (list_sum(v[1:32]) - list_sum(v[33:64])) / 8 AS b, sqrt(list_dot_product(v, v)) AS n FROM e)
 SELECT vec_id, round(1 / (1 + exp(-((a / n * 112.33 - 16.55) - (b / n * 112.33 - 16.55)))), 9) AS quality FROM s""")
def prompt_quality(spark, d):
    """The good prompt likes all numbers, the bad one the first half."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(scores.prompt_quality(vec.unit(F.col("embedding")), [1 / 8] * 64, [1 / 8] * 32 + [-1 / 8] * 32), 9).alias("quality"))


@query("recap_images", f"""WITH p AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, ts, CASE WHEN event_id % 3 = 0 THEN 0.6 * value + 0.4 * (event_id % 10) WHEN event_id % 3 = 1 THEN value / 9 ELSE greatest(0, 1 - (event_id % 150) * 0.01) END AS score FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, event_id) AS k, greatest(1, 40 // (SELECT count(DISTINCT day) FROM p)) AS q FROM p),
 l AS (SELECT *, row_number() OVER (ORDER BY score DESC, event_id) AS pos FROM r WHERE k > q), t AS (SELECT day, event_id, ts FROM r WHERE k <= q UNION ALL SELECT day, event_id, ts FROM l WHERE pos <= 40 - (SELECT count(*) FROM r WHERE k <= q))
 SELECT day, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) - 1 AS place, event_id AS photo_id, CASE WHEN day[10] IN ('1', '3', '5') THEN 'On ' || day ELSE '' END AS caption FROM t""")
def recap_images(spark, d):
    """Forty pictures of all days, with the captions of some."""
    i = F.col("photo_id")
    p = photos(spark, d)
    items = p.select("day", "photo_id", (i % 150).alias("rank"), "taken_at", F.when(i % 3 == 0, (i % 10).cast("double")).alias("nima"), F.col("ap25"), F.when(i % 3 == 1, F.col("ap25") / 9).alias("iqa"))
    files = p.select("day").distinct().where("substring(day, 10, 1) IN ('1', '3', '5')").select("day", F.to_json(F.struct(F.concat(F.lit("On "), F.col("day")).alias("caption"))).alias("text"))
    return export.recap_images(items, side_files.captions(files)).select("day", "place", "photo_id", "caption")


@query("picture_measures", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: 5 * least(50, greatest(0, round((x::DOUBLE * 4 + 1) * 25.5)))::DOUBLE) AS p FROM embeddings),
 x AS (SELECT vec_id, p, i // 8 AS r, i % 8 AS c FROM e, range(64) v(i)),
 l AS (SELECT vec_id, p[8 * r + c + 1] AS g, p[8 * (CASE r WHEN 0 THEN 1 ELSE r - 1 END) + c + 1] + p[8 * (CASE r WHEN 7 THEN 6 ELSE r + 1 END) + c + 1]
        + p[8 * r + (CASE c WHEN 0 THEN 1 ELSE c - 1 END) + 1] + p[8 * r + (CASE c WHEN 7 THEN 6 ELSE c + 1 END) + 1] - 4 * p[8 * r + c + 1] AS lap FROM x),
 s AS (SELECT vec_id, var_pop(lap) AS sharpness, avg(g) / 255 AS m, stddev_pop(g) AS sd, avg((g < 8)::INT) AS low, avg((g > 247)::INT) AS high, quantile_cont(g, 0.05) / 255 AS p05, quantile_cont(g, 0.95) / 255 AS p95 FROM l GROUP BY 1)
 SELECT vec_id, round(sharpness, 5) AS sharpness, round(greatest(0, (1 - 2 * abs(m - 0.5)) * (1 - low - high) * (0.5 + 0.5 * least(sd / 127.5, 1))), 6) AS exposure, round(m, 6) AS luma_mean, round(sd / 255, 6) AS luma_std,
        round(low + high, 6) AS clipped, round(low, 6) AS clipped_low, round(high, 6) AS clipped_high, round(p05, 6) AS p05, round(p95, 6) AS p95, m < 0.3 AS low_light FROM s""")
def picture_measures(spark, d):
    """M6: each vector as a grey picture of eight by eight."""
    step = F.transform("embedding", lambda x: (5 * F.least(F.lit(50), F.greatest(F.lit(0), F.round((x.cast("double") * 4 + 1) * 25.5)))).cast("int"))
    code = F.transform(step, lambda x: F.lpad(F.hex(x), 2, "0"))
    frames = table(spark, d, "embeddings").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.array_join(F.transform(code, lambda h: F.concat(h, h, h)), "")).alias("pixels"))
    m = pictures.measured(frames, "vec_id")
    return m.select("vec_id", F.round("sharpness", 5).alias("sharpness"), *[F.round(c, 6).alias(c) for c in m.columns[2:-1]], "low_light")
