"""The registered queries: the operators over the driver's tables, with their SQL.

Events stand in for photos (ts, value as score, user as stack, type as tag), embeddings for image vectors, documents for
files, labels for decisions, orders for visits. Places are made from keys: lat 34 + (event_id % 97)/1000, lon
77 + (event_id % 89)/1000.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumiquarry.functions import geo, scores, texts, vec
from lumiquarry.operators import aggregate, cluster, density, islands, joins, mutate, rank
from lumiquarry.plans import curate as curation
from lumiquarry.plans import dedup, export, moments, search, stories, taste
from lumiquarry.plans.registry import query
from lumiquarry.session import table
from lumiquarry.sources import media, side_files

DAY = "strftime(ts, '%Y-%m-%d')"
SECONDS = "(epoch_us(ts) / 1e6)"
LAT, LON = "(34 + (event_id % 97) * 0.001)", "(77 + (event_id % 89) * 0.001)"


def events(spark, d):
    return table(spark, d, "events")


def photos(spark, d):
    """Events as photos: photo_id, taken_at, at (seconds), day, ap25, nima, blur, lat, lon, tag, user_id."""
    e = events(spark, d)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(
        F.col("event_id").alias("photo_id"), F.col("ts").alias("taken_at"), at.alias("at"), texts.day(F.col("ts")).alias("day"), F.col("value").alias("ap25"), (F.col("event_id") % 11).cast("double").alias("nima"),
        (F.col("value") * 10).alias("blur"), (34 + (F.col("event_id") % 97) * 0.001).alias("lat"), (77 + (F.col("event_id") % 89) * 0.001).alias("lon"), F.col("event_type").alias("tag"), "user_id",
    )


def with_vectors(spark, d, unit=True):
    """Photos with ``v``, the vector whose id is theirs modulo the number of vectors: every vector is some photo's."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.count("*").alias("_n"))
    v = e.select("vec_id", (vec.unit(F.col("embedding"), floor=1e-6) if unit else F.col("embedding")).alias("v"))
    return photos(spark, d).join(F.broadcast(n), F.lit(True)).withColumn("vec_id", F.col("photo_id") % F.col("_n")).drop("_n").join(v, "vec_id")


@query("tag_counts", "SELECT event_type AS tag, count(*) AS n FROM events GROUP BY 1")
def tag_counts(spark, d):
    """A1."""
    return events(spark, d).groupBy(F.col("event_type").alias("tag")).agg(F.count("*").alias("n"))


CURATE = f"""
WITH p AS (SELECT {DAY} AS day, event_id, user_id, 0.6 * value + 0.4 * (event_id % 11)::DOUBLE AS combined FROM events),
cut AS (SELECT day, count(*) AS n, quantile_cont(combined, 0.75) AS c FROM p GROUP BY 1),
lib AS (SELECT quantile_cont(combined, 0.5) AS f FROM p),
ok AS (SELECT p.* FROM p JOIN cut USING (day), lib WHERE combined >= greatest(CASE WHEN n > 1 THEN c ELSE '-inf'::DOUBLE END, f)),
r AS (SELECT *, row_number() OVER (PARTITION BY day, user_id ORDER BY combined DESC, event_id) AS pos FROM ok)
SELECT day, event_id AS photo_id, user_id AS moment_id, combined FROM r WHERE pos = 1
"""


@query("curate_day", CURATE)
def curate_day(spark, d):
    """Each day's best, one photo a user."""
    p = photos(spark, d)
    stacks = p.select("photo_id", F.col("user_id").alias("moment_id"), F.lit(-1).cast("long").alias("primary_photo_id"))
    return curation.curate(p, p.select("photo_id", "day", "ap25", "nima"), by=["day"], moments=stacks, percent=75, library_percent=50).select("day", "photo_id", "moment_id", "combined")


@query("library_floor", "SELECT quantile_cont(0.6 * value + 0.4 * (event_id % 11)::DOUBLE, 0.5) AS floor FROM events")
def library_floor(spark, d):
    return curation.library_floor(photos(spark, d), 50)


@query(
    "photo_list_page",
    "SELECT o_orderkey, o_totalprice, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE NOT coalesce(c_acctbal < 0, false) ORDER BY o_orderdate ASC NULLS LAST, o_orderkey LIMIT 200 OFFSET 400",
)
def photo_list_page(spark, d):
    """A page of the list, rejected rows out, unscored ones in."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.where(scores.rejected_is(False, F.col("c_acctbal") < 0, F.col("c_acctbal").isNotNull()))
    return rank.page(rows, [F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey")], 400, 200).select("o_orderkey", "o_totalprice", "c_name", "c_acctbal")


@query("list_totals", "SELECT count(*) AS total, count(c_acctbal) AS scored FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000")
def list_totals(spark, d):
    """A2: the total counts before a score order drops unscored rows."""
    c = table(spark, d, "customer").where("c_acctbal > 5000")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").agg(F.count("*").alias("total"), F.count("c_acctbal").alias("scored"))


@query(
    "quality_buckets",
    """SELECT count(*) FILTER (value / 500 < 0.32) AS under, count(*) FILTER (value / 500 > 0.78 OR (event_id % 20) / 100.0 > 0.07) AS over_, count(*) FILTER (value * 10 < 150) AS out_of_focus,
       count(*) FILTER (value * 10 >= 150 AND value * 10 < 400 AND 0.6 * value + 0.4 * (event_id % 11) >= 5.8) AS blurry_keepers FROM events""",
)
def quality_buckets(spark, d):
    """P3."""
    p = photos(spark, d).withColumns({"luma": F.col("ap25") / 500, "high": (F.col("photo_id") % 20) / 100})
    test = lambda b: scores.quality_is(b, F.col("luma"), F.col("high"), F.col("blur"), F.col("ap25"), F.col("nima"))
    return p.agg(*[F.count_if(test(b)).alias(n) for b, n in (("under", "under"), ("over", "over_"), ("out_of_focus", "out_of_focus"), ("blurry_keepers", "blurry_keepers"))])


@query(
    "doctor_buckets",
    """WITH p AS (SELECT event_id, value / 500 AS luma, (event_id % 13) / 100.0 AS low, (event_id % 20) / 100.0 AS high, value * 10 AS blur, 0.6 * value + 0.4 * (event_id % 11) AS c FROM events),
       b AS (SELECT CASE WHEN luma < 0.32 OR low > 0.10 THEN 'under' WHEN luma > 0.78 OR high > 0.07 THEN 'over' END AS bucket FROM p
             UNION ALL SELECT CASE WHEN blur < 150 THEN 'out_of_focus' WHEN blur < 400 AND c >= 5.8 THEN 'blurry_keepers' END FROM p)
       SELECT bucket, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY 1""",
)
def doctor_buckets(spark, d):
    """P4."""
    p = photos(spark, d)
    b = scores.doctor_buckets(F.col("ap25") / 500, (F.col("photo_id") % 13) / 100, (F.col("photo_id") % 20) / 100, F.col("blur"), F.col("ap25"), F.col("nima"))
    return p.select(F.explode(b).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(
    "auto_reject",
    "SELECT CASE WHEN value < 30 THEN 'severe_blur' WHEN (event_id % 100) / 100.0 > 0.95 AND (event_id % 7) / 10.0 < 0.1 AND event_id % 3 = 0 THEN 'all_black' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY 1",
)
def auto_reject(spark, d):
    """P5."""
    i = F.col("event_id")
    return events(spark, d).groupBy(F.coalesce(scores.reject_reason(F.col("value"), (i % 100) / 100, (i % 7) / 10, i % 3), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("score_blends", "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CASE WHEN event_id % 3 > 0 THEN (value + event_id % 11) / 2 ELSE value END WHEN event_id % 3 > 0 THEN (event_id % 11)::DOUBLE END AS mean_score, 0.6 * (CASE WHEN event_id % 5 > 0 THEN value END) + 0.4 * (CASE WHEN event_id % 3 > 0 THEN event_id % 11 END) AS blended FROM events")
def score_blends(spark, d):
    """With one score missing the mean is of the other, the blend is null."""
    i = F.col("event_id")
    ap, nima = F.when(i % 5 > 0, F.col("value")), F.when(i % 3 > 0, (i % 11).cast("double"))
    return events(spark, d).select("event_id", scores.mean_available(nima, ap).alias("mean_score"), scores.blend(ap, nima).alias("blended"))


@query("date_filters", f"SELECT {DAY} AS day, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND (hour(ts) * 3600 + minute(ts) * 60 + epoch_us(ts) % 60000000 / 1e6) BETWEEN 59400 AND 70200 GROUP BY 1")
def date_filters(spark, d):
    """A date-only end means its midnight; hours are inclusive at both ends."""
    e = events(spark, d).where(F.col("ts").between(F.to_timestamp_ntz(F.lit("2024-01-05")), F.to_timestamp_ntz(F.lit("2024-01-20"))))
    return e.where(stories.at_hour(F.col("ts"), "golden hour")).groupBy(texts.day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


@query("include_exclude", "SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'purchase') AND event_type NOT IN ('view')")
def include_exclude(spark, d):
    """P10, P13."""
    tag = F.coalesce("event_type", F.lit(""))
    return events(spark, d).where(tag.isin("click", "view", "purchase") & ~tag.isin("view")).select("event_id")


@query("tag_join_duplicates", "SELECT o_orderkey, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def tag_join_duplicates(spark, d):
    """A photo comes once per matching tag row."""
    tags = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return table(spark, d, "orders").join(tags, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_returnflag")


@query("collapsed_list", "WITH m AS (SELECT l_orderkey AS photo_id, max(l_partkey) AS moment_id, min(l_orderkey) FILTER (l_linenumber = 1) AS p FROM lineitem GROUP BY 1) SELECT o_orderkey AS photo_id, moment_id FROM orders LEFT JOIN m ON o_orderkey = photo_id WHERE p IS NULL OR p = o_orderkey")
def collapsed_list(spark, d):
    """J3."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("photo_id"))
    members = li.agg(F.max("l_partkey").alias("moment_id"), F.min(F.when(F.col("l_linenumber") == 1, F.col("l_orderkey"))).alias("primary_photo_id"))
    return joins.collapsed(table(spark, d, "orders").select(F.col("o_orderkey").alias("photo_id")), members).select("photo_id", "moment_id")


@query("liked_semi", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def liked_semi(spark, d):
    """J5, U1."""
    return search.restricted(table(spark, d, "documents"), table(spark, d, "labels").where("quality = 1"), key="doc_id").select("doc_id", "n_chars")


@query("division_all", "SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
def division_all(spark, d):
    """J6."""
    return joins.having_all(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


@query("any_tag_semi", "SELECT DISTINCT user_id FROM events WHERE lower(event_type) IN ('click', 'error')")
def any_tag_semi(spark, d):
    """J7, U4."""
    return joins.having_any(events(spark, d), "user_id", "event_type", ["CLICK", "Error"])


@query("uncategorized", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncategorized(spark, d):
    """J8, U3."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


VISITS = f"SELECT o_orderkey AS visit_id, o_orderpriority AS name, 1704067200 + o_orderkey * 600 AS arrived, 1704067200 + o_orderkey * 600 + 900 + o_orderkey % 7 * 60 AS departed FROM orders"


def visits(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("visit_id"), F.col("o_orderpriority").alias("name"), (1_704_067_200 + k * 600).alias("arrived"), (1_704_067_200 + k * 600 + 900 + k % 7 * 60).alias("departed"))


@query("place_interval", f"WITH v AS ({VISITS}), p AS (SELECT event_id, {SECONDS} AS pos FROM events) SELECT event_id AS photo_id, arg_min(name, visit_id) AS place FROM p JOIN v ON pos BETWEEN arrived AND departed GROUP BY 1")
def place_interval(spark, d):
    """The first visit whose time holds the photo."""
    return joins.first_interval(photos(spark, d).select("photo_id", "at"), visits(spark, d), "at", "arrived", "departed", 1800, "photo_id", ["visit_id"], "name").withColumnRenamed("name", "place")


@query("place_photos", f"WITH v AS ({VISITS}) SELECT DISTINCT event_id AS photo_id FROM events JOIN v ON {SECONDS} BETWEEN arrived AND departed WHERE name = '1-URGENT'")
def place_photos(spark, d):
    """J11."""
    return joins.in_interval(photos(spark, d).select("photo_id", "at"), visits(spark, d).where("name = '1-URGENT'"), "at", "arrived", "departed", 1800).select("photo_id").distinct()


PAIRS = f"SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 SECOND AND (b.ts > a.ts OR a.event_id < b.event_id)"


@query("burst_pairs", PAIRS)
def burst_pairs(spark, d):
    """J12."""
    return joins.band_pairs(photos(spark, d).select("photo_id", "at"), "at", "photo_id", 12).select(F.col("photo_id_a").alias("a"), F.col("photo_id_b").alias("b"))


#: Every photo has a vector; every fifth a place; every third no face, the others one of two.
GATED = f"""SELECT a.event_id AS a, b.event_id AS b FROM (SELECT event_id AS a0, ts AS t0 FROM events) JOIN events b ON b.ts >= t0 AND b.ts <= t0 + INTERVAL 12 SECOND AND (b.ts > t0 OR a0 < b.event_id) JOIN events a ON a.event_id = a0
 JOIN embeddings va ON va.vec_id = a.event_id % (SELECT count(*) FROM embeddings) JOIN embeddings vb ON vb.vec_id = b.event_id % (SELECT count(*) FROM embeddings)
 WHERE list_cosine_similarity(va.embedding::DOUBLE[], vb.embedding::DOUBLE[]) >= -0.05
 AND (a.event_id % 5 > 0 OR b.event_id % 5 > 0 OR sqrt(((a.event_id % 97 - b.event_id % 97) * 0.001) ** 2 + ((a.event_id % 89 - b.event_id % 89) * 0.001) ** 2) <= 0.0002)
 AND CASE WHEN a.event_id % 3 = 0 AND b.event_id % 3 = 0 THEN true WHEN a.event_id % 3 = 0 OR b.event_id % 3 = 0 THEN false ELSE a.event_id % 2 = b.event_id % 2 END"""
BURSTS = f"""WITH RECURSIVE e AS ({GATED}), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a),
c AS (SELECT a AS photo_id, least(a, min(b)) AS moment_id FROM r GROUP BY 1)
SELECT moment_id, photo_id, row_number() OVER (PARTITION BY moment_id ORDER BY 0.6 * (event_id % 11)::DOUBLE + 0.4 * least(value * 10 / 1000, 1.0) DESC, ts, photo_id) - 1 AS rank FROM c JOIN events ON event_id = photo_id"""


def bursts(spark, d):
    """Burst members, by time, place, vector and faces."""
    i = F.col("photo_id")
    place = lambda c: F.when(i % 5 == 0, F.col(c)).alias(c)
    none = F.array().cast("array<array<double>>")
    faces = F.when(i % 3 == 0, none).otherwise(F.array(F.array(*[F.when(i % 2 == k, 1.0).otherwise(0.0) for k in (0, 1)]))).alias("faces")
    p = with_vectors(spark, d, unit=False).select("photo_id", "at", place("lat"), place("lon"), "v", faces, F.col("nima").alias("iqa"), "blur")
    return moments.burst_members(p, moments.burst_links(p, similar=-0.05))


@query("burst_members", BURSTS)
def burst_members(spark, d):
    """C1, C3, J12, J13, W11."""
    return bursts(spark, d).select("moment_id", "photo_id", "rank")


@query("burst_moments", f"WITH m AS ({BURSTS}) SELECT moment_id, arg_min(photo_id, rank) AS primary_photo_id, min({SECONDS}) AS started_at, max({SECONDS}) AS ended_at, count(*) AS size FROM m JOIN events ON event_id = photo_id GROUP BY 1".replace("WITH m AS (WITH RECURSIVE", "WITH RECURSIVE m AS (WITH RECURSIVE"))
def burst_moments(spark, d):
    """A14."""
    return moments.burst_moments(bursts(spark, d))


@query("face_identity", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE CASE WHEN a.vec_id % 4 = 0 AND b.vec_id % 4 = 0 THEN true WHEN a.vec_id % 4 = 0 OR b.vec_id % 4 = 0 THEN false ELSE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.05 END")
def face_identity(spark, d):
    """J13."""
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 4 == 0, F.array().cast("array<array<float>>")).otherwise(F.array("embedding")).alias("faces"))
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("faces").alias("other"))
    return e.join(b, F.col("vec_id") == F.col("a")).where(joins.shares_identity(F.col("faces"), F.col("other"), 0.05)).select("a", "b")


LOOK = """p AS (SELECT *, embedding::DOUBLE[] AS v, [vec_id % 7, label, vec_id % 3, 5.5]::DOUBLE[] AS look FROM embeddings), c AS (SELECT *, list_transform(look, lambda x: x - list_avg(look)) AS centred FROM p)"""


@query("near_dup_pairs", f"WITH {LOOK} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM c a JOIN c b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.2 AND list_cosine_similarity(a.centred, b.centred) >= 0.93")
def near_dup_pairs(spark, d):
    """Alike as vectors and in appearance."""
    e, i = table(spark, d, "embeddings"), F.col("vec_id")
    look = F.array(*[c.cast("double") for c in (i % 7, F.col("label"), i % 3, F.lit(5.5))])
    return dedup.near_pairs(e.withColumn("look", look), 0.2, key="vec_id", appearance="look", most=None).withColumn("similarity", F.round("similarity", 6))


@query("nearest_place", f"""WITH c AS (SELECT n_nationkey AS id, n_name AS name, 34 + n_nationkey * 0.004 AS plat, 77 + n_nationkey * 0.0035 AS plon FROM nation),
 p AS (SELECT event_id, {LAT} AS lat, {LON} AS lon FROM events), r AS (SELECT event_id, name, id, sqrt((lat - plat) ** 2 + (lon - plon) ** 2) AS d FROM p, c)
 SELECT event_id AS photo_id, arg_min(name, (round(d, 9), id)) AS place FROM r WHERE d < 0.0105 GROUP BY 1""")
def nearest_place(spark, d):
    """J15."""
    k = F.col("n_nationkey")
    places = table(spark, d, "nation").select(k.alias("id"), F.col("n_name").alias("place"), (34 + k * 0.004).alias("plat"), (77 + k * 0.0035).alias("plon"))
    return joins.nearest_within(
        photos(spark, d).select("photo_id", "lat", "lon"), places, key="photo_id", lat="lat", lon="lon", place_lat="plat", place_lon="plon",
        limit=0.0105, measure="degrees", strict=True, order=["id"], take="place",
    )


@query("landmark_radius", f"""WITH c AS (SELECT n_nationkey AS id, n_name AS name, 34 + n_nationkey * 0.004 AS plat, 77 + n_nationkey * 0.0035 AS plon, least(500 + n_nationkey * 100, 1500) AS radius FROM nation),
 p AS (SELECT event_id, {LAT} AS lat, {LON} AS lon FROM events),
 r AS (SELECT event_id, name, id, radius, round(1000 * sqrt(((lat - plat) * 111.0) ** 2 + ((lon - plon) * 111.32 * cos(radians((lat + plat) / 2))) ** 2), 6) AS d FROM p, c)
 SELECT event_id AS photo_id, arg_min(name, (d, id)) AS place FROM r WHERE d <= radius GROUP BY 1""")
def landmark_radius(spark, d):
    """J16, M3."""
    k = F.col("n_nationkey")
    places = table(spark, d, "nation").select(k.alias("id"), F.col("n_name").alias("place"), (34 + k * 0.004).alias("plat"), (77 + k * 0.0035).alias("plon"), F.least(500 + k * 100, F.lit(1500)).alias("radius"))
    return joins.nearest_within(
        photos(spark, d).select("photo_id", "lat", "lon"), places, key="photo_id", lat="lat", lon="lon", place_lat="plat", place_lon="plon",
        limit="radius", measure="flat", strict=False, order=["id"], take="place", digits=6,
    )


@query("id_union", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(quality, -1) AS quality FROM labels a FULL JOIN (SELECT doc_id FROM documents WHERE n_chars > 3000) b ON a.doc_id = b.doc_id")
def id_union(spark, d):
    """J18."""
    long = table(spark, d, "documents").where("n_chars > 3000").select("doc_id")
    return table(spark, d, "labels").join(long, "doc_id", "full").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("nested_members", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS orders_ FROM orders GROUP BY 1")
def nested_members(spark, d):
    """One grouped join instead of a query per parent."""
    o = table(spark, d, "orders").groupBy("o_custkey")
    return o.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda s: s["o_orderkey"].cast("string")), ",").alias("orders_"))


@query("swipe_summary", "SELECT count(*) FILTER (quality = 1) AS kept, count(*) FILTER (quality = 0) AS rejected, (SELECT count(*) FROM documents) - count(*) AS undecided FROM labels")
def swipe_summary(spark, d):
    """A3."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.agg(F.count_if(F.col("quality") == 1).alias("kept"), F.count_if(F.col("quality") == 0).alias("rejected"), F.count_if(F.col("quality").isNull()).alias("undecided"))


@query("facet_counts", f"SELECT 'day' AS facet, {DAY} AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'tag', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'person', user_id::VARCHAR, count(*) FROM events GROUP BY 2")
def facet_counts(spark, d):
    """A4."""
    e = events(spark, d)
    return aggregate.facet_counts(day=e.select(texts.day(F.col("ts")).alias("day")), tag=e.select("event_type"), person=e.select("user_id"))


@query("percentile_flavours", "SELECT event_type, quantile_cont(value, 0.95) AS linear, list_sort(list(value))[1 + floor(0.95 * (count(*) - 1))::INT] AS nearest, list_sort(list(value))[1 + (count(*) // 2)::INT] AS upper_median FROM events GROUP BY 1")
def percentile_flavours(spark, d):
    """A5, A7, A8, A18."""
    return rank.group_elements(events(spark, d), ["event_type"], "value", {"linear": rank.linear_place(95), "nearest": rank.nearest_place(95), "upper_median": rank.upper_median_place})


@query("map_bins", f"SELECT round_even({LAT} / 0.013, 0)::BIGINT AS cell_lat, round_even({LON} / 0.013, 0)::BIGINT AS cell_lon, count(*) AS n, round(avg({LAT}), 9) AS lat, round(avg({LON}), 9) AS lon, arg_max(event_id, (ts, event_id)) AS cover FROM events GROUP BY 1, 2")
def map_bins(spark, d):
    """A9."""
    out = aggregate.map_bins(photos(spark, d), "lat", "lon", 0.013, "photo_id", ["taken_at", "photo_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("lat", "lon")})


@query("exact_dups", "SELECT sha256(text) AS sha256, count(*) AS n, arg_max(doc_id, (n_chars, -doc_id)) AS keeper, (sum(n_chars) - max(n_chars))::BIGINT AS reclaimable FROM documents GROUP BY 1 HAVING count(*) >= 2")
def exact_dups(spark, d):
    """A10, A11."""
    return aggregate.exact_duplicates(table(spark, d, "documents").withColumn("sha256", F.sha2("text", 256)), "sha256", "doc_id", F.lit(None).cast("double"), F.col("n_chars"))


@query("dup_report", """WITH RECURSIVE p AS (SELECT doc_id, sha256(text) AS h, n_chars, embedding::DOUBLE[] AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
 x AS (SELECT h, count(*) AS n, sum(n_chars) - max(n_chars) AS r FROM p GROUP BY 1 HAVING count(*) >= 2),
 k AS (SELECT * FROM p WHERE v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x WHERE x.h = p.h)),
 e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.doc_id < b.doc_id WHERE list_cosine_similarity(a.v, b.v) >= 0.4), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a), c AS (SELECT a AS doc_id, least(a, min(b)) AS g FROM r GROUP BY 1),
 g AS (SELECT g, count(*) AS n, sum(n_chars) - max(n_chars) AS r FROM c JOIN p USING (doc_id) GROUP BY 1)
 SELECT kind, count(*) AS groups, sum(n)::BIGINT AS photos, sum(r)::BIGINT AS reclaimable FROM (SELECT 'exact' AS kind, n, r FROM x UNION ALL SELECT 'near', n, r FROM g) GROUP BY 1""")
def dup_report(spark, d):
    """Exact and near groups; a document's vector is that of its id."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.lit(None).cast("double").alias("iqa"), F.col("n_chars").alias("size_bytes"))
    return dedup.report(docs.join(e, "doc_id", "left"), 0.4, key="doc_id", most=None)


NEAR = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4"


@query("near_groups", f"""WITH RECURSIVE e AS ({NEAR}), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a),
 c AS (SELECT a AS vec_id, least(a, min(b)) AS group_id FROM r GROUP BY 1)
 SELECT group_id, count(*) AS n, arg_max(vec_id, (label, vec_id % 1000, -vec_id)) AS keeper, (sum(vec_id % 1000) - arg_max(vec_id % 1000, (label, vec_id % 1000, -vec_id)))::BIGINT AS reclaimable FROM c JOIN embeddings USING (vec_id) GROUP BY 1""")
def near_groups(spark, d):
    """Groups of like vectors, label as quality."""
    e = table(spark, d, "embeddings")
    p = e.select("vec_id", F.col("label").cast("double").alias("iqa"), (F.col("vec_id") % 1000).alias("size_bytes"))
    return dedup.near_groups(p, dedup.near_pairs(e, 0.4, key="vec_id", most=None), key="vec_id")


@query("primary_tag", "SELECT l_orderkey, l_returnflag AS tag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def primary_tag(spark, d):
    """W1."""
    return rank.top_per_group(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")]).select("l_orderkey", F.col("l_returnflag").alias("tag"))


@query("top_per_day", f"SELECT {DAY} AS day, event_id FROM events QUALIFY row_number() OVER (PARTITION BY {DAY} ORDER BY value DESC, event_id) <= 120")
def top_per_day(spark, d):
    """W2."""
    return rank.top_per_group(photos(spark, d), ["day"], [F.desc("ap25"), F.col("photo_id")], 120).select("day", F.col("photo_id").alias("event_id"))


ZSCORE = """WITH t AS (SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
cv AS (SELECT label AS tag, list(c ORDER BY i) AS c FROM t GROUP BY 1),
s AS (SELECT vec_id, tag, list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(c, c)) AS sim FROM embeddings, cv),
z AS (SELECT vec_id, tag, (sim - avg(sim) OVER (PARTITION BY tag)) / greatest(stddev_pop(sim) OVER (PARTITION BY tag), 1e-6) AS z FROM s)
SELECT vec_id, tag, round(z, 5) AS z FROM z WHERE z >= 0.5 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, tag) <= 3"""


@query("zscore_tags", ZSCORE)
def zscore_tags(spark, d):
    """Tags whose similarity stands out among all photos, three a photo."""
    e = table(spark, d, "embeddings")
    centres = aggregate.mean_vectors(e.select(F.col("label").alias("tag"), "embedding"), ["tag"], "embedding").select("tag", "centroid")
    # The tag vocabulary is a fixed list, so it is broadcast against every photo.
    s = e.select("vec_id", "embedding").join(F.broadcast(centres), F.lit(True)).select("vec_id", "tag", vec.dot(F.col("embedding"), F.col("centroid")).alias("sim"))
    stats = s.groupBy("tag").agg(F.avg("sim").alias("m"), F.greatest(F.stddev_pop("sim"), F.lit(1e-6)).alias("sd"))
    z = s.join(F.broadcast(stats), "tag").withColumn("z", (F.col("sim") - F.col("m")) / F.col("sd")).where("z >= 0.5")
    return rank.top_per_group(z, ["vec_id"], [F.desc("z"), F.col("tag")], 3).select("vec_id", "tag", F.round("z", 5).alias("z"))


@query("calibrate_rank", "SELECT o_orderkey, round(p, 6) AS p FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) / greatest(1, count(*) OVER () - 1) * 100 AS p FROM orders)")
def calibrate_rank(spark, d):
    """W4 over a whole table: numbered by ranges, not in one task."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    n = o.agg(F.count("*").alias("n"))
    return rank.global_rank(o, [F.col("o_totalprice"), F.col("o_orderkey")], "r").join(F.broadcast(n), F.lit(True)).select("o_orderkey", F.round(F.col("r") / F.greatest(F.lit(1), F.col("n") - 1) * 100, 6).alias("p"))


@query("average_percent", "SELECT event_id, round(CASE WHEN n > 1 THEN (r - 1 + (t - 1) / 2) / (n - 1) ELSE 1.0 END, 9) AS p FROM (SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type, value) AS t, count(*) OVER (PARTITION BY event_type) AS n FROM events)")
def average_percent(spark, d):
    """W5."""
    e = events(spark, d).select("event_id", "event_type", "value")
    return rank.average_percents(e, "value", ["event_type"], "p").select("event_id", F.round("p", 9).alias("p"))


@query("extremes", "(SELECT 'low' AS side, event_id FROM events ORDER BY value, event_id LIMIT 50) UNION ALL (SELECT 'high', event_id FROM events ORDER BY value DESC, event_id DESC LIMIT 50)")
def extremes(spark, d):
    """W6."""
    e, order = events(spark, d), [F.col("value"), F.col("event_id")]
    low, high = rank.extremes(e, order, 50, False), rank.extremes(e, order, 50, True)
    return low.select(F.lit("low").alias("side"), "event_id").union(high.select(F.lit("high"), "event_id"))


@query("scene_islands", f"""WITH p AS (SELECT user_id, event_id, {SECONDS} AS pos, embedding::DOUBLE[] AS v FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings)),
 f AS (SELECT *, coalesce(pos - lag(pos) OVER w > 3600 AND list_cosine_similarity(v, lag(v) OVER w) < 0.05, false)::INT AS new FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos, event_id))
 SELECT event_id AS photo_id, (sum(new) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS scene FROM f""")
def scene_islands(spark, d):
    """W7."""
    return islands.scenes(with_vectors(spark, d, unit=False), ["user_id"], "at", "v", "photo_id", gap=3600, similar=0.05).select("photo_id", "scene")


HAVERSINE = "2 * {r} * asin(sqrt(sin(radians({b} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({b})) * sin(radians({d} - {c}) / 2) ** 2))"


@query("session_blocks", f"""WITH p AS (SELECT user_id, event_id, {SECONDS} AS pos, {LAT} AS lat, {LON} AS lon FROM events),
 l AS (SELECT *, lag(pos) OVER w AS t0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos, event_id)),
 f AS (SELECT *, (coalesce(pos - t0 > 5400, false) OR coalesce({HAVERSINE.format(r=6371000.0, a='lat0', b='lat', c='lon0', d='lon')} > 5000, false))::INT AS new FROM l)
 SELECT event_id AS photo_id, (sum(new) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS block FROM f""")
def session_blocks(spark, d):
    """W8, M2."""
    return islands.sessions(photos(spark, d), ["user_id"], "at", "lat", "lon", "photo_id", metres=5000).select("photo_id", "block")


@query("route_km", f"""WITH p AS (SELECT user_id, ts, event_id, {LAT} AS lat, {LON} AS lon FROM events),
 l AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT user_id, round(sum({HAVERSINE.format(r=6371.0088, a='lat0', b='lat', c='lon0', d='lon')}), 6) AS km FROM l GROUP BY 1""")
def route_km(spark, d):
    """W9, A16."""
    return islands.route_km(photos(spark, d), ["user_id"], ["taken_at", "photo_id"], "lat", "lon").withColumn("km", F.round("km", 6))


@query("highlight_runs", """WITH p AS (SELECT user_id, event_id::DOUBLE AS t, value > 20 AS good FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - row_number() OVER (PARTITION BY user_id, good ORDER BY t) AS run FROM p)
 SELECT user_id, round(min(t), 3) AS start, round(max(t), 3) AS "end", count(*) AS frames FROM r WHERE good GROUP BY user_id, run HAVING count(*) >= 2""")
def highlight_runs(spark, d):
    """W10."""
    e = events(spark, d).select("user_id", F.col("event_id").cast("double").alias("t"), (F.col("value") > 20).alias("good"))
    return islands.good_runs(e, ["user_id"], "t", "good")


@query("pearson_hist", """SELECT 'corr' AS kind, 0 AS bin, round(corr(l_quantity, l_extendedprice), 6) AS v FROM lineitem
 UNION ALL SELECT 'hist', least(19, floor((l_extendedprice - lo) / ((hi - lo) / 20)))::INT, count(*)::DOUBLE FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 2""")
def pearson_hist(spark, d):
    """A25, A26."""
    li = table(spark, d, "lineitem")
    c = li.agg(F.round(aggregate.pearson(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("v")).select(F.lit("corr").alias("kind"), F.lit(0).alias("bin"), "v")
    return c.union(aggregate.histogram(li, "l_extendedprice").select(F.lit("hist"), "bin", F.col("n").cast("double")))


@query("rank_auc", "WITH r AS (SELECT l.quality AS y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM labels l JOIN documents USING (doc_id)) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auc FROM r")
def rank_auc(spark, d):
    """A24."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return aggregate.rank_auc(rows, F.col("quality") == 1, "n_chars").select(F.round("auc", 9).alias("auc"))


@query("trip_kind", "WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT event_type, count(*) FILTER (n >= greatest(3, floor(t * 0.05))) AS k FROM c JOIN (SELECT event_type, sum(n) / 8 AS t FROM c GROUP BY 1) USING (event_type) GROUP BY 1) SELECT event_type, CASE WHEN k = 0 THEN 'unknown' WHEN k = 1 THEN 'solo' WHEN k = 2 THEN 'couple' WHEN k <= 6 THEN 'group' ELSE 'event' END AS kind FROM k")
def trip_kind(spark, d):
    """A27, with an eighth of the rows as the number of photos."""
    c = events(spark, d).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return c.groupBy("event_type").agg(aggregate.trip_kind(F.sum("n") / 8, F.collect_list("n")).alias("kind"))


@query("cluster_list", """WITH best AS (SELECT l_orderkey, arg_min(l_returnflag || l_linestatus, (-l_extendedprice, l_returnflag || l_linestatus)) AS tag FROM lineitem GROUP BY 1),
 r AS (SELECT coalesce(tag, 'uncategorized') AS tag, o_orderkey, row_number() OVER (PARTITION BY coalesce(tag, 'uncategorized') ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS pos FROM orders LEFT JOIN best ON l_orderkey = o_orderkey)
 SELECT tag, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY pos) FILTER (pos <= 4) AS samples, min(o_orderkey) FILTER (pos = 1) AS cover FROM r GROUP BY 1""")
def cluster_list(spark, d):
    """A28."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("photo_id"), F.col("o_totalprice").alias("iqa"))
    tags = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.concat("l_returnflag", "l_linestatus").alias("tag"), F.col("l_extendedprice").alias("score"))
    return aggregate.clusters(o, tags).withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


@query("tags_by_source", "SELECT l_orderkey, coalesce(nullif(l_returnflag, 'N'), 'legacy') AS source, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_extendedprice DESC, l_linenumber) AS tags FROM lineitem GROUP BY 1, 2")
def tags_by_source(spark, d):
    """A32."""
    li = table(spark, d, "lineitem")
    source = F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("legacy")).alias("source")
    tags = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("s"), "l_linenumber"))), lambda s: s["l_linenumber"].cast("string"))
    return li.groupBy("l_orderkey", source).agg(F.array_join(tags, ",").alias("tags"))


@query("json_counts", "SELECT (json_extract(props, '$.k')::INT) % 10 AS k, count(*) AS n, count(*) FILTER (value > 50) AS good FROM events GROUP BY 1")
def json_counts(spark, d):
    """A29, N1."""
    k = F.from_json("props", "k int")["k"]
    return events(spark, d).groupBy((k % 10).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("good"))


@query("distinct_probes", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, (SELECT count(*) > 0 FROM events WHERE value > 400) AS some FROM events")
def distinct_probes(spark, d):
    """A30."""
    return events(spark, d).agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.bool_or(F.col("value") > 400).alias("some"))


QUERY = [1.0 if k % 3 == 0 else 0.0 for k in range(64)]
QSQL = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"
COSQL = f"list_dot_product(embedding::DOUBLE[], {QSQL}) / ((sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9) * (sqrt(22.0) + 1e-9))"


@query("vector_topk", f"SELECT vec_id, round({COSQL}, 6) AS similarity FROM embeddings ORDER BY {COSQL} DESC, vec_id LIMIT 60")
def vector_topk(spark, d):
    """T4, M1."""
    return search.top_k(table(spark, d, "embeddings"), QUERY, 60, key="vec_id").withColumn("similarity", F.round("similarity", 6))


@query("hybrid_search", f"""WITH s AS (SELECT vec_id, {COSQL} AS sem, CASE WHEN label IN (3) THEN 1 ELSE 0 END AS hits FROM embeddings),
 t AS (SELECT *, sem + CASE WHEN hits > 0 THEN 10.0 + (hits - 1) ELSE 0 END AS score, hits > 0 OR max(sem) OVER () <= 0 OR sem >= 0.55 * max(sem) OVER () AS keep FROM s),
 r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS pos FROM t)
 SELECT vec_id, hits::BIGINT AS hits, round(score, 6) AS score FROM r WHERE (keep OR pos <= 12) AND pos <= 60""")
def hybrid_search(spark, d):
    """C15, X1, X2, U1."""
    e = table(spark, d, "embeddings")
    tags = e.select("vec_id", F.concat(F.lit("label"), F.col("label").cast("string")).alias("tag"))
    return search.hybrid(e, tags, ["label3"], QUERY, key="vec_id").select("vec_id", "hits", F.round("score", 6).alias("score"))


@query("stories_like", f"SELECT label AS story_id, vec_id, round({COSQL}, 6) AS similarity, round(max({COSQL}) OVER (PARTITION BY label), 6) AS best FROM embeddings QUALIFY max({COSQL}) OVER (PARTITION BY label) >= 0.25")
def stories_like(spark, d):
    """A31."""
    e = table(spark, d, "embeddings").withColumnRenamed("label", "story_id")
    return search.stories_like(e, QUERY, key="vec_id", least=0.25).withColumns({c: F.round(c, 6) for c in ("similarity", "best")})


@query("quota_spill", f"""WITH p AS (SELECT {DAY} AS day, event_id, value, row_number() OVER (PARTITION BY {DAY} ORDER BY value DESC, event_id) AS r FROM events), q AS (SELECT greatest(1, 40 // count(DISTINCT day)) AS q FROM p),
 t AS (SELECT day, event_id FROM p, q WHERE r <= q), l AS (SELECT day, event_id, row_number() OVER (ORDER BY value DESC, event_id) AS pos FROM p, q WHERE r > q)
 SELECT day, event_id FROM t UNION ALL SELECT day, event_id FROM l WHERE pos <= 40 - (SELECT count(*) FROM t)""")
def quota_spill(spark, d):
    """T8."""
    p = photos(spark, d)
    return rank.quota_then_best(p, "day", F.col("ap25"), "photo_id", 40).select("day", F.col("photo_id").alias("event_id"))


@query("top_places", "SELECT event_type AS place, count(*) AS n FROM events WHERE value > 40 GROUP BY 1 HAVING count(*) >= 10 ORDER BY n DESC, min(event_id) LIMIT 3")
def top_places(spark, d):
    """T7."""
    g = events(spark, d).where("value > 40").groupBy(F.col("event_type").alias("place")).agg(F.count("*").alias("n"), F.min("event_id").alias("first")).where("n >= 10")
    return g.orderBy(F.desc("n"), "first").limit(3).select("place", "n")


@query("score_order", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 100")
def score_order(spark, d):
    """T3, T10, T11."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.orderBy(*rank.photo_order("aesthetic", aesthetic="quality", key="doc_id")).limit(100).select("doc_id")


@query("random_unrated")
def random_unrated(spark, d):
    """One random row without a label."""
    return uncategorized(spark, d).orderBy(F.rand(7)).limit(1)


@query("upsert_latest", "WITH u AS (SELECT doc_id, quality, 0 AS seq FROM labels UNION ALL SELECT doc_id, toxic, 1 FROM labels WHERE doc_id % 3 = 0) SELECT doc_id, arg_max(quality, seq) AS quality, max(seq) AS seq, min(seq) AS first_seq FROM u GROUP BY 1")
def upsert_latest(spark, d):
    """K4: the last decision, the first time."""
    lab = table(spark, d, "labels")
    old = lab.select("doc_id", "quality", F.lit(0).alias("seq"), F.lit(0).alias("first_seq"))
    new = lab.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("quality"), F.lit(1).alias("seq"), F.lit(1).alias("first_seq"))
    return mutate.upserted(old, new, ["doc_id"], "seq", ["first_seq"])


@query("insert_absent", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_absent(spark, d):
    """K3."""
    return mutate.inserted_if_absent(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality")), ["doc_id"])


@query("replace_slice", "SELECT doc_id, quality, toxic FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, 9, 1 FROM labels WHERE quality = 1")
def replace_slice(spark, d):
    """K1, K2."""
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return mutate.slice_replaced(lab, lab.where("quality = 1").select("doc_id", F.lit(9).alias("quality"), F.lit(1).alias("toxic")), F.col("toxic") == 1)


@query("update_columns", "SELECT doc_id, coalesce(quality, -1) AS quality, lang FROM documents LEFT JOIN labels USING (doc_id)")
def update_columns(spark, d):
    """K5."""
    old = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"), "lang")
    return mutate.columns_updated(old, table(spark, d, "labels"), "doc_id", ["quality"])


@query("merge_persons", """WITH m AS (SELECT l_orderkey AS photo_id, CASE WHEN l_suppkey IN (1, 2, 3) THEN 0 ELSE l_suppkey END AS person_id, l_linenumber AS f, l_extendedprice AS c, (l_suppkey = 0)::INT AS own FROM lineitem)
 SELECT person_id, count(DISTINCT photo_id) AS photo_count FROM m GROUP BY 1""")
def merge_persons(spark, d):
    """K6."""
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.col("l_suppkey").alias("person_id"), F.col("l_linenumber").alias("face_embedding_id"), F.col("l_extendedprice").alias("confidence"))
    return mutate.merged_persons(links, [1, 2, 3], 0)[1]


@query("set_primary", "SELECT l_orderkey AS moment_id, l_linenumber AS photo_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber <> 3)::INT, l_extendedprice, l_linenumber) - 1 AS rank FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_extendedprice)")
def set_primary(spark, d):
    """K7."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("moment_id"), F.col("l_linenumber").alias("photo_id")).agg(F.min("l_extendedprice").alias("rank"))
    return mutate.primary_set(li, li.select("moment_id").distinct().withColumn("photo_id", F.lit(3)))


@query("rename_label", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'people:' || replace(o_orderpriority, 'HIGH', 'Alice') ELSE 'place:' || o_orderpriority END AS day FROM orders")
def rename_label(spark, d):
    """K8, P14."""
    day = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "people:").otherwise("place:"), "o_orderpriority")
    return mutate.label_renamed(table(spark, d, "orders").select("o_orderkey", day.alias("day"), F.lit("").alias("title")), "HIGH", "Alice").select("o_orderkey", "day")


@query("export_plan", f"SELECT event_id AS photo_id, {DAY} || '/' || printf('%03d_%s', event_id % 40, event_type || '.jpg') AS target FROM events")
def export_plan(spark, d):
    """K10, K12, K13, X3."""
    e = events(spark, d)
    items = e.select(F.col("event_id").alias("photo_id"), F.concat(F.lit("/lib/"), "event_type", F.lit(".jpg")).alias("path"), texts.day(F.col("ts")).alias("day"), (F.col("event_id") % 40).alias("rank"))
    return export.export_plan(items, by_day=True).select("photo_id", "target")


@query("rating_plan", """WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'liked' WHEN 1 THEN 'curated' WHEN 2 THEN 'rejected' ELSE 'other' END AS verdict, doc_id % 5 > 0 AS present, CASE WHEN doc_id % 3 = 0 THEN '.NEF' ELSE '.jpg' END AS ext FROM documents),
 r AS (SELECT *, CASE verdict WHEN 'liked' THEN 5 WHEN 'curated' THEN 4 WHEN 'rejected' THEN 1 ELSE 0 END AS n, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 6)::INT END AS old FROM p)
 SELECT doc_id AS photo_id, CASE WHEN n = 0 OR NOT present THEN 'no_op' WHEN old > n THEN 'skip_lower' WHEN old = n THEN 'skip_same' ELSE 'write' END AS action, n > 0 AND ext = '.NEF' AS is_sidecar FROM r""")
def rating_plan(spark, d):
    """K11."""
    i = F.col("doc_id")
    path = F.concat(F.lit("/lib/"), i.cast("string"), F.when(i % 3 == 0, ".NEF").otherwise(".jpg"))
    verdict = F.when(i % 4 == 0, "liked").when(i % 4 == 1, "curated").when(i % 4 == 2, "rejected").otherwise("other")
    p = table(spark, d, "documents").select(i.alias("photo_id"), path.alias("path"), verdict.alias("verdict"), (i % 5 > 0).alias("present"))
    old = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.when((i % 3 == 0) & (i % 4 != 3), F.concat(F.lit("/lib/"), i.cast("string"), F.lit(".xmp"))).otherwise(path).alias("target"), (i % 6).cast("int").alias("existing_rating"))
    return export.rating_plan(p, old).select("photo_id", "action", "is_sidecar")


@query("date_phrases", "SELECT o_custkey, CASE WHEN lo = hi THEN strftime(lo, '%B %-d, %Y') WHEN year(lo) = year(hi) AND month(lo) = month(hi) THEN strftime(lo, '%B %-d') || '–' || strftime(hi, '%-d, %Y') WHEN year(lo) = year(hi) THEN strftime(lo, '%B %-d') || ' – ' || strftime(hi, '%B %-d, %Y') ELSE strftime(lo, '%B %-d, %Y') || ' – ' || strftime(hi, '%B %-d, %Y') END AS phrase FROM (SELECT o_custkey, min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders GROUP BY 1)")
def date_phrases(spark, d):
    """D1."""
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return g.select("o_custkey", texts.date_range(F.col("lo"), F.col("hi")).alias("phrase"))


@query("text_functions", r"""SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name || ' of ' || p_type), '[a-z0-9]+'), lambda w: len(w) > 2) AS words, regexp_replace(p_name || ' (' || p_size || ')', '\s*\(\d+\)$', '') AS base,
 CASE WHEN contains(p_name || ' ' || lower(p_type), 'red') THEN 'Warm' WHEN contains(p_name || ' ' || lower(p_type), 'ring') THEN 'Rings' END AS bucket, CASE WHEN p_size > 0 THEN p_name || ' (' || format('{:,}', p_size * 1000) || 'm)' ELSE p_name END AS crumb FROM part""")
def text_functions(spark, d):
    """X1 to X5, X8."""
    p = table(spark, d, "part")
    tags = F.array("p_name", "p_type")
    return p.select(
        "p_partkey", texts.query_words(F.concat("p_name", F.lit(" of "), "p_type")).alias("words"), texts.strip_number(F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))).alias("base"),
        texts.keyword_bucket(tags, {"Warm": ["red"], "Rings": ["ring"]}).alias("bucket"), texts.breadcrumb(F.array(F.struct(F.col("p_name").alias("name"), (F.col("p_size") * 1000).alias("elevation_m")))).alias("crumb"),
    )


@query("geo_distances", f"SELECT event_id, round({HAVERSINE.format(r=6371000.0, a='34.05', b=LAT, c='77.02', d=LON)}, 4) AS metres, round(sqrt((({LAT}) - 34.05) ** 2 + (({LON}) - 77.02) ** 2), 9) AS degrees, round(sqrt((({LAT} - 34.05) * 111.0) ** 2 + (({LON} - 77.02) * 111.32 * cos(radians(({LAT} + 34.05) / 2))) ** 2), 6) AS km FROM events")
def geo_distances(spark, d):
    """M2 to M4."""
    a = (F.lit(34.05), F.lit(77.02), F.col("lat"), F.col("lon"))
    return photos(spark, d).select(F.col("photo_id").alias("event_id"), F.round(geo.haversine_m(*a), 4).alias("metres"), F.round(geo.degrees_apart(*a), 9).alias("degrees"), F.round(geo.equirect_km(*a), 6).alias("km"))


@query("score_functions", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 9) AS sig, 0.4 * least(1.0, greatest(0.0, (value * 10 - 100) / 900)) AS ramp, round(0.5 * least(1.0, value * 10 / 200) + 0.5 * (event_id % 10) / 10.0, 9) AS quality, value * 10 >= 100 AND (event_id % 10) / 10.0 >= 0.35 AS good FROM events")
def score_functions(spark, d):
    """M5, M9, M10."""
    blur, exposure = F.col("value") * 10, (F.col("event_id") % 10) / 10
    return events(spark, d).select("event_id", F.round(scores.sigmoid((F.col("value") - 50) / 10), 9).alias("sig"), scores.taste_weight(F.col("value") * 10).alias("ramp"), F.round(scores.frame_quality(blur, exposure), 9).alias("quality"), scores.frame_good(blur, exposure).alias("good"))


@query("box_overlap", "SELECT l_orderkey, l_linenumber, round(i / (l_quantity * 20 + 400 - i), 9) AS iou FROM (SELECT *, greatest(0, least(l_discount * 100 + l_quantity, 25) - greatest(l_discount * 100, 5)) * greatest(0, least(l_tax * 100 + 20, 25) - greatest(l_tax * 100, 5)) AS i FROM lineitem)")
def box_overlap(spark, d):
    """M8."""
    v = lambda x: F.lit(float(x))
    i = vec.iou(F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_quantity"), v(20), v(5), v(5), v(20), v(20))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(i, 9).alias("iou"))


@query("face_penalties", """WITH f AS (SELECT l_orderkey AS photo_id, l_discount * 10 AS eyes, (l_quantity - 25) * 2 AS yaw, l_tax / 8 AS area FROM lineitem),
 g AS (SELECT photo_id, count(*) FILTER (area >= 0.005) AS nb, count(*) FILTER (area >= 0.005 AND eyes < 0.35) AS cb, count(*) FILTER (area >= 0.005 AND abs(yaw) <= 30) AS fb, count(*) AS na, count(*) FILTER (eyes < 0.35) AS ca, count(*) FILTER (abs(yaw) <= 30) AS fa FROM f GROUP BY 1),
 p AS (SELECT photo_id, CASE WHEN nb > 0 THEN nb ELSE na END AS n, CASE WHEN nb > 0 THEN cb ELSE ca END AS c, CASE WHEN nb > 0 THEN fb ELSE fa END AS fr FROM g)
 SELECT photo_id, round(least(0.5, CASE WHEN c = 0 THEN 0 WHEN n = 1 THEN 0.30 WHEN n >= 3 AND fr >= ceil(0.6 * n) THEN 0.45 * c ELSE 0.20 * c END), 6) AS penalty FROM p""")
def face_penalties(spark, d):
    """A21, A22."""
    from lumiquarry.functions import faces

    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("photo_id"), (F.col("l_discount") * 10).alias("eyes_open"), ((F.col("l_quantity") - 25) * 2).alias("yaw"), (F.col("l_tax") / 8).alias("face_area_ratio"))
    return faces.penalties(f).withColumn("penalty", F.round("penalty", 6))


@query("person_covers", "SELECT l_suppkey AS person_id, arg_max(l_linenumber * 1000000 + l_orderkey, (c * sqrt(w * h), -(l_linenumber * 1000000 + l_orderkey))) AS face_id FROM (SELECT *, l_extendedprice AS c, l_quantity::INT AS w, (l_partkey % 50 + 1)::INT AS h FROM lineitem) GROUP BY 1")
def person_covers(spark, d):
    """A20."""
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("person_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_orderkey")).alias("face_id"), F.col("l_extendedprice").alias("confidence"), F.col("l_quantity").cast("int").alias("bbox_w"), (F.col("l_partkey") % 50 + 1).cast("int").alias("bbox_h"))
    return aggregate.best_faces(f).select("person_id", "face_id")


@query("visit_rollup", f"SELECT user_id, round(avg({LAT}), 9) AS lat, round(avg({LON}), 9) AS lon, min(ts) AS arrived_at, max(ts) AS departed_at, count(*) AS n, arg_max(event_id, (value, -event_id)) AS cover FROM events GROUP BY 1")
def visit_rollup(spark, d):
    """A17."""
    out = stories.visit_rollup(photos(spark, d).withColumn("iqa", F.col("ap25")), ["user_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("lat", "lon")})


@query("agreement", "WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) / greatest(1, count(*) OVER () - 1) * 100 AS p FROM documents) SELECT round(median(p), 6) AS median_percent, count(*) AS n FROM r JOIN labels USING (doc_id) WHERE quality = 1")
def agreement(spark, d):
    """A23, W4."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    liked = table(spark, d, "labels").where("quality = 1")
    return rank.agreement(docs, [F.col("n_chars"), F.col("doc_id")], "doc_id", liked).withColumn("median_percent", F.round("median_percent", 6))


@query("retrained", f"""WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
 c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u WHERE label = 1) GROUP BY 1))
 SELECT vec_id AS photo_id, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 6) AS personal_score FROM u, c""")
def retrained(spark, d):
    """C13."""
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "photo_id")
    ratings = e.select("photo_id", F.when(F.col("label") == 1, 1).otherwise(0).alias("rating"))
    return taste.retrained(e.select("photo_id", "embedding"), ratings).withColumn("personal_score", F.round("personal_score", 6))


@query("taste_scores")
def taste_scores(spark, d):
    """A taste model of label 1 against the rest."""
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "photo_id")
    swipes = e.select("photo_id", F.when(F.col("label") < 5, "keep").otherwise("reject").alias("decision"))
    w, b = taste.train_taste(taste.labelled(e.select("photo_id", "embedding"), swipes))
    return taste.taste_scores(e.select("photo_id", "embedding"), w.tolist(), b)


@query("dbscan_day", f"""WITH RECURSIVE p AS (SELECT {DAY} AS day, event_id, 34 + (event_id * 7919 % 1009) * 0.0005 AS x, 77 + (event_id * 104729 % 1013) * 0.0005 AS y FROM events),
 n AS (SELECT a.event_id AS a, b.event_id AS b FROM p a JOIN p b ON a.day = b.day AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.0252),
 c AS (SELECT a FROM n GROUP BY 1 HAVING count(*) >= 3), e AS (SELECT a, b FROM n WHERE a IN (SELECT a FROM c) AND b IN (SELECT a FROM c)),
 r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), l AS (SELECT a, min(b) AS cluster FROM r GROUP BY 1)
 SELECT n.b AS photo_id, coalesce(min(l.cluster) FILTER (n.a = n.b), min(l.cluster)) AS cluster FROM n JOIN l ON n.a = l.a GROUP BY 1""")
def dbscan_day(spark, d):
    """C4, per day."""
    i = F.col("event_id")
    p = events(spark, d).select(texts.day(F.col("ts")).alias("day"), i.alias("photo_id"), (34 + (i * 7919 % 1009) * 0.0005).alias("lat"), (77 + (i * 104729 % 1013) * 0.0005).alias("lon"))
    return cluster.dbscan(p, by=["day"], eps=0.0252)


@query("mmr_reps", """WITH RECURSIVE e AS (SELECT label AS scene, vec_id, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-6)) AS v,
        0.5 * ((vec_id * 37 % 101) / 101) + 0.3 * least((vec_id % 300)::DOUBLE, 1) + 0.2 * 0.5 AS q FROM embeddings),
 n AS (SELECT scene, CASE WHEN count(*) >= 60 THEN 15 WHEN count(*) >= 30 THEN 10 WHEN count(*) >= 15 THEN 6 WHEN count(*) >= 8 THEN 3 ELSE greatest(1, count(*) // 3) END AS most FROM e GROUP BY 1),
 s AS (SELECT a.scene, a.vec_id AS a, b.vec_id AS b, a.q, list_dot_product(a.v, b.v) AS sim FROM e a JOIN e b ON a.scene = b.scene),
 g AS (SELECT scene, 0 AS pick, arg_max(vec_id, (q, -vec_id)) AS photo_id, [arg_max(vec_id, (q, -vec_id))] AS chosen FROM e GROUP BY 1
       UNION ALL SELECT g.scene, g.pick + 1, p.a, list_append(g.chosen, p.a) FROM g JOIN n ON n.scene = g.scene AND g.pick + 1 < n.most,
       LATERAL (SELECT a FROM s WHERE s.scene = g.scene AND list_contains(g.chosen, s.b) AND NOT list_contains(g.chosen, s.a) GROUP BY a, q HAVING max(sim) < 0.88 ORDER BY 0.45 * q - 0.55 * max(sim) DESC, a LIMIT 1) p)
 SELECT scene, photo_id, pick FROM g""")
def mmr_reps(spark, d):
    """Representatives of each label's vectors."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("scene"), F.col("vec_id").alias("photo_id"), vec.unit(F.col("embedding"), floor=1e-6).alias("v"), ((F.col("vec_id") * 37 % 101) / 101).alias("iqa"), (F.col("vec_id") % 300).cast("double").alias("blur"), F.lit(1.0).alias("p95"), F.lit(0.5).alias("face"))
    return cluster.representatives(e, ["scene"])


@query("persons_linkage")
def persons_linkage(spark, d):
    """C6, A19."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("face_id"), (F.col("vec_id") % 97).alias("photo_id"), "embedding")
    return cluster.persons(e, distance=0.6, merge=0.65)


@query("smart_clusters")
def smart_clusters(spark, d):
    """C7, C9."""
    e = table(spark, d, "embeddings").select((F.col("label") % 2).alias("block"), F.col("vec_id").alias("photo_id"), vec.unit(F.col("embedding"), floor=1e-6).alias("v"))
    return density.density_clusters(e, "block")


def _vocabulary() -> dict[str, list[float]]:
    """Twelve labels for vectors of 64 numbers: each likes every twelfth of them."""
    return {f"theme {k}": [1.0 if x % 12 == k else -0.05 for x in range(64)] for k in range(12)}


@query("lookback_clusters")
def lookback_clusters(spark, d):
    """The look-back pass, over all vectors at once."""
    return density.density_clusters(table(spark, d, "embeddings").select(F.col("vec_id").alias("photo_id"), vec.unit(F.col("embedding"), floor=1e-6).alias("v")), least=20)


@query("cluster_names", """WITH RECURSIVE e AS (SELECT label AS cluster, generate_subscripts(embedding, 1) AS k, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
 m AS (SELECT cluster, k, avg(x) AS x, count(*) AS n FROM e GROUP BY 1, 2), z AS (SELECT cluster, sqrt(sum(x * x)) AS size FROM m GROUP BY 1),
 s AS (SELECT cluster, t, max(n) AS n, sum(x / size * CASE WHEN (k - 1) % 12 = t THEN 1.0 ELSE -0.05 END) AS sim FROM m JOIN z USING (cluster), range(12) v(t) GROUP BY 1, 2),
 o AS (SELECT cluster, row_number() OVER (ORDER BY max(n) DESC, cluster) AS place FROM s GROUP BY 1),
 g AS (SELECT 0::BIGINT AS place, NULL::BIGINT AS cluster, NULL::BIGINT AS t, []::BIGINT[] AS used
       UNION ALL SELECT g.place + 1, o.cluster, p.t, list_append(g.used, p.t) FROM g JOIN o ON o.place = g.place + 1,
       LATERAL (SELECT t FROM s WHERE s.cluster = o.cluster AND NOT list_contains(g.used, s.t) ORDER BY sim DESC, t LIMIT 1) p)
 SELECT cluster, 'theme ' || t AS name FROM g WHERE place > 0""")
def cluster_names(spark, d):
    """The clusters are the labels of the vectors."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("cluster"), "embedding")
    return density.cluster_names(aggregate.mean_vectors(e, ["cluster"], "embedding"), _vocabulary())


@query("day_stories")
def day_stories(spark, d):
    """Representatives of the scenes of each day."""
    p = with_vectors(spark, d)
    return stories.day_stories(p.select("photo_id", "taken_at", "v", (F.col("ap25") / 500).alias("iqa"), "blur", F.lit(0.0).alias("face"), (F.col("ap25") < 3).alias("auto_reject")))


@query("composed_story", f"""WITH p AS (SELECT event_id, value / 500 AS iqa, value * 10 AS blur FROM events WHERE event_type = 'click' AND (hour(ts) * 3600 + minute(ts) * 60 + epoch_us(ts) % 60000000 / 1e6) BETWEEN 18000 AND 39600 AND value / 500 >= 0.3)
 SELECT event_id AS photo_id, round(0.6 * iqa + 0.4 * blur / max(blur) OVER (), 9) AS score FROM p ORDER BY 0.6 * iqa + 0.4 * blur / max(blur) OVER () DESC, event_id LIMIT 10""")
def composed_story(spark, d):
    """C16: "top 10 click photos of the morning"."""
    p = photos(spark, d)
    request = stories.parse("top 10 click photos of the morning", [], [], ["click", "view"])
    links = p.select("photo_id", F.col("user_id").alias("person_id"))
    rows = p.select("photo_id", "taken_at", "at", (F.col("ap25") / 500).alias("iqa"), "blur")
    return stories.compose(request, rows, links, p.select("photo_id", "tag"), visits(spark, d)).withColumn("score", F.round("score", 9))


@query("frame_sampling", "SELECT event_id, list_distinct(list_transform(range(0, least(12, event_id + 1)), lambda k: round_even(k * CASE WHEN event_id > 0 THEN event_id / (least(12, event_id + 1) - 1) ELSE 0 END, 0)::INT)).list_sort() AS frames FROM events")
def frame_sampling(spark, d):
    """S8."""
    return events(spark, d).select("event_id", F.sort_array(media.frame_indices((F.col("event_id") + 1).cast("int"), F.lit(24.0))).alias("frames"))


@query("file_kinds", "SELECT kind, count(*) AS n FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'heic' WHEN 2 THEN 'raw' WHEN 3 THEN 'video' WHEN 4 THEN 'jpeg' END AS kind FROM documents) WHERE kind IS NOT NULL GROUP BY 1")
def file_kinds(spark, d):
    """S3, S9."""
    i = F.col("doc_id")
    name = F.concat(F.lit("a/"), i.cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".JPG", ".heic", ".Nef", ".mp4", ".webp", ".txt")]), (i % 6 + 1).cast("int")))
    return table(spark, d, "documents").select(media.kind(name).alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


@query("exif_fields", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN TIMESTAMP '2024-03-05 06:07:08' WHEN 1 THEN TIMESTAMP '2024-03-06 06:07:08' END AS taken_at, round((34 + 5 / 60 + (doc_id % 60) / 3600) * CASE WHEN doc_id % 2 = 0 THEN -1 ELSE 1 END, 9) AS lat FROM documents")
def exif_fields(spark, d):
    """S6."""
    i = F.col("doc_id")
    raw = F.when(i % 3 == 0, "2024:03:05 06:07:08").when(i % 3 == 1, " 2024-03-06 06:07:08 ").otherwise("soon")
    dms = F.concat(F.lit("34/1 5/1 "), (i % 60 * 100).cast("string"), F.lit("/100"))
    return table(spark, d, "documents").select("doc_id", texts.exif_time(F.lit(None).cast("string"), raw).alias("taken_at"), F.round(texts.dms_degrees(dms, F.when(i % 2 == 0, "S").otherwise("N")), 9).alias("lat"))


@query("geocode_cache", f"WITH c AS (SELECT DISTINCT round_even({LAT}, 3) AS la, round_even({LON}, 3) AS lo FROM events WHERE event_id % 2 = 0) SELECT event_id, c.la IS NULL AS asked FROM events LEFT JOIN c ON la = round_even({LAT}, 3) AND lo = round_even({LON}, 3)")
def geocode_cache(spark, d):
    """S13."""
    p = photos(spark, d)
    cache = p.where("photo_id % 2 = 0").select(texts.geo_key(F.col("lat")).alias("lat_round"), texts.geo_key(F.col("lon")).alias("lon_round"), F.lit("x").alias("display_name")).distinct()
    return side_files.geocoded(p.select(F.col("photo_id").alias("event_id"), "lat", "lon"), cache).select("event_id", "asked")


@query("caption_json", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE '' END AS caption FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL")
def caption_json(spark, d):
    """Captions from JSON texts, broken ones empty."""
    c = table(spark, d, "conversations").where("role is not null and text is not null")
    json_ = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("caption")))).otherwise("{broken")
    return side_files.captions(c.select(F.struct("conv_id", "turn").alias("day"), json_.alias("text"))).select("day.conv_id", "day.turn", "caption")


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Tumbling windows as the streaming layer has them, over a finished table."""
    from lumiquarry.streaming.watch import tumbling

    return tumbling(events(spark, d), "ts", "1 hour", ["event_type"])


