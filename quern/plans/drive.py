"""Queries over stored files, chunks and activity, with their DuckDB SQL. Orders stand for files: the customer owns them, the
priority is their folder, P is a draft, F is trash."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import tables
from quern.plans.tables import table

QUERIES, ORACLE_SQL = {}, {}
NOW = "1996-01-01"


def trash_list(spark, d):
    """V2: trashed files of each owner, the latest first."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


ORACLE_SQL["trash_list"] = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders WHERE o_orderstatus = 'F'"


def resolved_paths(spark, d):
    """V3: the file of each (owner, folder, name), a null folder being the root; of several the latest."""
    f = table(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_custkey", F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority")).alias("folder"), F.concat(F.lit("f"), F.month("o_orderdate")).alias("name"), "o_orderkey", "o_orderdate")
    asked = f.select("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("folder")).alias("folder"), "name").distinct()
    best = f.groupBy("o_custkey", "folder", "name").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    same = asked["o_custkey"].eqNullSafe(best["o_custkey"]) & asked["folder"].eqNullSafe(best["folder"]) & (asked["name"] == best["name"])
    return asked.join(best, same, "left").select(asked["o_custkey"], asked["folder"], asked["name"], "o_orderkey")


ORACLE_SQL["resolved_paths"] = """WITH f AS (SELECT o_custkey, CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderpriority END AS folder, 'f' || month(o_orderdate) AS name, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'F'),
  a AS (SELECT DISTINCT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN folder END AS folder, name FROM f), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey, folder, name ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
  SELECT a.o_custkey, a.folder, a.name, b.o_orderkey FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey AND a.folder IS NOT DISTINCT FROM b.folder AND a.name = b.name"""


def expired_drafts(spark, d):
    """V6: drafts older than 30 days at a fixed clock, and of each owner how many."""
    return table(spark, d, "orders").where(F.col("o_orderstatus") == "P").where(F.col("o_orderdate") <= F.expr(f"timestamp'{NOW}' - interval 30 days")).groupBy("o_custkey").agg(F.count("*").alias("drafts"), F.max("o_orderkey").alias("last_draft"))


ORACLE_SQL["expired_drafts"] = f"SELECT o_custkey, count(*) AS drafts, max(o_orderkey) AS last_draft FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY 1"


def activity_page(spark, d):
    """The second page of 20 of the activity log, filtered by a substring, with the total."""
    e = table(spark, d, "events").where(F.col("event_type").ilike("%i%")).select("event_id", "user_id", "event_type", "ts")
    return tables.offset_page(e, [F.desc("ts"), F.desc("event_id")], 2, 20).select("event_id", "user_id", "event_type", "total")


ORACLE_SQL["activity_page"] = "SELECT event_id, user_id, event_type, total FROM (SELECT *, count(*) OVER () AS total FROM events WHERE event_type ILIKE '%i%' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20)"


def reindex_targets(spark, d):
    """Files to index again, all that are ready and not deleted, by folder."""
    return table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.count("*").alias("files"), F.min("o_orderkey").alias("first_file"))


ORACLE_SQL["reindex_targets"] = "SELECT o_orderpriority, count(*) AS files, min(o_orderkey) AS first_file FROM orders WHERE o_orderstatus = 'O' GROUP BY 1"


def retention_purge(spark, d):
    """Events that a purge of more than ten days keeps at a fixed clock, by day."""
    return table(spark, d, "events").where(F.col("ts") >= F.expr("timestamp'2024-01-20' - interval 10 days")).groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))


ORACLE_SQL["retention_purge"] = "SELECT ts::DATE AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY GROUP BY 1"


def _paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("/"), T.host_of(F.col("url")), F.regexp_replace(F.regexp_extract("url", "^[A-Za-z]+://[^/]*([^?#]*)", 1), "/$", "")).alias("path"))


def moved_subtree(spark, d):
    """Pages by path, their hosts below example hosts of one name part moved elsewhere."""
    p = _paths(spark, d)
    top = F.regexp_extract("path", "^(/[^/]*)", 1)
    return p.select("page_id", "path", tables.under_path(F.col("path"), "/m.ththth.example.net").alias("below"), tables.moved(F.col("path"), "/m.ththth.example.net", "/archive/m").alias("moved"), top.alias("top"))


_PATH = "SELECT page_id, '/' || lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/]*([^?#]*)', 1), '/$', '') AS path FROM pages"
_M = "/m.ththth.example.net"
ORACLE_SQL["moved_subtree"] = f"SELECT page_id, path, path = '{_M}' OR path LIKE '{_M}/%' AS below, CASE WHEN path = '{_M}' OR path LIKE '{_M}/%' THEN '/archive/m' || substr(path, {len(_M) + 1}) ELSE path END AS moved, regexp_extract(path, '^(/[^/]*)', 1) AS top FROM ({_PATH})"


def not_retired(spark, d):
    """P10: events whose JSON properties do not name the user as the one who retired them."""
    by = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").where(by.isNull() | (by % 10 != F.col("user_id") % 10)).select("event_id", "user_id")


ORACLE_SQL["not_retired"] = "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') IS NULL OR json_extract_string(props, '$.k')::BIGINT % 10 <> user_id % 10"


def cloned_domain(spark, d):
    """The parts of a brand copied to a new owner under new ids, each text once."""
    p = table(spark, d, "part").where("p_brand = 'Brand#11' or p_size < 10")
    first = p.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    ids = first.select("p_partkey", F.sha2(F.concat_ws("|", F.lit("clone-1"), "p_partkey"), 256).alias("new_id"))
    return p.select("p_partkey", "p_name").join(ids, "p_partkey").select("new_id", "p_name", F.col("p_partkey").alias("copied_from"))


ORACLE_SQL["cloned_domain"] = "SELECT sha256('clone-1|' || k) AS new_id, p_name, k AS copied_from FROM (SELECT p_name, min(p_partkey) AS k FROM part WHERE p_brand = 'Brand#11' OR p_size < 10 GROUP BY 1)"


def cursors(spark, d):
    """Opaque cursors of events, made and read back."""
    c = T.cursor(F.col("ts"), F.col("event_id"))
    return table(spark, d, "events").select("event_id", c.alias("cursor")).withColumn("id_back", T.cursor_id(F.col("cursor"))).withColumn("at", F.date_format(T.cursor_time(F.col("cursor")), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


ORACLE_SQL["cursors"] = """SELECT event_id, rtrim(replace(replace(to_base64(('{"t":"' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '","i":"' || event_id || '"}')::BLOB), '+', '-'), '/', '_'), '=') AS cursor, event_id AS id_back, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "at" FROM events"""


def nulls_last(spark, d):
    """Events by value, unknown values last."""
    w = Window.partitionBy("event_type").orderBy(F.desc_nulls_last("v"), "event_id")
    return table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 5 > 0, F.col("value"))).select("event_id", "event_type", F.row_number().over(w).alias("place"))


ORACLE_SQL["nulls_last"] = "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN event_id % 5 > 0 THEN value END DESC NULLS LAST, event_id) AS place FROM events"


def usage_report(spark, d):
    """Of each user the last 30 days' requests at a fixed clock and the last 50 events of production types."""
    e = table(spark, d, "events")
    recent = e.where(F.col("ts") >= F.expr("timestamp'2024-01-31' - interval 30 days")).groupBy("user_id").agg(F.count("*").alias("requests"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = e.where("event_type <> 'error'").withColumn("n", F.row_number().over(w)).where("n <= 50").groupBy("user_id").agg(F.count("*").alias("logged"), F.min_by("event_id", "n").alias("last_event"))
    return recent.join(last, "user_id", "full_outer").select("user_id", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("logged", F.lit(0)).alias("logged"), "last_event")


ORACLE_SQL["usage_report"] = """WITH r AS (SELECT user_id, count(*) AS requests FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 1),
  l AS (SELECT user_id, count(*) AS logged, arg_min(event_id, n) AS last_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n <= 50 GROUP BY 1)
  SELECT user_id, coalesce(requests, 0) AS requests, coalesce(logged, 0) AS logged, last_event FROM r FULL JOIN l USING (user_id)"""


def page_covers(spark, d):
    """Order lines as chunks that name their page now and then; each chunk covers the page it carries on and its
    own, and an order's cover is their union."""
    named = F.when(F.col("l_linenumber") % 3 == 1, F.col("l_linenumber"))
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.lit(1)).select("l_orderkey", "l_linenumber", named.alias("page"))
    from quern.operators import conversation

    c = conversation.carried(l, ["l_orderkey"], ["l_linenumber"], "page").withColumn("cover", F.array_distinct(F.array_compact(F.array("carried", "page"))))
    return c.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cover")))), ",").alias("pages"), F.count_if(F.size("cover") == 2).alias("two_paged"))


ORACLE_SQL["page_covers"] = """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 1 THEN l_linenumber END AS page FROM lineitem),
  c AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM l)
  SELECT l_orderkey, coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT unnest(list_value(x.carried, x.page)) AS p FROM c x WHERE x.l_orderkey = c.l_orderkey) WHERE p IS NOT NULL), '') AS pages, count(*) FILTER (carried IS NOT NULL AND page IS NOT NULL AND carried <> page) AS two_paged FROM c GROUP BY 1"""


def image_captions(spark, d):
    """C14: pictures (part types) by content hash, each once, the places that show it united."""
    p = table(spark, d, "part").select(F.sha2("p_type", 256).alias("sha"), "p_partkey")
    return p.groupBy("sha").agg(F.array_join(F.array_sort(F.collect_set("p_partkey")), ",").alias("anchors"))


ORACLE_SQL["image_captions"] = "SELECT sha256(p_type) AS sha, string_agg(DISTINCT p_partkey, ',' ORDER BY p_partkey) AS anchors FROM part GROUP BY 1"

for _f in (trash_list, resolved_paths, expired_drafts, activity_page, reindex_targets, retention_purge, moved_subtree, not_retired, cloned_domain, cursors, nulls_last, usage_report, page_covers, image_captions):
    QUERIES[_f.__name__] = _f
