"""Queries on documents and versions (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalogue import fixtures as X, query
from foliant.catalogue import sql as Q
from foliant.catalogue.documents import _SOURCES
from foliant.functions import ids
from foliant.functions.skew import number_rows
from foliant.operators import versions as V
from foliant.session import union_all

NOW = "2024-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("register_documents", f"""
WITH {Q.V1.lstrip()}
SELECT document_id, source_id, ext AS external_document_id,
  CASE WHEN lang = 'en' THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '{NOW}' END AS created_at FROM d1""")
def register_documents(spark, sf):
    docs = X.table(spark, sf, "documents").select(
        F.col("source").alias("source_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("external_document_id"), "lang")
    known = V.with_document_id(docs.where(F.col("lang") == "en")).select(
        "document_id", "source_id", "external_document_id", F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    return V.register_documents(known, union_all(docs, docs), now())


_CHANGES = f"""{_SOURCES},
{Q.V1.lstrip()},
before AS (SELECT source_id, ext, document_id, sha256(text) AS h FROM d1 WHERE lang <> 'es' OR doc_id IN (SELECT doc_id FROM labels)),
after AS (SELECT source_id, ext, document_id, sha256({Q.EDITED}) AS h FROM d1),
{Q.V3_TEXT.lstrip()},
incoming AS (SELECT source_id, ext, document_id, h FROM after UNION ALL SELECT source_id, ext, document_id, sha256(text) FROM d3),
changes AS (SELECT i.source_id, i.ext, i.document_id, src.update_policy,
  CASE WHEN b.h IS NULL THEN 'NEW' WHEN b.h = i.h THEN 'UNCHANGED' ELSE 'CHANGED' END AS change_status,
  CASE WHEN b.h IS NOT NULL THEN {Q.version_uuid('i.document_id', '1')} END AS active_version_id
  FROM incoming i LEFT JOIN src USING (source_id) LEFT JOIN before b ON i.document_id = b.document_id)"""


def changes(spark, sf):
    """V1 (without the unlabelled Spanish documents) is ACTIVE, V2 comes in."""
    rows = X.table(spark, sf, "documents")
    unlabelled = rows.where(F.col("lang") == "es").join(X.table(spark, sf, "labels"), "doc_id", "left_anti").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("external_document_id"))
    first = X.first_versions(X.corpus(spark, sf)).join(unlabelled, "external_document_id", "left_anti")
    active = V.active_versions(first.withColumn("status", F.lit("ACTIVE")).drop("content"))
    incoming = V.with_document_id(X.revised(spark, sf).drop("content"))
    known = incoming.join(X.sources(spark, sf).select("source_id", "update_policy"), "source_id", "left")
    return V.detect_changes(known, active)


@query("detect_changes", f"""
WITH {_CHANGES.lstrip()}
SELECT source_id, ext AS external_document_id, document_id, change_status, active_version_id FROM changes""")
def detect_changes(spark, sf):
    return changes(spark, sf).select("source_id", "external_document_id", "document_id", "change_status", "active_version_id")


_DECISION = """CASE change_status WHEN 'NEW' THEN 'BUILD' WHEN 'UNCHANGED' THEN {0}
  ELSE CASE update_policy WHEN 'AUTHORITATIVE_SNAPSHOT' THEN 'BUILD' ELSE 'REQUIRE_VERSION_RESOLUTION' END END"""


@query("build_decision", f"""
WITH {_CHANGES.lstrip()}
SELECT document_id, change_status, update_policy, {_DECISION.format("'SKIP'")} AS decision, {_DECISION.format("'BUILD'")} AS forced FROM changes""")
def build_decision(spark, sf):
    plain = V.build_decision(changes(spark, sf))
    return V.build_decision(plain.withColumnRenamed("decision", "plain"), force=True).select(
        "document_id", "change_status", "update_policy", F.col("plain").alias("decision"), F.col("decision").alias("forced"))


_HISTORY = f"""
hist AS (SELECT *, 'user-' || user_id AS ext, {Q.document_uuid("'events'", "'user-' || user_id")} AS document_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
stat AS (SELECT *, n = max(n) OVER (PARTITION BY user_id) AS newest FROM hist),
ver AS (SELECT {Q.version_uuid('document_id', 'n')} AS vid, *,
  CASE WHEN event_type = 'error' THEN 'FAILED' WHEN NOT newest THEN 'INACTIVE' WHEN event_type = 'click' THEN 'BUILDING' ELSE 'ACTIVE' END AS status
  FROM stat),
version AS (SELECT *, CASE WHEN status IN ('ACTIVE', 'INACTIVE') THEN ts END AS activated_at FROM ver)"""


@query("history_changes", f"""
WITH {_HISTORY.lstrip()}
SELECT event_id, n AS version_number, CASE WHEN n = 1 THEN 'NEW'
  WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY n) THEN 'UNCHANGED' ELSE 'CHANGED' END AS change_status FROM hist""")
def history_changes(spark, sf):
    # The predecessor of a revision is found by (document, number - 1): an equi-join whose keys no document dominates.
    rows = X.history(spark, sf)
    before = rows.select("document_id", (F.col("version_number") + 1).alias("version_number"), F.col("event_type").alias("_prev"))
    status = F.when(F.col("_prev").isNull(), "NEW").when(F.col("_prev") == F.col("event_type"), "UNCHANGED").otherwise("CHANGED")
    return rows.join(before, ["document_id", "version_number"], "left").select("event_id", "version_number", status.alias("change_status"))


@query("next_versions", f"""
WITH {_HISTORY.lstrip()},
stored AS (SELECT document_id, max(n) AS top, max((status = 'BUILDING')::INT) AS busy FROM version GROUP BY document_id),
batch AS (SELECT document_id, o.o_orderkey, row_number() OVER (PARTITION BY document_id ORDER BY o.o_orderdate, o.o_orderkey) AS n
  FROM (SELECT *, {Q.document_uuid("'events'", "'user-' || o_custkey")} AS document_id FROM orders) o)
SELECT o_orderkey, document_id, coalesce(top, 0) + n AS version_number, {Q.version_uuid('document_id', 'coalesce(top, 0) + n')} AS document_version_id,
  CASE WHEN busy = 1 THEN 'REFUSED' ELSE 'BUILDING' END AS status
FROM batch LEFT JOIN stored USING (document_id) WHERE busy IS DISTINCT FROM 1
UNION ALL SELECT o_orderkey, document_id, NULL, NULL, 'REFUSED' FROM batch JOIN stored USING (document_id) WHERE busy = 1""")
def next_versions(spark, sf):
    # Orders play incoming revisions: several per document, numbered by date behind the stored history.
    batch = X.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", ids.document_id(F.lit("events"), F.concat(F.lit("user-"), F.col("o_custkey").cast("string"))).alias("document_id"))
    created, refused = V.next_versions(batch, X.version_table(spark, sf), ["o_orderdate", "o_orderkey"])
    none = F.lit(None)
    return union_all(
        created.select("o_orderkey", "document_id", "version_number", "document_version_id", "status"),
        refused.select("o_orderkey", "document_id", none.cast("long").alias("version_number"),
                       none.cast("string").alias("document_version_id"), F.lit("REFUSED").alias("status")))


@query("activate_versions", f"""
WITH {_HISTORY.lstrip()},
rising AS (SELECT document_id FROM version WHERE status = 'BUILDING')
SELECT document_id, vid AS document_version_id, 'ACTIVE' AS status, TIMESTAMP '{NOW}' AS activated_at, NULL AS violation
  FROM version WHERE status = 'BUILDING'
UNION ALL SELECT document_id, vid, 'INACTIVE', activated_at, NULL FROM version WHERE status = 'ACTIVE' AND document_id IN (SELECT document_id FROM rising)
UNION ALL SELECT document_id, vid, NULL, NULL, 'cannot activate ' || status FROM version WHERE status IN ('FAILED', 'INACTIVE')""")
def activate_versions(spark, sf):
    versions = X.version_table(spark, sf)
    changed, errors = V.activate(versions, versions, now())
    none = F.lit(None)
    return union_all(
        changed.withColumn("violation", none.cast("string")),
        errors.withColumns({"status": none.cast("string"), "activated_at": none.cast("timestamp")}))


@query("activated_table", f"""
WITH {_HISTORY.lstrip()}
SELECT vid AS document_version_id, CASE WHEN status = 'BUILDING' THEN 'ACTIVE' ELSE status END AS status,
  CASE WHEN status = 'BUILDING' THEN TIMESTAMP '{NOW}' ELSE activated_at END AS activated_at FROM version""")
def activated_table(spark, sf):
    versions = X.version_table(spark, sf)
    changed, _ = V.activate(versions, versions, now())
    return V.apply_status(versions, changed).select("document_version_id", "status", "activated_at")


@query("fail_versions", f"""
WITH {_HISTORY.lstrip()}
SELECT document_id, vid AS document_version_id, 'FAILED' AS status, NULL AS violation FROM version WHERE status = 'BUILDING'
UNION ALL SELECT document_id, vid, NULL, 'cannot fail ' || status FROM version WHERE status IN ('ACTIVE', 'INACTIVE')""")
def fail_versions(spark, sf):
    versions = X.version_table(spark, sf)
    changed, errors = V.fail_versions(versions, versions)
    return union_all(changed.withColumn("violation", F.lit(None).cast("string")), errors.withColumn("status", F.lit(None).cast("string")))


@query("current_status", f"""
WITH {_HISTORY.lstrip()}
SELECT document_id AS document_version_id, arg_max(status, n) AS status,
  CASE WHEN arg_max(status, n) IN ('ACTIVE', 'INACTIVE') THEN max(ts) FILTER (status = 'ACTIVE') END AS activated_at FROM version GROUP BY document_id""")
def current_status(spark, sf):
    # The history of a document read as the status events of one version.
    events = X.version_table(spark, sf).select(
        F.col("document_id").alias("document_version_id"), "document_id", "status", F.col("version_number").alias("seq"), F.col("created_at").alias("at"))
    return V.current_status(events)


@query("resumable_versions", f"""
WITH {_HISTORY.lstrip()}
SELECT document_id, vid AS document_version_id, n AS version_number FROM version WHERE status = 'FAILED' AND newest""")
def resumable_versions(spark, sf):
    return V.resumable(X.version_table(spark, sf)).select("document_id", "document_version_id", "version_number")


@query("version_invariants", f"""
WITH {_HISTORY.lstrip()},
bad AS (SELECT document_id, vid, n - 1 AS n, CASE event_type WHEN 'view' THEN 'ACTIVE' WHEN 'click' THEN 'BUILDING' WHEN 'error' THEN 'FAILED' ELSE 'LOST' END AS status,
  CASE WHEN value > 20 THEN 'x' ELSE sha256(event_type) END AS h, CASE WHEN value > 5 THEN ts END AS since FROM version)
SELECT document_id, vid AS document_version_id, 'version number not positive' AS violation FROM bad WHERE n <= 0
UNION ALL SELECT document_id, vid, 'unknown status' FROM bad WHERE status = 'LOST'
UNION ALL SELECT document_id, vid, 'content hash is not SHA-256 hex' FROM bad WHERE h = 'x'
UNION ALL SELECT document_id, vid, 'activation time does not fit status' FROM bad WHERE (since IS NOT NULL) <> (status IN ('ACTIVE', 'INACTIVE'))
UNION ALL SELECT document_id, NULL, 'several ACTIVE versions' FROM bad GROUP BY document_id HAVING count(*) FILTER (status = 'ACTIVE') > 1
UNION ALL SELECT document_id, NULL, 'several BUILDING versions' FROM bad GROUP BY document_id HAVING count(*) FILTER (status = 'BUILDING') > 1
UNION ALL SELECT document_id, NULL, 'repeated version number' FROM bad GROUP BY document_id, n HAVING count(*) > 1""")
def version_invariants(spark, sf):
    kind = F.col("event_type")
    damaged = X.version_table(spark, sf).withColumns({
        "version_number": F.col("version_number") - 1,
        "status": F.when(kind == "view", "ACTIVE").when(kind == "click", "BUILDING").when(kind == "error", "FAILED").otherwise("LOST"),
        "content_hash": F.when(F.col("value") > 20, "x").otherwise(F.col("content_hash")),
        "activated_at": F.when(F.col("value") > 5, F.col("created_at"))})
    return V.version_violations(damaged)


@query("interrupted_builds", f"""
WITH {_HISTORY.lstrip()},
log AS (SELECT document_id, event_type AS stage, ts,
  CASE WHEN value < 3 THEN 'RUNNING' WHEN value < 8 THEN 'FAILED' WHEN value < 12 THEN 'PENDING' ELSE 'COMPLETED' END AS status FROM hist),
last AS (SELECT document_id, arg_max(stage, struct_pack(a := ts, b := stage)) AS stage, arg_max(status, struct_pack(a := ts, b := stage)) AS status, min(ts) AS created_at FROM log GROUP BY document_id),
v AS (SELECT document_id, CASE WHEN count(*) % 2 = 0 THEN 'BUILDING' ELSE 'FAILED' END AS version_status FROM hist GROUP BY document_id)
SELECT document_id AS document_version_id, stage, status, version_status, created_at FROM last JOIN v USING (document_id)
WHERE status IN ('PENDING', 'RUNNING') OR (status = 'FAILED' AND version_status = 'BUILDING')""")
def interrupted_builds(spark, sf):
    rows = X.history(spark, sf)
    value = F.col("value")
    log = rows.select(
        F.col("document_id").alias("document_version_id"), F.col("event_type").alias("stage"), F.col("ts").alias("started_at"),
        F.when(value < 3, "RUNNING").when(value < 8, "FAILED").when(value < 12, "PENDING").otherwise("COMPLETED").alias("status"))
    versions = rows.groupBy(F.col("document_id").alias("document_version_id")).agg(
        F.when(F.count("*") % 2 == 0, "BUILDING").otherwise("FAILED").alias("status"))
    return V.interrupted_builds(log, versions)


@query("numbered_lines", """
SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem""")
def numbered_lines(spark, sf):
    # Three groups hold all rows: the numbering must not gather a group in one task.
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = X.table(spark, sf, "lineitem").select("l_returnflag", *order)
    return number_rows(rows, ["l_returnflag"], order).select("l_orderkey", "l_linenumber", "l_suppkey", "n")
