"""Events as opens, revisions, jobs and file changes; one user is one owner or session."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import sessions as ops
from quire.plans.registry import query
from quire.session import table
from quire.sources import stored


def events(spark, folder):
    return table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp")).drop("ts")


@query(
    "recent_files",
    "W9 M2 T6",
    """WITH o AS (SELECT user_id AS owner, CASE WHEN event_id % 2 = 0 THEN 'File' ELSE 'file' END || floor(value * 10)::INT AS path, ts, CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END AS pin FROM events),
    f AS (SELECT owner, lower(path) AS key, arg_max(path, ts) AS path, max(ts) AS ts, coalesce(arg_max(pin, ts) FILTER (WHERE pin IS NOT NULL), false) AS pinned FROM o GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY owner, pinned ORDER BY ts DESC, key) AS rank FROM f)
    SELECT owner, path, epoch_us(ts) AS opened, pinned, rank FROM r WHERE rank <= CASE WHEN pinned THEN 30 ELSE 20 END""",
)
def recent_files(spark, folder):
    opens = events(spark, folder).select(
        F.col("user_id").alias("owner"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "File").otherwise("file"), F.floor(F.col("value") * 10).cast("string")).alias("path"),
        "at", F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "error", False).alias("pin"),
    )
    return ops.recents(opens).select("owner", "path", F.unix_micros("at").alias("opened"), "pinned", "rank")


@query(
    "revision_retention",
    "W10",
    """WITH r AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS revision, floor(value * 1000000)::BIGINT AS size_bytes FROM events),
    b AS (SELECT *, count(*) OVER w AS n, sum(size_bytes) OVER w AS bytes FROM r WINDOW w AS (PARTITION BY session_id ORDER BY revision DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT session_id, revision, size_bytes, (n <= 30 AND bytes <= 536870912) OR n = 1 AS reachable FROM b WHERE (n <= 30 AND bytes <= 536870912) OR n = 1 OR revision = 0""",
)
def revision_retention(spark, folder):
    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    revisions = events(spark, folder).select(
        F.col("user_id").alias("session_id"), (F.row_number().over(order) - 1).alias("revision"), F.floor(F.col("value") * 1000000).alias("size_bytes")
    )
    return ops.kept_revisions(revisions)


@query(
    "revision_pointer",
    "W20 M6 W10",
    # One event after another: what is kept, where the pointer stands in it, and the last number given.
    """WITH RECURSIVE e AS (SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'undo' WHEN 'signup' THEN 'redo' WHEN 'error' THEN 'goto' ELSE 'push' END AS event,
        floor(value * 1000000)::BIGINT AS size, floor(value)::BIGINT AS target, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    s AS (SELECT DISTINCT session_id, 0::BIGINT AS n, NULL::BIGINT AS seq, []::STRUCT(r BIGINT, size BIGINT)[] AS kept, 0::BIGINT AS spot, -1::BIGINT AS last FROM e
      UNION ALL
      SELECT session_id, n, seq, CASE WHEN event = 'push' THEN list_slice(grown, cut + 1, len(grown)) ELSE kept END,
        CASE event WHEN 'push' THEN len(grown) - cut WHEN 'undo' THEN CASE WHEN spot > 1 THEN spot - 1 ELSE spot END WHEN 'redo' THEN CASE WHEN spot < len(kept) THEN spot + 1 ELSE spot END
          ELSE coalesce(nullif(list_position(list_transform(kept, lambda x: x.r), target), 0), spot) END,
        CASE WHEN event = 'push' THEN last + 1 ELSE last END
      FROM (
        SELECT *, coalesce(list_min(list_filter(range(len(grown)), lambda c: c = len(grown) - 1 OR (len(grown) - c <= 30 AND list_sum(list_transform(list_slice(grown, c + 1, len(grown)), lambda x: x.size)) <= 536870912))), 0) AS cut
        FROM (SELECT s.session_id, e.n, e.seq, e.event, e.target, s.kept, s.spot, s.last, list_append(list_slice(s.kept, 1, s.spot), {'r': s.last + 1, 'size': e.size}) AS grown
              FROM s JOIN e ON e.session_id = s.session_id AND e.n = s.n + 1)))
    SELECT session_id, seq, kept[spot].r AS current, spot > 1 AS can_undo, spot < len(kept) AS can_redo FROM s WHERE n > 0""",
)
def revision_pointer(spark, folder):
    kinds = {"view": "push", "purchase": "push", "click": "undo", "signup": "redo", "error": "goto"}
    named = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])
    log = events(spark, folder).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), named[F.col("event_type")].alias("event"),
        F.floor(F.col("value") * 1000000).alias("size_bytes"), F.floor("value").alias("target"),
    )
    return ops.revision_pointer(log)


@query(
    "recoverable_sessions",
    "J19 M3 T6",
    """WITH e AS (SELECT user_id * 10 + floor(value)::INT % 10 AS session_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'close' ELSE 'touch' END AS event, CASE event_type WHEN 'purchase' THEN true WHEN 'click' THEN false END AS dirty FROM events),
    f AS (SELECT session_id, max(ts) FILTER (WHERE event = 'open') AS o, max(ts) FILTER (WHERE event = 'close') AS c, max(ts) AS t, coalesce(arg_max(dirty, ts) FILTER (WHERE dirty IS NOT NULL), false) AS dirty FROM e GROUP BY 1),
    j AS (SELECT session_id, t, dirty, 'Customer#' || lpad(session_id::VARCHAR, 9, '0') AS path FROM f WHERE o IS NOT NULL AND (c IS NULL OR c < o))
    SELECT session_id, path, epoch_us(t) AS touched, dirty, dirty AND session_id % 2 = 0 AS unsaved_changes, path IN (SELECT c_name FROM customer) AS file_exists FROM j WHERE session_id NOT IN (SELECT s_suppkey FROM supplier)""",
)
def recoverable_sessions(spark, folder):
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "close").otherwise("touch")
    log = events(spark, folder).select(
        (F.col("user_id") * 10 + F.floor("value") % 10).alias("session_id"), "at", kind.alias("event"),
        F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "click", False).alias("dirty"),
    )
    journals = ops.open_sessions(log).select(
        "session_id", F.concat(F.lit("Customer#"), F.lpad(F.col("session_id").cast("string"), 9, "0")).alias("path"),
        "last_touched_at", "dirty", (F.col("session_id") % 2 == 0).alias("has_copy"),
    )
    active = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("session_id"))
    files = table(spark, folder, "customer").select(F.col("c_name").alias("path"))
    found = ops.recoverable(journals, active, files)
    return found.select("session_id", "path", F.unix_micros("last_touched_at").alias("touched"), "dirty", "unsaved_changes", "file_exists")


@query(
    "job_states",
    "M4",
    """WITH e AS (SELECT user_id * 100 + floor(value)::INT % 100 AS job_id, ts, ['view','click','purchase','signup','error'] AS k, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'succeed' WHEN 'signup' THEN 'cancel' ELSE 'fail' END AS event,
      CASE WHEN event_type = 'click' THEN event_id END AS completed, CASE WHEN event_type = 'view' THEN floor(value)::BIGINT END AS total, user_id % 2 = 0 AS cancellable FROM events),
    c AS (SELECT *, event IN ('succeed', 'fail') OR (event = 'cancel' AND cancellable) AS closes FROM e)
    SELECT job_id, epoch_us(min(ts)) AS started, arg_max(completed, ts) FILTER (WHERE completed IS NOT NULL) AS completed, arg_max(total, ts) FILTER (WHERE total IS NOT NULL) AS total,
      coalesce(CASE arg_min(event, ts) FILTER (WHERE closes) WHEN 'succeed' THEN 'succeeded' WHEN 'fail' THEN 'failed' WHEN 'cancel' THEN 'cancelled' END, 'running') AS state, epoch_us(min(ts) FILTER (WHERE closes)) AS finished FROM c GROUP BY 1""",
)
def job_states(spark, folder):
    kinds = {"view": "start", "click": "progress", "purchase": "succeed", "signup": "cancel", "error": "fail"}
    named = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])
    log = events(spark, folder).select(
        (F.col("user_id") * 100 + F.floor("value") % 100).alias("job_id"), "at", named[F.col("event_type")].alias("event"),
        F.when(F.col("event_type") == "click", F.col("event_id")).alias("completed"),
        F.when(F.col("event_type") == "view", F.floor("value")).alias("total"), (F.col("user_id") % 2 == 0).alias("cancellable"),
    )
    found = ops.job_states(log)
    return found.select(
        "job_id", F.unix_micros("started_at").alias("started"), "completed", "total", "state", F.unix_micros("finished_at").alias("finished")
    )


HOUR = 3600 * 1000


@query(
    "file_changes",
    "M1 M9",
    f"""WITH e AS (SELECT user_id AS doc_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE floor(value / 10)::BIGINT END AS size_bytes, event_type = 'signup' AS own FROM events),
    o AS (SELECT *, max(ts) FILTER (WHERE own) OVER (PARTITION BY doc_id ORDER BY ts) AS own_at, coalesce((epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY doc_id ORDER BY ts)) > {2 * HOUR})::INT, 1) AS fresh FROM e),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY ts) AS burst FROM o),
    s AS (SELECT doc_id, max(ts) AS ts, count(*) AS n, last(size_bytes ORDER BY ts) AS size_bytes, last(own_at ORDER BY ts) AS own_at FROM b GROUP BY doc_id, burst),
    l AS (SELECT *, last_value(size_bytes IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM s WHERE own_at IS NULL OR epoch_ms(ts) + {2 * HOUR} >= epoch_ms(own_at) + {5 * HOUR})
    SELECT doc_id, epoch_us(ts) AS at_us, n, CASE WHEN size_bytes IS NULL THEN 'deleted' ELSE 'modified' END AS change, size_bytes FROM l WHERE size_bytes IS NULL OR known IS NULL OR size_bytes <> known""",
)
def file_changes(spark, folder):
    log = events(spark, folder).select(
        F.col("user_id").alias("doc_id"), "at", F.when(F.col("event_type") != "error", F.floor(F.col("value") / 10)).alias("size_bytes"),
        (F.col("event_type") == "signup").alias("own_write"), "event_id",
    )
    found = ops.file_changes(log, gap_ms=2 * HOUR, quiet_ms=5 * HOUR, ties=["event_id"])
    return found.select("doc_id", F.unix_micros("at").alias("at_us"), "n", "change", "size_bytes")


@query(
    "first_opens",
    "M10 S3",
    """WITH e AS (SELECT user_id AS doc_id, ts, CASE event_type WHEN 'view' THEN 'open' WHEN 'error' THEN 'close' END AS event FROM events WHERE event_type IN ('view', 'error')),
    l AS (SELECT *, lag(event) OVER (PARTITION BY doc_id ORDER BY ts) AS before FROM e) SELECT doc_id, epoch_us(ts) AS at_us FROM l WHERE event = 'open' AND coalesce(before, 'close') <> 'open'""",
)
def first_opens(spark, folder):
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "error", "close")
    log = events(spark, folder).select(F.col("user_id").alias("doc_id"), "at", kind.alias("event"))
    return ops.first_opens(log).select("doc_id", F.unix_micros("at").alias("at_us"))


@query(
    "finished_exports",
    "M7",
    """WITH e AS (SELECT user_id * 100 + floor(value)::INT % 100 AS export_id, CASE user_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'text' ELSE 'docx' END AS mode, ts, CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'cancel' ELSE 'page' END AS event, event_id AS page FROM events),
    n AS (SELECT export_id, min(ts) AS end_at, arg_min(event, ts) AS how FROM e WHERE event <> 'page' GROUP BY 1)
    SELECT export_id, mode, page, epoch_us(CASE WHEN mode = 'png' THEN ts ELSE end_at END) AS delivered FROM e LEFT JOIN n USING (export_id) WHERE event = 'page' AND (end_at IS NULL OR ts <= end_at) AND (mode = 'png' OR how = 'finish')""",
)
def finished_exports(spark, folder):
    kind = F.when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "cancel").otherwise("page")
    modes = F.array(F.lit("png"), F.lit("text"), F.lit("docx"))
    log = events(spark, folder).select(
        (F.col("user_id") * 100 + F.floor("value") % 100).alias("export_id"), F.element_at(modes, (F.col("user_id") % 3 + 1).cast("int")).alias("mode"),
        "at", kind.alias("event"), F.col("event_id").alias("page"),
    )
    return ops.finished_exports(log, ["png", "jpeg", "webp"]).select("export_id", "mode", "page", F.unix_micros("delivered_at").alias("delivered"))


@query(
    "stored_recents",
    "S10 H30",
    """WITH r AS (SELECT event_id AS owner, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, ts FROM events)
    SELECT owner, 'p' || k AS path, event_type AS display_name, (k % 2 = 0) AS pinned, k AS size_bytes, event_type = 'error' OR k % 3 = 0 AS repaired FROM r WHERE k IS NOT NULL""",
)
def stored_recents(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint")
    good = F.to_json(
        F.struct(
            F.concat(F.lit("p"), k.cast("string")).alias("path"), F.col("event_type").alias("display_name"),
            F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_opened_at"), (k % 2 == 0).alias("pinned"), k.alias("size_bytes"),
        )
    )
    bad = F.when(k % 3 == 0, F.lit(',{"path":"","pinned":true},{"path":7,"last_opened_at":"never","pinned":false}')).otherwise(F.lit(""))
    version = F.when(F.col("event_type") == "error", "2").otherwise("1")
    raw = events(spark, folder).select(
        F.col("event_id").alias("owner"), F.concat(F.lit('{"version":'), version, F.lit(',"entries":['), good, bad, F.lit("]}")).alias("content")
    )
    return stored.recents_files(raw).drop("last_opened_at")


@query(
    "merged_settings",
    "S11",
    """WITH b AS (SELECT c_custkey AS owner, unnest(['theme', 'segment', 'tool_path']) AS key, unnest(['dark', c_mktsegment, '/usr/bin/' || c_nationkey]) AS value FROM customer),
    p AS (SELECT o_custkey AS owner, unnest(['theme', 'tool_path', 'extra']) AS key, unnest([CASE WHEN max(o_orderkey) % 2 = 0 THEN 'light' END, CASE WHEN max(o_orderkey) % 3 = 0 THEN 'new' END, 'x' || count(*)]) AS value FROM orders GROUP BY o_custkey)
    SELECT coalesce(b.owner, p.owner) AS owner, coalesce(b.key, p.key) AS key, CASE WHEN p.key = 'tool_path' AND p.value IS NULL THEN NULL ELSE coalesce(p.value, b.value) END AS value FROM b FULL JOIN p ON p.owner = b.owner AND p.key = b.key""",
)
def merged_settings(spark, folder):
    def rows(df, owner, **cells):
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in cells.items()])
        return df.select(F.col(owner).alias("owner"), F.inline(pairs))

    base = rows(
        table(spark, folder, "customer"), "c_custkey", theme=F.lit("dark"), segment=F.col("c_mktsegment"),
        tool_path=F.concat(F.lit("/usr/bin/"), F.col("c_nationkey").cast("string")),
    )
    facts = table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("m"), F.count("*").alias("n"))
    patch = rows(
        facts, "o_custkey", theme=F.when(F.col("m") % 2 == 0, F.lit("light")), tool_path=F.when(F.col("m") % 3 == 0, F.lit("new")),
        extra=F.concat(F.lit("x"), F.col("n").cast("string")),
    )
    return stored.merged_settings(base, patch, ["tool_path"])
