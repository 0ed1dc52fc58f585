"""Streams give what the batch operators give."""

import itertools
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.operators import sessions
from quire.plans.search import pages_of
from quire.streaming import flows

HOUR = 3600 * 1000
NAMES = itertools.count()


@pytest.fixture(scope="module")
def event_files(spark, small):
    """Events in order of time, in four files."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).drop("ts")
    events = events.withColumn("at_us", F.unix_micros("at")).orderBy("at").coalesce(1)
    rows = events.count()
    events.write.mode("overwrite").option("maxRecordsPerFile", rows // 4 + 1).parquet(f"{folder}/e")
    return f"{folder}/e"


def run(frame, mode="append"):
    name = f"out_{next(NAMES)}"
    query = (
        frame.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def both(spark, event_files):
    batch = spark.read.parquet(event_files)
    return batch, flows.table_stream(spark, event_files, batch.schema)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_revision_pointer(spark, event_files):
    kinds = F.create_map(*[F.lit(v) for p in {"view": "push", "purchase": "push", "click": "undo", "signup": "redo", "error": "goto"}.items() for v in p])

    def log(df):
        return df.select(
            F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("event"),
            F.floor(F.col("value") * 1000000).alias("size_bytes"), F.floor("value").alias("target"),
        )

    batch, stream = both(spark, event_files)
    assert rows(run(flows.revision_pointer(log(stream)))) == rows(sessions.revision_pointer(log(batch)))


def test_file_changes(spark, event_files):
    def log(df):
        return df.select(
            F.col("user_id").alias("doc_id"), "at", "at_us",
            F.when(F.col("event_type") != "error", F.floor(F.col("value") / 10)).alias("size_bytes"),
            (F.col("event_type") == "signup").alias("own_write"),
        )

    batch, stream = both(spark, event_files)
    told = rows(run(flows.file_changes(log(stream), 2 * HOUR, 5 * HOUR)))
    found = sessions.file_changes(log(batch), 2 * HOUR, 5 * HOUR).select(
        "doc_id", F.unix_micros("at").alias("at_us"), "n", "change", "size_bytes"
    )
    # The last burst of a file settles only when something comes after it.
    last = log(batch).groupBy("doc_id").agg(F.max("at_us").alias("at_us"))
    settled = rows(found.join(last, ["doc_id", "at_us"], "left_anti").select("doc_id", "at_us", "n", "change", "size_bytes"))
    assert told == settled and told


def test_first_opens(spark, event_files):
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "error", "close")

    def log(df):
        return df.select(F.col("user_id").alias("doc_id"), "at", "at_us", kind.alias("event")).where("event is not null")

    batch, stream = both(spark, event_files)
    expected = sessions.first_opens(log(batch)).select("doc_id", F.unix_micros("at"))
    assert rows(run(flows.first_opens(log(stream)))) == rows(expected)


def test_exports(spark, event_files):
    kind = F.when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "cancel").otherwise("page")
    modes = F.array(F.lit("png"), F.lit("text"), F.lit("docx"))

    def log(df):
        return df.select(
            (F.col("user_id") * 10 + F.floor("value") % 10).alias("export_id"),
            F.element_at(modes, (F.col("user_id") % 3 + 1).cast("int")).alias("mode"), "at", "at_us", kind.alias("event"), F.col("event_id").alias("page"),
        )

    batch, stream = both(spark, event_files)
    expected = sessions.finished_exports(log(batch), ["png", "jpeg", "webp"]).select("export_id", "mode", "page", F.unix_micros("delivered_at"))
    expected = expected.where(F.col("mode").isin("png", "jpeg", "webp") | F.col("page").isNotNull())
    assert rows(run(flows.finished_exports(log(stream)))) == rows(expected)


def test_recents(spark, event_files):
    def log(df):
        return df.select(
            F.col("user_id").alias("owner"), F.concat(F.lit("F"), (F.floor("value") % 12).cast("string")).alias("path"), "at", "at_us",
            F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "error", False).alias("pin"),
        )

    batch, stream = both(spark, event_files)
    out = run(flows.recent_files(log(stream))).collect()
    latest = {}
    for row in out:
        latest[row.owner] = max(latest.get(row.owner, 0), row.version)
    # A pin of a file that fell off the list is forgotten by the live list, so
    # compare owners that never filled it.
    few = log(batch).groupBy("owner").agg(F.countDistinct("path").alias("n")).where("n <= 20").select("owner")
    owners = {r.owner for r in few.collect()}
    final = [(r.owner, r.path, r.opened, r.pinned, r["rank"]) for r in out if r.owner in owners and r.version == latest[r.owner]]
    expected = sessions.recents(log(batch)).select("owner", "path", F.unix_micros("at").alias("opened"), "pinned", F.col("rank").cast("bigint").alias("rank"))
    assert owners and sorted(final, key=repr) == rows(expected.join(few, "owner", "left_semi"))


def test_open_sessions_and_jobs(spark, event_files):
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "close").otherwise("touch")

    def log(df):
        return df.select(F.col("user_id").alias("session_id"), "at", kind.alias("event"), (F.col("event_type") == "purchase").alias("dirty"))

    batch, stream = both(spark, event_files)
    assert rows(run(flows.open_sessions(log(stream)), "complete")) == rows(sessions.open_sessions(log(batch)))


def test_settled_queries(spark, event_files):
    def log(df):
        return df.select(F.col("user_id").alias("owner"), "at", F.col("props").alias("query"))

    batch, stream = both(spark, event_files)
    told = set(rows(run(flows.settled_queries(log(stream), "2 hours", "10 minutes"))))
    expected = sessions.bursts(log(batch), ["owner"], "at", 2 * HOUR).select("owner", "last.query", "first_at", "last_at", "n")
    assert told and told <= set(rows(expected))


def test_standing_hits_once(spark, small):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    pages = pages_of(spark, small).select("doc_id", "page", "text", F.timestamp_seconds(F.col("doc_id")).alias("at"))
    # Every page is delivered twice.
    pages.write.parquet(f"{folder}/p")
    pages.write.mode("append").parquet(f"{folder}/p")
    stream = flows.table_stream(spark, f"{folder}/p", pages.schema, 2)
    hits = run(flows.standing_hits(stream, "ation", "run-1", "10 days"))
    from quire.operators.search import search_pages

    expected = search_pages(pages_of(spark, small), "ation").select("doc_id", "page", "start")
    assert rows(hits.select("doc_id", "page", "start")) == rows(expected)


def test_scrubbed_stream(spark, event_files):
    _, stream = both(spark, event_files)
    lines = run(flows.scrubbed_log(stream.select(F.concat(F.lit("token="), "event_type").alias("line"))))
    assert {r[0] for r in lines.select("line").distinct().collect()} == {"token=***"}


def run_with_state(frame):
    """What a run gives, and how many keys its state holds at the end."""
    name = f"out_{next(NAMES)}"
    query = (
        frame.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return frame.sparkSession.table(name), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_closed_sessions_leave_the_state(spark, event_files):
    kinds = F.create_map(*[F.lit(v) for p in {"view": "touch", "purchase": "open", "click": "touch", "signup": "open", "error": "close"}.items() for v in p])

    def log(df):
        return df.select(
            F.col("user_id").alias("session_id"), "at", "at_us", kinds[F.col("event_type")].alias("event"), F.when(F.col("value") > 50, F.col("value") > 90).alias("dirty")
        )

    batch, stream = both(spark, event_files)
    told, held = run_with_state(flows.session_ends(log(stream)))
    open_ = sessions.open_sessions(log(batch))
    assert held == open_.count() > 0
    expected = {}
    for r in log(batch).orderBy("session_id", "at_us").collect():
        state = expected.setdefault(r.session_id, {"open": None, "ends": []})
        if r.event == "open":
            state["open"] = r.at_us
        elif r.event == "close" and state["open"] is not None:
            state["ends"].append((r.session_id, state["open"], r.at_us))
            state["open"] = None
    assert rows(told.select("session_id", "opened_us", "last_us")) == sorted((e for s in expected.values() for e in s["ends"]), key=repr)


def test_ended_jobs_leave_the_state(spark, event_files):
    kinds = F.create_map(*[F.lit(v) for p in {"view": "progress", "purchase": "start", "click": "progress", "signup": "succeed", "error": "cancel"}.items() for v in p])

    def log(df):
        # An identifier is one job: what comes after its end is left out.
        jobs = df.select(
            F.col("user_id").alias("job_id"), "at", "at_us",
            F.when((F.col("event_id") % 9 > 0) & F.col("event_type").isin("signup", "error"), "progress").otherwise(kinds[F.col("event_type")]).alias("event"),
            F.floor("value").alias("completed"),
            F.when(F.col("value") > 40, F.lit(100).cast("long")).alias("total"), (F.col("user_id") % 2 == 0).alias("cancellable"),
        )
        return jobs

    batch = log(spark.read.parquet(event_files))
    closes = (F.col("event") == "succeed") | ((F.col("event") == "cancel") & F.col("cancellable"))
    first = batch.where(closes).groupBy("job_id").agg(F.min("at").alias("end"))
    once = batch.join(first, "job_id", "left").where("end is null or at <= end").drop("end")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    once.orderBy("at").coalesce(1).write.mode("overwrite").option("maxRecordsPerFile", once.count() // 4 + 1).parquet(f"{folder}/e")
    told, held = run_with_state(flows.job_ends(flows.table_stream(spark, f"{folder}/e", once.schema)))
    states = sessions.job_states(once)
    done = states.where("state <> 'running'")
    assert held == states.where("state = 'running'").count() > 0
    assert rows(told) == rows(done.select("job_id", "state", F.unix_micros("started_at"), F.unix_micros("finished_at"), "completed", "total"))


def test_the_last_burst_is_told_by_a_timer(spark, tmp_path):
    import time

    events = spark.createDataFrame([(1, 1_000, 5, False), (1, 2_000, 7, False), (2, 1_000, None, False)], "doc_id long, at_us long, size_bytes long, own_write boolean")
    events.write.parquet(f"{tmp_path}/e")
    stream = flows.table_stream(spark, f"{tmp_path}/e", events.schema, 10)
    name = f"out_{next(NAMES)}"
    query = (
        flows.file_changes(stream, gap_ms=50).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(processingTime="100 milliseconds").start()
    )
    until = time.time() + 90
    while time.time() < until and spark.table(name).count() < 2:
        time.sleep(0.5)
    query.stop()
    assert rows(spark.table(name)) == [(1, 2000, 2, "modified", 7), (2, 1000, 1, "deleted", None)]
