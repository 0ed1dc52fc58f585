"""Sessions, revisions, recent files, jobs and file changes as event tables.

These are the batch answers; :mod:`quire.streaming` keeps the same answers up to
date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.folds import ordered_fold

# Fixed values.
PINNED, UNPINNED = 30, 20
MOST_REVISIONS, MOST_BYTES = 30, 512 * 1024 * 1024


def recents(opens: DataFrame, pinned: int = PINNED, unpinned: int = UNPINNED) -> DataFrame:
    """Recent files per owner: pinned ones first, newest first, each list cut to its length.

    ``opens``: owner, path, at, pin (true pins, false unpins, null leaves).  Paths
    are one file whatever their case; reopening keeps the pin.
    """
    folded = opens.groupBy("owner", F.lower("path").alias("key")).agg(
        F.max_by("path", "at").alias("path"),
        F.max("at").alias("at"),
        F.coalesce(F.max_by("pin", F.when(F.col("pin").isNotNull(), F.col("at"))), F.lit(False)).alias("pinned"),
    )
    order = Window.partitionBy("owner", "pinned").orderBy(F.desc("at"), "key")
    # The rank filter is applied before the shuffle too, so an owner with very
    # many files sends only the newest of each task.
    ranked = folded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(pinned, unpinned))
    return ranked.where((F.col("pinned") & (F.col("rank") <= pinned)) | (~F.col("pinned") & (F.col("rank") <= unpinned))).select(
        "owner", "path", "at", "pinned", "rank"
    )


def kept_revisions(revisions: DataFrame, most: int = MOST_REVISIONS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Revisions of push-only logs that survive the budget, and which undo can reach.

    ``revisions``: session_id, revision, size_bytes.  From the newest back while
    count and bytes fit; the newest and the base (0) always stay.
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc("revision"))
    # Past ``most`` nothing can stay, so each task first drops all but its newest.
    recent = revisions.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most)
    bytes_back = F.sum("size_bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    reachable = recent.withColumn("bytes", bytes_back).where((F.col("bytes") <= most_bytes) | (F.col("n") == 1))
    kept = reachable.select("session_id", "revision", "size_bytes", F.lit(True).alias("reachable"))
    base = revisions.where("revision = 0").join(kept.select("session_id", "revision"), ["session_id", "revision"], "left_anti")
    return kept.unionByName(base.select("session_id", "revision", "size_bytes", F.lit(False).alias("reachable")))


class RevisionLog:
    """Undo history of one session: the entries that can still be reached, and a pointer.

    Entries pushed out at the front are forgotten, so a session keeps ``most`` of them
    and one more, however long it runs.
    """

    def __init__(self, most: int = MOST_REVISIONS, most_bytes: int = MOST_BYTES):
        self.most, self.most_bytes = most, most_bytes
        self.entries: list[tuple[int, int]] = []
        self.at, self.last = -1, -1

    def step(self, row: dict):
        event = row["event"]
        if event == "push":
            del self.entries[self.at + 1 :]
            self.last += 1
            self.entries.append((self.last, int(row["size_bytes"])))
            self.at = len(self.entries) - 1
            while self.at > 0 and self._over():
                del self.entries[0]
                self.at -= 1
        elif event == "undo" and self.at > 0:
            self.at -= 1
        elif event == "redo" and self.at + 1 < len(self.entries):
            self.at += 1
        elif event == "goto":
            places = [i for i, (r, _) in enumerate(self.entries) if r == int(row["target"])]
            if places:
                self.at = places[0]
        current = self.entries[self.at][0] if self.entries else None
        return [(row["seq"], current, self.at > 0, self.at + 1 < len(self.entries))]

    def _over(self) -> bool:
        return len(self.entries) > self.most or sum(size for _, size in self.entries) > self.most_bytes

    def finish(self):
        return []


def revision_pointer(events: DataFrame) -> DataFrame:
    """The current revision after every event, and whether undo and redo are open.

    ``events``: session_id, seq, event (push, undo, redo, goto), size_bytes, target.
    """
    return ordered_fold(
        events.select("session_id", "seq", "event", "size_bytes", "target"),
        ["session_id"], ["seq"], RevisionLog,
        "session_id long, seq long, current long, can_undo boolean, can_redo boolean",
    )


def recoverable(journals: DataFrame, active: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions that never closed and are not open now, newest first.

    ``journals``: session_id, path, last_touched_at, dirty, has_copy; ``active``:
    session_id; ``files``: path.
    """
    exists = files.select("path").distinct().withColumn("file_exists", F.lit(True))
    return (
        journals.join(active, "session_id", "left_anti")
        .join(exists, "path", "left")
        .select(
            "session_id", "path", "last_touched_at", "dirty",
            (F.col("dirty") & F.col("has_copy")).alias("unsaved_changes"),
            F.coalesce("file_exists", F.lit(False)).alias("file_exists"),
        )
        .orderBy(F.desc("last_touched_at"))
    )


def open_sessions(events: DataFrame) -> DataFrame:
    """Sessions whose last open has no later close: ``session_id, opened_at, last_touched_at, dirty``.

    ``events``: session_id, at, event (open, close, touch), dirty (nullable).
    """
    facts = events.groupBy("session_id").agg(
        F.max(F.when(F.col("event") == "open", F.col("at"))).alias("opened_at"),
        F.max(F.when(F.col("event") == "close", F.col("at"))).alias("closed_at"),
        F.max("at").alias("last_touched_at"),
        F.max_by("dirty", F.when(F.col("dirty").isNotNull(), F.col("at"))).alias("dirty"),
    )
    never_closed = F.col("closed_at").isNull() | (F.col("closed_at") < F.col("opened_at"))
    return facts.where(F.col("opened_at").isNotNull() & never_closed).select(
        "session_id", "opened_at", "last_touched_at", F.coalesce("dirty", F.lit(False)).alias("dirty")
    )


def job_states(events: DataFrame) -> DataFrame:
    """Jobs after all their events: state, last known progress, when they ended.

    ``events``: job_id, at, event (start, progress, succeed, fail, cancel), completed,
    total, cancellable.  Progress keeps the last value given; a job ends at its
    first closing event that may close it (cancelling needs a cancellable job).
    """
    closes = F.col("event").isin("succeed", "fail") | ((F.col("event") == "cancel") & F.col("cancellable"))
    ended = F.when(closes, F.struct("at", "event"))
    worded = F.create_map(
        F.lit("succeed"), F.lit("succeeded"), F.lit("fail"), F.lit("failed"), F.lit("cancel"), F.lit("cancelled")
    )

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("at")))

    facts = events.groupBy("job_id").agg(
        F.min("at").alias("started_at"), F.min(ended).alias("end"), last("completed").alias("completed"), last("total").alias("total")
    )
    return facts.select(
        "job_id", "started_at", "completed", "total",
        F.coalesce(worded[F.col("end.event")], F.lit("running")).alias("state"), F.col("end.at").alias("finished_at"),
    )


def bursts(events: DataFrame, keys: list[str], at: str, gap_ms: int, ties: list[str] | None = None) -> DataFrame:
    """Events joined while they follow within a gap: ``keys, first_at, last_at, n`` and the last row.

    Of rows at the last time the one with the least ``ties`` (whole numbers) is told.
    """
    order = Window.partitionBy(*keys).orderBy(at)
    quiet = F.unix_millis(F.col(at)) - F.unix_millis(F.lag(at).over(order))
    rest = [c for c in events.columns if c not in keys]
    return (
        events.withColumn("_new", F.coalesce((quiet > gap_ms).cast("int"), F.lit(1)))
        .withColumn("_burst", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_burst")
        .agg(
            F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"),
            F.max_by(F.struct(*rest), F.struct(at, *[-F.col(t) for t in ties or []])).alias("last"),
        )
        .drop("_burst")
    )


def file_changes(events: DataFrame, gap_ms: int = 250, quiet_ms: int = 2000, ties: list[str] | None = None) -> DataFrame:
    """Changes worth telling: bursts settled, own writes ignored, unchanged facts silent.

    ``events``: doc_id, at, size_bytes (null when the file is gone), own_write.  A
    burst is looked at once, ``gap_ms`` after its last event, with the facts then;
    nothing is said within ``quiet_ms`` of an own write or when nothing changed.  An own
    write counts for all events of its time; the facts are those of the least ``ties``.
    """
    order = Window.partitionBy("doc_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("own_at", F.max(F.when(F.col("own_write"), F.col("at"))).over(order))
    settled = bursts(seen, ["doc_id"], "at", gap_ms, ties).select(
        "doc_id", F.col("last_at").alias("at"), "n", "last.size_bytes", "last.own_at"
    )
    checked = F.unix_millis("at") + gap_ms
    looked = settled.where(F.col("own_at").isNull() | (checked >= F.unix_millis("own_at") + quiet_ms))
    facts = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last("size_bytes", ignorenulls=True).over(facts)
    return (
        looked.withColumn("known", known)
        .where(F.col("size_bytes").isNull() | F.col("known").isNull() | (F.col("size_bytes") != F.col("known")))
        .select("doc_id", "at", "n", F.when(F.col("size_bytes").isNull(), "deleted").otherwise("modified").alias("change"), "size_bytes")
    )


def first_opens(events: DataFrame) -> DataFrame:
    """Opens that count: a document already open is not opened again.

    ``events``: doc_id, at, event (open, close).  An open counts when the event
    before it is not an open.
    """
    order = Window.partitionBy("doc_id").orderBy("at")
    relevant = events.where(F.col("event").isin("open", "close"))
    return relevant.withColumn("before", F.lag("event").over(order)).where(
        (F.col("event") == "open") & (F.coalesce("before", F.lit("close")) != "open")
    ).select("doc_id", "at")


def finished_exports(events: DataFrame, per_page: list[str]) -> DataFrame:
    """Pages an export delivered: picture kinds at once, document kinds when finished.

    ``events``: export_id, mode, at, event (page, finish, cancel), page.
    """
    end = events.where(F.col("event").isin("finish", "cancel")).groupBy("export_id").agg(
        F.min(F.struct("at", "event")).alias("end")
    )
    pages = events.where(F.col("event") == "page").join(end, "export_id", "left").where(
        F.col("end").isNull() | (F.col("at") <= F.col("end.at"))
    )
    at_once = F.col("mode").isin(per_page)
    return pages.where(at_once | (F.col("end.event") == "finish")).select(
        "export_id", "mode", "page", F.when(at_once, F.col("at")).otherwise(F.col("end.at")).alias("delivered_at")
    )
