"""Standing queries over event and page streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.facts import scrubbed
from quire.operators import sessions
from quire.operators.sessions import RevisionLog
from quire.streaming.folds import stateful_fold


def table_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def scrubbed_log(lines: DataFrame) -> DataFrame:
    """Log lines with sensitive values masked; no state."""
    return lines.withColumn("line", scrubbed(F.col("line")))


def standing_hits(pages: DataFrame, query: str, run_key: str, late: str = "1 hour") -> DataFrame:
    """Hits of a query on pages as they arrive, each once per run: ``run_key, doc_id, page, start, at``.

    ``pages``: doc_id, page, text, at.  A page delivered twice within the lateness gives
    its hits once; hits of another run have another key.
    """
    from quire.functions.text import match_starts

    found = pages.withWatermark("at", late).where(F.contains(F.lower("text"), F.lit(query.lower()))).select(
        F.lit(run_key).alias("run_key"), "doc_id", "page", "at", F.explode(match_starts(F.col("text"), query)).alias("start")
    )
    return found.dropDuplicatesWithinWatermark(["run_key", "doc_id", "page", "start"])


def settled_queries(typed: DataFrame, gap: str = "180 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last query of each burst of typing: ``owner, query, first_at, last_at, n``."""
    return (
        typed.withWatermark("at", late)
        .groupBy("owner", F.session_window("at", gap).alias("burst"))
        .agg(F.max_by("query", "at").alias("query"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"))
        .drop("burst")
    )


def open_sessions(events: DataFrame) -> DataFrame:
    """Sessions that never closed, kept current (update or complete mode)."""
    return sessions.open_sessions(events)


def job_states(events: DataFrame) -> DataFrame:
    """Jobs and their progress, kept current (update or complete mode)."""
    return sessions.job_states(events)


class LiveSession:
    """A session until it closes; what is left open is told when nothing more is heard of it."""

    def __init__(self):
        self.opened = self.touched = None
        self.dirty = self.over = False

    def step(self, row: dict):
        self.touched = row["at_us"]
        if row["dirty"] is not None:
            self.dirty = bool(row["dirty"])
        if row["event"] == "open":
            self.opened, self.over = row["at_us"], False
        closed = row["event"] == "close" and self.opened is not None
        self.over = self.opened is None or closed
        out = [("closed", self.opened, self.touched, self.dirty)] if closed else []
        if closed:
            self.opened = None
        return out

    def finish(self):
        return [("recoverable", self.opened, self.touched, self.dirty)] if self.opened is not None else []

    def dump(self):
        return [self.opened, self.touched, self.dirty]

    def load(self, body):
        self.opened, self.touched, self.dirty = body


def session_ends(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """How each session ended: closed, or left open for ``idle_ms``: ``session_id, ended, opened_us, last_us, dirty``.

    ``events``: session_id, at_us, event (open, touch, close), dirty (nullable).  A closed
    session leaves the state at once, and so does what comes in for one never opened.
    """
    return stateful_fold(
        events.select("session_id", "at_us", "event", "dirty"), ["session_id"], ["at_us"], LiveSession,
        "session_id long, ended string, opened_us long, last_us long, dirty boolean", idle_ms,
    )


class LiveJob:
    """A job until it ends, with its last known progress."""

    ends = {"succeed": "succeeded", "fail": "failed", "cancel": "cancelled"}

    def __init__(self):
        self.started = self.completed = self.total = None
        self.over = False

    def step(self, row: dict):
        if self.over:
            return []
        self.started = row["at_us"] if self.started is None else self.started
        self.completed = self.completed if row["completed"] is None else row["completed"]
        self.total = self.total if row["total"] is None else row["total"]
        self.over = row["event"] in ("succeed", "fail") or (row["event"] == "cancel" and bool(row["cancellable"]))
        return [(self.ends[row["event"]], self.started, row["at_us"], self.completed, self.total)] if self.over else []

    def finish(self):
        return [("running", self.started, None, self.completed, self.total)]

    def dump(self):
        return [self.started, self.completed, self.total]

    def load(self, body):
        self.started, self.completed, self.total = body


def job_ends(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Each job once, when it ends, or as running when nothing was heard of it for ``idle_ms``.

    ``events``: job_id, at_us, event (start, progress, succeed, fail, cancel), completed,
    total, cancellable -> ``job_id, state, started_us, finished_us, completed, total``.
    An ended job leaves the state; an identifier that comes again is a new job.
    """
    return stateful_fold(
        events.select("job_id", "at_us", "event", "completed", "total", "cancellable"), ["job_id"], ["at_us"], LiveJob,
        "job_id long, state string, started_us long, finished_us long, completed long, total long", idle_ms,
    )


class LiveRevisions(RevisionLog):
    def dump(self):
        return {"entries": self.entries, "at": self.at, "last": self.last}

    def load(self, body):
        self.entries = [tuple(e) for e in body["entries"]]
        self.at, self.last = body["at"], body["last"]


def revision_pointer(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The current revision after every event of each session."""
    return stateful_fold(
        events.select("session_id", "seq", "event", "size_bytes", "target"), ["session_id"], ["seq"], LiveRevisions,
        "session_id long, seq long, current long, can_undo boolean, can_redo boolean", idle_ms,
    )


class FileWatch:
    """Bursts of one file's events: settled once, own writes and unchanged facts silent."""

    gap_us, quiet_us = 250_000, 2_000_000

    def __init__(self):
        self.last = self.size = self.own = self.known = None
        self.n = 0

    def step(self, row: dict):
        out = self._settle() if self.last is not None and self._gap(row["at_us"]) else []
        if row["own_write"]:
            self.own = int(row["at_us"])
        self.last, self.n = int(row["at_us"]), self.n + 1
        self.size = None if row["size_bytes"] is None else int(row["size_bytes"])
        return out

    def _gap(self, at: int) -> bool:
        return at // 1000 - self.last // 1000 > self.gap_us // 1000

    def _settle(self):
        quiet = self.own is not None and (self.last + self.gap_us) // 1000 < (self.own + self.quiet_us) // 1000
        told = not quiet and (self.size is None or self.known is None or self.size != self.known)
        out = [(self.last, self.n, "deleted" if self.size is None else "modified", self.size)] if told else []
        if not quiet and self.size is not None:
            self.known = self.size
        self.n = 0
        return out

    def finish(self):
        out = self._settle() if self.n else []
        self.last = None
        return out

    def dump(self):
        return [self.last, self.size, self.own, self.known, self.n]

    def load(self, body):
        self.last, self.size, self.own, self.known, self.n = body


def file_watch(gap_ms: int, quiet_ms: int) -> type[FileWatch]:
    return type("FileWatch", (FileWatch,), {"gap_us": gap_ms * 1000, "quiet_us": quiet_ms * 1000})


def file_changes(events: DataFrame, gap_ms: int = 250, quiet_ms: int = 2000, idle_ms: int | None = None) -> DataFrame:
    """File changes worth telling.  ``events``: doc_id, at_us, size_bytes, own_write.

    A burst is settled by the next event after the gap, or by a timer: after ``idle_ms``
    (the gap, unless said otherwise) without an event the last burst is told too.
    """
    return stateful_fold(
        events.select("doc_id", "at_us", "size_bytes", "own_write"), ["doc_id"], ["at_us"], file_watch(gap_ms, quiet_ms),
        "doc_id long, at_us long, n long, change string, size_bytes long", gap_ms if idle_ms is None else idle_ms,
    )


class OpenGate:
    """An open counts when the document is not open already."""

    def __init__(self):
        self.open = False

    def step(self, row: dict):
        counts = row["event"] == "open" and not self.open
        self.open = row["event"] == "open"
        return [(row["at_us"],)] if counts else []

    def finish(self):
        return []

    def dump(self):
        return self.open

    def load(self, body):
        self.open = body


def first_opens(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Opens of documents not open already.  ``events``: doc_id, at_us, event (open, close)."""
    return stateful_fold(
        events.select("doc_id", "at_us", "event"), ["doc_id"], ["at_us"], OpenGate, "doc_id long, at_us long", idle_ms
    )


class ExportSession:
    """Pages of one export: picture kinds leave at once, others wait for the finish."""

    per_page = ("png", "jpeg", "webp")

    def __init__(self):
        self.held: list[list] = []
        self.ended = False

    def step(self, row: dict):
        if self.ended:
            return []
        if row["event"] == "page":
            if row["mode"] in self.per_page:
                return [(row["mode"], row["page"], row["at_us"])]
            self.held.append([row["mode"], row["page"]])
            return []
        self.ended = True
        out = [(mode, page, row["at_us"]) for mode, page in self.held] if row["event"] == "finish" else []
        self.held = []
        return out

    def finish(self):
        return []

    def dump(self):
        return {"held": self.held, "ended": self.ended}

    def load(self, body):
        self.held, self.ended = body["held"], body["ended"]


def finished_exports(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Pages each export delivers.  ``events``: export_id, mode, at_us, event, page."""
    return stateful_fold(
        events.select("export_id", "mode", "at_us", "event", "page"), ["export_id"], ["at_us"], ExportSession,
        "export_id long, mode string, page long, delivered long", idle_ms,
    )


class RecentList:
    """One owner's recent files: reopened ones move up and keep their pin."""

    def __init__(self):
        self.files: dict[str, list] = {}

    def step(self, row: dict):
        key = row["path"].lower()
        path, _, pinned = self.files.get(key, [None, None, False])
        if row["pin"] is not None:
            pinned = bool(row["pin"])
        self.files[key] = [row["path"], int(row["at_us"]), pinned]
        kept = {}
        for flag, most in ((True, sessions.PINNED), (False, sessions.UNPINNED)):
            group = sorted((k for k, v in self.files.items() if v[2] is flag), key=lambda k: (-self.files[k][1], k))
            kept.update({k: self.files[k] for k in group[:most]})
        self.files = kept
        return []

    def listed(self):
        out = []
        for flag in (True, False):
            group = sorted((k for k, v in self.files.items() if v[2] is flag), key=lambda k: (-self.files[k][1], k))
            out += [(self.files[k][0], self.files[k][1], flag, n) for n, k in enumerate(group, 1)]
        return out

    def finish(self):
        return []

    def dump(self):
        return self.files

    def load(self, body):
        self.files = body


class PublishedRecents(RecentList):
    """Gives the whole list after every open, stamped with the event that made it."""

    def step(self, row: dict):
        super().step(row)
        return [(int(row["at_us"]), *entry) for entry in self.listed()]


def recent_files(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Each owner's list after each open: ``owner, version, path, opened, pinned, rank``.

    ``events``: owner, path, at_us, pin.  The state holds one list, at most fifty files.
    """
    return stateful_fold(
        events.select("owner", "path", "at_us", "pin"), ["owner"], ["at_us"], PublishedRecents,
        "owner long, version long, path string, opened long, pinned boolean, rank long", idle_ms,
    )
