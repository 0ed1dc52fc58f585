"""Logs of edits applied to tables: page order, keyed rows, outlines, wording.

Page and outline edits name places as the edit before left them, so they are
ordered folds per document.  Edits of keyed rows are set-based: the last change
of each field wins, and no history is replayed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import ranges
from quire.operators.folds import ordered_fold

NO_PAGE = "That change does not apply to any page of this document."
LAST_PAGE = "A PDF must keep at least one page."
MARK_OUTSIDE = "A marked area belongs to a page this document does not have."
COMMENT_OUTSIDE = "That comment belongs to a page this document does not have."


class Refused(Exception):
    """An edit that cannot be applied; its whole transaction is left out."""


class PageEdits:
    """Pages of one document under edits, a transaction at a time."""

    def __init__(self):
        self.pages: list[dict] = []
        self.fresh = 0
        self.pending: list[dict] = []
        self.txn = None

    def step(self, row: dict):
        out = []
        if row["txn"] != self.txn:
            out = self._commit()
            self.txn = row["txn"]
        self.pending.append(row)
        return out

    def finish(self):
        errors = self._commit()
        pages = [
            (n, p["ref"], p["rotation"], p["crop_width"], p["crop_height"], None, None)
            for n, p in enumerate(self.pages, 1)
        ]
        return errors + pages

    def _commit(self):
        before, fresh = [dict(p) for p in self.pages], self.fresh
        operations, self.pending = self.pending, []
        try:
            for operation in operations:
                self._apply(operation)
        except Refused as error:
            self.pages, self.fresh = before, fresh
            return [(None, None, None, None, None, self.txn, str(error))]
        return []

    def _targets(self, operation: dict) -> list[int]:
        wanted = sorted({int(p) for p in operation["pages"] if 1 <= p <= len(self.pages)})
        if not wanted:
            raise Refused(NO_PAGE)
        return wanted

    def _apply(self, operation: dict) -> None:
        kind, pages = operation["kind"], self.pages
        number = operation["number"]
        if kind == "open":
            self.pages = [
                {"ref": n, "rotation": 0, "crop_width": operation["width"], "crop_height": operation["height"], "media": (operation["width"], operation["height"])}
                for n in range(1, number + 1)
            ]
        elif kind == "insertBlankPages":
            at = max(0, min(number, len(pages)))
            like = pages[at - 1] if at > 0 else {"crop_width": 595.28, "crop_height": 841.89, "media": (595.28, 841.89)}
            added = []
            for _ in range(int(operation["pages"][0])):
                self.fresh -= 1
                added.append({"ref": self.fresh, "rotation": 0, "crop_width": like["media"][0], "crop_height": like["media"][1], "media": like["media"]})
            pages[at:at] = added
        elif kind in ("applyRedactions", "addAnnotations"):
            if any(p < 1 or p > len(pages) for p in operation["pages"]):
                raise Refused(MARK_OUTSIDE if kind == "applyRedactions" else COMMENT_OUTSIDE)
        elif kind in ("rotatePages", "deletePages", "movePages", "duplicatePages", "cropPages"):
            chosen = set(self._targets(operation))
            named = [p for n, p in enumerate(pages, 1) if n in chosen]
            rest = [p for n, p in enumerate(pages, 1) if n not in chosen]
            if kind == "rotatePages":
                for page in named:
                    page["rotation"] = (page["rotation"] + number) % 360
            elif kind == "deletePages":
                if not rest:
                    raise Refused(LAST_PAGE)
                self.pages = rest
            elif kind == "movePages":
                ahead = sum(1 for n in chosen if n <= number)
                target = max(0, min(number - ahead, len(rest)))
                self.pages = rest[:target] + named + rest[target:]
            elif kind == "duplicatePages":
                self.pages = [
                    copy for n, p in enumerate(pages, 1) for copy in ([p, dict(p)] if n in chosen else [p])
                ]
            else:
                for page in named:
                    page["crop_width"] = max(1.0, min(operation["width"], page["media"][0]))
                    page["crop_height"] = max(1.0, min(operation["height"], page["media"][1]))


PAGE_ROWS = (
    "doc_id long, position long, ref long, rotation long, crop_width double, crop_height double, txn long, error string"
)
LOG = ("doc_id", "txn", "op_index", "kind", "pages", "number", "width", "height")


def page_edits(documents: DataFrame, log: DataFrame) -> DataFrame:
    """Pages after a log of edits, and the transactions refused (rows with ``error``).

    ``documents``: doc_id, page_count, width, height; ``log``: doc_id, txn, op_index,
    kind, pages, number (degrees, index or target), width, height.  ``ref`` is the page's
    number at the start; inserted pages count down from -1.
    """
    opened = documents.select(
        "doc_id", F.lit(-1).cast("bigint").alias("txn"), F.lit(0).alias("op_index"), F.lit("open").alias("kind"),
        F.array().cast("array<bigint>").alias("pages"), F.col("page_count").cast("bigint").alias("number"), "width", "height",
    )
    known = log.join(documents.select("doc_id"), "doc_id", "left_semi").select(*LOG)
    return ordered_fold(opened.unionByName(known), ["doc_id"], ["txn", "op_index"], PageEdits, PAGE_ROWS)


def folded_rows(base: DataFrame, changes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows after puts, patches and deletes; the last change of each field wins.

    ``changes``: keys, ord, kind (put, patch, delete) and fields; a null field of a
    patch leaves the value.  Everything folds with partial aggregates by key.
    """
    start = base.select(*keys, F.lit(-1).cast("bigint").alias("ord"), F.lit("put").alias("kind"), *fields)
    events = start.unionByName(changes.select(*keys, F.col("ord").cast("bigint").alias("ord"), "kind", *fields))
    lives = events.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == "put", F.col("ord"))).alias("put_at"),
        F.max(F.when(F.col("kind") == "delete", F.col("ord"))).alias("gone_at"),
    ).where(F.col("put_at").isNotNull() & (F.col("gone_at").isNull() | (F.col("put_at") > F.col("gone_at"))))
    current = events.join(lives.select(*keys, "put_at"), keys).where((F.col("kind") != "delete") & (F.col("ord") >= F.col("put_at")))
    latest = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f) for f in fields]
    return current.groupBy(*keys).agg(*latest)


def refused_changes(base: DataFrame, changes: DataFrame, keys: list[str], message: str) -> DataFrame:
    """Changes that name a row which is not there."""
    return changes.join(base.select(*keys), keys, "left_anti").select(*keys, F.lit(message).alias("error"))


def replaced_groups(base: DataFrame, batches: DataFrame, group: list[str]) -> DataFrame:
    """Groups named by a batch hold the batch's rows, the others keep theirs.

    ``batches``: group, ord and the rows as an array ``rows``; the last batch of a
    group counts and an empty one clears it.
    """
    last = batches.groupBy(*group).agg(F.max_by("rows", "ord").alias("rows"))
    kept = base.join(last.select(*group), group, "left_anti")
    return kept.unionByName(last.select(*group, F.inline("rows")), allowMissingColumns=True)


def with_alt_text(tags: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alternate text set where the path exists and the type is the one expected.

    ``tags``: doc_id, path, type, raw_type, alt; ``changes``: doc_id, path, expected, ord,
    alt.  Text is trimmed; blank clears.  The last change of a path counts.
    """
    from quire.functions.text import trimmed

    last = changes.groupBy("doc_id", "path").agg(F.max_by(F.struct("expected", "alt"), "ord").alias("c"))
    both = tags.join(last, ["doc_id", "path"], "full")
    fits = F.col("type").isNotNull() & ((F.col("c.expected") == F.col("type")) | (F.col("c.expected") == F.col("raw_type")))
    text = trimmed(F.coalesce("c.alt", F.lit("")))
    after = both.where("type is not null").select(
        "doc_id", "path", "type", "raw_type",
        F.when(F.col("c").isNotNull() & fits, F.when(text != "", text)).otherwise(F.col("alt")).alias("alt"),
    )
    refused = both.where(F.col("c").isNotNull() & ~fits).select(
        "doc_id", "path", F.lit("That element is not in this document any more.").alias("error")
    )
    return after, refused


def metadata_edits(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Document information as ``doc_id, name, value``: the last word counts, blank removes."""
    last = changes.groupBy("doc_id", "name").agg(F.max_by(F.coalesce("value", F.lit("")), "ord").alias("new"))
    merged = base.join(last, ["doc_id", "name"], "full").select("doc_id", "name", F.coalesce("new", "value").alias("value"))
    return merged.where("value <> ''")


def _title(entry: str | list) -> str:
    return entry if isinstance(entry, str) else entry[0]


class OutlineEdits:
    """One document's outline as nested lists, edited by path.

    Most entries have none below, so such an entry is its title alone; another is a list
    of its title and the entries below it.
    """

    def __init__(self):
        self.top: list[str | list] = []

    def _at(self, path: str | None) -> list[str | list]:
        entries = self.top
        for step in path.split(".") if path else []:
            if not step.isdigit() or int(step) >= len(entries):
                raise Refused("That bookmark is not in this document any more.")
            entry = entries[int(step)]
            if isinstance(entry, str):
                entry = entries[int(step)] = [entry, []]
            entries = entry[1]
        return entries

    def _entry(self, row: dict) -> tuple[list[str | list], int]:
        above, _, last = (row["path"] or "").rpartition(".")
        siblings = self._at(above)
        if not last.isdigit() or int(last) >= len(siblings) or _title(siblings[int(last)]) != row["expected"]:
            raise Refused("That bookmark is not in this document any more.")
        return siblings, int(last)

    def step(self, row: dict):
        try:
            self._apply(row)
        except Refused as error:
            return [(None, row["title"], row["ord"], str(error))]
        return []

    def _apply(self, row: dict) -> None:
        kind = row["kind"]
        title = row["title"] if row["title"] and row["title"].strip() else "Untitled"
        if kind in ("open", "addBookmark"):
            siblings = self._at(row["parent"])
            place = len(siblings) if row["index"] is None else max(0, min(int(row["index"]), len(siblings)))
            siblings.insert(place, title)
            return
        siblings, place = self._entry(row)
        if kind == "updateBookmark":
            if isinstance(siblings[place], str):
                siblings[place] = title
            else:
                siblings[place][0] = title
        elif kind == "deleteBookmark":
            del siblings[place]
        elif kind == "moveBookmark":
            parent = row["parent"] or ""
            if parent == row["path"] or parent.startswith(row["path"] + "."):
                raise Refused("A bookmark cannot be moved inside itself.")
            target = self._at(parent)
            to = max(0, min(int(row["index"]), len(target)))
            entry = siblings.pop(place)
            # Within one list the index was read before the entry left it.
            if target is siblings and to > place:
                to -= 1
            target.insert(to, entry)

    def finish(self):
        open_lists = [("", enumerate(self.top))]
        while open_lists:
            above, entries = open_lists[-1]
            n, entry = next(entries, (None, None))
            if n is None:
                open_lists.pop()
                continue
            path = f"{above}{n}"
            yield path, _title(entry), None, None
            if not isinstance(entry, str):
                open_lists.append((f"{path}.", enumerate(entry[1])))


OUTLINE_LOG = ("doc_id", "ord", "kind", "path", "expected", "parent", "index", "title")


def outline_edits(bookmarks: DataFrame, log: DataFrame) -> DataFrame:
    """Outlines after edits: ``doc_id, path, title`` and refused edits (``ord, error``).

    ``bookmarks``: doc_id, path, order, title; ``log``: doc_id, ord, kind, path, expected
    (title), parent, index, title.
    """
    parts = F.split("path", r"\.")
    start = bookmarks.select(
        "doc_id", F.col("order").alias("ord"), F.lit("open").alias("kind"),
        "path", F.lit(None).cast("string").alias("expected"),
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".").alias("parent"),
        F.lit(None).cast("bigint").alias("index"), "title",
    )
    later = log.select("doc_id", (F.col("ord") + F.lit(1 << 40)).alias("ord"), *OUTLINE_LOG[2:])
    return ordered_fold(
        start.withColumn("ord", F.col("ord").cast("bigint")).unionByName(later), ["doc_id"], ["ord"], OutlineEdits,
        "doc_id long, path string, title string, ord long, error string",
    )


def wording(kind: Column, pages: Column, number: Column) -> Column:
    """One line that says what an edit did."""
    listed = F.concat(F.when(F.size(F.array_distinct(pages)) == 1, F.lit("page ")).otherwise(F.lit("pages ")), ranges.written(pages))
    direction = F.when(number == 90, "right").when(number == 270, "left").otherwise("180°")
    blanks = F.when(number == 1, F.lit("Insert a blank page")).otherwise(
        F.concat(F.lit("Insert "), number.cast("string"), F.lit(" blank pages"))
    )
    plain = {
        "insertPages": "Insert pages", "insertImagePages": "Insert an image as a page", "setPageLabels": "Change page numbering",
        "addText": "Add text", "deleteImage": "Delete image", "setWatermark": "Watermark", "setBackground": "Background",
        "setHeaderFooter": "Header and footer", "removeFurniture": "Remove watermark, background, header or footer",
        "addLink": "Add link", "deleteLink": "Delete link", "addImage": "Add image",
    }
    said = F.when(kind == "rotatePages", F.concat(F.lit("Rotate "), listed, F.lit(" "), direction))
    for name, verb in (("deletePages", "Delete "), ("movePages", "Move "), ("duplicatePages", "Duplicate "), ("cropPages", "Crop ")):
        said = said.when(kind == name, F.concat(F.lit(verb), listed))
    said = said.when(kind == "insertBlankPages", blanks)
    for name, text in plain.items():
        said = said.when(kind == name, text)
    return said
