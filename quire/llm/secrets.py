"""Secret scanning with corpus-wide ownership frequency, in built-in functions.

Candidates are found in every text, their hashes are counted by distinct
repositories and owners, and the counts tell widely copied examples from
credentials that one owner holds and that look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import let, pick, stored

# The base kinds, in their order, and the kind the counts add.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = (
    "((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|"
    "(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A run shorter than asked can hold no longer match inside, so the lengths stand in the patterns.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
# Long runs of the characters that keys are written in.
RUN = "[A-Za-z0-9+/_=-]{20,}"
LEAST_VALUE = 6
HOT = 1000


def _spans(text: Column, pattern: str, kind: int, group: int, least: int = 0) -> Column:
    """Spans (start, kind, end, value) of the leftmost matches, counted in code points.

    The pieces between matches and the matches themselves, laid end to end, are the
    text, so running lengths are the positions.
    """
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    begin = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def walk(parts: Column) -> Column:
        pieces, hits, values = parts["pieces"], parts["hits"], parts["values"]

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(pieces, i))
            end = start + F.length(F.get(hits, i))
            span = F.struct(
                start.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"),
                F.get(values, i).alias("value"),
            )
            return F.struct(end.cast("long").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        found = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), begin, step)["spans"]
        return F.when(F.size(hits) > 0, found).otherwise(none)

    parts = F.struct(
        F.split(text, pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )
    # Most texts hold no match: one scan decides that.
    spans = F.when(text.rlike(pattern), let(parts, walk)).otherwise(none)
    return F.filter(spans, lambda s: F.length(s["value"]) >= least) if least else spans


def _entropy(value: Column) -> Column:
    """Bits per character."""

    def of(letters: Column) -> Column:
        return F.aggregate(
            F.array_distinct(letters), F.lit(0.0),
            lambda acc, c: acc - let(
                F.size(F.filter(letters, lambda x: x == c)) / F.size(letters), lambda share: share * F.log2(share)
            ),
        )

    return let(F.split(value, ""), of)


def _looks_live(value: Column) -> Column:
    """Mixed classes and an even spread of characters, and no filler word."""
    classes = sum((value.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    filler = F.lower(value).rlike("example|sample|dummy|changeme|your_|xxxx|placeholder|12345678")
    return (classes >= 2) & ~filler & (_entropy(value) >= 3.0)


def _candidates(text: Column) -> Column:
    base = F.concat(
        _spans(text, ASSIGN, 0, 2, LEAST_VALUE), _spans(text, ACCESS, 1, 0), _spans(text, HEX, 2, 0)
    )

    def more(known: Column) -> Column:
        runs = F.filter(
            _spans(text, RUN, 3, 0),
            lambda r: r["value"].rlike("[a-z]") & r["value"].rlike("[A-Z]") & r["value"].rlike("[0-9]")
            & ~F.exists(known, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
            & (_entropy(r["value"]) >= 3.5),
        )
        return F.sort_array(F.concat(known, runs))

    return let(base, more)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def scan(docs: DataFrame, repository: tuple[str, ...] = ("source", "lang"), owner: tuple[str, ...] = ("source",)) -> DataFrame:
    """Each row's candidates, stored: ``row``, ``doc_id``, owner and repository hashes, ``marks``."""
    cols = tuple(dict.fromkeys(("doc_id", "text", *owner, *repository)))
    key = lambda names: F.sha2(F.to_json(F.struct(*[F.col(n).cast("string").alias(n) for n in dict.fromkeys(names)])), 256)
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = F.transform(
        _candidates(text),
        lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
            F.unhex(F.sha2(s["value"].cast("binary"), 256)).alias("hash"), _looks_live(s["value"]).alias("live"),
        ),
    )
    return stored(
        pick(docs, *cols).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", key(owner).alias("owner"),
            key((*owner, *repository)).alias("repository"), marks.alias("marks"),
        ),
        "secret-candidates",
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash: places, distinct repositories and distinct owners."""
    return (
        found.select("owner", "repository", F.explode("marks.hash").alias("hash"))
        .groupBy("hash", "owner", "repository").agg(F.count("*").alias("places"))
        .groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("places").alias("places"))
        .groupBy("hash").agg(
            F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.sum("places").alias("places")
        )
    )


def secrets_by_ownership(
    docs: DataFrame, repository: tuple[str, ...] = ("source", "lang"), owner: tuple[str, ...] = ("source",),
    copied_owners: int = 3,
) -> DataFrame:
    """One row per document: its spans, each with its counts and verdict.

    ``verdict`` of a span is ``example`` when ``copied_owners`` owners or more hold its
    value, ``owned`` when one owner holds it and it looks live, else ``unclear``.  Base
    kinds stay whatever the verdict; a run of key characters becomes a span of kind
    ``owned`` only with that verdict.

    A null text is empty; empty texts have no spans; rows that repeat are scanned
    each; null owners and repositories are values of their own; a table without rows
    gives none; other columns are not looked at.
    """
    found = scan(docs, repository, owner)
    # Values of one place need no row: their counts are 1.
    counted = stored(ownership(found).where("places > 1"), "secret-owners")
    # At most HOT values hold more than one HOT-th of all places each; those go to the
    # places, and no other value is more than that share of the join.
    most = (counted.agg(F.sum("places")).first()[0] or 0) // HOT
    hot, rest = counted.where(F.col("places") > most), counted.where(F.col("places") <= most)
    placed = found.select("row", F.inline("marks")).join(F.broadcast(hot), "hash", "left")
    met, open_ = placed.where("places is not null"), placed.where("places is null").drop("owners", "repositories", "places")
    judged = (
        met.unionByName(open_.join(rest, "hash", "left"))
        .withColumns({
            "owners": F.coalesce("owners", F.lit(1)), "repositories": F.coalesce("repositories", F.lit(1)),
            "places": F.coalesce("places", F.lit(1)),
        })
        .withColumn(
            "verdict",
            F.when(F.col("owners") >= copied_owners, "example").when((F.col("owners") == 1) & F.col("live"), "owned").otherwise("unclear"),
        )
        .where("kind < 3 or verdict = 'owned'")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "verdict", "owners", "repositories", "places"))).alias("spans"))
    )
    return found.select("row", "doc_id").join(judged, "row", "left").select(
        "doc_id",
        F.coalesce(
            "spans",
            F.array().cast("array<struct<start:bigint,kind:int,end:bigint,verdict:string,owners:bigint,repositories:bigint,places:bigint>>"),
        ).alias("spans"),
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of ``secrets_by_ownership``."""
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    said = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        said("owned").alias("n_owned"), said("example").alias("n_examples"),
    )
