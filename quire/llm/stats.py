"""Statistics of a text as column expressions, every one over the whole text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.llm.shared import BLANK, let


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def repeated_words(words: Column, gram: int = 3) -> Column:
    """Words that lie in a window of ``gram`` words found twice or more in the text.

    Windows are sorted as numbers, their hash above and their position below, so equal
    windows are neighbours; neighbours of one hash are compared word by word.
    """
    left = lambda a, n: F.call_function("shiftleft", a, n)
    right = lambda a, n: F.call_function("shiftrightunsigned", a, n)

    def count(w: Column) -> Column:
        last = F.size(w) - gram
        bits = F.ceil(F.log2(F.size(w) + F.lit(1))).cast("int")

        def coded(bits: Column) -> Column:
            code = lambda i: left(F.xxhash64(*[F.get(w, i + k) for k in range(gram)]), bits).bitwiseOR(i.cast("long"))
            codes = F.sort_array(F.transform(F.sequence(F.lit(0), last), code))
            return let(codes, lambda codes: covered(w, codes, bits, left(F.lit(1).cast("long"), bits) - 1))

        return F.when(last < 0, F.lit(0)).otherwise(let(bits, coded))

    def covered(w: Column, codes: Column, bits: Column, mask: Column) -> Column:
        def again(a: Column, b: Column) -> Column:
            i, j = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
            same = reduce(lambda x, y: x & y, [F.get(w, i + k) == F.get(w, j + k) for k in range(gram)])
            return F.coalesce((right(a.bitwiseXOR(b), bits) == 0) & same, F.lit(False))

        hits = F.filter(codes, lambda a, j: again(a, F.get(codes, j - 1)) | again(a, F.get(codes, j + 1)))
        at = F.sort_array(F.transform(hits, lambda a: a.bitwiseAND(mask).cast("int")))
        start = F.struct(F.lit(-gram).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(
            at, start,
            lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(gram), p - acc["last"])).alias("sum")),
        )["sum"]

    return let(words, count)


def text_statistics(text: Column) -> dict[str, Column]:
    """Counts of one text; null counts as empty.  ``words`` is the array the rest is made of.

    Use ``words`` as a column of its own first (``with_statistics``), so that texts are
    split once.
    """
    words = F.col("words")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    only = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": only(r"#*$%&|<>"),
        "n_repeat_words": repeated_words(words).cast("long"),
        "line_counts": let(lines, lambda l: F.struct(
            F.size(l).cast("long").alias("n_lines"), (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines")
        )),
        "n_upper": only("A-Z"),
        "n_digits": only("0-9"),
        "n_marks": only("!?"),
        "n_stops": only(".,;:"),
    }


BASIC = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_lines", "n_dup_lines")


def with_statistics(df, wide: bool = False):
    """``df`` (with a column ``text``) with the counts in place of the text."""
    rest = [c for c in df.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    made = text_statistics(F.col("text"))
    if not wide:
        made = {k: v for k, v in made.items() if k in BASIC or k == "line_counts"}
    return (
        df.withColumn("text", text).withColumn("words", words_of(F.col("text")))
        .select(*rest, *[v.alias(k) for k, v in made.items()])
        .select(*rest, *[k for k in made if k != "line_counts"], "line_counts.n_lines", "line_counts.n_dup_lines")
    )
