"""String rules: white space, folding, literal search, excerpts, drawable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of the data model: ASCII white space, no-break space and the
# Unicode separators.
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SOLID = r"[^\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WORD_CHARACTER = r"[\p{L}\p{N}_]"
ELLIPSIS = "…"


def quoted(needle: str) -> str:
    """``needle`` as a regular expression that matches exactly itself."""
    return "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def quoted_column(needle: Column) -> Column:
    return F.concat(
        F.lit("\\Q"),
        F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
        F.lit("\\E"),
    )


# The same characters as a set, for trimming.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    chr(code) for code in range(0x2000, 0x200B)
)


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def trimmed_end(value: Column) -> Column:
    return F.rtrim(value, F.lit(BLANKS))


def collapsed(value: Column) -> Column:
    """White space runs become one space; outer white space goes."""
    return trimmed(F.regexp_replace(value, f"{BLANK}+", " "))


def is_blank(value: Column) -> Column:
    return trimmed(value) == ""


def char_at(value: Column, index: Column) -> Column:
    """The character at a 0-based index; empty when there is none."""
    return F.when(index < 0, F.lit("")).otherwise(F.substring(value, index + 1, F.lit(1)))


def at_word_edge(value: Column, index: Column) -> Column:
    return ~char_at(value, index).rlike(WORD_CHARACTER)


def match_starts(
    value: Column,
    needle: str | Column,
    case_sensitive: bool = False,
    whole_word: bool = False,
) -> Column:
    """0-based starts of every (also overlapping) literal occurrence.

    A look-ahead split cuts the text before each occurrence, so each piece but
    the first begins a match and its offset is the running length of the pieces
    before it.  Whole word looks at the unfolded neighbours.
    """
    hay = value if case_sensitive else F.lower(value)
    if isinstance(needle, str):
        folded = F.lit(needle if case_sensitive else needle.lower())
        pattern = F.lit(f"(?={quoted(needle if case_sensitive else needle.lower())})")
        size = F.lit(len(needle))
    else:
        folded = needle if case_sensitive else F.lower(needle)
        pattern = F.concat(F.lit("(?="), quoted_column(folded), F.lit(")"))
        size = F.length(needle)
    lengths = F.transform(F.split(hay, pattern, -1), F.length)
    starts = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda state, n: F.struct(
            (state["at"] + n).alias("at"),
            F.array_append(state["out"], state["at"]).alias("out"),
        ),
        lambda state: state["out"],
    )
    found = F.when(F.startswith(hay, folded), starts).otherwise(
        F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))
    )
    if whole_word:
        found = F.filter(
            found,
            lambda at: at_word_edge(value, at - 1) & at_word_edge(value, at + size),
        )
    none = F.array().cast("array<int>")
    usable = F.contains(hay, folded) & (folded != "")
    return F.when(usable, found).otherwise(none)


def excerpt(value: Column, start: Column, end: Column, radius: int = 34) -> Column:
    """Text around a match: ``radius`` characters each side, ellipses only where cut."""
    first = F.greatest(F.lit(0), start - radius)
    last = F.least(F.length(value), end + radius)
    return F.concat(
        F.when(first > 0, F.lit(ELLIPSIS)).otherwise(F.lit("")),
        collapsed(F.substring(value, first + 1, last - first)),
        F.when(last < F.length(value), F.lit(ELLIPSIS)).otherwise(F.lit("")),
    )


def drawable(value: Column) -> Column:
    """Text a Latin-1 font can draw; tabs are four spaces, the rest ``?``.

    Line breaks are kept.
    """
    mapped = F.replace(value, F.lit("\t"), F.lit("    "))
    mapped = F.translate(mapped, "‘’“”–—", "''\"\"--")
    mapped = F.replace(mapped, F.lit(ELLIPSIS), F.lit("..."))
    mapped = F.regexp_replace(mapped, r"[^\n\r -~\u00a0-ÿ]", "?")
    # Most text needs nothing mapped; one anchored look decides (a positive class
    # is several times faster than searching for its complement).
    return F.when(value.rlike(r"\A[\n\r -~\u00a0-ÿ]*\z"), value).otherwise(mapped)


def drawable_line(value: Column) -> Column:
    return trimmed(F.regexp_replace(drawable(value), r"[\r\n]+", " "))


def undrawable_characters(value: Column) -> Column:
    """Distinct characters outside code page 1252, in the order first met."""
    # The printable characters of code page 1252 outside Latin-1.
    extra = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ"
    extra += "‘’“”•–—˜™š›œžŸ"
    return F.array_distinct(
        F.regexp_extract_all(
            value, F.lit(rf"[^\t -~\u00a0-ÿ{extra}]"), F.lit(0)
        )
    )


def shortened(value: Column, limit: int) -> Column:
    return F.when(
        F.length(value) > limit,
        F.concat(F.substring(value, 1, limit - 1), F.lit(ELLIPSIS)),
    ).otherwise(value)


def quoted_summary(value: Column, limit: int = 70) -> Column:
    return F.concat(F.lit("“"), shortened(value, limit), F.lit("”"))


def html_escaped(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def safe_name(value: Column, fallback: str = "page", limit: int = 120) -> Column:
    """A file name any desktop system takes."""
    leaf = F.element_at(F.split(value, r"[\\/]"), -1)
    clean = F.regexp_replace(leaf, r'[<>:"|?*\u0000-\u001f]', "")
    clean = trimmed(F.regexp_replace(clean, r"\.+$", ""))
    return F.when(clean == "", F.lit(fallback)).otherwise(F.substring(clean, 1, limit))


def filled_template(template: Column | str, tokens: dict[str, Column]) -> Column:
    """Named tokens replaced one after another."""
    value = F.lit(template) if isinstance(template, str) else template
    for token, content in tokens.items():
        value = F.replace(value, F.lit(token), content)
    return value


def unevenly_spaced(value: Column) -> Column:
    """Whether words are parted by anything but single spaces."""
    return value.rlike(r"[\t-\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]|  |^ | $") | (value == "")


def blank_led_words(value: Column) -> Column:
    """The words of a text, each with the blanks before it."""
    return F.regexp_extract_all(value, F.lit(f"{BLANK}*{SOLID}+"), F.lit(0))


def tokens_with_offsets(value: Column) -> Column:
    """``array<struct<text,start>>`` of the runs of non-blank characters.

    Text with single spaces only, which is nearly all of it, is cut at the spaces;
    other blanks take the general expression.
    """

    def running(lengths: Column, gap: int) -> Column:
        return F.aggregate(
            lengths,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda state, n: F.struct(
                (state["at"] + n + gap).alias("at"), F.array_append(state["out"], state["at"]).alias("out")
            ),
            lambda state: state["out"],
        )

    def plain(words: Column) -> Column:
        return F.zip_with(
            words, running(F.transform(words, F.length), 1), lambda w, at: F.struct(w.alias("text"), at.alias("start"))
        )

    def ragged(pieces: Column) -> Column:
        return F.zip_with(
            pieces,
            running(F.transform(pieces, F.length), 0),
            lambda p, at: F.struct(
                F.ltrim(p, F.lit(BLANKS)).alias("text"),
                (at + F.length(p) - F.length(F.ltrim(p, F.lit(BLANKS)))).alias("start"),
            ),
        )

    odd, pieces = unevenly_spaced(value), blank_led_words(value)
    bound = lambda array, body: F.flatten(F.transform(F.array(array), body))
    return F.when(odd, bound(pieces, ragged)).otherwise(bound(F.split(value, " "), plain))
