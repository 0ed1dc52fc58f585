"""Predicates and classifications over document facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import let
from quire.functions.text import trimmed

# The shape of a language tag.
LANGUAGE_TAG = r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"

# Action types that start a program, reach outside the file or send data.
REACHING_OUT = [
    "Launch", "SubmitForm", "ImportData", "GoToR", "GoToE", "Movie", "Sound", "Rendition",
]

# File extensions a desktop system treats as executable.
RISKY_EXTENSIONS = """
    ade adp app application appref-ms asp bas bat cer chm cmd com cpl crt csh diagcab exe fxp gadget
    hlp hta htc inf ins isp its jar js jse ksh lnk mad maf mag mam maq mar mas mat mau mav maw mcf
    mda mdb mde mdt mdw mdz msc msh msh1 msh2 mshxml msi msp mst ops osd pcd pif pl plg prf prg ps1
    ps1xml ps2 ps2xml psc1 psc2 pst py pyc pyw reg scf scr sct shb shs theme tmp url vb vbe vbp vbs
    vsmacros vsw webpnp website ws wsc wsf wsh xbap xll xnk
""".split()

# Words whose value a log line must not show.
SECRET_WORDS = ["password", "passphrase", "secret", "token"]
MASK = "***"
BLANKS = " \t\n\r\f\x0b"


def language_tag(value: Column) -> Column:
    text = trimmed(value)
    return F.length(text).between(2, 35) & text.rlike(LANGUAGE_TAG)


def allowed_url(value: Column) -> Column:
    """Web and mail addresses only."""
    return F.lower(value).rlike(r"^https?://[^\s/?#]+") | F.lower(value).rlike(r"^mailto:")


def action_class(kind: Column) -> Column:
    return (
        F.when(kind == "JavaScript", F.lit("javascript"))
        .when(kind.isin(REACHING_OUT), F.lit("reachingOut"))
        .otherwise(F.lit("other"))
    )


def hidden_flag(flags: Column) -> Column:
    """Hidden or no-view annotations."""
    return flags.bitwiseAND(F.lit(34)) != 0


def last_extension(name: Column) -> Column:
    return F.when(
        F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))
    ).otherwise(F.lit(""))


def risky_attachment(name: Column) -> Column:
    return last_extension(name).isin(RISKY_EXTENSIONS)


def _names_a_secret(part: Column) -> Column:
    """Does a part that ends with a separator name a secret right before it?

    Blanks may stand before the separator, and one quote before those.
    """
    before = F.lower(F.rtrim(F.substring(part, F.lit(1), F.length(part) - 1), F.lit(BLANKS)))
    name = F.when(F.right(before, F.lit(1)).isin("'", '"'), F.substring(before, F.lit(1), F.length(before) - 1)).otherwise(before)
    ends = F.right(part, F.lit(1)).isin(":", "=")
    return ends & reduce(lambda a, b: a | b, [F.endswith(name, F.lit(w)) for w in SECRET_WORDS])


def scrubbed(message: Column) -> Column:
    """A log line with the values of secrets masked.

    The line is read in parts that end at a ``:`` or ``=``.  After a part that names a
    secret comes its value: from a quote to the next quote of its kind, where there is
    one, else all up to the next blank.  A value may hold separators and go over several
    parts; the reading goes on behind it.
    """
    quotes = ("'", '"')
    state = "struct<shown:array<string>,mode:string>"

    def later(parts: Column, quote: str) -> Column:
        """The last part that holds a quote."""
        return F.array_max(F.transform(parts, lambda p, i: F.when(F.contains(p, F.lit(quote)), i)))

    def step(so_far: Column, part: Column) -> Column:
        text = part["text"]
        body = F.ltrim(text, F.lit(BLANKS))
        opens = (so_far["mode"] == "asked") & (body != "")
        first = F.left(body, F.lit(1))
        inner = F.substring(body, F.lit(2), F.length(body))
        quoted = reduce(
            lambda a, b: a | b, [(first == q) & (F.contains(inner, F.lit(q)) | part[f"later{n}"]) for n, q in enumerate(quotes)]
        )
        lead = F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(body)), F.lit(MASK))
        begun = F.struct(
            F.when(opens & quoted, first).when(opens, " ").when(so_far["mode"] == "asked", "text").otherwise(so_far["mode"]).alias("mode"),
            F.when(opens, lead).otherwise("").alias("lead"),
            F.when(opens & quoted, inner).when(opens, body).otherwise(text).alias("rest"),
        )

        def behind(b: Column) -> Column:
            """What follows the value, null while it has no end."""
            blank = F.position(F.lit(" "), F.translate(b["rest"], BLANKS, " " * len(BLANKS)))
            quote = F.position(b["mode"], b["rest"])
            return (
                F.when(b["mode"] == "text", b["rest"])
                .when((b["mode"] == " ") & (blank > 0), F.substring(b["rest"], blank, F.length(b["rest"])))
                .when(b["mode"].isin(*quotes) & (quote > 0), F.substring(b["rest"], quote + 1, F.length(b["rest"])))
            )

        def moved(b: Column) -> Column:
            return let(
                behind(b),
                lambda rest: F.struct(
                    F.concat(so_far["shown"], F.array(b["lead"], F.coalesce(rest, F.lit("")))).alias("shown"),
                    F.when(rest.isNull(), b["mode"]).when(_names_a_secret(rest), "asked").otherwise("text").alias("mode"),
                ).cast(state),
            )

        return let(begun, moved)

    def read(parts: Column) -> Column:
        marked = F.transform(
            parts,
            lambda p, i: F.struct(
                p.alias("text"), *[F.coalesce(later(parts, q) > i, F.lit(False)).alias(f"later{n}") for n, q in enumerate(quotes)]
            ),
        )
        start = F.struct(F.array().cast("array<string>").alias("shown"), F.lit("text").alias("mode")).cast(state)
        return F.aggregate(marked, start, step, lambda s: F.array_join(s["shown"], ""))

    named = reduce(lambda a, b: a | b, [F.contains(F.lower(message), F.lit(w)) for w in SECRET_WORDS])
    return F.when(named, let(F.split(message, "(?<=[:=])"), read)).otherwise(message)


def permissions(bits: Column, revision: Column) -> list[Column]:
    """Print, modify and the rest from permission bits (bit 1 is the lowest).

    Before revision 3 the finer bits do not exist and the coarse ones speak for
    them.
    """

    def bit(n: int) -> Column:
        return bits.bitwiseAND(F.lit(1 << (n - 1)).cast("int")) != 0

    coarse = revision < 3
    fill = F.when(coarse, bit(6)).otherwise(bit(9))
    assemble = F.when(coarse, bit(4)).otherwise(bit(11))
    return [
        F.when(~bit(3), "none").when(coarse | bit(12), "full").otherwise("low").alias("print"),
        F.when(bit(4), "all")
        .when(bit(6), "annotate")
        .when(fill, "form")
        .when(assemble, "assembly")
        .otherwise("none")
        .alias("modify"),
        bit(5).alias("extract"),
        F.when(coarse, bit(5)).otherwise(bit(10)).alias("extract_for_accessibility"),
        fill.alias("fill_forms"),
        bit(6).alias("annotate"),
        assemble.alias("assemble"),
    ]


def algorithm(handler: Column, method: Column, version: Column, key_bits: Column) -> Column:
    """What an encryption dictionary says it used."""
    return (
        F.when(handler.isNotNull() & (handler != "Standard"), F.concat(handler, F.lit(" security handler")))
        .when(method == "AESV3", "AES-256")
        .when(method == "AESV2", "AES-128")
        .when(method == "None", "None")
        .when(version == 5, "AES-256")
        .when(key_bits.isNull(), "RC4")
        .otherwise(F.concat(F.lit("RC4 "), key_bits.cast("string"), F.lit("-bit")))
    )


def inside_root(path: Column, root: Column) -> Column:
    """True when ``path``, with its ``.`` and ``..`` steps taken, is ``root`` or below it."""

    def normal(value: Column) -> Column:
        return F.aggregate(
            F.filter(F.split(F.replace(value, F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != ".")),
            F.array().cast("array<string>"),
            lambda stack, step: F.when(
                step == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
            ).otherwise(F.array_append(stack, step)),
        )

    inner, outer = normal(path), normal(root)
    return F.slice(inner, 1, F.size(outer)) == outer


def link_target(action: Column, url: Column, destination: Column, page: Column) -> Column:
    """Where a link goes: its action decides when it has one, else its destination."""
    resolved = F.when(page.isNotNull(), "page").when(destination.isNotNull(), "named")
    return (
        F.when(action == "URI", F.when(F.coalesce(url, F.lit("")) == "", "empty").otherwise("url"))
        .when(action == "GoTo", F.when(page.isNotNull(), "page").otherwise("named"))
        .when(action == "Launch", "launch")
        .when(action == "JavaScript", "script")
        .when(action.isNotNull(), "other")
        .otherwise(resolved.otherwise("nowhere"))
    )


def goes_nowhere(action: Column, url: Column, destination: Column) -> Column:
    """Neither a destination nor an action that leads anywhere."""
    return (
        F.when(action == "URI", trimmed(F.coalesce(url, F.lit(""))) == "")
        .when(action.isNotNull(), F.lit(False))
        .otherwise(F.coalesce(destination, F.lit("")) == "")
    )


def outline_action(page: Column, action: Column, destination: Column) -> Column:
    return (
        F.when(page.isNotNull(), "page")
        .when(action == "URI", "url")
        .when(action.isNotNull() | destination.isNotNull(), "other")
        .otherwise("none")
    )


def pages_wording(pages: Column) -> Column:
    """``Page 3``, ``Pages 2, 4`` or, above eight, ``12 pages``."""
    listed = F.transform(pages, lambda p: p.cast("string"))
    return (
        F.when(F.size(pages) == 1, F.concat(F.lit("Page "), F.array_join(listed, ", ")))
        .when(F.size(pages) > 8, F.concat(F.size(pages).cast("string"), F.lit(" pages")))
        .otherwise(F.concat(F.lit("Pages "), F.array_join(listed, ", ")))
    )


def document_id(path: Column) -> Column:
    """Stable id of a path: 32 hex characters of its case-folded SHA-256."""
    return F.substring(F.sha2(F.lower(path), 256), 1, 32)
