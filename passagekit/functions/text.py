"""String expressions for article cleaning and question text.

Everything here returns a ``Column`` built from Spark built-ins, so it stays
inside the JVM (whole-stage codegen, or interpreted higher-order functions for
the per-line lambdas) and never round-trips through Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
# Heading names that are not appended to a section. Compared against the
# heading with every "=" and space removed, so the two names with spaces can
# never match; kept as written.
BLOCKED_HEADINGS = ["See also", "Notes", "External links", "Overview",
                    "Description", "Career", "Sources"]
# A line matching this stops the article (the current section is still kept).
REFERENCES_PATTERN = r"==\s*[rR]eferences\s*=="
MIN_LINE_LEN = 50          # shorter lines are not kept in a section
MIN_SECTION_LEN = 50       # shorter sections are dropped
HEADING_MIN_LEN = 7        # heading lines outside [7, 100) are dropped
HEADING_MAX_LEN = 100
HEADING_MAX_DOUBLE_EQ = 6  # at most six "==" => the heading opens a section
HEADING_MIN_EQ = 6         # more than six "=" => the heading is appended
DISAMBIGUATION_PHRASE = "may refer to"
FIRST_SENTENCE_CHARS = 100
LETTERS = "ABCDE"
# Query/passage prefixes by encoder family.
E5_MODELS = ["intfloat/e5-small-v2", "intfloat/e5-base-v2", "intfloat/e5-large-v2"]
BGE_MODELS = ["BAAI/bge-small-en-v1.5", "BAAI/bge-base-en-v1.5", "BAAI/bge-large-en-v1.5"]
E5_QUERY_PREFIX = "query: "
E5_PASSAGE_PREFIX = "passage: "
BGE_QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
# Order in which the question and options are joined into the query text.
QUERY_FIELDS = ["prompt", "C", "A", "B", "D", "E"]
# ---------------------------------------------------------------------------

# The characters Python's str.strip() removes: exactly those with
# str.isspace() (all lie below U+3001). Trimming a character set is a plain
# scan from both ends, cheaper than a Unicode regex.
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def py_strip(c: Column) -> Column:
    """``str.strip()`` with no argument."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def is_references_line(t: Column) -> Column:
    """The references rule; the regex only runs on lines containing the word."""
    return F.when(t.contains("eferences"), t.rlike("(?U)" + REFERENCES_PATTERN)).otherwise(F.lit(False))


def _count(t: Column, n: Column, s: str) -> Column:
    """Non-overlapping occurrences of ``s`` in ``t`` (times len(s))."""
    return n - F.length(F.replace(t, F.lit(s), F.lit("")))


def _normalized_heading(t: Column) -> Column:
    h = F.btrim(t, F.lit(" ="))
    return F.when((F.length(h) > 0) & ~h.endswith("."), F.concat(h, F.lit("."))).otherwise(h)


def _line_facts(t: Column) -> dict:
    """The rule conditions for one stripped line, as Column expressions."""
    n = F.length(t)
    is_head = t.startswith("=") & t.endswith("=")
    ok_len = (n >= HEADING_MIN_LEN) & (n < HEADING_MAX_LEN)
    dbl = _count(t, n, "==")  # 2 * count("==")
    eq = _count(t, n, "=")
    squeezed = F.replace(F.replace(t, F.lit("="), F.lit("")), F.lit(" "), F.lit(""))
    brk = is_head & ok_len & (dbl <= 2 * HEADING_MAX_DOUBLE_EQ)
    app = (is_head & ok_len & (dbl > 2 * HEADING_MAX_DOUBLE_EQ) & (eq > HEADING_MIN_EQ)
           & ~squeezed.isin(BLOCKED_HEADINGS))
    raw_ok = ((n >= MIN_LINE_LEN) & ~(is_head & ~ok_len)
              & ~(t.startswith("{") & t.endswith("}")))
    return {"is_ref": is_references_line(t), "brk": brk, "app": app, "raw_ok": raw_ok,
            "norm": _normalized_heading(t)}


def line_class(t: Column) -> Column:
    """Classify one stripped line; returns a struct.

    Fields: ``is_ref`` (stops the article), ``brk`` (heading that opens a new
    section), ``app`` (heading appended to the section), ``pieces`` (0-2
    strings appended to the current section, in order).
    """
    f = _line_facts(t)
    empty = F.array().cast("array<string>")
    pieces = F.concat(
        F.when(f["brk"] | f["app"], F.array(f["norm"])).otherwise(empty),
        F.when(f["raw_ok"], F.array(t)).otherwise(empty),
    )
    return F.struct(f["is_ref"].alias("is_ref"), f["brk"].alias("brk"), f["app"].alias("app"),
                    pieces.alias("pieces"))


def article_section_texts(text: Column) -> Column:
    """All sections of one article as ``array<string>`` (lead section first).

    One pass over the lines, no shuffle. Lines never contain ``\\n``, so each
    line is encoded as a string in which ``\\n`` is always followed by a marker:
    ``x`` (a piece follows), ``S`` (a section starts) or ``R`` (references:
    the article stops). Cutting at the first ``\\nR`` and splitting on ``\\nS``
    yields the sections; dropping the ``x`` markers restores the pieces
    joined by newlines. Cost is linear in the article length.
    """
    stripped = F.transform(F.split(text, "\n", -1), py_strip)

    def enc(t):
        # the line's contribution as a string, built without per-line arrays
        f = _line_facts(t)
        raw = F.when(f["raw_ok"], F.concat(F.lit("\nx"), t)).otherwise(F.lit(""))
        return (F.when(f["is_ref"], F.lit("\nR"))
                .when(f["brk"], F.concat(F.lit("\nS\nx"), f["norm"], raw))
                .when(f["app"], F.concat(F.lit("\nx"), f["norm"], raw))
                .otherwise(raw))

    flat = F.concat(F.lit("\nS"), F.array_join(F.transform(stripped, enc), ""))
    live = F.substring_index(flat, "\nR", 1)
    # drop the empty piece before the first marker; the split result is
    # referenced once (a second reference would re-run the per-line transform)
    secs = F.filter(F.split(live, "\nS", -1), lambda x, i: i > 0)
    return F.transform(secs, lambda s: F.substring(F.replace(s, F.lit("\nx"), F.lit("\n")), 2, 2147483647))


# ---- question side ---------------------------------------------------------

def query_text(model: str | None = None, prefix: str | None = None) -> Column:
    """Prompt and options joined by a space, option C first; nulls as ``nan``."""
    body = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in QUERY_FIELDS])
    p = prefix if prefix is not None else query_prefix_for(model)
    return F.concat(F.lit(p), body) if p else body


def query_prefix_for(model: str | None) -> str:
    if model in E5_MODELS:
        return E5_QUERY_PREFIX
    if model in BGE_MODELS:
        return BGE_QUERY_PREFIX
    return ""


def passage_prefix_for(model: str | None) -> str:
    return E5_PASSAGE_PREFIX if model in E5_MODELS else ""


def passage_text(model: str | None = None, add_tags: bool = False, add_first_sentence: bool = False,
                 text: str = "text", headers: str = "headers", first_sentence: str = "first_sentence",
                 prefix: str | None = None) -> Column:
    """Text handed to the passage encoder: prefix, then optional headers, then
    optional first sentence (each prepended in that order, so the prefix ends
    up inside)."""
    out = F.col(text)
    p = prefix if prefix is not None else passage_prefix_for(model)
    if p:
        out = F.concat(F.lit(p), out)
    if add_tags:
        out = F.concat(F.col(headers), F.lit(" "), out)
    if add_first_sentence:
        out = F.concat(F.col(first_sentence), F.lit(" "), out)
    return out


def section_headers(text: Column, sec: Column) -> Column:
    """Heading of a section: the first line of every section after the lead
    (a section always starts with its normalized heading); ``""`` for the
    lead section."""
    return F.when(sec > 0, F.substring_index(text, "\n", 1)).otherwise(F.lit(""))


def letter_to_index(c: Column) -> Column:
    return F.instr(F.lit(LETTERS), c) - 1


def index_to_letter(c: Column) -> Column:
    return F.substring(F.lit(LETTERS), c + 1, 1)
