"""Text expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity types, and the punctuation that answers are compared without.
ENTITY_TYPES = ("PERSON", "ORG", "LOC", "EVENT", "OTHER")
PUNCTUATION = r"[!-/:-@\[-`{-~]"
NOT_PLAIN = r"[^0-9a-z\x{4e00}-\x{9fff}]+"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def text(x: Column) -> Column:
    """Stripped; null is the empty string."""
    return strip(F.coalesce(x.cast("string"), F.lit("")))


def squeeze(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def is_var(x: Column) -> Column:
    return F.coalesce(F.startswith(x, F.lit("?")), F.lit(False))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def name_key(x: Column) -> Column:
    """Lower case, with runs of non-word characters as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\W+", " "))


def entity_type(x: Column) -> Column:
    up = F.upper(text(x))
    has = lambda *parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(up, p))
    return (
        F.when(up.isin(*ENTITY_TYPES), up)
        .when(has("PER"), "PERSON")
        .when(has("GPE"), "LOC")
        .when(has("ORG", "COMP"), "ORG")
        .when(has("LOC", "PLACE", "CITY", "COUNTRY"), "LOC")
        .when(has("EVENT"), "EVENT")
        .otherwise("OTHER")
    )


def plain(x: Column) -> Column:
    """Lower case; all but digits, a-z and CJK ideographs as single spaces."""
    return F.trim(F.regexp_replace(lowered(x), NOT_PLAIN, " "))


def lowered(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def plain_in(name: Column, low: Column) -> Column:
    """Is ``name``, a plain form, not empty and in the plain form of a text whose lower case is ``low``?

    The plain form of the text isn't made, which costs far more than a search: a run of plain characters is in it
    if it is in the lower case, and runs with single spaces between are if runs of other characters part them there.
    """
    ends = F.contains(low, F.substring_index(name, " ", 1)) & F.contains(low, F.substring_index(name, " ", -1))
    several = F.contains(name, F.lit(" "))
    return (name != "") & ends & (~several | F.rlike(low, F.replace(name, F.lit(" "), F.lit(NOT_PLAIN + "+"))))


def mentions(body: Column, head: Column, tail: Column, relation: Column | None = None) -> Column:
    """Do the plain forms of head and tail (and relation, if given) occur in that of ``body``?"""
    inside = lambda x: plain_in(plain(x), lowered(body))
    found = inside(head) & inside(tail)
    return found if relation is None else found & inside(relation)


def answer_key(x: Column) -> Column:
    """Lower case without punctuation and articles, white space squeezed."""
    bare = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def tokens(x: Column) -> Column:
    """Distinct lower-case white-space tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+"), lambda t: t != ""))


def answer_tokens(x: Column) -> Column:
    return F.filter(F.split(answer_key(x), " "), lambda t: t != "")


def share_token(a: Column, b: Column) -> Column:
    return F.arrays_overlap(tokens(a), tokens(b))


def clean_list(xs: Column) -> Column:
    """Stripped, without nulls and empties."""
    return F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), text), lambda x: x != "")


def distinct_exact(xs: Column) -> Column:
    """Cleaned, each text once, in first-seen order."""
    return F.array_distinct(clean_list(xs))


def distinct_ignoring_case(xs: Column) -> Column:
    """Cleaned, each text once whatever its case, in first-seen order and spelling."""
    keep = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(clean_list(xs), F.array().cast("array<string>"), keep)


def join_texts(*parts: Column, sep: str = " ") -> Column:
    """The stripped parts that aren't empty."""
    return F.concat_ws(sep, *[F.nullif(text(p), F.lit("")) for p in parts])
