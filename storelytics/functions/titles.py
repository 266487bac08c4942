"""Title clean-up. Blanks and word characters are spelled out, since dialects disagree on the classes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from storelytics.functions.urls import once

BLANK = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
NON_WORD = "[^A-Za-z0-9_]"


def trim_sql(text: str) -> str:
    return f"regexp_replace({text}, r'^{BLANK}+|{BLANK}+$', '')"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def clean_title(text: Column) -> Column:
    """One blank between words, no symbols at the ends, nothing after ``| `` or ``- ``."""
    tidy = F.regexp_replace(trim(text), f"{BLANK}+", " ")
    bare = F.regexp_replace(tidy, f"^{NON_WORD}+|{NON_WORD}+$", "")
    return trim(F.regexp_replace(F.regexp_replace(bare, r"\| .*$", ""), r"- .*$", ""))


def title_part(text: Column) -> Column:
    """The first part of a page title longer than three characters, else the whole title."""

    def part(whole):
        parts = F.filter(F.transform(F.split(whole, "[|\\-–—]"), trim), lambda p: F.length(p) > 3)
        return F.coalesce(F.get(parts, F.lit(0)), whole)

    return once(text, part)
