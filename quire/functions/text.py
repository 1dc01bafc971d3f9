"""Texts of pages: joining, escaping, normalising and searching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, running_sum
from .numbers import BLANK, trim_all

# Typographic characters and their plain forms.
TYPOGRAPHY = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"',
    "–": "-", "—": "--", "―": "--",
    "…": "...",
    "\u00a0": " ", "\u2009": " ", "\u202f": " ", "\u2007": " ",
    "•": "* ", "·": "* ",
    "™": "(TM)", "®": "(R)", "©": "(C)",
    "′": "'", "″": '"',
    "\ufeff": "",
}

# Patterns of personal data; digits must not touch further digits.
PII_PATTERNS = {
    "email": r"[^\s@]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}",
    "phone": r"(?<!\d)(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}(?!\d)",
    "creditCard": r"(?<!\d)\d(?:[\s-]?\d){12,15}(?!\d)",
    "ssn": r"(?<!\d)\d{3}[\s-]?\d{2}[\s-]?\d{4}(?!\d)",
}


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def collapse_space(text: Column) -> Column:
    return trim_all(F.regexp_replace(text, f"{BLANK}+", " "))


def normalize_typography(text: Column) -> Column:
    """Plain forms of typographic characters; what is left beyond Latin-1 becomes a space."""
    single = {k: v for k, v in TYPOGRAPHY.items() if len(v) == 1}
    gone = "".join(k for k, v in TYPOGRAPHY.items() if not v)
    text = F.translate(text, "".join(single) + gone, "".join(single.values()))
    for char, plain in TYPOGRAPHY.items():
        if len(plain) > 1:
            text = F.replace(text, F.lit(char), F.lit(plain))
    return F.regexp_replace(text, r"[^\x09\x0A\x20-\x{FF}]", " ")


def page_text(runs: Column) -> Column:
    """The runs of a page on one line: joined by spaces, blanks collapsed, trimmed."""
    return trim_all(F.regexp_replace(F.array_join(runs, " "), r"[ \t]+", " "))


def document_text(pages: Column, separator: str = "\n\n") -> Column:
    """The non-empty pages with a separator between and a line end after, or nothing."""
    kept = F.filter(pages, lambda p: p != "")
    return F.when(F.size(kept) == 0, "").otherwise(F.concat(F.array_join(kept, separator), F.lit("\n")))


def compared_page(runs: Column) -> Column:
    """Runs of a page, array<struct<str, ends_line>>, as one text: a line end after those that end a line, else a space."""
    kept = F.filter(runs, lambda r: r["str"].isNotNull())
    after = lambda r: F.when(F.coalesce(r["ends_line"], F.lit(False)), F.lit("\n")).otherwise(F.lit(" "))
    return F.array_join(F.transform(kept, lambda r: F.concat(r["str"], after(r))), "")


def compared_document(pages: Column) -> Column:
    """Pages with an empty line between, without blanks at line ends, trimmed: what a comparison by lines takes."""
    return trim_all(F.regexp_replace(F.array_join(pages, "\n\n"), r"[ \t]+\n", "\n"))


def has_email(text: Column) -> Column:
    """Whether text holds an address. A cheap test goes first: the pattern backtracks on texts without "@"."""
    return text.contains("@") & text.rlike(PII_PATTERNS["email"])


#: A line without any of these holds no match of a preset: each needs an "@" or digits.
MAY_MATCH = "[@0-9]"


def pii_flags(text: Column) -> dict[str, Column]:
    return {
        "email": has_email(text),
        **{k: text.rlike(p) for k, p in PII_PATTERNS.items() if k != "email"},
    }


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of all matches, in code points: lengths of the pieces between them add up."""

    def spans(v: Column) -> Column:
        lengths = F.transform(v["found"], F.length)
        ends = running_sum(F.zip_with(F.slice(v["pieces"], F.lit(1), F.size(v["found"])), lengths, lambda p, n: F.length(p) + n))
        return F.zip_with(ends, lengths, lambda end, n: F.struct((end - n).cast("int").alias("start"), end.cast("int").alias("end")))

    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    whole = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("pieces"))
    return F.when(text.rlike(pattern), let(whole, spans)).otherwise(none)


def literal_pattern(term: str) -> str:
    """A case-insensitive pattern that takes a trimmed search term as it is."""
    return "(?i)" + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", term.strip())


def count_literal(text: Column, term: str) -> Column:
    return F.regexp_count(text, F.lit(literal_pattern(term)))


def substitute_tokens(template: Column, absolute: Column, absolute_total: Column, relative: Column, relative_total: Column) -> Column:
    for token, value in (("{rf}", relative_total), ("{r}", relative), ("{n}", absolute), ("{p}", absolute_total)):
        template = F.replace(template, F.lit(token), value.cast("string"))
    return template


def decode_data_url(url: Column) -> Column:
    """The bytes after the comma of a base64 data URL; null if they are none."""
    return F.try_to_binary(F.regexp_extract(url, r"^data:[^,]*,(.*)$", 1), F.lit("base64"))
