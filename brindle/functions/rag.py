"""Context and citations of grounded answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import let, strip

# Patterns of titles that an answer mentions, and the limits of a source's text.
BOLD = r"\*\*(.+?)\*\*"
ITALIC = r"(?<!\w)_([^_]+?)_(?!\w)"
QUOTED = r'"([^"]+)"'
SOURCE_DESCRIPTION = 500
SOURCE_SUBJECTS = 8


def context_entry(rank: Column, title: Column, authors: Column, year: Column, description: Column, subjects: Column) -> Column:
    tags = F.coalesce(F.nullif(F.array_join(F.slice(subjects, 1, SOURCE_SUBJECTS), ", "), F.lit("")), F.lit("None listed"))
    return F.format_string('[%d] "%s" by %s (%s)\n%s\nSubjects: %s\n', rank, F.coalesce(title, F.lit("Unknown")), F.coalesce(authors, F.lit("Unknown")), F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("n.d.")), F.substring(F.coalesce(description, F.lit("No description available.")), 1, SOURCE_DESCRIPTION), tags)


def cited_titles(answer: Column, italic: bool = True) -> Column:
    found = [F.regexp_extract_all(answer, F.lit(p), F.lit(1)) for p in ([BOLD, ITALIC, QUOTED] if italic else [BOLD, QUOTED])]
    return F.concat(*found)


def clean_citation(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(F.lower(title)), r"^\[\d+\]\s*", ""), r"^[_* ]+|[_* ]+$", "")


def unsupported_titles(answer: Column, source_titles: Column, italic: bool = True) -> Column:
    """Titles in an answer that are no part of a source's title, nor contain one."""
    known = F.transform(source_titles, F.lower)

    def wrong(title: Column) -> Column:
        return let(clean_citation(title), lambda t: (F.length(t) >= 3) & ~F.exists(known, lambda s: F.contains(s, t) | F.contains(t, s)))

    return F.filter(cited_titles(answer, italic), wrong)
