"""Text cleaning, tokenizers and the text projections of a book, as Column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Double-encoded sequences and what they stand for, in order of application.
MOJIBAKE = [
    ("â\u0080\u0099", "’"),
    ("â\u0080\u0098", "‘"),
    ("â\u0080\u009c", "“"),
    ("â\u0080\u009d", "”"),
    ("â\u0080\u0093", "–"),
    ("â\u0080\u0094", "—"),
    ("â\u0080¦", "…"),
    ("Â ", " "),
    ("Â·", "·"),
    ("Ã©", "é"),
    ("Ã¡", "á"),
    ("Ã±", "ñ"),
]

# Limits of the book record and of the texts built from it.
MIN_DESCRIPTION = 30
HEADER_REST = 50
MAX_AUTHORS = 8
MAX_SUBJECTS = 12
EMBED_DESCRIPTION = 2000
EMBED_SUBJECTS = 10
PASSAGE_DESCRIPTION = 1500
PASSAGE_SUBJECTS = 5
POOL_SUBJECTS = 8
POOL_DESCRIPTION = 500

# Fixed value: descriptions that say nothing.
BOILERPLATE = (
    r"(?i)^\s*(no description(?: available| provided)?|description not available|"
    r"no synopsis(?: available)?|currently unavailable|n/?a|none|tba|tbd)\s*[.!]*\s*$"
)

# Fixed value: what counts as white space at the ends of a text, Unicode's included.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: an expression that stands in several places of another
    one is repeated there, and chains of such steps grow without bound."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Trim all white space, Unicode's too, from both ends; what lies between isn't looked at."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def draw(*keys: Column | str) -> Column:
    """A stable draw from keys (names of columns, or Columns): the MD5 of their texts, as other engines have it
    too. Its order is a shuffle, and `draw_number` of it a die."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def draw_number(sides: Column, *keys: Column | str) -> Column:
    """0 to sides - 1 from the first eight digits of the keys' draw."""
    return F.pmod(F.conv(F.substring(draw(*keys), 1, 8), 16, 10).cast("long"), sides).cast("int")


def fix_mojibake(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), MOJIBAKE, c)


def _repaired(text: str) -> str:
    """UTF-8 that was read as Windows-1252, once or twice, read right; text that wasn't stays as it is."""
    for _ in range(2):
        try:
            better = text.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return text
        if better == text:
            return text
        text = better
    return text


@F.pandas_udf(T.StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _repaired(t))


# Fixed value: characters that UTF-8 read as Windows-1252 begins with.
DAMAGE = "[ÂÃâð]"


def repair_text(c: Column) -> Column:
    """Encoding damage undone, null as empty. Only texts that may be damaged leave the JVM."""
    text = F.coalesce(c, F.lit(""))
    return F.coalesce(_repair(F.when(text.rlike(DAMAGE), text)), text)


def strip_review_header(c: Column) -> Column:
    """Drop all up to the first review count, if more than 50 characters follow it."""
    def cut(x: Column) -> Column:
        rest = strip(F.regexp_replace(x, r"(?s)^.*?\d+\s+[Rr]eviews?\s*", ""))
        return F.when(x.rlike(r"\d+\s+[Rr]eviews?") & (F.length(rest) > HEADER_REST), rest).otherwise(x)

    return let(c, cut)


def normalize_whitespace(c: Column) -> Column:
    c = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    for pattern, to in ((r"\n{3,}", "\n\n"), (r"[ \t]+", " "), (r"[ \t]+\n", "\n")):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def clean_description(c: Column) -> Column:
    """Encoding, then header, then white space. Null and empty stay as they are."""
    return normalize_whitespace(strip_review_header(fix_mojibake(c)))


def split_list(c: Column, limit: int) -> Column:
    """A comma list: trimmed, truncated pieces dropped, the first of equal ones kept, at most `limit`."""
    pieces = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    kept = F.filter(pieces, lambda x: (x != "") & ~F.contains(x, F.lit("...")) & ~F.endswith(x, F.lit("…")))
    return F.slice(F.array_distinct(kept), 1, limit)


def usable(title: Column, author: Column, desc: Column) -> Column:
    t, a, d = (strip(F.coalesce(c, F.lit(""))) for c in (title, author, desc))
    return (t != "") & (a != "") & (d != "") & (F.length(d) >= MIN_DESCRIPTION) & ~d.rlike(BOILERPLATE)


def english_by_stopwords(c: Column) -> Column:
    """An offline stand-in for a language detector: more English than other function words among the
    words of the first 600 characters."""
    words = F.split(F.lower(F.substring(c, 1, 600)), r"[^\p{L}]+")

    def hits(*names: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*names)))

    return hits("the", "and", "of", "to", "in", "is", "that", "was", "for", "with") > F.greatest(
        hits("der", "die", "und", "das", "ist", "nicht", "ein", "von", "mit", "zu"), hits("le", "la", "les", "et", "des", "est", "une", "que", "dans", "pour"), hits("el", "los", "las", "que", "y", "en", "una", "del", "por", "con"))


# ---- tokenizers; each has its own rules and they are not to be unified

def sparse_tokens(c: Column) -> Column:
    """Words of two characters or more, letters and digits of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


# Function words that document frequencies of titles leave out.
TITLE_STOPWORDS = [
    "a", "an", "the", "of", "and", "or", "in", "on", "at", "to", "for", "is", "it", "by", "with", "from", "as", "be", "was", "are", "were", "been", "has",
    "had", "have", "do", "does", "did", "not", "no", "but", "if", "than", "that", "this", "its", "my", "his", "her", "our", "their", "he", "she", "we",
    "they", "me", "him", "us", "them", "who", "what", "so", "up", "out", "all", "about", "into", "over", "after", "before",
]


def title_tokens(c: Column) -> Column:
    """Punctuation dropped, then words of more than a character that aren't function words."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*TITLE_STOPWORDS))


def alphabetic_words(c: Column, strip_chars: str = "") -> Column:
    """Lower-case words of three letters or more, for a spelling dictionary."""
    words = F.split(F.lower(c), r"\s+")
    if strip_chars:
        words = F.transform(words, lambda w: F.regexp_replace(w, f"^[{strip_chars}]+|[{strip_chars}]+$", ""))
    return F.filter(words, lambda w: w.rlike(r"^\p{L}{3,}$"))


# ---- projections of a book

def work_id(isbn: Column, row_idx: Column) -> Column:
    return F.coalesce(F.concat(F.lit("gr:"), F.nullif(strip(isbn), F.lit(""))), F.concat(F.lit("gr:idx"), row_idx.cast("string")))


def plain_id(c: Column) -> Column:
    return F.replace(c, F.lit("/works/"), F.lit(""))


def combined_text(title: Column, description: Column, subjects: Column) -> Column:
    """What the sparse index reads: title, description, subjects. Authors aren't in it."""
    return F.trim(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(description, F.lit("")), F.nullif(F.array_join(subjects, " "), F.lit(""))))


def searchable_text(title: Column, authors: Column, subjects: Column, description: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(authors, " "), F.array_join(subjects, " "), F.coalesce(description, F.lit("")))


def embedding_text(title: Column, authors: Column, description: Column, subjects: Column) -> Column:
    head = F.concat(title, F.lit(" by "), F.when(F.size(authors) > 0, F.array_join(authors, ", ")).otherwise("Unknown"))
    body = F.nullif(F.substring(description, 1, EMBED_DESCRIPTION), F.lit(""))
    tags = F.when(F.size(subjects) > 0, F.array_join(F.slice(subjects, 1, EMBED_SUBJECTS), ", "))
    return F.concat(F.lit("search_document: "), F.concat_ws(". ", head, body, tags))


def query_text(query: Column) -> Column:
    return F.concat(F.lit("search_query: "), query)


def clean_subjects(raw: Column, limit: int = PASSAGE_SUBJECTS) -> Column:
    """Subject tags for prose: split at commas, machine tags and repeats dropped, and those that are
    part of another one."""
    flat = F.filter(F.transform(F.flatten(F.transform(raw, lambda s: F.split(s, ","))), strip), lambda s: (s != "") & ~s.rlike(r"^\w+:\S+=|=\d{4}\b"))

    def key(s: Column) -> Column:
        return F.replace(F.lower(s), F.lit("-"), F.lit(" "))

    def first(tags: Column) -> Column:
        return let(F.transform(tags, key), lambda keys: F.filter(tags, lambda s, i: F.array_position(keys, key(s)) == i + 1))

    def whole(tags: Column) -> Column:
        return F.filter(tags, lambda s: ~F.exists(tags, lambda o: (F.lower(o) != F.lower(s)) & F.contains(F.lower(o), F.lower(s))))

    return F.slice(let(let(flat, first), whole), 1, limit)


def passage(title: Column, authors: Column, description: Column, subjects: Column) -> Column:
    """A document as prose for a pair scorer; `authors` is one string."""
    t, a = F.nullif(title, F.lit("")), F.nullif(authors, F.lit(""))
    head = F.when(t.isNotNull() & a.isNotNull(), F.concat(t, F.lit(" by "), a, F.lit("."))).when(t.isNotNull(), F.concat(t, F.lit(".")))
    body = strip(F.regexp_replace(F.regexp_replace(description, "^[\"']+|[\"']+$", ""), r"\s+", " "))
    tail = let(clean_subjects(subjects), lambda tags: F.when(F.size(tags) > 0, F.concat(F.lit("This book covers "), F.array_join(tags, ", "), F.lit("."))))
    return F.concat_ws(" ", head, F.nullif(F.substring(body, 1, PASSAGE_DESCRIPTION), F.lit("")), tail)


def cover_url(cover_id: Column, isbn: Column) -> Column:
    # fixed values: the addresses of cover images by either key
    base = "https://covers.openlibrary.org/b/"
    return F.when(cover_id.isNotNull() & (cover_id != 0), F.concat(F.lit(base + "id/"), cover_id.cast("string"), F.lit("-M.jpg"))).when(
        F.nullif(isbn, F.lit("")).isNotNull(), F.concat(F.lit(base + "isbn/"), isbn, F.lit("-M.jpg?default=false")))


def subject_badge(subjects: Column, shown: int = 3) -> Column:
    """The first subjects, and how many more there are: "a, b, c +2 more"."""
    more = F.size(subjects) - shown
    return F.concat(F.array_join(F.slice(subjects, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def pooled_document(work_id: Column, title: Column, authors: Column, subjects: Column, description: Column) -> Column:
    """A document of a pool, as a judge sees it: plain id, eight subjects, 500 characters."""
    return F.struct(plain_id(work_id).alias("work_id"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(authors, F.lit("")).alias("authors"), F.slice(F.coalesce(subjects, F.array().cast("array<string>")), 1, POOL_SUBJECTS).alias("subjects"), F.substring(F.coalesce(description, F.lit("")), 1, POOL_DESCRIPTION).alias("description"))


def wrap_lines(text: Column, width: int, most: int) -> Column:
    """Words in lines of at most `width` characters, at most `most` of them; what is cut is marked " ...".
    A word that is longer has a line of its own."""
    def add(done: Column, word: Column) -> Column:
        last = F.coalesce(F.element_at(done, -1), F.lit(""))
        fits = (F.size(done) > 0) & (F.length(last) + 1 + F.length(word) <= width)
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat_ws(" ", last, word)))).otherwise(F.concat(done, F.array(word)))

    words = F.filter(F.split(strip(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    lines = F.aggregate(words, F.array().cast("array<string>"), add)
    return let(lines, lambda ls: F.when(F.size(ls) > most, F.concat(F.slice(ls, 1, most - 1), F.array(F.concat(F.get(ls, F.lit(most - 1)), F.lit(" ..."))))).otherwise(ls))


def join_authors(authors: Column) -> Column:
    return F.array_join(F.filter(authors, lambda a: a.isNotNull() & (a != "")), ", ")
