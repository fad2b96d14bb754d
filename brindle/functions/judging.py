"""Grades: parsing, votes, contradictions, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import draw_number, let, strip

# Phrases that deny or affirm relevance.
NEGATIVE_PHRASES = ["not relevant", "unrelated", "no connection", "nothing to do", "does not match", "wrong topic", "irrelevant", "no overlap", "not what the user", "not a match", "misleading"]
POSITIVE_PHRASES = ["exactly what", "perfect match", "directly relevant", "precisely what", "ideal result", "highly relevant", "exactly matches"]


def grade_of(grade: Column, relevance: Column) -> Column:
    """The newer field first; a grade of 0 counts."""
    return F.coalesce(grade, relevance)


def pair_key(query: Column, work_id: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lower(strip(query)), F.lit("||"), strip(work_id)), 256), 1, 16)


def unfence(raw: Column) -> Column:
    """An answer without the fence of a code block around it."""
    text = strip(raw)
    inner = F.regexp_replace(F.regexp_replace(text, r"(?s)^```[^\n]*\n", ""), r"(?s)```(?:(?!```).)*$", "")
    return F.when(F.startswith(text, F.lit("```")), strip(inner)).otherwise(text)


def parse_grade(raw: Column) -> Column:
    """(grade, reasoning) of a JSON answer. What can't be read is null, never 0."""
    found = F.regexp_extract(raw, r'"grade"\s*:\s*([012])', 1).try_cast("int")

    def of(p: Column) -> Column:
        number = p["read"]["grade"].try_cast("double").try_cast("int")
        grade = F.when(p["valid"], F.when(number.isin(0, 1, 2), number)).otherwise(found)
        return F.struct(grade.alias("grade"), F.when(p["valid"], F.coalesce(p["read"]["reasoning"], F.lit(""))).otherwise("").alias("reasoning"))

    return let(let(unfence(raw), lambda t: F.struct(F.from_json(t, "grade string, reasoning string").alias("read"), F.try_parse_json(t).isNotNull().alias("valid"))), of)


def leading_grade(raw: Column) -> Column:
    """The first character if it is a digit, at most 2."""
    return F.when(strip(raw).rlike(r"^\d"), F.least(F.lit(2), F.substring(strip(raw), 1, 1).try_cast("int")))


def contradiction(grade: Column, reasoning: Column) -> Column:
    """(flag, detail): a high grade with a denying phrase, or 0 with an affirming one; the first in order."""
    low = F.lower(F.coalesce(reasoning, F.lit("")))

    def first(phrases: list[str]) -> Column:
        return F.get(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p)), F.lit(0))

    def found(phrase: Column) -> Column:
        detail = F.concat(F.lit("Grade "), grade.cast("string"), F.lit(' but reasoning says "'), phrase, F.lit('"'))
        return F.struct(phrase.isNotNull().alias("contradiction"), F.coalesce(detail, F.lit("")).alias("contradiction_detail"))

    return let(F.when(grade >= 2, first(NEGATIVE_PHRASES)).when(grade == 0, first(POSITIVE_PHRASES)), found)


def vote(samples: Column) -> Column:
    """(majority, grade, votes): over half the samples; of exactly two grades with equally many, the
    lower; else no majority."""
    def of(p: Column) -> Column:
        top = F.array_max(F.transform(p["c"], lambda c: c["n"]))

        def won(t: Column) -> Column:
            best = F.filter(p["c"], lambda c: c["n"] == t)
            ok = F.coalesce((F.size(p["s"]) > 0) & ((t * 2 > F.size(p["s"])) | (F.size(best) == 2)), F.lit(False))
            return F.struct(ok.alias("majority"), F.when(ok, F.get(best, F.lit(0))["g"]).alias("grade"), F.coalesce(t, F.lit(0)).alias("votes"))

        return let(top, won)

    grades = F.array_sort(F.array_distinct(samples))
    counts = F.transform(grades, lambda g: F.struct(F.size(F.filter(samples, lambda x: x == g)).alias("n"), g.alias("g")))
    return let(F.struct(samples.alias("s"), counts.alias("c")), of)


def judge(samples: Column, reasons: Column, extra: Column, extra_reasons: Column, k: Column, escalation: int = 2) -> Column:
    """The judgment of sampled grades: no majority among two samples or more draws the extra ones.
    Agreement counts all requested samples, those that failed too."""
    def second(f: Column) -> Column:
        more = ~f["majority"] & (F.size(samples) >= 2) & F.lit(escalation > 0)
        return F.struct(F.when(more, F.concat(samples, extra)).otherwise(samples).alias("every"), F.when(more, F.concat(reasons, extra_reasons)).otherwise(reasons).alias("why"), F.when(more, k + escalation).otherwise(k).alias("asked"))

    def settle(d: Column) -> Column:
        v, every = d["vote"], d["draw"]["every"]
        none = F.size(samples) == 0
        said = F.coalesce(F.get(d["draw"]["why"], (F.array_position(every, v["grade"]) - 1).cast("int")), F.lit(""))
        reasoning = F.when(none, F.lit("all_samples_failed")).when(~v["majority"], F.lit("no_consensus")).otherwise(said)
        agreement = F.when(v["majority"], v["votes"] / d["draw"]["asked"]).otherwise(F.lit(0.0))
        low = none | ~v["majority"] | (F.size(every) < 2)
        return F.struct(F.when(~none, v["grade"]).alias("grade"), reasoning.alias("reasoning"), every.alias("samples"), agreement.alias("agreement"), d["draw"]["asked"].alias("k_requested"), F.size(every).alias("n_samples_ok"), low.alias("low_confidence"), v["majority"].alias("majority"))

    def check(j: Column) -> Column:
        odd = contradiction(j["grade"], j["reasoning"])
        fields = [j[c].alias(c) for c in ("grade", "reasoning", "samples", "agreement", "k_requested", "n_samples_ok", "low_confidence")]
        return F.struct(*fields, (odd["contradiction"] & j["majority"]).alias("contradiction"), F.when(j["majority"], odd["contradiction_detail"]).otherwise("").alias("contradiction_detail"))

    draw = let(vote(samples), second)
    return let(let(let(draw, lambda d: F.struct(d.alias("draw"), vote(d["every"]).alias("vote"))), settle), check)


def synthetic_grade(*keys: Column) -> Column:
    """A stable made-up grade for dry runs."""
    return draw_number(F.lit(3), *keys)
