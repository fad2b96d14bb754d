"""Jobs of evaluation, composed of the operators: pools, judging, graded evaluation, known items, thresholds,
labels, query generation. Models come in as functions of Columns; nothing here calls one by itself."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import querygen as G
from brindle.functions.judging import contradiction, leading_grade, pair_key, parse_grade, synthetic_grade, vote
from brindle.functions.text import pooled_document, strip
from brindle.operators import agreement, bootstrap, etl, judging, metrics, sampling
from brindle.plans.engine import Engine

#: A judge's answer to a prompt; the seed tells samples apart.
Ask = Callable[[Column, Column], Column]
SAMPLES, ESCALATION = 3, 2


def keep(df: DataFrame) -> DataFrame:
    """What several branches read is held, spilled to disk where memory is short; a lost executor costs a
    recomputation. Jobs take another function for tables on shared storage."""
    return df.persist()


# ---- pools

def pool_queries(engine: Engine, queries: DataFrame, depth: int = 10) -> DataFrame:
    """(query, pos, document): what vector, keyword, hybrid and reranked hybrid search find for
    queries(qid, query), the first of repeated documents, as a judge sees them."""
    arms = []
    for mode, again in (("vector", False), ("keyword", False), ("hybrid", False), ("hybrid", True)):
        arms.append(engine.search(queries, depth, mode, rerank=again).select(F.col("qid").alias("query"), "work_id", "rank"))
    pooled = etl.pool(arms)
    b = engine.index.books
    shown = b.select("work_id", pooled_document(F.col("work_id"), F.col("title"), F.col("authors"), F.col("subjects"), F.col("description")).alias("document"))
    return pooled.join(shown, "work_id").select("query", "pos", "work_id", "document")


# ---- judging

def graded_judging(pairs: DataFrame, ask: Ask, done: DataFrame | None = None) -> DataFrame:
    """Judgments(query, work_id, grade, raw) of pairs(query, work_id, title, authors, description, subjects), one
    answer each: graded ones of `done` stay as they are, failed ones are asked again."""
    todo = pairs if done is None else judging.to_judge(pairs, done)
    raw = ask(judging.prompt(F.col("query").cast("string"), F.col("title"), F.col("authors"), F.col("description"), F.col("subjects")), F.lit(0))
    new = todo.select("query", "work_id", raw.alias("raw")).select("query", "work_id", leading_grade(F.col("raw")).alias("grade"), "raw")
    if done is None:
        return new
    return done.where("grade is not null").select("query", "work_id", "grade", F.lit(None).cast("string").alias("raw")).unionByName(new)


def _answers(pairs: DataFrame, ask: Ask, first: int, count: int, name: str) -> DataFrame:
    """`name`: the readable answers of samples first to first + count, each asked with an order of its own."""
    def one(i: int) -> Column:
        seed = F.lit(first + i)
        return parse_grade(ask(judging.prompt(F.col("query").cast("string"), F.col("title"), F.col("authors"), F.col("description"), F.col("subjects"), seed), seed))

    return pairs.withColumn(name, F.filter(F.array(*map(one, range(count))), lambda a: a["grade"].isNotNull()))


def judge_pool(pairs: DataFrame, ask: Ask, k: int = SAMPLES, escalation: int = ESCALATION, done: DataFrame | None = None, cache: DataFrame | None = None, save: Callable[[DataFrame], DataFrame] = keep) -> tuple[DataFrame, DataFrame]:
    """(judgments, cache) of pairs by k samples each; those without a majority, and they alone, get `escalation`
    more. Graded pairs of `done` aren't judged again, pairs whose key `cache(pair_key, grade, reasoning)`
    holds aren't asked; the new cache holds both."""
    pairs = pairs.withColumn("query", F.col("query").cast("string")).withColumn("work_id", F.col("work_id").cast("string"))
    todo = pairs if done is None else judging.to_judge(pairs, done)
    known = None
    if cache is not None:
        known, todo = judging.with_cache(todo, cache.where("grade is not null").select("pair_key", "grade", "reasoning"))
        todo = todo.drop("pair_key")
    first = save(_answers(todo, ask, 0, k, "answers"))
    undecided = ~vote(F.transform("answers", lambda a: a["grade"]))["majority"] & (F.size("answers") >= 2) & F.lit(escalation > 0)
    none = F.lit(None).cast(first.schema["answers"].dataType)
    settled = first.where(~undecided).withColumn("more", F.coalesce(none, F.slice("answers", 1, 0)))
    samples = settled.unionByName(_answers(first.where(undecided), ask, k, escalation, "more"))
    grades, why = (lambda c: F.transform(c, lambda a: a["grade"])), (lambda c: F.transform(c, lambda a: a["reasoning"]))
    judged = judging.aggregate(samples.select("query", "work_id", "title", grades("answers").alias("samples"), why("answers").alias("reasons"), grades("more").alias("extra"), why("more").alias("extra_reasons"), F.lit(k).alias("k")), escalation)
    judged = save(judged.withColumn("cached", F.lit(False)))
    fresh = judged.where("grade is not null").select(pair_key(F.col("query"), F.col("work_id")).alias("pair_key"), "grade", "reasoning")
    if known is None:
        return judged, fresh
    odd = contradiction(F.col("grade"), F.col("reasoning"))
    blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in judged.schema.fields}
    old = known.select(*[F.col(c) if c in ("query", "work_id", "title", "grade", "reasoning") else F.lit(False).alias(c) if c == "low_confidence" else odd[c].alias(c) if c.startswith("contradiction") else F.lit(True).alias(c) if c == "cached" else blank[c] for c in judged.columns])
    return judged.unionByName(old), cache.select("pair_key", "grade", "reasoning").unionByName(fresh).dropDuplicates(["pair_key"])


def dry_run(prompt: Column, seed: Column) -> Column:
    """A made-up judge for dry runs: a stable grade for each prompt and sample."""
    return F.concat(F.lit('{"grade": '), synthetic_grade(prompt, seed).cast("string"), F.lit(', "reasoning": "synthetic"}'))


def judge_report(judgments: DataFrame) -> DataFrame:
    """One row: the distribution of grades and the consistency of samples."""
    return agreement.grade_distribution(judgments).crossJoin(agreement.self_consistency(judgments.where("not cached")))  # one row each


def rater_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Agreement over the pairs that both judgments(query, work_id, grade, pos) grade."""
    return agreement.agreement(agreement.pair_labels(a, b))


# ---- graded evaluation

def evaluate(rankings: DataFrame, grades: DataFrame, queries: DataFrame, modes: list[str], base: str, save: Callable[[DataFrame], DataFrame] = keep, replicates: int = bootstrap.REPLICATES) -> dict[str, DataFrame]:
    """All tables of a graded evaluation of rankings(mode, query, rank, work_id) by grades, over the queries with a
    relevant document that every mode answered; `queries(query, category)` may lack some. Each mode but
    `base` is compared with it; "oracle" is the best order of each mode's own candidates."""
    fit = metrics.with_relevant(grades).join(metrics.in_all_modes(rankings, len(modes)), "query", "left_semi")
    some, known = rankings.join(fit, "query", "left_semi"), grades.join(fit, "query", "left_semi")
    per = save(metrics.with_category(metrics.query_metrics(some, known), queries))
    best = metrics.oracle_order(metrics.judged(some, known), group=("mode", "query")).select("mode", "query", "rank", "work_id")
    oracle = metrics.mean_metrics(metrics.query_metrics(best, known), "mode")
    categories = sorted(r["category"] for r in per.select("category").distinct().collect())  # a handful
    pairs = [(m, base) for m in modes if m != base]
    by_category = [bootstrap.category_intervals(per, m, b, categories, replicates).withColumn("versus", F.lit(f"{m} - {b}")) for m, b in pairs]
    out = by_category[0] if by_category else None
    for part in by_category[1:]:
        out = out.unionByName(part)
    tables = {
        "per_query": per, "overall": metrics.mean_metrics(per, "mode"), "intervals": bootstrap.mode_intervals(per, modes, replicates),
        "by_category": metrics.mean_metrics(per, "category", "mode"), "oracle": oracle, "ceiling": metrics.recall_ceiling(known),
        "dropped": metrics.missing_queries(rankings, grades.select("query"))}
    if pairs:
        tables |= {"paired": bootstrap.paired_intervals(per, pairs, replicates), "category_intervals": out}
    return tables


def thresholds(rankings: DataFrame, grades: DataFrame, levels: tuple[int, ...] = (1, 2), trials: int = 2000, seed: int = 42) -> DataFrame:
    """(at_least, mode, mrr, recall, density, random_mrr, lift): how results depend on the grade that counts as
    relevant, beside the expectation of a random order of each query's judged documents."""
    out = None
    for level in levels:
        per = metrics.query_metrics(rankings, grades, at_least=level)
        pools = grades.where("grade is not null").groupBy("query").agg(F.count("*").cast("int").alias("pool"), F.count_if(F.col("grade") >= level).cast("int").alias("relevant"))
        luck = metrics.random_mrr_trials(pools, trials, seed) if trials else pools.select("query", F.round(metrics.random_mrr(F.col("pool"), F.col("relevant")), 6).alias("random_mrr"))
        mean = per.join(luck, "query", "left").groupBy("mode").agg(*(F.round(F.avg(c), 4).alias(c) for c in ("mrr", "recall")), F.round(F.avg("relevant_total"), 2).alias("density"), F.round(F.avg("random_mrr"), 4).alias("random_mrr"))
        part = mean.select(F.lit(level).alias("at_least"), "*", F.round(F.try_divide("mrr", F.nullif("random_mrr", F.lit(0.0))), 2).alias("lift"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- known items

def known_item_rankings(engine: Engine, items: DataFrame, modes: list[str], top_k: int = 10) -> DataFrame:
    """(mode, query, rank, work_id) of items(query, work_id, ...); "x+rerank" is mode x, reranked."""
    asked, out = items.select(F.col("query").alias("qid"), "query").distinct(), None
    for name in modes:
        mode, again = metrics.leading_mode(name)
        part = engine.search(asked, top_k, mode, rerank=again).select(F.lit(name).alias("mode"), F.col("qid").alias("query"), F.col("rank").cast("int").alias("rank"), F.replace("work_id", F.lit("/works/"), F.lit("")).alias("work_id"))
        out = part if out is None else out.unionByName(part)
    return out


def known_item_report(items: DataFrame, rankings: DataFrame, hard: DataFrame | None = None, hard_rankings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Accuracy by mode, by the class of a title's words, and by the kind of hard variant."""
    out = {"overall": metrics.known_item_accuracy(items, rankings), "by_class": metrics.known_item_accuracy(items, rankings, "class")}
    if hard is not None and hard_rankings is not None:
        out["hard"] = metrics.known_item_accuracy(hard, hard_rankings, "class")
    return out


def run_gate(report: dict[str, DataFrame], baseline: DataFrame | None, gated: list[str], max_drop: float = 5.0, fast: bool = False, update: bool = False, stamp: dict | None = None) -> tuple[int, dict]:
    """(exit code, summary): 0 if every gated mode holds, 1 if one falls by more than `max_drop` points, 2 if
    the run must be refused. The summary has a row for each mode and no details; with `update` it is
    the new baseline."""
    modes = [r.asDict() for r in report["overall"].orderBy("mode").collect()]  # a row for each mode
    old = [] if baseline is None else [r.asDict() for r in baseline.collect()]
    before = sorted({m for r in old for m in (r.get("gated_modes") or [])})
    problems = metrics.gate_problems([] if update else before, gated, [m["mode"] for m in modes], fast, update)
    summary = {"modes": {m["mode"]: {k: m[k] for k in ("accuracy_at_1", "accuracy_at_5", "mrr")} for m in modes}, "gated_modes": gated, "max_drop_pp": max_drop, "item_count": modes[0]["total"] if modes else 0} | (stamp or {})
    if problems:
        return 2, summary | {"problems": problems}
    if update or baseline is None:
        return 0, summary | {"updated": update}
    checks = [r.asDict() for r in metrics.gate(report["overall"], baseline, gated, max_drop).orderBy("mode").collect()]
    return int(not all(c["passed"] for c in checks)), summary | {"checks": checks}


# ---- labels

def label_tasks(judgments: DataFrame, pooled: DataFrame, done: DataFrame, n: int, seed: int = 42, strategy: str = "stratified") -> DataFrame:
    """The sampled pairs that nobody has graded yet: a session that was left goes on with the rest."""
    return sampling.label_pairs(judgments, pooled, n, seed, strategy).join(done.select("query", "work_id"), ["query", "work_id"], "left_anti")


def take_back(done: DataFrame, query: str, work_id: str) -> DataFrame:
    """Labels without the one of a pair, which is asked again."""
    return done.where(~((F.col("query") == query) & (F.col("work_id") == work_id)))


# ---- query generation

def generation_prompt(category: Column, title: Column, authors: Column, subjects: Column, description: Column) -> Column:
    return F.concat(F.lit("Write one search query of the kind "), category, F.lit(" for this book.\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\nAuthors: "), F.array_join(authors, ", "), F.lit("\nSubjects: "), F.array_join(F.slice(subjects, 1, 8), ", "), F.lit("\nDescription: "), F.substring(F.coalesce(description, F.lit("")), 1, 400))


def generate_queries(books: DataFrame, n: int, generate: Callable[[Column], Column] | None, seed: int = 42) -> DataFrame:
    """(work_id, category, query, source): a model's query for each seed book, quotes around it dropped; where there
    is no model or it gave nothing, the template's."""
    seeds = sampling.assign_categories(sampling.seed_books(books, n, seed), n, seed)
    template = strip(G.template_query(F.col("category"), F.col("title"), F.col("authors"), F.col("subjects"), F.col("description"), F.col("first_publish_year"), F.concat_ws("|", "work_id", F.lit(seed))))
    asked = F.lit(None).cast("string") if generate is None else generate(generation_prompt(F.col("category"), F.col("title"), F.col("authors"), F.col("subjects"), F.col("description")))
    both = seeds.select("work_id", "category", F.nullif(strip(F.regexp_replace(strip(asked), "^[\"'“”]+|[\"'“”]+$", "")), F.lit("")).alias("said"), template.alias("template"))
    source = F.lit("template") if generate is None else F.when(F.col("said").isNotNull(), "model").otherwise("template_fallback")
    return both.select("work_id", "category", F.coalesce("said", "template").alias("query"), source.alias("source"))


# ---- models behind an address

class ModelError(Exception):
    """An answer that isn't one: its status, and whether a filter refused the text."""

    def __init__(self, status: int, filtered: bool = False):
        super().__init__(f"status {status}")
        self.status, self.filtered = status, filtered


def retrying(call: Callable[[str], str], attempts: int = 5, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> Callable[[str], str | None]:
    """A model call that waits and tries again when it is asked to slow down or the server fails: 0.6 s, then 1.7
    times as long, at most 8 s, give or take 30 %. A text that a filter refuses is null; other refusals
    are errors at once."""
    rng = rng or random.Random()

    def ask(text: str) -> str | None:
        for n in range(1, attempts + 1):
            try:
                return call(text)
            except ModelError as e:
                if e.filtered:
                    return None
                if (e.status != 429 and e.status < 500) or n == attempts:
                    raise
            sleep(min(8.0, 0.6 * 1.7 ** (n - 1)) * rng.uniform(0.7, 1.3))
        return None

    return ask
