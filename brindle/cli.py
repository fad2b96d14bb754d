"""Command line: corpus, index, search, dictionary and queue jobs."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from brindle.operators import agreement, etl, sampling, spelling
from brindle.plans import jobs
from brindle.plans.engine import Engine, Index, Settings, build_index
from brindle.sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="brindle")
    sub = p.add_subparsers(dest="job", required=True)

    def job(name: str, *args: tuple) -> None:
        s = sub.add_parser(name)
        for flags, options in args:
            s.add_argument(*flags, **options)

    corpus, out = (("--corpus",), {"required": True}), (("--out",), {"required": True})
    job("corpus", (("--input",), {"required": True}), out, (("--limit",), {"type": int}), (("--seed",), {"type": int, "default": 42}), (("--keep-non-english",), {"action": "store_true"}))
    job("clean", (("--input",), {"required": True}), (("--out",), {"help": "where the cleaned corpus goes; needed unless --dry-run is given, and never the input"}), (("--dry-run",), {"action": "store_true"}))
    job("enqueue", corpus, out, (("--start-batch",), {"type": int, "default": 0}), (("--max-batches",), {"type": int}))
    job("worker", (("--queue",), {"required": True}), out, (("--checkpoint",), {"required": True}), (("--loop",), {"action": "store_true"}), (("--errors",), {}), (("--embedder",), {"help": "module:function from a list of texts to rows of numbers; without it the hashed stand-in"}))
    job("assemble", corpus, (("--shards",), {"required": True}), out, (("--dim",), {"type": int, "default": 256}), (("--allow-partial",), {"action": "store_true"}))
    job("load", corpus, (("--vectors",), {"required": True}), out, (("--recreate",), {"action": "store_true"}))
    job("dictionary", corpus, out)
    job("queries", corpus, out, (("--n",), {"type": int, "default": 100}), (("--seed",), {"type": int, "default": 42}), (("--max-verbatim-ngram",), {"type": int}))
    job("known-items", corpus, out, (("--count",), {"type": int, "default": 50}), (("--seed",), {"type": int, "default": 42}))
    pooled, judgments = (("--pooled",), {"required": True}), (("--judgments",), {"required": True})
    job("judge", pooled, out, (("--csv",), {}), (("--k",), {"type": int, "default": jobs.SAMPLES}), (("--max-escalation-samples",), {"type": int, "default": jobs.ESCALATION}), (("--done",), {}), (("--agreement",), {"nargs": 2}), (("--gold-check",), {"nargs": 2}))
    job("evaluate", judgments, (("--rankings",), {"required": True}), (("--queries",), {}), (("--base",), {"default": "vector"}), out)
    job("thresholds", judgments, (("--rankings",), {"required": True}), (("--trials",), {"type": int, "default": 2000}), (("--seed",), {"type": int, "default": 42}), out)
    job("label", judgments, pooled, (("--done",), {}), (("--n",), {"type": int, "default": 50}), (("--seed",), {"type": int, "default": 42}), (("--strategy",), {"choices": ["stratified", "random"], "default": "stratified"}), out)
    job("known-item-eval", (("--items",), {"required": True}), (("--index",), {"required": True}), (("--modes",), {"nargs": "+", "default": ["keyword", "vector", "hybrid"]}), (("--gated-modes",), {"nargs": "*", "default": ["hybrid"]}), (("--max-drop",), {"type": float, "default": 5.0}), (("--top-k",), {"type": int, "default": 10}), (("--baseline",), {}), (("--fast",), {"action": "store_true"}), (("--update-baseline",), {"action": "store_true"}), (("--no-hard-variants",), {"action": "store_true"}), out)
    job("search", (("--index",), {"required": True}), (("query",), {}), (("--top-k",), {"type": int, "default": 10}), (("--mode",), {"default": "hybrid"}), (("--tier",), {"type": int}), (("--year-min",), {"type": int}), (("--year-max",), {"type": int}))
    return p


def _judge(spark: SparkSession, a: argparse.Namespace) -> object:
    """Judging by the dry-run judge (models are injected where the job is called from Python), agreement of two
    judgments, or a check of gold documents."""
    if a.agreement:
        first, second = (tables.judgments(spark, p) for p in a.agreement)
        return tables.write_report([r.asDict() for r in jobs.rater_agreement(first, second).collect()], a.out)
    if a.gold_check:
        queries = spark.read.option("multiLine", True).json(a.gold_check[0]).select("query", "gold_work_ids")
        return tables.write_report([r.asDict() for r in agreement.gold_agreement(agreement.gold_pairs(queries), tables.judgments(spark, a.gold_check[1])).collect()], a.out)
    judged, _ = jobs.judge_pool(tables.pooled(spark, a.pooled), jobs.dry_run, a.k, a.max_escalation_samples, tables.judgments(spark, a.done) if a.done else None)
    if a.csv:
        tables.write_audit(judged, a.csv)
    judged.write.mode("overwrite").json(tables.guard(a.out))
    return [r.asDict() for r in jobs.judge_report(judged).collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("brindle").getOrCreate()
    if a.job == "corpus":
        return tables.write_books(etl.build_corpus(tables.raw_books(spark, a.input), a.limit, a.seed, a.keep_non_english), a.out)
    if a.job == "clean":
        from brindle.functions.text import clean_description

        if not a.dry_run and (not a.out or a.out.rstrip("/") == a.input.rstrip("/")):
            raise ValueError("clean needs --out, another place than --input, or --dry-run")
        books = tables.books(spark, a.input)
        new = clean_description(F.col("description"))
        row = books.agg(F.count_if(~new.eqNullSafe(F.col("description"))).alias("changed"), F.count("*").alias("total")).first()
        if not a.dry_run:
            tables.write_books(books.withColumn("description", new), a.out)
        return row["changed"], row["total"]
    if a.job == "enqueue":
        from brindle.streaming.embedding import enqueue

        schema = tables.T.StructType([*tables.BOOK.fields, tables.T.StructField("row_idx", tables.T.LongType())])
        return enqueue(spark.read.schema(schema).json(a.corpus), a.out, Settings.from_env().slice_rows, a.start_batch, a.max_batches)
    if a.job == "worker":
        from brindle.operators.dense import embed_udf, hashed_embedding
        from brindle.streaming.embedding import start

        dim = Settings.from_env().dim
        embed = lambda c: hashed_embedding(c, dim)
        if a.embedder:
            module, _, name = a.embedder.partition(":")
            embed = embed_udf(getattr(importlib.import_module(module), name), dim)
        return start(spark, a.queue, a.out, a.checkpoint, embed, dim, a.loop, a.errors).awaitTermination()
    if a.job == "assemble":
        books, vectors = tables.indexed_books(spark, a.corpus), tables.shards(spark, a.shards)
        etl.check_index(etl.validate_index(vectors, books, a.dim), a.allow_partial)
        return tables.write_index(vectors.select("work_id", "embedding"), a.out)
    if a.job == "load":
        return build_index(tables.indexed_books(spark, a.corpus), tables.vectors(spark, a.vectors)).save(a.out, a.recreate)
    if a.job == "dictionary":
        return tables.write_dictionary(spelling.build_dictionary(tables.indexed_books(spark, a.corpus)), a.out)
    if a.job == "queries":
        return tables.write_report(sampling.query_set(tables.indexed_books(spark, a.corpus), a.n, a.seed, a.max_verbatim_ngram), a.out)
    if a.job == "known-items":
        return tables.write_report([r.asDict() for r in sampling.known_items(tables.indexed_books(spark, a.corpus), a.count, a.seed).collect()], a.out)
    if a.job == "judge":
        return _judge(spark, a)
    if a.job == "evaluate":
        rankings, grades = tables.rankings(spark, a.rankings), tables.judgments(spark, a.judgments)
        queries = spark.read.json(a.queries).select("query", "category") if a.queries else spark.createDataFrame([], "query string, category string")
        modes = sorted(r["mode"] for r in rankings.select("mode").distinct().collect())
        result = jobs.evaluate(rankings, grades, queries, modes, a.base if a.base in modes else modes[0])
        return tables.write_report({name: [r.asDict() for r in df.collect()] for name, df in result.items() if name != "per_query"}, a.out)
    if a.job == "thresholds":
        rows = jobs.thresholds(tables.rankings(spark, a.rankings), tables.judgments(spark, a.judgments), trials=a.trials, seed=a.seed)
        return tables.write_report([r.asDict() for r in rows.orderBy("at_least", "mode").collect()], a.out)
    if a.job == "label":
        done = tables.progress(spark, a.done) if a.done else spark.createDataFrame([], "query string, work_id string, grade int")
        rows = [r.asDict() for r in jobs.label_tasks(tables.judgments(spark, a.judgments).select("query", "work_id", "grade"), tables.pooled(spark, a.pooled), done, a.n, a.seed, a.strategy).collect()]
        return tables.write_with_meta(rows, a.out, {"n": a.n, "seed": a.seed, "strategy": a.strategy})
    if a.job == "known-item-eval":
        engine = Engine(Index.load(spark, a.index))
        items = tables.known_item_rows(spark, a.items)
        hard = None if a.no_hard_variants or a.fast else tables.known_item_rows(spark, a.items, "hard")
        report = jobs.known_item_report(items, jobs.known_item_rankings(engine, items, a.modes, a.top_k), hard, None if hard is None else jobs.known_item_rankings(engine, hard, a.modes, a.top_k))
        code, summary = jobs.run_gate(report, tables.baseline(spark, a.baseline) if a.baseline and not a.update_baseline else None, a.gated_modes, a.max_drop, a.fast, a.update_baseline)
        tables.write_report(summary | {name: [r.asDict() for r in df.collect()] for name, df in report.items() if name != "overall"}, a.out)
        return code
    hits = Engine(Index.load(spark, a.index)).search(spark.createDataFrame([(0, a.query)], "qid int, query string"), a.top_k, a.mode, a.year_min, a.year_max, a.tier)
    return hits.select("rank", "work_id", "title", "score").orderBy("rank").show(truncate=False)


if __name__ == "__main__":
    main()
