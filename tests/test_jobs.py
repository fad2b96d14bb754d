"""Stores, queues, the worker, and the jobs of evaluation."""

import json
import random

import pytest
from pyspark.sql import functions as F

from brindle import cli
from brindle.functions import text as X
from brindle.operators import dense, metrics
from brindle.plans import jobs
from brindle.plans.engine import Engine, Index, add_books, build_index, lexical_scorer
from brindle.sources import tables
from brindle.sources.backends import FileQueue, ObjectStore, get_queue, object_store, trace_headers, trace_of
from brindle.sources.scratch import scratch_root
from brindle.streaming import embedding as E

BOOK = "work_id string, title string, authors array<string>, description string, subjects array<string>, first_publish_year int, cover_id int, isbn string, tier int, row_idx long"


def make_books(spark, n=8):
    words = ["dragons", "ships", "gardens", "kings", "storms", "bees", "rivers", "stones"]
    return spark.createDataFrame([(f"gr:{i}", f"The Title {words[i % 8]} {i}", ["Ann Lee"], f"a tale of {words[i % 8]} and {words[(i + 3) % 8]} told in full", ["Fiction"], 1990 + i, None, None, 1, i) for i in range(n)], BOOK)


def test_store(spark, tmp_path):
    with pytest.raises(ValueError):
        object_store(spark, "ftp", "x")
    store = object_store(spark, "local", str(tmp_path / "s"))
    assert store.list() == [] and not store.exists("a/b")
    store.put_bytes("a/b", b"one")
    store.put_bytes("a/b", b"\xff\x00two")
    store.put_bytes("a/c", b"")
    assert store.get_bytes("a/b") == b"\xff\x00two" and store.get_bytes("a/c") == b"" and store.list("a/") == ["a/b", "a/c"] and store.list("a/b") == ["a/b"]
    assert store.delete("a/b") and not store.exists("a/b") and not store.move("none", "other")
    tables.write_shards(spark.createDataFrame([("b1", 0, "x", [1.0])], tables.SHARD), str(tmp_path / "s" / "shards"))
    assert [r["work_id"] for r in store.shards("shards/").collect()] == ["x"]


def test_queue_hands_out_and_takes_back(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path))
    with pytest.raises(ValueError):
        get_queue(store, "rabbit", "t")
    queue = get_queue(store, "azure", "t", visibility=60)
    queue.ensure()
    assert queue.receive(3) == []
    for i in range(4):
        queue.send({"batch_id": f"b{i}"}, trace_headers("a" * 32, "b" * 16))
    first = queue.receive(3)
    assert [m.body["batch_id"] for m in first] == ["b0", "b1", "b2"] and first[0].headers == {"traceparent": f"00-{'a' * 32}-{'b' * 16}-01"}
    assert queue.ack(first[0]) and [m.body["batch_id"] for m in queue.receive(9)] == ["b3"] and queue.receive(9) == []
    late = FileQueue(store, "u", visibility=-1)
    late.send({"n": 1})
    assert len(late.receive()) == 1 and len(late.receive()) == 1
    heads = spark.createDataFrame([([("x", b"1"), ("traceparent", trace_headers("c" * 32)["traceparent"].encode())],), ([],)], "h array<struct<key:string,value:binary>>")
    assert [r["t"] for r in heads.select(trace_of(F.col("h")).alias("t")).collect()] == ["c" * 32, None]


def test_worker_does_each_slice_for_itself(spark, tmp_path):
    store, embed = ObjectStore(spark, str(tmp_path)), lambda c: dense.hashed_embedding(c, 16)
    queue = get_queue(store, "files", "embed", visibility=60)
    assert E.send_tasks(make_books(spark), store, queue, size=3) == 3
    queue.send({"batch_id": "gone", "blob_path": "slices/none", "start_idx": 0, "end_idx": 1})
    out, errors = str(tmp_path / "out"), str(tmp_path / "errors")
    assert E.work(spark, store, queue, out, embed, 16, loop=True, errors=errors, idle=0) == 1
    assert spark.read.parquet(out).count() == 8 and store.list("embed/new/") == [] and len(store.list("embed/taken/")) == 1
    notes = [json.loads(store.get_bytes(k)) for k in store.list("errors/")]
    assert [n["batch_id"] for n in notes] == ["gone"] and notes[0]["error"]
    with pytest.raises(Exception):  # noqa: B017
        E.work(spark, store, queue, out, lambda c: F.raise_error(F.lit("no model")), 16)


def test_worker_does_many_slices_in_a_job(spark, tmp_path, monkeypatch):
    store, embed = ObjectStore(spark, str(tmp_path / "a b=c")), lambda c: dense.hashed_embedding(c, 16)
    queue = get_queue(store, "files", "embed", visibility=60)
    n = E.send_tasks(make_books(spark), store, queue, size=1)
    written, write = [], E.write_shards
    monkeypatch.setattr(E, "write_shards", lambda df, path: (written.append(1), write(df, path)))
    out, errors = str(tmp_path / "out"), str(tmp_path / "errors")
    assert E.work(spark, store, queue, out, embed, 16, loop=True, errors=errors, idle=0) == 0
    assert n > 3 and len(written) == 1 and store.list("embed/new/") == store.list("embed/taken/") == []
    back = spark.read.parquet(out).select("batch_id", "start_idx").collect()
    assert len(back) == 8 and all(r["batch_id"] == f"batch-{r['start_idx']:06d}" for r in back)


def test_stream_goes_on_past_a_bad_slice(spark, tmp_path):
    def embed(text):
        return F.when(F.contains(text, F.lit("gardens")), F.raise_error(F.lit("bad slice")).cast("array<double>")).otherwise(dense.hashed_embedding(text, 16))

    b, root = make_books(spark), str(tmp_path)
    for _ in range(2):  # put in again, slices replace themselves
        E.enqueue(b, f"{root}/queue", size=2)
    E.start(spark, f"{root}/queue", f"{root}/out", f"{root}/check", embed, 16, errors=f"{root}/errors").awaitTermination()
    assert {r["work_id"] for r in spark.read.parquet(f"{root}/out").collect()} == {f"gr:{i}" for i in (0, 1, 4, 5)}
    assert [k.split("-2")[0] for k in ObjectStore(spark, f"{root}/errors").list()] == ["batch-000001", "batch-000003"]
    E.enqueue(b.where("row_idx in (2, 3, 6, 7)"), f"{root}/queue", size=2)
    E.start(spark, f"{root}/queue", f"{root}/out", f"{root}/check", lambda c: dense.hashed_embedding(c, 16), 16, errors=f"{root}/errors").awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == 8


def test_index_takes_books_in(spark, tmp_path):
    b, path = make_books(spark).drop("row_idx"), str(tmp_path / "index")
    embed = lambda c: dense.hashed_embedding(c, 32)
    vectors = lambda x: x.select("work_id", embed(F.concat_ws(" ", "title", "description")).alias("embedding"))
    build_index(b, vectors(b)).save(path)
    new = b.where("work_id = 'gr:1'").withColumn("description", F.lit("now about volcanoes")).unionByName(b.where("work_id = 'gr:2'").withColumns({"work_id": F.lit("gr:99"), "description": F.lit("volcanoes and lava")}))
    add_books(spark, path, new, vectors(new))
    engine = Engine(Index.load(spark, path), embed, scorer=lexical_scorer)
    q = spark.createDataFrame([(1, "volcanoes")], "qid int, query string")
    assert {r["work_id"] for r in engine.search(q, 5, "keyword").collect()} == {"gr:1", "gr:99"}
    assert engine.stats()["points"] == 9 and engine.ready() and engine.health()["status"] == "ok"
    assert not Engine(Index.load(spark, path), lambda c: F.raise_error(F.lit("x"))).ready()
    pooled = jobs.pool_queries(engine, q, 3)
    assert pooled.count() >= 3 and pooled.select("document.title").count()
    with pytest.raises(ValueError):
        engine.compare(q, 21)
    with pytest.raises(ValueError):
        engine.ask(spark.createDataFrame([(1, "x" * 501)], "qid int, question string"), lambda a, c: a)


def pairs_of(spark):
    return make_books(spark).select(F.lit("q").alias("query"), "work_id", "title", X.join_authors(F.col("authors")).alias("authors"), "description", "subjects")


def test_judging_asks_once_and_escalates(spark):
    asked = []

    def ask(prompt, seed):
        asked.append(1)
        n = F.substring("work_id", 4, 9).cast("int")
        g = F.when(n == 0, 2).when(n == 1, seed % 3).when(n == 2, F.when(seed < 3, seed % 3).otherwise(1)).when(n == 3, F.when(seed == 0, 1)).otherwise(0)
        return F.when(g.isNull(), F.lit("???")).otherwise(F.concat(F.lit('{"grade": '), g.cast("string"), F.lit(', "reasoning": "perfect match"}')))

    judged, cache = jobs.judge_pool(pairs_of(spark), ask)
    got = {r["work_id"]: r for r in judged.collect()}
    assert got["gr:0"]["grade"] == 2 and got["gr:0"]["k_requested"] == 3 and got["gr:0"]["agreement"] == 1.0
    assert got["gr:1"]["grade"] == 0 and got["gr:1"]["k_requested"] == 5 and got["gr:1"]["agreement"] == 0.4
    assert got["gr:2"]["grade"] == 1 and got["gr:2"]["agreement"] == 0.6
    assert got["gr:3"]["grade"] == 1 and got["gr:3"]["low_confidence"] and got["gr:3"]["n_samples_ok"] == 1
    assert got["gr:4"]["grade"] == 0 and got["gr:4"]["contradiction"] and cache.count() == 8
    again, after = jobs.judge_pool(pairs_of(spark), lambda p, s: F.raise_error(F.lit("asked again")).cast("string"), cache=cache)
    assert {r["work_id"]: r["grade"] for r in again.collect()} == {k: r["grade"] for k, r in got.items()} and after.count() == 8
    done = judged.where("work_id <> 'gr:5'").select("query", "work_id", "grade")
    assert [r["work_id"] for r in jobs.judge_pool(pairs_of(spark), ask, done=done)[0].collect()] == ["gr:5"]
    assert jobs.judge_report(judged).first()["total_pairs"] is not None


def test_gate_codes(spark):
    report = {"overall": spark.createDataFrame([("hybrid", 10, 0.8, 0.9, 0.85), ("keyword", 10, 0.5, 0.6, 0.55)], "mode string, total long, accuracy_at_1 double, accuracy_at_5 double, mrr double")}
    base = spark.createDataFrame([("hybrid", 0.9, ["hybrid"])], "mode string, accuracy_at_1 double, gated_modes array<string>")
    assert jobs.run_gate(report, base, ["hybrid"])[0] == 1 and jobs.run_gate(report, base, ["hybrid"], 20.0)[0] == 0
    assert jobs.run_gate(report, base, ["keyword"])[0] == 2 and jobs.run_gate(report, None, ["vector"])[0] == 2
    code, summary = jobs.run_gate(report, None, ["hybrid"], update=True, stamp={"git_sha": "abc"})
    assert code == 0 and summary["modes"]["hybrid"]["accuracy_at_1"] == 0.8 and summary["git_sha"] == "abc"
    assert jobs.run_gate(report, None, ["hybrid"], fast=True, update=True)[0] == 2


def test_evaluation(spark):
    rankings = spark.createDataFrame([(m, q, r + 1, f"d{(r + s) % 4}") for m, s in (("a", 0), ("b", 1)) for q in ("q1", "q2", "q3") for r in range(4) if (m, q) != ("b", "q3")], "mode string, query string, rank int, work_id string")
    grades = spark.createDataFrame([(q, f"d{i}", 2 if i == 0 else 0) for q in ("q1", "q2", "q3") for i in range(4)], "query string, work_id string, grade int")
    got = jobs.evaluate(rankings, grades, spark.createDataFrame([("q1", "x")], "query string, category string"), ["a", "b"], "a", replicates=50)
    assert {(r["mode"], r["mrr"], r["n_queries"]) for r in got["overall"].collect()} == {("a", 1.0, 2), ("b", 0.25, 2)}
    assert {(r["mode"], r["ndcg"]) for r in got["oracle"].collect()} == {("a", 1.0), ("b", 1.0)}
    assert [tuple(r) for r in got["dropped"].collect()] == [("b", "q3")] and {r["category"] for r in got["by_category"].collect()} == {"x", "unknown"}
    assert {r["delta"] for r in got["paired"].where("metric = 'mrr'").collect()} == {-0.75} and got["category_intervals"].count() == 2
    t = jobs.thresholds(rankings, grades, trials=0).orderBy("at_least", "mode").collect()
    assert len(t) == 4 and t[0]["random_mrr"] == pytest.approx((1 + 1 / 2 + 1 / 3 + 1 / 4) / 4, abs=1e-4)


def test_labels(spark):
    j = spark.createDataFrame([("q", f"d{i}", i % 3) for i in range(9)], "query string, work_id string, grade int")
    done = j.where("work_id in ('d0', 'd1')")
    left = {r["work_id"] for r in jobs.label_tasks(j, j.select("query", "work_id"), done, 9).collect()}
    assert left == {f"d{i}" for i in range(2, 9)}
    assert {r["work_id"] for r in jobs.label_tasks(j, j.select("query", "work_id"), jobs.take_back(done, "q", "d1"), 9).collect()} == left | {"d1"}


def test_generation_falls_back(spark):
    b = make_books(spark).withColumn("first_publish_year", F.lit(1990))
    got = jobs.generate_queries(b, 8, lambda prompt: F.when(F.contains(prompt, F.lit("ships")), F.lit(' "a ship story" ')))
    rows = got.collect()
    assert {r["query"] for r in rows if r["source"] == "model"} == {"a ship story"} and sum(r["source"] == "template_fallback" for r in rows) == 6 and all(r["query"] for r in rows)


def test_retry():
    waits, calls = [], []

    def call(text):
        calls.append(text)
        if len(calls) < 3:
            raise jobs.ModelError(429)
        return "ok"

    assert jobs.retrying(call, sleep=waits.append, rng=random.Random(1))("x") == "ok" and len(waits) == 2
    assert 0.42 <= waits[0] <= 0.78 and 0.714 <= waits[1] <= 1.326

    def refuse(error):
        def f(text):
            raise error
        return f

    assert jobs.retrying(refuse(jobs.ModelError(400, True)))("x") is None
    for error, n in ((jobs.ModelError(401), 0), (jobs.ModelError(503), 4)):
        waits.clear()
        with pytest.raises(jobs.ModelError):
            jobs.retrying(refuse(error), sleep=waits.append)("x")
        assert len(waits) == n


def test_text_of_displays(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], "one two three four five six seven"), ([], ""), (["a"], None)], "s array<string>, t string")
    got = df.select(X.subject_badge(F.col("s")).alias("b"), X.wrap_lines(F.col("t"), 9, 2).alias("w")).collect()
    assert [r["b"] for r in got] == ["a, b, c +2 more", "", "a"] and [r["w"] for r in got] == [["one two", "three ..."], [], []]


def test_known_items_from_files(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"items": [{"query": "a b c", "work_id": "/works/x", "title": "A", "title_word_class": "distinctive"}], "hard_variants": [{"query": "a", "work_id": "x", "title": "A", "variant_type": "typo"}]}))
    (tmp_path / "bad.json").write_text("{")
    items, hard = (tables.known_item_rows(spark, str(tmp_path / "i.json"), k) for k in ("items", "hard"))
    assert [tuple(r) for r in items.collect()] == [("a b c", "x", "A", "distinctive")] and hard.first()["class"] == "typo"
    assert tables.known_item_rows(spark, str(tmp_path / "bad.json")).count() == 0
    found = spark.createDataFrame([("keyword", "a b c", 2, "x")], "mode string, query string, rank int, work_id string")
    report = jobs.known_item_report(items, found, hard, found.withColumn("query", F.lit("a")))
    assert report["overall"].first()["mrr"] == 0.5 and report["by_class"].first()["class"] == "distinctive" and report["hard"].first()["hits_at_5"] == 1
    assert metrics.leading_mode("hybrid+rerank") == ("hybrid", True) and metrics.leading_mode("vector") == ("vector", False)


def test_command_line(spark, tmp_path):
    corpus, index = str(tmp_path / "corpus"), str(tmp_path / "index")
    b = make_books(spark)
    b.write.json(corpus)
    for out in ([], ["--out", corpus]):
        with pytest.raises(ValueError):
            cli.main(["clean", "--input", corpus, *out], spark)
    assert cli.main(["clean", "--input", corpus, "--dry-run"], spark) == (0, 8)
    vectors = str(tmp_path / "vectors")
    tables.write_index(b.select("work_id", dense.hashed_embedding(F.col("title"), 256).alias("embedding")), vectors)
    cli.main(["load", "--corpus", corpus, "--vectors", vectors, "--out", index], spark)
    cli.main(["known-items", "--corpus", corpus, "--out", str(tmp_path / "k.json"), "--count", "4"], spark)
    rows = json.loads((tmp_path / "k.json").read_text())
    (tmp_path / "items.json").write_text(json.dumps({"items": rows, "hard_variants": []}))
    code = cli.main(["known-item-eval", "--items", str(tmp_path / "items.json"), "--index", index, "--modes", "keyword", "--gated-modes", "keyword", "--out", str(tmp_path / "r.json")], spark)
    assert code == 0 and json.loads((tmp_path / "r.json").read_text())["modes"]["keyword"]["accuracy_at_5"] > 0.7
    pooled = {"q": [{"work_id": f"w{i}", "title": "t", "authors": "a", "subjects": ["s"], "description": "d"} for i in range(5)]}
    (tmp_path / "p.json").write_text(json.dumps(pooled))
    judged = str(tmp_path / "j")
    assert cli.main(["judge", "--pooled", str(tmp_path / "p.json"), "--out", judged, "--csv", str(tmp_path / "csv")], spark)[0]["total_pairs"]
    grades = {"q": [{"work_id": f"w{i}", "grade": i % 3} for i in range(5)]}
    (tmp_path / "g.json").write_text(json.dumps(grades))
    (tmp_path / "ranks.json").write_text(json.dumps({"a": {"q": ["w2", "w1"]}, "b": {"q": ["w0", "w2"]}}))
    for job in ("evaluate", "thresholds"):
        cli.main([job, "--judgments", str(tmp_path / "g.json"), "--rankings", str(tmp_path / "ranks.json"), "--out", str(tmp_path / f"{job}.json")], spark)
        assert json.loads((tmp_path / f"{job}.json").read_text())
    cli.main(["label", "--judgments", str(tmp_path / "g.json"), "--pooled", str(tmp_path / "p.json"), "--out", str(tmp_path / "l.json")], spark)
    assert len(json.loads((tmp_path / "l.json").read_text())) == 5 and json.loads((tmp_path / "l.meta.json").read_text())["rows"] == 5
    cli.main(["judge", "--pooled", "x", "--agreement", str(tmp_path / "g.json"), str(tmp_path / "g.json"), "--out", str(tmp_path / "agree.json")], spark)
    assert json.loads((tmp_path / "agree.json").read_text())[0]["raw_agreement"] == 1.0
    assert scratch_root(spark)
