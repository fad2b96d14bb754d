"""Cases of the library that SQL doesn't check, and properties of its plans."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import querygen as G
from brindle.functions import text as X
from brindle.functions.judging import vote
from brindle.functions.rag import unsupported_titles
from brindle.operators import agreement, bootstrap, dense, etl, language, metrics, ranking, sampling, sparse, spelling
from brindle.plans import more_queries, queries
from brindle.plans.engine import Engine, Index, build_index, lexical_scorer, model_scorer, text_index, understand
from brindle.sources import tables

SF = "/root/testdata/sf0.001"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("raw, out", [
    ("itâ\u0080\u0099s", "it’s"), ("a\r\n\r\n\r\n\r\nb  c \nd", "a\n\nb c\nd"), ("  x ", "x"), (None, None), ("", ""),
    ("T by A 4.5 10 reviews " + "w" * 51, "w" * 51), ("10 reviews short", "10 reviews short")])
def test_clean_description(spark, raw, out):
    assert one(spark, X.clean_description, raw) == out


def test_header_is_cut_at_the_first_count(spark):
    rest = "then 7 reviews follow and this text goes on for long enough to stay"
    assert one(spark, X.clean_description, "1 review " + rest) == rest


@pytest.mark.parametrize("raw, out", [("a, b,a,,c...,d…, e", ["a", "b", "e"]), (None, []), (",".join("abcdefghij"), list("abcdefgh"))])
def test_split_list(spark, raw, out):
    assert one(spark, lambda c: X.split_list(c, 8), raw) == out


def test_usable_and_boilerplate(spark):
    rows = [("t", "a", "x" * 30), ("t", "a", "x" * 29), (" ", "a", "x" * 40), ("t", "a", "No description available" + " ." * 10), ("t", None, "x" * 40), ("t", "a", "   no synopsis available!!!      ")]
    df = spark.createDataFrame(rows, "t string, a string, d string").select(X.usable(F.col("t"), F.col("a"), F.col("d")).alias("u"))
    assert [r["u"] for r in df.collect()][:3] == [True, False, False]
    assert not df.collect()[4]["u"] and not df.collect()[5]["u"]


@pytest.mark.parametrize("name, out", [("Dr. Jane  Doe", "jane doe"), ("Prof Sir X", "x"), (" Lady Ada ", "ada"), ("Drew", "drew")])
def test_authors(spark, name, out):
    assert one(spark, G.normalize_author, name) == out


@pytest.mark.parametrize("samples, grade", [([2, 2, 1], 2), ([0, 0, 1, 1], 0), ([2, 1, 0], None), ([2, 1, 0, 2, 1], 1), ([2, 1, 0, 1, 1], 1), ([], None)])
def test_votes(spark, samples, grade):
    assert one(spark, vote, samples, "array<int>")["grade"] == grade


def test_kappa_and_alpha(spark):
    a, b = [0, 0, 1, 1, 2, 2, 0, 1, 2, 0], [0, 1, 1, 1, 2, 0, 0, 2, 2, 0]
    row = agreement.agreement(spark.createDataFrame(list(zip(a, b)), "a int, b int")).first()
    assert row["n"] == 10 and row["kappa"] == round(0.36 / 0.66, 4) and row["raw_agreement"] == 0.7
    none = agreement.agreement(spark.createDataFrame([], "a int, b int")).first()
    assert none["n"] == 0 and none["kappa"] is None


def test_ranking_is_the_same_however_rows_are_dealt(spark):
    rows = [(0, f"w{i:02d}", 0.125) for i in range(12)] + [(0, "wz", 1.0), (0, "wy", 0.5833334)]
    want = None
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "qid int, key string, score double").repartition(seed + 1)
        got = [r["key"] for r in ranking.top_k(df, 10, ["qid"]).orderBy("rank").collect()]
        want = want or got
        assert got == want and got[:2] == ["wz", "wy"]


@pytest.mark.parametrize("k, base, scores", [(2, 0, [1.0, 1 / 3 + 1 / 4]), (60, 1, [2 / 61, 1 / 62 + 1 / 63])])
def test_fusion(spark, k, base, scores):
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "qid int, key string, rank int")
    b = spark.createDataFrame([(0, "x", 1), (0, "y", 3)], "qid int, key string, rank int")
    got = {r["key"]: r["score"] for r in ranking.reciprocal_rank_fusion([a, b], ["qid"], k=k, rank_base=base).collect()}
    assert got["x"] == pytest.approx(scores[0]) and got["y"] == pytest.approx(scores[1])


def test_vector_search_matches_numpy_whatever_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    docs = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "key long, vector array<double>").repartition(5)
    asked = docs.where("key < 7").withColumnRenamed("key", "qid")
    want = {q: [int(i) for i in np.lexsort((np.arange(60), -np.round(x[q] @ x.T, 10)))[:5]] for q in range(7)}
    for block, rows, most in ((3, 7, 64 << 20), (4096, 2048, 64 << 20), (3, 7, 0)):
        monkeypatch.setattr(dense, "QUERY_BLOCK", block)
        monkeypatch.setattr(dense, "SCORE_ROWS", rows)
        monkeypatch.setattr(dense, "MAX_QUERY_BYTES", most)
        got = {}
        for r in dense.vector_top_k(docs, asked, 5).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["key"])
        assert got == want
    assert dense.vector_top_k(docs, asked.where("qid < 0"), 5).count() == 0


def test_keyword_plan_broadcasts_queries_and_cuts_early(spark):
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = sparse.keyword_top_k(d, b.select(F.col("item_id").alias("qid"), F.col("text").alias("query")), 10, key="doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_empty_query_has_no_hits(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert sparse.keyword_top_k(d, spark.createDataFrame([(0, "*")], "qid int, query string"), 5, key="doc_id").count() == 0


def test_unique_ids_and_pool(spark):
    ids = etl.unique_ids(spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "a")], "row_idx long, work_id string"))
    assert sorted(r["work_id"] for r in ids.collect()) == ["a", "a-2", "a-3", "b"]
    lists = [spark.createDataFrame(x, "query string, work_id string, rank int") for x in ([("q", "x", 1), ("q", "y", 2)], [("q", "y", 1), ("q", "z", 2)])]
    assert [r["work_id"] for r in etl.pool(lists).orderBy("pos").collect()] == ["x", "y", "z"]


def test_metrics_case(spark):
    rankings = spark.createDataFrame([("m", "q", 1, "a"), ("m", "q", 2, "b"), ("m", "q", 3, "c")], "mode string, query string, rank int, work_id string")
    grades = spark.createDataFrame([("q", "b", 2), ("q", "d", 1), ("q", "a", 0), ("q", "c", None)], "query string, work_id string, grade int")
    m = metrics.query_metrics(rankings, grades).first()
    ideal = 2 + 1 / np.log2(3)
    assert m["mrr"] == 0.5 and m["recall"] == 0.5 and m["precision"] == 0.1 and m["ndcg"] == pytest.approx(2 / np.log2(3) / ideal)


def test_bootstrap_is_reproducible(spark):
    rows = [("m", f"q{i:02d}", i / 30, i / 40, i / 50) for i in range(30)]
    df = spark.createDataFrame(rows, "mode string, query string, mrr double, ndcg double, recall double")
    a, b = (bootstrap.mode_intervals(df.repartition(n), ["m"], 200).orderBy("metric").collect() for n in (1, 7))
    assert a == b
    rng = np.random.default_rng(42)
    low, high = bootstrap.percentile_ci(np.array([r[2] for r in rows]), rng, 200)
    assert [r for r in a if r["metric"] == "mrr"][0]["low"] == round(float(low), 4)


def test_other_intervals_against_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(m, f"q{i:02d}", float(rng.random()), float(rng.random()), float(rng.random()), "ab"[i % 2]) for m in ("x", "y") for i in range(12)]
    df = spark.createDataFrame(rows, "mode string, query string, mrr double, ndcg double, recall double, category string")
    by = {(r[0], r[1]): r for r in rows}
    qs = sorted({r[1] for r in rows})
    deltas = {k: np.array([by["y", q][c] - by["x", q][c] for q in qs]) for k, c in (("ndcg", 3), ("mrr", 2))}
    draws = np.random.default_rng(1000).integers(0, 12, (300, 12))
    for r in bootstrap.paired_intervals(df.repartition(5), [("y", "x")], 300).collect():
        d = deltas[r["metric"]]
        boots = np.array([sum(d[j] for j in one) / 12 for one in draws])
        low, high = np.percentile(boots, [2.5, 97.5])
        want = (boots <= 0).mean() if d.mean() > 0 else (boots >= 0).mean()
        assert (r["low"], r["high"], r["delta"]) == (round(low, 4), round(high, 4), round(d.mean(), 4)) and r["p_opposite"] == round(want, 4) and r["significant"] == (low > 0 or high < 0) and r["low_n"]
    for r in bootstrap.category_intervals(df, "y", "x", ["a", "b"], 300).collect():
        mine = [q for q in qs if by["x", q][5] == r["name"]]
        d = np.array([by["y", q][3] - by["x", q][3] for q in mine])
        g = np.random.default_rng(2000 + "ab".index(r["name"]))
        low, high = np.percentile([d[g.integers(0, 6, 6)].mean() for _ in range(300)], [2.5, 97.5])
        assert (r["low"], r["high"], r["n_queries"]) == (round(low, 4), round(high, 4), 6)
    for r in bootstrap.index_percentile_intervals(df, "mrr", 7, 300).collect():
        v, g = [by[r["mode"], q][2] for q in qs], random.Random(7)
        means = sorted(sum(v[g.randrange(12)] for _ in range(12)) / 12 for _ in range(300))
        assert (r["low"], r["high"]) == (round(means[7], 4), round(means[292], 4))


def test_language_profiles(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    find = language.detect(language.fit_profiles(d.where("doc_id % 5 <> 0")))
    held = d.where("doc_id % 5 = 0 and length(text) > 40").select("lang", find(F.col("text")).alias("found")).collect()
    assert np.mean([r["lang"] == r["found"] for r in held]) > 0.95
    odd = spark.createDataFrame([(None,), ("",), ("12 !",)], "t string").select(find(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in odd] == [None] * 3


@pytest.mark.parametrize("raw, out", [("caf\u00c3\u00a9 \u00e2\u20ac\u201c x", "caf\u00e9 \u2013 x"), ("\u00c3\u0192\u00c2\u00a9", "\u00e9"), ("caf\u00e9 \u00c2 5", "caf\u00e9 \u00c2 5"), (None, ""), ("plain", "plain")])
def test_repair(spark, raw, out):
    assert one(spark, X.repair_text, raw) == out


def test_gate(spark):
    cur = spark.createDataFrame([("hybrid", 0.80), ("keyword", 0.1)], "mode string, accuracy_at_1 double")
    base = spark.createDataFrame([("hybrid", 0.86), ("keyword", 0.9)], "mode string, accuracy_at_1 double")
    assert {r["mode"]: r["passed"] for r in metrics.gate(cur, base, ["hybrid"], 5).collect()} == {"hybrid": False, "keyword": True}
    assert all(r["passed"] for r in metrics.gate(cur, base, ["hybrid"], 7).collect())
    assert metrics.gate_problems(["hybrid"], ["vector"], ["hybrid"], True, True)


def test_spelling(spark):
    words = spark.createDataFrame([("like", 100), ("lake", 50), ("dune", 10), ("the", 9)], "term string, freq long")
    q = spark.createDataFrame([(1, "liek Dune"), (2, "xx 1999 zzzzzzzz"), (3, ""), (4, "The LAKE")], "qid int, query string")
    got = {r["qid"]: (r["corrected"], r["was_corrected"]) for r in spelling.correct(q, words).collect()}
    assert got == {1: ("like Dune", True), 2: ("xx 1999 zzzzzzzz", False), 3: ("", False), 4: ("The LAKE", False)}
    assert one(spark, lambda c: spelling.osa_distance(c, F.lit("abc")), "ca") == 3


def test_spelling_by_bytes(spark):
    pairs = spark.createDataFrame([("ca", "abc", 2), ("ñ", "n", 2), ("ñadobo", "adobo", 2), ("ñadobo", "ñadoco", 1), ("é", "è", 1), ("", "ab", 2), ("same", "same", 0)], "a string, b string, d int")
    assert all(r["d"] == r["o"] for r in pairs.select("d", spelling.byte_distance("a", "b").alias("o")).collect())
    words = spark.createDataFrame([("adobo", 1), ("ñadoco", 1)], "term string, freq long")
    q = spark.createDataFrame([(1, "ñadobo")], "qid int, query string")
    assert spelling.correct(q, words).first()["corrected"] == "adobo"
    assert spelling.correct(q, words, measure=spelling.byte_distance).first()["corrected"] == "ñadoco"


def test_every_item_is_spelled(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {r["qid"] for r in queries.spell_queries(spark, SF).select("qid").collect()}
    assert got == {r["item_id"] for r in items.collect()} and "% 100" not in queries.SQL["spell_queries"]


def test_embedding_cost_is_linear_and_vectors_are_units(spark):
    words = spark.createDataFrame([(i, " ".join(f"word{i * j}" for j in range(200))) for i in range(40)] + [(40, None), (41, "")], "i int, t string")
    for dim in (16, 256):
        v = np.array([r["v"] for r in words.select(dense.truncate(dense.hashed_embedding(F.col("t"), dim), dim).alias("v"), "i").orderBy("i").collect()])
        norms = np.linalg.norm(v, axis=1)
        assert v.shape == (42, dim) and np.allclose(norms[:40], 1) and not norms[40:].any()
    again = dense.word_hash_model(16)(["a b a", "b a a", ""])
    assert (again[0] == again[1]).all() and not again[2].any()


def test_longest_run_has_no_bound(spark):
    shared = " ".join(f"w{i}" for i in range(150))
    df = spark.createDataFrame([(f"x {shared} y", f"start {shared} end {shared}"), ("a b c", "c b a"), ("", "a"), ("a", None)], "q string, d string")
    assert [r["n"] for r in df.select(G.longest_shared_run(F.col("q"), F.col("d")).alias("n")).collect()] == [150, 1, 0, 0]


def test_suggestions(spark):
    words = spark.createDataFrame([("space", 100), ("ship", 50), ("dune", 10), ("wardrobe", 9)], "term string, freq long")
    q = spark.createDataFrame([(1, "spaceship dune"), (2, "ward robe"), (3, "dune"), (4, "spce")], "qid int, query string")
    got = {(r["qid"], r["suggestion"]) for r in spelling.suggest(q, words).collect()}
    assert {(1, "space ship dune"), (2, "wardrobe"), (4, "space")} <= got and not any(i == 3 for i, _ in got)
    assert max(r["place"] for r in spelling.suggest(q, words, 1).collect()) == 1


def test_percentile_by_index(spark):
    rng = random.Random(5)
    rows = [(g, rng.randrange(9)) for g in "ab" for _ in range(rng.randrange(1, 30))] + [("c", None)]
    for p in (0.0, 0.5, 0.9, 1.0):
        got = {r["g"]: r["v"] for r in sampling.percentile_by_index(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", p).collect()}
        for g in "ab":
            v = sorted(x for k, x in rows if k == g)
            assert got[g] == v[min(int(len(v) * p), len(v) - 1)]
        assert set(got) == {"a", "b"}


def test_trials_meet_the_closed_form(spark):
    pools = spark.createDataFrame([("a", 20, 3), ("b", 5, 5), ("c", 30, 0)], "query string, pool int, relevant int")
    got = {r["query"]: r["random_mrr"] for r in metrics.random_mrr_trials(pools, 4000).collect()}
    want = {r["query"]: r["m"] for r in pools.select("query", metrics.random_mrr(F.col("pool"), F.col("relevant")).alias("m")).collect()}
    assert all(got[q] == pytest.approx(want[q], abs=0.02) for q in want) and got["b"] == 1.0 and got["c"] == 0.0


def test_block_search_is_keyword_search(spark, monkeypatch):
    monkeypatch.setattr(sparse, "QUERY_BLOCK", 7)
    monkeypatch.setattr(sparse, "SCORE_ROWS", 9)
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randrange(60)))) for i in range(90)] + [(90, None), (91, "only here"), (92, "only here")], "key long, text string")
    asked = docs.where("key % 4 = 3").selectExpr("key AS qid", "text AS query").unionByName(spark.createDataFrame([(500, "unseen"), (501, "")], "qid long, query string"))
    counts = sparse.term_counts(docs, "key", F.col("text"))
    voc = sparse.fit_vocabulary(counts, docs.count())
    want = sparse.search(sparse.weigh(counts, voc, "key"), voc, asked, 5)
    for most in (sparse.MAX_QUERY_BYTES, 0):
        monkeypatch.setattr(sparse, "MAX_QUERY_BYTES", most)
        for share in (0, 8, 10**9):
            monkeypatch.setattr(sparse, "DENSE_SHARE", share)
            got = sparse.block_search(sparse.weighted_rows(counts, voc, "key"), voc, asked, 5)
            assert {(r["qid"], r["rank"], r["key"], round(r["score"], 8)) for r in got.collect()} == {(r["qid"], r["rank"], r["key"], round(r["score"], 8)) for r in want.collect()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (term" not in plan.split("MapInArrow")[0]


def test_text_search_is_keyword_search(spark, monkeypatch):
    monkeypatch.setattr(sparse, "QUERY_BLOCK", 7)
    monkeypatch.setattr(sparse, "SCORE_ROWS", 9)
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randrange(60)))) for i in range(90)] + [(90, None), (91, "only here"), (92, "only here"), (93, "")]
    asked = spark.createDataFrame([(i, t) for i, t in rows if i % 4 == 3] + [(500, "unseen"), (501, ""), (502, None), (503, "W7 w7, only w3!")], "qid long, query string")
    for more in ([], [(5, "w1 only"), (5, None), (7, "seven")]):  # a key in several rows is one document
        docs = spark.createDataFrame(rows + more, "key long, text string").repartition(5)
        counts = sparse.term_counts(docs, "key", F.col("text"))
        voc = sparse.fit_vocabulary(counts, docs.count())
        want = {(r["qid"], r["rank"], r["key"]): pytest.approx(r["score"], abs=1e-9) for r in sparse.search(sparse.weigh(counts, voc, "key"), voc, asked, 5).collect()}
        terms = sparse.text_vocabulary(docs, "key", F.col("text"))
        assert terms.count() == voc.count()
        for most in (2_000_000, 20, 0):
            monkeypatch.setattr(sparse, "TERMS_SENT", most)
            got = sparse.text_search(docs, terms, asked, 5, "key", F.col("text"))
            assert {(r["qid"], r["rank"], r["key"]): r["score"] for r in got.collect()} == want
        none = sparse.text_search(docs.where("false"), sparse.text_vocabulary(docs.where("false"), "key", F.col("text")), asked, 5, "key", F.col("text"))
        assert none.count() == 0 and sparse.text_search(docs, terms, asked.where("false"), 5, "key", F.col("text")).count() == 0


def test_known_items_need_no_postings(spark, monkeypatch):
    monkeypatch.setattr(queries, "stored_index", None)
    assert queries.known_item_acc(spark, SF).first()["total"] > 0


def test_known_item_classes_need_no_postings(spark, monkeypatch):
    monkeypatch.setattr(queries, "stored_index", None)
    assert sum(r["total"] for r in queries.known_item_by_class(spark, SF).collect()) == spark.read.parquet(f"{SF}/benchmark.parquet").count()


def test_gate_needs_no_postings(spark, monkeypatch):
    monkeypatch.setattr(queries, "stored_index", None)
    assert queries.gate_check(spark, SF).first()["mode"] == "keyword"


def test_engine_search_needs_no_postings(spark, monkeypatch):
    monkeypatch.setattr(sparse, "weigh", None)
    found = more_queries.engine_search(spark, SF)
    assert found.count() > 0 and {r["rank"] for r in found.collect()} == set(range(1, 11))


def test_text_engine_is_the_stored_engine(spark, tmp_path):
    rows = [(f"gr:{i}", f"Title {w}", ["Ann Lee"], f"a tale of {w} and {v} told in full", ["Fiction"], 1990 + i, None, None, 1 + i % 3) for i, (w, v) in enumerate([("dragons", "kings"), ("ships", "storms"), ("gardens", "bees"), ("dragons", "bees")])]
    books = spark.createDataFrame(rows, "work_id string, title string, authors array<string>, description string, subjects array<string>, first_publish_year int, cover_id int, isbn string, tier int")
    embed = lambda c: dense.hashed_embedding(c, 64)
    vectors = books.select("work_id", embed(F.concat_ws(" ", "title", "description")).alias("embedding"))
    build_index(books, vectors).save(str(tmp_path / "index"))
    stored, texts = Engine(Index.load(spark, str(tmp_path / "index")), embed, scorer=lexical_scorer), Engine(text_index(books, vectors), embed, scorer=lexical_scorer)
    q = spark.createDataFrame([(1, "dragons and bees"), (2, "unseen")], "qid int, query string")
    for asked in ({"mode": "keyword"}, {"tier": 1}, {"rerank": True, "explain": True}):
        a, b = (sorted(e.search(q, 3, **asked).drop("score").collect()) for e in (stored, texts))
        assert a == b and a
    assert texts.health()["status"] == "ok" and texts.ready() and texts.stats() == stored.stats()


def test_difficulties_need_no_postings(spark, monkeypatch):
    monkeypatch.setattr(queries, "stored_index", None)
    found = more_queries.difficulties(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0 and "SortMergeJoin" not in plan


def test_vectors_need_no_postings(spark, monkeypatch):
    monkeypatch.setattr(queries, "stored_index", None)
    assert queries.vector_topk(spark, SF).count() > 0


def test_grades_are_counted_where_they_are(spark):
    rng = random.Random(8)
    rows = [(f"q{q}", f"w{w}", rng.choice([0, 0, 1, 2, 3, None])) for q in range(5) for w in range(q * 9)] + [("none", "w", None), ("zero", "w", 0)]
    grades = spark.createDataFrame(rows, "query string, work_id string, grade int")
    got = {r["query"]: (r["idcg"], r["relevant_total"]) for r in metrics.ideal_dcg(grades, 10).collect()}
    assert set(got) == {q for q, _, g in rows if g is not None}
    for q in got:
        best = sorted((g for x, _, g in rows if x == q and g is not None), reverse=True)
        assert got[q] == (pytest.approx(sum(g / np.log2(i + 2) for i, g in enumerate(best[:10]))), sum(g > 0 for g in best))
    ranked = spark.createDataFrame([("m", "q4", i, f"w{i}") for i in range(1, 9)] + [("m", "new", 1, "w1")], "mode string, query string, rank int, work_id string")
    judged = metrics.judged(ranked, grades)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and judged.count() == 9
    assert "Window" in metrics.ideal_dcg(grades)._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [query")[1]


def test_trials_of_a_large_pool(spark):
    pools = spark.createDataFrame([(f"q{i}", 50_000_000, 25_000_000) for i in range(4)], "query string, pool int, relevant int")
    began = time.perf_counter()
    got = {r["query"]: r["random_mrr"] for r in metrics.random_mrr_trials(pools, 4000).collect()}
    want = pools.select(metrics.random_mrr(F.col("pool"), F.col("relevant")).alias("m")).first()["m"]
    assert all(v == pytest.approx(want, abs=0.03) for v in got.values()) and len(set(got.values())) > 1
    assert time.perf_counter() - began < 60
    assert got == {r["query"]: r["random_mrr"] for r in metrics.random_mrr_trials(pools, 4000).collect()}


def test_citations(spark):
    answer = 'I like **Dune** and _Emma Woods_, "[2] The Lost One" and "ok".'
    assert one(spark, lambda c: unsupported_titles(c, F.array(F.lit("Dune Messiah"), F.lit("emma woods"))), answer) == ["[2] The Lost One"]


def test_query_sets(spark):
    rows = [(f"w{i}", f"The Long Title Number {i} Of Things", [f"Author Name{i % 5}"], ["History", "Science"], f"Some text number {i}. " * 8, 1900 + i) for i in range(40)]
    b = spark.createDataFrame(rows, "work_id string, title string, authors array<string>, subjects array<string>, description string, first_publish_year int")
    a = sampling.query_set(b, 10, 3)
    assert a == sampling.query_set(b.repartition(3), 10, 3) and 0 < len(a) <= 10 and len({r["work_id"] for r in a}) == len(a)
    assert sum(sampling.category_counts(50).values()) == 50
    assert sampling.known_items(b, 5).count() == 5
    assert sampling.author_gold(b.limit(1), sampling.author_index(b)).first()["gold_work_ids"] == [f"w{i}" for i in sorted(range(0, 40, 5), key=lambda i: f"w{i}")]


def test_engine_round_trip(spark, tmp_path):
    rows = [(f"gr:{i}", f"Title {w}", ["Ann Lee"], f"a tale of {w} and {v} told in full", ["Fiction"], 1990 + i, None, None, 1 + i % 3) for i, (w, v) in enumerate([("dragons", "kings"), ("ships", "storms"), ("gardens", "bees"), ("dragons", "bees")])]
    books = spark.createDataFrame(rows, "work_id string, title string, authors array<string>, description string, subjects array<string>, first_publish_year int, cover_id int, isbn string, tier int")
    embed = lambda c: dense.hashed_embedding(c, 64)
    vectors = books.select("work_id", embed(F.concat_ws(" ", "title", "description")).alias("embedding"))
    build_index(books, vectors).save(str(tmp_path / "index"))
    engine = Engine(Index.load(spark, str(tmp_path / "index")), embed, scorer=lexical_scorer)
    q = spark.createDataFrame([(1, "dragons and bees")], "qid int, query string")
    for mode in ("hybrid", "keyword", "vector"):
        hits = engine.search(q, 2, mode, rerank=True).orderBy("rank").collect()
        assert hits[0]["work_id"] == "gr:3" and len(hits) == 2
    assert [r["work_id"] for r in engine.search(q, 5, "keyword", year_max=1991).collect()] and engine.search(q, 5, "keyword", year_max=1980).count() == 0
    assert engine.compare(q, 2).count() == 6 and engine.stats()["points"] == 4
    assert "keyword_rank" in engine.search(q, 2, explain=True).columns
    for bad in ({"mode": "x"}, {"top_k": 0}, {"tier": 4}):
        with pytest.raises(ValueError):
            engine.search(q, **bad)
    ask = engine.ask(spark.createDataFrame([(1, "dragons?"), (2, "")], "qid int, question string"), lambda question, context: F.lit('Read **Title dragons** and "Nothing Known"'), mode="keyword")
    got = {r["qid"]: r for r in ask.collect()}
    assert got[1]["hallucinated_titles"] == ["Nothing Known"] and not got[1]["citations_valid"] and got[2]["citations_valid"]
    u = understand(q.withColumn("query", F.lit("novels by Jane Austen"))).first()
    assert u["intent"] == "author" and u["corrected"] == "novels by Jane Austen"


@pytest.mark.parametrize("batch", [1, 3, 100])
def test_scorer_keeps_places(spark, batch):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([7, 3, 19, 1, 5, 12, 2, 25, 4, 9])], "i int, p string")
    score = model_scorer(lambda q, p: [float(len(x)) for x in p], batch)
    assert all(r["s"] == len(r["p"]) for r in df.select("p", score(F.lit("q"), F.col("p")).alias("s")).collect())


def test_tables(spark, tmp_path):
    with pytest.raises(FileExistsError):
        tables.guard("data/results_v1.json")
    d = spark.createDataFrame([("b", 2), ("a", 1)], "term string, freq long")
    tables.write_dictionary(d, str(tmp_path / "d"))
    assert sorted(map(tuple, tables.dictionary(spark, str(tmp_path / "d")).collect())) == [("a", 1), ("b", 2)]
    (tmp_path / "j.json").write_text('{"q": [{"work_id": "a", "grade": 0, "relevance": 2}, {"work_id": "b", "relevance": null}]}')
    assert [r["grade"] for r in tables.judgments(spark, str(tmp_path / "j.json")).orderBy("pos").collect()] == [0, None]
    (tmp_path / "bad.json").write_text("{not json")
    assert tables.judgments(spark, str(tmp_path / "bad.json")).count() == 0
    np.savez(tmp_path / "b0.npz", embeddings=np.ones((2, 3), np.float32), work_ids=np.array(["x", "y"]), start_idx=5)
    assert sorted((r["work_id"], r["start_idx"]) for r in tables.npz_shards(spark, str(tmp_path)).collect()) == [("x", 5), ("y", 5)]
    assert tables.synthetic_pool(spark).count() == 40
    tables.write_shards(spark.createDataFrame([("b1", "x")], "batch_id string, work_id string"), str(tmp_path / "s"))
    for _ in range(2):
        tables.write_shards(spark.createDataFrame([("b2", "y")], "batch_id string, work_id string"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_stream_replays_replace(spark, tmp_path):
    from brindle.streaming.embedding import enqueue, start

    b = spark.createDataFrame([(i, f"w{i}", "T", ["A"], "d" * i, ["S"], 1) for i in range(5)], "row_idx long, work_id string, title string, authors array<string>, description string, subjects array<string>, tier int")
    enqueue(b, str(tmp_path / "q"), size=2)
    for checkpoint in ("c1", "c2"):
        start(spark, str(tmp_path / "q"), str(tmp_path / "out"), str(tmp_path / checkpoint), lambda c: dense.hashed_embedding(c, 8), 8).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 4 and rows.select("batch_id").distinct().count() == 3  # the empty description isn't indexed

    with pytest.raises(Exception):
        start(spark, str(tmp_path / "q"), str(tmp_path / "o2"), str(tmp_path / "c3"), lambda c: F.raise_error("no model"), 8)


def test_index_validation(spark):
    books = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("c", "", 1)], "work_id string, description string, tier int")
    good = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "work_id string, embedding array<float>")
    etl.check_index(etl.validate_index(good, books, 2))
    for bad in ([("a", [1.0, 0.0])], [("a", [2.0, 0.0]), ("b", [0.0, 1.0])], [("a", [1.0, 0.0]), ("a", [1.0, 0.0])], [("a", [1.0, 0.0]), ("z", [1.0, 0.0])]):
        with pytest.raises(ValueError):
            etl.check_index(etl.validate_index(spark.createDataFrame(bad, "work_id string, embedding array<float>"), books, 2))
