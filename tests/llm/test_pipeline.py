"""The pipeline against its operators, applied one by one to collected rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from brindle.llm import mixing, packing, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "packing"] and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = simhash.Scratch(spark, "test-pipeline")
    outs = []
    now = docs
    for name, stage in P.STAGES:
        now = scratch.save(stage(spark, now, SF))
        outs.append(now)
        if name != "packing":
            assert now.columns == docs.columns
    rejected = {r["doc_id"] for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    first = {r["doc_id"] for r in outs[0].collect()}
    assert first == {r["doc_id"] for r in docs.collect()} - rejected
    best = {}
    for r in outs[0].collect():
        k = "".join(r["text"].split(" ")).translate(str.maketrans("", "", "\t\n\x0b\x0c\r"))
        best[k] = min(best.get(k, (1, 0)), (-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in outs[1].collect()} == {v[1] for v in best.values()}
    rows = sorted(outs[1].collect(), key=lambda r: r["doc_id"])
    sets = [set(simhash.shingles_of(r["text"]).tolist()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    assert {r["doc_id"] for r in outs[2].collect()} == {min(rows[k]["doc_id"] for k in range(len(rows)) if group[k] == g) for g in set(group)}
    words = lambda df: df.select(F.sum(mixing.word_count(F.col("text")))).first()[0] or 0
    assert words(outs[3]) == mixing.mix_report(outs[2]).agg(F.sum("taken")).first()[0]
    tok = packing.WordTokenizer(packing.default_tokenizer())
    assert outs[4].agg(F.sum("length")).first()[0] == sum(len(tok.ids(r["text"])) // 4 + 1 for r in outs[3].collect())
    assert P.run(spark, SF).count() == outs[4].count()


def test_wide_fingerprint_against_loops():
    rng = np.random.default_rng(6)
    for n in (1, 4, 255, 700, 255 * 256 + 3):
        shingles = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        h = simhash._MULTIPLIERS * shingles
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        want = [sum(1 << b for b in range(64) if 2 * int(((w >> np.uint64(b)) & np.uint64(1)).sum()) > n) for w in h]
        assert simhash.wide_fingerprint(shingles).tolist() == want


def test_near_stage_gets_its_pairs_from_the_grid_of_segment_counts(spark, monkeypatch):
    for name, value in (("CELL", 8), ("WIDE_BLOCK", 16), ("ROUND", 7)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(8)
    texts = []
    for base in range(100):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 60 + base)]
        at = rng.choice(len(words) - 10, 1)[0] + 5
        texts += [" ".join(words), " ".join([*words[:at], f"x{base}", *words[at + 1 :]])]
    sets = [simhash.shingles_of(t) for t in texts]
    bits = np.array([simhash.wide_fingerprint(s) for s in sets])
    apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2, dtype=int)
    rows = [(k, len(s), *(simhash._signed(int(w)) for w in b)) for k, (s, b) in enumerate(zip(sets, bits, strict=True))]
    scratch = simhash.Scratch(spark, "test")
    known = scratch.save(spark.createDataFrame(rows, "id long, many long, w0 long, w1 long, w2 long, w3 long"))
    tables = simhash.near_tables(len(rows))
    assert len(tables) > simhash.ROUND and len(tables[0]) == 3
    cells = {}
    for r in simhash.near_cells(known, list(enumerate(tables))).collect():
        cells.setdefault(r["cell"], set()).add(r["id"])
    counts = np.array([[(int(w) >> (2 * s) & 3).bit_count() for w in b for s in range(32)] for b in bits])
    want = {frozenset(np.flatnonzero((counts[:, c] == row).all(axis=1)).tolist()) for c in tables for row in counts[:, c]}
    assert {frozenset(c) for c in cells.values()} == want and max(map(len, cells.values())) > simhash.WIDE_BLOCK
    group = {r["id"]: r["cell"] for r in simhash.similar_fingerprints(scratch, known, len(rows)).collect()}
    root = np.arange(len(rows))
    for i, j in zip(*np.nonzero(apart <= simhash.NEAR_LIMIT), strict=True):
        root[root == root[i]] = root[j]
    assert group and all(root[k] == root[v] for k, v in group.items())
    near = [k for k in range(0, len(sets), 2) if simhash.is_near(sets[k], sets[k + 1])]
    assert len(near) > 50 and all(group[k] == group[k + 1] for k in near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.drop_similar(docs).collect()} == set(range(len(texts))) - {k + 1 for k in near}
    # no pair comes by another way
    found = simhash.similar_fingerprints
    monkeypatch.setattr(simhash, "similar_fingerprints", lambda *a: found(*a).limit(0))
    assert simhash.drop_similar(docs).count() == len(texts)


def test_near_stage_has_its_own_similarity(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "NEAR_BLOCK", 16)
    rng = np.random.default_rng(4)
    rows, sets = [], []
    for base in range(6):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        for k in range(20):
            now = list(words)
            for at in rng.choice(300, k % 10, replace=False):
                now[at] = f"x{base}-{k}-{at}"
            rows.append((len(rows), " ".join(now)))
            sets.append({tuple(now[i : i + 5]) for i in range(296)})
    group = list(range(len(rows)))
    far = 0
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                far += bin(simhash.fingerprint_of(rows[a][1]) ^ simhash.fingerprint_of(rows[b][1])).count("1") > 3
                group = [group[b] if g == group[a] else g for g in group]
    assert far > 100
    got = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {min(i for i in range(len(rows)) if group[i] == g) for g in set(group)}


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 701}" for i in range(30_000))
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n", "en", None, 3), (None, "orphan words here", None, None, None), (4, long, "de", "b", len(long)), (5, long + " ", "de", "b", 0), (6, "same text twice", "en", "a", 15), (6, "same text twice", "en", "a", 15), (7, "ünï ½ 日本語 \u0301", "fr", "c", 9)]
    rows += [(100 + i, " ".join(f"t{i}x{j}" for j in range(40 + i)), "en", f"s{i % 3}", 1) for i in range(20)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, names).selectExpr("*", "77 AS row", "doc_id AS __row", "'x' AS Number", "1.5D AS number_", "array(1) AS parts", "true AS whole", "source AS fp", "0 AS s", "0 AS p")


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_documents(spark, tmp_path, empty):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(100 + i, 1, int(i % 4 == 0)) for i in range(20)] + [(None, None, None), (4, None, None)], "doc_id long, quality int, toxic int")
    if empty:
        docs, labels = docs.limit(0), labels.limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    scratch = simhash.Scratch(spark, "odd")
    for name, stage in P.STAGES:
        now = scratch.save(stage(spark, now, str(tmp_path)))
        counts.append(now.count())
        if name != "packing":
            assert now.columns == before.columns and now.schema["number_"].dataType.simpleString() == "double"
    if empty:
        assert counts == [0] * 5
        return
    assert counts[0] >= counts[1] >= counts[2] > 10 and counts[4] >= 1
    kept = [r.asDict() for r in scratch.save(P.exact(spark, before, str(tmp_path))).collect()]
    assert len(kept) == 29 - 2 - 1 - 1 and all(r["row"] == 77 and r["__row"] == r["doc_id"] for r in kept)
    assert P.run(spark, str(tmp_path)).count() == counts[4]
