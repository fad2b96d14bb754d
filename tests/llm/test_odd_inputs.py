"""Each operator on nulls in any column, empty and very long texts, ties, repeated rows, empty tables, and extra
columns whose names clash with those the operators use."""

import hashlib

import numpy as np
import pytest

from brindle.llm import embedding_dedup, exact_dedup, language_id, mixing, packing, simhash, substring_dedup, suffix_dedup, toxicity, warc

NAMES = ["row", "__row", "sha", "id", "fp", "cell", "number", "part", "parts", "whole", "kept", "size", "order", "mark", "spans", "content", "doc", "at", "s", "p", "Text2", "n", "vec", "low"]
CLASH = [f"{i} AS {c}" if i % 2 else f"'x{i}' AS {c}" for i, c in enumerate(NAMES)]
LONG = " ".join(f"wort{i % 1009} und" for i in range(40_000))
ROWS = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \t\r\n", "en", "b"), (None, "a text without an id", None, "a"), (4, LONG, "de", "b"), (5, LONG + "x", "de", "b"),
    (6, "tie one two three", "en", "a"), (7, "tie one two three", "en", "a"), (8, "tie one  two three", "en", "a"), (9, "same row", "en", "c"), (9, "same row", "en", "c"), (10, "½ ²³", "fr", "c"), (11, "퟿ \U0001f600 日本", "fr", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = ROWS + [(100 + i, f"these are the words of text {i} and no others. " * (i % 5 + 1), ("en", "de")[i % 2], f"s{i % 2}") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + i, i % 2) for i in range(40)] + [(None, 1), (101, None), (4, 1), (4, 0)], "doc_id long, toxic int").selectExpr("*", "1 AS quality", "'z' AS text")


OPERATORS = {
    "op1": lambda d, lab: substring_dedup.remove_repeats(d, "sentence", 25), "op2": lambda d, lab: language_id.identify(d), "op3": lambda d, lab: suffix_dedup.remove_repeated_bytes(d),
    "op6": lambda d, lab: simhash.simhash_groups(d), "op7": toxicity.toxicity_scores, "op8": lambda d, lab: exact_dedup.exact_dedup(d), "op9": lambda d, lab: mixing.mix_report(d), "op10": lambda d, lab: packing.pack_documents(d)}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(docs, labels, name):
    op = OPERATORS[name]
    got = op(docs, labels).collect()
    ids = sorted((str(r["doc_id"]) for r in got))
    if name == "op10":
        assert set(ids) == {str(r["doc_id"]) for r in docs.select("doc_id").collect()}
    else:
        assert ids == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    rows = {r["doc_id"]: r for r in got}
    if name == "op1":
        assert rows[1]["n_units"] == rows[2]["n_units"] == rows[3]["n_units"] == 0 and rows[5]["n_removed"] == 0
    if name == "op2":
        assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 10)) and rows[11]["lang_pred"] != "und"
    if name == "op3":
        assert rows[1]["n_bytes"] == 0 and rows[3]["n_bytes"] == 4 and rows[5]["n_removed"] == len(LONG) and rows[5]["n_bytes"] == len(LONG) + 1
    if name == "op6":
        assert {rows[i]["fingerprint"] for i in (1, 2, 3)} == {"0" * 16} and {rows[i]["component_id"] for i in (1, 2, 3)} == {1} and rows[7]["component_id"] == 6
    if name == "op7":
        base = rows[1]["score"]
        assert rows[2]["score"] == base == rows[3]["score"] and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert rows[None]["held_out"]
    if name == "op8":
        assert {rows[i]["keep_id"] for i in (6, 7, 8)} == {8} and {rows[i]["keep_id"] for i in (1, 2, 3)} == {3} and rows[3]["group_size"] == 3
        assert sum(r["kept"] for r in got if r["doc_id"] == 9) == 1 and rows[1]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    if name == "op9":
        assert rows[1]["size"] == rows[2]["size"] == rows[3]["size"] == rows[1]["taken"] == 0 and all(r["taken"] <= 3 * r["size"] for r in got) and rows[4]["size"] == 80_000
    if name == "op10":
        assert rows[1]["length"] == rows[2]["length"] == 1 and sum(r["length"] for r in got if r["doc_id"] == 4) > 80_000 and max(r["offset"] + r["length"] for r in got) <= 4096


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_documents(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [exact_dedup.drop_exact, simhash.drop_near, simhash.drop_similar, mixing.mix_documents])
def test_stages_keep_the_columns(docs, stage):
    got = stage(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        assert all(r[c] == (i if i % 2 else f"x{i}") for i, c in enumerate(NAMES))


def test_vectors(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=8).tolist()
    rows = [(1, v), (1, v), (2, [x * 1e200 for x in v]), (3, [x * 1e-200 for x in v]), (4, None), (5, []), (6, [0.0] * 8), (7, [1.0] * 7 + [None]), (8, [float("inf")] * 8), (9, v[:7]), (None, v), (10, [-x for x in v]), (11, [-0.0] * 7 + [1.0]), (12, [0.0] * 7 + [1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", *[c for c in CLASH if not c.endswith("AS vec")])
    got = embedding_dedup.embedding_groups(e, recall=0.999).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert by[1] == [(4, 1, True)] * 2 and by[2] == by[3] == [(4, 1, False)] and by[None] == [(4, 1, False)]
    assert all(by[i] == [(0, i, True)] for i in (4, 5, 6, 7, 8, 9, 10)) and by[11] == [(1, 11, True)] and by[12] == [(1, 11, False)]
    assert embedding_dedup.embedding_groups(e.limit(0)).count() == 0


def test_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300_000)  # several archives for each task
    pages = [(1, None, None), (2, "u", ""), (None, "u", "x"), (3, None, LONG), (4, "u", LONG), (5, "u", "y"), (5, "u", "y"), (6, "u", "y"), *((100 + i, "http://x", f"{i} {LONG[: 50_000]}") for i in range(20))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", *CLASH)
    got = warc.archive_round_trip(df.repartition(2), str(tmp_path / "w")).collect()
    assert len(got) == len(pages) and len(list((tmp_path / "w").glob("*.wacz"))) > 3
    rows = {r["page_id"]: r for r in got}
    assert rows[3]["refers_to"] == 4 and rows[3]["record_type"] == "revisit" and rows[4]["payload_bytes"] == len(LONG) and rows[1]["refers_to"] == 2 and rows[5]["refers_to"] == 6
    assert rows[None]["record_type"] == "response" and rows[100]["payload_digest"] == warc.payload_digest(f"0 {LONG[: 50_000]}".encode())
