"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows,
extra columns, and no rows at all."""

import gzip
import hashlib
import io
import random
import zipfile

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import embedding_dedup, language_id, mixing, packing, simhash, substring_dedup, suffix_dedup, toxicity, warc
from brindle.llm.exact_dedup import CuckooIndex, drop_exact, exact_dedup
from brindle.llm.induced_sort import suffix_order

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sha string, row string, kept string, size string"


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "w") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocab = ["alpha", "beta", "Gamma", "delta", "été", "straße", "niño", "omega", "zeta", "eta"]
    long = " ".join(rng.choice(vocab) for _ in range(60))
    near = long.replace("alpha", "kappa", 1)
    out = [
        (3, long, "a"), (5, long + "  ", "a"), (2, " " + long, "b"), (9, near, None), (10, "One line.\n" + long + "\nlast", "b"), (11, "one  LINE.\nother\n\n" + long.upper(), "c"),
        (7, None, "a"), (8, "", None), (12, " \t\n", "c"), (13, "x", "a"), (14, "Σ İ \x1c <|endoftext|> don't we'll 12 ½ ´é", "d"), (3, long, "a"), (15, "ab " * 900, "d"), (None, "orphan text", "e"),
        (16, "shti " * 120, "a"), (17, "q" * 400, "a"), (18, "y " * 5000, "f")]
    out += [(100 + i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 40))), f"s{i % 3}") for i in range(30)]
    return out


@pytest.mark.parametrize("kind, least", [("line", 1), ("sentence", 1), ("sentence", 12), ("paragraph", 3)])
def test_line_dedup(spark, rows, monkeypatch, kind, least):
    monkeypatch.setattr(substring_dedup, "FLUSH_BYTES", 500)
    shared = "This passage stands in two texts. It has several sentences, e.g. this one! Each is short"
    rows = [*rows, (60, f"Start here {shared}. And so on.", "a"), (61, f"Other words {shared} elsewhere.", "a"), (62, "It has several sentences, e.g. this one! Else.", "b"), (63, "Long. " * 9000, "b")]
    got = substring_dedup.remove_repeats(make_docs(spark, rows), kind, least).collect()
    assert len(got) == len(rows)
    seen, want = set(), []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        t, marks = t or "", []
        for s, e, words in substring_dedup.units_of(t, kind):
            u = b" ".join(words)
            marks.append((s, e, len(words), u in seen))
            seen.add(u)
        gone = []
        for k, m in enumerate(marks):
            lo = hi = k
            while lo > 0 and marks[lo - 1][3]:
                lo -= 1
            while hi + 1 < len(marks) and marks[hi + 1][3]:
                hi += 1
            if m[3] and sum(x[2] for x in marks[lo : hi + 1]) >= least:
                gone.append(m[:2])
        kept, at = "", 0
        for s, e in gone:
            kept, at = kept + t[at:s], e
        want.append((i, len(marks), [list(g) for g in gone], kept + t[at:]))
    key = lambda r: (r[0] is None, r[0] or 0, str(r[2]), r[3])
    assert sorted(((r["doc_id"], r["n_units"], [list(x) for x in r["spans"]], r["kept_text"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["n_removed"] == len(r["spans"]) and r["removed_chars"] == sum(x["end"] - x["start"] for x in r["spans"]) for r in got)
    assert substring_dedup.remove_repeats(make_docs(spark, rows).limit(0), kind, least).count() == 0


def test_units_tile_the_text():
    def parts(text, kind):
        return [text[s:e] for s, e, _ in substring_dedup.units_of(text, kind)]

    assert parts("a\nb\n\n c\n \nd", "paragraph") == ["a\nb\n\n", " c\n \n", "d"]
    assert parts("a. b\n\nc", "line") == ["a. b\n", "c"]
    assert parts("One.  Two?! 3.5 e.g.x y…\nz.\n", "sentence") == ["One.  ", "Two?! ", "3.5 e.g.x y…\n", "z.\n"]
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab. !\n\t…") for _ in range(rng.randrange(40)))
        for kind in substring_dedup.UNITS:
            assert "".join(m[0] for m in substring_dedup.UNITS[kind].finditer(text)) == text


def brute_spans(docs, depth=100):
    seen, out = set(), []
    for b in docs:
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - depth + 1):
            if b[k : k + depth] in seen:
                gone[k : k + depth] = b"\1" * depth
            seen.add(b[k : k + depth])
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_suffix_dedup(spark, rows, monkeypatch):
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefg ") for _ in range(95))  # shorter than a string, in many surroundings
    rows = rows + [(200 + i, "".join(rng.choice("xyz") for _ in range(40)) + passage + "".join(rng.choice("xyz") for _ in range(rng.randrange(40))), "a") for i in range(40)]
    rows += [(300, "short ä" * 40, "a"), (301, "ab" * 700, "a"), (302, "ab" * 900 + "ba" * 90, "a"), (303, rows[-3][1] + rows[-5][1], "b")]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = brute_spans([(t or "").encode() for _, t, _ in order])
    for most in (4 << 20, 2000, 1):  # groups are sorted; large ones, or all, are dealt anew level by level
        monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", most)
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
        monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 5000)
        monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 9000)
        got = suffix_dedup.remove_repeated_bytes(make_docs(spark, rows)).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[2])
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=key) == sorted(((o[0], *w) for o, w in zip(order, want)), key=key)
    assert suffix_dedup.remove_repeated_bytes(make_docs(spark, rows).limit(0)).count() == 0


def test_suffix_dedup_of_a_table_that_is_dealt_anew(spark):
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(200)) + shared * (i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    moving = docs.mapInPandas(lambda parts: (p.sample(frac=1) for p in parts), docs.schema)
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"]).decode()) for r in suffix_dedup.remove_repeated_bytes(moving).collect()}
    want = {r["doc_id"]: (r["n_removed"], bytes(r["kept"]).decode()) for r in suffix_dedup.remove_repeated_bytes(docs).collect()}
    assert got == want and sum(n >= 150 for n, _ in got.values()) == 19


def test_large_suffix_groups_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 20_000)
    texts = ["ab" * (1000 + 37 * i) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    scratch = suffix_dedup.Scratch(spark, "test")
    rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc"), "text"))
    kinds = {r["kind"] for r in suffix_dedup.find_stretches(suffix_dedup.whole_texts(rows), 4).collect()}
    assert suffix_dedup.SORT not in kinds and suffix_dedup.DEAL in kinds
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeated_bytes(docs).collect())
    assert got == [(0, len(texts[0]) - 2)] + [(i, len(t)) for i, t in enumerate(texts)][1:]


@pytest.mark.parametrize("depth", [3, 8, 100])
def test_induced_sort(depth):
    rng = np.random.default_rng(depth)
    for _ in range(150):
        parts = []
        for _ in range(rng.integers(1, 6)):
            parts += [np.tile(rng.integers(1, int(rng.choice([2, 3, 200])), rng.integers(1, 30)).astype(np.uint8), rng.integers(1, 4)), np.zeros(1, np.uint8)]
        t = np.concatenate(parts + parts[:2])
        order, lcp = suffix_order(t, depth, limit=int(rng.choice([64, 1 << 20])))
        ends = np.flatnonzero(t == 0)
        text = [bytes(t[i : ends[np.searchsorted(ends, i)]])[:depth] for i in order]
        assert sorted(order.tolist()) == list(range(len(t))) and all(a <= b for a, b in zip(text, text[1:]))
        for k in range(1, len(t)):
            n = next((m for m, (x, y) in enumerate(zip(text[k - 1], text[k])) if x != y), min(len(text[k - 1]), len(text[k])))
            assert lcp[k] == n


def test_exact_dedup(spark, rows):
    got = exact_dedup(make_docs(spark, rows)).collect()
    form = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(form(t), []).append((-len(t or ""), i is None, i or 0))
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[2] if not min(v)[1] else None, len(v)) for k, v in groups.items()}
    assert len(got) == len(rows) and all((r["keep_id"], r["group_size"]) == want[r["text_sha256"]] for r in got)
    assert sum(r["kept"] for r in got) == len(groups) == drop_exact(make_docs(spark, rows)).count()
    assert drop_exact(make_docs(spark, rows)).columns == make_docs(spark, rows).columns
    assert exact_dedup(make_docs(spark, rows).limit(0)).count() == 0


def test_cuckoo_index():
    index, live, rng = CuckooIndex(8), {}, random.Random(1)  # keys of 32 bytes
    for step in range(6000):
        key = hashlib.sha256(str(rng.randrange(1500)).encode()).digest()
        if rng.random() < 0.6:
            index.insert(key, step)
            live[key] = step
        else:
            assert index.delete(key) == (live.pop(key, None) is not None)
        assert index.get(key) == live.get(key)
    assert len(index) == len(live) and index.resizes > 3 and all(index.get(k) == v for k, v in live.items())
    assert dict(index.items()) == live
    same = [b"\1\0" + bytes([i]) * 30 for i in range(40)]  # one fingerprint, many keys
    for i, k in enumerate(same):
        index.insert(k, i)
    assert index.get(same[0][:-1] + b"x") is None and index.false_hits
    assert all(index.get(k) == i for i, k in enumerate(same)) and all(index.delete(k) for k in same) and len(index) == len(live)


def slow_fingerprint(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, rows):
    got = simhash.simhash_groups(make_docs(spark, rows)).collect()
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                group = [group[b] if g == group[a] else g for g in group]
    low = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = sorted((str(rows[i][0]), f"{fps[i]:016x}", str(low[group[i]])) for i in range(len(rows)))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert simhash.drop_near(make_docs(spark, rows)).count() == len(set(group))
    assert simhash.simhash_groups(make_docs(spark, rows).limit(0)).count() == 0


def test_near_fingerprints_in_large_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(120)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    scratch = simhash.Scratch(spark, "test")
    got = {r["fp"]: r["root"] for r in simhash.fingerprint_groups(scratch, scratch.save(df)).collect()}
    group = {f: f for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = {k: new if v == old else v for k, v in group.items()}
    for f in fps:
        mine = [simhash._signed(k) for k in fps if group[k] == group[f]]
        assert got.get(simhash._signed(f), simhash._signed(f)) == min(mine)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(5)
    x = [(rng.normal(size=16) if i % 3 else np.ones(16) + 0.15 * rng.normal(size=16)).tolist() for i in range(90)]
    x += [x[0], x[1], [2 * v for v in x[1]], None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [], [1.0, 0.0], [1.0, 0.01]]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, n int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_groups(df, recall=0.9999).collect()}
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]
    link = lambda a, b: ok[a] and ok[b] and len(x[a]) == len(x[b]) and np.dot(x[a], x[b]) / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.95
    want = [sum(link(i, j) for j in range(len(x)) if j != i) for i in range(len(x))]
    assert [got[i]["n_links"] for i in range(len(x))] == want and sum(want) > 20
    group = list(range(len(x)))
    for a in range(len(x)):
        for b in range(a):
            if link(a, b):
                group = [group[b] if g == group[a] else g for g in group]
    assert all(got[i]["component_id"] == min(j for j in range(len(x)) if group[j] == group[i]) for i in range(len(x)))
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0


def test_embedding_recall_on_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r["embedding"] for r in e.orderBy("vec_id").collect()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95).sum() - len(x)
    found = embedding_dedup.embedding_groups(e).agg(F.sum("n_links")).first()[0]
    assert 0.9 * near <= found <= near


def test_zip_reader_with_zip64_comment_and_compressed_members():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        with z.open(zipfile.ZipInfo("a/data"), "w", force_zip64=True) as m:
            m.write(b"0123456789" * 50)
        z.writestr("index", b"text " * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    data = buf.getvalue()
    r = warc.ZipRanges(io.BytesIO(data), len(data))
    assert r.member("index") == b"text " * 100 and list(r.ranges("a/data", [(3, 4), (495, 5)])) == [b"3456", b"56789"]
    with pytest.raises(ValueError):
        list(r.ranges("a/data", [(499, 5)]))
    with pytest.raises(ValueError):
        list(r.ranges("index", [(0, 1)]))
    with pytest.raises(ValueError):
        warc.ZipRanges(io.BytesIO(b"nothing" * 9), 63)


def test_zip64_directory():
    """A directory whose sizes, offset and counts stand in ZIP64 records alone."""
    import struct

    name, body = b"m", b"hello"
    local = warc.LOCAL_SIGNATURE + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, 5, 5) + body
    central = warc.CENTRAL_SIGNATURE + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    at = len(local)
    end64 = warc.END64_SIGNATURE + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    tail = end64 + warc.END64_LOCATOR + struct.pack("<IQI", 0, at + len(central), 1) + warc.END_SIGNATURE + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = local + central + tail
    assert warc.ZipRanges(io.BytesIO(data), len(data)).member("m") == b"hello"


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/é ü", "<p>x</p>"), (2, None, None), (3, "u", ""), (4, "http://b", "<p>x</p>"), (5, "http://c", "ünï\r\n\r\nWARC/1.0"), (6, "http://d", "<p>x</p>"), (None, "http://e", "alone")]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, sha string")
    got = {r["page_id"]: r for r in warc.archive_round_trip(df, str(tmp_path / "w"), with_payload=True).collect()}
    assert len(got) == 7 and list((tmp_path / "w").glob("*.wacz"))
    for i, _, html in pages:
        body = (html or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == warc.payload_digest(body)
        assert r["record_type"] == ("revisit" if i in (1, 2, 4) else "response") and r["refers_to"] == {1: 6, 4: 6, 2: 3}.get(i)
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == body
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    assert gzip.decompress(warc.record_bytes([("A", "b")], b"c")).startswith(b"WARC/1.1\r\nA: b\r\n")


def test_targets_and_seats():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    assert mixing.targets([100, 1, 0], [1, 1, 1]) == [98.0, 3.0, 0.0]
    assert mixing.sainte_lague(np.array([53.0, 24, 23]), 7, np.array([9, 9, 9])).tolist() == [3, 2, 2]
    rng = np.random.default_rng(0)
    for _ in range(40):
        share, most, seats = rng.random(6) * 100, rng.integers(0, 9, 6), int(rng.integers(0, 30))
        want = np.zeros(6, int)
        for _ in range(min(seats, most.sum())):
            want[np.argmax(np.where(want < most, share / (2 * want + 1), -1))] += 1
        assert mixing.sainte_lague(share, seats, most).tolist() == want.tolist()


def test_mix(spark, rows):
    docs = make_docs(spark, rows)
    got = mixing.mix_report(docs).collect()
    size = lambda t: len([w for w in (t or "").encode().split()])
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, x in rows if x == s) for s in sources]
    goal = mixing.targets(sizes, [1 + i % 3 for i in range(len(sources))])
    taken = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        taken.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(size(t) for _, t, _ in rows)
    want = {}
    for s, g in zip(sizes, goal):
        want[(s, g)] = want.get((s, g), 0) + g
    assert all(abs(sum(taken[k]) - g) <= 0.02 * g + 3 for k, g in want.items())
    again = mixing.mix_report(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and sum(size(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_mix_gives_small_sources_and_shards_their_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
    monkeypatch.setattr(mixing, "SHARD_DOCS", 64)
    texts = [("a", "w " * 40)] * 1500 + [("b", "w")] * 700 + [("c", "v " * 9)] * 30
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
    got = mixing.mix_report(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert {r["source_size"] for r in got} == {60000, 700, 270} and all(abs(r["taken"] - r["target"]) <= 1 for r in got)


def test_tokenizer_equals_the_library(rows):
    tok = packing.WordTokenizer(packing.default_tokenizer())
    texts = [t for _, t, _ in rows] + ["Ａｂ ﬁ ǅ é  x y", "it's 'tis I'LL 10,000.50!!! ?!x_y a'b", "\x85a　b", "日本語 текст ΑΣ", "🙂🙂 a​b", "a\x1fb"]
    for t in texts:
        want = tok.whole.encode(t, add_special_tokens=False).ids if t else []
        assert np.frombuffer(tok.ids(t), "<u4").tolist() == want == np.frombuffer(tok.ids(t), "<u4").tolist()


def test_pack_lengths():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 3000):
        lengths = np.minimum(4096, rng.lognormal(6.3, 1.2, n).astype(int) + 1)
        seq, offset, count = packing.pack(lengths)
        ends = {}
        for i in np.lexsort((offset, seq)):
            assert ends.get(seq[i], 0) == offset[i]
            ends[seq[i]] = offset[i] + lengths[i]
        assert len(ends) == count and all(v <= 4096 for v in ends.values()) and count <= max(np.ceil(lengths.sum() / 4096) * 1.02 + 2, 1 if n else 0)


@pytest.mark.parametrize("law", [lambda r, n: r.lognormal(6.3, 1.2, n), lambda r, n: r.lognormal(7.2, 0.6, n), lambda r, n: r.lognormal(7.6, 0.3, n), lambda r, n: r.uniform(1, 4096, n), lambda r, n: r.uniform(1, 60, 5 * n)])
def test_packing_is_near_its_bound(law):
    """The program over lengths rounded down to the least of their group can't take more sequences than any packing;
    nor can all tokens in full ones."""
    lengths = np.clip(law(np.random.default_rng(11), 2000).astype(int), 1, 4096)
    large = np.sort(lengths[lengths > packing.LARGE])[::-1]
    each = max(1, -(-len(large) // 96))
    groups = [large[k : k + each] for k in range(0, len(large), each)]
    bound = -(-int(lengths.sum()) // 4096)
    if groups:
        value, _ = packing._price([int(g[-1]) // 4 for g in groups], np.full(len(groups), 1e-9))
        assert value > 0
        bound = max(bound, sum(n for _, n in packing.configurations([int(g[-1]) // 4 * 4 for g in groups], [len(g) for g in groups])) * (1 - packing.GAP))
    plain = packing.Bins()
    packing._fit(plain, list(range(len(lengths))), lengths)
    count = packing.pack(lengths)[2]
    assert count <= bound * 1.015 + 1 and count <= len(plain.items)


def test_tokenizer_on_any_code_points():
    tok = packing.WordTokenizer(packing.default_tokenizer())
    rng = random.Random(6)
    texts = ["\u1c89", "\u1acd\u0c3c", "\u0301\u0d3c", "\ud7a3\u11a8", "a\u0130b", "Σσς", "\x85\x0b\x1f", "\ufeffx", "\U0001f9d1\u200d\U0001f692"]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x250, 0x3100), rng.randrange(0xA000, 0xD7FF), rng.randrange(0xF900, 0x1FAFF)])) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    texts += ["".join(rng.choice(packing.PLAIN) for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(tok.ids(t), "<u4").tolist() == tok.whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_pack_documents(spark, rows):
    got = packing.pack_documents(make_docs(spark, rows)).collect()
    tok = packing.WordTokenizer(packing.default_tokenizer())
    want = []
    for i, t, _ in rows:
        ids = (tok.whole.encode(t, add_special_tokens=False).ids if t else []) + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((str(i), k, at, len(part), __import__("zlib").crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
    assert packing.pack_documents(make_docs(spark, rows).limit(0)).count() == 0


def test_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "12 !!", "fr"), (-3, "", None)], "doc_id long, text string, lang string")
    both = d.select("doc_id", "text", "lang").unionByName(extra)
    got = language_id.identify(both).join(both, "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] >= 0]
    assert len(got) == 1003 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] < 0)
    assert {r["lang_pred"] for r in language_id.identify(both.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(both.limit(0)).count() == 0


def test_toxicity(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(d, lab).join(lab, "doc_id").where("held_out").collect()
    y, s = np.array([r["toxic"] for r in got]), np.array([r["score"] for r in got])
    order = s.argsort()
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    hit = np.array([r["predicted"] for r in got])
    assert auc > 0.85 and hit[y == 0].mean() < 0.02 and hit[y == 1].mean() > 0.6
    kept = toxicity.drop_toxic(d.limit(200).withColumn("s", F.lit(1)).withColumn("p", F.lit(2)), d, lab)
    assert kept.columns == [*d.columns, "s", "p"] and kept.count() <= 200
    none = toxicity.toxicity_scores(make_docs(spark, [(1, None, "a"), (None, "", "b")]), lab.limit(0)).collect()
    assert [r["predicted"] for r in none] == [0, 0]
    assert toxicity.toxicity_scores(d.limit(0), lab).count() == 0


def test_choice_of_blocks_against_a_loop_over_words():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        sizes, block = rng.integers(0, 30, 9), int(rng.integers(1, 40))
        quota = int(rng.integers(0, 3 * sizes.sum() + 1))
        words = [(d, k) for d, n in enumerate(sizes) for k in range(n)]
        blocks = [words[i : i + block] for i in range(0, len(words), block)]
        left, once = quota % max(1, len(words)), set()
        for b in np.random.default_rng(seed).permutation(len(blocks)):
            once |= set(blocks[b][:left])
            left -= min(left, len(blocks[b]))
        passes, ranges = mixing.choose_words(sizes, quota, block, seed)
        assert {(d, k) for d, r in enumerate(ranges) for lo, hi in r for k in range(lo, hi)} == once and passes == (quota // len(words) if words else 0)
        shards = mixing.shard_quotas(sizes, quota, block)
        assert shards.sum() == quota and (shards <= 3 * sizes).all()


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    rows = [np.array(sorted(set(rng.integers(0, 6, 3).tolist()))) for _ in range(600)]
    y = np.array([float(0 in r and 1 in r) for r in rows])
    m = toxicity.FactorizationMachine(6)
    m.fit(rows, y, epochs=60)
    assert m.paired
    s = m.score(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    assert ((s >= 0.5) == (y == 1)).mean() > 0.97


def test_pairwise_sum_against_loops():
    rng = np.random.default_rng(1)
    m = toxicity.FactorizationMachine(40, 5)
    m.paired, m.bias, m.w, m.v = True, 0.3, rng.normal(size=40).astype(np.float32), rng.normal(size=(40, 5)).astype(np.float32)
    rows = [np.sort(rng.choice(40, n, replace=False)) for n in (0, 1, 2, 7, 0, 30)]
    raw, sums = m.raw(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    for r, got, total in zip(rows, raw, sums):
        want = 0.3 + sum(float(m.w[i]) for i in r) + sum(float(m.v[i] @ m.v[j]) for a, i in enumerate(r) for j in r[:a])
        assert got == pytest.approx(want, abs=1e-4) and np.allclose(total, m.v[r].sum(0), atol=1e-5)


def pair_texts(rng, n):
    """Texts that are toxic if an insult meets its own group: each word alone tells nothing."""
    out = []
    for _ in range(n):
        words = [f"filler{x}" for x in rng.integers(0, 300, 20)]
        a, b = rng.integers(0, 2, 2)
        words += [f"insult{'AB'[a]}", f"group{'AB'[b]}"]
        rng.shuffle(words)
        out.append((" ".join(words), int(a == b)))
    return out


def test_toxicity_that_stands_in_pairs_alone(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, t, y) for i, (t, y) in enumerate(pair_texts(rng, 4000))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    right = {}
    for factors in (8, 0):
        model = toxicity.train(docs, labels, factors=factors)
        got = toxicity.score_documents(docs, model).join(labels, "doc_id").where(toxicity.fold(F.col("doc_id")) == 0).collect()
        right[factors] = np.mean([r["predicted"] == r["toxic"] for r in got])
    assert right[8] > 0.9 and right[0] < 0.6


def test_repeated_ids_are_trained_in_one_order(spark):
    rows = [(i % 7, f"word{i} text{i % 3} more{i % 5}", i % 2) for i in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, toxic int")
    a, b = (toxicity.train(docs.repartition(n), labels) for n in (1, 5))
    assert a.bias == b.bias and (a.w == b.w).all() and (a.v == b.v).all()


def test_convolution_and_gradients_against_loops():
    rng = np.random.default_rng(4)
    net = language_id.ByteConvNet(["a", "b", "c"])
    for name in ("embed", "conv", "conv_bias", "dense", "dense_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64) + (0.05 * rng.normal(size=3) if name == "dense_bias" else 0))
    x = rng.integers(1, 256, (3, language_id.WINDOW)).astype(np.uint8)
    x[2, 50:] = 0
    e = np.concatenate([net.embed[x], np.zeros((3, language_id.WIDEST, language_id.EMBED))], 1)
    got, at = net.pooled(x), 0
    for width, count in language_id.FILTERS.items():
        for f in range(at, at + count):
            kernel = net.conv[: width * language_id.EMBED, f].reshape(width, -1)
            for n in range(3):
                want = max(max((e[n, p : p + width] * kernel).sum() for p in range(language_id.WINDOW)) + net.conv_bias[f], 0)
                assert got[n, f] == pytest.approx(want, abs=1e-6)
        at += count
    y = np.array([0, 2, 1])
    loss = lambda: -net.log_probs(x)[np.arange(3), y].mean()
    for name, g in zip(("embed", "conv", "conv_bias", "dense", "dense_bias"), net.gradients(x, y)):
        p = getattr(net, name)
        for i in rng.permutation(p.size)[:25]:
            at = np.unravel_index(i, p.shape)
            if (name == "embed" and at[0] == 0) or (name == "conv" and not net.mask[at]):
                continue
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5), (name, at)


def test_numerals_are_no_letters():
    net = language_id.ByteConvNet(["de", "en"])
    assert language_id.predict(net, ["½ ²³ Ⅷ", "٣", "a½", None, "", "__"])[0][:2] == ["und", "und"]
    assert [n == "und" for n in language_id.predict(net, ["½ ²³ Ⅷ", "٣", "a½", None, "", "__"])[0]] == [True, True, False, True, True, True]


def test_records_are_sent_in_few_bytes():
    from brindle.llm import suffix_dedup as D

    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, 3000, dtype=np.uint8)) for _ in range(60)]
    r, _ = D.split_first(D.stretches(texts, np.arange(60) + 40_000, np.arange(60) + (7 << 33), np.zeros(60, np.int64), 0))
    for some in (r, r[:1], r[:0]):
        assert (D.unpack_records(D.pack_records(some), len(some)) == some).all()
    assert len(D.pack_records(r)) < 0.7 * r.nbytes
