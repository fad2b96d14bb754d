"""Further registered queries: readers and writers, text projections, samples, jobs; each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import judging as J
from brindle.functions import querygen as G
from brindle.functions import text as X
from brindle.operators import agreement, dense, etl, language, metrics, ranking, sampling, spelling
from brindle.operators import judging as judging_ops
from brindle.plans import jobs
from brindle.plans.engine import model_scorer
from brindle.plans.queries import BOOKS, GRADES, JUDGED, KEYWORD, LEAK, SPARSE, _dense_sql, _grades, _judgments, _known, _query_weights, _rankings, books, query, read, stored_engine, text_engine
from brindle.sources import tables
from brindle.sources.backends import get_queue, object_store
from brindle.sources.scratch import fresh_path, saved

# ---- sources and sinks


def _corpus(spark, sf_dir):
    """Documents as a corpus of books on disk, with their index."""
    b = books(spark, sf_dir)
    fields = {f.name: F.lit(None).cast(f.dataType) for f in tables.BOOK.fields if f.name not in b.columns}
    return b.withColumns(fields).withColumn("row_idx", F.col("doc_id"))


@query("SELECT (doc_id % 3 + 1)::INTEGER AS tier, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE doc_id % 3 + 1 <= 2 AND text <> '' GROUP BY 1")
def corpus_round_trip(spark, sf_dir):
    path = fresh_path(spark, "corpus")
    tables.write_books(_corpus(spark, sf_dir), path)
    back = etl.indexed(tables.books(spark, path, tier=2))
    return back.groupBy("tier").agg(F.count("*").alias("n"), F.sum(F.length("description")).alias("chars"))


@query("SELECT doc_id FROM documents WHERE text <> '' AND doc_id % 3 + 1 <= 1")
def tier_filter(spark, sf_dir):
    return etl.indexed(books(spark, sf_dir), 1).select("doc_id")


@query("SELECT vec_id // 100 AS batch, vec_id AS start_idx, len(embedding)::BIGINT AS dim, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings")
def shards_in_order(spark, sf_dir):
    root = fresh_path(spark, "store")
    e = read(spark, sf_dir, "embeddings").select(F.format_string("batch-%06d", F.floor(F.col("vec_id") / 100)).alias("batch_id"), F.col("vec_id").cast("long").alias("start_idx"), F.col("vec_id").cast("string").alias("work_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    tables.write_shards(e, f"{root}/shards")
    back = etl.by_start(tables.shards(spark, f"{root}/shards"))
    place = F.count("*").over(sampling.W.partitionBy(F.lit(0)).orderBy("start_idx"))  # a report over shards
    return back.select(F.substring("batch_id", 7, 6).cast("long").alias("batch"), "start_idx", F.size("embedding").cast("long").alias("dim"), place.alias("place"))


@query("SELECT vec_id::VARCHAR AS work_id, len(embedding)::BIGINT AS dim FROM embeddings")
def vector_round_trip(spark, sf_dir):
    path = fresh_path(spark, "vectors")
    tables.write_index(read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("work_id"), "embedding"), path)
    return tables.vectors(spark, path).select("work_id", F.size("embedding").cast("long").alias("dim"))


@query(r"""WITH w AS (SELECT unnest(string_split_regex(lower(text), '\s+')) AS term FROM benchmark), b AS (SELECT unnest(string_split_regex(lower(substr(split_part(text, chr(10), 1), 1, 80)), '\s+')) AS term FROM documents WHERE text <> '' UNION ALL SELECT unnest([lower(source), lower(lang)]) FROM documents WHERE text <> ''),
p AS (SELECT DISTINCT term, 1000 AS freq FROM b WHERE regexp_matches(term, '^\p{L}{3,}$') UNION ALL SELECT term, count(*) FROM w WHERE regexp_matches(term, '^\p{L}{3,}$') GROUP BY term)
SELECT term, sum(freq)::BIGINT AS freq FROM p GROUP BY term""")
def dictionary_merge(spark, sf_dir):
    path = fresh_path(spark, "dictionary")
    tables.write_dictionary(spelling.build_dictionary(books(spark, sf_dir)), path)
    more = read(spark, sf_dir, "benchmark").select(F.explode(X.alphabetic_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))
    return spelling.merge_dictionaries(tables.dictionary(spark, path), more)


@query("SELECT vec_id AS work_id, (CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END)::BIGINT AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label::BIGINT FROM embeddings WHERE vec_id % 5 = 0")
def index_upsert(spark, sf_dir):
    path = fresh_path(spark, "upsert")
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("work_id"), F.col("label").cast("long").alias("label"))
    tables.write_upsert(spark, e, path)
    tables.write_upsert(spark, e.where("work_id % 2 = 0").withColumn("label", F.col("label") + 100).unionByName(e.where("work_id % 5 = 0").withColumn("work_id", F.col("work_id") + 1000000)), path)
    return spark.read.parquet(path).select("work_id", "label")


@query(f"WITH {JUDGED} SELECT work_id::VARCHAR AS work_id, grade, low_confidence, contradiction FROM j")
def audit_csv(spark, sf_dir):
    path = fresh_path(spark, "audit")
    j = _judgments(spark, sf_dir).withColumns({"work_id": F.col("work_id").cast("string"), "title": F.lit("t"), "samples": F.array("grade")})
    tables.write_audit(j, path)
    return spark.read.option("header", True).csv(path).select("work_id", F.col("grade").cast("int").alias("grade"), F.col("low_confidence").cast("boolean").alias("low_confidence"), F.col("contradiction").cast("boolean").alias("contradiction"))


@query("SELECT count(*) AS n, sum(length(k))::BIGINT AS chars FROM (SELECT 'slices/' || doc_id || '.json' AS k FROM documents WHERE doc_id % 100 = 0)")
def object_listing(spark, sf_dir):
    # one object for each row whose id is divisible by 100, listed by prefix
    store = object_store(spark, "local", fresh_path(spark, "objects"))
    for r in read(spark, sf_dir, "documents").where("doc_id % 100 = 0").select("doc_id").toLocalIterator():
        store.put_bytes(f"slices/{r['doc_id']}.json", b"{}")
    keys = spark.createDataFrame([(k,) for k in store.list("slices/")], "k string")
    return keys.agg(F.count("*").alias("n"), F.sum(F.length("k")).alias("chars"))


@query("SELECT printf('batch-%06d', doc_id // 500) AS batch_id, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE text <> '' GROUP BY 1")
def queue_worker(spark, sf_dir):
    from brindle.sources.backends import ObjectStore
    from brindle.streaming.embedding import send_tasks, work

    root = fresh_path(spark, "tasks")
    store = ObjectStore(spark, root)
    queue = get_queue(store, "files", "embed")
    b = _corpus(spark, sf_dir).withColumn("tier", F.lit(1)).drop("doc_id", "year")
    send_tasks(b, store, queue)
    failures = work(spark, store, queue, f"{root}/shards", lambda c: dense.hashed_embedding(c, 32), 32, loop=True, errors=f"{root}/errors", idle=0.0)
    if failures or store.list("embed/new/") or store.list("embed/taken/"):
        raise RuntimeError(f"{failures} tasks failed")
    return spark.read.parquet(f"{root}/shards").groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("start_idx").alias("ids"))


# ---- projections

@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'https://covers.openlibrary.org/b/id/' || doc_id || '-M.jpg' WHEN doc_id % 3 = 2 THEN 'https://covers.openlibrary.org/b/isbn/' || source || '-M.jpg?default=false' END AS cover FROM documents""")
def cover_payload(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", X.cover_url(F.when(F.col("doc_id") % 3 == 1, F.col("doc_id")), F.when(F.col("doc_id") % 3 == 2, F.col("source"))).alias("cover"))


@query(rf"""WITH {BOOKS} SELECT doc_id, sha256(title || ' ' || author || ' ' || lang || ' ' || source || ' ' || description) AS digest FROM books""")
def searchable_text(spark, sf_dir):
    b = books(spark, sf_dir)
    return b.select("doc_id", F.sha2(X.searchable_text(F.col("title"), F.col("authors"), F.col("subjects"), F.col("description")).cast("binary"), 256).alias("digest"))


@query(rf"""WITH {BOOKS} SELECT doc_id, work_id, title, source AS authors, lang || '|' || source AS subjects, substr(description, 1, 500) AS description FROM books""")
def pooled_documents(spark, sf_dir):
    b = books(spark, sf_dir)
    shown = X.pooled_document(F.concat(F.lit("/works/"), F.col("work_id")), F.col("title"), X.join_authors(F.col("authors")), F.col("subjects"), F.col("description"))
    return b.select("doc_id", shown.alias("d")).select("doc_id", "d.work_id", "d.title", "d.authors", F.array_join("d.subjects", "|").alias("subjects"), "d.description")


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN quality END, toxic)::INTEGER AS grade FROM labels")
def grade_fields(spark, sf_dir):
    return read(spark, sf_dir, "labels").select("doc_id", J.grade_of(F.when(F.col("quality") == 1, F.col("quality")), F.col("toxic")).cast("int").alias("grade"))


@query(rf"""WITH {BOOKS} SELECT doc_id, sha256('Query: ' || source || chr(10) || chr(10) || 'Title: ' || title || chr(10) || 'Authors: ' || author || chr(10) || 'Description: ' || substr(description, 1, 500) || chr(10) || 'Subjects: ' || lang || ', ' || source) AS prompt FROM books""")
def judge_prompts(spark, sf_dir):
    b = books(spark, sf_dir)
    p = judging_ops.prompt(F.col("authors")[0], F.col("title"), X.join_authors(F.col("authors")), F.col("description"), F.col("subjects"))
    return b.select("doc_id", F.sha2(p.cast("binary"), 256).alias("prompt"))


@query(r"""WITH f AS (SELECT doc_id, unnest(['Title: ' || substr(split_part(text, chr(10), 1), 1, 80), 'Authors: ' || source, 'Description: ' || substr(text, 1, 500), 'Subjects: ' || lang || ', ' || source]) AS f FROM documents),
o AS (SELECT doc_id, string_agg(f, chr(10) ORDER BY md5(f || '|5'), f) AS fields FROM f GROUP BY doc_id) SELECT doc_id, sha256('Query: ' || doc_id || chr(10) || chr(10) || fields) AS prompt FROM o""")
def judge_prompts_shuffled(spark, sf_dir):
    b = books(spark, sf_dir)
    p = judging_ops.prompt(F.col("doc_id").cast("string"), F.col("title"), X.join_authors(F.col("authors")), F.col("description"), F.col("subjects"), F.lit(5))
    return b.select("doc_id", F.sha2(p.cast("binary"), 256).alias("prompt"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split(substr(split_part(text, chr(10), 1), 1, 80), ' '), lambda x: x <> '') AS t FROM documents)
SELECT doc_id, array_to_string(t[1:3], ', ') || CASE WHEN len(t) > 3 THEN ' +' || (len(t) - 3) || ' more' ELSE '' END AS badge FROM s""")
def subject_badges(spark, sf_dir):
    words = F.filter(F.split("title", " "), lambda w: w != "")
    return books(spark, sf_dir).select("doc_id", X.subject_badge(words).alias("badge"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split(split_part(text, chr(10), 1), ' '), lambda x: x <> '') AS w FROM documents WHERE split_part(text, chr(10), 1) NOT LIKE '%' || chr(9) || '%'),
l AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE string_split(list_reduce(w, lambda a, b: CASE WHEN length(regexp_extract(a, '[^\n]*$')) + 1 + length(b) <= 40 THEN a || ' ' || b ELSE a || chr(10) || b END), chr(10)) END AS ls FROM w)
SELECT doc_id, CASE WHEN len(ls) > 3 THEN array_to_string(ls[1:2], '/') || '/' || ls[3] || ' ...' ELSE array_to_string(ls, '/') END AS lines FROM l""")
def wrapped_titles(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("t")).where(~F.contains("t", F.lit("\t")))
    return d.select("doc_id", F.array_join(X.wrap_lines(F.col("t"), 40, 3), "/").alias("lines"))


@query(r"SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'), ' ') AS form FROM benchmark")
def dedup_forms(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", G.dedup_form(F.col("text")).alias("form"))


@query(rf"""WITH {BOOKS}, t AS (SELECT doc_id, trim(title, E' \n\t\r') AS t, title FROM books) SELECT doc_id FROM t WHERE len(string_split_regex(t, '\s+')) >= 3 AND length(title) >= 10 AND NOT (title = upper(title) AND length(title) > 5)""")
def distinctive_titles(spark, sf_dir):
    return books(spark, sf_dir).where(G.distinctive_title(F.col("title"))).select("doc_id")


@query(r"""WITH t AS (SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 80) AS title FROM documents), w AS (SELECT doc_id, title, string_split_regex(trim(title, E' \n\t\r'), '\s+') AS w FROM t)
SELECT doc_id, CASE WHEN contains(title, ':') THEN trim(split_part(title, ':', 1), E' \n\t\r') WHEN contains(title, ' - ') THEN trim(split_part(title, ' - ', 1), E' \n\t\r') WHEN contains(title, ' — ') THEN trim(split_part(title, ' — ', 1), E' \n\t\r') ELSE array_to_string(w[1:greatest(2, floor(len(w) * 0.6::DOUBLE)::INTEGER)], ' ') END AS part FROM w""")
def partial_titles(spark, sf_dir):
    return books(spark, sf_dir).select("doc_id", G.known_item_partial(F.col("title")).alias("part"))


TITLE_STOP = ", ".join(f"'{w}'" for w in X.TITLE_STOPWORDS)
TITLE_DF = rf"""tt AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(substr(split_part(text, chr(10), 1), 1, 80) || ' ' || text), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda x: length(x) > 1 AND x NOT IN ({TITLE_STOP}))) AS w FROM documents),
tdf AS (SELECT term, count(*) AS df FROM (SELECT unnest(w) AS term FROM tt) GROUP BY term)"""


@query(f"WITH {TITLE_DF} SELECT term, df FROM tdf")
def title_doc_freq(spark, sf_dir):
    return sampling.title_df(books(spark, sf_dir))


@query(rf"""WITH {TITLE_DF}, q AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(regexp_replace(lower(substr(split_part(text, chr(10), 1), 1, 80)), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda x: length(x) > 1 AND x NOT IN ({TITLE_STOP})))) AS term FROM documents),
r AS (SELECT doc_id, bool_or(coalesce(df, 0) / (SELECT count(*) FROM documents)::DOUBLE < 0.005) AS rare FROM q LEFT JOIN tdf USING (term) GROUP BY doc_id)
SELECT 'gr:' || doc_id AS work_id, CASE WHEN rare THEN 'distinctive' ELSE 'common_words' END AS title_word_class FROM documents LEFT JOIN r USING (doc_id)""")
def title_classes(spark, sf_dir):
    b = books(spark, sf_dir)
    return sampling.title_class(b.select("work_id", "title"), sampling.title_df(b), b.count())


@query("SELECT doc_id, sha256(text || ' é ñ ü') AS digest FROM documents WHERE lang = 'en' AND regexp_matches(text, '^[\\x00-\\x7f]*$')")
def repaired_texts(spark, sf_dir):
    """Texts are damaged as by a wrong decoder; the repair gives them back."""
    d = read(spark, sf_dir, "documents").where("lang = 'en'").where(F.col("text").rlike(r"^[\x00-\x7f]*$"))
    damaged = F.concat("text", F.lit(" Ã© Ã± Ã¼"))
    return d.select("doc_id", F.sha2(X.repair_text(damaged).cast("binary"), 256).alias("digest"))


@query()
def language_profiles(spark, sf_dir):
    """Profiles of the rows whose id isn't divisible by 5, applied to all whole texts."""
    d = read(spark, sf_dir, "documents")
    find = language.detect(language.fit_profiles(d.where("doc_id % 5 <> 0")))
    return d.select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), "lang", find(F.col("text")).alias("found"))


@query(rf"""WITH b AS (SELECT doc_id, 'gr:' || doc_id AS work_id, substr(split_part(text, chr(10), 1), 1, 80) AS title FROM documents WHERE text <> ''),
{TITLE_DF}, one AS (SELECT lower(trim(title, E' \n\t\r')) AS t FROM b GROUP BY 1 HAVING count(*) = 1),
fit AS (SELECT * FROM b WHERE len(string_split_regex(trim(title, E' \n\t\r'), '\s+')) >= 3 AND length(title) >= 10 AND NOT (title = upper(title) AND length(title) > 5) AND lower(trim(title, E' \n\t\r')) IN (SELECT t FROM one)),
some AS (SELECT * FROM fit ORDER BY md5(work_id || '|42'), work_id LIMIT 50),
r AS (SELECT doc_id, bool_or(coalesce(df, 0) / (SELECT count(*) FROM b)::DOUBLE < 0.005) AS rare FROM (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda x: length(x) > 1 AND x NOT IN ({TITLE_STOP}))) AS term FROM some) LEFT JOIN tdf USING (term) GROUP BY doc_id)
SELECT work_id, title AS query, CASE WHEN rare THEN 'distinctive' ELSE 'common_words' END AS title_word_class FROM some LEFT JOIN r USING (doc_id)""".replace("some AS", "picked AS").replace("FROM some", "FROM picked"))
def known_item_set(spark, sf_dir):
    return sampling.known_items(books(spark, sf_dir)).select("work_id", "query", "title_word_class")


# ---- samples and reports

@query(f"""WITH {BOOKS}, numbered AS (SELECT work_id, row_number() OVER (ORDER BY md5(work_id || '|42|category'), work_id) AS n FROM books)
SELECT work_id, CASE WHEN n <= round_even(c.n * 0.2, 0) THEN 'title_lookup' WHEN n <= round_even(c.n * 0.2, 0) + round_even(c.n * 0.15, 0) THEN 'author' WHEN n <= round_even(c.n * 0.2, 0) + round_even(c.n * 0.15, 0) + round_even(c.n * 0.3, 0) THEN 'genre_topic'
WHEN n <= round_even(c.n * 0.2, 0) + round_even(c.n * 0.15, 0) + round_even(c.n * 0.3, 0) + round_even(c.n * 0.25, 0) THEN 'exploratory' ELSE 'combined' END AS category FROM numbered, (SELECT count(*)::DOUBLE AS n FROM documents) c""".replace("WHEN n <=", "WHEN numbered.n <="))
def assigned_categories(spark, sf_dir):
    b = books(spark, sf_dir).select("work_id")
    return sampling.assign_categories(b, b.count(), 42)


@query("SELECT lang, s[len(s) // 2 + 1] AS upper_median FROM (SELECT lang, list_sort(list(length(text))) AS s FROM documents GROUP BY lang)")
def upper_medians(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", F.length("text").cast("long").alias("n"))
    return sampling.percentile_by_index(d, ["lang"], "n", 0.5).select("lang", F.col("n").alias("upper_median"))


@query("SELECT count(DISTINCT CASE WHEN n <= 50 THEN source || '' ELSE 'gr:' || doc_id END) AS authors_or_books, sum(CASE WHEN n <= 50 THEN 0 ELSE 1 END)::BIGINT AS alone FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def gold_sets(spark, sf_dir):
    b = books(spark, sf_dir)
    gold = sampling.author_gold(b, sampling.author_index(b)).join(b.select(F.col("work_id").alias("seed_id"), F.col("authors")[0].alias("a")), "seed_id")
    size = b.groupBy(F.col("authors")[0].alias("a")).agg(F.count("*").alias("n"))
    named = gold.join(size, "a").select(F.when(F.col("n") <= G.GOLD_CAP, F.col("a")).otherwise(F.col("gold_work_ids")[0]).alias("key"), (F.col("n") > G.GOLD_CAP).alias("alone"))
    return named.agg(F.countDistinct("key").alias("authors_or_books"), F.count_if("alone").alias("alone"))


@query("SELECT count(DISTINCT doc_id) AS gold_documents FROM documents")
def gold_documents(spark, sf_dir):
    b = books(spark, sf_dir)
    return sampling.gold_count(sampling.author_gold(b, sampling.author_index(b)))


@query("SELECT (SELECT count(*) FROM (SELECT source FROM documents GROUP BY source HAVING count(*) > 1)) AS duplicates, (SELECT string_agg(source, '|' ORDER BY source) FROM (SELECT source FROM documents GROUP BY source HAVING count(*) > 1 ORDER BY source LIMIT 5)) AS examples")
def duplicate_ids(spark, sf_dir):
    d = etl.duplicate_examples(read(spark, sf_dir, "documents").withColumnRenamed("source", "work_id"))
    return d.select("duplicates", F.array_join("examples", "|").alias("examples"))


@query(r"""WITH t AS (SELECT text, replace(replace(text, 'Ã©', 'é'), 'Ã±', 'ñ') AS t FROM documents), n AS (SELECT text, CASE WHEN regexp_matches(t, '\d+\s+[Rr]eviews?') AND length(trim(regexp_replace(t, '(?s)^.*?\d+\s+[Rr]eviews?\s*', ''), E' \n\t\r')) > 50 THEN regexp_replace(t, '(?s)^.*?\d+\s+[Rr]eviews?\s*', '') ELSE trim(regexp_replace(regexp_replace(regexp_replace(replace(t, E'\r\n', E'\n'), '\n{3,}', E'\n\n', 'g'), '[ \t]+', ' ', 'g'), '[ \t]+\n', E'\n', 'g'), E' \n\t\r') END AS c FROM t)
SELECT count(*) FILTER (text IS DISTINCT FROM c) AS changed, count(*) AS total FROM n""")
def changed_rows(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.agg(F.count_if(~X.clean_description(F.col("text")).eqNullSafe(F.col("text"))).alias("changed"), F.count("*").alias("total"))


@query("""SELECT m.mode, q.query FROM (SELECT UNNEST(['full', 'short']) AS mode) m, (SELECT vec_id AS query FROM embeddings) q WHERE q.query % 100 <> 0""")
def missing_in_mode(spark, sf_dir):
    asked = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"))
    return metrics.missing_queries(_rankings(spark, sf_dir), asked)


@query("SELECT vec_id AS query, CASE WHEN label % 2 = 0 THEN 'label-' || label ELSE 'unknown' END AS category FROM embeddings")
def category_default(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), "label")
    return metrics.with_category(e.select("query"), e.where("label % 2 = 0").select("query", F.concat(F.lit("label-"), F.col("label").cast("string")).alias("category")))


@query("SELECT doc_id % 7 AS query, doc_id AS work_id, quality::INTEGER AS a, (CASE WHEN doc_id % 3 = 0 THEN 1 - toxic ELSE toxic END)::INTEGER AS b FROM labels WHERE doc_id % 11 <> 0")
def rater_pairs(spark, sf_dir):
    lab = read(spark, sf_dir, "labels").select((F.col("doc_id") % 7).alias("query"), F.col("doc_id").alias("work_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    a = lab.select("query", "work_id", F.when(F.col("work_id") % 11 != 0, F.col("quality")).alias("grade"))
    b = lab.select("query", "work_id", F.col("toxic").alias("grade"), F.lit(0).alias("pos")).unionByName(lab.where("work_id % 3 = 0").select("query", "work_id", (1 - F.col("toxic")).alias("grade"), F.lit(1).alias("pos")))
    return agreement.pair_labels(a, b)


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(a, '^\\d') THEN least(2, substr(a, 1, 1)::INTEGER) END AS grade FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE (conv_id % 5) || ' ' || text END AS a FROM conversations WHERE NOT regexp_matches(text, '^\\s'))")
def leading_grades(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where(~F.col("text").rlike(r"^\s"))
    said = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat((F.col("conv_id") % 5).cast("string"), F.lit(" "), F.col("text")))
    return c.select("conv_id", "turn", J.leading_grade(said).alias("grade"))


@query("SELECT doc_id, ('0x' || substr(md5(doc_id || '|' || source), 1, 8))::BIGINT % 3 AS grade FROM documents")
def synthetic_grades(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", J.synthetic_grade(F.col("doc_id"), F.col("source")).cast("long").alias("grade"))


@query(f"""WITH {LEAK}, o AS (SELECT item_id, doc_id, (SELECT count(*) FROM (SELECT unnest([lang, source]) AS s FROM documents d WHERE d.doc_id = pairs.doc_id) WHERE contains(lower(text), lower(s))) AS o, contains(lower(text), (1850 + doc_id % 170)::VARCHAR) AS dated, item_id % 4 AS c FROM pairs JOIN benchmark USING (item_id))
SELECT item_id, CASE WHEN c = 0 THEN 'hard' WHEN c = 1 THEN (CASE WHEN o >= 2 OR (o >= 1 AND dated) THEN 'easy' WHEN o >= 1 OR dated THEN 'medium' ELSE 'hard' END) ELSE (CASE WHEN o >= 2 THEN 'easy' WHEN o >= 1 THEN 'medium' ELSE 'hard' END) END AS difficulty, c > 1 AS complete FROM o""".replace("c > 1 AS complete", "false AS complete"))
def difficulties(spark, sf_dir):
    from brindle.plans.queries import _leak_first

    first, n = _leak_first(spark, sf_dir)
    p = books(spark, sf_dir).select("doc_id", "title", "authors", "subjects", "year").join(ranking.small_side(first, n), "doc_id")
    category = F.element_at(F.array(F.lit("exploratory"), F.lit("combined"), F.lit("genre_topic"), F.lit("genre_topic")), (F.col("item_id") % 4 + 1).cast("int"))
    return p.select("item_id", G.difficulty(category, F.col("q"), F.col("title"), F.col("authors"), F.col("subjects"), F.col("year"), F.lit(0.0)).alias("difficulty"), G.gold_is_complete(category).alias("complete"))


# ---- jobs

def _judge_pairs(spark, sf_dir):
    return books(spark, sf_dir).select(F.col("authors")[0].alias("query"), "work_id", "title", X.join_authors(F.col("authors")).alias("authors"), "description", "subjects")


def _die(sides: int, *tags):
    return X.draw_number(F.lit(sides), F.col("query"), F.col("work_id"), *tags)


def _drawn_judge(prompt, seed):
    """A judge whose answers are draws of the pair and the sample, so that SQL has them too."""
    return F.concat(F.lit('{"grade": '), _die(3, seed).cast("string"), F.lit(', "reasoning": "drawn"}'))


DRAWN = "('0x' || substr(md5(source || '|gr:' || doc_id || '|' || {}), 1, 8))::BIGINT % 3"


@query(f"""WITH s AS (SELECT source AS query, 'gr:' || doc_id AS work_id, {DRAWN.format("'0'")} AS a, {DRAWN.format("'1'")} AS b, {DRAWN.format("'2'")} AS c, {DRAWN.format("'3'")} AS d, {DRAWN.format("'4'")} AS e FROM documents),
g AS (SELECT *, a <> b AND b <> c AND a <> c AS open FROM s)
SELECT query, work_id, (CASE WHEN open THEN (CASE WHEN d = e THEN d ELSE least(d, e) END) WHEN a = b OR a = c THEN a ELSE b END)::INTEGER AS grade, (CASE WHEN open THEN 5 ELSE 3 END)::INTEGER AS k_requested,
round(CASE WHEN open THEN (CASE WHEN d = e THEN 0.6 ELSE 0.4 END) WHEN a = b AND b = c THEN 1.0 ELSE 2.0 / 3 END, 4)::DOUBLE AS agreement FROM g""")
def judge_job(spark, sf_dir):
    judged, _ = jobs.judge_pool(_judge_pairs(spark, sf_dir), _drawn_judge, save=saved)
    return judged.select("query", "work_id", "grade", "k_requested", F.round("agreement", 4).alias("agreement"))


@query("SELECT source AS query, 'gr:' || doc_id AS work_id, (CASE WHEN doc_id % 2 = 0 THEN 2 ELSE NULL END)::INTEGER AS known FROM documents")
def judge_resume(spark, sf_dir):
    """Half of the pairs are in the cache: they aren't asked again, and the new cache holds all."""
    pairs = _judge_pairs(spark, sf_dir)
    cache = pairs.where("cast(substring(work_id, 4) as long) % 2 = 0").select(J.pair_key(F.col("query"), F.col("work_id")).alias("pair_key"), F.lit(2).alias("grade"), F.lit("kept").alias("reasoning"))
    judged, after = jobs.judge_pool(pairs, _drawn_judge, cache=cache, save=saved)
    held = judged.withColumn("pair_key", J.pair_key(F.col("query"), F.col("work_id"))).join(after.select("pair_key"), "pair_key")
    return held.select("query", "work_id", F.when(F.col("cached"), F.col("grade")).alias("known"))


@query(f"WITH s AS (SELECT source AS query, 'gr:' || doc_id AS work_id, {DRAWN.format(chr(39) + 'once' + chr(39))} AS g, doc_id FROM documents) SELECT query, work_id, (CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN NULL ELSE g END)::INTEGER AS grade FROM s")
def graded_judging(spark, sf_dir):
    pairs = _judge_pairs(spark, sf_dir)
    number = F.substring("work_id", 4, 20).cast("long")
    done = pairs.where(number % 3 == 0).select("query", "work_id", F.lit(1).alias("grade"))
    answer = lambda prompt, seed: F.when(number % 5 == 0, F.lit("no number")).otherwise(F.concat(_die(3, F.lit("once")).cast("string"), F.lit(" - fits")))
    return jobs.graded_judging(pairs, answer, done).select("query", "work_id", "grade")


def _evaluated(spark, sf_dir):
    r, g = _rankings(spark, sf_dir), _grades(spark, sf_dir)
    queries = g.select("query").distinct().where("query % 200 = 0").select("query", F.lit("even").alias("category"))
    return jobs.evaluate(r, g, queries, ["full", "short"], "full", save=saved)


def _evaluated_sql() -> str:
    from brindle.plans.queries import _metric_sql

    return f"{_metric_sql()}, fit AS (SELECT query FROM grades GROUP BY query HAVING max(grade) > 0)"


@query(f"WITH {_evaluated_sql()} SELECT mode, count(*) AS n_queries, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision FROM m JOIN fit USING (query) GROUP BY mode")
def graded_eval_overall(spark, sf_dir):
    return _evaluated(spark, sf_dir)["overall"]


@query(f"WITH {_evaluated_sql()} SELECT CASE WHEN query % 200 = 0 THEN 'even' ELSE 'unknown' END AS category, mode, count(*) AS n_queries, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision FROM m JOIN fit USING (query) GROUP BY ALL")
def graded_eval_categories(spark, sf_dir):
    return _evaluated(spark, sf_dir)["by_category"]


@query()
def graded_eval_paired(spark, sf_dir):
    return _evaluated(spark, sf_dir)["paired"]


@query()
def threshold_report(spark, sf_dir):
    return jobs.thresholds(_rankings(spark, sf_dir), _grades(spark, sf_dir), trials=200)


@query("""WITH x AS (SELECT quality AS q, doc_id FROM labels) SELECT doc_id % 7 AS query, doc_id AS work_id FROM x WHERE doc_id % 11 <> 0 AND doc_id % 2 = 1""")
def label_resume(spark, sf_dir):
    """All pairs are sampled; those already labelled, the even ones, aren't asked again."""
    j = _judgments(spark, sf_dir).select(F.col("query").cast("string").alias("query"), F.col("work_id").cast("string").alias("work_id"), "grade")
    done = j.where("cast(work_id as long) % 2 = 0")
    left = jobs.label_tasks(j, j.select("query", "work_id"), done, j.count(), 1)
    return left.select(F.col("query").cast("long").alias("query"), F.col("work_id").cast("long").alias("work_id"))


@query(r"""SELECT 'gr:' || doc_id AS work_id, CASE WHEN doc_id % 2 = 0 THEN 'model' ELSE 'template_fallback' END AS source, CASE WHEN doc_id % 2 = 0 THEN 'asked ' || md5('gr:' || doc_id) END AS said FROM documents""")
def generated_queries(spark, sf_dir):
    b = books(spark, sf_dir).withColumn("first_publish_year", F.col("year"))
    even = F.substring("work_id", 4, 20).cast("long") % 2 == 0
    out = jobs.generate_queries(b, b.count(), lambda prompt: F.when(even & (F.length(prompt) > 0), F.concat(F.lit('"asked '), F.md5("work_id"), F.lit('"'))))
    return out.select("work_id", "source", F.when(F.col("source") == "model", F.col("query")).alias("said"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank, length(text)::DOUBLE AS rerank_score FROM documents QUALIFY rank <= 5")
def pair_model(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    score = model_scorer(lambda q, p: [float(len(x)) for x in p])
    pairs = d.select("doc_id", F.col("source").alias("qid"), F.col("doc_id").alias("rank"), score(F.col("source"), F.col("text")).alias("s"))
    out = ranking.rerank(pairs, F.col("s"), 5, ["qid"])
    return out.select("doc_id", F.col("rank").cast("long").alias("rank"), "rerank_score")


ENGINE = rf"""etf AS (SELECT work_id, term, count(*) AS tf FROM (SELECT work_id, unnest(regexp_extract_all(lower(trim(title || ' ' || description || ' ' || lang || ' ' || source, ' ')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM books) GROUP BY ALL),
evoc AS (SELECT term, ln((1.0 + (SELECT count(*) FROM books)) / (1.0 + count(*))) + 1.0 AS idf FROM etf GROUP BY term),
epost AS (SELECT work_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY work_id)) AS w FROM etf JOIN evoc USING (term)),
eqtf AS (SELECT item_id AS qid, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM benchmark) GROUP BY ALL),
eqw AS (SELECT qid, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY qid)) AS w FROM eqtf JOIN evoc USING (term)),
es AS (SELECT qid, work_id, sum(epost.w * eqw.w) AS score FROM epost JOIN eqw USING (term) JOIN books USING (work_id) WHERE tier = 1 GROUP BY ALL)"""

TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}'))"


@query(rf"""WITH {BOOKS.strip()}, {ENGINE}, unit AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
asked AS (SELECT item_id AS qid, text AS query, v FROM benchmark JOIN unit ON vec_id = item_id WHERE item_id % 100 = 0),
k AS (SELECT qid, work_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, work_id) AS rank FROM es WHERE qid IN (SELECT qid FROM asked)),
vs AS (SELECT qid, work_id, list_dot_product(asked.v, unit.v) AS score FROM asked, unit JOIN books ON work_id = 'gr:' || vec_id WHERE tier = 1),
v AS (SELECT qid, work_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, work_id) AS rank FROM vs),
f AS (SELECT qid, work_id, sum(1.0 / (1 + rank)) AS score FROM (SELECT * FROM k WHERE rank <= 50 UNION ALL SELECT * FROM v WHERE rank <= 50) GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, work_id) AS original_rank FROM f),
p AS (SELECT work_id, title, coalesce(CASE WHEN title <> '' THEN title || ' by ' || author || '. ' END, '') || substr(trim(regexp_replace(trim(description, E'"\''), '\s+', ' ', 'g'), ' '), 1, 1500) || ' This book covers ' || lang || ', ' || source || '.' AS passage FROM books),
s AS (SELECT qid, work_id, title, original_rank, len(list_intersect({TOKENS.format("query")}, {TOKENS.format("passage")}))::DOUBLE / len({TOKENS.format("query")}) AS score FROM h JOIN p USING (work_id) JOIN asked USING (qid) WHERE original_rank <= 25),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, original_rank) AS rank FROM s)
SELECT qid, rank, work_id, title, original_rank, original_rank - rank AS rank_change, round(score, 4) AS rerank_score FROM r WHERE rank <= 10""")
def engine_search(spark, sf_dir):
    asked = read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    q = read(spark, sf_dir, "benchmark").join(asked, "item_id").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), "vector")
    hits = text_engine(spark, sf_dir).search(q, 10, "hybrid", tier=1, rerank=True)
    return hits.select("qid", *(F.col(c).cast("long").alias(c) for c in ("rank", "original_rank", "rank_change")), "work_id", "title", "rerank_score")



@query(f"WITH {BOOKS.strip()}, {ENGINE}, er AS (SELECT qid, work_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, work_id) AS rank FROM es JOIN books USING (work_id) WHERE year >= 1900) SELECT qid, rank, er.work_id, title, author AS authors, year, round(score, 6) AS score FROM er JOIN books USING (work_id) WHERE rank <= 10")
def engine_keyword(spark, sf_dir):
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    hits = stored_engine(spark, sf_dir).search(q, 10, "keyword", tier=1, year_min=1900)
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), "work_id", "title", "authors", "year", F.round("score", 6).alias("score"))


@query(f"WITH {BOOKS.strip()}, {ENGINE} SELECT (SELECT count(*) FROM documents) AS points, 64::INTEGER AS dim, (SELECT count(*) FROM evoc) AS terms, 'ok' AS status, true AS ready")
def engine_stats(spark, sf_dir):
    engine = stored_engine(spark, sf_dir)
    s = engine.stats()
    return spark.createDataFrame([(s["points"], s["dim"], s["terms"], engine.health()["status"], engine.ready())], "points long, dim int, terms long, status string, ready boolean")


@query(f"WITH {SPARSE}, {_query_weights(KEYWORD)}, h AS (SELECT qid, kall.rank, contains(documents.text, benchmark.text) AS hit FROM kall JOIN documents USING (doc_id) JOIN benchmark ON item_id = qid WHERE kall.rank <= 10) SELECT qid AS query, min(rank) AS rank FROM h WHERE hit GROUP BY qid")
def known_item_ranks(spark, sf_dir):
    _, pairs = _known(spark, sf_dir)
    return pairs.where("hit").groupBy(F.col("qid").alias("query")).agg(F.min("rank").cast("long").alias("rank"))


@query(f"WITH {_dense_sql()}, {GRADES} SELECT query, count(*) AS pool, count(*) FILTER (grade > 0) AS relevant FROM grades GROUP BY query")
def judged_pools(spark, sf_dir):
    return _grades(spark, sf_dir).groupBy("query").agg(F.count("*").alias("pool"), F.count_if(F.col("grade") > 0).alias("relevant"))


@query()
def random_mrr_trials(spark, sf_dir):
    pools = judged_pools(spark, sf_dir).select("query", F.col("pool").cast("int").alias("pool"), F.col("relevant").cast("int").alias("relevant"))
    return metrics.random_mrr_trials(pools, 500)


@query()
def spell_suggestions(spark, sf_dir):
    d = spelling.build_dictionary(books(spark, sf_dir))
    q = read(spark, sf_dir, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return spelling.suggest(q, d)


@query(r"""SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'similar_to' WHEN 1 THEN 'semantic' WHEN 2 THEN 'filtered' WHEN 3 THEN 'author' WHEN 4 THEN 'semantic' ELSE 'keyword' END AS intent, CASE item_id % 6 WHEN 0 THEN 'vector' WHEN 5 THEN 'keyword' ELSE 'hybrid' END AS search_mode,
(CASE item_id % 6 WHEN 1 THEN 0.5 WHEN 3 THEN 2.0 ELSE 1.0 END)::DOUBLE AS boost_keyword, CASE WHEN item_id % 6 = 2 THEN (1900 + item_id % 100)::INTEGER END AS year_min, CASE WHEN item_id % 6 = 0 THEN 'title ' || item_id END AS extracted_title FROM benchmark""")
def intents(spark, sf_dir):
    from brindle.functions.intent import classify

    i = F.col("item_id")
    made = [F.concat(F.lit("books like title "), i.cast("string")), F.concat(F.lit("books about subject "), i.cast("string")), F.concat(F.lit("stories since "), (1900 + i % 100).cast("string")), F.lit("novels by Ann Lee"), F.concat(F.lit("subject "), i.cast("string")), F.lit("9780306406157")]
    chain = F.lit(None).cast("string")
    for k, m in enumerate(made):
        chain = F.when(i % 6 == k, m).otherwise(chain)
    return read(spark, sf_dir, "benchmark").select("item_id", X.let(chain, classify).alias("a")).select("item_id", "a.intent", "a.search_mode", "a.boost_keyword", "a.year_min", "a.extracted_title")


@query(r"""WITH d AS (SELECT unnest(string_split_regex(lower(substr(split_part(text, chr(10), 1), 1, 80)), '\s+')) AS term FROM documents WHERE text <> ''), k AS (SELECT DISTINCT term FROM d WHERE regexp_matches(term, '^[a-z]{3,}$'))
SELECT doc_id, sum(CASE WHEN length(w) > 2 AND NOT regexp_matches(w, '^\d+$') THEN 1 ELSE 0 END)::BIGINT AS asked, sum(CASE WHEN length(w) > 2 AND lower(w) IN (SELECT term FROM k) THEN 1 ELSE 0 END)::BIGINT AS known
FROM (SELECT doc_id, unnest(string_split(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g'), ' '), ' ')) AS w FROM documents) GROUP BY doc_id""")
def spell_words(spark, sf_dir):
    known = books(spark, sf_dir).where("description <> ''").select(F.explode(F.split(F.lower("title"), r"\s+")).alias("term")).where(F.col("term").rlike("^[a-z]{3,}$")).distinct()
    title = F.substring_index("text", "\n", 1)
    words = spelling.asked_words(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), title.alias("query")))
    flagged = words.join(known.withColumn("there", F.lit(1)), words["word"] == known["term"], "left")
    return flagged.groupBy(F.col("qid").alias("doc_id")).agg(F.count_if("asked").alias("asked"), F.count_if((F.length("raw") > 2) & F.col("there").isNotNull()).alias("known"))
