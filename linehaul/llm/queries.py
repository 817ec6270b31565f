"""Registered corpus queries (``opN_<name>`` and ``pipeline``) and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.llm.frames import id_text, table, word_count
from linehaul.scratch import Scratch


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linehaul.llm.license_scan import license_paragraphs

    return license_paragraphs(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linehaul.llm.decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linehaul.llm.mixing import mix

    # texts are read once; the mix needs their sizes and, to order rows of one id, digests
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("digest"))
    docs = Scratch(spark, "words").table(docs, "documents")
    return mix(docs, text_col="digest", size_col="words").select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linehaul.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda i: id_text(i) % 3 == 1)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linehaul.llm.warc import archive, read_archives

    back = read_archives(archive(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linehaul.llm.substring_dedup import substring_digest

    return substring_digest(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linehaul.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda i: id_text(i) % 5 == 0)


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linehaul.llm.ngram_lm import perplexity

    return perplexity(table(spark, sf_dir, "documents"), lambda i: id_text(i) % 5 == 1)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linehaul.llm.near_dedup import near_classes

    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linehaul.llm.embedding_dedup import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linehaul.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linehaul.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from linehaul.llm.bpe import encoding_digest

    return encoding_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_lm": op8_ngram_lm,
    "op9_near_dedup": op9_near_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_spelling": op11_spelling,
    "op12_filter_audit": op12_filter_audit,
    "op13_bpe": op13_bpe,
    "pipeline": pipeline,
}

ORACLES = {
    "op6_substring_dedup": r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM p WHERE i + 49 <= len(w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM g) WHERE doc_id > m),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(50)) AS k)),
k AS (SELECT p.doc_id, count(*) FILTER (c.i IS NOT NULL) AS gone, string_agg(p.w[p.i], ' ' ORDER BY p.i) FILTER (c.i IS NULL) AS kept
      FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id""",
    "op11_spelling": r"""
WITH RECURSIVE w AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
d AS (SELECT doc_id, r, count(*) AS k, doc_id || ':' || r AS s FROM w GROUP BY doc_id, r),
b AS (SELECT r, k, flatten(list_transform(list_transform(range(1, length(s) + 1), lambda i: unicode(s[i])), lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END)) AS y FROM d),
h AS (SELECT r, k, xor(4294967295, list_reduce(flatten(list_transform(y, lambda v: list_transform(range(8), lambda j: CAST((v >> CAST(j AS INTEGER)) & 1 AS BIGINT)))),
        lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295)) AS h FROM b),
c AS (SELECT CASE WHEN h % 31 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
x AS MATERIALIZED (SELECT word, i, word[1:i - 1] || word[i + 1:] AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT DISTINCT * FROM (SELECT p.word AS a, q.word AS b FROM x p JOIN x q ON p.s = q.s AND p.i = q.i AND p.word <> q.word
      UNION ALL SELECT x.word, v.word FROM x JOIN v ON x.s = v.word UNION ALL SELECT v.word, x.word FROM x JOIN v ON x.s = v.word)),
g AS (SELECT e.a, e.b, v.n, row_number() OVER (PARTITION BY e.a ORDER BY v.n DESC, encode(e.b)) AS k, count(*) OVER (PARTITION BY e.a) AS near FROM e JOIN v ON v.word = e.b),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(g.near, 0) AS n_near, CASE WHEN g.n >= 10 * v.n THEN g.b END AS form, CASE WHEN g.n >= 10 * v.n THEN g.n END AS form_n FROM v LEFT JOIN g ON g.a = v.word AND g.k = 1),
t AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
z AS (SELECT t.word, arg_max(t.root, f.n) AS root FROM t JOIN f ON f.word = t.root GROUP BY t.word)
SELECT f.word, f.form, coalesce(z.root, f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f LEFT JOIN z ON z.word = f.word""",
    "op12_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (SELECT doc_id, part, list_value(len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
        regexp_matches(text, '[#$%&*|]'), coalesce(first < doc_id, false)) AS f FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT m.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, f),
j AS (SELECT part, filter_order, step, o[step] AS own, n, good, toxic, list_bool_or(list_transform(o[1:step - 1], lambda k: f[k])) AS was, f[o[step]] AS now,
        len(list_filter(f, lambda v: v)) AS fails FROM c, s),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT coalesce(was, false) AND NOT now) AS kept, sum(n) FILTER (NOT coalesce(was, false) AND now) AS removed,
        sum(n) FILTER (was AND now) AS redundant, sum(n) FILTER (now AND fails = 1) AS unique_fails, sum(good) FILTER (NOT coalesce(was, false) AND now) AS good_lost,
        sum(toxic) FILTER (NOT coalesce(was, false) AND now) AS toxic_lost FROM j GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM r""",
    "op5_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f""",
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS r FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.r > 0 AND b.r > 0 AND list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.95),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.m, vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id""",
}
