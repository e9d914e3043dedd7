"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.llm.ball_search import quantised, top_k
from formlens.llm.collocations import collocations
from formlens.llm.common import Scratch, partitions, table
from formlens.llm.jaccard_join import near_duplicates
from formlens.llm.license_scan import document_licences
from formlens.llm.line_dedup import dedup_lines
from formlens.llm.media import document_media
from formlens.llm.mixing import mix_sources, mixing_sql
from formlens.llm.quality import held_out, score_quality, train_quality
from formlens.llm.ranked_search import ranked_search
from formlens.llm.sharding import shard_rows
from formlens.llm.subword import encode_samples
from formlens.llm.url_filter import judge_urls
from formlens.llm.warc_zip import page_records, read_archives, write_archives


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"), Scratch(spark, "op3"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, Scratch(spark, "op6"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op10")
    archives = write_archives(table(spark, sf_dir, "pages"), scratch)
    return page_records(read_archives(archives.repartition(partitions(spark), "path")), scratch)


PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_samples(table(spark, sf_dir, "documents"), PIECES, k=2, chunk_bytes=1 << 21)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, Scratch(spark, "op8"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_licences(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op4"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", "p", "sampled")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op11"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), Scratch(spark, "op12"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_rows(docs, Scratch(spark, "op13")).drop("text")


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_exact_topk": op3_exact_topk,
    "op4_license_scan": op4_license_scan,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_url_filter": op6_url_filter,
    "op7_media_columns": op7_media_columns,
    "op8_line_dedup": op8_line_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_warc_zip": op10_warc_zip,
    "op11_ranked_search": op11_ranked_search,
    "op12_collocations": op12_collocations,
    "op13_sharding": op13_sharding,
}

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * common >= 80 * (p.n_shingles + q.n_shingles - common)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.doc_id)
SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n_shingles
"""

OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN g.kept IS NULL OR g.kept = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.kept <> p.page_id THEN g.kept END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

OP8_SQL = """
WITH l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text <> '')),
w AS (SELECT *, CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, ' ', '')) + 1 END AS w FROM l),
m AS (SELECT y.doc_id, y.i, y.w, x.doc_id AS other, y.i - x.i AS shift
  FROM w y JOIN w x ON x.line = y.line AND (x.doc_id < y.doc_id OR x.doc_id = y.doc_id AND x.i < y.i)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY i) AS run FROM m),
t AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, other, shift, run) AS total FROM r),
g AS (SELECT DISTINCT doc_id, i FROM t WHERE total >= 50),
k AS (SELECT w.doc_id, string_agg(line, chr(10) ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed
  FROM w LEFT JOIN g USING (doc_id, i) GROUP BY w.doc_id)
SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN k USING (doc_id)
"""

OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n FROM t WHERE len(ts) > 0),
g AS (SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM t) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * g.N + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, g.N),
s AS (SELECT q.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * d.n * g.N) // g.L)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), g GROUP BY q.item_id, p.doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM w, range(1, 6) AS r(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 100),
k AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n.n, CAST((CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score, cut.k
  FROM c JOIN n USING (lang) JOIN range(1, 5) AS cut(k) ON cut.k < c.m
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut.k + 1:c.m], ' ')),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = s.lang AND 100 * q.a >= 100 * s.a
  AND length(q.phrase) > length(s.phrase) AND contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' '))),
r AS (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score FROM o)
SELECT * FROM r WHERE rank <= 2000
"""

ORACLES = {
    "op3_exact_topk": OP3_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_source_mixing": mixing_sql(),
    "op10_warc_zip": OP10_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
