"""The corpus queries with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc, bpe, codes, decontam, embeddings, lines, minhash, mixing, passages, pii, quality, search, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontam.build_index(_table(spark, sf_dir, "documents"))
    found = decontam.report(decontam.match(index, _table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.held_out(F.col("doc_id"), 3, 1)
    table = quality.feature_table(_table(spark, sf_dir, "documents"))
    ranking = quality.train(table, _table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(table, ranking).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(lines.clean(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = toxicity.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model).select("row.doc_id", "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), b"surrogates")
    return out.select("doc_id", "n_entities", F.array_join("kinds", ",").alias("kinds"), F.sha2("text", 256).alias("text_sha256"))


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = arc.archive_pages(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.rank_documents(docs, _table(spark, sf_dir, "benchmark")).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    ids = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path("word_bpe_49k.json"))
    out = bpe.decode(ids.select("doc_id", "ids", "n_tokens"), path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.coded_vectors(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"op1_decontamination": op1_decontamination, "op2_mixing": op2_mixing, "op3_embedding_dedup": op3_embedding_dedup, "op4_minhash_dedup": op4_minhash_dedup, "op5_quality": op5_quality, "op6_passage_dedup": op6_passage_dedup, "op7_line_dedup": op7_line_dedup, "op8_toxicity": op8_toxicity, "op9_pii_surrogates": op9_pii_surrogates, "op10_arc_to_warc": op10_arc_to_warc, "op11_search": op11_search, "op12_bpe": op12_bpe, "op13_codes": op13_codes, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op2_mixing": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op4_minhash_dedup": OP4_SQL, "op7_line_dedup": OP7_SQL, "op10_arc_to_warc": OP10_SQL, "op11_search": OP11_SQL, "op13_codes": OP13_SQL}


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS r
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT r, n, p, array_to_string(ws[p:p + n - 1], ' ') AS phrase
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, sizes WHERE len(ws) >= n)),
hit AS (SELECT spots.r, spots.p, spots.n, win.item_id FROM spots JOIN win ON spots.n = win.n AND spots.phrase = win.phrase),
words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS x FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP3_SQL = """
WITH RECURSIVE x AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) r ON r.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + least(len(ws), 5) - 1], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
l AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id, w.doc_id = r.component_id AS kept
FROM w JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) r ON r.u = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls, row_number() OVER () AS r FROM documents),
l AS (SELECT r, source, p, trim(ls[p], ' ' || chr(9) || chr(13)) AS bare, ls[p] AS line FROM (SELECT r, source, ls, unnest(range(1, len(ls) + 1)) AS p FROM d)),
spread AS (SELECT bare FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10),
m AS (SELECT l.*, bare <> '' AS filled, spread.bare IS NOT NULL AS bad FROM l LEFT JOIN spread USING (bare)),
c AS (
  SELECT r, count(*) FILTER (filled) AS n_lines, count(*) FILTER (bad) AS n_spread,
         coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT bad), '') AS kept
  FROM m GROUP BY r),
o AS (SELECT d.doc_id, d.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_spread, 0) AS n_spread, kept, coalesce(n_spread, 0) > 0 AND n_spread < n_lines AS cut FROM d LEFT JOIN c USING (r))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_spread AS BIGINT) AS n_spread, CAST(CASE WHEN cut THEN n_spread ELSE 0 END AS BIGINT) AS n_removed,
       CAST(length(CASE WHEN cut THEN kept ELSE text END) AS BIGINT) AS n_chars, sha256(CASE WHEN cut THEN kept ELSE text END) AS text_sha256
FROM o
"""



OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS lev,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS pos
  FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT min_by(lev, pos) AS lev FROM l WHERE 2.0::DOUBLE * source_size > lev * weight),
t AS (SELECT source, source_size, coalesce(least(2.0::DOUBLE * source_size, (SELECT lev FROM stop) * weight), 2.0::DOUBLE * source_size) AS target FROM l),
e AS (
  SELECT d.doc_id, d.source, d.size, d.u, t.source_size, t.target,
         least(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END, 2.0::DOUBLE) AS x
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (
  SELECT *, CASE WHEN x - floor(x) > 0 THEN (u / (1 - u)) / ((x - floor(x)) / (1 - (x - floor(x)))) END AS q,
         target - floor(x) * source_size AS left_words
  FROM e),
r AS (
  SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q / (1 + q)) AS run, sum(size) OVER (PARTITION BY source, q / (1 + q)) AS peers FROM v)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((floor(x) + CASE WHEN q IS NOT NULL AND 2 * run - peers <= 2 * left_words THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {k}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for k in (15, 10, 5, 0))
OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
c AS (SELECT CAST(count(*) FILTER (len(ws) > 0) AS BIGINT) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d),
t AS (SELECT q, word, CAST(count(*) AS BIGINT) AS times FROM (SELECT q, unnest(ws) AS word FROM i) GROUP BY q, word),
p AS (SELECT r, word, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ws) AS word FROM d) WHERE word IN (SELECT word FROM t) GROUP BY r, word),
w AS (SELECT word, CAST(floor(1000 * ln((2 * (SELECT n FROM c) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p GROUP BY word),
m AS (SELECT r, doc_id, 25 + (75 * CAST(len(ws) AS BIGINT) * (SELECT n FROM c)) // (SELECT l FROM c) AS m FROM d WHERE len(ws) > 0),
s AS (
  SELECT t.q, m.doc_id, p.r, CAST(sum(t.times * w.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score
  FROM t JOIN p USING (word) JOIN w USING (word) JOIN m ON m.r = p.r GROUP BY t.q, m.doc_id, p.r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s JOIN i USING (q) WHERE score > 0
QUALIFY rank <= 10
"""


def _codes_sql(rounds: int = 4) -> str:
    """Integers, codebook and assignment as chained tables; each round assigns and then moves the entries."""
    down = "CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT)"
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, vec_id, label, x FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)),
y AS MATERIALIZED (SELECT r, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] AS x FROM v, range(4) AS g(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS k, x AS e FROM y WHERE r <= 256)"""
    ]
    for n in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(y.x, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts.append(f"""a{n} AS MATERIALIZED (SELECT y.r, y.p, min(CAST({distance} AS BIGINT) * 256 + b.k) AS best FROM y JOIN b{n} b ON b.p = y.p GROUP BY y.r, y.p)""")
        if n < rounds:
            parts.append(f"""b{n + 1} AS MATERIALIZED (
  SELECT b.p, b.k, coalesce(m.e, b.e) AS e FROM b{n} b LEFT JOIN (
    SELECT p, k, list({down} ORDER BY j) AS e FROM (
      SELECT y.p, a.best % 256 AS k, j, sum(x[j]) AS s, count(*) AS n FROM y JOIN a{n} a ON a.r = y.r AND a.p = y.p, range(1, 4097) AS i(j) WHERE j <= len(x) GROUP BY ALL)
    GROUP BY p, k) m ON m.p = b.p AND m.k = b.k)""")
    return f"""
WITH {", ".join(parts)},
c AS (SELECT r, string_agg(printf('%02x', CAST(best % 256 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS digest FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM c JOIN v USING (r), h
"""


OP13_SQL = _codes_sql()
