"""One registered query for each training-data operator, over its whole table, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from critiq.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] ELSE w END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * i >= 80 * (u.n + v.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM t UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT t.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, t.doc_id = min(r.c) AS kept
FROM t JOIN r ON r.v = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id
""")
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from critiq.llm.minhash_dedup import minhash_groups

    return minhash_groups(table(spark, sf_dir, "documents"), width=2, similarity_pct=80)


def _crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def _ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from critiq.llm.toxicity import toxicity_scores, train

    docs = table(spark, sf_dir, "documents")
    learn = table(spark, sf_dir, "labels").filter(_crc_mod(3) != 1)
    scores = toxicity_scores(docs.select("doc_id", "text"), train(docs, learn))
    return scores.select("doc_id", (_crc_mod(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x != '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x != '') AS v FROM benchmark),
masks(k, gap) AS (VALUES (0, [4]), (1, [3, 7]), (2, [5])),
ds AS (SELECT doc_id, w, p, k, array_to_string([CASE WHEN list_contains(gap, j) THEN '' ELSE w[p + j + 1] END for j in range(0, 9)], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 8)) AS p FROM d), masks),
bs AS (SELECT item_id, v, q, k, array_to_string([CASE WHEN list_contains(gap, j) THEN '' ELSE v[q + j + 1] END for j in range(0, 9)], ' ') AS s
  FROM (SELECT item_id, v, unnest(range(0, len(v) - 8)) AS q FROM b), masks),
h AS (SELECT DISTINCT doc_id, item_id, w, v, p, q, least(len(v), 20) AS n FROM ds JOIN bs USING (k, s)),
f AS (SELECT doc_id, item_id, list_max([list_sum([CASE WHEN p - q + i >= 0 AND w[p - q + i + 1] = v[i + 1] THEN 1 ELSE 0 END for i in range(z, z + n)])
  for z in range(greatest(0, q + 9 - n), least(q, len(v) - n) + 1)]) / n AS share FROM h),
g AS (SELECT doc_id, item_id, max(share) AS share FROM f GROUP BY 1, 2 HAVING max(share) >= 0.75),
e AS (SELECT doc_id, count(*) AS n, max(share) AS best FROM g GROUP BY 1)
SELECT d.doc_id, e.n IS NOT NULL AS contaminated, coalesce(e.n, 0)::BIGINT AS n_items, coalesce(e.best, 0.0)::DOUBLE AS best_share FROM d LEFT JOIN e USING (doc_id)
""")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from critiq.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(x) > 0 AND list_sum([(y IS NULL OR NOT isfinite(y))::INT for y in x]) = 0 AND list_sum([(y != 0)::INT for y in x]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id != b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS v, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.c) AS component_id, v.vec_id = min(r.c) AS kept
FROM v JOIN r ON r.v = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id
""")
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from critiq.llm.embedding_dedup import embedding_groups

    return embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.95)


@query()
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from critiq.llm.byte_bpe import bpe_round_trip

    back = bpe_round_trip(table(spark, sf_dir, "documents"), _ranks())
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from critiq.llm.language_id import languages, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(_crc_mod(4) != 2))
    return languages(docs, model).select("doc_id", (_crc_mod(4) == 2).alias("held_out"), "lang_pred", "score")


@query()
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from critiq.llm.common import shared_folder
    from critiq.llm.token_files import read_token_files, write_token_files

    folder = shared_folder(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from critiq.llm.pii import distinct_key, pseudonymise

    docs = table(spark, sf_dir, "documents")
    docs = pseudonymise(docs, key=distinct_key(docs, "critiq"))
    return docs.select("doc_id", F.size("pii").cast("long").alias("n_entities"), F.array_sort(F.array_distinct("pii.kind")).alias("kinds"), "text")


@query()
def op9_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from critiq.llm.quote_links import reply_ordered

    return reply_ordered(table(spark, sf_dir, "conversations"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS s FROM pages),
q AS (SELECT page_id, CASE WHEN s > 0 THEN substr(url, s + 3) ELSE '' END AS rest FROM p),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM q),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY h.page_id, host, path ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
""")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from critiq.llm.url_filter import url_verdicts

    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


@query("""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size::DOUBLE AS cap, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source) AS k FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - (sum(cap) OVER (ORDER BY k) - cap)) / (sum(w) OVER () - (sum(w) OVER (ORDER BY k) - w)) AS level FROM o),
g AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
  ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '-') || ':' || t), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS draw
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""")
def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from critiq.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"), weights=[5, 2, 1], share=1.5, cap=2.0, out_col="mix")
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from critiq.llm.mixing import words
    from critiq.llm.periodic_runs import periodic_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", words(F.col("text")).alias("n"))
    g = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 10)
    docs = docs.withColumn("a", F.when((_crc_mod(10) == 0) & (F.col("n") > 0), g % F.greatest("n", F.lit(1))))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))
    runs = periodic_runs(docs, repeat_from=F.col("a"), repeat_period=period)
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("runs", "collapsed")]
    return runs.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests)


@query("""
WITH RECURSIVE bits AS (SELECT range(256) AS v),
crc_table AS (SELECT [list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for b in v] AS t FROM bits),
d AS (SELECT doc_id, source, text, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END, CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
  xor(4294967295, list_reduce(list_concat([4294967295], [ascii(x) for x in string_split(doc_id::VARCHAR, '')]), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) AS crc
  FROM documents, crc_table),
h AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  CASE WHEN text IS NOT NULL AND crc % 2 = 0 THEN sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) END AS other FROM d),
n0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM h),
t(lv, source, i, n, node) AS (SELECT 0, source, i, n, leaf FROM n0 UNION ALL
  SELECT lv + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lv, source, i // 3, n),
s AS (SELECT source, node, lv AS top, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lv, i, n, node) AS (SELECT 0, i, n, node FROM s UNION ALL SELECT lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lv, i // 3, n),
f(doc_id, source, i0, lv, pos, n, folded, proof) AS (SELECT doc_id, source, i, 0, i, n, coalesce(other, leaf), '' FROM n0 UNION ALL
  SELECT f.doc_id, f.source, f.i0, f.lv + 1, f.pos // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN t.i = f.pos THEN f.folded ELSE t.node END, '' ORDER BY t.i)),
    f.proof || coalesce(string_agg(t.node, '' ORDER BY t.i) FILTER (t.i != f.pos), '')
  FROM f JOIN t ON t.lv = f.lv AND t.source IS NOT DISTINCT FROM f.source AND t.i // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.doc_id, f.source, f.i0, f.lv, f.pos, f.n, f.folded, f.proof),
g(doc_id, source, i0, lv, pos, n, folded, proof) AS (SELECT f.doc_id, f.source, f.i0, 0, s.i, s.n, f.folded, f.proof FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source AND f.n = 1 UNION ALL
  SELECT g.doc_id, g.source, g.i0, g.lv + 1, g.pos // 3, (g.n + 2) // 3, sha256(string_agg(CASE WHEN u.i = g.pos THEN g.folded ELSE u.node END, '' ORDER BY u.i)),
    g.proof || coalesce(string_agg(u.node, '' ORDER BY u.i) FILTER (u.i != g.pos), '')
  FROM g JOIN u ON u.lv = g.lv AND u.i // 3 = g.pos // 3 WHERE g.n > 1 GROUP BY g.doc_id, g.source, g.i0, g.lv, g.pos, g.n, g.folded, g.proof)
SELECT g.doc_id, n0.leaf, s.node AS subroot, r.node AS root, sha256(g.proof) AS proof_sha256, g.folded AS folded_root, g.folded = r.node AS verified
FROM g JOIN n0 ON n0.source IS NOT DISTINCT FROM g.source AND n0.i = g.i0 JOIN s ON s.source IS NOT DISTINCT FROM g.source, (SELECT node FROM u WHERE n = 1) r WHERE g.n = 1
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from critiq.llm.merkle import digest, field, fold, manifest, siblings

    docs = table(spark, sf_dir, "documents")
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    broken = F.when(_crc_mod(2) == 0, digest(*head, field(F.replace("text", F.lit("\n"), F.lit("")))))
    whole = manifest(docs.select("doc_id", "source", digest(*head, field(F.col("text"))).alias("leaf"), broken.alias("tampered")))
    folded = whole.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
