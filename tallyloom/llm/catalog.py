"""Queries of this subpackage, each an operator applied to its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, common, divergence, jaccard, langid, media, packing, passages, pii, quality, substrings, subwords, toxicity, vectorcodes

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    got = toxicity.score(docs.select("doc_id", "text"), machine)
    return got.select("doc_id", (common.crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(common.table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(common.table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(common.table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(common.table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(common.table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    got = langid.classify(docs.select("doc_id", "text"), langid.dictionaries(docs))
    return got.select("doc_id", (common.crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(common.table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.table(spark, sf_dir, "documents"))


def op13_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    got = subwords.score(docs.select("doc_id", "text"), subwords.train(docs, common.table(spark, sf_dir, "labels")))
    return got.select("doc_id", (common.crc_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Query] = {"op1_toxicity": op1_toxicity, "op2_media": op2_media, "op4_suffix_dedup": op4_suffix_dedup, "op5_pii": op5_pii, "op6_jaccard": op6_jaccard, "op7_passages": op7_passages, "op8_quality": op8_quality, "op3_bpe": op3_bpe, "op9_packing": op9_packing, "op10_langid": op10_langid, "op11_vector_codes": op11_vector_codes, "op12_divergence": op12_divergence, "op13_subwords": op13_subwords}

#: Whole texts' words, five-word windows and lines, each host's frequent lines, and the verdict, in the operator's limits.
QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
  w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM d),
  u AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
  g AS (SELECT r, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
  h AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c, d, e) AS n FROM g WHERE e IS NOT NULL),
  rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM h WHERE n > 1) GROUP BY r),
  l AS (SELECT r, source, t, line, len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) AS size, trim(regexp_replace(regexp_replace(lower(line), '[^\\pL\\pN]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS norm
    FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
  dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
  freq AS (SELECT l.source, norm FROM l JOIN (SELECT source, count(*) AS host_docs FROM d GROUP BY source) x ON l.source IS NOT DISTINCT FROM x.source GROUP BY l.source, norm, host_docs HAVING count(DISTINCT r) >= {quality.LINE_DOCUMENTS} AND count(DISTINCT r) >= {quality.LINE_SHARE} * host_docs),
  cut AS (SELECT r, sum(size) AS cut_words FROM l SEMI JOIN freq ON l.norm = freq.norm AND l.source IS NOT DISTINCT FROM freq.source GROUP BY r),
  f AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) - coalesce(cut_words, 0) AS words_left FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN cut USING (r)),
  b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND words_left >= {quality.LEAST_WORDS} AND words_left >= {quality.LEAST_SHARE} * n_words AS kept, CAST(words_left AS BIGINT) AS words_left FROM b"""


def vector_codes_sql() -> str:
    """Every distance of every round, in whole numbers."""
    steps = [
        """k AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "z AS (SELECT greatest(1, (max(len(e)) + 7) // 8) AS w FROM k)",
        "r AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(e, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM k)",
        "x AS MATERIALIZED (SELECT r, vec_id, CAST((i - 1) // w AS INTEGER) AS part, CAST((i - 1) % w AS INTEGER) AS pos, coalesce(v[i], 0) AS x FROM (SELECT r, vec_id, v, w, unnest(range(1, 8 * w + 1)) AS i FROM r, z))",
        "f AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS entry FROM (SELECT vec_id, arg_min(r, v) AS r FROM r GROUP BY vec_id) ORDER BY vec_id NULLS LAST LIMIT 16)",
        "c0 AS MATERIALIZED (SELECT part, entry, pos, x FROM x JOIN f USING (r))",
    ]
    for k in range(vectorcodes.ROUNDS + 1):
        steps.append(f"d{k} AS (SELECT r, part, entry, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{k} c USING (part, pos) GROUP BY r, part, entry)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, d * 16 + entry) AS entry, CAST(min(d) AS BIGINT) AS d FROM d{k} GROUP BY r, part)")
        if k < vectorcodes.ROUNDS:
            steps.append(f"s{k} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} USING (r, part) GROUP BY part, entry, pos)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n + n) % n)) // n, x) AS x FROM c{k} LEFT JOIN s{k} USING (part, entry, pos))")
    end = vectorcodes.ROUNDS
    steps.append(f"h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{end})")
    steps.append(f"o AS (SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{end} GROUP BY r)")
    return "WITH " + ",\n  ".join(steps) + "\n  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN o USING (r), h"


#: Every kept term for every pair of sources, in whole numbers.
DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
  u AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  k AS (SELECT lang, term, count(*) AS whole FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST_DOCUMENTS}),
  n AS (SELECT lang, source, term, count(*) AS n FROM u SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
  v AS (SELECT lang, count(*) AS v, sum(whole) AS lang_n FROM k GROUP BY lang),
  g AS (SELECT lang, source, coalesce(s, 0) AS s, v, lang_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS s FROM n GROUP BY lang, source) USING (lang, source) LEFT JOIN v USING (lang)),
  p AS MATERIALIZED (SELECT lang, source, term, n, 1 + CAST({divergence.UNIT} AS HUGEINT) * (coalesce(n, 0) + 1) // (s + v) AS p, 1 + CAST({divergence.UNIT} AS HUGEINT) * (whole + 1) // (lang_n + v) AS whole_p FROM k JOIN g USING (lang) LEFT JOIN n USING (lang, source, term)),
  f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  e AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
  t AS (SELECT lang, source, term AS item, CAST((p - whole_p) * (p - whole_p) // whole_p AS BIGINT) AS value FROM p WHERE n > 0 AND p > whole_p)
  SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM e
  UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM t) WHERE rank <= {divergence.RANKS}"""

ORACLE_SQL: dict[str, str] = {"op8_quality": QUALITY, "op11_vector_codes": vector_codes_sql(), "op12_divergence": DIVERGENCE}
