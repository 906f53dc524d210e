"""The registered queries of this subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from permspark.llm import collocations, decontaminate, html_text, licenses, mixing, nearest, quality, secrets, simhash, spelling, token_files, url_filter, warc

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from permspark.sources.writers import staged

    files = warc.write_archives(table(spark, sf_dir, "pages"))
    found = warc.resolve_revisits(staged(warc.read_archives(files, keep=False).drop("payload")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("n_linked")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality.judge(docs, quality.fit(docs, labels)).select("doc_id", *quality.STATS, "base_failed", "kept", "score")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


#: Words of a text and their positions, as in the operator.
_WORDS = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"

#: The rule by another way: 13 words with at most 2 replaced hold 4 equal words in a row, shorter items with one replaced an equal half, so overlaps
#: are found by those and counted.
OP1_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
cut AS (SELECT item_id, least(len(w), 13) AS n, list_slice(w, a, a + least(len(w), 13) - 1) AS v
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS a FROM items WHERE w[1] <> '')),
windows AS (SELECT DISTINCT item_id, n, v FROM cut),
parts AS (SELECT DISTINCT v, n, unnest(CASE WHEN n = 13 THEN [{{'o': o, 'l': 4}} FOR o IN range(1, 11)] WHEN n < 5 THEN [{{'o': 1, 'l': n}}]
            ELSE [{{'o': 1, 'l': n // 2}}, {{'o': n // 2 + 1, 'l': n - n // 2}}] END) AS p FROM windows),
keys AS (SELECT v, n, p.o AS o, p.l AS l, array_to_string(list_slice(v, p.o, p.o + p.l - 1), ' ') AS k FROM parts),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, l, p, array_to_string(list_slice(w, p, p + l - 1), ' ') AS k
           FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM docs, (SELECT DISTINCT l FROM keys) WHERE len(w) >= l)),
hits AS (SELECT DISTINCT doc_id, p - o AS start, v, n, list_slice(w, p - o + 1, p - o + n) AS part
         FROM places JOIN keys USING (k, l) WHERE p - o >= 0 AND p - o + n <= len(w)),
good AS (SELECT doc_id, start, v FROM hits
         WHERE list_sum([CASE WHEN part[i] = v[i] THEN 1 ELSE 0 END FOR i IN range(1, n + 1)]) >= n - CASE WHEN n = 13 THEN 2 WHEN n >= 5 THEN 1 ELSE 0 END)
SELECT doc_id, item_id, count(DISTINCT start) AS n_places, min(start)::INTEGER AS first_word, max(start)::INTEGER AS last_word
FROM good JOIN windows USING (v) GROUP BY ALL
"""

#: Writing sources once, sharing and capping as in the operator, in one recursive-free statement.
OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, hash(text) AS h, CASE WHEN trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 0
    ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 2.0 * source_size AS cap,
  CASE (row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS w FROM sources),
levels AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level, cap / w AS ratio
  FROM weighed WINDOW before AS (ORDER BY cap / w, source IS NULL, source::BLOB ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, least(cap, w * (SELECT max(level) FROM levels WHERE level <= ratio))::DOUBLE AS target FROM levels),
keyed AS (SELECT s.doc_id, s.size, g.source_size, g.target, round(g.target)::BIGINT AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('20:' || coalesce(s.doc_id::VARCHAR, '')), s.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(greatest(budget % source_size - earlier, 0), size) END::BIGINT AS taken
FROM keyed
"""

#: Every phrase as a string, counted and scored at once.
OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
counts AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT *, array_to_string(w[: k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS rest
         FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM counts WHERE m > 1)),
scores AS (SELECT c.lang, c.phrase, c.m, c.f AS a, x.f AS l, y.f AS r, n, k, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
           FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM weakest w WHERE NOT EXISTS (
           SELECT 1 FROM counts c WHERE c.lang = w.lang AND c.m > w.m AND c.f >= w.a AND contains(' ' || c.phrase || ' ', ' ' || w.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase::BLOB) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_html_text, op3_simhash, op4_token_files, op5_warc, op6_secrets, op7_mixing, op8_quality_rules,
        op9_licenses, op10_url_filter, op11_collocations, op12_spelling, op13_nearest,
    )
}
ORACLES = {"op1_decontamination": OP1_SQL, "op7_mixing": OP7_SQL, "op11_collocations": OP11_SQL}
