"""Registered queries of this subpackage, beside their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bagminhash, crosspolytope, linededup, mixing, outliers, pieces, pii, records, tokens, toxicity, variants, whitening, winnowing,
)
from tidemark.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op2_robust_outliers")
def robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"
    )


@query("op3_winnowing")
def winnowed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_edit(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


@query("op9_token_records")
def token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encode_to_records(table(spark, sf_dir, "documents"))


@query("op8_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.delete_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("text_sha256"))


@query("op6_bagminhash")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("root").alias("class_root"))


@query("op10_toxicity_chain")
def toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "p_poor", "p_toxic", "p_toxic_prose", "rejected")


@query("op7_piece_codec")
def piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"))


@query("op5_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digests(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


# The checksum is computed from a table made by its polynomial; near words meet on (position, word without it) and on the shorter word.
ORACLES["op12_spelling_variants"] = r"""WITH RECURSIVE
crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
  lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) GROUP BY ALL),
hashed AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([
    CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + unicode(ch)::BIGINT // 64, 128 + unicode(ch)::BIGINT % 64] END
    FOR ch IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, '')])),
    lambda c, b: xor(c >> 8, t[(xor(c, b) % 256) + 1])), 4294967295::BIGINT) AS h FROM runs, crc WHERE length(w) >= 6),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT x.word, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.a || c.b
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.a || c.b),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
forms AS (SELECT word, other AS form, other_n AS form_n FROM best JOIN words USING (word) WHERE other_n >= 5 * n),
chain AS (SELECT word, word AS root, 0 AS depth FROM words UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.root),
roots AS (SELECT word, max_by(root, depth) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM words LEFT JOIN best USING (word) LEFT JOIN forms USING (word) JOIN roots USING (word)"""


@query("op12_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


@query("op13_cross_polytope")
def cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
