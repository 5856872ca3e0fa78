"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by 2-word shingles at similarity 0.8."""
    from agroclime.llm.near_dedup import near_duplicates

    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2, percent=80)
    return found.withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                 ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), rows AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM rows x JOIN rows y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), low AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN low l ON l.id = s.doc_id
"""

def op9_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    from agroclime.llm.warc import archive, read_records

    return read_records(archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
top AS (SELECT html, max(page_id) AS last FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    1 + ((('0x' || hex[10 * (i // 8) + 1 : 10 * (i // 8) + 10])::BIGINT >> (35 - 5 * (i % 8))) & 31)]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN top USING (html)
"""


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    from agroclime.llm.chat import chat_format

    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP10_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
), c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn) AS turns FROM t GROUP BY conv_id),
whole AS (SELECT turns, min(conv_id) AS conv_id FROM c GROUP BY turns),
prefixes AS (SELECT DISTINCT turns[1:i] AS p FROM (SELECT turns, unnest(range(1, len(turns))) AS i FROM c))
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns,
  list_aggregate(list_transform(turns, lambda x: '<|' || replace(x.r, '<|', '< |') || '|>' || chr(10) || replace(x.t, '<|', '< |') || '<|end|>' || chr(10)),
                 'string_agg', '') AS rendered
FROM whole ANTI JOIN prefixes ON whole.turns = prefixes.p
"""

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the public rank file and decoded again."""
    import public_tokenizers

    from agroclime.llm.bpe import encode_documents

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, ["n_tokens", "ids_sha256", "decoded_sha256"])


def op8_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its similarity."""
    from agroclime.llm.decontaminate import contaminated

    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    from agroclime.llm.pii import detect

    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def learnable(doc_id, parts: int, held: int):
    """Whether crc32 of the id as text, modulo ``parts``, is another remainder than ``held``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1)) != held


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of them is held out of training."""
    from agroclime.llm.langid import fit, predict

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(learnable(F.col("doc_id"), 4, 2)), "doc_id", "text", "lang")
    return predict(docs, model).withColumn("held_out", ~learnable(F.col("doc_id"), 4, 2)).select("doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches")


def op7_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a third of them is held out of training."""
    from agroclime.llm.quality import score_documents

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, labels, lambda doc_id: learnable(doc_id, 3, 1))
    return scored.withColumn("held_out", ~learnable(F.col("doc_id"), 3, 1)).select("doc_id", "held_out", "score", "predicted")


def op5_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte windows of earlier documents."""
    from agroclime.llm.repeats import remove_repeats

    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (
  SELECT doc_id, s, substr(x, 2 * s + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS s FROM h WHERE n >= 50)
), f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
hits AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM w JOIN f USING (g) WHERE first < doc_id),
islands AS (
  SELECT doc_id, s, sum(CASE WHEN s <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM hits
), runs AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM islands GROUP BY doc_id, k),
spans AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, n, coalesce(gone, 0) AS gone, coalesce(len(a), 0) AS m, list_aggregate(list_transform(range(0, coalesce(len(a), 0) + 1),
    lambda i: substr(x, 2 * coalesce(b[i], 0) + 1, 2 * (coalesce(a[i + 1], n) - coalesce(b[i], 0)))), 'string_agg', '') AS left_over
  FROM h LEFT JOIN spans USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(m AS BIGINT) AS n_spans,
  sha256(unhex(left_over)) AS kept_sha256 FROM kept
"""


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vector."""
    from agroclime.llm.nndescent import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 100 == 0)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the distribution of the benchmark texts."""
    from agroclime.llm.importance import resample

    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), texts AS (
  SELECT 0 AS side, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark
), words AS (
  SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), counted AS (SELECT side, id, f, count(*) AS n FROM features GROUP BY ALL),
kinds AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)),
buckets AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM kinds, tab
), held AS (
  SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM counted JOIN buckets USING (f) GROUP BY bucket
), sums AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM held),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM held, sums
), weights AS (
  SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
  FROM counted JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
), noise AS (
  SELECT id AS doc_id, len(w) AS n_words,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS g
  FROM words WHERE side = 0
), scores AS (
  SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + g AS score
  FROM noise LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scores LEFT JOIN ranked USING (doc_id)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh vector has the next label."""
    from agroclime.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", label), lambda vec_id: vec_id % 100 == 0)


OP12_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), mates AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM mates JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

PACKING_TOKENIZER = "byte_bpe_50k.json"


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    import public_tokenizers

    from agroclime.llm.packing import pack_documents

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(PACKING_TOKENIZER))



def importable(query):
    """The query, after telling Python workers where this package lies, so that it works from any current folder."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        known = spark.sparkContext.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_nn_descent": op1_nn_descent,
    "op2_pii_boosted": op2_pii_boosted,
    "op3_language_crf": op3_language_crf,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_repeated_windows": op5_repeated_windows,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_quality_pu": op7_quality_pu,
    "op8_simhash_decontamination": op8_simhash_decontamination,
    "op9_warc_chunks": op9_warc_chunks,
    "op10_chat_snapshots": op10_chat_snapshots,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_best_fit_packing": op13_best_fit_packing,
}
QUERIES = {name: importable(query) for name, query in QUERIES.items()}
ORACLE = {
    "op4_minhash_near_dedup": OP4_SQL,
    "op5_repeated_windows": OP5_SQL,
    "op9_warc_chunks": OP9_SQL,
    "op10_chat_snapshots": OP10_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
