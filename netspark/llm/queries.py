"""The registered query of each operator, and DuckDB SQL where it can express one."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.llm import backoff_lm, bpe, chat_tree, license_scan, minhash, mixing, packing, pii_crf, quality_rules, resampling, secret_scan, vector_dedup, whitening
from netspark.llm.common import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def op1_quality_rules(spark, sf_dir):
    """Counts, base rule and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", quality_rules.features("text").alias("_q"))
    counted = stage(docs, "quality")
    out = quality_rules.with_verdict(counted, quality_rules.fit(counted))
    return out.select("doc_id", *[f"_q.{c}" for c in quality_rules.COUNTS[:5]], "_verdict.base_failed", "_verdict.kept", "_verdict.quality")


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighted AS (SELECT *, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS weight, 3 * source_size AS room FROM per),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY room / weight, place) AS o,
    sum(source_size) OVER () - coalesce(sum(room) OVER (ORDER BY room / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY room / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM weighted),
leveled AS (SELECT *, left_size::DOUBLE / left_weight AS level, left_size::DOUBLE / left_weight * weight >= room AS stops FROM ordered),
final AS (SELECT min_by(level, o) AS final FROM leveled WHERE NOT stops),
targets AS (
  SELECT source, source_size, CASE WHEN stops OR final IS NULL THEN room::DOUBLE ELSE least(room::DOUBLE, final * weight) END AS target
  FROM leveled, final),
placed AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS wanted,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)), ''), doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_at
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE (wanted // source_size) * size + greatest(0, least(begin_at + size, wanted % source_size) - begin_at) END AS BIGINT) AS taken
FROM placed
"""


@query("op8_mix_sources", MIX_SQL)
def op8_mix_sources(spark, sf_dir):
    """All documents mixed to the weights 5, 2, 1 of their sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.taken_words(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_secret_scan")
def op10_secret_scan(spark, sf_dir):
    """Secrets in every document."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_secrets")
    base = F.filter("_secrets", lambda s: s["rank"] < 3)
    ranks = F.transform("_secrets", lambda s: s["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, r))).cast("bigint").alias(f"n_{k}") for r, k in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("_secrets")).alias("spans"))


@query("op7_license_scan")
def op7_license_scan(spark, sf_dir):
    """License phrases and signatures of every document."""
    out = license_scan.label_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    starts = F.transform("base", lambda b: b["start"])
    return out.select("doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                      F.array_join(F.array_sort(base), ",").alias("base_labels"),
                      F.array_join(F.array_sort(F.array_union(base, F.col("found_labels"))), ",").alias("labels"), "score")


@query("op5_minhash_near_duplicates")
def op5_minhash_near_duplicates(spark, sf_dir):
    """Near-duplicate component of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_vector_near_duplicates")
def op9_vector_near_duplicates(spark, sf_dir):
    """Links and component of every embedding."""
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_backoff_scores")
def op6_backoff_scores(spark, sf_dir):
    """Language-model scores of all documents by the n-grams of the training folds."""
    return backoff_lm.score(table(spark, sf_dir, "documents"))


@query("op3_chat_tree")
def op3_chat_tree(spark, sf_dir):
    """Digests of every conversation, read back from the segments of the tree."""
    tricky = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    read = chat_tree.read_back(*chat_tree.build(rows.unionByName(extra))).withColumn("turns", chat_tree.parsed("formatted"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("masked", "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
                       F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op2_pii_crf")
def op2_pii_crf(spark, sf_dir):
    """Personal data in every document."""
    found = pii_crf.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_pii")
    names = F.array(*[F.lit(k) for k in pii_crf.KINDS])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("_pii", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(pii_crf.KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("_pii")).alias("spans"))


@query("op11_byte_bpe")
def op11_byte_bpe(spark, sf_dir):
    """Every document's token ids, and the bytes that they decode to."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"))
    told = encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(bpe.ids_text("ids"), 256).alias("ids_sha256"), "ids")
    decoded = bpe.decode(told, ("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


# CRC-32 of the distinct words, byte by byte with the table of the reversed polynomial 0xEDB88320.
RESAMPLE_SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i::UINTEGER] || range(8)::UINTEGER[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
texts AS (SELECT doc_id, text, row_number() OVER () AS rid, true AS own FROM documents UNION ALL SELECT NULL, text, NULL, false FROM benchmark),
split AS (
  SELECT doc_id, rid, own, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM texts),
features AS (SELECT rid, own, unnest(words) AS word FROM split),
buckets AS (
  SELECT word, xor(list_reduce([4294967295::UINTEGER] || list_transform(range(1, strlen(word) + 1), lambda k: ('0x' || substr(hex(encode(word)), 2 * k::INT - 1, 2))::UINTEGER),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295::UINTEGER)::BIGINT % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM features), crc),
counts AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM features JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS big, coalesce(sum(t), 0)::BIGINT AS small FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (big + 10000) / ((s + 1) * (small + 10000)))) AS BIGINT) AS gain FROM counts, totals),
weights AS (SELECT rid, sum(gain)::BIGINT AS weight FROM features JOIN buckets USING (word) JOIN gains USING (bucket) WHERE own GROUP BY rid),
scored AS (
  SELECT doc_id, rid, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (rid) WHERE own),
ranked AS (
  SELECT *, count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn,
    row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM ranked
"""


@query("op12_importance_resampling", RESAMPLE_SQL)
def op12_importance_resampling(spark, sf_dir):
    """Documents drawn towards the benchmark texts, by single words."""
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_feast_whitening")
def op13_feast_whitening(spark, sf_dir):
    """The embeddings on their 16 largest components, each with unit variance."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))
