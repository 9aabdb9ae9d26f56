"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and
read again as the next one's documents.  All but the last return the columns of
documents.  Nulls, empty texts, ties, repeated rows and other columns are
handled as the operators say; columns of any name pass through.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm import minhash, mixing, packing, quality_rules, secret_scan
from netspark.llm.common import stage


def fingerprint(docs: DataFrame):
    """128 bits that name a row by its values and by which of its columns are null."""
    row = F.struct("*")
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in docs.columns])
    return F.struct(F.xxhash64(nulls, row).alias("a"), F.xxhash64(row, nulls).alias("b"))


def with_copies(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of docs as often as `keys` (_key, rows, copies) says for all rows of a fingerprint together.

    Rows that stand once, nearly all, are only joined.  Of those that stand
    several times, equal in all columns, one is taken and repeated.
    """
    names = docs.columns
    marked = docs.select(F.struct("*").alias("_row"), fingerprint(docs).alias("_key"))
    met = marked.join(keys.filter("copies > 0"), "_key")
    few = met.filter("rows > 1").groupBy("_key").agg(F.first("_row").alias("_row"), F.first("rows").alias("rows"), F.first("copies").alias("copies"))
    met = met.filter("rows = 1").unionByName(few)
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col("_row")[n].alias(n) for n in names])


def quality(spark, docs, sf_dir):
    """Documents that the quality rules keep."""
    judged = quality_rules.judge(docs.select(F.struct("*").alias("_row"), "text"))
    return judged.filter("_verdict.kept").select(*[F.col("_row")[n].alias(n) for n in docs.columns])


def near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate group, that of the smallest id; rows without an id stay."""
    found = minhash.near_duplicates(docs)
    once = found.filter("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    met = docs.select(F.struct("*").alias("_row"), "doc_id").join(once, F.col("doc_id") == F.col("_id"))
    # An id that stands several times is one group; the row of the smallest fingerprint stays.
    several = met.filter("_n > 1").groupBy("_id").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    kept = met.filter("_n = 1").select("_row").unionByName(several.select("_row"))
    kept = kept.unionByName(docs.filter("doc_id IS NULL").select(F.struct(*docs.columns).alias("_row")))
    return kept.select(*[F.col("_row")[n].alias(n) for n in docs.columns])


def secrets(spark, docs, sf_dir):
    """Documents with their secrets replaced by a mark, and n_chars as it is then."""
    found = secret_scan.scan(docs.select(F.struct("*").alias("_row"), "text"))
    clean = found.withColumn("_clean", secret_scan.redacted(F.col("text"), F.col("_secrets")))
    new = {"text": F.col("_clean"), "n_chars": F.when(F.size("_secrets") > 0, F.length("_clean")).otherwise(F.col("_row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
           if "n_chars" in docs.columns else None}
    return clean.select(*[(F.col("_row")[n] if new.get(n) is None else new[n]).alias(n) for n in docs.columns])


def mix(spark, docs, sf_dir):
    """Documents as often as the mix begins them: repeats and omissions bring the sources to their target weights.

    The document at which a source's target is reached is taken whole.
    """
    keyed = docs.select("doc_id", "text", "source", fingerprint(docs).alias("_key"))
    taken = mixing.taken_words(keyed, extra=("_key",))
    keys = taken.groupBy("_key").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
    return with_copies(docs, keys)


def pack(spark, docs, sf_dir):
    """The pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mix), ("packing", pack)]

#: The verdict of the quality rules comes from a fit by expectation-maximisation, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"after-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
