"""Importance resampling towards a target: hashed n-gram features, gains per bucket, Gumbel top-k.

Words and their offsets come from an untrained pre-tokenizer (a split by a
regular expression) over text whose A-Z are lower case.  Windows of offsets are
n-gram features, a feature's CRC names its bucket, and a document keeps only
its histogram, which has `buckets` entries at most however long the text is.
"""

import hashlib
import math
import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import running_sums, stage

#: Words: runs of anything but ASCII signs, where A-Z have become lower case.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of a text that are split at a time; a longer text is cut where no word is.
STRETCH = 1 << 20


@dataclass(frozen=True)
class Settings:
    """What a draw depends on: longest n-gram, buckets, share of the documents, least words of a document, seed."""
    ngrams: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


def stretches(data: bytes, size: int) -> list[bytes]:
    """Cuts of lower-cased UTF-8 text at ASCII signs, of about `size` bytes; a word that is longer stays whole."""
    sign = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
    out, begin = [], 0
    while len(data) - begin > size:
        met = sign.search(data, begin + size)
        if met is None:
            break
        out.append(data[begin:met.start()])
        begin = met.start()
    return [*out, data[begin:]]


def words_of(splitter, text: str | None) -> tuple[list[str], np.ndarray]:
    """Words of a text, a character for each UTF-8 byte, and their offsets (bytes of the lower-cased text, end exclusive).

    No byte of a sign beyond ASCII separates words, so bytes may be split like characters.
    """
    words, offsets, base = [], [np.empty(0, np.int64)], 0
    for part in stretches((text or "").encode().translate(LOWER), STRETCH):
        found = splitter.pre_tokenize_str(part.decode("latin-1"))
        words += [word for word, _ in found]
        offsets.append(np.fromiter(chain.from_iterable(pair for _, pair in found), np.int64, 2 * len(found)) + base)
        base += len(part)
    return words, np.concatenate(offsets).reshape(-1, 2)


def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)


def windows(offsets: np.ndarray, n: int) -> np.ndarray:
    """Offset pairs of the runs of n words, where each word is one byte behind the one before it."""
    lengths = offsets[:, 1] - offsets[:, 0]
    ends = np.cumsum(lengths + 1) - 1
    return np.column_stack([(ends - lengths)[:len(ends) - n + 1], ends[n - 1:]])


def histogram(words: list[str], offsets: np.ndarray, settings: Settings, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with a feature and their counts.  `known` holds CRCs of single words."""
    for w in set(words).difference(known):
        known[w] = zlib.crc32(w.encode("latin-1"))
    crcs = [np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
    joined = " ".join(words).encode("latin-1") if settings.ngrams > 1 else b""
    for n in range(2, min(settings.ngrams, len(words)) + 1):
        pairs = windows(offsets, n).tolist()
        crcs.append(np.fromiter((zlib.crc32(joined[a:b]) for a, b in pairs), np.int64, len(pairs)))
    return np.unique(np.concatenate(crcs) % settings.buckets, return_counts=True)


def histograms(docs: DataFrame, settings: Settings = Settings(), carry: tuple = ("doc_id",)) -> DataFrame:
    """The carried columns, n_words, n_features, and the buckets with their counts of every whole text.

    Null, empty and wordless texts have no features.  Other columns are not read.
    """
    width = len(carry)
    names = [*carry, "n_words", "n_features", "buckets", "counts"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry),
                        "n_words bigint, n_features bigint, buckets array<int>, counts array<bigint>"])

    def run(batches):
        split, known = splitter(), {}
        for batch in batches:
            n_words, n_features, buckets, counts = [], [], [], []
            for text in batch.column(width):
                words, offsets = words_of(split, text.as_py())
                if len(known) > 1 << 18:
                    known.clear()
                bucket, count = histogram(words, offsets, settings, known)
                n_words.append(len(words))
                n_features.append(int(count.sum()))
                buckets.append(bucket)
                counts.append(count)
            ends = pa.array(np.cumsum([0, *map(len, buckets)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *values]), kind))
                     for values, kind in ((buckets, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), *lists], names=names)

    return docs.select(*carry, "text").mapInArrow(run, schema)


def bucket_sums(found: DataFrame) -> dict[int, int]:
    """Features per bucket over all rows: as many entries as there are buckets at most."""
    pairs = found.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return {r[0]: r[1] for r in pairs.groupBy("p.buckets").agg(F.sum("p.counts").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Per bucket, thousandths of the logarithm of its share in the target over its share in the source, each with one added."""
    big, small = sum(source.values()) + buckets, sum(target.values()) + buckets
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * big / ((source.get(b, 0) + 1) * small))) for b in range(buckets)], np.int64)


def gumbel(seed: int, key) -> int:
    """Thousandths of a Gumbel variate that only the seed and the key decide."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(found: DataFrame, gain: np.ndarray, settings: Settings, key: str = "doc_id") -> DataFrame:
    """Rows key, n_words, n_features, weight (sum of gains over the features), score (weight and noise)."""
    schema = f"`{key}` {found.schema[key].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint, score bigint"

    def run(batches):
        for batch in batches:
            buckets, counts = batch.column(3), batch.column(4)
            ends = np.append(0, np.cumsum(gain[buckets.flatten().to_numpy()] * counts.flatten().to_numpy()))
            offsets = np.cumsum([0, *buckets.value_lengths().to_pylist()])
            weight = ends[offsets[1:]] - ends[offsets[:-1]]
            noise = np.array([gumbel(settings.seed, k) for k in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64()), pa.array(weight + noise, pa.int64())],
                                             names=[key, "n_words", "n_features", "weight", "score"])

    return found.select(key, "n_words", "n_features", "buckets", "counts").mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), key: str = "doc_id") -> DataFrame:
    """Every document's key, n_words, n_features, weight, score and rank (1, 2, ... of the drawn ones, else null).

    Drawn are the highest scores, in number `percent` of the documents with
    `least_words` words or more, ties to the smaller key, then to fewer
    features.  A null key is drawn like others and last among ties; rows that
    repeat a key share its noise; equal rows get ranks in any order.  Null and
    empty texts have weight 0.  With an empty target or empty documents the
    gains rest on the added ones.  Other columns are not read.
    """
    found = stage(histograms(docs.select(key, "text"), settings, (key,)), "histograms")
    gain = gains(bucket_sums(found), bucket_sums(histograms(target.select("text"), settings, ())), settings.buckets)
    # A number per row, fixed by writing it, tells equal rows apart, so that very many of them need not meet in one task.
    rows = stage(scored(found, gain, settings, key).withColumn("_row", F.monotonically_increasing_id()), "scores")
    fit = F.col("n_words") >= settings.least_words
    drawn = settings.percent * rows.filter(fit).count() // 100
    columns = [key, "n_words", "n_features", "weight", "score"]
    ordered = running_sums(rows.filter(fit), [-F.col("score"), F.col(key), F.col("n_features"), F.col("_row")], {"before": F.lit(1).cast("bigint")}, "ranks")
    ranked = ordered.select(*columns, F.when(F.col("before") < drawn, F.col("before") + 1).cast("bigint").alias("rank"))
    return ranked.unionByName(rows.filter(~fit).select(*columns, F.lit(None).cast("bigint").alias("rank")))
