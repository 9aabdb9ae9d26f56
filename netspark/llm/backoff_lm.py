"""Language-model scores by a weighted backoff automaton of all n-grams of a corpus.

The model grows with the corpus, so no task holds it whole.  Documents are
written in blocks; a block asks for the counts of just the n-grams its texts
contain, and the answers are the part of the automaton its texts can visit.
Requests and answers travel as packed arrays, each n-gram once per block, so a
word that makes up a third of all text is asked for no more often than others.
"""

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import stage
from netspark.llm.hashing import mixed, text_words

ORDER = 3
#: Weight of the lower order in (count + weight * lower) / (context + weight).
BACKOFF = 20.0
#: Smoothing of single tokens.
ADD = 0.1
FOLDS = 10
BLOCK_TOKENS, BUCKET_KEYS = 2_000_000, 1_500_000

END, BEGIN = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id) -> bool:
    """Every tenth document by the check sum of its id; a null id is held out."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers of up to 64 bits by the byte planes they use, compressed; behind their count and the number of planes."""
    x = x.astype("<u8")
    used = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :used].T)
    return len(x).to_bytes(7, "little") + bytes([used]) + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if used else b"")


def unpack_numbers(data: bytes) -> np.ndarray:
    n, used = int.from_bytes(data[:7], "little"), data[7]
    out = np.zeros((n, 8), np.uint8)
    if used:
        out[:, :used] = np.frombuffer(pa.decompress(data[8:], decompressed_size=used * n, codec="zstd", asbytes=True), np.uint8).reshape(used, n).T
    return out.view("<u8").reshape(-1)


def pack_keys(hashes: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return pack_numbers(np.diff(hashes, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data), dtype=np.uint64)


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of about BLOCK_TOKENS tokens: block, ids, lengths, tokens (places in words), words (sorted hashes), train_tokens, train_docs.

    A document is its words and an end token.  The table is written, so its random block names stay.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "ids", "lengths", "tokens", "words", "train_tokens", "train_docs"]

    def build(batches):
        ids, texts, size = [], [], 0

        def row():
            lengths = np.array([len(t) for t in texts], np.int64)
            words, tokens = np.unique(np.concatenate(texts), return_inverse=True)
            train = np.array([not held_out(i) for i in ids])
            return pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([pack_numbers(lengths)], pa.binary()),
                pa.array([pack_numbers(tokens)], pa.binary()), pa.array([words.tobytes()], pa.binary()),
                pa.array([int(lengths[train].sum())], pa.int64()), pa.array([int(train.sum())], pa.int64())], names=names)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for i, words in zip(batch.column("doc_id").to_pylist(), text_words(batch.column("text"))):
                ids.append(i)
                texts.append(np.append(words, END))
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    schema = f"block bigint, ids array<{key}>, lengths binary, tokens binary, words binary, train_tokens bigint, train_docs bigint"
    return stage(docs.select("doc_id", "text").mapInArrow(build, schema), "blocks")


def ngrams(lengths: np.ndarray, tokens: np.ndarray, words: np.ndarray, order: int) -> list[dict]:
    """Per order the distinct n-grams of a block: hashes, index (of each position, or -1) and contexts (index one order lower; -1: the start).

    A text begins behind a start mark; n-grams that would reach beyond it do not exist.
    """
    starts = np.zeros(len(tokens), bool)
    starts[np.cumsum(lengths)[:-1]] = True
    starts[0] = True
    out = [{"hashes": words, "index": tokens.astype(np.int32), "contexts": None}]
    for k in range(2, order + 1):
        lower = out[-1]
        context = np.empty(len(tokens), np.int64)
        context[1:] = lower["index"][:-1]
        context[starts] = -1
        absent = (context < 0) & ~starts if k == 2 else (context < 0)
        codes = (context + 1) * len(words) + tokens
        codes[absent] = -1
        kinds, index = np.unique(codes, return_inverse=True)
        skip = int(len(kinds) > 0 and kinds[0] == -1)
        kinds, index = kinds[skip:], (index - skip).astype(np.int32)
        contexts, last = (kinds // len(words) - 1).astype(np.int32), (kinds % len(words)).astype(np.int32)
        before = np.append(lower["hashes"], BEGIN)[contexts]
        out.append({"hashes": mixed(before * _PAIR + words[last] + np.uint64(k)), "index": index, "contexts": contexts, "last": last})
    return out


def block_columns(batch, i):
    lengths, tokens = (unpack_numbers(batch.column(c)[i].as_py()) for c in ("lengths", "tokens"))
    return lengths.astype(np.int64), tokens.astype(np.int64), np.frombuffer(batch.column("words")[i].as_buffer(), np.uint64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def requests(table: DataFrame, order: int, buckets: int) -> DataFrame:
    """Rows bucket, block, level, keys, counts: a block's n-grams of a bucket in order of hash, with their counts in its training texts."""
    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, tokens, words = block_columns(batch, i)
                train = np.repeat([not held_out(x) for x in batch.column("ids")[i].as_py()], lengths)
                rows = []
                for level, grams in enumerate(ngrams(lengths, tokens, words, order), 1):
                    use = train & (grams["index"] >= 0)
                    counts = np.bincount(grams["index"][use], minlength=len(grams["hashes"]))
                    by = np.argsort(grams["hashes"]) if level > 1 else slice(None)
                    hashes, counts = grams["hashes"][by], counts[by]
                    edges = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
                    # Single words keep all 64 bits; longer n-grams 48 below those that tell their bucket.
                    keys = hashes >> np.uint64(0 if level == 1 else max(0, 16 - (buckets - 1).bit_length()))
                    rows += [(b, level, pack_keys(keys[lo:hi]), pack_numbers(counts[lo:hi])) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if hi > lo]
                block = batch.column("block")[i].as_py()
                for at in range(0, len(rows), 1024):
                    part = rows[at: at + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([block] * len(part), pa.int64()),
                                                      pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary()),
                                                      pa.array([r[3] for r in part], pa.binary())], names=["bucket", "block", "level", "keys", "counts"])

    return table.select("block", "ids", "lengths", "tokens", "words").mapInArrow(ask, "bucket int, block bigint, level int, keys binary, counts binary")


def answer(table: pa.Table) -> pa.Table:
    """Sum a bucket's counts over blocks: per request the sums in its order, and once the number of n-grams seen in training."""
    parts = [unpack_keys(x.as_py()) for x in table.column("keys")]
    counts = np.concatenate([unpack_numbers(x.as_py()) for x in table.column("counts")])
    _, which = np.unique(np.concatenate(parts), return_inverse=True)
    sums = np.bincount(which, weights=counts).astype(np.int64)
    every = sums[which]
    edges = np.cumsum([0] + [len(p) for p in parts])
    seen = [int((sums > 0).sum())] + [0] * (len(parts) - 1)
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "level": table.column("level"),
                     "sums": pa.array([pack_numbers(every[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary()), "seen": pa.array(seen, pa.int64())})


def automaton(grams: list[dict], counts: list[np.ndarray], total: int, distinct: int, docs: int, backoff: float) -> tuple[list, list]:
    """Arc and failure weights, log10: per order, the weight of reading an n-gram's last token in the state of its context, and of that state's failure arc.

    A state is a context seen in training; its failure arc leads to the context
    without its first token and weighs backoff / (count + backoff).  An arc
    read in a state mixes in the next lower arc.  In the root every token has
    an arc.  An n-gram never seen has no arc (NaN), an unseen context no state.
    """
    root = np.log10((counts[0] + ADD) / (total + ADD * (distinct + 1)))
    arcs, fails = [root], [None]
    lower = 10.0 ** root
    for k, level in enumerate(grams[1:], 2):
        context = np.append(counts[k - 2], docs)[level["contexts"]].astype(float)
        # The next lower n-gram drops the first token of this one; for pairs it is the token itself.
        below = lower[level["last"]] if k == 2 else lower[level["suffix"]]
        known = context > 0
        chance = np.where(known, (counts[k - 1] + backoff * below) / (context + backoff), below)
        arcs.append(np.where(counts[k - 1] > 0, np.log10(chance), np.nan))
        fails.append(np.where(known, np.log10(backoff / (context + backoff)), 0.0))
        lower = chance
    return arcs, fails


def traverse(grams: list[dict], arcs: list, fails: list) -> np.ndarray:
    """Weight of each token of the block's texts, read left to right.

    Before a token the state is the longest known context of at most order - 1
    tokens, which is all a text carries on.  From there failure arcs are
    followed, adding their weights, until a state has an arc for the token.
    As the state depends on the last tokens only, every position takes its
    step at once, from the highest order down.
    """
    weight = np.zeros(len(grams[0]["index"]))
    done = np.zeros(len(weight), bool)
    for level, arc, fail in reversed(list(zip(grams[1:], arcs[1:], fails[1:]))):
        at = np.flatnonzero(~done & (level["index"] >= 0))
        which = level["index"][at]
        step = arc[which]
        taken = ~np.isnan(step)
        weight[at] += np.where(taken, step, fail[which])
        done[at[taken]] = True
    at = np.flatnonzero(~done)
    weight[at] += arcs[0][grams[0]["index"][at]]
    return weight


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are an end token.  Null ids are held out; repeated rows
    count as often as they stand there.  Other columns are not read.  An empty
    table gives an empty table.  Without training texts every token is unknown.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    table = blocks(docs)
    train_tokens, train_docs = table.agg(F.sum("train_tokens"), F.sum("train_docs")).first()
    total, trained = int(train_tokens or 0), int(train_docs or 0)
    # Enough buckets that the requests of one hold about BUCKET_KEYS keys.
    buckets = max(1, -(-total * order // BUCKET_KEYS))
    asked = requests(table, order, buckets)
    answers = stage(asked.groupBy("level", "bucket").applyInArrow(answer, "block bigint, bucket int, level int, sums binary, seen bigint"), "answers")
    distinct = int(answers.filter("level = 1").agg(F.sum("seen")).first()[0] or 0)
    schema = f"doc_id {key}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        lengths, positions, words = block_columns(left, 0)
        grams = ngrams(lengths, positions, words, order)
        got = sorted(zip(right.column("level").to_pylist(), right.column("bucket").to_pylist(), right.column("sums").to_pylist()))
        counts = []
        for k, level in enumerate(grams, 1):
            ordered = np.concatenate([unpack_numbers(x[2]) for x in got if x[0] == k] or [np.empty(0, np.uint64)]).astype(np.int64)
            mine = np.empty(len(ordered), np.int64)
            mine[np.argsort(level["hashes"]) if k > 1 else slice(None)] = ordered
            counts.append(mine)
            if k > 2:  # the n-gram one shorter that ends at the same position
                at = level["index"] >= 0
                level["suffix"] = np.zeros(len(level["hashes"]), np.int32)
                level["suffix"][level["index"][at]] = grams[k - 2]["index"][at]
        arcs, fails = automaton(grams, counts, total, distinct, trained, backoff)
        edges = np.cumsum(lengths) - lengths
        sums = {"n_known": counts[0][positions] > 0, "base_score": arcs[0][positions], "score": traverse(grams, arcs, fails)}
        sums = {k: np.add.reduceat(v.astype(np.int64 if v.dtype == bool else float), edges) for k, v in sums.items()}
        ids = left.column("ids")[0].as_py()
        return pa.table({"doc_id": pa.array(ids, left.schema.field("ids").type.value_type), "held_out": pa.array([held_out(i) for i in ids]),
                         "n_tokens": pa.array(lengths, pa.int64()), "n_known": pa.array(sums["n_known"], pa.int64()),
                         "train_tokens": pa.array(np.full(len(ids), total), pa.int64()),
                         "base_score": pa.array(sums["base_score"]), "score": pa.array(sums["score"])})

    mine = table.select("block", "ids", "lengths", "tokens", "words").groupBy("block")
    return mine.cogroup(answers.select("block", "level", "bucket", "sums").groupBy("block")).applyInArrow(read, schema)
