"""Best-fit packing of tokenized documents by bulk-synchronous rounds."""

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import class_rank, salts_for, stage

CAPACITY = 2048
END_ID = 0
# Corpora of this many sequences spare one a round.
MANY = 1000


@lru_cache
def encoder(name: str):
    """text -> ids of a public byte-level BPE vocabulary.

    The same vocabulary is read by two libraries; the faster one counts for
    ordinary texts, and a text that holds a special token's string goes to the other.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return ids


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k", keep_ids: bool = False) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32 (and ids): documents cut where longer than a sequence.

    A document is its ids and an end id, so an empty or null text has one id.
    The first piece takes what is over, so that the others fill a sequence each.
    """
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids

    def cut(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            took, cols = [], {n: [] for n in names}
            for i, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity if len(ids) > capacity else len(ids)
                ends = [*([first] if first else []), *range(first + capacity, len(ids) + 1, capacity)]
                begin = 0
                for p, end in enumerate(ends):
                    data = ids[begin:end].tobytes()
                    took.append(i)
                    for n, v in zip(names, (p, begin, end - begin, zlib.crc32(data), data)):
                        cols[n].append(v)
                    begin = end
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(took, pa.int64())),
                                              *[pa.array(cols[n], t) for n, t in zip(names, types)]], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def sweep(open_docs: np.ndarray, gaps: np.ndarray, capacity: int, spare: int = 0) -> tuple[list, list]:
    """One round over the size classes: (fits, opens).

    Both arrays count by size.  From the longest documents down, each class
    takes its successors, the smallest gaps that hold it; a gap is matched once
    a round, with as many documents of the class as it holds.  Ranks inside the
    classes settle who gets what: a fit (size, first gap rank, gaps, length,
    first document, per gap, documents) says so for a run of equal gaps.  Then the
    longest documents left open new sequences, as many as are needed by now, and
    at least one where nothing fitted.  `spare` sequences are opened a round even
    if the gaps may do, which ends in fewer rounds.
    """
    todo, free, matched = open_docs.copy(), gaps.copy(), np.zeros(capacity + 1, np.int64)
    begun, after = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    fits, opens = [], []
    lengths = [int(x) for x in np.nonzero(todo)[0][::-1]]
    sizes = [int(x) for x in np.nonzero(free)[0]]
    for length in lengths:
        for size in [s for s in sizes if s >= length]:
            if not todo[length]:
                break
            if not free[size]:
                continue
            each = size // length
            used = min(int(free[size]), -(-int(todo[length]) // each))
            took = min(int(todo[length]), used * each)
            fits.append((size, int(matched[size]), used, length, int(begun[length]), each, took))
            rest = took - (used - 1) * each
            after[size - each * length] += used - 1
            after[size - rest * length] += 1
            matched[size] += used
            free[size] -= used
            todo[length] -= took
            begun[length] += took
        sizes = [s for s in sizes if free[s]]
    sizes = np.arange(capacity + 1)
    # So many sequences are still needed whatever happens; opening two thirds of them a round keeps the packing tight and the rounds few.
    need = (int((todo * sizes).sum()) - int(((free + after) * sizes).sum())) / capacity
    left = np.nonzero(free + after)[0]
    may, largest = max(spare if fits else 1, int(need * 2 / 3)), int(left[-1]) if len(left) else 0
    for length in lengths:
        if not todo[length]:
            continue
        alone = length > max(largest, capacity // 2)  # fits no gap and no second document of its kind
        if may <= 0 and not alone:
            break
        each = capacity // length
        n = int(todo[length]) if alone else min(int(todo[length]), may * each)
        opens.append((length, int(begun[length]), n, each, -(-n // each)))
        may -= -(-n // each)
    return fits, opens


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Pieces are ranked inside their length and gaps inside their size (the range
    sort; sizes are whole numbers up to `capacity`, so the two count tables
    that a round sends to the driver have at most that many rows).  A round
    sweeps successors over the classes, joins pieces and gaps by rank, writes
    the gaps that remain, and repeats until every piece has a place.
    """
    spark = cut.sparkSession
    order = ["doc_id", "piece", "start", "ids_crc32"]
    total = cut.count()
    ranked = stage(class_rank(cut, "length", order, F.xxhash64(*order), salts_for(total), "rank"), "ranked", salts_for(total))
    todo = np.zeros(capacity + 1, np.int64)
    for row in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        todo[row["length"]] = row["n"]
    spare = int((todo * np.arange(capacity + 1)).sum() >= MANY * capacity)
    first = np.zeros(capacity + 1, np.int64)  # rank of the first piece without a place, by length
    sequences, gaps, rounds, opened = 0, None, [], []
    fit_schema = "size bigint, low bigint, used bigint, length bigint, begin bigint, each bigint, took bigint"
    open_schema = "length bigint, begin bigint, n bigint, each bigint, base bigint"
    while todo.any():
        count = np.zeros(capacity + 1, np.int64)
        if gaps is not None:
            least = int(np.nonzero(todo)[0][0])
            gaps = gaps.filter(F.col("gap") >= least)
            for row in gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n")).collect():
                count[row["gap"]] = row["n"]
        fits, opens = sweep(todo, count, capacity, spare)
        after = None
        if fits:
            plan = spark.createDataFrame([(s, lo, u, length, int(first[length]) + b, e, t) for s, lo, u, length, b, e, t in fits], fit_schema)
            placed = class_rank(gaps, "gap", ["sequence_id"], F.xxhash64("sequence_id"), salts_for(int(count.sum())), "_rank")
            plan = plan.withColumnRenamed("size", "_size")
            placed = placed.join(F.broadcast(plan), (F.col("gap") == F.col("_size")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("low") + F.col("used")), "left")
            skip = (F.col("_rank") - F.col("low")) * F.col("each")
            placed = placed.select("sequence_id", "gap", "length", (F.col("begin") + skip).alias("begin"),
                                   F.least(F.col("each"), F.col("took") - skip).alias("n"))
            placed = stage(placed, "round", salts_for(int(count.sum())))
            rounds.append(placed.filter("length IS NOT NULL").select("sequence_id", (F.lit(capacity) - F.col("gap")).alias("filled"), "length", "begin", "n"))
            used = F.coalesce(F.col("n") * F.col("length"), F.lit(0))
            after = placed.select("sequence_id", (F.col("gap") - used).alias("gap"))
        elif gaps is not None:
            after = gaps
        if opens:
            rows = []
            for length, begun, n, each, new in opens:
                rows.append((length, int(first[length]) + begun, n, each, sequences))
                sequences += new
            opened += rows
            plan = F.broadcast(spark.createDataFrame(rows, open_schema))  # one row per length at most
            at = F.col("rank") - F.col("begin")
            fresh = ranked.select("length", "rank").join(plan, "length").filter((at >= 0) & (at < F.col("n")) & (at % F.col("each") == 0))
            fresh = fresh.select((F.col("base") + F.floor(at / F.col("each"))).alias("sequence_id"),
                                 (F.lit(capacity) - F.col("length") * F.least(F.col("each"), F.col("n") - at)).alias("gap"))
            after = fresh if after is None else after.unionByName(fresh)
        for _, _, _, length, _, _, took in fits:
            todo[length] -= took
            first[length] += took
        for length, _, n, _, _ in opens:
            todo[length] -= n
            first[length] += n
        gaps = after.filter("gap > 0")
    at = F.col("rank") - F.col("_begin")
    plan = spark.createDataFrame(opened, open_schema).withColumnsRenamed({"begin": "_begin", "length": "_length"})
    # A length opens in more than one round only if gaps came between; its runs of ranks do not overlap.
    firsts = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (at >= 0) & (at < F.col("n")))
    firsts = firsts.select(*ranked.columns, (F.col("base") + F.floor(at / F.col("each"))).alias("sequence_id"), (at % F.col("each") * F.col("length")).alias("offset"))
    if not rounds:
        return firsts.drop("rank")
    matched = rounds[0]
    for more in rounds[1:]:
        matched = matched.unionByName(more)
    k = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")  # at most capacity / length pieces in a gap
    matched = matched.select("sequence_id", "filled", "length", "begin", k).select(
        "sequence_id", (F.col("filled") + F.col("k") * F.col("length")).alias("offset"), "length", (F.col("begin") + F.col("k")).alias("rank"))
    # Both sides grow with the corpus, however well their files compress.
    others = ranked.join(matched.hint("merge"), ["length", "rank"]).select(*ranked.columns, "sequence_id", "offset")
    return firsts.unionByName(others).drop("rank")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Pieces of all documents with their places.

    Null and empty texts are one end id; null ids and repeated rows are
    documents like others (equal rows may swap places); other columns are not
    read.  An empty table gives an empty table.
    """
    return pack(stage(pieces(docs, capacity, tokenizer), "pieces"), capacity)
