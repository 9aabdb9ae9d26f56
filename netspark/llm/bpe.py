"""Byte-level BPE encoding and decoding by merge rounds over length-bucketed matrices.

The words of a batch of texts (matches of the vocabulary's split pattern) are
encoded once each: those of like length are the rows of one padded matrix of
ids, every row merges its leftmost pair of least rank in each round, finished
rows leave the matrix and the others lose a column.  A pair's rank comes from
an open-addressing hash table of all pairs that join to a token.
"""

import base64
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank of a pair that is no token, and the filling of rows.
NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: Widths of the matrices; a longer word is a row of its own (long_row).
WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128)
#: Cells of a matrix, bytes of texts taken together, matches of a longer text taken together.
CELLS, TOGETHER, MATCHES = 1 << 20, 1 << 22, 1 << 18
#: Code points of words whose ids a task remembers.
REMEMBERED = 1 << 23


class Vocabulary:
    """Ranks of a public .tiktoken file.  A token's id is its rank, as there."""

    def __init__(self, name: str):
        import public_tokenizers
        import regex

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self._hash_pairs()

    def _hash_pairs(self) -> None:
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys, ranks = np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, EMPTY), np.full(1 << bits, NONE)
        at = keys * SPREAD >> self.shift
        while len(keys):
            free = np.flatnonzero(self.keys[at] == EMPTY)
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], ranks[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, ranks, at = keys[rest], ranks[rest], at[rest] + np.uint64(1) & self.last

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where they do not join (or one of them is filling)."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = keys * SPREAD >> self.shift
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], NONE)
        todo = np.flatnonzero((held != keys) & (held != EMPTY))
        while len(todo):
            at[todo] = at[todo] + np.uint64(1) & self.last
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held != EMPTY)]
        return out

    def matrix_rows(self, ids: np.ndarray) -> list[tuple]:
        """Merged ids of each row of a matrix that is filled with NONE at the right."""
        out: list[tuple] = [()] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            low = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                filled = ids[done] != NONE
                ends = np.cumsum(filled.sum(1))
                flat = ids[done][filled].tolist()
                for row, begin, end in zip(rows[done].tolist(), (ends - filled.sum(1)).tolist(), ends.tolist()):
                    out[row] = tuple(flat[begin:end])
                ids, ranks, rows, best, low = ids[~done], ranks[~done], rows[~done], best[~done], low[~done]
                if not len(rows):
                    break
            # The pair becomes one id and all to its right moves up: each row and the matrix lose a column.
            each, cols = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)
            ids[each, best] = low
            if ids.shape[1] == 1:
                ranks = np.empty((len(rows), 0), np.int32)
                continue
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, cols + (cols >= best[:, None]), 1)
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best < ids.shape[1] - 1)
            ranks[left, best[left] - 1] = self.rank(ids[left, best[left] - 1], low[left])
            ranks[right, best[right]] = self.rank(low[right], ids[right, best[right] + 1])
        return out

    def long_row(self, ids: np.ndarray) -> np.ndarray:
        """Merged ids of one long word.

        A round merges all places of the least pair from the left, up to the
        first whose new id opens a pair of lower rank, which is due next.  The
        ids are those of single merges, leftmost first, in far fewer rounds.
        """
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks) and (low := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == low)
            # Of overlapping places every other one from the left.
            begins = np.append(True, np.diff(at) != 1)
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0]
            side = np.full(len(at), NONE)
            before, after = side.copy(), side.copy()
            before[at > 0] = ids[at[at > 0] - 1]
            before[1:][np.diff(at) == 2] = low
            inside = at + 2 < len(ids)
            after[inside] = ids[at[inside] + 2]
            new = np.full(len(at), low)
            opens = np.flatnonzero(np.minimum(self.rank(before, new), self.rank(new, after)) < low)
            if len(opens):
                at = at[:opens[0] + 1]
            ids = np.delete(ids, at + 1)
            ranks = np.delete(ranks, at)
            place = at - np.arange(len(at))
            ids[place] = low
            for pair in (place[place > 0] - 1, place[place < len(ranks)]):
                ranks[pair] = self.rank(ids[pair], ids[pair + 1])
        return ids

    def encode_words(self, words: list[str]) -> dict[str, tuple]:
        """Ids of distinct words.  A word that is a token is that token, as in the tiktoken library."""
        out, buckets = {}, {}
        for word in words:
            data = word.encode()
            if (rank := self.ranks.get(data)) is not None:
                out[word] = (rank,)
            elif len(data) > WIDTHS[-1]:
                out[word] = tuple(self.long_row(self.of_byte[np.frombuffer(data, np.uint8)]).tolist())
            else:
                buckets.setdefault(int(np.searchsorted(WIDTHS, len(data))), []).append((word, data))
        for bucket, members in buckets.items():
            width = WIDTHS[bucket]
            for begin in range(0, len(members), CELLS // width):
                some = members[begin:begin + CELLS // width]
                lengths = np.fromiter((len(d) for _, d in some), np.int64, len(some))
                ids = np.full((len(some), width), NONE)
                ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(d for _, d in some), np.uint8)]
                out.update(zip((w for w, _ in some), self.matrix_rows(ids)))
        return out


@lru_cache
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


class _Encoder:
    """Ids of texts, with the ids of words met before."""

    def __init__(self, name: str):
        self.vocabulary, self.known, self.size = vocabulary(name), {}, 0

    def ids(self, words: list[list[str]]) -> list[np.ndarray]:
        """Ids of each list of words."""
        if self.size > REMEMBERED:
            self.known, self.size = {}, 0
        known = self.known
        new = list(set().union(*words).difference(known))
        known.update(self.vocabulary.encode_words(new))
        self.size += sum(map(len, new))
        return [np.fromiter(itertools.chain.from_iterable(map(known.__getitem__, w)), np.int32) for w in words]

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        find = self.vocabulary.pattern
        return self.ids([find.findall(t) for t in texts])

    def long_text(self, text: str) -> np.ndarray:
        matches = (m.group() for m in self.vocabulary.pattern.finditer(text))
        return np.concatenate([np.empty(0, np.int32), *(self.ids([some])[0] for some in iter(lambda: list(itertools.islice(matches, MATCHES)), []))])


def _groups(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of texts of TOGETHER bytes at most; a longer text is a run of its own."""
    out, begin, total = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and total + size > TOGETHER:
            out.append((begin, i))
            begin, total = i, 0
        total += size
    return out + [(begin, len(sizes))] * (begin < len(sizes))


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *values])))


def _schema(df: DataFrame, carry: tuple, name: str, kind: str) -> str:
    if name in carry:
        raise ValueError(f"column {name} is the result's, carry it under another name")
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry), f"{name} {kind}"])


def encode(docs: DataFrame, carry: tuple = ("doc_id",), text: str = "text", tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """The carried columns of docs and `ids`, the ids of the text without special tokens.

    A null or empty text has no ids (an empty list).  Rows are independent, so
    nulls, ties and repeated rows in the carried columns pass through; other
    columns are not read.  A text of any length is split as a whole and held
    one stretch of words at a time.  An empty table gives an empty table.
    """
    width = len(carry)

    def run(batches):
        encoder = _Encoder(tokenizer)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(width)), 0).to_numpy(zero_copy_only=False)
            for begin, end in _groups(sizes):
                part = batch.slice(begin, end - begin)
                texts = [t or "" for t in part.column(width).to_pylist()]
                out = [encoder.long_text(texts[0])] if sizes[begin] > TOGETHER else encoder.texts(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], _lists(out)], names=[*carry, "ids"])

    return docs.select(*carry, text).mapInArrow(run, _schema(docs, carry, "ids", "array<int>"))


def decode(encoded: DataFrame, carry: tuple = ("doc_id",), ids: str = "ids", tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """The carried columns and `bytes`, what the ids stand for; encoding and decoding a text gives its UTF-8 bytes.

    An empty list gives no bytes.  A null list, or one with a null or an id
    that is not in the vocabulary, gives null.
    """
    width = len(carry)

    def run(batches):
        tokens = vocabulary(tokenizer).tokens
        for batch in batches:
            lists = batch.column(width)
            out = []
            for row in lists:
                values = row.values
                if values is None:
                    out.append(None)
                    continue
                low, high = pa.compute.min_max(values).as_py().values() if len(values) else (0, 0)
                unknown = values.null_count or low < 0 or high >= len(tokens)
                out.append(None if unknown else b"".join(map(tokens.__getitem__, values.to_numpy().tolist())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(out, pa.binary())], names=[*carry, "bytes"])

    return encoded.select(*carry, ids).mapInArrow(run, _schema(encoded, carry, "bytes", "binary"))


def ids_text(ids: str) -> Column:
    """Decimal ids with one space between."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
