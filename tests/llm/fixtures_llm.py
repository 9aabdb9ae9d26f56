"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns."""

import os
import re

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions under a pale silver moon tonight "
LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(60_000))
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, rank int, _q string, n_words string, text_hash string, length string, begin string"

TEXTS = [
    (None, PROSE * 4, "s1"), (None, None, None), (1, None, "s1"), (2, "", "s2"), (3, " \t\n\x0b ", None), (4, LONG, "s1"),
    (5, PROSE * 6, "s3"), (6, PROSE * 6, "s3"), (7, PROSE * 6 + "and more", "s1"), (8, "one two", "s2"), (8, "one two", "s2"),
    (9, "one two", "s1"), (10, "One TWO", "s1"), (11, "x", "s1"), (12, "   É \x85", "s4"), (13, LONG + " tail", "s1"),
    (14, "a\nb\na\n\n\nb\nA", "s2"), (15, "z z z z z z z z z z " * 8, "s5"), (16, "#$% & | < > *** " * 30, "s1"),
]


def odd_docs(spark, texts=TEXTS):
    rows = [(i, t, "en", s, len(t) if t is not None else None, 3, 1, "q", "w", "h", "l", "b") for i, t, s in texts]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def words(text, lower=False):
    data = (text or "").encode()
    if lower:
        data = data.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]


def rows(df):
    return df.toArrow().to_pylist()


def use_path():
    """Executors import the package by PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.environ["PYTHONPATH"] = root + ":" + os.environ.get("PYTHONPATH", "")
