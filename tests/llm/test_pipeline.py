import re

import pytest
from fixtures_llm import SF, TEXTS, empty_docs, odd_docs, rows, table

import corpus_pipeline as P
from netspark.llm import minhash, secret_scan
from netspark.llm.common import stage
from test_minhash import expected as groups
from test_packing import check as check_packing
from test_quality_rules import counted, failed
from test_secret_scan import expected as secrets

STAGES = dict(P.STAGES)


def run(spark, name, docs):
    return stage(STAGES[name](spark, docs, SF), "test")


def texts_of(df):
    return sorted(str(tuple(r.values())) for r in rows(df))


def test_names_and_registration(spark):
    import __spark_entry__ as entry
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mixing", "packing"]
    assert entry.queries()["pipeline"] is P.run
    names = [k for k in entry.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in names) == list(range(1, 14))


@pytest.mark.parametrize("docs", ["given", "odd"])
def test_each_stage(spark, docs):
    given = docs == "given"
    df = spark.read.parquet(f"{SF}/documents.parquet") if given else odd_docs(spark)
    start = rows(df)
    kept = run(spark, "quality_rules", df)
    assert kept.columns == df.columns and set(texts_of(kept)) <= set(texts_of(df))
    if given:
        labels = {r["doc_id"]: r["quality"] for r in table("labels")}
        left = {r["doc_id"] for r in rows(kept)}
        clean = [d["doc_id"] for d in start if labels.get(d["doc_id"]) == 1 and not failed(counted(d["text"]))]
        junk = [i for i, q in labels.items() if q == 0]
        assert sum(i in left for i in clean) >= 0.98 * len(clean) and sum(i in left for i in junk) <= 0.1 * len(junk)
    source = kept if given else df
    before = rows(source)
    once = run(spark, "near_duplicates", source)
    part = groups([(d["doc_id"], d["text"]) for d in before])
    assert sorted(r["doc_id"] for r in rows(once) if r["doc_id"] is not None) == sorted(set(part.values()))
    assert sum(r["doc_id"] is None for r in rows(once)) == sum(d["doc_id"] is None for d in before)
    clean = run(spark, "secrets", once)
    marked = {(r["doc_id"], r["source"]): r for r in rows(clean)}
    for r in rows(once):
        new = marked[r["doc_id"], r["source"]]
        found = secrets(r["text"])
        assert (new["text"] == r["text"] and new["n_chars"] == r["n_chars"]) if not found else new["text"].count("[SECRET]") >= 1 and new["n_chars"] == len(new["text"])
        assert {k: v for k, v in new.items() if k not in ("text", "n_chars")} == {k: v for k, v in r.items() if k not in ("text", "n_chars")}
    mixed = run(spark, "mixing", clean)
    assert mixed.columns == df.columns
    whole, times = texts_of(clean), texts_of(mixed)
    assert set(times) <= set(whole) and max((times.count(t) / whole.count(t) for t in set(times)), default=0) <= 3
    packed = rows(run(spark, "packing", mixed))
    by = {}
    for r in rows(mixed):
        by.setdefault((r["doc_id"], r["text"]), 0)
        by[r["doc_id"], r["text"]] += 1
    check_packing(packed, [(i, t) for (i, t), n in by.items() for _ in range(n)])


def test_empty_table_runs_through(spark):
    docs = empty_docs(spark)
    for name, _ in P.STAGES:
        docs = run(spark, name, docs)
        assert docs.count() == 0


def test_repeated_rows_mix_as_often_as_their_copies(spark):
    docs = odd_docs(spark, [(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "e " * 40, "y"), (3, "f " * 40, "z")])
    got = rows(run(spark, "mixing", docs))
    assert 2 <= sum(r["doc_id"] == 1 for r in got) <= 6
    assert len(TEXTS) and minhash.BANDS and secret_scan.KINDS


def test_rows_that_differ_in_which_column_is_null_are_told_apart(spark):
    docs = spark.createDataFrame([(1, None, "x", "a b c"), (1, "x", None, "a b c")], "doc_id bigint, source string, lang string, text string")
    names = [tuple(r[0]) for r in docs.select(P.fingerprint(docs)).collect()]
    assert names[0] != names[1]
    got = {(r["source"], r["lang"]) for r in rows(run(spark, "mixing", docs))}
    assert got == {(None, "x"), ("x", None)}


def test_run_equals_stages(spark):
    out = rows(P.run(spark, SF))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(out[0])
    again = rows(P.run(spark, SF))
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, out)) == sorted(map(key, again))
