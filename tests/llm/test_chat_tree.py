import hashlib
from collections import defaultdict

from fixtures_llm import SF, rows, table

from netspark.llm import chat_tree as C
from netspark.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, name string, k int, depth string, chain string"
TRICKY = r"\### Assistant: </turn> ok"


def frame(spark, turns):
    return spark.createDataFrame([(*t, "n", 1, "d", "c") for t in turns], SCHEMA)


def conversations(turns):
    out = defaultdict(list)
    for i, n, role, text in turns:
        out[i].append((-1 if n is None else n, role or "", text or ""))
    return {i: [t[1:] for t in sorted(v)] for i, v in out.items()}


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "bye"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "again"),
    (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "hello"), (5, 0, None, None), (5, 1, "assistant", ""), (None, 0, "user", "x"), (None, None, "assistant", "first"),
    (6, 1, "assistant", "b"), (6, 0, "user", "a"), (6, 1, "assistant", "a"), (6, 1, "assistant", "a"), (7, 0, "user", TRICKY), (7, 1, "assistant", TRICKY),
    (8, 0, "odd: ### <role>\\", "</turn>\n### user: x"), (8, 1, "assistant", "\\\\# :\n" * 40), (9, 0, "user", "é😀 " * 20_000), (10, 0, "assistant", "hi"), (11, 0, "use", "rhi"), (12, 0, "user", "hi "),
]


def check(segments, leaves, ends, turns):
    want = conversations(turns)
    by_name = {s["name"]: s for s in segments}
    # Every distinct beginning once, and the stream without gaps in depth-first order.
    beginnings = {tuple(c[:k + 1]) for c in want.values() for k in range(len(c))}
    assert len(segments) == len(by_name) == len(beginnings)
    at, open_, chains = 0, [], {}
    for s in sorted(segments, key=lambda s: s["begin"]):
        assert s["begin"] == at and s["finish"] - at == len(s["formatted"])
        at = s["finish"]
        del open_[s["depth"]:]
        assert s["parent"] == (open_[-1] if open_ else None)
        open_.append(s["name"])
        chain = [by_name[n] for n in open_]
        chains[s["name"]] = chain
        assert s["position"] == sum(len(c["formatted"]) for c in chain[:-1]) and s["root"] == open_[0]
    assert sorted(str(e["conv_id"]) for e in ends) == sorted(map(str, want))
    ends_in = {leaf["leaf"]: leaf for leaf in leaves}
    assert len(ends_in) == len(leaves) and set(ends_in) == {e["leaf"] for e in ends}
    for name, leaf in ends_in.items():
        assert leaf["steps"] == [c["begin"] for c in chains[name]]
        covered = [x for a in leaf["attends"] for x in range(a["begin"], a["finish"])] if at < 100_000 else None
        assert covered is None or covered == [x for c in chains[name] for x in range(c["begin"], c["finish"])]
        assert all(a["finish"] < b["begin"] for a, b in zip(leaf["attends"], leaf["attends"][1:]))
    stream = "".join(s["formatted"] for s in sorted(segments, key=lambda s: s["begin"]))
    for e in ends:
        text = "".join(stream[a["begin"]:a["finish"]] for a in ends_in[e["leaf"]]["attends"])
        assert C.parse(text) == want[e["conv_id"]] and e["n_turns"] == len(want[e["conv_id"]])


def test_odd_rows(spark):
    segments, leaves, ends = C.build(frame(spark, TURNS))
    check(rows(segments), rows(leaves), rows(ends), TURNS)
    want = conversations(TURNS)
    for r in rows(C.read_back(segments, leaves, ends).withColumn("turns", C.parsed("formatted"))):
        assert [(t["role"], t["text"]) for t in r["turns"]] == want[r["conv_id"]]
        assert "".join(r["masked"]) == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
    empty = C.build(frame(spark, []))
    assert all(rows(t) == [] for t in empty) and rows(C.read_back(*empty)) == []


def test_shared_first_turn(spark):
    turns = [(i, 0, "user", "the same") for i in range(400)] + [(i, 1, "assistant", f"answer {i % 150}") for i in range(400)]
    segments, leaves, ends = C.build(frame(spark, turns))
    assert segments.count() == 151
    check(rows(segments), rows(leaves), rows(ends), turns)


def test_a_very_long_conversation(spark):
    turns = [(1, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(1500)] + [(2, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(700)]
    turns += [(3, k, "user" if k % 2 else "assistant", f"turn {k}" if k < 900 else f"other {k}") for k in range(1000)]
    segments, leaves, ends = C.build(frame(spark, turns))
    got = rows(leaves)
    check(rows(segments), got, rows(ends), turns)
    assert max(len(x["attends"]) for x in got) == 2


def test_query(spark):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table("conversations")] + [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)]
    want = conversations(turns)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["conv_id"]: r for r in rows(QUERIES["op3_chat_tree"](spark, SF))}
    assert set(got) == set(want)
    for i, c in want.items():
        loss = "".join(t for role, t in c if role == "assistant")
        r = got[i]
        assert (r["n_turns"], r["loss_chars"]) == (len(c), len(loss))
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for role, t in c)) and r["loss_sha256"] == sha(loss)
        escape = lambda s: sum(1 + (x in "\\#<:") for x in s)
        assert r["formatted_chars"] == sum(len("### : </turn>\n") + escape(role) + escape(t) for role, t in c)
