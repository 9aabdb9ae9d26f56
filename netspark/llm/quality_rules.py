"""Quality rules as weak supervision: rules vote or abstain, EM finds what each vote is worth, the posterior decides."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_top_word", "n_distinct",
          "n_upper", "n_lower", "n_digits", "n_exclaims"]
FEATURES = T.StructType([T.StructField(name, T.LongType()) for name in COUNTS])


def repeated_words(ids: np.ndarray, distinct: int, width: int = 3) -> int:
    """Words in windows of `width` words that occur twice or more."""
    if len(ids) <= width:
        return 0
    windows = ids[: len(ids) - width + 1].copy()
    span = distinct
    for k in range(1, width):
        if span * distinct >= 1 << 62:  # number the prefixes anew before codes overflow
            windows = np.unique(windows, return_inverse=True)[1]
            span = int(windows.max()) + 1
        windows = windows * distinct + ids[k: len(ids) - width + 1 + k]
        span *= distinct
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k: k + len(again)] |= again
    return int(covered.sum())


def text_counts(text: str | None) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")

    def count(chars):
        return len(data) - len(data.translate(None, chars))

    words = data.split()  # bytes split at ASCII white space only
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    top = int(np.bincount(ids).max()) if len(ids) else 0
    return (len(words), len(text or "") - count(SPACE), count(SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids, len(numbers)),
            len(lines), top, len(numbers), count(UPPER), count(LOWER), count(DIGITS), data.count(b"!"))


@F.pandas_udf(FEATURES)
def features(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(t) for t in text], columns=COUNTS)


def rules(f: str) -> dict[str, Column]:
    """Votes by rule over the struct column `f`: 1 good, -1 bad, 0 no opinion."""
    words = F.greatest(F.col(f"{f}.n_words"), F.lit(1))
    letters = F.greatest(F.col(f"{f}.n_upper") + F.col(f"{f}.n_lower"), F.lit(1))
    lines = F.greatest(F.col(f"{f}.n_lines"), F.lit(1))

    def part(name, whole=words):
        return F.col(f"{f}.{name}") / whole

    def vote(bad, good):
        return F.when(bad, -1).when(good, 1).otherwise(0)

    enough, length = F.col(f"{f}.n_words") >= 50, part("word_chars")
    return {
        "symbols": vote(part("n_symbols") > 0.1, part("n_symbols") < 0.02),
        "word_length": vote((length < 2.5) | (length > 15), (length >= 3) & (length <= 10)),
        "repeated_words": vote(part("n_repeat_words") > 0.3, part("n_repeat_words") < 0.15),
        "repeated_lines": vote((part("n_dup_lines", lines) > 0.3) & (F.col(f"{f}.n_lines") >= 6), (part("n_dup_lines", lines) < 0.1) & (F.col(f"{f}.n_lines") >= 3)),
        "upper_case": vote(part("n_upper", letters) > 0.5, part("n_upper", letters) < 0.2),
        "top_word": vote(enough & (part("n_top_word") > 0.25), enough & (part("n_top_word") < 0.15)),
        "distinct_words": vote(enough & (F.col(f"{f}.n_distinct") < 25), enough & (F.col(f"{f}.n_distinct") >= 35)),
        "digits": vote(part("n_digits", F.greatest(F.col(f"{f}.word_chars"), F.lit(1))) > 0.3, part("n_digits", F.greatest(F.col(f"{f}.word_chars"), F.lit(1))) < 0.1),
        "exclaims": vote(part("n_exclaims") > 0.3, part("n_exclaims") < 0.1),
    }


def kinds_of_junk(patterns: np.ndarray, counts: np.ndarray, least: float = 0.25, evidence: float = 16.0) -> list[list[int]]:
    """Sets of rules that all confirm each other: the largest cliques of two rules or more.

    Two rules confirm each other where their rejects correlate by `least` at
    least over the texts on which both vote, and by more than chance explains.
    """
    reject, votes = (patterns == -1).astype(float), (patterns != 0).astype(float)
    n = votes.T @ (votes * counts[:, None])
    with np.errstate(all="ignore"):
        here = reject.T @ (votes * counts[:, None]) / n
        there = here.T
        phi = np.nan_to_num((reject.T @ (reject * counts[:, None]) / n - here * there) / np.sqrt(here * (1 - here) * there * (1 - there)))
    linked = (phi >= least) & (n * phi ** 2 >= evidence)
    found = []

    def grow(members: list[int], candidates: list[int], passed: list[int]):
        if not candidates and not passed and len(members) > 1:
            found.append(members)
        for place, i in enumerate(candidates):
            near = [j for j in candidates[place + 1:] if linked[i, j]]
            grow(members + [i], near, [j for j in passed + candidates[:place] if linked[i, j]])

    grow([], list(range(patterns.shape[1])), [])
    return found


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 2000, caution: float = 0.05, least_attested: float = 0.25) -> dict:
    """EM over distinct vote patterns (rows of -1, 0, 1) and how often each occurs.

    A document is good or of one of some kinds of junk; given that, rules vote
    independently, and no opinion says nothing.  Rules that reject the same
    texts are not independent evidence of one class; each set of rules that
    confirm each other starts a kind of its own, which takes in the texts that
    they reject.  EM then finds the share of each class and each rule's chance
    of rejecting its texts, without bounds.  A rule that no other confirms
    starts no kind: its rejects count as far as EM finds them more frequent in
    junk.  Where votes fit both readings, good and junk, `caution` decides: a
    rule is thought to reject that part less of good texts, at any size of the
    table.  A kind whose rules come to reject less than `least_attested` of its
    texts is given up and the rest is fitted anew.

    Returns the kinds (lists of rules), the share of each class and the chance
    of a reject by class and rule; class 0 is good.
    """
    reject, approve = (patterns == -1).astype(float), (patterns == 1).astype(float)
    votes, kinds = reject + approve, kinds_of_junk(patterns, counts)
    trust = np.array([1 + caution] + [1.0] * len(kinds))[:, None]
    while True:
        hits = np.stack([reject[:, k].sum(axis=1) for k in kinds], axis=1) if kinds else np.zeros((len(patterns), 0))
        hit = hits.sum(axis=1, keepdims=True)
        junk = np.where(hit > 0, 0.9 * hits / np.maximum(hit, 1), 0.02 / max(len(kinds), 1))
        chance = np.hstack([1 - junk.sum(axis=1, keepdims=True), junk])
        for _ in range(rounds):
            weight = chance * counts[:, None]
            share = (weight.sum(axis=0) + 1) / (counts.sum() + 1 + len(kinds))
            rate = (weight.T @ reject + 0.05) / (trust * (weight.T @ votes) + 0.1)
            log = np.log(share) + reject @ np.log(rate).T + approve @ np.log1p(-rate).T
            after = np.exp(log - log.max(axis=1, keepdims=True))
            after /= after.sum(axis=1, keepdims=True)
            still = np.abs(after - chance).max() < 1e-9
            chance = after
            if still:
                break
        attested = [k for j, k in enumerate(kinds) if rate[j + 1, k].mean() >= least_attested]
        if len(attested) == len(kinds):
            return {"kinds": kinds, "share": share, "reject": rate}
        kinds, trust = attested, trust[: len(attested) + 1]


def fit(featured: DataFrame, f: str = "_q") -> dict:
    """Fit on the vote patterns of a whole table: 3 ** rules rows at most reach the driver."""
    names = list(rules(f))
    rows = featured.select(*[c.alias(n) for n, c in rules(f).items()]).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).collect()
    patterns = np.array([[r[n] for n in names] for r in rows], dtype=int).reshape(-1, len(names))
    order = np.lexsort(patterns.T) if len(patterns) else []
    return fit_votes(patterns[order], np.array([r["_n"] for r in rows], dtype=float)[order]) if len(patterns) else {}


def posterior(model: dict, f: str = "_q") -> Column:
    """Chance that a document is good, given its rules' votes."""
    if not model or not model["kinds"]:
        return F.lit(1.0)
    odds = F.lit(1.0)
    for k in range(1, len(model["share"])):
        against = np.log(model["reject"][k] / model["reject"][0])
        for_ = np.log1p(-model["reject"][k]) - np.log1p(-model["reject"][0])
        logit = F.lit(float(np.log(model["share"][k] / model["share"][0])))
        for j, vote in enumerate(rules(f).values()):
            logit = logit + F.when(vote == -1, float(against[j])).when(vote == 1, float(for_[j])).otherwise(0.0)
        odds = odds + F.exp(logit)
    return 1 / odds


def base_failed(f: str = "_q") -> Column:
    return (F.col(f"{f}.n_words") < 50) | (100 * F.col(f"{f}.n_repeat_words") > 50 * F.col(f"{f}.n_words"))


def judge(docs: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """`docs` with the structs _q (counts) and _verdict (base_failed, quality, kept).

    The counts are read twice: once for the fit, once for the verdict.  Null
    and empty texts have no words and fail the base rule; other columns,
    nulls and repeated rows pass through untouched.  An empty table stays empty.
    Where no two rules confirm each other, the base rule alone decides.  Input
    columns named _q or _verdict are replaced.
    """
    featured = docs.withColumn("_q", features(F.col(text)))
    return with_verdict(featured, fit(featured), threshold)


def with_verdict(featured: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    failed, quality = base_failed(), posterior(model)
    return featured.withColumn("_verdict", F.struct(failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= threshold)).alias("kept")))
