"""Personal data: base patterns, and a skip-chain conditional random field that carries their labels to related tokens."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
#: Token shapes are hashed to so many classes, which bounds the model.
SHAPES = 1 << 14
#: Message passing ends when no message changes by more than the first number; damping; and the posterior from which a token is taken.
TOLERANCE, DAMPING, CERTAIN = 1e-4, 0.3, 0.9
#: Without convergence, which loops cannot promise, it ends after so many sweeps and one more per path.
SWEEPS = 200
LIMIT = 6.0
#: Differing and agreeing skip links assumed before any are seen; their keys are narrow, so agreement is the rule.
AGREE = [1.0, 100.0]
#: Tokens of fewer digits are equal by chance more often: by their digits, agreeing links assumed to a differing one.
#: At most so many digits say little, and there an open repeat of a labelled token counts as differing.
FEW, SAME = 3, [0.1, 0.1, 1.0, 10.0, 100.0, 100.0, 100.0]
#: A number that is written in groups has at most so many digits.
LONGEST = 19

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match takes a whole run of digits, so none begins behind a digit; that keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
DIGITS, OUTER = frozenset("0123456789"), "()[]{}<>.,;:!?'\"+-*/#"
NUMBER = re.compile(r"[^\w@]*[0-9](?:[^\w@]|[0-9])*")


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_card(match: str) -> bool:
    digits = match.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns by start, then kind."""
    if not MARKED.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if is_card(m[0])]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def shape(token: str) -> int:
    """Class of a token's form: digits and letters stand for their kind, and runs of five and more are alike."""
    form = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", token))
    form = re.sub(r"(.)\1{4,}", r"\1\1\1\1\1", form)
    return zlib.crc32(form[:32].encode("utf-8", "replace")) % SHAPES


def skip_key(token: str) -> str | None:
    """Tokens with one key are likely the same thing: equal last seven digits, or equal letters and digits around an @."""
    digits = re.sub(r"[^0-9]", "", token)
    if len(digits) >= 7:
        return digits[-7:]
    return re.sub(r"[^\w@]", "", token).lower() if "@" in token else None


def group_keys(run: list[str]) -> list[tuple[int, tuple]]:
    """(place before the end, key) of the last tokens of a run of neighbouring number tokens, given by their digits, last first.

    The last seven digits of the joined run name it, so "+44 20 7946 0958" and
    "020 7946 0958" meet token by token from the end; a token before those
    seven digits meets one with equal last two digits.
    """
    joined = ""
    for p, digits in enumerate(run):
        joined = digits + joined
        if len(joined) >= 7:
            break
    if len(joined) < 7:
        return []
    name, size, out = joined[-7:], 0, []
    for p, digits in enumerate(run):
        if p and size + len(digits) > LONGEST:
            break
        out.append((p, (name, p) if size < 7 else (name, p, digits[-2:])))
        size += len(digits)
    return out


class Graph:
    """The tokens of a text that hold a digit or an @: places, shapes, links to neighbours, and skip links between related ones.

    A skip link joins an occurrence to the next one with its key, and an open one to the nearest labelled ones with its key before and
    behind it, so links grow with the tokens and not with their pairs, and a label needs no way through other open occurrences.
    Keys are those of single tokens, and of every end of a run of neighbouring tokens that are numbers, so a number in groups has them too.
    Shorter tokens are related where they are equal and one of them is labelled; these links are `repeats` (first, second, digits).
    `paths` holds all links as (table, nodes in order): table 0 for neighbours, 1 for skip links, 2 + digits for repeats.
    """

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        self.places, self.shapes, self.labels, numbers, lists = [], [], [], [], {}
        self.chain, self.paths = [], []
        at, run, equal = 0, [], {}
        for number, m in enumerate(TOKEN.finditer(text)):
            if not MARKED.search(m[0]):
                continue
            while at < len(spans) and spans[at][2] <= m.start():
                at += 1
            label = spans[at][1] + 1 if at < len(spans) and spans[at][0] < m.end() else 0
            i = len(self.places)
            if numbers and numbers[-1] == number - 1:
                self.chain.append((i - 1, i))
                self.paths[-1][1].append(i)
            else:
                self.paths.append((0, [i]))
                run = []
            bare = m[0].strip(OUTER)
            digits = re.sub(r"[^0-9]", "", m[0])
            key = skip_key(m[0])
            if NUMBER.fullmatch(m[0]):
                run = [digits, *run[: LONGEST - 1]]
                for p, name in group_keys(run):
                    lists.setdefault(name, []).append(i - p)
            else:
                run = []
                if key is not None:
                    lists.setdefault((key, 0), []).append(i)
            if key is None and bare:
                equal.setdefault(bare.lower(), []).append(i)
            self.places.append((m.start(), m.end()))
            self.shapes.append(shape(m[0]))
            self.labels.append(label)
            numbers.append(number)
        self.joined = set(self.chain)
        self.skips = [link for nodes in lists.values() for path in [nodes, *self.anchored(nodes)] for link in self.join(1, path)]
        self.repeats = []
        for bare, nodes in equal.items():
            if len(nodes) > 1 and any(self.labels[i] for i in nodes):
                size = sum(c in DIGITS for c in bare)
                self.repeats += [(*link, size) for path in [nodes, *self.anchored(nodes)] for link in self.join(2 + size, path)]
        self.paths = [p for p in self.paths if len(p[1]) > 1]

    def anchored(self, nodes: list[int]) -> list[list[int]]:
        """Each open node with the nearest labelled one before it, and with the nearest behind it."""
        out, before, behind = [], None, None
        for i in nodes:
            if self.labels[i]:
                before = i
            elif before is not None:
                out.append([before, i])
        for i in reversed(nodes):
            if self.labels[i]:
                behind = i
            elif behind is not None:
                out.append([i, behind])
        return out

    def join(self, table: int, nodes: list[int]) -> list[tuple[int, int]]:
        """Link each node to the next; a pair that is linked already stays so, as a second link would count its evidence twice."""
        links, path = [], nodes[:1]
        for link in zip(nodes, nodes[1:]):
            if link in self.joined:
                self.paths.append((table, path))
                path = [link[1]]
            else:
                self.joined.add(link)
                links.append(link)
                path.append(link[1])
        self.paths.append((table, path))
        return links


def train_counts(text: str | None) -> Counter:
    """Counts of (shape, label), of neighbouring labels and of labels at both ends of skip links, by the base labels.

    A base label is sure, its absence is not: a repeat in another form is just
    what the base misses.  So a skip link counts where both its ends are labelled;
    of the links of tokens of few digits, where repeats by chance are the rule, also those with one labelled end.
    """
    out = Counter()
    text = text or ""
    if not MARKED.search(text):
        return out
    g = Graph(text, base_spans(text))
    out.update(("shape", s, y) for s, y in zip(g.shapes, g.labels))
    left, right = {j for _, j in g.chain}, {i for i, _ in g.chain}
    out.update(("chain", g.labels[i], g.labels[j]) for i, j in g.chain)
    out.update(("chain", 0, y) for i, y in enumerate(g.labels) if i not in left)
    out.update(("chain", y, 0) for i, y in enumerate(g.labels) if i not in right)
    for i, j in g.skips:
        if g.labels[i] and g.labels[j]:
            out[("skip", int(g.labels[i] == g.labels[j]), 0)] += 1
    for i, j, size in g.repeats:
        if (g.labels[i] and g.labels[j]) or (size <= FEW and (g.labels[i] or g.labels[j])):
            out[("repeat", int(g.labels[i] == g.labels[j]), size)] += 1
    return out


def fit(docs: DataFrame) -> dict:
    """Piecewise training over all texts: each factor is estimated by itself from corpus counts.

    The counts are summed by Spark; at most SHAPES * 5 + 41 sums reach the driver.
    """
    def count(batches):
        for frame in batches:
            total = Counter()
            for text in frame["text"]:
                total.update(train_counts(text))
            yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["factor", "a", "b", "n"])

    rows = docs.select("text").mapInPandas(count, "factor string, a long, b long, n long")
    counts = {(r["factor"], r["a"], r["b"]): r["n"] for r in rows.groupBy("factor", "a", "b").agg(F.sum("n").alias("n")).collect()}
    return factors(counts)


def association(counts: np.ndarray) -> np.ndarray:
    """How much more often two labels meet than by chance, as a log ratio within LIMIT."""
    smooth = counts + 0.5
    joint = smooth / smooth.sum()
    return np.clip(np.log(joint / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True))), -LIMIT, LIMIT)


def factors(counts: dict) -> dict:
    n = len(LABELS)
    shapes, chain, agree = {}, np.zeros((n, n)), np.array(AGREE)
    same = np.array([[1.0, x] for x in SAME])
    prior = np.full(n, 0.01)
    prior[0] = 1.0
    for (factor, a, b), c in counts.items():
        if factor == "shape":
            shapes.setdefault(a, np.zeros(n))[b] += c
            prior[b] += c
        elif factor == "chain":
            chain[a, b] += c
        elif factor == "repeat":
            same[b, a] += c
        else:
            agree[a] += c
    prior /= prior.sum()
    unary = {s: np.log((c + prior) / (c.sum() + 1)) for s, c in shapes.items()}
    # One weight for agreement, whatever the label; before any data related tokens agree.
    weight = np.clip(np.log(agree[1] / agree[0] * (n - 1)), 0, LIMIT)
    repeat = np.clip(np.log(same[:, 1] / same[:, 0] * (n - 1)), 0, LIMIT)
    return {"shapes": unary, "unseen": np.log(prior), "chain": association(chain), "skip": weight * np.eye(n), "repeat": repeat[:, None, None] * np.eye(n)}


def sweep(local: np.ndarray, table: np.ndarray, tables: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Messages along all paths at once, from each first node to the last: what comes into each element, log.

    `local` is what an element knows besides its path, `place` its number in the
    path.  A message is the product of the steps before it; products of 1, 2,
    4, ... steps are put together, so a path takes the logarithm of its length.
    """
    steps = np.exp(local - local.max(axis=1, keepdims=True))[:, :, None] * np.exp(tables - tables.max(axis=(1, 2), keepdims=True))[table]
    width, longest = 1, int(place.max())
    while width < longest:
        at = np.flatnonzero(place >= width)
        both = steps[at - width] @ steps[at]
        steps[at] = both / both.max(axis=(1, 2), keepdims=True)
        width *= 2
    out = np.zeros_like(local)
    into = np.flatnonzero(place > 0)
    out[into] = np.log(np.maximum(steps[into - 1].sum(axis=1), 1e-300))
    return out - out.max(axis=1, keepdims=True)


def posteriors(g: Graph, model: dict) -> np.ndarray:
    """Label chances of a text's tokens by damped loopy message passing over chain and skip links, until messages stand still.

    A sweep passes messages along every path in both directions, so evidence
    reaches all occurrences of a key at once, however many there are.
    Neighbours that hold neither digit nor @ are known to be none.  Tokens
    under a base span are fixed to its label, so only what is open moves.
    """
    n = len(g.places)
    own = np.stack([model["shapes"].get(s, model["unseen"]) for s in g.shapes])
    inner = np.zeros((2, n), bool)
    for i, j in g.chain:
        inner[0, j] = inner[1, i] = True
    own[~inner[0]] += model["chain"][0]
    own[~inner[1]] += model["chain"][:, 0]
    for i, y in enumerate(g.labels):
        if y:
            own[i] = -1e9  # more than any number of links can say
            own[i, y] = 0.0
    if g.paths:
        sizes = np.array([len(nodes) for _, nodes in g.paths])
        node = np.concatenate([nodes for _, nodes in g.paths])
        table = np.repeat([t for t, _ in g.paths], sizes)
        place = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rest = np.repeat(sizes, sizes) - 1 - place
        tables = np.stack([model["chain"], model["skip"], *model.get("repeat", [])])
        messages = np.zeros((2, len(node), len(LABELS)))
        for _ in range(SWEEPS + len(sizes)):
            belief = own.copy()
            np.add.at(belief, node, messages[0] + messages[1])
            local = belief[node] - messages[0] - messages[1]
            fresh = np.stack([sweep(local, table, tables, place), sweep(local[::-1], table[::-1], tables.transpose(0, 2, 1), rest[::-1])[::-1]])
            change = np.abs(fresh - messages).max()
            messages = DAMPING * messages + (1 - DAMPING) * fresh
            if change < TOLERANCE:
                break
        np.add.at(own, node, messages[0] + messages[1])
    own -= own.max(axis=1, keepdims=True)
    chance = np.exp(own)
    return chance / chance.sum(axis=1, keepdims=True)


def find(text: str | None, model: dict) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of all spans of a text by start, then kind.

    Tokens outside base spans that are surely of one kind are added, without
    the punctuation around them; neighbours of one kind are one span.
    """
    text = text or ""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    if MARKED.search(text):
        g = Graph(text, base)
        if g.places:
            chance = posteriors(g, model)
            linked, previous = {j for _, j in g.chain}, None
            for i in range(len(g.places)):
                y = int(chance[i].argmax())
                if g.labels[i] or not y or chance[i, y] < CERTAIN:
                    previous = None
                    continue
                a, b = g.places[i]
                while a < b and not text[a].isalnum() and text[a] not in "+(":
                    a += 1
                while b > a and not text[b - 1].isalnum():
                    b -= 1
                if previous is not None and i in linked and previous[1] == y - 1:
                    a = previous[0]
                    out.pop()
                previous = (a, y - 1, b, False)
                out.append(previous)
    return sorted(out)


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """`docs` with the column _pii: array of (start, kind, end, base), in code points, end exclusive.

    Null and empty texts have none; the other columns, null ids and repeated
    rows pass through; an empty table stays empty, and one without personal
    data adds nothing.  An input column named _pii is replaced.
    """
    model = fit(docs) if model is None else model

    @F.pandas_udf(T.ArrayType(SPAN))
    def spans(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [dict(zip(("start", "kind", "end", "base"), s)) for s in find(t, model)], na_action=None)

    return docs.withColumn("_pii", spans("text"))
