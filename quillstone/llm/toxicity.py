"""Toxicity by weak supervision.

1. Terms: over labelled training rows (a sample of at most `sample_rows`, the documented bound of what is fitted) Spark counts
   by term in how many toxic and other documents it stands. Terms are words and word beginnings of 4 and 5 letters, which reach
   inflected and compounded forms. Those much likelier in toxic documents, and in at least `TERM_SUPPORT` groups of near copies
   among them, make the lexicons. Labels choose words only; how far each lexicon is to be believed is not read from them. The support is the same for any input, so terms of rare languages count.
2. Voters: lexicons of words, lexicons of beginnings, fixed lexicons, and patterns (density, insult beside a pronoun, shouting,
   no term at all). A voter votes or abstains.
3. A generative label model is fitted to the votes of every document that is not held out, labelled or not: Spark counts how
   often each combination of votes occurs, and all combinations, weighted by their counts, go through expectation-maximisation: on
   the driver up to `MAX_PATTERNS` of them, else every step is a pass over their table. It starts from how many voters vote, not from
   labels. A class has its rate; within a class each voter depends on one other voter (the maximum spanning tree of their conditional
   mutual information, with a rate for either vote of that voter), so accuracies and correlations are both parameters of the model.
   Languages and manners of insult make groups of votes of their own, so a class is split in two again, `LEVELS` times in all.
4. Labels name the model's classes: a class is as toxic as the labelled training rows in it.
5. A logistic classifier on term and density features is trained on the labelled sample's posteriors; its slope and offset are then
   calibrated on the sample's labels. It scores every whole text.

Labels are read for training rows only and are no input of a score, as are lang, source and doc_id.

Edge cases: null and empty texts have no terms and get the classifier's base rate; without usable labels only the fixed lexicons
and patterns vote; several labels of one doc_id count as toxic if one does, null labels are left out; repeated rows score
equally; a null doc_id is not held out and never matches a label; an empty table gives no rows; other columns are
ignored, whatever their names. The driver holds the term list, the sample's votes and its toxic rows' sketches, all bounded; nothing else is collected.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import hash_words, split_words, window_hashes, written

SAMPLE_ROWS, TERM_SUPPORT, TERM_ODDS = 20_000, 6, 4.0
#: Combinations of votes that the driver holds at most; how many times the label model's classes are split.
MAX_PATTERNS, LEVELS = 100_000, 3
#: Near copies: `NEAR` of the windows of `WINDOW` words are shared, as told by the `SKETCH` smallest window hashes.
WINDOW, SKETCH, NEAR = 5, 64, 0.75
GROUPS = 12
THRESHOLD = 0.7
#: Fixed lexicons of plain insults; learned terms join them.
FIXED = {
    "en": "idiot moron stupid loser scum trash pathetic worthless disgusting clown",
    "de": "idiot trottel dumm abschaum versager widerlich",
    "fr": "idiot imbécile stupide ordure minable crétin",
    "es": "idiota imbécil estúpido basura patético escoria",
}
PRONOUNS = frozenset("you your you're du dich dein ihr tu toi vous te usted tú".split())
_WORDS = re.compile(r"[^\W\d_]+").findall
BEGINNINGS = (4, 5)


def terms_of(text: str | None) -> tuple[set[str], int]:
    """Distinct terms: words as they are, beginnings with a star; and the number of words."""
    words = _WORDS((text or "").lower())
    distinct = set(words)
    return distinct | {f"{w[:n]}*" for n in BEGINNINGS for w in distinct if len(w) > n}, len(words)


class Voters:
    """Lexicon and pattern voters over a list of terms."""

    def __init__(self, terms: list[str]):
        fixed = {w for ws in FIXED.values() for w in ws.split()}
        self.terms = sorted({*terms, *fixed})
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.begins = {n: {t[:-1]: i for t, i in self.place.items() if t.endswith("*") and len(t) == n + 1} for n in BEGINNINGS}
        group = lambda t: (2 * (zlib.crc32(t.encode()) % GROUPS)) + t.endswith("*")
        self.lexicons = [frozenset(i for t, i in self.place.items() if group(t) == g) for g in range(2 * GROUPS)]
        self.lexicons += [frozenset(self.place[w] for w in ws.split()) for ws in FIXED.values()]
        self.size = len(self.lexicons) + 5

    def hits(self, text: str | None) -> tuple[list[int], list[str], int]:
        words = _WORDS((text or "").lower())
        distinct = set(words)
        found = {self.place[w] for w in distinct if w in self.place}
        for n, table in self.begins.items():
            if table:
                found.update(table[w[:n]] for w in distinct if len(w) > n and w[:n] in table)
        return sorted(found), words, len(words)

    def votes(self, text: str | None) -> np.ndarray:
        found, words, n = self.hits(text)
        held = set(found)
        out = [bool(held & x) for x in self.lexicons]
        near = any(w in PRONOUNS for i, x in enumerate(words) if x in self.place for w in words[max(0, i - 3) : i + 4]) if held else False
        shouting = sum(map(str.isupper, text or "")) > 0.5 * max(1, sum(map(str.isalpha, text or ""))) and n > 3
        out += [len(found) >= 2, len(found) >= 4, near, bool(shouting), not found]
        return np.array(out, bool)

    def features(self, text: str | None) -> list[tuple[int, float]]:
        """Sparse: a bias, terms, then how many terms there are and how dense."""
        found, _, n = self.hits(text)
        k = len(self.terms)
        return [(k, 1.0), *((i, 1.0) for i in found), (k + 1, float(np.log1p(len(found)))), (k + 2, min(1.0, 20.0 * len(found) / max(20, n)))]


class LabelModel:
    """P(class) * P(votes | class), in which every voter but the root depends on one other voter and the class."""

    def __init__(self, both: np.ndarray, total: np.ndarray, tree: list[tuple[int, int]] | None = None):
        """Fits to the weights of the classes and, by class, of rows in which two voters vote; tree: (voter, the voter it depends on or -1), from the data if not given."""
        self.prior = (total + 1) / (total.sum() + 2)
        self.tree = tree or self._spanning(both, total)
        one = np.stack([np.diag(b) for b in both])
        total = total[:, None]
        self.root = (one + 0.5) / (total + 1)
        parent = np.array([max(p, 0) for _, p in sorted(self.tree)])
        at = np.arange(both.shape[1])
        on, held = both[:, at, parent], one[:, parent]
        #: [class, parent's vote, voter]: how often it votes.
        self.rate = np.stack([(one - on + 0.5) / (total - held + 1), (on + 0.5) / (held + 1)], axis=1)
        self.parent = np.array([p for _, p in sorted(self.tree)])

    def apart(self, other: LabelModel) -> float:
        """The largest difference of two models' parameters."""
        return max(np.abs(getattr(self, x) - getattr(other, x)).max() for x in ("prior", "root", "rate"))

    @staticmethod
    def _spanning(both: np.ndarray, total: np.ndarray) -> list[tuple[int, int]]:
        m = both.shape[1]
        gain = np.zeros((m, m))
        for b, t in zip(both, total, strict=True):
            p = (np.diag(b) + 0.5) / (t + 1)
            for x in (0, 1):
                for y in (0, 1):
                    px, py = (p if x else 1 - p)[:, None], (p if y else 1 - p)[None, :]
                    d = np.diag(b)
                    joint = b if x and y else d[:, None] - b if x else d[None, :] - b if y else t - d[:, None] - d[None, :] + b
                    joint = (joint + 0.25) / (t + 1)
                    gain += t / max(total.sum(), 1e-9) * joint * np.log(joint / (px * py))
        inside, tree = [0], [(0, -1)]
        while len(inside) < m:
            rest = [j for j in range(m) if j not in inside]
            i, j = max(((i, j) for i in inside for j in rest), key=lambda e: gain[e])
            inside.append(j)
            tree.append((j, i))
        return tree

    def log_joint(self, v: np.ndarray) -> np.ndarray:
        """log P(class, votes), rows by classes."""
        out = np.tile(np.log(self.prior), (len(v), 1))
        for j, p in enumerate(self.parent):
            for c in (0, 1):
                rate = self.root[c, j] if p < 0 else np.where(v[:, p], self.rate[c, 1, j], self.rate[c, 0, j])
                out[:, c] += np.log(np.where(v[:, j], rate, 1 - rate))
        return out

    def posterior(self, v: np.ndarray) -> np.ndarray:
        z = self.log_joint(v)
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))


#: The way to a class: models, and which of a model's two classes it lies in.
Path = list[tuple[LabelModel, int]]


def within(votes: np.ndarray, path: Path) -> np.ndarray:
    """How much of each row lies in the class at the end of a path."""
    out = np.ones(len(votes))
    for model, c in path:
        q = model.posterior(votes)
        out *= q if c else 1 - q
    return out


def moments(votes: np.ndarray, counts: np.ndarray, path: Path, model: LabelModel | None) -> tuple[np.ndarray, np.ndarray]:
    """What a model of a class is fitted to, as far as rows tell; without a model, from the number of voters that vote. The last voter is the one for no term."""
    v, n = votes.astype(float), counts * within(votes, path)
    q = np.clip(v[:, :-1].sum(1) * 0.3, 0.02, 0.95) if model is None else model.posterior(votes)
    w = np.stack([n * (1 - q), n * q])
    return np.stack([v.T @ (c[:, None] * v) for c in w]), w.sum(1)


def maximised(of, steps: int = 60) -> LabelModel:
    """Expectation-maximisation; of(model) gives moments. The tree settles in the first steps."""
    model = LabelModel(*of(None))
    for step in range(steps):
        new = LabelModel(*of(model), model.tree if step >= 5 else None)
        done = step >= 5 and new.apart(model) < 1e-6
        model = new
        if done:
            break
    return model


def label_model(votes: np.ndarray, counts: np.ndarray | None = None, steps: int = 60) -> LabelModel:
    n = np.ones(len(votes)) if counts is None else counts.astype(float)
    return maximised(lambda model: moments(votes, n, [], model), steps)


def label_classes(of) -> list[Path]:
    """Classes of votes, each split in two LEVELS times; of(path, model) gives moments."""
    paths: list[Path] = [[]]
    for _ in range(LEVELS):
        split = [(p, maximised(lambda model, p=p: of(p, model))) for p in paths]
        paths = [[*p, (model, c)] for p, model in split for c in (0, 1)]
    return paths


def named(paths: list[Path], votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Posteriors of rows: how much of each lies in a class, times how often that class's labelled rows are toxic."""
    inside = np.stack([within(votes, p) for p in paths])
    rates = (inside @ toxic + toxic.mean()) / (inside.sum(1) + 1)
    return rates @ inside


def combinations(patterns: np.ndarray, voters: int) -> np.ndarray:
    """Votes from bits."""
    return patterns[:, None] >> np.arange(voters) & 1 == 1


def moments_of(patterns: DataFrame, voters: int):
    """moments() over a table of patterns and how often they occur. A small one is held here; else each call is a pass over it, whose partial sums come back."""
    held = patterns.limit(MAX_PATTERNS + 1).collect()  # voters' votes in a long, and a count
    if len(held) <= MAX_PATTERNS:
        held = sorted(tuple(r) for r in held)
        votes, n = combinations(np.array([p for p, _ in held], np.int64), voters), np.array([n for _, n in held], float)
        return lambda path, model: moments(votes, n, path, model)

    def summed(path: Path, model: LabelModel | None) -> tuple[np.ndarray, np.ndarray]:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            both, total = np.zeros((2, voters, voters)), np.zeros(2)
            for b in batches:
                x, y = moments(combinations(b["pattern"].to_numpy(np.int64), voters), b["n"].to_numpy(float), path, model)
                both, total = both + x, total + y
            yield pd.DataFrame({"sums": [np.append(both.ravel(), total).tolist()]})

        sums = np.sum([r["sums"] for r in patterns.mapInPandas(part, "sums array<double>").collect()], axis=0)  # one short row a task
        return sums[:-2].reshape(2, voters, voters), sums[-2:]

    return summed


def fit_linear(rows: list[list[tuple[int, float]]], target: np.ndarray, size: int, l2: float = 1e-5, steps: int = 600) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient descent over sparse rows."""
    at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)])
    col = np.array([c for r in rows for c, _ in r])
    val = np.array([x for r in rows for _, x in r])
    w, u, n = np.zeros(size), np.zeros(size), len(rows)
    rate = 4.0 / max(1.0, np.bincount(at, val**2).mean() * 2)
    for k in range(steps):
        y = w + (k / (k + 3)) * (w - u)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, val * y[col], n), -30, 30)))
        grad = np.bincount(col, val * (p - target)[at], size) / n + l2 * y
        u, w = w, y - rate * grad
    return w


def calibrated(w: np.ndarray, z: np.ndarray, toxic: np.ndarray, bias: int) -> np.ndarray:
    """Weights whose slope and offset fit labels, by Newton steps on a logistic regression of one input; near 1 and 0 where labels say little."""
    near = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    loss = lambda a: np.logaddexp(0, x @ a).sum() - toxic @ (x @ a) + ((a - near) ** 2).sum() / 2
    a = near
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - toxic) + (a - near))
        while np.abs(step).max() > 1e-9 and loss(a - step) > loss(a):
            step = step / 2  # far from its end a whole Newton step can go astray
        a = a - step
    if not a[0] > 0:
        return w
    w = w * a[0]
    w[bias] += a[1]
    return w


def sketch(text: str | None) -> list[int]:
    """The smallest hashes of a text's windows of words, in order; of all its words where they are fewer."""
    h = hash_words(split_words(text, lower=True))
    return np.unique(window_hashes(h, min(WINDOW, max(1, len(h)))).view(np.int64))[:SKETCH].tolist()


def near_groups(sketches: list[tuple[int, ...]]) -> dict[tuple[int, ...], int]:
    """The group of each sketch. A sketch joins the groups whose first sketch it is near to, which become one."""
    root: list[int] = []
    leaders: list[set[int]] = []
    holders: dict[int, list[int]] = {}
    out: dict[tuple[int, ...], int] = {}

    def top(g: int) -> int:
        while root[g] != g:
            g = root[g]
        return g

    for s in sorted(set(sketches)):
        near = []
        for g, shared in Counter(g for h in s for g in holders.get(h, ())).items():
            if shared >= NEAR * len(s):
                least = sorted(leaders[g].union(s))[:SKETCH]
                if len(leaders[g].intersection(s, least)) >= NEAR * len(least):
                    near.append(top(g))
        if near:
            out[s] = min(near)
            for g in near:
                root[g] = out[s]
            continue
        out[s] = len(root)
        root.append(out[s])
        leaders.append(set(s))
        for h in s:
            holders.setdefault(h, []).append(out[s])
    return {s: top(g) for s, g in out.items()}


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> tuple[Voters, np.ndarray]:
    """docs: doc_id, text. labels: doc_id, toxic. Returns the voters and the classifier's weights."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])  # sample_rows bounds what is sent, and what comes back

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"sketch": [sketch(t) for t in b["text"]]})

    groups = near_groups([tuple(r["sketch"]) for r in rows.filter("toxic <> 0").mapInPandas(sketched, "sketch array<long>").distinct().collect()])  # SKETCH numbers a row

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of = [groups[tuple(sketch(t))] if x else None for t, x in zip(b["text"], b["toxic"], strict=True)]
            yield pd.DataFrame({"toxic": b["toxic"], "near": pd.array(of, "Int64"), "terms": [sorted(terms_of(t)[0]) for t in b["text"]]})

    each = rows.mapInPandas(spread, "toxic int, near long, terms array<string>").select("toxic", "near", F.explode("terms").alias("term"))
    counts = each.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"), F.count_distinct("near").alias("groups"))
    total = rows.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).first()
    na, nb = total["a"] or 0, total["b"] or 0
    odds = F.log((F.col("a") + 0.5) / (na + 1.0)) - F.log((F.col("b") + 0.5) / (nb + 1.0))
    best = counts.filter(F.col("groups") >= TERM_SUPPORT).withColumn("o", odds).filter(F.col("o") >= TERM_ODDS)
    voters = Voters([r["term"] for r in best.select("term").collect()])  # each in TERM_SUPPORT of the sample's rows at least

    def cast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = [voters.features(t) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "votes": [voters.votes(t).tolist() for t in b["text"]], "at": [[i for i, _ in r] for r in f], "value": [[x for _, x in r] for r in f]})

    held = rows.mapInPandas(cast, "toxic int, votes array<boolean>, at array<int>, value array<double>").collect()  # sample_rows rows of bounded length
    size = len(voters.terms) + 3
    if not held:
        weights = np.zeros(size)
        weights[[voters.place[w] for ws in FIXED.values() for w in ws.split()]] = 4.0
        weights[-3] = -3.0
        return voters, weights

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = 1 << np.arange(voters.size, dtype=np.int64)
        for b in batches:
            p, n = np.unique([int(bits[voters.votes(t)].sum()) for t in b["text"]], return_counts=True)
            yield pd.DataFrame({"pattern": p, "n": n})

    open_ = docs.filter(~held_out(F.col("doc_id"))).select("text").mapInPandas(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    paths = label_classes(moments_of(written(open_, "vote-patterns"), voters.size))
    votes = np.array([r["votes"] for r in held])
    toxic = np.array([r["toxic"] for r in held], float)
    posterior = named(paths, votes, toxic)
    rows = [list(zip(r["at"], r["value"], strict=True)) for r in held]
    weights = fit_linear(rows, posterior, size)
    return voters, calibrated(weights, np.array([sum(weights[i] * x for i, x in r) for r in rows]), toxic, len(voters.terms))


def scored(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    """docs: doc_id, text. labels: doc_id, toxic. Returns doc_id, held_out, score, predicted, one row per row of docs."""
    voters, weights = train(docs, labels, **bounds)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = np.array([sum(weights[i] * x for i, x in voters.features(t)) for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInPandas(score, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
