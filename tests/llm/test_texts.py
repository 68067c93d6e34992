import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import bpe, maxent_lm, pii, quality, stages, toxicity
from quillstone.llm.common import hash_texts, window_hashes
from tests.llm.fixtures import counted, documents, empty, plain, texts


def test_word_hashes():
    t = [*texts(), "a b", "b a", "a  b", "É é"]
    h, at = hash_texts(t)
    words = [w for x in t for w in (x or "").encode().split()]
    assert len(h) == len(words) and at.tolist() == np.cumsum([0, *(len((x or "").split()) if x is None else len(x.encode().split()) for x in t)]).tolist()
    assert len(set(zip(h.tolist(), words, strict=True))) == len(set(words)) == len(set(h.tolist()))
    low, _ = hash_texts(["ÀB Cd"], lower=True)
    assert low.tolist() == hash_texts(["Àb cd"])[0].tolist()


@pytest.mark.parametrize("k", [1, 2, 3, 5, 7, 10, 50])
def test_windows(k):
    h, _ = hash_texts([" ".join(np.random.default_rng(k).choice(["a", "b"], 400))])
    g = window_hashes(h, k)
    runs = [tuple(h[i : i + k].tolist()) for i in range(len(h) - k + 1)]
    assert len(g) == len(runs) and len(set(zip(g.tolist(), runs, strict=True))) == len(set(runs)) == len(set(g.tolist()))


def base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_pii(spark):
    docs = documents(spark)
    quick = [(i, t) for i, t, _ in plain(docs) if len(t or "") < 15_000]
    got = pii.extract(docs).collect()
    rows = counted((r["doc_id"], tuple(sorted((s["kind"], s["start"], s["end"]) for s in r["base"]))) for r in got)
    for i, t in quick:
        assert rows[(i, tuple(sorted(base(t or ""))))] > 0
    assert len(got) == docs.count()
    secrets = sum(s["kind"] == "secret" for r in pii.extract(docs, seed_share=2, support=2).collect() for s in r["spans"])
    assert secrets == 16  # 8 of a published form, 8 found through their make-up
    assert pii.extract(empty(spark)).count() == 0


def scored_plainly(edges, rounds, support, confidence):
    """The graph's scoring without Spark."""
    edges = set(edges)
    for _ in range(rounds):
        of = {}
        for t, label, p in edges:
            of.setdefault(p, []).append(label)
        score = {p: c.count("known") / (c.count("known") + c.count("other") + pii.UNKNOWN_WEIGHT * c.count("unknown")) for p, c in of.items() if c.count("known") >= support}
        score = {p: s for p, s in score.items() if s >= confidence}
        rest = {}
        for t, label, p in edges:
            if label != "other" and p in score:
                rest[t] = rest.get(t, 1.0) * (1 - min(0.999, score[p]))
        reached = {t for t, r in rest.items() if 1 - r >= confidence}
        edges = {(t, "known" if label == "unknown" and t in reached else label, p) for t, label, p in edges}
    return score, reached


def test_pii_graph(spark):
    """Patterns of the seeds reach unknown tokens, whose other patterns then reach more; contexts of other kinds stay out."""
    edges = [(f"a{i}", "known", "key token") for i in range(4)] + [(f"b{i}", "unknown", "key token") for i in range(6)] + [(f"b{i}", "unknown", "before pass") for i in range(5)]
    edges += [(f"c{i}", "unknown", "before pass") for i in range(3)] + [("d", "unknown", "before the"), *((f"a{i}", "known", "before the") for i in range(3)), *((f"e{i}", "other", "before the") for i in range(9))]
    patterns, reached = pii.bootstrapped(spark.createDataFrame(edges, "token string, label string, pattern string"))
    score, tokens = scored_plainly(edges, pii.ROUNDS, pii.SUPPORT, pii.CONFIDENCE)
    assert {r["pattern"]: pytest.approx(r["score"]) for r in patterns.collect()} == score and set(score) == {"key token", "before pass"}
    assert {r["token"] for r in reached.collect()} == tokens == {*(f"a{i}" for i in range(4)), *(f"b{i}" for i in range(6)), *(f"c{i}" for i in range(3))}


def test_pii_finds_what_is_no_seed(spark):
    """On the driver's documents patterns induced by an eighth of the keys find the others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = pii.extract(docs).agg(F.sum("n_seeds").alias("seeds"), F.sum("n_induced").alias("induced"), F.sum(F.size(F.filter("spans", lambda s: s["kind"] == "secret"))).alias("all")).first()
    assert 0 < r["seeds"] < 0.4 * r["all"] and r["induced"] >= 0.95 * (r["all"] - r["seeds"])


def test_pii_is_linear():
    for t in ("1" * 200_000, "a" * 200_000, "a." * 100_000, "@" * 100_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000):
        pii.base_spans(t)
        pii.candidates(t, [])


def test_maxent(spark):
    docs = documents(spark)
    rows = plain(docs)
    tokens = [[*(t or "").encode().lower().split(), None] for _, t, _ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = counted((i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)) for (i, _, _), ws, h in zip(rows, tokens, held, strict=True))
    got = maxent_lm.scored(docs, owners=3).collect()
    assert counted((r[0], r[1], r[2], r[3], r[4], round(r[5], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert maxent_lm.scored(empty(spark)).count() == 0
    dealt = maxent_lm.scored(docs, owners=7, fan=2, region_words=40).collect()  # over two levels, many bundles a region
    assert counted((*r[:5], round(r[5], 5), round(r[6], 3)) for r in dealt) == counted((*r[:5], round(r[5], 5), round(r[6], 3)) for r in got)


def test_maxent_learns():
    text = " ".join(["alpha beta gamma delta"] * 3000)
    tok, form, at = maxent_lm.tokens([text])
    h, first, n = np.unique(tok, return_index=True, return_counts=True)
    lexicon = maxent_lm.Lexicon(h, form[first], n)
    lexicon.classes[: len(h)] = np.arange(len(h))
    classes, f = lexicon.look(tok, form)[0], maxent_lm.features(tok, at)
    w, b = np.zeros((1 << maxent_lm.BUCKETS_LOG2, maxent_lm.CLASSES), np.float32), np.zeros(maxent_lm.CLASSES, np.float32)
    before = maxent_lm.log_class(w, b, f, classes).sum()
    learner = maxent_lm.Learner(w, b)
    learner.learn(f, classes)
    assert maxent_lm.log_class(learner.w, b, f, classes).sum() > before and np.allclose(maxent_lm.class_shares(learner.w, b, f).sum(1), 1, atol=1e-4)


def test_maxent_score_is_the_models(spark):
    """Scores against a plain sum over tokens; the words of a class and an unseen one sum to one, and so do the classes."""
    docs = documents(spark)
    named = docs.select("doc_id", maxent_lm.held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    model = maxent_lm.fitted(named, owners=3)
    counts, forms = Counter(), {}
    for r in named.filter("not held_out").collect():
        tok, form, _ = maxent_lm.tokens([r["text"]])
        counts.update(tok.tolist())
        forms.update(zip(tok.tolist(), form.tolist(), strict=True))
    of = {w: int(model.lexicon.look(np.array([w], np.uint64), np.array([forms[w]], np.int16))[0][0]) for w in counts}
    for c in set(of.values()):
        own = [counts[w] for w in of if of[w] == c]
        assert 10 ** model.scale[c] == pytest.approx(sum(own) + 0.1 * (len(own) + 1))
    got = Counter((r["doc_id"], round(r["score"], 3)) for r in maxent_lm.scored(docs, owners=3).collect())
    for i, t, _ in plain(docs):
        tok, form, at = maxent_lm.tokens([t])
        z = model.bias + sum(model.weights[row] for row in maxent_lm.features(tok, at))
        logs = (z - np.log(np.exp(z.astype(float)).sum(axis=1, keepdims=True))) / math.log(10)
        classes = model.lexicon.look(tok, form)[0]
        want = sum(float(logs[k, c]) + math.log10(counts[int(w)] + 0.1) - model.scale[c] for k, (w, c) in enumerate(zip(tok, classes, strict=True)))
        assert any(abs(s - want) < 1e-3 * max(1, abs(want)) for d, s in got if d == i), (i, want)


def test_maxent_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = maxent_lm.scored(docs).filter("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    assert 10 ** ((r["b"] - r["s"]) / r["n"]) < 0.75  # perplexity against the base's


def test_toxicity(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i % 7} " + ("you utter zorbling fool" if i % 5 == 0 else "and more of them"), "en", "s") for i in range(600)] + [(9000, None, None, None), (9001, "", None, None), (None, "zorbling", None, None)], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, None if i % 97 == 3 else int(i % 5 == 0)) for i in range(600)] + [(0, 0), (None, 1), (5, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, labels).collect()}
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [r for i, r in got.items() if i is not None and i < 600 and r["held_out"]]
    assert len(held) > 100 and all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    assert got[9000]["predicted"] == 0 and got[9000]["score"] == got[9001]["score"] and got[None]["held_out"] is False
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.scored(docs, none).collect()} <= {0, 1}
    assert toxicity.scored(docs.limit(0), none).count() == 0
    long = spark.createDataFrame([(1, "zorbling fool " * 100_000), (1, "zorbling fool " * 100_000), (2, "x" * 2_000_000)], "doc_id long, text string")
    many = docs.select("doc_id", "text").union(long).union(long)
    again = toxicity.scored(many, labels).filter("doc_id in (1, 2)").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("score").alias("k")).collect()
    assert {(r["doc_id"], r["n"]) for r in again} == {(1, 5), (2, 3)}


def test_toxicity_rare_terms(spark):
    """A term of few toxic rows counts in any number of them; one that only near copies of a text hold does not."""
    rows = [(f"plain row n{i} of m{i % 89} and k{i % 97} words", 0) for i in range(3600)] + [(f"zorbling fool n{i} of m{i % 89} and k{i % 97}", 1) for i in range(600)]
    rows += [(f"eres un zafio n{i} de m{i} y k{i}", 1) for i in range(15)]
    long = " ".join(f"w{k}" for k in range(60))
    rows += [(f"copyword {long} n{i}", 1) for i in range(45)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, toxic int")
    terms = toxicity.train(docs, labels)[0].terms
    assert {"zorbling", "zafio"} <= set(terms) and "copyword" not in terms


def test_label_model():
    """Accuracies come from agreement alone; voters that copy one another are told apart from the class."""
    r = np.random.default_rng(2)
    y = r.random(6000) < 0.15
    votes = np.stack([np.where(y, r.random(6000) < hit, r.random(6000) < miss) for hit, miss in ((0.8, 0.05), (0.7, 0.02), (0.75, 0.1), (0.6, 0.03))], axis=1)
    noise = r.random(6000) < 0.1  # two copies of a voter that knows nothing
    votes = np.concatenate([votes, np.stack([noise ^ (r.random(6000) < 0.01) for _ in range(2)], axis=1)], axis=1)
    model = toxicity.label_model(votes)
    q = model.posterior(votes)
    q = q if q[y].mean() > q[~y].mean() else 1 - q
    plain = np.prod([np.where(votes[:, j], (0.8, 0.7, 0.75, 0.6)[j] / (0.05, 0.02, 0.1, 0.03)[j], (1 - (0.8, 0.7, 0.75, 0.6)[j]) / (1 - (0.05, 0.02, 0.1, 0.03)[j])) for j in range(4)], axis=0) * 0.15 / 0.85
    best = plain / (1 + plain)
    assert abs(q - best).mean() < 0.05 and ((q > 0.5) == y).mean() > ((best > 0.5) == y).mean() - 0.02
    # The joint is a distribution: its sum over all votes of a small model is one.
    small = toxicity.label_model(votes[:, :5])
    every = np.array([[i >> k & 1 for k in range(5)] for i in range(32)], bool)
    assert np.exp(small.log_joint(every)).sum() == pytest.approx(1)
    for row in every:  # against the product written out
        p = [small.prior[c] * math.prod((lambda rate: rate if row[j] else 1 - rate)(small.root[c, j] if a < 0 else small.rate[c, int(row[a]), j]) for j, a in enumerate(small.parent)) for c in (0, 1)]
        assert small.posterior(row[None])[0] == pytest.approx(p[1] / sum(p))
    merged, back = np.unique(votes, axis=0, return_inverse=True)
    assert np.allclose(toxicity.label_model(merged, np.bincount(back.ravel())).posterior(merged)[back.ravel()], model.posterior(votes), atol=1e-6)


def test_toxicity_of_two_manners(spark, monkeypatch):
    """Insults of two manners, whose words never meet, are both found; more combinations of votes than the driver holds tell the same."""
    r = np.random.default_rng(5)
    plain_words, coded = [f"plain{chr(97 + i)}" for i in range(26)], [f"{chr(97 + i)}zorb" for i in range(24)]
    rude = "idiot moron stupid loser scum trash pathetic worthless disgusting clown".split()
    rows = []
    for i in range(1600):
        kind = i % 20
        own = r.choice(coded, 9, replace=False).tolist() if kind == 0 else r.choice(rude, r.integers(1, 4), replace=False).tolist() if kind in (1, 2) else []
        rows.append((i, " ".join(r.permutation([*r.choice(plain_words, 30), f"n{i}", *own])), int(kind < 3)))
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([x[::2] for x in rows], "doc_id long, toxic int")
    toxic = {i: x for i, _, x in rows}
    got = {x["doc_id"]: x for x in toxicity.scored(docs, labels).collect()}
    held = [x for x in got.values() if x["held_out"]]
    assert len(held) > 400 and all(x["predicted"] == toxic[x["doc_id"]] for x in held)
    monkeypatch.setattr(toxicity, "MAX_PATTERNS", 5)
    monkeypatch.setattr(toxicity, "LEVELS", 1)
    voters = toxicity.Voters(coded)
    votes = np.array([voters.votes(t) for _, t, _ in rows])
    bits, n = np.unique([sum(1 << j for j in np.flatnonzero(v).tolist()) for v in votes], return_counts=True)
    table = spark.createDataFrame(list(zip(bits.tolist(), n.tolist(), strict=True)), "pattern long, n long")
    (apart, _), *_ = toxicity.label_classes(toxicity.moments_of(table, voters.size))[0]
    assert len(bits) > 100 and np.allclose(apart.posterior(votes), toxicity.label_model(votes).posterior(votes), atol=1e-4)


def test_calibration_ends():
    """Scores far from 0 and a few rows on the wrong side: whole Newton steps go astray."""
    r = np.random.default_rng(6)
    toxic = (np.arange(20_000) < 2_000).astype(float)
    z = np.where(toxic == 1, r.normal(-2, 12, 20_000), -22.0)
    w = toxicity.calibrated(np.array([1.0, 0.0]), z, toxic, 1)
    p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -30, 30)))
    assert w[0] > 0 and np.abs(w).max() < 50 and abs(p.mean() - toxic.mean()) < 0.01


def test_toxicity_held_out(spark):
    """Held-out labels of the driver's documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(docs, labels).filter("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    rate = {r["toxic"]: r["p"] for r in got}
    assert rate[1] > 0.8 and rate[0] < 0.01


def test_toxicity_near_groups():
    base = [f"w{i}" for i in range(200)]
    near = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in (20, 90, 199)]
    far = " ".join(base[:90] + [f"v{i}" for i in range(110)])
    s = [tuple(toxicity.sketch(t)) for t in (" ".join(base), *near, far, "", None, "one")]
    g = toxicity.near_groups(s)
    assert len({g[x] for x in s[:4]}) == 1 and len({g[x] for x in s}) == 4


def measured(t):
    t = t or ""
    w = t.encode().split()
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = [False] * len(w)
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            again[i : i + 5] = [True] * 5
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(again)


def test_quality(spark):
    docs = documents(spark)
    got = quality.judged(docs, line_least=1000).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = counted((i, *(m := measured(t)), (bad := m[0] < 10 or 100 * m[4] > 20 * m[0]), not bad) for i, t, _ in plain(docs))
    assert counted((r["doc_id"], *(r[n] for n in names), r["base_failed"], r["kept"]) for r in got) == want
    assert quality.judged(empty(spark)).count() == 0


def test_quality_boilerplate(spark):
    line = "All pages of this site carry this very line, Number 7."
    rows = [(i, f"{line}\nsome words only here {i}", "h") for i in range(20)] + [(100, f"{line.replace('7', '8')}\n" + " ".join(f"own{i}" for i in range(40)), "h"), (101, f"{line}\nsome other words in here", "g")]
    rows += [(200 + i, rows[0][1], "h") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judged(docs, line_least=5, line_share=0.3).collect()}
    assert not any(got[i]["kept"] for i in range(20)) and got[100]["kept"] and got[100]["n_boilerplate_words"] == 11 and got[101]["kept"]
    few = {r["doc_id"]: r["kept"] for r in quality.judged(docs.filter("doc_id = 0 or doc_id >= 200"), line_least=2, line_share=0.3).collect()}
    assert all(few.values())  # copies of one text are one document


def test_quality_small_host(spark):
    """The limits as they are in use find boilerplate in hosts of few documents, and none in a handful."""
    name = lambda n: "".join(chr(97 + int(d)) for d in str(n))  # noqa: E731  (digits are alike in lines)
    line = "All pages of this site carry this very line, Number 7."
    rows = [(i, f"{line}\nsome words only here {name(i)}", "small") for i in range(30)] + [(100 + i, " ".join(f"own{name(i)}x{name(k)}" for k in range(30)), "small") for i in range(30)]
    rows += [(200 + i, f"{line}\nsome words only here {name(i)}", "few") for i in range(5)]
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(not got[i]["kept"] and got[i]["n_boilerplate_words"] == 11 for i in range(30))
    assert all(got[i]["kept"] and got[i]["n_boilerplate_words"] == 0 for i in [*range(100, 130), *range(200, 205)])


def test_quality_changed_texts(spark):
    """Texts less their boilerplate, sent to every task or by a shuffle; a line counts whatever its letter case, numbers and blanks are."""
    line = lambda i: ("Read  MORE\tnews of day 17 here", "read more news of day 4 here ")[i % 2]
    own = lambda i: "abcdefgh"[i % 8] * (1 + i // 8)
    rows = [(i, f"some own words of document {own(i)} here and there\n{line(i // 2)}\nand an end {own(i)} of it all", None if i % 2 else "h") for i in range(40)]
    docs = spark.createDataFrame([*rows, rows[3], (99, None, "h"), (98, "x " * 300_000 + "\n" + line(0), "h")], "doc_id long, text string, source string")
    found = quality.judged(docs)
    for limit in (0, 10**6):
        got = counted(r["kept_text"] for r in quality.changed_texts(docs, found, broadcast_hashes=limit).collect())
        assert got == counted([t.replace(f"\n{line(i // 2)}", "") for i, t, _ in rows] + ["x " * 300_000])
    assert quality.changed_texts(docs.limit(0), quality.judged(docs.limit(0))).count() == 0


def test_quality_stage_removes_lines(spark):
    line = "All pages of this site carry this very line, Number 7."
    name = lambda n: "".join(chr(97 + int(d)) for d in str(n))  # noqa: E731  (digits are alike in lines)
    own = lambda i: " ".join(f"own{name(i)}x{name(k)}" for k in range(30))
    rows = [(i, f"{line.replace('7', str(i))}\n\n{own(i)}\n{line.upper()}\nlast words of {name(i)}", "h", 1, 5) for i in range(30)] + [(90, own(90), "h", 2, 6), (91, f"{line}\n{own(91)}", None, 3, None)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string, n_chars int, _lines int")
    got = stages.quality_rules(spark, docs, "")
    want = [(i, t := f"\n{own(i)}\nlast words of {name(i)}", "h", len(t), 5) for i in [0, *range(30)]] + [(90, own(90), "h", 2, 6), (91, f"{line}\n{own(91)}", None, 3, None)]
    assert got.schema == docs.schema and counted(map(tuple, got.collect())) == counted(want)


def test_bpe(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    docs = documents(spark)
    got = bpe.encoded(docs, bpe.tokenizer_path()).collect()
    want = []
    for i, x, _ in plain(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    assert counted((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got) == counted(want)
    assert bpe.encoded(empty(spark), bpe.tokenizer_path()).count() == 0


def test_bpe_random():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(bpe.tokenizer_path()), bpe.codec(bpe.tokenizer_path())
    parts = ["a", "s", "'", "'s", "'ll", " ", "  ", "\n", "\n\n", "\t", "\r", "é", "ß", " ", " ", "12", ".", "!!", "<|endoftext|>", "<|", "漢", "😀", "xq", "ZQ", "\x1c", "\x85", "don't", "İ", "\x00", "ñ"]

    @settings(max_examples=500, deadline=None)
    @given(st.lists(st.sampled_from(parts), max_size=14).map("".join) | st.text(st.characters(exclude_categories=["Cs"]), max_size=20))
    def check(text):
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(c.encode(text), "<u4").tolist() == ids and c.decode(c.encode(text)) == t.decode(ids, skip_special_tokens=False)

    check()
