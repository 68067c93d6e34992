import hashlib
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import exact_dedup, golomb, jaccard_join, substring_dedup
from quillstone.llm.components import components
from tests.llm.fixtures import counted, documents, empty, plain

BIG = 1 << 63


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**48 - 1), max_size=200), st.integers(0, 56))
def test_golomb(values, k):
    v = np.array(sorted(values), np.uint64)
    if len(v) and int(v.max()) >> k > 1 << 16:
        k = 36
    assert golomb.decode(golomb.encode(v, k), len(v), k).tolist() == v.tolist()


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_exact(spark, broadcast_rows):
    docs = documents(spark)
    groups = defaultdict(list)
    for i, t, _ in plain(docs):
        groups[t or ""].append(i)
    got = [tuple(r) for r in exact_dedup.dedup(docs, owners=5, broadcast_rows=broadcast_rows).collect()]
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = counted((i, keep[t], len(ids), sha(t)) for t, ids in groups.items() for i in ids)
    assert counted((i, k, n, s) for i, k, n, _, s in got) == want
    kept = [(i, s) for i, _, _, stays, s in got if stays]
    assert counted(kept) == counted((keep[t], sha(t)) for t in groups)


def test_messages_follow_the_rows():
    """Golomb-coded lists stay long, and owners bounded, from a thousand rows to 5e10."""
    for n in (10**3, 10**6, 10**9, 5 * 10**10):
        owners, senders = exact_dedup.dealt(n, 12)
        assert n / owners <= exact_dedup.OWNER_ROWS and owners * senders <= max(4 * 12, 1.1 * n / 64 + owners)


def similar(docs, size=5, percent=75):
    rows = plain(docs)
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), BIG), d)
    return counted((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize(("block", "owners", "fan", "limit"), [(1000, 4, 2048, 250_000), (4, 3, 2048, 250_000), (1000, 3, 2048, 2), (2, 9, 4, 250_000), (3, 7, 2, 3)])
def test_jaccard(spark, monkeypatch, block, owners, fan, limit):
    """Small bounds force large blocks, two levels of owners, and heavy shingles."""
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    docs = documents(spark)
    got = jaccard_join.join(docs, block=block, owners=owners, fan=fan, list_limit=limit).select("doc_id", "n_shingles", "component_id").collect()
    assert counted(tuple(r) for r in got) == similar(docs)


def chained(n: int = 60) -> list[str]:
    """Texts that share rare passages with their neighbours, some of them near copies, so blocks are chains of what is not alike."""
    r = np.random.default_rng(9)
    words = lambda k: " ".join(f"v{x}" for x in r.integers(0, 10**6, k))
    passages = [words(12) for _ in range(n + 1)]
    out = []
    for i in range(n):
        text = f"{passages[i]} {passages[i + 1]} {words(6)} {passages[7]}"
        out += [text, f"{text} more"] if i % 3 == 0 else [text]
    return out


@pytest.mark.parametrize("block", [2, 5, 1000])
def test_jaccard_of_chains(spark, block):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(chained())], "doc_id long, text string, source string").repartition(3)
    got = jaccard_join.join(docs, block=block).select("doc_id", "n_shingles", "component_id").collect()
    assert counted(tuple(r) for r in got) == similar(docs)


def test_jaccard_of_a_drifting_group(spark, monkeypatch):
    """Copies of one text that are mostly not alike: their block is compared about once, not once for each list of their shared prefixes."""
    r = np.random.default_rng(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in r.choice(120, r.integers(1, 5), replace=False):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words), "s"))
    docs, compared, searched = spark.createDataFrame(rows, "doc_id long, text string, source string"), [], jaccard_join._searched

    def counting(tasks, percent):
        compared.extend(q * m for q, m in tasks.groupBy("task").agg(F.sum(F.col("query").cast("int")).alias("q"), F.count("*").alias("m")).select("q", "m").collect())
        return searched(tasks, percent)

    monkeypatch.setattr(jaccard_join, "_searched", counting)
    got = jaccard_join.join(docs, block=10).select("doc_id", "n_shingles", "component_id").collect()
    assert counted(tuple(x) for x in got) == similar(docs)
    assert sum(compared) < 3 * 90 * 90


def test_search_of_a_large_group():
    """A task's largest group, most of it copies of one text that link with nothing, takes seconds."""
    r = np.random.default_rng(8)
    base = np.sort(r.choice(2**47, 390, replace=False).astype(np.uint64))
    sets = [np.sort(np.concatenate((r.choice(base, 300, replace=False), r.choice(2**40, 90, replace=False).astype(np.uint64)))) for _ in range(1000)]
    began = time.process_time()
    assert jaccard_join.search(sets, [390] * 1000) == []
    assert time.process_time() - began < 10


def test_fans():
    assert jaccard_join.fans(2048) == (2048, 1)
    assert all(a * b >= n and a <= 0xFFFF for n in (2049, 10**5, 13 * 10**6) for a, b in [jaccard_join.fans(n)])


def test_search_matches_all_pairs():
    r = np.random.default_rng(3)
    base = r.choice(2**40, 60, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate((r.choice(base, 50, replace=False), r.choice(2**40, r.integers(0, 12)).astype(np.uint64)))) for _ in range(40)]
    ns = [len(s) for s in sets]
    forest = jaccard_join.Forest(40)
    found = jaccard_join.search(sets, ns)
    asked = jaccard_join.search(sets, ns, queries=[3, 17])
    assert {x for x, _ in asked} <= {3, 17}
    for i, j in found:
        assert 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
        forest.join(i, j)
    for i in range(40):
        for j in range(i):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j])):
                assert forest.find(i) == forest.find(j)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (10, 20), (20, 30), (7, 7), (2, 1), (100, 1)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**dict.fromkeys((1, 2, 3, 4, 5, 100), 1), **dict.fromkeys((10, 20, 30), 10), **dict.fromkeys(range(1000, 1061), 1000)}


def without_repeats(rows, length):
    out, seen = [], {}
    key = lambda i: BIG if i is None else i
    for i, t, _ in rows:
        w = (t or "").encode().split()
        for a in range(len(w) - length + 1):
            k = tuple(w[a : a + length])
            seen[k] = min(seen.get(k, BIG), key(i))
    for i, t, _ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            if seen[tuple(w[a : a + length])] < key(i):
                gone[a : a + length] = [True] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return counted(out)


@pytest.mark.parametrize(("length", "query_words"), [(50, 200_000), (12, 60)])
def test_substrings(spark, length, query_words):
    docs = documents(spark)
    report, texts = substring_dedup.dedup(docs, length=length, query_words=query_words)
    assert counted(tuple(r) for r in report.collect()) == without_repeats(plain(docs), length)
    assert texts.count() > 0


def test_automaton():
    a = substring_dedup.Automaton()
    a.add(b"a b c d e a b c x".split())
    a.add(b"q r s".split())
    assert a.spans(b"z a b c d y b c x q r s".split(), 3) == [(1, 5), (6, 12)]  # spans that touch are one
    assert a.spans(b"c x q".split(), 3) == []


def test_empty_tables(spark):
    assert exact_dedup.dedup(empty(spark)).count() == 0
    assert jaccard_join.join(empty(spark)).count() == 0
    assert substring_dedup.dedup(empty(spark))[0].count() == 0
