import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.llm import mixing, stages, warc
from quillstone.llm.common import release, shared_dir, tables, written
from tests.llm.fixtures import counted, documents, empty, plain
from tests.llm.test_dedup import similar
from tests.llm.test_texts import measured


def targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    asked, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (asked - sum(most * sizes[s] for s in full)) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else w[s] * level for s in order}
        full.update(over)


def solved(own, target, most=2.0):
    """Rates by size: the multiplier of the tilt by plain bisection."""
    if not own or target >= most * sum(own):
        return dict.fromkeys(own, most)
    scale = sum(z * z for z in own) / sum(own)
    rate = lambda m, z: min(most, math.exp(min(50.0, m * z / scale)))
    low, high = -1e5, 1e5
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(z * rate(mid, z) for z in own) < target else (low, mid)
    return {z: rate(low, z) for z in own}


def test_mixing(spark):
    docs = documents(spark)
    sizes = defaultdict(int)
    for _, t, s in plain(docs):
        sizes[s] += len((t or "").encode().split())
    want = targets(sizes)
    got = mixing.mix(docs, slots=4).collect()
    again = mixing.mix(docs.repartition(7), slots=4).collect()
    assert counted(r[:] for r in got) == counted(r[:] for r in again)
    assert counted((r["doc_id"], r["size"]) for r in got) == counted((i, len((t or "").encode().split())) for i, t, _ in plain(docs))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.6 * largest[s] + 1
        own = [r["size"] for r in got if r["source"] == s and r["size"]]
        for z, rate in solved(own, t).items():
            assert {r["rate"] for r in got if r["source"] == s and r["size"] == z} == {next(r["rate"] for r in got if r["source"] == s and r["size"] == z)}
            assert next(r["rate"] for r in got if r["source"] == s and r["size"] == z) == pytest.approx(rate, rel=1e-6)
            assert all(math.floor(rate - 1e-6) <= r["copies"] <= math.ceil(rate + 1e-6) for r in got if r["source"] == s and r["size"] == z)
    assert len({r["rate"] for r in got if r["source"] == "s2"}) > 3
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(docs).collect()] == [0, 0]


def pages(spark):
    rows = [(9, "http://a/", "x" * 100), (3, "http://a/b?c\r\nd", "x" * 100), (5, None, "x" * 99), (4, "u", "x" * 99), (None, "u", "x" * 100), (7, "ü", "é" * 60), (6, "v", "é" * 60), (8, "e", None), (2, "e", ""), (3, "http://a/b?c\r\nd", "x" * 100)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_warc(spark, tmp_path):
    p = f"file://{tmp_path}/a"
    warc.write_archive(pages(spark), p)
    got = warc.read_archive(spark, p).collect()
    rows = [(r["page_id"], r["html"] or "") for r in pages(spark).collect()]
    first = {h: min(i for i, x in rows if x == h and i is not None) for _, h in rows}
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    assert counted((r["page_id"], bytes(r["payload"])) for r in got) == counted((i, h.encode()) for i, h in rows)
    for r in got:
        h = bytes(r["payload"]).decode()
        assert r["payload_digest"] == hashlib.sha256(h.encode()).hexdigest() and r["payload_bytes"] == len(h.encode())
        if r["record_type"] == "revisit":
            assert len(h.encode()) >= 100 and r["refers_to"] == first[h]
        (f, header, block), = warc.warc_records(bytes(r["record"]))
        assert header == bytes(r["header"]) and block == (h.encode() if r["record_type"] == "response" else b"") and f["warc-type"] == r["record_type"]
    assert sorted((r["page_id"], r["record_type"]) for r in got if r["page_id"] in (3, 9, 6, 7)) == [(3, "response"), (3, "revisit"), (6, "response"), (7, "revisit"), (9, "revisit")]
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.warc").write_bytes(b"".join(bytes(r["record"]) for r in got))
    assert warc.read_warc_files(spark, f"file://{files}").count() == len(got)
    ids = [f["warc-record-id"] for r in got for f, _, _ in warc.warc_records(bytes(r["record"]))]
    assert len(set(ids)) == len(ids) and {f["warc-refers-to"] for r in got for f, _, _ in warc.warc_records(bytes(r["record"])) if "warc-refers-to" in f} <= set(ids)
    long = spark.createDataFrame([(i, "u", "é" * 4_000_000) for i in (2, 1, 3)], "page_id long, url string, html string")
    warc.write_archive(long, f"{p}-long")
    assert sorted((r["page_id"], r["record_type"], r["payload_bytes"]) for r in warc.read_archive(spark, f"{p}-long").drop("payload", "record").collect()) == [(1, "response", 8_000_000), (2, "revisit", 8_000_000), (3, "revisit", 8_000_000)]
    warc.write_archive(pages(spark).limit(0), f"{p}-empty")
    assert warc.read_archive(spark, f"{p}-empty").count() == 0


def test_warc_cut_short():
    with pytest.raises(ValueError, match="cut short"):
        list(warc.warc_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


def test_written_goes_to_the_shared_folder(spark):
    df = written(spark.range(5), "t")
    assert df.count() == 5 and shared_dir(spark).split("://")[-1] in df.inputFiles()[0]


def test_stages(spark):
    """The pipeline's stages against plain versions of what they decide."""
    docs = documents(spark)
    names = docs.columns
    good = written(stages.quality_rules(spark, docs, ""), "q")
    keep = lambda t: (m := measured(t))[0] >= 10 and 100 * m[4] <= 20 * m[0]
    assert good.columns == names and counted(plain(good)) == counted(r for r in plain(docs) if keep(r[1]))
    single = written(stages.exact_copies(spark, good, ""), "e")
    best = {}
    for i, t, _ in plain(good):
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    assert single.columns == names and sorted((i if i is not None else -1, t) for i, t, _ in plain(single)) == sorted((i, t) for t, i in best.items())
    apart = written(stages.near_copies(spark, single, ""), "n")
    groups = similar(single)
    assert apart.columns == names and {r[0] for r in plain(apart)} == {c for _, _, c in groups} and apart.count() == len({c for _, _, c in groups})
    mixed = written(stages.source_mix(spark, apart, ""), "m")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(apart).collect()}
    assert mixed.columns == names and counted(i for i, _, _ in plain(mixed)) == counted(i for i, n in copies.items() for _ in range(n))
    last = stages.bpe_round_trip(spark, mixed, "").collect()
    assert counted((r["doc_id"], r["text"]) for r in last) == counted((i, t) for i, t, _ in plain(mixed))
    for stage in (stages.quality_rules, stages.exact_copies, stages.near_copies, stages.source_mix, stages.bpe_round_trip):
        assert stage(spark, empty(spark), "").count() == 0


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.filter(F.col("n_tokens") > 0).count() > 100


def test_release(spark):
    mark = tables()
    a, b = written(spark.range(3), "a"), written(spark.range(4), "b")
    release(spark, mark, keep=1)
    assert tables() == mark + 1 and b.count() == 4
    with pytest.raises(Exception, match="(?i)not.*exist"):
        spark.read.parquet(a.inputFiles()[0])
