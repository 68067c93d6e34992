"""Substring dedup with suffix automata of reference shards.

A window is `length` consecutive words. A word goes if a window over it also starts in a document with a smaller doc_id.

1. Marks. Of every document the least hash of each `length - GRAM + 1` consecutive GRAM-word runs is kept: documents that share
   a window share a mark, and about one mark in 20 words is kept. Marks of one document only are dropped.
2. References. Windows around shared marks are hashed, and the smallest document holding each is found (combined on the map
   side). The smallest document's passages of such windows are the reference shards; each repeated window is in a reference
   once, however many documents repeat it.
3. Automata. Each shard's passages become a suffix automaton over words, sent with the shard to as many tasks as its
   queries need (a checked number), and the passages of later documents stream through it. Where the matching statistic
   reaches `length`, the span is removed. This decides on words, not on hashes.
Equal texts, by SHA-256, are handled as one reference: a text's later copies lie in its first copy as a whole.

Edge cases: null, blank and short texts have no window and stay; texts are read whole; repeated rows with one doc_id do
not remove each other; a null doc_id counts as larger than any (and nulls as equal); an empty table gives no rows; other columns
are ignored, whatever their names. A task holds one shard's automaton (passages of one document) and a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import batch_windows, hash_texts, n_parts, running, split_words, window_hashes, written

LENGTH, GRAM = 50, 10
QUERY_WORDS = 200_000
_LAST = (1 << 63) - 1


def marks(h: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Marked runs of a batch: their hashes and places."""
    gram = min(GRAM, length)
    g = window_hashes(h, gram)
    n = length - gram + 1
    least = running(g, n, np.minimum)
    _, fits = batch_windows(h, bounds, length)
    best = np.concatenate((np.zeros(n - 1, np.uint64), np.where(fits[: len(least)], least, 0), np.zeros(n - 1, np.uint64))) if len(least) else np.zeros(0, np.uint64)
    at = np.flatnonzero(running(best, n, np.maximum)[: len(g)] == g) if len(least) else np.zeros(0, np.int64)
    return g[at], at


def _lists(values: np.ndarray, cuts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _mark(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(2).to_pylist()
                h, bounds = hash_texts(texts)
                found, places = marks(h, bounds, length)
                doc = np.searchsorted(bounds, places, "right") - 1
                each = [np.unique(found[a:b]) for a, b in zip(*(np.searchsorted(doc, range(len(texts)), s) for s in ("left", "right")), strict=True)]
                cuts = np.concatenate(([0], np.cumsum([len(e) for e in each])))
                joined = [b" ".join(split_words(t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array([hashlib.sha256(j).hexdigest() for j in joined]), _lists(np.concatenate(each).view(np.int64) if each else [], cuts, pa.int64())],
                    ["d", "text_sha", "n_words", "sha", "marks"],
                )

    return run


def _windows(length: int):
    gram = min(GRAM, length)
    n = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                h, bounds = hash_texts(part.column(2).to_pylist())
                starts, hashes = [], []
                for i, wanted in enumerate(part.column(3).to_pylist()):
                    own = h[bounds[i] : bounds[i + 1]]
                    hit = np.isin(window_hashes(own, gram), np.array(wanted, np.int64).view(np.uint64))
                    total = np.concatenate(([0], np.cumsum(hit)))
                    s = np.flatnonzero(total[n:] > total[:-n]) if len(total) > n else np.zeros(0, np.int64)
                    starts.append(s)
                    hashes.append(window_hashes(own, length)[s])
                cuts = np.concatenate(([0], np.cumsum([len(s) for s in starts])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), _lists(np.concatenate(starts).astype(np.int32), cuts, pa.int32()), _lists(np.concatenate(hashes).view(np.int64), cuts, pa.int64())],
                    ["d", "th", "text", "starts", "hashes"],
                )

    return run


def _passages(length: int):
    """Cuts texts into reference passages and, by the document they refer to, query passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "query", "th", "start", "words", "passage"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for d, th, text, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = split_words(text)
                at.sort(key=lambda x: x["start"])
                rows, begin = [], 0
                for k in range(1, len(at) + 1):
                    if k == len(at) or at[k]["start"] != at[k - 1]["start"] + 1 or at[k]["lo"] != at[begin]["lo"]:
                        a, b, lo = at[begin]["start"], at[k - 1]["start"] + length, at[begin]["lo"]
                        rows.append((lo, lo != d, th, a, b - a, b" ".join(words[a:b]).decode("utf-8", "surrogatepass")))
                        begin = k
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


class Automaton:
    """Suffix automaton over words; passages are kept apart by marks no query has."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last, self.apart = [-1], [0], 0, 0

    def add(self, words: list[bytes]) -> None:
        self.apart += 1
        for w in (*words, self.apart):
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[self.last] + 1)
            self.link.append(0)
            p = self.last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            self.last = cur

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal spans covered by matches of at least `least` words."""
        out, state, n = [], 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            if n >= least:
                a = i + 1 - least
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((a, i + 1))
        return out


def _match(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for batch in batches:
            out = []
            for shard, salt, query, th, start, passage in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (shard, salt) != key:
                    held, key = Automaton(), (shard, salt)
                words = split_words(passage)
                if query:
                    out += [(th, start + a, start + b) for a, b in held.spans(words, length)]
                else:
                    held.add(words)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["th", "begin", "end"])

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, shas, kept = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = split_words(text)
            stay = np.ones(len(words), bool)
            for s in spans:
                stay[s["begin"] : s["end"]] = False
            rest = b" ".join([words[i] for i in np.flatnonzero(stay)])
            gone.append(int((~stay).sum()))
            shas.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())], ["th", "gone", "rest_sha", "rest"])


def dedup(docs: DataFrame, *, length: int = LENGTH, query_words: int = QUERY_WORDS) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. Returns (one row per row of docs: doc_id, n_words, n_removed, kept_sha256; text_sha, kept text of each changed first copy)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.unhex(F.sha2(text, 256)).alias("text_sha"), text.alias("text"))
    rows = named.mapInArrow(_mark(length), "d long, text_sha binary, n_words long, sha string, marks array<long>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "marks")
    # A text goes by the row number of its first copy from here on.
    firsts = rows.filter(F.col("n_words") >= length).groupBy("text_sha").agg(F.min(F.struct("d", "row")).alias("f")).select("text_sha", F.col("f.d").alias("d"), F.col("f.row").alias("th"))
    firsts = written(firsts, "firsts")
    texts = rows.select("row", "marks").join(firsts, rows["row"] == firsts["th"]).select("th", "d", F.explode("marks").alias("mark"))
    texts = written(texts, "first-marks")
    shared = texts.groupBy("mark").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo <> hi").select("mark")
    wanted = texts.join(written(shared, "shared-marks"), "mark").groupBy("th").agg(F.collect_list("mark").alias("marks")).join(firsts, "th")
    near = named.join(wanted, ["text_sha", "d"]).dropDuplicates(["th"]).select("d", "th", "text", "marks")
    near = written(near.mapInArrow(_windows(length), "d long, th long, text string, starts array<int>, hashes array<long>"), "windows")
    each = near.select("d", "th", F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select("d", "th", F.col("w.starts").alias("start"), F.col("w.hashes").alias("hash"))
    repeated = each.groupBy("hash").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo <> hi").select("hash", "lo")
    repeated = written(repeated, "repeated")  # read back, so that hot windows of the join can be split
    at = each.join(repeated, "hash").groupBy("th").agg(F.collect_list(F.struct("start", "lo")).alias("at"))
    cut = near.select("d", "th", "text").join(at, "th").select("d", "th", "text", "at").mapInArrow(_passages(length), "shard long, query boolean, th long, start int, words int, passage string")
    cut = written(cut, "passages")
    salts = cut.filter("query").groupBy("shard").agg(F.ceil(F.sum("words") / F.lit(query_words)).cast("int").alias("salts"))
    salted = cut.join(salts, "shard").withColumn("salt", F.explode(F.when(F.col("query"), F.array(F.pmod(F.xxhash64("th", "start"), F.col("salts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))))
    streams = salted.select("shard", "salt", "query", "th", "start", "passage").repartition(n_parts(docs.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", "query")
    spans = streams.mapInArrow(_match(length), "th long, begin int, end int").groupBy("th").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    cleaned = written(near.select("th", "text").join(spans, "th").select("th", "text", "spans").mapInArrow(_keep, "th long, gone long, rest_sha string, rest string"), "cleaned")
    nothing = hashlib.sha256(b"").hexdigest()
    out = rows.select("d", "text_sha", "n_words", "sha").join(firsts.withColumnRenamed("d", "first"), "text_sha", "left").join(cleaned.select("th", "gone", "rest_sha"), "th", "left")
    copy = F.col("first").isNotNull() & (F.col("d") > F.col("first"))
    report = out.select(
        F.when(F.col("d") < _LAST, F.col("d")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("rest_sha", "sha")).alias("kept_sha256"),
    )
    return report, cleaned.join(firsts, "th").select("text_sha", F.col("rest").alias("text"))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
