"""Quality rules by cross-document line frequency.

Each line is normalised (A-Z lower-cased, runs of 0-9 as one 0, runs of ASCII white space as one blank, none at the ends) and hashed. For
every host (the `source` column) the distinct documents holding a line are counted; documents with one and the same text count once,
so copies of a clean text do not make its lines common. A line is boilerplate if more than `line_share` of the host's distinct
documents hold it, and more than `line_least` of them, a floor of a few documents, so small hosts are judged by the share as large ones
are. Boilerplate lines are removed. A document is depleted, and rejected, if fewer than `least_words` words remain without them, or
less than `least_share` of its words. Base rules (too few words, too much repetition inside the text) reject too.

One pass over the texts makes the base measures and the lines' hashes, in numpy over slices of texts, which are written once;
counting and joining then move only hashes. Counts combine on the map side; the join of lines with boilerplate lines leaves hot
lines to adaptive skew handling, or is broadcast where Spark finds the boilerplate small. Only texts that lose lines are read again
in Python; they are found by host and SHA-256, sent to every task if they hold at most `broadcast_hashes` hashes, as counted, else by a shuffle.

Edge cases: null and blank texts have no words, fail the base rule, and are not kept; lines without words are never boilerplate; a
null source is a host of its own; an empty table gives no rows; repeated rows are judged alike and each returned; a text of any
length is read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import finish, hash_bytes, slices, trimmed, unrolled, window_hashes, written

LINE_SHARE, LINE_LEAST = 0.02, 6
LEAST_WORDS, LEAST_SHARE = 10, 0.2
REPEAT = 5
#: Line hashes, with eight a text besides, that are sent to every task at most.
BROADCAST_HASHES = 1_000_000
SYMBOLS = "#*$%&|<>"
SLICE_CHARS = 2_000_000
_DIGITS = re.compile(rb"[0-9]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def line_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line of the texts, one after another: its text, its normalised hash and its number of words."""
    data = b"\n".join([_DIGITS.sub(b"0", r.lower()) for r in raw]) + b"\n"
    h, begins = hash_bytes(data)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    bounds = np.concatenate(([0], np.searchsorted(begins, ends)))
    text = np.repeat(np.arange(len(raw)), [r.count(b"\n") + 1 for r in raw])
    return text, unrolled(h, bounds), np.diff(bounds)


def repeated_words(h: np.ndarray, bounds: np.ndarray, size: int = REPEAT) -> np.ndarray:
    """Of each text, the words in windows of `size` words that the text holds twice or more, the first of them too."""
    n = len(h)
    total = np.zeros(n + 1, np.int64)
    g = window_hashes(h, size)
    if len(g):
        doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
        own = np.flatnonzero(doc[: len(g)] == doc[size - 1 :])
        with np.errstate(over="ignore"):
            mixed = finish(g[own] + doc[own] * _STEP)
        _, back, counts = np.unique(mixed, return_inverse=True, return_counts=True)
        at = own[counts[back] > 1]
        np.add.at(total, at, 1)
        np.add.at(total, at + size, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(total[:-1]) > 0)))
    return covered[bounds[1:]] - covered[bounds[:-1]]


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in trimmed(batches):
        cuts = slices(whole.column(5).to_pylist(), SLICE_CHARS)
        for a, b in cuts:
            batch = whole.slice(a, b - a)
            part = [t or "" for t in batch.column(4).to_pylist()]
            raw = [encoded(t) for t in part]
            h, begins = hash_bytes(b"\n".join(raw) + b"\n")
            bounds = np.searchsorted(begins, np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw]))))
            of, lines, words = line_hashes(raw)
            some = words > 0
            heads = np.concatenate(([0], np.cumsum(np.bincount(of[some], minlength=len(part)))))
            lists = [pa.ListArray.from_arrays(pa.array(heads, pa.int32()), pa.array(v, t)) for v, t in ((lines[some].view(np.int64), pa.int64()), (words[some].astype(np.int32), pa.int32()))]
            chars = [len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")) for t in part]
            counts = [np.diff(bounds), chars, [sum(map(t.count, SYMBOLS)) for t in part], [duplicate_lines(t) for t in part], repeated_words(h, bounds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *(pa.array(c, pa.int64()) for c in counts), *lists], _NAMES)


_NAMES = ["doc_id", "source", "body", "text_sha", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]
_MEASURED = "doc_id long, source string, body long, text_sha binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def judged(docs: DataFrame, *, line_share: float = LINE_SHARE, line_least: int = LINE_LEAST, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """docs: doc_id, text, source. Returns doc_id, source, text_sha, the measures, boilerplate (its lines' hashes, null if it has none), base_failed, n_boilerplate_words and kept, one row per row of docs."""
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", "source", F.xxhash64(text).alias("body"), F.unhex(F.sha2(text, 256)).alias("text_sha"), "text", F.length(text).alias("chars"))
    rows = written(named.mapInArrow(_measure, _MEASURED).withColumn("row", F.monotonically_increasing_id()), "lines")
    hosts = rows.groupBy("source", "body").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"))
    each = rows.select("row", "source", "body", F.explode(F.arrays_zip("lines", "line_words")).alias("z")).select("row", "source", "body", F.col("z.lines").alias("line"), F.col("z.line_words").alias("words"))
    held = each.select("source", "line", "body").distinct().groupBy("source", "line").agg(F.count(F.lit(1)).alias("line_docs")).filter(F.col("line_docs") > line_least)
    held = held.withColumnRenamed("source", "_s").join(hosts, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    common = held.filter(F.col("line_docs") > F.col("host_docs") * line_share).select("_s", F.col("line").alias("_line"))
    lost = each.join(common, F.col("source").eqNullSafe(F.col("_s")) & (F.col("line") == F.col("_line"))).groupBy("row").agg(F.sum("words").alias("lost"), F.sort_array(F.collect_set("line")).alias("boilerplate"))
    out = rows.drop("lines", "line_words", "body").join(lost, "row", "left").withColumn("n_boilerplate_words", F.coalesce("lost", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    depleted = (F.col("n_boilerplate_words") > 0) & ((left < least_words) | (left < F.col("n_words") * least_share))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("row", "lost")


def without_lines(text: str, hashes) -> str:
    """The text less its lines of these hashes; lines without words stay."""
    _, found, words = line_hashes([encoded(text)])
    gone = (words > 0) & np.isin(found.view(np.int64), np.array(list(hashes), np.int64))
    return "\n".join([x for x, g in zip(text.split("\n"), gone, strict=True) if not g])


def _without_lines(text: pd.Series, hashes: pd.Series) -> pd.Series:
    return pd.Series([without_lines(t, h) if isinstance(t, str) else None for t, h in zip(text, hashes, strict=True)], dtype=object)


def cleaned(text, hashes):
    """Columns: a text less its lines of these hashes. Texts that lose none are not sent to Python."""
    some = F.coalesce(F.size(hashes) > 0, F.lit(False))
    return F.when(some, F.pandas_udf(_without_lines, "string")(F.when(some, text), hashes)).otherwise(text)


def changed_texts(docs: DataFrame, found: DataFrame, *, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """Each distinct text of a host that loses lines: source, text_sha, kept_text. found: what judged() returns."""
    wanted = written(found.filter("boilerplate is not null").select(F.col("source").alias("_s"), F.col("text_sha").alias("_sha"), "boilerplate").dropDuplicates(["_s", "_sha"]), "changed")
    small = (wanted.agg(F.sum(F.size("boilerplate") + 8)).first()[0] or 0) <= broadcast_hashes
    texts = docs.select("source", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_sha"))
    met = texts.join(F.broadcast(wanted) if small else wanted, F.col("source").eqNullSafe(F.col("_s")) & (F.col("text_sha") == F.col("_sha"))).select("source", "text_sha", "text", "boilerplate")
    return met.dropDuplicates(["source", "text_sha"]).select("source", "text_sha", cleaned(F.col("text"), F.col("boilerplate")).alias("kept_text"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = written(judged(docs), "judged")
    changed = changed_texts(docs, found).select(F.col("source").alias("_s"), F.col("text_sha").alias("_sha"), F.sha2("kept_text", 256).alias("changed"))
    out = found.join(changed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("text_sha") == F.col("_sha")), "left")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boilerplate_words"]
    return out.select(*names, F.coalesce("changed", F.lower(F.hex("text_sha"))).alias("cleaned_sha256"))
