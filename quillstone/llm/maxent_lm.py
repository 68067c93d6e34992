"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The class factor is a maximum-entropy model: a softmax over classes of the summed
weights of hashed history features, which are the word before, the two words before (n-grams), and the second and third word before
alone (skip features). The word factor within a class has one feature, the word itself, whose maximum-entropy solution is its
share of the class, smoothed by `ALPHA` as the base model is. Frequent words, those with at least 1/`HEAVY` of all tokens (so at most
`HEAVY` words), are units of their own; all others, unseen ones too, go by form, one of `FORMS` buckets of a word's first bytes. Classes
are clusters of units that stand between alike words, found from counts over all training tokens. The end has its own.

1. Counts. Word hashes with forms and counts go to owners by hash range, merged in each batch first; owners keep the whole vocabulary's counts.
2. Classes. Every partition counts, for each unit, hashed buckets of the words before and after it; the sums over all partitions, a table
   of fixed size, are clustered on the driver (weighted k-means over square roots of shares, `CLASSES` - 1 clusters).
3. Training. In each of `ROUNDS` rounds every partition runs gradient steps (Adagrad, minibatches) over its share of that round's
   training documents from common weights, and the weights come back as token-weighted means, block by block, in two levels. The
   rounds' documents are disjoint and together all training documents.
4. Scoring. Whole texts are scored in numpy batches. Counts of frequent words are at hand; those of all others are asked of their
   owners, who answer each piece of texts with sums per text.

Beyond `FAN` owners counts, requests and answers run over two levels: regions of owners first, whose messages are put together, about
`REGION_WORDS` words at a time, and dealt on, so a message holds hundreds of words at every size.

Sent to every task: the frequent words with their classes and the weights, both of fixed size. Edge cases: null and empty texts are one end token; texts are
read whole; equal texts have equal scores and are asked for once per batch; repeated rows come back each; a null doc_id is held
out or not by crc32 of nothing (it trains); without training tokens every score is 0; an empty table gives no rows; other columns
are ignored, whatever their names. Words are told apart by 64-bit hashes, texts by half of their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import finish, hash_bytes, n_parts, trimmed, written
from quillstone.llm.jaccard_join import FAN, fans

ALPHA = 0.1
HEAVY, FORMS, CLASSES = 65_536, 256, 24
#: Buckets of neighbours on each side, and rounds of clustering.
SIDE, TURNS = 32, 12
BUCKETS_LOG2, ROUNDS = 15, 2
MINIBATCH, RATE, CALM = 200_000, 0.25, 12.0
OWNER_TOKENS, LEVEL = 3_000_000, 256
BLOCKS, BLOCK_TOKENS = 32, 20_000
#: Words put together before a region's messages are dealt on, and tasks that do so for a region.
REGION_WORDS, REGION_TASKS = 2_000_000, 16
#: A text's key, half of its SHA-256.
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_MASK = np.uint64((1 << BUCKETS_LOG2) - 1)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of the texts, each closed by an end, their forms, and where each text begins."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw).lower() + b"\n\n\n"
    h, begins = hash_bytes(data)
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    form = finish(b[begins] << np.uint64(16) | b[begins + 1] << np.uint64(8) | (b[begins + 2] if len(begins) else begins.astype(np.uint64))) % np.uint64(FORMS)
    bounds = np.searchsorted(begins, np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw]))))
    return np.insert(h, bounds[1:], END), np.insert(form.astype(np.int16), bounds[1:], 0), bounds + np.arange(len(bounds))


def features(tok: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Four feature buckets for each token, from the tokens before it in its text."""
    back = [tok]
    for k in (1, 2, 3):
        b = np.concatenate((np.full(min(k, len(tok)), START), tok[:-k]))
        for j in range(k):
            at = bounds[:-1] + j
            b[at[at < bounds[1:]]] = START
        back.append(b)
    salt = [np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1) for k in (1, 2, 3, 4)]
    with np.errstate(over="ignore"):
        mixed = (back[1] + salt[0], back[1] * salt[1] + back[2], back[2] + salt[2], back[3] + salt[3])
        return np.stack([(finish(m) & _MASK).astype(np.int32) for m in mixed])


class Lexicon:
    """Frequent words with their forms and counts; unit i is frequent word i, or form i less the number of words. classes: of every unit."""

    def __init__(self, hashes: np.ndarray, forms: np.ndarray, counts: np.ndarray):
        by = np.argsort(hashes)
        self.hashes, self.forms, self.counts = hashes[by], forms[by], counts[by]
        self.classes = np.zeros(len(by) + FORMS, np.int8)

    def units(self, tok: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units, and counts, 0 for words that are not frequent."""
        n = len(self.hashes)
        if not n:
            return form.astype(np.int64), np.zeros(len(tok), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, tok), n - 1)
        hit = self.hashes[at] == tok
        return np.where(hit, at, n + form), np.where(hit, self.counts[at], 0)

    def look(self, tok: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes, and counts, 0 for words that are not frequent."""
        units, counts = self.units(tok, form)
        return self.classes[units], counts


def clustered(table: np.ndarray, weight: np.ndarray, k: int, turns: int = TURNS) -> np.ndarray:
    """Cluster of each row by weighted k-means over square roots of shares on either side; rows without counts are cluster 0. Deterministic."""
    n = len(table)
    x = np.concatenate([np.sqrt(t / np.maximum(t.sum(1, keepdims=True), 1)) for t in (table[:, :SIDE].astype(float), table[:, SIDE:].astype(float))], axis=1).astype(np.float32)
    w = weight.astype(float) * (table.sum(1) > 0)
    if n == 0 or not w.any():
        return np.zeros(n, np.int64)
    centres = [x[np.argmax(w)]]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k and (far * w).max() > 1e-9:  # the heaviest of what is far from all centres
        centres.append(x[np.argmax(far * np.sqrt(w))])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    c = np.stack(centres)
    for _ in range(turns):
        of = np.argmin((c**2).sum(1) - 2 * (x @ c.T), axis=1)
        mass = np.bincount(of, w, len(c))
        sums = np.stack([np.bincount(of, w * col, len(c)) for col in x.T], axis=1)
        c = np.where(mass[:, None] > 0, sums / np.maximum(mass[:, None], 1e-9), c).astype(np.float32)
    return np.argmin((c**2).sum(1) - 2 * (x @ c.T), axis=1)


def _logits(weights: np.ndarray, bias: np.ndarray, f: np.ndarray):
    """Blocks of tokens that fit a processor's cache: their range, and the classes' logits less the largest."""
    for i in range(0, f.shape[1], BLOCK_TOKENS):
        part = f[:, i : i + BLOCK_TOKENS]
        z = weights.take(part[0], axis=0)
        for row in part[1:]:
            z += weights.take(row, axis=0)
        z += bias
        z -= z.max(axis=1)[:, None]
        yield slice(i, i + len(z)), z


def class_shares(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    """P(class | history), tokens by classes."""
    out = np.empty((f.shape[1], len(bias)), np.float32)
    for at, z in _logits(weights, bias, f):
        np.exp(z, out=z)
        out[at] = z / z.sum(axis=1)[:, None]
    return out


def log_class(weights: np.ndarray, bias: np.ndarray, f: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural log of P(class | history) of each token's own class."""
    out = np.empty(f.shape[1])
    for at, z in _logits(weights, bias, f):
        own = z[np.arange(len(z)), classes[at]]
        out[at] = own - np.log(np.exp(z, out=z).sum(axis=1))
    return out


class Learner:
    """Adagrad over minibatches; rarely seen features move little."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.w, self.b = weights.copy(), bias
        self.seen = np.zeros_like(self.w)
        self.n = 0

    def learn(self, f: np.ndarray, classes: np.ndarray) -> None:
        for at in range(0, len(classes), MINIBATCH):
            part, c = f[:, at : at + MINIBATCH], classes[at : at + MINIBATCH]
            g = class_shares(self.w, self.b, part)
            g[np.arange(len(c)), c] -= 1
            g = np.ascontiguousarray(g.T)
            total = np.stack([sum(np.bincount(row, col, len(self.w)) for row in part) for col in g], axis=1).astype(np.float32)
            self.seen += total**2
            self.w -= RATE * total / (np.sqrt(self.seen) + CALM)
            self.n += len(c)


def _slices(column: pa.Array | list[str | None], chars: int = 2_500_000):
    out, total = [], 0
    for at in range(0, len(column), 256):
        for t in column[at : at + 256] if isinstance(column, list) else column.slice(at, 256).to_pylist():
            out.append(t)
            total += len(t or "")
            if total >= chars:
                yield out
                out, total = [], 0
    if out:
        yield out


def _owner(h: np.ndarray, owners: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int32)


def _runs(dest: np.ndarray) -> list[tuple[int, slice]]:
    """The runs of an ascending array."""
    edges = np.concatenate(([0], np.flatnonzero(dest[1:] != dest[:-1]) + 1, [len(dest)])) if len(dest) else np.zeros(1, np.int64)
    return [(int(dest[a]), slice(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


COUNTS = "owner int, hashes binary, counts binary, forms binary"


def _counts_to(dest: np.ndarray, h: np.ndarray, c: np.ndarray, form: np.ndarray) -> pa.RecordBatch:
    """A message of ascending word hashes to each destination."""
    runs = _runs(dest)
    columns = [[x[s].tobytes() for _, s in runs] for x in (h, c.astype(np.int64), form.astype("u1"))]
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in runs], pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], ["owner", "hashes", "counts", "forms"])


def _count(owners: int, per: int):
    """Counts go to regions of `per` owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for texts in _slices(batch.column(0)):
                tok, form, _ = tokens(texts)
                h, first, c = np.unique(tok, return_index=True, return_counts=True)
                yield _counts_to(_owner(h, owners) // per, h, c, form[first])

    return run


def _summed(hashes: list[bytes], counts: list[bytes], forms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, c, f = (np.frombuffer(b"".join(x), t) for x, t in ((hashes, np.uint64), (counts, np.int64), (forms, "u1")))
    u, first, back = np.unique(h, return_index=True, return_inverse=True)
    return u, np.bincount(back, c, len(u)).astype(np.int64), f[first]


def _bundles(rows: Iterator[tuple], words: int, most: int) -> Iterator[list[tuple]]:
    """Consecutive messages with about `most` words together; words: which column holds their hashes."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[words]) // 8
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in trimmed(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _deal_counts(owners: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _bundles(_rows(batches), 1, most):
            h, c, f = _summed(*list(zip(*held, strict=True))[1:])
            yield _counts_to(_owner(h, owners), h, c, f)

    return run


def _merge(table: pa.Table) -> pa.Table:
    u, total, f = _summed(*(table.column(x).to_pylist() for x in ("hashes", "counts", "forms")))
    of_form = [np.bincount(f, w, FORMS).astype(np.int64) for w in (total, None)]
    columns = [pa.array([table.column("owner")[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (u, total, f)), pa.array([int(total.sum())]), pa.array([len(u)]), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in of_form)]
    return pa.table(columns, names=["owner", "hashes", "counts", "forms", "n", "v", "form_n", "form_v"])


def _at_regions(sent: DataFrame, key: str) -> DataFrame:
    """Messages of a region together, in an order that a task run again sees again."""
    return sent.repartition("owner", F.pmod(F.xxhash64(key), F.lit(REGION_TASKS))).sortWithinPartitions("owner", key)


def _frequent(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, f in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                h, c, f = np.frombuffer(h, np.int64), np.frombuffer(c, np.int64), np.frombuffer(f, "u1")
                stay = (c >= least) | (h == END.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h[stay]), pa.array(c[stay]), pa.array(f[stay].astype(np.int32))], ["hash", "count", "form"])

    return run


def _neighbours(lexicon: Lexicon):
    """For each unit, how often words of each bucket stand before and behind it; one row a block of units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(lexicon.hashes) + FORMS
        table = np.zeros((n, 2 * SIDE), np.int64)
        for batch in trimmed(batches):
            for texts in _slices(batch.column(0)):
                tok, form, bounds = tokens(texts)
                unit = lexicon.units(tok, form)[0]
                near = (finish(tok) % np.uint64(SIDE)).astype(np.int64)
                inner = np.ones(len(tok), bool)
                inner[bounds[:-1]] = False  # the first of a text has none before it
                before = np.flatnonzero(inner)
                table += np.bincount(unit[before] * 2 * SIDE + near[before - 1], minlength=table.size).reshape(table.shape)
                table += np.bincount(unit[before - 1] * 2 * SIDE + SIDE + near[before], minlength=table.size).reshape(table.shape)
        if table.any():
            level, parts = TaskContext.get().partitionId() % LEVEL, np.array_split(table, BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([level] * BLOCKS, pa.int32()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], ["block", "level", "sums"])

    return run


def _sum(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<i8") for x in group["sums"])
    return pd.DataFrame({"block": group["block"].iloc[:1], "level": group["level"].iloc[:1] * 0, "sums": [total.tobytes()]})


def _train(lexicon: Lexicon, weights: np.ndarray, bias: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(weights, bias)
        for batch in trimmed(batches):
            for texts in _slices(batch.column(0)):
                tok, form, bounds = tokens(texts)
                learner.learn(features(tok, bounds), lexicon.look(tok, form)[0])
        if learner.n:
            level = TaskContext.get().partitionId() % LEVEL
            parts = np.split(learner.w - weights, BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([level] * BLOCKS, pa.int32()), pa.array([learner.n] * BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "level", "n", "move"]
            )

    return run


def _mean(group: pd.DataFrame) -> pd.DataFrame:
    n = int(group["n"].sum())
    move = sum(np.frombuffer(m, np.float32) * np.float32(k / n) for m, k in zip(group["move"], group["n"], strict=True))
    return pd.DataFrame({"block": group["block"].iloc[:1], "level": group["level"].iloc[:1] * 0, "n": [n], "move": [move.tobytes()]})


def _score(lexicon: Lexicon, weights: np.ndarray, bias: np.ndarray, scale: np.ndarray):
    """scale: log10 of each class's denominator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            at = 0
            for texts in _slices(batch.column(3)):
                tok, form, bounds = tokens(texts)
                classes, counts = lexicon.look(tok, form)
                f = features(tok, bounds)
                part = log_class(weights, bias, f, classes) / np.log(10) - scale[classes]
                own = np.where(counts > 0, np.log10(counts + ALPHA), 0.0)
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (part, own, (counts > 0).astype(np.int64))]
                own_rows = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*(own_rows.column(k) for k in range(3)), pa.array(np.diff(bounds), pa.int64()), *map(pa.array, sums)], ["doc_id", "held_out", "th", "n_tokens", "class_part", "own_part", "own_known"])

    return run


ASKED = "owner int, piece long, ths binary, asked binary, who binary, times binary"
TOLD = "piece long, owner int, ths binary, part binary, known binary"


def _asked_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["owner", "piece", "ths", "asked", "who", "times"])


def _told_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=["piece", "owner", "ths", "part", "known"])


def _named(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _requests(piece: int, dest: np.ndarray, tok: np.ndarray, who: np.ndarray, times: np.ndarray, keys: np.ndarray) -> list[tuple]:
    """For each destination (ascending): the keys of its texts, and word hashes with text and multiplicity."""
    rows = []
    for d, s in _runs(dest):
        local, back = np.unique(who[s], return_inverse=True)
        rows.append((d, piece, keys[local].tobytes(), tok[s].tobytes(), back.astype("<u4").tobytes(), times[s].astype("<u4").tobytes()))
    return rows


def _ask(lexicon: Lexicon, owners: int, per: int):
    """Requests to regions of `per` owners for words that are not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            keys, at = np.frombuffer(b"".join(first), KEY), 0
            for texts in _slices(list(first.values())):
                own_keys = keys[at : at + len(texts)]
                at += len(texts)
                tok, form, bounds = tokens(texts)
                who = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(bounds))
                rare = lexicon.look(tok, form)[1] == 0
                tok, who = tok[rare], who[rare]
                order = np.lexsort((who, tok))
                tok, who = tok[order], who[order]
                new = np.flatnonzero(np.concatenate(([True], (tok[1:] != tok[:-1]) | (who[1:] != who[:-1])))) if len(tok) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(tok)))
                rows = _requests(_named(own_keys.tobytes()), _owner(tok[new], owners) // per, tok[new], who[new], times, own_keys)
                if rows:
                    yield _asked_batch(rows)

    return run


def _deal(owners: int, per: int, most: int):
    """Puts a region's requests together and deals them on to its owners. A text goes by its number in the bundle; a row without words names them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, of_region in groupby(_rows(batches), lambda r: r[0]):
            for held in _bundles(of_region, 3, most):
                _, pieces, ths, *words = zip(*held, strict=True)
                texts = [len(x) // KEY.itemsize for x in ths]
                tok, who, times = (np.frombuffer(b"".join(x), t) for x, t in zip(words, (np.uint64, "<u4", "<u4"), strict=True))
                who = who + np.repeat(np.cumsum([0, *texts[:-1]]), [len(x) // 8 for x in words[0]])
                order = np.lexsort((who, tok))
                tok, who, times = tok[order], who[order], times[order]
                head = np.array([len(held), region, *(x for pair in zip(pieces, texts, strict=True) for x in pair)], "<i8").tobytes()
                bundle = _named(head, *ths)
                rows = _requests(bundle, _owner(tok, owners), tok, who, times, np.arange(sum(texts), dtype="<u4"))
                yield _asked_batch([*rows, (region * per + bundle % per, bundle, head + b"".join(ths), b"", b"", b"")])

    return run


def _tell(asked: pa.Table, vocab: pa.Table) -> pa.Table:
    """An owner's answers, one row for each request: for each text the sum of log10(count + ALPHA) over the asked tokens, and how many are known."""
    rows = []
    h = np.frombuffer(vocab.column("hashes")[0].as_py(), np.uint64) if vocab.num_rows else np.zeros(0, np.uint64)
    c = np.frombuffer(vocab.column("counts")[0].as_py(), np.int64) if vocab.num_rows else np.zeros(0, np.int64)
    for owner, piece, keys, words, who, times in zip(*(asked.column(x).to_pylist() for x in ("owner", "piece", "ths", "asked", "who", "times")), strict=True):
        words, who, times = np.frombuffer(words, np.uint64), np.frombuffer(who, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
        counts = np.zeros(len(words), np.int64)
        if len(h):
            at = np.minimum(np.searchsorted(h, words), len(h) - 1)
            counts = np.where(h[at] == words, c[at], 0)
        part = np.bincount(who, times * np.log10(counts + ALPHA))  # every text of a request is asked for
        known = np.bincount(who, times * (counts > 0)).astype(np.int64)
        rows.append((piece, owner, keys, part.tobytes(), known.tobytes()))
    return _told_table(rows)


def _each(answers: pa.Table) -> dict[int, tuple[bytes, bytes, bytes]]:
    """Answers by who gave them, in order; what is asked twice is answered alike."""
    rows = zip(*(answers.column(c).to_pylist() for c in ("owner", "ths", "part", "known")), strict=True)
    return dict(sorted((o, x) for o, *x in rows if x[1]))


def _regions_answers(answers: pa.Table) -> pa.Table:
    """Sums the owners' answers to a bundle: the region's answer to each of its requests."""
    head = next(k for k, p in zip(answers.column("ths").to_pylist(), answers.column("part").to_pylist(), strict=True) if not p)
    n, region = np.frombuffer(head, "<i8", 2)
    of = np.frombuffer(head, "<i8", 2 * n, 16).reshape(-1, 2)
    cuts, keys = np.concatenate(([0], np.cumsum(of[:, 1]))), np.frombuffer(head, KEY, offset=16 + 16 * n)
    part, known = np.zeros(cuts[-1]), np.zeros(cuts[-1], np.int64)
    for texts, p, k in _each(answers).values():
        at = np.frombuffer(texts, "<u4")
        part[at] += np.frombuffer(p)
        known[at] += np.frombuffer(k, np.int64)
    return _told_table([(int(piece), int(region), *(x[a:b].tobytes() for x in (keys, part, known))) for piece, a, b in zip(of[:, 0], cuts, cuts[1:])])


def _gather(answers: pa.Table) -> pa.Table:
    """Sums the answers to one piece of texts, which is asked once of each region however often it occurs."""
    keys, part, known = (np.concatenate([np.frombuffer(x, t) for x in xs]) for xs, t in zip(zip(*_each(answers).values(), strict=True), (KEY, np.float64, np.int64), strict=True))
    order = np.lexsort((keys["b"], keys["a"]))
    keys, part, known = keys[order], part[order], known[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    of = np.cumsum(new) - 1
    return pa.table([pa.array([k.tobytes() for k in keys[new]], pa.binary()), pa.array(np.bincount(of, part)), pa.array(np.bincount(of, known).astype(np.int64))], names=["th", "part", "known"])


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray
    bias: np.ndarray
    #: log10 of each class's denominator.
    scale: np.ndarray
    #: Tokens and distinct tokens of the training documents.
    n: int
    v: int
    vocab: DataFrame
    #: Regions, and owners in each.
    fan: tuple[int, int]


def fitted(named: DataFrame, *, rounds: int = ROUNDS, owners: int | None = None, fan: int = FAN, region_words: int = REGION_WORDS) -> Model:
    """named: doc_id, held_out, text without nulls."""
    spark = named.sparkSession
    training = named.filter(~F.col("held_out"))
    if owners is None:
        size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        owners = max(n_parts(spark), size // 6 // OWNER_TOKENS)
    regions, per = fans(owners, fan)
    sent = training.select("text").mapInArrow(_count(regions * per, per), COUNTS)
    if per > 1:
        sent = _at_regions(sent, "hashes").mapInArrow(_deal_counts(regions * per, region_words), COUNTS)
    vocab = written(sent.groupBy("owner").applyInArrow(_merge, f"{COUNTS}, n long, v long, form_n array<long>, form_v array<long>"), "vocabulary")
    total = vocab.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = total["n"] or 0, total["v"] or 0
    often = vocab.select("hashes", "counts", "forms").mapInArrow(_frequent(n / HEAVY), "hash long, count long, form int").collect()  # at most HEAVY words and the end
    lexicon = Lexicon(np.array([r["hash"] for r in often], np.int64).view(np.uint64), np.array([r["form"] for r in often], np.int64), np.array([r["count"] for r in often], np.int64))
    units = len(lexicon.hashes) + FORMS
    unit_n, unit_v = np.zeros(units, np.int64), np.ones(units, np.int64)
    unit_n[: units - FORMS], unit_v[units - FORMS :] = lexicon.counts, 0
    each = vocab.select(F.posexplode(F.arrays_zip("form_n", "form_v")).alias("form", "z")).groupBy("form").agg(F.sum("z.form_n").alias("n"), F.sum("z.form_v").alias("v"))
    for r in each.collect():  # FORMS rows
        own = lexicon.forms == r["form"]
        unit_n[units - FORMS + r["form"]], unit_v[units - FORMS + r["form"]] = r["n"] - lexicon.counts[own].sum(), r["v"] - own.sum()
    near = training.select("text").mapInArrow(_neighbours(lexicon), "block int, level int, sums binary")
    for keys in (("block", "level"), ("block",)):
        near = near.groupBy(*keys).applyInPandas(_sum, "block int, level int, sums binary")
    blocks = {r["block"]: np.frombuffer(r["sums"], "<i8") for r in near.select("block", "sums").collect()}  # the table, of fixed size
    if blocks:
        lexicon.classes[:] = 1 + clustered(np.concatenate([blocks[i] for i in range(BLOCKS)]).reshape(units, 2 * SIDE), unit_n, CLASSES - 1)
    lexicon.classes[: units - FORMS][lexicon.hashes == END] = 0
    class_n, class_v = np.bincount(lexicon.classes, unit_n, CLASSES), np.bincount(lexicon.classes, unit_v, CLASSES)
    scale = np.log10(class_n + ALPHA * (class_v + 1))
    bias = np.log((class_n + 1) / (class_n.sum() + CLASSES)).astype(np.float32)
    weights = np.zeros((1 << BUCKETS_LOG2, CLASSES), np.float32)
    for r in range(rounds):
        turn = training.filter(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(rounds)) == r).select("text")
        moves = turn.mapInArrow(_train(lexicon, weights, bias), "block int, level int, n long, move binary")
        for keys in (("block", "level"), ("block",)):
            moves = moves.groupBy(*keys).applyInPandas(_mean, "block int, level int, n long, move binary")
        for row in moves.select("block", "move").collect():  # the weights, of fixed size
            at = row["block"] * len(weights) // BLOCKS
            weights[at : at + len(weights) // BLOCKS] += np.frombuffer(row["move"], np.float32).reshape(-1, CLASSES)
    return Model(lexicon, weights, bias, scale, n, v, vocab, (regions, per))


def scored(docs: DataFrame, *, rounds: int = ROUNDS, owners: int | None = None, fan: int = FAN, region_words: int = REGION_WORDS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.substring(F.unhex(F.sha2(text, 256)), 1, KEY.itemsize).alias("th"), text.alias("text"))
    lexicon, weights, bias, scale, n, v, vocab, (regions, per) = fitted(named, rounds=rounds, owners=owners, fan=fan, region_words=region_words)
    rows = named.mapInArrow(_score(lexicon, weights, bias, scale), f"doc_id {kind}, held_out boolean, th binary, n_tokens long, class_part double, own_part double, own_known long")
    asked = named.select("th", "text").mapInArrow(_ask(lexicon, regions * per, per), ASKED)
    if per > 1:
        asked = _at_regions(asked, "piece").mapInArrow(_deal(regions * per, per, region_words), ASKED)
    told = asked.groupBy("owner").cogroup(vocab.select("owner", "hashes", "counts").groupBy("owner")).applyInArrow(_tell, TOLD)
    if per > 1:
        told = told.groupBy("piece").applyInArrow(_regions_answers, TOLD)
    told = told.groupBy("piece").applyInArrow(_gather, "th binary, part double, known long")
    told = written(told.groupBy("th").agg(F.max("part").alias("part"), F.max("known").alias("known")), "told")  # a text in several pieces has the same sums in each
    counts = F.col("own_part") + F.coalesce("part", F.lit(0.0))
    base = float(np.log10(n + ALPHA * (v + 1)))
    none = F.lit(n == 0)
    return rows.join(told, "th", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("own_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.when(none, F.lit(0.0)).otherwise(counts - F.col("n_tokens") * base).alias("base_score"),
        F.when(none, F.lit(0.0)).otherwise(counts + F.col("class_part")).alias("score"),
    )


def op3_maxent_lm(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
