"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Documents are sets of distinct 5-word shingles, as 64-bit hashes. Two link if their sets' Jaccard similarity is at least `percent`.

1. Counting. One pass makes every document's set id and size, and counts each shingle that two classes of equal sets or more of a
   slice of texts hold. Shingles whose counts add up to over `LIST_LIMIT` classes (or a two-millionth of all, so that there are never
   more than two million of them) are heavy; every other list is at most that limit and one entry a slice long.
2. Exchange. The hashes of every class go to owners by hash range, an owner for each `OWNER_SHINGLES` of the input. An owner counts
   in how many classes a shingle occurs (its list's length) and drops those of a single class: no link needs them. What stays goes to
   holders by class. Heavy shingles go to the holders directly and count as the longest lists, so no owner gets a list that grows
   with the input. Beyond `FAN` owners both ways run over two levels: regions first, whose messages are put together and dealt to the
   region's owners, so a message holds hundreds of shingles at every size.
3. Shingles are ordered by (list length, hash), rarest first. A class of n shingles needs T = ceil(percent * n) in common with any
   partner, so partners meet in the first n - T + 1 of both. Classes meeting there form blocks (components of that coarse graph).
4. In a block each class is a T-occurrence query: its L longest inverted lists are set aside, the short ones are merged into counts,
   classes with T - L occurrences there are probed in the long lists by binary search (where so many are left that merging the long
   lists too is less work, they are merged), and those reaching the required overlap link.
   Classes known to be connected already are not counted again, and members of the largest tree need no query of their own.
5. A block of over `block` classes is cut. A few of its classes are queries against all of it, chunk by chunk, which joins large
   groups of near copies in one linear pass. If at most `block` classes are then outside the largest group, they are the queries of a
   second such pass, and the block is done. Else it falls into the lists of the shared prefix shingles whose classes are not all
   connected, each list with a given membership once; a list of over `block` classes is cut as a block is, its queries in sets of `block`.
   Near copies of one text share most of their prefixes, so that their lists hold the same pairs again and again: where the lists
   have more comparisons than the block, the block's queries go against all of it, in sets of `block`.
6. Links (a spanning set of them) give components, whose name is their smallest doc_id.

Edge cases: null, blank and wordless texts have empty sets and link with nothing (component: themselves); texts with fewer than 5
words have one shingle, the whole sequence; texts are read whole; equal sets link; repeated rows are in one class; null doc_ids
take part and never name a component unless all its ids are null; an empty table gives no rows; other columns are ignored,
whatever their names. 48 bits of a hash within a region's range stand for a shingle; a false match inside a compared pair has a
chance of about n*n / 2**54.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import hash_texts, n_parts, trim, trimmed, window_hashes, written
from quillstone.llm.components import components

SIZE, PERCENT = 5, 75
#: Shingles an owner takes about; classes a task compares about; first queries of a large block.
OWNER_SHINGLES, BLOCK, PIVOTS = 2_000_000, 3_000, 4
#: Destinations that a sender addresses at most; shingles put together before a region's messages are dealt on.
FAN, REGION_SHINGLES = 2_048, 2_000_000
#: A list longer than this, or than this share of all shingles, is heavy; the share bounds how many are sent to every task.
LIST_LIMIT, HEAVY_MOST = 250_000, 2_000_000
#: DivideSkip's balance between merging and probing; entries of a list that are merged in the time of a probe.
MU, PROBE = 0.02, 32
_LOW = np.uint64((1 << 48) - 1)
HEAVY_LENGTH = 0xFFFF


def shingle_sets(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    h, bounds = hash_texts(texts, lower=True)
    g = window_hashes(h, size)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n = b - a
        out.append(np.unique(g[a : b - size + 1]) if n >= size else window_hashes(h[a:b], int(n)) if n else h[:0])
    return out


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parts(column: pa.ChunkedArray | pa.Array, chars: int = 2_500_000):
    """Slices of a batch with at most about so many characters."""
    texts, total = [], 0
    for at in range(0, len(column), 256):
        for t in column.slice(at, 256).to_pylist():
            texts.append(t)
            total += len(t or "")
            if total >= chars:
                yield texts
                texts, total = [], 0
    if texts:
        yield texts


def _sizes(size: int):
    """Set ids and sizes; the first row of each slice carries the shingles that two or more of its classes hold, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            at = 0
            for texts in _parts(batch.column(1)):
                sets = shingle_sets(texts, size)
                ids = [set_id(s) for s in sets]
                often, times = np.unique(np.concatenate(list(dict(zip(ids, sets, strict=True)).values())), return_counts=True)
                rest = [None] * (len(texts) - 1)
                shared = [[x[times > 1], *rest] for x in (often.view(np.int64), times)]
                own = batch.slice(at, len(texts))
                at += len(texts)
                columns = [own.column(0), own.column(2), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in shared)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_sha", "cid", "n", "often", "times"])

    return run


def heavy_shingles(rows: DataFrame, total: int, limit: int) -> np.ndarray:
    """Hashes, ascending, of the shingles in more than `limit` classes as far as slices tell; at most HEAVY_MOST."""
    each = rows.filter("often is not null").select(F.explode(F.arrays_zip("often", "times")).alias("z")).select(F.col("z.often").alias("h"), F.col("z.times").alias("c"))
    often = each.groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") > max(limit, total // HEAVY_MOST))
    return np.sort(np.array([r["h"] for r in often.select("h").collect()], np.int64).view(np.uint64))


def _among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(h), bool)
    return ordered[np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)] == h


def fans(owners: int, most: int = FAN) -> tuple[int, int]:
    """Regions, and owners in each."""
    if owners <= most:
        return owners, 1
    side = min(0xFFFF, int(np.ceil(np.sqrt(owners))))
    return side, side


def _of(values: np.ndarray, low: int, n: int) -> np.ndarray:
    """Which of n equal ranges 16 bits of 64-bit values lie in."""
    return ((values >> np.uint64(low) & np.uint64(0xFFFF)) * np.uint64(n) >> np.uint64(16)).astype(np.int64)


class Shingles:
    """Entries (shingle, class) with what messages carry of them. A message has a destination, its classes' ids, sizes and numbers of shingles, then the shingles class by class. Sizes take 2 bytes and numbers 1, or 4 each where some in the message is larger."""

    NAMES = ("dest", "ids", "ns", "counts", "keys", "lengths")
    KINDS = (pa.int64(), *[pa.binary()] * 5)
    DDL = "dest long, ids binary, ns binary, counts binary, keys binary, lengths binary"

    def __init__(self, keys: np.ndarray, cids: np.ndarray, ns: np.ndarray, lengths: np.ndarray):
        self.keys, self.cids, self.ns, self.lengths = keys, cids, ns, lengths

    @classmethod
    def read(cls, ids: list, ns: list, counts: list, keys: list, lengths: list) -> Shingles:
        small = lambda parts, kind: np.concatenate([np.frombuffer(x, kind if 8 * len(x) < 4 * len(i) else "<u4") for x, i in zip(parts, ids, strict=True)]).astype(np.int32)
        times = small(counts, "u1")
        packed = b"".join(keys)
        wide = len(packed) == 8 * int(times.sum())  # 8 bytes from an owner on, 6 before
        if wide:
            k = np.frombuffer(packed, np.uint64)
        else:
            full = np.zeros((len(packed) // 6, 8), np.uint8)
            full[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
            k = full.view("<u8").ravel()
        return cls(k, np.repeat(np.frombuffer(b"".join(ids), np.int64), times), np.repeat(small(ns, "<u2"), times), np.frombuffer(b"".join(lengths), "<u2") if wide else np.zeros(len(k), np.uint16))

    def messages(self, dest: np.ndarray, wide: bool, by_class: bool = False):
        """A batch of messages to the destinations of the entries; none without entries. by_class: entries of a class stand together."""
        if len(dest) and dest.max() <= 0xFFFF:
            dest = dest.astype(np.uint16)
        order = np.argsort(dest, kind="stable") if by_class else np.lexsort((self.cids, dest))
        d, c, n, k, ln = dest[order], self.cids[order], self.ns[order], self.keys[order], self.lengths[order]
        if not len(d):
            return
        runs = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (c[1:] != c[:-1]))))
        counts = np.diff(np.append(runs, len(d)))
        small = lambda v, kind: v.astype(kind if v.max() <= np.iinfo(kind).max else "<u4").tobytes()
        heads = np.flatnonzero(np.concatenate(([True], d[runs][1:] != d[runs][:-1])))
        packed = k if wide else np.ascontiguousarray(k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
        rows = []
        for a, b in zip(heads, np.append(heads[1:], len(runs)), strict=True):
            r, lo, hi = runs[a:b], runs[a], runs[b] if b < len(runs) else len(d)
            rows.append((int(d[lo]), c[r].tobytes(), small(n[r], "<u2"), small(counts[a:b], "u1"), packed[lo:hi].tobytes(), ln[lo:hi].astype("<u2").tobytes() if wide else b""))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), self.KINDS, strict=True)], list(self.NAMES))


def _send(size: int, regions: int, heavy: np.ndarray):
    """Sender: for each region the low 48 bits of hashes, class by class. Heavy shingles are left to _send_heavy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for texts in _parts(batch.column(0)):
                classes = {set_id(s): s for s in shingle_sets(texts, size) if len(s)}
                if not classes:
                    continue
                times = [len(s) for s in classes.values()]
                h, ids, ns = np.concatenate(list(classes.values())), np.repeat(np.array(list(classes), np.int64), times), np.repeat(np.array(times, np.int32), times)
                if len(heavy):
                    light = ~_among(h, heavy)
                    h, ids, ns = h[light], ids[light], ns[light]
                yield from Shingles(h & _LOW, ids, ns, np.zeros(len(h), np.uint16)).messages(_of(h, 48, regions), False, True)

    return run


def _holder(cids: np.ndarray, fan: tuple[int, int]) -> np.ndarray:
    c = cids.view(np.uint64)
    return _of(c, 48, fan[0]) * fan[1] + _of(c, 32, fan[1])


def _send_heavy(size: int, fan: tuple[int, int], heavy: np.ndarray):
    """Sender of heavy shingles: straight to the holders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for texts in _parts(batch.column(0)):
                classes = {}
                for s in shingle_sets(texts, size):
                    own = s[_among(s, heavy)]
                    if len(own):
                        classes[set_id(s)] = (len(s), own)
                if not classes:
                    continue
                h, times = np.concatenate([x for _, x in classes.values()]), [len(x) for _, x in classes.values()]
                ids, ns = np.repeat(np.array(list(classes), np.int64), times), np.repeat(np.array([n for n, _ in classes.values()], np.int32), times)
                keys = (_of(h, 48, fan[0]).astype(np.uint64) << np.uint64(48)) | (h & _LOW)
                yield from Shingles(keys, ids, ns, np.full(len(h), HEAVY_LENGTH, np.uint16)).messages(_holder(ids, fan), True, True)

    return run


def _deal_on(n: int, by_class: bool, most: int):
    """A region's messages, which come in order of region, put together and dealt to its n owners or holders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, held, total = None, [], 0

        def flush():
            s = Shingles.read(*(list(x) for x in zip(*held, strict=True)))
            yield from s.messages(region * n + _of(s.cids.view(np.uint64) if by_class else s.keys, 32, n), by_class)

        for batch in batches:
            for d, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (d != region or total >= most):
                    yield from flush()
                    held, total = [], 0
                region = d
                held.append(row)
                total += len(row[3]) // 6
        if held:
            yield from flush()

    return run


def _dealt_on(messages: DataFrame, fan: tuple[int, int], by_class: bool, most: int) -> DataFrame:
    """Messages to regions as messages to the regions' owners; a region is dealt on by as many tasks as its owners need."""
    if fan[1] == 1:
        return messages
    salt = F.pmod(F.xxhash64("ids", "keys"), F.lit(max(1, fan[1] * OWNER_SHINGLES // (4 * most))))
    rows = messages.withColumn("salt", salt).repartition(n_parts(messages.sparkSession), "dest", "salt").sortWithinPartitions("dest").select(*Shingles.NAMES)
    return rows.mapInArrow(_deal_on(fan[1], by_class, most), Shingles.DDL)


def _own(fan: tuple[int, int]):
    """Owner: keeps shingles of two classes or more, with their list lengths, and deals them out to the holders' regions."""

    def run(table: pa.Table) -> pa.Table:
        region = np.uint64(table.column("dest")[0].as_py() // fan[1])
        s = Shingles.read(*(table.column(c).to_pylist() for c in Shingles.NAMES[1:]))
        del table
        order = np.lexsort((s.cids, s.keys))
        keys, cids, ns = s.keys[order], s.cids[order], s.ns[order]
        del s, order
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (cids[1:] != cids[:-1])))
        keys, cids, ns = keys[new], cids[new], ns[new]
        trim()
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        length = np.diff(np.append(heads, len(keys)))
        length = np.repeat(length, length)
        stay = length > 1
        out = Shingles(keys[stay] | region << np.uint64(48), cids[stay], ns[stay], np.minimum(length[stay], HEAVY_LENGTH - 1))
        schema = pa.schema(list(zip(Shingles.NAMES, Shingles.KINDS, strict=True)))
        return pa.Table.from_batches(out.messages(_of(out.cids.view(np.uint64), 48, fan[0]), True), schema)

    return run


def _hold(percent: int):
    """Holder: puts classes' shared shingles together, rarest first, and finds each one's prefix."""

    def run(table: pa.Table) -> pa.Table:
        s = Shingles.read(*(table.column(c).to_pylist() for c in Shingles.NAMES[1:]))
        order = np.lexsort((s.keys, s.lengths, s.cids))
        keys, cids, ns = s.keys[order], s.cids[order], s.ns[order].astype(np.int64)
        del s, order
        trim()
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (cids[1:] != cids[:-1])))  # heavy shingles of a class come from each sender that has it
        keys, cids, ns = keys[new], cids[new], ns[new]
        begin = np.flatnonzero(np.concatenate(([True], cids[1:] != cids[:-1])))
        end = np.append(begin[1:], len(cids))
        out = []
        for a, b in zip(begin, end, strict=True):
            n = int(ns[a])
            prefix = n - -(-percent * n // 100) + 1 - (n - (b - a))
            if prefix > 0:
                out.append((int(cids[a]), n, keys[a : a + prefix].view(np.int64), np.sort(keys[a:b]).tobytes()))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["cid", "n", "prefix", "shared"])

    return run


class Forest:
    def __init__(self, n: int):
        self.up, self.size, self.parts, self.largest = list(range(n)), [1] * n, n, 0

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        i, j = min(i, j), max(i, j)
        self.up[j] = i
        self.size[i] += self.size[j]
        self.parts -= 1
        if self.size[i] >= self.size[self.find(self.largest)]:
            self.largest = i
        return True

    def in_largest(self, i: int) -> bool:
        return self.find(i) == self.find(self.largest)


def search(sets: list[np.ndarray], ns: list[int], percent: int = PERCENT, known: list[int] | None = None, queries: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of a block that join what was apart, each a truly similar pair.

    sets: ascending keys; ns: sizes, keys left out too; known: labels already connected; queries: the members compared with all others
    (without it every pair is covered: a pair without a query lies in the largest tree at the end).
    """
    m = len(sets)
    forest, out = Forest(m), []
    first: dict[int, int] = {}
    for i, label in enumerate(known or ()):
        forest.join(first.setdefault(label, i), i)
    sizes = np.array(ns, np.int64)
    keys = np.concatenate(sets)
    who = np.repeat(np.arange(m, dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(keys, kind="stable")  # lists hold classes in ascending order
    postings, listed = who[order], keys[order]
    del keys, who, order
    heads = np.flatnonzero(np.concatenate(([True], listed[1:] != listed[:-1])))
    stops = np.append(heads[1:], len(listed))
    names = listed[heads]
    del listed
    #: Every entry as list * m + class, ascending: a binary search finds a class in any list.
    entries = np.repeat(np.arange(len(heads)), stops - heads) * m + postings

    #: Which tree each class is in.
    trees = np.array([forest.find(i) for i in range(m)], np.int64)

    def counts(lists: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([postings[:0], *[postings[heads[i] : stops[i]] for i in lists]]), minlength=m)

    def query(x: int) -> None:
        at = np.searchsorted(names, sets[x])
        lengths = stops[at] - heads[at]
        t = -(-percent * ns[x] // 100)
        by = at[np.argsort(-lengths, kind="stable")]  # longest first
        aside = min(t - 1, len(by), int(t / (MU * np.log2(int(lengths.max(initial=0)) + 2) + 1)))
        merged = counts(by[aside:])
        found = np.flatnonzero((merged >= max(1, t - aside)) & (trees != trees[x]))
        if not len(found):
            return
        total = merged[found]
        need = -(-percent * (ns[x] + sizes[found]) // (100 + percent))
        if aside and PROBE * len(found) * aside > (stops[by[:aside]] - heads[by[:aside]]).sum():
            total = total + counts(by[:aside])[found]
        elif aside:
            wanted = by[:aside, None] * m + found
            place = np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)
            total = total + (entries[place] == wanted).sum(axis=0)
        linked = found[total >= need]
        out.extend((x, c) for c in linked.tolist() if forest.join(x, c))
        if len(linked):
            trees[np.isin(trees, np.append(trees[linked], trees[x]))] = forest.find(x)

    todo = list(range(m)) if queries is None else queries
    while todo and forest.parts > 1:
        left = []
        for x in todo:
            if forest.parts == 1:
                break
            if queries is None and forest.size[forest.find(forest.largest)] > 1 and forest.in_largest(x):
                left.append(x)
            else:
                query(x)
        todo = [x for x in left if not forest.in_largest(x)]
    return out


def _search(percent: int):
    """Streams tasks in order: rows of one task stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def finish():
            asked = None if all(r[3] for r in held) else [i for i, r in enumerate(held) if r[3]]
            links = search([np.frombuffer(r[4], np.uint64) for r in held], [r[1] for r in held], percent, [r[2] for r in held], asked)
            if len(held) > 256:
                trim()
            return [(held[i][0], held[j][0]) for i, j in links]

        def table(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in trimmed(batches):
            out = []
            for t, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if t != task:
                    if len(held) > 1:
                        out += finish()
                    task, held = t, []
                held.append(row)
            yield table(out)
        if len(held) > 1:
            yield table(finish())

    return run


def _searched(tasks: DataFrame, percent: int) -> DataFrame:
    """tasks: task, cid, n, label, query, shared."""
    dealt = tasks.select("task", "cid", "n", "label", "query", "shared").repartition(n_parts(tasks.sparkSession), "task").sortWithinPartitions("task", "cid")
    return dealt.mapInArrow(_search(percent), "u long, v long")


def _asked(members: DataFrame, query, percent: int, block: int) -> DataFrame:
    """Links of queries with all of their block. members: block, cid, n, label, shared, m (members of the block), q (its queries); query: which are queries.

    A block is dealt in chunks and its queries in sets, of about `block` each; a task has a chunk and a set.
    """
    chunks, groups = F.ceil(F.col("m") / block).cast("int"), F.ceil(F.greatest("q", F.lit(1)) / block).cast("int")
    part = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "cid"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    placed = members.withColumn("chunk", part("chunk", chunks)).withColumn("chunks", chunks).withColumn("own", F.when(query, part("set", groups))).withColumn("groups", groups)
    inside = placed.withColumn("group", each(F.col("groups"))).withColumn("query", F.coalesce(F.col("own") == F.col("group"), F.lit(False)))
    outside = placed.filter(F.col("own").isNotNull()).withColumn("group", F.col("own")).withColumn("_to", each(F.col("chunks"))).filter("_to <> chunk").withColumn("chunk", F.col("_to")).drop("_to").withColumn("query", F.lit(True))
    rows = inside.unionByName(outside)
    return _searched(rows.withColumn("task", F.xxhash64("block", "chunk", "group")), percent)


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows: ..., cid, label. Follows the links found since."""
    named = components(links)
    return rows.join(named, rows["cid"] == named["id"], "left").withColumn("label", F.coalesce("root", "label")).drop("id", "root")


def large_links(members: DataFrame, keys: DataFrame | None, *, percent: int, block: int) -> DataFrame:
    """Links of blocks that are too large for a task. members: block, cid, n, label, shared, m; keys: cid, key, by which a block falls apart (None: it is such a list)."""
    chosen = members.groupBy("block").agg(F.array(*[F.min_by("cid", F.xxhash64(F.lit(i), "cid")) for i in range(PIVOTS)]).alias("pivots"))
    pivoted = members.join(chosen, "block").withColumn("q", F.lit(PIVOTS))
    found = written(_asked(pivoted, F.array_contains("pivots", F.col("cid")), percent, block), "pivot-links")
    named = written(_labelled(members.select("block", "cid", "label"), found), "labels")
    sizes = written(named.groupBy("block", "label").agg(F.count(F.lit(1)).alias("k")), "label-sizes")
    masses = sizes.groupBy("block").agg(F.max_by("label", F.struct("k", "label")).alias("mass"), (F.sum("k") - F.max("k")).alias("q"))
    masses = written(masses.filter("q > 0"), "masses")
    state = members.drop("label").join(named, ["block", "cid"]).join(masses, "block")
    near = state if keys is None else state.filter(F.col("q") <= block)
    asks = F.col("label") != F.col("mass")
    out = found.unionByName(written(_asked(near, asks, percent, block), "rest-links"))
    if keys is None or not masses.filter(F.col("q") > block).limit(1).count():
        return out
    hard = written(state.filter(F.col("q") > block), "hard")
    held = keys.join(hard.select("cid", "label", "block", asks.cast("int").alias("asks")), "cid")
    lists = held.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("cid")).alias("sign"), F.min("label").alias("a"), F.max("label").alias("b"), F.min("block").alias("of"), F.sum("asks").alias("asks"))
    lists = written(lists.filter("a <> b").groupBy("of", "m", "sign").agg(F.min("key").alias("key"), F.min("asks").alias("asks")), "lists")
    work = lists.groupBy("of").agg(F.sum(F.col("m").cast("double") * F.col("asks")).alias("work"))
    dense = written(work.join(sizes.groupBy("block").agg(F.sum("k").alias("m")).join(masses, "block"), F.col("of") == F.col("block")).filter("work >= cast(m as double) * q").select("block"), "dense")
    if dense.limit(1).count():
        out = out.unionByName(written(_asked(hard.join(dense, "block", "left_semi"), asks, percent, block), "dense-links"))
        lists = lists.join(dense, F.col("of") == F.col("block"), "left_anti")
    lists, hard = lists.select("key", "m"), hard.select("cid", "n", "label", "shared")
    rows = keys.join(lists, "key").join(hard, "cid").withColumnRenamed("key", "block")
    short = written(_searched(rows.filter(F.col("m") <= block).withColumn("task", F.col("block")).withColumn("query", F.lit(True)), percent), "list-links")
    out = out.unionByName(short)
    if lists.filter(F.col("m") > block).limit(1).count():
        out = out.unionByName(large_links(written(rows.filter(F.col("m") > block), "long-lists"), None, percent=percent, block=block))
    return out


def links(held: DataFrame, *, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """held: cid, n, prefix, shared. Returns u, v: similar pairs that connect all that is connected."""
    keys = held.select("cid", F.explode("prefix").alias("key"))
    meets = keys.groupBy("key").agg(F.min("cid").alias("v"), F.max("cid").alias("top")).filter("v <> top").select("key", "v")
    meets = written(meets, "meets")  # read back, so that hot keys of the join can be split
    coarse = keys.join(meets, "key").select(F.col("cid").alias("u"), "v").distinct()
    blocks = components(coarse).select(F.col("id").alias("cid"), F.col("root").alias("block"))
    counts = written(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("m")), "blocks")
    placed = held.select("cid", "n", "shared").join(blocks, "cid").join(counts, "block").withColumn("label", F.col("cid"))
    whole = placed.filter(F.col("m") <= block).withColumn("task", F.col("block")).withColumn("query", F.lit(True))
    found = written(_searched(whole, percent), "links")
    if not counts.filter(F.col("m") > block).limit(1).count():
        return found
    large = written(placed.filter(F.col("m") > block), "large")
    shared = keys.join(meets.select("key"), "key").join(large.select("cid"), "cid", "left_semi")
    return found.unionByName(large_links(large, written(shared, "large-keys"), percent=percent, block=block))


def join(docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT, block: int = BLOCK, owners: int | None = None, fan: int = FAN, list_limit: int = LIST_LIMIT) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id, text_sha (SHA-256 of the text, null as empty), set_id and root (a component's own id; null without shingles), one row per row of docs."""
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_sha"))
    rows = written(named.mapInArrow(_sizes(size), "doc_id long, text_sha binary, cid long, n long, often array<long>, times array<long>"), "sets")
    total = rows.agg(F.sum("n")).first()[0] or 0
    to = fans(owners or max(n_parts(spark), -(-total // OWNER_SHINGLES)), fan)
    most = min(REGION_SHINGLES, max(1, total)) if fan == FAN else 1_000
    heavy = heavy_shingles(rows, total, list_limit)
    sent = _dealt_on(named.select("text").mapInArrow(_send(size, to[0], heavy), Shingles.DDL), to, False, most)
    kept = _dealt_on(sent.groupBy("dest").applyInArrow(_own(to), Shingles.DDL), to, True, most)
    if len(heavy):
        kept = kept.unionByName(named.select("text").mapInArrow(_send_heavy(size, to, heavy), Shingles.DDL))
    held = written(kept.groupBy("dest").applyInArrow(_hold(percent), "cid long, n long, prefix array<long>, shared binary"), "held")
    roots = components(links(held, percent=percent, block=block))
    classes = rows.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
    joined = classes.join(roots, F.col("cid") == F.col("id"), "left").select("cid", F.coalesce("root", "cid").alias("root"), "least")
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named_classes = joined.join(best, "root").select("cid", "component_id", "root")
    out = rows.join(named_classes, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_sha", F.col("cid").alias("set_id"), "root")


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
