"""Exact dedup by a Golomb-coded exchange of fingerprints.

1. Every row's text gets a SHA-256; its leading bits are the fingerprint. Runs of 1,024 rows are put together to senders of about 65,536
   rows, or of `MESSAGE` rows for each owner if that is more, so a message keeps at least about `MESSAGE` fingerprints and the number of
   messages follows the rows at every size.
2. A sender sorts its distinct fingerprints, cuts them by owner (a range of the fingerprint space) and sends each owner a
   Golomb-Rice code of the gaps. A text that a sender holds a thousand times is sent once, so no owner is flooded.
3. An owner decodes what it was sent, finds fingerprints that came from two senders or more, and answers each sender
   with a bitmap over that sender's list. Fingerprints repeated inside one sender are suspect without asking.
4. Only suspects' texts are shuffled: grouping by the whole text compares bytes, and combines on the map side first, so
   a group of copies of any size sends one text a partition. Single rows never move.

Suspects meet the texts through a broadcast join only if their counted number is at most `broadcast_rows`, else by a shuffle.

Edge cases: null and empty texts are equal; texts are compared without any change; of equal texts the row with the
largest doc_id stays (of rows that repeat that doc_id too, one); a null doc_id is smaller than any, and a group with only
null ids keeps one of them with keep_id null; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import golomb
from quillstone.llm.common import n_parts, written

#: Bits of a fingerprint. At n rows about n / 2**48 of the single texts are suspected wrongly, and then cleared by their bytes.
BITS = 48
SENDER_ROWS, RUN_LOG2, MESSAGE = 65_536, 10, 64
#: Fingerprints an owner decodes at once: 64 MB of them.
OWNER_ROWS = 8_000_000
BROADCAST_ROWS = 500_000


def _fingerprints(shas: pd.Series) -> np.ndarray:
    if not len(shas):
        return np.empty(0, np.uint64)
    return np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64) >> np.uint64(64 - BITS)


def _lists(fps: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct fingerprints, their counts, and where each owner's range begins."""
    distinct, counts = np.unique(fps, return_counts=True)
    edges = np.array([(o << BITS) // owners for o in range(owners + 1)], np.uint64)
    return distinct, counts, np.searchsorted(distinct, edges)


def _send(owners: int):
    def send(group: pd.DataFrame) -> pd.DataFrame:
        distinct, _, at = _lists(_fingerprints(group["sha"]), owners)
        out = []
        for o in np.flatnonzero(np.diff(at)):
            low, part = (int(o) << BITS) // owners, distinct[at[o] : at[o + 1]]
            k = golomb.rice_bits(len(part), ((int(o) + 1) << BITS) // owners - low)
            out.append((int(o), int(group["sender"].iloc[0]), len(part), k, golomb.encode(part - np.uint64(low), k)))
        return pd.DataFrame(out, columns=["owner", "sender", "n", "k", "code"])

    return send


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: which of a sender's fingerprints other senders hold too."""
    parts = [golomb.decode(c, n, k) for c, n, k in zip(group["code"], group["n"], group["k"], strict=True)]
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    shared = values[counts > 1]
    maps = []
    for p in parts:
        at = np.searchsorted(shared, p)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == p[hit]
        maps.append(np.packbits(hit).tobytes())
    return pd.DataFrame({"sender": group["sender"], "owner": group["owner"], "bitmap": maps})


def _receive(owners: int):
    def receive(rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"sha": pd.Series([], dtype=object)})
        fps = _fingerprints(rows["sha"])
        distinct, counts, at = _lists(fps, owners)
        suspect = counts > 1
        for o, bitmap in zip(bitmaps["owner"], bitmaps["bitmap"], strict=True):
            n = at[o + 1] - at[o]
            suspect[at[o] : at[o + 1]] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool)
        return pd.DataFrame({"sha": rows["sha"][suspect[np.searchsorted(distinct, fps)]].drop_duplicates()})

    return receive


def dealt(n: int, parts: int) -> tuple[int, int]:
    """Owners and senders for n rows."""
    owners = max(4, -(-n // OWNER_ROWS))
    return owners, max(parts, -(-n // max(SENDER_ROWS, MESSAGE * owners)))


def suspects(rows: DataFrame, owners: int | None = None) -> DataFrame:
    """rows: row, sha. Returns the distinct sha of rows whose fingerprint another row has too."""
    asked, senders = dealt(rows.count(), n_parts(rows.sparkSession))
    owners = owners or asked
    rows = rows.select(F.pmod(F.xxhash64(F.shiftright("row", RUN_LOG2)), F.lit(senders)).alias("sender"), "sha")
    coded = rows.groupBy("sender").applyInPandas(_send(owners), "owner int, sender long, n int, k int, code binary")
    bitmaps = coded.groupBy("owner").applyInPandas(_answer, "sender long, owner int, bitmap binary")
    found = rows.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInPandas(_receive(owners), "sha binary")
    return found.distinct()


def dedup(docs: DataFrame, *, owners: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, keep_id, group_size, kept, text_sha256, one row per row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", text.alias("text"))
    rows = written(named.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "digests")
    found = written(suspects(rows.select("row", "sha"), owners), "suspects")
    small = found.count() <= broadcast_rows
    wanted = F.broadcast(found) if small else found
    texts = named.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("sha")).join(wanted, "sha", "left_semi")
    same = texts.groupBy("sha", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    clash = F.raise_error(F.lit("two texts have one SHA-256")).cast("long")
    groups = same.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.when(F.count(F.lit(1)) == 1, F.max("group_size")).otherwise(clash).alias("group_size"))
    groups = written(groups.filter("group_size > 1"), "groups")
    joined = rows.join(groups, "sha", "left")
    single = F.col("group_size").isNull()
    holders = rows.join(groups, "sha").filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.max("row").alias("row")).select("row", F.lit(True).alias("holds"))
    out = joined.join(holders, "row", "left")
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.coalesce("holds", F.lit(False))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
