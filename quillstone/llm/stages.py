"""The operators as pipeline stages: each takes documents and returns those that stay, with the columns of documents.

Rows are told apart by their id, source and the SHA-256 of their text, so null or repeated ids do no harm; of rows alike in
all three the dedup stages keep one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import bpe, exact_dedup, jaccard_join, mixing, quality


def _sha(text="text"):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have in any letter case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _key(*columns):
    """One column, never null, that is equal where all of the columns are equal or null together."""
    parts = [x for c in columns for x in (c.isNull().cast("string"), F.coalesce(F.length(c.cast("string")).cast("string"), F.lit("")), F.coalesce(c.cast("string"), F.lit("")))]
    return F.unhex(F.sha2(F.concat_ws("|", *parts), 256))


def _met(docs: DataFrame, own: list, found: DataFrame, keys: list[str], carry: dict[str, str], once: bool) -> DataFrame:
    """Rows of docs whose own key columns equal a row of found, nulls being equal, with its columns to carry (name: new name); keys are not repeated in found."""
    name = _fresh(docs, "_key")
    renamed = found.select(_key(*map(F.col, keys)).alias(name), *[F.col(c).alias(n) for c, n in carry.items()])
    met = docs.withColumn(name, _key(*own)).join(renamed, name)
    return (met.dropDuplicates([name]) if once else met).drop(name)


def _as(docs: DataFrame, rows: DataFrame, made: dict | None = None) -> DataFrame:
    return rows.select(*[made[c].alias(c) if made and c in made else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents kept, without their boilerplate lines; n_chars, where there is one, follows the text."""
    lines, text = (_fresh(docs, x) for x in ("_lines", "_text"))
    judged = quality.judged(docs).filter("kept").select("doc_id", "source", F.lower(F.hex("text_sha")).alias("text_sha"), "boilerplate").dropDuplicates(["doc_id", "source", "text_sha"])
    kept = _met(docs, [F.col("doc_id"), F.col("source"), _sha()], judged, ["doc_id", "source", "text_sha"], {"boilerplate": lines}, False)
    kept = kept.withColumn(text, quality.cleaned(F.col("text"), F.col(lines)))
    length = F.when(F.col(lines).isNotNull() & F.col("n_chars").isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return _as(docs, kept, {"text": F.col(text), "n_chars": length})


def exact_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exact_dedup.dedup(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("sha")).distinct()
    return _as(docs, _met(docs, [F.col("doc_id"), _sha()], kept, ["doc_id", "sha"], {}, True))


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id stays (nulls last, then by text); texts without words stay each."""
    found = jaccard_join.join(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.lower(F.hex("text_sha")).alias("t")))
    grouped = found.filter(F.col("root").isNotNull()).groupBy("root").agg(least.alias("s")).select(F.col("s.i").alias("i"), F.col("s.t").alias("t"))
    alone = found.filter(F.col("root").isNull()).select(F.col("doc_id").alias("i"), F.lower(F.hex("text_sha")).alias("t"))
    return _as(docs, _met(docs, [F.col("doc_id").cast("long"), _sha()], grouped.unionByName(alone).distinct(), ["i", "t"], {}, True))


def source_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    times = _fresh(docs, "_times")
    sha = _fresh(docs, "_sha")
    rows = docs.select("doc_id", "source", "text", _sha().alias(sha))
    decided = mixing.mix(rows, carry=(sha,)).groupBy("doc_id", "source", sha).agg(F.sum("copies").cast("int").alias("n")).filter("n > 0")
    decided = decided.withColumn("times", F.sequence(F.lit(1), F.col("n")))
    met = _met(docs, [F.col("doc_id"), F.col("source"), _sha()], decided, ["doc_id", "source", sha], {"times": times}, True)
    return _as(docs, met.withColumn(times, F.explode(times)))


def bpe_round_trip(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded text, and their digests, one row per row."""
    out = bpe.encoded(docs, bpe.tokenizer_path())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
