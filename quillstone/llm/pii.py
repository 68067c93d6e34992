"""Personal data by bootstrapped contextual extraction.

Base rules find emails, IPv4 addresses, payment cards and phone numbers exactly as their patterns say. Besides, tokens that look
like identifiers (at least `LEAST` characters, letters and digits) are instances with lexical patterns: the key word before "=" or ":",
the word before, the word after, and the token's make-up. Of the tokens that have a published form of access keys, one in `SEED_SHARE`,
chosen by hash, are the seed entities; the others are left for the patterns to find. In each round Spark scores patterns over the
pattern-instance graph by their known identifiers against base-kind instances, with unknown ones at `UNKNOWN_WEIGHT`, and tokens by
their patterns; tokens that confident patterns reach are known from then on, wherever they stand. The rounds end when none is new. Every
occurrence of a known token becomes a span of kind "secret"; so does every token of a published form. Base spans always stay; found
spans never overlap them.

Edge cases: null and empty texts have no spans; texts are read whole in linear time (no pattern can run twice over one
run of characters); repeated rows get equal results; ties do not arise, spans of a kind being disjoint; an empty table gives no
rows; other columns are ignored, whatever their names. The graph holds only identifier-like tokens; it is aggregated by
pattern with map-side combining, and nothing of it is collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import written

KINDS = ("email", "ip", "card", "phone", "secret")
#: Published forms of access keys (cloud key ids, 40 hexadecimal digits, prefixed keys of code and chat hosts).
FORMS = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|[0-9a-f]{40}|[0-9A-F]{40}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}")
SEED_SHARE = 8
ROUNDS, SUPPORT, CONFIDENCE, UNKNOWN_WEIGHT = 5, 3, 0.75, 0.02
#: Characters of an identifier at least, and of its context on either side (a longer key word or neighbour is no pattern).
LEAST, CONTEXT = 12, 64

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits can start a match only at its first digit, so later starts are ruled out; possessive runs never give back.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")
_REST = re.compile(r"[A-Za-z0-9_+/-]*")
_KEY = re.compile(r"([A-Za-z_]{2,48})[ \t]*[=:][ \t]*[\"']?$")
_BEFORE = re.compile(r"([^\W\d_]{2,48})[^\w]*$")
_AFTER = re.compile(r"[^\w]*([^\W\d_]{2,48})")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping: the run of local characters before each @, then a domain with a dot."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if at > free and text[at - 1] in _LOCAL and (m := _DOMAIN.match(text, at + 1)):
            begin = at - 1
            while begin > free and text[begin - 1] in _LOCAL:
                begin -= 1
            out.append((begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def make_up(token: str) -> str:
    """What a token is made of; distinguishes hexadecimal, capitals with their first letters, and others."""
    if all(c in "0123456789abcdef" for c in token):
        return "hex"
    if not any(c.islower() for c in token):
        return f"capitals {token[:4]}"
    return "mixed"


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple]:
    """Identifier-like tokens outside the base spans: start, end, token, whether it has a published form, patterns."""
    out, m = [], _DIGIT.search(text)
    while m:
        begin, floor = m.start(), m.start()
        while begin and text[begin - 1] in _PART:
            begin -= 1
        end = _REST.match(text, floor).end()
        token = text[begin:end]
        if len(token) >= LEAST and any(c.isalpha() for c in token) and not any(a < end and begin < b for a, b in taken):
            left = text[max(0, begin - CONTEXT) : begin]
            patterns = [f"form {make_up(token)}"]
            key = _KEY.search(left)
            if key:
                patterns.append(f"key {key[1].lower()}")
            if before := _BEFORE.search(left):
                patterns.append(f"before {before[1].lower()}")
            if after := _AFTER.match(text, end, end + CONTEXT):
                patterns.append(f"after {after[1].lower()}")
            out.append((begin, end, token, bool(FORMS.fullmatch(token)), patterns))
        m = _DIGIT.search(text, end)
    return out


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple]:
    """Base spans as instances of other kinds: what keeps common words from becoming confident patterns."""
    out = []
    for _, a, b in spans:
        patterns = []
        if key := _KEY.search(text[max(0, a - CONTEXT) : a]):
            patterns.append(f"key {key[1].lower()}")
        if before := _BEFORE.search(text[max(0, a - CONTEXT) : a]):
            patterns.append(f"before {before[1].lower()}")
        if after := _AFTER.match(text, b, b + CONTEXT):
            patterns.append(f"after {after[1].lower()}")
        out.append((a, b, text[a:b], patterns))
    return out


_INSTANCE = "start int, end int, token string, label string, patterns array<string>"
_FOUND = f"doc_id {{}}, base array<struct<kind string, start int, end int>>, instances array<struct<{_INSTANCE}>>"


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            text = text or ""
            base = base_spans(text)
            found = [(a, b, t, "form" if form else "unknown", p) for a, b, t, form, p in candidates(text, [(a, b) for _, a, b in base])] if _DIGIT.search(text) else []
            found += [(a, b, t, "other", p) for a, b, t, p in contexts(text, base)]
            rows.append(([{"kind": k, "start": a, "end": b} for k, a, b in base], [dict(zip(("start", "end", "token", "label", "patterns"), x, strict=True)) for x in found]))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "base": [r[0] for r in rows], "instances": [r[1] for r in rows]})


def seed(token, share: int = SEED_SHARE):
    return F.pmod(F.crc32(token.cast("binary")), F.lit(share)) == 0


def bootstrapped(edges: DataFrame, *, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """edges: token, label (known, unknown, other), pattern; one row per distinct edge. Returns the confident patterns (pattern, score) and the tokens they reach (token, belief)."""
    tally = lambda label, name: F.sum((F.col("label") == label).cast("int")).alias(name)
    for _ in range(rounds):
        stats = edges.groupBy("pattern").agg(tally("known", "pos"), tally("other", "neg"), tally("unknown", "open"))
        score = F.col("pos") / (F.col("pos") + F.col("neg") + F.lit(UNKNOWN_WEIGHT) * F.col("open"))
        patterns = written(stats.withColumn("score", score).filter((F.col("pos") >= support) & (F.col("score") >= confidence)).select("pattern", "score"), "patterns")
        reached = edges.filter(F.col("label") != "other").join(patterns, "pattern").groupBy("token").agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("belief"))
        reached = written(reached.filter(F.col("belief") >= confidence), "reached")
        fresh = edges.filter(F.col("label") == "unknown").join(reached.select("token"), "token", "left_semi")
        if not fresh.limit(1).count():
            break
        now = reached.select("token", F.lit(True).alias("_now"))
        label = F.when(F.col("_now") & (F.col("label") == "unknown"), "known").otherwise(F.col("label")).alias("label")
        edges = written(edges.join(now, "token", "left").select("token", label, "pattern"), "edges")
    return patterns, reached


def extract(docs: DataFrame, *, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, seed_share: int = SEED_SHARE) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, base and spans (arrays of kind, start, end in code points), n_seeds (spans of seeds) and n_induced (spans of other tokens that patterns found), one row per row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(docs.select("doc_id", "text").mapInPandas(_find, _FOUND.format(kind)).withColumn("row", F.monotonically_increasing_id()), "found")
    each = rows.select("row", F.explode("instances").alias("i")).select("row", "i.*")
    is_seed = (F.col("label") == "form") & seed(F.col("token"), seed_share)
    label = F.when(is_seed, "known").when(F.col("label") == "other", "other").otherwise("unknown")
    edges = written(each.select("token", label.alias("label"), F.explode("patterns").alias("pattern")).distinct(), "edges")
    _, reached = bootstrapped(edges, rounds=rounds, support=support, confidence=confidence)
    span = F.struct(F.lit("secret").alias("kind"), "start", "end")
    caught = each.filter(F.col("label") != "other").join(reached.select("token", F.lit(True).alias("_reached")), "token", "left").filter(F.col("_reached") | (F.col("label") == "form"))
    induced = F.sum((F.col("_reached") & ~is_seed).cast("int"))
    added = caught.groupBy("row").agg(F.collect_set(span).alias("added"), F.sum(is_seed.cast("int")).alias("seeds"), induced.alias("induced"))
    joined = rows.drop("instances").join(added, "row", "left")
    spans = F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))).alias("spans")
    return joined.select("doc_id", "base", spans, F.coalesce("seeds", F.lit(0)).cast("long").alias("n_seeds"), F.coalesce("induced", F.lit(0)).cast("long").alias("n_induced"))


def as_text(spans) -> object:
    """kind:start:end by kind as KINDS lists them, then start, comma-joined."""
    rank = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    return F.array_join(F.transform(F.array_sort(F.transform(spans, rank)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), "n_seeds", "n_induced")
