"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of bytes that no vocabulary token holds inside can never be merged over, so between two such bytes a cut is
certain. The table of such pairs comes from the vocabulary. Texts are cut there, fragments are encoded apart, each distinct
fragment once per worker while its memo lasts, and the ids are put together again.

A cut must be certain for the split into pieces that comes before merging, too. Two kinds of forced pairs are:
* a character that is surely no white space (printable ASCII, Latin letters), then a blank or line feed: no piece goes on
  from the one to the other, and what follows does not change the piece before;
* two ASCII letters: whatever piece holds them goes on as a run of letters on both sides.
Others (a line feed before a letter, say) are not used: the pieces before them depend on what follows.
Special tokens' strings in a text are that token's id, as the library has it.

Edge cases: null and empty texts have no ids and decode to ""; texts of any length are encoded whole; the memo is emptied
when it holds `MEMO` fragments, which changes speed only; rows come back as they are, repeated ones too; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fragments a worker remembers, and the characters of the longest.
MEMO, MEMO_CHARS = 600_000, 64
LATIN = [chr(c) for c in range(0xC0, 0x250)]


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes bytes as characters: printable Latin-1 as itself, the rest from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = {}, 0x100
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


def inside_pairs(tokens: list[bytes]) -> np.ndarray:
    """Which byte pairs stand side by side inside a token."""
    found = np.zeros((256, 256), bool)
    for t in tokens:
        b = np.frombuffer(t, np.uint8)
        found[b[:-1], b[1:]] = True
    return found


class Codec(dict):
    """Encodes and decodes texts. As a dict it is the memo: fragment -> its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            named = json.load(f)
        alphabet = byte_alphabet()
        self.special = {x["content"]: x["id"] for x in named["added_tokens"]}
        vocab = {w: i for w, i in named["model"]["vocab"].items() if w not in self.special}
        as_bytes = {i: bytes(alphabet[c] for c in w) for w, i in vocab.items()}
        self.forced = ~inside_pairs(list(as_bytes.values()))
        self.table = [as_bytes.get(i, b"") for i in range(max([*as_bytes, *self.special.values()]) + 1)]
        for w, i in self.special.items():
            self.table[i] = w.encode()
        before = [c for c in [*map(chr, range(0x21, 0x7F)), *LATIN] if self.forced[c.encode()[-1], 0x20] and self.forced[c.encode()[-1], 0x0A]]
        firm = "".join(map(re.escape, before)) or "(?!)"
        #: A fragment runs up to the next blank or line feed that stands behind a firm character.
        self.fragments = re.compile(rf"[\s\S][^ \n]*(?:(?<![{firm}])[ \n][^ \n]*)*").findall if before else lambda text: [text]
        letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
        self.letter_cuts = {a + b for a in letters for b in letters if self.forced[ord(a), ord(b)]}
        self.openers = {x[0] for x in self.special}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]

    def __missing__(self, fragment: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        cuts = [i for i in range(1, len(fragment)) if fragment[i - 1 : i + 1] in self.letter_cuts]
        if cuts:
            ids = b"".join([self[fragment[a:b]] for a, b in zip([0, *cuts], [*cuts, len(fragment)], strict=True)])
        else:
            ids = np.array(self.library.encode(fragment, add_special_tokens=False).ids, "<u4").tobytes()
        if len(fragment) <= MEMO_CHARS:
            self[fragment] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not any(c in text for c in self.openers) or len(parts := self.specials(text)) == 1:
            return b"".join(map(self.__getitem__, self.fragments(text)))
        out = []
        for k, part in enumerate(parts):
            out.append(self.special[part].to_bytes(4, "little") if k % 2 else b"".join(map(self.__getitem__, self.fragments(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_HELD: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker process."""
    if path not in _HELD:
        _HELD[path] = Codec(path)
    return _HELD[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, ids (little-endian unsigned 32-bit integers in a binary), decoded, one row per row of docs. path: the tokenizer's file, present on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [c.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    out = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
