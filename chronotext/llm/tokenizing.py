"""Encoding of the whole corpus with a public tokenizer (problem 6)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.session import ship_package, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters whose class (letter, figure, white space) is the same for Python's `re` and for the tokenizer; texts with
#: any other are encoded whole.
PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0300-\u036f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
#: How the tokenizer cuts a text before merging, for texts in PLAIN: a fixed pattern of the public vocabulary.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from U+0100."""
    out, free = [""] * 256, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


class Codec:
    """A byte-level tokenizer with a bounded memory of pieces.

    Merges never cross pieces, so a piece is encoded once and remembered; the library encodes what is new, and any text
    outside PLAIN as a whole. No special tokens; their strings are ordinary text.
    """

    MOST = 200_000

    def __init__(self, path: str = TOKENIZER) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        made = json.loads(self.library.to_str())
        cut = made.get("pre_tokenizer") or {}
        #: Whether PIECES cuts as this tokenizer does; with any other one every text is encoded whole by the library.
        self.known = made.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        self.library.encode_special_tokens = True
        self.path = path
        self.memory: dict[str, list[int]] = {}
        self._bytes: list[bytes] | None = None

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty and a null text have none, an empty list."""
        out: list[list[int]] = []
        memory = self.memory
        known = memory.__getitem__
        for t in texts:
            if not t:
                out.append([])
            elif not self.known or not PLAIN.fullmatch(t):
                out.append(self.library.encode(t, add_special_tokens=False).ids)
            else:
                pieces = PIECES.findall(t)
                try:
                    ids = list(chain.from_iterable(map(known, pieces)))
                except KeyError:
                    self._learn(pieces)
                    ids = list(chain.from_iterable(map(known, pieces)))
                out.append(ids)
        return out

    def _learn(self, pieces: list[str]) -> None:
        if len(self.memory) > self.MOST:
            self.memory.clear()
        new = list({p for p in pieces if p not in self.memory})
        for p, e in zip(new, self.library.encode_batch(new, add_special_tokens=False)):
            self.memory[p] = e.ids

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id, by the table of byte letters; a special token stands for its own text."""
        if self._bytes is None:
            byte_of = {c: b for b, c in enumerate(byte_letters())}
            with open(self.path, encoding="utf-8") as f:
                model = json.load(f)
            words = {**model["model"]["vocab"], **{t["content"]: t["id"] for t in model.get("added_tokens", [])}}
            special = {t["content"] for t in model.get("added_tokens", [])}
            self._bytes = [b""] * (max(words.values()) + 1)
            for w, i in words.items():
                self._bytes[i] = w.encode() if w in special else bytes(byte_of[c] for c in w)
        return self._bytes

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no whole character (a cut sequence) become U+FFFD."""
        of = self.token_bytes()
        return b"".join(of[i] for i in ids).decode("utf-8", errors="replace")

    def offsets(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """First and last-plus-one character of each token; tokens that share a split character overlap on it."""
        of = self.token_bytes()
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1 if len(raw) else np.zeros(0, int)
        ends = np.cumsum([len(of[i]) for i in ids]) if ids else np.zeros(0, int)
        starts = np.r_[0, ends[:-1]] if ids else ends
        return [int(char[s]) for s in starts], [int(char[e - 1]) + 1 for e in ends]


def encoded(rows: DataFrame, id_: str, text: str, path: str = TOKENIZER, offsets: bool = False) -> DataFrame:
    """(id, ids[, starts, ends]) of every row, one to one; null and empty texts have empty lists. No shuffle."""

    ship_package(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = codec.encode(texts)
            columns = [b.column(0), lists(ids)]
            if offsets:
                both = [codec.offsets(t or "", x) for t, x in zip(texts, ids)]
                columns += [lists([x for x, _ in both]), lists([x for _, x in both])]
            yield pa.RecordBatch.from_arrays(columns, [id_, "ids", "starts", "ends"][: len(columns)])

    kind = rows.schema[id_].dataType.simpleString()
    return rows.select(id_, text).mapInArrow(run, f"`{id_}` {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets)


def lists(values: list[list[int]]) -> pa.Array:
    """Lists of int32 as an Arrow array, by way of one flat array."""
    sizes = np.fromiter(map(len, values), np.int32, len(values))
    flat = np.fromiter((x for v in values for x in v), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))


def decoded(rows: DataFrame, id_: str, ids: str, path: str = TOKENIZER) -> DataFrame:
    """(id, text) of lists of ids; a null list has a null text."""

    ship_package(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else codec.decode(x) for x in b.column(1).to_pylist()], pa.string())], [id_, "text"])

    return rows.select(id_, ids).mapInArrow(run, f"`{id_}` {rows.schema[id_].dataType.simpleString()}, text string")


def token_counts(rows: DataFrame, keep: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """keep columns and `tokens`, the number of ids of the text."""

    ship_package(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in batches:
            n = pa.array([len(x) for x in codec.encode(b.column(text).to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n], [*keep, "tokens"])

    few = rows.select(*keep, text)
    schema = ", ".join(f"`{c}` {few.schema[c].dataType.simpleString()}" for c in keep)
    return few.mapInArrow(run, f"{schema}, tokens long")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the length and hash of what its ids decode to (a null text counts as empty)."""
    documents = table(spark, sf_dir, "documents")
    back = decoded(encoded(documents, "doc_id", "text"), "doc_id", "ids")
    return back.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def p6_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, and the characters from the first to the last token (all of the text)."""
    both = encoded(table(spark, sf_dir, "documents"), "doc_id", "text", offsets=True)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.coalesce(F.array_max("ends"), F.lit(0)).cast("bigint").alias("n_covered"))


QUERIES = {"p6_ids": p6_ids, "p6_offsets": p6_offsets, "p6_roundtrip": p6_roundtrip}
ORACLES = {"p6_roundtrip": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents"}
