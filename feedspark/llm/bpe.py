"""Operator 3: BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never end up inside a token of any text, so
no merge crosses it: a word is cut at every such pair, the fragments are merged independently (by
the library's merge model, one fragment at a time) and their ids are concatenated. The normaliser and the splitting into words follow the tokenizer file
(NFC, white space to one space, lower case; contractions, letter runs, single digits, other runs).

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty
text; every input row gives one output row (repeated rows too, null ids included); other columns of
the input are not read. Texts of any length are encoded whole. Special tokens written in a text
become their id, as the library does it.
"""
from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from .common import lists, read, slices, texts
from .tokenizer_files import path

TOKENIZER = "word_bpe_49k.json"
#: Words remembered by one task before it starts afresh (bounds memory).
CACHE_WORDS = 250_000
#: Characters whose case, class and normal form no Unicode release disputes; others go to the library's own normaliser.
PLAIN = regex.compile("[^\u0000-ɏ‐-‧€]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in keep else next(rest)) for b in range(256)]


class SplitBpe:
    """Word encoder of one tokenizer file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        #: merge fragments: a word's last one carries the mark of a word's end, the others do not
        self.inner = models.BPE(vocab=vocab, merges=merges)
        self.last = models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=suffix)
        self.alphabet = byte_alphabet()
        #: byte pairs found inside some token; any other pair is a certain cut
        self.inside = {pair for t in vocab for x in [t.removesuffix(suffix)] for pair in zip(x, x[1:])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.strings = pa.array([strings.get(i) for i in range(max(strings) + 1)], pa.string())
        self.file = file
        self._library = None

    def fragments(self, word: str) -> list[str]:
        """``word`` in the byte alphabet, cut between bytes that no token holds side by side."""
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in self.inside]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])]

    def word(self, word: str) -> list[int]:
        """Ids of one word of normalised text: each fragment's, one after another."""
        if not (word.isascii() and word.isprintable()):
            word = "".join([self.alphabet[b] for b in word.encode("utf-8")])
        *inner, last = self.fragments(word)
        return [t.id for f in inner for t in self.inner.tokenize(f)] + [t.id for t in self.last.tokenize(last)]

    def library(self):
        if self._library is None:
            self._library = Tokenizer.from_file(self.file)
        return self._library


class WordBpe(SplitBpe):
    """Whole texts: special tokens, normaliser, words, ids; words seen before come from a bounded memory."""

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, file: str):
        super().__init__(file)
        outer = self

        class Ids(dict):
            def __missing__(self, word: str) -> bytes:
                self[word] = got = np.array(outer.word(word), "<i4").tobytes()
                return got

        self.ids = Ids()
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None

    def words(self, text: str) -> list[str]:
        if PLAIN.search(text):  # letters whose class or case may differ between Unicode releases
            lib = self.library()
            back = {c: b for b, c in enumerate(self.alphabet)}
            pieces = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
            return [bytes(back[c] for c in p).decode("utf-8") for p, _ in pieces]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self.WORDS.findall(text.lower())

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
        if self.marks is None or "<|" not in text:
            return b"".join(map(self.ids.__getitem__, self.words(text)))
        out = []
        for piece in self.marks.split(text):
            if piece in self.special:
                out.append(np.array([self.special[piece]], "<i4").tobytes())
            else:
                out.extend(map(self.ids.__getitem__, self.words(piece)))
        return b"".join(out)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each list of ids with a space between them, as this tokenizer has no decoder of its own."""
        return pc.binary_join(lists(ids.offsets, self.strings.take(ids.values)), " ")


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id_col, ids array<int>, decoded string) of every row: one scan, no shuffle."""
    file = tokenizer or path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(file)
        for batch in slices(batches):
            got = [bpe.encode(t) for t in texts(batch.column(1))]
            offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in got])])
            ids = lists(offsets, pa.array(np.frombuffer(b"".join(got), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, bpe.decode(ids)], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def op3(spark, sf_dir: str) -> DataFrame:
    out = encode_decode(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
