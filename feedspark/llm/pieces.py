"""Operator 13: SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text starts with the word mark and every space becomes one. Its symbols (characters, at first) stand in a
linked list; an agenda holds each adjacent pair whose concatenation is a piece, best score first, ties to the
left. The best pair is merged and its new neighbours enter the agenda. In a short part the agenda is a list beside the symbols,
in which the best entry is looked up; in a longer one it is a heap, in which entries whose symbols have changed since are
passed over. Symbols that are no piece become byte pieces.

No piece holds a word mark behind another character (tested when the file is read), so no merge
crosses such a place: texts are cut there, and a part met before is not merged again. Each part that is new to
a task is checked against the sentencepiece library, one Arrow batch of texts at a time; a difference ends the
query with an error.

Defined results: a null text counts as empty; an empty text has no ids but the begin and end ids; every input
row gives one output row (repeated rows too, null ids included); other columns of the input are not read. Texts of any
length are encoded whole. Vocabularies of another kind, with a character map, with user-defined or unused
pieces, or that drop white space, are refused.
"""
from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, read, slices, texts
from .tokenizer_files import path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Parts remembered by one task before it starts afresh, and the longest that is remembered (bounds memory).
CACHE_PARTS, CACHE_CHARS = 600_000, 64
#: Bytes of text taken at once.
BYTES_AT_ONCE = 8 << 20
#: Most symbols of a part whose agenda is a list.
SHORT = 40
NEVER = float("inf")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = number(i)
        kind = key & 7
        if kind == 0:
            value, i = number(i)
        else:
            size, i = number(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i:i + size], i + size
        yield key >> 3, value


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, file: str):
        with open(file, "rb") as f:
            model = f.read()
        parts: dict[int, dict] = {k: dict(fields(v)) for k, v in fields(model) if k in (2, 3)}
        trainer, normaliser = parts.get(2, {}), parts.get(3, {})
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=file)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        # fields of the file: 3 kind of model (2: merges), 35 byte fallback, 24 white space as suffix; 2 character map, 3 mark before the text, 4 extra white space dropped, 5 marks for spaces
        plain = [i for i in range(n) if i not in self.control and i != self.unknown and not sp.is_byte(i)]
        user = any(dict(fields(v)).get(3, 1) == 4 for k, v in fields(model) if k == 1)
        if (trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or len(self.bytes) != 256 or normaliser.get(2) or not normaliser.get(3, 1)
                or normaliser.get(4, 1) or not normaliser.get(5, 1) or user or any(sp.is_unused(i) for i in range(n))
                or any(re.search(f"[^{MARK}]{MARK}", self.names[i]) for i in plain)):
            raise ValueError(f"{file}: not a plain merge-type vocabulary with byte fallback")
        self.ids = {self.names[i]: i for i in plain}
        #: rank by falling score: what a pair costs on the agenda
        self.cost = {self.names[i]: -sp.get_score(i) for i in plain}
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        surface = trainer.get(44, b" \xe2\x81\x87 ")
        self.surface = [b"" if i in self.control else surface if i == self.unknown else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(self.names)]
        self.table = pa.array(self.surface, pa.binary())
        self.is_control = np.array([i in self.control for i in range(n)])
        self.leading = np.array([p.startswith(MARK) and p in self.ids for p in self.names])
        codecs.register_error("one-by-one", lambda e: ("\ufffd", e.start + 1))
        outer = self

        class Known(dict):
            def __missing__(self, part: str) -> bytes:
                got = np.array(outer.merge(part), "<u4").tobytes()
                if len(part) <= CACHE_CHARS:
                    self[part] = got
                outer.fresh.append((part, got))
                return got

        self.known, self.fresh = Known(), []
        self.parts = re.compile(f"{MARK}+[^{MARK}]*")

    def merge(self, part: str) -> list[int]:
        """Ids of a text's part by the agenda."""
        if len(part) <= SHORT:
            symbols = self.merge_short(part)
        else:
            symbols = self.merge_long(part)
        out = []
        for s in symbols:
            one = self.ids.get(s)
            if one is not None:
                out.append(one)
            else:
                out.extend([self.bytes[b] for b in s.encode()])
        return out

    def merge_short(self, part: str) -> list[str]:
        get = self.cost.get
        symbols = list(part)
        agenda = [get(a + b, NEVER) for a, b in zip(symbols, part[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            pair = symbols[i] + symbols[i + 1]
            symbols[i:i + 2] = [pair]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(pair + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + pair, NEVER)
        return symbols

    def merge_long(self, part: str) -> list[str]:
        cost = self.cost
        symbols: list[str | None] = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, pair) for i in range(n - 1) if (c := cost.get(pair := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, pair = pop(agenda)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (c := cost.get(more := pair + symbols[k])) is not None:
                    push(agenda, (c, i, more))
            h = before[i]
            if h >= 0 and (c := cost.get(more := symbols[h] + pair)) is not None:
                push(agenda, (c, h, more))
        return [s for s in symbols if s is not None]

    def encode(self, text: str) -> bytes:
        """Ids, without begin and end, as little-endian 32-bit numbers."""
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, self.parts.findall(MARK + text.replace(" ", MARK))))

    def check(self) -> None:
        """Compare the parts merged since the last call with the library's ids."""
        fresh, self.fresh = [(p, g) for p, g in self.fresh if p != MARK], []
        want = self.library.encode([p[1:] for p, _ in fresh], num_threads=1)
        for (part, got), ids in zip(fresh, want):
            if np.array(ids, "<u4").tobytes() != got:
                raise ValueError(f"the library encodes {part[:100]!r} in another way")
        if len(self.known) > CACHE_PARTS:
            self.known.clear()

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts: pieces side by side, marks as spaces, without the mark before the text; bytes that are no UTF-8 become U+FFFD one by one."""
        offsets, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten()
        joined = pc.binary_join(lists(pa.array(offsets, pa.int32()), self.table.take(flat)), b"")
        number, control = flat.to_numpy(), np.append(self.is_control[flat.to_numpy()], True)
        other = np.append(np.flatnonzero(~control), len(flat))
        first = other[np.searchsorted(other, offsets[:-1])]
        count = np.append(0, np.cumsum(control[:-1]))
        lo, hi = offsets[:-1], offsets[1:]
        marked = (first < hi) & self.leading[np.append(number, 0)[np.minimum(first, len(flat))]]
        if (count[hi] - count[lo] <= 1 * control[lo] + control[np.maximum(lo, hi - 1)] * (hi > lo + 1)).all():
            try:
                text = joined.cast(pa.string())  # fails where bytes are no UTF-8
                return pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(text, 1), text)
            except pa.ArrowInvalid:
                pass
        out = []
        for lo, hi, at, raw in zip(offsets[:-1], offsets[1:], first, joined.to_pylist()):
            if count[hi] - count[lo] > control[lo] + control[max(lo, hi - 1)] * (hi > lo + 1):  # control ids between others part the bytes beside them
                runs = np.split(number[lo:hi], np.flatnonzero(control[lo:hi]))
                text = "".join(b"".join(self.surface[i] for i in run).decode("utf-8", "one-by-one") for run in runs)
            else:
                text = raw.decode("utf-8", "one-by-one")
            out.append(text[1:] if at < hi and self.leading[number[at]] else text)
        return pa.array(out, pa.string())


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id_col, n_tokens long, ids binary, decoded string) of every row, ids with begin and end, as little-endian unsigned 32-bit numbers: one scan, no shuffle."""
    file = model or path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(file)
        begin, end = np.array([pieces.begin], "<u4").tobytes(), np.array([pieces.end], "<u4").tobytes()
        for batch in (small for b in slices(batches) for small in by_bytes(b)):
            got = [begin + pieces.encode(t) + end for t in texts(batch.column(1))]
            pieces.check()
            size = np.array([len(b) // 4 for b in got], np.int64)
            decoded = pieces.decode(lists(np.concatenate([[0], np.cumsum(size)]), pa.array(np.frombuffer(b"".join(got), "<i4"))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(got, pa.binary()), decoded], names=[id_col, "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string")


def by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of the batch with texts of about BYTES_AT_ONCE at most (one text at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + BYTES_AT_ONCE, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def op13(spark, sf_dir: str) -> DataFrame:
    out = encode_decode(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
