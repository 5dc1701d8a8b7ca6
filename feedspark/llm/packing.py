"""Operator 10: cost-balanced packing of documents into fixed-length token sequences.

Each document becomes the ids of its whole text and an end mark. A task packs the documents of its
partition in bounded groups of about GROUP_TOKENS tokens, so that no group
grows with the data: a document's full lengths of CAPACITY tokens are sequences of their own; the
remainders go, in descending length, to the sequence of lowest estimated cost
(LINEAR * n + QUADRATIC * n * n for each piece of n tokens, as attention stays inside a document)
that still has room for them. A remainder that fits nowhere is cut over the gaps. The last tokens of
a group, fewer than CAPACITY, are its tail. The tails of all tasks meet in a second step, GROUP_TOKENS of them
in one task, and are packed alike; only what is left there, fewer than CAPACITY tokens of each such task, fills sequences
whose lengths are powers of two, which need no padding. So the number of short sequences does not depend on the number of partitions.

Sequence ids hold the step, the task's partition and a counter. The first step's pieces are written once; the second reads
that table.

Defined results: a null or empty text gives a document of the end mark alone; repeated rows and null
ids are packed like any other row; no rows give no sequences; other columns are not read.
"""
from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import read, slices, texts
from .tokenizer_files import path

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
CAPACITY, END_ID = 1024, 0
#: Estimated cost of a piece of n tokens: LINEAR * n for the layers, QUADRATIC * n * n for attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Tokens packed together by a task (4 bytes each).
GROUP_TOKENS = 1 << 21
#: Other characters than these go to the reference tokenizer itself (their class may differ between Unicode releases).
EXOTIC = regex.compile("[^\u0000-ɏ‐-‧€]")
#: Public splitting pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """Ids as the file TOKENIZER gives them; plain texts take the same vocabulary as ranks, which is faster."""

    def __init__(self, tokenizer: str, ranks: str):
        import tiktoken
        self.tokenizer = tokenizer
        with open(ranks, "rb") as f:
            table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    @functools.cached_property
    def library(self):
        """Read only by tasks that meet a text which needs it."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.tokenizer)

    def encode(self, text: str) -> np.ndarray:
        if "<|" in text or EXOTIC.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def plan(lengths: np.ndarray, capacity: int = CAPACITY, short: bool = True) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths (each at least 1); without ``short`` the
    last tokens, fewer than ``capacity``, are pieces of sequence -1."""
    out: list[tuple[int, int, int, int, int]] = []
    n_seq = 0
    full, rest = np.divmod(np.asarray(lengths, np.int64), capacity)
    for d in np.flatnonzero(full):
        for k in range(full[d]):
            out.append((int(d), k * capacity, capacity, n_seq, 0))
            n_seq += 1
    order = np.argsort(-rest, kind="stable")
    bins, tail = divmod(int(rest.sum()), capacity)
    room, cost = np.full(bins, capacity, np.int64), np.zeros(bins)
    left: list[tuple[int, int, int]] = []
    for d in order:
        n, start = int(rest[d]), int(full[d]) * capacity
        while n:
            fits = np.flatnonzero(room >= n)
            if len(fits):
                b = fits[np.argmin(cost[fits])]
            elif bins and room.max() > 0:
                b = int(np.argmax(room))
            else:
                left.append((int(d), start, n))
                break
            take = min(n, int(room[b]))
            out.append((int(d), start, take, n_seq + int(b), capacity - int(room[b])))
            room[b] -= take
            cost[b] += LINEAR * take + QUADRATIC * take * take
            n, start = n - take, start + take
    n_seq += bins
    if not short:
        return out + [(d, start, n, -1, 0) for d, start, n in left]
    sizes = [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
    used = 0
    for d, start, n in left:
        while n:
            take = min(n, sizes[0] - used)
            out.append((d, start, take, n_seq, used))
            n, start, used = n - take, start + take, used + take
            if used == sizes[0]:
                sizes.pop(0)
                n_seq, used = n_seq + 1, 0
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = True) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of every piece; ids are little-endian 32-bit numbers, or null
    without ``with_ids``."""
    files = tokenizer or path(TOKENIZER), ranks or path(RANKS)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    class Group:
        """Documents, or tails of documents, that are packed together."""

        def __init__(self, step: int, short: bool):
            self.base, self.short, self.used = (step << 60) + (TaskContext.get().partitionId() << 40), short, 0
            self.clear()

        def clear(self):
            self.keys, self.ids, self.starts, self.totals, self.held = [], [], [], [], 0

        def add(self, ids: np.ndarray, start: int, total: int):
            self.ids.append(ids)
            self.starts.append(start)
            self.totals.append(total)
            self.held += len(ids)

        def packed(self) -> Iterator[pa.RecordBatch]:
            if not self.ids:
                return
            pieces = np.array(plan(np.array([len(x) for x in self.ids]), short=self.short), np.int64)
            key, starts, totals = pa.concat_arrays(self.keys), np.array(self.starts, np.int64), np.array(self.totals, np.int64)
            cuts = [self.ids[d][s:s + n].tobytes() for d, s, n in pieces[:, :3]]
            for i in range(0, len(pieces), 4096):
                p, c = pieces[i:i + 4096], cuts[i:i + 4096]
                tail = p[:, 3] < 0
                yield pa.RecordBatch.from_arrays([
                    key.take(pa.array(p[:, 0])), pa.array(p[:, 1] + starts[p[:, 0]]), pa.array(p[:, 2]), pa.array([crc32(x) for x in c], pa.int64()),
                    pa.array(totals[p[:, 0]]), pa.array(self.base + self.used + p[:, 3], mask=tail), pa.array(p[:, 4], mask=tail),
                    pa.array([x if with_ids or t else None for x, t in zip(c, tail)], pa.binary())], names=names)
            self.used += int(pieces[:, 3].max()) + 1
            self.clear()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, group = ByteEncoder(*files), Group(0, False)
        for batch in slices(batches):
            group.keys.append(batch.column(0))
            for text in texts(batch.column(1)):
                ids = np.append(encoder.encode(text), np.uint32(END_ID)).astype("<u4")
                group.add(ids, 0, len(ids))
            if group.held >= GROUP_TOKENS:
                yield from group.packed()
        yield from group.packed()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Group(1, True)
        for batch in batches:
            group.keys.append(batch.column(0))
            for start, total, ids in zip(batch.column("start").to_pylist(), batch.column("doc_tokens").to_pylist(), batch.column("ids").to_pylist()):
                group.add(np.frombuffer(ids, "<u4"), start, total)
        yield from group.packed()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    pieces = cut_lineage(docs.select(id_col, text_col).mapInArrow(first, schema))
    tails = pieces.where("sequence_id IS NULL")
    n = tails.agg(F.sum("length")).first()[0] or 0
    return pieces.where("sequence_id IS NOT NULL").unionByName(tails.repartition(max(1, -(-n // GROUP_TOKENS))).mapInArrow(second, schema))


def op10(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), with_ids=False).drop("ids")
