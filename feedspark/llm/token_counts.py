"""Operator 5: token counts of a unigram tokenizer by trie-shared dynamic programming.

Every whole text is split into pre-tokens by the tokenizer's public pattern. The vocabulary is the
public byte vocabulary given as ranks; the cost of rank r is the negative logarithm of
1 / (r + ZIPF_SHIFT), in millionths and rounded, so that sums are exact integers (ranks of a BPE
vocabulary are in order of falling frequency; Zipf's law turns them into probabilities). A pre-token
is segmented at the least total cost, then the fewest tokens.

Each task puts the distinct pre-tokens it meets into a trie whose nodes hold the forward score (least
cost, tokens used) of their prefix: a prefix shared by many pre-tokens is scored once. Terminal
counts are stored, and a document's count is the sum of its pre-tokens'. No shuffle takes place.

Defined results: null and empty texts have 0 pre-tokens and 0 tokens; one output row for every input
row (repeated rows and null ids included); other columns are not read.
"""
from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import read, slices, texts
from .tokenizer_files import path

VOCABULARY = "byte_bpe_50k.tiktoken"
ZIPF_SHIFT = 2.7
#: Bits of a score below its cost.
TOKENS_BITS = 40
#: Trie nodes held by a task before it starts a new trie (bounds memory).
MAX_NODES = 400_000
#: Public splitting pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_costs(file: str) -> dict[bytes, int]:
    """Cost of every token of a rank file."""
    out = {}
    with open(file, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                out[base64.b64decode(token)] = round(1e6 * math.log(int(rank) + ZIPF_SHIFT))
    return out


class ForwardTrie:
    """Pre-tokens in a trie; node i holds the best score of the prefix that ends there.

    A score is one integer: the cost above TOKENS_BITS bits that hold the number of tokens.
    """

    def __init__(self, costs: dict[bytes, int]):
        # vocabulary read backwards, so that all tokens that end at a place are found in one walk
        self.back: dict[int, int] = {}
        self.cost: list[int] = [-1]
        for token, c in costs.items():
            at = 0
            for b in reversed(token):
                key = at << 8 | b
                if (to := self.back.get(key)) is None:
                    to = self.back[key] = len(self.cost)
                    self.cost.append(-1)
                at = to
            self.cost[at] = (c << TOKENS_BITS) + 1
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.best: list[int] = [0]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """Number of tokens of ``word``; scores only the prefixes that no earlier word had."""
        data, child, best, back, cost = word.encode("utf-8"), self.child, self.best, self.back, self.cost
        at, along = 0, [0]
        for d, b in enumerate(data):
            key = at << 8 | b
            to = child.get(key)
            if to is None:
                node, top = 0, None
                for start in range(d, -1, -1):
                    node = back.get(node << 8 | data[start])
                    if node is None:
                        break
                    if (c := cost[node]) >= 0:
                        total = best[along[start]] + c
                        if top is None or total < top:
                            top = total
                if top is None:
                    raise ValueError(f"byte {b} is in no token of the vocabulary")
                to = child[key] = len(best)
                best.append(top)
            at = to
            along.append(at)
        self.terminal[word] = n = best[at] & ((1 << TOKENS_BITS) - 1)
        return n


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, n_pretokens long, n_tokens long) of every row."""
    file = vocabulary or path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, split = ForwardTrie(read_costs(file)), regex.compile(PATTERN)
        for batch in slices(batches):
            n_words, n_tokens = [], []
            for text in texts(batch.column(1)):
                if len(trie.best) > MAX_NODES:
                    trie.reset()
                words = split.findall(text)
                for w in set(words).difference(trie.terminal):
                    trie.insert(w)
                n_words.append(len(words))
                n_tokens.append(sum(map(trie.terminal.__getitem__, words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=[id_col, "n_pretokens", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_pretokens long, n_tokens long")


def op5(spark, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
