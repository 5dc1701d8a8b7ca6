"""The trie against a plain recursive version; components split by joins and inside tasks alike."""
import hashlib
import zlib

import numpy as np
import pytest

from feedspark.llm import prefix_trie

from .conftest import odd_conversations

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), digest(r or "", x or ""), r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    trie = {(): set()}
    ends = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        whole = tuple(turns.get(base, [])[:h] + turns[c][h:])
        ends.setdefault(whole, []).append(c)
        for d in range(len(whole) + 1):
            trie.setdefault(whole[:d], set()).add(c)
    kids = {}
    for node in trie:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(trie, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + ((len(trie[node]) - 1) * len(node[-1][1]) if node else 0)
    if not turns:
        return []
    return sorted(str((min(trie[n]), len(n), min(trie[n[:-1]]) if n else None, len(trie[n]), len(kids.get(n, [])), leaves[n], saved[n],
                       hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())) for n in trie)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def result(df):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in df.collect())


@pytest.mark.parametrize("block", [20_000, 200])
def test_against_recursion(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in odd_conversations()]
    assert result(prefix_trie.prefix_trie(table(spark, rows), block=block)) == plain(rows)


def test_every_component_split_by_joins(spark):
    rows = [(c, t, "u", f"{t if t < c % 7 else c}") for c in range(14) for t in range(6)]
    assert result(prefix_trie.prefix_trie(table(spark, rows), block=1)) == plain(rows)


def test_other_partitionings_give_the_same(spark):
    rows = [(c, t, "u", f"{t if t < c % 5 else c}") for c in range(10) for t in range(40)]
    want = plain(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert result(prefix_trie.prefix_trie(table(spark, rows).repartition(3))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_decompose_random_forests():
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, 10, 100, 400]:
        for kind in range(4):
            parent = np.array([-1] + [[i - 1, 0, int(rng.integers(0, i)), -1 if rng.random() < 0.2 else int(rng.integers(max(0, i - 3), i))][kind] for i in range(1, n)])
            values = rng.integers(0, 9, (n, 2))
            want = values.copy()
            for i in range(n - 1, 0, -1):
                if parent[i] >= 0:
                    want[parent[i]] += want[i]
            assert (prefix_trie.decompose(parent, values) == want).all()
