"""Results against brute force, the public libraries, held-out labels and exact round trips."""
import hashlib
import math
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from feedspark.llm import ann, bpe, language, near_dup, packing, quality, token_counts, top_k, vector_blocks
from feedspark.llm.queries import QUERIES
from feedspark.llm.tokenizer_files import path

SF001 = "/root/testdata/sf0.01"


def documents(spark, d):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


# --- quality (1) and language (9)

def test_quality_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    got = [r for r in QUERIES["op1_quality_classifier"](spark, SF001).collect()]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) > 0.93
    assert np.mean([p for p, y in held if y == 1]) > 0.97


def test_quality_reads_every_byte():
    rng = np.random.default_rng(1)
    net = quality.Network(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(size=quality.FILTERS).astype(np.float32),
                          rng.normal(size=2 * quality.FILTERS), 0.1)
    texts = [b"", b"a", bytes(rng.integers(1, 256, 249)), bytes(rng.integers(1, 256, 250)), bytes(rng.integers(1, 256, 5000))]
    for t, s in zip(texts, net.scores(texts)):  # one chunk at a time, in plain loops
        n = -(-(len(t) + quality.WIDTH) // quality.SEGMENT)
        data = (bytes(quality.WIDTH) + t).ljust(n * quality.SEGMENT + quality.WIDTH, b"\0")
        pooled = [np.max([sum(net.table[w, data[i + w]] for w in range(quality.WIDTH)) for i in range(g * quality.SEGMENT, (g + 1) * quality.SEGMENT, quality.STRIDE)], axis=0)
                  for g in range(n)]
        h = np.tanh(np.array(pooled) + net.bias)
        z = np.concatenate([h.max(axis=0), h.mean(axis=0)]) @ net.out + net.const
        assert math.isclose(s, 1 / (1 + math.exp(-z)), rel_tol=1e-3)
        assert net.scores([t])[0] == pytest.approx(s, rel=1e-6)  # whatever other texts are scored with it


def test_language_on_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = QUERIES["op9_language_id"](spark, SF001).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in got if r["held_out"]]) > 0.95
    assert sum(r["rejected"] for r in got) < 0.005 * len(got)


def test_language_of_texts_without_letters(spark, odd_dir):
    texts = defaultdict(set)
    for i, t in documents(spark, odd_dir):
        texts[i].add(any(c.isalpha() for c in t or ""))
    for r in QUERIES["op9_language_id"](spark, odd_dir).collect():
        if len(texts[r["doc_id"]]) == 1:
            assert (r["lang_pred"] == "und") == (texts[r["doc_id"]] == {False})


def test_gram_counts_by_hand():
    got = language.gram_counts(["", "ab", "Ab!"])
    assert got.sum(axis=1).tolist() == [2 + 1, 4 + 3 + 2, 5 + 4 + 3]
    assert got[1].max() >= 2


# --- tokenizers (3, 5, 10)

@pytest.mark.parametrize("folder", ["odd_dir", "sf"])
def test_encoding_equals_the_library(spark, request, folder):
    d = request.getfixturevalue(folder)
    tok = Tokenizer.from_file(path(bpe.TOKENIZER))
    want = []
    for i, t in documents(spark, d):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op3_bpe_forced_boundaries"](spark, d).collect()]
    assert sorted(got) == sorted(want)


def test_no_token_crosses_a_forced_cut():
    enc = bpe.WordBpe(path(bpe.TOKENIZER))
    assert enc.fragments("hello") == ["hello"]
    pieces = enc.fragments("aqxzjqk")
    assert "".join(pieces) == "aqxzjqk" and all((a[-1], b[0]) not in enc.inside for a, b in zip(pieces, pieces[1:]))


@pytest.mark.parametrize("folder", ["odd_dir", "sf"])
def test_token_counts_equal_a_plain_viterbi(spark, request, folder):
    d = request.getfixturevalue(folder)
    costs = token_counts.read_costs(path(token_counts.VOCABULARY))
    longest = max(map(len, costs))
    known = {}

    def plain(word: str) -> int:
        data = word.encode()
        best = [(0, 0)]
        for e in range(1, len(data) + 1):
            best.append(min((best[s][0] + costs[data[s:e]], best[s][1] + 1) for s in range(max(0, e - longest), e) if data[s:e] in costs))
        return best[-1][1]

    want = []
    for i, t in documents(spark, d):
        words = regex.findall(token_counts.PATTERN, t or "")
        for w in words:
            if w not in known:
                known[w] = plain(w)
        want.append((str(i), len(words), sum(known[w] for w in words)))
    got = [(str(r["doc_id"]), r["n_pretokens"], r["n_tokens"]) for r in QUERIES["op5_trie_token_counts"](spark, d).collect()]
    assert sorted(got) == sorted(want)


def check_packing(docs, pieces):
    tok = Tokenizer.from_file(path(packing.TOKENIZER))
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    sequences, tokens = defaultdict(list), 0
    for r in pieces:
        assert any(len(x) == r["doc_tokens"] and crc32(x[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        tokens += r["length"]
    assert tokens == sum(len(x) for g in ids.values() for x in g)
    for i, group in ids.items():  # each id in exactly one piece
        covered = sorted((r["start"], r["length"]) for r in pieces if r["doc_id"] == i)
        assert sum(n for _, n in covered) == sum(map(len, group))
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.01 * tokens


@pytest.mark.parametrize("folder", ["odd_dir", "sf"])
def test_packing(spark, request, folder):
    d = request.getfixturevalue(folder)
    check_packing(documents(spark, d), QUERIES["op10_cost_balanced_packing"](spark, d).collect())


def test_short_sequences_do_not_depend_on_partitions(spark, monkeypatch):
    texts = [f"document {i} " + "word " * (i * 37 % 260) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    short = set()
    for parts in (1, 4, 40):
        got = packing.pack(docs.repartition(parts)).collect()
        check_packing(list(enumerate(texts)), got)
        assert all(len(r["ids"]) == 4 * r["length"] and crc32(r["ids"]) == r["ids_crc32"] for r in got)
        size = defaultdict(int)
        for r in got:
            size[r["sequence_id"]] += r["length"]
        short.add(tuple(sorted(n for n in size.values() if n < 1024)))
    assert len(short) == 1 and len(short.pop()) <= 10


def by_steps(lengths, capacity):
    """Plain assignment: remainders by falling length to the cheapest sequence with room, else cut over the gaps, widest first."""
    out, n_seq = [], 0
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            out.append((d, k * capacity, capacity, n_seq, 0))
            n_seq += 1
    rest = [(n % capacity, d) for d, n in enumerate(lengths)]
    sequences = [[] for _ in range(sum(n for n, _ in rest) // capacity)]
    used = lambda s: sum(n for _, _, n in s)
    cost = lambda s: sum(packing.LINEAR * n + packing.QUADRATIC * n * n for _, _, n in s)
    for n, d in sorted(rest, key=lambda r: -r[0]):
        at = lengths[d] - n
        while n:
            room = [b for b, s in enumerate(sequences) if used(s) + n <= capacity]
            if room:
                b = min(room, key=lambda b: (cost(sequences[b]), b))
            elif any(used(s) < capacity for s in sequences):
                b = min(range(len(sequences)), key=lambda b: (used(sequences[b]), b))
            else:
                out.append((d, at, n, -1, 0))
                break
            take = min(n, capacity - used(sequences[b]))
            out.append((d, at, take, n_seq + b, used(sequences[b])))
            sequences[b].append((d, at, take))
            n, at = n - take, at + take
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_equals_a_plain_assignment(seed):
    lengths = np.random.default_rng(seed).integers(1, 60, 90).tolist()
    assert sorted(packing.plan(np.array(lengths), 32, short=False)) == sorted(by_steps(lengths, 32))


def test_packing_plan_balances_cost():
    lengths = np.random.default_rng(3).integers(1, 3000, 400)
    pieces = packing.plan(lengths)
    cost = defaultdict(float)
    for d, s, n, q, o in pieces:
        cost[q] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = max(cost.values())
    shared = [c for q, c in cost.items() if sum(1 for p in pieces if p[3] == q) > 1 and sum(p[2] for p in pieces if p[3] == q) == 1024]
    assert max(shared) <= full and np.std(shared) < 0.25 * np.mean(shared)


# --- vectors (2, 4)

def brute(spark, d, step, k, quantise):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and (quantise or any(v))]
    if quantise:
        rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = {}
    for q, w in rows:
        if q % step == 0:
            scores = out.setdefault(q, {})
            for i, v in rows:
                if i != q:
                    s = 0 if quantise else 0.0
                    for a, b in zip(w, v):
                        s += a * b
                    scores[i] = max(s, scores.get(i, -math.inf))
    return {q: sorted(((-s, i) for i, s in c.items()))[:k] for q, c in out.items()}


@pytest.mark.parametrize("folder", ["odd_dir", "sf", SF001])
def test_top_k_is_exact(spark, request, folder):
    d = folder if "/" in folder else request.getfixturevalue(folder)
    got = defaultdict(list)
    for r in sorted(QUERIES["op2_maxscore_top_k"](spark, d).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == brute(spark, d, 50, 5, True)


@pytest.mark.parametrize("folder", ["odd_dir", SF001])
def test_neighbours_found(spark, request, folder):
    d = folder if "/" in folder else request.getfixturevalue(folder)
    got = defaultdict(list)
    for r in sorted(QUERIES["op4_one_bit_neighbours"](spark, d).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    want = brute(spark, d, 20, 20, False)
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.9


def test_one_bit_bounds_hold():
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(2000, 48)), rng.normal(size=(20, 48))
    est, half = ann.estimate(q, ann.rotation(x.shape[1]), *ann.encode(x))
    assert np.mean(np.abs(est - q @ x.T) <= half) > 0.98


def test_large_components_stay_exact():
    q, x = np.array([[500000.0, -3.0]]), np.array([[500000.0, 1.0], [-500000.0, 1.0], [1e30, 0.0]])
    _, ids, scores = top_k.maxscore(2)(np.array([1, 2, 3]), x)(np.array([9]), q)
    assert ids.tolist() == [3, 1] and scores.tolist() == [128000000 * (1 << 27), 128000000**2 - 768 * 256]


def test_best_with_repeated_ids():
    s, i = np.array([5, 5, 5, 1, 4]), np.array([7, 7, 7, 2, 1])
    assert i[vector_blocks.best(s, i, 3)].tolist() == [7, 1, 2]


# --- near-duplicates (6) and the pipeline

def groups(docs, k, percent=80):
    sets = defaultdict(list)
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i].append(frozenset(tuple(w[a:a + min(k, len(w))]) for a in range(max(1, len(w) - k + 1))) if w else frozenset())
    ids = [(i, s) for i, g in sets.items() if i is not None for s in g if s]
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(ids):
        for j, t in ids[:a]:
            if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                n = len(s & t)
                if 100 * n >= percent * (len(s) + len(t) - n):
                    u, v = find(i), find(j)
                    root[max(u, v)] = min(u, v)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("folder", ["odd_dir", "sf"])
@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, request, folder, k):
    d = request.getfixturevalue(folder)
    docs = documents(spark, d)
    want = groups(docs, k)
    got = near_dup.near_duplicates(spark.read.parquet(f"{d}/documents.parquet"), k=k).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("small", [near_dup.SMALL, 6])
def test_links_at_the_threshold_and_deep_trees(spark, monkeypatch, small):
    """Pairs of similarity 0.8 exactly, a chain, and a group of near copies larger than a node and a block may be."""
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 16)
    rng = np.random.default_rng(5)
    docs, n = [], 0
    for _ in range(60):  # 36 of 45 shingles: 0.8 after the last words change
        words = [f"w{x}" for x in rng.integers(0, 5000, 41)]
        other = words[:-5] + [f"v{x}" for x in rng.integers(0, 5000, 5)]
        docs += [(n, " ".join(words)), (n + 1, " ".join(other))]
        n += 2
    base = [f"g{x}" for x in range(200)]
    for c in range(80):
        words = list(base)
        words[int(rng.integers(0, 200))] = f"c{c}"
        docs.append((n, " ".join(words)))
        n += 1
    chain = [f"z{x}" for x in range(150)]
    for c in range(12):
        docs.append((n, " ".join(chain[c * 5:c * 5 + 60])))
        n += 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = groups(docs, 2)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, k=2).collect()}
    assert got == want


def test_pipeline_against_its_parts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF001).write.parquet(str(tmp_path / name))
        out[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = out[name][1]
    before, after = out["quality"]
    good = {r["doc_id"] for r in QUERIES["op1_quality_classifier"](spark, SF001).collect() if r["predicted"]}
    assert {r["doc_id"] for r in after.collect()} == good
    before, after = out["language"]
    model = language.train(before, ~language.held_out())
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in language.identify(before, model).collect() if not r["rejected"]}
    before, after = out["near_duplicates"]
    root = groups([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert {r["doc_id"] for r in after.collect()} == {i for i, r in root.items() if i == r}
    before, after = out["packing"]
    check_packing([(r["doc_id"], r["text"]) for r in before.collect()], after.collect())
    assert corpus_pipeline.run(spark, SF001).count() == after.count()
