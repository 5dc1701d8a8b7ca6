"""Operator 11: prefix trie of conversations, rolled up by centroid decomposition.

A conversation is rebuilt from the first turns of its group's base conversation and its own later turns. Turns
are numbered by one global sort whose partitions each know how many rows of a conversation came before, so that a
conversation of any length spreads over many tasks. A trie node is a sequence of turns; it is known by the exclusive or
of 128-bit hashes of (depth, turn), which a prefix sum over the sorted turns gives for every prefix at once. Grouping
(conversation, depth, node) by node gives members and smallest member, so the parent edges need no recursion.

Totals of subtrees come from a centroid decomposition of the forest of parent edges. A component's centroid is
its deepest node with at least half of the component's weight below it (a node weighs its members, so its
subtree's weight is known from the same grouping). The total below the centroid, inside the component, is added to
every node on the path from the centroid up to the component's top; then the centroid goes and its children's
pieces and the rest are components of their own. A node and a descendant are parted exactly once, by a centroid between
them, so every node ends with its subtree's total after a number of rounds that grows with the logarithm of the
input, however deep the trie is. Components of weight above BLOCK are split by joins, all at once, one round
each; smaller ones are decomposed inside tasks, there by their numbers of nodes.

The hash of a node's ends is one SHA-256 over all their ids in order, so its bytes have to pass through one task:
ids sorted by (node, id) are joined to texts of CHUNK ids first, and that task holds one text at a time.

Defined results: rows without a conv_id are left out; null role and text are empty; turns that share a number stand in
the order of their digests (equal rows are alike, and all count); a conversation without turns belongs to the root alone; an
empty table has no nodes, not even a root. Other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_tables
from .common import read, whole_groups

#: Conversations of one group share its base's first turns: at most MOST_TURNS.
GROUP, HEADS = 100, 6
#: Weight above which a component is split by joins; rows of small components taken at once; ids in one text.
BLOCK, ROWS_AT_ONCE, CHUNK = 20_000, 20_000, 1024
NONE_SHA256 = hashlib.sha256(b"").hexdigest()
_ROW_BITS = 33  # monotonically_increasing_id(): partition << 33 | row


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, part, row, digest, points): turns in order; ``row`` counts inside ``part``, a range of all (conversation, turn)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.char_length(text).cast("long").alias("points")).where("conv IS NOT NULL")
    order = ["conv", "turn", "digest", "salt"]  # the salt lets equal rows part
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("salt", F.rand(11)).repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    # written once: another run of this exchange could cut the ranges elsewhere
    return cut_lineage(ranged.select("conv", F.shiftright(at, _ROW_BITS).cast("int").alias("part"), at.bitwiseAND((1 << _ROW_BITS) - 1).alias("row"), "digest", "points"))


def base_and_heads(conv: Column) -> tuple[Column, Column]:
    """(base conversation, number of its first turns that the conversation begins with)."""
    return conv - conv % GROUP, F.crc32(conv.cast("string")) % HEADS


def memberships(turns: DataFrame) -> DataFrame:
    """(conv, depth, h1, h2, q1, q2, points, length): each rebuilt conversation's node at every depth from 0, with the node's parent q."""
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base, heads = base_and_heads(F.col("conv"))
    spans = turns.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))
    spans = spans.select("conv", "part", "first_row", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                         F.sum("n").over(Window.partitionBy("conv")).alias("turns"), base.alias("base"), heads.alias("heads"))
    spans = cut_lineage(spans)
    place = F.col("row") - F.col("first_row") + F.col("before")
    # at most HEADS - 1 turns of a base conversation are ever taken from it
    first = (turns.where(F.col("conv") % GROUP == 0).join(spans.where(F.col("before") < HEADS - 1).select("conv", "part", "first_row", "before"), ["conv", "part"])
             .where(place < HEADS - 1).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "digest", "points"))).alias("opening")))
    spans = spans.join(first.withColumnRenamed("conv", "base"), "base", "left")
    taken = F.least(F.col("heads"), F.coalesce(F.size("opening"), F.lit(0))).cast("long")
    spans = spans.withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("turns") - F.col("heads")))
    own = (turns.join(spans.drop("opening"), ["conv", "part"]).where(place >= F.col("heads"))
           .select("conv", "part", (F.col("taken") + place - F.col("heads") + 1).alias("depth"), "digest", "points", "length"))
    opening = spans.where("before = 0").select("conv", "part", "length", F.inline(F.slice("opening", F.lit(1), F.col("taken").cast("int")))).select(
        "conv", "part", (F.col("place") + 1).alias("depth"), "digest", "points", "length")
    both = own.unionByName(opening).select("*", F.xxhash64("depth", "digest").alias("a1"), F.xxhash64(F.lit("second"), "digest", "depth").alias("a2"))
    so_far = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = cut_lineage(both.select("conv", "part", "depth", "points", "length", "a1", "a2", F.bit_xor("a1").over(so_far).alias("p1"), F.bit_xor("a2").over(so_far).alias("p2")))
    # conversations that lie in several parts: one for each border between parts at most
    torn = local.groupBy("conv", "part").agg(F.bit_xor("a1").alias("s1"), F.bit_xor("a2").alias("s2"), F.count(F.lit(1)).alias("n"))
    torn = torn.withColumns({"c1": F.bit_xor("s1").over(earlier), "c2": F.bit_xor("s2").over(earlier)}).where("c1 IS NOT NULL").select("conv", "part", "c1", "c2")
    h1, h2 = (F.col(f"p{i}").bitwiseXOR(F.coalesce(F.col(f"c{i}"), F.lit(0))) for i in (1, 2))
    nodes = local.join(torn, ["conv", "part"], "left").select(
        "conv", "depth", h1.alias("h1"), h2.alias("h2"), h1.bitwiseXOR(F.col("a1")).alias("q1"), h2.bitwiseXOR(F.col("a2")).alias("q2"), "points", "length")
    zero = F.lit(0).cast("long")
    root = spans.where("before = 0").select("conv", *[zero.alias(c) for c in ("depth", "h1", "h2", "q1", "q2", "points")], "length")
    out = cut_lineage(nodes.unionByName(root))
    drop_tables(local)
    return out


def parent_edges(paths: DataFrame) -> DataFrame:
    """The trie's nodes: (h1, h2, depth, conv_id, parent_conv_id, n_convs, n_children, last_points, weight, q1, q2)."""
    nodes = cut_lineage(paths.groupBy("h1", "h2", "depth").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("points").alias("last_points"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight")))
    below = nodes.where("depth > 0")
    children = below.groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    # the root's children, of which there may be many, need no join
    root = nodes.where("depth = 0")
    first = below.where("depth = 1").withColumn("parent_conv_id", root.select("conv_id").scalar())
    edges = below.where("depth > 1").join(parents, ["q1", "q2"], "left").unionByName(first).unionByName(root.withColumn("parent_conv_id", F.lit(None).cast("long")))
    return edges.join(children, ["h1", "h2"], "left").fillna(0, ["n_children"])


def decompose(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals of ``values`` (nodes by columns) in a forest (parent position, -1 at a top) by centroid decomposition."""
    n = len(parent)
    kids: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            kids[p].append(i)
    up = parent.tolist()
    gone = [False] * n
    size = [1] * n
    out = np.zeros_like(values)
    work = [i for i in range(n) if up[i] < 0]

    def piece(top: int) -> list[int]:
        found = [top]
        for i in found:
            found.extend(k for k in kids[i] if not gone[k])
        return found

    while work:
        top = work.pop()
        part = piece(top)
        if len(part) == 1:
            out[top] += values[top]
            continue
        for i in part:
            size[i] = 1
        for i in reversed(part[1:]):
            size[up[i]] += size[i]
        centroid, heavy = top, top
        while heavy is not None:
            centroid = heavy
            heavy = next((k for k in kids[centroid] if not gone[k] and 2 * size[k] >= len(part)), None)
        total = values[piece(centroid)].sum(axis=0)
        path = [centroid]
        while path[-1] != top:
            path.append(up[path[-1]])
        out[path] += total
        gone[centroid] = True
        work.extend(k for k in kids[centroid] if not gone[k])
        if centroid != top:
            work.append(top)
    return out


def _parents(table: pa.Table) -> np.ndarray:
    """Position of each row's parent among the rows of its component; -1 at the component's top."""
    at = {}
    columns = [table.column(c).to_numpy().tolist() for c in ("comp1", "comp2", "h1", "h2", "q1", "q2", "depth")]
    for i, (c1, c2, h1, h2, *_) in enumerate(zip(*columns)):
        at[c1, c2, h1, h2] = i
    return np.array([at.get((c1, c2, q1, q2), -1) if depth and (c1, c2) != (h1, h2) else -1 for c1, c2, h1, h2, q1, q2, depth in zip(*columns)], np.int64)


def rolled_up(forest: DataFrame, paths: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """``forest`` with the total of each of ``values`` (longs) over every node's subtree, by centroid decomposition.

    ``forest``: h1, h2, q1, q2, depth, conv_id, weight (members below and at the node), other columns; ``paths``: conv, depth, h1, h2, q1, q2.
    """
    names = forest.columns
    zero = F.lit(0).cast("long")
    state = cut_lineage(forest.withColumns({"comp1": zero, "comp2": zero, "done": F.lit(False)} | {f"sum_{v}": zero for v in values}))
    while True:
        comps = state.where("NOT done").groupBy("comp1", "comp2").agg(F.max("weight").alias("all"), F.count(F.lit(1)).alias("size")).where((F.col("all") > block) & (F.col("size") > 1))
        comps = cut_lineage(comps.drop("size"))
        if comps.isEmpty():
            drop_tables(comps)
            break
        node = F.struct("h1", "h2", "conv_id", "weight")
        centroids = (state.where("NOT done").join(comps, ["comp1", "comp2"]).where(2 * F.col("weight") >= F.col("all"))
                     .groupBy("comp1", "comp2").agg(F.max(F.struct("depth", node.alias("node"))).alias("c"))
                     .select("comp1", "comp2", F.col("c.depth").alias("c_depth"), F.col("c.node.h1").alias("c1"), F.col("c.node.h2").alias("c2"),
                             F.col("c.node.conv_id").alias("c_conv"), F.col("c.node.weight").alias("c_weight")))
        centroids = cut_lineage(centroids)
        inside = state.where("NOT done").join(centroids.drop("c_conv", "c_weight"), ["comp1", "comp2"])
        # the branch under the centroid that a conversation's nodes lie in: looked up once for each conversation and component
        asked = inside.where(F.col("depth") > F.col("c_depth")).select("conv_id", "comp1", "comp2", "c1", "c2", (F.col("c_depth") + 1).alias("b_depth")).distinct()
        steps = paths.select(F.col("conv").alias("conv_id"), F.col("depth").alias("b_depth"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("q1").alias("c1"), F.col("q2").alias("c2"))
        branch = asked.join(steps, ["conv_id", "b_depth", "c1", "c2"]).select("conv_id", "comp1", "comp2", "b_depth", "b1", "b2")
        marked = state.join(branch, ["conv_id", "comp1", "comp2"], "left").withColumn("below", ~F.col("done") & F.col("b_depth").isNotNull() & (F.col("depth") >= F.col("b_depth")))
        marked = cut_lineage(marked.join(centroids.select("comp1", "comp2", "c1", "c2"), ["comp1", "comp2"], "left")
                             .withColumn("is_c", F.coalesce(~F.col("done") & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), F.lit(False))))
        totals = marked.where("below OR is_c").groupBy("comp1", "comp2").agg(*[F.sum(v).alias(f"d_{v}") for v in values])
        # nodes from the centroid up to the component's top
        up = (paths.select(F.col("conv").alias("c_conv"), "depth", "h1", "h2").join(centroids, "c_conv").where(F.col("depth") <= F.col("c_depth"))
              .join(totals, ["comp1", "comp2"]).select("h1", "h2", "comp1", "comp2", "c_weight", *[f"d_{v}" for v in values]))
        after = marked.join(up, ["h1", "h2", "comp1", "comp2"], "left")
        on_path = F.col("c_weight").isNotNull() & ~F.col("done")
        after = after.withColumns({
            **{f"sum_{v}": F.col(f"sum_{v}") + F.when(on_path, F.col(f"d_{v}")).otherwise(0) for v in values},
            "weight": F.col("weight") - F.when(on_path & ~F.col("is_c"), F.col("c_weight")).otherwise(0),
            "comp1": F.when(F.col("below"), F.col("b1")).otherwise(F.col("comp1")), "comp2": F.when(F.col("below"), F.col("b2")).otherwise(F.col("comp2")),
            "done": F.col("done") | F.col("is_c")}).select(state.columns)
        old, state = state, cut_lineage(after)
        drop_tables(old, marked, comps, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("comp1", "comp2"), ROWS_AT_ONCE):
            own = np.stack([table.column(v).to_numpy() for v in values], axis=1)
            got = decompose(_parents(table), own) + np.stack([table.column(f"sum_{v}").to_numpy() for v in values], axis=1)
            for i, v in enumerate(values):
                table = table.set_column(table.column_names.index(f"sum_{v}"), f"sum_{v}", pa.array(np.ascontiguousarray(got[:, i])))
            yield from table.to_batches()

    rest = state.where("NOT done").drop("done")
    rest = rest.repartition("comp1", "comp2").sortWithinPartitions("comp1", "comp2", "depth").mapInArrow(run, rest.schema)
    return rest.unionByName(state.where("done").drop("done")).select(*names, *[f"sum_{v}" for v in values])


def ends_sha256(paths: DataFrame) -> DataFrame:
    """(h1, h2, ends_sha256, n_ends) of nodes at which conversations end."""

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, conv = (batch.column(i).to_numpy() for i in range(3))
            if not len(conv):
                continue
            new = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            cuts = [i for a, b in zip(new, [*new[1:], len(conv)]) for i in range(a, b, CHUNK)]
            ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(conv)])]
            yield pa.RecordBatch.from_arrays([pa.array(h1[cuts]), pa.array(h2[cuts]), pa.array(conv[cuts]), pa.array(np.diff([*cuts, len(conv)])), pa.array(ids)],
                                             names=["h1", "h2", "first", "n", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, n = None, None, 0
        for batch in batches:
            out = []
            for h1, h2, count, ids in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "n", "ids"))):
                if key != (h1, h2):
                    if key is not None:
                        out.append((*key, sha.hexdigest(), n))
                    key, sha, n = (h1, h2), hashlib.sha256(), 0
                elif n:
                    sha.update(b",")
                sha.update(ids.encode())
                n += count
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["h1", "h2", "ends_sha256", "n_ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, sha.hexdigest(), n)], names=["h1", "h2", "ends_sha256", "n_ends"])

    order = ["h1", "h2", "conv"]
    ends = paths.where("depth = length").select(*order)
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = ends.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(join_ids, "h1 long, h2 long, first long, n long, ids string")
    return texts.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "first").mapInArrow(digest, "h1 long, h2 long, ends_sha256 string, n_ends long")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_ends) of every node."""
    turns = numbered_turns(conversations, conv_col, turn_col, role_col, text_col)
    paths = memberships(turns)
    forest = parent_edges(paths).withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("last_points")})
    nodes = rolled_up(forest, paths, ["leaf", "saved"], block)
    return nodes.join(ends_sha256(paths), ["h1", "h2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_leaf").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NONE_SHA256)).alias("ends_sha256"), F.coalesce("n_ends", F.lit(0)).alias("n_ends"))


def op11(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations")).drop("n_ends")


OP11_SQL = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda p, q: xor(p >> 1, (p & 1) * 3988292384)))) AS v FROM ids),
hs AS (SELECT c, v % 6 AS h, c - c % 100 AS b FROM crc),
m AS (
  SELECT hs.c, 0 AS own, t.pos, t.g, t.x FROM hs JOIN t ON t.c = hs.b AND t.pos < hs.h
  UNION ALL SELECT hs.c, 1, t.pos, t.g, t.x FROM hs JOIN t ON t.c = hs.c AND t.pos >= hs.h),
s AS (SELECT c, g, x, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth FROM m),
k AS (SELECT c, depth, x, string_agg(g, '') OVER (PARTITION BY c ORDER BY depth) AS k FROM s UNION ALL SELECT c, 0, '', '' FROM ids),
p AS (SELECT c, depth, x, k, lag(k) OVER (PARTITION BY c ORDER BY depth) AS q, max(depth) OVER (PARTITION BY c) AS d FROM k),
n AS (
  SELECT k, min(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, min(q) AS q, min(length(x)) AS points,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = d), '')) AS ends_sha256
  FROM p GROUP BY k),
f AS (
  SELECT n.*, coalesce(ch.m, 0) AS n_children, par.conv_id AS parent_conv_id
  FROM n LEFT JOIN (SELECT q, count(*) AS m FROM n WHERE depth > 0 GROUP BY q) ch ON ch.q = n.k LEFT JOIN n par ON n.depth > 0 AND par.k = n.q),
u AS (
  SELECT p.k, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.points) AS saved_tokens
  FROM f JOIN p ON p.c = f.conv_id AND p.depth <= f.depth GROUP BY p.k)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs, f.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (k)
"""
