"""Embedding near-duplicates by search in a robust-pruned flat graph.

Links are pairs of vectors with equal labels and cosine of at least a threshold.

1. Equal vectors of one label become one node with a count (combined before any
   shuffle), so exact copies never meet as pairs.
2. Nodes are put into overlapping shards: every label is cut by spherical k-means
   fitted on a bounded sample (``SAMPLE`` nodes a parent), a node enters the shards
   of its ``overlap`` nearest centroids, the nearest is its home; shards that are
   still larger than ``SHARD_MAX`` are cut again, up to ``LEVELS`` times. Members meet
   their shard's centroids in slices of about ``SLICE`` rows, so a hot label is many tasks. Centroids
   that would link with each other are merged, so a dense group is not torn apart;
   a parent with no more than ``overlap`` centroids left stays whole, as its nodes
   could only be parted without overlap.
3. In each shard every node gets candidate neighbours (the most similar ones and a
   few random ones), robustly pruned: a candidate goes if a kept one is closer to
   it, times ``ALPHA``, than the node itself is.
4. Adjacency lists of all shards, and their reverse edges, are united per node.
5. Each node is searched for in its home shard, with the shard's members and
   their neighbours from lists built elsewhere: a greedy beam search from the shard's
   medoid, then expansion of everything within range (and a little beyond). Two nodes in range
   of one query are at most twice the range's angle apart, so longer edges bring no
   neighbour from elsewhere.
   A shard that centroids cannot cut below ``SHARD_MAX`` (a dense group) is cut into
   blocks of about ``BLOCK`` shards by a hash; each block has a graph of its own, and every node is searched for in
   every block, one task a pair of blocks. Memory of a task is bounded, nothing is
   lost, and only counts leave these tasks; their work grows with the square of the
   group, as its links do.
6. Every pair found is verified by its cosine in double precision. A pair within
   one home is counted there; only pairs across homes are shuffled. Components are
   first joined inside each shard, so dense groups give one row per node.
7. ``recall`` compares a sample of nodes with all nodes by brute force: links between
   different nodes only, averaged over nodes that have one, over all and in every label
   that the sample meets often enough. Below ``RECALL_GOAL`` the search is repeated with
   more overlap and a wider beam; labels that are still short after the last repeat are
   compared exactly, block by block (``compare_all``).

Cases: null, empty, zero or non-finite vectors and null labels link with nothing
and stand alone; vectors of different lengths do not link; vec_id may repeat or
be null (rows are told apart by label and vector; the component's name is the
least vec_id of its rows); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import ship
from souk.llm.components import components
from souk.sources.staging import drop_staged, stage

THRESHOLD = 0.93
SHARD = 300                  # nodes a shard is cut for (before overlap)
SHARD_MAX = 2_400           # larger shards are cut again
BLOCK = 5                    # blocks of groups that cannot be cut: so many times SHARD
SLICE = 1_000                # members of one shard that meet its centroids in one group
FANOUT = 64                  # centroids of one cut, at most
LEVELS = 6
SAMPLE = 4_000               # nodes that k-means of one parent sees, in expectation
OVERLAP = 2
DEGREE, NEAREST, RANDOM, ALPHA = 24, 48, 12, 1.2
BEAM = 40
SLACK = 0.06                 # nodes this far below the threshold are still expanded
AUDIT = 200                  # nodes of the recall audit's first draw
AUDIT_LINKED = 100           # nodes with a true link that it wants to see; it draws more until then
AUDIT_MOST = 6_400           # nodes drawn, at most
AUDIT_PART = 20              # nodes with a true link from which on a label is judged alone
RECALL_GOAL = 0.95


# -- inside a task ---------------------------------------------------------------

def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means: unit centroids."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], c)
    return c


def apart(centres: np.ndarray, threshold: float) -> np.ndarray:
    """Centroids without those that are as close as a link to an earlier one."""
    kept: list[int] = []
    for k in range(len(centres)):
        if not kept or (centres[kept] @ centres[k]).max() < threshold:
            kept.append(k)
    return centres[kept]


def robust_prune(x: np.ndarray, p: int, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Kept neighbours of node ``p``: nearest first, dropping what a kept one covers."""
    near = x[candidates]
    far = 1.0 - near @ x[p]
    order = np.argsort(far, kind="stable")
    candidates, near, far = candidates[order], near[order], far[order]
    among = 1.0 - near @ near.T
    alive = candidates != p
    kept = []
    while len(kept) < degree:
        first = int(alive.argmax())
        if not alive[first]:
            break
        kept.append(candidates[first])
        alive &= alpha * among[first] > far
        alive[first] = False
    return np.array(kept, np.int64)


def build(x: np.ndarray, seed: int = 11) -> list[np.ndarray]:
    """Pruned adjacency lists of one shard."""
    n = len(x)
    rng = np.random.default_rng(seed)
    out = []
    take = min(NEAREST + 1, n)
    for a in range(0, n, 1024):                                  # bounded memory: 1024 rows of similarities
        sims = x[a:a + 1024] @ x.T
        near = np.argpartition(-sims, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(sims), 1))
        for k in range(len(sims)):
            out.append(robust_prune(x, a + k, np.unique(np.concatenate([near[k], rng.integers(0, n, min(RANDOM, n))]))))
    return out


def range_search(x: np.ndarray, adjacent: list[np.ndarray], query: np.ndarray, start: int, stamp: np.ndarray, mark: int,
                 threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with similarity of at least ``threshold - SLACK`` that the search reaches, and
    their similarities: greedy beam search, then expansion within the range."""
    ids, sims = np.array([start]), x[[start]] @ query
    done = np.zeros(1, bool)
    stamp[start] = mark
    wide_ids, wide_sims = [ids], [sims]

    def fresh(nodes: np.ndarray) -> np.ndarray:
        new = np.concatenate([adjacent[v] for v in nodes])
        new = np.unique(new[stamp[new] != mark])
        stamp[new] = mark
        return new

    while not done.all():
        top = np.nonzero(~done)[0][:4]
        done[top] = True
        new = fresh(ids[top])
        if len(new):
            s = x[new] @ query
            wide_ids.append(new)
            wide_sims.append(s)
            ids, sims = np.concatenate([ids, new]), np.concatenate([sims, s])
            done = np.concatenate([done, np.zeros(len(new), bool)])
            order = np.argsort(-sims, kind="stable")[:beam]
            ids, sims, done = ids[order], sims[order], done[order]
    ids, sims = np.concatenate(wide_ids), np.concatenate(wide_sims)
    keep = sims >= threshold - SLACK
    ids, sims = ids[keep], sims[keep]
    found_ids, found_sims, edge = [ids], [sims], ids
    while len(edge):
        new = fresh(edge)
        s = x[new] @ query
        keep = s >= threshold - SLACK
        edge = new[keep]
        found_ids.append(edge)
        found_sims.append(s[keep])
    return np.concatenate(found_ids), np.concatenate(found_sims)


FOUND = "kind string, a bigint, b bigint, n bigint, m bigint"
FAR, OWN, ELSEWHERE = 0, 1, 2    # how a link to a row is reported: as a pair, as a count, by another task


def _search_shard(pdf: pd.DataFrame, threshold: float, beam: int) -> pd.DataFrame:
    """Rows (kind, a, b, n, m): 'n' node a with n linked vectors (m different ones) among the
    task's own ones, 'r' node a joined with node b here, 'x' verified pair a < b across homes."""
    pdf = pdf.sort_values(["node", "member"], kind="stable").reset_index(drop=True)
    node, asks, member = pdf["node"].to_numpy(), pdf["asks"].to_numpy(bool), pdf["member"].to_numpy(bool)
    count, state, x = pdf["copies"].to_numpy(), pdf["state"].to_numpy(), unit(pdf["vector"])
    place = {v: k for k, v in enumerate(node)}
    adjacent = [np.array([place[v] for v in (a if a is not None else ()) if v in place], np.int64) for a in pdf["adjacent"]]
    inside = np.nonzero(member)[0]
    if not len(inside):
        return pd.DataFrame([], columns=["kind", "a", "b", "n", "m"])
    middle = x[inside].mean(axis=0)
    start = int(inside[(x[inside] @ middle).argmax()])
    stamp = np.zeros(len(node), np.int64)
    root = np.arange(len(node))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    queries, own = np.nonzero(asks)[0], np.nonzero(state == OWN)[0]
    at_own = np.full(len(node), -1, np.int64)
    at_own[own] = np.arange(len(own))
    same = np.zeros((len(queries), len(own)), bool)           # links to the task's own nodes
    across = []
    for mark, q in enumerate(queries, 1):
        ids, sims = range_search(x, adjacent, x[q], start, stamp, mark, threshold, beam)
        ids = ids[(sims >= threshold) & (ids != q)]
        for k in ids.tolist():
            a, b = find(int(q)), find(k)
            if a != b:
                root[max(a, b)] = min(a, b)
        same[mark - 1, at_own[ids[state[ids] == OWN]]] = True
        across += [(int(q), k) for k in ids[state[ids] == FAR].tolist()]
    both_ways = np.array_equal(queries, own)                  # else the other direction is another task
    weight = count[own].astype(np.float64)
    linked, others = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    for a in range(0, len(queries), 1024):
        part = same[a:a + 1024] | same[:, a:a + 1024].T if both_ways else same[a:a + 1024]
        linked[a:a + 1024] = (part @ weight).astype(np.int64)
        others[a:a + 1024] = part.sum(axis=1)
    rows = [("n", int(node[q]), int(node[q]), int(n), int(m)) for q, n, m in zip(queries, linked, others)]
    rows += [("r", int(node[k]), int(node[find(k)]), 0, 0) for k in range(len(node)) if root[k] != k]
    rows += [("x", int(min(node[a], node[b])), int(max(node[a], node[b])), 0, 0) for a, b in across]
    return pd.DataFrame(rows, columns=["kind", "a", "b", "n", "m"])


def _compare_blocks(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Rows like those of :func:`_search_shard` from all cosines of a pair of blocks (or of a
    block with itself)."""
    pdf = pdf.sort_values(["second", "node"], kind="stable")
    node, count, x = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), unit(pdf["vector"])
    edge = int((~pdf["second"].to_numpy(bool)).sum())
    alone = edge == len(node)
    right = slice(0, edge) if alone else slice(edge, len(node))
    linked, others, root = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.arange(len(node))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(0, edge, 256):
        b = min(a + 256, edge)
        hit = x[a:b] @ x[right].T >= threshold
        if alone:
            hit[np.arange(b - a), np.arange(a, b)] = False
        linked[a:b] += hit @ count[right]
        others[a:b] += hit.sum(axis=1)
        if not alone:
            linked[right] += count[a:b] @ hit
            others[right] += hit.sum(axis=0)
        for k in range(a, b):
            for j in (np.nonzero(hit[k - a])[0] + right.start).tolist():
                p, q = find(k), find(j)
                if p != q:
                    root[max(p, q)] = min(p, q)
    rows = [("n", int(v), int(v), int(n), int(m)) for v, n, m in zip(node, linked, others) if m]
    rows += [("r", int(node[k]), int(node[find(k)]), 0, 0) for k in range(len(node)) if root[k] != k]
    return pd.DataFrame(rows, columns=["kind", "a", "b", "n", "m"])


def reach(threshold: float) -> float:
    """The least cosine of two nodes that can both be in range (``SLACK`` included) of one query."""
    return float(np.cos(min(np.pi, 2 * np.arccos(np.clip(threshold - SLACK, -1, 1))))) - 1e-9


# -- Spark -----------------------------------------------------------------------

def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, label, dims, vector, copies, name): distinct usable vectors."""
    fine = ((F.size("embedding") > 0) & F.col("label").isNotNull()
            & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
            & F.exists("embedding", lambda v: v != 0))
    usable = rows.filter(F.coalesce(fine, F.lit(False)))
    return (usable.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("name"))
            .select(F.xxhash64("label", "embedding").alias("node"), F.concat_ws("/", "label", F.size("embedding")).alias("shard"),
                    F.col("embedding").alias("vector"), "copies", "name"))


def _cut(members: DataFrame, overlap: int, level: int, threshold: float) -> tuple[DataFrame, bool]:
    """Members of shards that are too large, put into the shards of their ``overlap``
    nearest centroids (left whole where no more than these stand apart: every node would
    enter every shard, or the shards would share no node). Members are read once, in slices
    of a shard that meet a copy of its centroids."""
    limit = SHARD if level == 0 else SHARD_MAX
    sizes = stage(members.groupBy("shard").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("home").cast("int")).alias("homes")),
                  "graph-sizes")
    large = sizes.filter(F.col("size") > limit)
    if large.isEmpty():
        return members, False
    drawn = (members.filter("home").join(large, "shard")
             .filter(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1_000_000)) < 1_000_000 * F.least(F.lit(1.0), SAMPLE / F.col("homes"))))

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        size = int(pdf["size"].iloc[0])
        k = int(min(FANOUT, max(2 * overlap, -(-size // SHARD))))
        c = apart(kmeans(unit(pdf["vector"]), k), threshold)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "slices": [-(-size // SLICE)], "centres": [c.reshape(-1).tolist()], "k": [len(c)]})

    table = stage(drawn.select("shard", "size", "node", "vector").groupBy("shard")
                  .applyInPandas(centres, "shard string, slices int, centres array<double>, k int").filter(F.col("k") > overlap),
                  "graph-centres")
    if table.isEmpty():
        return members, False
    columns = members.columns

    def assign(key: tuple, part: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return part[columns]
        c = np.array(centre["centres"].iloc[0]).reshape(int(centre["k"].iloc[0]), -1)
        near = np.argsort(-(unit(part["vector"]) @ c.T), axis=1, kind="stable")[:, :overlap]
        rows = []
        for j in range(near.shape[1]):
            p = part[columns].copy()
            p["shard"] = [f"{key[0]}.{v}" for v in near[:, j]]
            p["home"] = part["home"] & (j == 0)
            rows.append(p)
        return pd.concat(rows)

    whole = members.join(table.select("shard"), "shard", "left_anti").select(*columns)
    sliced = members.join(table.select("shard", "slices"), "shard").withColumn(
        "slice", F.pmod(F.xxhash64("node", F.lit(23)), F.col("slices")).cast("int"))
    copies = table.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cut = (sliced.select("slice", *columns).groupBy("shard", "slice")
           .cogroup(copies.select("shard", "slice", "centres", "k").groupBy("shard", "slice")).applyInPandas(assign, members.schema))
    if level:                                    # a node may reach a shard through two of its parents
        cut = cut.groupBy("shard", "node").agg(F.max("home").alias("home"), F.first("vector").alias("vector"),
                                               F.first("copies").alias("copies")).select(*columns)
    return stage(whole.unionAll(cut), "graph-members"), True


def link_vectors(rows: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, beam: int = BEAM) -> tuple[DataFrame, DataFrame]:
    """(nodes, classes): distinct vectors, and node, n_links, n_others (linked nodes), root for each."""
    spark = rows.sparkSession
    ship(spark)
    nodes = stage(nodes_of(rows), "graph-nodes")
    members = nodes.select("shard", "node", F.lit(True).alias("home"), "vector", "copies")
    for level in range(LEVELS):
        members, more = _cut(members, overlap, level, threshold)
        if not more:
            break
    members = members.withColumn("base", F.col("shard"))
    sizes = stage(members.groupBy("base").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > SHARD_MAX), "graph-dense")
    dense = not sizes.isEmpty()
    if dense:
        members = members.join(sizes, "base", "left").withColumn(
            "blocks", F.ceil(F.col("size") / (BLOCK * SHARD)).cast("int")).withColumn(
            "block", F.pmod(F.xxhash64("node", F.lit(17)), F.col("blocks")).cast("int")).withColumn(
            "shard", F.concat_ws("#", "base", "block")).drop("size")
        members = stage(members, "graph-blocks")

    def adjacency(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node, x = pdf["node"].to_numpy(), unit(pdf["vector"])
        lists = build(x)
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "node": node, "adjacent": [node[a] for a in lists],
                             "near": [x[a] @ x[k] >= reach(threshold) for k, a in enumerate(lists)]})

    lists = members.groupBy("shard").applyInPandas(adjacency, "shard string, node bigint, adjacent array<bigint>, near array<boolean>")
    edges = stage(lists.select("shard", "node", F.explode(F.arrays_zip("adjacent", "near")).alias("e"))
                  .select(F.col("shard").alias("built"), "node", F.col("e.adjacent").alias("other"), F.col("e.near").alias("near")),
                  "graph-edges")
    both = edges.unionAll(edges.select("built", F.col("other").alias("node"), F.col("node").alias("other"), "near"))
    # In- and out-neighbours of a node lie in its own shards: bounded by their size.
    united = stage(both.groupBy("node").agg(F.collect_set("other").alias("adjacent")), "graph-united")
    place = members.select("shard", "base", "node")
    # Neighbours from lists built in other shards only: those built here are members.
    halo = (place.join(both.filter("near").select("built", "node", "other"), "node").filter("built != shard")
            .select("shard", "base", F.col("other").alias("node")).distinct()
            .join(members.select("shard", "node"), ["shard", "node"], "left_anti")
            .join(nodes.select("node", "vector", "copies"), "node"))
    # A neighbour whose home is another block of the same shard is counted by the pair of blocks.
    state = F.lit(FAR)
    if dense:
        halo = halo.join(members.filter("home and blocks is not null").select("node", "base", F.lit(ELSEWHERE).alias("at_home")),
                         ["node", "base"], "left")
        state = F.coalesce("at_home", F.lit(FAR))
    cols = ["shard", "node", "vector", "copies", "member", "asks", "state"]
    inside = F.when(F.col("home"), F.lit(OWN)).otherwise(F.lit(FAR)).alias("state")
    no, yes = F.lit(False), F.lit(True)
    block = (members.select("shard", "node", "vector", "copies", yes.alias("member"), F.col("home").alias("asks"), inside)
             .unionAll(halo.select("shard", "node", "vector", "copies", no.alias("member"), no.alias("asks"), state.alias("state"))))
    if dense:
        # Every ordered pair of blocks: the nodes at home in one are searched for in the other.
        parts = members.filter("blocks is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        parts = parts.filter("other != block")
        task = lambda asking, asked: F.concat_ws("#", "base", asked, asking).alias("shard")
        block = (block.unionAll(parts.select(task("other", "block"), "node", "vector", "copies", yes, no, inside))
                 .unionAll(parts.filter("home").select(task("block", "other"), "node", "vector", "copies", no, yes, F.lit(ELSEWHERE))))
    block = block.select(*cols).join(united, "node", "left")
    found = stage(block.groupBy("shard").applyInPandas(
        lambda pdf: _search_shard(pdf, threshold, beam), FOUND), "graph-found")
    classes = _classes(nodes, found)
    drop_staged(edges, united, found)
    return nodes, classes


def compare_all(nodes: DataFrame, threshold: float) -> DataFrame:
    """Classes of ``nodes`` from the cosines of all pairs of equal label: hash blocks of about
    BLOCK x SHARD nodes, one task a pair of blocks, so a task's memory is bounded and only counts leave
    it. Work grows with the square of a label."""
    sizes = nodes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (BLOCK * SHARD)).cast("int").alias("blocks"))
    placed = nodes.select("shard", "node", "vector", "copies").join(sizes, "shard").withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit(17)), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = placed.select(F.concat_ws("#", "shard", F.least("block", "other"), F.greatest("block", "other")).alias("pair"),
                         "node", "vector", "copies", (F.col("block") > F.col("other")).alias("second"))
    found = stage(pair.groupBy("pair").applyInPandas(lambda pdf: _compare_blocks(pdf, threshold), FOUND), "graph-compared")
    classes = _classes(nodes, found)
    drop_staged(found)
    return classes


def _classes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """node, name, n_links, n_others, root from the rows of the searches."""
    pairs = found.filter("kind = 'x'").select("a", "b").distinct()
    copies = nodes.select("node", "copies")
    far = (pairs.join(copies, pairs["b"] == copies["node"]).select(F.col("a").alias("node"), "copies")
           .unionAll(pairs.join(copies, pairs["a"] == copies["node"]).select(F.col("b").alias("node"), "copies"))
           .groupBy("node").agg(F.sum("copies").alias("far"), F.count(F.lit(1)).alias("far_nodes")))
    near = found.filter("kind = 'n'").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("near"), F.sum("m").alias("near_nodes"))
    joined = components(found.filter("kind = 'r'").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = (nodes.select("node", "copies", "name").join(near, "node", "left").join(far, "node", "left").join(joined, "node", "left")
             .select("node", "name", (F.coalesce("near", F.lit(0)) + F.coalesce("far", F.lit(0)) + F.col("copies") - 1)
                     .cast("bigint").alias("n_links"),
                     (F.coalesce("near_nodes", F.lit(0)) + F.coalesce("far_nodes", F.lit(0))).cast("bigint").alias("n_others"),
                     F.coalesce("component", "node").alias("root")))
    return stage(named, "graph-classes")


def recall(nodes: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, sample: int = AUDIT) -> tuple[float, list[str]]:
    """The found share of the true links of a node with other nodes (copies count for
    nothing), averaged over drawn nodes that have one, and the labels found short: those below
    RECALL_GOAL, judged alone where AUDIT_PART such nodes were seen, else if the average is
    below it. ``sample`` nodes are drawn, then more until AUDIT_LINKED with a link are seen, all
    nodes are drawn or AUDIT_MOST are."""
    total, drawn, seen = nodes.count(), 0, {}
    place = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    while drawn < min(total, AUDIT_MOST) and sum(len(v) for v in seen.values()) < AUDIT_LINKED:
        more = max(sample, 3 * drawn)
        few = nodes.filter((place >= drawn / total) & (place < (drawn + more) / total))
        for part, share in _shares(few, nodes, classes, threshold):
            seen.setdefault(part, []).append(share)
        drawn += more
    if not seen:
        return 1.0, []
    mean = float(np.mean([x for v in seen.values() for x in v]))
    return mean, sorted(p for p, v in seen.items() if np.mean(v) < RECALL_GOAL and (mean < RECALL_GOAL or len(v) >= AUDIT_PART))


def _shares(few: DataFrame, nodes: DataFrame, classes: DataFrame, threshold: float) -> list[tuple[str, float]]:
    """(label, found share of the true links) of those of ``few`` nodes that have any."""
    by_part: dict[str, list] = {}
    for r in few.select("node", F.col("shard").alias("part"), "vector").collect():
        by_part.setdefault(r["part"], []).append(r)
    shared = nodes.sparkSession.sparkContext.broadcast(
        {p: (np.array([r["node"] for r in rs]), unit([r["vector"] for r in rs])) for p, rs in by_part.items()})

    def compare(batches):
        for pdf in batches:
            for part, own in pdf.groupby("shard"):
                if part in shared.value:
                    ids, x = shared.value[part]
                    y, other = unit(own["vector"]).T, own["node"].to_numpy()
                    hit = [((x[a:a + 256] @ y >= threshold) & (ids[a:a + 256, None] != other)).sum(axis=1)
                           for a in range(0, len(ids), 256)]
                    yield pd.DataFrame({"part": part, "node": ids, "n": np.concatenate(hit)})

    true = (nodes.select("shard", "node", "vector").mapInPandas(compare, "part string, node bigint, n bigint")
            .groupBy("part", "node").agg(F.sum("n").alias("links")).filter("links > 0"))
    share = F.least("n_others", "links") / F.col("links")
    return [(r["part"], r["share"]) for r in true.join(classes, "node").select("part", share.alias("share")).collect()]


def embedding_groups(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    overlap, beam = OVERLAP, BEAM
    while True:
        nodes, classes = link_vectors(rows, threshold, overlap, beam)
        short = recall(nodes, classes, threshold)[1]
        if not short:
            break
        if overlap >= 4 * OVERLAP:
            failing = nodes.filter(F.col("shard").isin(short))
            classes = classes.join(failing.select("node"), "node", "left_anti").select(*classes.columns).unionAll(
                compare_all(failing, threshold).select(*classes.columns))
            break
        overlap, beam = 2 * overlap, 2 * beam
    least = classes.groupBy("root").agg(F.min("name").alias("component_id"))
    final = stage(classes.join(least, "root").select("node", "n_links", "component_id"), "graph-final")
    out = rows.select("vec_id", F.xxhash64("label", "embedding").alias("node")).join(final, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
