"""Embedding near-duplicates by a cover tree and dual traversal: all pairs with a cosine of at least the threshold.

For unit vectors a cosine bound is a distance bound. A level of the tree is a set of centres that lie farther apart than
its radius and cover every vector within it; the centre of a node is also its first child's, and a child covers at most
half its parent's radius. The uppermost level is a Spark table: cells around centres that are each the farthest from
those before, with the covering radius of all their vectors, cut into blocks of a bounded number of vectors. Pairs of
cells that are too far apart by their radii are pruned; each pair of blocks of the others is one task, which builds the
levels below and walks both sides at once: pairs of nodes that are too far apart are dropped, pairs that are wholly
within the bound are linked at once, and the vectors of leaves that stay are compared in double precision.

The cells' centres may come from a bounded sample because the radii do not: which pairs are found does not depend on
them. Where vectors have no neighbours but their duplicates, in many dimensions, cells have wide radii and few of their
pairs are pruned: pruning begins at the levels within the tasks, and the copies sent grow with the number of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, stored, table

THRESHOLD = 0.95
#: a block has about so many vectors, more in large tables and never more than MOST_BLOCK
BLOCK = 8_192
MOST_BLOCK = 65_536
FEW_BLOCKS = 2_048
SAMPLE = 4_096
LEAF = 512
#: distances are compared with this much room, so that rounding prunes no pair
SLACK = 1e-7


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, without overflow."""
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors, each of a with each of b."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def far_points(x: np.ndarray, most: int) -> list[int]:
    """Rows chosen one by one, each the farthest from those before; fewer where no others are left."""
    chosen, left = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < most:
        at = int(left.argmax())
        if left[at] <= SLACK:
            break
        chosen.append(at)
        left = np.minimum(left, distances(x, x[at : at + 1])[:, 0])
    return chosen


def maybe_near(a: np.ndarray, b: np.ndarray, bound) -> np.ndarray:
    """Rows of b, in single precision as a, that may lie within bound (one number, or one a row) of any row of a."""
    return np.flatnonzero((a @ b.T).max(0) >= 1 - np.minimum(bound, 2) ** 2 / 2 - 1e-5)


def net(x: np.ndarray, x32: np.ndarray, radius: float, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Centres, row 0 the first, that lie farther apart than radius, and for each row one that has it within radius."""
    owner, chosen, left = np.zeros(len(x), np.int64), [], np.arange(len(x))
    while left.size:
        some = left[:batch]
        close, free, new = distances(x[some], x[some]) <= radius, np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                new.append(i)
                free &= ~close[i]
        centers, rest = some[new], np.ones(len(left), bool)
        at = maybe_near(x32[centers], x32[left], radius)
        away = distances(x[left[at]], x[centers])
        nearest, covered = away.argmin(1), away.min(1) <= radius
        owner[left[at[covered]]] = nearest[covered] + len(chosen)
        owner[centers] = np.arange(len(new)) + len(chosen)
        rest[at[covered]] = rest[new] = False
        chosen += centers.tolist()
        left = left[rest]
    return np.array(chosen), owner


class Node:
    """Rows idx of x (x32 in single precision) around the first; the children's centres are a net of half the radius."""

    def __init__(self, x: np.ndarray, idx: np.ndarray, x32: np.ndarray | None = None):
        self.idx, self.kids, self.center, self.radius = idx, [], x[idx[0]], 0.0
        if len(idx) == 1:
            return
        own = x[idx]
        self.radius = float(np.linalg.norm(own - self.center, axis=1).max())
        if len(idx) <= LEAF:
            return
        x32 = x.astype(np.float32) if x32 is None else x32
        if self.radius <= SLACK:
            parts = np.array_split(idx, -(-len(idx) // LEAF))
        else:
            chosen, owner = net(own, x32[idx], self.radius / 2)
            rank = np.ones(len(idx), np.int64)
            rank[chosen] = 0  # a centre comes first among its rows
            order = np.lexsort((rank, owner))
            parts = np.split(idx[order], np.flatnonzero(np.diff(owner[order])) + 1)
        self.kids = [Node(x, p, x32) for p in parts]

    def runs(self) -> list[list[Node]]:
        """The children (or the leaf itself) in order: leaves gathered to about LEAF rows, the others alone."""
        out, size = [], LEAF
        for kid in self.kids or [self]:
            if kid.kids or size + len(kid.idx) > LEAF:
                out.append([])
                size = 0
            out[-1].append(kid)
            size = LEAF if kid.kids else size + len(kid.idx)
        return out


class Links:
    """Link counts and connections of the rows of two sides, met in a dual traversal."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, threshold: float):
        self.x, self.x32, self.copies, self.threshold = x, x.astype(np.float32), copies, threshold
        self.reach = math.sqrt(max(0.0, 2 - 2 * threshold))
        self.counts, self.parent = np.zeros(len(x), np.int64), list(range(len(x)))
        self.seen = self.pruned = 0  # pairs of nodes, and those dropped by their radii

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def all_linked(self, a: Node, b: Node) -> None:
        if a is b:
            self.counts[a.idx] += self.copies[a.idx].sum() - self.copies[a.idx]
        else:
            self.counts[a.idx] += self.copies[b.idx].sum()
            self.counts[b.idx] += self.copies[a.idx].sum()
        for i in [*a.idx.tolist(), *b.idx.tolist()]:
            self.join(a.idx[0].item(), i)

    def leaves(self, a: np.ndarray, b: np.ndarray, same: bool = False) -> None:
        """Compare rows a with rows b, or among themselves."""
        for at in range(0, len(b), 8_192):
            self.compare(a, b[at : at + 8_192], same)

    def compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        rough = self.x32[a] @ self.x32[b].T
        if rough.max() < self.threshold - 1e-4:
            return
        mask = self.x[a] @ self.x[b].T >= self.threshold
        if same:
            np.fill_diagonal(mask, False)
        if not mask.any():
            return
        self.counts[a] += mask @ self.copies[b]
        if not same:
            self.counts[b] += mask.T @ self.copies[a]
        if mask.sum() <= 4 * (len(a) + len(b)):
            for i, j in zip(*(k.tolist() for k in mask.nonzero())):
                self.join(a[i].item(), b[j].item())
            return
        n, m = mask.shape  # many links: least labels spread over the two sides until they rest
        left, right = np.arange(n), np.arange(n, n + m)
        if same:
            right = left.copy()
        while True:
            new_right = np.minimum(right, np.where(mask, left[:, None], n + m).min(0))
            new_left = np.minimum(left, np.where(mask, new_right[None, :], n + m).min(1))
            if (new_left == left).all() and (new_right == right).all():
                break
            left, right = new_left, new_right
            if same:
                left = right = np.minimum(left, right)
        whole = np.concatenate([a, b])
        for at, label in [*enumerate(left.tolist()), *((n + k, v) for k, v in enumerate(right.tolist()))]:
            self.join(whole[at].item(), whole[label].item())

    def walk(self, a: Node, b: Node) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            apart = 0.0 if a is b else float(np.linalg.norm(a.center - b.center))
            if apart > a.radius + b.radius + self.reach + SLACK:
                continue
            if apart + a.radius + b.radius <= self.reach - SLACK:
                self.all_linked(a, b)
            elif a.kids or b.kids:
                stack += self.below(a, b)
            else:
                self.leaves(a.idx, b.idx, a is b)

    def below(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Compares the leaves among the children of both that stay, and returns the pairs of other children that stay."""
        out, kids = [], b.kids or [b]
        first, radii = np.array([k.idx[0] for k in kids]), np.array([k.radius for k in kids])
        centers, centers32 = self.x[first], self.x32[first]
        inner, done = np.array([bool(k.kids) for k in kids]), 0
        for run in a.runs():
            own, wide = np.array([k.idx[0] for k in run]), np.array([k.radius for k in run])
            done = done + len(run) if a is b else 0  # each pair of children once, those within the run below
            at = done + maybe_near(self.x32[own], centers32[done:], wide.max() + radii[done:] + self.reach + SLACK)
            near = distances(self.x[own], centers[at]) <= wide[:, None] + radii[at] + self.reach + SLACK
            tried = len(run) * (len(kids) - done)
            self.seen, self.pruned = self.seen + tried, self.pruned + tried - int(near.sum())
            rows = np.concatenate([k.idx for k in run])
            if run[0].kids:
                out += [(run[0], kids[j]) for j in at[near[0]].tolist()]
                if a is b:
                    out.append((run[0], run[0]))
                continue
            if a is b:
                self.leaves(rows, rows, True)
            out += [(run[i], kids[at[j]]) for i, j in zip(*(k.tolist() for k in (near & inner[at]).nonzero()))]
            met = at[near.any(0) & ~inner[at]].tolist()
            if met:
                self.leaves(rows, np.concatenate([kids[j].idx for j in met]))
        return out


def _pair(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One pair of blocks (sides 0 and 1) or one block (side 2): rows, copies linked, a row that each is connected with."""
    x = unit(np.stack(pdf["e"].to_numpy()))
    links, side = Links(x, pdf["n"].to_numpy(np.int64), threshold), pdf["side"].to_numpy()
    trees = [Node(x, rows, links.x32) for rows in map(np.flatnonzero, (side == 0, side == 1, side == 2)) if len(rows)]
    if len(trees) == 2 or side[0] == 2:  # a block may be empty
        links.walk(trees[0], trees[-1])
    got = np.flatnonzero(links.counts)
    cid = pdf["cid"].to_numpy()
    return pd.DataFrame({"cid": cid[got], "links": links.counts[got], "root": cid[[links.root(i) for i in got.tolist()]] if len(got) else cid[:0]})


def link_classes(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """classes: cid (unique long), n (copies), e (vector), all of one dimension. Returns cid, links, root.

    links counts copies in other classes; cid and root are connected. Several rows for a class add up.
    """
    spark, count = classes.sparkSession, classes.count()
    block = max(block, min(MOST_BLOCK, count // FEW_BLOCKS))
    some = classes.select("e").orderBy(F.xxhash64("e")).limit(SAMPLE).collect()
    if not some:
        return spark.createDataFrame([], "cid bigint, links bigint, root bigint")
    sample = unit(np.array([r.e for r in some]))
    centers = sample[far_points(sample, max(1, min(SAMPLE // 4, -(-count // block))))]

    def assign(batches):
        for b in batches:
            if b.num_rows:
                x = unit(np.stack([v.values.to_numpy(zero_copy_only=False) for v in b.column(2)]))
                near = (x @ centers.T).argmax(1)
                away = np.linalg.norm(x - centers[near], axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(away)], [*b.schema.names, "cell", "away"])

    kind = classes.schema["e"].dataType.simpleString()
    placed = stored(classes.select("cid", "n", "e").mapInArrow(assign, f"cid bigint, n bigint, e {kind}, cell int, away double"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).orderBy("cell").collect()  # as many as centres
    at, radius, slices = [c.cell for c in cells], np.array([c.r for c in cells]), [-(-c.n // block) for c in cells]
    near = distances(centers[at], centers[at]) <= radius[:, None] + radius + math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    plan = [(at[i], slices[i], [(at[j], slices[j]) for j in near[i].nonzero()[0].tolist()]) for i in range(len(at))]
    plan = spark.createDataFrame(plan, "cell int, slices int, near array<struct<cell:int, slices:int>>")
    # the plan has a row for each cell, of which there are at most SAMPLE // 4
    name = "bigint(cell) << 32 | bigint({})"  # of a block
    cut = placed.join(F.broadcast(plan), "cell").withColumn("own", F.expr(name.format("pmod(xxhash64(cid), slices)")))
    met = cut.select("cid", "n", "e", "own", F.inline("near").alias("cell", "slices"))
    met = met.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("other", F.expr(name.format("slice")))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    dealt = met.select("cid", "n", "e", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side.alias("side"))
    return dealt.groupBy("a", "b").applyInPandas(lambda pdf: _pair(pdf, threshold), "cid bigint, links bigint, root bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Null, zero and non-finite vectors, and those with null components, link with nothing; vectors of different
    dimensions do not link. Rows that repeat a vec_id are rows of their own. Equal vectors are compared once, as a
    class, and link with each other. Other columns are ignored; an empty table gives no rows.
    """
    e = F.col("embedding")
    whole = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(whole, F.lit(False)), e).alias("e"))
    valid = rows.filter("e is not null").groupBy("e").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = stored(valid.withColumn("cid", F.monotonically_increasing_id()))
    found = None
    for r in classes.select(F.size("e").alias("d")).distinct().collect():  # the dimensions that occur
        part = link_classes(classes.filter(F.size("e") == r.d), threshold, block)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found)
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    touched = named.filter("n > 1 or links > 0").join(least, "root")
    touched = touched.select("e", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(touched, "e", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").cast("bigint").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
