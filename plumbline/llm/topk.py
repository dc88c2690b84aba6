"""Exact top-k search by inner product with dual cover trees.

Vectors are rounded to integers, so scores are exact.

1. Pivots spread over a bounded sample (farthest first); each vector goes to the cell of its nearest pivot. A cell
   has a covering radius over all its vectors, and blocks of bounded size: a cell that a third of all rows share, or one
   that repeats one vector, only has more blocks.
2. Each query is searched in one block of its most promising cell, which gives it a k-th score to beat.
3. A query goes on to the blocks of those cells only that can still hold as much: <q, p> <= <q, c> + |q| r for all p
   within r of c. This is decided before anything is shuffled; blocks that no query asks for are not sent at all.
4. Where queries meet a block, a cover tree stands over either side, and pairs of nodes are walked, the most promising
   first. A pair is pruned when no score in it can reach the worst k-th score in its query node: <q, p> <= <cq, cp> +
   |cq| rp + |cp| rq + rq rp, with centres c and covering radii r. What is left at the leaves is multiplied out.

The best k of each meeting go into a window per query, which keeps k rows a task before its shuffle.

Cases. Vectors null or with null or non-finite components, and rows without vec_id, take no part. Shorter vectors, also
empty ones, count as padded with zeros. Each row with a query's id is a query, and only that row is not its candidate:
others with the same vec_id are. Ties go to the smaller vec_id. Under k candidates: all of them. Empty table: no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, saved
from .substring import scatter

HITS = "query long, query_id long, vec_id long, score long"
ASKED = "rid long, vec_id long, v array<double>, least double, cell int, sub int"


@dataclass
class Node:
    centre: np.ndarray
    norm: float
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, rows: np.ndarray, leaf: int = 64, shrink: float = 0.8) -> Node:
    """A tree over x[rows]: a node's children have centres among its points, that cover them within its radius * shrink."""
    centre = x[rows[0]]
    far = np.sqrt(((x[rows] - centre) ** 2).sum(axis=1))
    node = Node(centre, float(np.sqrt((centre**2).sum())), float(far.max()), rows)
    if len(rows) <= leaf or node.radius == 0:
        return node
    within, left, apart = node.radius * shrink, rows, far
    parts, loose = [], []
    while len(left):
        near = apart <= within
        # a point that covers next to nothing goes into a shared leaf
        (parts if near.sum() > 4 else loose).append(left[near])
        left, apart = left[~near], apart[~near]
        if len(left):
            apart = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(axis=1))
    if len(parts) + len(loose) == 1 or (len(parts) == 1 and len(parts[0]) == len(rows)):
        return node
    node.children = [cover_tree(x, p, leaf, shrink) for p in parts]
    if loose:
        alone = np.concatenate(loose)
        for k in range(0, len(alone), leaf):
            some = alone[k : k + leaf]
            apart = np.sqrt(((x[some] - x[some[0]]) ** 2).sum(axis=1))
            node.children.append(Node(x[some[0]], float(np.sqrt((x[some[0]] ** 2).sum())), float(apart.max()), some))
    return node


class Search:
    """The best k candidates of each query so far, and the walk that improves them."""

    def __init__(self, q: np.ndarray, q_own: np.ndarray, p: np.ndarray, p_own: np.ndarray, k: int, p_ids: np.ndarray | None = None, least: np.ndarray | None = None):
        """q_own and p_own: of equal ones a candidate is the query itself; least: scores that count for nothing below."""
        self.q, self.q_own, self.p, self.p_own, self.k = q, q_own, p, p_own, k
        self.p_ids = p_own if p_ids is None else p_ids
        self.least = np.full(len(q), -np.inf) if least is None else least
        self.score = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.pairs = self.pruned = 0

    def bound(self, a: Node, b: Node) -> float:
        top = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return top + 1e-9 * (abs(top) + a.norm * b.norm + 1)

    def to_reach(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.least[rows])

    def leaves(self, a: Node, b: Node) -> None:
        rows = a.rows
        new = self.q[rows] @ self.p[b.rows].T
        new[self.q_own[rows][:, None] == self.p_own[b.rows][None, :]] = -np.inf
        some = (new >= self.to_reach(rows)[:, None]).any(axis=0) & (new > -np.inf).any(axis=0)
        if not some.any():
            return
        score = np.concatenate([self.score[rows], new[:, some]], axis=1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(self.p_ids[b.rows][some], (len(rows), int(some.sum())))], axis=1)
        order = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, order, axis=1)
        self.ids[rows] = np.take_along_axis(ids, order, axis=1)

    def walk(self, a: Node, b: Node) -> None:
        todo = [(self.bound(a, b), a, b)]
        while todo:
            bound, a, b = todo.pop()
            self.pairs += 1
            if bound < self.to_reach(a.rows).min():
                self.pruned += 1
                continue
            if not a.children and not b.children:
                self.leaves(a, b)
            elif a.children and (not b.children or a.radius * b.norm > b.radius * a.norm):
                todo += sorted(((self.bound(c, b), c, b) for c in a.children), key=lambda t: t[0])
            else:
                todo += sorted(((self.bound(a, c), a, c) for c in b.children), key=lambda t: t[0])


def _whole(vectors: pd.Series, width: int = 0) -> np.ndarray:
    """floor(1024 * x) of each component, in float64; exact while products stay under 2**53."""
    out = np.zeros((len(vectors), max([width, *map(len, vectors)])))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = np.floor(1024.0 * np.asarray(v, dtype=np.float64))
    return out


def _alike(*some: np.ndarray) -> list[np.ndarray]:
    """With as many columns each, zeros at the end."""
    width = max(x.shape[1] for x in some)
    return [np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in some]


def _large(q: np.ndarray, p: np.ndarray, q_own: np.ndarray, p_own: np.ndarray, p_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, vec_id, score) where floats are not exact: they leave out what is surely no hit, whole numbers of any size decide."""
    for i in range(len(q)):
        near = p @ q[i]
        # the sums' rounding errors, generously
        slack = 2.0**-50 * p.shape[1] * (np.abs(p) @ np.abs(q[i]))
        near[p_own == q_own[i]] = -np.inf
        sure = np.sort(near - slack)[::-1][: k]
        some = np.flatnonzero((near + slack >= sure[-1]) & (near > -np.inf))
        mine = [int(x) for x in q[i]]
        got = sorted((-sum(x * int(y) for x, y in zip(mine, p[j])), int(p_ids[j])) for j in some)[:k]
        yield from ((i, v, -s) for s, v in got)


def best_of(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """HITS: each query's best k candidates, as far as they reach its least score.

    queries: vec_id, v and, if there are such, rid (which row it is; else the vec_id says it) and least. candidates: vec_id, v, rid.
    """
    own = "rid" if "rid" in queries else "vec_id"
    empty = pd.DataFrame({c.split()[0]: [] for c in HITS.split(", ")}, dtype="int64")
    if not len(queries) or not len(candidates):
        return empty
    q, p = _alike(_whole(queries["v"]), _whole(candidates["v"]))
    q_own, p_own, q_ids, p_ids = (x.to_numpy(np.int64) for x in (queries[own], candidates[own], queries["vec_id"], candidates["vec_id"]))
    if np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * q.shape[1] >= 2**53:
        rows = [(int(q_own[i]), int(q_ids[i]), v, s) for i, v, s in _large(q, p, q_own, p_own, p_ids, k)]
        return pd.DataFrame(rows, columns=list(empty.columns)) if rows else empty
    s = Search(q, q_own, p, p_own, k, p_ids, queries["least"].to_numpy(np.float64) if "least" in queries else None)
    s.walk(cover_tree(q, np.arange(len(q))), cover_tree(p, np.arange(len(p))))
    hit = (s.score > -np.inf) & (s.score >= s.least[:, None])
    n = hit.sum(axis=1)
    return pd.DataFrame({"query": np.repeat(q_own, n), "query_id": np.repeat(q_ids, n), "vec_id": s.ids[hit], "score": s.score[hit].astype(np.int64)})


def spread_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of x, each the farthest from those before it; fewer if the rest repeat them."""
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < most:
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return x[chosen]


def _dealt(pivots: np.ndarray):
    """Rows with the cell of their nearest pivot and how far it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, c = _alike(_whole(batch["v"]), pivots)
            cell, far = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
            for k in range(len(c)):
                d = np.sqrt(((x - c[k]) ** 2).sum(axis=1))
                cell, far = np.where(d < far, k, cell), np.minimum(d, far)
            yield batch.assign(cell=cell.astype(np.int32), far=far)

    return run


@dataclass
class Cells:
    """What is known of the cells; its size depends on the number of pivots only."""

    pivots: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    blocks: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No score of a query [row] within a cell [column] is above this."""
        q, c = _alike(q, self.pivots)
        size = np.sqrt((q**2).sum(axis=1))[:, None]
        top = q @ c.T + size * self.radius[None, :]
        top = top + 1e-9 * (np.abs(top) + size * (np.sqrt((c**2).sum(axis=1)) + self.radius)[None, :] + 1)
        return np.where(self.rows[None, :] > 0, top, -np.inf)


def _first_block(rid: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (scatter(rid.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int32)


def _start(cells: Cells, k: int):
    """A block for each query, of the cell where it may find most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                enough = cells.rows > k if (cells.rows > k).any() else cells.rows == cells.rows.max()
                cell = np.where(enough[None, :], cells.bounds(_whole(batch["v"])), -np.inf).argmax(axis=1)
                yield batch.assign(least=-np.inf, cell=cell.astype(np.int32), sub=_first_block(batch["rid"].to_numpy(np.int64), cells.blocks[cell]))

    return run


def _others(cells: Cells):
    """Each query with every block, but the one where it began (cell, sub), that may reach its least score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                row, cell = np.nonzero(cells.bounds(_whole(part["v"])) >= part["least"].to_numpy()[:, None])
                n = cells.blocks[cell]
                row, cell, sub = np.repeat(row, n), np.repeat(cell, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                new = (cell != part["cell"].to_numpy()[row]) | (sub != part["sub"].to_numpy()[row])
                row, cell, sub = row[new], cell[new], sub[new]
                for k in range(0, len(row), 4096):
                    yield part.iloc[row[k : k + 4096]].assign(cell=cell[k : k + 4096].astype(np.int32), sub=sub[k : k + 4096].astype(np.int32))

    return run


def _meet(asked: DataFrame, blocks: DataFrame, k: int, query_block: int) -> DataFrame:
    """HITS of the rows of asked (ASKED), each in its block. Only blocks that are asked for are sent, once for query_block queries."""
    n = saved(asked.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(query_block))).alias("n")), "topk-asked")
    left = asked.join(n, ["cell", "sub"]).withColumn("q", F.pmod(F.xxhash64("rid"), "n")).drop("n")
    right = blocks.join(n, ["cell", "sub"]).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    return left.groupBy("cell", "sub", "q").cogroup(right.groupBy("cell", "sub", "q")).applyInPandas(lambda a, b: best_of(a, b, k), HITS)


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, query_block: int = 2048, candidate_block: int = 8192, cell_rows: int = 2048, most_cells: int = 1024, sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score for the rows of vectors (vec_id, embedding) whose vec_id is divisible by every.

    Pivots come from at most ``sample`` rows, by the order of a hash; one for ``cell_rows`` rows, ``most_cells`` at most.
    They decide how much is pruned, never what is found.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sound = saved(sound.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v"), "topk-vectors")
    some = [r["v"] for r in sound.orderBy(F.xxhash64("vec_id", "rid")).limit(sample).select("v").collect()]
    pivots = spread_pivots(_whole(pd.Series(some, dtype=object)), min(most_cells, -(-sound.count() // cell_rows))) if some else np.zeros((1, 0))
    dealt = saved(sound.mapInPandas(_dealt(pivots), "rid long, vec_id long, v array<double>, cell int, far double"), "topk-cells")
    per = {r["cell"]: (r["far"], r["n"]) for r in dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    radius, rows = (np.array([per.get(c, (0.0, 0))[i] for c in range(len(pivots))]) for i in (0, 1))
    cells = Cells(pivots, radius, rows, np.maximum(1, -(-rows // candidate_block)))
    count = F.get(F.array(*[F.lit(int(b)) for b in cells.blocks]), "cell")
    blocks = dealt.withColumn("sub", F.pmod(F.xxhash64("rid"), count).cast("int")).drop("far")
    queries = dealt.where(F.col("vec_id") % every == 0).select("rid", "vec_id", "v")
    began = saved(queries.mapInPandas(_start(cells, k), ASKED), "topk-start")
    first = saved(_meet(began, blocks, k, query_block), "topk-first")
    # a query with fewer than k hits so far takes all
    worst = first.groupBy(F.col("query").alias("rid")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("worst"))
    known = began.join(worst, "rid", "left").withColumn("least", F.coalesce("worst", F.lit(float("-inf")))).select(*began.columns)
    near = first.unionByName(_meet(saved(known.mapInPandas(_others(cells), ASKED), "topk-others"), blocks, k, query_block))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id")))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_dual_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.rid <> c.rid
), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
