"""Exact top-k search by exhaustive term-at-a-time accumulation.

A term is a vector component; its posting list holds (row, weight) for each candidate with a non-zero weight.
Candidates stream through the tasks in blocks, of which a task holds ``HELD_BLOCKS`` at a time.  For these the query rows
- written once to the shared folder and read there some at a time, so that no task and no driver ever holds them all -
scatter their weighted postings into a dense array of scores, block by block; a partition selection keeps k of them
for each query over all held blocks, and a shuffle on the query merges what the tasks found.

Scores are 64-bit sums where their bound allows it: both rows' weights are below ``NARROW`` and there are fewer than
``MOST_TERMS`` terms.  Pairs with a greater weight are summed in whole numbers of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionframe.llm.common import fresh_path, table

SCALE = 1024.0
NARROW = float(1 << 20)
MOST_TERMS = 1 << 22
BLOCK_ROWS = 8192
HELD_BLOCKS = 16
QUERY_ROWS = 256


class Rows:
    """Quantised vectors: ids and the non-zero floor(1024 x) as (row, term, weight) of narrow ones; (id, weights) of wide ones."""

    def __init__(self, batch: pa.RecordBatch):
        ids, vecs = batch.column(0), batch.column(1)
        n = len(ids)
        lens = np.where(np.asarray(vecs.is_null()), 0, np.nan_to_num(np.asarray(vecs.value_lengths().fill_null(0)))).astype(np.int64)
        ends = np.cumsum(lens)
        x = np.asarray(vecs.flatten().cast(pa.float64()).fill_null(float("nan")), dtype=np.float64)
        row = np.repeat(np.arange(n), lens)
        term = np.arange(len(x)) - np.repeat(ends - lens, lens)
        takes_part = ~np.asarray(vecs.is_null()) & ~np.asarray(ids.is_null())
        takes_part[row[~np.isfinite(x)]] = False
        narrow = takes_part & (lens < MOST_TERMS)
        narrow[row[~(np.abs(x) < NARROW / SCALE)]] = False
        ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.ids = ids[narrow]
        use = np.flatnonzero(narrow[row])
        weight = np.floor(SCALE * x[use]).astype(np.int64)
        use, weight = use[weight != 0], weight[weight != 0]
        self.row, self.term, self.weight = (np.cumsum(narrow) - 1)[row[use]], term[use], weight
        # a double's product with 1024 may overflow; a whole number's doesn't
        exact = lambda v: int(np.floor(SCALE * v)) if abs(v) < 1e300 else 1024 * int(v)
        self.wide = [(int(ids[i]), [exact(v) for v in x[ends[i] - lens[i] : ends[i]]]) for i in np.flatnonzero(takes_part & ~narrow)]

    def postings(self) -> list[tuple[np.ndarray, np.ndarray]]:
        order = np.lexsort((self.row, self.term))
        row, term, weight = self.row[order], self.term[order], self.weight[order]
        ends = np.searchsorted(term, np.arange(term[-1] + 2)) if len(term) else [0]
        return [(row[a:b], weight[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def vectors(self) -> list[list[int]]:
        """The narrow rows' weights as lists, for products with wide ones."""
        out: list[list[int]] = [[] for _ in self.ids]
        for r, t, w in zip(self.row.tolist(), self.term.tolist(), self.weight.tolist(), strict=True):
            out[r] += [0] * (t - len(out[r])) + [w]
        return out


def accumulate(queries: Rows, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores [query, candidate]: term by term, each query's weight scatters the term's posting list."""
    scores = np.zeros((len(queries.ids), n), np.int64)
    for t in np.unique(queries.term):
        if t >= len(postings):
            break
        rows, weights = postings[t]
        own = queries.term == t
        if len(rows) == n:  # a full posting list is in row order
            scores[queries.row[own]] += np.multiply.outer(queries.weight[own], weights)
        elif len(rows):
            scores[np.ix_(queries.row[own], rows)] += np.multiply.outer(queries.weight[own], weights)
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id: a selection, then a sort of what it left."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, at = np.flatnonzero(scores > cut), np.flatnonzero(scores == cut)
        at = at[np.argsort(ids[at], kind="stable")][: k - len(above)]
        keep = np.concatenate([above, at])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))]


def dot(a: list[int], b: list[int]) -> int:
    return sum(x * y for x, y in zip(a, b, strict=False) if x and y)


class Held:
    """Some blocks of candidates, and each query's best among them."""

    def __init__(self, blocks: list[Rows]):
        self.narrow = [(b.ids, b.postings()) for b in blocks if len(b.ids)]
        self.wide = [w for b in blocks for w in b.wide]
        self.blocks = blocks

    def best_of(self, queries: Rows, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(query, its k best (score, id)) for each query of a block."""
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries.ids]
        for ids, postings in self.narrow:
            scores = accumulate(queries, postings, len(ids))
            for i, own in enumerate(queries.ids):
                others = np.flatnonzero(ids != own)
                top = others[best(scores[i][others], ids[others], k)]
                s, v = np.concatenate([kept[i][0], scores[i][top]]), np.concatenate([kept[i][1], ids[top]])
                top = best(s, v, k)
                kept[i] = s[top], v[top]
        vectors = queries.vectors() if self.wide else []
        for i, own in enumerate(queries.ids.tolist()):
            pairs = list(zip(*(c.tolist() for c in kept[i]), strict=True))
            yield own, highest(pairs + [(dot(vectors[i], v), j) for j, v in self.wide if j != own], k)
        if queries.wide:
            known = [(j, v) for b in self.blocks for j, v in zip(b.ids.tolist(), b.vectors(), strict=True)] + self.wide
            for own, w in queries.wide:
                yield own, highest([(dot(w, v), j) for j, v in known if j != own], k)


def highest(pairs: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return sorted(pairs, key=lambda p: (-p[0], p[1]))[:k]


def topk_search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k rows of highest integer inner product, itself left out.

    Components become floor(1024 x).  Vectors that are null, or hold a null or a non-finite value, and rows without id,
    take no part on either side.  Vectors of unlike length meet in the terms they share; long ones are read whole.  Ties
    go to the smaller id.  A row is left out of its own list by its id; repeated ids are rows of their own.  A score
    among a query's highest that is no 64-bit number is an error.  Empty tables give an empty result; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    path = fresh_path(spark, "topk-queries")
    pick = lambda df: df.select(df[id_col].cast("long").alias("vec_id"), df[vec_col].cast("array<double>").alias("v"))
    pick(queries).write.parquet(path)

    def query_blocks() -> Iterator[Rows]:
        fs, root = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        data = ds.dataset(root, filesystem=fs, format="parquet")
        for b in data.to_batches(columns=["vec_id", "v"], batch_size=QUERY_ROWS):
            if b.num_rows:
                yield Rows(b)

    def searched(held: list[Rows]) -> Iterator[pa.RecordBatch]:
        candidates = Held(held)
        for q in query_blocks():
            out = [(own, j, s) for own, pairs in candidates.best_of(q, k) for s, j in pairs]
            if any(abs(s) >= 1 << 63 for _, _, s in out):
                raise OverflowError("an inner product is no 64-bit number")
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        for batches in blocks_of(it, BLOCK_ROWS):
            held.append(Rows(pa.Table.from_batches(batches).combine_chunks().to_batches()[0]))
            if len(held) == HELD_BLOCKS:
                yield from searched(held)
                held = []
        if held:
            yield from searched(held)

    found = pick(vectors).mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def blocks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of at most ``most`` rows."""
    held, n = [], 0
    for b in batches:
        for s in range(0, b.num_rows, most):
            part = b.slice(s, most)
            if n and n + part.num_rows > most:
                yield held
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield held


def op6_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_search(rows, rows.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""
