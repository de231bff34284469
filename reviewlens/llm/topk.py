"""Exact top k by inner product: candidates ruled out by a table of distances to pivots.

Every row has its distances to a few dozen pivots (the origin is one of them) written beside it.
For a query q and a row c, the largest |d(q, p) - d(c, p)| over the pivots is a lower bound of
their distance, so (|q|^2 + |c|^2 - bound^2) / 2 is an upper bound of their inner product; with the
origin as a pivot it is never above |q| |c|. Candidates are scored from the highest bound down until
no bound left reaches the k-th score found, equal ones included, as a tie may go to a smaller id.

Rows lie in the cell of their nearest pivot but the origin, and a cell is cut into blocks of bounded size, however
many rows it has. Queries are dealt out in bundles of bounded size: first each to one block of the
cell with its highest bound, which gives a k-th score; then, with that score, to those blocks whose
cell may still hold better rows. One task sees one block and one bundle. The driver sees the pivots,
picked from a sample of bounded size, and per cell a count and the range of distances.

Pivots only decide what is skipped: the result is the same for any. Vectors that are null or have
null or non-finite components take no part; a shorter vector counts as ending in zeros; rows with
the same id are rows of their own; a null id is no query and comes last among ties. Rows fewer than
k are all returned, and an empty table gives an empty result. Scores beyond 64 bits are cut to its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import floored, longs, same_kind, with_vectors

K = 20
PIVOTS = 32
SAMPLE = 1_024
BLOCK_ROWS = 16_384
BUNDLE_ROWS = 4_096
QUERIES_AT_ONCE = 64
CANDIDATES_AT_ONCE = 2_048
# Bounds are taken in floating point; scores are exact.
SLACK = 1e-9


def _real(lists: pa.Array, width: int) -> np.ndarray:
    return floored(lists, width).astype(float)


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """The origin, then again and again the row farthest from all picked so far."""
    picked = [np.zeros(sample.shape[1])]
    nearest = (sample**2).sum(axis=1)
    while len(picked) < count and nearest.max(initial=0.0) > 0:
        picked.append(sample[int(nearest.argmax())])
        nearest = np.minimum(nearest, ((sample - picked[-1]) ** 2).sum(axis=1))
    return np.array(picked)


def _measure(pivots: np.ndarray):
    """Distances to the pivots, and the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _real(batch.column("_v"), pivots.shape[1])
            far = np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
            table = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
            # The origin is as near to all rows where they are of one length, and so parts none of them.
            cell = far[:, 1:].argmin(axis=1) + 1 if far.shape[1] > 1 else np.zeros(len(far))
            yield pa.RecordBatch.from_arrays([*batch.columns, table, pa.array(cell.astype(np.int32))], [*batch.schema.names, "_far", "_cell"])

    return run


@dataclass
class Cells:
    """Per cell: rows, number of blocks, and the range of the distances to every pivot."""

    rows: np.ndarray
    blocks: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, table: DataFrame, count: int, block_rows: int) -> Cells:
        ends = [f(F.col("_far")[i]).alias(f"{name}{i}") for i in range(count) for name, f in (("low", F.min), ("high", F.max))]
        found = {r["_cell"]: r for r in table.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect()}  # a row per pivot
        rows = np.array([found[c]["n"] if c in found else 0 for c in range(count)], np.int64)
        low, high = (np.array([[found[c][f"{end}{i}"] if c in found else 0.0 for i in range(count)] for c in range(count)]) for end in ("low", "high"))
        return cls(rows, -(-rows // block_rows), low, high)

    def bounds(self, far: np.ndarray) -> np.ndarray:
        """Upper bound of the score of each query with any row of each cell."""
        apart = np.stack([np.maximum(far - high, low - far).max(axis=1) for low, high in zip(self.low, self.high, strict=True)], axis=1)
        squares = far[:, :1] ** 2 + self.high[:, 0] ** 2
        best = _upper(squares, np.maximum(apart, 0.0))
        best[:, self.rows == 0] = -np.inf
        return best


def _upper(squares: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """From squared lengths, added up, and a lower bound of the distance."""
    return (squares - apart**2) / 2 + SLACK * (squares + 1)


def _aims(cells: Cells):
    """The cells a query still has to visit: the best first, before anything is known of its k-th
    score; all that may reach the score afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(cells.rows)
        for batch in batches:
            far = batch.column("_far").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, count)
            bounds = cells.bounds(far)
            least = batch.column("_least").to_numpy(zero_copy_only=False)
            first = bounds.argmax(axis=1)
            open_ = np.where(np.isnan(least)[:, None], np.arange(count) == first[:, None], bounds >= least[:, None]) & np.isfinite(bounds)
            row, cell = np.nonzero(open_)
            columns = [c.take(pa.array(row)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cell, pa.int32())], [*batch.schema.names, "_aim"])

    return run


# --- one block and one bundle of queries --------------------------------------------------------


def _best(queries: tuple, candidates: tuple, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of query and candidate, and score: for each query its k best and all ties with them."""
    (q, q_far, q_row, least), (c, c_far, c_row) = queries, candidates
    q, c = same_kind(q, c)
    if q.dtype != object:
        # Whole numbers below 2^53 are exact in floating point, whose products are the faster ones.
        small = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 1 << 53
        q, c = (q.astype(float), c.astype(float)) if small else (q.astype(object), c.astype(object))
    by_row = np.argsort(c_row)
    squares = c_far[:, 0] ** 2
    table = np.ascontiguousarray(c_far.T)
    for a in range(0, len(q), QUERIES_AT_ONCE):
        part = slice(a, a + QUERIES_AT_ONCE)
        own, far, limit = q[part], q_far[part], least[part].copy()
        apart = np.zeros((len(own), len(c)))
        for i in range(len(table)):
            difference = table[i] - far[:, i, None]
            np.maximum(apart, np.abs(difference, out=difference), out=apart)
        bounds = _upper(far[:, :1] ** 2 + squares, apart)
        # The query's own row is no candidate.
        place = np.minimum(np.searchsorted(c_row, q_row[part], sorter=by_row), len(c) - 1)
        itself = np.flatnonzero(c_row[by_row[place]] == q_row[part])
        bounds[itself, by_row[place[itself]]] = -np.inf
        top = np.full((len(own), k), -np.inf)
        found = []
        with np.errstate(invalid="ignore"):
            margin = (bounds - np.where(np.isinf(limit), 0.0, limit)[:, None]).max(axis=0)
        left = np.argsort(-margin, kind="stable")
        while len(left):
            left = left[(bounds[:, left] >= limit[:, None]).any(axis=0) & np.isfinite(bounds[:, left]).any(axis=0)]
            now, left = left[:CANDIDATES_AT_ONCE], left[CANDIDATES_AT_ONCE:]
            scores = own @ c[now].T
            open_ = (bounds[:, now] >= limit[:, None]) & np.isfinite(bounds[:, now])
            ranked = np.where(open_, scores.astype(float), -np.inf)
            row, column = np.nonzero(open_ & (ranked >= limit[:, None]))
            found.append((row, now[column], scores[row, column]))
            top = -np.sort(np.partition(-np.concatenate([top, ranked], axis=1), k - 1, axis=1)[:, :k], axis=1)
            limit = np.maximum(limit, top[:, -1])
        if found:
            row, column, score = (np.concatenate(x) for x in zip(*found, strict=True))
            good = score.astype(float) >= limit[row]
            yield a + row[good], column[good], score[good]


def _search(k: int, width: int, count: int):
    names = ["_query_row", "_query", "_row", "_id", "score"]

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        def far(t: pa.Table) -> np.ndarray:
            return t.column("_far").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, count)

        if not queries.num_rows or not candidates.num_rows:
            empty = [queries.column("_row"), queries.column("_id"), candidates.column("_row"), candidates.column("_id"), pa.array([], pa.int64())]
            return pa.table([x.slice(0, 0) for x in empty], names)
        least = queries.column("_least").to_numpy()
        least = np.where(np.isnan(least), -np.inf, least)
        # A score beyond 2^53 may have been rounded up on its way.
        least = np.where(np.abs(least) > 1 << 53, least - np.abs(least) * 1e-15, least)
        q = floored(queries.column("_v"), width), far(queries), queries.column("_row").to_numpy(), least
        c = floored(candidates.column("_v"), width), far(candidates), candidates.column("_row").to_numpy()
        # Ties beyond the k-th go by id, null ids last.
        ids = candidates.column("_id").combine_chunks()
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        rows, columns, scores = [], [], []
        for row, column, score in _best(q, c, k):
            order = np.lexsort((rank[column], -np.unique(score, return_inverse=True)[1], row))
            row, column, score = row[order], column[order], score[order]
            first = np.searchsorted(row, row)
            kept = np.arange(len(row)) - first < k
            rows.append(row[kept])
            columns.append(column[kept])
            scores.append(score[kept])
        row, column = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (rows, columns))
        score = longs(np.concatenate(scores)) if scores else pa.array([], pa.int64())
        return pa.table([queries.column("_row").take(row), queries.column("_id").take(row), candidates.column("_row").take(column), ids.take(column), score], names)

    return run


# --- all blocks ---------------------------------------------------------------------------------


def _of_cell(values: np.ndarray, cell: str) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(cell) + 1)


def _visit(queries: DataFrame, table: DataFrame, cells: Cells, k: int, width: int, bundle_rows: int, blocks) -> DataFrame:
    """Scores of the queries in the blocks of the cells they aim at; `blocks` picks among them."""
    count = len(cells.rows)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    aimed = queries.mapInArrow(_aims(cells), f"{kind}, _aim int")
    aimed = blocks(aimed.withColumn("_block", F.explode(F.sequence(F.lit(0), _of_cell(cells.blocks, "_aim") - 1))))
    aimed = written(aimed, "aims")
    sent = {(r["_aim"]): r["n"] for r in aimed.groupBy("_aim", "_block").count().groupBy("_aim").agg(F.max("count").alias("n")).collect()}
    bundles = np.array([-(-sent.get(c, 0) // bundle_rows) for c in range(count)], np.int64)
    # Which bundle a query is in follows from its row, so a bundle is about as large as the others.
    aimed = aimed.withColumn("_bundle", F.pmod(F.xxhash64("_row", F.lit("bundle")), F.greatest(_of_cell(bundles, "_aim"), F.lit(1))).cast("int"))
    wanted = table.where(_of_cell(bundles, "_cell") > 0).withColumn("_bundle", F.explode(F.sequence(F.lit(0), _of_cell(bundles, "_cell") - 1)))
    left = aimed.select(F.col("_aim").alias("_cell"), "_block", "_bundle", "_row", "_id", "_v", "_far", "_least")
    right = wanted.select("_cell", "_block", "_bundle", "_row", "_id", "_v", "_far")
    keys = ["_cell", "_block", "_bundle"]
    id_kind = table.schema["_id"].dataType.simpleString()
    schema = f"_query_row long, _query {id_kind}, _row long, _id {id_kind}, score long"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, width, count), schema)


def search(
    df: DataFrame, queries: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS, bundle_rows: int = BUNDLE_ROWS,
) -> DataFrame:
    """`(query_id, rank, key, score)`: for every row that `queries` (a condition on the key) names,
    the k rows with the highest scores, ties to the smaller key."""
    spark = df.sparkSession
    asked = F.coalesce(queries, F.lit(False)).alias("_asked")
    rows = with_vectors(df, vector, key).withColumnRenamed("_id", key)
    rows = written(rows.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_id"), "_v", asked), "vectors")
    kind = rows.schema["_id"].dataType.simpleString()
    width = rows.agg(F.max(F.size("_v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score long")
    sample = rows.select("_v").orderBy(F.xxhash64("_v", "_row")).limit(SAMPLE).toArrow()
    chosen = pick_pivots(_real(sample.column("_v"), width), pivots)
    table = rows.mapInArrow(_measure(chosen), f"_row long, _id {kind}, _v array<double>, _asked boolean, _far array<double>, _cell int")
    table = written(table, "pivot-table")
    cells = Cells.of(table, len(chosen), block_rows)
    table = table.withColumn("_block", F.pmod(F.xxhash64("_row"), F.greatest(_of_cell(cells.blocks, "_cell"), F.lit(1))).cast("int"))

    asking = table.where("_asked").select("_row", "_id", "_v", "_far")
    one = F.pmod(F.xxhash64("_row", F.lit("first")), F.greatest(_of_cell(cells.blocks, "_aim"), F.lit(1)))
    unknown = asking.withColumn("_least", F.lit(None).cast("double"))
    first = written(_visit(unknown, table, cells, k, width, bundle_rows, lambda aimed: aimed.where(F.col("_block") == one)), "first-scores")
    reached = first.groupBy(F.col("_query_row").alias("_row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("_least"))
    known = asking.join(reached, "_row", "left").withColumn("_least", F.coalesce("_least", F.lit(float("-inf"))))
    # The block seen before is left out.
    seen = (F.col("_aim") == F.col("_home")) & (F.col("_block") == one)
    homes = known.mapInArrow(_homes(cells), f"_row long, _id {kind}, _v array<double>, _far array<double>, _least double, _home int")
    rest = _visit(homes, table, cells, k, width, bundle_rows, lambda aimed: aimed.where(~seen))
    order = Window.partitionBy("_query_row").orderBy(F.desc("score"), F.asc_nulls_last("_id"), "_row")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("_query").alias("query_id"), "rank", F.col("_id").alias(key), "score")


def _homes(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = batch.column("_far").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cells.rows))
            home = cells.bounds(far).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], [*batch.schema.names, "_home"])

    return run
