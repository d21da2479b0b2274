"""Exact top-k by integer inner product: vectors are grouped by length, buckets prune, products verify.

1. Vectors are put in buckets by their length; a bucket too big for one task is dealt out by a hash of the id.
2. The longest bucket gives every query k products, hence a score that its k-th best can't fall below.
3. In each bucket a query's bound divided by both lengths is a local cosine threshold. Above 1 the query
   skips the bucket and isn't sent there; a bucket is sent only to blocks of queries that want it (length pruning). Where the threshold is high, the query's strongest coordinate bounds
   the same coordinate of any vector that can reach it, and only vectors within are multiplied (coordinate
   pruning); else all of the bucket is.
4. All scores are whole products; a bucket sends on at most k rows for each query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Scratch

_SCHEMA = "query_id bigint, vec_id bigint, score bigint"


@dataclass(frozen=True)
class Search:
    k: int = 20
    scale: int = 64
    every: int = 20
    block: int = 8192
    query_block: int = 8192
    buckets: int = 1000
    broadcast_bytes: int = 8 << 20
    #: Coordinate pruning is tried from this local cosine threshold on.
    coordinate_from: float = 0.5


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole-number products, by floats only where those are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return np.rint(q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return q @ v.T
    raise ValueError("a product does not fit 64 bits")


def search_block(ids: np.ndarray, q: np.ndarray, bound: np.ndarray, vec_ids: np.ndarray, v: np.ndarray, s: Search) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vector ids, scores) that may be among the k best; bound: each query's least k-th score."""
    order = np.argsort(vec_ids, kind="stable")
    vec_ids, v = vec_ids[order], v[order]
    q_len, v_len = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((v.astype(float) ** 2).sum(1))
    slack = 1e-6
    local = np.where(bound > np.iinfo(np.int64).min, bound / np.maximum(q_len * v_len.max(initial=0), 1e-300), -2.0)
    local = np.where((q_len == 0) | (v_len.max(initial=0) == 0), -2.0, local)
    live = np.flatnonzero(local <= 1 + slack)
    high = local[live] >= s.coordinate_from
    out = []

    def best(rows: np.ndarray, columns: np.ndarray) -> None:
        if not len(rows) or not len(columns):
            return
        scores = _products(q[rows], v[columns])
        own = ids[rows][:, None] == vec_ids[columns][None, :]
        for i, r in enumerate(rows):
            at = np.flatnonzero((scores[i] >= bound[r]) & ~own[i])
            if len(at) > s.k:
                least = np.partition(scores[i][at], len(at) - s.k)[len(at) - s.k]
                at = at[scores[i][at] >= least]
                at = at[np.argsort(-scores[i][at], kind="stable")][: s.k]  # columns ascend by id: ties keep the smaller
            out.append((np.full(len(at), ids[r]), vec_ids[columns][at], scores[i][at]))

    everything = np.arange(len(vec_ids))
    rest = live[~high]
    for at in range(0, len(rest), 256):
        best(rest[at : at + 256], everything)
    unit = v / np.maximum(v_len, 1e-300)[:, None]
    by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in live[high]:
        t = max(0.0, min(1.0, float(local[r]) - slack))
        c = int(np.abs(q[r]).argmax())
        if c not in by_coordinate:
            place = np.argsort(unit[:, c], kind="stable")
            by_coordinate[c] = place, unit[place, c]
        place, value = by_coordinate[c]
        x = q[r, c] / q_len[r]
        wide = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x)))
        lo = np.searchsorted(value, x * t - wide - slack) if t > -x else 0
        hi = np.searchsorted(value, x * t + wide + slack, side="right") if t > x else len(value)
        best(np.array([r]), np.sort(place[lo:hi]))
    return out


def _deal(rows: DataFrame, by: str, block: int, most: int) -> DataFrame:
    """rows with part, a string: ranges of by within each dim, those with more than block rows dealt out by hash.

    Only counts of ranges, at most dims x most of them, reach the driver.
    """
    n = rows.count()
    ranges = max(1, min(most, -(-n // block)))
    cuts = rows.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else []
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c <= F.col(by))) if cuts else F.lit(0)
    placed = rows.withColumn("_range", F.concat_ws("/", "dim", F.lpad(at.cast("string"), 6, "0")))
    sizes = placed.groupBy("_range").count().collect()
    salts = F.create_map(*[F.lit(x) for r in sizes for x in (r["_range"], -(-r["count"] // block))]) if sizes else F.create_map(F.lit(""), F.lit(1))
    return placed.withColumn("part", F.concat_ws("/", "_range", F.pmod(F.xxhash64("_id"), salts[F.col("_range")]).cast("int")))


def top_k(vectors: DataFrame, s: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose id is divisible by s.every, against all rows.

    Vectors that are null, or hold null or non-finite components, take no part, nor do null ids. Rows that
    repeat an id count once (the least vector stays). Vectors of different dimension have no product.
    Queries with fewer than k others get all; ties go to the smaller id; an empty table gives an empty result.
    Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    x = F.col("x")
    small = lambda df, width: F.broadcast(df) if df.count() * width <= s.broadcast_bytes else df
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("_id").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, finite), F.lit(False)))
    rows = rows.select("_id", F.transform(x, lambda c: F.floor(c * s.scale)).alias("v")).groupBy("_id").agg(F.min("v").alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    rows = scratch.write(rows.withColumn("length", F.sqrt(squares)).withColumn("dim", F.size("v")).where("dim > 0"), "vectors")
    placed = scratch.write(_deal(rows, "length", s.block, s.buckets).drop("_range"), "placed")
    parts = scratch.write(placed.groupBy("dim", "part").agg(F.max("length").alias("top")), "parts")
    queries = rows.where(F.col("_id") % s.every == 0).select("_id", F.col("v").alias("q"), "dim", "length")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            q, v = _matrix(left["q"], left.num_rows), _matrix(right["v"], right.num_rows)
            bound = left["bound"].to_numpy() if "bound" in left.column_names else np.full(left.num_rows, np.iinfo(np.int64).min)
            found = search_block(left["query_id"].to_numpy(), q, bound, right["vec_id"].to_numpy(), v, s)
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    # A first look at one part of the longest vectors of each dimension bounds each query's k-th score from below.
    first = parts.groupBy("dim").agg(F.max_by("part", F.struct("top", "part")).alias("part"))
    q_parts = max(1, -(-queries.count() // s.query_block))
    dealt = queries.select(F.col("_id").alias("query_id"), "q", "dim", F.pmod(F.xxhash64("_id"), F.lit(q_parts)).cast("int").alias("q_part"))
    seeds = placed.join(F.broadcast(first), ["dim", "part"]).select(F.col("_id").alias("vec_id"), "v", F.col("dim").alias("for_dim"), F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("for_part"))
    seeded = dealt.groupBy("dim", "q_part").cogroup(seeds.groupBy("for_dim", "for_part")).applyInArrow(run, _SCHEMA)
    bounds = seeded.groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("k")).where(F.col("k") == s.k).select(F.col("query_id").alias("_id"), "bound")
    # Shortest vector that can still reach a query's bound: queries alike in it meet the same parts.
    wanted = F.when(F.col("bound").isNull() | (F.col("bound") <= 0) | (F.col("length") == 0), 0.0).otherwise(F.col("bound") / F.col("length"))
    known = scratch.write(queries.join(bounds, "_id", "left").withColumn("wanted", wanted).withColumn("bound", F.coalesce("bound", F.lit(np.iinfo(np.int64).min))), "queries")
    known = scratch.write(_deal(known, "wanted", s.query_block, s.buckets).drop("_range").withColumnRenamed("part", "q_part"), "dealt")
    # Length pruning before anything moves: a query goes to the parts whose longest vector can reach its bound,
    # and a part to the query blocks that sent it one.
    reach = F.col("top") * (1 + 1e-9) + 1e-9
    left = known.join(small(parts, 64), "dim").where(F.col("wanted") <= reach).select(F.col("_id").alias("query_id"), "q", "bound", "part", "q_part")
    blocks = known.groupBy("dim", "q_part").agg(F.min("wanted").alias("wanted"))
    live = scratch.write(small(blocks, 64).join(parts, "dim").where(F.col("wanted") <= reach).select(F.col("part").alias("of_part"), F.col("q_part").alias("for_part")), "live")
    right = placed.withColumnRenamed("part", "of_part").join(small(live, 64), "of_part").select(F.col("_id").alias("vec_id"), "v", "of_part", "for_part")
    near = left.groupBy("part", "q_part").cogroup(right.groupBy("of_part", "for_part")).applyInArrow(run, _SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
