"""Exact top-k inner-product search: a ball tree per shard, branch and bound by inner-product bounds.

A shard is a run of at most ``shard_rows`` rows of an input partition, so no shuffle builds it and no
key can swell it. Queries are packed into blocks, and each pair of a shard and a block is one row of
work. A first round takes each shard's most promising leaf; the best k-th score that any shard
reaches is every shard's floor in the second round, which visits nodes by falling bound q.centre + |q| radius until the bound is below the
current k-th score. Nodes that may tie with it are visited, so ties are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlens.llm.common import Scratch

EXACT = float(1 << 53)
LONG = np.iinfo(np.int64)
TREE = pa.schema([("rows", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()), ("span", pa.binary()), ("child", pa.binary()), ("centre", pa.binary()), ("radius", pa.binary())])
TREE_DDL = "rows int, ids binary, values binary, span binary, child binary, centre binary, radius binary"


def quantised(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of each component. Rows without id, null vectors and vectors with null or non-finite components are left out."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null")
    df = df.filter(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return df.select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def build_tree(ids: np.ndarray, values: np.ndarray, leaf: int = 64) -> dict[str, np.ndarray]:
    """Nodes in preorder: span (first row, end), child (left, right; -1 in leaves), centre, radius."""
    points = values.astype(np.float64)
    order = np.arange(len(ids))
    span, child, centre, radius = [], [], [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        node = len(span)
        if parent >= 0:
            child[parent][side] = node
        p = points[order[lo:hi]]
        c = p.mean(0)
        d = np.sqrt(((p - c) ** 2).sum(1))
        span.append((lo, hi))
        child.append([-1, -1])
        centre.append(c)
        radius.append(d.max() * (1 + 1e-9) + 1e-6)
        if hi - lo > leaf and d.max() > 0:
            a = p[d.argmax()]
            b = p[((p - a) ** 2).sum(1).argmax()]
            along = p @ (b - a)
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(along, mid)]
            todo += [(lo + mid, hi, node, 1), (lo, lo + mid, node, 0)]
    return {"ids": ids[order], "values": values[order], "span": np.array(span, np.int32), "child": np.array(child, np.int32), "centre": np.array(centre), "radius": np.array(radius)}


def _trees(dims: int, shard_rows: int):
    def packed(parts):
        t = build_tree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return pa.record_batch([pa.array([len(t["ids"])], pa.int32()), *(pa.array([t[k].tobytes()], pa.binary()) for k in ("ids", "values", "span", "child", "centre", "radius"))], schema=TREE)

    def run(batches: Iterator[pa.RecordBatch]):
        parts, held = [], 0
        for batch in batches:
            ids, values = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            while len(ids):
                take = shard_rows - held
                parts.append((ids[:take], values[:take]))
                held += len(ids[:take])
                ids, values = ids[take:], values[take:]
                if held == shard_rows:
                    yield packed(parts)
                    parts, held = [], 0
        if held:
            yield packed(parts)

    return run


def _scores(values: np.ndarray, q: np.ndarray, exact: bool) -> list[int]:
    if exact:
        return (values.astype(np.float64) @ q.astype(np.float64)).astype(np.int64).tolist()
    return [min(max(int(s), LONG.min), LONG.max) for s in values.astype(object) @ q.astype(object)]


def search_tree(t: dict[str, np.ndarray], qid: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None, first_leaf: bool = False) -> Iterator[tuple[int, int, int]]:
    """(query, vec_id, score) of a shard's best k rows for each query, rows of the query's own id apart.

    With ``floor`` rows below it are left out; ``first_leaf`` stops after one leaf of each query.
    """
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(t["values"]).max(initial=0)) * max(q.shape[1], 1) < EXACT
    qf = q.astype(np.float64)
    norm = np.sqrt((qf**2).sum(1))
    bound = qf @ t["centre"].T + norm[:, None] * t["radius"]
    bound += np.abs(bound) * 1e-9 + 1e-3
    for i in range(len(qid)):
        best: list[tuple[int, int]] = []
        least = LONG.min if floor is None else int(floor[i])
        queue = [(-bound[i, 0], 0)]
        while queue:
            b, node = heapq.heappop(queue)
            if -b < least:
                break
            left, right = t["child"][node]
            if left >= 0:
                heapq.heappush(queue, (-bound[i, left], left))
                heapq.heappush(queue, (-bound[i, right], right))
                continue
            lo, hi = t["span"][node]
            for s, v in zip(_scores(t["values"][lo:hi], q[i], exact), t["ids"][lo:hi].tolist(), strict=True):
                if s >= least and v != qid[i]:
                    if len(best) < k:
                        heapq.heappush(best, (s, -v))
                    else:
                        heapq.heappushpop(best, (s, -v))
                    if len(best) == k:
                        least = max(least, best[0][0])
            if first_leaf and best:
                break
        yield from ((int(qid[i]), -v, s) for s, v in best)


BLOCK = pa.schema([("qid", pa.binary()), ("floor", pa.binary()), ("q", pa.binary())])
BLOCK_DDL = "qid binary, floor binary, q binary"


def _pack(dims: int):
    """Queries (vec_id, v, floor, block) of one block -> one row."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids)
        parts = [ids[order], table.column("floor").to_numpy()[order], _matrix(table.column("v"), dims)[order]]
        return pa.table([pa.array([x.tobytes()], pa.binary()) for x in parts], schema=BLOCK)

    return run


def _search(dims: int, k: int, first_leaf: bool):
    """Pairs of a shard and a block -> the block's results in the shard; with ``first_leaf`` only each query's k-th score so far."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(len(batch)):
                view = {f.name: batch.column(j)[i].as_buffer() for j, f in enumerate(batch.schema) if pa.types.is_binary(f.type)}
                t = {"ids": np.frombuffer(view["ids"], np.int64), "values": np.frombuffer(view["values"], np.int64).reshape(-1, dims), "span": np.frombuffer(view["span"], np.int32).reshape(-1, 2), "child": np.frombuffer(view["child"], np.int32).reshape(-1, 2), "centre": np.frombuffer(view["centre"], np.float64).reshape(-1, dims), "radius": np.frombuffer(view["radius"], np.float64)}
                qid, q = np.frombuffer(view["qid"], np.int64), np.frombuffer(view["q"], np.int64).reshape(-1, dims)
                found = list(search_tree(t, qid, q, k, None if first_leaf else np.frombuffer(view["floor"], np.int64), first_leaf))
                if first_leaf:
                    kth: dict[int, list[int]] = {}
                    for query, _, s in found:
                        kth.setdefault(query, []).append(s)
                    found = [(query, 0, min(s)) for query, s in kth.items() if len(s) == k]
                columns = zip(*found, strict=True) if found else [[]] * 3
                yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 10, shard_rows: int = 8192, block: int = 2048) -> DataFrame:
    """Exact k best rows of ``vectors`` (vec_id, v array<bigint>) by inner product for every query.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer than k rows
    if there are fewer. Rows with the query's own vec_id never answer it; queries that repeat an id
    count once (the least vector). Shorter vectors count as padded with zeros. Scores beyond the long
    range stop at its ends. Empty tables give no rows. The number of jobs doesn't depend on the rows:
    blocks of about ``block`` queries and shards are paired by Spark.
    """
    found = "query_id long, vec_id long, score long"
    queries = scratch.save(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    size = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    n, longest = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    dims, least = max(size, longest or 0, 1), F.lit(LONG.min).cast("long")
    trees = scratch.save(vectors.select("vec_id", "v").mapInArrow(_trees(dims, shard_rows), TREE_DDL), "trees")

    def paired(asked: DataFrame, name: str) -> DataFrame:
        packed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // block))))).groupBy("block").applyInArrow(_pack(dims), BLOCK_DDL)
        return trees.crossJoin(scratch.save(packed, name))

    first = paired(queries.withColumn("floor", least), "blocks-1").mapInArrow(_search(dims, k, True), found)
    floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.max("score").alias("floor"))
    asked = queries.join(scratch.save(floors, "floors"), "vec_id", "left").withColumn("floor", F.coalesce("floor", least))
    out = scratch.save(paired(asked, "blocks-2").mapInArrow(_search(dims, k, False), found), "found")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
