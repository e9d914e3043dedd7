"""Ranked lexical search over K2-treaps: top documents of each item by summed term impacts, exactly.

Documents are dealt into shards as they are scanned. A shard's grid has a row for each term and a column
for each document, in the order of doc_id; a point's value is the term's impact in the document before
its weight. The grid is halved both ways again and again. Each cell keeps its largest point and hands
the others on to its quarters, so a shard has as many nodes as points: in level order, with four bits for
the quarters that go on, the value as the difference from the parent's, and the place inside the cell.

An item descends the rows of all its terms together, over halved ranges of documents. The values of the
cells met bound what any document of the range can score; ranges are opened from the highest bound on,
and left out once the k-th score so far, kept from shard to shard within a task, can't be reached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formlens.llm.common import Scratch
from formlens.llm.textkernel import LOWER, as_text, byte_offsets, chunks, release

SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 12
WIDTH = 64  # ranges opened together
BLOCK_ITEMS, BLOCK_TERMS = 1 << 12, 1 << 20  # items and their terms that a task gets at once, on average
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
ONES = np.array([bin(i).count("1") for i in range(16)])
NO_ID = np.iinfo(np.int64).max  # a null doc_id, behind all others
BYTES = ("ids", "mask", "delta", "down", "across")
INDEX = pa.schema([("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int32())), ("height", pa.int32()), *((x, pa.binary()) for x in BYTES)])
INDEX_DDL = "terms array<string>, df array<int>, height int, " + ", ".join(f"{x} binary" for x in BYTES)
#: Rows are large, so the writer looks at their size after each one.
LARGE_ROWS = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for the jobs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def term_spans(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, first and end byte of each term, and the first term of each text and the end."""
    off = byte_offsets(text).astype(np.int64)
    raw = np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off, solid = off - off[0], TERM[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(solid & (~np.r_[False, solid[:-1]] | edge[:-1]))
    end = np.flatnonzero(solid & (~np.r_[solid[1:], False] | edge[1:])) + 1
    return LOWER[raw], start, end, np.searchsorted(start, off)


def terms_of(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of some texts one after the other, and the first of each text and the end."""
    data, start, end, first = term_spans(text)
    cut = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    flat = data[TERM[data]]  # terms hold all such bytes
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(cut), pa.py_buffer(flat)).dictionary_encode(), first


def _counts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        text = as_text(batch.column(0))
        for lo, hi in chunks(text, SHARD_BYTES):
            size = np.diff(term_spans(text.slice(lo, hi - lo))[3])
            yield pa.record_batch([pa.array([int((size > 0).sum())]), pa.array([int(size.sum())])], names=["docs", "terms"])
    release()


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of x (below 2**32) at the even places."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x.astype(np.int64)


@dataclass
class Treap:
    """Nodes in level order: quarters that go on, first child, value and the point's row and column."""

    height: int
    mask: np.ndarray
    child: np.ndarray
    value: np.ndarray
    row: np.ndarray
    col: np.ndarray


def build_treap(row: np.ndarray, col: np.ndarray, value: np.ndarray, height: int) -> dict[str, bytes]:
    """Points (distinct places, at least one) of a grid of side 2**height as stored columns."""
    code = (_spread(row) << 1) | _spread(col)
    order = np.argsort(code)
    code, value = code[order], value[order].astype(np.int64)
    row, col = row[order], col[order]
    masks, deltas, downs, acrosses = [], [], [], []
    above = worth = np.zeros(0, np.int64)
    for level in range(height + 1):
        if not len(code):
            break
        cell = code >> (2 * (height - level))
        lead = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        size = np.diff(np.r_[lead, len(cell)])
        most = np.maximum.reduceat(value, lead)
        at = np.flatnonzero(value == np.repeat(most, size))
        segment = np.searchsorted(lead, at, side="right") - 1
        at = at[np.r_[True, segment[1:] != segment[:-1]]]
        cells = cell[lead]
        if level:
            parent = np.searchsorted(above, cells >> 2)
            np.bitwise_or.at(masks[-1], parent, (1 << (cells & 3)).astype(np.uint8))
            deltas.append((worth[parent] - most).astype(np.uint32))
        else:
            deltas.append(most.astype(np.uint32))
        inside = (1 << (height - level)) - 1
        masks.append(np.zeros(len(cells), np.uint8))
        downs.append((row[at] & inside).astype(np.uint32))
        acrosses.append((col[at] & inside).astype(np.uint16 if height <= 16 else np.uint32))
        above, worth, left = cells, most, np.ones(len(code), bool)
        left[at] = False
        code, value, row, col = code[left], value[left], row[left], col[left]
    return {"mask": np.concatenate(masks).tobytes(), "delta": np.concatenate(deltas).tobytes(), "down": np.concatenate(downs).tobytes(), "across": np.concatenate(acrosses).tobytes()}


def read_treap(height: int, mask: bytes, delta: bytes, down: bytes, across: bytes) -> Treap:
    mask, value = np.frombuffer(mask, np.uint8), np.frombuffer(delta, np.uint32).astype(np.int64)
    row, col = np.frombuffer(down, np.uint32).astype(np.int64), np.frombuffer(across, np.uint16 if height <= 16 else np.uint32).astype(np.int64)
    many = ONES[mask]
    child = 1 + np.cumsum(many) - many
    lo, hi, high, wide = 0, 1, np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(height):
        # The children of a level follow one another: by parent, then by quarter.
        parent = np.repeat(np.arange(lo, hi), many[lo:hi])
        if not len(parent):
            break
        quarter = np.flatnonzero((mask[lo:hi, None] >> np.arange(4)) & 1) & 3
        high, wide = high[parent - lo] * 2 + (quarter >> 1), wide[parent - lo] * 2 + (quarter & 1)
        lo, hi = hi, hi + len(parent)
        value[lo:hi] = value[parent] - value[lo:hi]
        row[lo:hi] += high << (height - level - 1)
        col[lo:hi] += wide << (height - level - 1)
    return Treap(height, mask, child, value, row, col)


def search_treap(t: Treap, ids: np.ndarray, rows: np.ndarray, weight: np.ndarray, k: int, best: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """``best`` ((-score, doc_id), at most k, sorted) with this shard's documents let in; and the number of ranges opened."""

    def entered(cell: np.ndarray, points: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Bounds of ranges with their cells; the points of the rows asked for join those that wait for their document."""
        live = cell >= 0
        node = np.where(live, cell, 0)
        s, i = np.nonzero(live & (t.row[node] == rows))
        points = [np.concatenate(x) for x in zip(points, (s, i, t.col[node[s, i]], t.value[node[s, i]]), strict=True)]
        most = np.where(live, t.value[node], 0)
        np.maximum.at(most, (points[0], points[1]), points[3])
        return most @ weight, points

    cell, level, block, opened = np.zeros((1, len(rows)), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    bound, points = entered(cell, [np.zeros(0, np.int64)] * 4)
    while True:
        done = level == t.height  # one document, its bound is its score
        if done.any():
            best = sorted(best + [(-int(s), int(ids[d])) for s, d in zip(bound[done], block[done], strict=True) if s > 0])[:k]
        open_ = ~done & (bound > 0)
        if len(best) == k:
            least, last = -best[-1][0], best[-1][1]
            head = ids[np.minimum(block << (t.height - level), len(ids) - 1)]
            open_ &= (bound > least) | ((bound == least) & (head < last))
        if not open_.any():
            return best, opened
        at = np.flatnonzero(open_)
        if len(at) > WIDTH:
            near = np.argpartition(-bound[at], WIDTH)
            chosen, rest = at[near[:WIDTH]], at[near[WIDTH:]]
        else:
            chosen, rest = at, at[:0]
        opened += len(chosen)
        # Two halves of each chosen range, then the ranges that stay.
        place = np.full(len(bound), -1)
        place[chosen] = np.arange(len(chosen))
        s, i, doc, value = points
        mine = place[s] >= 0
        to, bit = place[s[mine]], (doc[mine] >> (t.height - level[s[mine]] - 1)) & 1
        halves = [to * 2 + bit, i[mine], doc[mine], value[mine]]
        parent, down = cell[chosen], (t.height - level[chosen] - 1)[:, None]
        live = parent >= 0
        node, quarter = np.where(live, parent, 0), ((rows >> down) & 1) << 1
        new = np.empty((len(chosen), 2, len(rows)), np.int64)
        for b in (0, 1):
            mask, q = t.mask[node], quarter + b
            new[:, b] = np.where(live & (mask >> q & 1 > 0), t.child[node] + ONES[mask & ((1 << q) - 1)], -1)
        new = new.reshape(-1, len(rows))
        new_bound, halves = entered(new, halves)
        place[:] = -1
        place[rest] = len(new) + np.arange(len(rest))
        stays = place[s] >= 0
        points = [np.concatenate([x, y[stays]]) for x, y in zip(halves, (place[s], i, doc, value), strict=True)]
        cell, bound = np.concatenate([new, cell[rest]]), np.concatenate([new_bound, bound[rest]])
        block = np.concatenate([(block[chosen][:, None] * 2 + [0, 1]).ravel(), block[rest]])
        level = np.concatenate([np.repeat(level[chosen] + 1, 2), level[rest]])


def _index(n_docs: int, n_terms: int):
    """Shards of (doc_id, text) rows; impacts by the lengths of all documents."""

    def shard(ids: pa.Array, text: pa.Array) -> pa.RecordBatch | None:
        terms, first = terms_of(text)
        size = np.diff(first)
        if not len(terms):
            return None
        key = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        col = np.empty(len(order), np.int64)
        col[order] = np.arange(len(order))
        code, count = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
        point, tf = np.unique(np.repeat(col, size) * count + code, return_counts=True)
        col, term = point // count, point % count
        df = np.bincount(term, minlength=count)
        rank = np.argsort(-df, kind="stable")  # frequent terms are neighbours, so cells hold rows of like values
        row = np.empty(count, np.int64)
        row[rank] = np.arange(count)
        long, back = np.unique(size[order], return_inverse=True)
        m = np.array([100 - 90 + 90 * n * n_docs // n_terms for n in long.tolist()], np.int64)[back][col]
        value = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        height = max(count - 1, len(order) - 1).bit_length()
        stored = build_treap(row[term], col, value, height) | {"ids": key[order].tobytes()}
        words = terms.dictionary.take(pa.array(rank))
        columns = [pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), x) for x in (words, pa.array(df[rank], pa.int32()))]
        return pa.record_batch([*columns, pa.array([height], pa.int32()), *(pa.array([stored[x]], pa.binary()) for x in BYTES)], schema=INDEX)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, text = batch.column(0), as_text(batch.column(1))
            for lo, hi in chunks(text, SHARD_BYTES):
                for at in range(lo, hi, SHARD_DOCS):
                    out = shard(ids.slice(at, min(hi, at + SHARD_DOCS) - at), text.slice(at, min(hi, at + SHARD_DOCS) - at))
                    if out is not None:
                        yield out
        release()

    return run


def build_index(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Stored shards of all documents (doc_id, text), and the number of documents with a term."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs, n_terms = rows.select("text").mapInArrow(_counts, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return scratch.save(rows.mapInArrow(_index(n_docs or 0, n_terms or 1), INDEX_DDL), "index", **LARGE_ROWS), n_docs or 0


def _item_terms(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        text = as_text(batch.column(1))
        for lo, hi in chunks(text, SHARD_BYTES):
            terms, first = terms_of(text.slice(lo, hi - lo))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), terms.cast(pa.string()))
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), lists], names=["item_id", "terms"])


def _frequencies(vocab: pa.Array):
    """df of the items' terms (by place) in each shard."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(len(batch)):
                found = pc.index_in(vocab, value_set=batch.column(0)[i].values)
                term = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                df = batch.column(1)[i].values.take(found.drop_null()).cast(pa.int64())
                yield pa.record_batch([pa.array(term), df], names=["term", "df"])

    return run


def _search(vocab: pa.Array, weight: np.ndarray, items: list[np.ndarray], k: int):
    """A task's best k documents of each item (by place) over all its shards."""

    def run(batches: Iterator[pa.RecordBatch]):
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for batch in batches:
            for s in range(len(batch)):
                one = {f.name: batch.column(j)[s] for j, f in enumerate(batch.schema)}
                found = pc.index_in(vocab, value_set=one["terms"].values).fill_null(-1).to_numpy()
                treap = read_treap(one["height"].as_py(), *(one[x].as_buffer() for x in BYTES[1:]))
                ids = np.frombuffer(one["ids"].as_buffer(), np.int64)
                for i, terms in enumerate(items):
                    terms = terms[found[terms] >= 0]
                    if len(terms):
                        best[i], _ = search_treap(treap, ids, found[terms].astype(np.int64), weight[terms], k, best[i])
        rows = [(i, d, -s) for i, docs in enumerate(best) for s, d in docs]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        doc = pa.array([None if d == NO_ID else d for d in doc], pa.int64())
        yield pa.record_batch([pa.array(item, pa.int32()), doc, pa.array(score, pa.int64())], names=["item", "doc_id", "score"])
        release()

    return run


def ranked_search(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents (doc_id, text) for each item (item_id, text).

    Scores are exact and above 0, equal ones go by ascending doc_id (null last); fewer than k rows if there
    are fewer. Items of one id, null included, are one item with the terms of all; an item without terms has
    no rows, nor has an empty table. Documents with repeated or null ids are documents of their own. Other
    columns aren't read. Items go to the shards in blocks, one job each, whatever their number.
    """
    spark = docs.sparkSession
    index, n_docs = build_index(docs, scratch)
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_item_terms, f"item_id {items.schema['item_id'].dataType.simpleString()}, terms array<string>")
    asked = asked.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).filter(F.size("terms") > 0)
    asked, seen = scratch.measured(asked, "items", F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms"))
    blocks = max(-(-seen["n"] // BLOCK_ITEMS), -(-(seen["terms"] or 0) // BLOCK_TERMS))
    parts = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # a block of the stated queries
        if not rows:
            continue
        terms = pa.array([x for r in rows for x in r["terms"]], pa.string()).dictionary_encode()
        cut = np.r_[0, np.cumsum([len(r["terms"]) for r in rows])]
        code, vocab = terms.indices.to_numpy(), terms.dictionary
        with batches_of(spark, 4):
            df = dict(tuple(r) for r in index.select("terms", "df").mapInArrow(_frequencies(vocab), "term long, df long").groupBy("term").agg(F.sum("df")).collect())
            weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocab))], np.int64)
            found = index.drop("df").mapInArrow(_search(vocab, weight, [code[lo:hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)], k), "item int, doc_id long, score long")
            found = scratch.save(found, f"found-{b}")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = found.withColumn("rank", place).filter(F.col("rank") <= k)
        parts.append(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
