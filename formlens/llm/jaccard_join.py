"""Near-duplicate self-join of word-shingle sets by PartEnum signatures, exact for the Jaccard threshold.

Sizes are cut into bands whose ends differ by the threshold at most, so similar sets lie in one band
or in neighbouring ones. For a band ("tag") a similar pair differs in at most k elements. The hash
domain is cut into n1 > k / 2 partitions, each of these into n2 parts; a pair differs in at most one
element in some partition, hence agrees there on n2 - 1 parts at least. Every subset of n2 - 1 parts
gives a signature.

* Equal sets share one key and are joined once; keys that clash are drawn anew.
* A signature held by at most ``group_limit`` sets yields its pairs. A more frequent one ("hot")
  yields a pair with one of its sets for each other: a number that grows with the sets, not the pairs.
* A set meets each partner in at least ``slack`` partitions, so while fewer of its signatures are hot,
  a signature that isn't hot finds the partner. The others are "dense". A hot signature all of whose
  dense sets are connected by now needs no more pairs; sets whose hot signatures that are not settled
  so still use up the slack are compared block by block, those of one component left out.
* Candidates pass a sound filter (histogram distance never exceeds set distance) and then an exact
  count of common shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens.llm.common import Names, Scratch, partitions, small_batches, spread_join
from formlens.llm.components import connected_components
from formlens.llm.textkernel import U, as_text, byte_offsets, chunks, mix, released, set_key, shingle_sets, words

GROUP_LIMIT = 24
FLUSH = 1 << 18
SPREAD = 1  # buckets per partition: a set has more signatures in each of fewer buckets, and its key is sent once for all of them
HELD = 1 << 22  # entries of a bucket before they are thinned out first
SLICE_SHIFT = 29
SLICES = 1 << (32 - SLICE_SHIFT)  # of a bucket's signatures; one is unpacked at a time
STRETCH = 1 << 20
LARGEST = 1 << 34  # elements of a set
SMALL, FAMILIES = 8, 3  # up to this distance, so many families
PLAIN = 1 << 17  # signatures below are codes of sets without slack
BLOCK_SHINGLES = 1 << 20
BROADCAST_ROWS = 1 << 16


class Bands:
    """Size bands ("tags") and partition counts for a threshold of ``percent`` in a hundred."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be between 50 and 100")
        self.percent = percent
        low, self.top = [1], []
        while low[-1] < LARGEST:  # at 100 only equal sets link, and one band will do
            self.top.append(low[-1] * 100 // percent if percent < 100 else LARGEST)
            low.append(self.top[-1] + 1)
        self.low = np.array(low)
        self.small = sum(self.distance(t) <= SMALL for t in range(len(self.top)))

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def distance(self, tag: int) -> int:
        """Most elements in which two similar sets of at most top[tag] elements each differ."""
        return 2 * self.top[tag] * (100 - self.percent) // (100 + self.percent)

    def parts(self, tag: int) -> tuple[int, int, int]:
        """First-level partitions, second-level partitions of each, and families (independent ways to partition).

        Of n1 partitions at most half the distance can differ in two elements or more. Small sets have
        more second-level partitions and families, as their partitions are often nearly empty.
        """
        k = self.distance(tag)
        if k <= 1:
            return 1, 5 if k else 1, FAMILIES if tag < self.small else 1
        if k <= SMALL:
            return k // 2 + 2, 5, FAMILIES
        return math.ceil(1.1 * (k // 2 + 1)) + 2, 3, 1


def signatures(u: np.ndarray, bands: Bands, tag: int, family: int = 0) -> tuple[np.ndarray, int]:
    """Signatures of a set for one tag and family, and the slack: in how many partitions it surely meets a similar set.

    A partition's signatures are its contents without one second-level part each: all subsets of
    n2 - 1 of the n2 parts. Subsets without elements sign nothing; a partition is safe if none of its
    subsets is empty. Two similar sets differ in at most one element in all but k // 2 partitions, so
    they share a signature in each safe one of those.
    """
    n1, n2, _ = bands.parts(tag)
    salt = 30 + 3 * family
    part = (((mix(u, salt) >> U(32)) * U(n1)) >> U(32)).astype(np.int64)
    cell = part * n2 + (((mix(u, salt + 1) >> U(32)) * U(n2)) >> U(32)).astype(np.int64)
    order = np.argsort(cell.astype(np.uint16) if n1 * n2 < 65536 else cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    content, full = np.zeros(n1 * n2, U), np.zeros(n1 * n2, np.int64)
    content[cell[first]] = np.add.reduceat(mix(u, salt + 2)[order], first)
    full[cell[first]] = 1
    content, full = content.reshape(n1, n2), full.reshape(n1, n2)
    whole, filled = content.sum(1, dtype=U)[:, None], full.sum(1)[:, None]
    if n2 == 1:
        subset, used = content, full > 0
    else:
        subset, used = whole - content, filled - full > 0
    sig = mix(subset + np.arange(n1 * n2, dtype=U).reshape(n1, n2) * U(0x9E3779B97F4A7C15) + U((tag * FAMILIES + family) * 0x1000003 + 1), 5)
    return sig[used], int((used.all(1)).sum()) - bands.distance(tag) // 2


def signed(u: np.ndarray, bands: Bands) -> Iterator[tuple[int, np.ndarray, int]]:
    """(code of tag and family, signatures, slack) of a set under its own and the next tag. Without slack the tag's code is one more, a shared signature."""
    band = bands.of(len(u))
    for tag in (band, band + 1):
        if tag < len(bands.top):
            for family in range(bands.parts(tag)[2]):
                sig, slack = signatures(u, bands, tag, family)
                code = tag * FAMILIES + family
                yield code, sig if slack > 0 else np.r_[sig, np.array([code], U)], max(slack, 0)


def sketch(u: np.ndarray, lean: int = 4) -> np.ndarray:
    """Histogram of the hashes' leading bits; the L1 distance of two such never exceeds their sets' distance."""
    bits = max(4, math.ceil(math.log2(max(len(u), 1) / lean)))
    return np.minimum(np.bincount((u >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    a, b = a.astype(np.int64), b.astype(np.int64)
    while len(a) > len(b):
        a = a.reshape(-1, 2).sum(1)
    while len(b) > len(a):
        b = b.reshape(-1, 2).sum(1)
    return int(np.abs(a - b).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _documents(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        text, ids = as_text(batch.column(1)), batch.column(0)
        for lo, hi in chunks(text):
            yield from zip(ids.slice(lo, hi - lo).to_pylist(), shingle_sets(words(text.slice(lo, hi - lo)), size), strict=True)


def _base(size: int, salt: int):
    @released
    def run(batches):
        rows: list[tuple] = []
        for doc, u in _documents(batches, size):
            rows.append((doc, len(u), set_key(u, salt), set_key(u, salt + 1000), sketch(u).tobytes() if len(u) else b""))
            if len(rows) == 4096:
                yield _batch(rows, BASE)
                rows = []
        yield _batch(rows, BASE)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


BASE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("other", pa.int64()), ("sketch", pa.binary())])


def _signature_rows(size: int, bands: Bands, buckets: int, salt: int):
    # Five bytes of a signature, besides its bucket: those that coincide are candidates more, no links.
    schema = pa.schema([("bucket", pa.int32()), ("sig", pa.binary()), ("high", pa.binary()), ("count", pa.binary()), ("key", pa.binary()), ("slack", pa.binary()), ("tag", pa.binary())])

    def packed(parts):
        sig, key, slack, tag = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = (((sig >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        sig, key, slack, tag = sig[order], key[order], slack[order], tag[order]
        low, high = sig.astype(np.uint32), (sig >> U(32)).astype(np.uint8)
        rows = []
        for b, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            if y > x:  # entries of a set under a tag stand together
                first = x + np.flatnonzero(np.r_[True, (key[x + 1:y] != key[x:y - 1]) | (tag[x + 1:y] != tag[x:y - 1])])
                size = np.diff(np.r_[first, y])
                if size.max() > 255:
                    first = np.concatenate([np.arange(f, f + m, 255) for f, m in zip(first, size, strict=True)])
                count = np.diff(np.r_[first, y]).astype(np.uint8)
                rows.append((b, low[x:y].tobytes(), high[x:y].tobytes(), count.tobytes(), key[first].tobytes(), slack[first].tobytes(), tag[first].tobytes()))
        return _batch(rows, schema)

    @released
    def run(batches):
        parts, held = [], 0
        for _, u in _documents(batches, size):
            if not len(u):
                continue
            key = set_key(u, salt)
            for code, sig, slack in signed(u, bands):
                m = len(sig)
                parts.append((sig, np.full(m, key, np.int64), np.full(m, min(slack, 255), np.uint8), np.full(m, code, np.uint16)))
                held += m
            if held >= FLUSH:
                yield packed(parts)
                parts, held = [], 0
        if parts:
            yield packed(parts)

    return run, "bucket int, sig binary, high binary, count binary, key binary, slack binary, tag binary"


CANDIDATE = pa.schema([("tag", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("hot", pa.int64()), ("slack", pa.int64())])


def _collisions(limit: int):
    """Rows of one bucket after the other -> candidate pairs (tag null), or hot signature counts of a set under a tag (b null).

    A signature of at most ``limit`` sets gives its pairs; of a more frequent one each set is paired
    with one of them, the pivot. A bucket stays packed as it came, and its signatures are unpacked one
    slice of their range after the other.
    """
    entry = np.dtype([("sig", U), ("key", np.int64), ("slack", np.uint8), ("tag", np.uint16)])
    count_of = np.dtype([("key", np.int64), ("tag", np.uint16), ("slack", np.uint8), ("n", np.int64)])
    packed = {"sig": np.uint32, "high": np.uint8, "count": np.uint8, "key": np.int64, "slack": np.uint8, "tag": np.uint16}
    nothing = (np.zeros(0, U), np.zeros(0, np.int64))

    def groups(y):
        first = np.flatnonzero(np.r_[True, y["sig"][1:] != y["sig"][:-1]]) if len(y) else np.zeros(0, np.int64)
        return first, np.diff(np.r_[first, len(y)])

    def compact(parts, hot):
        """Distinct entries by signature: single ones, those of a few sets, those of hot signatures; and the hot signatures with pivots."""
        x = np.concatenate(parts)
        x = x[np.argsort(x["sig"], kind="stable")]
        first, count = groups(x)
        keep = np.repeat((count > 1) | (x["sig"][first] < PLAIN) | np.isin(x["sig"][first], hot[0]), count)
        rest, y = x[~keep], x[keep]
        y = y[np.lexsort((y["key"], y["sig"]))]
        if len(y):
            y = y[np.r_[True, (y["sig"][1:] != y["sig"][:-1]) | (y["key"][1:] != y["key"][:-1])]]
        first, count = groups(y)
        known = np.isin(y["sig"][first], hot[0])
        high = (count > limit) | (y["sig"][first] < PLAIN) | known
        new = first[high & ~known]
        sig = np.r_[hot[0], y["sig"][new]]
        order = np.argsort(sig)
        mask = np.repeat(high, count)
        return rest, y[~mask], y[mask], (sig[order], np.r_[hot[1], y["key"][new]][order])

    def distinct(pairs):
        p = np.concatenate(pairs)
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        return p[np.r_[True, (p[1:] != p[:-1]).any(1)]]

    def counted(rows):
        """One row for each set and tag, with the sum of n."""
        z = np.sort(np.concatenate(rows), order=["key", "tag"])
        first = np.flatnonzero(np.r_[True, (z["key"][1:] != z["key"][:-1]) | (z["tag"][1:] != z["tag"][:-1])])
        n = np.add.reduceat(z["n"], first)
        z = z[first]
        z["n"] = n
        return z

    def of_hot(y, hot):
        """Counts by set and tag of the entries of hot signatures, and their pairs with the pivots."""
        z = np.ones(len(y), count_of)
        for name in ("key", "tag", "slack"):
            z[name] = y[name]
        y = y[y["sig"] >= PLAIN]
        pivot = hot[1][np.searchsorted(hot[0], y["sig"])]
        apart = pivot != y["key"]
        return counted([z]), np.stack([np.minimum(pivot, y["key"])[apart], np.maximum(pivot, y["key"])[apart]], 1)

    def of_few(y):
        """All pairs within each signature."""
        first, count = groups(y)
        for c in np.unique(count[count > 1]):
            at = first[count == c]
            i, j = np.triu_indices(int(c), 1)
            yield np.stack([y["key"][(at[:, None] + i).ravel()], y["key"][(at[:, None] + j).ravel()]], 1)

    def unpacked(parts):
        """Entries of the packed parts, one slice of the signatures' range after the other."""
        low, high, count, key, slack, tag = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        owner = np.repeat(np.arange(len(count), dtype=np.int32), count)
        piece = (low >> np.uint32(SLICE_SHIFT)).astype(np.uint8)
        for s in range(SLICES):
            at = np.flatnonzero(piece == s)
            own, x = owner[at], np.empty(len(at), entry)
            x["sig"] = low[at] | (high[at].astype(U) << U(32))
            x["key"], x["slack"], x["tag"] = key[own], slack[own], tag[own]
            yield x

    def stretches(batches):
        """(bucket, packed columns) of consecutive rows of one bucket, of at most ``STRETCH`` entries (one row at least)."""
        for batch in batches:
            ids = batch.column(0).to_numpy()
            edge = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                for lo, hi in chunks(batch.column("high").slice(i, j - i), STRETCH):
                    part = []
                    for name, kind in packed.items():
                        off, raw = byte_offsets(batch.column(name)), np.frombuffer(batch.column(name).buffers()[2], np.uint8)
                        part.append(raw[off[i + lo] : off[i + hi]].view(kind))
                    yield int(ids[i]), part

    @released
    def run(batches):
        bucket, bound = None, HELD
        parts = []  # packed, not looked at
        kept = []  # of each slice: entries of signatures that aren't hot, and hot signatures

        def taken(last):
            nonlocal kept
            stay, hots, found = [], [], []
            for x, (old, hot) in zip(unpacked(parts) if parts else (np.zeros(0, entry) for _ in range(SLICES)), kept or [([], nothing)] * SLICES, strict=True):
                rest, few, many, hot = compact([*old, x], hot)
                if len(many):
                    counts, pairs = of_hot(many, hot)
                    hots.append(counts)
                    found.append(pairs)
                if last:
                    found.extend(of_few(few))
                else:
                    stay.append(([rest, few], hot))
                found = [distinct(found)] if sum(map(len, found)) else []
            kept = stay
            if hots:
                z = counted(hots)
                yield pa.record_batch([pa.array(z["tag"], pa.int32()), pa.array(z["key"]), pa.nulls(len(z), pa.int64()), pa.array(z["n"]), pa.array(z["slack"], pa.int64())], schema=CANDIDATE)
            if found:
                p, none = found[0], pa.nulls(len(found[0]), pa.int64())
                yield pa.record_batch([pa.nulls(len(p), pa.int32()), pa.array(p[:, 0]), pa.array(p[:, 1]), none, none], schema=CANDIDATE)

        held = 0
        for at, part in stretches(batches):
            if at != bucket:
                if bucket is not None:
                    yield from taken(True)
                bucket, held, bound = at, 0, HELD
            parts.append(part)
            held += len(part[1])
            if held > bound:  # keeps memory bounded when one signature fills the bucket
                yield from taken(False)
                held = sum(len(x) for old, _ in kept for x in old)
                bound = max(HELD, 2 * held)
        if bucket is not None:
            yield from taken(True)

    return run


def _resigned(bands: Bands):
    """(key, comp, u) -> tag, sig, key, comp, slack: the signatures of dense sets once more."""

    @released
    def run(batches):
        schema = pa.schema([("tag", pa.int32()), ("sig", pa.int64()), ("key", pa.int64()), ("comp", pa.int64()), ("slack", pa.int64())])
        for batch in batches:
            for key, comp, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for code, sig, slack in signed(np.frombuffer(u.as_py(), U), bands):
                    m = len(sig)
                    yield pa.record_batch([pa.array(np.full(m, code, np.int32)), pa.array(sig.view(np.int64)), *(pa.array(np.full(m, x, np.int64)) for x in (key, comp, min(slack, 255)))], schema=schema)

    return run, "tag int, sig long, key long, comp long, slack long"


def _close(percent: int):
    """Drop candidate pairs whose sizes or histograms rule the threshold out."""

    @released
    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            most = (na + nb) * (100 - percent) // (100 + percent)
            keep = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent
            sa, sb = batch.column("sa"), batch.column("sb")
            for i in np.flatnonzero(keep):
                keep[i] = sketch_distance(np.frombuffer(sa[int(i)].as_py(), np.uint8), np.frombuffer(sb[int(i)].as_py(), np.uint8)) <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verified(percent: int):
    @released
    def run(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U), percent) for x, y in zip(batch.column("ua"), batch.column("ub"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(percent: int):
    """Edges that connect similar sets of one pair of blocks; sets of one component are not compared."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        keys, block = table.column("key").to_numpy(), table.column("block").to_numpy()
        sets = [np.frombuffer(x.as_py(), U) for x in table.column("u")]
        n = np.array([len(u) for u in sets])
        bits = max(4, math.ceil(math.log2(max(int(n.min()), 1) / 4)))
        hist = np.stack([np.minimum(np.bincount((u >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255) for u in sets]).astype(np.int16)
        label, edges = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1], []
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for x in left:
            ys = right[right > x] if i == j else right
            ys = ys[label[ys] != label[x]]
            ys = ys[np.minimum(n[ys], n[x]) * 100 >= np.maximum(n[ys], n[x]) * percent]
            for lo in range(0, len(ys), 512):
                some = ys[lo : lo + 512]
                far = np.abs(hist[some] - hist[x]).sum(1, dtype=np.int64)
                for y in some[far <= (n[some] + n[x]) * (100 - percent) // (100 + percent)]:
                    if label[y] != label[x] and similar(sets[x], sets[y], percent):
                        edges.append((min(keys[x], keys[y]), max(keys[x], keys[y])))
                        label[label == label[y]] = label[x]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = 80, shingle: int = 5, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, text) -> one row per input row: doc_id, n_shingles, component_id.

    Two texts link when 100 * |common shingles| >= percent * |all their shingles|; component_id is the
    least doc_id reachable by links. Nulls, empty texts and texts without words have n_shingles 0 and
    stay alone. Equal sets (repeated rows included) link. A row whose doc_id is null is returned with
    its count, links nothing and has no component. An empty table gives no rows; columns other than
    doc_id and text are not read.
    """
    spark, bands, parts = docs.sparkSession, Bands(percent), partitions(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = source.filter("doc_id is not null")
    salt, clashes = -1, True
    while clashes:  # two sets with one key but different second keys: other keys for all
        salt += 1
        with small_batches(spark):
            base = scratch.save(source.mapInArrow(_base(shingle, salt), "doc_id long, n long, key long, other long, sketch binary"), f"base-{salt}")
        nodes = base.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("size"), F.count("*").alias("n"), (F.min("other") < F.max("other")).alias("clash"))
        nodes, seen = scratch.measured(nodes, f"nodes-{salt}", F.count_if("clash").alias("clashes"))
        clashes = seen["clashes"] > 0
    rows = base.select("doc_id", F.col("n").alias("n_shingles"), "key")
    groups, nodes = nodes.select("key", "n"), nodes.filter("rep is not null").select("key", "rep", F.col("size").alias("n"))

    build, schema = _signature_rows(shingle, bands, parts * SPREAD, salt)
    dealt = known.select("doc_id", "text").mapInArrow(build, schema).repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    with small_batches(spark):
        found = scratch.save(dealt.mapInArrow(_collisions(group_limit), "tag int, a long, b long, hot long, slack long"), "found")

    heads = base.join(nodes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"]).groupBy("key").agg(F.max("n").alias("n"), F.first("sketch").alias("s"))
    pairs = found.filter("b is not null").select("a", "b").distinct()
    pairs = scratch.save(pairs, "candidates")
    pairs = spread_join(pairs, heads.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a", "b", scratch, "head-a")
    pairs = spread_join(pairs, heads.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b", "a", scratch, "head-b")
    pairs = scratch.save(pairs.mapInArrow(_close(percent), "a long, b long"), "pairs")

    def in_all_families(signs: DataFrame) -> DataFrame:
        """(tag, key) of sets whose signatures in ``signs`` leave no slack in any family of the tag."""
        tags = signs.groupBy("tag", "key").agg(F.sum("hot").alias("hot"), F.max("slack").alias("slack")).filter("hot >= slack")
        tags = tags.groupBy(F.floor(F.col("tag") / FAMILIES).cast("int").alias("tag"), "key").agg(F.count("*").alias("families"))
        return tags.filter(F.col("families") == F.when(F.col("tag") < bands.small, FAMILIES).otherwise(1)).select("tag", "key")

    dense, seen = scratch.measured(in_all_families(found.filter("b is null").withColumnRenamed("a", "key")), "dense", F.count("*").alias("n"))
    some_dense = seen["n"] > 0

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(dense.select("key")).distinct()
    wanted, seen = scratch.measured(wanted.join(nodes, "key").select("key", F.col("rep").alias("doc_id")), "wanted", F.count("*").alias("n"))
    few = seen["n"] <= BROADCAST_ROWS
    texts = known.join(F.broadcast(wanted.select("doc_id")) if few else wanted.select("doc_id"), "doc_id", "left_semi")

    @released
    def sets(batches):
        for batch in batches:
            made = [(set_key(u, salt), u.tobytes()) for _, u in _documents([batch], shingle) if len(u)]
            for lo in range(0, len(made), 256):
                yield _batch(made[lo : lo + 256], pa.schema([("key", pa.int64()), ("u", pa.binary())]))

    stored = texts.mapInArrow(sets, "key long, u binary").join(wanted.select("key"), "key", "left_semi")
    with small_batches(spark):
        stored = scratch.save(stored.dropDuplicates(["key"]), "sets")
    left, right = stored.select(F.col("key").alias("a"), F.col("u").alias("ua")), stored.select(F.col("key").alias("b"), F.col("u").alias("ub"))

    def checked(p: DataFrame, name: str) -> DataFrame:
        p = spread_join(spread_join(p, left, "a", "b", scratch, f"{name}-a"), right, "b", "a", scratch, f"{name}-b")
        return p.mapInArrow(_verified(percent), "a long, b long")

    # Each set against its least candidate first; pairs that those links connect already need no check.
    least = scratch.save(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "least-candidates")
    stars = scratch.save(checked(least, "star"), "stars")
    label = stars.select(F.col("b").alias("x"), F.col("a").alias("l"))
    up = Names(label.groupBy(F.col("x").alias("l")).agg(F.min("l").alias("up"), F.count("*").alias("n")), scratch, "up", BROADCAST_ROWS)
    label = up.join(label, ["l"], "left").select("x", F.coalesce("up", "l").alias("l"))
    # As many rows behind a name as it has pairs, so that a pivot's pairs don't meet in one task.
    of = lambda c, l: Names(pairs.groupBy(F.col(c)).agg(F.count("*").alias("n")).join(label.select(F.col("x").alias(c), F.col("l").alias(l)), c), scratch, f"labels-{c}", BROADCAST_ROWS)
    open_pairs = of("b", "lb").join(of("a", "la").join(pairs, ["a"], "left"), ["b"], "left")
    open_pairs = open_pairs.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    edges = scratch.save(stars.unionByName(checked(scratch.save(open_pairs.join(stars, ["a", "b"], "left_anti"), "open"), "open")), "edges")
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    component = connected_components(edges, scratch)

    if some_dense:
        # A frequent signature whose dense sets are all connected is settled; sets with enough others are compared in blocks.
        comp = component.select(F.col("node").alias("key"), F.col("component").alias("comp"))
        dense_sets = stored.join(dense.select("key").distinct(), "key").join(comp, "key", "left").select("key", F.coalesce("comp", "key").alias("comp"), "u")
        make, schema = _resigned(bands)
        signs = dense_sets.mapInArrow(make, schema)
        unsettled = signs.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("sig")
        unsettled, seen = scratch.measured(unsettled, "unsettled", F.count("*").alias("n"))
        if seen["n"]:
            hit = signs.join(F.broadcast(unsettled) if seen["n"] <= BROADCAST_ROWS else unsettled, "sig", "left_semi")
            left_over = in_all_families(hit.select("tag", "key", F.lit(1).alias("hot"), "slack")).join(dense, ["tag", "key"], "left_semi")
            left_over = scratch.save(left_over, "left-over")
            count = left_over.join(nodes.select("key", "n"), "key").groupBy("tag").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
            dealt = left_over.join(F.broadcast(count), "tag").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            dealt = dealt.select("tag", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
            links = dealt.join(dense_sets, "key").groupBy("tag", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
            links, seen = scratch.measured(links, "block-links", F.count("*").alias("n"))
            if seen["n"]:
                component = connected_components(edges.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), scratch, "cc2")

    component = component.join(nodes.select(F.col("key").alias("node"), "rep"), "node")
    least = Names(component.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n")), scratch, "least", BROADCAST_ROWS)
    linked = least.join(component, ["component"]).select(F.col("node").alias("key"), "least")
    of_key = nodes.join(linked, "key", "left").select("key", F.coalesce("least", "rep").alias("least")).join(groups, "key")
    out = Names(of_key, scratch, "classes", BROADCAST_ROWS).join(rows.filter("n_shingles > 0 and doc_id is not null"), ["key"])
    out = out.select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return out.unionByName(rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id")))
