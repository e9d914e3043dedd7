"""Subword sampling without replacement over SentencePiece lattices, and exact decoding.

Text gets the usual leading word mark. A word starts at each mark that no other mark precedes, and if no
piece has a mark after another character, no piece crosses into the next word, so a document's lattice
is the chain of its words' lattices (with such pieces the whole text is one word). A perturbed A-star search emits the k
segmentations with the largest Gumbel-perturbed log-probabilities: the agenda holds subtrees ("the
path so far up to a piece, then another piece than those taken"), their exact log-mass is the bound,
the best one is popped and its best leaf drawn; the sets left beside the drawn path get Gumbels
truncated at the popped value. That is sampling without replacement, seeded by the row's key. With
the k+1-th value a segmentation's inclusion score is 1 - exp(-exp(log_prob - that value)).

All documents of a chunk advance together in numpy; nothing depends on how rows are dealt.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens.llm.textkernel import U, as_text, chunks, mix, released, run_hashes

MARK = 0x2581
NONE, BYTES = -1, -2
MOST = 62  # characters of a piece: barred sizes are bits of a long
SAMPLE = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int32()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("decoded", pa.bool_())])
SAMPLE_DDL = "doc_id long, sample int, ids array<int>, n_pieces int, log_prob double, perturbed double, inclusion double, decoded boolean"


def _grow(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one code point longer."""
    return mix(h + (points.astype(U) + U(1)) * U(0x9E3779B97F4A7C15), 51)


class Vocabulary:
    """Pieces by hash of their code points, log-weights, and bytes for decoding."""

    def __init__(self, path: str, slots: int = 1 << 19):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces, score = [sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if len({float(score[i]).is_integer() for i in plain}) == 1 and float(score[plain[-1]]).is_integer():
            rank = score[plain].max() - score[plain]  # merge ranks: frequency falls about as 1 / rank
            score[plain] = -np.log(rank + 1) - np.log(np.sum(1 / (rank + 1)))
        self.weight, self.floor = score, float(score[plain].min()) - 10
        self.longest = max(len(pieces[i]) for i in plain)
        if self.longest > MOST:
            raise ValueError(f"pieces of over {MOST} characters are not supported")
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.breaks = not any("\n" in pieces[i] for i in plain)
        self.crosses = any("▁" in pieces[i].lstrip("▁") for i in plain)
        self.shift, self.mask = U(64 - int(np.log2(slots))), slots - 1
        h, rows, made = np.zeros(len(plain), U), np.arange(len(plain)), []
        for size in range(1, self.longest + 1):
            rows = rows[[len(pieces[plain[r]]) >= size for r in rows]]
            h[rows] = _grow(h[rows], np.array([ord(pieces[plain[r]][size - 1]) for r in rows]))
            whole = np.array([len(pieces[plain[r]]) == size for r in rows])
            made.append((h[rows], np.where(whole, np.array(plain)[rows], NONE), ~whole))
        key, where = np.unique(np.concatenate([m[0] for m in made]), return_inverse=True)
        ids, more = np.full(len(key), NONE, np.int32), np.zeros(len(key), bool)
        np.maximum.at(ids, where, np.concatenate([m[1] for m in made]).astype(np.int32))
        np.logical_or.at(more, where, np.concatenate([m[2] for m in made]))
        self.key, self.id, self.more, self.used = np.zeros(slots, U), np.full(slots, NONE, np.int32), np.zeros(slots, bool), np.zeros(slots, bool)
        at, todo = self.slot(key), np.arange(len(key))
        while len(todo):
            free = todo[~self.used[at[todo]]]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.used[at[put]], self.key[at[put]], self.id[at[put]], self.more[at[put]] = True, key[put], ids[put], more[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask
        raw = [b""] * n
        for i in plain:
            raw[i] = pieces[i].replace("▁", " ").encode()
        for b in range(256):
            raw[self.byte[b]] = bytes([b])
        self.raw_start = np.r_[0, np.cumsum([len(x) for x in raw])]
        self.raw_size = np.diff(self.raw_start)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece of each hash (or NONE), and whether a longer piece starts so."""
        at = self.slot(h)
        todo = np.flatnonzero((self.key[at] != h) & self.used[at])
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            todo = todo[(self.key[at[todo]] != h[todo]) & self.used[at[todo]]]
        here = self.key[at] == h
        return np.where(here, self.id[at], NONE), here & self.more[at]

    def pieces(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a piece sequence, and how many each piece has."""
        start, size = self.raw_start[ids], self.raw_size[ids]
        before = np.cumsum(size) - size
        return self.raw[np.repeat(start - before, size) + np.arange(size.sum())], size

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a piece sequence without the leading word mark."""
        return self.pieces(ids)[0].tobytes()[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """Chain of word lattices of a chunk: for each position of each distinct word the next piece's probabilities."""

    def __init__(self, texts: list[str], v: Vocabulary, alpha: float):
        # A literal word mark would decode to a space: it goes by bytes, as a point outside Unicode here.
        joined = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        size = np.array([len(j) + 1 if len(j) else 0 for j in joined])
        points = np.empty(size.sum(), np.int64)
        self.doc_at = np.r_[0, np.cumsum(size)]
        for j, at in zip(joined, self.doc_at, strict=False):
            if len(j):
                points[at] = MARK
                points[at + 1 : at + 1 + len(j)] = np.where(j == 32, MARK, np.where(j == MARK, 0x110000, j))
        begins = np.zeros(len(points), bool)
        begins[self.doc_at[:-1][size > 0]] = True
        if not v.crosses:
            mark = points == MARK
            begins[1:] |= mark[1:] & ~mark[:-1]
        if v.breaks:
            begins |= points == 10
        start = np.flatnonzero(begins)
        self.first = np.searchsorted(start, self.doc_at)  # first word of each document
        end = np.r_[start[1:], len(points)] if len(start) else start
        _, where, uid = np.unique(run_hashes(points, start, end), return_index=True, return_inverse=True)
        length = (end - start)[where]
        base = np.r_[0, np.cumsum(length)]
        n = int(base[-1])
        self.start, self.stop = base[:-1][uid], base[1:][uid]  # of each word, in the distinct words' text
        self.points = points[np.arange(n) + np.repeat(start[where] - base[:-1], length)] if n else points
        self._fill(v, alpha, np.repeat(base[1:], length) - np.arange(n))

    def _fill(self, v: Vocabulary, alpha: float, left: np.ndarray) -> None:
        """Options (pieces that match) of every position, those nearest to their word's end first: size, id, log-probability, distribution."""
        n = len(left)
        rows, h, found = np.arange(n, dtype=np.int32), np.zeros(n, U), []
        many = np.zeros(n, np.int32)
        left = left.astype(np.int32)
        for size in range(1, v.longest + 1):
            h = _grow(h, self.points[rows + size - 1])
            got, more = v.find(h)
            if size == 1:
                got[got == NONE] = BYTES
            hit = got != NONE
            found.append((rows[hit], got[hit]))
            many[found[-1][0]] += 1
            on = more & (left[rows] > size)
            rows, h = rows[on], h[on]
        order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 65536 else left, kind="stable")
        edge = np.r_[0, np.cumsum(many[order])]
        self.lo, self.hi = np.empty(n, np.int32), np.empty(n, np.int32)
        self.lo[order], self.hi[order] = edge[:-1], edge[1:]
        self.size, self.id, row = np.empty(edge[-1], np.int32), np.empty(edge[-1], np.int32), np.empty(edge[-1], np.int32)
        free = self.lo.copy()
        for size, (at, got) in enumerate(found, 1):
            e = free[at]
            self.size[e], self.id[e], row[e] = size, got, at
            free[at] += 1
        target = np.where(left[row] == self.size, n, row + self.size)
        lp = alpha * np.where(self.id == BYTES, v.floor, v.weight[np.maximum(self.id, 0)])
        after = np.zeros(n + 1)
        far = left[order]
        step = np.r_[np.flatnonzero(np.r_[True, far[1:] != far[:-1]]), n] if n else [0]
        for a, b in zip(step[:-1], step[1:], strict=True):
            lo, hi = edge[a], edge[b]
            at = edge[a:b] - lo
            t = lp[lo:hi] + after[target[lo:hi]]
            most = np.maximum.reduceat(t, at)
            total_here = most + np.log(np.add.reduceat(np.exp(t - np.repeat(most, np.diff(edge[a : b + 1]))), at))
            after[order[a:b]] = total_here
            lp[lo:hi] = t
        self.lp = lp - after[row]
        with np.errstate(divide="ignore"):
            self.rest = np.log(-np.expm1(np.minimum(self.lp, 0.0)))
        c = np.cumsum(np.exp(self.lp))
        self.below = c - np.repeat(np.r_[0.0, c][edge[:-1]], np.diff(edge))

    def draw(self, at: np.ndarray, stop: np.ndarray, key: np.ndarray, barred: np.ndarray):
        """Draw each row's pieces from its position to its word's end; ``barred`` bits exclude sizes at the first.

        Returns per piece: row, step, option, log-mass of the sizes neither taken nor barred.
        """
        at, live, step, out = at.copy(), np.arange(len(at)), 0, []
        while len(live):
            here = at[live]
            option, last = self.lo[here], self.hi[here] - 1
            u = uniform(mix(key[live] + U(step), 61))
            todo = np.flatnonzero(option < last)
            while len(todo):
                todo = todo[self.below[option[todo]] <= u[todo]]
                option[todo] += 1
                todo = todo[option[todo] < last[todo]]
            rest = self.rest[option]
            if step == 0:
                for i in np.flatnonzero(barred):
                    e = np.arange(self.lo[here[i]], self.hi[here[i]])
                    e = e[(int(barred[i]) >> (self.size[e] - 1)) & 1 == 0]
                    p = np.exp(self.lp[e])
                    pick = min(int(np.searchsorted(np.cumsum(p), u[i] * p.sum(), side="right")), len(e) - 1)
                    option[i] = e[pick]
                    p[pick] = 0.0
                    rest[i] = np.log(p.sum()) if p.any() else -np.inf
            out.append((live, np.full(len(live), step), option, rest))
            at[live] = here + self.size[option]
            live = live[at[live] < stop[live]]
            step += 1
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0),)
        count = np.bincount(np.concatenate([o[0] for o in out]), minlength=len(at))
        place = np.r_[0, np.cumsum(count)[:-1]]
        columns = [np.empty(int(count.sum()), c.dtype) for c in out[0]]
        for o in out:
            where = place[o[0]] + o[1]
            for target, c in zip(columns, o, strict=True):
                target[where] = c
        return tuple(columns)


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _truncated(mass: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels at location ``mass``, given that none exceeds ``most``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = mass - np.logaddexp(mass - most, np.log(-np.log(u)))
    return np.where(np.isneginf(mass), -np.inf, g)


def sample_segmentations(texts: list[str], keys: np.ndarray, v: Vocabulary, k: int, alpha: float = 1.0) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(text index, sample from 1, ids, log-probability, perturbed value, inclusion score) of up to k distinct segmentations of each text."""
    lattice = Lattice(texts, v, alpha)
    n, first = len(texts), lattice.first
    keys = mix(keys.astype(U), 60)
    root = -np.log(-np.log(uniform(mix(keys, 62))))
    # An agenda entry: -value, tie breaker, path, piece index of the branch, barred sizes there, log-probability before it.
    agenda: list[list[tuple]] = [[(-g, 0, -1, 0, 0, 0.0)] for g in root.tolist()]
    paths: list[list[tuple]] = [[] for _ in range(n)]
    for turn in range(k):
        popped = [(d, heapq.heappop(agenda[d])) for d in range(n) if agenda[d]]
        if not popped:
            break
        doc = np.array([d for d, _ in popped])
        begin = np.array([first[d] if node[2] < 0 else paths[d][node[2]][0][node[3]] for d, node in popped])
        count = first[doc + 1] - begin
        lead = np.r_[0, np.cumsum(count)]
        word = np.arange(lead[-1]) + np.repeat(begin - lead[:-1], count)
        at, barred = lattice.start[word], np.zeros(len(word), np.int64)
        for i, (d, node) in enumerate(popped):
            if node[2] >= 0:
                at[lead[i]], barred[lead[i]] = paths[d][node[2]][1][node[3]], node[4]
        key = mix((word - np.repeat(first[doc], count)).astype(U) * U(0x9E3779B97F4A7C15) + np.repeat(keys[doc], count), 63 + turn)
        row, step, option, rest = lattice.draw(at, lattice.stop[word], key, barred)
        edge = np.searchsorted(row, lead)
        long = np.diff(edge)
        lp, size = lattice.lp[option], lattice.size[option]
        total = np.r_[0.0, np.cumsum(lp)]
        start = np.array([node[5] for _, node in popped])
        before = total[:-1] + np.repeat(start - total[edge[:-1]], long)
        whole = start + total[edge[1:]] - total[edge[:-1]]
        moved = np.cumsum(size) - size
        place = at[row] + moved - np.repeat(moved[np.searchsorted(row, np.arange(len(at)))], np.bincount(row, minlength=len(at))) if len(row) else row
        value = np.array([-node[0] for _, node in popped])
        noise = uniform(mix(key[row] + U(1 << 40) * step.astype(U), 90))
        beside = _truncated(before + rest, np.repeat(value, long), noise)
        words_of = word[row]
        for i, (d, node) in enumerate(popped):
            lo, hi = int(edge[i]), int(edge[i + 1])
            here, want = beside[lo:hi], k - turn
            best = range(hi - lo) if hi - lo <= want else np.argpartition(-here, want - 1)[:want].tolist()
            for j in best:
                if here[j] > -np.inf:  # the first new piece's siblings leave out the sizes barred before as well
                    bar = (node[4] if j == 0 else 0) | 1 << int(size[lo + j] - 1)
                    heapq.heappush(agenda[d], (-float(here[j]), (turn, j), len(paths[d]), node[3] + j, bar, float(before[lo + j])))
            path = (words_of[lo:hi], place[lo:hi], option[lo:hi])
            if node[2] >= 0:
                path = tuple(np.concatenate([old[: node[3]], new]) for old, new in zip(paths[d][node[2]], path, strict=False))
            paths[d].append((*path, float(whole[i]), float(value[i])))
    for d in range(n):
        bound = -agenda[d][0][0] if agenda[d] else -np.inf
        for s, (_, place, option, log_prob, g) in enumerate(paths[d], 1):
            inclusion = 1.0 if bound == -np.inf else float(-np.expm1(-np.exp(min(log_prob - bound, 700.0))))
            yield d, s, _ids(lattice, v, place, option), log_prob, g, inclusion


def _ids(lattice: Lattice, v: Vocabulary, place: np.ndarray, option: np.ndarray) -> np.ndarray:
    ids = lattice.id[option]
    plain = np.flatnonzero(ids == BYTES)
    if not len(plain):
        return ids
    code = lattice.points[place[plain]]
    if code.max() < 0x80:
        ids = ids.copy()
        ids[plain] = v.byte[code]
        return ids
    parts, last = [], 0
    for i, c in zip(plain.tolist(), lattice.points[place[plain]].tolist(), strict=True):
        parts += [ids[last:i], v.byte[np.frombuffer(chr(MARK if c == 0x110000 else c).encode("utf-8", "surrogatepass"), np.uint8)]]
        last = i + 1
    return np.concatenate([*parts, ids[last:]])


def encode_samples(docs: DataFrame, model_path: str, k: int = 2, alpha: float = 1.0, key: str = "doc_id", chunk_bytes: int = 1 << 19) -> DataFrame:
    """(key, text) -> doc_id, sample (from 1, by falling perturbed value), ids, n_pieces, log_prob, perturbed, inclusion, decoded.

    One row per document and distinct segmentation, fewer than ``k`` where there are fewer; inclusion is
    then 1. ``decoded`` tells that decoding the ids gave the text's bytes back. Null and empty texts
    have one empty segmentation. A null key is seeded as 0 and stays null; repeated rows repeat their
    samples. ``model_path`` must be readable on every executor. Characters outside the vocabulary go
    by byte pieces; a literal word mark does too. Pieces of over 62 characters are an error. Other columns are not read; an empty table gives no rows.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]):
        v = vocabulary(model_path)
        for batch in batches:
            text, keys = as_text(batch.column(1)), batch.column(0)
            for lo, hi in chunks(text, chunk_bytes):
                texts, ids = text.slice(lo, hi - lo).to_pylist(), keys.slice(lo, hi - lo)
                seeds = ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
                rows = list(sample_segmentations(texts, seeds, v, k, alpha))
                raw = [t.encode() for t in texts]
                size = np.array([len(r[2]) for r in rows], np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *(r[2] for r in rows)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat))
                back, long = v.pieces(flat)
                end = np.r_[0, np.cumsum(long)][np.cumsum(size)] if len(size) else size
                back, first = back.tobytes(), np.r_[0, end]
                decoded = [back[a + 1 : b] == raw[r[0]] for r, a, b in zip(rows, first[:-1].tolist(), end.tolist(), strict=True)]
                own = ids.take(pa.array([r[0] for r in rows], pa.int64()))
                columns = [own, pa.array([r[1] for r in rows], pa.int32()), lists, pa.array(size), *(pa.array([r[c] for r in rows], pa.float64()) for c in (3, 4, 5)), pa.array(decoded, pa.bool_())]
                yield pa.record_batch(columns, schema=SAMPLE)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SAMPLE_DDL)


def decode_samples(samples: DataFrame, model_path: str) -> DataFrame:
    """Adds ``text``, decoded from ``ids`` (null ids decode to null), to doc_id and sample."""

    def run(batches: Iterator[pa.RecordBatch]):
        v = vocabulary(model_path)
        for batch in batches:
            ids = batch.column(2)
            text = [None if x is None else v.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in ids.to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["doc_id", "sample", "text"])

    return samples.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id long, sample int, text string")
