"""Collocations of each language: best-first branch and bound over phrases that grow to the right.

A phrase of words w1..wm occurs a times. Each cut after k words compares a with its parts, l = f(w1..wk)
and r = f(the rest), by 1000 * a * n / (l * r); the lowest cut counts. As a <= r, no phrase that starts
with a prefix can score over 1000 * n / f(prefix), least for the shortest one: 1000 * n / f(w1). So first
words are expanded from the rarest on, in bands; a band's phrases grow word by word while they occur
often enough, and no further band is begun once a language's ``top``-th surviving score is above the
bound of its next word. Equal scores and bounds are still expanded, so ties are complete.

The corpus is coded once: chunks of word codes with their own vocabulary, without words that are too rare
for any phrase. Each round sends a bounded number of phrases as a trie to all chunks; the counts of their
next words, of parts and of words before are summed by Spark. Words are told apart by 64-bit hashes of (language,
word), which are checked to be unique; if two clash, all are drawn anew. The frequent ones are then numbered in order
of their hashes, as small numbers take less room in shuffles; tasks read these numbers from the shared folder in sorted
parts, so the chunks themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formlens.llm.common import Names, Scratch, row_numbers, small_batches
from formlens.llm.textkernel import LOWER, U, as_text, byte_offsets, chunks, mix, released, run_hashes

CHUNK = 1 << 21  # bytes of text coded together
FILE = 8  # chunks of a stored file: Spark reads those of a file's row group at once, which else would be all of a task
SLICE = 1 << 17  # phrases sent to the chunks at once
BAND = 1 << 12  # first words of each language in the first band; each further one has four times as many
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = BREAK.copy()
GAP[[32, 9]] = True

TERM = pa.struct([("lang", pa.string()), ("word", pa.string()), ("hash", pa.int64()), ("n", pa.int64())])
CODED = pa.schema([("terms", pa.list_(TERM)), ("wide", pa.bool_()), ("codes", pa.binary()), ("starts", pa.binary())])
CODED_DDL = "terms array<struct<lang:string,word:string,hash:long,n:long>>, wide boolean, codes binary, starts binary"
LEAN = pa.schema([("vocab", pa.binary()), ("wide", pa.bool_()), ("codes", pa.binary()), ("starts", pa.binary())])
LEAN_DDL = "vocab binary, wide boolean, codes binary, starts binary"
COUNTS_DDL = "node int, side int, word long, n long"
PHRASE_DDL = "node int, lang string, words array<long>, pre array<long>"
HERE, AFTER, BEFORE = 1, 2, 4  # what is counted at a node: itself, the words after it, the words before it


def _unpack(wide: bool, codes: bytes | pa.Buffer, starts: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer(codes, np.uint32 if wide else np.uint16).astype(np.int64)
    return code, np.unpackbits(np.frombuffer(starts, np.uint8), count=len(code)).astype(bool)


def _pack(code: np.ndarray, starts: np.ndarray, size: int) -> tuple[bool, bytes, bytes]:
    wide = size > 1 << 16
    return wide, code.astype(np.uint32 if wide else np.uint16).tobytes(), np.packbits(starts).tobytes()


def code_chunk(text: pa.Array, lang: np.ndarray, names: list[str], salt: int) -> tuple[pa.Array, bool, bytes, bytes]:
    """Terms, codes and starts of pieces of a chunk; ``lang`` has the language's hash of each text, ``names`` its name."""
    off = byte_offsets(text).astype(np.int64)
    raw = np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]]
    off, data, gap = off - off[0], LOWER[raw], GAP[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(~gap & (np.r_[True, gap[:-1]] | edge[:-1]))
    end = np.flatnonzero(~gap & (np.r_[gap[1:], True] | edge[1:])) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    piece = np.cumsum(BREAK[raw])[start] + doc
    starts = np.r_[True, piece[1:] != piece[:-1]] if len(start) else np.zeros(0, bool)
    hashes = mix(run_hashes(data, start, end) + mix(lang[doc], 70 + 2 * salt), 71 + 2 * salt)
    vocab, first, code, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    size = (end - start)[first]
    cut = np.r_[0, np.cumsum(size)].astype(np.int32)
    flat = data[np.arange(cut[-1]) + np.repeat(start[first] - cut[:-1], size)]
    word = pa.StringArray.from_buffers(len(vocab), pa.py_buffer(cut), pa.py_buffer(flat))
    name = pa.array(names, pa.string()).take(pa.array(doc[first]))
    terms = pa.StructArray.from_arrays([name, word, pa.array(vocab.view(np.int64)), pa.array(n)], fields=list(TERM))
    return terms, *_pack(code, starts, len(vocab))


def _code(salt: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lang, key, text = batch.column(0), batch.column(1).to_numpy().view(np.uint64), as_text(batch.column(2))
            for lo, hi in chunks(text, CHUNK):
                part = text.slice(lo, hi - lo)
                if byte_offsets(part)[-1] == byte_offsets(part)[0]:
                    continue
                terms, *rest = code_chunk(part, key[lo:hi], lang.slice(lo, hi - lo).to_pylist(), salt)
                if len(terms):
                    lists = pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms)
                    yield pa.record_batch([lists, *(pa.array([x]) for x in rest)], schema=CODED)

    return released(run)


def lean_chunk(place: np.ndarray, hashes: np.ndarray, code: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, bool, bytes, bytes]:
    """A chunk with only the words kept, at ``place`` in its vocabulary; a left-out word ends a piece."""
    order = np.argsort(place)
    new = np.full(int(code.max(initial=-1)) + 1, -1, np.int32)
    new[place[order]] = np.arange(len(order), dtype=np.int32)
    code = new[code]
    here = code >= 0
    begins = begins | np.r_[False, ~here[:-1]]
    # A piece begins where any word since the last one kept began one.
    piece = np.cumsum(begins, dtype=np.int32)[here]
    first = np.r_[True, piece[1:] != piece[:-1]] if len(piece) else np.zeros(0, bool)
    return hashes[order], *_pack(code[here], first, len(order))


def _lean(batches: Iterator[pa.RecordBatch]):
    """Chunks without the words that aren't kept, one after the other: a batch holds many, so none is turned into lists."""
    for batch in batches:
        for i in range(batch.num_rows):
            kept, wide, codes, starts = (batch.column(c)[i] for c in range(4))
            place, hashes = (kept.values.field(c).to_numpy() for c in range(2))
            left, *rest = lean_chunk(place, hashes, *_unpack(wide.as_py(), codes.as_buffer(), starts.as_buffer()))
            yield pa.record_batch([pa.array([x]) for x in (left.tobytes(), *rest)], schema=LEAN)


class Trie:
    """Phrases (rows of word hashes) as sorted edges; ``leaf`` is each phrase's node."""

    def __init__(self, phrases: list[list[int]], asked: list[int]):
        self.words = np.unique(np.array([w for p in phrases for w in p], np.int64))
        size, longest = len(self.words), max(map(len, phrases))
        at = np.full((len(phrases), longest), -1, np.int64)
        for i, p in enumerate(phrases):
            at[i, : len(p)] = np.searchsorted(self.words, p)
        # Node 0 is the root; the nodes of a level follow those of the level before.
        node, self.nodes, keys, targets = np.zeros(len(phrases), np.int64), 1, [], []
        for level in range(longest):
            live = at[:, level] >= 0
            key, back = np.unique(node[live] * size + at[live, level], return_inverse=True)
            node[live] = self.nodes + back
            keys.append(key)
            targets.append(self.nodes + np.arange(len(key)))
            self.nodes += len(key)
        self.edge, self.target, self.leaf = np.concatenate(keys), np.concatenate(targets), node
        self.asked = np.zeros(self.nodes, np.int8)
        np.bitwise_or.at(self.asked, node, np.array(asked, np.int8))

    def step(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Child of each node by word (index, -1 for none); 0 if there is none."""
        key = node * len(self.words) + word
        i = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where((word >= 0) & (self.edge[i] == key), self.target[i], 0)

    def count(self, vocab: np.ndarray, code: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(side, node, word hash or 0, occurrences) in one chunk."""
        i = np.minimum(np.searchsorted(self.words, vocab), len(self.words) - 1)
        index = np.where(self.words[i] == vocab, i, -1)
        root = self.step(np.zeros(len(vocab), np.int64), index)
        node, last, n, size = root[code], len(code) - 1, self.nodes, len(vocab)
        begin = np.flatnonzero(node)
        node, depth = node[begin], 0
        found: dict[int, list[np.ndarray]] = {HERE: [], AFTER: [], BEFORE: []}
        while len(begin):
            asked, end = self.asked[node], begin + depth
            follows = (end < last) & ~starts[np.minimum(end + 1, last)]
            found[HERE].append(node[asked & HERE > 0])
            here = (asked & AFTER > 0) & follows
            found[AFTER].append(node[here] * size + code[end[here] + 1])
            here = (asked & BEFORE > 0) & ~starts[begin]
            found[BEFORE].append(node[here] * size + code[begin[here] - 1])
            begin, node, end = begin[follows], node[follows], end[follows]
            node = self.step(node, index[code[end + 1]])
            begin, node, depth = begin[node > 0], node[node > 0], depth + 1
        node, times = np.unique(np.concatenate([*found[HERE], np.zeros(0, np.int64)]), return_counts=True)
        yield HERE, node, np.zeros(len(node), np.int64), times
        for side in (AFTER, BEFORE):
            key, times = np.unique(np.concatenate([*found[side], np.zeros(0, np.int64)]), return_counts=True)
            yield side, key // max(size, 1), vocab[key % max(size, 1)], times


def kept_words(batch: pa.RecordBatch, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Coded chunks (hashes, wide, codes, starts) with their kept words (place, number) instead of all hashes.

    ``parts`` are hashes to keep, in any order, and their numbers; one part is held at a time.
    """
    column = batch.column(0)
    vocab = [column[i].values.to_numpy().view(np.uint64) for i in range(batch.num_rows)]  # sorted, as they come from np.unique
    places: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] for _ in vocab]
    numbers: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in vocab]
    for hashes, number in parts:
        order = np.argsort(hashes.view(np.uint64), kind="stable")
        hashes, number = hashes.view(np.uint64)[order], number[order]
        for i, words in enumerate(vocab):
            lo, hi = np.searchsorted(words, hashes[[0, -1]]) + [0, 1]
            at = np.minimum(np.searchsorted(hashes, words[lo:hi]), len(hashes) - 1)
            here = np.flatnonzero(hashes[at] == words[lo:hi])
            places[i].append((lo + here).astype(np.int32))
            numbers[i].append(number[at[here]])
    cut = np.r_[0, np.cumsum([sum(map(len, x)) for x in places])].astype(np.int32)
    pairs = [pa.array(np.concatenate([np.zeros(0, kind), *(a for x in lists for a in x)])) for kind, lists in ((np.int32, places), (np.int64, numbers))]
    kept = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(pairs, names=["place", "hash"]))
    return pa.record_batch([kept, *(batch.column(c) for c in range(1, 4))], names=["kept", "wide", "codes", "starts"])


def _parts(folder: str, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stored hashes and their numbers, at most so many at a time."""
    store, path = fs.FileSystem.from_uri(folder)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".parquet"))
    for name in files:
        with store.open_input_file(name) as f:
            for rows in pq.ParquetFile(f).iter_batches(most, columns=["hash", "number"]):
                if rows.num_rows:
                    yield rows.column(0).to_numpy(), rows.column(1).to_numpy()


def _keep(folder: str):
    def run(batches: Iterator[pa.RecordBatch]):
        return _lean(kept_words(batch, _parts(folder)) for batch in batches)

    return released(run)


def _count(trie: Trie):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                vocab, wide, codes, starts = (batch.column(c)[i] for c in range(4))
                for side, node, word, n in trie.count(np.frombuffer(vocab.as_buffer(), np.int64), *_unpack(wide.as_py(), codes.as_buffer(), starts.as_buffer())):
                    if len(node):
                        yield pa.record_batch([pa.array(node, pa.int32()), pa.array(np.full(len(node), side), pa.int32()), pa.array(word), pa.array(n)], names=["node", "side", "word", "n"])

    return released(run)


class Corpus:
    """Coded chunks, words (lang, word, hash, f) that occur ``least`` times, and n of each language; from here on a word's hash is its number."""

    def __init__(self, docs: DataFrame, scratch: Scratch, least: int):
        self.scratch, self.least, self.round = scratch, least, 0
        lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
        rows = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("key"), F.col("text").cast("string").alias("text"))
        for salt in range(8):
            with small_batches(docs.sparkSession):
                coded = scratch.save(rows.mapInArrow(_code(salt), CODED_DDL), f"coded-{salt}", maxRecordsPerFile=str(FILE))
            seen = coded.select(F.inline("terms")).groupBy("lang", "word", "hash").agg(F.sum("n").alias("f"))
            seen = scratch.save(seen, f"words-{salt}")
            if not seen.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
                break
        else:
            raise RuntimeError("hashes of words clash")
        self.langs = scratch.save(seen.groupBy("lang").agg(F.sum("f").alias("n")), "langs")
        frequent = row_numbers(seen.filter(F.col("f") >= least), [F.col("hash")], scratch, "number")
        folder = scratch.qualified("to-keep")
        scratch.save(frequent.select("hash", "number"), "to-keep")
        self.words = scratch.save(frequent.select("lang", "word", F.col("number").alias("hash"), "f"), "frequent")
        lean = coded.select(F.col("terms.hash").alias("hashes"), "wide", "codes", "starts")
        with small_batches(docs.sparkSession):
            self.chunks = scratch.save(lean.mapInArrow(_keep(folder), LEAN_DDL), "chunks", maxRecordsPerFile=str(FILE))
        scratch.drop(f"coded-{salt}")

    def asked(self, phrases: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        """Slices of ``phrases`` (lang, words, pre, asked) with their node, and the counts (node, side, word, n) of what is asked.

        Words after and before that occur less than ``least`` times there are left out. Store what is made of one before taking
        the next: each is broadcast, and many at once would take the executors' and the driver's memory.
        """
        slices = -(-phrases.count() // SLICE)
        for i in range(slices):
            part = phrases if slices == 1 else phrases.filter(F.pmod(F.xxhash64("words"), F.lit(slices)) == i)
            rows = part.select("lang", "words", "pre", "asked").toArrow()  # about SLICE phrases, as columns: objects for each of them would take several times the memory
            if not rows.num_rows:
                continue
            trie = Trie(rows["words"].to_pylist(), rows["asked"].to_pylist())
            at = pa.table({"node": pa.array(trie.leaf, pa.int32()), "lang": rows["lang"], "words": rows["words"], "pre": rows["pre"]})
            del rows
            counts = self.chunks.mapInArrow(_count(trie), COUNTS_DDL).groupBy("node", "side", "word").agg(F.sum("n").alias("n"))
            self.round += 1
            with small_batches(phrases.sparkSession):
                counts = self.scratch.save(counts.filter((F.col("side") == HERE) | (F.col("n") >= self.least)), f"counts-{self.round}")
            yield phrases.sparkSession.createDataFrame(at, PHRASE_DDL), counts


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _grow(corpus: Corpus, band: DataFrame, longest: int, name: str) -> DataFrame | None:
    """All phrases of 2 to ``longest`` words that start with a word of the band: (lang, words, pre), pre counting each prefix."""
    grown, frontier = [], band.select("lang", F.array("hash").alias("words"), F.array("f").alias("pre"))
    for length in range(2, longest + 1):
        children = None
        for part, counts in corpus.asked(frontier.withColumn("asked", F.lit(AFTER))):
            longer = counts.join(F.broadcast(part), "node")
            longer = longer.select("lang", F.array_append("words", F.col("word")).alias("words"), F.array_append("pre", F.col("n")).alias("pre"))
            children = corpus.scratch.append(longer, f"grown-{name}-{length}")
        if children is None:
            break
        frontier = children
        grown.append(frontier)
    return _union(grown) if grown else None


def _scored(corpus: Corpus, grown: DataFrame, floors: DataFrame, names: Names, longest: int, name: str) -> DataFrame:
    """Survivors among ``grown`` whose score reaches their language's floor: (lang, words, a, l, r, n, score)."""
    scratch, m = corpus.scratch, F.size("words")
    score = lambda l, r: F.expr(f"(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")
    closed = grown.filter(F.element_at("pre", -1) == F.element_at("pre", -2)).filter(m > 2).select(F.slice("words", F.lit(1), m - 1).alias("words")).distinct()
    rows = grown.join(closed, "words", "left_anti").withColumn("a", F.element_at("pre", -1)).withColumn("last", F.element_at("words", -1))
    rows = names.join(rows, ["last"]).join(floors, "lang").withColumn("before", F.element_at("pre", -2))
    rows = rows.withColumn("bound", score("before", "f_last")).filter((F.col("bound") >= F.col("floor")) & (F.expr("1000 * n div pre[0]") >= F.col("floor")))
    rows = scratch.save(rows.drop("before", "bound", "floor"), f"open-{name}")
    rest = rows.filter(m > 2).select("lang", F.explode(F.transform(F.sequence(F.lit(2), m - 1), lambda k: F.slice("words", k, m - k + 1))).alias("words"), F.lit(HERE).alias("asked"))
    left = rows.filter(m < longest).select("lang", "words", F.lit(BEFORE).alias("asked"))
    asked = rest.unionByName(left).groupBy("lang", "words").agg(F.bit_or("asked").alias("asked")).withColumn("pre", F.array().cast("array<long>"))
    parts = inside = None
    for part, counts in corpus.asked(scratch.save(asked, f"asked-{name}")):
        part = F.broadcast(part.select("node", "words"))
        parts = scratch.append(counts.filter(F.col("side") == HERE).join(part, "node").select(F.col("words").alias("rest"), F.col("n").alias("r")), f"rest-{name}")
        inside = scratch.append(counts.filter(F.col("side") == BEFORE).groupBy("node").agg(F.max("n").alias("a")).join(part, "node").select("words", "a"), f"inside-{name}")
    if parts is not None:
        rows = rows.join(inside, ["words", "a"], "left_anti")
        cuts = rows.filter(m > 2).select("words", F.posexplode(F.transform(F.sequence(F.lit(2), m - 1), lambda k: F.slice("words", k, m - k + 1))).alias("k", "rest"))
        cuts = cuts.join(parts, "rest").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("cuts"))
        rows = rows.join(cuts, "words", "left").withColumn("rs", F.concat(F.coalesce("cuts.r", F.array().cast("array<long>")), F.array("f_last")))
    else:
        rows = rows.withColumn("rs", F.array("f_last"))
    each = F.explode(F.arrays_zip(F.slice("pre", F.lit(1), m - 1).alias("l"), F.col("rs").alias("r"), F.sequence(F.lit(1), m - 1).alias("k")))
    rows = rows.select("lang", "words", "a", "n", each.alias("cut")).select("lang", "words", "a", "n", "cut.*").withColumn("score", score("l", "r"))
    lowest = rows.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "words", "a", "n", "cut.l", "cut.r", "cut.score").join(floors.select("lang", "floor"), "lang").filter("score >= floor").drop("floor")


def collocations(docs: DataFrame, scratch: Scratch, top: int = 2000, least: int = 100, longest: int = 5, band: int = BAND) -> DataFrame:
    """(lang, text) -> lang, rank (from 1), phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words.

    A-Z is lower-cased; pieces end at ``[.,;:!?\\x0A-\\x0D]``, words at blanks and tabs. Phrases lie within
    a piece and occur a >= ``least`` times, overlaps included; l and r belong to the lowest cut, the
    shortest first part among equals. A phrase that lies in a longer one as frequent as itself is left out.
    ``band`` is the number of first words of each language in the first band. Order: score and a falling, phrase rising by its bytes; so ties are resolved. A null lang is "und"; null,
    empty and blank texts have no words; repeated rows count each time; a language without phrases, or an
    empty table, gives no rows. Scores are exact up to 10**17 words of a language. Other columns aren't read.
    """
    corpus = Corpus(docs, scratch, least)
    names = Names(corpus.words.select(F.col("hash").alias("last"), F.col("f").alias("f_last"), F.col("f").alias("n")), scratch, "last")
    floors = corpus.langs.withColumn("floor", F.lit(0).cast("long")).withColumn("mark", F.struct(F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("hash")))
    best, width, i = None, band, 0
    while True:
        i += 1
        order = F.struct("f", "hash")
        todo = corpus.words.join(floors, "lang").filter((order > F.col("mark")) & (F.expr("1000 * n div f") >= F.col("floor")))
        nth = F.row_number().over(Window.partitionBy("lang").orderBy("f", "hash"))
        firsts, seen = scratch.measured(todo.withColumn("nth", nth).filter(F.col("nth") <= width).select("lang", "hash", "f"), f"band-{i}", F.count("*").alias("n"))
        if not seen["n"]:
            break
        grown = _grow(corpus, firsts, longest, str(i))
        if grown is not None:
            new = _scored(corpus, grown, floors, names, longest, str(i))
            place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score")))
            best = scratch.save((new if best is None else best.unionByName(new)).withColumn("place", place).filter(F.col("place") <= top).drop("place"), f"best-{i}")
        marks = floors.select("lang", "n", "mark", "floor").join(firsts.groupBy("lang").agg(F.max(order).alias("last")), "lang", "left").select("lang", "n", F.coalesce("last", "mark").alias("mark"), "floor")
        if best is not None:
            full = best.groupBy("lang").agg(F.count("*").alias("held"), F.min("score").alias("reached")).filter(F.col("held") >= top).drop("held")
            marks = marks.join(full, "lang", "left").withColumn("floor", F.greatest("floor", F.coalesce("reached", F.lit(0)))).drop("reached")
        floors, width = scratch.save(marks, f"floors-{i}"), min(width * 4, SLICE)
    if best is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    words = Names(corpus.words.select("hash", "word", F.col("f").alias("n")), scratch, "strings")
    terms = words.join(best.select("*", F.posexplode("words").alias("at", "hash")), ["hash"]).groupBy("lang", "words", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("terms"))
    out = terms.withColumn("phrase", F.array_join("terms.word", " "))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return out.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
