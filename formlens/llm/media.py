"""Media columns: interleaved text and media sequences from HTML, with payloads resolved by digest.

A page is parsed into an ordered array of structs, text and media references alike, so positions and
captions stay aligned. Payloads are stored as binary pixmaps (P6: 64 pixels a row, three 8-bit samples
each, hence 192 bytes a row), keyed by digest; references find them by a digest join.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlens.llm.common import Names, Scratch

WIDTH, ROW = 64, 192
ITEM = "array<struct<position:int,kind:string,text:string,ref:string,caption:string,n_bytes:bigint>>"
_ITEM = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string()), ("n_bytes", pa.int64())]))
_BLOCK = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "ul", "ol", "table", "br", "hr", "blockquote", "pre", "figure", "figcaption", "header", "footer", "main", "nav", "body"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
_HIDDEN = {"script", "style", "head", "template"}


class _Sequence(HTMLParser):
    """Text blocks and media references in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden, self.figure, self.caption = 0, None, None

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        self.text = []
        if text:
            self.add("text", text=text)

    def add(self, kind: str, text=None, ref=None, caption=None, n_bytes=None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "ref": ref, "caption": caption, "n_bytes": n_bytes})

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in _MEDIA and not self.hidden:
            self.flush()
            a = dict(attrs)
            if a.get("src"):
                size = a.get("data-bytes") or ""
                self.add("media", ref=a["src"], caption=a.get("alt") or None, n_bytes=int(size) if size.isascii() and size.isdigit() else None)
        elif tag in _BLOCK:
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)
            elif tag == "figcaption":
                self.caption = []

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption = re.sub(r"\s+", " ", "".join(self.caption)).strip()
            for item in self.items[self.figure if self.figure is not None else len(self.items) :]:
                if item["kind"] == "media" and caption:
                    item["caption"] = caption
            self.caption = None
        elif tag in _BLOCK:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """Ordered items of a page; null and empty pages have none."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, html) -> key, items: the ordered text and media structs of each page."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([parse_sequence(x) for x in batch.column(1).to_pylist()], _ITEM)], names=[key, "items"])

    df = pages.select(F.col(key), F.col(html).cast("string"))
    return df.mapInArrow(run, f"`{key}` {df.schema[0].dataType.simpleString()}, items {ITEM}")


def payload(text: Column) -> Column:
    """UTF-8 bytes padded with spaces to a positive multiple of a pixel row."""
    b = F.coalesce(text, F.lit("")).cast("binary")
    rows = F.greatest(F.ceil(F.octet_length(b) / ROW), F.lit(1))
    return F.rpad(b, (rows * ROW).cast("int"), F.lit(b" "))


def pixmap(data: Column) -> Column:
    """Stored form of a padded payload."""
    return F.concat(F.concat(F.lit(f"P6\n{WIDTH} "), (F.octet_length(data) / ROW).cast("int").cast("string"), F.lit("\n255\n")).cast("binary"), data)


def samples(stored: bytes) -> bytes:
    """The samples of a stored pixmap."""
    head = re.match(rb"P6\n(\d+) (\d+)\n255\n", stored)
    if not head or len(stored) - head.end() != int(head[1]) * int(head[2]) * 3:
        raise ValueError("not an 8-bit pixmap")
    return stored[head.end() :]


def feature(data: bytes) -> str:
    """Rows, mean of each channel in thousandths, and a 64-bit average hash of an 8 by 8 grid."""
    image = np.frombuffer(data, np.uint8).reshape(-1, WIDTH, 3).astype(np.int64)
    h = len(image)
    mean = image.reshape(-1, 3).sum(0) * 1000 // (h * WIDTH)
    edge = np.unique(np.arange(8) * h // 8)
    grid = np.add.reduceat(image.sum(2).reshape(h, 8, 8).sum(2), edge, 0)
    grid = grid * 1000 // np.diff(np.r_[edge, h])[:, None]
    bits = "".join("1" if x else "0" for x in (grid > grid.mean()).ravel())
    return f"{h}:{mean[0]}:{mean[1]}:{mean[2]}:{int(bits, 2):x}"


def media_features(store: DataFrame) -> DataFrame:
    """(ref, media) read back -> ref, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for ref, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stored = stored.as_py()
                data = samples(stored)
                rows.append((ref, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(data)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["ref", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return store.select("ref", "media").mapInArrow(run, "ref string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolve(sequences: DataFrame, media: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """One row per item of each sequence, with the columns of ``media`` where its ref is known.

    ``media`` may repeat a ref with the same values; a payload that many items ask for is broadcast.
    """
    items = sequences.select(key, F.explode("items").alias("i")).select(key, "i.*")
    one = media.groupBy("ref").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in media.columns if c != "ref"))
    return Names(one, scratch, "features").join(items, ["ref"], "left")


def document_media(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, payload and stored-form digests and feature of each text's media.

    Every text becomes a page with one captioned reference to its payload; the payloads are stored,
    read back and joined by digest. Null texts count as empty; equal texts share a reference and its
    values; rows with null or repeated doc_ids stay rows of their own. An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n"), payload(text).alias("data"))
    rows = rows.withColumn("ref", F.concat(F.lit("media:sha256-"), F.sha2("data", 256)))
    store = scratch.save(rows.select("ref", pixmap(F.col("data")).alias("media")), "media", compression="zstd")
    label = F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown"))
    page = F.concat(F.lit("<article><h1>Document "), label, F.lit('</h1><figure><img src="'), F.col("ref"), F.lit('" data-bytes="'), F.col("n"), F.lit('"><figcaption>Payload of '), label, F.lit("</figcaption></figure></article>"))
    sequences = interleave(rows.select("doc_id", page.alias("html")), "doc_id")
    out = resolve(sequences, media_features(store), "doc_id", scratch).filter("kind = 'media'")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
