import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from formlens.llm.common import Scratch, table
from formlens.llm.media import document_media, feature, interleave, media_features, parse_sequence, payload, pixmap, resolve, samples

SF = "/root/testdata/sf0.001"


def check(rows, texts):
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        data = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        stored = b"P6\n64 %d\n255\n" % (len(data) // 192) + data
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(data), hashlib.sha256(data).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(data[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == feature(data)


def test_documents_against_plain_python(spark):
    docs = table(spark, SF, "documents")
    rows = document_media(docs, Scratch(spark, "t")).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check(rows, texts)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "x" * 192, 0), (4, "é" * 96 + "y", 0), (5, "z " * 50000, 0), (3, "x" * 192, 0), (None, "x" * 192, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ref int")
    got = document_media(df, Scratch(spark, "t")).collect()
    assert len(got) == 7 and len({r.payload_sha256 for r in got if r.doc_id in (1, 2)}) == 1
    check(got, {d: t for d, t, _ in rows})
    assert document_media(df.limit(0), Scratch(spark, "t")).collect() == []


def test_sequences_keep_positions_and_captions(spark):
    html = '<body><style>p{}</style><p>One &amp; two</p><figure><img src="m:1" alt="old"><figcaption>A  cat</figcaption></figure>tail<script>var t="</p>";</script><video src="m:2"></video></body>'
    items = parse_sequence(html)
    assert [(i["position"], i["kind"], i["text"], i["ref"], i["caption"]) for i in items] == [(0, "text", "One & two", None, None), (1, "media", None, "m:1", "A cat"), (2, "text", "tail", None, None), (3, "media", None, "m:2", None)]
    assert parse_sequence(None) == [] and parse_sequence("") == [] and parse_sequence('<img src="a" data-bytes="x9">')[0]["n_bytes"] is None
    store = spark.createDataFrame([("m:1", "hello")], "ref string, t string").select("ref", pixmap(payload(F.col("t"))).alias("media"))
    got = resolve(interleave(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")), media_features(store), "page_id", Scratch(spark, "t")).orderBy("position").collect()
    assert [r.payload_bytes for r in got] == [None, 192, None, None]


def test_broken_pixmaps_are_refused():
    with pytest.raises(ValueError):
        samples(b"P6\n64 2\n255\n" + b"x" * 192)
