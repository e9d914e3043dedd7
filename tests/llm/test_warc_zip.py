import hashlib
import io
import struct
import zipfile

import pytest

from formlens.llm.common import Scratch
from formlens.llm.warc_zip import INDEX, WARC, archive, members, page_records, parse_record, read_archives, read_records, warc_record, write_archives


def reader(data):
    seen = []

    def read(at, n):
        seen.append((at, n))
        return data[at : at + n]

    return read, seen


def zip64(data: bytes) -> bytes:
    """The same archive with sizes, offsets and the end record moved to ZIP64 fields."""
    end = data.rfind(b"PK\5\6")
    count, length, start = struct.unpack("<HII", data[end + 10 : end + 20])
    directory, out, p = data[start : start + length], b"", 0
    for _ in range(count):
        n, extra, comment = struct.unpack("<HHH", directory[p + 28 : p + 34])
        packed, plain = struct.unpack("<II", directory[p + 20 : p + 28])
        (header,) = struct.unpack("<I", directory[p + 42 : p + 46])
        field = struct.pack("<HHQQQ", 1, 24, plain, packed, header)
        out += directory[p : p + 20] + struct.pack("<IIHHH", 0xFFFFFFFF, 0xFFFFFFFF, n, len(field), 0) + directory[p + 34 : p + 42] + struct.pack("<I", 0xFFFFFFFF) + directory[p + 46 : p + 46 + n] + field
        p += 46 + n + extra + comment
    body = data[:start] + out
    record = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, len(out), start)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, len(body), 1)
    return body + record + locator + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


@pytest.mark.parametrize("change", [lambda d: d, zip64])
def test_range_reads_of_plain_and_zip64(change):
    records = [(str(i), warc_record("response", str(i), "http://a/b", "d", None, b"x" * 100_000)) for i in range(20)]
    data = change(archive(records))
    assert set(members(reader(data)[0], len(data))) == {WARC, INDEX}
    read, seen = reader(data)
    first = next(iter(read_records(read, len(data))))
    assert first[1]["payload"] == b"x" * 100_000 and sum(n for _, n in seen) < 250_000
    assert [r["record_id"] for _, r in read_records(reader(data)[0], len(data))] == [str(i) for i in range(20)]


def test_archives_without_index_and_compressed_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(WARC, warc_record("response", "1", None, "d", None, b"a\r\n\r\nb") + warc_record("revisit", "2", "u", "d", "1", b""))
    data = out.getvalue()
    got = [r for _, r in read_records(reader(data)[0], len(data))]
    assert [(r["record_type"], r["payload"], r["refers_to"]) for r in got] == [("response", b"a\r\n\r\nb", None), ("revisit", None, "1")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(WARC, "x" * 500)
    with pytest.raises(ValueError):
        list(read_records(reader(out.getvalue())[0], len(out.getvalue())))
    with pytest.raises(ValueError):
        members(reader(b"no zip")[0], 6)
    with pytest.raises(ValueError):
        parse_record(b"nothing")


def test_pages_and_odd_rows(spark, tmp_path):
    big = "<p>" + "é" * 600
    rows = [(1, "u\r\nX: y", big), (2, "u2", big), (9, "u9", big), (3, None, "small"), (4, "u4", "small"), (5, "u5", None), (6, "u6", ""), (None, "u", big), (9, "again", big), (7, "u7", "q" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest")
    scratch = Scratch(spark, "t")
    archives = write_archives(df, scratch, str(tmp_path), limit=10_000)
    got = page_records(read_archives(archives), scratch).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(p, len((t or "").encode()), sha(t), "revisit" if t == big and p != 9 else "response", 9 if t == big and p != 9 else None) for p, _, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.path for r in archives.collect()} == {str(p) for p in tmp_path.iterdir()} and archives.count() > 1
    scratch = Scratch(spark, "t")
    assert page_records(read_archives(write_archives(df.limit(0), scratch)), scratch).collect() == []
    stored = tmp_path / "64.wacz"
    stored.write_bytes(zip64(next(tmp_path.glob("*.zip")).read_bytes()))
    assert read_archives(spark.createDataFrame([(str(stored),), (None,)], "path string")).count() >= 1
