import io
import struct
import zipfile
from hashlib import sha256

from storyline.llm import warc_zip as w

ROWS = [(5, "http://a/", "x" * 150, "e"), (3, "http://b/\r\nX: y", "x" * 150, "e"), (9, None, "x" * 99, "e"), (8, "u", "x" * 99, "e"), (1, "u", None, "e"), (2, "u", "", "e"), (None, "u", "x" * 150, "e")]
ROWS += [(20, "é", "é\r\n\r\n\x00😀" * 40, "e"), (-4, "é", "é\r\n\r\n\x00😀" * 40, "e"), (21, "long", "abc " * 400_000, None), (3, "again", "x" * 150, "e")]


def want(rows):
    first = {}
    for i, _, t, _ in rows:
        if i is not None and len((t or "").encode()) >= 100:
            first[t] = min(i, first.get(t, i))
    out = []
    for i, _, t, _ in rows:
        p = (t or "").encode()
        to = first.get(t) if i is not None else None
        to = None if to == i else to
        out.append((i, len(p), sha256(p).hexdigest(), "response" if to is None else "revisit", to))
    return out


def test_round_trip(spark, tmp_path):
    rows = ROWS + [(10_000 + i, f"http://p/{i}", f"page {i} " * 50, "e") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    packages = w.write_packages(df.repartition(3), f"file://{tmp_path}/out", package_bytes=4000)
    assert packages.count() > 5
    got = w.page_records(w.read_packages(packages))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want(rows), key=repr)
    for r in packages.limit(3).collect():  # any ZIP reader can open them
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z:
            assert z.testzip() is None and len(z.read(w.INDEX).splitlines()) == r.records


def test_round_trip_of_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = w.round_trip(spark, df).collect()
    rows = [(r.page_id, r.url, r.html, None) for r in df.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want(rows), key=repr)


def test_empty(spark):
    assert w.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Bytes:
    def __init__(self, b):
        self.b = b

    def read_at(self, n, at):
        return self.b[at : at + n]


def test_zip64_and_missing_index():
    raw = [w.record(i, "u", b"p" * i, "d", None) for i in range(3)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("note.txt", "stored" * 9, zipfile.ZIP_DEFLATED)
        z.writestr(w.DATA, b"".join(raw))
        z.comment = b"PK"
    b = out.getvalue()
    at = b.rfind(b"PK\x05\x06")
    n, length, offset = struct.unpack("<HII", b[at + 10 : at + 20])
    # The same directory by way of ZIP64 records, its numbers in the extra field.
    entry = b.find(b"PK\x01\x02", b.find(b"PK\x01\x02") + 4)
    local = struct.unpack("<I", b[entry + 42 : entry + 46])[0]
    size = struct.unpack("<I", b[entry + 20 : entry + 24])[0]
    extra = struct.pack("<HHQQQ", 1, 24, size, size, local)
    name = b[entry + 46 : entry + 46 + len(w.DATA)]
    wide_entry = b[entry : entry + 20] + b"\xff" * 8 + struct.pack("<HH", len(name), len(extra)) + b[entry + 32 : entry + 42] + b"\xff" * 4 + name + extra
    directory = b[offset:entry] + wide_entry
    head = b[:offset] + directory
    head += b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), offset)
    wide = head + b"PK\x06\x07" + struct.pack("<IQI", 0, offset + len(directory), 1) + b"PK\x05\x06" + b"\0" * 4 + b"\xff" * 12 + b"\0\0"
    for x in (b, wide):
        found = list(w.locate(Bytes(x), len(x)))
        assert [x[a : a + n] for a, n in found] == raw
        assert [m.name for m in w.members(Bytes(x), len(x))] == [w.DATA]
