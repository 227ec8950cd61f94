import glob
import hashlib
import io
import base64
import zipfile

import pytest

from barlattice.llm import warc


@pytest.mark.parametrize("wide", [False, True])
def test_zip_reader_reads_ranges(wide):
    raw = warc.zip_bytes([("a", b"hello"), ("dir/b", bytes(range(256)) * 9)], b"note", wide)
    other = zipfile.ZipFile(io.BytesIO(raw))
    assert other.testzip() is None and other.read("a") == b"hello"
    asked = []
    reader = warc.ZipReader(lambda a, b: asked.append((a, b)) or raw[a:b], len(raw))
    assert reader.range("dir/b", 250, 260) == (bytes(range(256)) * 2)[250:260]
    assert (len(raw) and asked[-1][1] - asked[-1][0]) == 10
    with pytest.raises(ValueError):
        reader.range("a", 0, 6)


def test_an_archive_of_another_writer():
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"abc")
    raw = box.getvalue()
    assert warc.ZipReader(lambda a, b: raw[a:b], len(raw)).range("x", 1, 3) == b"bc"
    with pytest.raises(ValueError):
        warc.ZipReader(lambda a, b: b"x" * (b - a), 100)


@pytest.mark.parametrize("few", [300_000, 0])
def test_pages_come_back(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    rows = [(5, "http://a\r\nX: y", "<p>é</p>"), (3, "u", "<p>é</p>"), (3, "u", "<p>é</p>"), (7, None, None), (8, "v", ""), (None, "w", "solo"), (9, "w", "z" * 300_000), (None, "w", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, revisit string")
    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=200)
    files = glob.glob(str(tmp_path / "w" / "part*"))
    assert len(files) > 2 and all(zipfile.ZipFile(f).testzip() is None for f in files)
    got = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()
    first = {}
    for i, _, h in rows:
        k = h or ""
        first[k] = min([x for x in (first.get(k), i) if x is not None], default=None)
    want = []
    for i, _, h in rows:
        payload = (h or "").encode()
        alone = sum((x[2] or "") == (h or "") for x in rows) == 1
        revisit = not alone and i != first[h or ""]
        want.append((str(i), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None, None if revisit else payload))
    assert sorted(map(str, want)) == sorted(str((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]))) for r in got)
    assert warc.round_trip(pages, revisit_from=100).where("record_type = 'revisit'").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0
