import base64
import hashlib
import io
import zipfile
import zlib

import pytest

from lumiquarry.llm import warc_zip as wz
from lumiquarry.session import shared_folder

ROWS = [
    (1, "http://a/\r\nx y", "<p>one</p>", "more"), (2, None, "<p>two é 你</p>", None), (3, "u3", "<p>one</p>", "m"), (4, "u4", None, "m"), (5, "u5", "", "m"), (None, "u6", "<p>two é 你</p>", "m"),
    (2, "twice", "<p>two é 你</p>", "m"), (9, "u9", "x" * 300_000, "m"), (8, "u8", "WARC/1.1\r\n\r\nPK\5\6 PK\1\2", "m"), (None, None, None, None),
]
SCHEMA = "page_id long, url string, html string, payload string"


def brute(rows, smallest=0):
    first = {}
    for p, _, h, _ in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        head = first.get(h or "")
        again = p is not None and len(raw) >= smallest and p > head
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("smallest", [0, 12])
def test_round_trip(spark, zip64, smallest, monkeypatch):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    packages = wz.write_packages(pages, shared_folder(spark, "w"), zip64=zip64, smallest=smallest)
    out = wz.read_packages(spark, packages).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=repr) == brute(ROWS, smallest)
    by = {r["page_id"]: r for r in out}
    assert by[9]["payload"] == "x" * 300_000 and by[8]["payload"] == ROWS[8][2] and by[1]["url"] == "http://a/%0D%0Ax%20y" and by[4]["payload"] in ("", None)


def test_packages_are_zip_files_of_gzip_records(spark):
    packages = wz.write_packages(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), shared_folder(spark, "w"))
    for r in packages.collect():
        store, name = wz.opened(r["package"])
        with zipfile.ZipFile(io.BytesIO(store.open_input_file(name).read())) as z:
            assert z.testzip() is None and set(z.namelist()) == {wz.ARCHIVE, wz.INDEX} and all(i.compress_type == 0 for i in z.infolist())
            data, n = z.read(wz.ARCHIVE), 0
            while data:
                d = zlib.decompressobj(wbits=31)
                assert d.decompress(data).startswith(b"WARC/1.1\r\n")
                data, n = d.unused_data, n + 1
            assert n == r["records"] == len(z.read(wz.INDEX).splitlines())


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_reads_other_writers(zip64):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k in range(5):
            with z.open(f"member é {k}", "w", force_zip64=zip64) as f:
                f.write(b"abc" * k)
        z.comment = b"PK\5\6 in the comment"
    found = wz.directory(out, len(out.getvalue()))
    assert [m.size for m in found.values()] == [0, 3, 6, 9, 12]
    m = found["member é 3"]
    at = wz.stored_at(out, m)
    assert out.getvalue()[at : at + m.size] == b"abcabcabc"


def test_many_members_need_zip64():
    out = io.BytesIO()
    w = wz.ZipWriter(out)
    for k in range(70_000):
        w.begin(str(k))
        w.end()
    w.close()
    found = wz.directory(out, len(out.getvalue()))
    assert len(found) == 70_000 and found["69999"].header > found["0"].header
    assert len(zipfile.ZipFile(out).namelist()) == 70_000


def test_empty(spark):
    packages = wz.write_packages(spark.createDataFrame([], SCHEMA), shared_folder(spark, "w"))
    assert wz.read_packages(spark, packages).count() == 0
