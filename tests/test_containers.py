"""Containers of photos and videos, built byte by byte."""

import struct

import pytest

from lumiquarry.sources import containers


def ifd(order, entries, base, next_at=0):
    """A TIFF directory at ``base`` and what its values need after it. Entries: tag, type, count, bytes."""
    table, after = b"", b""
    room = base + 2 + 12 * len(entries) + 4
    for tag, kind, count, raw in entries:
        if len(raw) <= 4:
            value = raw.ljust(4, b"\0")
        else:
            value = struct.pack(order + "I", room + len(after))
            after += raw
        table += struct.pack(order + "HHI", tag, kind, count) + value
    return struct.pack(order + "H", len(entries)) + table + struct.pack(order + "I", next_at) + after


def tiff(order, main, exif=(), gps=()):
    text = lambda tag, s: (tag, 2, len(s) + 1, s.encode() + b"\0")
    make = lambda rows: [text(t, v) if isinstance(v, str) else (t, 4, 1, struct.pack(order + "I", v)) if isinstance(v, int) else (t, 5, len(v), struct.pack(f"{order}{2 * len(v)}I", *sum(v, ()))) for t, v in rows]
    first = make(main)
    n = len(ifd(order, [*first, (0x8769, 4, 1, b"\0" * 4), (0x8825, 4, 1, b"\0" * 4)], 8))
    exif_at = 8 + n
    second = ifd(order, make(exif), exif_at)
    gps_at = exif_at + len(second)
    whole = ifd(order, [*first, (0x8769, 4, 1, struct.pack(order + "I", exif_at)), (0x8825, 4, 1, struct.pack(order + "I", gps_at))], 8)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + whole + second + ifd(order, make(gps), gps_at)


def jpeg(*segments, width=640, height=480):
    size = b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, height, width, 0)
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([k]) + struct.pack(">H", len(d) + 2) + d for k, d in segments) + size + b"\xff\xda\0\2" + b"picture" + b"\xff\xd9"


FULL = ([(0x010F, " Maker "), (0x0110, "One"), (0x0132, "2020:01:01 00:00:00")], [(0x9003, "2024:05:06 07:08:09"), (0x9004, "2023:01:01 00:00:00"), (0xA002, 4000), (0xA003, 3000)], [(1, "S"), (2, ((34, 1), (5, 1), (5049, 100))), (3, "E"), (4, ((77, 1), (30, 1), (0, 1)))])


def box(kind, *inside):
    data = b"".join(inside)
    return struct.pack(">I4s", len(data) + 8, kind) + data


def mp4(codec=b"avc1", frames=60, scale=600, length=1200, large=False, sized=True):
    stsd = box(b"stsd", struct.pack(">II", 0, 1), struct.pack(">I4s", 86, codec), b"\0" * 24, struct.pack(">HH", 1920, 1080), b"\0" * 50)
    stts = box(b"stts", struct.pack(">II", 0, 2), struct.pack(">IIII", frames - 10, 20, 10, 20))
    stsz = box(b"stsz", struct.pack(">III", 0, 7, frames)) if sized else b""
    mdhd = box(b"mdhd", b"\1\0\0\0" + b"\0" * 16 + struct.pack(">IQ", scale, length)) if large else box(b"mdhd", b"\0" * 12 + struct.pack(">II", scale, length))
    track = lambda kind, *more: box(b"trak", box(b"tkhd", b"\0" * 84), box(b"mdia", mdhd, box(b"hdlr", b"\0" * 8 + kind + b"\0" * 12), box(b"minf", box(b"stbl", *more))))
    moov = box(b"moov", box(b"mvhd", b"\0" * 100), track(b"soun"), track(b"vide", stsd, stts, stsz))
    media = struct.pack(">I4sQ", 1, b"mdat", 16 + 5000) + b"\0" * 5000
    return box(b"ftyp", b"isom") + media + moov


def rows(spark, tmp_path, files, told):
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    df = spark.createDataFrame([(str(tmp_path / n),) for n in [*files, "missing"]], "path string")
    return {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in told(df).collect()}


def test_photos(spark, tmp_path):
    exif = tiff("<", *FULL)
    files = {
        "full.jpg": jpeg((0xE0, b"JFIF\0"), (0xE1, b"Exif\0\0" + exif)), "big.jpg": jpeg((0xE1, b"another kind of segment"), (0xE1, b"Exif\0\0" + tiff(">", *FULL))),
        "plain.jpg": jpeg(), "raw.dng": exif, "second.jpg": jpeg((0xE1, b"Exif\0\0" + tiff(">", [(0x0110, "Two")], [(0x9003, "no time"), (0x9004, "2023-01-02 03:04:05")], [(2, ((10, 1), (0, 0), (0, 1)))]))),
        "broken.jpg": jpeg((0xE1, b"Exif\0\0" + exif[:60])), "cut.jpg": jpeg((0xE1, b"Exif\0\0" + exif))[:40], "text.jpg": b"not a picture at all", "empty.jpg": b"",
        "loop.dng": b"II*\0\x08\0\0\0\xff\xff" + b"\0" * 40,
        "a.png": b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 31, 17), "a.gif": b"GIF89a" + struct.pack("<HH", 9, 8) + b"\0\0", "a.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6),
        "x.webp": b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"), "l.webp": b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 4 + b"\x2f" + (9 | 19 << 14).to_bytes(4, "little") + b"\0" * 5,
    }
    got = rows(spark, tmp_path, files, containers.photos_told)
    for name in ("full.jpg", "big.jpg", "raw.dng"):
        width, height, at, camera, lat, lon = got[name]
        assert (width, height, str(at), camera) == (4000, 3000, "2024-05-06 07:08:09", "Maker One")
        assert lat == pytest.approx(-(34 + 5 / 60 + 50.49 / 3600)) and lon == 77.5
    assert got["plain.jpg"] == (640, 480, None, None, None, None)
    assert got["second.jpg"][:2] == (640, 480) and str(got["second.jpg"][2]) == "2023-01-02 03:04:05" and got["second.jpg"][3:] == ("Two", None, None)
    assert got["broken.jpg"] == (640, 480, None, None, None, None)
    assert {n: r[:2] for n, r in got.items() if n[0] in "axl" and n != "loop.dng"} == {"a.png": (31, 17), "a.gif": (9, 8), "a.bmp": (5, 6), "x.webp": (100, 50), "l.webp": (10, 20)}
    assert all(got[n] == (None,) * 6 for n in ("cut.jpg", "text.jpg", "empty.jpg", "missing", "loop.dng"))


def test_videos(spark, tmp_path):
    files = {"a.mp4": mp4(), "b.mov": mp4(b"hvc1", 120, 1000, 4000, large=True, sized=False), "c.mp4": mp4()[:-200], "d.mp4": b"no boxes here", "e.mp4": b"", "f.mp4": box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", b"\0" * 100)), "g.mp4": mp4(b"abcd", length=0)}
    got = rows(spark, tmp_path, files, containers.videos_told)
    assert got["a.mp4"] == (1920, 1080, 2.0, "h264", 60, 30.0) and got["b.mov"] == (1920, 1080, 4.0, "hevc", 120, 30.0)
    assert got["g.mp4"] == (1920, 1080, 0.0, "abcd", 60, None)
    assert all(got[n] == (None,) * 6 for n in ("c.mp4", "d.mp4", "e.mp4", "f.mp4", "missing"))
