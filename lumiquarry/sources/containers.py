"""What photo and video files say of themselves, read from their containers by ranges: TIFF directories, JPEG segments, MP4 boxes.

Tasks open the files and read headers alone; what a broken or foreign file does not say is null. Pictures are not decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiquarry.functions.texts import dms_degrees, exif_time

# Tags of TIFF directories, bytes of a value by type, names of codecs by their four letters.
MAIN = {0x0100: "main_width", 0x0101: "main_height", 0x010F: "make", 0x0110: "model", 0x0132: "changed", 0x8769: "exif", 0x8825: "gps"}
EXIF = {0x9003: "original", 0x9004: "digitized", 0xA002: "exif_width", 0xA003: "exif_height"}
GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 13: 4}
CODECS = {"avc1": "h264", "avc3": "h264", "hvc1": "hevc", "hev1": "hevc", "mp4v": "mpeg4", "av01": "av1", "vp09": "vp9", "vp08": "vp8", "jpeg": "mjpeg"}
#: Bytes of a value, entries of a directory, and bytes of a video's index that are read at most.
MOST_VALUE, MOST_ENTRIES, MOST_INDEX = 1 << 16, 4096, 1 << 28

Read = Callable[[int, int], bytes]  # (place, number of bytes)


def ranged(file: BinaryIO, base: int = 0) -> Read:
    def read(at: int, n: int) -> bytes:
        file.seek(base + at)
        data = file.read(n)
        if len(data) < n:
            raise ValueError("the file ends early")
        return data

    return read


def directory(read: Read, order: str, at: int, names: dict[int, str]) -> dict[str, str]:
    """The values of the tags in ``names`` of one TIFF directory, as text: numbers and fractions with spaces between."""
    (n,) = struct.unpack(order + "H", read(at, 2))
    if n > MOST_ENTRIES:
        raise ValueError("too many entries")
    out = {}
    data = read(at + 2, 12 * n)
    for k in range(n):
        tag, kind, count = struct.unpack(order + "HHI", data[12 * k : 12 * k + 8])
        size = SIZES.get(kind, 0) * count
        if tag not in names or not 0 < size <= MOST_VALUE:
            continue
        raw = data[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else read(struct.unpack(order + "I", data[12 * k + 8 : 12 * k + 12])[0], size)
        if kind == 2:
            out[names[tag]] = raw.split(b"\0")[0].decode("utf-8", "replace")
        elif kind in (5, 10):
            parts = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            out[names[tag]] = " ".join(f"{a}/{b}" for a, b in zip(parts[::2], parts[1::2], strict=True))
        elif kind in (3, 4, 8, 9, 13):
            out[names[tag]] = " ".join(map(str, struct.unpack(f"{order}{count}{'HIhiI'[(3, 4, 8, 9, 13).index(kind)]}", raw)))
    return out


def tiff_fields(read: Read) -> dict[str, str]:
    """The fields of a TIFF, or of the TIFF in a JPEG's Exif segment: first directory, Exif and GPS directories."""
    mark = read(0, 8)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(mark[:4])
    if order is None:
        raise ValueError("no TIFF")
    out = directory(read, order, struct.unpack(order + "I", mark[4:])[0], MAIN)
    for place, names in (("exif", EXIF), ("gps", GPS)):
        if (at := out.pop(place, None)) is not None:
            out |= directory(read, order, int(at), names)
    return out


def photo_fields(file: BinaryIO) -> dict[str, str | int]:
    """Width and height of a JPEG, PNG, GIF, BMP, WebP or TIFF, and the fields of its Exif directories. What cannot be read is left out."""
    read, out = ranged(file), {}
    head = read(0, 12)
    if head[:2] == b"\xff\xd8":
        at = 2
        while True:
            try:
                mark, kind = read(at, 2)
                if mark != 0xFF or kind in (0xD9, 0xDA):  # no segment, the end, or the picture itself
                    break
                if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 1:  # filling, or a mark without a length
                    at += 1 if kind == 0xFF else 2
                    continue
                (n,) = struct.unpack(">H", read(at + 2, 2))
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    out["height"], out["width"] = struct.unpack(">HH", read(at + 5, 4))
            except (ValueError, struct.error):
                break
            if kind == 0xE1 and "model" not in out:
                try:
                    if read(at + 4, 6) == b"Exif\0\0":
                        out = tiff_fields(ranged(file, at + 10)) | out
                except (ValueError, struct.error, OverflowError):
                    pass
            at += 2 + n
    elif head[:8] == b"\x89PNG\r\n\x1a\n":
        out["width"], out["height"] = struct.unpack(">II", read(16, 8))
    elif head[:4] in (b"GIF8",):
        out["width"], out["height"] = struct.unpack("<HH", read(6, 4))
    elif head[:2] == b"BM":
        width, height = struct.unpack("<ii", read(18, 8))
        out["width"], out["height"] = width, abs(height)
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        kind, data = read(12, 4), read(20, 10)
        if kind == b"VP8X":
            out["width"], out["height"] = (1 + int.from_bytes(data[k : k + 3], "little") for k in (4, 7))
        elif kind == b"VP8L":
            bits = int.from_bytes(data[1:5], "little")
            out["width"], out["height"] = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        elif kind == b"VP8 ":
            out["width"], out["height"] = (x & 0x3FFF for x in struct.unpack("<HH", data[6:10]))
    else:
        out = tiff_fields(read)
    return out


def boxes(read: Read, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(kind, begin and end of what is inside) of the boxes between two places."""
    while at + 8 <= end:
        n, kind = struct.unpack(">I4s", read(at, 8))
        begin = at + 8
        if n == 1:
            (n,) = struct.unpack(">Q", read(begin, 8))
            begin += 8
        stop = end if n == 0 else at + n
        if stop < begin or stop > end:
            raise ValueError("a box ends beyond what holds it")
        yield kind.decode("latin-1"), begin, stop
        at = stop


def video_fields(file: BinaryIO, size: int) -> dict[str, str | int | float]:
    """codec, width, height, duration_sec, frame_count and fps of the first video track of an MP4 or QuickTime file."""
    whole = ranged(file)
    found = next(((a, b) for kind, a, b in boxes(whole, 0, size) if kind == "moov"), None)
    if found is None or found[1] - found[0] > MOST_INDEX:
        raise ValueError("no index")
    data = whole(found[0], found[1] - found[0])
    read: Read = lambda at, n: data[at : at + n] if at + n <= len(data) else (_ for _ in ()).throw(ValueError("the index ends early"))

    def inside(at: int, end: int, *path: str) -> tuple[int, int] | None:
        for kind in path:
            at, end = next(((a, b) for k, a, b in boxes(read, at, end) if k == kind), (-1, -1))
            if at < 0:
                return None
        return at, end

    for kind, a, b in boxes(read, 0, len(data)):
        if kind != "trak" or not (handler := inside(a, b, "mdia", "hdlr")) or read(handler[0] + 8, 4) != b"vide":
            continue
        out: dict[str, str | int | float] = {}
        if times := inside(a, b, "mdia", "mdhd"):
            long = read(times[0], 1) == b"\1"
            scale, length = struct.unpack(">IQ", read(times[0] + 20, 12)) if long else struct.unpack(">II", read(times[0] + 12, 8))
            if scale:
                out["duration_sec"] = length / scale
        if table := inside(a, b, "mdia", "minf", "stbl"):
            if (entry := inside(*table, "stsd")) and struct.unpack(">I", read(entry[0] + 4, 4))[0]:
                letters = read(entry[0] + 12, 4).decode("latin-1")
                out["codec"] = CODECS.get(letters, letters.strip())
                out["width"], out["height"] = struct.unpack(">HH", read(entry[0] + 40, 4))
            if stsz := inside(*table, "stsz"):
                (out["frame_count"],) = struct.unpack(">I", read(stsz[0] + 8, 4))
            elif stts := inside(*table, "stts"):
                (n,) = struct.unpack(">I", read(stts[0] + 4, 4))
                out["frame_count"] = sum(c for c, _ in struct.iter_unpack(">II", read(stts[0] + 8, 8 * n)))
        if out.get("frame_count") and out.get("duration_sec"):
            out["fps"] = out["frame_count"] / out["duration_sec"]
        return out
    raise ValueError("no video track")


PHOTO = ("width", "height", "main_width", "main_height", "exif_width", "exif_height", "original", "digitized", "changed", "make", "model", "lat", "lat_ref", "lon", "lon_ref")
VIDEO = {"width": "int", "height": "int", "duration_sec": "double", "codec": "string", "frame_count": "long", "fps": "double"}


def _told(files: DataFrame, of: Callable[[BinaryIO], dict], names: dict[str, str]) -> DataFrame:
    """(path, the named fields) of each file; null where it cannot be opened or read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    with open(path, "rb") as file:
                        rows.append(of(file))
                except (OSError, ValueError, struct.error, OverflowError, TypeError):
                    rows.append({})
            yield pd.DataFrame({"path": batch["path"], **{n: pd.Series([r.get(n) if t != "string" or r.get(n) is None else str(r[n]) for r in rows], dtype="object", index=batch.index) for n, t in names.items()}})

    return files.select("path").mapInPandas(run, "path string, " + ", ".join(f"{n} {t}" for n, t in names.items()))


def photos_told(files: DataFrame) -> DataFrame:
    """(path, width, height, taken_at, camera, gps_lat, gps_lon) of ``files`` (path).

    The Exif directory's size comes before the first directory's, and that before the picture's own. The time is the first
    that reads as one of original, digitized and changed; the camera is maker and model; south and west are negative. A
    file that is missing, broken or of another kind has nulls.
    """
    raw = _told(files, photo_fields, dict.fromkeys(PHOTO, "string"))
    size = lambda side: F.coalesce(*[F.expr(f"try_cast({p}{side} AS int)") for p in ("exif_", "main_", "")]).alias(side)
    camera = F.trim(F.concat_ws(" ", F.nullif(F.trim("make"), F.lit("")), F.nullif(F.trim("model"), F.lit(""))))
    place = lambda c, ref: dms_degrees(F.col(c), F.coalesce(F.trim(f"{c}_ref"), F.lit(ref)))
    return raw.select("path", size("width"), size("height"), exif_time(*[F.col(c) for c in ("original", "digitized", "changed")]).alias("taken_at"), F.nullif(camera, F.lit("")).alias("camera"), place("lat", "N").alias("gps_lat"), place("lon", "E").alias("gps_lon"))


def videos_told(files: DataFrame) -> DataFrame:
    """(path, width, height, duration_sec, codec, frame_count, fps) of ``files`` (path); nulls where a file is missing, broken or has no video."""

    def of(file: BinaryIO) -> dict:
        return video_fields(file, file.seek(0, 2))

    return _told(files, of, VIDEO)
