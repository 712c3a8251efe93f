"""Size, format and the common EXIF tags of image files, read from their headers without an image library."""

from __future__ import annotations

import struct

TAGS = {0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x8825: "GPSInfo"}
SHOWN = ("Make", "Model", "DateTime", "GPSInfo", "Software", "width", "height", "format")


def _png(b: bytes) -> tuple[int, int]:
    return struct.unpack(">II", b[16:24])


def _gif(b: bytes) -> tuple[int, int]:
    return struct.unpack("<HH", b[6:10])


def _bmp(b: bytes) -> tuple[int, int]:
    w, h = struct.unpack("<ii", b[18:26])
    return w, abs(h)


def _webp(b: bytes) -> tuple[int, int]:
    kind = b[12:16]
    if kind == b"VP8X":
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
    if kind == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    w, h = struct.unpack("<HH", b[26:30])
    return w & 0x3FFF, h & 0x3FFF


def _exif(b: bytes) -> dict[str, object]:
    """The text tags of the first directory of a TIFF block; GPSInfo is where that directory begins."""
    order = "<" if b[:2] == b"II" else ">"
    at = struct.unpack(order + "I", b[4:8])[0]
    found: dict[str, object] = {}
    for k in range(struct.unpack(order + "H", b[at : at + 2])[0]):
        entry = b[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if tag not in TAGS:
            continue
        value = struct.unpack(order + "I", entry[8:12])[0]
        if kind == 2:  # text, in place if it fits
            raw = entry[8 : 8 + n] if n <= 4 else b[value : value + n]
            found[TAGS[tag]] = raw.split(b"\0")[0].decode("utf-8", "ignore")
        elif kind == 4:
            found[TAGS[tag]] = value
    return found


def _jpeg(b: bytes) -> dict[str, object]:
    at, found = 2, {}
    while at + 4 <= len(b) and b[at] == 0xFF:
        mark, size = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])[0]
        if mark == 0xE1 and b[at + 4 : at + 10] == b"Exif\0\0":
            found |= _exif(b[at + 10 : at + 2 + size])
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return found | {"width": w, "height": h, "format": "JPEG"}
        at += 2 + size
    return found


def image_info(content: bytes) -> dict[str, object]:
    """What the header tells; empty for other formats and for broken headers."""
    b = bytes(content)
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return dict(zip(("width", "height"), _png(b)), format="PNG")
        if b[:4] == b"GIF8":
            return dict(zip(("width", "height"), _gif(b)), format="GIF")
        if b[:2] == b"BM":
            return dict(zip(("width", "height"), _bmp(b)), format="BMP")
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            return dict(zip(("width", "height"), _webp(b)), format="WEBP")
        if b[:2] == b"\xff\xd8":
            return _jpeg(b)
        if b[:4] in (b"II*\0", b"MM\0*"):
            return _exif(b) | {"format": "TIFF"}
    except (struct.error, IndexError):
        pass
    return {}


def described(name: str, info: dict[str, object]) -> str:
    """The text that stands for an image."""
    tags = ", ".join(f"{k}: {info[k]}" for k in info if k in SHOWN)
    return f"Image file: {name}" + (f" ({tags})" if tags else "")
