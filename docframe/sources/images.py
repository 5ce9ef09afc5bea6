"""Images inside documents: their kinds, sizes and bytes.

An image's destination is a path, an address, or a data URI that holds the bytes. Packages take bytes in as parts and give
them back as data URIs, so that conversions of bytes lose none; conversions of files read and write image files beside them.
"""

from __future__ import annotations

import base64
import binascii
import re
import struct
from collections.abc import Mapping

#: Media types by file extension.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "webp": "image/webp", "tiff": "image/tiff"}
_DATA = re.compile(r"data:(image/[\w.+-]+);base64,([A-Za-z0-9+/=\s]+)")
EMU_PER_PIXEL = 9525


def extension(data: bytes) -> str:
    """The file extension of an image by how its bytes begin; png if that is not known."""
    starts = ((b"\x89PNG", "png"), (b"\xff\xd8", "jpg"), (b"GIF8", "gif"), (b"BM", "bmp"), (b"II*\x00", "tiff"), (b"MM\x00*", "tiff"))
    found = next((e for s, e in starts if data.startswith(s)), None)
    if found:
        return found
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    return "svg" if b"<svg" in data[:1000] else "png"


def size(data: bytes) -> tuple[int, int] | None:
    """(width, height) in pixels of a PNG, GIF, BMP or JPEG image; None if they can't be read."""
    try:
        if data.startswith(b"\x89PNG"):
            return struct.unpack(">II", data[16:24])
        if data.startswith(b"GIF8"):
            return struct.unpack("<HH", data[6:10])
        if data.startswith(b"BM"):
            width, height = struct.unpack("<ii", data[18:26])
            return width, abs(height)
        at = 2
        while data.startswith(b"\xff\xd8"):
            kind, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if data[at] != 0xFF:
                return None
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's head
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + length
    except (struct.error, IndexError):
        pass
    return None


def data_uri(data: bytes) -> str:
    return f"data:{MIME[extension(data)]};base64,{base64.b64encode(data).decode()}"


def bytes_of(destination: str, assets: Mapping[str, bytes] | None = None) -> bytes | None:
    """The bytes behind a destination: of a data URI, or of assets by path."""
    if m := _DATA.fullmatch(destination):
        try:
            return base64.b64decode(re.sub(r"\s", "", m[2]), validate=True)
        except binascii.Error:
            return None
    return (assets or {}).get(destination)


def to_files(blocks: list, folder: str = "image") -> tuple[list, dict[str, bytes]]:
    """A document's tree whose images with data URIs lead to files, and the files by path: image1, image2 and so on, equal ones once.

    Only destinations of images change; text that looks like a data URI stays text.
    """
    files: dict[str, bytes] = {}
    names: dict[bytes, str] = {}

    def moved(x: object) -> object:
        if isinstance(x, list):
            return [moved(i) for i in x]
        if not isinstance(x, dict):
            return x
        if x.get("type") == "image":
            held = f"data:image/{x['format']};base64,{x['data']}" if "data" in x else x.get("destination") or ""
            data = bytes_of(held) if held.startswith("data:") else None
            if data is not None:
                name = names.setdefault(data, f"{folder}/image{len(names) + 1}.{extension(data)}")
                files[name] = data
                image = {k: v for k, v in x.items() if k not in ("format", "data")} | {"destination": name}
                return {"type": "paragraph", "content": [image]} if "data" in x else image
        return {k: moved(v) for k, v in x.items()}

    return moved(blocks), files


class Parts:
    """Images of a package that is written: equal ones are one part."""

    def __init__(self, folder: str, assets: Mapping[str, bytes] | None = None) -> None:
        self.folder, self.assets = folder, assets
        self.files: dict[str, bytes] = {}
        self._names: dict[bytes, str] = {}

    def add(self, destination: str) -> tuple[str, bytes] | None:
        """(part name, bytes) of an image whose bytes are there."""
        data = bytes_of(destination, self.assets)
        if data is None:
            return None
        if data not in self._names:
            self._names[data] = f"{self.folder}/image{len(self._names) + 1}.{extension(data)}"
            self.files[self._names[data]] = data
        return self._names[data], data


def extent(data: bytes | None, width: int, height: int) -> tuple[int, int]:
    """(cx, cy) in EMU of an image at its own size, made smaller to fit width and height; 640 x 480 pixels if not known."""
    x, y = (n * EMU_PER_PIXEL for n in ((size(data) if data else None) or (640, 480)))
    scale = min(width / max(x, 1), height / max(y, 1), 1.0)
    return max(round(x * scale), 1), max(round(y * scale), 1)
