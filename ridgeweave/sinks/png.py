"""A line chart as a PNG picture, without a plotting library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Rows of three dots for each sign, from the top.
SIGNS = {
    "0": (7, 5, 5, 5, 7), "1": (2, 6, 2, 2, 7), "2": (7, 1, 7, 4, 7), "3": (7, 1, 7, 1, 7), "4": (5, 5, 7, 1, 1), "5": (7, 4, 7, 1, 7), "6": (7, 4, 7, 5, 7),
    "7": (7, 1, 1, 1, 1), "8": (7, 5, 7, 5, 7), "9": (7, 5, 7, 1, 7), ".": (0, 0, 0, 0, 2), "-": (0, 0, 7, 0, 0), "k": (4, 5, 6, 5, 5), "m": (0, 7, 7, 5, 5), " ": (0, 0, 0, 0, 0),
}
INK, LINE, FAINT = (40, 40, 40), (38, 92, 66), (222, 222, 222)
DOT = 2


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encoded(pixels: np.ndarray, title: str) -> bytes:
    """An image (rows, columns, 3) as a PNG file with a title."""
    rows, columns, _ = pixels.shape
    raw = np.concatenate([np.zeros((rows, 1), np.uint8), pixels.reshape(rows, 3 * columns)], axis=1).tobytes()
    head = struct.pack(">2I5B", columns, rows, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"Title\0" + title.encode("latin-1", "replace")) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def label(pixels: np.ndarray, text: str, x: int, y: int) -> None:
    for sign in text:
        for row, bits in enumerate(SIGNS[sign]):
            for column in range(3):
                if bits >> (2 - column) & 1:
                    pixels[y + DOT * row : y + DOT * (row + 1), x + DOT * column : x + DOT * (column + 1)] = INK
        x += 4 * DOT


def profile(title: str, km: list[float], metres: list[float], width: int = 1120, height: int = 420) -> bytes:
    """Elevations over distance, with the range of both at the axes; what isn't a number is left out."""
    pixels = np.full((height, width, 3), 255, np.uint8)
    left, top, right, bottom = 70, 20, width - 20, height - 40
    for k in range(5):
        pixels[top + k * (bottom - top) // 4, left:right] = FAINT
    pixels[top : bottom + 1, left], pixels[bottom, left:right] = INK, INK
    d, z = np.asarray(km, float), np.asarray(metres, float)
    fine = np.isfinite(d) & np.isfinite(z)
    d, z = d[fine], z[fine]
    if len(d):
        low, high, far = z.min(), z.max(), d.max() or 1.0
        columns = np.arange(left, right)
        heights = np.interp((columns - left) / (right - 1 - left) * far, d, z)
        rows = np.rint(bottom - (heights - low) / ((high - low) or 1.0) * (bottom - top)).astype(int)
        for x, a, b in zip(columns.tolist(), rows.tolist(), [*rows[1:].tolist(), int(rows[-1])], strict=True):
            pixels[max(0, min(a, b) - 1) : max(a, b) + 2, x] = LINE
        label(pixels, f"{high:.0f} m", 4, top)
        label(pixels, f"{low:.0f} m", 4, bottom - 5 * DOT)
        label(pixels, f"{far:.2f} km", right - 80, bottom + 12)
    return encoded(pixels, title)
