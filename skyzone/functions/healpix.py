"""NESTED pixels of the equal-area sphere, in numpy (after Gorski et al. 2005)."""

from __future__ import annotations

import numpy as np

# Ring and longitude offsets of the twelve base faces.
_RING = np.asarray([2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4])
_PHI = np.asarray([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])


def _spread(v: np.ndarray) -> np.ndarray:
    """Bits of v at even places."""
    v = v.astype(np.int64)
    out = np.zeros_like(v)
    for k in range(30):
        out |= ((v >> k) & 1) << (2 * k)
    return out


def _gather(v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for k in range(30):
        out |= ((v >> (2 * k)) & 1) << k
    return out


def pixel(order: int, ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    """NESTED pixel of each position in degrees."""
    n = 1 << order
    z, t = np.sin(np.radians(dec)), np.mod(np.asarray(ra, dtype=float), 360.0) / 90.0
    za = np.abs(z)
    face, x, y = (np.empty(len(z), dtype=np.int64) for _ in range(3))
    flat = za <= 2 / 3
    # equatorial belt: indexes of ascending and descending edge lines
    a, b = n * (0.5 + t[flat]), n * z[flat] * 0.75
    up, down = np.floor(a - b).astype(np.int64), np.floor(a + b).astype(np.int64)
    fu, fd = up >> order, down >> order
    face[flat] = np.where(fu == fd, (fu & 3) + 4, np.where(fu < fd, fu & 3, (fd & 3) + 8))
    x[flat], y[flat] = down & (n - 1), n - (up & (n - 1)) - 1
    # polar caps
    cap = ~flat
    whole = np.minimum(t[cap].astype(np.int64), 3)
    part = t[cap] - whole
    # 1 - |z| from the declination, which keeps its digits at the poles
    s = n * np.sqrt(3.0 * 2.0 * np.sin(np.radians(90.0 - np.abs(np.asarray(dec, dtype=float)[cap])) / 2.0) ** 2)
    p, q = np.minimum((part * s).astype(np.int64), n - 1), np.minimum(((1 - part) * s).astype(np.int64), n - 1)
    north = z[cap] >= 0
    face[cap] = np.where(north, whole, whole + 8)
    x[cap], y[cap] = np.where(north, n - q - 1, p), np.where(north, n - p - 1, q)
    return (face << (2 * order)) | _spread(x) | (_spread(y) << 1)


def _rings(order: int, pix: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of nested pixels: ring from the north, quarter of the ring's pixels, place on it from 1, and shift of its first centre."""
    n = 1 << order
    pix = np.asarray(pix, dtype=np.int64)
    face, rest = pix >> (2 * order), pix & (n * n - 1)
    x, y = _gather(rest), _gather(rest >> 1)
    ring = _RING[face] * n - x - y - 1
    north, south = ring < n, ring > 3 * n
    width = np.where(north, ring, np.where(south, 4 * n - ring, n))
    shift = np.where(north | south, 0, (ring - n) & 1)
    column = (_PHI[face] * width + x - y + 1 + shift) // 2
    column = np.where(column > 4 * width, column - 4 * width, np.where(column < 1, column + 4 * width, column))
    return ring, width, column, shift


def centre(order: int, pix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right ascension and declination of pixel centres in degrees."""
    n = 1 << order
    ring, width, column, shift = _rings(order, pix)
    north, south = ring < n, ring > 3 * n
    z = np.where(north, 1 - width**2 / (3.0 * n * n), np.where(south, width**2 / (3.0 * n * n) - 1, (2 * n - ring) * 2 / (3.0 * n)))
    phi = (column - (shift + 1) * 0.5) * (90.0 / width)
    return np.mod(phi, 360.0), np.degrees(np.arcsin(np.clip(z, -1, 1)))


def nested_to_ring(order: int, pix: np.ndarray) -> np.ndarray:
    """Numbers along rings of nested pixels."""
    n = 1 << order
    ring, width, column, _ = _rings(order, pix)
    before = np.where(ring < n, 2 * ring * (ring - 1), np.where(ring > 3 * n, 12 * n * n - 2 * width * (width + 1), 2 * n * (n - 1) + (ring - n) * 4 * n))
    return before + column - 1


def diagonal(order: int) -> float:
    """A bound in degrees on the distance between two points of a pixel, safe at all faces."""
    return float(np.degrees(np.sqrt(4 * np.pi / 12) / (1 << order)) * 2.2)


def directory(pix: int) -> int:
    return pix // 10000 * 10000


def ring_centre(order: int, pix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right ascension and declination of the centres of pixels numbered along rings, in degrees."""
    n, p = 1 << order, np.asarray(pix, dtype=np.int64)
    cap, total = 2 * n * (n - 1), 12 * n * n
    north, south = p < cap, p >= total - cap
    # rings count from the nearer pole; a cap's ring i holds 4 i pixels
    q = np.where(south, total - 1 - p, p)
    i = ((1 + np.sqrt(1 + 2.0 * np.where(north | south, q, 0))) / 2).astype(np.int64)
    i -= (2 * i * (i - 1) > q) & (north | south)
    j = q - 2 * i * (i - 1)
    j = np.where(south, 4 * i - 1 - j, j)
    belt = p - cap
    row = belt // (4 * n) + n
    z = np.where(north | south, 1 - i * i / (3.0 * n * n), (2 * n - row) * 2 / (3.0 * n))
    shift = np.where((row - n) & 1, 0.0, 0.5)
    phi = np.where(north | south, (j + 0.5) / np.maximum(i, 1), (belt % (4 * n) + shift) / n) * 90.0
    return np.mod(phi, 360.0), np.degrees(np.arcsin(np.where(south, -z, z)))


def ring_to_nested(order: int, pix: np.ndarray) -> np.ndarray:
    """Numbers in nested order of pixels numbered along rings."""
    return pixel(order, *ring_centre(order, pix))


def cone_pixels(order: int, centre_deg: tuple[float, float], radius_deg: float) -> list[int]:
    """Pixels of an order that can overlap a cone: those of the order above that can, each cut in four."""
    found = np.arange(12)
    for k in range(order + 1):
        if k:
            found = (found[:, None] * 4 + np.arange(4)).reshape(-1)
        a, d = centre(k, found)
        h = np.sin(np.radians(d - centre_deg[1]) / 2) ** 2 + np.cos(np.radians(d)) * np.cos(np.radians(centre_deg[1])) * np.sin(np.radians(a - centre_deg[0]) / 2) ** 2
        found = found[np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1.0, h)))) <= radius_deg + diagonal(k)]
    return found.tolist()


def intervals(pixels: list[int], order: int, deepest: int) -> list[tuple[int, int]]:
    """Half-open ranges of ``deepest``-order pixels that pixels of an order cover, adjacent ones joined."""
    out: list[tuple[int, int]] = []
    shift = 2 * (deepest - order)
    for p in sorted(set(pixels)):
        lo, hi = p << shift, (p + 1) << shift
        if out and out[-1][1] == lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out
