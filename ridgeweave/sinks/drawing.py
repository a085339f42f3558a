"""Maps and profile charts as drawings inside a page."""

from __future__ import annotations

import math
from html import escape

#: Colour and radius of the markers on a route's map.
MARKERS = {"km": ("#265c42", 5), "direction": ("#5b7fb5", 3), "steps": ("#f0c36a", 3), "steep": ("#b85c38", 4)}
WIDTH, HEIGHT, EDGE = 700, 420, 14


class Frame:
    """Degrees to the drawing's units, with one scale for both axes at the middle latitude."""

    def __init__(self, points: list[tuple[float, float]]):
        lon, lat = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
        self.west, self.north = min(lon), max(lat)
        self.squeeze = math.cos(math.radians((min(lat) + max(lat)) / 2))
        across, down = (max(lon) - self.west) * self.squeeze, self.north - min(lat)
        self.scale = min((WIDTH - 2 * EDGE) / across if across > 0 else math.inf, (HEIGHT - 2 * EDGE) / down if down > 0 else math.inf)
        if not math.isfinite(self.scale):
            self.scale = 1.0

    def at(self, lon: float, lat: float) -> tuple[float, float]:
        return round(EDGE + (lon - self.west) * self.squeeze * self.scale, 1), round(EDGE + (self.north - lat) * self.scale, 1)

    def line(self, points: list[tuple[float, float]]) -> str:
        return " ".join(f"{x},{y}" for x, y in (self.at(*p) for p in points))


def route_map(line: list[tuple[float, float]], markers: list[dict], name: str) -> str:
    """A route with its start, its end and its markers (kind, lon, lat, note)."""
    f = Frame(line)
    out = [f'<svg id="map" viewBox="0 0 {WIDTH} {HEIGHT}" role="img"><title>{escape(name)}</title><polyline fill="none" stroke="#b85c38" stroke-width="4" points="{f.line(line)}"/>']
    for m in markers:
        x, y = f.at(m["lon"], m["lat"])
        colour, radius = MARKERS[m["kind"]]
        out.append(f'<circle class="{m["kind"]}" cx="{x}" cy="{y}" r="{radius}" fill="{colour}"><title>{escape(m["note"])}</title></circle>')
    for label, p in (("Start", line[:1]), ("End", line[-1:])):
        for x, y in (f.at(*v) for v in p):
            out.append(f'<g class="{label.lower()}"><circle cx="{x}" cy="{y}" r="7" fill="none" stroke="#111" stroke-width="2"/><text x="{x + 9}" y="{y + 4}" font-size="13">{label}</text></g>')
    return "".join(out) + "</svg>"


def overview_map(lines: dict[str, list[tuple[float, float]]], names: dict[str, str]) -> str:
    """All routes on one map, each a link to its page."""
    f = Frame([p for line in lines.values() for p in line])
    each = "".join(f'<a href="routes/{escape(k)}.html"><polyline data-route="{escape(k)}" fill="none" stroke="#7c8f67" stroke-opacity="0.65" stroke-width="3" points="{f.line(line)}"><title>{escape(names.get(k, k))}</title></polyline></a>' for k, line in lines.items())
    return f'<svg id="map" viewBox="0 0 {WIDTH} {HEIGHT}" role="img"><title>All routes</title>{each}</svg>'


def profile_chart(km: list[float], metres: list[float], grades: list[float | None]) -> str:
    """Elevation, and the grade in per cent on a scale of its own, over kilometres."""
    good = [z for z in metres if z is not None and math.isfinite(z)]
    if not good:
        return '<svg id="profile" viewBox="0 0 700 240"></svg>'
    far, width, height = max(km) or 1.0, WIDTH - 90, 180

    def curve(values: list[float | None], low: float, high: float) -> str:
        spots = [(k, v) for k, v in zip(km, values, strict=True) if v is not None and math.isfinite(v)]
        return " ".join(f"{45 + k / far * width:.1f},{15 + (high - v) / ((high - low) or 1.0) * height:.1f}" for k, v in spots)

    steep = max([abs(g) for g in grades if g is not None and math.isfinite(g)], default=0.0) or 1.0
    low, high = min(good), max(good)
    return (
        f'<svg id="profile" viewBox="0 0 700 240" role="img"><title>Profile</title><path d="M45 15V195H{45 + width}V15" fill="none" stroke="#999"/>'
        f'<polyline class="elevation" fill="none" stroke="#265c42" stroke-width="3" points="{curve(metres, low, high)}"/><polyline class="grade" fill="none" stroke="#b85c38" points="{curve(grades, -steep, steep)}"/>'
        f'<g font-size="12"><text x="4" y="20">{high:.0f} m</text><text x="4" y="195">{low:.0f} m</text><text x="{50 + width}" y="20">{steep:.0f} %</text><text x="{50 + width}" y="195">{-steep:.0f} %</text><text x="45" y="215">0</text><text x="{width}" y="215">{far:.2f} km</text></g></svg>'
    )
