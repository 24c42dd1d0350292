"""The publication figure: a scene of lines, dots and texts laid out from tidy rows, written as SVG, PDF or PNG."""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass
from xml.sax.saxutils import escape

import numpy as np

WIDTH, ROW, HEAD, MARGIN, LABELS = 760.0, 18.0, 46.0, 24.0, 190.0
COLORS = ("#1f5fa8", "#c2571a", "#3b8a52", "#7a4fa3", "#555555")
LIMIT = 2000


@dataclass(frozen=True)
class Line:
    x1: float
    y1: float
    x2: float
    y2: float
    color: str = "#bbbbbb"


@dataclass(frozen=True)
class Dot:
    x: float
    y: float
    color: str
    radius: float = 3.5


@dataclass(frozen=True)
class Text:
    x: float
    y: float
    text: str
    size: float = 11.0
    anchor: str = "start"


@dataclass(frozen=True)
class Scene:
    width: float
    height: float
    marks: tuple[Line | Dot | Text, ...]


def ticks(low: float, high: float, about: int = 5) -> list[float]:
    """Round values that cover a range, some ``about`` of them, 1, 2 or 5 times a power of ten apart."""
    span = (high - low) or abs(high) or 1.0
    power = 10.0 ** math.floor(math.log10(span / about))
    step = next(power * m for m in (1, 2, 5, 10) if power * m >= span / about * 0.999)
    first, last = int(low // step), int(-(-high // step))
    return [round(k * step, 12) for k in range(first, max(last, first + 1) + 1)]


def spread(places: list[float], gap: float, low: float, high: float) -> list[float]:
    """Places in the same order, at least ``gap`` apart and within the bounds, moved as little as a pass each way allows.

    With too little room for the gap, a smaller one that just fits is kept."""
    if not places:
        return []
    gap = min(gap, (high - low) / max(len(places) - 1, 1))
    order = sorted(range(len(places)), key=lambda i: (places[i], i))
    at: list[float] = []
    for i in order:
        at.append(max(places[i], low, at[-1] + gap if at else low))
    ceiling = high
    for k in reversed(range(len(at))):
        at[k] = ceiling = min(at[k], ceiling)
        ceiling -= gap
    out = [0.0] * len(places)
    for i, y in zip(order, at):
        out[i] = y
    return out


def layout(title: str, rows: list[tuple[str, str, str, str, float | None]]) -> Scene:
    """(panel, row label, series, metric, value) to a scene: a box for each panel, a line for each label, a dot for each value.

    Panels, labels and series keep the order they come in.  Rows without value keep their line.  Each last dot of a line is
    labelled with its number, moved aside where numbers would overlap."""
    if len(rows) > LIMIT:
        raise ValueError(f"a figure of more than {LIMIT} values")
    series = list(dict.fromkeys(f"{s} {m}" for _, _, s, m, _ in rows))
    color = {s: COLORS[k % len(COLORS)] for k, s in enumerate(series)}
    marks: list[Line | Dot | Text] = [Text(MARGIN, 26, title, 15)]
    y = 44.0
    for k, s in enumerate(series):
        x = MARGIN + k % 3 * 240
        marks += [Dot(x + 4, y + k // 3 * 15 - 4, color[s]), Text(x + 14, y + k // 3 * 15, s)]
    y += (len(series) + 2) // 3 * 15.0
    left, right = MARGIN + LABELS, WIDTH - MARGIN - 50
    for name in dict.fromkeys(r[0] for r in rows):
        own = [r for r in rows if r[0] == name]
        labels = list(dict.fromkeys(r[1] for r in own))
        values = [r[4] for r in own if r[4] is not None] or [0.0]
        scale = ticks(min(0.0, *values), max(0.0, *values))
        top, bottom = y + HEAD, y + HEAD + ROW * len(labels)
        place = lambda v: left + (v - scale[0]) / (scale[-1] - scale[0]) * (right - left)  # noqa: B023, E731
        marks.append(Text(MARGIN, y + 20, name, 13))
        for v in scale:
            marks += [Line(place(v), top - 6, place(v), bottom, "#555555" if v == 0 else "#dddddd"), Text(place(v), top - 10, f"{v:g}", 9, "middle")]
        ends: list[tuple[float, float]] = []
        for k, label in enumerate(labels):
            at = top + ROW * (k + 0.5)
            marks.append(Text(MARGIN, at + 4, label))
            shown = [(r[4], color[f"{r[2]} {r[3]}"]) for r in own if r[1] == label and r[4] is not None]
            if len(shown) > 1:
                marks.append(Line(place(min(v for v, _ in shown)), at, place(max(v for v, _ in shown)), at))
            marks += [Dot(place(v), at, c) for v, c in shown]
            if shown:
                ends.append((at + 4, max(v for v, _ in shown)))
        for (_, v), to in zip(ends, spread([a for a, _ in ends], 11.0, top, bottom + 4)):
            marks.append(Text(right + 8, to, f"{v:.2f}", 9))
        y = bottom
    return Scene(WIDTH, y + MARGIN, tuple(marks))


def svg(scene: Scene) -> str:
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{scene.width:g}" height="{scene.height:g}" viewBox="0 0 {scene.width:g} {scene.height:g}" font-family="Helvetica, sans-serif">']
    for m in scene.marks:
        if isinstance(m, Line):
            out.append(f'<line x1="{m.x1:.2f}" y1="{m.y1:.2f}" x2="{m.x2:.2f}" y2="{m.y2:.2f}" stroke="{m.color}"/>')
        elif isinstance(m, Dot):
            out.append(f'<circle cx="{m.x:.2f}" cy="{m.y:.2f}" r="{m.radius:g}" fill="{m.color}"/>')
        else:
            out.append(f'<text x="{m.x:.2f}" y="{m.y:.2f}" font-size="{m.size:g}" text-anchor="{m.anchor}">{escape(m.text)}</text>')
    return "\n".join([*out, "</svg>"])


def _paint(color: str) -> str:
    return " ".join(f"{int(color[k : k + 2], 16) / 255:.3f}" for k in (1, 3, 5))


def pdf(scene: Scene) -> bytes:
    """One page with the standard font; the same scene gives the same bytes.  Characters outside Latin-1 become "?"."""
    ops: list[str] = []
    up = lambda y: scene.height - y
    for m in scene.marks:
        if isinstance(m, Line):
            ops.append(f"{_paint(m.color)} RG {m.x1:.2f} {up(m.y1):.2f} m {m.x2:.2f} {up(m.y2):.2f} l S")
        elif isinstance(m, Dot):
            # a line of no length with round ends is a disc
            ops.append(f"q 1 J {2 * m.radius:g} w {_paint(m.color)} RG {m.x:.2f} {up(m.y):.2f} m {m.x:.2f} {up(m.y):.2f} l S Q")
        else:
            text = m.text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
            # half a size a character is near the font's mean width, enough to centre short numbers
            x = m.x - {"start": 0.0, "middle": 0.25, "end": 0.5}[m.anchor] * m.size * len(m.text)
            ops.append(f"BT /F {m.size:g} Tf {x:.2f} {up(m.y):.2f} Td ({text}) Tj ET")
    content = "\n".join(ops).encode("latin-1", "replace")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {scene.width:g} {scene.height:g}] /Contents 5 0 R /Resources << /Font << /F 4 0 R >> >> >>".encode(),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content),
    ]
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


#: A font of five columns of seven dots a character, from the blank to the letter z (fixed values): a byte a column, the lowest bit on top.
FONT = bytes.fromhex("""
0000000000 00005F0000 0007000700 147F147F14 242A7F2A12 2313086462 3649552250 0005030000 001C224100 0041221C00 14083E0814 08083E0808 0050300000 0808080808 0060600000 2010080402
3E5149453E 00427F4000 4261514946 2141454B31 1814127F10 2745454539 3C4A494930 0171090503 3649494936 064949291E 0036360000 0056360000 0814224100 1414141414 0041221408 0201510906
324979413E 7E1111117E 7F49494936 3E41414122 7F4141221C 7F49494941 7F09090901 3E4149497A 7F0808087F 00417F4100 2040413F01 7F08142241 7F40404040 7F020C027F 7F0408107F 3E4141413E
7F09090906 3E4151215E 7F09192946 4649494931 01017F0101 3F4040403F 1F2040201F 3F4038403F 6314081463 0708700807 6151494543 007F414100 0204081020 0041417F00 0402010204 4040404040
0001020400 2054545478 7F48444438 3844444420 384444487F 3854545418 087E090102 0C5252523E 7F08040478 00447D4000 2040443D00 7F10284400 00417F4000 7C04180478 7C08040478 3844444438
7C14141408 081414187C 7C08040408 4854545420 043F444020 3C4040207C 1C2040201C 3C4030403C 4428102844 0C5050503C 4464544C44
""")


def _glyph(ch: str) -> np.ndarray:
    """Seven rows of five dots; characters that the font lacks are a question mark."""
    at = ord(ch) - 32
    columns = FONT[5 * at : 5 * at + 5] if 0 <= at < len(FONT) // 5 else FONT[5 * 31 : 5 * 32]
    return (np.frombuffer(columns, np.uint8)[None, :] >> np.arange(7, dtype=np.uint8)[:, None]) & 1


def png(scene: Scene, scale: int = 2) -> bytes:
    """The scene in dots, ``scale`` a unit; the same scene gives the same bytes."""
    width, height = math.ceil(scene.width * scale), math.ceil(scene.height * scale)
    image = np.full((height, width, 3), 255, dtype=np.uint8)
    rgb = lambda color: tuple(int(color[k : k + 2], 16) for k in (1, 3, 5))

    def paint(ys: np.ndarray, xs: np.ndarray, color: tuple[int, int, int]) -> None:
        inside = (ys >= 0) & (ys < height) & (xs >= 0) & (xs < width)
        image[ys[inside], xs[inside]] = color

    for m in scene.marks:
        if isinstance(m, Line):
            n = max(2, math.ceil(max(abs(m.x2 - m.x1), abs(m.y2 - m.y1)) * scale) + 1)
            xs, ys = (np.rint(np.linspace(a * scale, b * scale, n)).astype(int) for a, b in ((m.x1, m.x2), (m.y1, m.y2)))
            paint(ys, xs, rgb(m.color))
        elif isinstance(m, Dot):
            r = m.radius * scale
            ys, xs = np.mgrid[math.floor(m.y * scale - r) : math.ceil(m.y * scale + r) + 1, math.floor(m.x * scale - r) : math.ceil(m.x * scale + r) + 1]
            disc = (ys - m.y * scale) ** 2 + (xs - m.x * scale) ** 2 <= r * r
            paint(ys[disc], xs[disc], rgb(m.color))
        else:
            dot = max(1, round(m.size * scale / 10))
            dots = np.concatenate([np.pad(_glyph(ch), ((0, 0), (0, 1))) for ch in m.text], axis=1) if m.text else np.zeros((7, 0), np.uint8)
            ys, xs = np.nonzero(np.kron(dots, np.ones((dot, dot), np.uint8)))
            left = m.x * scale - {"start": 0.0, "middle": 0.5, "end": 1.0}[m.anchor] * dots.shape[1] * dot
            paint(ys + round(m.y * scale) - 7 * dot, xs + round(left), (0, 0, 0))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 9)) + chunk(b"IEND", b"")


def scene_of(title: str, figure_rows: list[dict]) -> Scene:
    """The scene of rows of ``publication.figure_data`` in their order."""
    label = lambda r: f"{r['tour']} {r['slam']}" + (f" {r['period']}" if r.get("period") else "")
    return layout(title, [(r["panel"], label(r), r["model"], r["metric"], r["value"]) for r in figure_rows])
