"""Reports and plain figures from small result tables."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame

LIMIT = 5000


def _cells(df: DataFrame, order: list[Column | str]) -> list[list[str]]:
    rows = df.orderBy(*order).limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"a report of more than {LIMIT} rows")
    show = lambda v: "" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    return [[show(v) for v in r] for r in rows]


def markdown(title: str, tables: dict[str, tuple[DataFrame, list[Column | str]]]) -> str:
    """A document with one table per heading."""
    out = [f"# {title}", ""]
    for heading, (df, order) in tables.items():
        out += [f"## {heading}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(c.replace("|", "\\|") for c in row) + " |" for row in _cells(df, order)]
        out.append("")
    return "\n".join(out)


def dots(title: str, rows: list[tuple[str, float, float | None, float | None]], width: int = 640) -> str:
    """An SVG of labelled points, with intervals where they are given."""
    values = [v for _, *vs in rows for v in vs if v is not None]
    low, high = (min([0.0, *values]), max([0.0, *values])) if values else (0.0, 1.0)
    span = (high - low) or 1.0
    x = lambda v: 220 + (v - low) / span * (width - 250)
    height = 50 + 22 * len(rows)
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">', f'<text x="10" y="20" font-size="14">{escape(title)}</text>', f'<line x1="{x(0):.1f}" x2="{x(0):.1f}" y1="30" y2="{height - 10}" stroke="#bbb"/>']
    for k, (label, point, a, b) in enumerate(rows):
        y = 46 + 22 * k
        parts.append(f'<text x="10" y="{y + 4}">{escape(label)}</text>')
        if a is not None and b is not None:
            parts.append(f'<line x1="{x(a):.1f}" x2="{x(b):.1f}" y1="{y}" y2="{y}" stroke="#555"/>')
        parts.append(f'<circle cx="{x(point):.1f}" cy="{y}" r="4" fill="#1f5fa8"/>')
    return "\n".join([*parts, "</svg>"])


def interval_figure(title: str, intervals: DataFrame, metric: str) -> str:
    """One metric of all cells with its intervals."""
    rows = intervals.where(f"metric = '{metric}' and point is not null").orderBy("tour", "slam", "model").limit(LIMIT).collect()
    return dots(title, [(" ".join(str(r[c] or "other") for c in ("tour", "slam", "model")), r["point"], r["low"], r["high"]) for r in rows])
