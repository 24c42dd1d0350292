import json
import re
import xml.dom.minidom

import pytest
from hypothesis import given
from hypothesis import strategies as st

from duelscope.operators import metrics
from duelscope.plans import catalogue, figure, project

ROWS = [("rates", "A One", "elo", "expected", 30.0), ("rates", "A One", "elo", "actual", 31.0), ("rates", "A Two <&", "elo", "expected", None), ("excess", "A One", "elo", "gap", -1.5)]


@given(st.lists(st.floats(0, 100), max_size=30), st.floats(0.1, 20))
def test_spread_keeps_order_bounds_and_gap(places, gap):
    out = figure.spread(places, gap, 0.0, 100.0)
    kept = min(gap, 100 / max(len(places) - 1, 1))
    order = sorted(range(len(places)), key=lambda i: (places[i], i))
    assert all(-1e-6 <= v <= 100 + 1e-6 for v in out)
    assert all(out[b] - out[a] >= kept - 1e-6 for a, b in zip(order, order[1:]))


@given(st.floats(-1e6, 1e6), st.floats(1e-6, 1e6))
def test_ticks_cover_the_range(low, span):
    got = figure.ticks(low, low + span)
    slack = 1e-6 * (abs(low) + span)
    assert got[0] <= low + slack and got[-1] >= low + span - slack and 2 <= len(got) <= 9 and got == sorted(set(got))


def test_scene_has_every_value():
    scene = figure.layout("T", ROWS)
    texts = [m.text for m in scene.marks if isinstance(m, figure.Text)]
    assert {"rates", "excess", "A One", "A Two <&", "31.00", "-1.50"} <= set(texts)
    drawn = [m for m in scene.marks if isinstance(m, figure.Dot) and m.x > figure.MARGIN + figure.LABELS - 1]
    assert len([d for d in drawn if d.y > 60]) == 3
    assert all(0 <= m.y <= scene.height for m in scene.marks if not isinstance(m, figure.Line))
    with pytest.raises(ValueError):
        figure.layout("T", ROWS * figure.LIMIT)
    assert figure.layout("T", []).marks


def test_renderers():
    scene = figure.layout("T (x) \\ é €", ROWS)
    assert xml.dom.minidom.parseString(figure.svg(scene)).documentElement.tagName == "svg"
    page = figure.pdf(scene)
    start = int(re.search(rb"startxref\n(\d+)", page)[1])
    assert page == figure.pdf(scene) and page[start : start + 4] == b"xref"
    for k, at in enumerate(re.findall(rb"(\d{10}) 00000 n", page), 1):
        assert page[int(at) :].startswith(b"%d 0 obj" % k)
    length = int(re.search(rb"/Length (\d+)", page)[1])
    assert page.split(b"stream\n", 1)[1][length:].startswith(b"\nendstream") and rb"T \(x\) \\ " in page


def test_published_files(spark, folder, tmp_path):
    cells = catalogue.cells(spark, folder)
    got = project.publish(metrics.summaries(cells).where("slam is not null and population = 'completed_non_retirement'"), metrics.contrasts(cells).where("population = 'completed_non_retirement'"), str(tmp_path))
    lines = (tmp_path / "figure_data.csv").read_text().splitlines()
    assert got["rows"] == len(lines) - 1 > 0 and json.loads((tmp_path / "figure.json").read_text())["files"] == got["files"]
    assert xml.dom.minidom.parse(str(tmp_path / "figure.svg")).getElementsByTagName("circle").length > got["rows"] / 2


def unpacked(data):
    """The dots of a PNG of eight bits a colour without filters."""
    import struct
    import zlib

    import numpy as np

    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        parts[kind] = body
        at += 12 + size
    width, height = struct.unpack(">II", parts[b"IHDR"][:8])
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, 1 + 3 * width)
    assert not lines[:, 0].any() and b"IEND" in parts
    return lines[:, 1:].reshape(height, width, 3)


def test_png_shows_the_marks_where_they_are():
    scene = figure.Scene(60.0, 40.0, (figure.Line(5, 10, 50, 10, "#ff0000"), figure.Dot(30, 20, "#0000ff", 4), figure.Text(5, 36, "Ab1", 10), figure.Dot(500, 500, "#00ff00")))
    image = unpacked(figure.png(scene, 2))
    assert image.shape == (80, 120, 3) and figure.png(scene, 2) == figure.png(scene, 2)
    assert tuple(image[20, 60]) == (255, 0, 0) and tuple(image[40, 60]) == (0, 0, 255) and tuple(image[0, 0]) == (255, 255, 255)
    assert tuple(image[40, 60 + 9]) == (255, 255, 255) and (image[56:74, 8:60] == 0).all(axis=2).sum() > 30
    assert len(figure.FONT) == 5 * 91


def test_five_panels_are_published_in_order(spark, tmp_path):
    from duelscope.operators import contracts, publication
    from duelscope.plans import project

    rows = [(publication.PANELS[k % 5], "ATP", "Wimbledon", "overall_elo", "maximum_available", "1-2", "excess_per_100", float(k), 7, 10 - k) for k in range(10)]
    table = spark.createDataFrame(rows, "panel string, tour string, slam string, model string, sample string, period string, metric string, value double, score_matches long, place long")
    with pytest.raises(contracts.ContractError):
        project.publish_panels(table, str(tmp_path), {p: 3 for p in publication.PANELS})
    assert not list(tmp_path.iterdir())
    made = project.publish_panels(table, str(tmp_path), {p: 2 for p in publication.PANELS})
    assert made["rows"] == 10 and sorted(x.name for x in tmp_path.iterdir()) == ["figure.json", "figure.pdf", "figure.png", "figure.svg", "figure_data.csv"]
    assert [line.split(",")[-1] for line in (tmp_path / "figure_data.csv").read_text().splitlines()[1:]] == [str(k) for k in range(1, 11)]
    unpacked((tmp_path / "figure.png").read_bytes())
