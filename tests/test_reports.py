import json
import xml.dom.minidom

import pytest

from duelscope.operators import market, metrics, replay, resample
from duelscope.plans import catalogue, relational, reports
from duelscope.sources import configs, files


def test_configs_are_strict(tmp_path):
    at = tmp_path / "p.json"
    at.write_text(json.dumps({"replays": [{"variant": "a", "k": 16.0}, {"variant": "b", "retirement": 0.5}], "market": [{"policy": "m", "method": "power"}]}))
    assert configs.load(replay.Variant, str(at), "replays")[1].retirement == 0.5 and configs.load(market.Policy, str(at), "market")[0].method == "power"
    for bad in ({"variant": "a", "kk": 1}, {"variant": "a", "k": -1.0}, {"variant": "a", "duplicates": "x"}):
        at.write_text(json.dumps({"replays": [bad]}))
        with pytest.raises(files.SourceError):
            configs.load(replay.Variant, str(at), "replays")
    with pytest.raises(files.SourceError):
        configs.frozen({"seed": 1}, {"seed": 2})
    seen = configs.file_digests([str(at)])
    configs.unchanged(seen)
    at.write_text("{}")
    with pytest.raises(files.SourceError):
        configs.unchanged(seen)
    assert configs.digest({"b": 1, "a": 2}) == configs.digest({"a": 2, "b": 1})


def test_reports_and_figures(spark, folder):
    cells = catalogue.cells(spark, folder)
    text = reports.markdown("Upsets", {"Summaries": (metrics.summaries(cells), list(metrics.BASE))})
    assert text.startswith("# Upsets") and "| population | tour | slam | model |" in text
    svg = reports.interval_figure("Excess <per> 100", resample.intervals(cells, replicates=20), "excess_per_100")
    assert xml.dom.minidom.parseString(svg).documentElement.tagName == "svg"
    runs = resample.rolling_intervals(cells, size=2, replicates=20).collect()
    assert all(r["low"] is None or r["low"] <= r["high"] for r in runs)


def test_every_query_runs_on_the_smallest_tables(spark, folder):
    """Registered once, and each result has the columns of its SQL (values are compared by the oracle)."""
    assert relational and len(catalogue.QUERIES) >= 110
    for name in ("prj27_signatures", "j04_linkage", "u06_panel_difference", "s04_argmin", "mkt09_name_proposals"):
        assert catalogue.QUERIES[name](spark, folder).columns
