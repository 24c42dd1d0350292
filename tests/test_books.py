import json

import pytest

from duelscope import cli
from duelscope.sources import books, fetch
from duelscope.sources.files import SourceError

SITE = f"http://{books.HOST}"


def config(tmp_path, old="", new=""):
    head = f'schema_version = 1\nprovider = "{books.PROVIDER}"\nattribution = "them"\nrights_notice = "ask them"\nbase_url = "{SITE}/"\n'
    head += "".join(f'{k} = "{SITE}/{k}.php"\n' for k in books.ABOUT if k.endswith("_url") and k != "base_url")
    for tour, first, folder in (("ATP", 2001, "{year}"), ("WTA", 2007, "{year}w")):
        head += f'[[sources]]\ntour = "{tour}"\nstart_year = {first}\nend_year = 2025\ndirectory_pattern = "{folder}"\nfilename_pattern = "{{year}}.{{extension}}"\nlegacy_extension = "xls"\ncurrent_extension = "xlsx"\nextension_transition_year = 2013\n'
    assert old in head
    at = tmp_path / "odds.toml"
    at.write_text(head.replace(old, new, 1) if old else head)
    return str(at)


def payload(url):
    return bytes.fromhex(books.ZIP if url.endswith("x") else books.OLE2) + url.encode()


def test_seasons_and_addresses(tmp_path):
    found, about = books.sources(config(tmp_path))
    at = {p: u for b in found for _, p, u in b.files()}
    assert len(at) == 25 + 19 and about["base_url"] == SITE
    assert at["atp/2012.xls"] == f"{SITE}/2012/2012.xls" and at["wta/2013.xlsx"] == f"{SITE}/2013w/2013.xlsx"


@pytest.mark.parametrize(("old", "new"), [
    ("end_year = 2025", "end_year = 2026"), ("start_year = 2001", "start_year = 2002"), ("schema_version = 1", "schema_version = 2"),
    ('"them"', '""'), ('tour = "WTA"', 'tour = "ATP"'), ("extension_transition_year = 2013", "extension_transition_year = 2012"),
    ('"{year}w"', '"w"'), ('"{year}w"', '"{year}/{year}"'), ('"{year}w"', '"../{year}"'), ('"{year}w"', '"{year!r}"'), ('"{year}w"', '"{year"'),
    ("{year}.{extension}", "{year:05}.{extension}"), ("{year}.{extension}", "{year}{year}.{extension}"),
    (f"{SITE}/notes_url.php", "http://elsewhere.org/notes"), (f"{SITE}/notes_url.php", f"https://{books.HOST}/notes"),
    (f"{SITE}/notes_url.php", f"{SITE}:80/notes"), (f"{SITE}/notes_url.php", f"http://me@{books.HOST}/notes"), (f"{SITE}/notes_url.php", f"{SITE}/notes?x=1"),
])
def test_config_is_refused(tmp_path, old, new):
    with pytest.raises(SourceError):
        books.sources(config(tmp_path, old, new))


def test_error_pages_drift_and_changed_locks_leave_no_file(tmp_path):
    found, about = books.sources(config(tmp_path))
    raw, lock = tmp_path / "raw", tmp_path / "lock.json"

    def run(downloader=payload):
        return fetch.fetch(found, str(raw), str(lock), downloader, check=books.workbook, about=about)

    broken = lambda url: b"<html>" if url.endswith("2025w/2025.xlsx") else payload(url)
    with pytest.raises(SourceError):
        run(broken)
    assert not lock.exists() and not list(raw.rglob("*.xls*"))
    assert run() == {"files": 44, "bytes": run()["bytes"], "new_lock": True}
    whole = lock.read_text()
    gone = raw / "atp/2001.xls"
    gone.unlink()
    with pytest.raises(SourceError):
        run(lambda url: payload(url) + b"drift")
    assert not gone.exists() and lock.read_text() == whole
    assert not run()["new_lock"] and gone.read_bytes() == payload(f"{SITE}/2001/2001.xls")
    for change in (lambda k: k["files"].append(k["files"][0]), lambda k: k["files"][0].update(path="../x.xls"), lambda k: k["files"][0].update(year=1999), lambda k: k["about"].update(attribution="me"), lambda k: k["sources"][0].update(base_url="http://elsewhere.org")):
        kept = json.loads(whole)
        change(kept)
        lock.write_text(json.dumps(kept))
        with pytest.raises(SourceError):
            run()
    lock.write_text(whole)
    gone.write_bytes(payload("other"))
    with pytest.raises(SourceError):
        run()
    assert gone.read_bytes() == payload("other")


def test_command(tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(fetch.fetch, "__defaults__", (payload, *fetch.fetch.__defaults__[1:]))
    assert cli.main(["fetch-odds", "--odds-config", config(tmp_path), "--odds-lock", str(tmp_path / "l.json"), "--odds-raw", str(tmp_path / "r")]) == 0
    assert json.loads(capsys.readouterr().out)["files"] == 44
