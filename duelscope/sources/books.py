"""Annual price workbooks of one provider: what there is to fetch, checked before anything is."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path
from string import Formatter
from urllib.parse import urlsplit

from .files import OLE2, ZIP, SourceError

# fixed values: the provider, its host, the completed seasons of each tour, workbook formats before and from a season
PROVIDER = "Tennis-Data"
HOST = "www.tennis-data.co.uk"
SEASONS = {"ATP": (2001, 2025), "WTA": (2007, 2025)}
FORMATS = ("xls", "xlsx", 2013)
ABOUT = ("provider", "base_url", "all_data_url", "notes_url", "terms_url", "liability_disclaimer_url", "attribution", "rights_notice")


@dataclass(frozen=True)
class Books:
    """The workbooks of a tour, one per season."""

    tour: str
    start_year: int
    end_year: int
    directory_pattern: str
    filename_pattern: str
    legacy_extension: str
    current_extension: str
    extension_transition_year: int
    base_url: str

    #: nothing but address and bytes identifies a workbook
    pins = property(lambda self: {})

    def files(self) -> list[tuple[int, str, str]]:
        """(season, relative path, url) of every workbook."""
        out = []
        for year in range(self.start_year, self.end_year + 1):
            kind = self.current_extension if year >= self.extension_transition_year else self.legacy_extension
            folder, name = self.directory_pattern.format(year=year), self.filename_pattern.format(year=year, extension=kind)
            if any(not part or part in (".", "..") or set(part) & set("/\\") for part in (folder, name)):
                raise SourceError(f"{self.tour} {year}: not one folder and one file")
            out.append((year, f"{self.tour.lower()}/{name}", official(f"{self.base_url}/{folder}/{name}")))
        return out


def official(url: str) -> str:
    """The address without closing slashes, if it is plain http on the provider's host and nothing else."""
    if urlsplit(url)._replace(path="").geturl() != f"http://{HOST}" or "?" in url or "#" in url:
        raise SourceError(f"not a plain address of the provider: {url}")
    return url.rstrip("/")


def _fields(template: str) -> list[str]:
    """The fields of a template, sorted; a conversion or a format makes a name that no field has."""
    try:
        return sorted(f"{name}{convert or ''}{form}" for _, name, form, convert in Formatter().parse(template) if name is not None)
    except ValueError as e:
        raise SourceError(f"not a template: {template}") from e


def sources(path: str) -> tuple[list[Books], dict]:
    """Workbooks of both tours and what is said about the provider, from TOML."""
    given = tomllib.loads(Path(path).read_text())
    about = {k: str(given.get(k, "")).strip() for k in ABOUT}
    about |= {k: official(v) for k, v in about.items() if k.endswith("_url")}
    if given.get("schema_version") != 1 or about["provider"] != PROVIDER or not (about["attribution"] and about["rights_notice"]):
        raise SourceError("version 1 with the provider, its attribution and a notice of rights is needed")
    found = sorted((Books(**{**s, "tour": str(s["tour"]).upper()}, base_url=about["base_url"]) for s in given.get("sources", [])), key=lambda b: b.tour)
    if [b.tour for b in found] != sorted(SEASONS):
        raise SourceError(f"one source each for {sorted(SEASONS)} is needed")
    for b in found:
        if (b.start_year, b.end_year) != SEASONS[b.tour]:
            raise SourceError(f"{b.tour}: the completed seasons are {SEASONS[b.tour]}")
        if (b.legacy_extension, b.current_extension, b.extension_transition_year) != FORMATS:
            raise SourceError(f"{b.tour}: workbooks are {FORMATS[0]}, from {FORMATS[2]} on {FORMATS[1]}")
        if _fields(b.directory_pattern) != ["year"] or _fields(b.filename_pattern) != ["extension", "year"]:
            raise SourceError(f"{b.tour}: a folder names the year once, a file the year and the extension once")
    if len(paths := [p for b in found for _, p, _ in b.files()]) > len(set(paths)):
        raise SourceError("a path is given twice")
    return found, about


def workbook(path: str, content: bytes) -> None:
    """Raise unless the first bytes are those of the format that the name promises: error pages are not workbooks."""
    if not content.hex().upper().startswith(ZIP if path.endswith(".xlsx") else OLE2):
        raise SourceError(f"{path} is not a valid workbook")
