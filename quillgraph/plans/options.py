"""What a view query may ask for: validated options, from and to a URL query."""

from __future__ import annotations

from dataclasses import dataclass, replace
from urllib.parse import parse_qs, urlencode

MODES = ("concept", "context", "institution")
UNITS = ("patent", "applicant")
COLOUR_MODES = ("community", "community_applicants", "first_year", "source", "ipc")
EDGE_WEIGHTS = ("jaccard", "npmi")
COMPARE_VIEWS = ("difference", "side-by-side")
MOST_PANELS = 6


@dataclass(frozen=True)
class ViewOptions:
    """year_range None: the full range of the graph."""

    mode: str = "concept"
    min_support: int = 1
    year_range: tuple[int, int] | None = None
    source_files: tuple[str, ...] = ()
    ipc_level: int = 3
    ipc_filter: tuple[str, ...] = ()
    unit: str = "patent"
    colour_mode: str | None = None
    edge_weight: str = "jaccard"
    show_semantic: bool = False
    show_citations: bool = False
    temporal_reference: str = "active"
    panels: tuple[tuple[str, ...], ...] = ()
    compare: bool = False
    compare_view: str | None = None
    max_year: int = 2035

    def __post_init__(self) -> None:
        for name, allowed in (("mode", MODES), ("unit", UNITS), ("edge_weight", EDGE_WEIGHTS), ("temporal_reference", ("active", "full"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}: {getattr(self, name)!r} is none of {allowed}")
        if self.compare_view not in (None, *COMPARE_VIEWS):
            raise ValueError(f"compare_view: {self.compare_view!r} is none of {COMPARE_VIEWS}")
        if self.colour_mode not in (None, *COLOUR_MODES):
            raise ValueError(f"colour_mode: {self.colour_mode!r} is none of {COLOUR_MODES}")
        if not 1 <= self.ipc_level <= 5:
            raise ValueError("ipc_level must be 1..5")
        if len(self.panels) > MOST_PANELS:
            raise ValueError(f"at most {MOST_PANELS} panels")

    @property
    def colours(self) -> str:
        """The colour mode in force: communities follow the unit unless another mode is chosen."""
        if self.colour_mode in (None, "community"):
            return "community_applicants" if self.unit == "applicant" else "community"
        return self.colour_mode


def from_query(query: str, repair_years: bool = False) -> ViewOptions:
    """Options of a URL query; what is malformed is left at its default. repair_years swaps a reversed year range instead."""
    p = parse_qs(query.lstrip("?"), keep_blank_values=True)
    one = lambda k: p[k][0] if k in p else None
    got: dict = {}
    for key, name, allowed in (("mode", "mode", MODES), ("unit", "unit", UNITS), ("colorMode", "colour_mode", COLOUR_MODES), ("ew", "edge_weight", EDGE_WEIGHTS), ("temporal_ref", "temporal_reference", ("active", "full")), ("compareView", "compare_view", COMPARE_VIEWS)):
        if one(key) in allowed:
            got[name] = one(key)
    for key, name in (("llm", "show_semantic"), ("citations", "show_citations"), ("compare", "compare")):
        if one(key) in ("0", "1"):
            got[name] = one(key) == "1"
    panels = tuple(tuple(x for x in p[k] if x) for k in (f"panel{i}" for i in range(MOST_PANELS)) if k in p)
    files = tuple(x for x in p.get("source", []) if x)
    right = tuple(x for x in p.get("rsource", []) if x)
    if panels:
        got["panels"] = panels
    elif right:
        got["panels"] = (files, right)
    if files and not panels:
        got["source_files"] = files
    if (one("ipcLevel") or "") in ("1", "2", "3", "4", "5"):
        got["ipc_level"] = int(one("ipcLevel"))
    if keys := tuple(x for x in p.get("ipc", []) if x):
        got["ipc_filter"] = keys
    if (one("minSupport") or "").isdigit() and int(one("minSupport")) >= 1:
        got["min_support"] = int(one("minSupport"))
    a, b = one("yearStart") or "", one("yearEnd") or ""
    if a.lstrip("-").isdigit() and b.lstrip("-").isdigit():
        years = (int(a), int(b))
        if years[0] <= years[1]:
            got["year_range"] = years
        elif repair_years:
            got["year_range"] = years[::-1]
    return ViewOptions(**got)


def to_query(o: ViewOptions) -> str:
    pairs: list[tuple[str, str]] = [("mode", o.mode), ("llm", "1" if o.show_semantic else "0"), ("minSupport", str(o.min_support)), ("unit", o.unit), ("ew", o.edge_weight), ("ipcLevel", str(o.ipc_level)), ("temporal_ref", o.temporal_reference), ("citations", "1" if o.show_citations else "0")]
    if o.compare:
        pairs.append(("compare", "1"))
    if o.compare_view:
        pairs.append(("compareView", o.compare_view))
    if o.colour_mode:
        pairs.append(("colorMode", o.colour_mode))
    if o.year_range:
        pairs += [("yearStart", str(o.year_range[0])), ("yearEnd", str(o.year_range[1]))]
    pairs += [("ipc", k) for k in o.ipc_filter]
    if o.panels:
        pairs += [(f"panel{i}", f) for i, own in enumerate(o.panels) for f in (own or ("",))]
    else:
        pairs += [("source", f) for f in o.source_files]
    return urlencode(pairs)


def normal_scopes(scopes: list[list[str]], known: list[str]) -> list[list[str]]:
    """Scopes with unknown files dropped and repeats removed, in order; a scope that names every file, or none, is empty: all files."""
    out = []
    for s in scopes:
        own = [f for f in dict.fromkeys(s) if f in set(known)]
        out.append([] if set(own) == set(known) else own)
    return out


def distinct_scopes(scopes: list[list[str]]) -> bool:
    return len({tuple(sorted(s)) for s in scopes}) == len(scopes)


def scope_key(dataset: list[str], o: ViewOptions, year: tuple[int, int]) -> str:
    """Identity of an analysis scope; each list sorted, the year range explicit."""
    joined = lambda xs: ",".join(sorted(xs))
    return f"dataset={joined(dataset)}|source={joined(o.source_files)}|ipc={joined(o.ipc_filter)}|unit={o.unit}|year={year[0]}-{year[1]}"


def with_panel(o: ViewOptions, files: list[str]) -> ViewOptions:
    return replace(o, source_files=tuple(files), panels=())
