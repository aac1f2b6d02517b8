"""Short texts that describe scopes, filters and uploads."""

from __future__ import annotations

from quillgraph.plans.options import ViewOptions


def scope_label(files: list[str] | tuple[str, ...], everything: str = "all files") -> str:
    return everything if not files else files[0] if len(files) == 1 else f"{files[0]} +{len(files) - 1}"


def filter_summary(o: ViewOptions, full: tuple[int, int] | None = None) -> str:
    """What all panels of a comparison have in common."""
    parts = [f"mode={o.mode}", f"unit={o.unit}", f"support>={o.min_support}"]
    if o.year_range and o.year_range != full:
        parts.append(f"years {o.year_range[0]}-{o.year_range[1]}")
    if o.ipc_filter:
        parts.append(f"IPC L{o.ipc_level}: {', '.join(sorted(o.ipc_filter))}")
    return "; ".join(parts)


def upload_label(names: list[str], rows: int, most: int = 3) -> str:
    shown = ", ".join(names[:most]) + (f" and {len(names) - most} more" if len(names) > most else "")
    return f"{shown} ({rows:,} rows)"


def tooltip(node: dict) -> list[str]:
    """Lines about a node: label first, then whatever numbers it has."""
    lines = [str(node.get("label", ""))]
    for key, text in (("frequency", "patents"), ("applicant_count", "institutions"), ("patent_count", "patents filed"), ("concept_count", "concepts")):
        if node.get(key) is not None:
            lines.append(f"{text}: {node[key]}")
    if node.get("first_year") is not None:
        lines.append(f"years: {node['first_year']}-{node.get('last_year', node['first_year'])}")
    if node.get("median_year") is not None:
        lines.append(f"median year: {node['median_year']:g}")
    return lines


def file_name(title: str, mode: str, extension: str) -> str:
    safe = "".join(c if c.isalnum() or c in "-_" else "-" for c in title).strip("-") or "graph"
    return f"{safe}-{mode}.{extension}"
