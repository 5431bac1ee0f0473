"""The report of a full run: small results as records, as plain text, and as one HTML page with bar charts.

Only results in `SECTIONS` are collected, each up to `MOST` rows, so the driver holds a page, not a table. Numbers are formatted in Python
from raw doubles. The page is one file without scripts; it shows the day and time of the run.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from datetime import UTC, datetime
from html import escape

from pyspark.sql import DataFrame

#: Rows of a result that are collected at most; of the graph's nodes and edges.
MOST, MOST_OF_GRAPH = 200, 4000
#: Title and results of each section, in order.
SECTIONS = {
    "Data": ["dataset_shapes", "dataset_footprints", "null_percentages", "unparsed_values"],
    "Events": ["event_counts", "conversion_funnel", "time_span", "daily_average", "visitors_and_items", "top_items", "concentration", "events_per_hour", "events_per_weekday", "item_popularity_histogram"],
    "Items and categories": ["top_properties", "category_mapping", "availability", "top_item_categories", "top_event_categories", "item_features_summary", "top_items_by_popularity", "top_categories_by_popularity"],
    "Category tree": ["tree_summary", "top_parents"],
    "Users": ["user_type_distribution", "users_with_category_preference", "anomaly_summary", "top_anomalies"],
    "Sessions": ["session_summary", "session_patterns", "conversion_by_length", "frequent_transitions"],
}
GRAPH = ("figure_nodes", "figure_edges")
#: Under this name, `collected` lists the results that it cut.
CUT = "left out"
#: Results with a chart: the label's column and the value's.
CHARTS = {
    "event_counts": ("event", "n"),
    "user_type_distribution": ("user_type", "n"),
    "events_per_hour": ("hour", "n"),
    "item_popularity_histogram": ("bin", "n_items"),
    "session_patterns": ("session_pattern", "n"),
    "top_event_categories": ("categoryid", "n"),
    "conversion_by_length": ("session_length", "conversion_rate"),
}


def records(df: DataFrame, most: int = MOST) -> list[dict]:
    """The first rows of a small result as dictionaries."""
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def collected(results: Mapping[str, DataFrame], most: int = MOST) -> dict[str, list[dict]]:
    """Records of the results that the report shows."""
    wanted = [*[(name, most) for names in SECTIONS.values() for name in names], *[(name, MOST_OF_GRAPH) for name in GRAPH]]
    found = {name: records(results[name], n + 1) for name, n in wanted if name in results}
    cut = [{"name": name, "rows": n} for name, n in wanted if len(found.get(name, ())) > n]
    return {name: rows[: dict(wanted)[name]] for name, rows in found.items()} | {CUT: cut}


def left_out(found: Mapping[str, list[dict]], name: str) -> str:
    """What the report says where it doesn't show all rows of a result."""
    return next((f"the first {x['rows']:,} rows; more aren't shown" for x in found.get(CUT, ()) if x["name"] == name), "")


def shown(value: object) -> str:
    """Numbers with separators and at most two digits, everything else as it prints."""
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    return f"{value:,.2f}" if isinstance(value, float) else str(value)


def cells(row: Mapping) -> list[str]:
    """Ids keep their digits together."""
    return [str(v) if k.endswith("id") or k in ("node", "from_item", "to_item") else shown(v) for k, v in row.items()]


def as_text(found: Mapping[str, list[dict]]) -> str:
    lines: list[str] = []
    for title, names in SECTIONS.items():
        lines += [title.upper(), "=" * len(title)]
        for name in (n for n in names if n in found):
            lines.append(f"\n{name.replace('_', ' ')}")
            rows = [list(found[name][0]), *map(cells, found[name])] if found[name] else [["no rows"]]
            widths = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
            if note := left_out(found, name):
                lines.append(f"  ({note})")
            lines += ["  " + "  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in rows]
        lines.append("")
    return "\n".join(lines)


def chart(rows: list[dict], label: str, value: str) -> str:
    """Horizontal bars as SVG, longest 400 units."""
    values = [float(r[value] or 0) for r in rows]
    unit = 400 / (max(values, default=0) or 1)
    bars = "".join(
        f'<text x="170" y="{20 * i + 14}" text-anchor="end">{escape(str(r[label]))}</text><rect x="180" y="{20 * i + 2}" width="{v * unit:.1f}" height="16"/><text x="{185 + v * unit:.1f}" y="{20 * i + 14}">{escape(shown(r[value]))}</text>'
        for i, (r, v) in enumerate(zip(rows, values, strict=True))
    )
    return f'<svg viewBox="0 0 700 {20 * len(rows) + 4}" width="700">{bars}</svg>'


def graph(nodes: list[dict], edges: list[dict]) -> str:
    """The category graph as SVG, a row for each depth; edges whose ends are both shown. What a node stands for, or hides, is in its title."""

    def title(n: dict) -> str:
        return n["node"] + (f": {n['n']:,} more" if n["n"] > 1 or n["node"].startswith("children") else "") + (f"; {n['parents_left_out']:,} parents aren't drawn" if n["parents_left_out"] else "")

    widest = max((n["x"] for n in nodes), default=1)
    rows = {y: max(n["x"] for n in nodes if n["y"] == y) for y in {n["y"] for n in nodes}}
    at = {n["node"]: (900 * (n["x"] - 0.5) / rows[n["y"]], 30 + 110 * n["y"]) for n in nodes}
    lines = "".join(f'<line x1="{at[a][0]:.1f}" y1="{at[a][1]}" x2="{at[b][0]:.1f}" y2="{at[b][1]}"/>' for e in edges if (a := e["src"]) in at and (b := e["dst"]) in at)
    dots = "".join(
        f'<circle cx="{at[n["node"]][0]:.1f}" cy="{at[n["node"]][1]}" r="{n["size"] / (2 if widest < 60 else 5):.1f}"><title>{escape(title(n))}</title></circle>' + (f'<text x="{at[n["node"]][0]:.1f}" y="{at[n["node"]][1] - 12}" text-anchor="middle">{escape(title(n))}</text>' if n["labelled"] else "") for n in nodes
    )
    return f'<svg viewBox="0 0 900 {60 + 110 * max(rows, default=0)}" width="900">{lines}{dots}</svg>'


STYLE = "body{font:15px sans-serif;max-width:60em;margin:2em auto}table{border-collapse:collapse;margin:.5em 0}td,th{padding:.2em .8em;border-bottom:1px solid #ccc;text-align:left}svg{font:12px sans-serif}rect,circle{fill:#4878a8}line{stroke:#bbb}"


def as_html(found: Mapping[str, list[dict]], at: datetime | None = None) -> str:
    parts = [f"<h1>Clickstream report</h1><p>{at or datetime.now(UTC):%Y-%m-%d %H:%M:%S}</p>"]
    for title, names in SECTIONS.items():
        parts.append(f"<h2>{escape(title)}</h2>")
        if title == "Category tree" and found.get("figure_nodes"):
            parts.append(graph(found["figure_nodes"], found.get("figure_edges", [])))
            parts += [f"<p>{name.replace('_', ' ')}: {note}</p>" for name in GRAPH if (note := left_out(found, name))]
        for name in (n for n in names if n in found):
            rows = found[name]
            parts.append(f"<h3>{escape(name.replace('_', ' '))}</h3>")
            if note := left_out(found, name):
                parts.append(f"<p>{note}</p>")
            if name in CHARTS:
                parts.append(chart(rows, *CHARTS[name]))
            if name == "conversion_funnel" and rows:
                parts.append(chart([{"step": k, "events": rows[0][k]} for k in ("views", "carts", "transactions")], "step", "events"))
            head = "".join(f"<th>{escape(k)}</th>" for k in rows[0]) if rows else ""
            body = "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in cells(r)) + "</tr>" for r in rows)
            parts.append(f"<table><tr>{head}</tr>{body}</table>" if rows else "<p>no rows</p>")
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Clickstream report</title><style>{STYLE}</style></head><body>{"".join(parts)}</body></html>'


def write(found: Mapping[str, list[dict]], folder: str) -> None:
    """report.html and report.txt in a folder of the driver; older ones are replaced."""
    os.makedirs(folder, exist_ok=True)
    for name, text in (("report.html", as_html(found)), ("report.txt", as_text(found))):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
