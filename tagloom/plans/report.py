"""HTML reports over small collected aggregates; inline SVG, no scripts."""

from __future__ import annotations

import html
import math

from pyspark.sql import DataFrame

COLOURS = ["#4c78a8", "#f58518", "#54a24b", "#e45756", "#72b7b2", "#b279a2", "#ff9da6", "#9d755d", "#bab0ac", "#2f4b7c", "#a05195", "#d45087"]


def pie(values: dict[str, float], size: int = 240) -> str:
    total, at, parts = sum(values.values()), -math.pi / 2, []
    r = size / 2
    for i, (name, v) in enumerate(values.items()):
        share = v / total if total else 0
        if share <= 0:
            continue
        end = at + 2 * math.pi * min(share, 0.99999)
        x0, y0, x1, y1 = (r + r * f(a) for a in (at, end) for f in (math.cos, math.sin))
        parts.append(f'<path d="M{r:.2f},{r:.2f} L{x0:.2f},{y0:.2f} A{r:.2f},{r:.2f} 0 {int(share > 0.5)} 1 {x1:.2f},{y1:.2f} Z" fill="{COLOURS[i % len(COLOURS)]}"><title>{html.escape(name)}: {v:g} ({share:.1%})</title></path>')
        at = end
    return f'<svg width="{size}" height="{size}">{"".join(parts)}</svg>'


def rows_table(df: DataFrame, most: int = 1000) -> str:
    """An HTML table of all rows; beyond ``most`` rows, of the first ones and a line that says so."""
    rows = df.limit(most + 1).collect()
    cut = f"<p>The first {most} of {df.count()} rows.</p>" if len(rows) > most else ""
    rows = rows[:most]
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"{cut}<table><tr>{head}</tr>{body}</table>"


def page(title: str, sections: list[tuple[str, str]]) -> str:
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px;text-align:right}"
    inner = "".join(f"<h2>{html.escape(h)}</h2>{b}" for h, b in sections)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{inner}</body></html>"


def decoding_report(stats: dict, title: str, path: str | None = None) -> str:
    """From the statistics object: outcomes of all reads, every failure included, and a table a library."""
    per_lib = stats.get("num_seqs_decoded_per_lib", {})
    outcomes = {"decoded": sum(per_lib.values())} | {k.removeprefix("num_failed_"): v for k, v in sorted(stats.items()) if k.startswith("num_failed_")}
    listed = "".join(f"<tr><td>{html.escape(k)}</td><td>{v}</td></tr>" for k, v in outcomes.items())
    libraries = "".join(f"<tr><td>{html.escape(k)}</td><td>{v}</td></tr>" for k, v in sorted(per_lib.items()))
    text = page(title, [("Reads", f"<p>{stats.get('num_seqs_read', 0)} reads</p>{pie(outcomes)}<table>{listed}</table>"), ("Libraries", f"<table>{libraries}</table>")])
    if path:
        with open(path, "w") as f:
            f.write(text)
    return text


def analysis_report(parts: dict[str, DataFrame], title: str, path: str | None = None) -> str:
    text = page(title, [(name, rows_table(df)) for name, df in parts.items()])
    if path:
        with open(path, "w") as f:
            f.write(text)
    return text
