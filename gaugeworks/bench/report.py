"""Reports of runs: Markdown, JSON, an HTML page, and the recommendation for a building."""

from __future__ import annotations

import html
import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import Row

from ..model import EXPECTED_WINNERS, FAMILIES, PROFILES, SEED, SENSOR_TYPES
from .runner import RunRow


def _table(head: list[str], rows: list[list]) -> str:
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(head), "|" + "---|" * len(head), *map(line, rows)]) + "\n"


def _latency(r: RunRow) -> list:
    return [r.query, r.layout, *(f"{x / 1000:.1f}" for x in (r.stats.median_ns, r.stats.p95_ns, r.stats.p99_ns)), f"{r.memory_bytes / 1024:.1f}"]


HEAD = ["Query", "Layout", "Median us", "p95 us", "p99 us", "KB"]


def markdown(rows: list[RunRow], winners: list[Row]) -> str:
    out = [f"# Layouts against the twelve queries\n\nSeed {SEED}.\n"]
    for scale in dict.fromkeys(r.scale for r in rows):
        out.append(f"## {scale}\n\n" + _table(HEAD, [_latency(r) for r in rows if r.scale == scale]))
        own = {w["query"]: w for w in winners if w["scale"] == scale}
        verdict = {True: "as expected", False: "not as expected", None: "—"}
        listed = [[q, FAMILIES[q], own[q]["winner"], own[q]["runner_up"] or "—", ", ".join(EXPECTED_WINNERS[q]) or "—", verdict[own[q]["as_expected"]]] for q in FAMILIES if q in own]
        out.append("### Fastest\n\n" + _table(["Query", "Family", "Fastest", "Second", "Expected", ""], listed))
    return "\n".join(out)


def as_json(rows: list[RunRow]) -> str:
    return json.dumps([asdict(r) for r in rows], indent=1)


def page(rows: list[RunRow]) -> str:
    """One tab a scale, without scripts; in it a bar a layout and query, as long as its median against the slowest."""
    scales = list(dict.fromkeys(r.scale for r in rows))
    shown = ",".join(f"#tab{i}:checked~#scale{i}" for i in range(len(scales))) or "section"
    parts = [f"<!doctype html><meta charset=utf-8><title>Layouts</title><style>body{{font:14px sans-serif;margin:2em}}.bar{{background:#60a5fa;height:12px}}td{{padding:2px 8px}}section{{display:none}}{shown}{{display:block}}</style>"]
    parts += [f'<input type=radio name=scale id=tab{i}{"" if i else " checked"}><label for=tab{i}>{html.escape(scale)}</label>' for i, scale in enumerate(scales)]
    for i, scale in enumerate(scales):
        parts.append(f"<section id=scale{i}><h2>{html.escape(scale)}</h2><table>")
        for query in dict.fromkeys(r.query for r in rows if r.scale == scale):
            own = [r for r in rows if (r.scale, r.query) == (scale, query)]
            slowest = max(r.stats.median_ns for r in own) or 1
            for r in own:
                parts.append(f'<tr><td>{html.escape(query)}<td>{html.escape(r.layout)}<td>{r.stats.median_ns / 1000:.1f} us<td style="width:300px"><div class=bar style="width:{100 * r.stats.median_ns / slowest:.0f}%"></div>')
        parts.append("</table></section>")
    return "\n".join(parts)


def recommendation(source: str, label: str, counts: dict[str, int], placed: dict[str, int], scores: list[Row], rows: list[RunRow], by_type: dict[str, list[Row]]) -> str:
    """counts: elements, zones, equipment, sensors; placed: sensors by type; scores as recommend gives them, best first."""
    listed = lambda s: _table(["Layout", "Score", "Coverage"], [[r["layout"], f"{r['score']:.3f}", f"{r['coverage'] * 100:.0f}%"] for r in s])
    best = lambda s: s[0]["layout"] if s else "none"
    days = {p.sensor_type: p.retention_days for p in PROFILES}
    out = [
        f"# Recommended layout\n\n- Source: `{source}`\n- Run: `{label}`\n- " + ", ".join(f"{n} {k}" for k, n in counts.items()) + "\n",
        "## Sensors by type\n\n" + _table(["Type", "Sensors", "Days kept"], [[t, placed[t], days[t]] for t in SENSOR_TYPES if placed.get(t)]),
        "## Recommendation\n\nA score is how many times the fastest layout's median a layout takes, averaged over the building's queries by their weights; 1 is best. Coverage is the share of those weights that the layout has times for.\n\n" + listed(scores) + f"\n**{best(scores)}**\n",
        "## By sensor type\n",
        *[f"**{t}**: {best(s)}\n\n" + listed(s) for t, s in by_type.items()],
        "## Latencies\n\n" + _table(HEAD, [_latency(r) for r in rows]),
    ]
    return "\n".join(out)


def write_suite(folder: str, rows: list[RunRow], winners: list[Row]) -> None:
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "latency.md").write_text(markdown(rows, winners))
    (out / "latency.json").write_text(as_json(rows))
    (out / "benchmark.html").write_text(page(rows))
