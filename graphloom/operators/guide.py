"""A guide to a code base for readers new to it."""

from __future__ import annotations

from ..graph import CodeGraph
from . import lookup, process


def agent_guide(graph: CodeGraph, name: str = "this repository") -> str:
    """Markdown: stack by language, main packages, symbols that many depend on, main flows."""
    lines = [f"# Guide to {name}", "", "## Languages", ""]
    lines += [f"- {r['language']}: {r['n']} symbols" for r in lookup.language_counts(graph).collect()]
    lines += ["", "## Packages", "", "| Package | Symbols | Exported | Languages |", "| --- | --- | --- | --- |"]
    lines += [f"| {r['package']} | {r['symbols']} | {r['exported']} | {', '.join(r['languages'])} |" for r in lookup.package_summary(graph).collect()]
    lines += ["", "## Handle with care", ""]
    lines += [f"- **{r['name']}** ({r['type']}) in `{r['file']}`: {r['callers']} callers" for r in lookup.critical_symbols(graph).collect()]
    lines += ["", "## Main flows", ""]
    lines += [f"- {r['label']}: {len(r['steps'])} steps" for r in process.detect_processes(graph, 10).select("label", "steps").collect()]
    return "\n".join(lines)
