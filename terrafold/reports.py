"""Reports as JSON and Markdown, from small tables of measures."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame

from terrafold.functions.labels import LABELS

CLASSES = ("UNKNOWN", "DRIVABLE", "NON_DRIVABLE_TERRAIN", "STATIC_OBSTACLE", "DYNAMIC")


def rows_of(table: DataFrame, most: int = 100_000) -> list[dict]:
    """The rows of a table of measures, which must be small."""
    got = [r.asDict(recursive=True) for r in table.limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"a report of more than {most} rows")
    return got


def write_json(report: dict, path: str) -> str:
    """Write a report, with sorted keys and ISO dates; returns the text."""
    text = json.dumps(report, indent=2, sort_keys=True, default=lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text + "\n", encoding="utf-8")
    return text


def _cell(value: object) -> str:
    if value is None:
        return "n/a"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown(rows: Sequence[dict], columns: Sequence[str], title: str | None = None) -> str:
    """A Markdown table of rows; numbers stand to the right."""
    numeric = {c: any(isinstance(r.get(c), (int, float)) and not isinstance(r.get(c), bool) for r in rows) for c in columns}
    lines = [f"# {title}", ""] if title else []
    lines += ["| " + " | ".join(columns) + " |", "|" + "|".join("---:" if numeric[c] else "---" for c in columns) + "|"]
    lines += ["| " + " | ".join(_cell(r.get(c)) for c in columns) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def stats_markdown(stats: DataFrame, labels: Sequence[str]) -> str:
    """metrics.data_stats() by sequence: points, classes, moving and critical points in each bucket."""
    rows, out = rows_of(stats), []
    for seq in sorted({r["seq"] for r in rows}):
        own = [r for r in rows if r["seq"] == seq and not r["all_buckets"]]
        beyond = sum(r["n"] for r in own if r["all_classes"] and r["bucket"] == -1)

        def line(name: str, value: str, pick) -> dict:
            by = {r["bucket"]: r[value] for r in own if pick(r)}
            return {"": name} | {label: by.get(k, 0) for k, label in enumerate(labels)}

        table = [line("points", "n", lambda r: r["all_classes"])]
        table += [line(c, "n", lambda r, k=k: not r["all_classes"] and r["super_cls"] == k) for k, c in enumerate(CLASSES)]
        table += [line("moving points", "n_moving", lambda r: r["all_classes"]), line("safety-critical points", "n_critical", lambda r: r["all_classes"])]
        out.append(markdown(table, ["", *labels], f"Sequence {seq}") + f"\nPoints beyond the last bucket: {beyond:,}\n")
    return "\n".join(out)


def semantic_markdown(overall: dict, buckets: Sequence[dict], labels: Sequence[str]) -> str:
    """Accuracy, mean IoU and unknown rate, overall and by distance."""
    rows = [{"distance": labels[b["bucket"]] if b["bucket"] >= 0 else "beyond"} | b for b in sorted(buckets, key=lambda b: (b["bucket"] < 0, b["bucket"]))]
    head = f"mean IoU {_cell(overall.get('miou'))}, accuracy {_cell(overall.get('accuracy'))}, {_cell(overall.get('n'))} points\n\n"
    return head + markdown(rows, ["distance", "n", "n_evaluated", "unknown_rate", "miou", "accuracy"])


def motion_markdown(by_gap: DataFrame) -> str:
    return markdown(sorted(rows_of(by_gap), key=lambda r: r["gap"]), ["gap", "tp", "fp", "fn", "iou", "parked_fpr"], "Motion by gap")


def hazard_report(rates: DataFrame) -> dict:
    """detection_rates() as a report: the total, and rates by each column with their intervals."""
    rows = rows_of(rates)
    by = [c.removeprefix("all_") for c in rates.columns if c.startswith("all_")]
    entry = lambda r: {"n": r["n"], "hits": r["hits"], "rate": r["rate"], "interval": [r["low"], r["high"]]}
    out: dict = {"total": next((entry(r) for r in rows if all(r[f"all_{c}"] for c in by)), None)}
    for c in by:
        out[f"by_{c}"] = {str(r[c]): entry(r) for r in rows if not r[f"all_{c}"]}
    return out


def class_names() -> dict[int, str]:
    """Raw ids and their names."""
    return {k: n for k, n, *_ in LABELS}
