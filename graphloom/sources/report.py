"""A member's report: the top of each measure as JSON, Markdown and HTML."""

from __future__ import annotations

import html
import json
from datetime import UTC, datetime
from secrets import token_hex

from pyspark.sql import DataFrame


def run_id() -> str:
    """UTC milliseconds and three random bytes."""
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%S.%f")[:-3] + "-" + token_hex(3)


def collect_sections(sections: dict[str, DataFrame], limit: int = 10) -> dict[str, list[dict]]:
    """The first rows of each section, ordered by the section itself; a report holds top lists only."""
    return {name: [r.asDict(True) for r in df.limit(limit).collect()] for name, df in sections.items()}


def as_json(data: dict[str, list[dict]], run: str) -> str:
    return json.dumps({"version": 1, "run": run, "sections": data}, default=str, ensure_ascii=False, indent=1)


def as_markdown(data: dict[str, list[dict]], title: str) -> str:
    out = [f"# {title}"]
    for name, rows in data.items():
        out += ["", f"## {name}", ""]
        if not rows:
            out.append("none")
            continue
        cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
        out += ["| " + " | ".join(rows[0]) + " |", "|" + "-|" * len(rows[0])]
        out += ["| " + " | ".join(cell(v) for v in r.values()) + " |" for r in rows]
    return "\n".join(out) + "\n"


def as_html(data: dict[str, list[dict]], title: str, run: str) -> str:
    """One page with the tables and the data; ``</`` can't end the script early."""
    tables = []
    for name, rows in data.items():
        head = "".join(f"<th>{html.escape(str(c))}</th>" for c in (rows[0] if rows else ()))
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str('' if v is None else v))}</td>" for v in r.values()) + "</tr>" for r in rows)
        tables.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    payload = as_json(data, run).replace("</", "<\\/")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(tables)}<script type=application/json id=data>{payload}</script>"
