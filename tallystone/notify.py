"""A chat card about a finished run."""

from __future__ import annotations

import json
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame

from .functions.render import size_text
from .operators.reports import top_usage

TOP = 10


def top_rows(summary: DataFrame) -> DataFrame:
    """section, name, used: the largest users and the largest others."""
    parts = [top_usage(summary.where(f"section = '{s}'"), TOP).select("section", "name", "used") for s in ("user", "other")]
    return parts[0].unionByName(parts[1])


def card(report: dict) -> dict:
    """An adaptive card with capacity, teams, and the largest users of a report document."""
    room = report.get("general_system", {})
    total = room.get("total") or 1
    facts = [{"title": "Directory", "value": report.get("directory", "")}, {"title": "Used", "value": f"{size_text(room.get('used', 0))} ({room.get('used', 0) / total * 100:.1f} %)"}]
    facts += [{"title": t["name"], "value": size_text(t["used"])} for t in report.get("team_usage", [])]
    body: list[dict] = [{"type": "TextBlock", "weight": "Bolder", "text": "Storage usage"}, {"type": "FactSet", "facts": facts}]
    for title, key in (("Users", "user_usage"), ("Others", "other_usage")):
        rows = sorted(report.get(key, []), key=lambda r: (-r["used"], r["name"]))[:TOP]
        if rows:
            body += [{"type": "TextBlock", "weight": "Bolder", "text": title}, {"type": "FactSet", "facts": [{"title": r["name"], "value": size_text(r["used"])} for r in rows]}]
    content = {"type": "AdaptiveCard", "version": "1.4", "body": body}
    return {"type": "message", "attachments": [{"contentType": "application/vnd.microsoft.card.adaptive", "content": content}]}


def send(url: str, report: dict, timeout: float = 10.0) -> bool:
    """Post the card; a failure is no failure of the run."""
    request = Request(url, json.dumps(card(report)).encode(), {"Content-Type": "application/json"})
    try:
        with urlopen(request, timeout=timeout) as answer:
            return 200 <= answer.status < 300
    except OSError:
        return False
