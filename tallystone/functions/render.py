"""Text of collected rows for the terminal. Nothing here runs on executors."""

from __future__ import annotations

import re
from datetime import datetime

KB = 1024


def size_text(size: float | None) -> str:
    if size is None:
        return ""
    if size < 0:
        return "0 B"
    for unit, name, digits in ((KB**4, "TB", 2), (KB**3, "GB", 1), (KB**2, "MB", 0), (KB, "KB", 0)):
        if size >= unit:
            return f"{size / unit:.{digits}f} {name}"
    return f"{int(size)} B"


def time_text(seconds: float, form: str = "%Y-%m-%d %H:%M:%S") -> str:
    """Local time of an epoch second; empty for what is none."""
    try:
        return datetime.fromtimestamp(seconds).strftime(form)
    except (OverflowError, OSError, ValueError, TypeError):
        return ""


def shortened(text: str, width: int) -> str:
    return text if len(text) <= width else text[: max(0, width - 3)] + "..."[: max(0, width)]


def highlighted(text: str, keyword: str, on: bool) -> str:
    """The keyword in bold, in any case; only for terminals."""
    return re.sub(re.escape(keyword), lambda m: f"\033[1m{m[0]}\033[0m", text, flags=re.I) if on and keyword else text


def table(headers: list[str], rows: list[tuple], title: str = "", width: int = 120) -> str:
    """A grid whose widest columns give way until it fits."""
    cells = [[str("" if v is None else v) for v in row] for row in rows]
    wide = [max([len(h), *(len(r[i]) for r in cells)]) for i, h in enumerate(headers)]
    while sum(wide) + 3 * len(wide) + 1 > width and max(wide) > 6:
        wide[wide.index(max(wide))] -= 1
    rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"

    def line(row: list[str]) -> str:
        parts = []
        for text, w in zip(row, wide, strict=True):
            text = shortened(text, w)
            number = re.fullmatch(r"[-+]?[\d.,]+( [KMGT]?B| ?%)?", text)
            parts.append(text.rjust(w) if number else text.ljust(w))
        return "| " + " | ".join(parts) + " |"

    out = [title] if title else []
    return "\n".join([*out, rule, line(list(headers)), rule, *map(line, cells), rule])


def bar(percent: float, width: int = 20) -> str:
    """A bar of ``width`` places, filled by percent."""
    full = round(width * min(100.0, max(0.0, percent)) / 100)
    return "[" + "#" * full + "-" * (width - full) + "]"


def grid(names: list[str], width: int = 100) -> str:
    """Names column by column."""
    if not names:
        return ""
    wide = max(map(len, names)) + 2
    columns = max(1, width // wide)
    high = -(-len(names) // columns)
    return "\n".join("".join(n.ljust(wide) for n in names[i::high]).rstrip() for i in range(high))


def tree(rows: list[dict], start: str, measure: str) -> str:
    """Rows (path, place, hidden, ``measure``) of a tree view as an ASCII tree below ``start``."""
    below: dict[str, list[dict]] = {}
    for r in rows:
        below.setdefault(r["path"].rpartition("/")[0] or "/", []).append(r)
    out = [start]

    def walk(path: str, lead: str) -> None:
        own = sorted(below.get(path, []), key=lambda r: r["place"])
        for i, r in enumerate(own):
            last = i == len(own) - 1 and not r["hidden"]
            out.append(f"{lead}{'`-- ' if last else '|-- '}{r['path'].rpartition('/')[2]}  [{size_text(r[measure])}]")
            walk(r["path"], lead + ("    " if last else "|   "))
        if own and own[0]["hidden"]:
            out.append(f"{lead}`-- ... {own[0]['hidden']} more")

    walk(start, "")
    return "\n".join(out)
