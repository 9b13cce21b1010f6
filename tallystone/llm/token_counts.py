"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once, as a whole; token boundaries are mapped to character
offsets and joined with the sections' character intervals (both sorted, so the
join is a merge: one binary search for all boundaries). A token that crosses a
section boundary is allocated by an explicit rule:

``start``  to the section of its first character (default),
``end``    to the section of its last character,
``most``   to the section with most of its characters, the earlier one of equals.

Sections are given as spans or cut by ``sections`` (default: a section ends after
each run of line feeds, so sections cover the text). Characters outside every
section belong to none; tokens allocated there are counted in no section.

Null or empty text: no sections, hence no rows. Null doc_id: returned as it is.
Repeated rows are counted each. Ties of ``most`` go to the earlier section. Very
long texts are encoded part by part and attributed whole; what is held is about
50 bytes a token. An empty table gives no rows. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import codec, vocabulary_path
from .common import in_batches

Spans = list[tuple[int, int]]
ROWS_A_BATCH = 20_000


def line_sections(text: str) -> Spans:
    ends = [m.end() for m in re.finditer(r"\n+", text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return [(a, b) for a, b in zip([0, *ends], ends) if b > a]


def field_sections(fields: list[str | None], joiner: str = "\n") -> tuple[str, Spans]:
    """One text of several fields, and each field's span in it."""
    text, spans = [], []
    at = 0
    for i, f in enumerate(fields):
        if i:
            text.append(joiner)
            at += len(joiner)
        text.append(f or "")
        spans.append((at, at + len(f or "")))
        at += len(f or "")
    return "".join(text), spans


def attribute(first: np.ndarray, end: np.ndarray, spans: Spans, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary. ``spans`` are sorted and disjoint."""
    begins = np.array([a for a, _ in spans], dtype=np.int64)
    stops = np.array([b for _, b in spans], dtype=np.int64)
    n = len(spans)

    last = np.maximum(first, end - 1)
    low, high = np.searchsorted(begins, first, side="right") - 1, np.searchsorted(begins, last, side="right") - 1
    head = np.where((low >= 0) & (first < stops[low]), low, -1)
    tail = np.where((high >= 0) & (last < stops[high]), high, -1)
    if rule == "start":
        where = head
    elif rule == "end":
        where = tail
    elif rule == "most":
        where = head.copy()
        for i in np.flatnonzero((low != high) | (head != tail)):
            cover = [(max(0, min(int(stops[s]), int(end[i])) - max(int(begins[s]), int(first[i]))), -s) for s in range(max(0, int(low[i])), int(high[i]) + 1)]
            where[i] = -max(cover)[1] if cover and max(cover)[0] else -1
    else:
        raise ValueError(f"rule: {rule}")
    inside = where >= 0
    crossing = inside & (head != tail)
    return np.bincount(where[inside], minlength=n), np.bincount(where[crossing], minlength=n)


def section_tokens(docs: DataFrame, path: str | None = None, rule: str = "start", sections: Callable[[str], Spans] = line_sections) -> DataFrame:
    """doc_id, section, first_char, n_chars, n_tokens, n_crossing, doc_tokens: a row for each section."""
    path = path or vocabulary_path()
    kind = dict(docs.dtypes)["doc_id"]
    names = ["section", "first_char", "n_chars", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []

            def flush(own=b.column(0)):
                columns = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int64()) for k in range(len(names))]
                return pa.RecordBatch.from_arrays([own.take(pa.array(rows, pa.int64())), *columns], names=["doc_id", *names])

            for i, value in enumerate(b.column(1)):
                text = value.as_py()
                if not text:
                    continue
                coder = codec(path)
                ids = coder.encode(text)
                spans = sections(text)
                if not spans:
                    continue
                counts, crossing = attribute(*coder.char_spans(text, ids), spans, rule)
                at = np.array(spans, dtype=np.int64)
                rows += [i] * len(spans)
                parts.append((np.arange(len(spans)), at[:, 0], at[:, 1] - at[:, 0], counts, crossing, np.full(len(spans), len(ids) // 4)))
                if len(rows) >= ROWS_A_BATCH:
                    yield flush()
                    rows, parts = [], []
            yield flush()

    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))
