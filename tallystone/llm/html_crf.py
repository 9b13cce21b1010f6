"""Main text of HTML pages: a linear-chain conditional random field over leaf blocks.

A page is read into its leaf blocks (``page_blocks``); each block's features are
its ancestors' tags and class words, and its own tag, length, links and wording.
The chain has two labels, main text and other; weights of features and of label
changes are trained on labelled pages by gradient ascent of the conditional
likelihood (forward-backward, all pages at once), and Viterbi finds the best
labels of a page. The blocks of the main text are joined by line feeds.

Training pages come from ``labelled_pages`` (``TRAIN_PAGES`` of them, from fixed
seeds) or from the caller. Only the weights, a few kilobytes, are broadcast.

Null or empty html, or a page without main text: empty text, n_chars 0. Null url
or page_id: returned as they are. Repeated rows get equal results; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled_pages import page as labelled_page
from .page_blocks import blocks, emission, own_features

TRAIN_PAGES = 900
STEPS, RATE, PENALTY = 160, 0.12, 0.02


class Field:
    """Weights for the label main text against other, and the four label changes' weights."""

    def __init__(self, weights: dict[str, float], change: np.ndarray, start: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.change, self.start = change.tolist(), start.tolist()
        self.score = emission(weights)

    def __reduce__(self):
        return Field, (self.weights, np.array(self.change), np.array(self.start), self.bias)

    def labels(self, page: str | None) -> tuple[list, list[int]]:
        """The blocks of a page and their best labels."""
        found = blocks(page)
        if not found:
            return found, []
        (t00, t01), (t10, t11) = self.change
        scores = self.score(found)
        a, b = self.start[0], self.start[1] + scores[0] + self.bias
        back = []
        for s in scores[1:]:
            back.append((a + t00 < b + t10, a + t01 < b + t11))
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + s + self.bias
        out = [int(b > a)]
        for from_other, from_main in reversed(back):
            out.append(int(from_main if out[-1] else from_other))
        return found, out[::-1]

    def text(self, page: str | None) -> str:
        found, labels = self.labels(page)
        return "\n".join(b.text for b, y in zip(found, labels, strict=True) if y)


def train(pages: list[tuple[str, list[int]]]) -> Field:
    """Fit the field to pages with a label for each block."""
    names: dict[str, int] = {}
    rows: list[list[list[int]]] = []
    labels = []
    for page, own in pages:
        found = blocks(page)
        if len(found) != len(own):
            raise ValueError(f"{len(own)} labels for a page of {len(found)} blocks")
        if not found:
            continue
        rows.append([[names.setdefault(f, len(names)) for f in (*sorted(b.features), *own_features(b, i, len(found)))] for i, b in enumerate(found)])
        labels.append(own)
    n, longest, size = len(rows), max(map(len, rows)), len(names) + 1
    x = np.zeros((n, longest, size), dtype=np.float32)
    y = np.zeros((n, longest), dtype=np.int64)
    on = np.zeros((n, longest), dtype=bool)
    for i, (page_rows, own) in enumerate(zip(rows, labels, strict=True)):
        for t, features in enumerate(page_rows):
            x[i, t, features] = 1
            x[i, t, -1] = 1
        y[i, : len(own)], on[i, : len(own)] = own, True
    flat = x.reshape(-1, size)
    w, change, start = np.zeros(size), np.zeros((2, 2)), np.zeros(2)
    pairs_on = on[:, 1:]
    seen_change = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs_on).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    seen_start = np.bincount(y[:, 0], minlength=2).astype(float)
    seen_w = flat.T @ (y * on).ravel().astype(np.float32)
    memory = [np.zeros_like(v) for v in (w, change, start) for _ in (0, 1)]
    for step in range(1, STEPS + 1):
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, longest)
        ahead, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            s = ahead[:, t - 1, :, None] + change
            step_ahead = np.logaddexp(s[:, 0], s[:, 1]) + e[:, t]
            ahead[:, t] = np.where(on[:, t, None], step_ahead, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            s = change + (e[:, t + 1] + back[:, t + 1])[:, None, :]
            back[:, t] = np.where(on[:, t + 1, None], np.logaddexp(s[:, :, 0], s[:, :, 1]), 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        node = np.exp(ahead + back - total[:, None, None]) * on[:, :, None]
        edge = np.exp(ahead[:, :-1, :, None] + change + (e[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs_on[:, :, None, None]
        grads = (
            seen_w - flat.T @ node[:, :, 1].ravel().astype(np.float32) - PENALTY * w,
            seen_change - edge.sum(axis=(0, 1)) - PENALTY * change,
            seen_start - node[:, 0].sum(axis=0) - PENALTY * start,
        )
        for k, (v, g) in enumerate(zip((w, change, start), grads, strict=True)):
            m, s = memory[2 * k], memory[2 * k + 1]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return Field({f: round(float(w[i]), 4) for f, i in names.items()}, change.round(4), start.round(4), round(float(w[-1]), 4))


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train([labelled_page(seed) for seed in range(TRAIN_PAGES)])


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [shared.value.text(value.as_py()) for value in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
