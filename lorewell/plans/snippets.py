"""Snippets: the best 14 tokens of a text with hits marked."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewell.functions.text import fold_plain

SIZE = 14
_TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}\p{Co}]+")


def snippet_of(text: str | None, phrases: list[list[str]], size: int = SIZE, mark: tuple[str, str] = ("<mark>", "</mark>"), dots: str = "…") -> str:
    """The window with most distinct phrases; sentence starts are preferred; overlapping hits share a mark."""
    if not text:
        return ""
    spans = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    words = [fold_plain(text[a:b]) for a, b in spans]
    n = len(words)
    hits = [(i, i + len(p), k) for k, p in enumerate(phrases) for i in range(n - len(p) + 1) if p and words[i : i + len(p)] == p]
    if n <= size:
        lo, hi = 0, n
    else:
        starts = [0] + [i for i in range(1, n) if regex.search(r"[.!?:]\s", text[spans[i - 1][1] : spans[i][0]])]
        best = (-1, 0)
        for first, last, _ in sorted(hits):
            inside = [h for h in hits if first <= h[0] and h[1] <= first + size]
            end = max([h[1] for h in inside] or [last])
            centred = min(max(0, first - (size - (end - first)) // 2), n - size)
            options = [(centred, 0)]
            if earlier := [s for s in starts if s < first]:
                options.append((min(earlier[-1], n - size), 120 if earlier[-1] == 0 else 100))
            for lo, bonus in options:
                own = [h for h in hits if lo <= h[0] and h[1] <= lo + size]
                kinds = len({h[2] for h in own})
                score = 1000 * kinds + len(own) - kinds + bonus if own else 0
                if score > best[0]:
                    best = (score, lo)
        lo, hi = best[1], best[1] + size
    covered = [False] * n
    for a, b, _ in hits:
        if lo <= a and b <= hi:
            covered[a:b] = [True] * (b - a)
    out = [dots] if lo > 0 else [text[: spans[0][0]]] if spans else []
    for i in range(lo, hi):
        if covered[i] and not (i > lo and covered[i - 1]):
            out.append(mark[0])
        out.append(text[spans[i][0] : spans[i][1]])
        if covered[i] and not (i + 1 < hi and covered[i + 1]):
            out.append(mark[1])
        if i + 1 < hi:
            out.append(text[spans[i][1] : spans[i + 1][0]])
    out.append(dots if hi < n else text[spans[-1][1] :] if spans else text)
    return "".join(out)


def snippet(text: Column, phrases: list[list[str]], size: int = SIZE) -> Column:
    """``snippet_of`` in Arrow batches, for the page that is shown."""
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([snippet_of(t, phrases, size) for t in texts])

    return apply(text)
