"""Places of figures on pages, from boxes of words: lines, columns, captions, and the white space above."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OUT = "page_id string, caption string, column int, x0 double, y0 double, x1 double, y1 double"
CAPTION = ("figure", "fig.", "fig")


class Line:
    """Words of a line as (x0, text), and its extent."""

    __slots__ = ("bottom", "top", "words")

    def __init__(self, top: float, bottom: float, word: tuple[float, str]) -> None:
        self.top, self.bottom, self.words = top, bottom, [word]

    @property
    def text(self) -> str:
        return " ".join(text for _, text in sorted(self.words, key=lambda w: w[0]))


def lines_of(words: pd.DataFrame) -> list[Line]:
    """Words grouped into lines: those that overlap a line's height by half or more join it, the last such line first.

    Words come from the top, so a line that ends above one is never joined again, and only the others are kept at hand.
    """
    x0, y0, y1, text = (words[c].to_numpy() for c in ("x0", "y0", "y1", "text"))
    lines: list[Line] = []
    open_: list[Line] = []
    for k in np.lexsort((x0, y0)).tolist():
        top, bottom, word = float(y0[k]), float(y1[k]), (float(x0[k]), text[k])
        for line in reversed(open_):
            if min(line.bottom, bottom) - max(line.top, top) >= 0.5 * min(line.bottom - line.top, bottom - top):
                line.words.append(word)
                line.top, line.bottom = min(line.top, top), max(line.bottom, bottom)
                break
        else:
            lines.append(Line(top, bottom, word))
            open_ = [line for line in open_ if line.bottom >= top]
            open_.append(lines[-1])
    return lines


def column_split(words: pd.DataFrame, width: float) -> float | None:
    """Where a page parts into two columns: the place in its middle third that fewest words cross; null if many do."""
    places = [width * (0.35 + 0.01 * k) for k in range(31)]
    # A word crosses the places between its edges, so edges are counted up to each place.
    x0, x1 = words.x0.to_numpy(), words.x1.to_numpy()
    wide = x0 < x1
    crossed = (np.searchsorted(np.sort(x0[wide]), places, side="left") - np.searchsorted(np.sort(x1[wide]), places, side="right")).tolist()
    best = min(range(31), key=lambda k: (crossed[k], abs(places[k] - width / 2)))
    return places[best] if crossed[best] <= 0.02 * len(words) else None


def place_figures(words: pd.DataFrame) -> pd.DataFrame:
    """Captions of a page and the region above each, up to the text before it in the column."""
    width, page = float(words.page_width.iloc[0]), words.page_id.iloc[0]
    split = column_split(words, width)
    parts = [words] if split is None else [words[words.x1 <= split], words[words.x0 >= split]]
    out = []
    for number, part in enumerate(parts):
        if part.empty:
            continue
        left, right = (0.0, width) if split is None else ((0.0, split), (split, width))[number]
        bottom = 0.0
        for line in sorted(lines_of(part), key=lambda ln: ln.top):
            text = line.text
            if text.lower().startswith(CAPTION) and line.top - bottom > 2 * (line.bottom - line.top):
                out.append((page, text, number, left, bottom, right, line.top))
            bottom = line.bottom
    return pd.DataFrame(out, columns=["page_id", "caption", "column", "x0", "y0", "x1", "y1"])


def figure_regions(words: DataFrame) -> DataFrame:
    """Regions of all pages. ``words``: page_id, page_width, text, x0, y0, x1, y1; a group is one page."""
    return words.groupBy("page_id").applyInPandas(place_figures, OUT)
