"""Recursive character splitting with overlap, for use inside a pandas UDF."""

from __future__ import annotations

import pandas as pd
import pyspark.sql.functions as F

#: Separators from coarse to fine; the empty one splits into characters.
SEPARATORS = ["\n\n", "\n第", "\n", "。", "！", "？", "；", "，", ""]


def split_text(text: str, size: int = 512, overlap: int = 64, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most ``size`` characters. The first separator that occurs cuts the text and stays at the start of the part
    behind it; parts are packed greedily, and a new piece begins with the last parts of the one before, up to ``overlap``."""
    separators = SEPARATORS if separators is None else separators
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        head, *tail = text.split(separator)
        parts = [p for p in [head, *(separator + t for t in tail)] if p]
    else:
        parts = list(text)
    out: list[str] = []
    window: list[str] = []
    held = 0

    def emit() -> None:
        whole = "".join(window).strip()
        if whole:
            out.append(whole)

    for part in parts:
        if len(part) >= size and finer:
            emit()
            window, held = [], 0
            out.extend(split_text(part, size, overlap, finer))
            continue
        if held + len(part) > size and window:
            emit()
            while window and (held > overlap or held + len(part) > size):
                held -= len(window.pop(0))
        window.append(part)
        held += len(part)
    emit()
    return out


def splitter(size: int = 512, overlap: int = 64):
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return split
