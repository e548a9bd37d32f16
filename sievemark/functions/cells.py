"""Packed cells: several values in one text field.

``split_cell`` is a finite-state tokenizer. Its states are *between values*, *in a bare value*, *in a
quoted part* (with a stack of the closing marks still due, so nesting depth is known) and *after an
escape*. A lexer hands it the next run of ordinary characters at once, so the automaton only takes a
step where something can change.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separators (comma, enumeration comma, semicolon, slash, vertical bar; each of any width).
SEPARATORS = ",，﹐､、﹑;；﹔/／|｜"
#: Quotation marks, opening mark to closing mark.
QUOTES = {'"': '"', "'": "'", "＂": "＂", "＇": "＇", "“": "”", "‘": "’", "「": "」", "『": "』", "｢": "｣", "«": "»"}
#: Marks that may enclose a cell as a whole.
BRACKETS = {"[": "]", "［": "］", "{": "}", "｛": "｝", "(": ")", "（": "）", "【": "】", "〔": "〕"}
#: Marks that stand for an apostrophe inside a word; they open a quotation only where a value begins.
_WORD_MARKS = "'＇‘"

_SEP = re.escape(SEPARATORS) + r"\s"
_MARK = re.escape("".join(dict.fromkeys([*QUOTES, *QUOTES.values()])))
_LEXER = re.compile(rf"(?P<sep>[{_SEP}]+)|(?P<esc>\\.)|(?P<mark>[{_MARK}])|(?P<run>[^{_SEP}{_MARK}\\]+|\\)", re.S)


def _unwrap(cell: str) -> str:
    """The cell without brackets that enclose it as a whole."""
    cell = cell.strip()
    while len(cell) > 1 and BRACKETS.get(cell[0]) == cell[-1]:
        opening, closing, depth = cell[0], cell[-1], 0
        for m in re.finditer("[" + re.escape(opening + closing) + "]", cell):
            depth += 1 if m.group() == opening else -1
            if not depth:
                break
        if depth or m.start() != len(cell) - 1:
            break
        cell = cell[1:-1].strip()
    return cell


def split_cell(cell: str | None) -> list[str]:
    """The values of a packed cell, in order; a null or blank cell has none.

    * Separators and white space part values; inside quotation marks they belong to the value.
    * Marks that enclose a value are dropped, and with them the doubling or backslash that protects
      a mark inside; marks within a value stay, but separators between them don't part it.
    * Brackets around the whole cell are dropped.
    * A mark that is never closed is an ordinary character. Empty values are left out; equal ones stay.
    """
    if cell is None:
        return []
    text = _unwrap(cell)
    last = {c: text.rfind(c) for c in {*QUOTES.values()}}
    out: list[str] = []
    _scan(text, 0, last, out)
    return out


def _scan(text: str, start: int, last: dict[str, int], out: list[str]) -> None:
    literal_from: int | None = None  # from here on marks are ordinary: a quotation that began there never ended
    while True:
        raw: list[str] = []  # the value as it stands
        inner: list[str] = []  # the value without its enclosing marks
        stack: list[str] = []
        enclosed = False  # the value began with a mark and nothing has followed the closing one
        opened_at, n_before = -1, len(out)
        value_start = start
        pos, size = start, len(text)
        while pos < size:
            m = _LEXER.match(text, pos)
            kind, piece = m.lastgroup, m.group()
            nxt = m.end()
            if kind == "sep" and not stack:
                _emit(out, raw, inner, enclosed)
                raw, inner, enclosed = [], [], False
                n_before, value_start = len(out), nxt
            elif kind == "mark" and (literal_from is None or pos < literal_from):
                if stack and piece == stack[-1]:
                    if len(stack) == 1 and text[nxt : nxt + 1] == piece and piece in "\"'＂＇":  # doubled
                        raw.append(piece * 2)
                        inner.append(piece)
                        nxt += 1
                    else:
                        stack.pop()
                        raw.append(piece)
                        if stack:
                            inner.append(piece)
                elif piece in QUOTES and last[QUOTES[piece]] > pos and (not stack or piece == opened_mark) and (QUOTES[piece] != piece or not stack):
                    if not stack:
                        if raw and piece in _WORD_MARKS:
                            raw.append(piece)
                            inner.append(piece)
                            pos = nxt
                            continue
                        opened_at, opened_mark = pos, piece
                        enclosed = not raw
                    else:
                        inner.append(piece)
                    stack.append(QUOTES[piece])
                    raw.append(piece)
                else:
                    raw.append(piece)
                    inner.append(piece)
                    enclosed = enclosed and bool(stack)
            elif kind == "esc" and (piece[1] in _ESCAPABLE):
                raw.append(piece)
                inner.append(piece[1])
                enclosed = enclosed and bool(stack)
            elif kind == "esc":
                raw.append("\\")
                inner.append("\\")
                enclosed = enclosed and bool(stack)
                nxt = pos + 1
            else:
                raw.append(piece)
                inner.append(piece)
                enclosed = enclosed and bool(stack)
            pos = nxt
        if stack:  # never closed: read the value again with its marks as ordinary characters
            del out[n_before:]
            start, literal_from = value_start, opened_at
            literal_from = min(opened_at, literal_from)
            continue
        _emit(out, raw, inner, enclosed)
        return


_ESCAPABLE = "\\" + "".join(dict.fromkeys([*QUOTES, *QUOTES.values()]))


def _emit(out: list[str], raw: list[str], inner: list[str], enclosed: bool) -> None:
    value = "".join(inner if enclosed else raw)
    if value.strip():
        out.append(value)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split_cells(cells: pd.Series) -> pd.Series:
    return cells.map(split_cell)


def cell_values(cell: Column) -> Column:
    """``split_cell`` over a column, by Arrow batches."""
    return _split_cells(cell)
