"""Spreadsheet formulas as tokens, by one scan."""

from __future__ import annotations

from collections.abc import Iterator

# Numbers in formulas that say nothing.
HARMLESS_NUMBERS = "0 1 2 -1 100 0.0 1.0".split()
_DIGITS, _LETTERS = frozenset("0123456789"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_WORD = _DIGITS | _LETTERS | frozenset("_.$")


def column_number(letters: str) -> int:
    """A is 1, Z 26, AA 27."""
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n


def address(word: str) -> tuple[str, int] | None:
    """Column letters and row of a word like ``$B$7``; none for other words."""
    bare = word.replace("$", "")
    n = next((i for i, c in enumerate(bare) if c not in _LETTERS), len(bare))
    letters, digits = bare[:n], bare[n:]
    if not (1 <= len(letters) <= 3 and letters.isupper() and 1 <= len(digits) <= 7 and set(digits) <= _DIGITS):
        return None
    return letters, int(digits)


def tokens(formula: str) -> Iterator[tuple[str, str, str]]:
    """(kind, sheet, text) of the cells, functions and bare numbers of a formula, in order.

    ``cell`` (of a range, both corners; the sheet is empty where none is named), ``function`` in capitals, ``number``.
    Quoted texts are scanned like the rest. A number that touches a letter, a sign of names or a colon is part of something else.
    """
    i, n, sheet = 0, len(formula), ""
    while i < n:
        c = formula[i]
        if c == "'" and (end := formula.find("'", i + 1)) > 0 and formula[end + 1 : end + 2] == "!":
            sheet, i = formula[i + 1 : end], end + 2
            continue
        if c not in _WORD:
            if c != ":":  # a range's second corner is on the sheet of the first
                sheet = ""
            i += 1
            continue
        end = i
        while end < n and formula[end] in _WORD:
            end += 1
        word, before, after = formula[i:end], formula[i - 1 : i], formula[end : end + 1]
        if after == "!":
            sheet, i = word, end + 1
            continue
        if formula[end:].lstrip().startswith("(") and word[0] in _LETTERS and "$" not in word and "_" not in word and len(word) > 1:
            yield "function", "", word.upper()
        elif address(word):
            yield "cell", sheet, word.replace("$", "")
        elif before not in (":", "$") and after not in (":", "(") and word[0] in _DIGITS and word.count(".") <= 1 and set(word) <= _DIGITS | {"."}:
            yield "number", "", word
        i = end


def cells_of(formula: str, sheet: str) -> list[tuple[str, str, int]]:
    """Distinct (sheet, column letters, row) that a formula on a sheet reads."""
    found = {(s or sheet, *address(text)) for kind, s, text in tokens(formula) if kind == "cell"}
    return sorted(found)


def functions_of(formula: str) -> list[str]:
    return sorted(text for kind, _, text in tokens(formula) if kind == "function")


def numbers_of(formula: str) -> list[str]:
    """Bare numbers that may deserve a cell of their own."""
    return sorted({text for kind, _, text in tokens(formula) if kind == "number"} - set(HARMLESS_NUMBERS))
