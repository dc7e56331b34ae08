"""Problem 5: splitting oversized items at natural boundaries.

Every place where a text may be cut has a strength: paragraph 5, list item 4, sentence 3, after ; or : 2, after a comma or a
closing bracket 1, white space 0. A sparse table answers, for any window, where the strongest cut lies.
A piece ends at the strongest cut of all that its permissible length reaches (after the end of the piece before), the rightmost of
equals. The next piece starts at the strongest place within the `overlap` characters before that cut, the leftmost of
equals, so that the overlap is as long as it may be. A window without any cut is cut at the limit.

Positions count characters (code points). Cases: null texts and texts within the limit give one piece (or no row, with
``only_long``); repeated ids give one set of pieces; null headings stay null.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.keys import reject_missing

LIMIT, OVERLAP = 1400, 140
PARAGRAPH, ITEM, SENTENCE, CLAUSE, PHRASE, SPACE = 5, 4, 3, 2, 1, 0

# Abbreviations after which a full stop ends no sentence, and those after which a capital starts one.
ABBREVIATIONS = frozenset("e.g i.e vs approx incl excl cf sec art fig para ch vol v p pp ca viz resp mr mrs ms dr prof st".split())
BEFORE_NUMBER = frozenset("no nos inc ltd co corp etc".split())

_END = re.compile(r"[.!?…][.!?…]*[\"'”’»)\]]*\s+")
_START = re.compile(r"[\"'“‘«(\[]*(?:[A-ZÀ-Þ0-9]|[a-z][A-Z])")
_PARAGRAPH = re.compile(r"\n[ \t\r\xa0]*\n\s*")
_BULLET = re.compile(r"(?:^|\n)[ \t\xa0]*(?=[•●▪◦‣·*–—-][ \t\xa0])")
_NUMBERED = re.compile(r"[:;.!?][\"'”’»)\]]*[ \t\xa0]*(?:and|or)?\s*\n[ \t\xa0]*(?=\d{1,3}[.)][ \t\xa0])")
_MARKER = re.compile(r"[:;][ \t\xa0]*(?:\s(?:and|or|and/or))?\s+(?=\((?:[a-z]{1,2}|[ivxl]{1,7}|\d{1,3})\)\s)")
_LEFT = re.compile(r"[\w.&/-]+$")


def _word_before(text: str, at: int) -> str:
    left = _LEFT.search(text, max(0, at - 24), at)
    return left.group() if left else ""


def _abbreviated(word: str) -> bool:
    """Whether a full stop after the word calls for what follows: a number of a section, a form, a register."""
    low = word.lower()
    return low in ABBREVIATIONS or low.rstrip(".") in ABBREVIATIONS or low in BEFORE_NUMBER or len(word) == 1 and word.isalpha()


def _starts_item(text: str, at: int) -> bool:
    """Whether a number at `at` numbers an item: it begins a line, and what stands before has come to an end."""
    before = text[:at].rstrip(" \t\xa0")
    if before and before[-1] != "\n":
        return False
    end = before.rstrip()
    end = re.sub(r"\s(?:and|or)$", "", end[-24:]).rstrip() if end else end
    return not end or end[-1] in ":;!?" or end[-1] == "." and not _abbreviated(_word_before(end, len(end) - 1)) or end[-1] in "\"'”’»)]" and end[-2:-1] in (".", "!", "?", ";")


def _ends_sentence(text: str, dot: int, nxt: int) -> bool:
    """Whether the mark at `dot` ends a sentence whose successor starts at `nxt`."""
    if not _START.match(text, nxt):
        return False
    if text[dot] != ".":
        return True
    word = _word_before(text, dot)
    if word.lower() in BEFORE_NUMBER:
        return not text[nxt].isdigit()
    if _abbreviated(word):
        return False
    return not (word.isdigit() and len(word) <= 3 and _starts_item(text, dot - len(word)))


def boundaries(text: str) -> dict[int, int]:
    """position -> strength of the starts of sentences, list items and paragraphs other than the first."""
    out: dict[int, int] = {}
    for m in _END.finditer(text):
        if m.end() < len(text) and _ends_sentence(text, m.start(), m.end()):
            out[m.end()] = SENTENCE
    for pattern in (_BULLET, _NUMBERED, _MARKER):
        for m in pattern.finditer(text):
            if pattern is not _NUMBERED or _starts_item(text, m.end()):
                out[m.end()] = ITEM
    for m in _PARAGRAPH.finditer(text):
        out[m.end()] = PARAGRAPH
    first = len(text) - len(text.lstrip())
    return {k: v for k, v in out.items() if first < k < len(text)}


class StrongestCut:
    """Sparse tables of range maxima over (strength, position), one with ties to the right and one with ties to the left: queries
    take constant time."""

    FAR = (1 << 40) - 1

    def __init__(self, at: np.ndarray, strength: np.ndarray):
        self.at = at
        self.right = self._levels(strength.astype(np.int64) << 40 | at.astype(np.int64))
        self.left = self._levels(strength.astype(np.int64) << 40 | self.FAR - at.astype(np.int64))

    @staticmethod
    def _levels(level: np.ndarray) -> list[np.ndarray]:
        out, step = [level], 1
        while 2 * step <= len(out[0]):
            level = np.maximum(level[:-step], level[step:])
            out.append(level)
            step *= 2
        return out

    def query(self, lo: int, hi: int, leftmost: bool = False) -> tuple[int, int] | None:
        """(position, strength) of the strongest cut with lo <= position <= hi, the rightmost of equals, or the leftmost."""
        i, j = np.searchsorted(self.at, (lo, hi + 1))
        if i >= j:
            return None
        levels, k = self.left if leftmost else self.right, int(j - i).bit_length() - 1
        best = int(max(levels[k][i], levels[k][j - (1 << k)]))
        place = best & self.FAR
        return self.FAR - place if leftmost else place, best >> 40

    def at_least(self, strength: int) -> list[tuple[int, int]]:
        """All (position, strength) of at least this strength, in order: the strongest of a range divides it, until none is left."""
        out, ranges = [], [(0, self.FAR - 1)]
        while ranges:
            lo, hi = ranges.pop()
            best = self.query(lo, hi) if lo <= hi else None
            if best and best[1] >= strength:
                out.append(best)
                ranges += [(lo, best[0] - 1), (best[0] + 1, hi)]
        return sorted(out)


def cuts(text: str) -> StrongestCut:
    strong = {m.end(): SPACE for m in re.finditer(r"\s+", text)}
    strong |= {m.end(): PHRASE for m in re.finditer(r"[,)\]”’]\s+", text)}
    strong |= {m.end(): CLAUSE for m in re.finditer(r"[;:]\s+", text)}
    strong |= boundaries(text)
    strong = {k: v for k, v in strong.items() if 0 < k < len(text)}
    at = np.array(sorted(strong), dtype=np.int64)
    return StrongestCut(at, np.array([strong[int(k)] for k in at], dtype=np.int64))


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces, each at most `limit` long, covering the text in order."""
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be less than half the limit")
    out, start, done = [], 0, 0
    table = cuts(text)
    while len(text) - start > limit:
        best = table.query(done + 1, start + limit)
        end = best[0] if best else start + limit
        out.append((start, end))
        back = table.query(max(start + 1, end - overlap), end - 1, leftmost=True) if overlap else None
        cold = end - overlap if end - overlap > start else end  # no place to start at: so many characters, but never backwards
        start, done = (back[0] if back else cold), end
    out.append((start, len(text)))
    return out


def _long(df: DataFrame, id_col: str, text: str, limit: int, *keep: str) -> DataFrame:
    reject_missing(df, id_col, text, *keep)
    extra = [F.col(c).cast("string").alias("heading") for c in keep]
    rows = df.where(F.length(text) > limit).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), *extra)
    return rows.where("id is not null").dropDuplicates(["id"])


def boundary_rows(df: DataFrame, id_col: str, text: str, limit: int = LIMIT) -> DataFrame:
    """(id, boundary_at, strength) for texts over the limit."""

    def run(batches):
        for batch in batches:
            rows = [(i, k, v) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, v in cuts(t).at_least(SENTENCE)]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32()))], ["id", "boundary_at", "strength"]
            )

    return _long(df, id_col, text, limit).mapInArrow(run, "id string, boundary_at int, strength int")


def pieces(df: DataFrame, id_col: str, text: str, heading: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece_no, start_at, end_at, heading, piece) for texts over the limit."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, t, h in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows += [(i, n, a, b, h, t[a:b]) for n, (a, b) in enumerate(split(t, limit, overlap))]
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "piece_no", "start_at", "end_at", "heading", "piece"])

    return _long(df, id_col, text, limit, heading).mapInArrow(run, "id string, piece_no int, start_at int, end_at int, heading string, piece string")
