"""p2: cut oversized texts into pieces under a word limit, along their own structure.

The gaps between words are graded (sentence end, line, list item or table row, paragraph, headings by level);
the grades span a tree whose nodes are stretches between stronger gaps. Sibling subtrees are merged bottom-up
to the limit and only oversized nodes are descended into; a stretch without any boundary is cut between words.
Every piece after the first repeats up to ``overlap`` words of its neighbour, from a natural boundary if one
lies in reach.

A word is a longest run of characters other than space, tab, carriage return and line feed. Texts at or under
the limit, null and blank texts give no piece. One word is never cut. Rows with a null id are ignored; of a
repeated id the latest row counts.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.session import latest_rows

LIMIT, OVERLAP = 512, 50
_WORD = re.compile(r"[^ \t\r\n]+")
_NEWLINE = re.compile(r"\r\n|\r|\n")
_SENTENCE_END = re.compile(r"[.!?…。！？؟][\"'”’»)\]]*$|[\u2028\u2029]$")
_HEADING = re.compile(r"#{1,6}$")
_ITEM = re.compile(r"([-*+•|]|\d{1,3}[.)])")
SENTENCE, LINE, ITEM, PARAGRAPH, HEADING = 1, 2, 3, 4, 5

PIECES = "piece int, n_pieces int, first_word int, n_words int, overlap int, content string"


def gap_grades(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Word spans, and for each word the grade of the gap before it (0: no natural boundary; the first has 0)."""
    spans = [m.span() for m in _WORD.finditer(text)]
    grades = [0] * len(spans)
    for i in range(1, len(spans)):
        end, start = spans[i - 1][1], spans[i][0]
        lines = len(_NEWLINE.findall(text[end:start])) if start - end > 1 or text[end] in "\r\n" else 0
        if lines:
            word = text[start : spans[i][1]]
            if _HEADING.match(word):
                grades[i] = HEADING + 6 - len(word)
            elif lines > 1:
                grades[i] = PARAGRAPH
            else:
                grades[i] = ITEM if _ITEM.match(word) else LINE
        elif _SENTENCE_END.search(text[max(spans[i - 1][0], end - 4) : end]):
            grades[i] = SENTENCE
    return spans, grades


def pack(grades: list[int], lo: int, hi: int, limit: int) -> list[int]:
    """Starts of the stretches, each of at most ``limit`` words, into which words ``lo``..``hi`` are packed."""
    if hi - lo <= limit:
        return [lo]
    top = max(grades[lo + 1 : hi])
    if top == 0:
        parts = -(-(hi - lo) // limit)
        return [lo + (hi - lo) * k // parts for k in range(parts)]
    cuts = [lo, *(i for i in range(lo + 1, hi) if grades[i] == top)]
    starts: list[int] = []
    for a, b in zip(cuts, [*cuts[1:], hi]):
        starts += pack(grades, a, b, limit)
    merged = [lo]
    for k, start in enumerate(starts[1:], 1):
        end = starts[k + 1] if k + 1 < len(starts) else hi
        if end - merged[-1] > limit:
            merged.append(start)
    return merged


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(first word, words, words repeated from the previous piece, text) of each piece."""
    spans, grades = gap_grades(text)
    starts = pack(grades, 0, len(spans), limit - overlap)
    out = []
    for k, start in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(spans)
        back = start
        if k and overlap:
            reach = range(max(starts[k - 1], start - overlap), start)
            back = next((i for i in reach if grades[i] >= SENTENCE), reach[0])
        out.append((back, end - back, start - back, text[spans[back][0] : spans[end - 1][1]]))
    return out


def word_count(text):
    return F.regexp_count(text, F.lit(r"[^ \t\r\n]+"))


def split_oversized(
    items: DataFrame, id_col: str = "id", text_col: str = "content", time_col: str | None = "ingested_at", limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces of every item of more than ``limit`` words: (id, piece, n_pieces, first_word, n_words, overlap, content).

    Only the texts of oversized rows are shuffled to find the latest row of an id; of other rows the time alone.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    big = word_count(F.col(text_col)) > limit
    rows = items.select(
        F.col(id_col).alias("_ll_id"),
        (F.col(time_col) if time_col else F.lit(None).cast("timestamp")).alias("_ll_time"),
        F.when(big, F.col(text_col)).alias("_ll_text"),
    )
    rows = latest_rows(rows, "_ll_id", "_ll_time") if time_col else rows
    rows = rows.where(F.col("_ll_text").isNotNull()).select("_ll_id", "_ll_text")
    schema = f"`{id_col}` {items.schema[id_col].dataType.simpleString()}, {PIECES}"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, cols = [], [[] for _ in range(6)]
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = pieces(text, limit, overlap)
                    for k, (first, n, back, content) in enumerate(found):
                        ids.append(key)
                        for col, value in zip(cols, (k, len(found), first, n, back, content)):
                            col.append(value)
                kinds = [pa.int32()] * 5 + [pa.string()]
                names = [id_col, "piece", "n_pieces", "first_word", "n_words", "overlap", "content"]
                arrays = [pa.array(ids, part.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, schema)
