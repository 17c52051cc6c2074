"""Problem 3: splitting oversized items at natural boundaries.

Separators form a hierarchy: section, paragraph, line, sentence, word, character. An item over the limit is taken apart by the first
level; a part that could never be whole in a piece (it is longer than the limit less the overlap) is taken apart by the next, and so
on. The parts are packed greedily: a piece takes parts while they fit, ends where a part ends, and the next piece starts ``overlap``
characters before that end. A part that fits no more but could stand in the next piece is left whole for it.

An item is *forced* if a part over the limit had to be taken apart below the sentence, else *natural*. Overlap and limit may
leave no room for a part that is within the limit; then it is cut at a blank, and the item is still natural. The kind of an item comes out of the
same pass as its pieces.

The work is a narrow pass over the items that are too long (the length filter runs in the JVM), linear in the text and
its levels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("section", "paragraph", "line", "sentence", "word", "character")

# Abbreviations whose stop ends no sentence, lower case, without the stop.
ABBREVIATIONS = frozenset("""approx art assoc av bd ca cf ch chap co col corp dept dr ed eds eg env et al etc ex fdn fig figs ft
gen gov hon ibid ie inc inst jr l lab lt ltd m max me mgr min mlle mm mme mr mrs ms mt no nos nr op p par pp prof pt ref resp
rev sec sect sr st ste tab tel univ v viz vol vols vs""".split())

_SECTION = re.compile(r"\f+|(?:\r?\n[^\S\n]*){3,}")
_PARAGRAPH = re.compile(r"(?:\r?\n[^\S\n]*){2,}")
_LINE = re.compile(r"\r\n|[\n\r\v\f\x1c-\x1e\x85  ]")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+(?=\S)")
_WORD = re.compile(r"\s+")
_LAST_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*$")


def _sentence_ends(text: str, start: int, end: int) -> Iterator[int]:
    for m in _SENTENCE.finditer(text, start, end):
        if m.end() >= end or not text[m.end()].isupper():
            continue
        if text[m.start()] == "." and m.group().rstrip() == ".":
            word = _LAST_WORD.search(text, max(start, m.start() - 40), m.start())
            if word:
                w = word.group()
                if w.isnumeric() or w.replace(".", "").lower() in ABBREVIATIONS or (len(w) == 1 and w.isupper()):
                    continue
        yield m.end()


def _ends(text: str, start: int, end: int, level: int) -> Iterator[int]:
    """Where the parts of ``text[start:end]`` at a level end, but for the last."""
    if level == 3:
        yield from _sentence_ends(text, start, end)
    elif level == 5:
        yield from range(start + 1, end)
    else:
        pattern = (_SECTION, _PARAGRAPH, _LINE, None, _WORD)[level]
        yield from (m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end)


def parts_of(text: str, start: int, end: int, level: int) -> list[tuple[int, int]]:
    """``text[start:end]`` taken apart by the first level from ``level`` on that can do so: ``(end, level)`` of the parts, in order.

    Nothing below a word takes it apart: a part without any blank comes back alone, of the character's level.
    """
    while level < 5:
        ends = list(_ends(text, start, end, level))
        if ends:
            return [*((e, level) for e in ends), (end, level)]
        level += 1
    return [(end, 5)]


def pack(text: str, limit: int = 2000, overlap: int = 200) -> tuple[list[tuple[int, int, int]], bool]:
    """``(pieces, forced)`` of a text; pieces are ``(start, end, level of the end)``, consecutive ones overlap by exactly ``overlap``."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    out: list[tuple[int, int, int]] = []
    start, end, end_level, forced = 0, 0, 0, False
    # What is still to be placed, next one last: where a part ends, the level of that end, the level that may take it apart.
    waiting = [(len(text), 0, 0)] if text else []

    def close() -> None:
        nonlocal start
        out.append((start, end, end_level))
        start = end - overlap

    while waiting:
        stop, level, inner = waiting.pop()
        empty = end == (out[-1][1] if out else 0)
        if stop - start <= limit:
            end, end_level = stop, level
        elif not empty and (stop - end <= limit - overlap or end - start == limit):
            close()
            waiting.append((stop, level, inner))
        else:
            parts = parts_of(text, end, stop, inner)
            deep = parts[0][1]
            forced |= deep > 3 and stop - end > limit
            if deep < 5:
                waiting += [(e, deep if e < stop else level, deep + 1) for e, _ in reversed(parts)]
            else:
                end, end_level = start + limit, 5
                waiting.append((stop, level, 5))
    if text:
        close()
    return out, forced


def kind(text: str, limit: int) -> str:
    """``natural`` if every stretch between natural boundaries fits the limit, else ``forced``."""
    return "forced" if pack(text, limit, 0)[1] else "natural"


def pieces(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int, int]]:
    """``(start, end, level of the end)`` of the pieces."""
    return pack(text, limit, overlap)[0]


def oversized(items: DataFrame, id_col: str = "chunk_id", text_col: str = "text", limit: int = 2000, overlap: int = 200) -> DataFrame:
    """``id_col, cut`` of every item over the limit, as its packing turns out. Null texts are not over it; repeated rows stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = ["forced" if pack(t, limit, overlap)[1] else "natural" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], names=[id_col, "cut"])

    long = items.where(F.length(text_col) > limit).select(id_col, F.col(text_col).alias("__text"))
    return long.mapInArrow(run, f"`{id_col}` {items.schema[id_col].dataType.simpleString()}, cut string")


def split_items(items: DataFrame, id_col: str = "chunk_id", text_col: str = "text", keep: tuple[str, ...] = ("page", "section"),
                limit: int = 2000, overlap: int = 200) -> DataFrame:
    """``id_col, piece, start, end, ends_at, piece_text`` and the ``keep`` columns of every piece of every item.

    An item within the limit is one piece. Null and empty texts give none. Joining the pieces without their overlaps
    gives back the text. Repeated rows give repeated pieces; ``keep`` must not name an output column.
    """
    kept = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, start, end, level, body = [], [], [], [], [], []
            for i, text in enumerate(batch.column(len(kept)).to_pylist()):
                for n, (a, b, how) in enumerate(pieces(text or "", limit, overlap)):
                    row.append(i)
                    number.append(n)
                    start.append(a)
                    end.append(b)
                    level.append(LEVELS[how] if b < len(text) else "end")
                    body.append(text[a:b])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in batch.columns[: len(kept)]), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(end, pa.int64()), pa.array(level, pa.string()), pa.array(body, pa.string())],
                names=[*kept, "piece", "start", "end", "ends_at", "piece_text"])

    schema = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in kept)
    return items.select(*kept, F.col(text_col).alias("__text")).mapInArrow(
        run, schema + ", piece int, start bigint, end bigint, ends_at string, piece_text string")
