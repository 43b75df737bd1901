"""Splitting oversized texts at natural boundaries, by agglomerative merging.

A text is first cut into atoms: a run without spaces, with the white space after it. Each
boundary between atoms has a strength: 5 before a blank line, 4 at a line break, 3 after a sentence, 2
after a clause, 1 at a space, 0 inside a run that had to be cut. Adjacent pairs wait in a heap by
(strength, joint size) and the weakest boundary is merged first, as long as the joint size
plus the overlap fits the limit. What remains are the pieces. Each piece but the first is
preceded by an overlap: the end of the piece before it, of at most `overlap` code points, from a
boundary of atoms on where there is one. Runs that must be cut are cut so that the overlap fits; it is shorter
only before a run that the limit holds whole, but not together with the overlap.

Only a run without space, tab, CR or LF longer than the limit is cut inside; its text's kind is
'hard', that of all others 'boundary'. Lines count line feeds.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_ATOM = re.compile(r"[^ \t\r\n]+|[ \t\r\n]+")
_SENTENCE, _CLAUSE = re.compile(r"[.!?。！？…][\"'”’»)\]]*$"), re.compile(r"[,;:，；：、)\]}]$")


def atoms(text: str, limit: int, room: int) -> tuple[list[int], list[int], bool]:
    """(start of each atom, strength of the boundary before it, whether a run was cut inside). Runs above the limit are cut into atoms of
    `room`, what the limit leaves beside the overlap."""
    starts, strengths, hard, before = [0], [9], False, ""
    for m in _ATOM.finditer(text):
        at, run = m.start(), m.group()
        if run[0] in " \t\r\n":
            # long white space is cut too, but never between CR and LF
            for k in range(room, len(run), room) if len(run) > limit else ():
                cut = at + k - (run[k - 1 : k + 1] == "\r\n")
                if cut > starts[-1]:
                    starts.append(cut)
                    strengths.append(4)
            feeds = run.count("\n")
            if m.end() < len(text) and at > 0:
                s = 5 if feeds > 1 else 4 if feeds or "\r" in run else 3 if _SENTENCE.search(before) else 2 if _CLAUSE.search(before) else 1
                starts.append(m.end())
                strengths.append(s)
            elif m.end() < len(text) and len(run) > 0:
                starts.append(m.end())
                strengths.append(5)
        else:
            before = run[-4:]
            for k in range(room, len(run), room) if len(run) > limit else ():
                starts.append(at + k)
                strengths.append(0)
                hard = True
    return starts, strengths, hard


def split(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], bool]:
    """([(start, start of the body, end)], hard). Bodies join up to the text; a piece is
    text[start:end] and start..body is its overlap with the piece before."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and greater than the overlap, which must not be negative")
    n = len(text)
    if n <= limit:
        return ([(0, 0, n)] if n else []), False
    room = limit - overlap
    starts, strengths, hard = atoms(text, limit, room)
    ends = starts[1:] + [n]
    # an atom and the white space behind it may exceed their room together: the white space is cut off
    fixed_s, fixed_k = [], []
    for s, e, k in zip(starts, ends, strengths):
        fixed_s.append(s)
        fixed_k.append(k)
        while True:
            solid = len(text[s:e].rstrip(" \t\r\n"))
            bound = room if solid <= room else limit
            if e - s <= bound:
                break
            cut = s + (solid if 0 < solid <= bound else bound)
            if text[cut - 1 : cut + 1] == "\r\n":
                cut += -1 if cut - 1 > s else 1
            if cut >= e:
                break
            s = cut
            fixed_s.append(s)
            fixed_k.append(1)
    starts, strengths = fixed_s, fixed_k
    ends = starts[1:] + [n]
    count = len(starts)
    nxt, prev, end, alive = list(range(1, count + 1)), list(range(-1, count - 1)), ends[:], [True] * count
    heap = [(strengths[i + 1], end[i + 1] - starts[i], i, end[i + 1]) for i in range(count - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, stop = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= count or end[nxt[i]] != stop or stop - starts[i] != size or size > room:
            continue
        j = nxt[i]
        alive[j], end[i], nxt[i] = False, end[j], nxt[j]
        if nxt[j] < count:
            prev[nxt[j]] = i
            heapq.heappush(heap, (strengths[nxt[j]], end[nxt[j]] - starts[i], i, end[nxt[j]]))
        if prev[i] >= 0:
            heapq.heappush(heap, (strengths[i], end[i] - starts[prev[i]], prev[i], end[i]))
    pieces = []
    for i in range(count):
        if not alive[i]:
            continue
        s, e = starts[i], end[i]
        back = min(overlap, limit - (e - s)) if pieces else 0
        first = s - back
        if back:
            natural = bisect_left(starts, first)
            first = starts[natural] if natural < count and starts[natural] < s else first
            if text[first - 1 : first + 1] == "\r\n":
                first += 1
        pieces.append((max(first, pieces[-1][1] if pieces else 0), s, e))
    return pieces, hard


PIECES = "id {}, piece int, start_char int, overlap_chars int, start_line int, end_line int, kind string, content string"


def split_oversized(texts: DataFrame, id_col: str, text_col: str, line_col: str, limit: int = 500, overlap: int = 50) -> DataFrame:
    """The pieces of every text above the limit (code points): id, piece (from 0), start_char of the
    piece with its overlap, overlap_chars, start_line and end_line, kind and content.

    Nulls and texts within the limit give no rows; a null start line gives null lines. Repeated
    rows of an id count once. Extra columns are not read. An empty table gives an empty result.
    """
    id_type = texts.schema[id_col].dataType.simpleString()
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(id_type, pa.int64())
    names = ["id", "piece", "start_char", "overlap_chars", "start_line", "end_line", "kind", "content"]
    kinds = [arrow_id, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            rows: list[tuple] = []
            for i, text, line in zip(*(c.to_pylist() for c in b.columns)):
                pieces, hard = split(text, limit, overlap)
                at, feeds = 0, 0
                for k, (s, body, e) in enumerate(pieces):
                    feeds += text.count("\n", at, s)
                    at = s
                    first = None if line is None else line + feeds
                    rows.append((i, k, s, body - s, first, None if line is None else first + text.count("\n", s, e), "hard" if hard else "boundary", text[s:e]))
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    large = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(line_col).alias("line")).where(F.char_length("text") > limit)
    return large.dropDuplicates(["id"]).mapInArrow(cut, PIECES.format(id_type))
