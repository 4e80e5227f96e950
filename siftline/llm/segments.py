"""Splitting oversized texts at natural boundaries by lexical cohesion."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shipped

CHARS = 4
#: How much a boundary counts, beside the depth of its cohesion valley: heading, entry, line, sentence, word, none.
STRENGTH = (1.0, 0.8, 0.5, 0.25, 0.0, 0.0)
HEADING, ENTRY = re.compile(r"#{1,2}\s"), re.compile(r"(?:#{3,6}\s|\*\*|\d{1,3}[.)]\s)")
SENTENCE = re.compile(r"(?<=[.!?;:…。！？])\s+")
WORD = re.compile(r"\w+")


def tokens(text: str) -> int:
    return max(1, len(text) // CHARS)


def units(text: str, most: int) -> list[tuple[int, int]]:
    """(start of a unit, kind of the boundary before it): lines; sentences of lines, words of sentences and runs of
    characters where a unit has more than ``most`` characters."""
    out: list[tuple[int, int]] = []
    at = 0
    for line in text.splitlines(keepends=True):
        kind = 0 if HEADING.match(line) else 1 if ENTRY.match(line) else 2
        if line.strip() or not out:  # empty lines stay with what is before them
            out.append((at, kind))
        if len(line) > most // 4:
            cuts = [at + m.end() for m in SENTENCE.finditer(line) if m.end() < len(line)]
            out.extend((c, 3) for c in cuts)
            for begin, end in zip([at, *cuts], [*cuts, at + len(line)], strict=True):
                while end - begin > most // 4:  # no sentence end: a space, else any character
                    space = text.rfind(" ", begin + 1, begin + most // 4)
                    begin = space + 1 if space > begin else begin + most // 4
                    out.append((begin, 4 if space > 0 else 5))
        at += len(line)
    return sorted(out)


def cohesion(text: str, starts: list[int], block: int = 4) -> list[float]:
    """For each unit the depth of the valley before it: how far the similarity of the ``block`` units before and after
    lies under the peaks on either side."""
    bags = [[w for w in WORD.findall(text[a:b].lower()) if len(w) > 3] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
    n = len(bags)
    likeness = [1.0] * n
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    dot = squares_left = squares_right = 0
    for b in bags[:block]:
        for w in b:
            c = right.get(w, 0)
            squares_right += 2 * c + 1
            right[w] = c + 1
    for i in range(1, n):  # the product and both norms follow each word that enters or leaves a side
        for w in bags[i - 1]:
            c, d = right[w], left.get(w, 0)
            squares_right -= 2 * c - 1
            squares_left += 2 * d + 1
            dot += (c - 1) * (d + 1) - c * d
            right[w], left[w] = c - 1, d + 1
        if i - 1 - block >= 0:
            for w in bags[i - 1 - block]:
                d = left[w]
                squares_left -= 2 * d - 1
                dot -= right.get(w, 0)
                left[w] = d - 1
        if i - 1 + block < n:
            for w in bags[i - 1 + block]:
                c = right.get(w, 0)
                squares_right += 2 * c + 1
                dot += left.get(w, 0)
                right[w] = c + 1
        norm = sqrt(squares_left * squares_right)
        likeness[i] = dot / norm if norm else 0.0
    depth = [0.0] * n
    peak = 0.0
    up = [0.0] * n
    for i in range(n):
        peak = likeness[i] if not i or likeness[i] >= likeness[i - 1] else peak
        up[i] = peak
    peak = 0.0
    for i in range(n - 1, -1, -1):
        peak = likeness[i] if i == n - 1 or likeness[i] >= likeness[i + 1] else peak
        depth[i] = up[i] + peak - 2 * likeness[i]
    return depth


def split(text: str, limit: int = 350, overlap: int = 40) -> list[tuple[int, int, int]]:
    """(start, core, end) of each piece in characters: text[start:end] has at most ``limit`` tokens, text[start:core] of
    about ``overlap`` tokens repeats the piece before, the cores text[core:end] put together are the text.

    A text within the limit is one piece. Each cut is the boundary with the deepest valley and the strongest kind in
    the second half of what fits."""
    if tokens(text) <= limit:
        return [(0, 0, len(text))]
    most = limit * CHARS + CHARS - 1
    back = overlap * CHARS
    found = units(text, most)
    starts = [s for s, _ in found]
    depth = cohesion(text, starts)
    score = [STRENGTH[k] + d for (_, k), d in zip(found, depth, strict=True)]
    out: list[tuple[int, int, int]] = []
    core, i = 0, 0
    while core < len(text):
        start = _tail(text, core, back) if out else 0
        reach = start + most
        if reach >= len(text):
            out.append((start, core, len(text)))
            break
        least = core + (reach - core) // 2
        while i < len(starts) and starts[i] <= core:
            i += 1
        best, j = None, i
        while j < len(starts) and starts[j] <= reach:
            rank = (starts[j] >= least, score[j], starts[j])
            if best is None or rank > best[0]:
                best = (rank, starts[j])
            j += 1
        end = best[1] if best else reach
        out.append((start, core, end))
        core = end
    return out


def _tail(text: str, core: int, back: int) -> int:
    """Start of the overlap: the first line, sentence or word start among the last ``back`` characters before core."""
    low = max(0, core - back)
    if not low:
        return 0
    part = text[low:core]
    if text[low - 1] == "\n":
        return low
    for mark in ("\n", ". ", " "):
        p = part.find(mark, 0, back // 2)
        if p >= 0:
            return low + p + len(mark)
    return low


def pieces(rows: DataFrame, keys: list[str], text: str, limit: int = 350, overlap: int = 40, over: int | None = None) -> DataFrame:
    """(keys..., piece, start, core, end, tokens, text): the pieces of every text over ``over`` tokens (by default
    ``limit``), each of at most ``limit`` tokens; start, core and end count code points from 0.

    Texts within the limit are left out by a filter that runs before any Python. Null texts give no rows; repeated rows
    count once; ties between boundaries go to the later one.
    """
    shipped(rows.sparkSession)
    bar = over if over is not None else limit
    kept = rows.select(*keys, F.col(text).alias("__text")).where(F.length("__text") >= (bar + 1) * CHARS).dropDuplicates()
    kinds = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                owner, rest = [], []
                for i, value in enumerate(part.column(len(keys))):
                    whole = value.as_py()
                    for k, (a, c, b) in enumerate(split(whole, limit, overlap)):
                        owner.append(i)
                        rest.append((k, a, c, b, tokens(whole[a:b]), whole[a:b]))
                cols = list(zip(*rest, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(pa.array(owner, pa.int64())) for k in range(len(keys))), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string())], names=[*keys, "piece", "start", "core", "end", "tokens", "text"]
                )

    return kept.mapInArrow(run, f"{kinds}, piece bigint, start bigint, core bigint, `end` bigint, tokens bigint, text string")
