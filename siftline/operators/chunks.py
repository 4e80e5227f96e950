"""Chunks of parsed documents: by section, inside experience by entry, within a budget of tokens with an overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shipped
from . import extract

LIMIT, OVERLAP, CHARS = 350, 40, 4
LEAST_BUDGET = 50


def size(text: str) -> int:
    return max(1, len(text) // CHARS)


def halves(line: str, budget: int) -> list[str]:
    """A line cut between words into halves until each fits; a single word stays whole."""
    todo, out = [line.split()], []
    while todo:
        ws = todo.pop()
        if len(ws) <= 1 or size(" ".join(ws)) <= budget:
            out.append(" ".join(ws))
        else:
            todo += [ws[len(ws) // 2 :], ws[: len(ws) // 2]]
    return out


def packed(lines: list[str], budget: int, overlap: int) -> list[list[str]]:
    """Lines in groups within the budget; a group starts with the last lines of the one before, as many as the overlap
    holds, unless its own first line then doesn't fit. A line over the budget makes groups of its own halves."""
    groups: list[list[str]] = []
    now: list[str] = []
    held = 0

    def close() -> None:
        nonlocal now, held
        if now:
            groups.append(now)
        now, held = [], 0

    for line in lines:
        n = size(line) + 1
        if n > budget:
            close()
            groups.extend([x] for x in halves(line, budget - 1))
            continue
        if now and held + n > budget:
            room, back = overlap, []
            for old in reversed(now):
                room -= size(old) + 1
                if room < 0:
                    break
                back.append(old)
            close()
            again = sum(size(x) + 1 for x in back)
            if again + n <= budget:
                now, held = back[::-1], again
        now.append(line)
        held += n
    close()
    return groups


def chunked(docs: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, idx, section, header, text, tokens): one run of chunks for each section, in experience for each entry; sections
    to skip are left out. The header names headline, section, entry, company and dates and counts for the budget; a
    document that parses to nothing is one chunk. Null and blank texts have none, repeated rows count once.

    Lines are parsed by expressions and meet again by document; packing depends on all lines before and runs in Arrow
    batches, a row a document."""
    shipped(docs.sparkSession)
    once_ = docs.where(F.col(text).isNotNull()).select(key, text).distinct()
    lines = extract.parsed_lines(once_, key, text)
    meta = extract.meta_lines(lines, key).select(key, "line_no", "company", "dates_text")
    rows = lines.join(meta, [key, "line_no"], "left")
    part = F.struct("line_no", "role", F.col("text").alias("t"), "section", "kind", "entry", "entry_no", "company", "dates_text")
    grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list(part)).alias("lines"))  # the lines of one text
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row, lines_ in enumerate(batch.column(1).to_pylist()):
                for i, found in enumerate(_chunks_of(lines_, limit, overlap)):
                    for column, value in zip(out, (row, i, *found), strict=True):
                        column.append(value)
            ids = batch.column(0).take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[1], pa.int32()), *(pa.array(x, pa.string()) for x in out[2:5]), pa.array(out[5], pa.int64())], names=["key", "idx", "section", "header", "text", "tokens"])

    return grouped.select(key, "lines").mapInArrow(run, f"`{key}` {kind}, idx int, section string, header string, text string, tokens bigint")


def _chunks_of(lines: list[dict], limit: int, overlap: int) -> Iterator[tuple[str, str, str, int]]:
    headline = next((x["t"] for x in lines if x["role"] == "headline"), "") or "Resume"
    units: dict[tuple, list[dict]] = {}
    top = 0
    for x in lines:
        if x["role"] == "section":
            top = x["line_no"]
        if x["role"] != "headline":
            units.setdefault((top, x["entry_no"] if x["kind"] == "experience" else None), []).append(x)
    some = False
    for unit in units.values():
        kind, section = unit[0]["kind"], unit[0]["section"]
        body = [x["t"] for x in unit if x["role"] in ("entry", "line") and x["t"]]
        if kind == "skip" or not body:
            continue
        meta = next((x for x in unit if x["role"] == "meta"), None) if kind == "experience" else None
        title = next((x["t"] for x in unit if x["role"] == "entry"), None) if kind == "experience" else None
        about = [p for p in (title, meta and meta["company"], meta and meta["dates_text"]) if p]
        header = f"{headline} | {section}" + (f" › {', '.join(about)}" if title or (meta and meta["company"]) else "")
        for group in packed(body, max(LEAST_BUDGET, limit - size(header) - 1), overlap):
            some = True
            text = "\n".join(group)
            yield kind, header, text, size(header) + 1 + size(text)
    if not some:
        text = "\n".join(x["t"] for x in lines)
        yield "other", headline, text, size(text)
