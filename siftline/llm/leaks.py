"""Evaluation texts leaking into training text: template windows, hash join, slot consistency.

Windows of words are compared after numbers, units and names have become placeholders. Windows that follow each other at
the same distance form a run, and the slots of a run as a whole must be exchanged consistently. A window with too few
words beside its placeholders says nothing as a template (a table of numbers has many such) and is compared word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shipped
from . import words as W

#: Words of measure that a re-parameterised question exchanges, in the four languages of the corpus.
UNITS = frozenset(
    """percent prozent pourcent pour-cent ciento euro euros eur dollar dollars usd pound pounds gbp second seconds minute minutes hour hours day days week weeks month months
    year years sekunde sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre seconde secondes heure heures jour jours semaine semaines mois an ans
    segundo segundos minuto minutos hora horas semana semanas mes meses año años km kg cm mm mb gb tb k""".split()
)
CAPITAL = re.compile(r"(?<![.!?:;\n\-*•>] )(?<![.!?:;\n\-*•>])(?<!^)\b[^\W\d_a-zß-öø-ÿ]\w+")

#: The placeholders.
SLOTS = ("\x00number", "\x00unit", "\x00name")

#: Windows of items that go to every worker at once; more items take more passes over the documents.
BROADCAST_WINDOWS = 2_000_000
FOUND = "key bigint, item bigint, exact bigint, reworded bigint"


class Template:
    """Replaces numbers, units and names by typed placeholders, word by word, whatever the context, so that equal words
    always have equal templates. Names are the words that the held-out items write with a capital inside a sentence; a
    document fills their slots with these or with any word that it writes with a capital itself."""

    def __init__(self, names: Iterable[str]):
        self.names = frozenset(names)

    @staticmethod
    def names_in(text: str) -> set[str]:
        return {w.lower() for w in CAPITAL.findall(text)}

    def of(self, word: str) -> str:
        if any(c.isdigit() for c in word):
            return "\x00number"
        if word in UNITS:
            return "\x00unit"
        return "\x00name" if word in self.names else word


class Hashed:
    """Template hashes of the words of a text; each word is classified and hashed once."""

    def __init__(self, template: Template):
        shape = W.Vocabulary()

        class Shapes(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= W.Vocabulary.LIMIT:
                    self.clear()
                value = self[word] = shape[template.of(word)]
                return value

        self.shape = Shapes()

    def __call__(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.shape.__getitem__, tokens), np.uint64, len(tokens))


class Seeds:
    """Windows of the held-out items, found by the longest run of words between their name slots.

    A name slot takes any name, also one that no item holds, so a window can't be looked up by a hash of all its words.
    Its seed is the longest run without a name slot; what meets a seed is compared word by word outside the name slots.
    Windows with fewer than ``literal`` words beside their placeholders have a hash of their words as they are instead."""

    #: Pairs compared at once.
    PAIRS = 200_000

    def __init__(self, rows: list[tuple], width: int, literal: int, template: Template):
        self.width, self.template = width, template
        self.name = np.uint64(xxhash.xxh3_64_intdigest("\x00name"))
        slots = np.array([xxhash.xxh3_64_intdigest(x) for x in SLOTS], np.uint64)
        hashed, plain = Hashed(template), W.Vocabulary()
        self.items: list[int] = []  # of each window
        self.words: list[str] = []
        shapes, asis, starts, seeds = [], [], [], {}
        for item, text in rows:
            tokens = W.words(text or "")
            shape = hashed(tokens)
            said = np.concatenate([[0], np.cumsum(~np.isin(shape, slots))])
            for p in range(len(tokens) - width + 1):
                if said[p + width] - said[p] >= literal:
                    at, n = self._longest(shape[p : p + width] == self.name)
                    seeds.setdefault(n, []).append((len(starts), at))
                else:
                    seeds.setdefault(0, []).append((len(starts), 0))
                starts.append(len(self.words) + p)
                self.items.append(item)
            self.words += tokens
            shapes.append(shape)
            asis.append(W.hashes(tokens, plain))
        none = np.empty(0, np.uint64)
        self.shape, self.asis = np.concatenate([none, *shapes]), np.concatenate([none, *asis])
        self.starts = np.array(starts, np.int64)
        self.known = {}
        for n, found in seeds.items():
            window, at = np.array(found, np.int64).T
            h = W.windows(self.shape if n else self.asis, n or width)[self.starts[window] + at]
            order = np.argsort(h, kind="stable")
            self.known[n] = (h[order], window[order], at[order], self._bits(h))

    @property
    def verbatim(self) -> bool:
        """Whether some windows are compared as they are, which takes the hashes of the words themselves."""
        return 0 in self.known

    @staticmethod
    def _longest(names: np.ndarray) -> tuple[int, int]:
        edges = np.flatnonzero(np.concatenate(([True], names, [True])))
        runs = np.diff(edges) - 1
        best = int(runs.argmax())
        return (int(edges[best]), int(runs[best])) if runs[best] else (0, len(names))

    @staticmethod
    def _bits(h: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 16, bool)
        bits[(h >> np.uint64(48)).astype(np.int64)] = True
        return bits

    def pairs(self, shape: np.ndarray, asis: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, place) that agree outside the name slots; ``shape`` and ``asis`` hold texts that end at ``ends``."""
        for n, (want, window, at, bits) in self.known.items():
            h = W.windows(shape, n) if n else W.windows(asis, self.width)
            place = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
            low = np.searchsorted(want, h[place])
            hit = want[np.minimum(low, len(want) - 1)] == h[place]
            place, low = place[hit], low[hit]
            many = np.searchsorted(want, h[place], "right") - low
            upto = np.cumsum(many)
            done = 0
            while done < len(place):  # as many places as give PAIRS pairs, one at least
                last = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + self.PAIRS, "right")))
                k = many[done:last]
                j = np.repeat(low[done:last] - np.cumsum(k) + k, k) + np.arange(k.sum())
                yield self._agreeing(shape, ends, window[j], np.repeat(place[done:last], k) - at[j])
                done = last

    def _agreeing(self, shape: np.ndarray, ends: np.ndarray, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = (place >= 0) & (place + self.width <= len(shape))
        window, place = window[inside], place[inside]
        inside = np.searchsorted(ends, place, "right") == np.searchsorted(ends, place + self.width - 1, "right")
        window, place = window[inside], place[inside]
        for k in range(self.width):
            ours = self.shape[self.starts[window] + k]
            same = (ours == self.name) | (ours == shape[place + k])
            window, place = window[same], place[same]
        return window, place

    def fits(self, window: int, theirs: list[str], named: list[bool]) -> bool:
        """Whether the words of a document, of which some are ``named``, fill the name slots of a window with names."""
        of = self.template.of
        ours = self.words[self.starts[window] : self.starts[window] + self.width]
        return all(of(a) != "\x00name" or (c := of(b)) == "\x00name" or (x and c == b) for a, b, x in zip(ours, theirs, named, strict=True))

    def counted(self, found: list[tuple[int, int, bool]], theirs: list[str]) -> tuple[int, int]:
        """(exact, reworded) windows from all (window, place in theirs, exact) of an item and a document. Reworded ones
        count if the slots are exchanged consistently over their whole run."""
        exact, reworded = sum(e for _, _, e in found), 0
        found = sorted((p - int(self.starts[w]), p, e) for w, p, e in set(found))
        begin = 0
        for i in range(1, len(found) + 1):
            if i < len(found) and found[i][0] == found[i - 1][0] and found[i][1] - found[i - 1][1] <= self.width:
                continue
            (apart, first, _), (_, last, _) = found[begin], found[i - 1]
            new = sum(not e for _, _, e in found[begin:i])
            if new and consistent(self.words[first - apart : last - apart + self.width], theirs[first : last + self.width]):
                reworded += new
            begin = i
        return exact, reworded


def capitals(text: str, tokens: list[str]) -> list[bool]:
    """Which words of a text have a capital; where lower-casing changes the number of words, those that have one anywhere."""
    written = W.WORD.findall(text)
    if len(written) == len(tokens):
        return [w[0] != w[0].lower() for w in written]
    some = {w.lower() for w in written if w[0] != w[0].lower()}
    return [w in some for w in tokens]


def consistent(item_words: list[str], doc_words: list[str]) -> bool:
    """Each word of the item stands for one word of the document and the other way round, over all their slots."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    return all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in zip(item_words, doc_words, strict=True))


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, width: int = 13, broadcast_windows: int = BROADCAST_WINDOWS, literal: int = 5) -> DataFrame:
    """(key, item, exact, reworded): documents that share windows of ``width`` words with a held-out item.

    exact counts windows with the same words, reworded those that are equal after numbers, units and names are replaced
    by placeholders, have ``literal`` words or more beside them, and belong to a run of windows whose slots are exchanged
    consistently from its first word to its last. The names are those of the items and, in their slots,
    all words that the document writes with a capital. Whole texts are read. The held-out items are the small side; up
    to broadcast_windows of their windows go to every worker as sorted arrays of seeds, which a document is looked up
    in; more items go in several parts, each with a pass over the documents, and give the same rows.
    Null keys, null texts and texts shorter than the window give no rows; repeated rows and items with equal keys and
    texts count once; an empty table on either side gives an empty result. Clashing column names don't matter.
    """
    shipped(docs.sparkSession)
    items = items.select(F.col(item_key).cast("bigint").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").distinct()
    docs = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    template = Template(r[0] for r in items.mapInArrow(_names, "name string").distinct().toLocalIterator())
    found = docs.sparkSession.createDataFrame([], FOUND)
    for rows in _parts(items, 2 * broadcast_windows):  # a window starts at a word, a word takes two characters at least
        found = found.union(_looked_up(docs, rows, width, literal, template))
    return found.groupBy("key", "item").agg(F.sum("exact").alias("exact"), F.sum("reworded").alias("reworded"))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = set().union(*(Template.names_in(t) for t in batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(names), pa.string())], names=["name"])


def _parts(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """The items in lists of about ``size`` characters; one list at a time is in the driver."""
    rows, weight = [], 0
    for r in items.toLocalIterator():
        if rows and weight + len(r["text"]) > size:
            yield rows
            rows, weight = [], 0
        rows.append((r["item"], r["text"]))
        weight += len(r["text"])
    if rows:
        yield rows


def _looked_up(docs: DataFrame, rows: list[tuple], width: int, literal: int, template: Template) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Seeds(rows, width, literal, template))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        hashed, plain = Hashed(seeds.template), W.Vocabulary()
        none = np.empty(0, np.uint64)
        for batch in batches:
            texts = batch.column(1).to_pylist() if len(seeds.starts) else []
            tokens = [W.words(t) for t in texts]
            ends = np.cumsum([len(x) for x in tokens], dtype=np.int64)
            shape = np.concatenate([none, *map(hashed, tokens)])
            asis = np.concatenate([none, *(W.hashes(t, plain) for t in tokens)]) if seeds.verbatim else none
            found: dict[tuple[int, int], list[tuple[int, int, bool]]] = {}
            named: dict[int, list[bool]] = {}
            for window, place in seeds.pairs(shape, asis, ends):
                for w, p, i in zip(window.tolist(), place.tolist(), np.searchsorted(ends, place, "right").tolist(), strict=True):
                    p -= int(ends[i]) - len(tokens[i])
                    theirs = tokens[i][p : p + width]
                    exact = seeds.words[seeds.starts[w] : seeds.starts[w] + width] == theirs
                    if not exact and i not in named:
                        named[i] = capitals(texts[i], tokens[i])
                    if exact or seeds.fits(w, theirs, named[i][p : p + width]):
                        found.setdefault((i, seeds.items[w]), []).append((w, p, exact))
            rows_ = [(i, item, *seeds.counted(x, tokens[i])) for (i, item), x in found.items()]
            a = list(zip(*(r for r in rows_ if r[2] or r[3]), strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a[0], pa.int64())), *(pa.array(x, pa.int64()) for x in a[1:])], names=["key", "item", "exact", "reworded"])

    return docs.mapInArrow(run, FOUND)
