"""Keyword-stuffed and link-list pages, by the perplexity of their word-class sequences under a model of prose."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shipped, stored

#: Function words of the four languages, each its own class in the sequences.
FUNCTION_WORDS = {
    "en": "the a an of for and or to in on at by with from as is are was were be been have has had not but if when which that this it its we our you your they their than then how while before after into over under",
    "de": "der die das den dem des ein eine einen und oder zu im in mit von für bei auf aus an als ist sind war wurde wurden nicht aber wenn der ohne durch nach über unter hat haben wird was sich wir auch",
    "fr": "le la les un une des du de et ou à au aux en dans par pour sur avec sans est sont été ont a avons avait ne pas mais si qui que ce cette nous vous ils leur après avant soit",
    "es": "el la los las un una unos unas de del y o a al en con por para sin sobre es son fue ha han hemos no pero si que se lo su sus este esta nos como cuando después antes",
}
WORDS = frozenset(" ".join(FUNCTION_WORDS.values()).split())
#: Classes of everything else; a page becomes one byte for each token.
OTHERS = ("^", "$", "link", "linkr", "tag", "hash", "hashr", "number", "W", "Wr", "w", "wr", "end", "bar", "comma", "mark")
CODE = {c: i for i, c in enumerate((*OTHERS, *sorted(WORDS)))}
NAMES = tuple(CODE)
NEWLINE = 255
TOKEN = re.compile(
    r"((?!https?://|www\.)[^\W\d]\w*(?:[-'’.+#]\w+)*[+#]*)|(\n)|(<a\b[^>\n]*>|</a>|\[[^\]\n]*\]\([^)\n]*\)|(?:https?://|www\.)\S+)|(<[^>\n]{1,200}>|&\w{1,8};)|([#@]\w+)|(\d[\d.,:/]*)|([.!?…](?=\s|$))|([|>»·•/\\<=~]|\((?:more|mehr|plus|más)\))|([,–—])|(\*\*|`)|([^\w\s])"
)
FUNCTION = np.zeros(256, bool)
FUNCTION[[CODE[w] for w in WORDS]] = True
REPEAT = np.zeros(256, bool)
REPEAT[[CODE[c] for c in ("Wr", "wr", "hashr", "linkr")]] = True
LISTED = np.zeros(256, bool)
LISTED[[CODE[c] for c in ("link", "linkr", "hash", "hashr", "bar", "Wr", "wr", "tag")]] = True


class Spelling(dict):
    """word -> (lower-cased, class, whether it is a content word); worked out once for each word that a worker meets."""

    LIMIT = 1_000_000

    def __missing__(self, word: str) -> tuple[str, int, bool]:
        if len(self) >= self.LIMIT:
            self.clear()
        low = word.lower()
        content = low not in WORDS
        found = self[word] = (low, (CODE["w"] if word == low else CODE["W"]) if content else CODE[low], content)
        return found


def encoded(text: str, spelling: Spelling | None = None) -> bytes:
    """Classes of the tokens of a text, NEWLINE between lines. A content word that follows the same word as earlier in
    the page, a repeated tag and a repeated link have classes of their own."""
    spelling = Spelling() if spelling is None else spelling
    out = bytearray()
    add = out.append
    seen: set = set()
    last = ""
    plain = (0, 0, NEWLINE, CODE["link"], CODE["tag"], CODE["hash"], CODE["number"], CODE["end"], CODE["bar"], CODE["comma"], 0, CODE["mark"])
    for m in TOKEN.finditer(text):
        i = m.lastindex
        if i == 1:
            low, code, content = spelling[m.group()]
            if content:
                pair = (last, low)
                if pair in seen:
                    code += 1
                else:
                    seen.add(pair)
            last = low
            add(code)
        elif i == 3 or i == 5:
            low = m.group().lower()
            add(plain[i] + (low in seen))
            seen.add(low)
        elif i != 10:  # marks of emphasis say nothing
            add(plain[i])
    return bytes(out)


class Page:
    """An encoded page as one array, each line between two begin marks and an end mark, so that all lines are counted at
    once: ``at`` has the starts of lines, ``size`` their tokens."""

    __slots__ = ("at", "grams", "of", "size", "x")

    def __init__(self, codes: bytes):
        lines = codes.split(bytes([NEWLINE]))
        self.x = np.frombuffer(b"".join(b"\x00\x00" + c + b"\x01" for c in lines), np.uint8)
        self.size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.at = np.concatenate([[0], np.cumsum(self.size + 3)[:-1]])
        wide = self.x.astype(np.int64)
        grams = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        inner = self.x[2:] != 0  # a window that ends in a begin mark belongs to no line
        self.grams = grams[inner]
        self.of = np.repeat(np.arange(len(lines)), self.size + 1)

    def counted(self, kinds: np.ndarray) -> np.ndarray:
        """Tokens of the kinds in each line."""
        return np.add.reduceat(kinds[self.x].astype(np.int64), self.at)

    def prose(self) -> np.ndarray:
        """Lines that are certainly prose: ten tokens or more, a sentence end, a fair share of function words, few marks of
        lists. Only such lines train the model."""
        last = self.at + 1 + self.size
        ends = (self.x[last] == CODE["end"]) | (self.x[np.maximum(last - 1, 0)] == CODE["end"])
        return (self.size >= 10) & ends & (self.counted(FUNCTION) >= 0.12 * self.size) & (self.counted(LISTED) <= 0.15 * self.size)


class ProseModel:
    """A trigram model of word classes with Witten-Bell smoothing, in arrays: the counts of the trigrams seen and, of each
    context of one or two classes, its rows and kinds. Its size depends on the classes, not on the data."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.counts = grams[order].astype(np.int64), counts[order].astype(np.float64)
        one = np.bincount(self.grams & 0xFF, self.counts, 256)
        two = np.bincount(self.grams & 0xFFFF, self.counts, 1 << 16)
        kinds = np.count_nonzero(one)
        rows = one.sum()
        single = (one + kinds / 256) / (rows + kinds) if rows else np.full(256, 1 / 256)
        rows_2, kinds_2 = two.reshape(256, 256).sum(axis=1), np.count_nonzero(two.reshape(256, 256), axis=1)
        with np.errstate(invalid="ignore"):
            pair = (two.reshape(256, 256) + kinds_2[:, None] * single) / (rows_2 + kinds_2)[:, None]
        self.pair = np.where(rows_2[:, None] > 0, pair, single[None]).reshape(-1)
        self.rows, self.kinds = np.bincount(self.grams >> 8, self.counts, 1 << 16), np.bincount(self.grams >> 8, minlength=1 << 16)
        #: bits of a class in the prose it was trained on
        self.usual = float((self.surprise(self.grams) * self.counts).sum() / rows) if rows else 0.0

    def surprise(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last class of each trigram after the two before."""
        seen = np.zeros(len(grams))
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            seen = np.where(self.grams[at] == grams, self.counts[at], 0.0)
        rows, kinds, pair = self.rows[grams >> 8], self.kinds[grams >> 8], self.pair[grams & 0xFFFF]
        return -np.log2(np.where(rows > 0, (seen + kinds * pair) / np.maximum(rows + kinds, 1), pair))

    def bits(self, page: Page) -> np.ndarray:
        """Mean bits of each line: the logarithm of its perplexity."""
        return np.bincount(page.of, self.surprise(page.grams), len(page.size)) / (page.size + 1)


STRUCTURE = re.compile(r"\s*(?:#{1,6}\s|\*[^*\n]+\*\s*$)")


def encode(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, codes, lengths): one pass over the texts; later passes read only this. lengths has the characters of each
    line, negative for headings and emphasised lines."""
    kind = docs.schema[key].dataType.simpleString()

    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling()
        for batch in batches:
            codes, lengths = [], []
            for value in batch.column(1):
                t = value.as_py()
                codes.append(encoded(t, spelling))
                lengths.append([-len(x) if STRUCTURE.match(x) else len(x) for x in t.split("\n")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(lengths, pa.list_(pa.int32()))], names=["key", "codes", "lengths"])

    return docs.select(F.col(key), F.col(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull()).mapInArrow(run, f"key {kind}, codes binary, lengths array<int>")


def trained(pages: DataFrame) -> ProseModel:
    """The model of the prose lines of all pages: one partial count for each task, one row for each trigram of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            pages_ = map(Page, batch.column(0).to_pylist())
            found = [p.grams[p.prose()[p.of]] for p in pages_]
            if found:
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                total.update(dict(zip(grams.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    sums = pages.select("codes").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    frame = sums.toPandas()  # two numbers for each trigram of the 177 classes, 90 MB at most, whatever the pages
    return ProseModel(frame["gram"].to_numpy(np.int64), frame["n"].to_numpy(np.int64))


def stuffed_pages(docs: DataFrame, key: str, text: str, share: float = 0.5, high: float = 2.8, low: float = 1.4, function: float = 0.12, repeats: float = 0.25) -> DataFrame:
    """(key, share, bits, stuffed): for each page the share of its characters in spam lines, the mean bits of a token
    and whether the share exceeds ``share``.

    A line is spam if its perplexity under the model of prose is abnormally high, its bits lying ``high`` above those of
    prose, or abnormally low, ``low`` below, and it has few function words or many repeats, so that prose in odd type is
    none. Headings and emphasised lines, the structure of resumes and guides, count as no spam; the ends of lines don't
    count. A text without characters has share 0. Null keys and texts are left out, repeated rows count once.
    """
    pages = stored(encode(docs, key, text))
    model = docs.sparkSession.sparkContext.broadcast(trained(pages))
    kind = pages.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            shares, mean = [], []
            for codes, lengths in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                p, size = Page(codes), np.abs(lengths)
                b = m.bits(p)
                odd = ((b > m.usual + high) | (b < m.usual - low)) & (p.size > 0) & (np.asarray(lengths) > 0)
                odd &= (p.counted(FUNCTION) < function * p.size) | (p.counted(REPEAT) > repeats * p.size)
                every = int(size.sum())
                shares.append(int(size[odd].sum()) / every if every else 0.0)
                mean.append(float((size * b)[p.size > 0].sum()) / every if every else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64()), pa.array(mean, pa.float64())], names=["key", "share", "bits"])

    found = pages.mapInArrow(run, f"key {kind}, share double, bits double")
    return found.groupBy("key").agg(F.max("share").alias("share"), F.max("bits").alias("bits")).withColumn("stuffed", F.col("share") > share)
