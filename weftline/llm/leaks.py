"""Evaluation items that leaked into training text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.automaton import SuffixAutomaton
from weftline.llm.normal import places, words
from weftline.session import spread

#: Words of an item that a passage must span, and the share of them that may differ (one in so many).
MIN_WORDS, ONE_IN = 18, 8
#: Places by which words of a passage may be shifted against its longest unchanged run, by words left out or added.
#: A longer passage with more of them holds a shorter one with fewer.
DRIFT = 6
_ZERO = 1 << 31
_SENTENCE = re.compile(r"(?<=[.?!…。？！])[\s\"'”’»“„)]*\s+|\n+")


def longest_run(min_words: int = MIN_WORDS, one_in: int = ONE_IN) -> int:
    """The unchanged run that any passage must hold: ``e`` changes leave ``e + 1`` runs of the other words."""
    return min(-(-(n - n // one_in) // (n // one_in + 1)) for n in range(min_words, 40 * one_in))


def longest_stretch(gain: np.ndarray, count: np.ndarray) -> tuple[int, int, int]:
    """Most words of a stretch whose gains add up to 0 or more, and where it begins and ends (exclusive).

    Changed words may stand at its ends. The earliest of the lowest sums before a place that don't exceed its own
    begins the longest stretch that ends there.
    """
    total, words = np.zeros((2, len(gain) + 1), dtype=np.int64)
    np.cumsum(gain, out=total[1:])
    np.cumsum(count, out=words[1:])
    first = np.searchsorted(-np.minimum.accumulate(total), -total)
    length = words - words[first]
    end = int(length.argmax())
    return int(length[end]), int(first[end]), end


def sentences(text: str | None) -> list[list[str]]:
    return [w for w in (words(s) for s in _SENTENCE.split(text or "")) if w]


class Items:
    """The items as word numbers, without instruction sentences, and their suffix automaton.

    The words of instructions are taken out of items and, where they stand whole, of documents, so that neither
    side's instructions count.
    """

    def __init__(self, rows: list[tuple[int, str]], instructions: set[tuple[str, ...]], min_words: int = MIN_WORDS, one_in: int = ONE_IN):
        self.min_words, self.one_in = min_words, one_in
        self.run = longest_run(min_words, one_in)
        parts = [(i, sentences(t)) for i, t in rows if t]
        self.instructions = instructions
        self.lead: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
        for s in self.instructions:
            self.lead.setdefault(s[:2], []).append(s)
        self.ids: list[int] = []
        self.code: dict[str, int] = {}
        self.items: list[list[int]] = []
        for i, ss in parts:
            item = [self.code.setdefault(w, len(self.code)) for s in ss if tuple(s) not in self.instructions for w in s]
            if len(item) >= min_words:
                self.ids.append(i)
                self.items.append(item)
        self.auto = SuffixAutomaton(self.items)
        self.words_of = [np.unique(item) for item in self.items]
        self.mark = np.full(len(self.code) + 1, -1)  # the last one is for other words
        self.longest = max(map(len, self.items), default=0)
        self.ones = np.ones(self.longest, dtype=np.int64)
        self._ends: dict[int, np.ndarray] = {}

    def bare(self, text: list[str]) -> list[int]:
        """Places of the words that aren't in a whole instruction."""
        n = len(text)
        if not self.lead:
            return list(range(n))
        out, k = [], 0
        while k < n:
            for s in self.lead.get((text[k], text[k + 1]), ()) if k + 1 < n else ():
                if tuple(text[k : k + len(s)]) == s:
                    k += len(s)
                    break
            else:
                out.append(k)
                k += 1
        return out

    def ends(self, state: int) -> np.ndarray:
        """Places in items where the last :attr:`run` words of a longer match end: other items may share only these.

        As numbers to which the text's position is added: the item, and beside it the diagonal.
        """
        if state not in self._ends:
            top = state
            while self.auto.length[self.auto.link[top]] >= self.run:
                top = self.auto.link[top]
            if top not in self._ends:
                self._ends[top] = np.array([(no << 32) + _ZERO - pos for no, pos in self.auto.ends(top)], dtype=np.int64)
            self._ends[state] = self._ends[top]
        return self._ends[state]

    def found(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item_id, words spanned, first word, last word)`` of each item that leaked into the text.

        The words spanned are the item's; first and last are places among the text's words.
        """
        toks = words(text)
        at = self.bare(toks)
        if len(at) < self.min_words - self.min_words // self.one_in:
            return []
        other = len(self.code)
        nums = [self.code.get(toks[k], other) for k in at]
        runs = [self.ends(state) + k for k, (state, n) in enumerate(self.auto.longest(nums)) if n >= self.run]
        if not runs:
            return []
        seeds = np.unique(np.concatenate(runs))
        of, diagonals = seeds >> 32, (seeds & 0xFFFFFFFF) - _ZERO
        cand, start = np.unique(of, return_index=True)
        need = self.min_words - self.min_words // self.one_in
        most = self._crowded(nums, cand, self.min_words + self.min_words // self.one_in)
        edge = np.full(self.longest + DRIFT, -1)
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, nums, edge]), 2 * DRIFT + 1)
        out = []
        for c in np.flatnonzero(most >= need):
            no = int(cand[c])
            own = diagonals[start[c] : start[c + 1] if c + 1 < len(cand) else None]
            near = [d for d in self._bands(own.tolist()) if self._reach(wide, self.items[no], d) >= self.min_words]
            span, first, last = max((self._span(nums, self.items[no], d) for d in near), default=(0, 0, 0))
            if span >= self.min_words:
                out.append((self.ids[no], span, at[first], at[last]))
        return out

    def _crowded(self, nums: list[int], cand: np.ndarray, width: int) -> np.ndarray:
        """The most words of each candidate in a window of the text, whatever their order."""
        kinds, text = np.unique(nums, return_inverse=True)
        self.mark[kinds] = np.arange(len(kinds))
        most = np.zeros(len(cand), dtype=np.int64)
        block = max(1, (1 << 21) // len(text))
        for s in range(0, len(cand), block):
            own = [self.words_of[no] for no in cand[s : s + block]]
            row, kind = np.repeat(np.arange(len(own)), [len(w) for w in own]), self.mark[np.concatenate(own)]
            holds = np.zeros((len(own), len(kinds)), dtype=bool)
            holds[row[kind >= 0], kind[kind >= 0]] = True
            hits = np.zeros((len(own), len(text) + 1), dtype=np.int32)
            np.cumsum(holds[:, text], axis=1, out=hits[:, 1:])
            most[s : s + block] = (hits[:, width:] - hits[:, :-width]).max(axis=1) if len(text) > width else hits[:, -1]
        self.mark[kinds] = -1
        return most

    def _reach(self, wide: np.ndarray, item: list[int], diagonal: int) -> int:
        """An upper bound of :meth:`_span`: each word of the item may stand up to ``DRIFT`` places off its own."""
        at = diagonal + self.longest
        hit = (wide[at : at + len(item)] == np.array(item)[:, None]).any(axis=1)
        if hit.sum() < self.min_words - self.min_words // self.one_in:
            return 0
        return longest_stretch(np.where(hit, 1, 1 - self.one_in), self.ones[: len(hit)])[0]

    @staticmethod
    def _bands(diagonals: list[int], near: int = 4) -> list[int]:
        """One diagonal for each group of near ones, of ascending ones."""
        out: list[int] = []
        for d in diagonals:
            if not out or d - out[-1] > near:
                out.append(d)
        return out

    def _span(self, text: list[int], item: list[int], diagonal: int, band: int = 12) -> tuple[int, int, int]:
        """Words of the item in the longest passage near a diagonal, and the first and last of the text's.

        The item is aligned with the text round it by the fewest changes, with free ends; along this alignment the
        longest stretch is taken of whose item's words at most one in ``one_in`` is changed, left out or added.
        """
        n, m, width = len(text), len(item), 2 * band + 1
        lo = diagonal - band  # row i covers the text from i + lo to i + lo + width - 1
        far = 1 << 20
        # words of the item that would lie beyond the text's ends, further than the band, take no part
        begin, m = max(0, band - diagonal - width + 2), min(m, n - diagonal + band - 1)
        row = [0 if 0 <= begin + lo + c <= n else far for c in range(width)]
        steps = []
        for i in range(begin + 1, m + 1):
            word, new, how = item[i - 1], [far] * width, bytearray(width)
            first = i + lo
            left = far
            for c in range(max(0, -first), min(width, n - first + 1)):
                j = first + c
                cost, step = far, 0
                if j:
                    cost = row[c] + (text[j - 1] != word)
                    step = 1
                if c + 1 < width and row[c + 1] + 1 < cost:
                    cost, step = row[c + 1] + 1, 2  # the item's word is left out
                if left + 1 < cost:
                    cost, step = left + 1, 3  # the text has a word more
                new[c] = left = cost
                how[c] = step
            steps.append(how)
            row = new
        c, i = min(range(width), key=row.__getitem__), m
        if row[c] >= far:
            return 0, 0, 0
        gains = []  # from the last to the first: gain, words of the item, place in the text
        while i > begin:
            step = steps[i - 1 - begin][c]
            if step == 1:
                gains.append((1 if text[i + lo + c - 1] == item[i - 1] else 1 - self.one_in, 1, i + lo + c - 1))
                i -= 1
            elif step == 2:
                gains.append((1 - self.one_in, 1, -1))
                i, c = i - 1, c + 1
            else:
                gains.append((-self.one_in, 0, i + lo + c - 1))
                c -= 1
        if not gains:
            return 0, 0, 0
        gain, count, place = np.array(gains[::-1]).T
        span, begin, end = longest_stretch(gain, count)
        inside = place[begin:end]
        inside = inside[inside >= 0]
        return (span, int(inside[0]), int(inside[-1])) if len(inside) else (0, 0, 0)


def shared_sentences(items: DataFrame, text: str) -> set[tuple[str, ...]]:
    """Sentences of two words or more that items with different words share."""

    def split(batches):
        for pdf in batches:
            rows = [(" ".join(s), " ".join(w for x in ss for w in x)) for ss in map(sentences, pdf["t"]) for s in ss if len(s) > 1]
            yield pd.DataFrame(rows, columns=["s", "whole"])

    long = items.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInPandas(split, "s string, whole string")
    shared = long.groupBy("s").agg(F.count_distinct("whole").alias("n")).where("n > 1")
    return {tuple(r["s"].split(" ")) for r in shared.collect()}


def leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    one_in: int = ONE_IN,
    block_bytes: int = 1 << 20,
) -> DataFrame:
    """Documents that hold a passage of an item: ``(doc_id, item_id, words INT, start INT, stop INT)``.

    ``words`` is the passage's length, ``start`` and ``stop`` (exclusive) are the characters of the text that it takes.

    A passage spans at least ``min_words`` words of the item in its order, of which at most one in ``one_in`` is
    changed, left out or added. Case, punctuation, spacing, line breaks, markup and character forms are levelled on
    both sides; instruction sentences are taken out of both.

    Method. Each document is streamed once through a generalised suffix automaton of the items; the longest
    matching lengths give the unchanged runs, of which any passage must hold one of :func:`longest_run` words. All
    items in which such a run ends, also as the end of a longer match with another item, are candidates; those without a window of enough of their words fall away, and
    an alignment along the run's diagonal decides. No candidate is dropped by a cap.

    Plan. The corpus isn't shuffled: items are broadcast in blocks of at most ``block_bytes`` of text, one pass over
    the documents for each block, so that the size of a broadcast is bounded whatever the number of items.

    Edge cases. Null, empty and short texts match nothing. Repeated items count as one; a repeated document
    row gives its rows again. Items with equal words and different ids are reported each. Sentences that such equal
    items share aren't instructions. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = f"{doc_id} bigint, {item_id} bigint, words int, start int, stop int"
    whole = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t")).distinct()
    size = whole.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shared = shared_sentences(items, text)
    blocks = max(1, -(-size // block_bytes))
    corpus = spread(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.col("t").isNotNull()))
    out = []
    for k in range(blocks):
        part = whole.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        rows = sorted((r["i"], r["t"]) for r in part.collect())
        out.append(corpus.mapInArrow(_search(spark.sparkContext.broadcast((rows, shared, min_words, one_in)), doc_id, item_id), schema))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _search(packed, doc_id: str, item_id: str):
    def run(batches):
        items = Items(*packed.value)
        for batch in batches:
            rows = [[], [], [], [], []]
            for k, t in enumerate(batch.column("t").to_pylist()):
                hits = items.found(t)
                where = places(t) if hits else []
                for i, n, first, last in hits:
                    for col, x in zip(rows, (k, i, n, where[first][0], where[last][1]), strict=True):
                        col.append(x)
            ids = batch.column("d").cast(pa.int64()).take(pa.array(rows[0], pa.int64()))
            rest = [pa.array(c, t) for c, t in zip(rows[1:], (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *rest], [doc_id, item_id, "words", "start", "stop"])

    return run


def cleaned(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most: float = 0.5) -> DataFrame:
    """Texts without the passages that leaked: ``(doc_id, text, removed INT)``, one row for each row of ``docs``.

    ``found`` is the result of :func:`leaks` on the same ``docs``, whose ids must be unique. A document of whose
    characters more than ``most`` lie in passages has a null text. ``removed`` counts the characters taken out; a null
    text has 0. Only the places are joined with the corpus, which Spark broadcasts while they are few.
    """
    spans = found.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    base = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
    both = base.join(spans, F.col("d") == F.col("i"), "left").select("d", "t", "spans")

    def cut(batches):
        for batch in batches:
            texts, gone = [], []
            for t, spans in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts, at, n = [], 0, 0
                for s in spans or ():
                    if s["stop"] > at:
                        parts.append(t[at : max(at, s["start"])])
                        n += s["stop"] - max(at, s["start"])
                        at = s["stop"]
                texts.append(None if t is None or n > most * len(t) else t if not n else "".join([*parts, t[at:]]))
                gone.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(texts, pa.string()), pa.array(gone, pa.int32())], [doc_id, text, "removed"])

    return both.mapInArrow(cut, f"{doc_id} bigint, {text} string, removed int")
