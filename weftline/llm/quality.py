"""Text quality statistics and the structural profile of each document."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.normal import _FOLD, _UNSEEN, TAG
from weftline.session import Cut, spread

#: Token classes of a segment: common words, other words, numbers, symbol runs and markup, repeats; separator
#: classes: space, line break, comma, strong separator (tab, wide gap, semicolon, bar, equals sign and the like).
CLASSES = ("common", "word", "number", "symbol", "repeat", "space", "line", "comma", "strong")

# What a segment of each kind is made of. The first five shares (tokens) and the last four
# (separators) add up to one each. Prose of the languages in the table of common words is fitted (`fit_prose`); the
# prose profiles here stand for other languages and for layouts.
PROFILES = {
    "prose": (0.36, 0.60, 0.02, 0.02, 0.00, 0.86, 0.02, 0.10, 0.02),
    "prose_rich": (0.52, 0.45, 0.01, 0.02, 0.00, 0.90, 0.02, 0.07, 0.01),
    "prose_plain": (0.12, 0.85, 0.02, 0.01, 0.00, 0.90, 0.05, 0.03, 0.02),
    "prose_upright": (0.36, 0.60, 0.02, 0.02, 0.00, 0.20, 0.72, 0.06, 0.02),
    "prose_gaps": (0.36, 0.60, 0.02, 0.02, 0.00, 0.06, 0.03, 0.03, 0.88),
    "list": (0.01, 0.72, 0.10, 0.17, 0.00, 0.42, 0.46, 0.06, 0.06),
    "list_bare": (0.01, 0.88, 0.10, 0.01, 0.00, 0.25, 0.70, 0.03, 0.02),
    "word_list": (0.01, 0.98, 0.01, 0.00, 0.00, 0.08, 0.02, 0.88, 0.02),
    "word_salad": (0.00, 0.99, 0.00, 0.01, 0.00, 0.94, 0.03, 0.02, 0.01),
    "trail": (0.00, 0.97, 0.02, 0.01, 0.00, 0.07, 0.02, 0.03, 0.88),
    "table": (0.00, 0.55, 0.42, 0.03, 0.00, 0.05, 0.17, 0.03, 0.75),
    "csv": (0.00, 0.50, 0.45, 0.05, 0.00, 0.04, 0.17, 0.75, 0.04),
    "numbers": (0.00, 0.02, 0.96, 0.02, 0.00, 0.84, 0.13, 0.02, 0.01),
    "log": (0.00, 0.36, 0.50, 0.14, 0.00, 0.40, 0.12, 0.02, 0.46),
    "code": (0.00, 0.52, 0.20, 0.28, 0.00, 0.30, 0.25, 0.15, 0.30),
    "markup": (0.00, 0.30, 0.02, 0.68, 0.00, 0.60, 0.10, 0.02, 0.28),
    "symbols": (0.00, 0.04, 0.04, 0.92, 0.00, 0.80, 0.14, 0.03, 0.03),
    "code_text": (0.00, 0.45, 0.25, 0.30, 0.00, 0.70, 0.10, 0.10, 0.10),
    "repeats": (0.02, 0.05, 0.02, 0.05, 0.86, 0.84, 0.05, 0.05, 0.06),
}

#: A segment is taken as prose of a language if it has so many words and so large a share of the language's common ones.
SAMPLE_WORDS, SAMPLE_SHARE = 6, 0.2
#: Words whose counts a task holds before it passes them on.
HELD_WORDS = 200_000


class Profiles:
    """Profiles by name; those whose name begins with ``prose`` are natural."""

    def __init__(self, fitted: dict[str, tuple] | None = None):
        self.shares = {**PROFILES, **(fitted or {})}
        self.names = list(self.shares)
        p = np.array(list(self.shares.values())) + 0.004
        self.p = p / p.sum(axis=1, keepdims=True)
        self.log_p = np.log2(self.p)
        self.natural = np.array([k.startswith("prose") for k in self.names])

    def divergence(self, counts: np.ndarray) -> np.ndarray:
        """Jensen-Shannon divergence (base 2) of each segment's classes from each profile."""
        q = _shares(counts) + 0.004
        q /= q.sum(axis=1, keepdims=True)
        out = np.empty((len(q), len(self.p)))
        own, log_q = (self.p * self.log_p).sum(axis=1), np.log2(q)
        for s in range(0, len(q), 1024):
            x = q[s : s + 1024]
            both = self.p + x[:, None, :]
            out[s : s + 1024] = 0.5 * (own + (x * log_q[s : s + 1024]).sum(axis=1)[:, None] - np.einsum("ijk,ijk->ij", both, np.log2(both)) + 2)
        return out


def _shares(counts: np.ndarray) -> np.ndarray:
    a, b = counts[:, :5].sum(axis=1, keepdims=True), counts[:, 5:].sum(axis=1, keepdims=True)
    return np.concatenate([np.where(a > 0, counts[:, :5] / np.maximum(a, 1), 0.2), np.where(b > 0, counts[:, 5:] / np.maximum(b, 1), 0.25)], axis=1)

#: Evidence (tokens times difference of divergences) that a change of kind between segments costs.
SWITCH = 0.9

_TOKEN = re.compile(
    rf"(?P<tag>{TAG}|https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.]+)"
    r"|(?P<num>[+-]?\d[\d.,:/\-]*\d%?|\d%?)(?![^\W\d_぀-ヿ㐀-鿿々〆])"
    r"|(?P<ja>[぀-ゟ]+|[゠-ヿ]+|[㐀-鿿々〆]+)"
    r"|(?P<word>(?:[^\W\d_぀-ヿ㐀-鿿]|[̀-ͯ])+\d*)(?![^\W぀-ヿ㐀-鿿々〆])"
    r"|(?P<mix>[^\W぀-ヿ㐀-鿿々〆]+)"
    r"|(?P<rest>[^\w\s]+)"
)
_BULLET = re.compile(r"^\s*(?:[-–—•*·▪◦‣+○●■□✓✔]|\[[ xX]?\]|\(?(?:\d{1,3}|[A-Za-zа-яА-Я]|[ivxIVX]{1,4})[.)])\s+")
_QUOTE = re.compile(r"^(?:\s*>)+\s?")
_ENDS = re.compile(r"(?<=[.!?…])[\"'”’»“)\]]*\s+|(?<=[。！？])」?")
_PLAIN = set(".,!?…;:'\"()[]“”„«»‘’‹›-–—¿¡。、！？「」『』・，．；：（）*_`~")
_COMMA = re.compile(r"^\s*[,、，]\s*$")
_STRONG = re.compile(r"\t| {3,}|[;|=»>/→{}\\]|: *$|\.{4,}|(?:\. ){3,}")


@lru_cache(maxsize=20_000)
def _separator(gap: str) -> int:
    """Class of what stands between two tokens: 5 space or nothing, 6 line break, 7 comma, 8 strong separator."""
    if gap in ("", " "):
        return 5
    return 7 if _COMMA.match(gap) else 8 if _STRONG.search(gap) else 5


def _letters(text: str) -> str:
    text = _UNSEEN.sub("", html.unescape(text) if "&" in text else text)
    return unicodedata.normalize("NFKC", text) if not text.isascii() else text


def _folded(word: str) -> str:
    return word.casefold().translate(_FOLD)


class Scales:
    """Common words of each language, the profiles, and how often each common word stands in a language's prose."""

    def __init__(self, common: list[tuple[str, str]], profiles: Profiles | None = None, words: dict[str, dict[str, int]] | None = None):
        by: dict[str, set[str]] = {}
        for lang, word in common:
            if word:
                by.setdefault(lang or "", set()).add(_folded(_letters(word)))
        self.langs = sorted(by)
        self.mask: dict[str, int] = {}
        for k, lang in enumerate(self.langs):
            for word in by[lang]:
                self.mask[word] = self.mask.get(word, 0) | 1 << k
        # Japanese writes without spaces: a run of kana counts if it begins or ends with a common word
        self.kana = tuple(w for w in self.mask if re.fullmatch(r"[぀-ゟ]+", w))
        self.kana_mask = 0
        for w in self.kana:
            self.kana_mask |= self.mask[w]
        self.seen: dict[str, int] = {}
        self.profiles = profiles or Profiles()
        self.words = {lang: (sum(n.values()), n) for lang, n in (words or {}).items() if n}

    def _mask(self, kind: str, tok: str) -> int:
        """Languages of which a token is a common word, as bits; kept for tokens seen before."""
        known = self.seen.get(tok)
        if known is None:
            if len(self.seen) >= 200_000:
                self.seen.clear()
            if kind == "ja":
                hit = self.kana and "぀" <= tok[0] <= "ゟ" and (tok.startswith(self.kana) or tok.endswith(self.kana))
                known = self.kana_mask if hit else 0
            else:
                known = self.mask.get(_folded(tok), 0)
            self.seen[tok] = known
        return known

    def language(self, tally: dict[str, int]) -> str:
        """The language whose common words are distributed most like those of the text, by Jensen-Shannon divergence."""
        total, best, name = sum(tally.values()), 1.0, ""
        for lang, (n, freq) in self.words.items() if total else ():
            d = 1.0  # nothing in common; each word that the text shares with the profile brings them nearer
            for word in tally.keys() & freq.keys():
                x, p = tally[word] / total, freq[word] / n
                m = (x + p) / 2
                d += 0.5 * (x * log2(x / m) + p * log2(p / m) - x - p)
            if d < best - 1e-9:
                best, name = d, lang
        return name

    def segment(self, text: str, recent: list[tuple[str, str]], tally: Counter) -> list[int]:
        """Class counts of a segment; ``recent`` holds the last pairs of words, across segments.

        Common words are those of the language that has most of them. ``tally`` counts them by their languages' bits.
        """
        n = [0] * 9
        masks: dict[int, int] = {}
        end, bullet, start = None, _BULLET.match(text), 0
        if bullet:
            n[3] += 1
            start = bullet.end()
        for m in _TOKEN.finditer(text, start):
            kind, tok = m.lastgroup, m.group()
            if kind == "rest" and len(tok) <= 4 and (_PLAIN.issuperset(tok) or min(tok) >= "\u2600"):
                continue  # ordinary punctuation belongs to the separators, and so do pictures
            if end is not None:
                n[_separator(text[end : m.start()])] += 1
            end = m.end()
            if kind == "tag" and tok[0] != "<":
                continue  # addresses tell nothing of the text beside them
            if kind == "tag" or kind == "rest":
                n[3] += 1 + (len(tok) > 12)
                continue
            if kind == "mix" or (kind == "word" and len(tok) > 40):
                n[3] += 1 + len(tok) // 12
                continue
            low = tok.casefold()
            # a word or a pair of words that has just been there
            if recent and (low == recent[-1][1] or (recent[-1][1], low) in recent):
                n[4] += 1
            elif kind == "num":
                n[2] += 1
            else:
                mask = self._mask(kind, tok)
                if mask:
                    masks[mask] = masks.get(mask, 0) + 1
                    tally[low] += 1
                else:
                    n[1] += 1
            recent.append((recent[-1][1] if recent else "", low))
            del recent[:-6]
        self.of = 0
        if masks:
            if len(masks) == 1:
                (mask, most), every = next(iter(masks.items())), 0
                every = most
                self.of = mask
            else:
                union, every, most = 0, sum(masks.values()), -1
                for m in masks:
                    union |= m
                while union:
                    bit = union & -union
                    union ^= bit
                    if (k := sum(c for m, c in masks.items() if m & bit)) > most:
                        most, self.of = k, bit
            n[0] += most
            n[1] += every - most
        if not any(n):
            n[3] = sum(x[0] < "\u2600" and not x[0].isalnum() for x in text.split())  # nothing but punctuation
        return n

    def segments(self, text: str, tally: Counter):
        """``(class counts, characters, language bits)`` of each segment of the text."""
        recent: list[tuple[str, str]] = []
        for line in _letters(text).split("\n"):
            parts = [p for p in _ENDS.split(_QUOTE.sub("", line)) if p and not p.isspace()]
            for k, part in enumerate(parts, 1):
                n = self.segment(part, recent, tally)
                n[6 if k == len(parts) else 5] += 1  # the segment's own end
                yield n, len("".join(part.split())), self.of

    def profile(self, text: str) -> tuple[float, str, str]:
        """Share of characters outside natural sentences, the kind of the largest part, and the nearest language."""
        return next(self.profiled([text]))

    def profiled(self, texts: list[str | None]):
        """:meth:`profile` of each text."""
        return self.judged(self._read(t) for t in texts)

    def _read(self, text: str | None) -> tuple[np.ndarray, list[int], Counter]:
        tally: Counter = Counter()
        found = list(self.segments(text, tally)) if text else []
        return _table(x[0] for x in found), [x[1] for x in found], tally

    def judged(self, read, block: int = 20_000):
        """:meth:`profile` of texts given by the class counts and the characters of their segments and their common words.

        The divergences of about ``block`` segments are taken at once.
        """
        held, counts, n = [], [], 0
        for table, sizes, tally in read:
            held.append((sizes, self.language(tally)))
            counts.append(table)
            n += len(table)
            if n >= block:
                yield from self._judged(held, counts)
                held, counts, n = [], [], 0
        yield from self._judged(held, counts)

    def _judged(self, held: list[tuple[list[int], str]], counts: list[np.ndarray]):
        is_natural, names = self.profiles.natural, self.profiles.names
        table = np.concatenate([_table(()), *counts]).astype(np.float64)
        d = self.profiles.divergence(table)
        gap = (d[:, is_natural].min(axis=1) - d[:, ~is_natural].min(axis=1)) * np.maximum(table[:, :5].sum(axis=1), 0.3)
        gap, near = gap.tolist(), d.argmin(axis=1).tolist()
        start = 0
        for sizes, language in held:
            part = slice(start, start + len(sizes))
            start = part.stop
            total = sum(sizes)
            if not total:
                yield 0.0, "empty", ""
                continue
            out, kinds = 0, {}
            for size, j, junk in zip(sizes, near[part], smooth(gap[part], SWITCH), strict=True):
                out += size if junk else 0
                if is_natural[j] != junk:
                    kinds[names[j]] = kinds.get(names[j], 0) + size
            kind = max(kinds, key=kinds.get) if kinds else ("list" if out * 2 > total else "prose")
            yield out / total, "prose" if kind.startswith("prose") else kind, language


def _table(counts) -> np.ndarray:
    return np.array(list(counts), dtype=np.int32).reshape(-1, len(CLASSES))


def smooth(odds: list[float], switch: float) -> list[bool]:
    """The cheapest labelling (true: not prose) of a row of segments whose changes of label cost ``switch``."""
    cost = [max(0.0, -odds[0]), max(0.0, odds[0])]  # of calling the first one junk, prose
    back = []
    for o in odds[1:]:
        j = (cost[0], 0) if cost[0] <= cost[1] + switch else (cost[1] + switch, 1)
        p = (cost[1], 1) if cost[1] <= cost[0] + switch else (cost[0] + switch, 0)
        back.append((j[1], p[1]))
        cost = [j[0] + max(0.0, -o), p[0] + max(0.0, o)]
    at = 0 if cost[0] < cost[1] else 1
    out = [at == 0]
    for j, p in reversed(back):
        at = j if at == 0 else p
        out.append(at == 0)
    return out[::-1]


#: Characters that end a sentence.
_FULL_STOPS = (".", "!", "?", "…", "。", "！", "？")
_BLANKS = " \t\r\f\x0b"


def text_statistics(docs: DataFrame, common: DataFrame, *, doc_id: str = "doc_id", text: str = "text", word: str = "word") -> DataFrame:
    """Statistics of each text: ``(doc_id, n_words, mean_word_len, symbol_ratio, line_punct, common_share)``.

    One row for each row of ``docs``. Words are runs of letters and digits; symbols are what is neither that nor white
    space, as a share of all characters; of lines with any text the share is given whose last character ends a
    sentence; common words are those of any language in ``common``, in lower case.

    Plan. Built-in functions only. Words are held against ``common`` by a join, which Spark broadcasts if the table is
    small and shuffles otherwise, and counted again for each text; what is shuffled then is a row for each text
    without the text.

    Edge cases. Null text: no words and null ratios. Empty text: no words, null ratios. White space: a symbol ratio of
    0 and null for the others. A word listed for several languages counts once. Repeated texts give repeated rows;
    empty tables an empty result or a common share of 0; other columns are ignored.
    """
    t, ws = F.col("t"), F.col("ws")
    listed = common.select(F.lower(F.col(word)).alias("w")).where(F.col("w").isNotNull()).distinct().withColumn("listed", F.lit(1))
    base = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("k"))
    words = base.withColumn("ws", F.coalesce(F.regexp_extract_all("t", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array().cast("array<string>")))
    letters = F.aggregate(ws, F.lit(0), lambda n, w: n + F.length(w))
    spaces = F.length(t) - F.length(F.translate(t, _BLANKS + "\n", ""))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x != "")
    stats = words.select("k", "d", "t", "ws", F.size(ws).alias("n_words"), letters.alias("letters"), spaces.alias("spaces"), lines.alias("lines"))
    ends = F.size(F.filter("lines", lambda x: F.right(x, F.lit(1)).isin(*_FULL_STOPS)))
    stats = stats.select(
        "k",
        "d",
        "n_words",
        F.when(F.col("n_words") > 0, F.col("letters") / F.col("n_words")).alias("mean_word_len"),
        F.when(F.length(t) > 0, (F.length(t) - F.col("letters") - F.col("spaces")) / F.length(t)).alias("symbol_ratio"),
        F.when(F.size("lines") > 0, ends / F.size("lines")).alias("line_punct"),
        F.transform(ws, F.lower).alias("ws"),
    )
    # apart from the figures, which would else be computed again for each word
    stats = stats.select(*[c for c in stats.columns if c != "ws"], F.explode_outer("ws").alias("w"))
    held = stats.join(listed, "w", "left").groupBy("k", "d", "n_words", "mean_word_len", "symbol_ratio", "line_punct").agg(F.count("listed").alias("n"))
    share = F.when(F.col("n_words") > 0, F.col("n") / F.col("n_words"))
    return held.select(F.col("d").alias(doc_id), "n_words", "mean_word_len", "symbol_ratio", "line_punct", share.alias("common_share"))


def _common(common: DataFrame, lang: str, word: str, most: int) -> list[tuple[str, str]]:
    rows = common.select(F.col(lang).alias("l"), F.col(word).alias("w")).where(F.col("w").isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words; give a larger max_common, or profiles fitted on fewer")
    return sorted((r["l"] or "", r["w"]) for r in rows)


_SEGMENTED = "d bigint, counts binary, sizes binary, words array<string>, times array<int>, lang string, word string, share int, n array<bigint>"
_SEGMENTED_ARROW = pa.schema([
    ("d", pa.int64()), ("counts", pa.binary()), ("sizes", pa.binary()), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int32())),
    ("lang", pa.string()), ("word", pa.string()), ("share", pa.int32()), ("n", pa.list_(pa.int64())),
])


def _segmented(docs: DataFrame, common: list[tuple[str, str]], doc_id: str, text: str) -> DataFrame:
    """The segments of each text and what they add to the prose of each language, in one pass over all texts.

    A text has one row without ``lang``: the class counts and characters of its segments as packed int32, and its common
    words with their counts. Rows with ``lang`` are partial sums: of a language's prose segments by their share of
    common words in twentieths (their number and class counts), and of each common word in them.
    """
    packed = docs.sparkSession.sparkContext.broadcast(common)

    def batch_of(cols, width):
        blank = [None] * len(cols[0])
        full = [*cols, *[blank] * 4] if width == 5 else [*[blank] * 5, *cols]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(full, _SEGMENTED_ARROW.types, strict=True)], schema=_SEGMENTED_ARROW)

    def count(batches):
        scales = Scales(packed.value)
        sums: dict[tuple[str, int], list] = {}
        words: dict[tuple[str, str], int] = {}

        def added():
            rows = [(lang, "", share, cell) for (lang, share), cell in sums.items()] + [(lang, w, 0, [k]) for (lang, w), k in words.items()]
            sums.clear()
            words.clear()
            return batch_of(list(zip(*rows, strict=True)) if rows else [[]] * 4, 4)

        for batch in batches:
            texts = []
            for t in batch.column("t").to_pylist():
                whole: Counter = Counter()
                tally: Counter = Counter()
                counts, sizes = [], []
                for n, size, bit in scales.segments(t, tally) if t else ():
                    counts.append(n)
                    sizes.append(size)
                    total = sum(n[:5])
                    if bit and not bit & (bit - 1) and total >= SAMPLE_WORDS and n[0] >= SAMPLE_SHARE * total:
                        lang = scales.langs[bit.bit_length() - 1]
                        cell = sums.setdefault((lang, int(20 * n[0] / total)), [0] * 10)
                        for i, x in enumerate((1, *n)):
                            cell[i] += x
                        for w, k in tally.items():
                            words[lang, w] = words.get((lang, w), 0) + k
                    for w, k in tally.items():
                        whole[w] += k
                    tally.clear()
                texts.append((_table(counts).tobytes(), np.array(sizes, dtype=np.int32).tobytes(), list(whole), list(whole.values())))
                if len(words) >= HELD_WORDS:
                    yield added()
            yield batch_of([batch.column("d").cast(pa.int64()).to_pylist(), *(zip(*texts, strict=True) if texts else [[]] * 4)], 5)
        yield added()

    return spread(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))).mapInArrow(count, _SEGMENTED)


def fit_prose(docs: DataFrame, common: list[tuple[str, str]], *, doc_id: str = "doc_id", text: str = "text") -> tuple[Profiles, dict[str, dict[str, int]]]:
    """Profiles of the prose of each language in ``common``, and how often its common words stand in it.

    All texts are read whole. A segment counts for the language that has most of its common words, if it has
    :data:`SAMPLE_WORDS` words and a share of :data:`SAMPLE_SHARE` of them. Of a language two profiles are made, of
    the third of its segments poorest and of that richest in common words. A language with fewer than 30 segments
    has none and is left to the general profiles.
    """
    return _fitted(_segmented(docs, common, doc_id, text))


def _fitted(segmented: DataFrame) -> tuple[Profiles, dict[str, dict[str, int]]]:
    parts = segmented.where("lang is not null").select("lang", "word", "share", F.posexplode("n").alias("i", "x"))
    fitted: dict[str, tuple] = {}
    words: dict[str, dict[str, int]] = {}
    sums: dict[str, dict[int, np.ndarray]] = {}
    # at most 21 rows of ten numbers for a language and one for each common word
    for r in parts.groupBy("lang", "word", "share", "i").agg(F.sum("x").alias("x")).collect():
        if r["word"]:
            words.setdefault(r["lang"], {})[r["word"]] = r["x"]
        else:
            sums.setdefault(r["lang"], {}).setdefault(r["share"], np.zeros(10))[r["i"]] = r["x"]
    for lang, by in sorted(sums.items()):
        total = sum(c[0] for c in by.values())
        if total < 30:
            continue
        for name, order in (("poor", sorted(by)), ("rich", sorted(by, reverse=True))):
            cell = np.zeros(10)
            for share in order:
                if cell[0] * 3 < total:
                    cell += by[share]
            fitted[f"prose_{lang}_{name}"] = tuple(_shares(cell[None, 1:])[0])
    return Profiles(fitted), words


def text_structure(docs: DataFrame, common: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", word: str = "word", max_common: int = 1_000_000) -> DataFrame:
    """The structure of each text: ``(doc_id, outside DOUBLE, profile STRING, language STRING)``, one row for each row of ``docs``.

    ``outside`` is the share of characters (white space aside) outside natural sentences; ``profile`` the nearest
    structural profile of the larger part; ``language`` the language of ``common`` whose distribution of common words
    is nearest to the text's, empty if it has none.

    Method. A text is cut into lines and sentences. The common words of a language, other words, numbers, symbols,
    repeats and the separators of each segment are held against prose profiles and structural ones (lists, tables,
    trails, logs, code, markup, number dumps, symbol runs, word lists and salads, repeats) by Jensen-Shannon
    divergence. The prose profiles of each language, rich and poor in common words, are fitted on all texts
    (:func:`fit_prose`); general ones stand for other languages and layouts (lines of one word, wide gaps). Since
    short segments tell little, a label changes between neighbours only for more evidence than a change costs. Every
    segment of the whole text counts.

    Plan. One pass over the texts, without shuffle, writes what their segments are made of and sums up the prose of
    each language; one over that table judges them. The common words are broadcast, at most ``max_common`` of them; a
    larger table is an error.

    Edge cases. Null, empty and white texts have ``outside`` 0, the profile ``empty`` and no language. A word listed
    for several languages counts for each. Repeated documents give repeated rows; empty tables an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = _common(common, lang, word, max_common)
    read = Cut(spark, "structure").keep(_segmented(docs, rows, doc_id, text))
    packed = spark.sparkContext.broadcast((rows, *_fitted(read)))
    kinds = [pa.float64(), pa.string(), pa.string()]
    names = [doc_id, "outside", "profile", "language"]

    def texts(batch):
        for counts, sizes, words, times in zip(*(batch.column(c).to_pylist() for c in ("counts", "sizes", "words", "times")), strict=True):
            tally = dict(zip(words, times, strict=True))
            yield np.frombuffer(counts, dtype=np.int32).reshape(-1, len(CLASSES)), np.frombuffer(sizes, dtype=np.int32).tolist(), tally

    def run(batches):
        scales = Scales(*packed.value)
        for batch in batches:
            out = list(scales.judged(texts(batch)))
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("d"), *cols], names)

    schema = f"{doc_id} bigint, outside double, profile string, language string"
    return spread(read.where("lang is null").select("d", "counts", "sizes", "words", "times")).mapInArrow(run, schema)


def not_prose(quality: DataFrame, most: float = 0.5) -> DataFrame:
    """Documents of whose characters more than ``most`` lie outside natural sentences."""
    return quality.where(F.col("outside") > most)
