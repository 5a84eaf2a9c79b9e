"""Encoding of a whole corpus with a public byte-level tokenizer."""

from __future__ import annotations

import base64
import heapq
import os
from collections import Counter

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.transducer import Transducer, compile_words
from weftline.session import delete_at_exit, local_file, shared_path, spread

# Fixed value: the public pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words kept in a task's memory before it starts anew.
CACHE = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line for each token, its bytes in base 64 and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(no) for token, no in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact byte-pair merges: always the pair of the lowest rank, the leftmost of equals.

    A heap over linked parts, so that a piece of n bytes takes n log n steps however long it is.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0 for parts that are gone
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Words to ids: the lexicon first, exact merges for words that it lacks."""

    def __init__(self, lexicon: Transducer, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.lexicon, self.ranks = lexicon, ranks
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        ids = self.lexicon.get(raw)
        ids = merge(raw, self.ranks) if ids is None else ids
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(word) <= 64:
            self.cache[word] = ids
        return ids

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.cache.get
        for word in self.split(text) if text else ():
            ids = known(word)
            out += self.word(word) if ids is None else ids
        return out


def word_counts(docs: DataFrame, pattern: str = PATTERN, flush: int = 200_000) -> DataFrame:
    """Words of all texts and how often they stand in them: ``(word STRING, n BIGINT)``.

    Counted within each task first, so that a common word is sent once for each task and not for each place.
    """

    def count(batches):
        split, seen = regex.compile(pattern).findall, Counter()
        for pdf in batches:
            for text in pdf["t"]:
                if text:
                    seen.update(w for w in split(text) if len(w) <= 64)
                if len(seen) >= flush:
                    yield pd.DataFrame(list(seen.items()), columns=["word", "n"])
                    seen.clear()
        yield pd.DataFrame(list(seen.items()), columns=["word", "n"])

    return docs.mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, ranks: dict[bytes, int], words: int, least: int, pattern: str = PATTERN) -> bytes:
    """The automaton of the ``words`` most frequent words that stand at least ``least`` times in the corpus."""
    top = word_counts(docs, pattern).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(words).collect()
    raw = [r["word"].encode() for r in top]
    return compile_words((w, merge(w, ranks)) for w in raw)


def encode_corpus(docs: DataFrame, ranks_path: str, *, doc_id: str = "doc_id", text: str = "text", pattern: str = PATTERN, words: int = 50_000, least: int = 2) -> DataFrame:
    """Ids of each text: ``(doc_id BIGINT, ids ARRAY<INT>)``, one row for each row of ``docs``.

    Method. The frequent words of the whole corpus are compiled with their ids into a minimal acyclic automaton with
    shared suffixes, which tasks map into memory from the shared folder; words that it lacks are merged exactly.
    Which words it holds changes the speed and never the ids.

    Plan. Two passes over the texts. The first counts words within tasks and shuffles one row for each word and
    task; the second has no shuffle. The vocabulary (fixed) and at most ``words`` words are all that is sent to
    tasks.

    Edge cases. Null and empty texts give an empty list; white space is encoded. Strings of special tokens are
    ordinary text. Texts and words of any length are encoded whole; words of more than 64 characters are never
    kept. Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    corpus = spread(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")))
    data = build_lexicon(corpus, ranks, words, least, pattern)
    path = shared_path(spark, "lexicon")
    local = local_file(spark, path)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as f:
            f.write(data)
        delete_at_exit(spark, path)
        held = spark.sparkContext.broadcast((local, None, ranks))
    else:  # no path that tasks could map: the bytes themselves, bounded by `words`
        held = spark.sparkContext.broadcast((None, data, ranks))

    def run(batches):
        local, data, ranks = held.value
        encode = Encoder(Transducer.open(local) if local else Transducer(data), ranks, pattern)
        for batch in batches:
            ids = pa.array([encode(t) for t in batch.column("t").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("d").cast(pa.int64()), ids], [doc_id, "ids"])

    return corpus.mapInArrow(run, f"{doc_id} bigint, ids array<int>")
