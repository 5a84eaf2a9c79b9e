"""Sentence lexer: query fields to typed features, ranked by how few groups of similar features cover them."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import LexerConfig

#: Longest dictionary entry that matches, in bytes.
MAX_ENTRY = 255
_SCALE, _DUP, _LEN = 1.3, 1.0, 0.3


def boundaries(text: str, seps: str) -> tuple[list[int], list[int]]:
    """Places where a word or a separator starts, and where an entry may end."""
    starts = [i for i, c in enumerate(text) if i == 0 or c in seps or text[i - 1] in seps]
    ends = [i for i in range(1, len(text) + 1) if i == len(text) or text[i] in seps]
    return starts, ends


def spans(text: str, seps: str) -> list[tuple[int, int, str]]:
    """``(start, end, text)`` of all spans that a dictionary entry might fill.

    An entry ends at the end of the field or before a separator; one that is the rest of the field and one trailing
    link more also matches.
    """
    starts, ends = boundaries(text, seps)
    out = []
    for s in starts:
        for e in ends:
            if s < e and len(text[s:e].encode()) <= MAX_ENTRY:
                out.append((s, e, text[s:e]))
        if s < len(text):
            out.append((s, len(text), text[s:] + seps[-1]))
    return out


def segmentations(text: str, matches: dict[int, list[tuple[int, int]]], seps: str) -> list[list[int | str]]:
    """Ways to read a field as entries (their numbers) and unresolved words.

    Kept are the readings with the fewest unresolved words and, among these, at most one item more than the shortest.
    ``matches`` gives ``(end, entry)`` for each start. One separator after an item is swallowed; a separator that no
    entry begins with is skipped for free. The readings come in a fixed order, each once.
    """
    n = len(text)

    def after(pos: int) -> int:
        return pos + 1 if pos < n and text[pos] in seps else pos

    def steps(pos: int):
        for end, entry in matches.get(pos, ()):
            yield after(end), entry, 0
        if text[pos] in seps:
            yield pos + 1, None, 0
        else:
            end = next((i for i in range(pos, n) if text[i] in seps), n)
            yield after(end), text[pos:end], 1

    @lru_cache(maxsize=None)
    def best(pos: int) -> tuple[int, int]:
        if pos >= n:
            return 0, 0
        return min((u + best(to)[0], (item is not None) + best(to)[1]) for to, item, u in steps(pos))

    if not n:
        return [[]]
    for pos in range(n - 1, -1, -1):
        best(pos)
    least, size = best(0)

    @lru_cache(maxsize=None)
    def shortest(pos: int, left: int) -> float:
        """Fewest items from a place on with at most ``left`` unresolved words."""
        if pos >= n:
            return 0
        return min(((item is not None) + shortest(to, left - u) for to, item, u in steps(pos) if u <= left and best(to)[0] <= left - u), default=float("inf"))

    out: dict[tuple, None] = {}
    stack: list[tuple[int, int, tuple]] = [(0, least, ())]
    while stack:
        pos, left, items = stack.pop()
        if pos >= n:
            out.setdefault(items)
            continue
        for to, item, u in steps(pos):
            more = items if item is None else (*items, item)
            if u <= left and best(to)[0] <= left - u and len(more) + shortest(to, left - u) <= size + 1:
                stack.append((to, left - u, more))
    return [list(x) for x in sorted(out, key=lambda x: (len(x), [str(i) for i in x]))]


def cover_size(groups: list[frozenset[int]]) -> int:
    """Size of a greedy cover: groups that hold most uncovered terms first, ties to the smaller group."""
    left, n = list(groups), 0
    while left:
        counts: dict[int, int] = {}
        for g in left:
            for x in g:
                counts[x] = counts.get(x, 0) + 1
        top = min(counts, key=lambda x: (-counts[x], x))
        left = [g for g in left if top not in g]
        n += 1
    return n


def similar_groups(terms: list, vectors: dict, coversim: float) -> dict:
    """Groups of each term: a term's own number and those of the terms at a cosine above ``coversim``."""
    own = {t: i for i, t in enumerate(terms)}
    with_vec = [t for t in terms if t in vectors]
    groups = {t: {own[t]} for t in terms}
    if with_vec:
        x = np.array([vectors[t] for t in with_vec], dtype=np.float64)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        for i, j in zip(*np.nonzero(x @ x.T > coversim), strict=True):
            groups[with_vec[i]].add(own[with_vec[j]])
    return {t: frozenset(g) for t, g in groups.items()}


def weigh(sentence: list, groups: dict) -> float:
    """Weight of a sentence: fewer groups, fewer repeated terms and fewer terms weigh more."""
    dups = len(sentence) - len(set(sentence))
    return _SCALE / (cover_size([groups[t] for t in sentence]) + _DUP * dups + _LEN * len(sentence))


def guesses(fields: list[str], hits: dict[int, dict[int, list[tuple[int, int]]]], types: dict[int, list[int]], vectors: dict, config: LexerConfig, n: int, min_weight: float) -> list[tuple[list[tuple[int, int | str]], float]]:
    """Ranked sentences of a query: lists of ``(typeno, featno or text)``, and their weights.

    ``hits`` has the matches of each field, ``types`` the types of the best priority of each feature. Weights are
    divided by the largest; sentences below ``min_weight`` and beyond the first ``n`` (all if negative) are left out.
    """
    seps = config.spacesb + config.linksb
    sentences: dict[tuple, None] = {(): None}
    for k, text in enumerate(fields):
        if not text:
            continue
        readings = segmentations(text, hits.get(k, {}), seps)
        variants: dict[tuple, None] = {}
        for items in readings:
            options = [[(0, i)] if isinstance(i, str) else [(t, i) for t in types.get(i) or [0]] for i in items]
            for v in product(*options):
                variants.setdefault(v)
        sentences = dict.fromkeys((*s, *v) for s in sentences for v in variants)
    ranked = [list(s) for s in sentences if s]
    if not ranked:
        return []
    terms = list(dict.fromkeys(t for s in ranked for t in s))
    groups = similar_groups(terms, vectors, config.coversim)
    scored = sorted(((weigh(s, groups), i) for i, s in enumerate(ranked)), key=lambda x: (-np.float32(x[0]), x[1]))
    top = scored[0][0]
    scored = scored if n < 0 else scored[:n]
    eps = float(np.finfo(np.float32).eps)
    return [(ranked[i], w / top) for w, i in scored if w / top >= min_weight + (eps if min_weight > 0 else 0)]


GUESSES = "query_id bigint, rank int, terms array<struct<type: string, value: string>>, weight double"


def lex(queries: DataFrame, features: DataFrame, relations: DataFrame, types: DataFrame, vectors: DataFrame, config: LexerConfig) -> DataFrame:
    """Typed readings of query fields: ``(query_id, rank, terms, weight)``.

    ``queries`` has ``(query_id, fields ARRAY<STRING>, n INT, min_weight DOUBLE)``, fields in their normal form with
    the characters of ``config`` for spaces and links; the two compare as equal. Of a feature's types those of the
    lowest priority number count, all if there are several; without ``lextypes`` all types have one priority.
    Unresolved words have the type ``''``.

    Plan. All spans of the fields that an entry might fill are joined with the dictionary, and features with their
    types and vectors, by shuffles: the dictionary is never broadcast. One task reads a query from its own matches.

    Edge cases. Null and empty fields are skipped; a query without any text has no rows. Null ``n`` means all,
    null ``min_weight`` 0. An undefined type in ``lextypes`` is an error. Repeated dictionary rows count once.
    """
    known = {r["type"]: r["typeno"] for r in types.collect()}
    if missing := set(config.lextypes) - set(known):
        raise ValueError(f"undefined types: {sorted(missing)}")
    levels = config.lextypes or dict.fromkeys(known, 0)
    seps = config.spacesb + config.linksb
    fold = str.maketrans(config.linksb, config.spacesb)

    def split(batches):
        for pdf in batches:
            rows = [(q, k, s, e, t.translate(fold)) for q, fs in zip(pdf["query_id"], pdf["fields"], strict=True) if fs is not None for k, f in enumerate(fs) if f for s, e, t in spans(f, seps)]
            yield pd.DataFrame(rows, columns=["query_id", "field", "s", "e", "folded"])

    asked = queries.where(F.col("query_id").isNotNull())
    cut = asked.select("query_id", "fields").mapInPandas(split, "query_id bigint, field int, s int, e int, folded string").distinct()
    prio = types.sparkSession.createDataFrame([(known[t], p) for t, p in levels.items()] or [(-1, 0)], "typeno int, prio int")
    rel = relations.select("featno", F.explode("typenos").alias("typeno")).join(F.broadcast(prio), "typeno")
    best = rel.groupBy("featno").agg(F.min(F.struct("prio")).alias("p"), F.collect_set(F.struct("prio", "typeno")).alias("all"))
    best = best.select("featno", F.array_sort(F.transform(F.filter("all", lambda x: x["prio"] == F.col("p.prio")), lambda x: x["typeno"])).alias("typenos"))
    words = features.select("featno", "feature", F.translate("feature", config.linksb, config.spacesb).alias("folded")).distinct()
    found = cut.join(words, "folded").join(best, "featno", "left")
    vec = vectors.select("typeno", "featno", "vec")
    terms = found.select("query_id", "featno", "typenos").distinct().select("query_id", "featno", F.explode("typenos").alias("typeno")).join(vec, ["typeno", "featno"])
    by_vec = terms.groupBy("query_id").agg(F.collect_list(F.struct("typeno", "featno", "vec")).alias("vecs"))
    by_hit = found.groupBy("query_id").agg(F.collect_list(F.struct("field", "s", "e", "featno", "feature", "typenos")).alias("hits"))
    names = {v: k for k, v in known.items()}

    def read(batches):
        for pdf in batches:
            out = []
            for q, fields, n, low, hits, vecs in zip(*[pdf[c] for c in ("query_id", "fields", "n", "min_weight", "hits", "vecs")], strict=True):
                at: dict[int, dict[int, list]] = {}
                kinds: dict[int, list[int]] = {}
                label: dict[int, str] = {}
                for h in sorted([] if hits is None else hits, key=lambda h: (h["field"], h["s"], h["e"], h["featno"])):
                    at.setdefault(h["field"], {}).setdefault(h["s"], []).append((h["e"], h["featno"]))
                    kinds[h["featno"]] = [] if h["typenos"] is None else list(h["typenos"])
                    label[h["featno"]] = h["feature"]
                held = {(v["typeno"], v["featno"]): v["vec"] for v in ([] if vecs is None else vecs)}
                fs = [] if fields is None else [f or "" for f in fields]
                found = guesses(fs, at, kinds, held, config, -1 if pd.isna(n) else int(n), 0.0 if pd.isna(low) else float(low))
                for rank, (sentence, w) in enumerate(found, 1):
                    out.append((q, rank, [{"type": names.get(t, ""), "value": v if isinstance(v, str) else label[v]} for t, v in sentence], w))
            yield pd.DataFrame(out, columns=["query_id", "rank", "terms", "weight"])

    return asked.select("query_id", "fields", "n", "min_weight").join(by_hit, "query_id", "left").join(by_vec, "query_id", "left").mapInPandas(read, GUESSES)
