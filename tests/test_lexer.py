import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.config import LexerConfig
from weftline.operators import lexer as L

SEPS = "_-"


def entries_at(text, words):
    out = {}
    for s, e, t in L.spans(text, SEPS):
        for no, w in enumerate(words):
            if w.replace("-", "_") == t.replace("-", "_"):
                out.setdefault(s, []).append((e, no))
    return out


def all_readings(text, words):
    """Brute force over all ways to read a field."""
    at = entries_at(text, words)

    def go(pos):
        if pos >= len(text):
            yield ()
            return
        skip = lambda p: p + 1 if p < len(text) and text[p] in SEPS else p
        for end, no in at.get(pos, ()):
            for rest in go(skip(end)):
                yield (no, *rest)
        if text[pos] in SEPS:
            yield from go(pos + 1)
        else:
            end = next((i for i in range(pos, len(text)) if text[i] in SEPS), len(text))
            for rest in go(skip(end)):
                yield (text[pos:end], *rest)

    every = set(go(0))
    least = min(sum(isinstance(x, str) for x in r) for r in every)
    best = [r for r in every if sum(isinstance(x, str) for x in r) == least]
    size = min(map(len, best))
    return {r for r in best if len(r) <= size + 1}


word = st.text("ab", min_size=1, max_size=2)
phrase = st.builds(lambda ws, ss: "".join(itertools.chain.from_iterable(zip(ws, ss, strict=False))).strip("_-"), st.lists(word, min_size=1, max_size=4), st.lists(st.sampled_from(SEPS), min_size=4, max_size=4))


@settings(max_examples=150, deadline=None)
@given(st.lists(phrase.filter(bool), max_size=6), phrase.filter(bool))
def test_segmentations_match_brute_force(words, text):
    got = L.segmentations(text, entries_at(text, words), SEPS)
    assert len(got) == len({tuple(g) for g in got})
    assert {tuple(g) for g in got} == all_readings(text, words)


def test_long_field_is_quick():
    text = "_".join(["a"] * 60)
    got = L.segmentations(text, entries_at(text, ["a", "_".join(["a"] * 20)]), SEPS)
    assert min(map(len, got)) == 3 and all(len(g) <= 4 for g in got)


def test_trailing_link_and_separators():
    assert L.segmentations("a", entries_at("a", ["a-"]), SEPS) == [[0]]
    assert L.segmentations("a-_-b", {}, SEPS) == [["a", "b"]]
    assert L.segmentations("new_york", entries_at("new_york", ["new-york"]), SEPS) == [[0]]
    assert L.segmentations("", {}, SEPS) == [[]]


def test_cover():
    assert L.cover_size([]) == 0 and L.cover_size([frozenset({1}), frozenset({2})]) == 2
    assert L.cover_size([frozenset({1, 2}), frozenset({2, 3}), frozenset({4})]) == 2


def test_lex(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal(16)
    near = {2: base, 3: base + r.standard_normal(16) * 0.05}
    types = spark.createDataFrame([(1, "E"), (2, "N"), (3, "V")], "typeno int, type string")
    feats = ["new_york", "new", "york", "big-apple", "bare"]
    features = spark.createDataFrame([*enumerate(feats, 1), (1, "new_york")], "featno int, feature string")
    relations = spark.createDataFrame([(1, [1, 3]), (2, [2, 3]), (3, [2, 1]), (4, [3])], "featno int, typenos array<int>")
    vecs = [(1, 1, near[2]), (3, 4, near[3]), (2, 2, r.standard_normal(16)), (2, 3, r.standard_normal(16)), (1, 3, r.standard_normal(16))]
    vectors = spark.createDataFrame([(t, f, [float(x) for x in v]) for t, f, v in vecs], "typeno int, featno int, vec array<float>")
    queries = spark.createDataFrame([(1, ["new_york", "big_apple"], -1, 0.0), (2, ["nowhere_york"], 1, None), (3, [None, ""], 5, 0.0), (4, None, 5, 0.0), (5, ["bare"], None, 0.0), (6, ["new york"], 5, 0.0)], "query_id bigint, fields array<string>, n int, min_weight double")
    out = {}
    for x in L.lex(queries, features, relations, types, vectors, LexerConfig({"E": 0, "N": 1, "V": 2}, coversim=0.8)).orderBy("query_id", "rank").collect():
        out.setdefault(x.query_id, []).append(([(t.type, t.value) for t in x.terms], x.weight))
    assert out[1][0] == ([("E", "new_york"), ("V", "big-apple")], 1.0)
    assert out[1][1][0] == [("N", "new"), ("E", "york"), ("V", "big-apple")] and out[1][1][1] < 1
    assert out[2] == [([("", "nowhere"), ("E", "york")], 1.0)] and 3 not in out and 4 not in out
    assert out[5] == [([("", "bare")], 1.0)] and out[6][0][0] == [("", "new york")]


def test_composite_numbers(spark):
    """Primes are letters; composite numbers are phrases of their factors. A phrase is read as one feature of type E."""
    def factors(n):
        return [p for p in range(2, n + 1) if n % p == 0 and all(p % q for q in range(2, p))]

    letters = {p: chr(97 + i) for i, p in enumerate(p for p in range(2, 40) if all(p % q for q in range(2, p)))}
    rnd = random.Random(4)
    names = {n: rnd.choice("_-").join(letters[p] for p in factors(n)) for n in range(2, 40)}
    rows = sorted(set(names.values()))
    features = spark.createDataFrame(list(enumerate(rows, 1)), "featno int, feature string")
    types = spark.createDataFrame([(1, "E"), (2, "N")], "typeno int, type string")
    relations = spark.createDataFrame([(i, [1] if len(x) > 1 else [2]) for i, x in enumerate(rows, 1)], "featno int, typenos array<int>")
    none = spark.createDataFrame([], "typeno int, featno int, vec array<float>")
    queries = spark.createDataFrame([(n, [x.replace("-", "_")], -1, 0.0) for n, x in names.items()], "query_id bigint, fields array<string>, n int, min_weight double")
    best = {r.query_id: r.terms for r in L.lex(queries, features, relations, types, none, LexerConfig({"E": 0, "N": 0})).where("rank = 1").collect()}
    for n, x in names.items():
        assert len(best[n]) == 1 and best[n][0].type == ("E" if len(x) > 1 else "N")
        assert best[n][0].value.replace("-", "_") == x.replace("-", "_")
