import random

import pytest
from tokenizers import Tokenizer

from weftline.llm import encode as E
from weftline.llm import leaks as L
from weftline.llm import quality as Q
from weftline.llm.automaton import SuffixAutomaton
from weftline.llm.normal import words
from weftline.llm.queries import RANKS
from weftline.llm.transducer import Transducer, compile_words

DOCS = "doc_id bigint, text string, lang string, d string, t string, ids int, words int, n_words int, item_id string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", "y", 1, 2, 3, "z") for i, t in texts], DOCS)


# -- encoding -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return E.read_ranks(RANKS)


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_transducer():
    r = random.Random(1)
    table = {"".join(r.choice("abcé") for _ in range(r.randrange(1, 9))).encode(): [r.randrange(9) for _ in range(r.randrange(0, 4))] for _ in range(800)}
    t = Transducer(compile_words(table.items()))
    assert len(t) == len(table) and all(t.get(w) == ids for w, ids in table.items())
    assert all(t.get(w + b"x") is None for w in table) and t.get(b"") is None
    assert len(t.starts) - 1 < sum(map(len, table))  # suffixes are shared
    none = Transducer(compile_words([]))
    assert none.get(b"a") is None and len(none) == 0
    with pytest.raises(ValueError):
        Transducer(b"x" * 100)


def test_ids_match_the_public_tokenizer(spark, reference):
    r = random.Random(2)
    texts = [None, "", " ", "\n\n ", "<|endoftext|> text", "don't WE'LL 12 345", "x" * 9000, "ab" * 4000 + "!" * 3000, "é é ﬁ ½²", "\x00\x1c\x85 ​﻿", "日本語のテキスト 地図", "🙂👩‍👩‍👧"]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(0xA0, 0x2FFF), r.randint(0x10000, 0x1F9FF), 32, 10])) for _ in range(80)) for _ in range(150)]
    texts += ["the cat sat on the mat " * 3] * 5
    rows = [*enumerate(texts), (3, "again"), (None, "no id")]
    got = E.encode_corpus(docs(spark, rows), RANKS, words=40).collect()
    want = sorted(((-1 if i is None else i, tuple(reference(t)) if t else ()) for i, t in rows))
    assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in got) == want


def test_encode_empty_table(spark):
    assert E.encode_corpus(docs(spark, []), RANKS).count() == 0


def test_merge_of_long_pieces(ranks, reference):
    for piece in ("a" * 3001, "abcabd" * 700, "~!@#$" * 900):
        assert E.merge(piece.encode(), ranks) == reference(piece)


def test_word_counts(spark):
    got = {r.word: r.n for r in E.word_counts(docs(spark, [(1, "a b a"), (2, " a"), (3, None)]).selectExpr("doc_id AS d", "text AS t")).collect()}
    assert got == {"a": 1, " b": 1, " a": 2}


# -- leaks --------------------------------------------------------------------------------------------------------

ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu"
OTHER = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ASK = "Read the passage and answer."


def test_automaton_against_brute_force():
    r = random.Random(5)
    items = [[r.randrange(4) for _ in range(r.randrange(1, 40))] for _ in range(12)]
    text = [r.randrange(4) for _ in range(200)]
    auto = SuffixAutomaton(items)
    grams = {tuple(i[a:b]) for i in items for a in range(len(i)) for b in range(a + 1, len(i) + 1)}
    for k, (state, n) in enumerate(auto.longest(text)):
        want = max((m for m in range(1, k + 2) if tuple(text[k + 1 - m : k + 1]) in grams), default=0)
        assert n == want
        if n:
            run = text[k + 1 - n : k + 1]
            assert set(auto.ends(state)) == {(i, p) for i, x in enumerate(items) for p in range(n - 1, len(x)) if x[p + 1 - n : p + 1] == run}


def find(spark, texts, items):
    d = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((r.doc_id, r.item_id) for r in L.leaks(docs(spark, texts), d).collect())


def changed(n, gaps, item=ITEM):
    """The first ``n`` words with those at ``gaps`` changed."""
    w = item.split()[:n]
    return " ".join("zzz" if i in gaps else x for i, x in enumerate(w))


def test_leaks(spark):
    items = [(1, f"{ITEM}. {ASK}"), (2, f"{ASK} {OTHER}"), (3, None), (4, ""), (5, "short item"), (1, f"{ITEM}. {ASK}"), (6, f"{ASK}")]
    full = ITEM.split()
    texts = {
        1: f"before it {ITEM} and after", 2: changed(18, {5, 11}), 3: changed(24, {3, 10, 17}), 4: changed(14, set()), 5: changed(20, {2, 5, 8, 11, 14, 17}),
        6: " ".join(reversed(full)), 7: " ".join(w for i, w in enumerate(full) if i not in (8, 16)), 8: " ".join(f"{w} and" if i in (6, 15) else w for i, w in enumerate(full)),
        9: ITEM.upper().replace(" ", ",\n  "), 10: "".join(f"<b>{w}</b> " for w in full), 11: ITEM.replace("charlie", "char-\n> lie").replace("golf", "go­lf").replace("a", "а"),
        12: "".join(chr(ord(c) + 0xFEE0) if c != " " else " " for c in ITEM), 13: f"{ASK} {ASK} {ASK} {ASK}", 14: None, 15: "", 16: "  \n", 17: f"{OTHER} {ITEM}", 18: " ".join(["filler word here"] * 30_000) + " " + ITEM,
        19: " ".join(full[:10]) + f" {ASK} " + " ".join(full[10:]), 20: ITEM.replace("b", "&#98;").replace(" ", "&nbsp; "),
    }
    got = find(spark, list(texts.items()) + [(1, texts[1])], items)
    assert got == sorted([(d, 1) for d in (1, 1, 2, 3, 7, 8, 9, 10, 11, 12, 17, 18, 19, 20)] + [(17, 2)])


def test_equal_items_and_blocks(spark, monkeypatch):
    items = [(i, ITEM if i < 3 else f"{OTHER} nr{i} {' '.join(f'w{i}x{k}' for k in range(20))}") for i in range(40)]
    texts = [(1, ITEM), (2, items[30][1]), (3, "nothing at all")]
    one = find(spark, texts, items)
    assert one == [(1, 0), (1, 1), (1, 2)] + [(2, i) for i in range(3, 40)]  # the items share their first words
    many = L.leaks(docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=400)
    assert sorted((r.doc_id, r.item_id) for r in many.collect()) == one


def test_places_of_words():
    for text in ("Ｆｕｌｌ “Café” l’été <i class='x y'>x</i>y &amp; z_1 co-\nop е‍ж", "a<br/>b<!-- no no -->c d-\n> e", "道が静か だった。 x", "...", "a &nbsp;b&#8217;c"):
        assert len(L.places(text)) == len(words(text)) and all(0 <= a < b <= len(text) for a, b in L.places(text))
    text = "Before <b>Some Words</b> here, after."
    a, b = L.places(text)[1][0], L.places(text)[3][1]
    assert text[a:b] == "<b>Some Words</b> here,"


def test_cleaned(spark):
    filler = "nothing of this stands in any item and goes on for quite a while so that most of the text is left over. " * 4
    rows = [(1, filler + ITEM + " " + filler), (2, ITEM), (3, None), (4, ""), (5, filler), (6, ITEM.upper().replace(" ", "\n") + "\n" + filler * 3)]
    items = spark.createDataFrame([(7, ITEM), (8, ITEM)], "item_id bigint, text string")
    frame = docs(spark, rows)
    found = L.leaks(frame, items)
    for r in found.collect():
        assert words(dict(rows)[r.doc_id][r.start : r.stop]) == words(ITEM)
    got = {r.doc_id: (r.text, r.removed) for r in L.cleaned(frame, found).collect()}
    assert len(got) == 6 and got[2] == (None, len(ITEM)) and got[3] == (None, 0) and got[4] == ("", 0) and got[5] == (filler, 0)
    assert words(got[1][0]) == words(filler + filler) and words(got[6][0]) == words(filler * 3)
    assert L.leaks(spark.createDataFrame([(r.doc_id, r.text) for r in L.cleaned(frame, found).collect()], "doc_id bigint, text string"), items).count() == 0


def test_leaks_of_empty_tables(spark):
    assert find(spark, [], [(1, ITEM)]) == [] and L.leaks(docs(spark, [(1, ITEM)]), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_longest_run():
    assert L.longest_run(18, 8) == 6


def test_words():
    assert words("Ｆｕｌｌ “Café” l’été <i>x</i>y &amp; z_1 co-\nop е‍ж") == ["full", "cafe", "l", "ete", "xy", "z", "1", "coop", words("ж")[0].join(["e", ""])]
    assert words('a <a title="q > r" href=\'' + "x y " * 1500 + "'>b</a> <!-- " + "no " * 3000 + "--> c <!-- d") == ["a", "b", "c", "d"]
    assert words(None) == [] and words("...") == []


# -- quality ------------------------------------------------------------------------------------------------------

COMMON = [("en", w) for w in "the a of and to in is it that was for on with as his they at be this from or had by but not what all were we when there an she which do their if will how so".split()] + [("ja", w) for w in "の は を が に で と だ た".split()] + [(None, None), ("fr", "la"), ("es", "la")]
PROSE = "It was the end of the day when they came to the house on the hill, and there was not a light in it. She had seen that all of them were tired."


def scales():
    return Q.Scales([(a or "", b) for a, b in COMMON if b])


NATURAL = {
    "plain": PROSE, "upper": PROSE.upper(), "no stops": PROSE.lower().replace(".", "").replace(",", ""), "one word a line": PROSE.replace(" ", "\n"), "wrapped": PROSE.replace(" the", "\nthe"), "quoted": "> " + PROSE.replace(" and", "\n> and"),
    "cut": PROSE[:40], "picture": "The road was on the hill. 👍🏽", "address": "She had seen that road. https://veguvon.example/devevor", "the twice": "The kitchen opens the mountain along the northern\nline.", "wide gaps": PROSE.replace(" ", "   "), "tabs": PROSE.replace(" ", "\t"), "japanese": "道が10日間ケフドン器とともに冬を運ぶことを私たちは知っている。山は静かだった。",
}
JUNK = {
    "list": "- house\n- hill\n- light (12)\n- day", "numbered": "1. house\n2. hill\n3. light\n4. day", "comma list": ", ".join(["house", "hill", "light", "day", "river", "road", "tower"] * 3), "csv": "house,12,hill\nriver,8.5,road\nday,77,tower",
    "table": "house\thill\t12\nriver\troad\t8\nday\ttower\t9", "bars": "| house | 12 |\n|---|---|\n| hill | 8 |\n| day | 9 |", "symbols": "~^;{#;>%? _[>$)}>=$ #^<=@{^[)", "dots": ". . . . . . . . . . . .", "rule": "=" * 80, "numbers": "503 917 746 141.79 78525\n1 421.13 2 78069",
    "log": "2025-01-24 00:14:30 [WARN] hudemul=378.00 nonoke\n2025-12-11 12:11:02 [E] runir=0 huriker", "hex": "b6fec8ca2 570c64f96 e0f1abd04 c4667485b f712df655", "links": '<div class="a"><a href="/x/6480">river</a></div><div class="b"><a href="/y/8">road</a></div>', "repeats": "Dorf! " * 30, "salad": "Babil taradol ketakus pesani madon tobin beshihul nukol. Nutu nobehur risaro vove bepidor.",
    "trail": "River » Kitanity » Road » Market » Dobes Tower » Letter", "long tag": '<div class="' + "on the hill and " * 60 + '">river</div><div class="b">road</div>',
    "code": "pepir(pigavor, 238):\n  terodon(gumil, 478) {\n    betedos(gurivon, 397);", "japanese list": "(1) 冬 確実\n(2) 契約\n(3) 市場\n(4) 灯台",
}


@pytest.mark.parametrize("name", list(NATURAL))
def test_natural_text(name):
    assert scales().profile(NATURAL[name])[0] <= 0.5


@pytest.mark.parametrize("name", list(JUNK))
def test_junk(name):
    share, profile, _ = scales().profile(JUNK[name])
    assert share > 0.5 and not profile.startswith("prose")


def test_shares_of_mixed_texts():
    table = "\n".join(["house\thill\t12\t9"] * 12)
    assert scales().profile(PROSE + "\n" + table)[0] > 0.5 and scales().profile("\n".join([PROSE] * 4) + "\n" + table[:60])[0] < 0.5


def test_quality_table(spark):
    common = spark.createDataFrame(COMMON, "lang string, word string")
    rows = [(1, PROSE), (2, JUNK["list"]), (3, None), (4, ""), (5, " \n\t"), (6, "The cat. \nno stop\n\n"), (6, "The cat. \nno stop\n\n"), (None, JUNK["table"]), (8, "x" * 300_000), (9, (PROSE + " ") * 2000)]
    out = {}
    for r in Q.text_statistics(docs(spark, rows), common).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, out.values())) == len(rows) and len(out[6]) == 2
    assert out[6][0].n_words == 4 and out[6][0].mean_word_len == 3.0 and out[6][0].line_punct == 0.5 and out[6][0].common_share == 0.25
    assert out[3][0].n_words == 0 and out[3][0].mean_word_len is None and out[4][0].symbol_ratio is None and out[5][0].symbol_ratio == 0
    assert {r.doc_id for r in Q.not_prose(Q.text_structure(docs(spark, rows), common)).collect()} == {2, None, 8}
    assert Q.text_statistics(docs(spark, []), common).count() == 0 and Q.text_structure(docs(spark, []), common).count() == 0
    none = common.limit(0)
    assert Q.text_statistics(docs(spark, rows), none).count() == len(rows) == Q.text_structure(docs(spark, rows), none).count()
    assert {r.common_share for r in Q.text_statistics(docs(spark, [(1, PROSE)]), none).collect()} == {0.0}


def test_fitted_prose(spark):
    """Profiles come from sentences with a language's common words, and texts are told by how these are distributed."""
    french = "la maison et le chemin de la ville sont dans la nuit".split()
    common = [("en", w) for w in "the and was of in a".split()] + [("fr", w) for w in "la et le de sont dans".split()]
    rows = [(i, PROSE) for i in range(40)] + [(50 + i, " ".join(french) + ".") for i in range(40)] + [(99, "- house\n- hill\n- light (12)\n- day")]
    profiles, words = Q.fit_prose(docs(spark, rows), common)
    assert {k for k in profiles.shares if k not in Q.PROFILES} == {"prose_en_poor", "prose_en_rich", "prose_fr_poor", "prose_fr_rich"}
    assert words["fr"]["la"] == 120 and abs(sum(profiles.shares["prose_fr_rich"]) - 2) < 1e-9
    got = {r.doc_id: (r.outside > 0.5, r.language) for r in Q.text_structure(docs(spark, rows), spark.createDataFrame(common, "lang string, word string")).collect()}
    assert got[0] == (False, "en") and got[50] == (False, "fr") and got[99] == (True, "")


def test_too_many_common_words(spark):
    with pytest.raises(ValueError):
        Q.text_structure(docs(spark, []), spark.createDataFrame(COMMON, "lang string, word string"), max_common=3)


def test_passages_with_changed_ends():
    """Any word of a passage may be the changed one, also its first and its last."""
    words = [f"word{i}" for i in range(19)]
    items = L.Items([(1, " ".join(words))], set())
    for gone, found in (({0}, True), ({18}, True), ({0, 18}, True), ({0, 9, 18}, True), ({0, 9, 10, 18}, False), ({0, 1, 18}, True), ({0, 1, 2, 18}, False)):
        text = " ".join(["before"] * 9 + ["other" if i in gone else w for i, w in enumerate(words)] + ["after"] * 9)
        assert bool(items.found(text)) == found, gone


def test_prose_is_fitted_on_all_texts(spark):
    """Many texts: every common word counts, and so does a language of few texts."""
    common = [("en", w) for w in "the and was of in a".split()] + [("fr", w) for w in "la et le de sont dans".split()]
    rows = [(i, "the house and the hill was in a light of day.") for i in range(9000)]
    rows += [(10_000 + i, "la maison et le chemin de la ville sont dans la nuit.") for i in range(35)]
    profiles, words = Q.fit_prose(docs(spark, rows), common)
    assert words["en"] == {"the": 18_000, "and": 9000, "was": 9000, "in": 9000, "a": 9000, "of": 9000}
    assert words["fr"] == {"la": 105, "et": 35, "le": 35, "de": 35, "sont": 35, "dans": 35} and "prose_fr_rich" in profiles.shares
