import random
from itertools import product

import pytest

from leafmill.functions import tibetan as T
from leafmill.operators import analysis as A
from leafmill.operators import nested as N


def test_all_syllables_go_both_ways():
    ambiguous = 0
    for onset, (_, parts) in T.onsets().items():
        for vowel, coda in product(T.VOWELS, T.codas()):
            if vowel == "a" and parts.prefix and not parts.superscript and not parts.subscript and not coda:
                continue  # written with a suffix
            latin = onset + vowel + coda
            script, faults = T.to_script(latin)
            back, others = T.to_latin(script)
            assert not faults and not others and T.to_script(back)[0] == script
            if back != latin:
                ambiguous += 1
                assert latin in [name for name, _ in T.readings(script)]
    assert ambiguous == 11 - 2 + 2


@pytest.mark.parametrize(("latin", "script"), [("bkra shis bde legs", "བཀྲ་ཤིས་བདེ་ལེགས"), ("g.yag gyag", "གཡག་གྱག"), ("pad+me hU~M oM", "པདྨེ་ཧཱུྃ་ཨོཾ"), ("bsgrubs/_12", "བསྒྲུབས། ༡༢"), ("rgyal ba'i", "རྒྱལ་བའི"), ("dbang dmag gnad", "དབང་དམག་གནད"), ("", "")])
def test_transliteration(latin, script):
    assert T.to_script(latin) == (script, []) and T.to_latin(script) == (latin, [])


def test_what_is_no_syllable_is_kept_and_reported():
    assert T.to_script("bla xyz ma") == ("བླ་[xyz]་མ", [(4, 7)]) and T.to_latin("བླ་[xyz]་མ") == ("bla [xyz] ma", [])
    assert T.to_latin("བླ ABC") == ("bla_[ABC]", [(3, 6)]) and T.to_script("bla+") == ("[bla+]", [(0, 4)])
    assert T.to_latin("ྱ")[1] == [(0, 1)] and T.to_script("[bla")[1] == [(0, 1)]
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("abgkyr'+./ []~MTའབྱཱི་") for _ in range(rng.randint(0, 12)))
        T.to_script(text), T.to_latin(text)


def test_transliterated_columns(spark):
    df = spark.createDataFrame([(1, "bla ma"), (2, None), (3, "q ma")], "id int, t string")
    rows = {r.id: r for r in T.transliterated(df, "t").collect()}
    assert rows[1].t_script == "བླ་མ" and rows[1].t_faults == [] and rows[2].t_script is None and rows[2].t_faults is None
    assert rows[3].t_script == "[q]་མ" and [tuple(f) for f in rows[3].t_faults] == [(0, 1)]


def test_forms_for_comparing():
    assert [T.lenient(s) for s in ("བའི", "པ", "བར", "བོ", "མཁའི", "དགའི", "ཎི", "རྒྱལ", "x")] == ["པ", "པ", "པར", "པོ", "མཁའ", "དགའ", "ནི", "རྒྱལ", "x"]
    same = [("བྱམས", "འབྱམས"[1:]), ("ཀྲ", "སྐྲ"), ("ལྷག", "ལྷགས"), ("གཡག", "ཡག"), ("ཤེས", "ཤེ"), ("དབང", "ཝང")]
    assert all(T.phonetic(a) == T.phonetic(b) for a, b in same)
    assert T.phonetic("ཀ") != T.phonetic("ཁ") and T.phonetic("ག") != T.phonetic("སྒ") and T.phonetic("hello") == "hello"


ABC = A.Analyzer(r"\w+", str.lower, frozenset({"of", "the"}), ((("united", "states"), ("usa",), ("us", "of", "a")),))
PLAIN = A.Analyzer(r"\w+", str.lower, frozenset({"of", "the"}))
GROUPS = [[("new", "york"), ("nyc",), ("big", "fine", "apple")], [("car",), ("motor", "car")]]


def spelled(analyzer, text):
    """All strings that paths of a text's graph spell, with the span each stands for, by walking from every node."""
    edges, out = A.Graphs(analyzer).edges(text), set()
    by = {}
    for e in edges:
        by.setdefault(e[0], []).append(e)

    def walk(node, tokens, begin, end):
        if tokens:
            out.add((tuple(tokens), begin, end))
        if len(tokens) < 5:
            for _, after, _, token, b, e in by.get(node, []):
                walk(after, [*tokens, token], b if begin is None else min(begin, b), e if end is None else max(end, e))

    for node in list(by):
        walk(node, [], None, None)
    return out


def test_graphs_of_synonyms():
    a = PLAIN.with_synonyms(*GROUPS)
    edges = A.Graphs(a).edges("In New York now")
    assert edges[0] == (0, 1, 0, "in", 0, 2) and (1, 5, 1, "nyc", 3, 11) in edges and edges[-1] == (5, 6, 3, "now", 12, 15)
    strings = {s for s, _, _ in spelled(a, "In New York now")}
    assert {("in", "new", "york", "now"), ("in", "nyc", "now"), ("in", "big", "fine", "apple", "now")} <= strings and ("in", "york") not in strings and ("new", "nyc") not in strings
    tokens, spans = A.Graphs(ABC).words("The State")
    assert tokens == ["", "state"] and spans.tolist() == [[0, 3], [4, 9]]
    with pytest.raises(ValueError, match="synonym"):
        A.Graphs(PLAIN.with_synonyms([(), ("x",)]))


def found(spark, analyzer, texts, phrases, slop=0):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    asked = spark.createDataFrame([(q, slop, p) for q, p in enumerate(phrases)], "q int, slop int, phrase string")
    posts = A.graph_postings(df, ["id"], "t", analyzer)
    table = A.graph_phrases(asked, "phrase", analyzer)
    hits = A.graph_hits(posts, table, ["q"], ["id"])
    assert sorted(map(str, hits.collect())) == sorted(map(str, A.text_hits(df, ["id"], "t", analyzer, table, ["q"]).collect()))
    return {(r.q, r.id): [tuple(s) for s in r.spans] for r in hits.collect()}


def test_phrases_are_paths(spark):
    rng = random.Random(2)
    words = ["new", "york", "nyc", "big", "fine", "apple", "car", "motor", "of", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [""]
    phrases = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    a = PLAIN.with_synonyms(*GROUPS)
    want = {}
    for q, phrase in enumerate(phrases):
        tokens = A.Graphs(PLAIN).words(phrase)[0]
        while tokens and tokens[0] == "":
            tokens.pop(0)
        while tokens and tokens[-1] == "":
            tokens.pop()
        for i, text in enumerate(texts):
            spans = sorted({(b, e) for s, b, e in spelled(a, text) if s == tuple(tokens)})
            if spans:
                want[q, i] = spans
    assert found(spark, a, texts, phrases) == want and len(want) > 300


def test_slop(spark):
    texts = ["a b c d", "a b x c", "a b x y c", "c b", "b", "b b"]
    hits = found(spark, "words", texts, ["b c", "b b"], 1)
    assert hits == {(0, 0): [(2, 5)], (0, 1): [(2, 7)], (1, 5): [(0, 3)]}
    assert set(found(spark, "words", texts, ["b c"], 2)) == {(0, 0), (0, 1), (0, 2), (0, 3)}


def test_lenient_and_phonetic_readings(spark):
    texts = ["རྒྱལ་བའི་བསྟན", "རྒྱལ་པ་བསྟན", "གྱལ་བ་སྟན"]
    assert set(found(spark, "lenient", texts, ["རྒྱལ་པ་བསྟན"])) == {(0, 0), (0, 1)}
    assert set(found(spark, "phonetic", texts, ["བརྒྱལ་པས་སྟན"])) == {(0, i) for i, t in enumerate(texts) if [T.phonetic(s) for s in t.split("་")] == [T.phonetic(s) for s in "བརྒྱལ་པས་སྟན".split("་")]}
    assert found(spark, "exact", ["ཀ།ཁ"], ["ཀ།ཁ", "ཀཁ"]) == {(0, 0): [(0, 3)]}


def test_marks_and_fragments():
    assert A.marked("one two three", [(4, 7)]) == "one <em>two</em> three"
    assert A.marked("one two three", [(0, 7), (4, 13)]) == "<em>one two three</em>" and A.marked("x", []) == "x"
    text = "aa " * 20 + "KEY " + "bb " * 40 + "KEY KEY " + "cc " * 20
    spans = [(m, m + 3) for m in range(len(text)) if text.startswith("KEY", m)]
    shown = A.marked(text, spans, 20)
    assert shown.count("<em>") == 2 and len(shown) == 20 + 2 * len("<em></em>")
    assert A.marked("short KEY", [(6, 9)], 100) == "short <em>KEY</em>" and A.marked("x KEYKEYKEY y", [(2, 11)], 4) == "<em>KEYKEYKEY</em>"


def test_highlights_mark_synonyms(spark):
    df = spark.createDataFrame([(1, "from New York, by car"), (2, "NYC"), (3, None)], "id int, t string")
    asked = spark.createDataFrame([(0, "a", 0, "nyc"), (0, "b", 0, "motor car")], "q int, part string, slop int, phrase string")
    a = PLAIN.with_synonyms(*GROUPS)
    hits = A.graph_hits(A.graph_postings(df, ["id"], "t", a), A.graph_phrases(asked, "phrase", a), ["q", "part"], ["id"])
    assert {r.id: r.highlight for r in A.highlights(hits, df, ["id"], "t", ["q"]).collect()} == {1: "from <em>New York</em>, by <em>car</em>", 2: "<em>NYC</em>"}


@pytest.fixture(scope="module")
def blocks(spark):
    segments = "segments array<struct<title_bo: array<string>, author_name_bo: string>>"
    rows = [("W1", [(["red small", "ring"], "ann"), (["red ring"], None)]), ("W2", [(None, "red small ring")]), ("W3", None), ("W4", [])]
    return spark.createDataFrame(rows, f"id string, {segments}")


def ask(spark, phrase, slop=0):
    return A.graph_phrases(spark.createDataFrame([(0, slop, phrase)], "q int, slop int, phrase string"))


def test_phrases_do_not_cross_elements_or_values(spark, blocks):
    texts = N.block_texts(blocks, "id", ["title_bo", "author_name_bo"], nested="segments")
    posts = N.block_postings(texts, {"": "words"})
    hits = N.element_hits(posts, ask(spark, "small ring"), ["q"])
    assert [(r.parent, r.element, r.field) for r in hits.collect()] == [("W2", 0, "segments.author_name_bo")]
    hits = N.element_hits(posts, ask(spark, "red"), ["q"], {"segments.author_name_bo": 0.5})
    scores = {(r.parent, r.element): r.score for r in hits.collect()}
    assert {(r.parent, r.element): r.score for r in N.search_elements(texts, "words", ask(spark, "red"), ["q"], {"segments.author_name_bo": 0.5}).collect()} == pytest.approx(scores)
    best = {r.parent: r.score for r in N.parents_of(hits, ["q"]).collect()}
    assert best == {"W1": max(scores["W1", 0], scores["W1", 1]), "W2": scores["W2", 0]} and len(scores) == 3
    assert {r.score for r in N.parents_of(hits, ["q"], "none").collect()} == {1.0}
    with pytest.raises(ValueError, match="mode"):
        N.parents_of(hits, ["q"], "sum")
    inner = N.fragments(N.inner_hits(hits, ["q"], size=1), texts, ["q"])
    assert sorted((r.parent, r.element, r.rank, r.highlight) for r in inner.collect()) == [("W1", 0, 1, "<em>red</em> small"), ("W2", 0, 1, "<em>red</em> small ring")]


def test_children_and_their_chunks(spark):
    kids = spark.createDataFrame([(f"E{i}", "P1" if i < 5 else "P2", [(f"x{k} a b" if (i + k) % 2 else "a x b",) for k in range(6)]) for i in range(7)], "id string, parent string, chunks array<struct<text_bo: string>>")
    posts = N.block_postings(N.block_texts(kids, "parent", ["text_bo"], nested="chunks", child="id"), {"": "words"})
    hits = N.element_hits(posts, ask(spark, "a b"), ["q"])
    assert {(r.parent, r.score) for r in N.parents_of(hits, ["q"], "none").collect()} == {("P1", 1.0), ("P2", 1.0)}
    inner = N.inner_hits(hits, ["q"], size=2, child_size=3, mode="none")
    want = {(p, f"E{i}", k) for p, ids in (("P1", range(3)), ("P2", range(5, 7))) for i in ids for k in [k for k in range(6) if (i + k) % 2][:2]}
    assert {(r.parent, r.child, r.element) for r in inner.collect()} == want


def test_ranks_are_bounded_before_they_meet(spark, blocks):
    posts = N.block_postings(N.block_texts(blocks, "id", ["title_bo"], nested="segments"), {"": "words"})
    hits = N.element_hits(posts, ask(spark, "red"), ["q"])
    plan = N.inner_hits(hits, ["q"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_volume_search(spark):
    records = spark.createDataFrame(
        [("I1", "རྒྱལ་བ", ["བླ་མ"], [(["བཀྲ་ཤིས"], ["བླ་མ"])]), ("I2", "བདེ་ལེགས", None, [([], [])]), ("I3", None, [], None)],
        "id string, pref_label_bo string, alt_label_bo array<string>, segments array<struct<title_bo: array<string>, author_name_bo: array<string>>>",
    )
    etexts = spark.createDataFrame([("E1", "I3", [("ཀ་བཀྲ་ཤིས་ཁ",), ("ག",)])], "id string, parent string, chunks array<struct<text_bo: string>>")
    best, inner = N.volume_search(spark, records, etexts, "བཀྲ་ཤིས")
    assert {r.id for r in best.collect()} == {"I1", "I3"}
    assert {(r.parent, r.child, r.element, r.highlight) for r in inner.collect()} == {("I1", None, 0, "<em>བཀྲ་ཤིས</em>"), ("I3", "E1", 0, "ཀ་<em>བཀྲ་ཤིས</em>་ཁ")}
    assert [r.id for r in N.volume_search(spark, records, etexts, "རྒྱལ་པའི")[0].collect()] == ["I1"]
    assert [(r.id, r.score) for r in N.volume_search(spark, records, etexts, " ", 2)[0].collect()] == [("I1", 0.0), ("I2", 0.0)]
