import random
import re
import time
from functools import cache
from math import isclose, log10

from leafmill.llm.secret_scan import GUESS_WORDS, KEY_ROWS, KINDS, corpus_ranks, guess_cost, scan, secret_scan


def spans(text):
    return [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in scan(text, 10.0)]


def test_base_patterns():
    text = 'é token = "abcdefgh" Password: short AKIA' + "A" * 12 + " AKIAshort " + "0a" * 16 + " API_KEY=\"x/y+z==12\" passwd=passwd=12345678"
    base = []
    for kind, pattern, ok in (("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32)):
        base += [(m.start(), KINDS.index(kind), m.end()) for m in re.finditer(pattern, text) if ok(m)]
    assert [x for x in spans(text) if not x.startswith("guess")] == [f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(base)]
    assert len(base) == 5


def test_costs():
    assert guess_cost("") == 0
    assert guess_cost("password") < 2 and guess_cost("P@ssw0rd") < 4
    assert guess_cost("qwertyuiop") < 5 and guess_cost("aaaaaaaaaaaaaaaa") < 5 and guess_cost("1999-12-31") < 6
    assert guess_cost("monkey1999dragon") < 9
    assert guess_cost("x9$Lq2!vZp7&Rt") > 14
    assert guess_cost("k" + "w8" * 5000) > 1000


def test_method_adds_spans_beside_the_base():
    assert spans("passphrase: x9$Lq2!vZp7") == ["guess:12:23"]
    assert spans("passphrase: password1999") == []
    assert spans('secret = "abcdefghijklm"') == ["assign:0:23"]


def test_odd_rows(spark, odd, none):
    assert {len(r.spans) for r in secret_scan(odd).collect()} == {0} and secret_scan(odd).count() == 9
    assert secret_scan(none).count() == 0


def piece_costs(piece, ranks):
    """What a piece costs by each kind of piece that it can be, told from the piece alone."""
    two, low = log10(2), piece.lower()
    if len(piece) == 1:
        yield log10(10 if piece.isdigit() else 26 if piece.isalpha() and piece.isascii() else 33)
    if len(piece) >= 3:
        if len(set(low)) == 1:
            yield log10(40 * len(piece)) + two
        place = {c: (i, k) for i, row in enumerate(KEY_ROWS) for k, c in enumerate(row)}
        if all(a in place and b in place and abs(place[a][0] - place[b][0]) + abs(place[a][1] - place[b][1]) == 1 for a, b in zip(low, low[1:])):
            yield log10(47 * 4 * len(piece)) + two
    plain = low.translate(str.maketrans("@430!$57", "aaeoiss" + "t"))
    extra = ((piece != low) + sum(a != b for a, b in zip(low, plain))) * two + two
    if plain in ranks:
        yield log10(ranks[plain] + 1) + extra
    if plain[::-1] in ranks:
        yield log10(2 * (ranks[plain[::-1]] + 1)) + extra
    if re.fullmatch(r"(19|20)\d\d", piece):
        yield log10(36600) + two
    for order in ((slice(0, 4), 4, 6), (slice(-4, None), 2, 0)):
        for sep in ("", "-", "/", "."):
            digits = piece.replace(sep, "") if sep else piece
            if len(digits) == 8 and digits.isdigit() and digits[order[0]][:2] in ("19", "20"):
                year, month, day = digits[order[0]], digits[order[1] :][:2], digits[order[2] :][:2]
                shown = sep.join((year, month, day) if order[1] == 4 else (day, month, year))
                if shown == piece and "01" <= month <= "12" and "01" <= day <= "31":
                    yield log10(36600) + two


def cheapest(value, ranks):
    @cache
    def rest(i):
        return 0.0 if i == len(value) else min(c + rest(j) for j in range(i + 1, len(value) + 1) for c in piece_costs(value[i:j], ranks))

    return rest(0)


def test_against_all_segmentations():
    ranks = {w: i + 1 for i, w in reversed(list(enumerate(GUESS_WORDS)))}
    dice = random.Random(3)
    parts = ["password", "drowssap", "P@ssw0rd", "monkey", "Dragon", "qwerty", "zxcvb", "aaaa", "tttttttt", "1234", "1999-12-31", "31.12.1999", "20240229", "2019", "19991", "x", "$", "Q7", "0ne", "asdfghjkl", "rewq", "the", "eht"]
    for _ in range(400):
        value = "".join(dice.choice(parts) for _ in range(dice.randint(1, 4)))[dice.randint(0, 2) :]
        if value:
            assert isclose(guess_cost(value, ranks), cheapest(value, ranks)), value


def test_words_of_the_corpus(spark, make):
    docs = make([(1, "the elephant saw butterfly butterfly garden elephant"), (2, "garden elephant passphrase: vqxjzkwpbm and vqxjzkwpbmx"), (3, None), (4, "pwd = elephantgarden!")])
    ranks = corpus_ranks(docs)
    assert ranks["elephant"] < ranks["butterfly"] < ranks["garden"] and "vqxjzkwpbm" not in ranks and "vqxjzkwpbmx" in ranks and "elephantgarden" not in ranks
    none = corpus_ranks(docs, 0)
    assert corpus_ranks(docs, 1) == none | {"elephant": len(none) + 1} == corpus_ranks(docs, 2)  # the next two are equally common
    assert set(corpus_ranks(docs, 3)) - set(none) == {"elephant", "butterfly", "garden"}
    found = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in secret_scan(docs).collect()}
    assert found == {1: [], 2: [("guess", 28)], 3: [], 4: []}


def test_costs_of_base_spans():
    (first, second) = scan("token = password1 token = x9Lq2vZp7RtK", 10.0)
    assert first[3] < 3.5 and second[3] > 10


def test_long_texts_take_time_in_proportion():
    began = time.time()
    assert len(scan("token=abcdefgh pwd: x9$Lq2!vZp7 " * 5000, 10.0)) == 10_000
    assert time.time() - began < 20
