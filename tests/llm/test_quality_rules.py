import random
import re

from leafmill.llm.quality_rules import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {k for at in windows.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def check(docs, texts):
    found = quality_rules(docs).collect()
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert got == sorted(map(base, texts))
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    return found


def test_base_equals_brute_force(make):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a ", "b ", "the ", "É# ", "x|y\n", "\n", "\t", "q", "12 "]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    check(make([(i, t) for i, t in enumerate(texts)]), texts)


def test_odd_rows(odd, none):
    check(odd, [r.text for r in odd.collect()])
    assert quality_rules(none).count() == 0


def test_distance_rejects_other_distributions(make):
    rng = random.Random(2)
    plain = [" ".join(rng.choice("the of and to in house tree river over green".split()) + rng.choice(["", "", ",", "."]) for _ in range(150)) for _ in range(50)]
    shout = " ".join(rng.choice(["THE!!", "RIVER!!", "TREE!!"]) + "%%%" + str(rng.random()) for _ in range(150))
    found = {r.doc_id: r for r in quality_rules(make([(i, t) for i, t in enumerate([*plain, shout])])).collect()}
    assert not found[50].kept and found[50].char_distance > 0.3162
    assert sum(found[i].kept or found[i].base_failed for i in range(50)) == 50


def test_no_common_word_is_the_largest_distance(make):
    plain = [" ".join(f"the house{k}{j} of tree{j}{k} and river{j}" for j in range(30)) for k in range(20)]
    strange = " ".join(f"hous{j} tre{j} rivr{j}" for j in range(50))
    rows = [*((k, t) for k, t in enumerate(plain)), (20, strange), (21, " ".join(strange.split()[:99])), (22, strange, "s", "xx"), (23, strange, "s", "de")]
    found = {r.doc_id: r for r in quality_rules(make(rows), max_char_distance=1.0).collect()}
    assert found[20].word_distance == 1.0 and not found[20].base_failed and not found[20].kept
    assert found[21].word_distance is None and found[21].kept  # under guard_words
    assert found[22].word_distance is None and found[22].kept  # no list of common words
    assert found[23].word_distance is None and found[23].kept  # the language's reference is empty
    assert all(found[k].kept and found[k].word_distance < 0.7071 for k in range(20))


def test_windows_with_colliding_hash_bits(make, monkeypatch):
    from leafmill.llm import quality_rules as Q

    # 39 bits of the windows' hashes are equal for these words
    check(make([(1, "w2043274 w2043274 w2043274 x1 w2627680 w2627680 w2627680 x2 w2043274 w2043274 w2043274")]), ["w2043274 w2043274 w2043274 x1 w2627680 w2627680 w2627680 x2 w2043274 w2043274 w2043274"])
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))) for _ in range(20)]
    for bits in (60, 5):  # three hash bits only; places for 32 windows only
        monkeypatch.setattr(Q, "INDEX_BITS", bits)
        check(make(list(enumerate(texts))), texts)
