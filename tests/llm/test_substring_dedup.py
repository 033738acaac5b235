import random

from leafmill.llm import substring_dedup as S


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    low = {}
    for i, w in words:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            low[key] = min(low.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if low[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def run(docs, window):
    return sorted(map(tuple, S.substring_dedup(docs, window).collect()), key=str)


def texts(seed):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for i in range(60):
        w = [rng.choice(["a", "b", "c", f"u{rng.randrange(500)}"]) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            s, e = sorted((rng.randrange(71), rng.randrange(71)))
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[s:e]
        if i % 7 == 0:
            w = ["r"] * 60 + w
        rows.append((i, " ".join(w)))
    return rows + [(70 + k, rows[k][1]) for k in range(10)]


def test_equals_brute_force(make):
    for seed, window in ((1, 50), (2, 12), (3, 3)):
        rows = texts(seed)
        assert run(make(rows), window) == brute(rows, window)


def test_hot_anchors_are_cut_into_windows(make, monkeypatch):
    monkeypatch.setattr(S, "HOT", 1)
    monkeypatch.setattr(S, "SHARD_WORDS", 100)
    rows = texts(4)
    assert run(make(rows), 12) == brute(rows, 12)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert run(odd, 50) == brute(rows, 50) and run(odd, 3) == brute(rows, 3)
    assert S.substring_dedup(none).count() == 0


def test_words_are_taken_unchanged(make):
    """Each function of batches makes what it remembers itself; words that differ in case are different ones."""
    rows = [(1, "One two three four"), (2, "x One two three"), (3, "one two three"), (4, "two three four y")]
    assert run(make(rows), 3) == brute(rows, 3) == [(1, 4, 0, rows[0][1]), (2, 4, 3, "x"), (3, 3, 0, rows[2][1]), (4, 4, 3, "y")]


def test_automaton():
    a = S.Automaton()
    a.add("abcbc", 5), a.add("xbcb", 3)
    a.close()
    assert list(a.least("abcbc", 2)) == [5, 3, 3, 3]
    assert list(a.least("zbcbcq", 3)) == [float("inf"), 3, 5, float("inf")]
