import random

from leafmill.llm import ngram_join as N


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def run(docs, *args):
    return sorted(map(tuple, N.ngram_join(docs, *args).collect()), key=str)


def near_copies(seed, size, edits, count):
    rng = random.Random(seed)
    rows = []
    for family in range(4):
        base = [f"w{rng.randrange(2000)}" for _ in range(size)]
        for _ in range(count):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = [f"e{rng.randrange(99)}"] * rng.choice([0, 1])
            rows.append((len(rows), " ".join(w)))
    passage = " ".join(f"q{k}" for k in range(40))
    rows += [(len(rows) + k, f"own{k} " + passage + f" end{k} " + " ".join(f"t{rng.randrange(3000)}" for _ in range(60))) for k in range(25)]
    return rows


def test_equals_brute_force(make):
    rows = near_copies(1, 120, 8, 12)
    assert run(make(rows), 4, 85, 100) == brute(rows, 4, 85, 100)


def test_long_lists_and_runs(make, monkeypatch):
    monkeypatch.setattr(N, "LONG_LIST", 2)
    for seed, args in ((3, (5, 80, 100)), (4, (2, 60, 100))):
        rows = near_copies(seed, 90, 6, 14)
        assert run(make(rows), *args) == brute(rows, *args)


def test_small_sets(make, monkeypatch):
    monkeypatch.setattr(N, "LONG_LIST", 1)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(80)]
    assert run(make(rows), 4, 85, 100) == brute(rows, 4, 85, 100)
    assert run(make(rows), 1, 50, 100) == brute(rows, 1, 50, 100)


def test_chains_of_links_and_case(make):
    w = [f"w{k}" for k in range(60)]
    rows = [(9 - s, " ".join(w[s : s + 50]).upper() if s % 2 else " ".join(w[s : s + 50])) for s in range(0, 10, 2)]
    rows += [(20 + s, " ".join(w[s : s + 50]).upper()) for s in range(1, 10, 2)]
    assert run(make(rows), 4, 85, 100) == brute(rows, 4, 85, 100)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert run(odd, 4, 85, 100) == brute(rows, 4, 85, 100)
    assert N.ngram_join(none).count() == 0


def test_links_equal_brute_force(make):
    rows = near_copies(4, 60, 1, 12)
    rows = [*rows, (9001, rows[0][1]), (9002, None), (9003, "")]
    links, members = N.ngram_links(make(rows))
    of = {}
    for r in members.collect():
        of.setdefault(r.node, []).append(r.doc_id)
    pairs = links.collect()
    assert len({(r.a, r.b) for r in pairs}) == len(pairs) and all(r.a < r.b for r in pairs)
    found = {frozenset((x, y)) for r in pairs for x in of[r.a] for y in of[r.b]} | {frozenset((x, y)) for ids in of.values() for x in ids for y in ids if x < y}
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    want = {frozenset((i, j)) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert found == want and len(want) > len(rows)  # more than what joins the components


def test_clashing_numbers_and_low_similarities(make, monkeypatch):
    rows = near_copies(7, 60, 6, 9)
    monkeypatch.setattr(N, "LONG_LIST", 3)
    assert run(make(rows), 4, 70, 100) == brute(rows, 4, 70, 100)
    monkeypatch.setattr(N, "number_of", lambda key: key[0] >> 4)
    assert run(make(rows), 4, 85, 100) == brute(rows, 4, 85, 100)


def test_blocks_of_a_list_of_near_misses(make, monkeypatch):
    monkeypatch.setattr(N, "LONG_LIST", 2)
    monkeypatch.setattr(N, "BLOCK", 5)
    monkeypatch.setattr(N, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(N, "PAIR_LIST", 2)
    monkeypatch.setattr(N, "BLOCK_TOKENS", 2000)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(30):  # most pairs are just under or just over the bound
        w = list(base)
        for _ in range(8):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    for homes in (0, 1):
        monkeypatch.setattr(N, "HOME_ROUNDS", homes)
        found = run(make(rows), 4, 85, 100)
        assert found == brute(rows, 4, 85, 100)
        assert len({c for _, _, c in found}) > 1


def test_near_misses_are_not_written_as_pairs(make, monkeypatch):
    """Near misses of one list number the square of its nodes; what tasks yield for them does not."""
    monkeypatch.setattr(N, "LONG_LIST", 2)
    monkeypatch.setattr(N, "PAIR_LIST", 2)
    monkeypatch.setattr(N, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(N, "HOME_ROUNDS", 0)
    counts = []
    for name in ("close_pairs", "joining_links"):

        def counted(*args, whole=getattr(N, name)):
            out = N.staged(whole(*args), "counted")
            counts.append(out.count())
            return out

        monkeypatch.setattr(N, name, counted)
    rng = random.Random(9)
    rows = []
    for k in range(50):
        w = [f"w{i}" for i in range(397)]
        for at in rng.sample(range(1, 99), 4):  # without a place in common, 362 of 426 shingles are
            w[4 * at] = f"e{k}_{at}"
        rows.append((k, " ".join(w)))
    assert run(make(rows), 4, 85, 100) == brute(rows, 4, 85, 100)
    assert counts and sum(counts) < 5 * len(rows)


def test_bitmaps_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for size, own in ((40, 3), (900, 200), (5000, 40)):
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        other = np.unique(np.concatenate([base[own:], rng.integers(0, 2**63, 2 * own, dtype=np.uint64)]))
        differ = len(np.setxor1d(base, other))
        assert 0 < N.apart(N.bitmap(base), N.bitmap(other)) <= differ
        assert N.apart(N.bitmap(base), N.bitmap(base)) == 0


def test_words_of_many_texts_are_hashed_at_once(monkeypatch):
    import numpy as np

    from leafmill.llm import hashing as H

    odd = [None, "", " ", "a", "A b", "x" * 63, "x" * 64, "y" * 65, "\u00e9" * 40 + " \u00c9A\x0bb\x1cc", " lead trail ", "a\nb\tc\rd\x0ce f", "\ud800 q", "aa a aaa", "12345678 123456789 1234567", "\x00 \x00\x00 a\x00"]
    calls, one = [], H.xxhash.xxh64_intdigest
    monkeypatch.setattr(H.xxhash, "xxh64_intdigest", lambda w: calls.append(w) or one(w))
    known = {}
    for texts in (odd, odd[::-1], [], [""]):
        ids, at = H.word_hashes(texts)
        words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        assert np.diff(at).tolist() == [len(w) for w in words]
        assert all(known.setdefault(w, h) == h for w, h in zip((w for own in words for w in own), ids.tolist()))
    assert len(set(known.values())) == len(known)
    assert {len(w) > 64 for w in calls} == {True}  # only long words are hashed one by one
    w = "a B c a b C a b".split()
    assert [len(s) for s in N.token_sets([" ".join(w), None, "one", "one TWO", "one two"], 3)] == [3, 0, 1, 1, 1]
    sets = N.token_sets(["one TWO", "one two", "a b c d"], 3)
    assert sets[0].tolist() == sets[1].tolist() and sets[2].tolist() == sorted(set(sets[2].tolist()))


def test_small_tables_of_the_contraction_are_few_files(spark, monkeypatch):
    wrote, staged = [], N.staged
    monkeypatch.setattr(N, "staged", lambda df, label: wrote.append((label, df.rdd.getNumPartitions())) or staged(df, label))
    monkeypatch.setattr(N, "TASK_ROWS", 40)
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100 + k, 200 + k) for k in range(20)], "a long, b long")
    names = {"spark.sql.shuffle.partitions": "11", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        found = {r.node: r.comp for r in N.contracted(None, links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {k: 0 for k in range(31)} | {100 + k: 100 + k for k in range(20)} | {200 + k: 100 + k for k in range(20)}
    assert {label for label, _ in wrote} == {"labels", "edges", "hooks"} and max(n for _, n in wrote) <= 3
