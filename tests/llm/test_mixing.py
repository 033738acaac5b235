import pytest

from leafmill.llm.mixing import mix, mixture


def water(sizes, weights, share, most):
    """Targets by dealing the excess again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        total = sum(w[s] for s in rest)
        level = (left - sum(capped.values())) / total if rest else 0
        over = [s for s in rest if level * w[s] > most * sizes[s]]
        if not over:
            return capped | {s: level * w[s] for s in rest}
        capped |= {s: most * sizes[s] for s in over}


def test_targets_and_taken(make):
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 5}" if i % 11 else None) for i in range(600)]
    found = mix(make(rows)).collect()
    sizes = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    goal = water(sizes, (5, 2, 1), 1.5, 2.0)
    for source, total in goal.items():
        own = [r for r in found if r.source == source]
        assert own[0].target == pytest.approx(total) and own[0].source_size == sizes[source]
        assert abs(sum(r.taken for r in own) - total) <= 40
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mix(make(rows)).collect()), key=str)


def test_one_document_and_equal_rows_meet_their_target(make):
    found = mix(make([(1, "a " * 1000, "a"), (2, "b " * 10, "b"), *[(3, "c " * 50, "c")] * 20])).collect()
    goal = {r.source: r.target for r in found}
    for s in goal:
        assert abs(sum(r.taken for r in found if r.source == s) - goal[s]) <= 20


def test_odd_rows(odd, none):
    found = {(r.doc_id, r.source): r for r in mix(odd).collect()}
    assert found[(1, "s")].size == 0 and found[(1, "s")].taken == 0
    assert mix(odd).count() == 9 and mix(none).count() == 0 and mixture(none).count() == 0
    assert mixture(odd).columns == odd.columns
    assert mixture(odd).where("text is null or trim(text) = ''").count() == 0


def test_all_texts_empty(make):
    assert [r.taken for r in mix(make([(1, ""), (2, None)])).collect()] == [0, 0]
