from pyspark.sql import functions as F

from leafmill.llm.line_dedup import line_dedup


def test_boilerplate_goes_by_site(make):
    rows = [(i, f"Share this page\nline {i}\n\nend {i}", "a") for i in range(20)] + [(100 + i, f"Share this page\nother {i}" if i == 0 else f"other {i}", "b") for i in range(20)]
    found = {r.doc_id: r for r in line_dedup(make(rows)).collect()}
    assert all(found[i].text == f"line {i}\n\nend {i}" and found[i].n_dropped == 1 and found[i].n_chars == len(found[i].text) for i in range(20))
    assert found[100].text == "Share this page\nother 0" and found[100].n_dropped == 0


def test_copies_do_not_make_boilerplate(make):
    rows = [(i, "same page\nsame end", "a") for i in range(30)] + [(100 + i, f"own {i}", "a") for i in range(30)]
    assert line_dedup(make(rows), copies_once=True).agg(F.sum("n_dropped")).first()[0] == 0
    assert line_dedup(make(rows)).agg(F.sum("n_dropped")).first()[0] == 60  # they are half of the site's pages


def test_small_sites(make):
    rows = [(1, "nav\nown", "one"), *((10 + i, f"nav\nown {i}", "four") for i in range(4)), (20, "x\nx", "twice")]
    found = {r.doc_id: r.text for r in line_dedup(make(rows)).collect()}
    assert found == {1: "nav\nown", 20: "x\nx", **{10 + i: f"own {i}" for i in range(4)}}


def test_odd_rows(odd, none):
    out = line_dedup(odd, copies_once=True)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (r.text for r in odd.collect())))
    assert line_dedup(none).count() == 0


def test_brute_force(make):
    import random

    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["nav", "foot", f"l{rng.randrange(60)}", ""]) for _ in range(rng.randint(1, 6))), f"s{i % 3}") for i in range(200)]
    for once in (False, True):
        pages = {}
        for i, t, s in rows:
            pages.setdefault(s, {})[t if once else i] = t
        counts = {s: [(x, sum(x in t.split("\n") for t in ts.values()), len(ts)) for x in {y for t in ts.values() for y in t.split("\n") if y}] for s, ts in pages.items()}
        drop = {(s, x) for s, found in counts.items() for x, n, total in found if n >= 2 and n / total > 0.1}
        want = {i: "\n".join(x for x in t.split("\n") if (s, x) not in drop) for i, t, s in rows}
        assert {r.doc_id: r.text for r in line_dedup(make(rows), copies_once=once).collect()} == want


def test_names_that_clash(make):
    names = ["_site", "_drop", "_all", "_left", "_own_site", "_row", "_line", "_text", "_key", "_l", "_site2", "pages", "site_pages", "ratio", "with.dot"]
    rows = [(i, f"nav\nown {i}", "a") for i in range(12)]
    docs = make(rows).withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in names})
    for once in (False, True):
        found = line_dedup(docs, copies_once=once).collect()
        assert len(found) == 12
        for r in found:
            assert r.text == f"own {r.doc_id}" and all(r[c] == f"{c} of {r.doc_id}" for c in names)
