"""Divergence of sources against a plain count over all terms."""

import re
from collections import Counter, defaultdict

import pytest

from quaytally.llm.divergence import divergence, share, terms_of

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, least):
    groups, known = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang or "", source or ""].update(terms)
        known[lang or ""].update(set(terms))
    out = []
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in known[lang].items() if n >= least]
        own = {s: c for (g, s), c in groups.items() if g == lang}
        whole = sum(own.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept} for s, c in own.items()}
        q = {t: 1 + 10**9 * (whole[t] + 2) // (sum(whole[x] for x in kept) + 2 * len(kept)) for t in kept}
        for s in own:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, apart(p[s][t], q[t])) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ranked[:most])]
    return sorted(out)


def found(docs, **how):
    return sorted(tuple(r) for r in divergence(docs, **how).select(*COLUMNS).collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int")


WORDS = "The cat sat on a mat With Élan über 漢字 don't x1y the-cat".split()


def made(n=60, sources=5):
    rows = []
    for i in range(n):
        k = i * 7 + i // 3
        rows.append((" ".join(WORDS[(k * j + j) % len(WORDS)] for j in range(i % 13)), "en" if i % 3 else "fr", f"s{i % sources}"))
    return rows


@pytest.mark.parametrize("cells_a_block", [1, 7, 1 << 16])
def test_rows_equal_a_plain_count(spark, cells_a_block):
    rows = made()
    assert found(frame(spark, rows), least=3, cells_a_block=cells_a_block) == plain(rows, 3)


def test_hard_rows(spark):
    rows = [(None, None, None), ("", "", "b"), (None, "en", "a"), ("tie tie", "en", "a"), ("tie", "en", None), ("tie eit", "en", "z"), ("eit", "en", "z"), ("eit", "en", "z"), ("only here", "de", "q"), ("w " * 70_000 + "tie", "en", "long"), ("tie", "en", "a"), ("tie", "en", "a")]
    assert found(frame(spark, rows), least=2) == plain(rows, 2)
    assert found(frame(spark, rows), least=99) == plain(rows, 99)  # no term is kept: pairs are 0


def test_one_source_holds_most_rows_and_one_term_is_everywhere(spark):
    rows = [("common rare%s" % "abc"[i % 3], "en", "hot" if i % 3 else f"s{i % 17}") for i in range(400)]
    assert found(frame(spark, rows), least=10, cells_a_block=4) == plain(rows, 10)


def test_an_empty_table_gives_no_rows(spark):
    assert found(frame(spark, [("a", "en", "x")]).limit(0)) == []


def test_shares_are_exact_for_large_counts():
    import numpy as np

    for count, total in ((0, 7), (10**12, 3 * 10**12 + 1), (10**15 - 3, 10**15), (5, 9)):
        assert share(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 2) // total


def test_terms_of_a_sliced_text_are_whole(monkeypatch):
    monkeypatch.setattr("quaytally.llm.divergence.SLICE", 5)
    text = "abcdefgh ij Klmnop9qr漢字st u".encode()
    assert [t for part in terms_of(text) for t in part] == [w.encode() for w in "abcdefgh ij klmnop qr漢字st u".split()]
