import itertools
import random
import random

import numpy as np
import pytest

from cases import components, corpus, shingles, table, thue_morse


@pytest.mark.parametrize("floors", [(64, 100_000), (2, 4)])
def test_ngram_join(spark, monkeypatch, floors):
    from tributary.llm import ngram_join

    texts = corpus(1, 90)
    if floors != ngram_join.CLASS_FLOORS:  # classes 2 and 3 in use, within this process
        monkeypatch.setattr(ngram_join, "CLASS_FLOORS", floors)
        keys = ngram_join.draw_keys(b"test")
        sets = {i: next(ngram_join.document_sets(*ngram_join.one_text(t), keys)) for i, t in texts}
        found, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        frequent = ngram_join.Frequent(found, times, floors)
        signed = {i: dict(zip(*(x.tolist() for x in ngram_join.signatures(s, frequent, keys)), strict=True)) for i, s in sets.items()}
        exact = {i: shingles(t) for i, t in texts}
        for a, b in itertools.combinations(exact, 2):
            n, m, k = len(exact[a]), len(exact[b]), len(exact[a] & exact[b])
            if k and 100 * k >= 75 * (n + m - k) and exact[a] != exact[b]:
                o = -(-75 * (n + m) // 175)
                assert any(signed[a][s] <= n - o and signed[b][s] <= m - o for s in signed[a].keys() & signed[b].keys())
        return
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_similar(table(spark, texts, extra=True)).collect()}
    assert found == components(texts)
    kept = ngram_join.keep_one(table(spark, [*texts, texts[0]]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in components(texts).values()})
    assert ngram_join.keep_one(table(spark, [])).count() == 0


def test_words_that_collide_modulo_a_power_of_two(spark):
    from tributary.llm import ngram_join

    texts = [(i, t) for i, t in enumerate(x for n in (1024, 2048, 4096) for x in (thue_morse(n), thue_morse(n, True)))]
    texts += [(10, f"{texts[0][1]} one two three four five"), (11, f"{texts[1][1]} one two three four five")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_similar(table(spark, texts)).collect()}
    assert found == components(texts)


def test_rows_without_id_link(spark):
    from tributary.llm import ngram_join

    words = [f"w{i}" for i in range(200)]
    left, middle, right = words[:100], words[12:112], words[24:124]  # the outer ones are linked by the middle one only
    rows = [(1, left), (None, middle), (9, right), (None, words[140:200]), (None, words[141:200]), (5, ["alone", *words[130:139]]), (None, []), (None, [])]
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_similar(table(spark, [(i, " ".join(t)) for i, t in rows])).collect()]
    near = lambda x, y: len({*x} & {*y})
    assert near(left, right) < near(left, middle)
    assert sorted(found, key=str) == sorted([(1, 96, 1), (None, 96, 1), (9, 96, 1), (None, 56, None), (None, 55, None), (5, 6, 5), (None, 0, None), (None, 0, None)], key=str)
    kept = ngram_join.keep_one(table(spark, [(i, " ".join(t)) for i, t in rows]))
    assert sorted((str(r.doc_id), len((r.text or "").split())) for r in kept.collect() if r.text) in ([("1", 100), ("5", 10), ("None", 59)], [("1", 100), ("5", 10), ("None", 60)])
    assert kept.where("doc_id is null and text = ''").count() == 2


def test_one_id_with_several_texts(spark):
    from tributary.llm import ngram_join

    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    kept = ngram_join.keep_one(table(spark, [(1, a), (1, b), (2, a + " more"), (1, a)]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (1, b)]
    small = table(spark, [(1, a), (2, a)]).selectExpr("cast(doc_id as smallint) doc_id", "text")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.join_similar(small).collect()) == [(1, 1), (2, 1)]


def test_sets_that_share_half_a_digest(spark):
    from tributary.llm import ngram_join

    texts = corpus(8, 40)
    assert ngram_join.node_of(np.arange(3, dtype=np.uint64), frozenset([ngram_join.set_hash(np.arange(3, dtype=np.uint64))[0]])) == ngram_join.set_hash(np.arange(3, dtype=np.uint64))[::-1]
    keys = ngram_join.draw_keys(b"x")
    plain = ngram_join.set_rows(table(spark, texts), keys).where("doc").select("text_key", "node", "other")
    some = {r.text_key: r for r in plain.collect()}
    clash = next(r.node for r in some.values() if r.node)
    again = ngram_join.set_rows(table(spark, texts), keys, frozenset([clash])).where("doc").select("text_key", "node", "other").collect()
    assert all((r.node, r.other) == ((some[r.text_key].other, clash) if some[r.text_key].node == clash else (some[r.text_key].node, some[r.text_key].other)) for r in again)


def template_pages(n, own=15, shared=85):
    r = random.Random(n)
    base = [f"site{i}" for i in range(shared)]
    return [(i, " ".join([*base, *(f"p{i}x{r.random()}" for _ in range(own))])) for i in range(n)]


def test_pages_of_one_template_cost_no_comparisons(spark, monkeypatch):
    """Pages that share a template but not three quarters of their shingles leave every list before anything is compared."""
    from tributary.llm import ngram_join

    monkeypatch.setattr(ngram_join, "HEAVY", 16)
    sizes = []

    def counted(*a, plain=ngram_join._open):
        members = plain(*a)
        sizes.append(members.count())
        return members

    monkeypatch.setattr(ngram_join, "_open", counted)
    done = ngram_join.join_similar(table(spark, template_pages(600)))
    assert done.where("doc_id <> component_id").count() == 0 and sizes == [0] * (ngram_join.STAR_ROUNDS + 1)


@pytest.mark.parametrize("heavy", [2, 64])
def test_templates_against_brute_force(spark, monkeypatch, heavy):
    """Templates around the threshold: pages of unlike sizes that link, by way of the last comparison too."""
    from tributary.llm import ngram_join

    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0 if heavy == 2 else 1)
    texts = [(100 * k + i, t) for k, own in enumerate((2, 6, 9, 12, 14)) for i, t in template_pages(12, own)]
    r = random.Random(5)
    base = [f"z{i}" for i in range(60)]
    texts += [(900 + i, " ".join(base[: (c := r.randrange(20, 60))] + [f"y{i}{j}" for j in range(r.randrange(8))] + base[c : c + r.randrange(30)])) for i in range(40)]
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join_similar(table(spark, texts)).collect()}
    assert found == components(texts)


def test_repeated_values():
    from tributary.llm.ngram_join import repeated

    for size, values in ((0, 1), (1, 1), (2, 1), (50, 1), (500, 40), (500, 10_000)):
        x = np.random.default_rng(size).integers(0, values, size).astype(np.uint64)
        found, times = np.unique(x, return_counts=True)
        got, counted = repeated(x.copy())
        assert got.tolist() == found[times > 1].tolist() and counted.tolist() == times[times > 1].tolist()
