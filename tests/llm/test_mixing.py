from cases import WORD, corpus, table


def test_mixing(spark):
    from tributary.llm import mixing

    texts = corpus(6, 200)
    df = table(spark, texts, extra=True)
    rows = mixing.allot(mixing.sized(df)).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in texts}
    assert {r.doc_id: r.size for r in rows} == size
    by = {}
    for r in rows:
        assert 0 <= r.copies <= 3
        by.setdefault(r.source, []).append(r)
    for found in by.values():
        taken, largest = sum(r.copies * r.size for r in found), max(r.size for r in found)
        assert abs(taken - found[0].target) <= 1.5 * largest
    mixed = [r.doc_id for r in mixing.mix(df).collect()]
    assert sorted(mixed) == sorted(i for r in rows for i in [r.doc_id] * r.copies)
    assert mixing.allot(mixing.sized(df.where("false"))).count() == 0


def test_mixing_of_null_and_repeated_ids(spark):
    from tributary.llm import mixing

    texts = [(i % 20 if i % 5 else None, f"one two three {i % 4}") for i in range(120)]
    rows = mixing.allot(mixing.sized(table(spark, texts, extra=True))).collect()
    assert len(rows) == len(texts) and all(0 <= r.copies <= 3 for r in rows)
    assert mixing.mix(table(spark, texts)).count() == sum(r.copies for r in rows)
