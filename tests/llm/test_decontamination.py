from cases import corpus, shingles, table


def test_decontamination(spark):
    from tributary.llm.decontaminate import drop_contaminated, search

    texts = corpus(3)
    items = [(0, texts[0][1]), (1, " ".join(f"q{i}" for i in range(20))), (2, None), (3, ""), (4, "w1 w2"), (5, " ".join(f"w{i}" for i in range(40)))]
    texts += [(500, "before " + " ".join(f"W{i}" for i in range(40)) + " after " * 300), (501, "W1 w2"), (502, " ".join(f"w{i}" if i != 20 else "zz" for i in range(40)))]
    df = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in texts for i, x in items if (s := shingles(x)) and 100 * len(s & shingles(t)) >= 75 * len(s)}
    for limit in (8 << 20, 0):  # an index in memory, tables
        assert {(r.doc_id, r.item_id) for r in search(table(spark, texts), df, index_bytes=limit).collect()} == want
        counts = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in search(table(spark, texts, extra=True), df, index_bytes=limit).collect()}
        sets, held = {i: shingles(x) for i, x in items}, {d: shingles(t) for d, t in texts}
        assert counts == {(d, i): (len(sets[i]), len(sets[i] & held[d])) for d, i in want}
        clean = drop_contaminated(table(spark, texts, extra=True).selectExpr("*", "1 as row"), df, index_bytes=limit)
        assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in texts} - {d for d, _ in want}) and clean.columns[-1] == "row"
        odd = df.selectExpr("cast(case when item_id <> 5 then item_id end as int) item_id", "text")
        found = search(table(spark, [(None, texts[-3][1]), (500, texts[-3][1]), (500, texts[-3][1])]), odd, index_bytes=limit).collect()
        assert sorted((str(r.doc_id), r.item_id) for r in found) == [("500", None), ("500", None), ("None", None)]
        assert search(table(spark, texts).where("false"), df, index_bytes=limit).count() == 0
    assert search(table(spark, texts), df.where("false")).count() == 0 and drop_contaminated(table(spark, texts), df.where("false")).count() == len(texts)


def test_signatures_by_size_class():
    """A document that contains an item has as many of its signature as the item's threshold says, for every size."""
    import math

    from tributary.llm.decontaminate import signature

    for n in range(1, 3000):
        size_class, length, need = signature(n, 75)
        assert 1 << (size_class - 1) <= n < 1 << size_class and 1 <= need <= length <= n
        missed = n - math.ceil(75 * n / 100)
        assert length - missed == need and length == min(n, (1 << size_class) - 1 - math.ceil(75 * ((1 << size_class) - 1) / 100) + 1)
