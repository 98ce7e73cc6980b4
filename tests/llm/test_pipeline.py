from cases import components, shingles, table


def test_pipeline(spark):
    import corpus_pipeline as p

    from tributary.llm.shared import table as read

    d = "/root/testdata/sf0.001"
    docs = read(spark, d, "documents")
    kept = {r.doc_id for r in p.quality(spark, docs, d).collect()}
    left = docs.where(docs.doc_id.isin(*kept))
    texts = [(r.doc_id, r.text) for r in left.collect()]
    one = {c for _, c in components(texts).values()}
    assert {r.doc_id for r in p.near_duplicates(spark, left, d).collect()} == one
    items = [shingles(r.text) for r in read(spark, d, "benchmark").collect()]
    clean = {i for i, t in texts if i in one and not any(s and 100 * len(s & shingles(t)) >= 75 * len(s) for s in items)}
    left = left.where(left.doc_id.isin(*one))
    assert {r.doc_id for r in p.decontamination(spark, left, d).collect()} == clean
    whole = p.run(spark, d)
    assert {r.doc_id for r in whole.collect()} <= clean and whole.columns[0] == "doc_id"


def test_stages_pass_odd_columns_on(spark):
    """Columns with dots, clashing names, null ids and repeated rows go through every stage that keeps documents; empty tables too."""
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    long = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(6)]
    rows = [(0, long[0]), (0, long[0]), (1, long[0] + " more"), (None, long[1]), (4, long[2]), (5, long[3]), (6, None), (7, "")]
    docs = table(spark, rows, extra=True).withColumn("a.b", F.lit("x")).withColumn("row", F.lit(1))
    kept = [sorted(str(r.doc_id) for r in stage(spark, docs, "/root/testdata/sf0.001").collect()) for _, stage in p.STAGES[1:3]]
    assert kept == [["0", "4", "5", "6", "7", "None"], ["0", "0", "1", "4", "5", "6", "7", "None"]]
    for _, stage in p.STAGES[:-1]:
        done = stage(spark, docs, "/root/testdata/sf0.001")
        assert done.columns == docs.columns and done.schema.names == docs.schema.names
        assert stage(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0
    assert p.STAGES[-1][1](spark, docs, "").count() == len(rows)
