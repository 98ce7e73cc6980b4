import re
from collections import Counter

from cases import WORD, corpus, table, thue_morse


def test_quality_counts_and_learning(spark):
    from tributary.llm import quality_rules as q

    texts = [*corpus(4), (900, "a b c a b c a b c d"), (901, "#x | y\n#x | y\n \n \n<z> &")]
    texts += [(902, f"{thue_morse(2048)} x y {thue_morse(2048, True)} x y"), (903, " ".join(f"w{i % 700}" for i in range(1500)))]
    for r in q.with_counts(table(spark, texts, extra=True), ["doc_id"], into="c").collect():
        t = dict(texts)[r.doc_id] or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times = Counter(runs)
        covered = {i + j for i, x in enumerate(runs) if times[x] > 1 for j in range(3)}
        assert (r.c.n_words, r.c.word_chars, r.c.n_symbols, r.c.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup)
        assert r.c.n_repeat_words == len(covered)


def test_quality_held_out(spark):
    from pyspark.sql import functions as F

    from tributary.llm import quality_rules as q

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged, rules = q.judge(spark, docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.where("doc_id % 2 = 0"))
    rows = judged.where("not base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert rules.rules and kept[1] > 0.98 and kept[0] < 0.3, (kept, str(rules))
    assert q.learn(judged.select("doc_id").limit(0).toPandas().assign(quality=[])).rules == ()


def test_quality_edges(spark):
    """Empty tables, labels of one class, columns with odd names, null and repeated ids: the verdict is the base rules'."""
    from pyspark.sql import functions as F

    from tributary.llm import quality_rules as q

    texts = [*corpus(4), (None, None), (None, "word " * 60), (3, "a b c d " * 40), (3, " ".join(f"v{i}" for i in range(60)))]
    docs = table(spark, texts, extra=True).withColumn("a.b", F.lit(1))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 0, 0)], "doc_id long, quality int, toxic int")

    def good(t):
        w = WORD.findall(t or "")
        runs = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(3)}
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)

    for known in (labels, labels.where("false")):
        kept = q.keep_good(spark, docs, known)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in texts if good(t)), key=str)
        judged, _ = q.judge(spark, docs, known)
        assert sorted(((r.doc_id, r.kept, r.base_failed) for r in judged.collect()), key=str) == sorted(((i, good(t), not good(t)) for i, t in texts), key=str)
    assert q.keep_good(spark, docs.where("false"), labels).count() == 0
