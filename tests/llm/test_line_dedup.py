from cases import LOWER, corpus, table


def test_line_dedup(spark):
    from tributary.llm.line_dedup import dedup_lines

    texts = corpus(2)
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    holders = {}
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    want = {}
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 2 and min(holders[key(x)]) != i)]
        want[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(table(spark, texts, extra=True)).collect()} == want


def test_line_dedup_edges(spark):
    """Rows without id count for nothing and stay whole; repeated rows are treated alike; an empty table."""
    from tributary.llm.line_dedup import dedup_lines

    assert dedup_lines(table(spark, [])).count() == 0
    rows = [(2, "a line of ten chars"), (2, "a line of ten chars"), (5, "A LINE of ten chars\nown text"), (None, "a line of ten chars\nonly here and there"), (None, None), (7, "Only here and there")]
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(table(spark, rows)).collect()), key=str)
    want = [(2, 1, 0, "a line of ten chars"), (2, 1, 0, "a line of ten chars"), (5, 2, 1, "own text"), (None, 2, 0, "a line of ten chars\nonly here and there"), (None, 1, 0, ""), (7, 1, 0, "Only here and there")]
    assert found == sorted(want, key=str)
