import math
import re

from cases import corpus, table


def brute(texts, templates, dice=75):
    """The best Dice coefficient, in permille, of any line, paragraph, whole text or window of a template's size."""
    words = lambda x: [w for w in re.sub(r"[\W_]+", " ", "".join(c.lower() if c.isascii() else c for c in x)).split(" ") if w]
    pairs = lambda w: {*zip(w, w[1:], strict=False)}
    found = {}
    for i, text in texts:
        if text is None:
            continue
        whole = words(text)
        units = [words(u) for u in [*text.split("\n"), *re.split(r"\n[\x20\x09-\x0D]*\n", text), text]]
        for name, t in templates.items():
            own = words(t)
            for u in [*units, *(whole[a : a + len(own)] for a in range(len(whole)) if tuple(whole[a : a + 2]) in pairs(own))]:
                if a := pairs(u):
                    p = math.floor(2000 * len(a & pairs(own)) / (len(a) + len(pairs(own))))
                    if p >= 10 * dice:
                        found[i, name] = max(found.get((i, name), 0), p)
    return found


def test_license_scan(spark):
    from tributary.llm import license_scan as s

    mit, gpl, apache = (s.TEMPLATES[k] for k in ("mit-text", "gpl-3.0-header", "apache-2.0-header"))
    laid_out = "\n\n".join([mit[:380], mit[380:560], mit[560:]])
    filler = "\n".join(f"code line {i} of the program = f({i})" for i in range(80))
    texts = [
        (1, "Intro words.\nReleased under the MIT License!\nmore"), (2, mit[:200] + "\n" + mit[200:]), (3, None), (4, ""), (5, "released license mit"), (6, "A\n\n" + s.TEMPLATES["mpl-2.0"]),
        (7, f"Copyright 2020 Jane Doe\n\n{laid_out}\n{filler}"), (8, f"{filler}\n/* {apache[:150]}\n * {apache[150:300]}\n * {apache[300:]} */\n{filler}"),
        (9, "Copyright 2020 Jane Doe. Released under the MIT License. All else is as it was before."), (10, gpl.replace("useful", "of use").replace(". ", ".\n\n") + "\n" + filler), (11, filler), (12, mit[:300] + filler + mit[300:]),
        *[(100 + i, t) for i, t in corpus(7, 20)],
    ]
    found = {(r.doc_id, r.license): r for r in s.scan(table(spark, texts, extra=True)).collect()}
    assert {k: r.permille for k, r in found.items()} == brute(texts, s.TEMPLATES)
    assert found[1, "mit"].permille == 1000 and found[2, "mit-text"].permille >= 980 and found[6, "mpl-2.0"].permille == 1000
    assert found[7, "mit-text"].permille >= 950 and found[8, "apache-2.0-header"].permille >= 950 and found[9, "mit"].permille == 1000 and found[10, "gpl-3.0-header"].permille > 900
    assert found[9, "mit"].n_units == 0 and {d for d, _ in found} == {1, 2, 6, 7, 8, 9, 10, 12}


def test_license_scan_of_repeated_and_null_ids(spark):
    from tributary.llm import license_scan as s

    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License."), (None, "x\nReleased under the MIT License.\ny")]
    found = sorted((str(r.doc_id), r.license, r.n_units, r.permille) for r in s.scan(table(spark, rows)).collect())
    assert found == [("1", "mit", 6, 1000), ("None", "mit", 6, 1000)]
    assert s.scan(table(spark, [])).count() == 0
