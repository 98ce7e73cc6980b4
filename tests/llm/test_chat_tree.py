import hashlib
import itertools

import pytest


@pytest.mark.parametrize("units", ["characters", "tokens"])
def test_chat_tree(spark, tmp_path, units):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tributary.llm import chat_tree as c

    tokenizer = public_tokenizers.path("byte_bpe_50k.json") if units == "tokens" else None

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", c.PROBE), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "u<s>\\", None), (3, 1, None, "</turn>\n<turn x>"), (4, 0, "user", "hi"), (None, None, "assistant", "alone"), (None, None, "assistant", "alone"), (5, 0, "user", "é <|endoftext|>\u3000 \U0001f600"), (5, 0, "user", "é <|endoftext|>\u3000 \U0001f600"), (6, 0, "assistant", "x" * 9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    c.write_tree(df.selectExpr("*", "1 as node", "2 as path", "3 as rank"), f"file://{tmp_path}/tree", tokenizer=tokenizer)
    nodes = spark.read.parquet(f"file://{tmp_path}/tree/nodes").orderBy("start").collect()
    assert sum(n.segment.startswith("<turn user>hi") for n in nodes) == 1
    assert [n.start for n in nodes] == [0, *itertools.accumulate(n.n_units for n in nodes)][:-1]
    model = Tokenizer.from_file(tokenizer) if tokenizer else None
    stream = [x for n in nodes for x in (n.ids if tokenizer else n.segment)]
    for n in nodes:
        path = [x for a in n.attends for x in stream[a.start : a.end]]
        own = list(n.ids) if tokenizer else list(n.segment)
        assert len(path) == n.position + n.n_units and path[len(path) - len(own) :] == own
        assert not tokenizer or model.decode(own, skip_special_tokens=False) == n.segment
    every = c.digests(spark, f"file://{tmp_path}/tree", tokenizer).collect()
    assert sum(r.conv_id is None for r in every) == 2
    got = {r.conv_id: r for r in every}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)[: None if conv is not None else 1]
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss))
    c.write_tree(df.where("false"), f"file://{tmp_path}/empty", tokenizer=tokenizer)
    assert c.digests(spark, f"file://{tmp_path}/empty", tokenizer).count() == 0
