import itertools
import random
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cases import corpus, table, thue_morse


def test_token_store(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tributary.llm import token_store as s

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    texts = [*corpus(5), (-3, "Nbsp here  and 'tis　<|endoftext|> \n\n end "), (700, "don't we'll\t\tX\r\n")]
    s.write_store(table(spark, texts), f"file://{tmp_path}/store", path)
    ids = {r.doc_id: r for r in s.read_ids(spark, f"file://{tmp_path}/store").collect()}
    start = 0
    found = {r.doc_id: r for r in s.read_digests(spark, f"file://{tmp_path}/store").collect()}
    for i, t in sorted(texts):
        want = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        assert list(ids[i].ids) == want
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    keys = [r.key for r in s.read_chunks(spark, f"file://{tmp_path}/store").select("key").collect()]
    assert len(keys) == len(set(keys))
    s.write_store(table(spark, texts).where("false"), f"file://{tmp_path}/empty", path)
    assert s.read_digests(spark, f"file://{tmp_path}/empty").count() == 0
    rng = np.random.default_rng(0)
    stream = rng.integers(0, 50000, 20000).astype(np.uint32)
    assert s.cut_points(stream)[-1] == 20000 and max(np.diff([0, *s.cut_points(stream)])) <= s.MOST
    assert s.crc_join(zlib.crc32(b"ab"), zlib.crc32(b"cde"), 3) == zlib.crc32(b"abcde")


def test_pieces_end_with_their_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tributary.llm.pieces_cache import PieceCache

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    r = random.Random(3)
    texts = ["word.\n\n", "next", "", "a  ", "", "b\t\t", "\n\n", "\n", "x \r\n"] + ["".join(r.choice(["a", "B.", "'s", " ", "\n", "\t", "7", "É"]) for _ in range(r.randrange(9))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    ids, first = PieceCache(path).encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True):
        assert ids[a:b].tolist() == model.encode(t, add_special_tokens=False).ids


def test_tokens_of_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tributary.llm.token_store import tokens_of

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>x\n\n"), (3, "<|endof"), (4, "text|> plain"), (5, "half <|end\n\n"), (6, None)]
    found = {r.doc_id: r for r in tokens_of(table(spark, texts).coalesce(1)).collect()}
    for i, t in texts:
        want = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        assert (found[i].n_tokens, found[i].ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))


def test_pieces_that_collide_modulo_a_power_of_two():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tributary.llm.pieces_cache import PieceCache

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, cache = Tokenizer.from_file(path), PieceCache(path)
    for n in (1024, 2048, 4096):
        for text in (thue_morse(n), thue_morse(n, True)):
            raw = text.encode()
            assert cache.encode(np.frombuffer(raw, dtype=np.uint8), np.array([0, n]))[0].tolist() == model.encode(text, add_special_tokens=False).ids


@pytest.fixture
def store(spark, tmp_path):
    import public_tokenizers

    from tributary.llm import token_store as s

    s.write_store(table(spark, [*corpus(5, 40), (3, "an id again"), (None, "no id")], extra=True).repartition(4), f"file://{tmp_path}/store", public_tokenizers.path("byte_bpe_50k.json"))
    return tmp_path / "store"


def test_store_with_repeated_and_null_ids(spark, store):
    from tributary.llm import token_store as s

    rows = s.read_digests(spark, f"file://{store}").orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: -1 if i is None else i) and rows[0].doc_id is None
    assert sum(r.doc_id == 3 for r in rows) == 2 and [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]


@pytest.mark.parametrize("name", ["chunks", "recipes", "manifest", "total"])
@pytest.mark.parametrize("damage", ["lost row", "lost file", "lost table", "changed", "doubled"])
def test_damaged_store_is_refused(spark, store, name, damage):
    """Whatever row, file or table is lost, changed or doubled, reading fails."""
    from tributary.llm import token_store as s

    files = sorted(f for f in (store / name).glob("part-*"))
    full = [f for f in files if pq.read_metadata(f).num_rows]
    if damage == "lost table":
        shutil.rmtree(store / name)
    elif damage == "lost file":
        full[0].unlink()
        if len(full) == 1:
            pq.write_table(pq.ParquetFile(store / "recipes" / next(iter(sorted(x.name for x in (store / "recipes").glob("part-*"))))).read().slice(0, 0) if name == "recipes" else pa.table({}), full[0])
    else:
        held = pq.ParquetFile(full[0]).read()
        if damage == "lost row":
            held = held.slice(1)
        elif damage == "doubled":
            held = pa.concat_tables([held, held.slice(0, 1)])
        else:
            column = {"chunks": "payload", "recipes": "n_tokens", "manifest": "n_docs", "total": "n_tokens"}[name]
            values = held.column(column).to_pylist()
            values[0] = values[0][:-1] + bytes([values[0][-1] ^ 1]) if name == "chunks" else values[0] + 1
            held = held.set_column(held.schema.get_field_index(column), held.schema.field(column), pa.array(values, held.schema.field(column).type))
        full[0].unlink()
        pq.write_table(held, full[0])
    for crc in store.rglob(".*.crc"):
        crc.unlink()
    if (name, damage) == ("chunks", "doubled"):  # a chunk too many still is what its hash says
        with pytest.raises(Exception, match="isn't as its recipe says"):
            s.read_digests(spark, f"file://{store}").collect()
        return
    with pytest.raises(Exception):
        s.read_digests(spark, f"file://{store}").collect()
