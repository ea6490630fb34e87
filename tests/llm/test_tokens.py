import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiprop.llm import bpe_distinct as bd
from lexiprop.llm import bpe_words as bw
from lexiprop.llm import token_arrow as ta
from lexiprop.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, ids string, part string"
TEXTS = [None, "", " \n\t", "Hello, World's  don't!! 12x3", "<|endoftext|>a <|startoftext|> <|endof text|>", "\x1c\x85\xa0 é é Ω ﬁ İstanbul ΑΣ", "naïve ÀÉß ×÷ªµº ²", "日本語 text 😀!'s", "a" * 3000, "x \x00y", "'s't 're'll !'s", "word " * 5000]


@pytest.fixture(scope="module")
def library():
    return bw.load(bw.tokenizer_text(tokenizer_path()))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="aB'st ré\n<|>endof1!\x1ć\xa0Σ", max_size=60))
def test_words_give_the_ids_of_the_text(library, text):
    assert np.frombuffer(bw.Encoder(library).encode([text])[0], "<u4").tolist() == _ids(library, text)


def test_cases_give_the_ids_of_the_text(library, monkeypatch):
    for most in (1 << 16, 7):
        monkeypatch.setattr(bw.segments, "__defaults__", (most,))
        e = bw.Encoder(library, room=50)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(TEXTS)] == [_ids(library, t) for t in TEXTS]


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises((ValueError, KeyError, TypeError)):
        bw.tokenizer_text(str(public_tokenizers.path("byte_bpe_50k.json")))


def _rows():
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again a row 3"), (3, "again a row 3")]
    return rows + [(100 + i, " ".join(rng.choice(["the", "Thing", "of,", "été", "x1", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(80)))) for i in range(300)]


@pytest.mark.parametrize("block_bytes,buckets,room", [(500, 3, 10), (8 << 20, 64, 1 << 20)])
def test_distinct_words_equal_the_library(spark, library, block_bytes, buckets, room):
    rows = _rows()
    out = bd.encode_documents(_docs(spark, rows).repartition(4), tokenizer_path(), block_bytes, buckets, room, with_results=True).collect()

    def want(i, t):
        ids = _ids(library, t)
        text = library.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text

    assert sorted((tuple(r) for r in out), key=repr) == sorted((want(i, t) for i, t in rows), key=repr)


def test_each_distinct_word_is_encoded_once(spark):
    docs = _docs(spark, [(i, "same words in every text here") for i in range(500)])
    blocks = bd.word_blocks(docs.repartition(5), 1000, 4)
    n = blocks.filter("bucket >= 0").select("block", "bucket").distinct().count()
    assert n == blocks.filter("bucket >= 0").count() and blocks.select("block").distinct().count() > 5
    assert bd.encode_documents(_docs(spark, []), tokenizer_path()).count() == 0


@pytest.mark.parametrize("length,batch", [(16, 3), (2048, 64)])
def test_token_files_round_trip(spark, library, tmp_path, length, batch):
    rows = _rows()
    manifest = ta.write_tokens(_docs(spark, rows).repartition(3), f"file://{tmp_path}/tokens", tokenizer_path(), 2, length, batch)
    out = ta.read_tokens(manifest).collect()
    ids = {i: sorted([*_ids(library, t), 2] for j, t in rows if j == i) for i, _ in rows}
    assert len(out) == len(rows)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        mine = [x for x in ids[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32]
        assert mine and r.n_tokens == len(mine[0]) and r.start == at
        at += r.n_tokens
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order)
    tokens = []
    for m in sorted(manifest.collect(), key=lambda m: m.part):
        f = ta.SequenceFile(m.ids_file)
        assert f.batches[0].schema.field(0).type.list_size == length and all(b.num_rows == batch for b in f.batches[:-1])
        got = [f.sequence(i) for i in range(len(f))]
        assert all(not x.flags.owndata and len(x) == len(k) == length for x, k in got)
        got = [(x, k.to_numpy(zero_copy_only=False)) for x, k in got]
        real = np.concatenate([x[k] for x, k in got])
        assert len(real) == m.n_tokens and (np.diff(np.concatenate([k for _, k in got]).astype(int)) <= 0).all()
        tokens += real.tolist()
    assert len(tokens) == at and tokens.count(2) >= len(rows)


def test_no_documents(spark, tmp_path):
    manifest = ta.write_tokens(_docs(spark, []), f"file://{tmp_path}/none", tokenizer_path())
    assert ta.read_tokens(manifest).count() == 0
