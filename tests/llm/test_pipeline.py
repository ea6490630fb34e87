"""The pipeline against a brute-force version of each stage, stage by stage."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from conftest import SF_SMALL

from lexiprop.llm import bpe_words, budget_mix, toxicity_channel
from lexiprop.llm.common import documents, labels
from lexiprop.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = documents(spark, SF_SMALL), []
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF_SMALL).cache()
        out.append(docs.collect())
    return out


def _rows(rows):
    return Counter(tuple(r) for r in rows)


def test_stages_and_columns(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "bpe"]
    docs = documents(spark, SF_SMALL)
    for _, stage in cp.STAGES[1:4]:
        assert stage(spark, docs, SF_SMALL).columns == docs.columns


def test_toxicity_stage(spark, outputs):
    docs = documents(spark, SF_SMALL)
    model = toxicity_channel.fit(docs, labels(spark, SF_SMALL))
    score = model.scorer()
    assert _rows(outputs[0]) == _rows(r for r in docs.collect() if score(r.text) < toxicity_channel.THRESHOLD)


def test_exact_stage(outputs):
    least = {}
    for r in outputs[0]:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[key] = min(least.get(key, r), r, key=lambda x: x.doc_id)
    assert _rows(outputs[1]) == _rows(least.values())


def test_near_stage(outputs):
    def simhash(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = np.array([xxhash.xxh64_intdigest(x, 42) for x in s], np.uint64)
        return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))

    rows = outputs[1]
    fps = np.array([simhash(r.text) for r in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    group = np.arange(len(rows))
    while True:
        new = np.array([group[near[i]].min() for i in range(len(rows))])
        if (new == group).all():
            break
        group = new
    least = {}
    for r, g in zip(rows, group):
        least[g] = min(least.get(g, r), r, key=lambda x: x.doc_id)
    assert _rows(outputs[2]) == _rows(least.values())


def test_mix_stage(spark, outputs):
    rows, mixed = outputs[2], outputs[3]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    words, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        words[r.source] += size(r)
    for r in mixed:
        taken[r.source] += size(r)
    names = sorted(words, key=lambda s: (s is None, s or ""))
    for s, t in zip(names, budget_mix.targets([words[s] for s in names])):
        rest, sums = round(t) % words[s], 1
        for r in rows:
            sums |= sums << size(r) if r.source == s else 0
        assert abs(taken[s] - round(t)) == min(abs(k - rest) for k, bit in enumerate(bin(sums)[:1:-1]) if bit == "1")
    assert max(_rows(mixed).values()) <= 2 and set(_rows(mixed)) <= set(_rows(rows))


def test_bpe_stage(outputs):
    t = bpe_words.load(bpe_words.tokenizer_text(tokenizer_path()))
    want = Counter()
    for r in outputs[3]:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert _rows(outputs[4]) == want


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    odd = [(None, None, None, None, None, "x"), (1, "", "en", "a", 0, "x"), (1, "", "en", "a", 0, "x"), (2, "some words here", "en", None, 15, None)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF_SMALL)
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
            docs = spark.createDataFrame(docs.collect(), schema)
        assert cp.bpe(spark, docs, SF_SMALL).count() == docs.count()
        assert docs.filter(F.col("doc_id") == 2).count() <= 2


HELPERS = ["__doc", "__row", "__hash", "__n", "__at", "__copies", "__digest", "__copy", "__id", "__score", "row", "key", "hash", "copies", "members", "score", "n", "digest"]


def test_columns_named_like_helpers(spark):
    """The same rows stay as without such columns, and the columns are as they were."""
    rows = [(i, f"some words {i % 7} " * (3 + i % 5), "en", f"s{i % 3}", i) for i in range(40)] + [(3, "some words 3", "en", "s0", 3)] * 3 + [(None, None, None, None, None)] * 2
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    named = plain.selectExpr("*", *[f"concat('{c}', coalesce(doc_id, 0)) as `{c}`" for c in HELPERS])
    for name, stage in cp.STAGES[:4]:
        want = _rows(stage(spark, plain, SF_SMALL).collect())
        out = stage(spark, named, SF_SMALL)
        got = out.collect()
        assert out.columns == named.columns, name
        if name == "source_mix":  # which rows are drawn depends on all their columns, how many words doesn't
            taken = lambda found: Counter(w for r, n in found.items() for w in [r[3]] * n * len((r[1] or "").split()))
            assert taken(Counter(tuple(r)[:5] for r in got)) == taken(want)
        else:
            assert Counter(tuple(r)[:5] for r in got) == want, name
        assert all(r[c] == f"{c}{r.doc_id or 0}" for r in got for c in HELPERS), name
