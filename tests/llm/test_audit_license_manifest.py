"""Source divergence, license scan and Merkle manifest against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lexiprop.llm import license_join as lj
from lexiprop.llm import merkle_manifest as mm
from lexiprop.llm import oracles
from lexiprop.llm import source_divergence as sd
from oracle_harness import compare, duck

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASH = ["row", "digest", "tree", "pos", "n", "path", "blocks", "term", "value", "one", "key", "leaf"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _table(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *[f"'x' as {c}" for c in CLASH])


def _rows(df, like=None):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- source divergence ---


def _audit(rows, min_docs=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        mine = sorted(s for k, s in groups if k == lang)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in mine}
        whole = share(sum((counts[lang, s] for s in mine), Counter()))
        for s in mine:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(f(p[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


def _corpus(n, sources, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{'abcdefghij'[i % 10]}{'klmnopq'[i % 7]}{'rstuvé'[i % 6]}" for i in range(120)] + ["Étude", "日本", "ÄB", "Zed", "zed"]
    rows = []
    for i in range(n):
        own = rng.randrange(sources)
        words = [rng.choice(vocabulary[own % 5 :: 2 + own % 3]) for _ in range(rng.randrange(0, 25))]
        rows.append((i, rng.choice([" ", "1", "\n"]).join(words), rng.choice(["en", "en", "fr", None]), f"s{own}", None))
    return rows


@pytest.mark.parametrize("k", [2, 16])
def test_divergence_equals_brute_force(spark, k, monkeypatch):
    rows = _corpus(300, 23, 1) + [(None, None, None, None, None), (1, "", "xx", "a", 1), (2, "foo " * 5000, "xx", "b", 1)] * 2
    monkeypatch.setattr(sd, "K", k)
    monkeypatch.setattr(sd.CountMatrix.__init__, "__defaults__", (sd.MIN_DOCS, k))
    assert _rows(sd.audit(_table(spark, rows))) == _audit(rows)


def test_divergence_edge_cases(spark):
    assert sd.audit(_table(spark, [])).collect() == []
    lone = [(i, "same words here", "en", "a", 1) for i in range(12)]
    assert _rows(sd.audit(_table(spark, lone))) == _audit(lone) == []
    none_kept = [(1, "a b c", "en", "a", 1), (2, "d", "en", "b", 1), (3, "", "en", "c", 1)]
    assert _rows(sd.audit(_table(spark, none_kept))) == _audit(none_kept)
    assert {r[4] for r in _audit(none_kept)} == {0}


def test_divergence_visits_only_pairs_with_counts(spark):
    """Two halves of the sources share no term: no quadrant pair across them is entered."""
    rows = [(i, " ".join(f"{'ab'[i % 2]}{'cdefghijkl'[j % 10]}{'mnopqrstuv'[j // 10]}" for j in range(64)), "en", f"{i % 2}{i // 2 % 16:02d}", 1) for i in range(640)]
    matrix = sd.CountMatrix(_table(spark, rows))
    assert matrix.groups.count() == 32
    assert matrix.leaf_pairs().filter("a != b").count() == 0 and matrix.leaf_pairs().count() > 0
    assert _rows(sd.audit(_table(spark, rows))) == _audit(rows)


def test_terms_of_very_long_texts(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 7)
    text = "Ein sehr langer Text, längere Wörter-und_Zeichen 12abc " * 50
    got = [t.decode() for p in sd.pieces(text.encode()) for t in p]
    assert got == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))


def test_probability_is_exact(spark):
    for count, n, v in ((0, 0, 1), (5, 17, 3), (10**15, 9 * 10**14 + 10**15, 10**9), (123456789012, 8 * 10**12, 77777)):
        got = spark.range(1).select(sd.probability(*[sd.F.lit(x).cast("long") for x in (count, n, v)])).first()[0]
        assert got == 1 + 10**9 * (count + 2) // (n + 2 * v)


# --- license scan ---


def _license_rows():
    rng = random.Random(3)
    fill = ["lorem", "ipsum", "the", "license", "of", "under", "Ünder", "4", "2", "cc", "all", "by", "general", "public", "rights"]
    rows = []
    for i in range(150):
        words = [rng.choice(fill) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(lj.TEMPLATES)[1].split()
            for _ in range(rng.randrange(6)):
                notice[rng.randrange(len(notice))] = rng.choice(fill)
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.3 else w for w in words), "en", "s", 1))
    rows += [(None, None, None, None, None), (7, "", "", "", 0), (8, "All rights reserved. CC-BY", None, None, None)] * 2
    rows.append((9, "word " * 30_000 + "Released under the MIT License. " + "of the license " * 5000 + "GNU General Public License, all rights reserved", "en", "s", 1))
    return rows


def _scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    base = [(i, label) for i in range(len(words)) for p, label in lj.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    found, best = set(), 0.0
    for label, t in lj.TEMPLATES:
        own = set(t.split())
        span = next(s for s in lj.CLASSES if len(t.split()) <= s)
        for start in range(0, len(words), span):
            n = len(own & set(words[start : start + 2 * span]))
            if n >= math.ceil(round(lj.THRESHOLD * len(own), 9)):
                found.add(label)
                best = max(best, n / len(own))
    names = {label for _, label in base}
    first, last = (base[0][0], base[-1][0]) if base else (None, None)
    return len(words), len(base), first, last, ",".join(sorted(names)), ",".join(sorted(names | found)), 1.0 if base else round(best, 9)


def test_license_scan_equals_brute_force(spark):
    rows = _license_rows()
    got = _rows(lj.scan(_table(spark, rows)))
    assert got == sorted(((r[0], *_scan(r[1])) for r in rows), key=repr)
    assert sum(bool(r[6]) for r in got) > 30 and sum(r[7] not in (0, 1) for r in got) > 5
    assert lj.scan(_table(spark, [])).collect() == []


def test_license_filters_let_through_what_matches_only(spark):
    rows = _table(spark, _license_rows())
    known = lj.Templates(lj.template_counts(rows))
    seen = lj.scanned(rows, known)
    matches = lj.matching_blocks(seen, known).collect()
    assert matches and all(m.containment >= lj.THRESHOLD for m in matches)
    # far fewer blocks are built than the texts have
    built, words = seen.selectExpr("sum(size(blocks))", "sum(n_words)").first()
    assert built < words / 8


def test_license_scan_stays_in_the_jvm(spark):
    plan = lj.scan(_table(spark, _license_rows()[:5]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "BroadcastNestedLoop", "Cartesian"))


# --- Merkle manifest ---


def _hash(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(r, text):
    return _hash("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)))


def _tree(digests):
    paths, at, now = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(now) > 1:
        for i, p in enumerate(at):
            s = p - p % 8
            paths[i].append(("".join(now[s:p]), "".join(now[p + 1 : s + 8])))
            at[i] = p // 8
        now = [_hash("".join(now[i : i + 8])) for i in range(0, len(now), 8)]
    return now[0], paths


def _manifest(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        trees.append(_tree([_leaf(r, r[1]) for r in langs[lang]]))
    root, top = _tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for lang, (subroot, paths), rest in zip(order, trees, top):
        for r, path in zip(langs[lang], paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            now = _leaf(r, r[1].translate(LOWER) if hit else r[1])
            for before, after in path + rest:
                now = _hash(before + now + after)
            out.append((r[0], _leaf(r, r[1]), subroot, root, _hash("".join(b + a for b, a in path + rest)), now, now == root))
    return sorted(out, key=repr)


def _manifest_rows():
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(400)]), rng.choice([None, "", "Abc Ä", "xyz", "HELLO " * 9000]), rng.choice([None, "", "en", "en", "én"]), rng.choice(["s", None]), rng.choice([None, 5])) for _ in range(700)]
    return rows + [(1000 + i, "T", f"l{i}", "s", 1) for i in range(11)] + [(None, "same", "en", "s", 4)] * 30


@pytest.mark.parametrize("block", [8, 8**4])
def test_manifest_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(mm, "BLOCK", block)  # windows of one run, or of many
    rows = _manifest_rows()
    assert _rows(mm.manifest(_table(spark, rows))) == _manifest(rows)


@pytest.mark.parametrize("rows", [[], [(5, "A", None, None, None)], [(5, "A", "x", "", 1)] * 9, [(i, "A", f"l{i}", "", 1) for i in range(9)]])
def test_manifest_edge_cases(spark, rows):
    assert _rows(mm.manifest(_table(spark, rows))) == _manifest(rows)


def test_sql_agrees_on_edge_cases(spark, tmp_path):
    rows = _license_rows()[-8:] + _manifest_rows()[:200]
    _table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").repartition(1).write.parquet(str(tmp_path / "t"))
    con = duck(str(tmp_path))
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/t/*.parquet')")
    docs = spark.read.parquet(str(tmp_path / "t"))
    for operator, sql in ((sd.audit, oracles.SOURCE_DIVERGENCE), (lj.scan, oracles.license_scan()), (mm.manifest, oracles.MERKLE_MANIFEST)):
        problems, _ = compare(operator(docs), con, sql)
        assert not problems, problems
