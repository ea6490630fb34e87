"""Registered queries for corpus cleaning, corpus statistics, vocabulary and thesaurus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiprop import fixtures as fx
from lexiprop.functions import text as tx
from lexiprop.operators import corpus as co
from lexiprop.operators import thesaurus as th
from lexiprop.operators import vocab as vo
from lexiprop.plans import oracle as o
from lexiprop.plans.expansion import rounded

QUERIES: dict = {}
ORACLE: dict = {}

WS = o.RE2_WS


def register(name, sql):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# --- corpus cleaning -------------------------------------------------------

def clean_sql(actions, limit=None) -> str:
    a = set(actions)
    x = "split_part(text, doc_id, 1)"
    if tx.ACTION_REMOVE_NEWLINES in a:
        x = f"replace(replace({x}, chr(10), ''), chr(13), '')"
    if tx.ACTION_SZ_IN_MUSS in a:
        x = f"replace({x}, 'muß', 'muss')"
    elif tx.ACTION_ALL_SZ in a:
        x = f"replace({x}, 'ß', 'ss')"
    if tx.ACTION_PARAGRAPH_WORD in a:
        x = f"replace({x}, '§', 'PARAGRAPHSIGN ')"
    if tx.ACTION_NON_GERMAN in a:
        x = f"regexp_replace({x}, '[^a-zA-ZüöäÜÖÄß]', ' ', 'g')"
    elif tx.ACTION_PUNCTUATION in a:
        x = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_{WS}]|[0-9_]', ' ', 'g')"
    elif tx.ACTION_PUNCTUATION_KEEP_HYPHEN in a:
        x = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_{WS}-]|[0-9_]', ' ', 'g')"
        x = f"regexp_replace({x}, '-[{WS}]-|[{WS}]-|-[{WS}]', ' ', 'g')"
    t = f"string_split({x}, ' ')"
    if tx.ACTION_MIN_TWO_CHARS in a:
        t = f"list_filter({t}, lambda w: length(w) >= 2)"
    if tx.ACTION_LOWERCASE in a:
        t = f"list_transform({t}, lambda w: lower(w))"
    src = "corpus_fx"
    if limit:
        src = f"(select * from corpus_fx order by doc_id limit {int(limit)})"
    return f"select doc_id, array_to_string({t}, ' ') as clean from {src}"


_CLEAN_VARIANTS = {
    "corpus_clean_default": (tx.DEFAULT_CORPUS_ACTIONS, None),
    "corpus_clean_punct": (
        (tx.ACTION_REMOVE_NEWLINES, tx.ACTION_SZ_IN_MUSS, tx.ACTION_PARAGRAPH_WORD, tx.ACTION_PUNCTUATION,
         tx.ACTION_MIN_TWO_CHARS, tx.ACTION_LOWERCASE, tx.ACTION_MULTIPLE_LINES),
        None,
    ),
    "corpus_clean_hyphen": (
        (tx.ACTION_PUNCTUATION_KEEP_HYPHEN, tx.ACTION_MIN_TWO_CHARS, tx.ACTION_LOWERCASE, tx.ACTION_SINGLE_LINE),
        None,
    ),
    "corpus_clean_all_sz": (
        (tx.ACTION_REMOVE_NEWLINES, tx.ACTION_ALL_SZ, tx.ACTION_PARAGRAPH_WORD, tx.ACTION_NON_GERMAN,
         tx.ACTION_MIN_TWO_CHARS, tx.ACTION_LOWERCASE, tx.ACTION_SINGLE_LINE),
        None,
    ),
    "corpus_clean_keep_newlines": ((tx.ACTION_SZ_IN_MUSS, tx.ACTION_PUNCTUATION, tx.ACTION_SINGLE_LINE), None),
    "corpus_clean_limit": (tx.DEFAULT_CORPUS_ACTIONS, 100),
}


def _clean_query(actions, limit):
    def q(spark, sf_dir):
        return co.clean_corpus(fx.corpus_fx(spark, sf_dir), actions, max_texts=limit)

    return q


for _name, (_acts, _limit) in _CLEAN_VARIANTS.items():
    register(_name, o.with_ctes([("corpus_fx", o.CORPUS_FX)], clean_sql(_acts, _limit)))(_clean_query(_acts, _limit))


def _ws_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '[{WS}]+'), lambda w: w <> '')"


@register(
    "corpus_stream_chunks",
    o.with_ctes(
        [
            ("corpus_fx", o.CORPUS_FX),
            ("clean", clean_sql(tx.DEFAULT_CORPUS_ACTIONS)),
            ("toks", f"select doc_id, {_ws_tokens('clean')} as t from clean"),
            ("offs", "select doc_id, t, coalesce(sum(len(t)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as off from toks"),
            ("pos", "select doc_id, unnest(range(len(t))) as pos, off from offs"),
            ("g", "select doc_id, pos, off + pos as gpos, cast(floor((off + pos) / 10000) as bigint) as chunk from pos"),
        ],
        "select chunk, count(*) as n_tokens, arg_min(doc_id, gpos) as first_doc_id, cast(arg_min(pos, gpos) as int) as first_pos, "
        "arg_max(doc_id, gpos) as last_doc_id, cast(arg_max(pos, gpos) as int) as last_pos from g group by chunk",
    ),
)
def q_corpus_stream_chunks(spark, sf_dir):
    clean = co.clean_corpus(fx.corpus_fx(spark, sf_dir))
    return co.chunk_summary(co.stream_chunks(clean)).withColumn("chunk", F.col("chunk").cast("long"))


# --- corpus statistics (raw documents) -------------------------------------

DESCRIBE_SQL = (
    "select count({v}) as count, round(avg({v}), 6) as mean, round(stddev_samp({v}), 6) as std, cast(min({v}) as double) as min, "
    "round(quantile_cont({v}, 0.25), 6) as p25, round(quantile_cont({v}, 0.5), 6) as p50, round(quantile_cont({v}, 0.75), 6) as p75, "
    "cast(max({v}) as double) as max, cast(sum({v}) as bigint) as sum from {src}"
)


@register(
    "corpus_token_stats",
    o.with_ctes(
        [("n", f"select doc_id, cast(len({_ws_tokens('text')}) as bigint) as n_tokens from documents")],
        DESCRIBE_SQL.format(v="n_tokens", src="n"),
    ),
)
def q_corpus_token_stats(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return rounded(co.describe(co.tokens_per_document(docs), "n_tokens"))


_RAW_TOKENS = ("rt", f"select unnest({_ws_tokens('text')}) as token from documents")


@register(
    "corpus_top_tokens",
    o.with_ctes([_RAW_TOKENS], "select token, count(*) as n from rt group by token order by n desc, token limit 10"),
)
def q_corpus_top_tokens(spark, sf_dir):
    return co.top_tokens(fx.table(spark, sf_dir, "documents"))


@register(
    "corpus_vocab_size",
    o.with_ctes([_RAW_TOKENS], "select count(distinct token) as n_distinct_tokens, count(*) as n_tokens from rt"),
)
def q_corpus_vocab_size(spark, sf_dir):
    return co.vocabulary_size(fx.table(spark, sf_dir, "documents"))


# --- vocabulary and co-occurrence -------------------------------------------

SIMPLE_TOKENS_SQL = (
    "select doc_id, unnest(range(len(t))) as pos, unnest(t) as token from (select doc_id, "
    "list_transform(list_filter(string_split(text, ' '), lambda w: length(w) >= 2), lambda w: lower(w)) as t from documents)"
)
VOCAB_SQL = "select token as word, count(*) as count from simple_tokens group by token having count(*) >= 5"


@register("vocab_min5", o.with_ctes([("simple_tokens", SIMPLE_TOKENS_SQL)], VOCAB_SQL))
def q_vocab_min5(spark, sf_dir):
    return vo.vocabulary(vo.simple_tokens(fx.table(spark, sf_dir, "documents")))


COOCCURRENCE_CTES = [
    ("simple_tokens", SIMPLE_TOKENS_SQL),
    ("vocab", VOCAB_SQL),
    ("iv", "select doc_id, token, row_number() over (partition by doc_id order by pos) as p from simple_tokens "
           "where token in (select word from vocab)"),
    ("pairs", "select a.token as w1, b.token as w2, 1.0 / (b.p - a.p) as weight from iv a join iv b "
              "on a.doc_id = b.doc_id and b.p > a.p and b.p <= a.p + 5"),
    ("sym", "select w1, w2, weight from pairs union all select w2 as w1, w1 as w2, weight from pairs"),
]


@register(
    "cooccurrence_window",
    o.with_ctes(
        COOCCURRENCE_CTES,
        "select w1, w2, round(sum(weight), 6) as weight from sym group by w1, w2",
    ),
)
def q_cooccurrence_window(spark, sf_dir):
    toks = vo.simple_tokens(fx.table(spark, sf_dir, "documents"))
    return rounded(vo.cooccurrence(toks, vo.vocabulary(toks), window=5))


# --- thesaurus ---------------------------------------------------------------

_CONCEPTS = [("concepts_fx", o.CONCEPTS_FX)]
_SYN = "select * from concepts_fx where class = 'synonym'"


@register("thes_class_counts", o.with_ctes(_CONCEPTS, "select class, count(*) as n_concepts from concepts_fx group by class"))
def q_thes_class_counts(spark, sf_dir):
    return th.class_counts(fx.concepts_fx(spark, sf_dir))


@register(
    "thes_size_describe",
    o.with_ctes(_CONCEPTS + [("kc", f"select concept, cast(len(keys) as bigint) as n_keys from ({_SYN})")], DESCRIBE_SQL.format(v="n_keys", src="kc")),
)
def q_thes_size_describe(spark, sf_dir):
    return rounded(th.size_describe(fx.concepts_fx(spark, sf_dir)))


@register(
    "thes_key_counts",
    o.with_ctes(
        _CONCEPTS + [("pk", f"select key, count(*) as n from (select unnest(keys) as key from ({_SYN})) group by key")],
        "select cast(sum(n) as bigint) as n_keys, count(*) as n_unique_keys, count(case when n > 1 then 1 end) as n_keys_in_several from pk",
    ),
)
def q_thes_key_counts(spark, sf_dir):
    return th.key_counts(fx.concepts_fx(spark, sf_dir))


@register(
    "thes_size_histogram",
    o.with_ctes(_CONCEPTS, f"select cast(len(keys) as bigint) as n_keys, count(*) as n_concepts from ({_SYN}) group by 1"),
)
def q_thes_size_histogram(spark, sf_dir):
    return th.size_histogram(fx.concepts_fx(spark, sf_dir))


def keys_sql(actions) -> str:
    a = set(actions)
    k = "keys"
    if th.ACTION_LOWERCASE in a:
        k = f"list_transform({k}, lambda x: lower(x))"
    if th.ACTION_NO_SPACE_OR_HYPHEN in a:
        k = f"list_filter({k}, lambda x: not contains(x, ' ') and not contains(x, '-'))"
    elif th.ACTION_NO_SPACE_KEEP_HYPHEN in a:
        k = f"list_filter({k}, lambda x: not contains(x, ' '))"
    if th.ACTION_ALL_SZ in a:
        k = f"list_transform({k}, lambda x: replace(x, 'ß', 'ss'))"
    return f"select concept, pos, keys from (select concept, pos, {k} as keys from ({_SYN})) where len(keys) > 0"


_KEY_VARIANTS = {
    "thes_keys_no_space_hyphen": (th.ACTION_LOWERCASE, th.ACTION_NO_SPACE_OR_HYPHEN),
    "thes_keys_keep_hyphen": (th.ACTION_LOWERCASE, th.ACTION_NO_SPACE_KEEP_HYPHEN),
    "thes_keys_all_sz": (th.ACTION_LOWERCASE, th.ACTION_NO_SPACE_OR_HYPHEN, th.ACTION_ALL_SZ),
}


def _keys_query(actions):
    def q(spark, sf_dir):
        return th.clean_keys(fx.concepts_fx(spark, sf_dir), actions).select("concept", "keys")

    return q


for _name, _acts in _KEY_VARIANTS.items():
    register(_name, o.with_ctes(_CONCEPTS, f"select concept, keys from ({keys_sql(_acts)})"))(_keys_query(_acts))

LARGEST_SQL = (
    "select word, first(concept order by n_keys desc, pos desc) as synset from ("
    "select concept, pos, len(keys) as n_keys, unnest(keys) as word from cleaned) group by word"
)
THES_CTES = _CONCEPTS + [
    ("cleaned", keys_sql(th.DEFAULT_THESAURUS_ACTIONS)),
    ("largest", LARGEST_SQL),
    ("simple_tokens", SIMPLE_TOKENS_SQL),
    ("vocab", VOCAB_SQL),
    ("in_vocab", "select word, synset from largest where word in (select word from vocab)"),
    ("thes_clean", "select word, synset from in_vocab where synset in (select synset from in_vocab group by synset having count(*) >= 2)"),
]


def _fixture_thesaurus(spark, sf_dir):
    vocab = vo.vocabulary(vo.simple_tokens(fx.table(spark, sf_dir, "documents")))
    return th.clean_thesaurus(fx.concepts_fx(spark, sf_dir), vocab)


@register("thes_largest_wins", o.with_ctes(THES_CTES[:3], "select word, synset from largest"))
def q_thes_largest_wins(spark, sf_dir):
    return th.largest_synset_wins(th.clean_keys(fx.concepts_fx(spark, sf_dir), th.DEFAULT_THESAURUS_ACTIONS))


@register("thes_in_vocab", o.with_ctes(THES_CTES[:6], "select word, synset from in_vocab"))
def q_thes_in_vocab(spark, sf_dir):
    vocab = vo.vocabulary(vo.simple_tokens(fx.table(spark, sf_dir, "documents")))
    mapping = th.largest_synset_wins(th.clean_keys(fx.concepts_fx(spark, sf_dir), th.DEFAULT_THESAURUS_ACTIONS))
    return th.keep_in_vocabulary(mapping, vocab)


@register("thes_clean", o.with_ctes(THES_CTES, "select word, synset from thes_clean"))
def q_thes_clean(spark, sf_dir):
    return _fixture_thesaurus(spark, sf_dir)
