"""The registered queries: columns and row counts of their contracts, SQL where there is some."""

import pytest

from conftest import SF_SMALL
from oracle_harness import compare, duck

import __spark_entry__
from lexiprop.llm.common import documents
from lexiprop.llm.queries import ORACLE, QUERIES

COLUMNS = {
    1: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    2: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    3: "doc_id bigint, fingerprint string, component_id bigint",
    4: "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    5: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    6: "doc_id bigint, held_out boolean, score double, predicted int",
    7: "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    8: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    9: "doc_id bigint, held_out boolean, score double, predicted int",
    10: "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    11: "lang string, source string, part string, item string, value bigint, rank int",
    12: "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    13: "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, name):
    out = QUERIES[name](spark, SF_SMALL)
    kinds = dict(out.dtypes)
    for column in COLUMNS[int(name[2:].split("_")[0])].split(", "):
        c, kind = column.split(" ")
        assert kinds[c] == kind
    if "doc_id" not in kinds:  # op11 has a row for each pair of sources or term
        return
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in documents(spark, SF_SMALL).select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    problems, _ = compare(QUERIES[name](spark, SF_SMALL), duck(SF_SMALL), ORACLE[name])
    assert not problems, problems


def test_registered():
    queries = __spark_entry__.queries()
    assert set(QUERIES) < set(queries) and "pipeline" in queries and set(ORACLE) < set(__spark_entry__.oracle_sql())
