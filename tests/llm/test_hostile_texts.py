"""Very long texts of one kind: each within seconds, and equal to a plain version on a shorter one."""

import time

import pytest

from loomspan.llm import decontaminate, mixing, spans, token_ids
from loomspan.llm.vocab import BYTE_VOCABULARY, read_ranks


@pytest.fixture(scope="module")
def machine():
    return token_ids.encoder(BYTE_VOCABULARY, read_ranks(BYTE_VOCABULARY))


@pytest.mark.parametrize("tail", ["", "a", " ", "\n", "'s", "é", "7 x", " b", "!"])
@pytest.mark.parametrize("run", [" ", "\n", "\t \r\n", "　 "])
def test_long_blanks_have_the_same_ids(machine, run, tail):
    for head in ("", "word", "it's 5."):
        for n in (19_999, 20_000, 30_001):
            text = head + (run * n)[:n] + tail
            assert token_ids.encode(machine, text).tolist() == machine.encode(text, disallowed_special=())
    two = "a" + run * 20_000 + "b" + run * 20_000 + tail
    assert token_ids.encode(machine, two).tolist() == machine.encode(two, disallowed_special=())


@pytest.mark.parametrize("text", [" " * 5_000_000, "x" + "\n" * 5_000_000 + "y", "x" * 1_000_000, "ab1!" * 1_250_000])
def test_long_texts_pack_and_unpack(spark, machine, text):
    began = time.time()
    row = token_ids.token_ids(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.time() - began < 40
    assert machine.decode(token_ids.unpack(bytes(row.payload), row.block_starts).tolist()) == text


@pytest.mark.parametrize("text,item", [("a" * 1_000_000, "a" * 150), ("ab" * 300_000 + "x", "ab" * 60 + "x" + "ab" * 20), ("a" * 400_000, "b" + "a" * 100)])
def test_one_repeated_gram_in_text_and_item(spark, text, item):
    began = time.time()
    docs = spark.createDataFrame([(1, text), (2, item[:50])], "doc_id long, text string")
    rows = decontaminate.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert time.time() - began < 60
    assert [(r.doc_id, r.item_id, r.edits) for r in rows] == [(1, 7, decontaminate.brute_distance(item.encode(), text[-5000:].encode()))]


def test_extra_columns_of_any_name(spark):
    rows = spark.createDataFrame([(k, f"text number {k} has some words", "en", "web", 1, 2, 3, 4) for k in range(40)], "doc_id long, text string, lang string, source string, __mix_source int, __mix_of int, __cuts int, __cut_id int")
    for kept in (mixing.mix(rows), spans.deduplicated(rows)):
        got = kept.collect()
        assert kept.columns == rows.columns and got and {tuple(r)[4:] for r in got} == {(1, 2, 3, 4)}
