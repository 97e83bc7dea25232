"""The pipeline against its stages by brute force, and over odd tables."""

import duckdb
import pytest

import corpus_pipeline
from loomspan.llm import decontaminate, language, mixing, token_ids
from loomspan.llm.vocab import BYTE_VOCABULARY, read_ranks
from tests.llm.test_operators import DATA, SCHEMA, TEXTS, brute_pairs


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars < 1200").write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").where("item_id % 4 = 0").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_whole_run(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    accepted = {r.doc_id for r in language.language_id(docs).where("accepted").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in accepted}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in brute_pairs([(i, r.text) for i, r in rows.items()]):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    rows = {i: r for i, r in rows.items() if find(i) == i}
    items = [r.text.encode() for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = {i: r for i, r in rows.items() if not any(decontaminate.brute_distance(x, r.text.encode()) <= decontaminate.edit_budget(len(x)) for x in items)}
    frame = spark.createDataFrame(list(rows.values()), docs.schema).toPandas()  # noqa: F841
    kept = {r[0] for r in duckdb.sql(mixing.mixing_sql("frame", "doc_id")).fetchall()}
    encode = token_ids.encoder(BYTE_VOCABULARY, read_ranks(BYTE_VOCABULARY)).encode
    want = {i: encode(rows[i].text, disallowed_special=()) for i in kept}
    got = {r.doc_id: token_ids.unpack(bytes(r.payload), r.block_starts).tolist() for r in corpus_pipeline.run(spark, small).collect()}
    assert len(want) > 20 and got == want


def test_odd_rows_and_empty_tables(spark, tmp_path):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    odd = spark.createDataFrame([(i, t, "en", None, 0, "s", "k", 1, 2, 3, "x") for i, t in TEXTS], SCHEMA)
    for name, docs, items in (("odd", odd, bench), ("empty", odd.limit(0), bench), ("no_items", odd, bench.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()]
        assert not {2, 3, 4, 5, 7} & set(got) and (name != "empty" or not got)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "mix", "token_ids"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
