"""Every repeated run of several sentences is removed to its last sentence."""

import re
from pathlib import Path

import duckdb

from loomspan.llm import queries, spans

DATA = "/root/testdata/sf0.001"


def sentences(text):
    out = []
    for line in text.split("\n"):
        now = []
        for w in re.findall(r"[^ \t\n\r\x0b\x0c]+", line):
            now.append(w)
            if w[-1] in ".!?":
                out.append(tuple(now))
                now = []
        if now:
            out.append(tuple(now))
    return out


def brute_runs(rows):
    """All runs of at least two sentences and twenty words, of any length, by their words."""
    docs, seen, gone = {i: sentences(t) for i, t in rows if i is not None and t}, {}, {}
    for i, s in sorted(docs.items()):
        for a in range(len(s)):
            words = ()
            for b in range(a, len(s)):
                words += s[b]
                if b - a + 1 >= spans.SENTENCES and len(words) >= spans.WORDS and seen.setdefault(words, (i, a)) != (i, a):
                    gone.setdefault(i, set()).update(range(a, b + 1))
    return {i: "\n".join(" ".join(x) for k, x in enumerate(docs[i]) if k not in g) for i, g in gone.items()}


def test_the_tail_of_a_repeated_run_goes(spark):
    run = "One two three four five six seven eight nine ten. " * 2 + "Eleven twelve thirteen words are in this one. Short end. Last."
    df = spark.createDataFrame([(1, "Before it all. " + run), (2, run + " Something new follows here.")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in spans.substring_dedup(df, ends=True).collect()} == {2: "Something new follows here."}
    assert {r.doc_id: r.text for r in spans.deduplicated(df, ends=True).collect()}[2] == "Something new follows here."


def test_runs_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars < 4000").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in spans.substring_dedup(docs, ends=True).collect()}
    assert got == brute_runs(rows) and got != {r.doc_id: r.text for r in spans.substring_dedup(docs).collect()}


def test_runs_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{Path(DATA)}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(queries.ORACLE_SQL["op9_substring_dedup_runs"]).fetchall()}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op9_substring_dedup_runs(spark, DATA).collect()} == want
