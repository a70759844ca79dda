"""The registered training-data queries over the small test tables: SQL counterparts, brute force, and what must agree."""

import collections
import math
from pathlib import Path

import duckdb
import pytest

from glossaflow.llm import leakage, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def rows(spark):
    found = {}

    def of(name):
        if name not in found:
            df = queries.queries()[name](spark, SF)
            found[name] = [r.asDict() for r in df.collect()], df.columns
        return found[name][0]

    return of


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(rows, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    q = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in q.description]
    want = collections.Counter(tuple(map(plain, r)) for r in q.fetchall())
    assert collections.Counter(tuple(plain(r[n]) for n in names) for r in rows(name)) == want


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("p7_mixture",)])
def test_rows_are_distinct(rows, name):
    got = [tuple(r.values()) for r in rows(name)]
    assert len(set(got)) == len(got)


def test_leaks_are_all_found(rows, spark):
    items = [(r.item_id, leakage.plain_words(r.text)) for r in spark.read.parquet(f"{SF}/heldout_items.parquet").collect()]
    docs = [(r.doc_id, leakage.plain_words(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    want = set()
    for doc, ws in docs:
        held = set(ws)
        for item, own in items:
            # Words of an item that the document lacks cost an edit each, so most pairs need no look.
            lacking = sum(w not in held for w in own)
            if (lacking <= 2 and leakage.edits_inside(own, ws) <= 2) or (len(own) - lacking >= min(8, len(own)) and leakage.longest_run(own, ws) >= min(8, len(own))):
                want.add((doc, item))
    assert {(r["doc_id"], r["item_id"]) for r in rows("p6_found")} == want and want
    assert sum(r["n_documents"] for r in rows("p6_items")) == len(want)


def test_reports_agree_with_rows(rows):
    by_source = collections.Counter()
    for r in rows("p7_mixture"):
        by_source[r["source"]] += r["n_tokens"]
    assert {r["source"]: r["tokens"] for r in rows("p7_shares") if r["tokens"]} == dict(by_source)
    assert len({(r["doc_id"], r["repeat"]) for r in rows("p7_mixture")}) == len(rows("p7_mixture"))
    short = {(r["table_name"], r["category"]) for r in rows("p5_report") if not r["can_be_met"]}
    assert short == {(r["table_name"], r["category"]) for r in rows("p5_found")}
    drawn = collections.Counter((r["table_name"], c) for r in rows("p5_sample") for c in r["category"].split("\x1f"))
    assert all(drawn[r["table_name"], r["category"]] == r["drawn"] for r in rows("p5_report"))
    pairs = {r["dataset_id"]: 0 for r in rows("p1_by_dataset")}
    for r in rows("p1_by_dataset"):
        pairs[r["dataset_id"]] += r["n_pairs"] if r["defect"] != "none" else 0
    assert sum(pairs.values()) == len(rows("p1_found")) and all(n >= 0 for n in pairs.values())


def test_languages_agree(rows):
    spoken = collections.defaultdict(set)
    for r in rows("p8_segments"):
        spoken[r["doc_id"]].add(r["lang"])
    found = collections.defaultdict(set)
    for r in rows("p8_found"):
        found[r["doc_id"]].add(r["true_lang"])
    assert all(langs == spoken[d] for d, langs in found.items()) and {d for d, langs in spoken.items() if len(langs) > 1} <= set(found)
    assert {r["doc_id"]: r["lang"] in spoken[r["doc_id"]] for r in rows("p8_documents")} == dict.fromkeys(spoken, True)
