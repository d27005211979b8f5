import duckdb
import pytest
from pyspark.sql import functions as F

from riskline.llm import quality, queries
from tests.llm import corpus


def repeated_words(text):
    w = corpus.WORD.findall(text or "")
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    return len({i + k for starts in at.values() if len(starts) > 1 for i in starts for k in range(8)})


def test_measurements_equal_brute_force(spark):
    found = corpus.rows(6) + [(900, "a b c d e f g h " * 9, "s"), (901, "#$ %\n#$ %\n\n \nx", "s")]
    got = quality.ledger(corpus.frame(spark, found).select("doc_id", "text", "size", "row")).collect()
    want = []
    for id, t, _ in found:
        t = t or ""
        lines = [x for x in t.split("\n") if corpus.WORD.search(x)]
        w = corpus.WORD.findall(t)
        want.append((id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), repeated_words(t)))
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)


def test_policies_and_ablation(spark):
    rows = [(1, "w " * 5, "s"), (2, " ".join(map(str, range(1000, 1040))), "s"), (3, "x y " * 30, "s"), (4, " ".join(f"&&&{i}" for i in range(1000, 1030)), "s")]
    docs = corpus.frame(spark, rows)
    entries = quality.ledger(docs)
    bits = {r.doc_id: r.fail_bits for r in entries.collect()}
    assert bits == {1: 1 | 16, 2: 0, 3: 2 | 16, 4: 4}
    assert sorted(r.doc_id for r in entries.where(quality.verdict("base")).collect()) == [2, 4]
    alone = {r.rule: (r.failed, r.only_by_this) for r in quality.ablation(entries, "base").collect()}
    assert alone == {"few_words": (1, 1), "repeated_windows": (1, 1)}
    assert quality.passing(docs).columns == docs.columns
    assert [r.doc_id for r in quality.passing(docs).collect()] == [2]
    assert quality.ledger(docs.limit(0)).collect() == []


def test_no_python_and_no_shuffle(spark):
    plan = quality.ledger(corpus.frame(spark, [(1, "a", "s")], 1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") <= 1


@pytest.mark.parametrize("name", ["op2_source_mix", "op7_quality_ledger"])
def test_sql_agrees(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, folder).select(*[F.col(c) for c in want.columns]).toPandas()
    key = list(want.columns)
    assert got.sort_values(key).to_numpy().tolist() == want.sort_values(key).to_numpy().tolist()
