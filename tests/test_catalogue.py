"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from provspark.plans import catalogue, spec  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    result = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    expected = Counter(tuple(map(plain, r)) for r in result.fetchall())
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def brute_cosine(rows, allowed):
    v = np.array([r["embedding"] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = set()
    for i, r in enumerate(rows):
        if r["vec_id"] % 20 == 0:
            best = sorted((-round(float(s), 6), o["vec_id"]) for s, o in zip(v @ v[i], rows) if o["label"] in allowed)[:10]
            out |= {(r["vec_id"], b, round(-s, 5), n + 1) for n, (s, b) in enumerate(best)}
    return out


def test_cosine_of_every_twentieth_row(spark, monkeypatch):
    from provspark.operators import semantic

    monkeypatch.setattr(semantic, "QUERY_BLOCK", 7)
    monkeypatch.setattr(semantic, "VECTOR_BLOCK", 90)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    for name, allowed in (("cosine_topk_batch", {r["label"] for r in rows}), ("cosine_topk_blocks", {r["label"] for r in rows}), ("cosine_label_filtered", {1, 2})):
        got = {(r["query_id"], r["vec_id"], round(r["score"], 5), r["rank"]) for r in catalogue.QUERIES[name](spark, SF).collect()}
        assert got == brute_cosine(rows, allowed)


def test_bm25_of_all_tokens(spark, duck):
    token = re.compile(r"[\w.@:-]+")
    windows = [Counter(r["ts"]) for r in catalogue._windows(spark, SF).select(catalogue.V.tokens(catalogue.F.col("chunk")).alias("ts")).collect()]
    mean = sum(sum(w.values()) for w in windows) / len(windows)
    df = Counter(t for w in windows for t in w)
    got = {(r["query_id"], r["rank"]): r["score"] for r in catalogue.QUERIES["bm25_topk_batch_whole"](spark, SF).collect()}
    expected = {}
    for item, text in duck.execute("SELECT item_id, text FROM benchmark").fetchall():
        terms = set(token.findall(text.lower()))
        scores = []
        for ts in windows:
            n = sum(ts.values())
            if hit := [t for t in terms if t in ts]:
                scores.append(sum(max(math.log((len(windows) - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * ts[t] * 2.2 / (ts[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t in hit))
        expected |= {(item, k + 1): s for k, s in enumerate(sorted(scores, reverse=True)[:10])}
    assert got == pytest.approx(expected, abs=2e-6)


def test_versioned_symbols_of_all_documents(spark, tmp_path):
    from provspark.functions.patterns import SYMBOLS

    texts = ["net.remove@1 and net.remove@1", "café: net.remove@1, café_x@22 été@3", "señal v.w-x@4 日本@5 a日@6", "plain", "é", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'src1' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, spec.symbol_extract_versioned(spark, str(tmp_path)).collect()))
    assert got == Counter((i, s) for i, t in enumerate(texts) for s in set(re.findall(SYMBOLS["versioned"], t or "")))
    assert {i for i, _ in got} == {0, 1, 2}


def test_spec_queries_read_the_tables(spark, tmp_path):
    texts = ["# Storage\n## CP-77 - Custom\nDependencies: CP-14\nThe cache must keep entries.\n", "no heading, class FooBarTimeout\n", "# Alpha\nThe cache must not keep entries.\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'src1' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 0, "user", "see CP-77"), (5, 1, "assistant", "raise QuotaError")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    own = {f"docs/src1/{i}.md" for i in range(3)} | {"conversations/5.md"}
    assert {r["path"] for r in run("spec_sections")} == own | {p for p, *_ in spec.SPEC}
    assert own <= {r["path"] for r in run("spec_windows")}
    assert {"CP-77", "FooBarTimeout", "QuotaError"} <= {r["symbol"] for r in run("graph_symbols")}
    edges = {(r["edge_type"], r["label"], r["status"]) for r in run("graph_edges")}
    assert {("REFERENCES", "CP-77", "RESOLVED"), ("DEPENDS_ON", "CP-14", "RESOLVED")} <= edges
    assert ("DEPENDS_ON", "CP-14") in {(r["edge_type"], r["label"]) for r in run("dependencies")}
    assert "CP-77" in {r["checkpoint_id"] for r in run("checkpoint_fields")}
    said = {(f"{r['path']}#{r['ordinal']}", r["family"], r["subject"], r["property"], r["polarity"]) for r in run("assertion_extract")}
    pairs = sorted({(x[0], y[0], *x[1:4]) for x in said for y in said if x[0] < y[0] and x[1:4] == y[1:4] and x[4] == -y[4]})
    assert [tuple(r) for r in run("conflict_pairs")] == pairs[:10]
    assert any(a.startswith("docs/") for a, *_ in pairs)


def test_first_conflicts_of_a_large_subject(spark):
    import random

    from provspark.operators import pack

    rng = random.Random(2)
    rows = sorted({(f"i{rng.randrange(300):03}", "modal", rng.choice([-1, 1]), f"s{rng.randrange(3)}", "p") for _ in range(500)})
    rows = [r for r in rows if r[2] == 1 or r[0] > "i200" or r[0] < "i004"]
    brute = sorted({(x[0], y[0], x[1], x[3], x[4]) for x in rows for y in rows if x[0] < y[0] and (x[1], *x[3:]) == (y[1], *y[3:]) and x[2] == -y[2]})
    got = pack.conflict_pairs(spark.createDataFrame(rows, "item string, family string, polarity int, subject string, property string")).collect()
    assert [tuple(r) for r in got] == brute[:10]


def test_result_does_not_depend_on_partitions(spark):
    first = sorted(map(tuple, catalogue.bm25_topk_batch(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(tuple, catalogue.bm25_topk_batch(spark, SF).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
