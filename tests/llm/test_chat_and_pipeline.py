import random

import pytest

import corpus_pipeline
from provspark.llm import chat_format as C

from .fixtures import corpus, empty, frame, words

A, U = "assistant", "user"


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def mask(turns):
        at, spans = 0, []
        for r, t in turns:
            begin = at + len(f"<|im_start|>{r}\n")
            at = begin + len(t) + len("<|im_end|>\n")
            if r == A:
                spans.append(f"{begin}-{at - 1}")
        return ",".join(spans)

    c, r = chosen[n:], rejected[n:]
    return (n, render(chosen[:n]), render(c), render(r), mask(c), mask(r))


def test_pairs_match_brute_force(spark):
    rng = random.Random(2)
    conv = lambda: [(rng.choice([U, A]), rng.choice(["x", "y y", "é"])) for _ in range(rng.randint(0, 5))]
    pairs = [(i, conv(), conv()) for i in range(80)] + [(100, [(U, "q"), (A, "r")], [(U, "q"), (A, "r")]), (101, None, [(A, "z")])]
    df = spark.createDataFrame(pairs, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r["pair_id"]: tuple(r)[1:] for r in C.format_pairs(df).collect()}
    assert got == {i: brute(a or [], b or []) for i, a, b in pairs}


def test_conversations(spark):
    rows = [(1, 0, U, "hi"), (1, 1, A, "yes"), (1, 2, U, "more"), (2, 0, None, "<|im_start|>"), (2, 1, A, None), (3, 0, U, "alone"), (None, 0, A, "x"), (4, 0, U, "hi"), (4, 1, A, "yes"), (4, 1, A, "yes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n_common", "'p' as prompt")
    got = {r["conv_id"]: r for r in C.preference_query(df).collect()}
    assert sorted(got) == [1, 2, 4]
    assert got[4]["chosen"] == render([(A, "yes")]) and got[4]["rejected"] == render([(A, "")]) and got[4]["n_common"] == 2
    assert got[2]["prompt"] == "<|im_start|>unknown\n<| im_start|><|im_end|>\n" and got[2]["rejected"] == render([(A, "yes")])
    assert got[1]["n_common"] == 2 and got[1]["chosen"] == ""  # the next reply is the same
    assert C.preference_query(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = corpus(120, 29)
    texts = [t for _, t in rows if t and len(words(t)) > 60]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(words(texts[2])[5:30]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages_match_brute_force(spark, tables):
    from .test_near_dedup import brute_classes
    from .test_texts import brute_contamination, brute_lines

    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, folder)
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {i for i, _ in before}
            break
        assert out.columns == columns
        out.write.parquet(path := f"{folder}/stage{n}")
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":  # one language: only texts without letters can go
            assert {i for i, t in before if t and any(c.isalpha() for c in t)} <= set(after)
            assert all(any(c.isalpha() for c in t) for t in after.values())
        elif name == "line_dedup":
            import hashlib

            kept = {i: h for i, _, dropped, h in brute_lines(before)}
            assert all(hashlib.sha256(t.encode()).hexdigest() == kept[i] for i, t in after.items())
            assert {i for i, t in before} - set(after) == {i for i, _, dropped, h in brute_lines(before) if dropped and h == hashlib.sha256(b"").hexdigest()}
        elif name == "near_dedup":
            classes = brute_classes(before)
            assert set(after) == set(classes.values())
        else:
            bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert set(after) == {r[0] for r in brute_contamination(before, bench) if not r[5]} and len(after) < len(before)


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).count() > 0


def test_stages_on_an_empty_table(spark, tables):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables[0])
        assert out.count() == 0
