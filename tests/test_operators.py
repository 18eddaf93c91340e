"""Parsers, kernels and the engine on small texts."""

import re
import uuid
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from provspark import cli
from provspark.engine import Engine, SemanticUnavailable, StaleIndex, open_engine
from provspark.functions import classify, text
from provspark.functions.embed import HashEmbedding
from provspark.operators import extract, hybrid, identity, markdown, overlap, pack, planner, semantic
from provspark.operators.filters import FilterSet
from provspark.plans.snapshot import IndexGenerationChanged, Store
from provspark.sources import workspace as W


@pytest.mark.parametrize(
    "source, expected",
    [
        ("# A\n## B ##\ntext\n#nope\n", [(0, 1, "A"), (1, 2, "B")]),
        ("---\na: 1\n---\n# T\n", [(3, 1, "T")]),
        ("---\nbroken\n# T\n", [(2, 1, "T")]),
        ("Title\nmore\n=====\nx\n---\n", [(0, 1, "Title more"), (3, 2, "x")]),
        ("```\n# no\n```\n~~~~\n# no\n~~~\n# no\n~~~~\n# yes\n", [(8, 1, "yes")]),
        ("```\n# unclosed\n", []),
        ("> # quoted\n- # item\n\n      # code\n\n    # inside\n", [(0, 1, "quoted"), (1, 1, "item"), (5, 1, "inside")]),
        ("text\n\n    # code\n", []),
        ("a | b\n--|--\n# H\r\n", [(2, 1, "H")]),
        ("***\n# H\n* * *\n", [(1, 1, "H")]),
        ("", []),
    ],
)
def test_headings(source, expected):
    assert markdown.headings(source) == expected


def test_canonical_heading(spark):
    cases = {"Retry  Policy!": "retry-policy", "ＦＵＬＬ": "full", "Straße": "strasse", "§25 Security": "25-security", "🙂": "section", "Ελλάδα": "ελλάδα", None: "section"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r[0]: r[1] for r in df.select("h", text.canonical_heading(F.col("h"))).collect()} == cases


@pytest.mark.parametrize("source", ["word " * 5000, "", "short", "x" * 9000, "para\n\n```\ncode\n```\n" * 300, "émoji 🙂 " * 900])
def test_windows_cover_and_are_bounded(source):
    spans = markdown.cut_windows("A > B", source)
    covered = set()
    for a, b in spans:
        assert markdown.estimate(f"A > B\n\n{source[a:b]}") <= markdown.MOST_TOKENS
        covered |= set(range(a, b))
    assert covered == set(range(len(source)))
    assert all(x < y for (x, _), (y, _) in zip(spans, spans[1:]))


def test_classes(spark):
    q = "Fix RunManifest in a_b and CP-14 §2.1 with --flag, ns::x, a.py:run, E42_X1 at src/x/y 'quoted words' #anchor kebab-name"
    df = spark.createDataFrame([(q,)], "q string")
    got = df.select(*[classify.query_class(F.col("q"), n).alias(n) for n in classify.QUERY_CLASSES]).first()
    assert got["camel_case"] == ["RunManifest"] and got["snake_case"] == ["a_b"] and got["checkpoint_ids"] == ["CP-14"]
    assert got["cli_flags"] == ["--flag"] and got["paths"] == ["src/x/y"] and got["quoted_phrases"] == ["quoted words"] and "kebab-name" in got["kebab_case"]
    assert df.select(classify.structural_terms(F.col("q"))).first()[0][0] == "CP-14"


def test_extraction():
    assert [s["origin"] for s in extract.symbols("RunManifest `RunManifest`\n```\nRunManifest\n")] == ["PROSE", "INLINE_CODE", "CODE"]
    fields = extract.checkpoint_fields("CP-1", "Goal: g\nTests:\n- a\n- b\nOther: x\n**Verify**: v")
    assert [(f["field"], f["value"]) for f in fields] == [("goal", "g"), ("tests_acceptance_criteria", "a"), ("tests_acceptance_criteria", "b"), ("verify", "v")]
    said = extract.assertions("CP-3", "The cache must not retry jobs. The cache must retry jobs; see\n```\nx must fail\n```\n")
    assert [(a["subject"], a["property"], a["polarity"]) for a in said] == [("cache", "retry-job", -1), ("cache", "retry-job", 1)]


def test_hash_embedding():
    v = HashEmbedding(16).embed_documents(["a b c", "", "a b c"])
    assert np.allclose(v[0], v[2]) and np.isclose(np.linalg.norm(v[0]), 1) and not v[1].any()


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(semantic.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def _hits(rows):
    return pd.DataFrame(rows, columns=["channel", "rank", "boost", "section", "path", "start", "end", "authority", "priority", "sha256", "text"])


def test_fusion_and_diversity():
    rows = [("structural", 1, 0.0, "s1", "a", 0, 100, 4, 0, "h1", "alpha beta"), ("bm25", 1, 0.0, "s1", "a", 50, 90, 4, 0, "h2", "beta"), ("semantic", 2, 0.0, "s2", "b", 0, 10, 1, 0, "h3", "other words")]
    fused = hybrid.fuse(_hits(rows))
    assert fused.iloc[0].section == "s1" and fused.iloc[0].channels == "structural,bm25" and np.isclose(fused.iloc[0].score, 2 / 61)
    many = _hits([("bm25", n, 0.0, f"s{n // 5}", f"d{n // 5}", n * 10, n * 10 + 5, 0, 0, f"h{n}", f"text number {n} " + "x" * n) for n in range(20)])
    kept = hybrid.diversify(many, 12)
    assert kept.groupby("section").size().max() <= 3 and kept.section.nunique() == 4
    assert len(hybrid.diversify(_hits([rows[0], (*rows[0][:3], "s9", "z", 0, 5, 0, 0, "h1", "alpha beta")]), 5)) == 1


def test_jaccard_pairs_are_exact(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(30)]
    sets = [(i, [w for w in base if rng.random() > 0.08] + [f"u{i}"] * int(rng.random() > 0.5)) for i in range(40)] + [(99, []), (100, base), (101, base)]
    got = {(r["a"], r["b"]) for r in overlap.jaccard_pairs(spark.createDataFrame(sets, "id long, items array<string>"), 0.85).collect()}
    reps = {}
    for i, x in sets:
        if x:
            reps.setdefault(frozenset(x), i)
    ids = sorted(((i, s) for s, i in reps.items()), key=lambda z: z[0])
    assert got == {(i, j) for n, (i, x) in enumerate(ids) for j, y in ids[n + 1 :] if len(x & y) / len(x | y) >= 0.85}


def test_identity(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "9"), ("e", "9")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("moved", "3"), ("f", "9"), ("g", "5")], "path string, sha256 string")
    got = {(r["path"], r["old_path"], r["status"]) for r in identity.plan_identity(old, new).collect()}
    assert got == {("a", "a", "unchanged"), ("b", "b", "changed"), ("moved", "c", "renamed"), ("f", None, "added"), ("g", None, "added"), (None, "d", "removed"), (None, "e", "removed")}


def test_filters(spark):
    rows = spark.createDataFrame([(1, "docs/A/x.md", 4, "a/b"), (2, "docs/b/y.md", 0, "ab")], "doc_id long, path string, authority int, heading_path_key string")
    keep = lambda **f: [r[0] for r in FilterSet(**f).apply(rows).collect()]
    assert keep() == [1, 2] and keep(scope="DOCS/a/") == [1] and keep(heading_prefix=("a",)) == [1] and keep(documents=frozenset({"2"})) == [2]
    assert keep(exclude_documents=frozenset({"docs/A/x.md"})) == [2] and keep(authority_floor=1) == [1] and keep(authorities=frozenset({0})) == [2]


def test_pack_budget():
    items = [{"id": "p", "text": "x" * 90, "required": True, "primary": True}, {"id": "q", "text": "y" * 900, "required": True}, {"id": "r", "text": "z" * 900, "excerpt": "z" * 30, "required": False}]
    packed = pack.fill(items, 160)
    assert [i["id"] for i in packed.items] == ["p", "r"] and packed.omitted == ["q"] and packed.tokens <= 160
    with pytest.raises(pack.ContextBudgetTooSmall):
        pack.fill(items, 5)


@pytest.mark.parametrize("bad", ["", "/a.md", "../a.md", "a//b.md", "C:/a.md", "a\0.md", "."])
def test_paths(bad):
    with pytest.raises(W.ConfigError):
        W.normalize_path(bad)


DOC = "# Platform\nThe RunManifest.\n## CP-14 - Manifest\nGoal: build\nDependencies: CP-13\n### Security\nThe cache must not retry jobs.\n## CP-13\nThe cache must retry jobs.\n"


def test_engine(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(DOC.encode())
    (tmp_path / "b.md").write_bytes(b"Other\r\n=====\r\nnetwork stabilization\r\n")
    e = Engine(spark, tmp_path)
    e.init()
    e.add("a.md", 4)
    e.add("b.md")
    first = e.sync()
    assert first["documents_added"] == 2 and first["embeddings_created"] == e.chunk_count() and first["index_generation"] == 1
    assert e.sync() == {"index_generation": 1, "documents_unchanged": 2}
    sections = e.store.table("sections").orderBy("ordinal").collect()
    assert "".join(s["source_text"] for s in sections if s["path"] == "a.md") == DOC
    assert "".join(s["source_text"] for s in sections if s["path"] == "b.md").encode() == (tmp_path / "b.md").read_bytes()
    assert e.search("network stabilization", 3).orderBy("rank").first()["path"] == "b.md"
    assert {r["label"] for r in e.dependencies(next(s["id"] for s in sections if s["heading"].startswith("CP-14"))).collect()} == {"CP-13"}
    assert e.find_symbol("runmanifest").count() == 1
    p = e.context_pack("Implement CP-14", 3000)
    assert p["status"] == "CONFLICTING" and p["tokens"] <= 3000 and any("must not retry" in i["text"] for i in p["items"])
    assert e.lines("a.md", 2, 3).count() == 2
    (tmp_path / "b.md").write_text("# New\n")
    with pytest.raises(StaleIndex):
        e.outline("b.md")
    again = e.sync()
    assert (again["documents_changed"], again["documents_unchanged"], again["index_generation"]) == (1, 1, 2)
    assert e.outline("b.md").first()["heading"] == "New" and e.generation_log().count() == 2


class Counting(HashEmbedding):
    """Writes down what it is asked to embed."""

    def __init__(self, folder, name="counting:1"):
        super().__init__(16)
        self.folder, self.identity = folder, name

    def embed_documents(self, texts):
        (self.folder / uuid.uuid4().hex).write_text("\n".join(texts))
        return super().embed_documents(texts)


def test_sync_is_incremental(spark, tmp_path):
    root, seen = tmp_path / "w", tmp_path / "seen"
    root.mkdir(), seen.mkdir()
    for n in range(4):
        (root / f"d{n}.md").write_text(f"# Document {n}\ntext number {n}\n## Part\nmore of {n}\n")
    make = partial(Counting, seen)
    e = Engine(spark, root, make)
    e.init()
    for n in range(4):
        e.add(f"d{n}.md")

    def asked():
        found = sorted(p.read_text() for p in seen.iterdir())
        [p.unlink() for p in seen.iterdir()]
        return "\n".join(found)

    e.sync()
    assert asked().count("text number") == 4
    before = {r["path"]: (r["doc_id"], r["id"]) for r in e.store.table("sections").where("level = 1").collect()}
    (root / "d1.md").write_text("# Document 1\nanother text\n## Part\nmore of 1\n")
    (root / "d2.md").rename(root / "moved.md")
    e.rename("d2.md", "moved.md")
    got = e.sync()
    assert (got["documents_changed"], got["documents_renamed"], got["documents_unchanged"]) == (1, 1, 2)
    assert (got["embeddings_created"], got["embeddings_retained"]) == (1, 7) and (got["sections_changed"], got["sections_unchanged"]) == (1, 7)
    asked_now = asked()
    assert "another text" in asked_now and "number" not in asked_now and "more of" not in asked_now
    after = {r["path"]: (r["doc_id"], r["id"]) for r in e.store.table("sections").where("level = 1").collect()}
    assert after["moved.md"] == before["d2.md"] and after["d1.md"] == before["d1.md"]  # ids survive a rename
    assert e.report()["category"] == "CLEAN" and "semantic" in e.report()["channels"]
    # another provider: nothing is mixed, all is embedded anew
    other = Engine(spark, root, partial(Counting, seen, "counting:2"))
    assert other.report()["category"] == "EMBEDDINGS_STALE"
    with pytest.raises(SemanticUnavailable, match="IDENTITY_MISMATCH"):
        other.search_semantic("text")
    assert other.sync()["embeddings_created"] == 8 and other.report()["category"] == "CLEAN"
    assert open_engine(spark, root, lambda: 1 / 0).search("another", 2).count() > 0
    with pytest.raises(SemanticUnavailable, match="PROVIDER_UNAVAILABLE"):
        open_engine(spark, root, lambda: 1 / 0, require_semantic=True)
    (root / "d0.md").unlink()
    assert other.report()["category"] == "MISSING_SOURCE"
    (root / "d3.md").write_text("# x\n")
    assert {r["category"] for r in other.report()["reasons"]} >= {"MISSING_SOURCE", "SOURCE_STALE"}


def test_carriage_returns(spark):
    text = "a\r# H\rtext\r\n\r## K\nx"
    d = spark.createDataFrame([("d", text), ("e", "one\rtwo\r")], "doc_id string, text string")
    rows = markdown.section_text(markdown.sections(d), d).orderBy("doc_id", "ordinal").collect()
    assert [r["source_text"] for r in rows] == ["a\r", "# H\rtext\r\n\r", "## K\nx", "one\rtwo\r"]
    got = [tuple(r) for r in markdown.subtree(markdown.sections(d)).collect()]
    assert got == [("d", 1, 2)]


PLATFORM = "# Platform\nOverview of it.\n## CP-7 - Queue\nGoal: bounded queue\nDependencies: CP-6, QueueModel\nVerify: run checks\n### Security\nThe queue must sign messages.\n### Tests\nround trip raises QueueTimeout\n## CP-6 - Store\nGoal: keep rows\n"
MODELS = "# Models\n## QueueModel\nmodel QueueModel has fields.\n## Worker\nUses QueueModel often.\n## Architecture\nQueues are bounded in size.\n"
POLICY = "# Retry policy\nThe queue must keep messages in order and bounded.\n# Archive notes\nOld queue ideas.\n"


@pytest.fixture(scope="module")
def planned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("planned")
    e = Engine(spark, root)
    e.init()
    for name, text, authority in (("platform.md", PLATFORM, 4), ("models.md", MODELS, 4), ("policy.md", POLICY, 4), ("notes.md", "# Notes\nCP-7 is discussed, see CP-99.\n", 1)):
        (root / name).write_text(text)
        e.add(name, authority)
    e.sync()
    return e


def test_graph_of_types_and_dependencies(planned):
    ids = {r["heading"]: r["id"] for r in planned.store.table("sections").collect()}
    edges = {(r["source"], r["edge_type"], r["label"]): (r["status"], r["targets"]) for r in planned.store.table("edges").collect()}
    queue = ids["CP-7 - Queue"]
    assert edges[queue, "DEPENDS_ON", "CP-6"] == ("RESOLVED", ids["CP-6 - Store"])
    assert edges[queue, "DEPENDS_ON", "QueueModel"] == ("RESOLVED", ids["QueueModel"])
    assert edges[ids["Worker"], "USES_TYPE", "QueueModel"] == ("RESOLVED", ids["QueueModel"])
    assert (ids["QueueModel"], "USES_TYPE", "QueueModel") not in edges and edges[ids["Notes"], "REFERENCES", "CP-99"][0] == "UNRESOLVED"
    found = {r["label"]: r for r in planned.dependencies(queue).collect()}
    assert found["CP-6"]["target"]["heading"] == "CP-6 - Store" and found["QueueModel"]["candidates"][0]["path"] == "models.md"
    assert {r["source"] for r in planned.references(ids["QueueModel"], incoming=True).collect()} >= {queue, ids["Worker"]}
    assert extract.dependency_labels("Dependencies", "Dependencies\n- CP-1\n- a::b") == ["a::b", "CP-1"]
    assert extract.dependency_labels("x", "x\nDependencies:\n- CP-2\n- section 3\n\nCP-9") == ["CP-2", "section 3"]


def test_lexical_boosts(planned):
    rows = planned.search_lexical("QueueModel", 5).orderBy("rank").collect()
    assert rows[0]["heading"] == "QueueModel" and rows[0]["matched_terms"] == ["QueueModel"]
    assert planned.search_lexical("   ").count() == 0
    top = planned.search("CP-7", 5).orderBy("rank").first()
    assert top["score"] > 12  # the heading holds the checkpoint that was asked for


def test_context_pack(planned):
    p = planned.context_pack("Implement CP-7", 9000)
    by_category = {c["category"]: c["status"] for c in p["coverage"]}
    assert p["status"] == "COMPLETE" and p["items"][0]["required"] and "CP-7" in p["items"][0]["text"]
    assert [by_category[c] for c in ("PRIMARY", "DEPENDENCIES", "SECURITY", "ACCEPTANCE", "ARCHITECTURE", "CHECKPOINT_DESCENDANTS")] == ["COVERED"] * 6
    assert any(i["category"] == "explicit_dependency" and "CP-6" in i["text"] for i in p["items"])
    small = planned.context_pack("Implement CP-7", 400)
    assert small["status"] == "PARTIAL" and small["omissions"] and small["tokens"] <= 400
    filtered = planned.context_pack("Implement CP-7", 9000, FilterSet(documents=frozenset({"platform.md"})))
    assert any("filters" in o["reason"] for o in filtered["omissions"])
    free = planned.context_pack("messages in order", 9000)
    assert free["checkpoints"] == [] and any("in order" in i["text"] for i in free["items"])


def test_strict_discovery(planned):
    c = planner._checkpoint(planned, "CP-7", None)
    found = planner.strict_discovery(planned, "Implement CP-7 bounded queue", [c], {s["id"] for s in c["sections"]})
    by_heading = {d["section"]["heading"]: d for d in found}
    assert by_heading["Retry policy"]["coverage"] == "NORMATIVE" and not by_heading["Retry policy"]["optional"]
    assert by_heading["Architecture"]["category"] == "interface_or_model"
    assert all(d["section"]["path"] != "notes.md" for d in found)
    p = planned.context_pack("Implement CP-7 bounded queue", 9000, strict=True)
    assert any("strict discovery" in i["reason"] for i in p["items"])


def test_checkpoint_context(planned):
    c = planned.checkpoint_context("cp-7")
    assert c["errors"] == ["QueueTimeout"] and c["verify"] == ["run checks"] and "QueueModel" in c["interfaces"].values()
    assert {e["label"] for e in c["dependencies"]} == {"CP-6", "QueueModel"} and c["security"] and c["context_pack"]["checkpoints"] == ["CP-7"]
    with pytest.raises(ValueError):
        planned.checkpoint_context("CP-1234")


def test_discovery_signals():
    found = planner.discovery_signals("Build it well", [{"title": "Queue title", "fields": {"goal": ["keep order"], "why": ["keep order"]}, "sections": [{"source_text": "# X\n- The queue must sign.\nplain line\n"}]}])
    assert found == [("Build it well", "task"), ("Queue title", "checkpoint_title"), ("keep order", "goal"), ("The queue must sign.", "normative_requirement")]
    assert planner.is_material(True, False, 1, -1, 1) and not planner.is_material(False, False, 1, 0.5, 1) and planner.is_material(False, False, 0, 0.53, 2)
    assert planner.match_excerpt("a\n" * 900 + "needle here\n" + "b\n" * 900, "the needle").count("needle") == 1


def test_store_refuses_a_second_writer(spark, tmp_path):
    store = Store(spark, tmp_path)
    df = spark.range(3)
    assert store.commit({"t": df}, {}, 0) == 1
    with pytest.raises(IndexGenerationChanged):
        store.commit({"t": df}, {}, 0)
    one, two = store.writer(1), store.writer(1)
    one.write("t", spark.range(5)), two.write("t", spark.range(7))
    assert two.commit({}) == 2
    with pytest.raises(IndexGenerationChanged):
        one.commit({})
    assert store.table("t").count() == 7 and store.table("t", 1).count() == 3 and store.prune(1) == 1


def test_cli_arguments():
    a = cli.parser().parse_args(["--root", "/x", "pack", "do it", "--budget", "9"])
    assert (a.command, a.task, a.budget) == ("pack", "do it", 9)
    assert re.match(r"lines", cli.parser().parse_args(["lines", "a.md", "1", "2"]).command)


def test_entry_without_the_training_data_operators(monkeypatch):
    import __spark_entry__ as entry

    def missing(name):
        raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert "bm25_topk_batch" in entry.queries() and "pipeline" not in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _windows_and_queries(spark):
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["the"] * 30
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for i in range(700)}
    texts |= {i: texts[i - 300] for i in range(900, 960)}  # copies tie
    rows = [(i // 5, i % 5, f"p{i // 5:03}", t) for i, t in texts.items()]
    queries = [(q, sorted({rng.choice(words) for _ in range(n)}), texts[q * 9][:40]) for q, n in enumerate((1, 3, 8, 20, 40))]
    queries += [(8, ["absent"], "absent"), (9, [], None)]
    return rows, spark.createDataFrame(rows, "doc_id long, ordinal long, path string, chunk string").coalesce(3), queries, spark.createDataFrame(queries, "query_id long, terms array<string>, phrase string")


def test_bm25_search_keeps_postings_where_they_are(spark, monkeypatch):
    """The same as by joined postings, ties too; nothing but the tasks' best rows and the counts is dealt out."""
    from provspark.operators import lexical

    rows, windows, queries, table = _windows_and_queries(spark)
    order = [("path", False), ("ordinal", False)]
    terms = table.selectExpr("query_id", "explode(terms) AS term")
    old = lexical.top_k(lexical.score(lexical.build_postings(windows, ["doc_id", "ordinal"], ["path"]), terms), 10, ["path", "ordinal"])
    plain = lambda df: sorted((r["query_id"], r["doc_id"], r["ordinal"], round(r["score"], 6), r["rank"]) for r in df.collect())
    found = lexical.search(windows, table.drop("phrase"), 10, order, ["doc_id", "ordinal", "path"])
    expected = plain(old)
    assert plain(found) == expected
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
    assert plain(lexical.search(windows, table.drop("phrase"), 10, order, ["doc_id", "ordinal", "path"])) == expected
    exact = lexical.search(windows, table.withColumn("terms", F.lit(None).cast("array<string>")), 5, order, ["doc_id", "ordinal", "path"])
    want = [(q, d, o, 2.0, k + 1) for q, _, p in queries if p is not None for k, (_, o, d) in enumerate(sorted((path, o, d) for d, o, path, t in rows if p in t)[:5])]
    assert plain(exact) == sorted(want)


def test_texts_are_embedded_where_they_are_scored(spark):
    """The same as over vectors; no Python column function, whose queue of waiting rows holds the texts on disk."""
    from provspark.functions.embed import embedder

    rows, windows, queries, _ = _windows_and_queries(spark)
    windows = windows.unionByName(spark.createDataFrame([(900, 0, "z", None)], windows.schema)).select("doc_id", "ordinal", "path", F.col("chunk").alias("embedding"))
    q = spark.createDataFrame([(n, p) for n, _, p in queries if p], "query_id long, q string").withColumn("q", embedder(HashEmbedding)("q"))
    vectors = windows.withColumn("embedding", embedder(HashEmbedding)("embedding"))
    got = semantic.search(q, windows, 5, ["path", "ordinal"], HashEmbedding)
    plain = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["ordinal"], round(r["score"], 6)) for r in df.collect())
    assert plain(got) == plain(semantic.search(q, vectors, 5, ["path", "ordinal"]))
    assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_span_cap_of_whole_groups(spark):
    from provspark.operators import fusion, lexical

    _, windows, _, table = _windows_and_queries(spark)
    windows = windows.repartition(3, "doc_id").sortWithinPartitions("doc_id", "ordinal")
    hits = lexical.score(lexical.build_postings(windows, ["doc_id", "ordinal"], ["path"]), table.selectExpr("query_id", "explode(terms) AS term"))
    want = fusion.span_cap(hits, ["query_id", "doc_id"], 3, [F.round("score", 6).desc(), "ordinal"]).select("query_id", "doc_id", "ordinal", "in_group")
    got = lexical.span_cap(windows, table.drop("phrase"), 3, "doc_id", ["doc_id", "ordinal"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_jaccard_pairs_rank_no_items_by_a_shuffle(spark):
    """Items are ordered inside a set's row; a window over all sets' items would deal all of them out."""
    from provspark.operators import overlap

    sets = [(i, [f"{i}-{j}" for j in range(400)]) for i in range(50)]
    sets += [(100, [f"x{j}" for j in range(100)]), (101, [f"x{j}" for j in range(96)]), (102, [f"x{j}" for j in range(100)]), (103, [])]
    got = overlap.jaccard_pairs(spark.createDataFrame(sets, "id long, items array<string>"), 0.92)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["a"], r["b"], round(r["jaccard"], 6)) for r in got.collect()] == [(100, 101, 0.96)]


def _brute_pairs(sets, threshold):
    least = {}
    for i, x in sets:
        if x:
            least[frozenset(x)] = min(i, least.get(frozenset(x), i))
    both = [(i, j, len(x & y) / len(x | y)) for x, i in least.items() for y, j in least.items() if i < j]
    return sorted((i, j, round(s, 9)) for i, j, s in both if s >= threshold - 1e-12)


def _jaccard_pairs(spark, sets, threshold):
    found = overlap.jaccard_pairs(spark.createDataFrame(sets, "id long, items array<string>"), threshold)
    return sorted((r["a"], r["b"], round(r["jaccard"], 9)) for r in found.collect())


def test_jaccard_pairs_deal_out_sets_not_pairs(spark):
    """A cluster of n alike sets has n * n pairs; its items go out once a set, not once or twice a pair."""
    rng = np.random.default_rng(5)
    base = [uuid.UUID(bytes=rng.bytes(16)).hex for _ in range(300)]
    sets = [(i, [w for w in base if rng.random() > 0.01] + [f"u{i}"]) for i in range(120)]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as of large tables
    try:
        got = _jaccard_pairs(spark, sets, 0.92)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 120 * 119 // 2 and got == _brute_pairs(sets, 0.92)
    assert written() - before < 3 * sum(len(w) for _, x in sets for w in x)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.92, 1.0])
@pytest.mark.parametrize("group", [1, 4, 512])
def test_jaccard_pairs_in_parts_and_groups(spark, monkeypatch, threshold, group):
    monkeypatch.setattr(overlap, "GROUP", group)
    rng = np.random.default_rng(group)
    bases = [[f"{b % 4}-{i}" for i in range(n)] for b, n in enumerate([1, 2, 5, 12, 13, 25, 26, 40, 60])]
    sets = [(1000 - i, [w for w in bases[i % 9] if rng.random() > 0.06] + [f"u{i}"] * int(rng.random() > 0.7)) for i in range(180)]
    sets += [(5000 + i, sets[i][1][::-1]) for i in range(0, 180, 7)] + [(-1, None)]
    assert _jaccard_pairs(spark, sets, threshold) == _brute_pairs(sets, threshold)


def test_jaccard_pairs_of_items_with_one_hash(spark):
    """Items that are equal in 32 bits are still told apart."""
    words = spark.range(200_000).select(F.concat(F.lit("w"), "id").alias("w")).groupBy(F.hash("w").alias("h")).agg(F.collect_list("w").alias("ws")).where("size(ws) > 1").head(3)
    rest = [f"r{i}" for i in range(23)]
    sets = [(2 * n + i, [*(f"{n}{w}" for w in rest), r["ws"][i]]) for n, r in enumerate(words) for i in (0, 1)]
    sets += [(100, [*rest, *words[0]["ws"][:2]]), (101, [*rest, words[0]["ws"][1]]), (102, [*rest, words[0]["ws"][0], "z"])]
    assert words and _jaccard_pairs(spark, sets, 0.92) == _brute_pairs(sets, 0.92) != []


def test_similar_sets_with_one_key_are_each_compared():
    """Different sets that are equal in the 64 bits of their key are rows of their own; a row that came twice counts once."""
    import pyarrow as pa

    items = [["a", "b", "c"], ["a", "b", "c", "d"], ["a", "b", "c"], ["x"], ["a", "b", "c", "e"]]
    sets = pa.table({"k": [1, 2, 1, 1, 2], "id": [10, 20, 10, 11, 21], "items": pa.array(items)})
    got = overlap._compared(0.75)(sets, pa.table({"ka": [1], "kb": [2]}))
    assert sorted(map(tuple, got.to_pandas().values.tolist())) == [(10.0, 20.0, 0.75), (10.0, 21.0, 0.75)]
