import io
import json

import pytest

from provspark.engine import Engine
from provspark.server import answer, serve
from provspark.sources import artifacts
from provspark.sources.workspace import ConfigError


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("workspace")
    (root / "a.md").write_text("# Alpha\nbeta gamma\n")
    e = Engine(spark, root)
    e.init()
    e.add("a.md")
    e.sync()
    return e


def test_requests(engine):
    lines = [{"id": 1, "tool": "document_outline", "arguments": {"path": "a.md"}}, {"id": 2, "tool": "nothing"}, {"id": 3, "tool": "search_exact", "arguments": {"query": "Alpha"}}, {"id": 4, "tool": "search", "arguments": {}}]
    sink = io.StringIO()
    serve(engine, io.StringIO("\n".join(map(json.dumps, lines)) + "\nnot json\n"), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert got[0]["result"][0]["heading"] == "Alpha" and got[2]["result"][0]["match_rank"] == 0
    assert all(got[n]["error"]["type"] == "InvalidRequest" for n in (1, 3, 4))


def test_bounds(engine):
    assert answer(engine, {"id": 1, "tool": "list_documents"}, max_chars=20)["error"]["type"] == "ValueError"
    many = {"query": "x", "documents": [str(i) for i in range(101)]}
    assert "more than" in answer(engine, {"id": 1, "tool": "search_exact", "arguments": many})["error"]["message"]


def test_artifacts(spark, tmp_path):
    assert artifacts.read_artifacts(spark, tmp_path).count() == 0
    path = artifacts.artifact_path(tmp_path, "docs/a b.md", "CP-7")
    path.parent.mkdir(parents=True)
    path.write_text('{"goal": ["x"]}')
    row = artifacts.read_artifacts(spark, tmp_path).first()
    assert (row["document_id"], row["checkpoint_id"], json.loads(row["json"])) == ("docs/a b.md", "CP-7", {"goal": ["x"]})
    with pytest.raises(ConfigError):
        artifacts.artifact_path(tmp_path, "d", "../x")
