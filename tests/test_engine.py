import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from fernglass import cli, engine, http, shapes
from fernglass.config import Config
from fernglass.errors import InvalidRequest, NotFound, StartupError, UsageError
from fernglass.models import HashEmbedder, LengthEmbedder, check_window, fitted_pair
from fernglass.sources import store
from fernglass.sources.chunker import paragraphs, structural

NOW = 1_791_158_400_000
PAGES = {
    "runbooks/webhook.md": ("Webhook retries", "2026-09-20", ["runbook", "api"], "\n# Webhook retries\n\nRetry the webhook.\n\n## Timeouts\n\nERR_WEBHOOK_TIMEOUT_504 means late.\n"),
    "runbooks/database.md": ("Database failover", "2025-01-10", ["runbook"], "\nPromote the replica.\n\n## Checks\n\nLook at lag.\n"),
    "api/users.md": ("Users API", "2026-08-01", ["api"], "\nList users with paging.\n"),
}


def write(folder, name, title, date, tags, body):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"---\ntitle: {title}\nupdated_at: {date}\ntags: [{', '.join(tags)}]\nowner: me\n---\n{body}")


@pytest.fixture
def folder(tmp_path):
    for name, page in PAGES.items():
        write(tmp_path / "docs", name, *page)
    return tmp_path


def embed(spark, folder, **more):
    return engine.embed(spark, str(folder / "docs"), str(folder / "out"), **more)


def serve(spark, folder, **more):
    return engine.create_engine(spark, str(folder / "docs"), str(folder / "out"), now_ms=lambda: NOW, **more)


def test_incremental_embedding(spark, folder):
    first = embed(spark, folder)
    assert (first["written"], first["up_to_date"], first["chunks_reused"]) == (3, 0, 0)
    again = embed(spark, folder)
    assert (again["written"], again["up_to_date"], again["chunks_embedded"]) == (0, 3, 0)
    title, date, tags, body = PAGES["runbooks/database.md"]
    write(folder / "docs", "runbooks/database.md", title, date, tags, body.replace("lag", "delay"))
    (folder / "docs/api/users.md").unlink()
    edited = embed(spark, folder)
    assert (edited["written"], edited["chunks_embedded"], edited["chunks_reused"], edited["pruned"]) == (1, 1, 1, 1)
    chunks = store.read_chunks(spark, str(folder / "out"))
    before = sorted((r.path, r.ordinal, r.start, r.hash) for r in chunks.collect())
    other = embed(spark, folder, embedder=LengthEmbedder())
    assert (other["written"], other["chunks_reused"]) == (2, 0)
    after = sorted((r.path, r.ordinal, r.start, r.hash) for r in store.read_chunks(spark, str(folder / "out")).collect())
    assert before == after
    rechunked = embed(spark, folder, embedder=LengthEmbedder(), chunker=structural(900))
    assert rechunked["written"] == 2 and rechunked["chunks_reused"] > 0
    assert store.export_sidecars(store.read_chunks(spark, str(folder / "out")), str(folder / "json")) == 2


def test_a_chunker_that_leaves_text_out_fails_its_document(spark, folder):
    from fernglass.sources.chunker import Chunker, Span

    half = Chunker("half@1", lambda title, body: [Span(0, 5, title, "", body[:5])])
    report = embed(spark, folder, chunker=half)
    assert report["written"] == 0 and len(report["failures"]) == 3
    assert embed(spark, folder, chunker=paragraphs())["written"] == 3


def test_problems_keep_the_engine_from_serving(spark, folder):
    with pytest.raises(StartupError, match="no stored chunks"):
        serve(spark, folder)
    embed(spark, folder)
    assert engine.check(spark, str(folder / "docs"), str(folder / "out")) == []
    write(folder / "docs", "api/users.md", "Users API", "2026-08-01", ["api"], "\nchanged\n")
    (folder / "docs/bad.md").write_text("no frontmatter")
    (folder / "docs/runbooks/database.md").unlink()
    found = dict(engine.check(spark, str(folder / "docs"), str(folder / "out")))
    assert set(found) == {"api/users.md", "bad.md", "runbooks/database.md"} and "stale" in found["api/users.md"]
    with pytest.raises(StartupError):
        serve(spark, folder)


def test_operations(spark, folder):
    embed(spark, folder)
    own = serve(spark, folder)
    seen = own.overview({"tags": ["runbook"]})
    assert (seen["documents"], seen["chunks"], seen["tags"]) == (2, 4, [{"name": "api", "documents": 1}, {"name": "runbook", "documents": 2}])
    page = own.list_documents({"sort": "updated_at", "limit": 2})
    assert page["total"] == 3 and [d["path"] for d in page["documents"]] == ["runbooks/webhook.md", "api/users.md"]
    whole = own.get_document("runbooks/webhook.md")
    assert [h["anchor"] for h in whole["outline"]] == ["webhook-retries", "timeouts"] and json.loads(whole["meta"]) == {"owner": "me"}
    assert own.get_document("runbooks/webhook.md#timeouts")["text"].startswith("## Timeouts")
    for ref in ("nope.md", "runbooks/webhook.md#", "runbooks/webhook.md#nope"):
        with pytest.raises(NotFound):
            own.get_document(ref)
    best = own.search({"query": "ERR_WEBHOOK_TIMEOUT_504", "mode": "keyword"})["results"]
    assert [r["ref"] for r in best] == ["runbooks/webhook.md#timeouts"]
    for mode in ("hybrid", "semantic"):
        assert own.search({"query": "retry the webhook", "mode": mode, "limit": 1})["results"][0]["path"] == "runbooks/webhook.md"
    assert own.search({"query": "the and of"})["results"]  # no terms: by vectors alone
    down = own.search({"query": "webhook users", "mode": "keyword", "weights": {"tag:runbook": -0.3}, "limit": 10})["results"]
    assert down[0]["path"] == "api/users.md" and down[-1]["scores"]["signals"]["tags"] == -1
    for bad in ({"query": " "}, {"query": "x", "limits": 1}, {"query": "x", "limit": 11}, {"query": "x", "weights": {"tag:no": 0.1}}, {"query": "x", "weights": {"recency": "a"}}, {"query": "x", "filter": {"dirs": "a"}}):
        with pytest.raises(InvalidRequest):
            own.search(bad)
    for bad in ({"sort": "x"}, {"limit": 0}, {"limit": 501}, {"offset": -1}, {"page": 1}):
        with pytest.raises(InvalidRequest):
            own.list_documents(bad)
    http_contract(own)


def http_contract(own):
    get = lambda target, method="GET", body=b"", host="localhost:1": http.answer(own, method, target, body, host)
    assert get("/healthz")[0] == get("/readyz")[0] == 200
    assert http.answer(None, "GET", "/readyz")[0] == 503 and http.answer(None, "GET", "/healthz")[0] == 200
    assert get("/overview?tag=api")[1]["documents"] == 2
    assert get("/documents?sort=updated_at&limit=1&dir=runbooks")[1]["total"] == 2
    assert get("/documents/runbooks%2Fwebhook.md%23timeouts")[1]["text"].startswith("## Timeouts")
    assert get("/search", "POST", b'{"query": "users"}')[0] == 200
    assert [get(t)[0] for t in ("/documents?limit=x", "/documents?limit=1&limit=2", "/overview?nope=1", "/nope", "/documents/nope.md")] == [400, 400, 400, 404, 404]
    for target, shape in (("/overview", shapes.OVERVIEW), ("/documents", shapes.LISTING), ("/documents/runbooks%2Fwebhook.md", shapes.DOCUMENT), ("/documents/nope.md", shapes.FAILURE)):
        assert shapes.misfits(get(target)[1], shape) == []
    for mode in ("hybrid", "semantic", "keyword"):
        assert shapes.misfits(get("/search", "POST", json.dumps({"query": "users", "mode": mode}).encode())[1], shapes.SEARCH) == []
    assert shapes.misfits({"documents": "3", "chunks": 1, "tags": [{"name": 1}], "x": 1, "index_version": "v"}, shapes.OVERVIEW) == ["$.embedding_model: missing", "$.documents: no integer", "$.tags[0].documents: missing", "$.tags[0].name: no string", "$.x: unknown"]
    assert get("/documents/a.md?full=true&full=true")[0] == 400
    assert [http.own_names(h) is not None for h in ("127.0.0.1", "127.1", "localhost.", "::1", "0:0:0:0:0:0:0:1", "[::1]", "::ffff:127.0.0.1", "127.9.9.9", "0.0.0.0", "example.org", "::")] == [True] * 8 + [False] * 3
    assert get("/healthz", host="[::1]:80")[0] == get("/healthz", host="127.0.0.1")[0] == get("/healthz", host="LOCALHOST.:1")[0] == 200
    assert http.answer(own, "GET", "/healthz", host="any.example", names=None)[0] == 200
    assert get("/search")[0] == 405 and get("/search", "POST", b"{")[0] == 400 and get("/healthz", host="evil.example")[0] == 400
    server = http.serve({"engine": own})
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/overview") as r:
        assert json.load(r)["documents"] == 3
    with pytest.raises(urllib.error.HTTPError) as e:  # the body is read, so the answer arrives
        urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/search", data=b" " * (3 << 20))
    assert e.value.code == 400 and "bytes at most" in e.value.read().decode()
    server.shutdown()


def test_serving_starts_before_the_engine():
    """The port answers while the engine is made; a failing engine ends the server; a taken port is an error."""
    said, ports, seen = [], [], []

    def say(line):
        said.append(line)
        if line.startswith("listening"):
            ports.append(int(line.rsplit(":", 1)[1]))

    def failing():
        try:
            urllib.request.urlopen(f"http://127.0.0.1:{ports[0]}/readyz")
        except urllib.error.HTTPError as e:
            seen.append(e.code)
        with pytest.raises(StartupError):
            cli._serve(lambda: None, "127.0.0.1", ports[0], say)
        raise StartupError("broken index")

    with pytest.raises(StartupError, match="broken index"):
        cli._serve(failing, "127.0.0.1", 0, say)
    assert seen == [503] and "ready" not in said


def test_commands(spark, folder):
    def run(*argv):
        out = io.StringIO()
        return cli.run([*argv, "--source", str(folder / "docs"), "--target", str(folder / "out")], spark, out), out.getvalue()

    assert run("check")[1].endswith("path(s) with problems\n")
    for twice in (("--limit", "1", "--limit", "2"), ("--dir", "a", "--dir", "a"), ("--json", "--json")):
        assert run("list", *twice)[0] == 2
    assert run("check")[0] == 1 and run("embed")[0] == 0 and run("check") == (0, "fresh\n")
    assert "runbook: 2" in run("overview")[1]
    assert "2 of 2" in run("list", "--tag", "runbook")[1]
    assert "runbooks/webhook.md#timeouts" in run("search", "ERR_WEBHOOK_TIMEOUT_504", "--mode", "keyword")[1]
    assert run("get", "nope.md")[0] == 1 and "Users API" in run("get", "api/users.md")[1]
    assert json.loads(run("list", "--since", "2026-09-20", "--json")[1])["total"] == 1
    assert run("search", "x", "--weight", "recency")[0] == 1 and run("search", "x", "--mode", "nope")[0] == 2


def test_configuration(tmp_path):
    with pytest.raises(UsageError):
        Config.load({"source": str(tmp_path), "target": str(tmp_path)})
    with pytest.raises(UsageError):
        Config.load({"source": str(tmp_path / "none")})
    assert Config.load({"source": str(tmp_path)}).target.endswith(".fernglass")


def test_model_windows():
    assert [len(x) for x in fitted_pair(range(400), range(900))] == [128, 381]
    with pytest.raises(ValueError):
        check_window(513, "a chunk")
    assert abs(sum(x * x for x in HashEmbedder().query("a b c")) - 1) < 1e-9


def test_streamed_ingestion(spark, tmp_path):
    from fernglass.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    schema = "path string, content binary, at long"

    def put(name, body, at, head="title: T\nupdated_at: 2026-01-01\ntags: []"):
        raw = f"---\n{head}\n---\n{body}".encode()
        spark.createDataFrame([(name, bytearray(raw), at)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), HashEmbedder(), structural()).awaitTermination()
        return {(r.path, r.text) for r in store.read_chunks(spark, str(tmp_path / "out")).collect()}

    put("a.md", "one", 1)
    assert go() == {("a.md", "\none")}
    put("b.md", "two", 2)
    put("a.md", "earlier, though greater by its letters", 3)
    put("a.md", "a later one", 4)
    put("bad.md", "body", 5, "title: [")
    assert go() == {("a.md", "\na later one"), ("b.md", "\ntwo")}
    failed = spark.read.parquet(str(tmp_path / "out" / "failures")).collect()
    assert [(r.path, "YAML" in r.reason) for r in failed] == [("bad.md", True)]
    assert sorted(map(tuple, store.read_titles(spark, str(tmp_path / "out")).collect())) == [("a.md", "T"), ("b.md", "T")]
    with pytest.raises(ValueError, match="at"):
        ingest(spark.readStream.schema("path string, content binary").parquet(str(tmp_path / "in")), "x", "y", HashEmbedder(), structural())
