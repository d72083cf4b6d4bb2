import io
import json
import zipfile

import pytest

from brackenfold import cli, tools
from brackenfold import schemas as s
from brackenfold.rag import RagEngine
from brackenfold.streaming import ingest


@pytest.fixture
def engine(spark, tmp_path):
    return RagEngine.open(spark, f"{tmp_path}/db", dim=64, chunk_size=8, overlap=2, clock=lambda: 1_700_000_000.0)


def test_index_skip_replace_delete(spark, engine):
    assert tools.index_text(engine, "alpha beta gamma", "dedup.txt")["status"] == "indexed"
    assert tools.index_text(engine, "alpha beta gamma", "dedup.txt") == {"status": "skipped", "source": "dedup.txt", "chunks": None}
    assert tools.index_text(engine, " ".join(f"w{i}" for i in range(20)), "dedup.txt") == {"status": "indexed", "source": "dedup.txt", "chunks": 3}
    assert engine.chunks().where("text like '%alpha%'").count() == 0
    status = engine.document_status("dedup.txt")
    assert status["chunk_count"] == 3 == engine.chunks().count() and status["indexed_at"] == 1_700_000_000
    engine.index_text("other text here", "b.md")
    assert engine.list_sources() == ["b.md", "dedup.txt"]
    engine.delete_source("dedup.txt")
    engine.delete_source("unknown")
    again = RagEngine.open(spark, engine.path, dim=64)
    assert again.list_sources() == ["b.md"] and again.document_status("dedup.txt") is None
    engine.index_text("back again", "dedup.txt")
    assert engine.compact() and not engine.compact()
    assert engine.list_sources() == ["b.md", "dedup.txt"] and sorted(r[0] for r in engine.chunks().select("vec_id").collect()) == [0, 1]
    assert engine.stats()["live_chunk_count"] == 2


def test_search(spark, engine):
    texts = [("rust.txt", "Rust is a systems language"), ("bread.txt", "Bread needs flour and water"), ("empty.txt", "")]
    assert {r["chunks"] for r in engine.index_texts(spark.createDataFrame(texts, "source string, text string")).collect()} == {0, 1}
    assert engine.list_sources() == ["bread.txt", "rust.txt"] and engine.document_status("empty.txt")["chunk_count"] == 0
    found = tools.search(engine, "systems language rust", 2)
    assert found["count"] == 2 and found["results"][0]["source"] == "rust.txt" and found["results"][0]["score"] > 0
    assert tools.search(engine, "rust", None, "bread.txt")["results"][0]["source"] == "bread.txt"
    assert [r["source"] for r in engine.search("flour", 1, "bread.txt", mode="postfilter").collect()] == ["bread.txt"]
    batch = spark.createDataFrame([(1, "flour water"), (2, "rust"), (3, "...")], "query_id int, query string")
    assert {(r["query_id"], r["source"]) for r in engine.search_batch(batch, 1).collect()} == {(1, "bread.txt"), (2, "rust.txt")}
    with pytest.raises(s.ZeroVector):
        engine.search("...", 1)
    with pytest.raises(s.DimensionMismatch):
        RagEngine.open(spark, engine.path, dim=65)
    assert tools.format_results([]) == "No results found."


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_paths_command_line_and_server(spark, tmp_path, engine):
    folder = tmp_path / "files" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("hello from markdown")
    (folder / "b.PY").write_text("def f():\n    return 1\n")
    (folder / "c.docx").write_bytes(docx("words of an office file"))
    (folder / "d.png").write_bytes(b"\x89PNG")
    (folder / "e.txt").write_bytes(b"")
    (folder / "f.docx").write_bytes(b"broken")
    (folder / "g.txt").write_bytes("caf\xe9 au lait, d\xe9j\xe0 vu".encode("latin-1"))
    args = cli.parser().parse_args(["index", str(tmp_path / "files"), str(tmp_path / "missing"), "--db-path", f"{tmp_path}/cli"])
    out = io.StringIO()
    assert cli.run(args, spark, out) == 0
    assert "Indexed: 5, skipped: 0" in out.getvalue() and "f.docx" in out.getvalue()
    for command, text in ((["search", "office", "file"], "office"), (["sources"], "a.md"), (["stats"], "Indexed sources: 4"), (["delete", str(folder / "a.md")], "Deleted"), (["models"], "bge-m3")):
        out = io.StringIO()
        cli.run(cli.parser().parse_args([*command, *([] if command == ["models"] else ["--db-path", f"{tmp_path}/cli"])]), spark, out)
        assert text in out.getvalue(), command
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "index_text", "arguments": {"text": "a b", "source": "s"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "a", "top_k": None}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "index_path", "arguments": {"path": "/no/such"}}},
        {"jsonrpc": "2.0", "id": 6, "method": "tools/call", "params": {"name": "document_status", "arguments": {"source_path": "none"}}},
        {"jsonrpc": "2.0", "id": 7, "method": "what"},
    ]
    out = io.StringIO()
    tools.serve(engine, [json.dumps(a) for a in asked] + ["{not json", ""], out)
    answers = {a["id"]: a for a in map(json.loads, out.getvalue().splitlines())}
    assert len(answers[2]["result"]["tools"]) == 5 and answers[5]["error"]["code"] == -32602 and answers[7]["error"]["code"] == -32601 and answers[None]["error"]
    assert json.loads(answers[4]["result"]["content"][0]["text"])["count"] == 1
    assert json.loads(answers[6]["result"]["content"][0]["text"])["found"] is False


def test_streams(spark, tmp_path, engine):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("streamed words")
    ingest.index_stream(engine, str(folder), f"{tmp_path}/cp").awaitTermination()
    (folder / "b.txt").write_text("more words")
    ingest.index_stream(engine, str(folder), f"{tmp_path}/cp").awaitTermination()
    engine.refresh()
    assert len(engine.list_sources()) == 2

    rows = [(1, 1, "I", "a"), (2, 2, "I", "b"), (1, 3, "D", None)]
    schema = "k bigint, lsn bigint, op string, payload string"
    for n, part in enumerate((rows[2:], rows[:2])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/feed/{n}")
        feed = spark.readStream.schema(schema).parquet(f"{tmp_path}/feed/*")
        ingest.apply_changes_stream(feed, "k", "lsn", "op", ["payload"], f"{tmp_path}/state", f"{tmp_path}/cp2").awaitTermination()
    got = {(r["k"], r["deleted"]) for r in ingest.read_state(spark, f"{tmp_path}/state", 1).collect()}
    assert got == {(1, True), (2, False)}
    # the second batch only wrote the parts of its keys
    assert len(ingest._version(ingest.Files(spark, f"{tmp_path}/state"), 1)) >= len(ingest.Files(spark, f"{tmp_path}/state").names("data/1")) - 1
