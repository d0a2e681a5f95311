"""Files in, datasets out, streams, command line."""

import json

import pytest

from chunkloom.config import Chunking, Config, Embeddings
from chunkloom.errors import ExportError, InputError
from chunkloom.operators import stages
from chunkloom.operators.embeddings import embed_chunks
from chunkloom.sinks import writers
from chunkloom.sources.files import from_text, read_dataset, read_documents
from chunkloom.streaming.chunks import stream_to_json

MD = "# Guide\n\nSome words stand here. They explain things well enough for anybody.\n\n## Tags\n\na1; b2; c3; d4; e5\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    (d / "guide.md").write_text(MD)
    (d / "copy.md").write_text(MD)
    (d / "data.csv").write_text("name,role\nAnn,x\nBob,y\n")
    (d / "bad.json").write_text("{nope")
    (d / "skip.bin").write_bytes(b"\0")
    (d / "sub").mkdir()
    (d / "sub" / "page.html").write_text("<title>T</title><h1>Head</h1><p>Text of the page that is long.")
    return str(d)


def test_files_to_chunks_and_back(spark, folder, tmp_path):
    docs = read_documents(spark, folder).cache()
    assert docs.count() == 5 and docs.where("error is not null").count() == 1
    cfg = Config(chunking=Chunking(target_size=60, min_size=5, max_size=90, overlap=10))
    chunks, processed = stages.run(docs.where("error is null"), cfg)
    chunks = chunks.cache()
    assert chunks.where("duplicate_of is not null").count() == 1
    assert stages.audit(processed, chunks).where("destination = 'dropped'").count() == 0
    for fmt in writers.available_formats():
        writers.export(chunks, str(tmp_path / fmt), fmt)
    for fmt in ("jsonl", "json"):
        back = read_dataset(spark, str(tmp_path / fmt))
        assert back.count() == chunks.count() and back.where("size(retrieval.tags) > 0").count() == 2
    with pytest.raises(ExportError):
        writers.export(chunks, str(tmp_path / "jsonl"), "jsonl", overwrite=False)
    assert writers.statistics(chunks)["duplicates"] == 1
    v = embed_chunks(chunks, Embeddings(dimensions=64)).first()["embedding"]
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-5
    with pytest.raises(InputError):
        read_documents(spark, folder + "/none")


def test_inline_text(spark):
    chunks, _ = stages.run(from_text(spark, MD))
    assert chunks.count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"document_id": "d", "title": "T", "source": "s", "content": MD}))
    q = stream_to_json(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_command_line(spark, folder, capsys):
    from chunkloom.cli import main

    assert main(["formats"]) == 0 and ".md" in capsys.readouterr().out
    assert main(["inspect", folder + "/guide.md", "--search", "explain"]) == 0 and "explain" in capsys.readouterr().out
    assert main(["validate", folder + "/guide.md", "--strict"]) == 1
