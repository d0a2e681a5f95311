"""The pipeline's stages on the small tables."""

import corpus_pipeline
from chunkloom.llm import decontaminate, pii
from chunkloom.plans.lineage import cut


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf))
        assert docs.columns == columns, name
    assert 0 < docs.count() < before
    assert decontaminate.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    kept = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(kept[i] == pii.scrub(source[i], pii.KEY)[0] for i in kept)
    spans = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        for d, a, b in zip(r.doc_ids, r.start_chars, r.end_chars):
            spans.setdefault(d, []).append((a, b))
    assert set(spans) == set(kept)
    assert all(sum(b - a for a, b in v) == len(kept[i]) for i, v in spans.items())


WORDS = "the quick brown fox jumps over a lazy dog while seven wizards box quietly in the old garden near the river bank".split()


def _tables(spark, folder, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, gone array<int>"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "what is the capital of the land of the seven wizards"), (2, None), (None, "x y z w")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    def say(k, n=40):
        return " ".join(WORDS[(k * 7 + i * (k + 3)) % len(WORDS)] + ("" if i % 5 else f"{k}q") for i in range(n))

    rows = [(i, say(i), "en", "s", 1, [i]) for i in range(20)]
    rows += [(100, None, "en", None, None, None), (101, "", "en", "s", 0, []), (102, "!!! 123", None, "s", 7, None), (None, say(50), "en", "s", 1, None), (None, say(50), "en", "s", 1, None)]
    rows += [(3, say(3), "en", "s", 1, [3]), (4, say(60), "en", "s", 1, None), (200, say(5) + " more", "en", "s", 1, None), (201, "ask: What is the CAPITAL of the land, of the seven wizards? " + say(61), "en", None, 1, None), (7, say(7) + " what is the capital of the land of the seven wizards", "en", "s", 1, None)]
    rows += [(300, say(62, 60_000) + " mail a.b@mail.example", "en", "s", 1, None)]
    _tables(spark, tmp_path, rows)
    docs = source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, str(tmp_path)))
        assert docs.schema == source.schema, name
        after[name] = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    ids = lambda name: [None if none else i for none, i, _ in after[name]]
    assert set(ids("language_id")) == {*range(20), None, 200, 201, 300} and len(ids("language_id")) == len(rows) - 3
    deduplicated = ids("near_dedup")
    assert deduplicated.count(None) == 2 and deduplicated.count(3) == 1 and deduplicated.count(4) == 1 and 200 not in deduplicated
    assert len(set(deduplicated)) == len(deduplicated) - 1
    assert 201 not in ids("decontamination") and set(deduplicated) - set(ids("decontamination")) <= {201, 7}
    assert "a.b@mail" not in after["pii"][[i for _, i, _ in after["pii"]].index(300)][2]
    spans = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        for d, a, b in zip(r.doc_ids, r.start_chars, r.end_chars):
            spans[d] = spans.get(d, 0) + b - a
    want = {}
    for none, i, text in after["pii"]:
        want[None if none else i] = want.get(None if none else i, 0) + len(text)
    assert spans == want and spans[None] == 2 * len(say(50))


def test_empty_table(spark, tmp_path):
    _tables(spark, tmp_path, [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.schema == docs.schema)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_key_is_a_setting(spark, sf):
    docs = spark.createDataFrame([(1, "card 4994226020900891")], "doc_id bigint, text string")
    one = corpus_pipeline.pseudonymise(spark, docs, sf).first().text
    spark.conf.set(corpus_pipeline.KEY_SETTING, "secret")
    try:
        assert corpus_pipeline.pseudonymise(spark, docs, sf).first().text not in (one, docs.first().text)
    finally:
        spark.conf.unset(corpus_pipeline.KEY_SETTING)
