"""A small case for each finding of a review."""

import duckdb
import pandas as pd
import pytest

from chunkloom import queries as Q
from chunkloom.functions import textkit as T


@pytest.mark.parametrize("text", ["Y.\nDe ella. Un dos.", "-\nWord. ’", "etc... Und", "Word.\n\nder ab.", "a... B", "Dr.\nWord", "x.y.z.a.b.c.d. Word", "aa.b.c. Word", "Word.  der"])
def test_sentences_as_in_sql(text):
    documents = pd.DataFrame({"doc_id": [1], "text": [text]})  # noqa: F841, read by name
    assert T.sentences(text) == [r[2] for r in duckdb.sql(Q.SQL["D8_sentences"]).order("position").fetchall()]


def same(spark, name, folder, **tables):
    """Whether the query gives the rows of its SQL on these tables."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = Q.QUERIES[name](spark, str(folder))
    return sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {', '.join(df.columns)} from ({Q.SQL[name]})").fetchall())


def test_titles_with_other_references(spark, tmp_path):
    title = lambda t: f"<html><head><title>{t}</title></head><body><p>x</p></body></html>"
    rows = [(2, "u", title("a = &quot;b")), (4, "u", title("a &amp;lt; b&amp")), (6, "u", title("a &lt;b&gt; &#39; &eacute &")), (7, "u", title("x"))]
    assert same(spark, "A5_title_policy", tmp_path, pages=(rows, "page_id bigint, url string, html string"))


def test_what_is_too_long_for_a_term_stays_text():
    from chunkloom.operators.stages import kernel
    from chunkloom.config import Config

    long = "Theslyor shea a, the reesanes instti of onerbleretion thonthwh onblees, antion edhash thednt erbleor en, retior thinnd ing in anbleer thlynd hethes."
    k = kernel(f"# Guide\n\nIt is a text that says what it does.\n\n## Keywords\n\nRed; blue; green; black; white; grey\n\n{long}", Config())
    assert any(long in c["content"] for c in k["chunks"])
    assert "blue" in k["chunks"][0]["retrieval"]["keywords"]


def test_a_page_that_fails_is_a_violation(spark, tmp_path, monkeypatch):
    from chunkloom.operators import stages

    process = stages.process

    def failing(documents, cfg=None, **more):
        from pyspark.sql import functions as F

        p = process(documents, cfg, **more)
        bad = F.col("document_id") == "1"
        return p.withColumns({"error": F.when(bad, "ValueError: x").otherwise(F.col("error")), "blocks": F.when(bad, F.filter("blocks", lambda b: F.lit(False))).otherwise(F.col("blocks")), "chunks": F.when(bad, F.filter("chunks", lambda b: F.lit(False))).otherwise(F.col("chunks"))})

    monkeypatch.setattr(stages, "process", failing)
    spark.createDataFrame([(1, "u", "<p>It is one of them.</p>"), (2, "u", "<p>It is another of them.</p>")], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r[0] for r in Q.QUERIES["I14_pages_lose_nothing"](spark, str(tmp_path)).collect()] == ["1"]


def test_find_by_pattern(spark, tmp_path):
    rows = [(7, 2, "user", "x"), (702, 0, "user", "x"), (17, 2, "user", "x"), (5, 0, "user", "x")]
    assert same(spark, "K5_find", tmp_path, conversations=(rows, "conv_id bigint, turn bigint, role string, text string"))


def test_streamed_texts_keep_their_lines(spark, tmp_path):
    rows = [(1, 0, "user", "Es uno.\nY. Dos ciento.\nDe tres.\n\nOtra."), (2, 0, "user", "a\n- b"), (2, 1, "user", "no")]
    assert same(spark, "M9_streamed_chunks", tmp_path, conversations=(rows, "conv_id bigint, turn bigint, role string, text string"))


def test_words_whose_signs_cancel(spark, tmp_path):
    from chunkloom.functions.udfs import _place

    places = {}
    for word in map("w{}".format, range(10_000)):
        i, sign = _place(word, 256)
        if other := places.get((i, -sign)):
            break
        places[i, sign] = word
    rows = [(1, f"{word} {other}"), (2, word), (3, "")]
    assert same(spark, "L2_hash_embedding_norms", tmp_path, documents=(rows, "doc_id bigint, text string"))


def test_cosine_tiles_against_brute_force():
    import numpy as np
    import pyarrow as pa
    import tracemalloc

    from chunkloom.operators.search import _scan

    rng = np.random.default_rng(0)
    v = np.round(rng.standard_normal((6000, 8)), 1)  # with equal cosines
    v[5000:] = v[:1000]
    column = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    shared = type("Shared", (), {"value": (np.arange(0, 6000, 4), column(v[::4]))})
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + 3000)), column(v[i : i + 3000])], ["key", "v"]) for i in (0, 3000)]
    tracemalloc.start()
    out = pa.Table.from_batches(list(_scan(shared, 5)(batches))).to_pydict()
    assert tracemalloc.get_traced_memory()[1] < 40e6  # one matrix of all queries and a batch would take 36 MB, several of them were held
    tracemalloc.stop()
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = np.round(u[::4] @ u.T, 6)
    s[np.arange(1500), np.arange(0, 6000, 4)] = -9
    want = {(4 * q, int(k)) for q in range(1500) for k in np.lexsort((np.arange(6000), -s[q]))[:5]}
    assert {(q, k) for q, k in zip(out["query"], out["key"])} == want


def test_made_texts_are_spread_over_the_cores(spark):
    from chunkloom.plans.skew import spread

    n = spark.sparkContext.defaultParallelism
    df = spread(spark.range(100).coalesce(1), "id")
    assert df.rdd.getNumPartitions() == n and df.count() == 100
    assert spread(spark.range(100), "id", rows=5).rdd.getNumPartitions() == 20


def test_the_kernel_measures_a_text_once(monkeypatch):
    from chunkloom.config import Chunking, Config
    from chunkloom.operators import stages

    calls = []
    real = stages.T.measure  # of the chunks; chunkers has its own name for it
    monkeypatch.setattr(stages.T, "measure", lambda *a: calls.append(a) or real(*a))
    cfg = Config(chunking=Chunking(strategy="sentence"))
    text = "It is one of them. It is another."
    k = stages.kernel(text, cfg)
    assert len(calls) == len(k["chunks"]) == 1 and k["chunks"][0]["measures"]["sentences"] == 2
    short = stages.kernel(text, cfg, False, False)
    assert short["chunks"][0] | {"measures": None} == k["chunks"][0] | {"measures": None} and short["chunks"][0]["measures"] is None


def test_parts_are_spread_over_the_cores(spark, sf):
    assert Q.QUERIES["A8a_tags_to_markdown"](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pages_are_taken_in_slices(spark):
    import pyarrow as pa

    from chunkloom.sources.tables import pages_as_documents

    class Pages:
        select = lambda self, *_: self
        mapInArrow = lambda self, f, _: f

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(200)), "url": ["u"] * 200, "html": ["<p>x</p>"] * 200})
    out = list(pages_as_documents(Pages())([batch]))
    assert max(b.num_rows for b in out) <= 64 and sum(b.num_rows for b in out) == 200
