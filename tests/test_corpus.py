"""Corpus operators, options and sinks against brute force and hand-made cases."""

import itertools
import json
import random

import numpy as np
import pytest

from chunkloom.config import Chunking, Config, Embeddings, Output, Project, Quality
from chunkloom.errors import MissingDependency
from chunkloom.functions import textkit as T
from chunkloom.functions import udfs as U
from chunkloom.operators import corpus, search, stages
from chunkloom.plans import skew
from chunkloom.sinks import writers
from pyspark.sql import functions as F


def _words(text):
    return T.re.findall(r"\w+", T.casefold(text))


def _set(text, size=5):
    w = _words(text)
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(3)
    rows = []
    for i in range(40):
        w = [f"w{r.randrange(500)}" for _ in range(r.randint(30, 60))]
        rows.append(" ".join(w))
        for _ in range(r.randint(0, 3)):
            v = list(w)
            for _ in range(r.randint(0, 2)):
                v[r.randrange(len(v))] = f"x{r.randrange(500)}"
            rows.append(" ".join(v).upper() if r.random() < 0.3 else " ".join(v))
    r.shuffle(rows)
    rows += ["", None, "one", "one", "two words"]
    return [(i, t) for i, t in enumerate(rows)]


def _pairs(texts, threshold):
    """Of each class of equal sets the first with each copy, and the firsts with each other."""
    sets = {i: _set(t or "") for i, t in texts}
    first = {}
    for i, s in sets.items():
        if s:
            first.setdefault(frozenset(s), i)
    out = {(first[frozenset(s)], i): 1.0 for i, s in sets.items() if s and first[frozenset(s)] != i}
    for a, b in itertools.combinations(sorted(first.values()), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= threshold:
            out[a, b] = j
    return out


def _greedy(texts, threshold):
    sets, kept, out = {i: _set(t or "") for i, t in texts}, [], {}
    for i, s in sets.items():
        of = next((k for k in kept if s and len(s & sets[k]) >= threshold * len(s | sets[k])), None)
        if of is None:
            kept.append(i)
        else:
            out[i] = of
    return out


def test_near_pairs_and_greedy_originals_against_brute_force(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, "id bigint, text string")
    for copies in (1 << 20, 1):
        monkeypatch.setattr(skew, "COPIES", copies)
        got = {(r.a, r.b): r.similarity for r in corpus.near_pairs(df, "id", "text", 0.6).collect()}
        want = _pairs(texts, 0.6)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    found = corpus.minhash_pairs(df, "id", "text", 0.6)
    mine = {(r.a, r.b) for r in found.collect()}
    assert mine <= want.keys() and len(mine) >= 0.97 * len(want)
    originals = {r.dup: r.original for r in corpus.greedy_originals(corpus.near_pairs(df, "id", "text", 0.6)).collect()}
    assert originals == _greedy(texts, 0.6)


def test_frequent_shingles_stand_last_and_lose_no_pair(spark, monkeypatch):
    common = "it is said in every text of this table that nothing in it may be left out at all by anyone"
    rows = [(i, f"{common} {' '.join(f'w{i // 2}x{k}' for k in range(60 + i % 2))}") for i in range(60)] + [(100, common), (101, f"{common} or so"), (102, None), (103, "one two")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    want = _pairs(rows, 0.8)
    sets, _ = corpus.shingle_classes(df, "id", "text")
    last = corpus._frequent(sets, 0.8)
    assert len(last) and len(want) == 31
    # none stands in a prefix that has room without it
    assert not corpus._prefixes(sets, 0.8, last).where("n > 40").where(F.col("shingle").isin(last.tolist())).count()
    for most in (1 << 20, 1):
        monkeypatch.setattr(corpus, "HOT_MOST", most)
        got = {(r.a, r.b): r.similarity for r in corpus.near_pairs(df, "id", "text", 0.8).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_greedy_query_against_brute_force(spark, sf):
    from chunkloom.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    assert {r.dup: r.original for r in QUERIES["H9_greedy_originals"](spark, sf).collect()} == _greedy(rows, 0.8)


def test_estimated_similarity(spark):
    s = spark.createDataFrame([(i, list(range(i, 400 + i))) for i in (0, 100, 100, 900)], "key bigint, s array<bigint>")
    sig = [r.signature for r in corpus.signatures(s, 256).orderBy("key").collect()]
    assert len(sig[0]) == 256 and sig[1] == sig[2]
    both = spark.createDataFrame([(sig[0], sig[1]), (sig[1], sig[2]), (sig[0], sig[3]), (sig[0], []), (None, sig[0])], "a array<bigint>, b array<bigint>")
    j = [r[0] for r in both.select(corpus.estimated_jaccard("a", "b")).collect()]
    assert abs(j[0] - 300 / 500) < 0.12 and j[1:3] == [1.0, 0.0] and j[3] == 0 and not j[4]


def test_cosine_blocks_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(200, 6)), 1)
    x[150:] = x[:50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(5)
    got = {}
    for r in search.cosine_top(df, "id", "v", df, "id", top=4, block=37).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["key"], r["cosine"]))
    u = np.concatenate([x, np.zeros((1, 6))])
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    ids = [*range(200), 901]
    s = np.round(u @ u.T, 6)
    for i, q in enumerate(ids):
        best = sorted((-s[i, k], ids[k]) for k in range(len(ids)) if k != i)[:4]
        assert [k for k, _ in got[q]] == [k for _, k in best], q
    assert 900 not in got and 902 not in got
    assert search.cosine_top(df.where("false"), "id", "v", df, "id").count() == 0


def test_validation_codes(spark):
    rows = [("a", "x", "d", 5, None, "b", ["code_split"]), ("b", " ", "", 900, "a", "zz", []), ("b", "y", None, 200, "a", None, None), (None, "z", "d", 200, None, None, ["other"])]
    c = spark.createDataFrame(rows, "id string, content string, document_id string, size int, previous_chunk string, next_chunk string, flags array<string>").withColumn("of", F.when(F.col("size") == 200, "a"))
    got = sorted((r.code, r.chunk_id or "") for r in corpus.validate(c, duplicate_of="of", flags="flags").collect())
    assert got == [("BROKEN_NEIGHBOR", "b"), ("CODE_SPLIT", "a"), ("DUPLICATE_ID", "b"), ("EMPTY_CONTENT", "b"), ("HIGH_DUPLICATION", ""), ("MISSING_DOCUMENT_ID", "b"), ("MISSING_DOCUMENT_ID", "b"), ("MISSING_ID", ""), ("OVERSIZED", "b"), ("UNDERSIZED", "a")]


def test_previews(spark):
    docs = spark.createDataFrame([("d", "abc def"), ("e", "")], "document_id string, content string")
    chunks = spark.createDataFrame([("d", "d_1", 1, 4, 7, None, "text"), ("d", "d_0", 0, 0, 3, "S", "text")], "document_id string, id string, chunk_index int, start_offset int, end_offset int, section string, content_type string")
    got = {r.document_id: r for r in search.previews(docs, chunks).collect()}
    assert [(s.chunk_id, got["d"].content[s.start : s.end]) for s in got["d"].spans] == [("d_0", "abc"), ("d_1", "def")] and got["e"].spans == []


def test_tokenizer_option_counts(spark):
    path = "tiktoken:/opt/tokenizers/byte_bpe_50k.tiktoken"
    text = "Internationalisation matters. " * 60
    n = T.tokenizer(path)(text)
    assert n != T.count_tokens(text) and T.measure(text, "tokens", path) == n
    one = stages.kernel(text, Config(chunking=Chunking(strategy="sentence", target_size=100, max_size=150, min_size=10, overlap=0, tokenizer=path)))
    assert all(T.tokenizer(path)(c["content"]) == c["size"] == c["token_count"] <= 150 for c in one["chunks"]) and len(one["chunks"]) > 1
    with pytest.raises(MissingDependency):
        T.tokenizer("abacus")
    assert spark.createDataFrame([(text,)], "t string").select(U.tokenizer_count("t", path)).first()[0] == n


def test_configured_outputs(spark, tmp_path):
    docs = spark.createDataFrame([("d", "T", "s", "# Head\n\nSome words stand here. They say a thing or two about it.")], "document_id string, title string, source string, content string")
    cfg = Config(project=Project(name="mine"), embeddings=Embeddings(enabled=True, dimensions=16), quality=Quality(validate_information_loss=False), output=Output(formats=("jsonl", "json"), directory=str(tmp_path / "out"), pretty=True, include_quality=False))
    chunks, processed = stages.run(docs, cfg)
    assert processed.where("size(blocks) > 0").count() == 0 and stages.reports(processed).first().blocks == 2
    paths = writers.write_dataset(chunks, cfg)
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["jsonl", "json", "statistics.json"]
    whole = json.loads((tmp_path / "out" / "json").read_text())
    assert "quality" not in whole["documents"][0] and len(whole["documents"][0]["embedding"]) == 16 and "\n  " in (tmp_path / "out" / "json").read_text()
    found = json.loads((tmp_path / "out" / "statistics.json").read_text())
    assert found["project"]["name"] == "mine" and found["kinds"] == {"knowledge": 1, "metadata": 0}


def test_hash_embedding_against_a_plain_version(spark):
    import hashlib

    texts = ["a b a", "", "Straße STRASSE", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(U.hash_embedding("t", 32)).collect()]
    for t, v in zip(texts, got):
        want = np.zeros(32)
        for w in T.casefold(t or "").split():
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            want[int.from_bytes(h[:4], "big") % 32] += 1 if h[4] & 1 else -1
        n = np.linalg.norm(want)
        assert np.allclose(v, want / n if n else want)
    assert got[2] == got[2][:] and sum(x != 0 for x in got[2]) == 1
