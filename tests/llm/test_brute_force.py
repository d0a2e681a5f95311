"""The operators against slow, plain versions of themselves, and on inputs made to break them."""

import itertools
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import decontaminate, html_content, near_dup, pack_bfd, pack_dp, pii, queries, toxicity, vector_graph
from chunkloom.llm._text import Words
from chunkloom.llm.components import connected_components
from chunkloom.plans.skew import named

DOCS = "doc_id bigint, text string"


def canonical(v):
    return f"{v:.6g}" if isinstance(v, float) else tuple(map(canonical, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(queries.queries()))
def test_every_query_against_its_sql_or_for_rows(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    rows = [tuple(canonical(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    at = [names.index(c) for c in sorted(names)]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, rows)) == sorted(repr(tuple(canonical(r[i]) for i in at)) for r in cur.fetchall())


# ---- personal data ------------------------------------------------------------------------------------------


def _luhn_ok(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def _values(r):
    """(text, valid) of every kind, the validity found by rules written anew."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    card = r.choice("3456") + digits(15)
    ip = ".".join(str(r.randint(0, 300)) for _ in range(4))
    y, m, d = r.randint(1890, 2110), r.randint(1, 13), r.randint(1, 31)
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    day_ok = 1900 <= y <= 2099 and m <= 12 and d <= [31, 28 + leap, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]
    ssn = digits(3) + "-" + digits(2) + "-" + digits(4)
    ssn_ok = ssn[:3] not in ("000", "666") and ssn[0] != "9" and ssn[4:6] != "00" and ssn[7:] != "0000"
    return [
        (card, _luhn_ok(card) and len(set(card)) > 1), (ip, all(int(p) <= 255 for p in ip.split("."))), (f"{y}-{m:02d}-{d:02d}", day_ok), (ssn, ssn_ok),
        (f"{word(5)}.{digits(2)}@{word(4)}.example.com", True), (f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", True), (f"token={word(r.randint(8, 900))}", True), (word(12), False), (f"{r.randint(1, 28)} {word(7)} {r.randint(1900, 2099)}", False),
    ]


def test_pii_query_against_a_naive_finder(spark, tmp_path):
    r = random.Random(11)
    rows, want, known = [], {}, {}
    for i in range(120):
        some = [r.choice(_values(r)) for _ in range(r.randint(0, 12))] + ([r.choice(list(known.items()))] * bool(known) if r.random() < 0.5 else [])
        some = [(v, ok) if isinstance(ok, bool) else (v, True) for v, ok in some]
        text, out, n = "", "", 0
        for v, ok in some:
            if ok:  # a dictionary of pseudonyms, filled by the value on its own
                known.setdefault(v, pii.scrub(v, pii.KEY)[0])
            text, out, n = f"{text}{v} ; ", f"{out}{known[v] if ok else v} ; ", n + ok
        rows.append((i, text))
        want[i] = (out, n)
    rows += [(500, None), (501, ""), (502, rows[0][1])]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.text, x.n_replaced) for x in pii.op9_pii(spark, str(tmp_path)).collect()}
    assert {i: got[i] for i in want} == want and got[500] == (None, 0) and got[501] == ("", 0) and got[502] == got[0]
    assert all(a != b for a, b in known.items()) and len(set(known.values())) == len(known)
    for v, new in known.items():
        assert re.sub("[0-9]", "0", v) == re.sub("[0-9]", "0", new) or "@" in v or "=" in v or v.count(".") == 3
        assert not v.isdigit() or _luhn_ok(new)


def test_pii_secrets_of_any_length_and_names_of_months():
    for n in (8, 64, 84, 100, 128, 500, 5000):
        for value in (("aB" * n)[:n], ("0f" * n)[:n], ("a1-_" * n)[: n - 1] + "z"):
            out, kinds = pii.scrub(f"token={value}", b"k")
            assert kinds == ["secret"] and len(out) == 6 + n and out[6:] != value
    local = "q" * 70
    assert local not in pii.scrub(f"{local}@mail.example", b"k")[0]
    for text in ("12 de mayo de 2021", "28. Februar 2021", "28 février 2021", "1er mars 2021", "May 3rd, 2021", "3. März 2020", "4 septiembre 2019", "5 AUGUST 2018"):
        out, kinds = pii.scrub(text, b"k")
        assert kinds == ["date"] and out != text
    same = [pii.scrub(t, b"k")[0] for t in ("12 de mayo de 2021", "12. Mai 2021", "12 mai 2021", "12 May 2021", "2021-05-12")]
    assert len({(s.split()[0].strip("."), s.split()[-1]) for s in same[:4]}) == 1 and same[4].startswith(same[0].split()[-1])
    for text in ("de89370400440532013000", "030 1234567", "01 23 45 67 89", "müller@mail.example", "张伟@mail.example"):
        assert pii.scrub(text, b"k")[0] != text, text
    for text in ("12 bananas 2021", "31. Februar 2021", "ab12 some more text here", "v 0123 456"):
        assert pii.scrub(text, b"k") == (text, [])
    assert pii.scrub("1111 4994 2260 2090 0891", b"k")[1] == ["card"]  # within what isn't valid as a whole
    assert pii.scrub("token=abcdefgh1", b"k") != pii.scrub("token=abcdefgh1", b"l")


def test_pii_takes_time_in_proportion():
    for part in ("a%", "a.", "+1 ", "12 12 ", "1.1.", "january ", "0301 12 ", "token: ", "ab12 "):
        began = time.time()
        pii.scrub(part * (400_000 // len(part)), b"k")
        assert time.time() - began < 5


# ---- benchmark passages -------------------------------------------------------------------------------------


def _naive_leaks(rows, items, least=decontaminate.LEAST):
    out = []
    split = lambda t: [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t or "")]
    for i, text in rows:
        words = split(text)
        for item, q in {(a, b) for a, b in items if a is not None and b is not None}:
            w = [x for x, _, _ in split(q)]
            n = min(len(w), decontaminate.WINDOW)
            if n < least:
                continue
            grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            hits = [k for k in range(len(words) - n + 1) if tuple(x for x, _, _ in words[k : k + n]) in grams]
            for _, run in itertools.groupby(enumerate(hits), lambda e: e[1] - e[0]):
                run = [k for _, k in run]
                out.append((i, item, words[run[0]][1], words[run[-1] + n - 1][2], run[-1] - run[0] + n))
    return sorted(out, key=repr)


def test_leaks_against_a_naive_scan(spark):
    r = random.Random(5)
    vocabulary = "ab cd ef gh ij".split()
    say = lambda n: r.choice(["", "  "]) + "".join(r.choice([w, w.upper()]) + r.choice([" ", ", ", "\n", " — "]) for w in r.choices(vocabulary, k=n))
    items = [(k, say(r.choice([2, 3, 4, 5, 6, 7, 8, 9, 12, 20]))) for k in range(12)] + [(None, say(9)), (50, None), (51, ""), (3, say(5)), (60, "one two three four five six seven eight nine ten")]
    rows = [(i % 40, say(r.randint(0, 60))) for i in range(60)] + [(None, say(40)), (None, None), (70, ""), (71, "x " * 50000 + "One two THREE four five six seven: eight!" + " y" * 50000)]
    bench, docs = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame([(*x, "c") for x in rows], DOCS + ", bad string")
    for least in (4, 1):
        assert sorted(map(tuple, decontaminate.leaks(docs, bench, least).collect()), key=repr) == _naive_leaks(rows, items, least)
    kept = sorted(map(repr, (tuple(x)[:2] for x in decontaminate.drop_contaminated(docs, bench).collect())))
    assert kept == sorted(repr(x) for x in rows if not _naive_leaks([x], items))  # each row by its own text
    assert (71, 60, 100000, 100040, 8) in _naive_leaks(rows, items)


# ---- near duplicates, components ----------------------------------------------------------------------------


def test_near_duplicates_in_blocks_and_hot_buckets_are_the_same(spark, monkeypatch):
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(150):  # a large group of copies that differ, some exact
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"z{r.randrange(10**6)}" for _ in range(30))) for i in range(30)] + [(2000 + i, rows[3][1]) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    whole = sorted(map(tuple, near_dup.near_duplicate_groups(docs).collect()))
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(near_dup, "HOT", 3)
    monkeypatch.setattr("chunkloom.plans.skew.COPIES", 10)
    assert sorted(map(tuple, near_dup.near_duplicate_groups(docs).collect())) == whole
    assert sum(kept for _, _, kept in whole) < 40


def test_components_against_brute_force(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500, 500 + i) for i in range(1, 90)] + [(600 + i, 601 + i) for i in range(40)] + [(7, 7), (1, None)]
    root = list(range(700))
    for a, b in edges:
        if b is not None:
            lo, hi = sorted((root[a], root[b]))
            root = [lo if x == hi else x for x in root]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    met = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert got == {x: root[x] for x in met}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    own = spark.createDataFrame([(i, i % 3) for i in range(20)], "id bigint, k bigint")
    assert {x.id: x.rep for x in named(own, own.groupBy("k").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "id", ["k"]).collect()} == {i: i % 3 for i in range(20)}


# ---- packing ------------------------------------------------------------------------------------------------


def test_shards_follow_running_sums(spark):
    r = random.Random(4)
    rows = [(r.choice([r.randrange(50), 10**12 + r.randrange(50), 7]), r.randrange(4), 0, r.randint(1, 30)) for _ in range(400)]
    keyed = spark.createDataFrame([(i, h, k, n) for k, (i, h, _, n) in enumerate(rows)], "i bigint, h bigint, salt bigint, n bigint")
    want, total = {}, 0
    for i, h, k, n in sorted((i, h, k, n) for k, (i, h, _, n) in enumerate(rows)):
        want.setdefault(total // 100, (i, h, k))
        total += n
    firsts = pack_dp.shards_of(keyed, 100)
    assert firsts == sorted(want.values())
    keys = sorted((i, h, k) for k, (i, h, _, n) in enumerate(rows))
    got = pack_dp.shard_numbers(firsts, *(np.array(c, np.int64) for c in zip(*keys)))
    assert got.tolist() == [max(k for k, f in enumerate(firsts) if f <= x) for x in keys]
    assert pack_dp.shards_of(keyed.where("false")) == []


def test_packing_of_equal_rows_and_null_ids(spark):
    rows = [(None, "Same text. " * 40)] * 60 + [(5, "Other text. " * 40)] * 90 + [(i, f"text {i}. " * 10) for i in range(30)] + [(108, None), (109, "")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], DOCS + ", shard int")
    p = pack_dp.packed(docs, window=64, shard_chars=5000).collect()
    chars, shards = {}, {}
    for x in sorted(p, key=lambda x: (x.shard, x.window)):
        for d, a, b in zip(x.doc_ids, x.start_chars, x.end_chars):
            chars[d] = chars.get(d, 0) + b - a
            shards.setdefault(d, set()).add(x.shard)
    want = {}
    for d, t in rows:
        want[d] = want.get(d, 0) + len(t or "")
    assert chars == {d: n for d, n in want.items() if n} and len(shards[None]) > 3 and len(shards[5]) > 3
    m = pack_bfd.packed_ids(docs, window=64, shard_chars=5000).collect()
    pieces = {}
    for x in m:
        for d, a, b in zip(x.doc_ids, x.cu_seqlens, x.cu_seqlens[1:]):
            pieces[d] = pieces.get(d, 0) + b - a
    one = {d: sum(b - a for x in pack_bfd.packed_ids(docs.where(F.col("doc_id").eqNullSafe(d) & F.col("text").isNotNull()).limit(1), window=64).collect() for a, b in zip(x.cu_seqlens, x.cu_seqlens[1:])) for d in (None, 109)}
    assert pieces[None] == 60 * one[None] and pieces[109] == 1 and 108 not in pieces and len({x.shard for x in m if 5 in x.doc_ids}) > 3


# ---- pages, toxicity, vectors ---------------------------------------------------------------------------------


@pytest.mark.parametrize("page", ["<a " * 350_000, "<span>" * 80_000 + "</b>" * 100_000, "<div>" * 200_000, "<b><div>" + "<span>" * 70_000 + "</b>" * 90_000, "<span>" * 80_000 + "<p></p>" * 70_000, "<!a " * 250_000, "<title" * 150_000, "<head>" * 150_000, '<a ">"' * 170_000 + "'", "<script>" + "</script " * 100_000], ids=lambda p: p[:8])
def test_pages_take_time_in_proportion(page):
    began = time.time()
    dom = html_content.Dom(page)
    html_content.title_of(page)
    html_content.marginals(html_content.Forest([dom]), html_content.prior())
    assert time.time() - began < 5


def test_pages_edges(spark):
    rows = [(1, None, 0), (1, None, 0), (2, "<p>a</p>" * 3, 1), (2, "<p>a</p>" * 3, 1), (3, "", 2), (4, "<p>one <b>two</b> " + "three " * 100_000, 2), (5, "1 < 2 <3 & <p title='x>y'>z</p><!-- <p>no</p> -->w", 1), (6, "<p id='never closed>a</p><p>b</p>", 1)]
    got = {}
    for x in html_content.extracted(spark.createDataFrame(rows, "page_id bigint, html string, text int"), html_content.prior()).collect():
        got.setdefault(x.page_id, []).append(x)
    assert got[2][0] == got[2][1] and got[1][0].text == "" and got[4][0].words == 100_002
    d = html_content.Dom(rows[6][1])
    assert [p[1] for p in d.pieces] == ["1 < 2 <3 &", "z", "w"]
    assert [p[1] for p in html_content.Dom(rows[7][1]).pieces] == ["a", "b"]
    deep = html_content.Dom("<div>" * 600 + "x")
    assert len(deep.tag) == 601 and deep.parent[600] == deep.parent[599] == 511


def test_toxicity_windows_against_brute_force(spark):
    r = random.Random(6)
    texts = ["", "!!!", "a"] + [" ".join(r.choice(["ab", "cd", "ef", "gh", "ij", "kl"] + [f"w{k}" for k in range(20)]) for _ in range(r.randint(1, 70))) for _ in range(40)]
    table = np.random.default_rng(1).normal(size=1 << toxicity.BITS)
    best, where = toxicity.worst_windows(Words(texts), table)
    score = {}
    for t in texts:
        for w in t.split():
            score[w] = toxicity.worst_windows(Words([w]), table)[0][0]
    for t, b, k in zip(texts, best, where):
        w = [x for x in t.split() if x.isalnum()]
        size = min(len(w), toxicity.WINDOW)
        means = [sum(score[x] for x in dict.fromkeys(w[s : s + size])) / size for s in range(len(w) - size + 1)] if w else []
        assert not w and b == -np.inf or np.isclose(b, max(means)) and np.isclose(means[k], max(means)) and k == next(i for i, m in enumerate(means) if m >= max(means) - 1e-9)
    m = toxicity.Model(table, 0.0, 0.5)
    rows = [(1, "ab cd"), (1, "ab cd"), (None, None), (2, "")]
    got = sorted(map(tuple, toxicity.scored(spark.createDataFrame([(*x, 3.0) for x in rows], DOCS + ", score double"), m).collect()), key=repr)
    assert got[0] == got[1] and len(got) == 4 and (None, 0.0, 0, False) in got


def test_toxicity_trains_and_scores_the_same_bag():
    texts = ["bad bad bad word here"] * 6 + ["good nice word there"] * 6
    bag, words = toxicity._Bag(texts), Words(texts)
    table = np.random.default_rng(2).normal(size=1 << toxicity.BITS)
    n = np.diff(bag.first)
    mine = toxicity.window_means(bag.means(table), toxicity.previous(bag.inverse, bag.first), bag.first[:-1], n)
    assert np.allclose(mine, toxicity.worst_windows(words, table)[0])


def test_vectors_in_split_shards_with_clashing_columns(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 16))
    x = np.concatenate([x, x[:150] + 0.03 * rng.normal(size=(150, 16)), np.repeat(x[9:10], 40, 0)]).astype(np.float32)
    monkeypatch.setattr(vector_graph, "CELLS", 2)
    monkeypatch.setattr(vector_graph, "TOO_LARGE", 2)
    monkeypatch.setattr(vector_graph, "CHUNK", 100)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1, "c") for i, r in enumerate(x)], "vec_id bigint, embedding array<float>, id int, rep string")
    members = vector_graph._members(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), vector_graph.centroids(vector_graph._unit(x.astype(np.float64)), 2), 2, 60)
    sizes = [r["count"] for r in members.groupBy("shard").count().collect()]
    assert members.select("id").distinct().count() == len(x) and max(sizes) <= 240
    u = vector_graph._unit(x.astype(np.float64))
    near = (u @ u.T >= vector_graph.COSINE).sum(1) - 1
    got = {r.vec_id: r.n_near for r in vector_graph.near_duplicate_vectors(df, shard=60).collect()}
    assert np.mean([got[i] == near[i] for i in range(len(x))]) > 0.98
