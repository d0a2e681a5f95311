"""The ten operators: edge cases, brute-force comparisons, round trips and held-out accuracy on small data."""

import io
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import _bpe, decontaminate, html_content, language_mix, near_dup, pack_bfd, pack_dp, pii, toxicity, vector_graph, warc
from chunkloom.llm._text import Words, shingles

scrub = lambda text: pii.scrub(text, b"key")

ODD = [(1, None, "en", "s", 0, 1), (2, "", "en", "s", 0, 1), (3, "!!! ???", None, None, None, 1), (4, "same words here again and again", "en", "s", 1, 2), (4, "same words here again and again", "en", "s", 1, 2), (None, "nobody knows this one", "en", "s", 1, 2), (5, "long " * 60000, "en", "s", 1, 3)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _gone bigint"  # a clashing extra column


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "same words here again and again"), (2, None), (3, "x"), (None, "nobody knows this one")], "item_id bigint, text string")


def test_decontamination_edges(odd, none, bench):
    got = {(r.doc_id, r.item_id, r.n_words) for r in decontaminate.leaks(odd, bench).collect()}
    assert got == {(4, 1, 6)}
    assert decontaminate.leaks(none, bench).count() == 0
    assert sorted(r.doc_id or 0 for r in decontaminate.drop_contaminated(odd, bench).collect()) == [0, 1, 2, 3, 5]
    assert decontaminate.drop_contaminated(odd, bench.where("false")).count() == len(ODD)


def test_decontamination_offsets_point_into_the_original(spark, bench):
    text = "Ünïcode, first: SAME   words—here\nAgain and, again!"
    d = spark.createDataFrame([(7, text)], "doc_id bigint, text string")
    r = decontaminate.leaks(d, bench).first()
    assert text[r.start_char : r.end_char] == "SAME   words—here\nAgain and, again"


def test_near_duplicates_edges(odd, none):
    g = {r.doc_id: (r.group_id, r.is_kept) for r in near_dup.near_duplicate_groups(odd).collect()}
    assert g == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True)}
    assert near_dup.near_duplicate_groups(none).count() == 0
    kept = near_dup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5]


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(r.randint(0, 99)) for _ in range(r.randint(3, 80))) for _ in range(60)]
    for t in list(texts):
        w = t.split()
        for _ in range(r.randint(0, 2)):
            copy = list(w)
            copy[r.randrange(len(w))] = "changed"
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        h, first = shingles(Words([t]), near_dup.SHINGLE)
        sets.append(set(h[first[0] : first[1]].tolist()))
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= near_dup.THRESHOLD * len(sets[a] | sets[b]):
            lo, hi = sorted((root[a], root[b]))
            root = [lo if x == hi else x for x in root]
    got = {x.doc_id: x.group_id for x in near_dup.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    right = sum(got[i] == root[i] for i in range(len(texts)))
    assert right >= 0.97 * len(texts)


def test_pii_values():
    out, kinds = scrub("a.b1@mail.example.com, +1 (499) 555-6503, 4994226020900891, 174.91.180.241, 28.02.2021, 123-45-6789")
    assert kinds == ["email", "phone", "card", "ip", "date", "ssn"]
    assert not any(x in out for x in ("a.b1@", "555-6503", "4994226020900891", "174.91.180.241", "28.02.2021", "123-45-6789"))
    card = [w.strip(",") for w in out.split() if len(w.strip(",")) == 16 and w.strip(",").isdigit()][0]
    assert pii.luhn(card[:-1]) == int(card[-1])
    for same in ("2021-02-28", "02/28/2021", "28 Feb 2021"):
        assert scrub(same)[1] == ["date"]
    one, two = scrub("2021-02-28")[0], scrub("28.02.2021")[0]
    assert one.split("-") == two.split(".")[::-1]
    clean = "v2.0.1 on 31.02.2021, 4994226020900892 and 999.1.1.1"
    assert scrub(clean) == (clean, [])


def test_pii_permutation_is_a_bijection():
    assert sorted(pii.permute(x, 1000, b"k", "t") for x in range(1000)) == list(range(1000))


def test_pii_edges(odd, none):
    out = pii.pseudonymise(odd, b"k")
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert pii.pseudonymise(none, b"k").count() == 0


def test_language_edges(odd, none):
    m = language_mix.fit(odd)
    r = {x.doc_id: x for x in language_mix.identified(odd, m).collect()}
    assert not r[1].accepted and not r[2].accepted and not r[3].accepted and r[4].main_lang == "en"
    assert language_mix.keep_identified(odd, m).columns == odd.columns
    assert language_mix.identified(none, m).count() == 0
    empty = language_mix.fit(none)
    assert language_mix.keep_identified(odd, empty).count() == len(ODD)


def test_language_mixture_and_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = language_mix.fit(docs)
    rows = docs.collect()
    pi, _, n = language_mix.mixtures([r.text for r in rows], m)
    names = [*m.names, "und"]
    big = [i for i in range(len(rows)) if n[i] > 20]
    assert np.mean([names[pi[i].argmax()] == rows[i].lang for i in big]) > 0.95
    de, es = (next(r.text for r in rows if r.lang == x and len(r.text) > 900)[:800] for x in ("de", "es"))
    both = dict(zip(names, language_mix.mixtures([de + " " + es], m)[0][0]))
    assert both["de"] > 0.3 and both["es"] > 0.3
    assert language_mix.mixtures(["qzxv jkwq xxqj vvkz"], m)[0][0][-1] > 0.5
    # every subset, EM to the end: the chosen set must be as good up to early stopping
    for text in (de, es, de + es):
        w = Words([text])
        p, _ = language_mix.word_likelihoods(w, m)
        best = -np.inf
        for k in range(1, len(names) + 1):
            for s in itertools.combinations(range(len(names)), k):
                a = np.zeros((1, len(names)))
                a[0, list(s)] = 1
                best = max(best, language_mix.em(p, w.first, a, 60)[1][0] - language_mix.PENALTY * k * np.log(len(p) + 1))
        got = language_mix.mixtures([text], m)[0]
        mine = language_mix.em(p, w.first, (got > 0).astype(float), 60)[1][0] - language_mix.PENALTY * (got > 0).sum() * np.log(len(p) + 1)
        assert mine >= best - 3


def test_dynamic_programme_against_brute_force():
    r = random.Random(1)
    for _ in range(200):
        n, w = r.randint(1, 30), r.randint(5, 30)
        size, kind = [r.randint(1, w) for _ in range(n)], [r.choice([0, 1, 1, 2]) for _ in range(n)]
        pen, f = [0, 4, 9], [0] + [10**9] * n
        for j in range(1, n + 1):
            for i in range(j):
                s = sum(size[i:j])
                if s <= w:
                    f[j] = min(f[j], f[i] + w - s + pen[kind[j - 1]])
        cuts = pack_dp.best_cuts(np.array(size), np.array(kind), w, 4, 9)
        cost = sum(w - sum(size[a:b]) + pen[kind[b - 1]] for a, b in zip([0, *cuts], cuts))
        assert cost == f[n]


def test_packing_covers_every_text_once(spark, odd, none):
    docs = odd.where("doc_id <> 4 or doc_id is null")
    rows = sorted(pack_dp.packed(docs, window=64, shard_chars=100000).collect(), key=lambda r: (r.shard, r.window))
    seen = {}
    for r in rows:
        assert 0 < r.n_tokens <= 64 and r.padding == 64 - r.n_tokens
        for d, a, b in zip(r.doc_ids, r.start_chars, r.end_chars):
            assert seen.get(d, 0) == a
            seen[d] = b
    assert seen == {None: 21, 3: 7, 5: 300000}
    assert pack_dp.packed(none).count() == 0


def test_best_fit_against_linear_search_and_round_trip(spark, odd, none, tmp_path):
    r = random.Random(2)
    for _ in range(100):
        w, sizes = r.randint(3, 40), []
        sizes = [r.randint(1, w) for _ in range(r.randint(1, 50))]
        room, last, t, want = [], {}, 0, [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = [(x, -last[k], k) for k, x in enumerate(room) if x >= sizes[i]]
            k = min(fit)[2] if fit else len(room)
            room += [w] * (not fit)
            want[i], room[k], last[k], t = k, room[k] - sizes[i], t + 1, t + 1
        assert pack_bfd.best_fit_decreasing(np.array(sizes), w).tolist() == want
    p = pack_bfd.packed_ids(odd.where("doc_id <> 4"), window=32).cache()
    parts = {}
    for x in p.collect():
        assert len(x.ids) == len(x.positions) == 32
        for k, (d, n) in enumerate(zip(x.doc_ids, x.pieces)):
            a, b = x.cu_seqlens[k : k + 2]
            assert x.positions[a:b] == list(range(b - a))
            parts.setdefault(d, {})[n] = x.ids[a:b]
    for d, text in ((2, ""), (3, "!!! ???"), (5, "long " * 60000)):
        ids = [i for n in sorted(parts[d]) for i in parts[d][n]]
        assert ids[-1] == _bpe.EOS and _bpe.decode(ids[:-1]) == text
    assert pack_bfd.packed_ids(none).count() == 0
    manifest = pack_bfd.write_matrices(p, str(tmp_path)).collect()
    shard = manifest[0].shard
    assert np.load(tmp_path / f"ids-{shard:08d}.npy").shape == (manifest[0].n_rows, 32)


def test_toxicity(spark, odd, none):
    r = random.Random(3)
    word = lambda: "".join(r.choice("bcdlmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    texts, y = [], []
    for i in range(600):
        w = [word() for _ in range(r.randint(5, 120))]
        if i % 4 == 0:
            for _ in range(1 + len(w) // 30):
                w[r.randrange(len(w))] = "vexhog" + r.choice(["", "s", "ing", "ed"])
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    m = toxicity.train(texts[:500], np.array(y[:500]))
    w = Words(texts[500:] + ["la mi vexhogger so ti"])  # a misspelling that was never seen
    hit = toxicity.worst_windows(w, m.table)[0] + m.bias > m.threshold
    assert np.mean(hit[:-1] == np.array(y[500:], bool)) >= 0.9 and hit[-1]
    got = {x.doc_id: x for x in toxicity.scored(odd, m).collect()}
    assert got[1].score == 0 and not got[2].is_toxic and toxicity.scored(none, m).count() == 0
    one = toxicity.train(["a b"], np.array([0]))
    assert toxicity.scored(odd, one).where("is_toxic").count() == 0


def test_html_marginals_and_extraction(spark):
    page = html_content.Dom("<nav><a href=x>home page</a></nav><div><p>Words of <b>the text</b>, more.<p>Second one</div><script>no()</script>")
    f, m = html_content.Forest([page]), html_content.prior()
    p, _ = html_content.marginals(f, m)
    own, z, acc = m.node[f.features].sum(1), 0.0, np.zeros(len(page.tag))
    for y in itertools.product((0, 1), repeat=len(page.tag)):
        s = np.exp(sum(own[i] * y[i] for i in range(len(y))) + sum(m.edge[f.tag[i], y[page.parent[i]], y[i]] for i in range(1, len(y))))
        z, acc = z + s, acc + s * np.array(y)
    assert np.allclose(acc / z, p)
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x"), (3, "<div>" * 300 + "deep")], "page_id bigint, html string")
    got = {r.page_id: r for r in html_content.extracted(rows, m).collect()}
    assert got[1].text == got[2].text == "" and got[3].n_nodes == 301
    assert html_content.extracted(rows.where("false"), m).count() == 0


def test_html_held_out_accuracy(spark, sf):
    pages, docs = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    data = [(html_content.Dom(h), t) for h, t in html_content.labelled_pages(pages, docs)]
    data = [(d, y) for d, t in data if (y := html_content.label(d, t)) is not None]
    half = len(data) // 2
    m = html_content.train([d for d, _ in data[:half]], [y for _, y in data[:half]])
    f = html_content.Forest([d for d, _ in data[half:]])
    p, _ = html_content.marginals(f, m)
    y, has = np.concatenate([y for _, y in data[half:]]), f.own > 0
    assert half > 3 and np.mean(((p >= 0.5) == y)[has]) > 0.85


def test_warc_links_and_edges(spark):
    base = dict.fromkeys(("file", "target_uri", "warc_date", "http_start"), None) | {"offset": 0, "headers": {}, "http_headers": {"set-cookie": ["a=1", "b=2"]}, "payload": b"", "truncated": False}
    rows = [("response", "r1", []), ("request", "q1", ["r1"]), ("metadata", "m1", ["q1"]), ("response", "r2", ["q2"]), ("request", "q2", []), ("metadata", "m9", ["gone"]), ("request", "q1", ["r1"]), ("response", None, None)]
    recs = spark.createDataFrame([base | {"warc_type": t, "record_id": i, "concurrent_to": c} for t, i, c in rows], warc.SCHEMA)
    got = {r.capture_id: r for r in warc.assemble(recs).collect()}
    assert got["r1"].request.record_id == "q1" and [m.record_id for m in got["r1"].metadata] == ["m1"] and got["r1"].n_records == 3
    assert got["r2"].request.record_id == "q2" and got["m9"].response is None and len(got) == 4
    assert got["r1"].response.headers == {"set-cookie": ["a=1", "b=2"]}
    wide = recs.withColumn("id", F.lit("x")).withColumn("capture", F.lit(1)).withColumn("payload", F.expr("if(record_id = 'm1', cast(repeat('long ', 200000) as binary), payload)"))
    assert len({r.capture_id: r for r in warc.assemble(wide).collect()}["r1"].metadata[0].payload) == 10**6
    tied = spark.createDataFrame([base | {"warc_type": t, "record_id": i, "concurrent_to": c} for t, i, c in [("response", "b", []), ("response", "a", []), ("request", "q", ["b", "a"])]], warc.SCHEMA)
    assert {r.capture_id: r.n_records for r in warc.assemble(tied).collect()} == {"a": 2, "b": 1}
    assert warc.assemble(recs.where("false")).count() == 0


def test_warc_headers_that_repeat():
    row = warc.row_of("f", 0, [("warc-type", "response"), ("content-type", "application/http"), ("x", "1"), ("x", "2")], b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\n", None)
    assert dict(row["headers"])["x"] == ["1", "2"] and dict(row["http_headers"])["set-cookie"] == ["a", "b"]


def test_warc_files(spark, tmp_path):
    import gzip

    data = [warc.transaction(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in data)[:-9])
    r = warc.read_warc(spark, str(tmp_path)).cache()
    assert r.where("file like '%a.warc'").count() == 9 and r.where("file like '%gz'").count() == 9
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(data[0]) + gzip.compress(data[1] * 50)[:-40])
    broken = warc.read_warc(spark, str(tmp_path / "c.warc.gz")).orderBy("offset").collect()
    assert len(broken) > 3 and [x.truncated for x in broken[:-1]] == [False] * (len(broken) - 1)
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n"
    assert warc.http_parts(chunked)[2] == b"abcde"
    assert [x["payload"] for x in warc.parse(io.BytesIO(b"junk\n" + data[0]))][0] == b"<p>0</p>"


def test_vector_groups_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x = np.concatenate([x, x[:60] + 0.03 * rng.normal(size=(60, 16)), x[:5], np.repeat(x[7:8], 30, 0) + 0.02 * rng.normal(size=(30, 16))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0] * 3), (None, [1.0] * 16), (3, [9.0] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in vector_graph.near_duplicate_vectors(df, shard=100).collect()}
    assert all(got[i].group_id == i and got[i].n_near == 0 for i in range(900, 905))
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= vector_graph.COSINE).sum(1) - 1
    ids = [i for i in range(len(x)) if i != 3]
    assert sum(min(got[i].n_near, near[i]) for i in ids) >= 0.9 * near[ids].sum()
    assert all(got[i].n_near <= near[i] + 1 for i in ids)
    assert vector_graph.near_duplicate_vectors(df.where("false")).count() == 0


def _exact_groups(x):
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= vector_graph.COSINE
    group = np.arange(len(x))
    while (low := np.where(near, group, len(x)).min(1)).tolist() != group.tolist():
        group = low
    return near.sum(1) - 1, group


def test_vector_groups_of_many_shards_are_exact(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    one, two = x[0] + 0.1 * rng.normal(size=(600, 16)), x[1] + 0.17 * rng.normal(size=(400, 16))  # dense, and looser than the radius
    x = np.concatenate([x, one, two, x[:20] + 0.3 * rng.normal(size=(20, 16)), one[:9]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    near, group = _exact_groups(x)
    got = {r.vec_id: r for r in vector_graph.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), shard=64).collect()}
    assert near[300:900].min() > 500  # a group of about ten shards
    wrong = [i for i in range(len(x)) if got[i].n_near != near[i] or got[i].group_id != group[i]]
    assert not [i for i in wrong if near[i] >= 64] and len(wrong) <= 0.01 * len(x)


def test_vector_search_that_stays_below_its_recall_ends_in_brute_force(spark, monkeypatch):
    def blind(cosine, beam):
        import pyarrow as pa

        return lambda table: pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})

    monkeypatch.setattr(vector_graph, "_search", blind)
    monkeypatch.setattr(vector_graph, "ROUNDS", 1)
    monkeypatch.setattr(vector_graph, "BLOCK_BYTES", 2000)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 16))
    x = np.concatenate([x, x[:30] + 0.03 * rng.normal(size=(30, 16))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    near, group = _exact_groups(x)
    got = {r.vec_id: r for r in vector_graph.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    assert all(got[i].n_near == near[i] and got[i].group_id == group[i] for i in range(len(x)))


def test_vector_recall_counts_each_vector_once(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    group = list(itertools.combinations(range(20), 2))
    true, audited = pairs([*group, (30, 31), (32, 33)]), spark.createDataFrame([(i,) for i in [*range(20), 30, 32]], "id bigint")
    assert abs(vector_graph._recall(true, pairs(group), audited) - 20 / 22) < 1e-9  # 190 of 192 pairs
    assert vector_graph._recall(true.where("false"), pairs(group), audited) == 1


def test_language_of_a_small_share_stays_in_a_long_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = language_mix.fit(docs)
    words = {}
    for r in docs.where("text is not null").orderBy("doc_id").collect():
        words.setdefault(r.lang, []).extend(r.text.split())
    long = " ".join((words["de"] * 20)[:20000] + words["es"][:120])
    pi, _, n = language_mix.mixtures([long], m)
    share = dict(zip(m.names, pi[0]))
    assert share["de"] > 0.95 and 0.003 < share["es"] < 0.02
    # taking it out costs more likelihood than the penalty gives
    w = Words([long])
    p, _ = language_mix.word_likelihoods(w, m)
    sets = np.repeat((pi > 0).astype(float), 2, 0)
    sets[1, m.names.index("es")] = 0
    both, less = (language_mix.em(p, w.first, s[None], 60)[1][0] for s in sets)
    assert both - less > language_mix.PENALTY * np.log(n[0] + 1)


def test_pii_phones_of_any_area_code():
    seen = set()
    for phone in ("+1 (017) 555-7713", "+1 (171) 555-2028", "+1 (211) 555-2028", "(099) 123-4567", "017-555-7713", "+10175557713", "+1 (499) 055-6503"):
        out, kinds = scrub(f"call {phone} now")
        assert kinds == ["phone"] and phone not in out
        new = out[5:-4]
        assert len(new) == len(phone) and [c for c in new if not c.isdigit()] == [c for c in phone if not c.isdigit()]
        assert not pii._nanp(int("".join(c for c in new if c.isdigit())[-10:]))
        seen.add("".join(c for c in new if c.isdigit())[-10:])
    assert len(seen) == 5  # three of the seven are notations of one number


def test_pii_secrets_and_ibans_in_full():
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    for value in ("q7Rk" * 100, "z" * 90, jwt, "ab12!cd34%ef56", "x9" * 3000):
        for text in (f"token={value} end", f'secret: "{value}" end.'):
            out, kinds = scrub(text)
            new = out.split("=", 1)[1].split(" ")[0] if "=" in text[:6] else out.split('"')[1]
            assert kinds == ["secret"] and len(out) == len(text) and out.endswith(text[-4:])
            assert all(value[a : a + 40] != new[a : a + 40] for a in range(0, len(value), 40))
    assert scrub("password: welcome. Then") == ("password: welcome. Then", [])
    for iban in ("ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "AT61 1904 3002 3457 3201", "PL61 1090 1014 0000 0712 1981 2874"):
        alone = scrub(iban)[0]
        assert alone != iban
        for after in (" EUR", " 12 EUR", " USD7", ""):
            assert scrub(iban + after) == (alone + after, ["iban"])
    assert scrub("AT61 1904 3002 3457 3201 4994 2260 2090 0891")[1] == ["iban", "card"]


def test_near_duplicates_of_ids_with_two_texts(spark):
    r = random.Random(8)
    text = lambda: [f"w{r.randrange(10**6)}" for _ in range(40)]
    rows, pairs = [], {}
    for i in range(16):
        a, b = text(), text()
        pairs[i] = " ".join(a), " ".join(b)
        rows += [(i, pairs[i][0]), (i, pairs[i][1]), (100 + i, " ".join(["new", *a[1:]])), (200 + i, " ".join(["new", *b[1:]]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {x.doc_id: x.text for x in near_dup.drop_near_duplicates(docs).collect()}
    for i, (a, b) in pairs.items():
        # the copy of the text that stays goes, the copy of the other one doesn't
        assert (100 + i in kept, 200 + i in kept) == ((False, True) if kept[i] == a else (True, False))
