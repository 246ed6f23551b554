"""Each operator of the llm subpackage against brute force, round trips or held-out accuracy, and on odd tables."""

import base64
import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bpe, common, components, decontaminate, extract, idcoder, idfiles, minhash, quality, shards, topk, toxicity, warc
from tessera.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, component string"
ODD = ["", None, "a", " ", "hello world " * 3000, "x<|endoftext|>y", "日本語 ½²³ \x1c\xa0 a\n\n b '’s don't I'LL", "The same text.", "The same text.", "aaaaaaaaaaaaaaa", "\r\n\t", "🙂🙂 ok"]


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None, 7, "clash") for i, t in zip(ids, texts, strict=True)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe(spark, library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab 'çß9\n!é") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    got = {r.doc_id: r for r in bpe.encode_documents(docs(spark, texts), tokenizer_path(), with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()
    plain = {r.doc_id: tuple(r) for r in bpe.encode_documents(docs(spark, texts), tokenizer_path(), chunk_chars=50).collect()}
    assert plain == {i: tuple(r)[:4] for i, r in got.items()}
    assert bpe.encode_documents(empty(spark), tokenizer_path()).count() == 0
    assert bpe.encode_documents(docs(spark, ["a", "a"], [None, None]), tokenizer_path()).count() == 2
    back = bpe.decode_documents(bpe.encode_documents(docs(spark, texts), tokenizer_path(), with_ids=True), tokenizer_path())
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_topk(spark):
    rng = random.Random(2)
    texts = [words(rng, rng.randint(1, 60), 80) for _ in range(150)] + ["", None, "w1 w2", "w1 w2"]
    d = docs(spark, texts)
    p = topk.SearchParams(k=5, block=4, shard_terms=500, query_block=2, blocks_a_task=2, files_a_task=3, batch=2)
    got = topk.top_k(d, d.where("doc_id % 50 = 0 or doc_id >= 150").selectExpr("doc_id query_id", "text"), p).toPandas()
    bags = [{} for _ in texts]
    for i, t in enumerate(texts):
        for w in (t or "").split():
            bags[i][w] = bags[i].get(w, 0) + 1
    df, n = {}, len(texts)
    for b in bags:
        for w in b:
            df[w] = df.get(w, 0) + 1
    mean = sum(sum(b.values()) for b in bags) / n
    for q in [0, 50, 100, 150, 151, 152, 153]:
        s = []
        for i, b in enumerate(bags):
            x = sum(bags[q][w] * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w, c in b.items() if w in bags[q])
            if x > 0:
                s.append((-round(x, 6), i))
        g = got[got.query_id == q].sort_values("rank")
        best = sorted(s)[:5]
        assert g.doc_id.tolist() == [i for _, i in best] and g.score.tolist() == pytest.approx([-x for x, _ in best], abs=1e-5)
    assert topk.top_k(empty(spark), empty(spark).selectExpr("doc_id query_id", "text"), p).count() == 0


def test_topk_skips_blocks():
    rng = random.Random(3)
    got = [topk.terms(("needle " * 3 if i == 7 else "") + words(rng, 30, 5000)) for i in range(2000)]
    p = topk.SearchParams(k=1, block=8)
    shard = topk.Shard(topk.packed(np.arange(2000), got[:], p), 30.0, p)
    for query, want in (("needle", [7]), ("needle w1 w2", None), ("w3 w4 w5 w6", None)):
        t, n, _ = topk.terms(query)
        at, w = shard.known(t, n.astype(float))
        scores, bounds = shard.dense_parts([(at, w)])
        ids, best, read = shard.search(at, w, scores[0], bounds[0], *topk.NOTHING)
        full = np.zeros(2000)
        for a, x in zip(at, w, strict=True):
            lo, hi = shard.start[shard.first[a]], shard.start[shard.first[a + 1]]
            full[shard.doc[lo:hi]] += shard.weight[lo:hi] * x
        top = np.round(full, 6).max()
        assert ids.tolist() == [int(shard.ids[np.round(full, 6) == top].min())] and best[0] == pytest.approx(top, abs=1e-5)
        assert want is None or (ids.tolist() == want and read < 50)


def test_topk_bounds_blocks_by_their_dense_scores():
    """Two frequent terms that meet in one document only: no block without it can reach its score, though each holds both terms."""
    got = [topk.terms("left right" if i == 0 else f"{'left' if i % 2 else 'right'} x{i}") for i in range(512)]
    p = topk.SearchParams(k=1, block=8)
    shard = topk.Shard(topk.packed(np.arange(512), got, p), 2.0, p)
    t, n, _ = topk.terms("left right")
    at, w = shard.known(t, n.astype(float))
    scores, bounds = shard.dense_parts([(at, w)])
    ids, _, read = shard.search(at, w, scores[0], bounds[0], *topk.NOTHING)
    assert ids.tolist() == [0] and read == 1


@pytest.mark.parametrize("dense", [0.02, 0.3, 2.0])
@pytest.mark.parametrize("few", [0.0, 1.0])
def test_topk_ways(dense, few):
    """All shares of dense rows, with bounds always or at first only, give what the exhaustive search gives, and bounds leave documents unread."""
    rng = random.Random(int(10 * dense) + int(few))
    texts = [words(rng, rng.randint(0, 40), 300) + (" rare%d" % rng.randrange(40)) for _ in range(1200)]
    got = [topk.terms(t) for t in texts]
    p = topk.SearchParams(k=4, block=4, dense=dense, few=few, waves=(0.05, 0.3, 1))
    shard = topk.Shard(topk.packed(np.arange(1200), got[:], p), 20.0, p)
    plain = topk.Shard(topk.packed(np.arange(1200), got, topk.SearchParams(k=4, block=4, dense=2.0)), 20.0, topk.SearchParams(dense=2.0))
    reads = 0
    for q in ["rare1", "rare2 rare3 w1", texts[5], texts[6], "none", "", "w1 w2 w3"]:
        t, n, _ = topk.terms(q)
        at, w = shard.known(t, n * 1.5)
        scores, bounds = shard.dense_parts([(at, w)])
        ids, best, read = shard.search(at, w, scores[0], bounds[0], *topk.NOTHING)
        reads += read
        full = np.zeros(1200)
        for a, x in zip(*plain.known(t, n * 1.5), strict=True):
            lo, hi = plain.start[plain.first[a]], plain.start[plain.first[a + 1]]
            full[plain.doc[lo:hi]] += plain.weight[lo:hi] * x
        full = np.round(full, 6)
        order = sorted(np.flatnonzero(full > 0), key=lambda i: (-full[i], plain.ids[i]))[:4]
        assert ids.tolist() == plain.ids[order].tolist() and best.tolist() == pytest.approx(full[order].tolist(), abs=1e-5)
    assert few == 1.0 or dense > 0.1 or reads < 7 * shard.blocks


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers(spark, module):
    rng = random.Random(4)
    label = "toxic" if module is toxicity else "quality"
    bad = ["scumbag", "blockhead"] if module is toxicity else ["%%%", "$$$"]
    texts, y = [], []
    for _ in range(400):
        y.append(rng.random() < 0.4)
        w = words(rng, rng.randint(20, 60)).split()
        for _ in range(6 if y[-1] == (module is toxicity) else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
    ids = list(range(400))
    labels = spark.createDataFrame([(i, int(v), int(v)) for i, v in enumerate(y)] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, texts + ODD + ["none"], ids + list(range(1000, 1000 + len(ODD))) + [None])
    got = module.classify(d, labels).toPandas()
    assert len(got) == 401 + len(ODD) and got.score.between(0, 1).all()
    p = module.ToxicityParams() if module is toxicity else module.QualityParams()
    known = got[got.doc_id < 400]
    held = known.doc_id.map(lambda i: zlib.crc32(str(int(i)).encode()) % p.folds == p.held_out)
    assert (known.held_out == held).all() and (got.predicted == (got.score >= p.threshold)).all()
    out = known[held]
    assert (out.predicted == [int(y[int(i)]) for i in out.doc_id]).mean() > 0.9
    for none in (labels.limit(0), labels.where(f"{label} = 1")):
        assert module.classify(d, none).select("predicted").distinct().count() == 1
    assert module.classify(empty(spark), labels).count() == 0


def test_training_sample_is_bounded(spark):
    texts = [f"text {i % 5} {i}" for i in range(3000)] + ["long " * 100, "fine", None]
    ids = [7] * 1500 + [8] * 1500 + [9, 10, 11]
    labels = spark.createDataFrame([(7, 0), (8, 1), (8, 1), (9, 1), (10, 0), (10, 1), (11, 0)], "doc_id long, toxic int")
    got, y = common.labelled_sample(docs(spark, texts, ids), labels, "toxic", 1, 5, 10, 100)
    assert got == [min(texts[:1500]), min(texts[1500:3000])] and y.tolist() == [0, 1]  # one text an id, no long one, no id with both labels


def test_log_count_ratios():
    """Weights against naive Bayes log-count ratios computed plainly: features of the toxic class push up, equal ones not at all."""
    p = toxicity.ToxicityParams(bits=12, orders=(3,), least_rows=1)
    texts, y = ["abc xyz", "abc qqq", "def xyz", "def rrr"] * 15, np.array([1, 1, 0, 0] * 15, dtype=float)
    m = toxicity.ToxicityModel(p).fit(texts, y)
    train = [i for i in range(60) if i % 5 != 4]
    grams = [set(toxicity.ngrams(t, p.orders, p.bits).tolist()) for t in texts]
    n = [sum(y[i] == k for i in train) for k in (0, 1)]
    for g in set().union(*grams):
        c = [sum(g in grams[i] and y[i] == k for i in train) for k in (0, 1)]
        ratio = math.log((c[1] + 1) / (n[1] + 2)) - math.log((c[0] + 1) / (n[0] + 2))
        assert abs(m.weights[g]) < 0.3 if abs(ratio) < 0.2 else m.weights[g] * ratio >= 0
    s = m.score(["abc", "def", "", None])
    assert s[0] > 0.7 > s[1] and s[2] == s[3]


def test_quality_sgd_by_brute_force():
    """A few steps of the training against the same steps written out with dense vectors."""
    p = quality.QualityParams(bits=8, dim=3, epochs=2, orders=(3,))
    texts, y = ["aa bb", "cc dd ee", "aa cc", "bb"], np.array([1.0, 0.0, 1.0, 0.0])
    m = quality.QualityModel(p)
    v, out, bias = m.vectors.astype(float).copy(), np.zeros((3, 2)), np.zeros(2)
    rng, step = np.random.default_rng(2), 0
    for _ in range(2):
        for i in rng.permutation(np.arange(4)):
            share = np.bincount(quality.features(texts[i], p.orders, p.bits), minlength=256) / len(quality.features(texts[i], p.orders, p.bits))
            rate, step = p.rate * (1 - step / 8), step + 1
            hidden = share @ v
            z = np.exp(hidden @ out + bias)
            g = z / z.sum() - np.eye(2)[int(y[i])]
            back = out @ g
            out -= rate * np.outer(hidden, g)
            bias -= 0.1 * rate * g
            v -= rate * np.count_nonzero(share) * share[:, None] * back / 10
    m.fit(texts, y)
    assert np.allclose(m.margin, v @ (out[:, 1] - out[:, 0]), atol=1e-5) and np.allclose(m.bias, bias, atol=1e-6)


LAYOUTS = [
    ("<html><body><div id='top-menu'><a href='/'>Home</a> <a href='/x'>News</a></div><main><h1>Title here</h1><p>First line of text. It goes on.</p><p>Energy is <math><mi>E</mi> = <mn>5</mn></math> joules &amp; more.</p></main><aside class='col-12 col-md-4 mt-3 mb-3 d-flex flex-column align-items-start p-2 rounded sidebar'><p>Read also this. And that.</p></aside></body></html>",
     "Title here\nFirst line of text. It goes on.\nEnergy is E = 5 joules & more."),
    ("<body><header class='masthead'><span>The Paper</span></header><article><h2>Big day</h2><p>Some <em>words</em>\n\t here. Two of them.</p><ul><li>point one is here.<li>point two is there.</ul><div class='ad'>Buy now. Cheap.</div></article><section class='comments'><h3>Comments</h3><div class='comment'><p>I think so. Yes.</p></div></section><footer>&copy; 2024 Paper</footer></body>",
     "Big day\nSome words here. Two of them.\npoint one is here.\npoint two is there."),
    ("<body><div class='cookie-notice'><p>We use cookies. Accept them.</p><button>OK</button></div><div class='entry-content'><p>Only paragraph, with a <a href='/y'>link</a> in it. Fine.</p></div><form class='newsletter'><label>Your mail</label><input></form></body>",
     "Only paragraph, with a link in it. Fine."),
]


def test_extract_pages_written_by_hand():
    model = extract.trained(extract.ExtractParams())
    for html, text in LAYOUTS:
        assert model.text(html) == text


def test_extract(spark):
    p = extract.ExtractParams()
    model = extract.trained(p)
    wrong = total = 0
    for html, y in extract.training_pages(60, 12345):
        dom = extract.Dom(html)
        own, _ = model.marginals(dom)
        assert len(own) == len(y)
        shown = [i for i in range(len(y)) if not dom.hidden[i]]
        wrong += sum((own[i] >= 0.5) != y[i] for i in shown)
        total += len(shown)
    assert wrong / total < 0.03
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='/a'>menu</a></ul></nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;three sentences here. More of it.<br><p>Second paragraph with <b>bold</b> words.</article><footer>&copy; us</footer>"
    html = [page, "", None, "plain text only", "<p>", "<<<>", page]  # the page is written by hand
    pages = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(html)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract.extract_pages(pages).collect()}
    assert got[0].text == "A & B\nOne two three sentences here. More of it.\nSecond paragraph with bold words." == got[6].text
    assert got[1].text == got[2].text == "" and got[3].text == "plain text only" and got[0].n_chars == len(got[0].text)
    assert extract.extract_pages(pages.limit(0)).count() == 0


def test_marginals_are_exact():
    model = extract.TreeModel().fit(extract.training_pages(10, 1), extract.ExtractParams(epochs=2))
    dom = extract.Dom("<div class='nav'><p>a. b</p><ul><li><a>x</a></li></ul></div>")
    n = len(dom.parents)
    z, ones = 0.0, [0.0] * n
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        s = sum(y[i] * sum(model.weights.get(f, 0) for f in dom.features[i]) + (model.edges[dom.kinds[i]][y[dom.parents[i]]][y[i]] if dom.parents[i] >= 0 else 0) for i in range(n))
        z += math.exp(s)
        ones = [o + math.exp(s) * v for o, v in zip(ones, y, strict=True)]
    assert model.marginals(dom)[0] == pytest.approx([o / z for o in ones])


def test_shards(spark):
    texts = [f"t{i % 40}" for i in range(333)] + ["", None, "é", "dup", "dup", "dup"]
    ids = list(range(333)) + [400, 401, 402, 403, 403, None]
    p = shards.ShardParams(shards=8)
    got = shards.assign(docs(spark, texts, ids), p).toPandas()
    assert len(got) == len(texts) and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    counts = got.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    by = got.dropna(subset=["doc_id"]).set_index("doc_id")
    assert by.loc[402, "size"] == 3 and by.loc[401, "size"] == 1 and by.loc[401, "text_crc32"] == 0 and by.loc[5, "text_crc32"] == zlib.crc32(b"t5")
    again = shards.assign(docs(spark, texts[::-1], ids[::-1]).repartition(5), p).toPandas()
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert shards.assign(empty(spark)).count() == 0


def test_shards_of_a_row_repeated_often(spark, monkeypatch):
    monkeypatch.setattr(shards, "RUN", 7)
    got = shards.assign(docs(spark, ["same"] * 100 + ["other"] * 15, [3] * 100 + list(range(15)))).toPandas()
    assert len(got) == 115 and (got.doc_id == 3).sum() == 101
    counts = got.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 1023])
def test_feistel(spark, n):
    from pyspark.sql import functions as F

    df = spark.range(n).select("id", shards.permuted(F.col("id"), n, 5).alias("p")).select("id", "p", shards.permuted(F.col("p"), n, 5, inverse=True).alias("back"))
    rows = df.collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(texts, ids, k, percent=80):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = spaced(t)
        m = min(k, len(w))
        sets[i] = {tuple(w[j : j + m]) for j in range(len(w) - m + 1)} if w else set()
    top = {i: i for i in ids}

    def find(i):
        return i if top[i] == i else find(top[i])

    for a in ids:
        for b in ids:
            c = len(sets[a] & sets[b])
            if a < b and c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, k):
    rng = random.Random(5)
    texts = ODD[:]
    for _ in range(25):
        base = words(rng, rng.randint(1, 80)).split()
        for _ in range(rng.randint(1, 6)):
            w = base[:]
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            texts.append(" ".join(w))
    hub = words(rng, 70).split()  # a group whose near copies share large buckets
    for _ in range(60):
        w = hub[:]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        texts.append(" ".join(w))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    want = brute_components(texts, ids, k)
    for block in (200_000, 500):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, texts, ids), minhash.MinHashParams(words=k, block=block)).collect()}
        assert got == want


def test_minhash_blocks_give_no_links_inside_a_component():
    """Two groups of near copies in one bucket: a block gives one link a set and component, not all pairs of a group."""
    sets = [np.sort(np.array([*range(20), 1000 + i], dtype=np.uint64).view(np.int64)) for i in range(300)]
    lists = minhash._lists(np.concatenate(sets), [21] * 300)
    ids, component = np.arange(300), np.where(np.arange(300) < 100, 0, np.where(np.arange(300) < 250, 100, 250))
    few = pa.table({"id": ids, "component": component, "members": lists}).slice(100, 50)
    many = pa.table({"other": ids, "its_component": component, "its": lists})
    got = minhash._block(80)(few, many).to_pandas()
    assert len(got) == 100 and set(got.a) | set(got.b) == {0, 250, *range(100, 150)}
    assert minhash._block(80)(few, many.slice(100, 150)).num_rows == 0


def test_minhash_odd(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    got = minhash.near_duplicates(docs(spark, ["a b", "a b", "a b", None], [3, 3, None, 9])).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(3, 1, 3, True), (3, 1, 3, True), (None, 1, None, True), (9, 0, 9, True)]))


def test_minhash_same_id_with_two_texts(spark):
    a, b, c = "one two three four five six seven", "eight nine ten eleven twelve thirteen", "x y z u v w"
    got = sorted(map(tuple, minhash.near_duplicates(docs(spark, [a, b, a, c, b, "", None], [2, 2, 3, 5, 4, 2, 2])).collect()))
    assert got == sorted([(2, 3, 2, True), (2, 2, 2, True), (3, 3, 2, False), (5, 2, 5, True), (4, 2, 2, False), (2, 0, 2, True), (2, 0, 2, True)])
    hot = docs(spark, [a] * 700 + [a.upper() + " "] * 300 + [words(random.Random(i), 30) for i in range(60)], list(range(9, 709)) + list(range(1300, 1000, -1)) + list(range(2000, 2060)))
    rows = minhash.near_duplicates(hot).toPandas()
    assert len(rows) == 1060 and (rows[rows.doc_id < 2000].component_id == 9).all() and rows.kept.sum() == 61


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    top = {}

    def find(i):
        top.setdefault(i, i)
        return i if top[i] == i else find(top[i])

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in top}


def test_decontaminate(spark):
    rng = random.Random(7)
    item = "Farmer Smith sold 12 apples and 7 pears for 40 cents each at the market on a cold morning in late autumn"
    swapped = item.replace("Smith", "Jones").replace("12", "31").replace("7", "5").replace("40 cents", "90 dollars")
    repeated = "If a train covers 60 km in 60 minutes then how far does that same train travel in total during its journey"
    broken = repeated.replace("60 km in 60 minutes", "60 km in 45 minutes")
    filler = lambda: words(rng, 60)
    texts = [f"{filler()} {item} {filler()}", f"{filler()}. {swapped} {filler()}", filler(), f"{filler()} {repeated.replace('60', '80')} x", f"{filler()} {broken[:48]}", "", None, "short words of an item here", item.upper()]
    bench = spark.createDataFrame([(1, item, 0), (2, repeated, 0), (3, "short words of an item here", 0), (4, None, 0), (5, "", 0), (None, "x y z a b c d e f g h", 0)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (3, 2), (7, 3), (8, 1)}  # in capitals names are words, so only windows without names match
    assert got[0, 1] and not got[3, 2]
    left = decontaminate.decontaminated(docs(spark, texts), bench)
    assert {2, 4, 5, 6} == {r.doc_id for r in left.collect()}
    clash = docs(spark, texts).withColumnRenamed("source", "__BAD").withColumnRenamed("lang", "__bad_")
    assert decontaminate.decontaminated(clash, bench).columns == clash.columns and decontaminate.decontaminated(clash, bench).count() == 4
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def test_decontaminate_by_brute_force(spark):
    """Random items with names, numbers and units exchanged one to one, or not, against a plain comparison of windows."""
    rng = random.Random(12)
    names, units, vocab = ["Ana", "Bob", "Cleo", "Dov", "Eva"], ["km", "kg", "days"], [f"w{c}{d}" for c in "abcdefgh" for d in "xyz"]
    make = lambda: [rng.choice(vocab) if rng.random() < 0.7 else rng.choice([rng.choice(names), str(rng.randrange(3)), f"{rng.randrange(3)} {rng.choice(units)}"]) for _ in range(rng.randint(3, 14))]
    items = ["so " + " ".join(make()) for _ in range(25)]
    texts = []
    for _ in range(120):
        t, swap = rng.choice(items).split(), {}
        for i, w in enumerate(t):
            pool = names if w in names else ["4", "5", "6", "7"] if w.isdigit() else units if w in units else None
            if pool and rng.random() < 0.9:
                t[i] = swap.setdefault(w, rng.choice(pool)) if rng.random() < 0.8 else rng.choice(pool)
        texts.append(" ".join(["so", *(["filler"] * rng.randint(0, 2)), *t, *make()]))

    def tokens(text):
        out, last = [], None
        for i, w in enumerate(text.split()):
            kind = "N" if w.isdigit() else "U" if w in units and last == "N" else "P" if w in names and i else w
            out.append((kind, w.lower()))
            last = kind
        return out

    def hit(doc, item):
        a, b = tokens(doc), tokens(item)
        k = min(10, len(b))
        for j in range(len(b) - k + 1):
            y = b[j : j + k]
            verbatim = sum(f not in "NUP" for f, _ in y) < 5
            for i in range(len(a) - k + 1):
                x = a[i : i + k]
                if verbatim:
                    if [w for _, w in x] == [w for _, w in y]:
                        return True
                elif [f for f, _ in x] == [f for f, _ in y]:
                    pairs = [(p[1], q[1]) for p, q in zip(x, y, strict=True) if p[0] in "NUP"]
                    if len(set(pairs)) == len({p for p, _ in pairs}) == len({q for _, q in pairs}):
                        return True
        return False

    want = {(i, j) for i, d in enumerate(texts) for j, x in enumerate(items) if hit(d, x)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == want and 20 < len(want) < len(texts) * len(items)


def test_items_below_the_literal_gate(spark):
    items = ["What is 7 + 5?", "Compute 12 + 34 * 5 - 6 / 2 + 8 - 9 + 10 + 11.", "Anna, Bob, Carl, Dora and Emil have 3, 4, 5, 6 and 7 coins each.", "7"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rng = random.Random(8)
    filler = lambda: words(rng, 30)
    texts = [f"{filler()} {x} {filler()}" for x in items[:3]] + [items[0].replace("7", "8"), items[1].replace("34", "35"), items[2].replace("Carl", "Kurt").replace("4", "9").replace("7", "8"), filler(), ""]
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(0, 0): True, (0, 3): True, (1, 1): True, (2, 2): True, (2, 3): True}
    assert {r.doc_id for r in decontaminate.decontaminated(docs(spark, texts), bench).collect()} == {3, 4, 5, 6, 7}


def test_names_at_the_start_of_sentences(spark):
    item = "Tom buys 3 red pens. Ann buys 5 blue pens. Joe buys 9 green pens."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")

    def renamed(text, names):
        for a, b in zip(["Tom", "Ann", "Joe", "3", "5", "9"], [*names, "4", "6", "8"], strict=True):
            text = text.replace(a, b)
        return text

    other = renamed(item, ["Max", "Eva", "Kim"])
    texts = [item, other, f"Say {other}", other.replace("Max", "then Max"), renamed(item, ["Max", "Max", "Max"]), other.replace("pens", "cups")]
    got = {r.doc_id: (r.exact, r.n_windows) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {0: (True, 6), 1: (False, 6), 2: (False, 6), 3: (False, 6)}


def test_slots_must_agree(spark):
    w = "alpha beta gamma delta epsilon zeta eta"
    bench = spark.createDataFrame([(1, f"{w} 4 and 4 more things to say about it now")], "item_id long, text string")
    d = docs(spark, [f"{w} 9 and 9 more things to say about it now", f"{w} 9 and 8 more", f"{w} 9 and 8 more words of another kind"])
    got = {r.doc_id for r in decontaminate.contaminated(d, bench).collect()}
    assert got == {0}


def test_id_coder():
    rng = np.random.default_rng(8)
    for ids in (np.zeros(0), np.array([0]), np.full(5000, 50256), rng.integers(0, 50257, 9000), np.tile([5, 9, 2, 7], 2000), np.arange(1 << 12), rng.integers(0, 300000, 70000), np.minimum(rng.zipf(1.3, 6000), 1 << 22)):
        prior, blocks = idcoder.encode(ids.astype(np.uint32), block=512, lanes_at_once=7)
        again = idcoder.Prior.loaded(prior.dumped())
        assert (idcoder.decode(again, blocks, lanes_at_once=5) == ids).all()
    n, crc, raw = blocks[3]
    blocks[3] = (n, crc ^ 1, raw)
    with pytest.raises(ValueError, match="checksum of block 3"):
        idcoder.decode(prior, blocks)
    prior, again = idcoder.encode(ids.astype(np.uint32), block=512)
    assert (idcoder.decode(prior, again[2:4]) == ids[1024:2048]).all()  # blocks stand alone
    assert sum(len(b[2]) for b in idcoder.encode(np.tile([5, 9, 2, 7], 2000).astype(np.uint32))[1]) < 8000


def test_id_coder_tells_kinds_of_text():
    rng = np.random.default_rng(5)
    kinds = [rng.permutation(50257)[:512] for _ in range(4)]
    ids = np.concatenate([kinds[k][rng.integers(0, 512, 256)] for k in rng.integers(0, 4, 1600)])  # 9 bits an id, 11 where kinds are mixed
    prior, blocks = idcoder.encode(ids.astype(np.uint32))
    assert (idcoder.decode(idcoder.Prior.loaded(prior.dumped()), blocks) == ids).all()
    assert 8 * sum(len(b[2]) for b in blocks) < 9.2 * len(ids)
    wide = np.concatenate([np.arange(1 << 18), np.zeros(1 << 18), rng.integers(0, 1 << 18, 5000)]).astype(np.uint32)  # shares of 1 in 2**20 and of nearly all
    assert (idcoder.decode(*idcoder.encode(wide)) == wide).all()


def test_broken_blocks_of_ids():
    rng = np.random.default_rng(6)
    ids = rng.zipf(1.4, 70000).clip(max=3000).astype(np.uint32)
    prior, blocks = idcoder.encode(ids)
    assert len(prior.codes) > 1
    for at in (0, 3, 4, 9, 40, 500):
        n, crc, raw = blocks[1]
        bad = [bytearray(raw), raw[:at], raw[:at] + raw[at + 1 :]]
        bad[0][at] ^= 0xFF
        for b in bad:
            with pytest.raises(ValueError, match="checksum of block 1"):
                idcoder.decode(prior, [blocks[0], (n, crc, bytes(b)), *blocks[2:]])


def adaptive_order0_bits(ids, vocabulary):
    """Ideal length of adaptive counts with an escape, a new id at equal shares of the vocabulary."""
    counts, bits = {}, 0.0
    for i, x in enumerate(ids):
        bits -= math.log2(counts[x] / (i + 1)) if x in counts else math.log2(1 / (i + 1) / vocabulary)
        counts[x] = counts.get(x, 0) + 1
    return bits


def test_id_coder_beats_zlib_and_order_0(spark, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    ids = np.array([i for t in texts for i in [*library.encode(t or "", add_special_tokens=False).ids, 2]], dtype=np.uint32)
    prior, blocks = idcoder.encode(ids)
    coded = 8 * (sum(len(b[2]) for b in blocks) + len(prior.dumped()))
    parts = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
    assert coded < 8 * sum(len(zlib.compress(x.astype("<u2").tobytes(), 9)) for x in parts)
    assert coded < sum(adaptive_order0_bits(x.tolist(), 50257) for x in parts)


def test_library_encoder(library):
    rng = random.Random(9)
    bits = ["a", "b", " ", "'", "ç", "9", "\n", "!", "é", "'s", "'ll", " '", "  ", "\t", "'r", "e", "ve", "日", "½", "\uffff", "🙂", "<|endoftext|>", "\u2019"]
    texts = ODD + ["".join(rng.choice(bits if i % 5 == 0 else bits[:18]) for _ in range(rng.randint(1, 50))) for i in range(1500)]
    encoder = idfiles.LibraryEncoder(tokenizer_path(), 2, max_words=300)
    for lo in range(0, len(texts), 500):
        ids, lengths = encoder.encode(texts[lo : lo + 500])
        at = np.concatenate([[0], np.cumsum(lengths)])
        for i, t in enumerate(texts[lo : lo + 500]):
            assert ids[at[i] : at[i + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2]


def test_id_files(spark, library):
    texts = ODD * 3
    ids = list(range(len(texts)))[::-1]
    files = idfiles.write_files(docs(spark, texts, ids), tokenizer_path(), idfiles.IdFileParams(file_ids=50, partitions=3))
    got = idfiles.read_files(files, with_ids=True).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(got, texts[::-1], strict=True):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(want), want, zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert idfiles.read_files(idfiles.write_files(empty(spark), tokenizer_path())).count() == 0
    odd = idfiles.read_files(idfiles.write_files(docs(spark, ["a", "b", "b"], [None, 4, 4]), tokenizer_path())).collect()
    assert sorted((r.start, r.doc_id) for r in odd) == [(0, None), (2, 4), (4, 4)]


def test_id_files_many_small(spark, library):
    """Many small files have one table file and share tasks; rows stay those of whole texts."""
    texts = [f"text {i} " * (i % 7) for i in range(300)]
    files = idfiles.write_files(docs(spark, texts, list(range(300))), tokenizer_path(), idfiles.IdFileParams(partitions=40))
    assert files.count() > 20
    assert len(files.inputFiles()) == 1
    cores = spark.sparkContext.defaultParallelism
    for task_ids, tasks in ((10**6, cores), (1, files.count())):
        rows = idfiles.read_files(files, task_ids=task_ids)
        assert rows.rdd.getNumPartitions() == tasks
        start = 0
        for r, t in zip(rows.orderBy("doc_id").collect(), texts, strict=True):
            want = [*library.encode(t, add_special_tokens=False).ids, 2]
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
            start += len(want)


def test_warc(spark):
    html = ["<p>one</p>", "<p>two</p>", "<p>one</p>", "", None, "é\r\n\r\nWARC/1.1\r\n" * 50, "<p>one</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i} y\n" if i else None, h, "c") for i, h in enumerate(html)] + [(None, "u", "<p>one</p>", "c")], "page_id long, url string, html string, first string")
    files = warc.write_archives(pages, warc.WarcParams(least=0, archive_bytes=500))
    got = {r.page_id: r for r in warc.read_archives(files, with_payload=True).collect()}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        first = next((j for j in range(i) if (html[j] or "").encode() == raw), None)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first is None else "revisit", first)
        assert r.payload == ((h or "") if first is None else None)
    assert got[None].record_type == "response"
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


@pytest.mark.parametrize("limit", [None, 40])
def test_zip_directory(monkeypatch, limit):
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    records = [b"r" * 100, b"s" * 77]
    raw = warc.package(records, ["line\n"])
    seen = []

    def read(at, n):
        seen.append(n)
        return raw[at : at + n]

    z = warc.ZipDirectory(read, len(raw))
    at, n = z.place(warc.ARCHIVE)
    assert raw[at : at + n] == b"".join(records) and set(z.members) == set(zipfile.ZipFile(io.BytesIO(raw)).namelist())
    with pytest.raises(ValueError):
        warc.ZipDirectory(lambda at, n: b"\0" * n, 100)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("x", "y" * 100)
    with pytest.raises(ValueError, match="isn't stored"):
        warc.ZipDirectory(lambda at, n: packed.getvalue()[at : at + n], len(packed.getvalue())).place("x")


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(rows) <= spark.read.parquet(f"{sf}/documents.parquet").count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "benchmark", "encode"]


def test_pipeline_against_plain_steps(spark, tmp_path, library):
    """Planted toxic and poor documents, copies, items, nulls and repeated rows: what is left is what plain code leaves."""
    import corpus_pipeline

    rng = random.Random(13)
    good = [words(rng, rng.randint(30, 60)) for _ in range(260)]
    toxic = [" ".join(w if rng.random() < 0.7 else rng.choice(["scumbag", "blockhead"]) for w in words(rng, 40).split()) for _ in range(130)]
    poor = [" ".join(w if rng.random() < 0.6 else rng.choice(["%%%", "$$$"]) for w in words(rng, 40).split()) for _ in range(130)]
    item = "Farmer Smith sold 12 apples and 7 pears for 40 cents each at the market on a cold morning"
    more = [good[0], good[1] + " w1", f"{good[2]} {item}", f"{words(rng, 30)} {item.replace('12', '31').replace('Smith', 'Jones')}", good[5]]
    texts = good + toxic + poor + more
    ids = list(range(len(texts)))
    rows = list(zip(ids, texts, strict=True)) + [(4, good[4]), (4, good[4]), (None, good[7]), (None, good[7])]
    spark.createDataFrame([(i, t, "en", "s", len(t), "c") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __kept string").write.parquet(f"{tmp_path}/documents.parquet")
    n, k = len(good), len(good) + len(toxic)
    spark.createDataFrame([(i, int(not k <= i < k + len(poor)), int(n <= i < k)) for i in ids[: k + len(poor)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    top = brute_components(good + more, [*range(n), *ids[-len(more):]], 5)
    left = [(i, t) for i, t in zip([*range(n), *ids[-len(more):]], good + more, strict=True) if top[i][2] and "at the market on a cold morning" not in t] + [(-1, good[7])] * 2
    assert got == sorted((i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in left)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty_docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
        assert stage(spark, empty_docs, str(tmp_path)).columns == empty_docs.columns and stage(spark, empty_docs, str(tmp_path)).count() == 0
