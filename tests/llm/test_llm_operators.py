"""Operators on small tables, against brute force; odd rows everywhere."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import components, op01_substring, op02_language, op03_packing, op04_itq, op05_urls, op06_toxicity, op07_bpe, op08_simhash, op09_tiff, op10_shard, tiff

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long, __spans string"


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(30, 160))) for _ in range(25)]
    shared = " ".join(word() for _ in range(60))
    texts = base + base[:5] + [base[6] + " " + shared, shared + "\n" + base[7], base[8].replace(" ", "\t ", 3)]
    texts += [" ".join(base[9].split()[:-1] + ["changed"]), base[10].upper(), "x y " * 60, "a b c", "", None, None, " \n", "word", "long " + "z" * 20_000]
    texts += [base[11] + " " + base[12], "Q" + base[13]]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), None if t is None else len(t), "extra") for i, t in enumerate(texts)]
    return rows + [rows[3], (None, base[14], "en", None, 5, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def brute_substring(rows, window=35):
    words = [WORD.findall(t or "") for t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("block", [10_000, 0])
def test_substring(docs, block):
    rows = corpus()
    want = Counter((r[0], *x) for r, x in zip(rows, brute_substring([r[1] for r in rows]), strict=True))
    got = op01_substring.substring_dedup(docs, block=block, chunk=500)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept", "spans"]
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept").collect()) == want


def test_substring_compares_words(spark):
    a, b = "ab"
    for _ in range(11):
        a, b = a + b, b + a
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join([*words[:20], x, *words[20:]]) for x in (a, b)]  # one word differs, its polynomial hash doesn't
    got = op01_substring.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r["n_removed"] for r in got.collect()] == [0, 0]


def test_substring_takes_copies_of_a_row(spark):
    text = " ".join(f"w{i}" for i in range(50))
    got = op01_substring.substring_dedup(spark.createDataFrame([(1, text)] * 300 + [(2, "a " + text)], "doc_id long, text string")).collect()
    assert len(got) == 301 and {(r["doc_id"], r["n_removed"], r["kept"]) for r in got} == {(1, 50, ""), (2, 50, "a")}


def test_substring_empty(empty):
    assert op01_substring.substring_dedup(empty).count() == 0


def test_language(spark, docs, empty):
    train = spark.createDataFrame([(i, ("the thing and that other " if i % 2 else "le la les que ce une ") * 5, "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    model = op02_language.train(train)
    rows = spark.createDataFrame([(1, "the other thing", None, "h", None), (2, "les que la", "en", None, None), (3, "", "en", "h", "com"), (4, None, None, None, None), (5, "zzz", "fr", "h", "x"), (5, "zzz", "fr", "h", "x")], "doc_id long, text string, lang string, host string, suffix string")
    got = op02_language.identify(rows, model, declared="lang", host="host", suffix="suffix").orderBy("doc_id").collect()
    assert [r["text_language"] for r in got[:4]] == ["en", "fr", "und", "und"]
    assert [r["language"] for r in got] == ["en", "fr", "und", "und", "fr", "fr"] and [r["rejected"] for r in got] == [False, False, True, True, False, False]
    assert op02_language.identify(docs, None).where("language <> 'und' or not rejected").count() == 0
    assert op02_language.train(empty) is None and op02_language.identify(empty, model).count() == 0


def test_language_rejects_foreign_and_garbled_text(spark):
    rng = random.Random(3)
    words = {
        "en": "the and that other thing with from would there their about which when people could time after where house being little water".split(),
        "fr": "les que une pour dans avec cette leur nous vous plus comme mais tout faire temps monde autre sans encore maison petite".split(),
    }
    said = lambda ws, n=80: " ".join(rng.choice(ws) for _ in range(n))
    model = op02_language.train(spark.createDataFrame([(i, said(words[l]), l) for i, l in enumerate(["en", "fr"] * 60)], "doc_id long, text string, lang string"))
    foreign = "jest nie się który przez tylko jako może było żeby wszystko dzień wiele ludzie miasto życie świat ręka woda słowo dziecko".split()
    bad = ["".join(chr(rng.randint(33, 126)) for _ in range(500)), said([str(i) for i in range(9999)]), "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(200)), said(foreign)]
    good = [said(words["en"]), said(words["fr"]), said(words["en"], 6)]
    rows = [(i, t, d) for i, t in enumerate(good + bad) for d in ("en", None)]
    got = op02_language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, declared="lang").collect()
    assert len(got) == 14 and all(r["rejected"] == (r["doc_id"] >= 3) for r in got)


def test_language_learns_rare_and_many_languages(spark):
    rng = random.Random(5)
    words = {f"l{i:02d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for i in range(70)}
    said = lambda l: " ".join(rng.choice(words[l]) for _ in range(60))
    labels = ["l00"] * 400 + [l for l in words for _ in range(3)]
    train = spark.createDataFrame([(i, said(l), l) for i, l in enumerate(labels)], "doc_id long, text string, lang string")
    model = op02_language.train(train, sample=20)
    rows = spark.createDataFrame([(i, said(l), l) for i, l in enumerate(words)], "doc_id long, text string, own string")
    got = op02_language.identify(rows, model).collect()
    assert len(got) == 70 and all(r["language"] == r["own"] for r in got)


def test_language_prior_leaves_out_the_row_and_shrinks(spark):
    model = op02_language.Model(["en", "fr"], np.zeros((op02_language.BUCKETS, 2)))
    rows = spark.createDataFrame([(i, "a", "fr", "h") for i in range(40)] + [(100, "a", None, "h"), (101, "a", None, "other"), (102, "a", "en", "h")], "doc_id long, text string, lang string, host string")
    got = {r["doc_id"]: r for r in op02_language.identify(rows, model, declared="lang", host="host").collect()}
    overall = np.array([2, 41]) / 43
    no_suffix = (np.array([1, 40]) + 0) * 0  # null suffixes are no evidence
    host = (np.array([1, 40]) + op02_language.HOST * overall + no_suffix) / (41 + op02_language.HOST)
    assert got[100]["posterior"] == pytest.approx(host[1]) and got[101]["posterior"] == pytest.approx(overall[1])
    own = (np.array([0, 40]) + op02_language.HOST * overall) / (40 + op02_language.HOST) * [0.9, 0.1]
    assert got[102]["posterior"] == pytest.approx(max(own / own.sum()))


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(op07_bpe.vocabulary())
    rows = corpus()
    want = Counter((r[0], tuple(lib.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in rows)
    pieces = op03_packing.pack(docs, op07_bpe.vocabulary()).collect()
    ids = lambda p: np.frombuffer(p["ids_le"], "<u4").tolist()
    seqs, by = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["length"] == len(ids(p)) >= 1
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
        by[p["doc_id"], p["doc_tokens"]].append(p)
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    whole = Counter()
    for (key, n), ps in by.items():
        copies = sum(p["start"] == 0 for p in ps)
        tokens = {p["start"] + i: t for p in ps for i, t in enumerate(ids(p))}
        assert sum(p["length"] for p in ps) == copies * n and sorted(tokens) == list(range(n))
        whole[key, tuple(tokens[i] for i in range(n))] += copies
    assert whole == want
    digest = {(r["sequence_id"], r["offset"]): r["ids_crc32"] for r in op03_packing.packed_digest(op03_packing.pack(docs, op07_bpe.vocabulary())).collect()}
    assert all(digest[p["sequence_id"], p["offset"]] == zlib.crc32(p["ids_le"]) for p in pieces)
    assert op03_packing.pack(empty, op07_bpe.vocabulary()).count() == 0


def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 64))
    out = [base[i] for i in range(300)]
    out += [base[i] + rng.normal(size=64) * s for i in range(60) for s in (0.1, 0.2, 0.28)]
    out += [base[0]] * 5 + [base[1] * 3]
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(out)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [None] + [1.0] * 63, [1.0, 2.0]]
    return rows + [(1000 + i, v, None) for i, v in enumerate(odd)] + [(None, rows[2][1], 1)]


def test_itq(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r["vec_id"]: r for r in op04_itq.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    sound = [r for r in rows if r[1] and len(r[1]) == 64 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([r[1] for r in sound])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T) >= 0.95
    want = linked.sum(axis=1) - 1
    found = np.array([got[r[0]]["n_links"] for r in sound])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum() > 100
    for r in rows:
        if all(r is not s for s in sound):
            assert (got[r[0]]["n_links"], got[r[0]]["component_id"], got[r[0]]["kept"]) == (0, r[0], True)
    assert got[300 + 180]["component_id"] == 0 and got[300 + 180]["n_links"] == got[0]["n_links"] >= 5 and not got[300 + 180]["kept"]
    assert got[None]["component_id"] == 2
    assert op04_itq.near_duplicates(df.limit(0)).count() == 0


def test_itq_searches_every_length(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3, 8))
    long_ = rng.normal(size=(300, 16))
    vs = [rng.normal(size=64) for _ in range(400)] + [base[0], base[0], base[1], base[1] * 1.01 + 0.001, base[2]] + [*long_, long_[0] * 2, long_[1]]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op04_itq.near_duplicates(df).collect()}
    assert [got[i] for i in range(400, 405)] == [(1, 400), (1, 400), (1, 402), (1, 402), (0, 404)]
    assert got[705][1] == 405 and got[706][1] == 406 and got[0] == (0, 0)


def test_itq_broadcasts_no_side_that_grows(spark, monkeypatch, capsys):
    """Codes are exploded over tables and flips: their file is small, their rows are not."""
    held, plans = op04_itq.materialize, []

    def planned(df, label):
        if label == "links":
            df.explain()  # before it runs: the plan once
            plans.append(capsys.readouterr().out)
        return held(df, label)

    monkeypatch.setattr(op04_itq, "materialize", planned)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    op04_itq.near_duplicates(df).explain()
    plans.append(capsys.readouterr().out)
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


URLS = ["http://a.example.com/en/x", "https://www.example.com/en/", "HTTP://WWW.Example.COM/en/1?a=/es/", "http://x.net/es/1", "http://net/fr/", "http://x.net", "http://com", "http://xcom/", "no url", None, "", "://h/p?q#f", "a://b.com/x://c.net/es/", "http://b.org/" + "9" * 3000, "http://x.net/de/?#", "http://x\n.com/a\nb"]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for _, r in op05_urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    rows = [(i, u, "kept") for i, u in enumerate(URLS + [f"http://s{i}.{'net/fr' if i % 2 else 'com/de'}/{i}" for i in range(60)] + [URLS[0]] * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(2)
    got = {r["page_id"]: r for r in op05_urls.judge(df).collect()}
    says = {r: v for v, r in op05_urls.RULES}
    assert len(got) == len(rows)
    for i, u, _ in rows:
        host, path, rule = brute_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == says[rule] if rule else got[i]["verdict"] in ("allow", "block")
    assert op05_urls.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in op05_urls.judge(df.where("page_id in (5, 8, 9)")).collect()} == {"allow"}


def test_trees_learn_a_step(spark):
    rows = [([float(i % 10), float(i % 7)], int((i % 10 > 4) != (i % 7 > 3))) for i in range(700)]
    df = spark.createDataFrame(rows, "__x array<double>, y int")
    model = op05_urls.fit(df, 2)
    wrong = df.where((model.score(F.col("__x")) > 0) != (F.col("y") == 1)).count()
    assert wrong < 35


def test_trees_equal_plain_evaluation(spark):
    """The expression gives what walking the trees gives; the first tree's root is the best split by brute force."""
    rng = random.Random(2)
    rows = [([float(rng.randint(0, 9)), float(rng.randint(0, 5))], int(rng.random() < 0.2 + 0.6 * (i % 3 == 0))) for i in range(300)]
    rows = [(x, int(x[0] > 6) if rng.random() < 0.9 else y) for x, y in rows]
    df = spark.createDataFrame(rows, "__x array<double>, y int")
    model = op05_urls.fit(df, 2, trees=3)

    def walk(node, x):
        while isinstance(node, dict):
            node = node["low"] if x[node["feature"]] <= node["most"] else node["high"]
        return node

    for r in df.select("__x", model.score(F.col("__x")).alias("s")).collect():
        assert r["s"] == pytest.approx(model.base + sum(walk(t, r["__x"]) for t in model.trees))
    p = sum(y for _, y in rows) / len(rows)
    p = (sum(y for _, y in rows) + 0.25) / (len(rows) + 1)

    def gain(f, cut):
        a, b = [y - p for x, y in rows if x[f] <= cut], [y - p for x, y in rows if x[f] > cut]
        h = p * (1 - p)
        return sum(a) ** 2 / (len(a) * h + 1) + sum(b) ** 2 / (len(b) * h + 1)

    splits = [(f, c) for f, top in ((0, 9), (1, 5)) for c in range(top) if any(x[f] > c for x, _ in rows)]
    root = model.trees[0]
    assert gain(root["feature"], root["most"]) == pytest.approx(max(gain(f, c) for f, c in splits))


def test_url_queries_stay_native(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    for frame in (op05_urls.judge(df), op10_shard.shuffle_shards(df, "page_id", "url")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_samples_hold_though_ids_repeat(spark):
    docs = spark.createDataFrame([(1, "le la", "fr")] * 300 + [(i, "the that", "en") for i in range(2, 60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 1)] * 300 + [(i, 1, 0) for i in range(2, 60)], "doc_id long, quality int, toxic int")
    model = op02_language.train(docs)
    likely = np.exp(model.log_likelihood)
    grams = len(op02_language.trigrams("le la"))
    assert likely[op02_language.trigrams("le la")[0], model.languages.index("fr")] == pytest.approx(1.5 / (0.5 * op02_language.BUCKETS + grams))
    assert op06_toxicity.train(docs, labels) is None  # one toxic document is too few for any feature


def test_language_posterior_equals_the_formula(spark):
    """All evidence at once, by counting in Python."""
    rng = random.Random(8)
    said = lambda l: " ".join(rng.choice({"en": "the that with this".split(), "fr": "les que une dans".split()}[l]) for _ in range(rng.randint(1, 9)))
    rows = [(i, said(l), rng.choice([l, l, "en", None]), rng.choice(["h1", "h2", None]), rng.choice(["com", "fr", None])) for i in range(60) for l in [rng.choice(["en", "fr"])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, suffix string")
    model = op02_language.train(df)
    names = model.languages
    count = lambda pick: np.array([sum(r[2] == l and pick(r) for r in rows) for l in names], dtype=float)
    got = {r["doc_id"]: r for r in op02_language.identify(df, model, declared="lang", host="host", suffix="suffix").collect()}
    for i, text, lang, host, suffix in rows:
        own = np.array([float(lang == l) for l in names])
        prior = count(lambda r: True) + 1
        prior = prior / prior.sum()
        if suffix:
            n = count(lambda r: r[4] == suffix) - own
            prior = (n + op02_language.SUFFIX * prior) / (n.sum() + op02_language.SUFFIX)
        if host:
            n = count(lambda r: r[3] == host) - own
            prior = (n + op02_language.HOST * prior) / (n.sum() + op02_language.HOST)
        grams = op02_language.trigrams(text)
        k = min(len(grams), op02_language.TRIGRAMS)
        by_text = model.log_likelihood[grams].mean(axis=0) * k
        weight = by_text + np.log(prior) + (np.log(np.where(own > 0, 0.9, 0.1)) if lang else 0.0)
        near = int(np.argmax(by_text))
        none = (model.usual[near] - model.slack[near] * np.sqrt(op02_language.TRIGRAMS / k)) * k + np.log(op02_language.NONE) - (np.log(len(names)) if lang else 0.0)
        p = np.exp(weight - weight.max())
        p /= p.sum() + np.exp(none - weight.max())
        assert got[i]["language"] == names[int(np.argmax(p))] and got[i]["posterior"] == pytest.approx(p.max(), rel=1e-6)


def test_language_of_pages(spark):
    pages = [(1, "http://a.fr/fr/x", '<html lang="fr"><body><script>the that</script>les que une dans les que</body></html>'), (2, "http://b.com/en/", "<p>the that with this the that</p>"), (3, "no url", None), (4, None, "")]
    evidence = {r["page_id"]: r for r in op02_language.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert evidence[1]["text"].split() == "les que une dans les que".split()
    assert [(evidence[i]["declared"], evidence[i]["host"], evidence[i]["suffix"]) for i in (1, 2)] == [("fr", "a.fr", "fr/fr"), (None, "b.com", "com/en")]
    assert evidence[3]["host"] is None and evidence[4]["host"] is None and evidence[3]["declared"] is None


def test_toxicity_fit_is_a_maximum_of_the_likelihood():
    rng = np.random.default_rng(4)
    n, f = 300, 6
    held = rng.random((n, f)) < 0.4
    held[:, 0] |= ~held.any(axis=1)
    rows, cols = np.nonzero(held)
    x = held / np.sqrt(held.sum(axis=1, keepdims=True))
    true = np.array([3.0, -2.0, 0.5, 0.0, 1.0, -1.0])
    latent = x @ true + rng.logistic(size=n)
    grades = (latent > 0.5).astype(int) + (latent > 2.0)
    shares = np.bincount(grades, minlength=3) / n
    w, t = op06_toxicity.fit(rows, cols, grades, f, shares, steps=1500, rate=0.05, penalty=1e-5)

    def loss(w, t):
        above = 1 / (1 + np.exp(-((x @ w)[:, None] - t[None, :])))
        p = np.column_stack([np.ones(n), above]) - np.column_stack([above, np.zeros(n)])
        return -np.log(p[np.arange(n), grades]).mean() + 0.5e-5 * w @ w

    best = loss(w, t)
    for i in range(f + 2):
        for step in (-0.1, 0.1):
            a, b = w.copy(), t.copy()
            (a if i < f else b)[i if i < f else i - f] += step
            assert loss(a, b) > best
    assert np.corrcoef(w, true)[0, 1] > 0.95 and t[0] < t[1]


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    texts = []
    for i in range(400):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)]
        if i % 4 == 0:
            words[3] = words[9] = rng.choice(["vilea", "vileb"])
        texts.append((i, " ".join(words), i % 4 == 0))
    frame = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(x)) for i, _, x in texts] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = op06_toxicity.train(frame, labels.where("doc_id < 300"))
    got = {r["doc_id"]: r for r in op06_toxicity.score(frame, model).collect()}
    assert all(got[i]["rejected"] == x for i, _, x in texts if i >= 300)
    assert all((got[i]["severity"] > 0.8) == x for i, _, x in texts)
    odd = op06_toxicity.score(docs, model)
    assert odd.count() == docs.count() and odd.where("(text is null or trim(text) = '') and (severity > 0 or rejected)").count() == 0
    assert op06_toxicity.train(frame, labels.where("toxic = 0")) is None and op06_toxicity.train(empty, labels) is None
    assert op06_toxicity.score(docs, None).where("rejected").count() == 0 and op06_toxicity.score(empty, model).count() == 0


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(op07_bpe.vocabulary())
    want = Counter()
    for r in corpus():
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in op07_bpe.round_trip(docs, op07_bpe.vocabulary()).collect()) == want
    coded = op07_bpe.encode(docs, op07_bpe.vocabulary(), keep=("doc_id", "text"))
    back = op07_bpe.decode(coded.withColumnRenamed("text", "said"), op07_bpe.vocabulary(), keep=("doc_id", "said", "n_tokens"))
    assert back.where("text <> coalesce(said, '')").count() == 0 and back.count() == docs.count()
    assert op07_bpe.round_trip(empty, op07_bpe.vocabulary()).count() == 0


def reach(links, nodes):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3), (1, None)]
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(4))
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    want = reach(real, {x for p in real for x in p})
    assert {r["node"]: r["root"] for r in got.collect()} == want and got.count() == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_across_tasks(spark):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = [x for i in range(2000) for x in ((3 * i + 2, 3 * i + 1), (3 * i + 1, 3 * i))]
        links += [(10_000 + i, 10_001 + i) for i in range(60)] + [(20_000, 20_001 + i) for i in range(300)]
        got = components.components(spark.createDataFrame(links, "a long, b long").repartition(24)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {i: i - i % 3 for i in range(6000)} | {10_000 + i: 10_000 for i in range(61)} | {20_000 + i: 20_000 for i in range(301)}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("homes", [20_000, 2])
def test_simhash(docs, empty, homes):
    rows = corpus()
    fps = [op08_simhash.fingerprint(r[1] or "") & (2**64 - 1) for r in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = reach(links, range(len(fps)))
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None and (least[root[i]] is None or r[0] < least[root[i]]):
            least[root[i]] = r[0]
    want = Counter((r[0], fps[i], least[root[i]]) for i, r in enumerate(rows))
    got = op08_simhash.near_duplicates(docs, homes=homes).collect()
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want
    assert op08_simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("group", [1000, 3])
def test_near_copies_equal_brute_force_in_a_large_group(spark, group):
    """Chains and stars of near copies: the pivot links to some only, strays link among themselves and to others."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    texts = []
    for i in range(40):
        copy = list(base)
        for k in range(0, i):  # drifts away from the first; neighbours are near
            copy[(k * 3) % 120] = f"n{k}"
        texts.append(" ".join(copy))
    texts += [" ".join([*base[:-1], word()]) for _ in range(30)]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    want = reach(links, range(len(sets)))
    got = op08_simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), group=group).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_copies(spark, docs, empty):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for i in range(240):
        words = [word() for _ in range((100, 300, 1000)[i % 3])]
        copy = list(words)
        for _ in range(max(1, len(words) * (i % 4 + 1) // 200)):
            copy[rng.randrange(len(words))] = word()
        texts += [" ".join(words), " ".join(copy)]
    grams = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    near = [jaccard(grams(texts[i]), grams(texts[i + 1])) >= 0.8 for i in range(0, len(texts), 2)]
    got = {r["doc_id"]: r["component_id"] for r in op08_simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[2 * i] == 2 * i and (near[i] or got[2 * i + 1] == 2 * i + 1) for i in range(240))
    found = sum(got[2 * i + 1] == 2 * i for i in range(240))
    print("near pairs, found:", sum(near), found)
    assert sum(near) > 100 and found >= 0.99 * sum(near)
    rows = [r for r in corpus() if r[0] is not None]
    out = op08_simhash.near_copies(docs)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in rows)
    blank = [r[0] for r in rows if not (r[1] or "").split()]
    assert {r["component_id"] for r in out.where(F.col("doc_id").isin(blank)).collect()} == {min(blank)}
    assert op08_simhash.near_copies(empty).count() == 0


def test_tiff(docs, empty):
    got = {(r["doc_id"], r["text"]): r for r in op09_tiff.decode(op09_tiff.to_tiff(docs, keep=("doc_id", "text")), keep=("doc_id", "text", "n_bytes")).collect()}
    for r in corpus():
        data = op09_tiff.payload(r[1] or "")
        mine = got[r[0], r[1]]
        assert b"".join(p["samples"] for p in mine["pages"]) == data and mine["n_bytes"] == len((r[1] or "").encode()) and mine["error"] is None
    assert op09_tiff.decode(op09_tiff.to_tiff(empty)).count() == 0


@pytest.mark.parametrize("form", op09_tiff.FORMS)
def test_tiff_forms(docs, form):
    stored = op09_tiff.to_tiff(docs, keep=("doc_id", "text"), form=form)
    for r in op09_tiff.decode(stored, keep=("doc_id", "text")).collect():
        assert b"".join(p["samples"] for p in r["pages"]) == op09_tiff.payload(r["text"] or "") and {p["compression"] for p in r["pages"]} == {form[0]}


def test_own_names_are_refused(docs):
    for call in (lambda: op09_tiff.to_tiff(docs, keep=("media",)), lambda: op03_packing.pack(docs.withColumnRenamed("doc_id", "length"), "", key="length"), lambda: op07_bpe.round_trip(docs.withColumnRenamed("doc_id", "n_tokens"), "", key="n_tokens")):
        with pytest.raises(ValueError):
            call()


def test_tiff_pages(spark):
    image = np.arange(600, dtype=np.uint8).reshape(20, 30)
    media = [tiff.write([image, image.T.copy()], tiff.LZW, 2, tile=(16, 16)), b"junk", None, tiff.write([image], tiff.PACKBITS, big=True)]
    rows = op09_tiff.read_pages(spark.createDataFrame(list(enumerate(media)), "doc_id long, media binary")).collect()
    assert [(r["doc_id"], r["page"], r["error"] is None) for r in sorted(rows, key=lambda r: (r["doc_id"], r["page"] or 0))] == [(0, 0, True), (0, 1, True), (1, None, False), (2, None, False), (3, 0, True)]


def test_shards(docs, empty):
    rows = corpus()
    got = op10_shard.shuffle_shards(docs, bucket_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert sorted(r["place"] for r in got) == list(range(len(rows)))
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    again = op10_shard.shuffle_shards(docs, bucket_bytes=2000).collect()
    assert {(r["place"], r["text"]) for r in got} == {(r["place"], r["text"]) for r in again}
    other = op10_shard.shuffle_shards(docs, bucket_bytes=2000, seed=1).collect()
    assert [r["text"] for r in sorted(got, key=lambda r: r["place"])] != [r["text"] for r in sorted(other, key=lambda r: r["place"])]
    assert op10_shard.shuffle_shards(empty).count() == 0


def test_shards_spread_equal_keys(spark):
    df = spark.createDataFrame([(None, "x" * 100)] * 2000, "doc_id long, text string").repartition(4)
    got = op10_shard.shuffle_shards(df, bucket_bytes=4000)
    assert got.count() == 2000 and sorted(r["place"] for r in got.collect()) == list(range(2000))
    scattered = max((p for p in __import__("pathlib").Path(spark.conf.get("spark.checkpoint.dir")).glob("scattered-*")), key=lambda p: p.stat().st_mtime)
    assert max(r["count"] for r in spark.read.parquet(str(scattered)).groupBy("__bucket").count().collect()) < 100


def test_shards_written(docs, tmp_path):
    op10_shard.write_shards(op10_shard.shuffle_shards(docs.select("doc_id", "text"), shards=3), str(tmp_path / "out"), files=4)
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 3


def test_near_copies_compare_what_the_links_of_fingerprints_join(spark, monkeypatch):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join(reversed(base)), "", None]
    made, links = [], op08_simhash.links

    def seen(fps, *args):
        made.extend(r["fp"] for r in fps.collect())
        return links(fps, *args)

    monkeypatch.setattr(op08_simhash, "links", seen)
    got = {r["doc_id"]: r["component_id"] for r in op08_simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}
    assert sorted(made) == sorted({op08_simhash.fingerprint(t) for t in texts[:3]})


def test_packing_counts_the_ids_that_a_task_holds():
    bins = op03_packing.Bins(8, 0)
    for n in (8, 4, 4, 2):
        bins.add((1, 0, np.zeros(n, dtype="<u4"), n))
    assert bins.held == 16 == sum(len(p[2]) for p in bins.out)
    bins.finish()
    assert bins.held == 18
