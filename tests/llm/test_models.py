"""Language, quality and toxicity: held-out accuracy, gradients, and odd inputs."""

import numpy as np
import pytest

from paperloom.llm import langid, mil, ordinal, queries, textvec

SF = "/root/testdata/sf0.01"
ODD = [(-1, None, "en"), (-2, "", None), (-3, "123 456 !!", "en"), (-4, "word " * 30000, "en"), (-5, "日本語 テキスト", "en")]


def test_languages(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.languages(spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and 150 < len(held) < 250
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) >= 0.98 and all(0 <= r["score"] <= 1 for r in got)


def test_mixture_of_two_languages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(d, "text", "lang")
    text = {r["lang"]: r["text"] for r in d.filter("n_chars between 1500 and 3000 and doc_id < 400").collect()}
    both = (text["en"][:1400] + " " + text["fr"][:600]).encode()
    share = dict(zip(model.languages, model.mixtures([both])[0][0]))
    assert share["en"] > share["fr"] > 0.15 and share["de"] == 0 and share["es"] == 0
    df = spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.identify(df, "text", model).collect()}
    assert [got[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3 and got[-5]["lang_pred"] in model.languages
    assert langid.identify(df.limit(0), "text", model).count() == 0
    empty = langid.train(df.limit(0), "text", "lang")
    assert {r["lang_pred"] for r in langid.identify(df, "text", empty).collect()} == {"und"}


def made(languages):
    """Texts of languages that share no letters' order: each has words of its own."""
    rng = np.random.default_rng(5)
    words = {x: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(25)] for x in languages}
    return words, [(x, " ".join(rng.choice(words[x], 60))) for x in languages for _ in range(2)]


def test_languages_in_blocks(spark, monkeypatch):
    """Blocks of 3 choose what one block of all 11 does, for texts of one and of two languages from any blocks."""
    names = [f"l{i:02d}" for i in range(11)]
    words, rows = made(names)
    df = spark.createDataFrame(rows, "lang string, text string")
    texts = [" ".join(words[x]).encode() for x in names] + [" ".join(words[a] + words[b]).encode() for a, b in (("l00", "l10"), ("l04", "l05"), ("l09", "l02"))] + [b"", b"12 !"]
    whole = langid.train(df, "text", "lang")
    assert len(whole.blocks) == 1
    want, n = whole.mixtures(texts)
    monkeypatch.setattr(langid, "AT_ONCE", 3)
    monkeypatch.setattr(langid, "SCORED", 7)
    parts = langid.train(df, "text", "lang")
    assert [b[0] for b in parts.blocks] == [3, 3, 3, 2] and parts.languages == whole.languages == names
    got, m = parts.mixtures(texts)
    assert (got > 0).tolist() == (want > 0).tolist() and np.allclose(got, want, atol=0.02) and n.tolist() == m.tolist()
    assert [np.flatnonzero(x).tolist() for x in got[:11]] == [[i] for i in range(11)] and np.flatnonzero(got[11]).tolist() == [0, 10]


def test_hundreds_of_languages(spark):
    names = [f"l{i:03d}" for i in range(300)]
    words, rows = made(names)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    model = langid.train(df, "text", "lang")
    assert len(model.languages) == 300 and len(model.blocks) == 10
    got = langid.identify(df.sample(0.1, seed=1), "text", model).collect()
    assert len(got) > 30 and all(r["lang_pred"] == r["lang"] and r["proportions"].keys() == {r["lang"]} for r in got)


def test_trigram_counts_of_few_and_many_labels(spark, monkeypatch):
    rows = [(f"l{i % 40}", f"abc abd {'xyz ' * (i % 3)}") for i in range(80)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = {(r["lang"], r["bin"]): r["n"] for r in langid.trigram_counts(df, "text", "lang").collect()}
    want = {}
    for lang, text in rows:
        data = np.frombuffer(b" " + text.encode() + b" ", np.uint8)
        for i in range(len(data) - 2):
            if data[i + 1] != 32:
                key = lang, int(langid._bins(data[i:i + 3])[0])
                want[key] = want.get(key, 0) + 1
    assert got == want
    one = df.filter("lang = 'l1'")
    assert {(r["lang"], r["bin"]): r["n"] for r in langid.trigram_counts(one, "text", "lang").collect()} == {k: v for k, v in want.items() if k[0] == "l1"}


def test_equal_languages(spark):
    """Of two languages with the same texts the first leaves; rows that are repeated are predicted alike."""
    text = "the same words in either language and some more of these"
    df = spark.createDataFrame([("a", text), ("b", text)] * 3, "lang string, text string")
    got = langid.identify(df, "text", langid.train(df, "text", "lang")).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("b", 1.0)} and len(got) == 6


def test_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.quality(spark, SF).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 60 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_attention_gradient():
    rng = np.random.default_rng(0)
    owner, x, y = np.repeat([0, 1, 2], [3, 1, 4]), rng.normal(size=(8, 5)), np.array([1.0, 0.0, 1.0])
    m = mil.Model(np.zeros(5), np.ones(5), rng, 0.1)

    def loss():
        p = m.forward(owner, x)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + 0.5e-4 * (m.p["W"] ** 2).sum()
    g = m.gradient(owner, x, y)
    for k, v in m.p.items():
        at = tuple(rng.integers(0, s) for s in np.shape(v))
        old = float(v[at])
        m.p[k][at] = old + 1e-5
        up = loss()
        m.p[k][at] = old - 1e-5
        down = loss()
        m.p[k][at] = old
        assert (up - down) / 2e-5 == pytest.approx(float(np.asarray(g[k])[at]), abs=1e-6)
    assert np.allclose(np.bincount(owner, weights=m.forward(owner, x)["attention"]), 1)


def test_quality_of_odd_texts(spark):
    df = spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, lang string, predicted int")
    model = mil.train(df, spark.createDataFrame([(-4, 1), (-3, 0), (-3, None)], "doc_id long, quality int"), "doc_id", "text", "quality")
    got = mil.score(df, "text", model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert mil.score(df.limit(0), "text", model).count() == 0
    mil.score(df, "text", mil.train(df.limit(0), df.select("doc_id", "predicted").limit(0), "doc_id", "text", "predicted")).collect()


def planted(spark):
    rng = np.random.default_rng(1)
    plain, rude = [f"plain{i}" for i in range(300)], ["vilo", "grunk", "smarx"]
    rows = []
    for i in range(1200):
        w = list(rng.choice(plain, 80))
        toxic = i % 8 == 0
        for _ in range(int(rng.integers(2, 8)) if toxic else 0):
            w[int(rng.integers(80))] = str(rng.choice(rude)) + "," * int(rng.integers(2))
        rows.append((i, " ".join(w), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity(spark):
    df = planted(spark)
    known = df.filter("doc_id % 2 = 0").select("doc_id", "toxic")
    model = ordinal.train(df, known, "doc_id", "text", "toxic")
    assert (np.diff(model.thresholds) > 0).all() and (model.weights >= 0).all()
    got = ordinal.score(df.withColumnRenamed("toxic", "truth"), "text", model).collect()
    held = [r for r in got if r["doc_id"] % 2]
    assert all(r["toxic"] == bool(r["truth"]) for r in held if r["doc_id"] % 8) and all(0 <= r["severity"] <= 3 for r in got)
    all_ = [r for r in got if r["truth"]]
    assert np.mean([r["toxic"] for r in all_]) == 1 and len({r["grade"] for r in all_}) >= 2
    odd = spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, lang string, severity int")
    assert not any(r["toxic"] for r in ordinal.score(odd, "text", model).collect())
    none = ordinal.train(df, known.limit(0), "doc_id", "text", "toxic")
    assert not any(r["toxic"] for r in ordinal.score(df.select("doc_id", "text").limit(20), "text", none).collect())


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(2)
    n = 2000
    number = rng.integers(0, 6, n)
    which = np.concatenate([rng.permutation(8)[:k] for k in number])
    grade = np.clip(number - 1, 0, 3)
    w, theta = ordinal._fit(np.repeat(np.arange(n), number), which, grade, 8)
    p = ordinal._sigmoid(np.bincount(np.repeat(np.arange(n), number), weights=w[which], minlength=n)[:, None] - theta)
    assert np.corrcoef(p.sum(1), grade)[0, 1] > 0.95


def test_word_hashes():
    texts = ["Été chaud, ÉTÉ".encode(), b"", b"abcdef abcdxx x"]
    w = textvec.Words(texts, textvec.LETTERS)
    whole, four = w.hashes(4)
    assert w.owner.tolist() == [0, 0, 0, 2, 2, 2] and whole[0] == whole[2] and len(set(whole.tolist())) == 5
    assert four[3] == four[4] != 0 and four[5] == 0


def test_toxicity_sample_keeps_the_ratio_of_classes(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(4000):
        toxic = i % 8 == 0
        w = [f"plain{k}" for k in rng.integers(0, 300, 40)] + ["vilo"] * int(rng.random() < (0.6 if toxic else 0.1)) + ["grunk"] * int(rng.random() < (0.6 if toxic else 0.1))
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    full, part = (np.mean([r["p_toxic"] for r in ordinal.score(df.select("doc_id", "text"), "text", ordinal.train(df, df.select("doc_id", "toxic"), "doc_id", "text", "toxic", **bound)).collect()])
                  for bound in ({}, {"sample": 400}))
    assert full == pytest.approx(1 / 8, abs=0.03) and part == pytest.approx(full, abs=0.03)


def test_the_fit_sees_whole_rows_and_is_bounded(spark, monkeypatch):
    """One labelled id has most rows, with one text and with many, and some texts are long."""
    seen = {}
    monkeypatch.setattr(mil, "fit", lambda owner, x, y: seen.update(owner=owner, x=x, y=y))
    long = " ".join(f"word{i}" for i in range(10_000))
    rows = [(1, "the same text")] * 4000 + [(1, f"text {i}") for i in range(300)] + [(2, long), (3, None), (3, ""), (4, "unlabelled")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (4, None), (None, 1)], "doc_id long, quality int")
    mil.train(df, labels, "doc_id", "text", "quality")
    sizes = np.bincount(seen["owner"])
    assert len(sizes) == 304 and sizes.max() == -(-10_000 // mil.PASSAGE_WORDS) and sorted(seen["y"])[:301] == [0.0] * 301
    mil.train(df, labels, "doc_id", "text", "quality", sample=50)
    assert len(np.bincount(seen["owner"])) == 50
    monkeypatch.setattr(mil, "PASSAGES", 100)  # the long text is too large a part of it
    mil.train(df, labels, "doc_id", "text", "quality")
    assert len(seen["owner"]) == 100 and np.bincount(seen["owner"]).max() == 1
    mil.train(df.limit(0), labels, "doc_id", "text", "quality")
    assert not len(seen["y"])
