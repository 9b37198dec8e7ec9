import random
from datetime import datetime

import numpy as np

from leafline.llm import abuse as A

T1, T2 = datetime(2025, 1, 1), datetime(2025, 1, 2)
HARM = ["You are a stupid idiot.", "Get lost, you filthy moron!", "All of them are vermin and should vanish.", "Nobody asked you, ugly pig."]
FINE = ["The desk opens at nine.", "Please read the page on rail passes.", "The word idiot is not allowed in replies.", "Kill the parent process first.", "It took ten people to move the table.", "A pig was seen near the lock."]


def corpus(seed, n):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        bad = rng.random() < 0.3
        parts = [rng.choice(FINE) for _ in range(rng.randint(1, 6))] + ([rng.choice(HARM)] if bad else [])
        rng.shuffle(parts)
        docs.append((" ".join(parts), int(bad)))
    return docs


def test_disguises_are_undone():
    words = lambda t: [A._WORDS[w] for w in A._WORD.findall(A.undisguise(t))]
    plain = words("you idiot")
    for text in ["y​o​u idiot", "YOU 1d10t", "you i.d.i.o.t", "yоu іdіоt", "yöü ïdïöt", "y o u i-d-i-o-t", "youuuu idiiiot", "ｙｏｕ ｉｄｉｏｔ"]:
        assert words(text) == plain, text
    assert A.undisguise("see v2.3.1 e.g. a b") == "see v2.3.1 e.g. a b"


def test_features_keep_to_their_documents():
    bags, cuts = A.features([None, "One two. Three!", "", "  ", "... four"])
    assert [len(c) for c in cuts] == [0, 2, 0, 0, 2] and bags.doc.tolist() == [1, 1, 4, 4]
    alone, _ = A.features(["Three!"])
    assert set(bags.ids[(bags.slot // 2) == 1]) == set(alone.ids)
    assert A.noisy_or(bags.chances(np.zeros(1 << A.BITS), 0.0), bags.doc, 5)[[0, 2, 3]].tolist() == [0, 0, 0]
    assert len(A.features([])[0].ids) == 0 and A.features([None])[0].chances(np.zeros(1 << A.BITS), 0.0).tolist() == []


def test_a_window_of_a_long_sentence_is_the_sum_of_its_words_and_word_groups():
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["i", "d", "i", "o", "t"] + ["end"] * 9
    bags, cuts = A.features([" ".join(words)])
    assert any(" i d i o t" in " ".join(words)[s:e] for _, s, e in cuts[0])
    w = np.random.default_rng(0).normal(size=1 << A.BITS)
    text = " ".join(words)
    for k, (first, two) in enumerate(zip(bags.first, bags.two)):
        start, end = cuts[0][first][1], cuts[0][first + two][2]
        own, _ = A.features([text[start:end]])
        # a window cut out by itself is one window again, or as many as its own stretches give
        if len(own.first) == 1:
            assert np.isclose(bags.chances(w, 0.1)[k], own.chances(w, 0.1)[0])


def test_the_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    texts = [t for t, _ in corpus(4, 12)] + ["a long run of words " * 12]
    bags, _ = A.features(texts)
    y, weight, w, b = rng.random(len(texts)).round(), rng.random(len(texts)) + 0.5, rng.normal(size=1 << A.BITS) / 3, -0.4

    def loss(w, b):
        bad = A.noisy_or(bags.chances(w, b), bags.doc, len(y))
        return -(weight * (y * np.log(bad) + (1 - y) * np.log1p(-bad))).sum()

    g, gb = A.gradient(bags, y, weight, w, b)
    for k in np.unique(bags.ids)[:20]:
        step = np.zeros_like(w)
        step[k] = 1e-5
        assert np.isclose((loss(w + step, b) - loss(w - step, b)) / 2e-5, g[k], atol=1e-4)
    assert np.isclose((loss(w, b + 1e-5) - loss(w, b - 1e-5)) / 2e-5, gb, atol=1e-4)


def test_noisy_or_learns_from_document_labels(spark):
    train, test = corpus(1, 400), corpus(2, 200)
    noise = np.random.default_rng(0).random(len(train)) < 0.05
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(train)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, "ann", int(v != n), T2) for i, ((_, v), n) in enumerate(zip(train, noise))], "doc_id long, annotator string, offensive int, labelled_at timestamp")
    w, b = A.train(d, labels)
    bags, cuts = A.features([t for t, _ in test])
    p = bags.chances(w, b)
    score = A.noisy_or(p, bags.doc, len(test))
    assert sum((s >= A.THRESHOLD) == v for s, (_, v) in zip(score, test)) >= 0.97 * len(test)
    for k, (t, v) in enumerate(test):
        if v and score[k] >= A.THRESHOLD:
            mine = bags.doc == k
            begin = sum(map(len, cuts[:k]))
            assert all(f["text"] in HARM for f in A.passages(t, p[mine], bags.first[mine] - begin, bags.two[mine], cuts[k]))


def test_all_passages_are_located_in_the_words_of_the_source(spark):
    docs = corpus(3, 200)
    calm = "the desk opens at nine and please read the page on rail passes and it took ten people to move the table "
    rows = [(i, t, "forum") for i, (t, _) in enumerate(docs)] + [
        (900, calm * 8 + "you are a stupid idiot get lost you filthy moron " + calm * 3, "s"), (901, " ".join([HARM[0], FINE[0], HARM[1]]), "s"), (902, FINE[0] + "\nYou are a stüpid i.d.i.o.t.", "s"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, "ann", v, T2) for i, (_, v) in enumerate(docs)], "doc_id long, annotator string, offensive int, labelled_at timestamp")
    got = {r["doc_id"]: r for r in A.score_documents(d, labels).where("doc_id >= 900").collect()}
    assert "stupid idiot" in got[900]["worst"] and got[900]["passages"][0]["start"] > 500
    assert [(p["sentence"], p["text"]) for p in got[901]["passages"]] == [(0, HARM[0]), (2, HARM[1])]
    assert [(p["sentence"], p["text"]) for p in got[902]["passages"]] == [(1, "You are a stüpid i.d.i.o.t.")]
    text = {i: t for i, t, _ in rows}
    assert all(text[i][p["start"] : p["end"]] == p["text"] for i, r in got.items() for p in r["passages"])


def test_tables(spark):
    docs = corpus(3, 200)
    rows = [(i, t, "forum" if i % 3 else None, 0.5) for i, (t, _) in enumerate(docs)] + [(900, None, "s", 0.1), (901, "", "s", 0.1), (902, "...", "s", 0.1), (903, "The desk opens at nine. " * 3000, "s", 0.1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    marks = [(i, "ann", v, T2) for i, (_, v) in enumerate(docs) if i < 150] + [(i, "ann", 1 - v, T1) for i, (_, v) in enumerate(docs) if i < 20] + [(5, None, None, T1), (None, "ann", 1, T1), (777, "ann", 1, T1)]
    labels = spark.createDataFrame(marks, "doc_id long, annotator string, offensive int, labelled_at timestamp")
    assert {r["doc_id"]: r["y"] for r in A.votes(labels).collect()}[3] == docs[3][1]
    got = {r["doc_id"]: r for r in A.score_documents(d, labels).collect()}
    assert len(got) == len(rows) and all(got[i]["score"] == 0 for i in (900, 901, 902)) and got[903]["score"] < 0.1
    assert sum((got[i]["passages"] is not None) == v for i, (_, v) in enumerate(docs)) >= 0.97 * len(docs)
    rates = {r["source"]: r["documents"] for r in A.source_rates(d, labels).collect()}
    assert rates["s"] == 4 and sum(rates.values()) == len(rows)
    assert {r["score"] for r in A.score_documents(d, labels.limit(0)).collect()} == {0.0}
    assert A.score_documents(d.limit(0), labels).collect() == []
