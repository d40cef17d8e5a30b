"""Rare words with one ending are told apart by what stands around them."""

import math
from collections import Counter

import numpy as np

from placekit.llm import class_language_model


def test_rare_words_of_one_ending(spark):
    """Each of 80 words stands five times in some 130,000 tokens: before 'red' after 'the', or before 'two' after 'we'."""
    rows = [(f"the {a} red we {b} two " * 5 + "so it went on and on for long " * 400,) for a, b in ((f"a{i}xyz", f"b{i}xyz") for i in range(40))]
    model, known = class_language_model.train(spark.createDataFrame(rows, "text string"))
    of = {bytes(r.word): (r.n, r.c) for r in known.collect()}
    assert model.total > 16384 * 5 and all(of[b"%s%dxyz" % (k, i)][0] == 5 for k in (b"a", b"b") for i in range(40))
    (a, n), (b, m) = (Counter(of[b"%s%dxyz" % (k, i)][1] for i in range(40)).most_common(1)[0] for k in (b"a", b"b"))
    assert a != b and n > 30 and m > 30


def _plain(texts, least, k):
    """Counts, rarer words and the classes of the model, and every token's word before and after it."""
    own = [class_language_model.tokens(t.encode()) for t in texts]
    n = Counter(w for ws in own for w in ws)
    total = sum(n.values())
    return own, n, {w for w in n if n[w] * least < total and w}


def test_rarer_words_stand_where_their_neighbours_are_likeliest(spark):
    """Against plain counting, with many words below the share that makes a context."""
    k, least = 8, 400
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    own, n, rare = _plain(texts, least, k)
    model, known = class_language_model.train(spark.createDataFrame([(t,) for t in texts], "text string"), k, least)
    of = {bytes(r.word): (r.n, r.c) for r in known.collect()}
    assert {w: x for w, (x, _) in of.items()} == dict(n) and set(model.heavy) == set(n) - rare and len(rare) > len(n) / 2
    slot = lambda w: k if w in rare else of[w][1]
    both = np.zeros((k + 1, k + 1))
    cells = {w: np.zeros((2, k + 1)) for w in rare}
    for ws in own:
        for before, w, after in zip([b"", *ws], ws, [*ws[1:], None]):
            both[slot(before), slot(w)] += 1
            if w in rare:
                cells[w][0, slot(before)] += 1
                cells[w][1, slot(after)] += 1
    smooth = both + 0.1
    gain = np.log(smooth) - np.log(smooth.sum(1))[:, None] - np.log(smooth.sum(0))[None, :]
    for w in rare:
        value = cells[w][0] @ gain[:, :k] + cells[w][1] @ gain[:k].T
        assert value[of[w][1]] >= value.max() - 1e-6


def test_scores_against_a_plain_sum(spark, monkeypatch):
    """Transitions, emissions and unseen words, over several blocks."""
    monkeypatch.setattr(class_language_model, "BLOCK", 3000)
    k, least = 8, 400
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    frame = spark.createDataFrame([(i, t, i % 7 != 2) for i, t in docs], "doc_id long, text string, train boolean")
    model, scores = class_language_model.fit_and_score(frame, k, least)
    got = {r.doc_id: r for r in scores.collect()}
    _, known = class_language_model.train(frame.where("train").select("text"), k, least)
    of = {bytes(r.word): (r.n, r.c) for r in known.collect()}
    size, bins = Counter(), {}
    for w, (n, c) in of.items():
        size[c] += n + 1
        bins.setdefault(class_language_model.bin_of(w), Counter())[c] += 1
    every = Counter(c for _, c in of.values())

    def cls(w):
        if w in of:
            return of[w][1]
        b = bins.get(class_language_model.bin_of(w), every)
        return min(b, key=lambda c: (-b[c], c))

    both = np.zeros((k, k))
    for i, t in docs:
        if i % 7 != 2:
            cs = [cls(b""), *map(cls, class_language_model.tokens(t.encode()))]
            np.add.at(both, (cs[:-1], cs[1:]), 1)
    share = both.sum(0) + 1
    chance = (both + class_language_model.SMOOTH * k * share / share.sum()) / (both.sum(1, keepdims=True) + class_language_model.SMOOTH * k)
    for i, t in docs:
        ws = class_language_model.tokens(t.encode())
        cs = [cls(b""), *map(cls, ws)]
        want = sum(math.log10(chance[a, b]) for a, b in zip(cs, cs[1:])) + sum(math.log10((of.get(w, (0,))[0] + 1) / (size[cls(w)] + 1)) for w in ws)
        assert math.isclose(got[i].score, want, rel_tol=1e-9) and got[i].n_known == sum(w in of for w in ws)
    assert any(w not in of for _, t in docs for w in class_language_model.tokens(t.encode())) and model.total == sum(n for n, _ in of.values())
