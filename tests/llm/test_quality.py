"""The classifier's numbers against plain ones: features, forward pass, slopes, word order."""

import dataclasses
import math
import random

import numpy as np
import pytest
import xxhash

from scriptwell.llm import quality

SMALL = quality.Settings(buckets=1 << 9, dim=4, word_grams=3, steps=60)
TEXTS = [None, "", " \n", "one", "one one one", "the cat sat on the mat", "mat the on sat cat the",
         "é\x00ü 漢字 漢字", "long " * 4_000 + "end", "b" * 3_000]


def plain_features(text, s):
    """All features of a text, with repeats, one by one."""
    mask = s.buckets - 1
    words = (text or "").encode().split()
    found = []
    for word in [*words, b"</s>"]:
        found.append(xxhash.xxh32_intdigest(word, 1) & mask)
        if word != b"</s>":
            marked = f"<{word.decode()}>"
            found += [xxhash.xxh32_intdigest(marked[i:i + n], 2) & mask
                      for n in range(s.gram_from, s.gram_to + 1)
                      for i in range(len(marked) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(w, 3) for w in words]
    for n in range(2, s.word_grams + 1):
        for i in range(len(words) - n + 1):
            h = hashes[i]
            for other in hashes[i + 1:i + n]:
                h = (h * 0x9E3779B97F4A7C15 + other) % 2**64
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
            found.append(h >> 32 & mask)
    if s.mark_repeats:
        found += [xxhash.xxh32_intdigest(b"</same>", 1) & mask
                  for a, b in zip(words, words[1:], strict=False) if a == b]
    return found


def trained(s=SMALL):
    r = random.Random(3)
    texts = [" ".join(r.choice("the of and house cat".split()) for _ in range(r.randint(0, 30)))
             for _ in range(80)]
    return quality.train(texts, [int(len(t) > 60) for t in texts], s)


@pytest.mark.parametrize("grams", [1, 2, 3])
@pytest.mark.parametrize("mark", [False, True])
def test_bag_holds_the_features(grams, mark):
    s = dataclasses.replace(SMALL, word_grams=grams, mark_repeats=mark)
    known = {}
    for text in TEXTS:
        expected, counts = np.unique(plain_features(text, s), return_counts=True)
        found, shares = quality.bag(text, s, known)
        assert found.tolist() == expected.tolist()
        assert np.allclose(shares, counts / counts.sum())


def test_scores_are_a_forward_pass(spark):
    model = trained()
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows + rows, "doc_id long, text string").repartition(3)
    scored = quality.score_quality(frame, model).collect()
    assert len(scored) == 2 * len(rows)
    for row in scored:
        mean = model.table[plain_features(TEXTS[row.doc_id], SMALL)].astype(float).mean(axis=0)
        logits = model.layer.astype(float) @ mean + model.bias
        assert row.score == pytest.approx(1 / (1 + math.exp(logits[0] - logits[1])), abs=1e-6)
        assert row.predicted == int(row.score >= 0.3)
    assert len({(r.doc_id, r.score) for r in scored}) == len(rows)


def test_forgetting_words_changes_no_score(monkeypatch):
    model = trained()
    scores = [quality.Remembered(model.slopes(), SMALL).margin(t) for t in TEXTS]
    monkeypatch.setattr(quality, "WORDS_KEPT", 1)
    one = quality.Remembered(model.slopes(), SMALL)
    assert [one.margin(t) for t in TEXTS] == scores


def test_slopes_are_finite_differences():
    rng = np.random.default_rng(1)
    s = dataclasses.replace(SMALL, dim=3)
    model = quality.Model(s, rng.normal(size=(s.buckets, 3)), rng.normal(size=(2, 3)),
                          rng.normal(size=2))
    bags = [quality.bag(t, s, {}) for t in ("a bb a", "cc bb", "dd dd", None)]
    y, weight = np.array([0, 1, 1, 0]), np.array([1.0, 0.5, 2.0, 0.7])
    _, distinct, table, layer, bias = quality.gradients(model, bags, y, weight)

    def moved(array, at):
        ends = []
        for step in (1e-5, -1e-5):
            before = array[at]
            array[at] = before + step
            ends.append(quality.gradients(model, bags, y, weight)[0])
            array[at] = before
        return (ends[0] - ends[1]) / 2e-5

    for row, feature in enumerate(distinct):
        for d in range(3):
            assert table[row, d] == pytest.approx(moved(model.table, (feature, d)), abs=1e-7)
    for at in np.ndindex(2, 3):
        assert layer[at] == pytest.approx(moved(model.layer, at), abs=1e-7)
    for k in range(2):
        assert bias[k] == pytest.approx(moved(model.bias, k), abs=1e-7)


def test_word_order_can_be_learned():
    """Both classes have the same words and character n-grams; only neighbours differ."""
    r = random.Random(5)
    texts, labels = [], []
    for i in range(200):
        pairs = [("red", "fox"), ("old", "map"), ("sea", "wind")]
        r.shuffle(pairs)
        texts.append(" , ".join(f"{a} {b}" if i % 2 else f"{b} {a}" for a, b in pairs))
        labels.append(i % 2)
    right = {}
    for grams in (1, 2):
        s = quality.Settings(word_grams=grams, steps=300)
        model = quality.train(texts[:150], labels[:150], s)
        one, bias = quality.Remembered(model.slopes(), s), float(model.bias[1] - model.bias[0])
        right[grams] = sum(int(one.margin(t) + bias > 0) == y
                           for t, y in zip(texts[150:], labels[150:], strict=True))
    assert right[2] == 50 and right[1] < 50


def test_same_rows_give_the_same_model(spark):
    rows = [(i, f"word{i % 7} " * (i % 5), i % 2) for i in range(60)] + [(None, "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    models = [quality.fit(f.drop("quality"), f.select("doc_id", "quality"), settings=SMALL)
              for f in (frame, frame.repartition(5).union(frame))]
    assert np.array_equal(models[0].table, models[1].table)
    assert np.array_equal(models[0].layer, models[1].layer)
