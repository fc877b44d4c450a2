import random

import numpy as np

from driftline.llm import language_id as m

SYLLABLES = {"aa": ["ka", "mo", "ti", "re", "lu"], "bb": ["sch", "ein", "ung", "ber", "ze"], "cc": ["é", "oi", "eau", "que", "è"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


def test_gradients_by_differences():
    net = m.BiGRU(3, seed=2, embed=4, hidden=5)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, n = m._matrix([b" ab ", b" abcde ", b" x "])
    y = np.array([0, 2, 1])
    _, g = net.gradients(x, n, y)
    for k, w in net.w.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        w[at] += 1e-4
        up = net.gradients(x, n, y)[0]
        w[at] -= 2e-4
        down = net.gradients(x, n, y)[0]
        w[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-3 * max(1, abs(g[k][at])), k


def test_prediction_reads_positions_like_training():
    net = m.BiGRU(3)
    x, n = m._matrix([b" hello ", b" world "])
    mask = np.ones(x.shape, np.float32)
    h = np.concatenate([net._run(x, mask, d, False)[0] for d in "fb"], 2)
    logits = h @ net.w["V"] + net.w["o"]
    want = logits - np.log(np.exp(logits).sum(2, keepdims=True))
    assert np.allclose(net.positions(x), want, atol=1e-4)


def test_held_out_accuracy_and_awkward_rows(spark, stored, awkward):
    rng = random.Random(7)
    rows = [(i, text(lang := "aabbcc"[i % 3 * 2 :][:2], rng.randint(5, 40), rng), lang if i % 11 else None, "s") for i in range(400)]
    truth = {i: "aabbcc"[i % 3 * 2 :][:2] for i in range(400)}
    rows += [(1000 + i, t, None, s) for i, (_, t, _, s) in enumerate(awkward)]
    found = {r.doc_id: r for r in m.identify(stored(rows)).collect()}
    assert len(found) == len(rows)
    held = [i for i in truth if m.held_out(i)]
    assert all(found[i].held_out == m.held_out(i) for i in truth)
    assert np.mean([found[i].lang_pred == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())
    none = [1000 + i for i, (_, t, _, _) in enumerate(awkward) if not t or not any(map(str.isalpha, t))]
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in none)
    assert all(found[1000 + i].lang_pred in ("aa", "bb", "cc") for i in range(len(awkward)) if 1000 + i not in none)


def test_positions_are_labelled(spark, stored):
    rng = random.Random(3)
    words = {k: [w for _ in range(300) for w in m.words_of(text(k, 3, rng).encode())] for k in SYLLABLES}
    reader = m.Reader(*m.train(words, steps=150))
    sample = b"kamoti, " + "éqüeau".encode()
    at = reader.positions(sample)
    assert [a for a, *_ in at] == [i for i in range(len(sample)) if sample[i : i + 1] not in (b",", b" ")]
    assert all(lang == "aa" for a, lang, _ in at if a < 6)


def test_sample_is_drawn_per_language(spark, stored, monkeypatch):
    rows = [(i, "ka mo ti", "aa", "s") for i in range(3000)] + [(5000 + i, "sch ein ung", "bb", "s") for i in range(3)]
    monkeypatch.setattr(m, "train", lambda words, seed: words)
    words = m.fit(stored(rows), sample_rows=40, doc_words=2)
    assert len(words["bb"]) == 6 and 0 < len(words["aa"]) <= 80


def test_all_segments_of_a_word_are_learned(monkeypatch):
    seen = set()
    whole = m.BiGRU.gradients
    monkeypatch.setattr(m.BiGRU, "gradients", lambda net, x, n, y: (seen.update(bytes(r[:3]) for r in x), whole(net, x, n, y))[1])
    m.train({"aa": [b"a" * 24 + b"b" * 24]}, steps=2)
    assert seen == {b" aa", b" bb"}


def test_no_rows_and_no_labels(spark, stored):
    assert m.identify(stored([])).count() == 0
    assert [r.lang_pred for r in m.identify(stored([(1, "abc", None, "s")])).collect()] == ["und"]


def test_documents_pool_their_positions(spark, stored, awkward):
    """Whole documents against a plain pass over every position, without a cache of words."""
    rng = random.Random(9)
    words = {k: [w for _ in range(200) for w in m.words_of(text(k, 3, rng).encode())] for k in SYLLABLES}
    langs, weights = m.train(words, steps=60)
    net = m.BiGRU(len(langs))
    net.w = weights
    rows = [(i, text(rng.choice(list(SYLLABLES)), rng.randint(1, 60), rng) + " " + "x" * rng.choice([0, 30, 100]), None, "s") for i in range(40)]
    rows += [(1000 + i, t, None, s) for i, (_, t, _, s) in enumerate(awkward) if len(t or "") < 1000]
    found = {r.doc_id: r for r in m.predict(stored(rows), (langs, weights), ["doc_id"], cache_words=20).collect()}
    for i, t, *_ in rows:
        total = np.zeros(len(langs))
        for w in (t or "").encode().lower().translate(m._TO_SPACE).split():
            for k in range(0, len(w), m.SEGMENT):
                x = np.frombuffer(b" " + w[k : k + m.SEGMENT] + b" ", np.uint8)[None]
                total += net.positions(x).sum((0, 1))
        p = np.exp(m.POOL * (total - total.max()))
        if any(map(str.isalpha, t or "")):
            assert found[i].lang_pred == langs[int(p.argmax())] and abs(found[i].score - p.max() / p.sum()) < 1e-3
        else:
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)


def test_sample_is_bounded_by_words(spark, stored):
    rows = [(i, f"{'ka' * 3000} " + "mo ti re " * 500, "aa", "s") for i in range(30)] + [(100 + i, "schein ungber", "bb", "s") for i in range(30)]
    docs = stored(rows).select("doc_id", "text", "lang")
    langs, _ = m.fit(docs, sample_rows=10, sample_words=50, doc_words=5)
    assert langs == ["aa", "bb"]
