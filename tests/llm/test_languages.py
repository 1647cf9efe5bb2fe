"""Texts in many languages, many labelled languages and rare letters."""

import math
import random

from quillon.llm import langid

SCHEMA = "doc_id long, text string, lang string"
WORDS = {"en": "the cat sat with them where they thought", "fr": "le chat noir était sous une fenêtre", "de": "die schwarze katze schläft zwischen büchern", "pl": "czarny kot wszędzie skacze przez płoty"}


def test_a_text_in_four_languages_stays(spark):
    even = " ".join(WORDS.values())
    rows = [(i, f"{t} {t}", x) for x, t in WORDS.items() for i in range(20)] + [(99, even, "en"), (100, "12 !", "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    langs, table = langid.learn(df)
    assert max(s for _, s in langid.identify(even, table)) < 0.4
    assert {r.doc_id for r in langid.keep_identified(df).filter("doc_id >= 99").collect()} == {99}


def test_every_labelled_language_is_learned(spark):
    """140 languages, each of an alphabet of its own; the rarest has one document."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3 * 140)]
    text = lambda k: " ".join(["".join(letters[3 * k : 3 * k + 3])] * 30)
    rows = [(1000 * k + i, text(k), f"x{k:03d}") for k in range(140) for i in range(3 if k < 139 else 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    labelled = {r.lang for r in df.filter(~langid.common.held_out(df["doc_id"])).select("lang").distinct().collect()}
    assert len(labelled) > 128
    langs, table = langid.learn(df)
    assert langs == sorted(labelled) and table.shape[1] == len(langs)
    assert all(langs[langid.identify(text(int(x[1:])), table)[0][0]] == x for x in langs)


def test_letters_beyond_the_first_planes(spark):
    rare = "\U00020000\U00020001\U0002A6D6 " * 20
    assert len(langid.trigrams(rare)) and len(langid.trigrams("\U00030000"))
    df = spark.createDataFrame([(i, rare, "lzh") for i in range(20)] + [(50 + i, WORDS["en"], "en") for i in range(20)], SCHEMA)
    assert {(r.doc_id < 50, r.lang_pred) for r in langid.predict_languages(df).collect()} == {(True, "lzh"), (False, "en")}
    assert langid.keep_identified(df).count() == 40


def plain_mixture(p, n):
    """Expectation-maximisation in plain Python: p[i][k], the likelihood of trigram i, seen n[i] times, in language k."""
    langs, total = range(len(p[0])), sum(n)
    share = [1 / len(langs)] * len(langs)
    for _ in range(langid.ROUNDS):
        expected = [0.0] * len(langs)
        for row, times in zip(p, n, strict=True):
            whole = sum(share[k] * row[k] for k in langs)
            for k in langs:
                expected[k] += times * share[k] * row[k] / whole
        new = [e / total for e in expected]
        change, share = max(abs(a - b) for a, b in zip(new, share, strict=True)), new
        if change < langid.TOLERANCE:
            break
    return share, sum(times * math.log(sum(share[k] * row[k] for k in langs)) for row, times in zip(p, n, strict=True))


def plain_identify(text, counts):
    """counts: of each language, its trigram buckets. The chosen languages and their proportions."""
    grams = langid.trigrams(text).tolist()
    seen = sorted(set(grams))
    n = [grams.count(g) for g in seen]
    of = [[(langid.SMOOTHING + c.get(g, 0)) / (langid.SMOOTHING * langid.BUCKETS + sum(c.values())) for c in counts] for g in seen]
    first = plain_mixture(of, n)[0]
    order = sorted(range(len(counts)), key=lambda k: -first[k])
    chosen, shares = [order[0]], [1.0]
    best = sum(times * math.log(row[order[0]]) for row, times in zip(of, n, strict=True))
    for k in order[1:]:
        new, likelihood = plain_mixture([[row[j] for j in (*chosen, k)] for row in of], n)
        if likelihood - best <= langid.PENALTY * 0.5 * math.log(len(grams) + 1):
            break
        chosen, shares, best = [*chosen, k], new, likelihood
    return sorted(zip(chosen, shares, strict=True), key=lambda x: (-x[1], x[0]))


def test_inference_equals_plain_python(spark):
    rows = [(4 * i, f"{t} {t}", x) for x, t in WORDS.items() for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    learned = [(t, x) for i, t, x in rows if i in {r.doc_id for r in df.filter(~langid.common.held_out(df["doc_id"])).collect()}]
    langs, table = langid.learn(df)
    counts = [{} for _ in langs]
    for t, x in learned:
        own = counts[langs.index(x)]
        for g in langid.trigrams(t).tolist():
            own[g] = own.get(g, 0) + 1
    rng = random.Random(2)
    for _ in range(60):
        text = " ".join(rng.choice(list(WORDS.values()))[: rng.randrange(4, 60)] for _ in range(rng.randrange(1, 6)))
        got, want = langid.identify(text, table), plain_identify(text, counts)
        assert [k for k, _ in got] == [k for k, _ in want], text
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want, strict=True))


def test_a_share_is_never_nothing(spark, monkeypatch):
    """So many documents that a share of them rounds to none: still one place in PLACES is learned from."""
    monkeypatch.setattr(langid, "PLACES", 4)
    df = spark.createDataFrame([(i, f"{WORDS['en']} {i}", "en") for i in range(400)], SCHEMA)
    langs, table = langid.learn(df, sample=1)
    assert langs == ["en"] and table.n.sum() > 0


def test_long_texts_are_counted_in_parts(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab é7 .日", k=rng.randrange(0, 60))) for _ in range(500)] + ["", "a", " ", "a" * 7, " " * 21]
    whole = [langid.trigrams(t).tolist() for t in texts]
    monkeypatch.setattr(langid, "SPAN", 7)
    for t, want in zip(texts, whole, strict=True):
        assert langid.trigrams(t).tolist() == want, repr(t)
        at, n = langid.trigram_counts(t)
        assert list(zip(at.tolist(), n.tolist(), strict=True)) == [(g, want.count(g)) for g in sorted(set(want))], repr(t)
