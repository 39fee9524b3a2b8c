"""Language models: held-out accuracy, mixing, labels, awkward input."""

import random

import numpy as np

from factloom.llm import language

PARTS = {
    "en": "the port authority|an old negotiator|the river council|three ships;reported a drop in traffic|asked for more time|left before the storm|rejected the claims;near the border|on Tuesday|within two days|after the meeting",
    "fr": "la capitainerie|un ancien négociateur|le conseil du fleuve|trois navires;a signalé une baisse du trafic|a demandé plus de temps|est parti avant la tempête|a rejeté les accusations;près de la frontière|mardi dernier|sous deux jours|après la réunion",
    "de": "die Hafenbehörde|ein alter Unterhändler|der Flussrat|drei Schiffe;meldete einen Rückgang des Verkehrs|bat um mehr Zeit|ging vor dem Sturm fort|wies die Vorwürfe zurück;nahe der Grenze|am Dienstag|binnen zwei Tagen|nach der Sitzung",
    "ru": "портовый совет|старый посредник|речной комитет|три корабля;сообщил о падении перевозок|попросил больше времени|ушёл до начала бури|отверг все обвинения;возле границы|во вторник|за два дня|после встречи",
}
NAMES = ["Kimberg", "Zashaven", "Torgrad", "Velpolis"]


def sentence(rng, lang):
    a, b, c = (rng.choice(p.split("|")) for p in PARTS[lang].split(";"))
    return f"{a} {b} {c} {rng.choice(NAMES)} {rng.randrange(99)}."


def trained(wrong=0.0):
    rng = random.Random(1)
    rows = []
    for lang in PARTS:
        for _ in range(120):
            rows.append((rng.choice(list(PARTS)) if rng.random() < wrong else lang, sentence(rng, lang)))
    return language.train_labelled(rows)


def best(models, texts):
    j = language.judge(models, texts, np.arange(len(texts)), len(texts))
    return [models.langs[i] if i >= 0 else None for i in j.lang], j


def direct(models, j, text):
    """Bits of a text under one model, n-gram by n-gram from its tables."""
    padded = chr(language._START) * (language.ORDER - 1) + text + " "
    h = language._hashes(np.array([ord(c) for c in padded], np.uint64))
    bits = 0.0
    for i in range(language.ORDER - 1, len(padded)):
        for k in range(language.ORDER, 0, -1):
            hit = np.nonzero(models.grams[k] == h[k][i])[0]
            if len(hit):
                bits -= models.logs[k][hit[0], j]
                break
            context = np.nonzero(models.contexts[k] == h[k - 1][i - 1])[0] if k > 1 else []
            if len(context):
                bits -= models.weights[k][context[0], j]
        else:
            bits += 16
    return bits / (len(text) + 1)


def test_lookup_equals_direct_backoff():
    models = trained()
    for t in ("the port asked", "qq портовый x", "zz"):
        ce, _ = models.cross_entropy([t, "le conseil"])
        assert np.allclose(ce[0], [direct(models, j, t) for j in range(len(models.langs))], atol=1e-4)


def test_kneser_ney_probabilities():
    """The lowest order leaves some of the mass, never more, to characters that were not seen."""
    models = language.train({"en": ["abab abba ba", "babb ab"]})
    top = np.exp2(models.logs[1][:, 0].astype(float)).sum()
    assert 0.5 < top <= 1.0 + 1e-6


def test_held_out_accuracy():
    rng = random.Random(99)
    for wrong in (0.0, 0.2):
        models = trained(wrong)
        texts = [(lang, sentence(rng, lang)) for lang in PARTS for _ in range(60)]
        got, j = best(models, [t for _, t in texts])
        assert sum(g == lang for g, (lang, _) in zip(got, texts, strict=True)) >= 0.98 * len(texts)
        assert ((j.confidence >= 0) & (j.confidence <= 1)).all()


def test_rejection():
    models = trained()
    got, j = best(models, ["", "12 34", "Ok", "qxz vvkq jjxw zzqk xwvq kkzj", "東京の港で船が止まった"])
    assert got == [None] * 5 and not j.confidence.any()


def test_labels():
    known = {"EN": "en", "en-US": "en", "eng": "en", "français": "fr", "ger": "de", "Deutsch": "de", "русский": "ru", "pt_BR": "pt", " es-419 ": "es"}
    assert {k: language.label_language(k) for k in known} == known
    assert [language.label_language(x) for x in (None, "", "-", "und", "xx", "N/A", "unknown", 3)] == [None] * 8


def test_sentences():
    assert language.sentences("https://a.example/b", None) == [] and language.sentences("", "  ") == []
    assert language.sentences("One two / Trois quatre", "A <b>b</b>. C d! E\nF") == ["One two", "Trois quatre", "A  b .", "C d!", "E", "F"]


def test_detect(spark):
    rng = random.Random(4)
    models = trained()
    en, fr = sentence(rng, "en"), sentence(rng, "fr")
    rows = [("right", en, sentence(rng, "en"), "EN-gb"), ("wrong", fr, None, "en"), ("mixed", en, fr, "en"), ("none", sentence(rng, "ru"), "", None), ("address", "http://x.example/y", None, "en"), ("empty", None, None, None), ("long", en * 800, None, "en")]
    df = spark.createDataFrame(rows, "doc_id string, title string, summary string, language string").withColumn("seq", df_one())
    errors = {(r.doc_id, r.lang) for r in language.label_errors(df, models, "doc_id", ["title", "summary"], "language").collect()}
    assert errors == {("wrong", "fr"), ("mixed", "en"), ("mixed", "fr"), ("none", "ru")}
    out = language.detect(df, models, "doc_id", ["title", "summary"], "language")
    assert {r.doc_id for r in out.where("mixed").collect()} == {"mixed"} and out.where("confidence < 0 or confidence > 1").count() == 0
    assert language.detect(df.limit(0), models, "doc_id", ["title", "summary"]).count() == 0


def df_one():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_sampling_is_bounded(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(str(i), sentence(rng, "en"), "eng" if i % 2 else None) for i in range(2000)], "doc_id string, title string, language string")
    got = language.sample_labelled(df, "language", ["title"], "doc_id", per_language=200)
    assert 120 < len(got) < 290 and {g[0] for g in got} == {"en"}
    assert language.sample_labelled(df.limit(0), "language", ["title"], "doc_id") == []
    assert language.train_labelled([]).langs == ()


def test_confidence_is_calibrated():
    """Of short pieces of sentences the models never saw, about as many are right as their confidence says."""
    rng = random.Random(31)
    models = trained(0.1)
    rows = [(lang, sentence(rng, lang)[at : at + rng.randrange(9, 14)]) for lang in PARTS for _ in range(400) for at in [rng.randrange(12)]]
    ce, n = models.cross_entropy([t for _, t in rows])
    j = language.judge(models, [t for _, t in rows], np.arange(len(rows)), len(rows))
    right = np.array([models.langs[i] == lang for i, (lang, _) in zip(ce.argmin(axis=1), rows, strict=True)])
    known = j.confidence > 0
    error = sum(abs(right[some].mean() - j.confidence[some].mean()) * some.sum() for low in np.arange(0, 1, 0.2) if (some := known & (j.confidence > low) & (j.confidence <= low + 0.2)).any()) / known.sum()
    assert error < 0.05 and known.mean() > 0.9


def test_few_true_sentences_are_rejected_and_most_foreign_ones():
    rng = random.Random(32)
    models = trained()
    own = [sentence(rng, lang) for lang in PARTS for _ in range(300)]
    other = ["ma päälinnan satama suljettiin eilen illalla", "de haven van de stad is gisteren gesloten", "hamnen i staden stängdes igår kväll klockan nio", "η λιμενική αρχή έκλεισε χθες το βράδυ"]
    got, _ = best(models, own)
    assert sum(g is None for g in got) <= 0.02 * len(own) and sum(g is None for g in best(models, other)[0]) >= 3
