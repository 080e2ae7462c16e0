import numpy as np
from pyspark.sql import functions as F

import tablewright.llm.quality as quality
from tablewright.llm.common import ascii_lower, words_of
from tablewright.llm.language import identify
from tablewright.llm.quality import score_quality

EN = "the of and this that with from over there under house"
FR = "le la les des une avec pour dans sur être écrit maison"
DE = "der die das und nicht mit über straße größe haus kein"
ES = "el los las una con para sobre niño señal casa aquí"


def corpus(spark, n=40):
    draw, rows = np.random.default_rng(1), []
    for i in range(n):
        for j, (lang, text) in enumerate({"en": EN, "fr": FR, "de": DE, "es": ES}.items()):
            rows.append((4 * i + j, " ".join(draw.choice(text.split(), 12)), lang, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, LANG_PRED string")


def test_languages(spark):
    df = corpus(spark)
    odd = spark.createDataFrame([(None, None, "en", ""), (900, "", None, ""), (901, "123 !!", "fr", ""), (902, "straße " * 30000, None, None), (902, "straße " * 30000, None, None)], df.schema)
    found = identify(df.union(odd), F.coalesce(F.col("doc_id") % 4 != 9, F.lit(True))).collect()
    assert all(0 <= r.lang_score <= 1 for r in found)
    assert sum(r.lang_pred == r.lang for r in found if r.doc_id is not None and r.doc_id < 900) >= 158
    odd = [(r.doc_id, r.lang_pred) for r in found if r.doc_id is None or r.doc_id >= 900]
    assert sorted(odd, key=str) == [(900, "und"), (901, "und"), (902, "de"), (902, "de"), (None, "und")]
    assert identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark):
    draw, rows, marks = np.random.default_rng(2), [], []
    for i in range(200):
        words = [str(w) for w in draw.choice(EN.split(), 30)]
        bad = i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), "a"))
        marks.append((i, 0 if bad else 1))
    rows += [(500, None, None), (501, "", None), (501, "", None), (None, "word " * 50000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SCORE string")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    scored = score_quality(df, labels, F.col("doc_id") % 4 != 1)
    assert scored.columns == ["doc_id", "text", "score"]
    out = scored.collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    wrong = [r.doc_id for r in out if r.doc_id is not None and r.doc_id < 500 and r.doc_id % 4 == 1 and (r.score >= 0.5) != (r.doc_id % 3 != 0)]
    assert len(wrong) <= 1
    assert score_quality(df.limit(0), labels, F.lit(True)).count() == 0
    assert {r.score for r in score_quality(df, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_forms_of_all_words_of_a_text_at_once(monkeypatch):
    """new words cost no Python call each, and buckets, forms and lengths are those of the words one by one."""
    draw = np.random.default_rng(4)
    letters = [*map(chr, range(128)), *"éÉßǅ１Ⅳ²ª…»\u00a0\u0085\ud800🎉𝐀", *"aAbBcC1!. " * 20]
    texts = [None, "", " \n", "É", "a", "!", "!!", "A!!", "Straße STRASSE straße", *("".join(draw.choice(letters, 120)) for _ in range(300))]
    for text in texts:
        words = words_of(text)
        distinct = list(dict.fromkeys(words))
        n = [words.count(w) for w in distinct]
        long = [len(w) >= quality.LONG_WORD for w in distinct]
        repeats = [sum(long), sum(c - 1 for c, far in zip(n, long) if far), sum(a == b for a, b in zip(words, words[1:]))]
        buckets, n_words, forms, n_forms = (x.tolist() for x in quality.tokens_of(text))
        assert buckets == [quality.bucket_of(ascii_lower(w)) for w in distinct] and n_words == n, text
        assert forms[:-3] == [quality.bucket_of(quality.form_of(w)) for w in distinct] and n_forms == n + repeats, text

    asked, form_of = [], quality.form_of
    monkeypatch.setattr(quality, "form_of", lambda word: asked.append(word) or form_of(word))
    quality.tokens_of(" ".join(f"Größe{i} {i}wort, ÉTÉ{i}!! x{i}é" for i in range(1000)))
    assert not asked
