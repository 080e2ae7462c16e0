import random
import re

import pytest
from pyspark.sql import functions as F

from tablewright.llm import licenses
from tablewright.llm.license_rules import BASE, CONFIDENCE, MOST_WORDS, SENTENCES, rules

RULES = rules()
PARTS = [
    "apsl 2", "GPL v3 or (at your option) any later version", "three-clause BSD", "Perl Artistic License 2.0", "unlicense", "Unlicence", "license mit 0",
    "Licensed under the Apache License, Version 2.0.", "MIT License", "mit", "license", "the GNU General Public License, version 3 or later",
    "CC BY-NC 4.0", "gplv2", "GPL-2.0-only", "SPDX-License-Identifier: LGPL-2.1", "general public license", "mit license mit license", "Mozilla Public Licence 2.0",
    "all rights reserved", "KELVIN K mit", "é", "日本", "apache", "Apache  LICENSE", "cc by sa 3.0 unported", "word", "_", "the", "İ", "\x00", "gnu lesser general public license v2.1",
]


def plain(text, known):
    """The result by trying every rule at every word and comparing all pairs of findings."""
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = []
    for i, word in enumerate(words):
        window = " ".join(words[i : i + MOST_WORDS])
        for n, rule in enumerate(known):
            if rule.keyword == word and (m := re.match(f"(?:{rule.expression})(?= |$)", window)):
                found.append((i, i + m.group().count(" "), rule.label, rule.priority, n))
    base, rest = [f for f in found if f[3] == BASE], [f for f in found if f[3] > BASE]

    def better(e, d):
        return e[0] <= d[0] and e[1] >= d[1] and (e[3], e[1] - e[0], -e[4]) > (d[3], d[1] - d[0], -d[4])

    kept = [d for d in rest if not any(better(e, d) for e in rest)]
    missed = 1.0
    for f in base + kept:
        missed *= 1 - CONFIDENCE[f[3]]
    return len(words), set(base), set(kept), 1 - missed


def check(spark, texts, known=None):
    df = spark.createDataFrame([(n, t, "own") for n, t in enumerate(texts)], "doc_id long, text string, LICENSES string")
    for row in licenses.scan_licenses(df, known=known).collect():
        n, base, kept, score = plain(row["text"], RULES if known is None else known)
        got = row["licenses"]
        assert got.n_words == n and set(map(tuple, got.base)) == base and len(got.base) == len(base)
        assert set(map(tuple, got.found)) == kept and len(got.found) == len(kept)
        assert got.score == pytest.approx(score)


def test_equals_trying_all_rules(spark):
    draw = random.Random(1)
    texts = [None, "", " ", "--", "x", *[draw.choice([" ", "\n", ", "]).join(draw.choices(PARTS, k=draw.randint(0, 9))) for _ in range(400)]]
    check(spark, [*texts, *texts[5:9]])
    assert licenses.scan_licenses(spark.createDataFrame([], "text string")).count() == 0


def test_many_findings_in_one_text(spark, monkeypatch):
    monkeypatch.setattr(licenses, "CHUNK", 3)
    check(spark, ["MIT License. GPLv3, Apache 2.0; " * 60, "word " * 100_000 + "mit license"])


def test_rules_are_sound(spark):
    assert len({r.keyword for r in RULES}) > 200 and len(RULES) > 500
    assert all(re.fullmatch("[a-z0-9]+", r.keyword) and re.match(r.keyword[:1], r.expression) for r in RULES)
    assert max(r.expression.count(" ") for r in RULES) < MOST_WORDS
    # The sentences without variants are found in themselves.
    lines = [line.split(": ", 1) for line in SENTENCES.strip().splitlines() if not set(line) & set("(?[")]
    df = spark.createDataFrame([(label, f"and {sentence}.") for label, sentence in lines], "label string, text string")
    assert licenses.scan_licenses(df).where(~F.exists("licenses.found", lambda f: f["label"] == F.col("label"))).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("mit license",)], "text string")
    plan = licenses.scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
