"""The pipeline's language stage decides by its inferred mixtures."""

from __future__ import annotations

import random

import pytest

from loomwright.llm import language

WORDS = {"xx": ["the", "house", "with", "river", "stone", "walks", "under"], "yy": ["daß", "über", "zwei", "schön", "nicht", "wäre", "grün"], "zz": ["qu'il", "été", "où", "leçon", "même", "garçon", "château"]}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=1, n=600):
    r = random.Random(seed)
    names = sorted(WORDS)
    return [(k, names[k % 3], " ".join(r.choice(WORDS[names[k % 3]]) for _ in range(r.randrange(5, 40)))) for k in range(n)]


@pytest.fixture(scope="module")
def stage(spark):
    def run(rows):
        table = spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in rows], COLUMNS)
        found = language.known_language(table)
        assert found.columns == table.columns
        return {x.doc_id: x.lang for x in found.collect()}

    return run


def test_null_languages_are_filled_and_no_language_goes(stage):
    rows = [(k, t, None if k >= 400 else lang) for k, lang, t in texts()]
    noise = random.Random(2)
    junk = [(900 + k, " ".join("".join(noise.choice("0123456789#$%&=~^{}x") for _ in range(12)) + "Z" for _ in range(30)), None) for k in range(2)]
    half = [(950, "the house with the river under stone " + "9#7$=~{} " * 2, None)]
    out = stage([*rows, *junk, *half, (960, None, "xx"), (961, "", "xx"), (962, "12 34 -", "yy")])
    assert out == {k: lang for k, lang, _ in texts()} | {950: "xx"}


def test_other_labels_change_the_stage(stage):
    rows = texts()
    turned = {"xx": "yy", "yy": "zz", "zz": "xx"}
    right = stage([(k, t, None if k >= 400 else lang) for k, lang, t in rows])
    wrong = stage([(k, t, None if k >= 400 else turned[lang]) for k, lang, t in rows])
    assert {k: turned[x] for k, x in right.items()} == wrong
    # a language that nobody has labelled is none
    unknown = stage([(k, t, lang) for k, lang, t in rows if lang != "zz"] + [(500, " ".join(WORDS["zz"]), None)])
    assert 500 not in unknown and len(unknown) == 400


def test_without_labels_nothing_goes(stage):
    rows = [(k, t, None) for k, _, t in texts(n=9)] + [(20, None, None), (21, "", None)]
    assert stage(rows) == {k: None for k, *_ in rows}
    assert stage([]) == {}
