"""The learned splitter, in four languages."""

from __future__ import annotations

import random

import pytest

from dossier.operators.chunking import Packer
from dossier.operators.sentences import Sentences, fit, scored, word_counts

TEXTS = {
    "en": (["Acme Inc. sells tools in the U.S. market.", "See No. 7 of the list.", "He met Dr. Brown there.", "No, it is not so.", "The rest is said in No. 12 below.", "Later the firm grew.", "We saw it in the U.S. again."], [("Acme Inc. grew. It sells tools.", ["Acme Inc. grew.", "It sells tools."]), ("See No. 7 for it. Later it fell.", ["See No. 7 for it.", "Later it fell."]), ("He is in the U.S. The rest is here.", ["He is in the U.S.", "The rest is here."]), ("Ask Dr. Brown. \"Is it so?\" Yes!", ["Ask Dr. Brown.", "\"Is it so?\"", "Yes!"])]),
    "de": (["Die Firma hat z.B. Holz.", "Siehe Nr. 7 der Liste.", "Er traf Dr. Braun dort.", "Siehe Nr. 12 dort.", "Das ist gut.", "Er sagt, das ist z.B. so.", "Man sieht, die Zahl steigt."], [("Siehe Nr. 7 dazu. Das ist gut.", ["Siehe Nr. 7 dazu.", "Das ist gut."]), ("Er traf Dr. Braun. Das ist z.B. Holz.", ["Er traf Dr. Braun.", "Das ist z.B. Holz."])]),
    "fr": (["Il a vu M. Petit ici.", "Voir art. 7 de la loi.", "Voir art. 12 ici.", "On dit que M. Petit est ici.", "La loi est la loi.", "Il dit que la loi est bonne."], [("Voir art. 7 ici. La loi est bonne.", ["Voir art. 7 ici.", "La loi est bonne."]), ("Il a vu M. Petit. Il est ici.", ["Il a vu M. Petit.", "Il est ici."])]),
    "es": (["El Sr. Gil vive en EE.UU. desde enero.", "Ver núm. 7 de la lista.", "Ver núm. 12 de la lista.", "Dice que el Sr. Gil vive.", "La lista es larga.", "Dice que la lista es larga."], [("Ver núm. 7 hoy. La lista es larga.", ["Ver núm. 7 hoy.", "La lista es larga."]), ("El Sr. Gil vive en EE.UU. Dice que es bueno.", ["El Sr. Gil vive en EE.UU.", "Dice que es bueno."])]),
}


@pytest.mark.parametrize("lang", sorted(TEXTS))
def test_abbreviations_of_four_languages(spark, lang):
    rng = random.Random(1)
    said, asked = TEXTS[lang]
    filler = {"en": "the thing was sold and kept later", "de": "das ding ist dort und hier er", "fr": "la chose est vue et dite il", "es": "la cosa dice que vive y va"}[lang].split()
    rows = [(" ".join([*rng.choices(said, k=4), *(" ".join(rng.choices(filler, k=8)).capitalize() + "." for _ in range(6))]),) for _ in range(60)]
    model = fit(spark.createDataFrame([*rows, (None,), ("",)], "text string"))
    for text, want in asked:
        assert model(text) == want
    # Words that often end a sentence and stand within others too are none.
    assert not model.abbreviations & set(filler)


def test_scores_by_hand(spark):
    import math

    rows = {r["word"]: r for r in scored(word_counts(spark.createDataFrame([("Inc. a b Inc. c. Inc. 7 (inc) \"Dr.\" ",)], "text string"))).collect()}
    assert (rows["inc"]["total"], rows["inc"]["with_period"], rows["inc"]["before_number"], rows["inc"]["small"]) == (4, 3, 1, 1)
    p = 5 / 9
    ratio = -2 * (3 * math.log(p) + math.log(1 - p) - 3 * math.log(0.99) - math.log(0.01))
    assert rows["inc"]["score"] == pytest.approx(ratio * math.exp(-3) / 3)
    assert set(rows) == {"inc", "c", "dr"}


def test_lines_quotes_and_plain_use():
    plain = Sentences()
    assert plain("One. Two! three? Four\nFive. (Six.) e.g. Seven J. Smith") == ["One.", "Two! three?", "Four", "Five.", "(Six.) e.g. Seven J. Smith"]
    assert plain("") == plain(None) == [] and plain(" \n ") == []
    assert [t for t, *_ in Packer(3, 0, 9, sentences=plain).pack("A bb cc. D ee ff.")] == ["A bb cc.", "D ee ff."]
