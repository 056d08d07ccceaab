import pytest

from civiclink.llm import licenses

from .cases import empty, frame, odd, odd_rows, prose


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(frame(spark, ["\n".join(prose(100 * i + j, 12) for j in range(4)) for i in range(300)]))


NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "All rights reserved.": "proprietary",
    "SPDX-License-Identifier: MIT": "mit",
    "This project is released under the MIT License (see LICENSE).": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
}


def test_notices_and_other_text(spark, model):
    texts = ["\n".join([prose(i, 12), "", notice, prose(i + 50, 9)]) for i, notice in enumerate(NOTICES)]
    texts += [prose(900 + i, 30) for i in range(60)] + ["the license of the river", "a copy of this version is free", "under the public work of this file"]
    rows = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, texts), model=model).collect()}
    for i, family in enumerate(NOTICES.values()):
        assert (rows[i]["families"], rows[i]["n_license"], rows[i]["n_paragraphs"]) == (family, 1, 3)
        assert rows[i]["found"][0]["paragraph"] == 1 and 0.5 <= rows[i]["found"][0]["probability"] <= 1
    assert all(rows[i]["n_license"] == 0 for i in range(len(NOTICES), len(texts)))


def test_wrapped_notices_and_notices_inside_long_lines(spark, model):
    bsd = "Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following\nconditions are met:"
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    cases = [
        ("Released under the\nMIT License.", "mit", 1),
        ("This program is licensed under the Apache\nLicense, Version 2.0", "apache", 1),
        (bsd, "bsd", 1),
        (f"{prose(1, 3000)} {mit} {prose(2, 3000)}", "mit", 1),
        (f"{prose(3, 400)} {mit} {prose(4, 400)} {apache} {prose(5, 400)}", "apache,mit", 2),
        (f"{prose(6, 12)}\n{prose(7, 9)} Released\nunder the MIT License. {prose(8, 9)}\n{prose(9, 12)}", "mit", 1),
    ]
    rows = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, [c[0] for c in cases]), model=model).collect()}
    assert [(rows[i]["families"], rows[i]["n_license"]) for i in range(6)] == [c[1:] for c in cases]
    assert rows[5]["found"][0]["paragraph"] == 1


def test_scoring_against_plain_features(model):
    for line in [*NOTICES, prose(3, 20), ""]:
        words = licenses.words_of(line.encode().translate(licenses.CLEAN))
        names = {w for w in words if w in model.single}
        ids = {model.single[w] for w in names}
        ids |= {model.pairs[model.single[a], model.single[b]] for a, b in zip(words, words[1:]) if a in names and b in names and (model.single[a], model.single[b]) in model.pairs}
        assert model.features(words) == sorted(ids)


def test_training_is_repeatable(spark, model):
    again = licenses.train(frame(spark, ["\n".join(prose(100 * i + j, 12) for j in range(4)) for i in range(300)]).repartition(5))
    assert (again.weights == model.weights).all() and again.threshold == model.threshold


def test_odd_rows(spark, model):
    rows = licenses.license_scan(odd(spark), model=model).collect()
    assert len(rows) == len(odd_rows()) and all(r["n_license"] == 0 for r in rows)
    assert sorted(r["n_paragraphs"] for r in rows) == sorted(sum(bool(x.strip()) for x in (r[1] or "").split("\n")) for r in odd_rows())
    assert licenses.license_scan(odd(spark)).count() == len(odd_rows())


def test_empty_table(spark):
    assert licenses.license_scan(empty(spark)).count() == 0
