"""Notices of few words."""

from helpers import documents

from orefield.llm import licenses


def test_a_short_notice_is_not_made_of_scattered_words(spark):
    rows = [
        (1, "Wir arbeiten mit der Sprache. Released under the Apache License, Version 2.0. Und so weiter mit Text."),
        (2, "Das geht mit Geduld. Licensed under the Apache License und noch mehr Prosa"),
        (3, "Ein Werk mit Zeilen. released UNDER the MIT-License, so steht es hier"),
        (4, "unreleased under the MIT License"),
    ]
    got = {r.doc_id: r.labels for r in licenses.scan(documents(spark, rows)).collect()}
    assert got == {1: "apache", 2: "apache", 3: "mit,mit-release", 4: "mit"}
