"""License notices against containment in every window."""

import random

import pytest

from tidewatch.llm import licenses


def pairs(text):
    words = licenses._words(text)
    return list(zip(words, words[1:]))


def by_hand(text):
    found = {}
    own = pairs(text or "")
    for name, template in licenses.TEMPLATES.items():
        wanted, size = set(pairs(template)), licenses.window_size(len(licenses._words(template)))
        for start in range(0, len(own), size // 2):
            share = len(set(own[start:start + size - 1]) & wanted) / len(wanted)
            if share >= licenses.CONTAINMENT and share > found.get(name, (0,))[0]:
                found[name] = (share, start)
    return found


def test_notices(spark):
    rng = random.Random(1)
    docs = []
    for k in range(120):
        words = rng.choices(["the", "license", "of", "under", "software", "x1"], k=rng.randrange(0, 120))
        if k % 2:
            notice = rng.choice(list(licenses.TEMPLATES.values())).split()
            if k % 3 == 0:
                notice.insert(rng.randrange(len(notice)), "indeed")
            at = rng.randrange(len(words) + 1)
            words[at:at] = [rng.choice([str.upper, str])(w) for w in notice]
        docs.append((k, rng.choice([" ", "\n"]).join(words), 0))
    docs += [(200, None, 0), (201, "", 0), (202, "word " * 50_000 + licenses.TEMPLATES["mit notice"], 0)]
    df = spark.createDataFrame(docs + docs[:3], "doc_id long, text string, containment int")
    got = {(r["doc_id"], r["template"]): (r["containment"], r["start_word"]) for r in licenses.license_notices(df).collect()}
    assert got == {(i, n): v for i, t, _ in docs for n, v in by_hand(t).items()}
    assert (202, "mit notice") in got


def test_bands_keep_their_promise():
    for text in licenses.TEMPLATES.values():
        n = len(licenses._words(text))
        shingles, window = n - 1, licenses.window_size(n) - 1
        least = -(-8 * shingles // 10)
        similarity = least / (window + shingles - least)
        assert (1 - similarity) ** licenses.bands_for(n) <= licenses.MISS
        phrases = licenses.needed_phrases(text)
        assert len(set(pairs(text))) - len(phrases) < licenses.CONTAINMENT * len(set(pairs(text)))


def test_own_templates_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(None, "all rights are mine"), (1, "nothing")], "doc_id long, text string")
    found = licenses.license_notices(df, {"mine": "all rights are mine"}).collect()
    assert [tuple(r) for r in found] == [(None, "mine", 1.0, 0, 1)]
    assert licenses.license_notices(df.limit(0)).collect() == []
    assert licenses.license_notices(df, {}).collect() == []
    with pytest.raises(ValueError):
        licenses.license_notices(df, {"short": "one"})


def test_usual_notices_have_a_template(spark):
    best = {
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by-4.0 notice",
        "Licensed under CC BY 3.0": "cc-by-3.0 short",
        "Content is licensed under CC BY-SA 3.0 unless noted": "cc-by-sa-3.0 short",
        "licensed under the GNU Lesser General Public License v2.1": "lgpl-2.1 v",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3 notice",
        "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3 notice",
        "under the terms of the Eclipse Public License v2.0": "epl v2.0 terms",
        "// SPDX-License-Identifier: LGPL-2.1-or-later": "spdx LGPL-2.1-or-later",
        "This is free and unencumbered software released into the public domain.": "released into the public domain",
        "(c) 2020 Somebody. All rights reserved.": "all rights reserved",
    }
    # the middle of a longer license text, from any word
    body = licenses.NOTICES["mit text, word 24"], licenses.NOTICES["mit text, word 36"]
    docs = [(k, "word " * 30 + t + " word" * 30) for k, t in enumerate([*best, *body])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = licenses.license_notices(df).where("place = 1").collect()
    first = {}
    for r in rows:
        first.setdefault(r["doc_id"], set()).add(r["template"])
    for k, name in enumerate(best.values()):
        assert name in first[k], (k, name, first.get(k))
    assert "mit text, word 24" in first[len(best)] and "mit text, word 36" in first[len(best) + 1]


def test_notices_with_words_put_in_are_found_wherever_they_stand(spark):
    notices = ["Licensed under the Apache Software Foundation License, Version 2.0.",
               "Licensed under the very old and good Apache License, Version 2.0."]
    template = {"apache": licenses.TEMPLATES["apache-2.0 notice"]}
    docs = [(64 * k + at, "word " * at + notice + " word" * 40) for k, notice in enumerate(notices) for at in range(64)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["containment"] for r in licenses.license_notices(df, template).collect()}
    assert found == {i: 6 / 7 for i, _ in docs}


def test_half_a_window_has_room_for_words_put_in(spark):
    for n in range(2, 300):
        assert licenses.window_size(n) // 2 >= n + licenses.room(n)
