"""Licence scans against coefficients computed for every unit and template."""

import re

from tests.compare import connect, differences
from tests.llm.helpers import DIRECTORY, as_rows, awkward, empty
from wardbook.llm import licenses, queries
from wardbook.llm.licenses import MARKERS, TEMPLATES, anchors, bigrams, words_in


def windows_of(text):
    words = words_in(text)
    places = {}
    for i in range(len(words) - 1):
        places.setdefault(f"{words[i]} {words[i + 1]}", []).append(i)
    for template in TEMPLATES.values():
        t = words_in(template)
        own = [i for i in range(len(t) - 1) if t[i] in MARKERS] or range(len(t) - 1)
        for j in own:
            gram = f"{t[j]} {t[j + 1]}"
            if f" {gram} " not in f" {' '.join(t[:j + 1])} ":  # its first place in the template
                for i in places.get(gram, []):
                    start = max(0, i - j)
                    yield " ".join(words[start:start + len(t)])


def brute(doc, text):
    text = text or ""
    found = {}
    for unit in {*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text, *windows_of(text)}:
        a = set(bigrams(unit))
        for name, template in TEMPLATES.items():
            b = set(bigrams(template))
            dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if dice >= 0.8:
                found[name] = max(found.get(name, 0), dice)
    best = min(((-d, -len(bigrams(TEMPLATES[n])), n) for n, d in found.items()), default=(0.0, 0, None))
    return doc, best[2], -best[0] + 0.0, ",".join(sorted(found))


def test_query_against_its_twin(spark):
    result = queries.op4_license_scans(spark, DIRECTORY)
    assert differences(result, connect(DIRECTORY), queries.ORACLE["op4_license_scans"]) == []
    assert 0 < result.where("license is not null").count() < result.count()


def test_units_near_matches_and_bounds(spark):
    mit, gpl = TEMPLATES["mit"], TEMPLATES["gpl-3.0-header"]
    texts = [
        mit, mit.upper() + "\r\n\nother", f"before\n  ** {mit} **\nafter", "Released under MIT License.", mit * 20,
        gpl.replace("either", "in").replace("any", "some"), gpl.replace(" ", "\n", 3), f"{gpl}\n{mit}\n{mit}",
        "words " + mit, "of several words " + mit, "the MIT License", "License", "", None, "İK " + mit,
        "Licensed under the Apache License,\nVersion 2.0.", "x\n \t\n" + gpl.replace("; ", "\n").replace(", ", ",\n"),
        " ".join(f"w{i}" for i in range(50_000)) + "\n" + mit,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert as_rows(licenses.scan(docs)) == sorted((brute(i, t) for i, t in enumerate(texts)), key=repr)


def test_notices_inside_lines_and_texts_in_comment_blocks(spark):
    filler = "some words of a page that has nothing to do with it"

    def in_comments(text, mark):
        lines = re.findall(r".{1,60}(?:\s|$)", text)
        return "\n".join([filler, *(f"{mark} {x}\n{mark}" if i % 3 == 2 else f"{mark} {x}" for i, x in enumerate(lines)), filler])

    names, texts = [], []
    for name, template in TEMPLATES.items():
        words = template.split()
        changed = " ".join(w if i % 40 != 20 else f"{w} indeed" for i, w in enumerate(words))
        for text in (f"{filler} {template} {filler}", in_comments(template, "#"), in_comments(template, " *"),
                     f"{filler}\n{in_comments(changed, '//')}", f"{filler} {template}", template):
            names.append(name)
            texts.append(text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = as_rows(licenses.scan(docs))
    assert found == sorted((brute(i, t) for i, t in enumerate(texts)), key=repr)
    assert all(names[row[0]] in row[3].split(",") for row in found)
    # Of a licence and a part of it, both found whole, the licence is named.
    assert {row[1] for row in found if texts[row[0]] in TEMPLATES.values()} == set(TEMPLATES)
    assert all(anchors(t) for t in TEMPLATES.values())
    assert licenses.scan(spark.createDataFrame([(1, filler * 20)], "doc_id long, text string")).first()["license"] is None


def test_units_without_needed_words_cannot_match():
    for template in TEMPLATES.values():
        needed, grams = licenses.needed_words(template, 0.8), bigrams(template)
        left = [g for g in grams if needed.isdisjoint(g.split())]
        # The best set without any of these words has no other bigrams than the template's.
        assert 2 * len(left) / (len(left) + len(grams)) < 0.8


def test_further_templates_come_from_a_folder(spark, tmp_path):
    long_text = " ".join(f"clause {i} says word{i} and word{i * 7 % 100}" for i in range(600))
    (tmp_path / "house-1.0").write_text(long_text)
    templates = licenses.read_templates(str(tmp_path))
    docs = spark.createDataFrame([(1, f"before {long_text} behind"), (2, "clause 1 says nothing")], "doc_id long, text string")
    found = licenses.scan(docs, {**TEMPLATES, **templates}).orderBy("doc_id").collect()
    assert [r["license"] for r in found] == ["house-1.0", None] and found[0]["dice"] == 1


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    assert as_rows(licenses.scan(docs)) == sorted(
        (brute(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(docs, {}).where("license is not null or dice <> 0").count() == 0
