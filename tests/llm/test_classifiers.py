"""Quality and toxicity: the parts on their own, and held-out accuracy."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tests.llm.helpers import DIRECTORY, awkward, empty
from wardbook.llm import quality, queries, toxicity

LARGER = DIRECTORY.replace("sf0.001", "sf0.01")
LABELS = "doc_id long, label int"


def merged(spark, query, label):
    found = query(spark, LARGER).toPandas()
    assert found.score.between(0, 1).all() and len(found) == len(pd.read_parquet(f"{LARGER}/documents.parquet"))
    return found.merge(pd.read_parquet(f"{LARGER}/labels.parquet")[["doc_id", label]], on="doc_id")


def test_quality_held_out(spark):
    rows = merged(spark, queries.op2_quality_classifier, "quality")
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() >= 0.95
    assert (rows.predicted == (rows.score >= 0.7)).all()
    assert held[held.quality == 1].predicted.mean() >= 0.97  # clean documents stay


def test_toxicity_held_out(spark):
    rows = merged(spark, queries.op9_toxicity, "toxic")
    held = rows[rows.held_out]
    assert (held.predicted == held.toxic).mean() >= 0.94
    assert held[held.toxic == 0].predicted.mean() <= 0.03
    assert held[held.toxic == 1].predicted.mean() >= 0.5  # of the few labels there


def test_flattened_trees_say_what_a_walk_says():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = quality.grow(x, y)

    def walk(row):
        total = trees.base
        for features, cuts, values in zip(trees.features, trees.cuts, trees.values):
            node = 0
            while node < len(features):
                node = 2 * node + (2 if row[features[node]] > cuts[node] else 1)
            total += values[node - len(features)]
        return 1 / (1 + math.exp(-total))

    scores = trees.scores(x)
    assert scores == pytest.approx([walk(r) for r in x], abs=1e-12)
    assert ((scores > 0.5) == y).mean() > 0.97


def test_one_class_and_no_labels():
    x = np.zeros((5, len(quality.FEATURES)))
    assert quality.grow(x, np.ones(5)).scores(x) == pytest.approx(1, abs=1e-5)
    none = quality.grow(x[:0], np.zeros(0))
    assert not none.learned and none.scores(x) == pytest.approx(0.5)


def all_readings(token, model):
    """Every path through the lattice with its score."""
    found = {}
    for path in itertools.product(*toxicity.lattice(token)):
        text, (a, b), total = "", (0, 0), 0.0
        for letter, channel in path:
            total += channel
            if letter:
                c = toxicity._code(letter)
                total += model[a, b, c]
                a, b, text = b, c, text + letter
        total += model[a, b, 0]
        found[text] = max(total, found.get(text, -math.inf))
    return found


def test_viterbi_finds_the_best_reading(spark):
    docs = spark.createDataFrame([(i, "the idiot is a stupid moron with trash and worthless scum " * 3) for i in range(3)],
                                 "doc_id long, text string")
    model = toxicity.letter_model(docs)
    assert np.exp(model).sum(axis=-1) == pytest.approx(1)
    for token in ("1d10t", "id1ooot", "m0r0n", "5tup1d", "tr@sh", "i.d.i.o.t", "w0rth1e55", "$cum", "id*ot", "mo-ron"):
        readings = all_readings(token, model)
        assert readings[toxicity.decode(token, model)] == pytest.approx(max(readings.values()))
    restorer = toxicity.Restorer(model)
    text = "An !!1d10t!! said: i d i o t, IDIOT### tr4sh. m-o-r-o-n well-known a b 2024 scu*m st*pid"
    words = restorer.words(text)
    assert words["idiot"] == 3 and words["trash"] == 1 and words["moron"] == 1 and words["well"] == words["known"] == 1
    assert words["scum"] == words["stupid"] == 1


def test_long_tokens_are_read(spark):
    docs = spark.createDataFrame([(i, "you are such an idiot and this is trash for any moron here " * 3) for i in range(3)],
                                 "doc_id long, text string")
    restorer = toxicity.Restorer(toxicity.letter_model(docs))
    plain = "you are such an idiot and this is trash for any moron here and this is such an idiot"
    for text in (plain.replace(" ", "."), plain.replace(" ", "/"), plain.replace(" ", "_").replace("idiot", "1d10t"),
                 " ".join(plain.replace(" ", "")), ".".join(plain.replace(" ", "")), "idi" + "o" * 5000 + "t trash"):
        words = restorer.words(text)
        assert words["idiot"] and words["trash"], text[:80]
    chinese = "".join(chr(0x4e00 + i) for i in range(100)) + "\u767d\u75f4" + "".join(chr(0x5000 + i) for i in range(100))
    assert restorer.words(chinese)["\u767d\u75f4"] == 1
    assert len(restorer.words("a1" * 50_000 + "." * 50_000 + "b")) > 0  # linear


def test_obfuscated_words_count(spark):
    ends = (" you know", " you idiot")
    texts = [(i, f"some plain words number {'x' * (i % 9)} here and there" + ends[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(texts + [(1000, "you 1d1ot"), (1001, "you i d i o t go"), (1002, "you there")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], LABELS)
    model, scorer = toxicity.train(docs, labels)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model, scorer).collect()}
    assert [found[i] for i in (0, 1, 1000, 1001, 1002)] == [0, 1, 1, 1, 0]


def test_copies_of_one_text_do_not_fill_the_lexicon(spark):
    def name(i, first):
        return first + "".join("bcdfghjklm"[int(d)] + "aeiouaeiou"[int(d)] for d in f"{i:03}")

    # Near copies of one toxic text of 500 words, beside other toxic texts that share a word.
    copied = " ".join(name(i, "q") for i in range(500))
    rows = [(i, f"{copied} copy {name(i, 'w')}", 1) for i in range(150)]
    rows += [(200 + i, f"some plain words {name(i, 'n')} here you idiot", 1) for i in range(50)]
    rows += [(400 + i, f"some plain words {name(i, 'n')} here you know", 0) for i in range(200)]
    # Exact copies of a text count once.
    rows += [(700 + i, "a text of which there are many flurb copies", 1) for i in range(100)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, "you idiot"), (1001, "plain flurb")], "doc_id long, text string")
    model, scorer = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], LABELS))
    assert "idiot" in scorer.weights and "flurb" not in scorer.weights
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model, scorer).where("doc_id >= 1000").collect()}
    assert found == {1000: 1, 1001: 0}


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 0), (5, 1), (None, 1), (6, None), (7, 5), (7, 1), (999, 1)], LABELS)
    for some in (labels, labels.limit(0)):
        trees = quality.train(docs, some)
        scores = [r["score"] for r in quality.score(docs, trees).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
        assert quality.score(empty(spark), trees).count() == 0
        kept = quality.good_documents(docs, trees)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        model, scorer = toxicity.train(docs, some)
        scores = [r["score"] for r in toxicity.score(docs, model, scorer).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
        assert toxicity.score(empty(spark), model, scorer).count() == 0
    assert quality.good_documents(docs, quality.train(docs, labels.limit(0))).count() == docs.count()
    model, scorer = toxicity.train(empty(spark), labels)
    assert toxicity.score(docs, model, scorer).where("predicted = 1").count() == 0


def test_toxicity_held_out_by_language(spark):
    """On the largest tables: nine in ten toxic texts are found, and hardly a clean one is taken."""
    largest = DIRECTORY.replace("sf0.001", "sf0.1")
    docs, labels = (pd.read_parquet(f"{largest}/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.op9_toxicity(spark, largest).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id").merge(labels, on="doc_id")
    held = rows[rows.held_out]
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert len(toxic) == 97 and toxic.predicted.sum() >= 88 and clean.predicted.mean() <= 0.005
    by_lang = toxic.groupby("lang").predicted.mean()
    assert (by_lang >= 0.8).all()


DISGUISES = {
    "blanks": " ".join, "two blanks": "  ".join, "tabs": "\t".join, "lines": "\n".join, "slashes": "/".join,
    "tildes": "~".join, "dots": ".".join, "no-break spaces": "\u00a0".join, "invisible": "\u200b".join,
    "capitals": str.upper, "look-alike signs": lambda w: w.translate(str.maketrans("aeios", "43105")),
    "one letter stretched": lambda w: w[:2] + w[1] * 3 + w[2:], "all letters stretched": lambda w: "".join(c * 4 for c in w),
    "full width": lambda w: "".join(chr(ord(c) + 0xFEE0) for c in w),
    "accents": lambda w: w.translate(str.maketrans("aiou", "\u00e1\u00ef\u00f6\u00fc")),
    "look-alike letters": lambda w: w.translate(str.maketrans("aeopc", "\u0430\u0435\u043e\u0440\u0441")),
}


@pytest.fixture(scope="module")
def letters(spark):
    return toxicity.letter_model(spark.read.parquet(f"{LARGER}/documents.parquet"))


@pytest.mark.parametrize("disguise", DISGUISES)
def test_disguised_words_are_restored(letters, disguise):
    words = "idiot moron stupid loser trash scum pathetic worthless disgusting".split()
    restorer = toxicity.Restorer(letters)
    found = sum(w in restorer.words(f"Thin the onlewh {DISGUISES[disguise](w)} and thre reat.") for w in words)
    assert found >= 8


def test_units_are_words_and_their_beginnings():
    units = toxicity.Units({"trash": 1, "bomen*": 2, "tra*": 3})
    assert list(toxicity.stems("bomenteja")) == ["bom*", "bome*", "bomen*", "boment*", "bomente*"]
    assert list(toxicity.stems("abc")) == []
    assert units.held({"trash": 2, "bomenteja": 1, "bomenta": 3, "tra": 1}) == {"trash": 2, "tra*": 2, "bomen*": 4}
    assert toxicity.Units({}).held({"trash": 1}) == {}


def test_one_id_in_many_rows_is_learned_from_once(spark):
    repeated = [(1, f"text number {i} scum") for i in range(500)] + [(i, f"plain words {i}") for i in range(2, 40)]
    docs = spark.createDataFrame(repeated, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)], LABELS)
    model, scorer = toxicity.train(docs, labels)
    again = toxicity.train(docs.where("doc_id > 1 or text = 'text number 0 scum'"), labels)[1]
    assert scorer.weights == again.weights and (scorer.scale == again.scale).all()


def test_quality_learns_from_one_row_of_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(7, f"text {i} of many rows") for i in range(50_000)] + [(8, "other"), (9, None)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (9, 0), (10, 1)], LABELS)
    seen, grow = [], quality.grow
    monkeypatch.setattr(quality, "grow", lambda x, y: seen.append((x.shape, sorted(y))) or grow(x, y))
    quality.train(docs, labels)
    assert seen == [((3, len(quality.FEATURES)), [0.0, 0.0, 1.0])]
