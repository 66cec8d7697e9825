"""Language identification by interpolated Kneser-Ney character models.

Counts come from all training documents. Texts become lower-case letters with one
space between words; a gram is ``ORDER`` characters. For every gram seen in any language
the model has the log probability of its last character in each language, and for
every context the weight of what lies below; both are looked up in sorted arrays of
64-bit hashes, one for each gram: a gram is four characters of 16 bits, and its hash mixes them without loss. A table holds
``MOST_VALUES`` numbers at most, whatever the number of languages. Beyond that the rarest grams stay in the written tables, and
the characters of a text that need them are looked up there by joins, so that every score is that of the whole model.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardbook.llm.common import by_batch, settle
from wardbook.llm.words import mix

ORDER = 4
MOST_VALUES = 1 << 22  # of one table, grams times languages: 16 MB
SCORED_AT_ONCE = 1 << 22  # numbers, characters times languages
SPACE = 0x20
PIECE = 1 << 19  # characters worked on at once; a longer text is cut at these places
COMBINED = 1 << 20  # distinct grams of a language that a task combines before it hands them on
REJECTED_SHARE = 0.001  # of the texts of a language
LEFT_OUT = 4  # one in so many training texts sets the limits; the model that scores it has not counted it
TAIL = 0.1  # share of the left-out texts of a language whose excess tells how fast its tail falls
LEAST_TAIL = 5  # texts in the tail, below which a language has no limit
LIMIT_STEP = 0.001  # width of a bin of cross-entropies

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point -> lower-case letter in 16 bits, a space for all else.

    Letters beyond 16 bits are folded into the private use area, which has no letters.
    """
    if not _letters:
        table = np.full(sys.maxunicode + 1, SPACE, np.uint16)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                code = ord(low) if len(low) == 1 else i
                table[i] = code if code < 0x10000 else 0xE000 + code % 0x1900
        _letters.append(table)
    return _letters[0]


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each after ORDER - 1 spaces, and for each the text it is of (-1: such a space).

    Runs of other characters than letters are one space, leading ones none. A text with letters ends in a space.
    """
    joined = "\n".join([*texts, ""])
    codes = _letter_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    before = np.concatenate([[SPACE], codes[:-1]])
    new = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
    keep = (codes != SPACE) | ((before != SPACE) & ~new)
    codes, text = codes[keep], text[keep]
    pad = ORDER - 1
    at = np.arange(len(codes)) + pad * (text + 1)
    chars = np.full(len(codes) + pad * (len(texts) + 1), SPACE, np.uint64)
    owner = np.full(len(chars), -1)
    chars[at], owner[at] = codes, text
    return chars, owner


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each character of each text, 16 bits a character, and its text."""
    chars, owner = normalise(texts)
    grams = np.zeros(len(chars), np.uint64)
    for i in range(ORDER):
        shift = ORDER - 1 - i
        grams[shift:] |= chars[:len(chars) - shift] << np.uint64(16 * shift)
    real = owner >= 0
    return grams[real], owner[real]


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of texts of bounded length, with their numbers; a long text comes in several pieces."""
    numbers, group, size = [], [], 0
    for i, text in enumerate(texts):
        for a in range(0, len(text or ""), PIECE):
            piece = text[a:a + PIECE]
            if size + len(piece) > PIECE and group:
                yield numbers, group
                numbers, group, size = [], [], 0
            numbers.append(i)
            group.append(piece)
            size += len(piece)
    if group:
        yield numbers, group


def gram_counts(train: DataFrame) -> DataFrame:
    """lang, gram (a long of four 16-bit characters), n: over all texts of ``train`` (text, lang)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out(lang: str) -> pa.RecordBatch:
            grams, n = held.pop(lang)
            return pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(grams), pa.string()), "gram": grams.view("i8"), "n": n})

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for _, group in _pieces(texts):
                    grams, n = np.unique(grams_of(group)[0], return_counts=True)
                    if lang in held:
                        grams = np.concatenate([held[lang][0], grams])
                        n = np.concatenate([held[lang][1], n])
                        grams, place = np.unique(grams, return_inverse=True)
                        n = np.bincount(place, n).astype(np.int64)
                    held[lang] = [grams, n]
                    if len(grams) > COMBINED:
                        yield out(lang)
        for lang in list(held):
            yield out(lang)

    counts = by_batch(train.select("text", "lang"), work, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """By order: sorted hashes of grams with log probabilities per language, and of contexts with log weights.

    ``cut`` tells by order whether either table is short of keys; if any is, ``written`` has all of them: (lang, key, v).
    """

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: np.ndarray
    limits: np.ndarray | None = None
    cut: list[tuple[bool, bool]] | None = None
    written: list[tuple[DataFrame, DataFrame]] | None = None

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """For each gram and language the log probability of its last character after the others."""
        return self._order(grams, ORDER)

    def _order(self, grams: np.ndarray, order: int) -> np.ndarray:
        if not order:
            return np.broadcast_to(self.unseen, (len(grams), len(self.languages)))
        own = suffix(grams, order)
        found, at = _look_up(self.grams[order], own)
        result = self.grams[order][1][at] if len(self.grams[order][0]) else np.zeros(
            (len(grams), len(self.languages)), np.float32)
        rest = np.flatnonzero(~found)
        if len(rest):
            below = self._order(grams[rest], order - 1)
            seen, at = _look_up(self.contexts[order], own[rest] >> np.uint64(16))
            weight = self.contexts[order][1][at] if len(self.contexts[order][0]) else np.zeros_like(below)
            result[rest] = below + np.where(seen[:, None], weight, 0)
        return result


    def is_exact(self, grams: np.ndarray) -> np.ndarray:
        """For each gram whether the tables here are enough, that is, whether no key is missed that may be among those left out."""
        exact = np.ones(len(grams), bool)
        rest = np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            own = suffix(grams[rest], order)
            missed = ~_look_up(self.grams[order], own)[0]
            rest, own = rest[missed], own[missed]
            if self.cut[order][0]:
                exact[rest] = False
                break
            if self.cut[order][1]:
                exact[rest[~_look_up(self.contexts[order], own >> np.uint64(16))[0]]] = False
        return exact


def suffix(grams: np.ndarray, order: int) -> np.ndarray:
    return grams & np.uint64((1 << 16 * order) - 1)


def hashes_of(keys: np.ndarray) -> np.ndarray:
    """One to one."""
    return mix(keys + np.uint64(0x9E3779B97F4A7C15))


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = table[0]
    if not len(hashes):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    wanted = hashes_of(keys)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return hashes[at] == wanted, at


def kneser_ney(counts: DataFrame, languages: list[str], most: int = MOST_VALUES) -> Model:
    """The model from counts of the longest grams; lower orders count distinct characters in front.

    Each order takes off an absolute discount n1 / (n1 + 2 n2) of its own; what that frees goes to the order below, the
    lowest to a uniform distribution. Joins of gram tables in Spark; of each table ``most`` numbers at most come to the driver,
    those of the most frequent grams; the model refers to the written tables for the others.
    """
    spark = counts.sparkSession
    langs = F.explode(F.array(*[F.lit(x) for x in languages])).alias("lang")
    tables = {ORDER: settle(counts, "grams")}
    for order in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << 16 * order) - 1)
        tables[order] = settle(
            tables[order + 1].select("lang", F.col("gram").bitwiseAND(mask).alias("gram")).groupBy("lang", "gram")
            .agg(F.count("*").alias("n")), "grams")
    characters = max(1, tables[1].select("gram").distinct().count())
    unseen = float(np.log(1 / (characters + 1)))
    grams: list = [None]
    contexts: list = [None]
    cut: list = [(False, False)]
    written: list = [None]
    below = None
    for order in range(1, ORDER + 1):
        t = tables[order].withColumn("context", F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long"))
        ones, twos = (F.count(F.when(F.col("n") == k, 1)) for k in (1, 2))
        # Kept within (0, 1) where there are no grams with a count of one, or only such.
        discount = F.broadcast(t.groupBy("lang").agg(
            F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.try_divide(ones, ones + 2 * twos))).alias("d")))
        context = settle(t.join(discount, "lang").groupBy("lang", "context").agg(
            F.sum("n").alias("total"), (F.max("d") * F.count("*") / F.sum("n")).alias("weight")), "contexts")
        seen = t.join(discount, "lang").join(context, ["lang", "context"]).select(
            "lang", "gram", ((F.col("n") - F.least("d", F.col("n"))) / F.col("total")).alias("own"))
        every = t.select("gram", "context").distinct().select("*", langs)
        joined = every.join(seen, ["lang", "gram"], "left").join(
            context.select("lang", "context", "weight"), ["lang", "context"], "left")
        weight = F.coalesce("weight", F.lit(1.0))
        if below is None:
            chance = F.coalesce("own", F.lit(0.0)) + weight * F.lit(float(np.exp(unseen)))
        else:
            mask = F.lit((1 << 16 * (order - 1)) - 1)
            joined = joined.withColumn("shorter", F.col("gram").bitwiseAND(mask)).join(
                below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("q")), ["lang", "shorter"])
            chance = F.coalesce("own", F.lit(0.0)) + weight * F.col("q")
        below = settle(joined.select("lang", "gram", chance.alias("p")), "probabilities")
        often = t.groupBy(F.col("gram").alias("key")).agg(F.sum("n").alias("n"))
        values = below.select("lang", F.col("gram").alias("key"), F.log("p").alias("v"))
        weights = context.select("lang", F.col("context").alias("key"), F.log("weight").alias("v"))
        table, less_grams = _table(values, often, languages, most)
        grams.append(table)
        often = context.groupBy(F.col("context").alias("key")).agg(F.sum("total").alias("n"))
        table, less_contexts = _table(weights, often, languages, most)
        contexts.append(table)
        cut.append((less_grams, less_contexts))
        written.append((values, weights))
    some = any(any(pair) for pair in cut)
    return Model(languages, grams, contexts, np.full(len(languages), unseen, np.float32),
                 cut=cut if some else None, written=written if some else None)


def _table(values: DataFrame, often: DataFrame, languages: list[str],
           most: int) -> tuple[tuple[np.ndarray, np.ndarray], bool]:
    """Sorted hashes of keys and per language their value, 0 without one, of ``values`` (lang, key, v); whether keys are left out.

    At most ``most`` values: if there are more keys, only those that are counted (``often``: key, n) above a limit, which
    comes from the numbers of keys in eighths of powers of two.
    """
    kept, step = most // len(languages), F.floor(8 * F.log2("n"))
    steps = often.groupBy(step.alias("step")).agg(F.count("*").alias("keys")).orderBy(F.desc("step")).collect()
    least, keys = None, 0
    for row in steps:
        keys += row["keys"]
        if keys > kept:
            break
        least = row["step"]
    if keys > kept:
        frequent = often.where(step >= least) if least is not None else often.limit(0)
        values = values.join(frequent.select("key"), "key", "left_semi")
    rows = values.select("lang", "key", "v").toArrow()
    found, at = np.unique(hashes_of(rows["key"].to_numpy().view("u8")), return_inverse=True)
    matrix = np.zeros((len(found), len(languages)), np.float32)
    number = {x: i for i, x in enumerate(languages)}
    matrix[at, [number[x] for x in rows["lang"].to_pylist()]] = rows["v"].to_numpy()
    return (found, matrix), keys > kept


def cross_entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its number of scored characters, and per language the mean negative log probability.

    From the tables of ``model`` alone: grams left out of them are left to the order below. :func:`identify` looks those up.
    """
    n, total = _sums(model, texts)
    return n, total / np.maximum(n, 1)[:, None]


def _sums(model: Model, texts: list[str | None], left: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each text its number of scored characters, and per language the sum of negative log probabilities.

    With ``left``, grams that the tables are not enough for are not summed; (text, gram) of each of them is added to it.
    """
    total = np.zeros((len(texts), len(model.languages)))
    n = np.zeros(len(texts), np.int64)
    for numbers, group in _pieces(texts):
        grams, owner = grams_of(group)
        if not len(grams):
            continue
        step = max(1, SCORED_AT_ONCE // max(1, len(model.languages)))
        for a in range(0, len(grams), step):
            lp, of = model.log_probabilities(grams[a:a + step]), owner[a:a + step]
            if left is not None:
                open_ = ~model.is_exact(grams[a:a + step])
                lp[open_] = 0
                left.append((np.array(numbers)[of[open_]], grams[a:a + step][open_]))
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            sums = np.add.reduceat(lp, starts, axis=0, dtype=np.float64)
            places = np.array(numbers)[of[starts]]
            np.subtract.at(total, places, sums)
            np.add.at(n, places, np.diff(np.append(starts, len(of))))
    return n, total


def _values(model: Model, wanted: DataFrame) -> DataFrame:
    """gram, lang, v: the log probabilities of ``wanted`` (gram, distinct) in each language, from the written tables.

    By order from the longest: a gram that is found has its value, the others add the weight of their context and go on.
    """
    wanted = settle(wanted, "open")
    parts = []
    for order in range(ORDER, 0, -1):
        values, weights = model.written[order]
        own = F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1)) if order < ORDER else F.col("gram")
        found = settle(wanted.select("gram", own.alias("key")).join(values, "key").select("gram", "lang", "v"), "found")
        wanted = settle(wanted.join(found.select("gram").distinct(), "gram", "left_anti"), "open")
        context = F.shiftrightunsigned(own, 16) if order > 1 else F.lit(0).cast("long")
        parts += [found, wanted.select("gram", context.alias("key")).join(weights, "key").select("gram", "lang", "v")]
    langs = F.explode(F.array(*[F.lit(x) for x in model.languages])).alias("lang")
    result = wanted.select("gram", langs, F.lit(float(model.unseen[0])).alias("v"))
    for part in parts:
        result = result.unionByName(part)
    return settle(result.groupBy("gram", "lang").agg(F.sum("v").alias("v")), "values")


def _summed(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, n and ``sums`` per language of every row, where tables are cut: what they lack comes by joins."""
    box = docs.sparkSession.sparkContext.broadcast(replace(model, written=None))
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left: list = []
            n, total = _sums(box.value, batch.column("text").to_pylist(), left)
            text, gram = (np.concatenate(x) for x in zip(*left)) if left else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            order = np.lexsort((gram, text))
            text, gram = text[order], gram[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
            starts = np.flatnonzero(new)
            times = np.diff(np.append(starts, len(text)))
            of_text = np.searchsorted(text[starts], np.arange(len(n) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in keep}, "n": pa.array(n), "sums": pa.array(list(total), pa.list_(pa.float64())),
                "rest": pa.ListArray.from_arrays(of_text, pa.StructArray.from_arrays(
                    [pa.array(gram[starts].view("i8")), pa.array(times)], ["gram", "times"]))})

    # Written, so that the numbers of rows stay.
    rows = settle(by_batch(docs.select(*keep, "text"), work,
                           f"{kinds}, n long, sums array<double>, rest array<struct<gram: long, times: long>>")
                  .withColumn("row", F.monotonically_increasing_id()), "rows")
    rest = rows.select("row", F.explode("rest").alias("r")).select("row", "r.gram", "r.times")
    values = _values(model, rest.select("gram").distinct())
    number = F.map_from_arrays(F.array(*[F.lit(x) for x in model.languages]),
                               F.array(*[F.lit(i) for i in range(len(model.languages))]))
    added = (rest.join(values, "gram").groupBy("row", "lang").agg(F.sum(F.col("times") * F.col("v")).alias("v"))
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(number[F.col("lang")].alias("i"), "v"))).alias("a")))
    # A gram has a value in every language, and so has a row with grams.
    joined = rows.join(added.select("row", F.col("a.v").alias("added")), "row", "left")
    return joined.select(*keep, "n", F.when(F.col("added").isNull(), F.col("sums")).otherwise(
        F.zip_with("sums", "added", lambda total, v: total - v)).alias("sums"))


def _scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with lang_pred, score, cross_entropy, rejected of every row."""
    box = docs.sparkSession.sparkContext.broadcast(replace(model, written=None))
    cut = model.cut is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = box.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            if cut:
                n = batch.column("n").to_numpy()
                entropy = batch.column("sums").flatten().to_numpy().reshape(len(n), -1) / np.maximum(n, 1)[:, None]
            else:
                n, entropy = cross_entropies(m, batch.column("text").to_pylist())
            some = n > 0
            best = np.where(some, entropy.argmin(axis=1) if m.languages else 0, len(m.languages)) if len(
                m.languages) else np.zeros(len(n), int)
            least = entropy.min(axis=1) if m.languages else np.zeros(len(n))
            # A text counts as 20 independent characters at most.
            odds = np.exp(-np.minimum(n, 20)[:, None] * (entropy - least[:, None])).sum(axis=1)
            score = np.where(some & (odds > 0), 1 / np.maximum(odds, 1), 0.0)
            limit = np.append(m.limits, np.inf)[best] if m.limits is not None else np.full(len(n), np.inf)
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in keep}, "lang_pred": pa.array(names[best], pa.string()),
                "score": pa.array(score), "cross_entropy": pa.array(np.where(some, least, 0.0)),
                "rejected": pa.array(~some | (least > limit))})

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return by_batch(_summed(docs, model, keep) if cut else docs.select(*keep, "text"), work,
                    f"{kinds}, lang_pred string, score double, cross_entropy double, rejected boolean")


def train(docs: DataFrame) -> Model:
    """A model from all rows of ``docs`` (doc_id, text, lang) with text and lang.

    A text is rejected where its best language finds it stranger than a thousandth of that language's texts are to be.
    The limits come from a quarter of the training texts, chosen by a hash of the text so that copies stay together, under a
    model of the other three; the model that is returned counts all of them. Any number of languages is learned; what
    crosses the driver is their names, a limit each, and MOST_VALUES numbers a table.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        none = [(np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))] * (ORDER + 1)
        return Model([], none, none, np.zeros(0, np.float32))
    left_out = F.pmod(F.xxhash64("text"), F.lit(LEFT_OUT)) == 0
    counted = settle(gram_counts(known.where(~left_out)), "grams")
    judge = kneser_ney(counted, languages)
    both = counted.unionByName(gram_counts(known.where(left_out)))
    model = kneser_ney(both.groupBy("lang", "gram").agg(F.sum("n").alias("n")), languages)
    limits = tail_limits(_scored(known.where(left_out), judge, ["lang"]).where("lang = lang_pred"))
    # Without enough texts for a limit: what is stranger than letters drawn blindly.
    model.limits = np.array([limits.get(x, -float(u)) for x, u in zip(languages, model.unseen)])
    return model


def tail_limits(scored: DataFrame) -> dict[str, float]:
    """lang -> the cross-entropy that REJECTED_SHARE of its texts exceed, from ``scored`` (lang, cross_entropy).

    Beyond the quantile of TAIL the cross-entropies are taken to fall off exponentially, with the mean excess that is seen;
    so a language needs no thousands of texts for its limit. A limit is not below the quantile of the texts themselves, the
    bin's largest value, should their tail be longer than that. Languages with fewer than LEAST_TAIL texts in the tail
    have none. Texts are counted by bins, so that a language of any size is a bounded number of rows.
    """
    binned = scored.groupBy("lang", F.floor(F.col("cross_entropy") / LIMIT_STEP).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("cross_entropy").alias("sum"), F.max("cross_entropy").alias("most"))
    of_lang = Window.partitionBy("lang")
    upto = binned.withColumns({
        "upto": F.sum("n").over(of_lang.orderBy("bin")), "total": F.sum("n").over(of_lang)})

    def reached(share: float) -> Column:
        return F.min(F.when(F.col("upto") >= (1 - share) * F.col("total"), F.col("most")))

    quantiles = upto.groupBy("lang").agg(
        reached(TAIL).alias("start"), reached(REJECTED_SHARE).alias("quantile"), F.max("total").alias("total"))
    tail = binned.join(quantiles, "lang").where(F.col("most") > F.col("start")).groupBy("lang").agg(
        F.max("start").alias("start"), F.max("quantile").alias("quantile"), F.max("total").alias("total"),
        F.sum("n").alias("n"), F.sum(F.col("sum") - F.col("n") * F.col("start")).alias("excess"))
    # One standard error above the mean excess: a rare language rejects rather too little.
    reach = F.col("excess") / F.col("n") * (1 + 1 / F.sqrt("n")) * F.log(F.col("n") / F.col("total") / REJECTED_SHARE)
    rows = tail.where(F.col("n") >= LEAST_TAIL).select(
        "lang", F.greatest(F.col("start") + reach, "quantile").alias("limit")).collect()
    return {r["lang"]: r["limit"] for r in rows}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected of every row.

    lang_pred is the language with the lowest cross-entropy per character, ``und``
    for a text that is null or has no letter, or if no language was learned. score is the share of the
    best language's likelihood, 0 for ``und``. Rows are independent; other columns are not looked at.
    """
    return _scored(docs, model, ["doc_id"])
