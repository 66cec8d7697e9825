"""Personal data: base patterns, and identifiers that contexts learned from them discover.

What the base patterns find are seed entities. The words around them are lexical patterns, a bipartite graph
with everything in the corpus that looks like an identifier. Rounds of Spark joins give patterns the
share of their instances that is believed, and instances the belief of their patterns;
instances of patterns that are nearly always of one kind are added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.common import by_batch, row_key, settle, text_hash, texts_of

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SEEDS = 5  # distinct seed entities of a kind that a pattern needs
LEAST_SHARE = 0.9  # of a pattern's distinct words that are believed to be of its kind
UNKNOWN = 0.5  # what a word counts for in a share that may be of the kind and is no seed
CONTEXT_CHARS = 24  # of a word of a pattern

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_BREAK = re.compile(r"[\s<>\"'()\[\]{}|,;]")
_TRAILING = ".:!?%*$&#="
# Tokens of digits, + ( ) . and - with single blanks between them, each up to a break or what may trail it; a full
# stop before a blank ends the run.
_TOKEN = r"[0-9+().-]++(?=[:!?%*$&#=]*+(?:[\s<>\"'\[\]{}|,;]|$))"
_GROUPED = re.compile(rf"(?<![^\s<>\"'\[\]{{}}|,;:=]){_TOKEN}(?:(?<!\.) {_TOKEN})*+")
LONGEST_KEY = 200  # characters of a word; longer ones are told apart by their hashes


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every at sign with a domain after it and, back to the last match, something before it.

    Same as matching from the left, as no at sign is in a local part, but linear in long words.
    """
    end = place = 0
    while (found := text.find("@", place)) >= 0:
        place = found + 1
        domain = _DOMAIN.match(text, found)
        start = found
        if domain:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
        if start < found:
            end = place = domain.end()
            yield start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end): leftmost non-overlapping matches per kind; those that fail their check are dropped."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(m.group().count, "0123456789")) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def identifiers(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Words with a digit or an at sign that touch none of the spans ``taken``."""
    spans = sorted((a, b) for _, a, b in taken)
    i = place = 0
    while (mark := _MARK.search(text, place)) is not None:
        start = mark.start()
        while start > place and not _BREAK.match(text, start - 1):
            start -= 1
        stop = _BREAK.search(text, mark.end())
        place = end = stop.start() if stop else len(text)
        while end > start and text[end - 1] in _TRAILING:
            end -= 1
        while i < len(spans) and spans[i][1] <= start:
            i += 1
        if not (i < len(spans) and spans[i][0] < end):
            yield start, end


def grouped(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Maximal runs of number tokens with single blanks or brackets, outside the spans ``taken``."""
    place = 0
    for start, end in [*sorted((a, b) for _, a, b in taken), (len(text), len(text))]:
        for m in _GROUPED.finditer(text, place, max(place, start)):
            a, b = m.span()
            if b == start < len(text):
                b = text.rfind(" ", a, b)  # the last token runs on into the span
            while a < b and not text[a].isdigit() and text[a] not in "+(":
                a += 1
            while b > a and not text[b - 1].isdigit():
                b -= 1
            if text[a:a + 1] == "(" and ")" not in text[a:b]:
                a += 1
            if " " in text[a:b] or "(" in text[a:b]:
                yield a, b
        place = max(place, end)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, bool, list[int]]]:
    """(start, end, run, whole, kinds): runs that may be a phone or card, and plain words.

    run is where the run starts that a word stands in, or the word itself. Words of a run that are of no kind on
    their own are parts of it and no candidates.
    """
    runs = [(a, b, kinds) for a, b in grouped(text, taken) if (kinds := [k for k in kinds_of(text[a:b]) if k >= 2])]
    for a, b, kinds in runs:
        yield a, b, a, True, kinds
    i = 0
    for a, b in identifiers(text, taken):
        while i < len(runs) and runs[i][1] <= a:
            i += 1
        kinds = kinds_of(text[a:b])
        if i < len(runs) and runs[i][0] < b:
            if kinds and (a, b) != runs[i][:2]:
                yield a, b, runs[i][0], False, kinds
        else:
            yield a, b, a, False, kinds


def _key(word: str) -> str:
    return word if len(word) <= LONGEST_KEY else hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


def kinds_of(word: str) -> list[int]:
    """What an identifier may be by its characters."""
    if "@" in word:
        return [0]
    digits = sum(map(word.count, "0123456789"))
    letters = sum(map(str.isalpha, word))
    kinds = []
    if letters == 0 and word.count(".") + word.count(":") >= 2 and digits >= 4:
        kinds.append(1)
    if letters == 0 and 12 <= digits <= 19:
        kinds.append(2)
    if letters == 0 and 7 <= digits <= 15:
        kinds.append(3)
    return kinds


def contexts(text: str, start: int, end: int) -> list[str]:
    """The two words before, and the word before with the word after."""
    line = text.rfind("\n", max(0, start - 200), start) + 1
    before = ["^", "^", *text[max(line, start - 200):start].split()]
    after = [*text[end:end + 100].split("\n", 1)[0].split(), "$"]
    a, b, c = (re.sub("[0-9]", "0", w.lower())[-CONTEXT_CHARS:] for w in (before[-2], before[-1], after[0]))
    return [f"{a} {b} _", f"{b} _ {c}"]


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_OCCURRENCE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.int32()), ("word", pa.string()),
                         ("run", pa.int32()), ("whole", pa.bool_()),
                         ("kinds", pa.list_(pa.int32())), ("patterns", pa.list_(pa.string()))])


def _scan(docs: DataFrame) -> DataFrame:
    """Every row's base spans, and its seeds and other identifiers with their contexts. seed is -1 for the others."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, seen = [], []
            for text in texts_of(batch):
                base = base_spans(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                seeds = [(k, a, b, a, False, [k]) for k, a, b in base]
                others = [(-1, *c) for c in candidates(text, base)]
                seen.append([
                    {"start": a, "end": b, "seed": k, "word": _key(text[a:b]), "run": run, "whole": whole,
                     "kinds": kinds, "patterns": contexts(text, a, b)}
                    for k, a, b, run, whole, kinds in [*seeds, *others]])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                "base": pa.array(spans, pa.list_(_SPAN)), "seen": pa.array(seen, pa.list_(_OCCURRENCE))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(
        docs.select("doc_id", "text", text_hash().alias("text_hash")), work,
        f"doc_id {kind}, text_hash long, base array<struct<kind: int, start: int, end: int>>, seen array<struct<"
        "start: int, end: int, seed: int, word: string, run: int, whole: boolean, kinds: array<int>, "
        "patterns: array<string>>>")


def trusted_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind) of high confidence from ``edges`` (pattern, word, seed, kinds), one per distinct pair.

    A round gives each pattern the share of its distinct words that is believed to be of a
    kind, and each word that is no seed the belief of the patterns it occurs in, as if
    they were independent. Seeds are believed from the start, and only in their kind; words that
    may be of the kind by their characters, but are no seeds, count UNKNOWN in the share.
    """
    counts = [F.sum((F.col("seed") == k).cast("int")).alias(f"s{k}") for k in range(len(KINDS))]
    maybe = [F.sum(((F.col("seed") < 0) & F.array_contains("kinds", k)).cast("int")).alias(f"m{k}")
             for k in range(len(KINDS))]
    # Patterns without enough seeds are never trusted and give no belief.
    of_kinds = F.explode(F.array(*[F.struct(
        F.lit(k).alias("kind"), F.col(f"s{k}").alias("seeds"),
        (F.col("words") - (1 - UNKNOWN) * F.col(f"m{k}")).alias("weight")) for k in range(len(KINDS))])).alias("k")
    scored = settle(
        edges.groupBy("pattern").agg(F.count("*").alias("words"), *counts, *maybe).select("pattern", of_kinds)
        .select("pattern", "k.*", F.lit(0.0).alias("believed")).where(F.col("seeds") >= LEAST_SEEDS), "patterns")
    share = (F.col("seeds") + UNKNOWN * F.col("believed")) / F.col("weight")
    unknown = settle(edges.where("seed < 0").join(
        scored.select("pattern").distinct(), "pattern", "left_semi").select("pattern", "word", "kinds"), "pattern_words")
    for _ in range(rounds):
        beliefs = unknown.join(scored.select("pattern", "kind", share.alias("share")), "pattern").where(
            F.array_contains("kinds", F.col("kind")) & (F.col("share") >= LEAST_SHARE))
        beliefs = settle(beliefs.groupBy("word", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("share")))))).alias("belief")), "beliefs")
        gained = unknown.join(beliefs, "word").groupBy("pattern", "kind").agg(F.sum("belief").alias("gained"))
        scored = settle(scored.join(gained, ["pattern", "kind"], "left").select(
            "pattern", "kind", "seeds", "weight", F.coalesce("gained", F.lit(0.0)).alias("believed")), "patterns")
    return scored.where(share >= LEAST_SHARE).select("pattern", "kind")


def _is_kind(kind: int):
    return lambda span: span["kind"] == kind


def find_identifiers(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row.

    The counts and base_sha256 are of the base spans; spans has all of them as kind:start:end, by kind
    and start. Null and empty texts have none. Contexts are counted by distinct
    words, so that copies of a document teach nothing new. Repeated rows have equal
    results; other columns are not looked at.
    """
    rows = settle(_scan(docs), "identifiers")
    rows = rows.withColumns(row_key(rows, F.col("text_hash")))
    keys = rows.columns[-3:]
    seen = rows.select(*keys, F.explode("seen").alias("o")).select(
        *keys, "o.start", "o.end", "o.seed", "o.word", "o.run", "o.whole", "o.kinds", F.explode("o.patterns").alias("pattern"))
    edges = seen.where(F.size("kinds") > 0).groupBy("pattern", "word").agg(
        F.max("seed").alias("seed"), F.max("kinds").alias("kinds"))
    # What looks like no kind counts against a pattern too.
    others = seen.where(F.size("kinds") == 0).groupBy("pattern", "word").agg(
        F.max("seed").alias("seed"), F.max("kinds").alias("kinds"))
    trusted = settle(trusted_patterns(settle(edges.unionByName(others), "edges"), rounds), "trusted")
    # Where a run is added as a whole, its words are not.
    added = (
        seen.where("seed < 0").join(trusted, "pattern").where(F.array_contains("kinds", F.col("kind")))
        .groupBy(*keys, "run", "start", "end").agg(F.min("kind").alias("kind"), F.max("whole").alias("whole"))
        .groupBy(*keys, "run").agg(
            F.collect_list(F.struct("kind", "start", "end")).alias("words"),
            F.collect_list(F.when(F.col("whole"), F.struct("kind", "start", "end"))).alias("runs"))
        .groupBy(*keys).agg(F.flatten(F.collect_list(
            F.when(F.size("runs") > 0, F.col("runs")).otherwise(F.col("words")))).alias("added")))
    names = F.array(*[F.lit(k) for k in KINDS])

    def told(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    none = F.array().cast("array<struct<kind: int, start: int, end: int>>")
    more = F.coalesce("added", none)
    return rows.join(added, keys, "left").select(
        "doc_id",
        *[F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        told(F.concat("base", more)).alias("spans"), F.size(more).cast("long").alias("n_added"))
