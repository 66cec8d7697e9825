"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Words with look-alike characters, repeated letters or spaced-out letters are
lattices of what they may stand for. A Viterbi search finds the likeliest letters under a character
model of the corpus; weights of words and of beginnings of words, and a logistic scale, learned from labelled rows, score
the result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.common import by_batch, settle, text_or_empty, texts_of
from wardbook.llm.langid import _pieces

LABELLED_ROWS = 20_000
EXPLAINED = 0.3  # what a text counts for after another word that it holds was chosen
LEAST_GAIN = 20.0  # of the likelihood ratio statistic, for a word to enter the lexicon
CACHED_TOKENS = 200_000  # per generation and worker
LONGEST_TOKEN = 64  # characters of a token whose reading is kept; longer ones are read anew each time
PIECE_OF_READING = 256  # letters of a path that are copied with each step of the search
UNSPACED_GRAMS = (2, 3, 4)  # characters of what counts as words in scripts without blanks
STEM_LETTERS = (3, 7)  # of the beginnings of longer words that are weighed beside whole words
STEM = "*"  # ends a beginning; no word holds it

# Fixed: what a character is read as besides itself.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
# Fixed: letters of other scripts that look like Latin ones.
LOOK_ALIKE_LETTERS = str.maketrans(
    "\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u043a\u043c\u0442\u0432\u043d"
    "\u03b1\u03bf\u03bd\u03c1\u03c4\u03b9\u03ba\u03b5\u03c5",
    "aeopcyxijskmtbh" "aovptikeu")
SEPARATORS = ".-_*/~"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
# Letters a-z are 1 to 26, other letters 27, all else the border 0.
CODES = 28

VOWELS = "aeiou"  # what an asterisk hides more often than other letters
LOG_MASKED, LOG_MASKED_CONSONANT = math.log(0.1), math.log(0.02)
LOG_SUBSTITUTED, LOG_KEPT = math.log(0.5), math.log(0.6)
# A letter may well stand twice; a longer repetition is a stretched word.
LOG_DROPPED, LOG_DROPPED_SECOND = math.log(0.3), math.log(0.02)

_PLAIN = re.compile(r"[^\W\d_]+")
_LEAD = re.compile(r"[\W_]*")
_LAST = re.compile(r"[^\W_]")
# Scripts written without blanks: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile(
    "[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
_REPEATED = re.compile(r"(.)\1\1")
_BETWEEN = r"[\s" + re.escape(SEPARATORS) + "]"
_SPACED = re.compile(rf"(?<!\S)\w(?:{_BETWEEN}{{1,4}}[^\s{re.escape(SEPARATORS)}]){{2,}}(?![^\W_])")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_LATIN = re.compile("[a-z]")


def letter_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.zeros(len(points), np.int64)
    ascii_letter = (points >= 0x61) & (points <= 0x7A)
    codes[ascii_letter] = points[ascii_letter] - 0x60
    other = np.flatnonzero(points >= 0x80)
    if len(other):
        kinds, at = np.unique(points[other], return_inverse=True)
        codes[other] = np.array([27 * chr(p).isalpha() for p in kinds.tolist()])[at]
    return codes


def trigram_counts(docs: DataFrame) -> DataFrame:
    """cell, n: letter trigrams of all texts; a cell is three codes in base CODES, 21,952 at most."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(CODES ** 3, np.int64)
            for _, group in _pieces(batch.column("text").to_pylist()):
                codes = letter_codes("  " + "  ".join(group) + " ")
                cells = (codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:]
                total += np.bincount(cells, minlength=CODES ** 3)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"cell": some, "n": total[some]})

    counts = by_batch(docs.where("text is not null").select("text"), work, "cell long, n long")
    return counts.groupBy("cell").agg(F.sum("n").alias("n"))


def letter_model(docs: DataFrame) -> np.ndarray:
    """log P(letter | the two before), interpolated with bigrams and letters, over the whole corpus."""
    table = trigram_counts(docs).toArrow()
    counts = np.zeros(CODES ** 3)
    counts[table["cell"].to_numpy()] = table["n"].to_numpy()
    counts = counts.reshape(CODES, CODES, CODES)
    chance = np.full(CODES, 1 / CODES)
    for c in (counts.sum(axis=(0, 1)), counts.sum(axis=0), counts):
        total, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
        chance = (c + kinds * chance) / np.maximum(total + kinds, 1) + (total == 0) * chance
    return np.log(chance)


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each character what it may stand for, "" for nothing, with log probabilities of the channel."""
    for i, c in enumerate(token):
        if "a" <= c <= "z":
            options = [(c, LOG_KEPT)]
        elif c in LOOK_ALIKES:
            options = [(x, LOG_SUBSTITUTED) for x in LOOK_ALIKES[c]]
        elif c in SEPARATORS:
            options = [("", LOG_DROPPED)]
            if c == "*":
                options += [(x, LOG_MASKED if x in VOWELS else LOG_MASKED_CONSONANT) for x in ALPHABET]
        else:
            options = [(c, LOG_KEPT)]
        if i and token[i - 1] == c:
            stretched = c * 3 in token[max(0, i - 2):i + 2]
            options.append(("", LOG_DROPPED if stretched else LOG_DROPPED_SECOND))
        yield options


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def decode(token: str, model: np.ndarray, borders: bool = False) -> str:
    """The likeliest reading of a token: Viterbi over the last two letters, linear in the length.

    With ``borders`` a blank may stand before every letter where the model finds a border likelier than none.
    """
    paths: dict = {(0, 0): (0.0, None, "")}  # score, pieces of the reading before, the rest of it
    for options in lattice(token):
        after: dict = {}
        for (a, b), (score, before, text) in paths.items():
            if len(text) > PIECE_OF_READING:
                before, text = (before, text), ""
            for letter, channel in options:
                if letter:
                    c = _code(letter)
                    steps = [((b, c), score + channel + model[a, b, c], letter)]
                    if borders and b:
                        steps.append(((0, c), score + channel + model[a, b, 0] + model[b, 0, c], " " + letter))
                else:
                    steps = [((a, b), score + channel, "")]
                for state, reached, more in steps:
                    if state not in after or reached > after[state][0]:
                        after[state] = (reached, before, text + more)
        paths = after
    ends = [(score + model[a, b, 0], before, text) for (a, b), (score, before, text) in paths.items()]
    best = max(end[0] for end in ends)
    return max(_reading(before, text) for score, before, text in ends if score == best)


def _reading(before: tuple | None, text: str) -> str:
    pieces = [text]
    while before:
        before, piece = before
        pieces.append(piece)
    return "".join(reversed(pieces))


def _core(token: str) -> tuple[str, str]:
    """What stands before the first letter or digit of a token, and from there to the last one."""
    start = end = _LEAD.match(token).end()
    for end in range(len(token), start, -1):
        if _LAST.match(token, end - 1):
            break
    return token[:start], token[start:end]


def folded(text: str) -> str:
    """Lower case, with characters of compatibility (full-width, styled) as the plain ones and without invisible ones."""
    if text.isascii():
        return text.lower()
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()


def _words(text: str) -> Iterator[str]:
    """Runs of letters, with accents also without them; where they are of a script without blanks, also what stands in
    them."""
    for word in _PLAIN.findall(text):
        yield word
        if not word.isascii() and _LATIN.search(word):
            plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
            if plain != word:
                yield plain
        for run in _UNSPACED.findall(word):
            for n in UNSPACED_GRAMS:
                yield from (g for i in range(len(run) - n + 1) if (g := run[i:i + n]) != word)


class Restorer(dict):
    """Token -> the words it restores to, with recent ones kept in two generations."""

    def __init__(self, model: np.ndarray):
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, token: str) -> tuple[str, ...]:
        words = self.old.get(token)
        if words is None:
            words = self.read(token)
            if len(token) > LONGEST_TOKEN:
                return words
        if len(self) >= CACHED_TOKENS:
            self.old = dict(self)
            self.clear()
        self[token] = words
        return words

    def read(self, token: str) -> tuple[str, ...]:
        if token.isascii() and token.isalpha() and not _REPEATED.search(token):
            return (token,)
        if not token.isascii() and _LATIN.search(token):
            token = token.translate(LOOK_ALIKE_LETTERS)
        lead, core = _core(token)
        if len(lead) == 1 and lead in LOOK_ALIKES:
            core = lead + core
        if _PLAIN.fullmatch(core) and not _REPEATED.search(core):
            return tuple(_words(core))
        letters = sum(c.isalpha() for c in core)
        if not letters or not any(c in LOOK_ALIKES or c in SEPARATORS for c in core) and not _REPEATED.search(core):
            return tuple(_words(core))
        # What a separator joins are words of their own, unless they are single letters.
        parts = re.split(f"[{re.escape(SEPARATORS)}]+", core)
        if len(parts) > 1 and max(map(len, parts)) > 1:
            # Or else letters of one word, with something put in between; of several words, if it is long.
            whole = decode(core, self.model, borders=len(core) > LONGEST_TOKEN)
            return (*(w for p in parts if p for w in self.read(p)), *_words(whole))
        if len(parts) > 1:
            return (*_words(decode(core, self.model)), *self.several(core)) or (core,)
        return tuple(_words(decode(core, self.model))) or (core,)

    def several(self, letters: str) -> tuple[str, ...]:
        """The words that the letter model finds in a spelled-out run, if they are more than one."""
        read = decode(letters, self.model, borders=True)
        return tuple(_words(read)) if " " in read else ()

    def words(self, text: str) -> Counter:
        """Restored words of a text with their numbers."""
        lower = folded(text)
        found: Counter = Counter()
        get, single, parted = found.get, 0, False
        for token, n in Counter(lower.split()).items():
            for word in self[token]:
                found[word] = get(word, 0) + n
            if len(token) == 1:
                single += n
            elif token[1] in SEPARATORS and len(token) > 4:
                parted = True
        if single >= 3 or parted:
            for match in _SPACED.finditer(lower):
                if len(match.group().split()) == 1:
                    continue  # a token, which is counted already
                joined = re.sub(_BETWEEN, "", match.group())
                for word in (*self[joined], *self.several(joined)):
                    found[word] += 1
        return found


def stems(word: str) -> Iterator[str]:
    """Beginnings of a longer word, which its other forms share."""
    least, most = STEM_LETTERS
    return (word[:k] + STEM for k in range(least, min(most, len(word) - 1) + 1))


class Units(dict):
    """Words and beginnings of words -> what is kept of them; finds those that a text holds."""

    def __init__(self, kept: dict):
        super().__init__(kept)
        self.heads = {u[:STEM_LETTERS[0]] for u in kept if u.endswith(STEM)}

    def held(self, words: dict[str, int]) -> dict[str, int]:
        few, many = sorted((self, words), key=len)
        found = {w: words[w] for w in few if w in many}
        if self.heads:
            for word, n in words.items():
                if word[:STEM_LETTERS[0]] in self.heads:
                    for stem in stems(word):
                        if stem in self:
                            found[stem] = found.get(stem, 0) + n
        return found


@dataclass
class Scorer:
    """Weights of words and beginnings, and the logistic scale over what a text holds of them."""

    weights: Units = field(default_factory=lambda: Units({}))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def features(self, hits: dict[str, int], total: int) -> list[float]:
        """``hits``: the units that the text holds; ``total``: its words."""
        n = sum(hits.values())
        return [1.0, max((self.weights[w] for w in hits), default=0.0), math.log1p(n), math.log1p(100 * n / max(total, 1))]

    def score(self, hits: dict[str, int], total: int) -> float:
        margin = sum(w * x for w, x in zip(self.scale.tolist(), self.features(hits, total)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def word_tables(labelled: DataFrame, model: np.ndarray) -> DataFrame:
    """word, toxic, clean: labelled texts of each kind that hold a restored word, or one with that beginning."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(texts_of(batch), batch.column("label").to_pylist()):
                words = restorer.words(text)
                for word in {*words, *(s for w in words for s in stems(w))}:
                    counts.setdefault(word, [0, 0])[label] += 1
            clean, toxic = zip(*counts.values()) if counts else ((), ())
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(list(counts), pa.string()), "toxic": pa.array(toxic, pa.int64()),
                "clean": pa.array(clean, pa.int64())})

    tables = by_batch(labelled, work, "word string, toxic long, clean long")
    return tables.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _gain(toxic, clean, n_toxic, n_clean, log=np.log):
    """The likelihood ratio statistic of holding a word against being toxic."""
    held, n = toxic + clean, n_toxic + n_clean

    def part(seen, total, others):
        return (seen + 1e-9) * log((seen + 1e-9) * n / ((total + 1e-9) * (others + 1e-9)))

    return 2 * (part(toxic, held, n_toxic) + part(clean, held, n_clean)
                + part(n_toxic - toxic, n - held, n_toxic) + part(n_clean - clean, n - held, n_clean))


def _candidates(labelled: DataFrame, model: np.ndarray, n_toxic: int, n_clean: int) -> list[str]:
    """All words and beginnings that tell enough about being toxic, each on its own. Whole words come first, then longer
    beginnings: where several say the same, the first is chosen."""
    gain = _gain(F.col("toxic"), F.col("clean"), F.lit(n_toxic), F.lit(n_clean), F.log)
    rows = (
        word_tables(labelled, model).where(F.col("toxic") * n_clean > F.col("clean") * n_toxic)
        .select("word", gain.alias("gain")).where(F.col("gain") >= LEAST_GAIN)
        .orderBy(F.col("word").endswith(STEM), F.desc(F.length("word")), "word").collect())
    return [r["word"] for r in rows]


def _choose(candidates: list[str], rows: np.ndarray, held: np.ndarray, toxic: np.ndarray) -> dict[str, float]:
    """Words by what they explain, with the log odds of the texts that hold them.

    ``rows`` and ``held``: each text with each candidate in it, by text. A text counts for less with every chosen
    word that it holds, so that words which only come along with toxic ones, as in near copies of one text, explain
    little more.
    """
    weights: dict[str, float] = {}
    rest = np.ones(len(toxic))
    free = np.ones(len(candidates), bool)
    by_word = np.argsort(held, kind="stable")
    starts = np.searchsorted(held[by_word], np.arange(len(candidates) + 1))
    while len(candidates):
        t, c = (np.bincount(held, (rest * kind)[rows], len(candidates)) for kind in (toxic, ~toxic))
        n_t, n_c = float(rest[toxic].sum()), float(rest[~toxic].sum())
        gains = np.where(free & (t > c), _gain(t, c, n_t, n_c), 0.0)
        best = int(gains.argmax())
        if gains[best] < LEAST_GAIN:
            return weights
        free[best] = False
        has = rows[by_word[starts[best]:starts[best + 1]]]
        a = int(toxic[has].sum())
        weights[candidates[best]] = math.log((a + 0.5) / (len(has) - a + 0.5))
        rest[has] *= EXPLAINED
    return weights


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> tuple[np.ndarray, Scorer]:
    """Letter model of all ``docs``; scorer from ``labels`` (doc_id, label 0 or 1).

    The scorer learns from a sample of ``rows`` labelled ids at most, those with the
    smallest hashes, and from one text of each, the smallest if an id is repeated. Rows with a null id or label are
    not learned from. Copies of a text count once, as toxic if one of them is.
    """
    model = letter_model(docs)
    chosen = (
        labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    one_each = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy(
        "doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    labelled = settle(one_each.groupBy("text").agg(F.max("label").cast("int").alias("label")), "labelled")
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    scorer = Scorer()
    if not sizes:
        return model, scorer
    candidates = _candidates(labelled, model, sizes.get(1, 0), sizes.get(0, 0))

    numbers = Units({word: i for i, word in enumerate(candidates)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            words = [restorer.words(t) for t in texts_of(batch)]
            held = [sorted((numbers[x], n) for x, n in numbers.held(w).items()) for w in words]
            yield pa.RecordBatch.from_pydict({
                "label": batch.column("label"), "key": batch.column("key"),
                "total": pa.array([sum(w.values()) for w in words], pa.int64()),
                "held": pa.array([[i for i, _ in h] for h in held], pa.list_(pa.int32())),
                "times": pa.array([[n for _, n in h] for h in held], pa.list_(pa.int64()))})

    # At most ``rows`` rows of the candidates in them, in an order that does not depend on tasks.
    sample = by_batch(
        labelled.withColumn("key", F.sha2("text", 256)), work,
        "label int, key string, total long, held array<int>, times array<long>").toArrow().sort_by("key")
    toxic, total = sample["label"].to_numpy() == 1, sample["total"].to_numpy()
    of_row = np.repeat(np.arange(len(toxic)), pc.list_value_length(sample["held"]).to_numpy())
    held, times = (pc.list_flatten(sample[c]).to_numpy() for c in ("held", "times"))
    scorer.weights = Units(_choose(candidates, of_row, held, toxic))
    chosen_words: list[dict[str, int]] = [{} for _ in range(len(toxic))]
    for at in np.flatnonzero(np.array([w in scorer.weights for w in candidates], bool)[held]).tolist():
        chosen_words[of_row[at]][candidates[held[at]]] = int(times[at])
    x = np.array([scorer.features(w, n) for w, n in zip(chosen_words, total.tolist())])
    scorer.scale = _logistic(x, toxic.astype(float))
    return model, scorer


def score(docs: DataFrame, model: np.ndarray, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, n_hits of every row.

    Null counts as the empty text, which like any text without a word of the
    lexicon has the score of the logistic scale alone. Without labels to learn from every score is 0.5 and
    predicted is 0. Rows are independent; other columns are not looked at.
    """
    box = docs.sparkSession.sparkContext.broadcast((model, scorer))
    learned = bool(scorer.scale.any())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, s = box.value
        restorer = Restorer(letters)
        for batch in batches:
            words = [restorer.words(t) for t in texts_of(batch)]
            hits = [s.weights.held(w) for w in words]
            scores = np.array([s.score(h, sum(w.values())) for h, w in zip(hits, words)], np.float64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "score": scores,
                "predicted": pa.array((scores >= threshold) & learned).cast(pa.int32()),
                "n_hits": pa.array([sum(h.values()) for h in hits], pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", "text"), work, f"doc_id {kind}, score double, predicted int, n_hits long")
