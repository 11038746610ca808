"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguises: compatibility forms, accents and invisible characters go,
look-alike letters become Latin ones, digits and signs inside words become the
letters they stand for.  The lexicon is learned from labelled documents: stems at
word starts whose document frequencies speak for label 1 beyond chance, weighted by
their log-odds.  Exception phrases (given, or learned from documents with label 0)
cancel the hits inside them.  The sum of weights and its ratio to the length give,
by logistic regression, the score.

Learning reads a sample of at most ``max_labelled`` labelled documents (the bound is
a parameter); scoring is one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskweave.llm.common import Cache, let, staged

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "г": "r", "е": "e", "з": "3", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʀ": "r", "ꜱ": "s", "ᴏ": "o", "ᴜ": "u", "ᴍ": "m", "ᴛ": "t", "ᴇ": "e",
}
#: Digits and signs that stand for letters inside a word.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
             "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}
#: Phrases in which a lexicon word is harmless.
HARMLESS = ("clown fish", "trash bag", "trash bin", "trash can", "class clown", "circus clown", "pond scum")

# one letter for the group that a 1 or a bar can stand for
_ONE_SHAPE = str.maketrans({"l": "i"})
_LETTERS = str.maketrans({**LOOK_ALIKES})
_SIGNS = str.maketrans(STAND_INS)
_APART = re.compile(r"[^\w]+|_")
_SIGNED = re.compile(r"[^\W\d_]")
# a sign at a word's end is punctuation
_EDGES = re.compile(r"^[!|]+|[!|$@€£]+$")


def fold(word: str) -> str:
    """Canonical letters of one word; parts that other signs separate become words.

    ``l`` and ``i`` become one letter, since ``1`` and ``|`` can stand for either.
    """
    plain = unicodedata.normalize("NFKD", word).casefold()
    if not plain.isascii():
        plain = "".join(c for c in plain if unicodedata.category(c) not in ("Mn", "Cf")).translate(_LETTERS)
    plain = _EDGES.sub("", plain)
    if _SIGNED.search(plain):
        plain = plain.translate(_SIGNS)
    return _APART.sub(" ", plain).strip().translate(_ONE_SHAPE)


def folded_text(text: str, cache: Cache) -> str:
    """The folded words between single spaces, with one before the first and after the last."""
    return f" {' '.join([w for w in map(cache.__getitem__, text.split()) if w])} "


@dataclass
class Model:
    """Entries start with a space: they match at word starts only."""
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    beta: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            if phrase not in self.weights:
                found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def score(self, total: float, n_words: int) -> float:
        x = self.beta[0] + self.beta[1] * np.log1p(total) + self.beta[2] * np.log1p(100 * total / max(n_words, 20))
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def hits(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the lexicon hits that lie in no exception phrase."""
    if not len(automaton):
        return []
    found, covered = [], []
    for last, (length, weight) in automaton.iter(folded):
        (covered if weight is None else found).append((last + 1 - length, last + 1, weight))
    return [h for h in found if not any(a <= h[0] and h[1] <= b for a, b, _ in covered)]


def measured(automaton, cache: Cache, text: str | None) -> tuple[float, int, list, str]:
    folded = folded_text(text or "", cache)
    found = hits(automaton, folded)
    return sum(w for _, _, w in found), folded.count(" ") - 1, found, folded


# --- learning ------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, toxic) of at most ``max_labelled`` training rows, the smallest hashes of their ids.

    Of near copies, which share the smallest hash of their three-word shingles, one is
    kept: a rare word that only they have is no evidence.
    """
    usable = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
              .groupBy("_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(max_labelled))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    shingles = let(F.split(F.lower("text"), r"\s+"), lambda words: F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(1))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))))
    return (texts.join(usable, "_id").groupBy(F.array_min(shingles).alias("_key"), "toxic")
            .agg(F.min("text").alias("text")).select("text", "toxic"))


def learn(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 6_000, shortest: int = 4, longest: int = 10,
          min_evidence: float = 30.0, max_entries: int = 2_000, harmless: tuple[str, ...] = HARMLESS) -> Model:
    """The lexicon, its exceptions and the score's coefficients.

    ``min_evidence`` is the least likelihood ratio (G statistic) of an entry.  With
    no labels, or one class only, nothing is learned: every score is the smoothed
    share of label 1 (0 without labels).
    """
    sample = staged(labelled_sample(docs, labels, max_labelled), "toxicity")
    sizes = {int(t): int(n) for t, n in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model(beta=(float(np.log((bad + 0.5) / (good + 0.5))) if bad or good else -20.0, 0.0, 0.0))

    def stems(batches):
        cache, seen = Cache(fold), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(folded_text(text or "", cache).split())
                seen.update({(w[:k], toxic) for w in words for k in range(shortest, longest + 1) if len(w) >= k})
        rows = [(s, n if t else 0, 0 if t else n) for (s, t), n in seen.items()]
        for at in range(0, len(rows), 50_000):
            s, t, c = zip(*rows[at:at + 50_000])
            yield pa.RecordBatch.from_pydict({"stem": list(s), "bad": pa.array(t, pa.int64()), "good": pa.array(c, pa.int64())})

    b, g = F.col("bad"), F.col("good")
    term = lambda n, share: F.when(n > 0, n * F.log(n / ((b + g) * share))).otherwise(0.0)
    share = bad / (bad + good)
    found = (sample.mapInArrow(stems, "stem string, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
             .where((b / bad > 4 * g / good) & (b >= 3))
             .withColumn("evidence", 2 * (term(b, share) + term(g, 1 - share))).where(F.col("evidence") >= min_evidence)
             .orderBy(F.desc("evidence"), F.desc(F.length("stem")), "stem").limit(max_entries).collect())
    weights: dict[str, float] = {}
    for r in found:  # of stems that extend each other, the one with the most evidence
        if not any(r.stem.startswith(s[1:]) or s[1:].startswith(r.stem) for s in weights):
            weights[f" {r.stem}"] = float(np.log((r.bad + 0.5) / (bad + 1) / ((r.good + 0.5) / (good + 1))))

    known = tuple(" " + " ".join(fold(w) for w in p.split()) for p in harmless)
    model = Model(weights, known)

    def around(batches):
        cache, automaton, seen = Cache(fold), model.automaton(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, _, found, folded = measured(automaton, cache, text)
                phrases = set()
                for start, end, _ in found:
                    stop = folded.index(" ", end)
                    if start > 0:
                        phrases.add(folded[folded.rindex(" ", 0, start):stop])
                    if stop + 1 < len(folded):
                        phrases.add(folded[start:folded.index(" ", stop + 1)])
                seen.update((p, toxic) for p in phrases)
        rows = [(p, n if t else 0, 0 if t else n) for (p, t), n in seen.items()]
        if rows:
            p, t, c = zip(*rows)
            yield pa.RecordBatch.from_pydict({"stem": list(p), "bad": pa.array(t, pa.int64()), "good": pa.array(c, pa.int64())})

    spared = (sample.mapInArrow(around, "stem string, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
              .where((b == 0) & (g >= 3)).orderBy(F.desc("good"), "stem").limit(max_entries).collect())
    model = Model(weights, known + tuple(r.stem for r in spared))

    def features(batches):
        cache, automaton = Cache(fold), model.automaton()
        for batch in batches:
            totals = [measured(automaton, cache, t)[:2] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"total": pa.array([t for t, _ in totals], pa.float64()),
                                              "n": pa.array([n for _, n in totals], pa.int64()), "toxic": batch.column(1)})

    table = np.array([tuple(r) for r in sample.mapInArrow(features, "total double, n long, toxic int").collect()])
    return Model(model.weights, model.exceptions, logistic(table[:, 0], table[:, 1], table[:, 2]))


def logistic(total: np.ndarray, n: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Newton's method on two features of at most ``max_labelled`` rows."""
    x = np.column_stack([np.ones_like(total), np.log1p(total), np.log1p(100 * total / np.maximum(n, 20))])
    beta, penalty = np.zeros(3), ridge * len(y) * np.diag([1e-3, 1.0, 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(3), x.T @ (y - p) - penalty @ beta)
        size = np.abs(step).max()
        beta = beta + step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return tuple(float(b) for b in beta)


# --- scoring -------------------------------------------------------------------

def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score (0 to 1), n_hits.  NULL and empty texts get the score of no hits.

    Repeated rows are scored each; columns other than doc_id and text are not read.
    """
    def run(batches):
        cache, automaton = Cache(fold), model.automaton()
        for batch in batches:
            out = [measured(automaton, cache, t)[:3] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "score": pa.array([model.score(t, n) for t, n, _ in out], pa.float64()),
                "n_hits": pa.array([len(h) for _, _, h in out], pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, n_hits long")


def clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold."""
    at = docs.columns.index("text")

    def run(batches):
        cache, automaton = Cache(fold), model.automaton()
        for batch in batches:
            keep = [model.score(*measured(automaton, cache, t)[:2]) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
