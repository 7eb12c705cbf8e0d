"""Toxicity: Levenshtein automata over a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learned from labelled rows (a bounded sample, see labelled.py): words and stems that toxic documents
hold far more often, each with its log-odds as weight. A trie holds them. The Levenshtein automata of all terms run on
the trie at once: a state is the set of (trie node, edits) that a prefix of a word can have reached; states are made
when first met and kept, so a word costs a dict look-up per character and most end after a few. Stems accept any ending.

Each hit is weighed by its context, WINDOW words to either side: quotation marks and verbs of saying lower it, other
hits, words of address and a break in the sentence raise it. A logistic regression over the sums scores the document;
its features come from a lexicon that was learned on the other half of the sample, so terms seen in one row only are
not overrated. The lexicon has no size of its own: it holds all terms that enough toxic documents of the sample share. Scoring is one scan without a shuffle.

Defined cases: null text counts as empty and is scored; without any learning rows, or with one class only, every text
scores that class's share (0.5 if there are none); an empty table: an empty result; repeated rows: repeated results;
further columns are ignored. Labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import worker_cache

THRESHOLD, WINDOW = 0.5, 8
#: A term is held by so many toxic documents, and by this share of them, at least; its log-odds are MIN_ODDS at least.
MIN_DOCS, MIN_SHARE, MIN_ODDS, STEM_CHARS = 3, 0.01, 2.0, (5, 8)

#: Words that a task remembers and terms that it counts, and pairs in the automaton's states: it lets go of them when it
#: has more.
MEMORY, PAIRS = 50_000, 400_000

_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»‘’…"
_QUOTES = "\"“”„«»"
#: Fixed word lists for context: verbs of saying, and words that address or describe someone.
SAYING = frozenset("said says saying wrote writes quote quoted quotes called quoting dit écrit cité sagte schrieb zitat zitiert dijo escribió cita citó".split())
ADDRESS = frozenset("you your you're are is tu vous ton votre es êtes du dein ihr bist seid eres usted tú sois".split())


def words_of(text: str) -> list[str]:
    return text.split()


def bare(word: str) -> str:
    return word.strip(_STRIP).lower()


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Finds the terms within their allowed edits of a word. terms: term -> weight; a term that ends in "*" is a stem."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, int, bool]]] = [[]]  # terms that end at a node, their allowed edits, stem or not
        self.most = [0]  # the most edits that a term at or below a node allows
        for term in sorted(terms):
            stem = term.endswith("*")
            letters, node = term.rstrip("*"), 0
            allowed = 0 if stem else edits_allowed(letters)
            self.most[0] = max(self.most[0], allowed)
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node].append((term, allowed, stem))
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.final: list[list[tuple[str, int]]] = []
        self.stems: list[list[str]] = []
        self.known: dict[str, tuple] = {}
        self.pairs = 0
        self.start = self._state({0: 0})

    def _close(self, reached: dict[int, int]) -> dict[int, int]:
        """Adds what letters of a term that the word lacks reach."""
        todo = list(reached.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < reached.get(child, 99):
                    reached[child] = e + 1
                    todo.append((child, e + 1))
        return reached

    def _state(self, reached: dict[int, int]) -> int:
        reached = self._close(reached)
        key = frozenset(reached.items())
        if key in self.states:
            return self.states[key]
        k = self.states[key] = len(self.sets)
        self.sets.append(tuple(reached.items()))
        self.pairs += len(reached) + 8
        self.moves.append({})
        self.final.append([(t, e) for n, e in reached.items() for t, allowed, stem in self.ends[n] if not stem and e <= allowed])
        self.stems.append([t for n, e in reached.items() for t, _, stem in self.ends[n] if stem and e == 0])
        return k

    def _move(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e + 1 <= self.most[node] and e + 1 < reached.get(node, 99):
                reached[node] = e + 1  # the word has a letter more
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < reached.get(child, 99):
                    reached[child] = cost
        k = self._state(reached) if reached else -1
        self.moves[state][c] = k
        return k

    def find(self, word: str) -> tuple:
        """(term, edits) pairs: the nearest term, and the longest stem."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > MEMORY or self.pairs > PAIRS:
                self._forget()
            state, stem = self.start, None
            for c in word:
                k = self.moves[state].get(c)
                state = self._move(state, c) if k is None else k
                if state < 0:
                    break
                if self.stems[state]:
                    stem = self.stems[state][0]
            best = min(self.final[state], key=lambda x: (x[1], -self.terms[x[0]], x[0]), default=None) if state >= 0 else None
            got = self.known[word] = tuple(x for x in (best, stem and (stem, 0)) if x)
        return got


def context(words: list[str], at: int, hit: list[bool]) -> tuple[float, float]:
    """How much the words around a hit look like quotation, and like abuse."""
    lo, hi = max(0, at - WINDOW), min(len(words), at + WINDOW + 1)
    around = [bare(w) for w in words[lo:hi]]
    marks_before = sum(sum(w.count(q) for q in _QUOTES) for w in words[lo : at + 1])
    marks_after = sum(sum(w.count(q) for q in _QUOTES) for w in words[at:hi])
    quotation = (marks_before > 0 and marks_after > 0) + any(w in SAYING for w in around)
    broken = at > 0 and words[at - 1][-1:] in ".!?" and words[at][:1].islower()
    abuse = min(3, sum(hit[lo:hi]) - 1) / 3 + any(w in ADDRESS for w in around) + broken
    return float(quotation), float(abuse)


FEATURES = 9


def features(text: str | None, automaton: Automaton) -> np.ndarray | None:
    """Sums over a document's hits; None if it has none."""
    words = words_of(text or "")
    counts = Counter(words)
    hits = {w: f for w in counts if (f := automaton.find(bare(w)))}
    if not hits:
        return None
    is_hit = [w in hits for w in words]
    exact, loose, stems = {}, {}, {}
    quoted = abusive = plain = 0.0
    n = 0
    for at, w in enumerate(words):
        if not is_hit[at]:
            continue
        n += 1
        top = 0.0
        for term, edits in hits[w]:
            weight = automaton.terms[term]
            kind = stems if term.endswith("*") else loose if edits else exact
            kind[term] = weight
            top = max(top, weight / (1 + edits))
        quotation, abuse = context(words, at, is_hit)
        quoted += top * min(quotation, 1)
        abusive += top * abuse
        plain += top * (1 + abuse) / (1 + 2 * quotation)
    return np.array(
        [
            sum(exact.values()) / 4,
            max(exact.values(), default=0) / 2,
            sum(loose.values()) / 4,
            sum(stems.values()) / 4,
            math.log1p(n),
            math.log1p(plain),
            math.log1p(abusive),
            math.log1p(quoted),
            math.log1p(100 * n / len(words)),
        ]
    )


class Model:
    def __init__(self, terms: dict[str, float], w: np.ndarray | None, bias: float, none: float):
        """none: the logit of a text without hits."""
        self.terms, self.w, self.bias, self.none = terms, w, bias, none

    def score(self, text: str | None, automaton: Automaton) -> float:
        x = None if self.w is None else features(text, automaton)
        return float(labelled.sigmoid(self.none if x is None else self.bias + float(self.w @ x)))


def weigh_terms(counts: pd.DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """counts: term, t, c (toxic and clean documents that hold it). Log-odds of the terms worth keeping."""
    t, c = counts["t"].to_numpy(float), counts["c"].to_numpy(float)
    odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    gain = t / max(toxic, 1) * odds
    keep = (t >= max(MIN_DOCS, MIN_SHARE * toxic)) & (odds >= MIN_ODDS)
    term = counts["term"].to_list()
    # a stem that one word or one longer stem accounts for says nothing more than that word
    most: dict[str, float] = {}
    for k in np.flatnonzero(keep):
        whole = term[k].rstrip("*")
        for cut in range(STEM_CHARS[0], min(STEM_CHARS[1], len(whole) - (not term[k].endswith("*"))) + 1):
            if whole[:cut] + "*" != term[k]:
                most[whole[:cut] + "*"] = max(most.get(whole[:cut] + "*", 0), t[k])
    keep &= np.array([most.get(x, 0) < 0.9 * n for x, n in zip(term, t, strict=True)], bool)
    order = sorted(np.flatnonzero(keep), key=lambda k: (-gain[k], term[k]))
    return {term[k]: float(odds[k]) for k in order}


def candidate_terms(text: str) -> set[str]:
    found = {b for w in set(words_of(text)) if len(b := bare(w)) >= 3}
    return found | {w[:k] + "*" for w in found for k in range(STEM_CHARS[0], min(STEM_CHARS[1], len(w) - 1) + 1)}


def learn(docs: DataFrame, labels: DataFrame, per_class: int = labelled.PER_CLASS) -> Model:
    rows, share = labelled.sample(docs, labels, "toxic", per_class)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def out() -> Iterator[pd.DataFrame]:
            if seen:
                yield pd.DataFrame([(f, y, t, n) for (f, y, t), n in seen.items()], columns=["fold", "y", "term", "n"])
            seen.clear()

        for b in batches:
            for fold, y, text in zip(b["fold"], b["y"], b["text"], strict=True):
                seen.update((fold, y, t) for t in candidate_terms(text or ""))
                if len(seen) > MEMORY:
                    yield from out()
        yield from out()

    counted = rows.mapInPandas(count, "fold int, y int, term string, n long").groupBy("term")
    sums = counted.agg(*[F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n"))), F.lit(0)).alias(f"n{f}{y}") for f in (0, 1) for y in (0, 1)])
    sizes = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = lambda y, folds: sum(sizes.get((f, y), 0) for f in folds)
    # terms of too few toxic documents, or of clean ones as well, stay out where they are counted; best first
    t, c = F.col("n01") + F.col("n11"), F.col("n00") + F.col("n10")
    odds = F.log((t + 0.5) / (n(1, (0, 1)) + 1)) - F.log((c + 0.5) / (n(0, (0, 1)) + 1))
    worth = (t >= max(MIN_DOCS, MIN_SHARE * n(1, (0, 1)))) & (odds >= MIN_ODDS / 2)  # a fold may rate a term higher
    table = sums.filter(worth).toPandas()  # bounded by the sample: at most a hundred times as many terms as one of its toxic documents holds
    if not n(0, (0, 1)) or not n(1, (0, 1)):
        flat = min(max(share, 1e-3), 1 - 1e-3)
        return Model({}, None, 0.0, math.log(flat / (1 - flat)))

    def lexicon(folds: tuple[int, ...]) -> dict[str, float]:
        counts = pd.DataFrame({"term": table["term"], "t": sum(table[f"n{f}1"] for f in folds), "c": sum(table[f"n{f}0"] for f in folds)})
        return weigh_terms(counts, n(1, folds), n(0, folds))

    crossed = {0: lexicon((1,)), 1: lexicon((0,))}

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = {f: Automaton(t) for f, t in crossed.items()}
        for b in batches:
            if b.empty:
                continue
            xs = [features(t, automata[f]) for f, t in zip(b["fold"], b["text"], strict=True)]
            yield pd.DataFrame({"y": b["y"], "x": [None if x is None else x.tolist() for x in xs]})

    got = rows.mapInPandas(extract, "y int, x array<double>").toPandas()  # 2 * per_class rows at most
    y = got["y"].to_numpy(float)
    shift = labelled.prior_shift(y, share)
    without = got["x"].isna().to_numpy()
    none = math.log((y[without].sum() + 0.5) / ((1 - y[without]).sum() + 0.5)) + shift
    hit = ~without
    if not hit.any():
        return Model(lexicon((0, 1)), None, 0.0, none)
    x, t = np.array(got["x"][hit].tolist()), y[hit]
    w, b = np.zeros(FEATURES), np.zeros(1)

    def gradients():
        e = (labelled.sigmoid(x @ w + b) - t) / len(t)
        return x.T @ e + 1e-3 * w, e.sum(keepdims=True)

    labelled.adam([w, b], gradients, 1500, 0.05)
    return Model(lexicon((0, 1)), w, float(b[0]) + shift, none)


def scorer(model: Model) -> Callable[[Column], Column]:
    key = ("automaton", hash(tuple(sorted(model.terms.items()))))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        cache = worker_cache()
        automaton = cache.get(key)
        if automaton is None:
            for old in [k for k in cache if isinstance(k, tuple) and k[0] == "automaton"]:
                del cache[old]
            automaton = cache[key] = Automaton(model.terms)
        return pd.Series([model.score(t, automaton) for t in texts], dtype="float64")

    return lambda text: score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = labelled.PER_CLASS) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, toxic. doc_id, held_out, score, predicted."""
    score = scorer(learn(docs, labels, per_class))
    out = docs.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = labelled.PER_CLASS) -> DataFrame:
    """docs that score below the threshold; columns as they were."""
    score = scorer(learn(docs, labels, per_class))
    return docs.filter(score(F.col("text")) < threshold)
