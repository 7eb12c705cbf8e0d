"""License scans: places of license phrases, and an exact set-similarity join of text blocks with license templates.

A text block is a run of as many words as a template has and SLACK more, wherever it starts. It meets the template if it
holds at least THRESHOLD of the template's distinct tokens. The join is exact, gives every such block (those that start
one after another as one, with the best containment), and looks at few:

- order: the templates' tokens by how many documents of the whole table hold them, rare ones first;
- prefix: with o = ceil(THRESHOLD * size) tokens to share, one of the template's first size - o + 1 tokens is shared, so
  only the words that a block around such a token can reach are looked at;
- length: a stretch of words with fewer than o of the template's tokens is out;
- position: a shared token at place i of the template leaves size - i - 1 tokens behind it at most; when what is shared
  so far and what may still come are less than o, the stretch is given up;
- in what is left, the block slides word by word, counting what comes in and what goes out.

Only the templates (a fixed list) are sent to the tasks, and one count per template token comes back. Nothing else is
shuffled, whatever the table holds.

Defined cases: null or empty text: no words, nothing found; equal scores: all labels are given; repeated rows: repeated
results; an empty table: an empty result; further columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_templates import TEMPLATES

THRESHOLD, SLACK, LEAST_SLACK = 0.9, 0.25, 4

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: All ASCII but letters and digits becomes a space; A-Z become a-z; other bytes stay.
_WORD_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


_BLOCK = ("label", "start", "length", "score")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def phrase_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """Where each phrase starts (words from 0) and its label."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at = joined.find(needle)
        place, counted = 0, 0
        while at >= 0:
            place += joined.count(b" ", counted, at)
            counted = at
            found.append((place, label))
            at = joined.find(needle, at + 1)
    return found


def template_words(text: str) -> list[str]:
    return [w.decode() for w in words_of(text.encode())]


def block_size(n_words: int) -> int:
    """Words of a block for a template of so many words."""
    return n_words + max(LEAST_SLACK, ceil(SLACK * n_words))


class Join:
    """Templates, indexed by their prefixes. frequency: documents that hold each token."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], threshold: float = THRESHOLD):
        texts = [template_words(t) for _, t in templates]
        vocabulary = sorted({w for t in texts for w in t}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w.encode(): k for k, w in enumerate(vocabulary)}
        self.labels = [label for label, _ in templates]
        self.tokens = [sorted({self.rank[w.encode()] for w in t}) for t in texts]
        self.members = [frozenset(t) for t in self.tokens]
        self.block = [block_size(len(t)) for t in texts]
        self.need = [ceil(threshold * len(t) - 1e-9) for t in self.tokens]
        self.prefix: dict[int, list[int]] = {}
        for k, (t, o) in enumerate(zip(self.tokens, self.need, strict=True)):
            for i in range(len(t) - o + 1):
                self.prefix.setdefault(t[i], []).append(k)
        self.seeds = frozenset(w for w, r in self.rank.items() if r in self.prefix)

    def enough(self, k: int, found: list[int]) -> bool:
        """Whether a stretch's distinct tokens (ranks, ascending) hold enough of template k."""
        t, o = self.tokens[k], self.need[k]
        n = at = 0
        for place, token in enumerate(t):
            if n + len(t) - place < o or n + len(found) - at < o:  # position: not enough can follow
                return False
            at = bisect_left(found, token, at)
            if at < len(found) and found[at] == token:
                n, at = n + 1, at + 1
        return n >= o

    def slide(self, k: int, ranks: list[int], lo: int, hi: int, last: int) -> Iterator[tuple[int, int, float]]:
        """Runs of blocks of template k within words lo to hi that meet it: first word, words, best containment. last: the
        last start that a text has."""
        members, o, size = self.members[k], self.need[k], self.block[k]
        held: Counter = Counter()
        n, first, best, end = 0, None, 0, lo
        for start in range(lo, min(hi, last + 1)):
            while end < min(start + size, hi):
                r = ranks[end - lo]
                if r in members:
                    held[r] += 1
                    n += held[r] == 1
                end += 1
            if n >= o:
                first, best = (start if first is None else first), max(best, n)
            elif first is not None:
                yield first, start - 1 + size - first, best / len(members)
                first, best = None, 0
            r = ranks[start - lo]
            if r in members:
                held[r] -= 1
                n -= held[r] == 0
        if first is not None:
            yield first, min(hi, last + 1) - 1 + size - first, best / len(members)

    def blocks(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """Label, first word, words and containment of all blocks that meet a template; overlapping ones as one."""
        near: dict[int, list[int]] = {}
        for at in [p for p, w in enumerate(words) if w in self.seeds]:
            for k in self.prefix[self.rank[words[at]]]:
                near.setdefault(k, []).append(at)
        found = []
        for k, places in near.items():
            size, o, at = self.block[k], self.need[k], 0
            last = max(len(words) - size, 0)
            while at < len(places):
                lo, hi = max(0, places[at] - size + 1), places[at] + size
                while at + 1 < len(places) and places[at + 1] - size + 1 <= hi:
                    at += 1
                    hi = places[at] + size
                at += 1
                lo, hi = min(lo, last), min(hi, len(words))
                ranks = [self.rank.get(w, -1) for w in words[lo:hi]]
                mine = [r for r in ranks if r in self.members[k]]
                if len(mine) >= o and self.enough(k, sorted(set(mine))):  # length; prefix and position
                    found += [(self.labels[k], start, min(n, len(words) - start), best) for start, n, best in self.slide(k, ranks, lo, hi, last)]
        return sorted(found)


def token_frequency(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[str, int]:
    """Documents of the whole table that hold each template token: a row per token comes back."""
    wanted = {w.encode() for _, t in templates for w in template_words(t)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                seen.update(wanted.intersection(words_of(text)))
        if seen:  # pandas would take empty columns for numbers
            yield pd.DataFrame({"token": [w.decode() for w in seen], "n": list(seen.values())})

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(run, "token string, n long")
    return {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id, text. doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks (label, start,
    length, score of each block that meets a template)."""
    join = Join(templates, token_frequency(docs, templates), threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                words = words_of(text)
                places = phrase_places(words, phrases)
                blocks = join.blocks(words)
                met: dict[str, float] = {}
                for label, _, _, share in blocks:
                    met[label] = max(met.get(label, 0.0), share)
                base = {label for _, label in places}
                starts = [p for p, _ in places]
                rows.append(
                    (doc_id, len(words), len(places), str(min(starts)) if starts else None, str(max(starts)) if starts else None)
                    + (",".join(sorted(base)), ",".join(sorted(base | met.keys())), 1.0 if base else max(met.values(), default=0.0), [dict(zip(_BLOCK, x, strict=True)) for x in blocks])
                )
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    # integers that may be null travel as text
    schema = "doc_id string, n_words long, n_base long, first_word string, last_word string, base_labels string, labels string, score double, blocks array<struct<label:string,start:long,length:long,score:double>>"
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(run, schema)
    return out.withColumns({"doc_id": F.col("doc_id").cast("long"), "first_word": F.col("first_word").cast("long"), "last_word": F.col("last_word").cast("long")})
