"""Toxicity by a lexicon whose Levenshtein automaton catches misspelled terms.

1. A lexicon is learned from a bounded sample of labelled rows: words, and stems
   (beginnings of words), that stand in toxic documents far more often than in
   others.
2. The lexicon is a trie. The automaton reads a token letter by letter; its
   state is the set of (place in the trie, edits so far) that are still within
   the budget of some term below: the intersection of the trie with the
   Levenshtein automaton of the token. States are made when first needed and
   kept, so that a token costs one look-up a letter.
3. Around each hit a window of words tells quotation from abuse: a pair of
   quotation marks around the term (an apostrophe between letters is none), or
   words that speak about a word ("the word", "a slur").
4. A logistic regression over hits that are plain, misspelled or quoted, fitted
   on the same sample, gives the score.

Defined results: null and empty texts, and texts without a hit, get the score
of a text without hits; equal rows get equal scores; with no labels to learn
from nothing is known and every score is 0; an empty table gives no rows. Time
is linear in the text; kept states and tokens are bounded.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bounds of the sample that lexicon and scores are fitted on: documents, and bytes of each (longer ones are left out).
SAMPLE, LONGEST = 5000, 1 << 15
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Documents of the sample in which a term must stand, and how much likelier it must be in toxic ones.
LEAST, LIFT, STEM = 6, 25.0, (4, 8)
CONTEXT, CACHE, STATES = 6, 200_000, 200_000
#: Terms of so many letters may differ in the first one.
FREE = 7
#: Words, with digits and with the signs that stand for letters between others.
_TOKEN = re.compile(r"[^\W_]+(?:[@$!*+|][^\W_]+)*")
_PART, _LETTER = re.compile(r"[^\W_]+"), re.compile(r"[^\W\d_]")
#: Quotation marks by what may close them, either way round for angles. An apostrophe between letters is none.
_CLOSES = {'"': '"', "'": "'", "`": "`'", "“": "”", "„": "“”", "‘": "’", "’": "’", "”": "”", "«": "»", "»": "«", "‹": "›", "›": "‹"}
_MARKS = re.compile("[" + "".join(sorted({*_CLOSES, *"".join(_CLOSES.values())})) + "]")
#: Words that speak about a word. Those that report speech are none: "he said you are ..." abuses, unless marks stand around it.
ABOUT = frozenset("word words term terms quote quoted quotes insult insults slur slurs spelled".split())


@dataclass
class Lexicon:
    """Terms with their log-odds; ``stems`` match every token that begins so."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: Tokens near a term that also stand in harmless documents.
    harmless: frozenset[str] = frozenset()


def _marked(before: str, after: str) -> bool:
    """Whether a quotation that opens in the text before a term closes in the one after it."""
    opened = None
    for m in _MARKS.finditer(before):
        left, right = before[m.start() - 1 : m.start()], before[m.end() : m.end() + 1]
        if left.isalnum() and right.isalnum():
            continue
        if opened is not None and m[0] in _CLOSES[opened] and left and not left.isspace():
            opened = None
        elif m[0] in _CLOSES and not left.isalnum() and not right.isspace():
            opened = m[0]
    if opened is None:
        return False
    for m in _MARKS.finditer(after):
        left, right = after[m.start() - 1 : m.start()], after[m.end() : m.end() + 1]
        # The first mark of the kind that isn't an apostrophe closes; what precedes the text after the term is the term.
        if m[0] in _CLOSES[opened] and not right.isalnum() and not left.isspace():
            return True
    return False


def edits(term: str) -> int:
    """Misspellings that a term tolerates."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Levenshtein automata of tokens, intersected with the trie of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[tuple[str, float] | None] = [None]
        self.stem: list[tuple[str, float] | None] = [None]
        self.budget = [0]
        for terms, marks in ((lexicon.words, self.word), (lexicon.stems, self.stem)):
            for term, weight in sorted(terms.items()):
                node, k = 0, edits(term) if marks is self.word else 0
                self.budget[0] = max(self.budget[0], k)
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        for x, new in ((self.children, {}), (self.word, None), (self.stem, None), (self.budget, 0)):
                            x.append(new)
                    node = self.children[node][c]
                    self.budget[node] = max(self.budget[node], k)
                marks[node] = (term, weight)
        self.start = self._closed({(0, 0)})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}

    def _closed(self, state: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With the places reached by letters of a term that the token leaves out; worse ways to a place go."""
        best: dict[int, int] = {}
        todo = list(state)
        while todo:
            node, e = todo.pop()
            if e > self.budget[node] or best.get(node, e + 1) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e in state:
            out.add((node, e + 1))
            for letter, child in self.children[node].items():
                out.add((child, e + (letter != c)))
        if len(self.steps) >= STATES:
            self.steps.clear()
        new = self.steps[state, c] = self._closed(out)
        return new

    def match(self, token: str) -> tuple[str, float, int] | None:
        """The term nearest to a token within its budget: (term, weight, edits)."""
        state, stem = self.start, None
        for c in token:
            state = self.steps.get((state, c)) or self._step(state, c)
            if not state:
                break
            for node, e in state:
                if e == 0 and self.stem[node]:
                    stem = (*self.stem[node], 0)
        found = [(e, *self.word[n]) for n, e in state if self.word[n] and e <= edits(self.word[n][0])]
        if found:
            e, term, weight = min(found, key=lambda x: (x[0], -x[2], x[1]))
            # A misspelling of a short term keeps the first letter, or it would too often be another word.
            if e == 0 or token[0] == term[0] or (e == 1 and len(term) >= FREE):
                return term, weight, e
        return stem


def without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One row of each group of near copies: those that share one of three minimum hashes of their five-word shingles.

    Else the rare words of a text that was copied often would look like terms.
    """
    seen, out = set(), []
    for text, label in rows:
        w = text.split()
        shingles = [" ".join(w[k : k + 5]).encode() for k in range(max(1, len(w) - 4))]
        keys = {(seed, min(zlib.crc32(x, seed) for x in shingles)) for seed in (1, 2, 3)}
        if not keys & seen:
            out.append((text, label))
        seen |= keys
    return out


def learn(rows: list[tuple[str, int]]) -> Lexicon:
    """Words and stems of toxic documents, from (text, label) rows."""
    toxic, clean, n = Counter(), Counter(), [0, 0]
    for text, label in without_copies(rows):
        (toxic if label else clean).update(set(_TOKEN.findall(text.lower())))
        n[bool(label)] += 1

    def weight(t: int, c: int) -> float:
        lift = ((t + 0.5) / (n[1] + 1)) / ((c + 0.5) / (n[0] + 1))
        return float(np.log(lift)) if t >= LEAST and lift >= LIFT else 0.0

    words = {w: x for w, t in toxic.items() if len(w) >= 3 and (x := weight(t, clean[w]))}
    # Stems count tokens, since the words behind one are many and each is rare.
    begun, begun_clean = Counter(), Counter()
    most = Counter()
    for w, k in toxic.items():
        for size in range(STEM[0], min(STEM[1], len(w)) + 1):
            begun[w[:size]] += k
            most[w[:size]] = max(most[w[:size]], k)
    begun = Counter({s: k for s, k in begun.items() if k >= LEAST})
    for w, k in clean.items():
        for size in range(STEM[0], min(STEM[1], len(w)) + 1):
            if w[:size] in begun:
                begun_clean[w[:size]] += k
    stems: dict[str, float] = {}
    for s in sorted(begun, key=lambda s: (len(s), s)):
        x = weight(begun[s], begun_clean[s])
        # Where one word makes up most of a stem, the word itself is the term.
        if x and most[s] < 0.5 * begun[s] and not any(t.startswith(s) or s.startswith(t) for t in stems):
            # As long as it loses next to nothing, a longer stem is the safer one.
            while len(s) < STEM[1] and (longer := max((t for t in begun if len(t) == len(s) + 1 and t.startswith(s)), key=lambda t: begun[t], default="")) and begun[longer] >= 0.98 * begun[s]:
                s = longer
            stems[s] = x
    words = {w: x for w, x in words.items() if not any(w[:k] in stems for k in range(STEM[0], len(w) + 1))}
    lexicon = Lexicon(words, stems)
    automaton = Automaton(lexicon)
    harmless = frozenset(w for w, c in clean.items() if (m := automaton.match(w)) and m[2] and weight(toxic[w], c) == 0.0)
    return Lexicon(words, stems, harmless)


class Scorer:
    """Features and scores of texts; made once in each task."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None = None):
        self.lexicon, self.weights, self.automaton = lexicon, weights, Automaton(lexicon)
        self.cache: dict[str, tuple[str, float, int] | None] = {}

    def _match(self, token: str) -> tuple[str, float, int] | None:
        found = None
        if _LETTER.search(token):
            # Where the whole says nothing, signs may part words after all.
            for part in dict.fromkeys([token, *_PART.findall(token)]):
                found = self.automaton.match(part)
                if found and not (found[2] and part in self.lexicon.harmless):
                    break
                found = None
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[token] = found
        return found

    def hits(self, text: str) -> list[tuple[int, int, str, int, bool]]:
        """(start, end, term, edits, quoted) of each term in a text, in its lower case."""
        low = text.lower()
        cache, missing = self.cache, object()
        found = {}
        for t in set(_TOKEN.findall(low)):
            m = cache.get(t, missing)
            if m is missing:
                m = self._match(t)
            if m:
                found[t] = m
        if not found:
            return []
        spans = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(low)]
        out = []
        for k, (a, b, t) in enumerate(spans):
            if t in found:
                near = {w for _, _, w in spans[max(0, k - CONTEXT) : k + CONTEXT + 1]}
                lo, hi = spans[max(0, k - CONTEXT)][0], spans[min(len(spans) - 1, k + CONTEXT)][1]
                # One sign more on either side, for a mark at the window's edge.
                marked = _marked(low[max(0, lo - 1) : a] + low[a : a + 1], low[b : hi + 2])
                out.append((a, b, found[t][0], found[t][2], marked or bool(near & ABOUT)))
        return out

    def features(self, text: str | None) -> np.ndarray:
        """1; logarithms of the numbers of plain, misspelled and quoted hits; the largest log-odds among unquoted ones."""
        n, most = [0, 0, 0], 0.0
        for _, _, term, e, quoted in self.hits(text or ""):
            n[2 if quoted else 1 if e else 0] += 1
            if not quoted:
                most = max(most, self.lexicon.words.get(term) or self.lexicon.stems.get(term, 0.0))
        return np.array([1.0, *np.log1p(n), most / 5])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-self.features(text) @ self.weights)))


#: What is believed before anything is seen: quotation counts for little.
_PRIOR = np.array([-3.0, 2.0, 1.5, 0.3, 1.0])


def fit(x: np.ndarray, y: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards the prior."""
    w = _PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - _PRIOR)
        hess = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer | None:
    """Fits on at most ``sample`` labelled documents that are not held out, chosen by a hash."""
    known = labels.where("toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The sample is chosen before texts are fetched: it is small enough to be sent to every reader of texts.
    share = min(1 << 40, int(1.1 * sample / max(1, known.count()) * (1 << 40)) + 1)
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST).join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    if not rows:
        return None
    rows = [(r["text"], int(r["toxic"])) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]
    scorer = Scorer(learn(rows))
    x = np.array([scorer.features(t) for t, _ in rows])
    return Scorer(scorer.lexicon, fit(x, np.array([y for _, y in rows], dtype=float)))


def toxicity(docs: DataFrame, lexicon: Lexicon | None, weights: np.ndarray | None, threshold: float = THRESHOLD) -> DataFrame:
    """(``doc_id``, ``score``, ``predicted``, ``hits``, ``quoted``) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, weights) if lexicon else None
        for b in batches:
            score, hits, quoted = [], [], []
            for v in b.column(1):
                if scorer is None:
                    found, s = np.zeros(5), 0.0
                else:
                    found = scorer.features(v.as_py())
                    s = float(1 / (1 + np.exp(-found @ weights)))
                score.append(s)
                n = np.rint(np.expm1(found[1:4])).astype(int).tolist()
                hits.append(n[0] + n[1])
                quoted.append(n[2])
            predicted = [int(s >= threshold) for s in score]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, type=pa.float64()), *(pa.array(x, type=pa.int32()) for x in (predicted, hits, quoted))], ["doc_id", "score", "predicted", "hits", "quoted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int, hits int, quoted int")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trained on labelled rows that are not held out, applied to all documents."""
    scorer = train(docs, labels)
    out = toxicity(docs, scorer.lexicon if scorer else None, scorer.weights if scorer else None)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "hits", "quoted")
