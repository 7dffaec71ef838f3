"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at one surface statistic of a text and votes good, votes bad or
abstains. No rule decides alone: the votes of all documents are reduced to a
histogram of vote patterns (at most ``3 ** len(RULES)`` rows, whatever the
number of documents), expectation-maximisation over that histogram estimates
how often each rule votes each way on good documents and on each kind of bad
ones, and a document is kept if its posterior probability of being good is
high enough.

Defined results: a null text counts as empty; an empty text has no words, so
fails the base; rows are judged one by one, so ties and repeated rows get equal
verdicts; an empty table gives an empty result; other columns may have any name,
since a row travels as one struct.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import Workspace

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Minimum words, and the share of repeated words (in percent) above which the base fails.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
GOOD, BAD, ABSTAIN = 1, 2, 0


@dataclass(frozen=True)
class Rule:
    """A statistic per word (or per line), with limits inside which it votes good or bad."""

    name: str
    value: str
    good: str
    bad: str


#: ``good`` and ``bad`` are SQL conditions on ``v``, the value of the rule.
RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", "v < 0.05", "v > 0.25"),
    Rule("capitals", "n_upper / greatest(word_chars, 1)", "v < 0.12", "v > 0.3"),
    Rule("exclamations", "n_bang / greatest(n_words, 1)", "v < 0.05", "v > 0.25"),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", "v < 0.02", "v > 0.1"),
    Rule("lines", "n_dup_lines / greatest(n_lines, 1)", "v < 0.05", "v > 0.3"),
    Rule("stops", "n_stops / greatest(n_words, 1)", "v between 0.02 and 0.5", "v < 0.01"),
    Rule("word_length", "word_chars / greatest(n_words, 1)", "v between 3 and 9", "v < 2 or v > 14"),
    Rule("length", "n_words", "v >= 20", "v < 4"),
)


def _counted(text: Column, chars: str) -> Column:
    """Code points of ``text`` in the character class ``chars``."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """A struct ``row`` of all columns of ``docs``, and a struct ``_q`` with the statistics of each text.

    Repeated windows are found inside the row: a hash for each five-word window,
    and only where two are equal a sort of (hash, position), so that the cost is
    n log n even for a very long repetitive text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    keep = ["row"]
    # Each step refers to the one before it at least twice, so that Catalyst keeps the steps apart.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    a = docs.select(row, t.alias("_t"), F.array_remove(F.split(t, SPACE), "").alias("_w"), F.split(t, "\n", -1).alias("_l"))
    a = a.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    a = a.withColumn("_l", F.filter("_l", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    window = lambda h, i: F.xxhash64(h, *[F.get("_h", i + k) for k in range(1, 5)])
    a = a.withColumn("_g", F.transform(F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 4, F.lit(0))), window))
    pairs = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    a = a.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs))
    s = F.col("_s")
    twin = lambda x, j: ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"])) | (
        (j < F.size(s) - 1) & (F.get(s, F.least(j + 1, F.size(s) - 1))["h"] == x["h"])
    )
    a = a.withColumn("_p", F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"])))
    p = F.col("_p")
    step = lambda x, j: F.when(j < F.size(p) - 1, F.least(F.lit(5), F.get(p, F.least(j + 1, F.size(p) - 1)) - x)).otherwise(5)
    covered = F.coalesce(F.aggregate(F.transform(p, step), F.lit(0), lambda x, y: x + y), F.lit(0))
    t = F.col("_t")
    return a.select(
        *keep,
        F.struct(
            F.size("_w").cast("long").alias("n_words"),
            F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            _counted(t, SYMBOLS).alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            covered.cast("long").alias("n_repeat_words"),
            F.size("_l").cast("long").alias("n_lines"),
            _counted(t, r"\p{Lu}").alias("n_upper"),
            _counted(t, "!").alias("n_bang"),
            _counted(t, ".,;:?").alias("n_stops"),
        ).alias("_q"),
    )


def _vote(rule: Rule) -> Column:
    value = rule.value
    for name in ("n_repeat_words", "n_dup_lines", "n_symbols", "word_chars", "n_words", "n_lines", "n_upper", "n_bang", "n_stops"):
        value = value.replace(name, f"_q.{name}")
    good, bad = (c.replace("v", f"({value})", 1) if "or v" not in c else c.replace("v", f"({value})") for c in (rule.good, rule.bad))
    return F.expr(f"case when {bad} then {BAD} when {good} then {GOOD} else {ABSTAIN} end")


def votes(measured_docs: DataFrame) -> DataFrame:
    """Adds ``_v``: one digit per rule (0 abstains, 1 good, 2 bad)."""
    return measured_docs.withColumn("_v", F.concat(*[_vote(r).cast("string") for r in RULES]))


@dataclass(frozen=True)
class Model:
    """Latent classes: the first is good, each other one gathers one kind of bad documents.

    ``prior[k]`` is the logarithm of the share of class k, ``votes[k][j][v]`` that of the
    probability that rule j, if it votes, votes v on a document of class k; to abstain says nothing.
    """

    prior: tuple[float, ...]
    votes: tuple[tuple[tuple[float, ...], ...], ...]

    def shares(self, pattern: str) -> list[float]:
        z = [p + sum(r[int(v)] for r, v in zip(rules, pattern, strict=True) if int(v) != ABSTAIN) for p, rules in zip(self.prior, self.votes, strict=True)]
        most = max(z)
        e = [math.exp(x - most) for x in z]
        return [x / sum(e) for x in e]

    def accuracies(self) -> dict[str, float]:
        """How often each rule, where it does not abstain, votes good on good documents."""
        return {r.name: math.exp(v[GOOD]) / (math.exp(v[GOOD]) + math.exp(v[BAD])) for r, v in zip(RULES, self.votes[0], strict=True)}


def _start(pattern: str) -> list[float]:
    """Beliefs before the first round: a bad vote points at the class of its rule, more than one all the more."""
    bad = [j for j, v in enumerate(pattern) if int(v) == BAD]
    good = 0.97 if not bad else 0.2 ** len(bad)
    return [good, *((1 - good) / (len(bad) or len(pattern)) if j in bad or not bad else 0.0 for j in range(len(pattern)))]


def fit(histogram: dict[str, int], rounds: int = 300, smooth: float = 0.5) -> Model:
    """Expectation-maximisation over vote patterns, in plain arithmetic on the driver.

    A single class of bad documents would not do: kinds of junk exclude one another, so
    that the bad votes of one kind would be outvoted by the good votes of the rest.
    """
    patterns, m = sorted(histogram.items()), len(RULES)
    share = {p: _start(p) for p, _ in patterns}
    for _ in range(rounds):
        weight = [smooth] * (m + 1)
        counts = [[[smooth / 3] * 3 for _ in range(m)] for _ in range(m + 1)]
        for p, n in patterns:
            for k, s in enumerate(share[p]):
                weight[k] += s * n
                for j, v in enumerate(p):
                    counts[k][j][int(v)] += s * n * (int(v) != ABSTAIN)
        model = Model(tuple(math.log(w / sum(weight)) for w in weight), tuple(tuple((0.0, *(math.log(x / sum(c[1:])) for x in c[1:])) for c in rules) for rules in counts))
        new = {p: model.shares(p) for p, _ in patterns}
        moved = max((abs(new[p][0] - share[p][0]) for p, _ in patterns), default=0.0)
        share = new
        if moved < 1e-6:
            break
    return model


def judged(voted: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, Model]:
    """Adds ``_base_failed``, ``_posterior`` and ``_kept``; ``voted`` is read twice, so hand in a table.

    The histogram that comes to the driver has at most ``3 ** len(RULES)`` rows.
    """
    histogram = {r["_v"]: r["n"] for r in voted.groupBy("_v").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit(histogram)
    scores = []
    for prior, rules in zip(model.prior, model.votes, strict=True):
        z = F.lit(prior)
        for j, w in enumerate(rules):
            z = z + F.get(F.array(*map(F.lit, w)), F.substring("_v", j + 1, 1).cast("int"))
        scores.append(z)
    voted = voted.withColumn("_z", F.array(*scores))
    z = F.col("_z")
    posterior = 1 / F.aggregate(F.transform(z, lambda x: F.exp(x - F.get(z, F.lit(0)))), F.lit(0.0), lambda x, y: x + y)
    failed = (F.col("_q.n_words") < MIN_WORDS) | (100 * F.col("_q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q.n_words"))
    out = voted.withColumn("_base_failed", failed).withColumn("_posterior", posterior)
    return out.withColumn("_kept", ~F.col("_base_failed") & (F.col("_posterior") >= threshold)), model


def quality_filter(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, that pass the base and whose posterior reaches ``threshold``."""
    table = Workspace(docs.sparkSession).save(votes(measured(docs)), "votes")
    return judged(table, threshold)[0].filter("_kept").select("row.*")


def quality_report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each document: the statistics, the votes and the verdict."""
    scored = votes(measured(docs.select("doc_id", "text"))).select(F.col("row.doc_id").alias("doc_id"), "_q", "_v")
    table = Workspace(docs.sparkSession).save(scored, "votes")
    q = [F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged(table, threshold)[0].select("doc_id", *q, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_v").alias("votes"), F.round("_posterior", 6).alias("posterior"))
