"""Toxicity scores from a learned lexicon, matched with spelling errors.

1. From labelled texts, words and word beginnings that mark the toxic class are collected with their
   log-odds. A term counts once for each different word that stands before it, so that copies of one
   text do not make all its words look telling.
2. The lexicon is a trie. Its intersection with Levenshtein automata, one per allowed number of errors,
   is a nondeterministic automaton over (trie node, errors, letter awaited after a swap); it is made
   deterministic lazily, state by state, as words arrive, and soon dies on most words. An error is a
   letter too many, too few or another one, or a swap of neighbours, anywhere in the word or stem.
3. Each hit is weighed in its window of words: quotation marks around it or words of report and
   mention nearby count it as quoted rather than meant.
4. Four numbers of a text (weight of exact hits, misspelled hits, quoted hits, share of its words) go
   into a logistic model that is fitted on the labelled texts.

Only labels of rows that ``held_out`` leaves are read; at most MOST_LABELLED of each class, those with
the smallest hash of the id. The model is a small object of bounded size that tasks carry.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, text_batches

#: Bound of the labelled sample, per class.
MOST_LABELLED = 4000
#: Beginnings of words are terms too, between these lengths.
STEM_FROM, STEM_TO = 4, 7
#: Words and stems of at least so many letters may have an error.
LEAST_FUZZY = 5
#: Members of the states that an automaton holds before it starts over.
MOST_HELD = 500_000
WINDOW = 6
THRESHOLD = 0.7

_WORD = r"[^\W\d_]+"
_QUOTES = "\"'“”„«»‘’‹›`"
#: Words of report and mention in English, French, German and Spanish.
_MENTION = frozenset(
    "said says quote quoted quotes word term called calls reported wrote"
    " dit disait cité citation mot terme écrit sagte sagt zitat zitiert wort begriff schrieb"
    " dijo dice cita citado palabra término escribió".split()
)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


@dataclass
class Lexicon:
    """Terms with weights; a stem matches every word that begins with it.

    ``everywhere``, as the learned lexicon has it: errors also in first letters and stems, and swaps as one.
    """

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    everywhere: bool = False

    def __post_init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.accept: list[tuple[float, bool, int] | None] = [None]  # weight, stem, most errors
        for terms, stem in ((self.words, False), (self.stems, True)):
            for term, weight in sorted(terms.items()):
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.accept.append(None)
                    node = self.children[node][c]
                if self.accept[node] is None or stem:
                    self.accept[node] = weight, stem, int((self.everywhere or not stem) and len(term) >= LEAST_FUZZY)
        # Errors are followed only where an entry below allows them.
        self.allows = [a[2] if a else 0 for a in self.accept]
        for node in range(len(self.children) - 1, -1, -1):
            self.allows[node] = max([self.allows[node], *(self.allows[x] for x in self.children[node].values())])
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[float, int] | None] = []
        self.stops: list[tuple[float, int] | None] = []
        self.near: list[tuple[float, int] | None] = []
        self.held = 0
        self._state(frozenset())  # dead
        self.start = self._state(frozenset({(0, 0, "")}))

    def __reduce__(self):
        return Lexicon, (self.words, self.stems, self.everywhere)

    def _state(self, reached: frozenset) -> int:
        k = self.states.get(reached)
        if k is None:
            k = self.states[reached] = len(self.sets)
            self.sets.append(reached)
            self.steps.append({})
            self.held += 10 + len(reached)
            hits = [(self.accept[n][0], e) for n, e, wait in reached if not wait and self.accept[n] and e <= self.accept[n][2]]
            stops = [(self.accept[n][0], e) for n, e, _ in reached if self.accept[n] and self.accept[n][1] and not e]
            near = [(self.accept[n][0], e) for n, e, wait in reached if not wait and self.accept[n] and self.accept[n][1] and 0 < e <= self.accept[n][2]]
            best = lambda found: min(found, key=lambda x: (x[1], -x[0]), default=None)
            self.ends.append(best(hits))
            self.stops.append(best(stops))
            self.near.append(best(near))
        return k

    def _step(self, state: int, c: str) -> int:
        reached: set[tuple[int, int, str]] = set()
        for node, errors, wait in self.sets[state]:
            if wait:  # the other letter of a swap
                if c == wait:
                    reached.add((node, errors, ""))
                continue
            below = self.children[node]
            if c in below:
                reached.add((below[c], errors, ""))
            if (node or self.everywhere) and errors < self.allows[node]:
                reached.add((node, errors + 1, ""))  # a letter too many
                for d, x in below.items():
                    if errors < self.allows[x]:
                        reached.add((x, errors + 1, ""))  # another letter
                        after = self.children[x].get(c)
                        if after is not None:
                            reached.add((after, errors + 1, ""))  # a letter left out
                            if self.everywhere and c != d and errors < self.allows[after]:
                                reached.add((after, errors + 1, d))  # two letters swapped
        # A last letter may be missing too; the node is then reached one letter early.
        for node, errors, wait in list(reached):
            if not wait and errors < self.allows[node]:
                reached |= {(x, errors + 1, "") for x in self.children[node].values() if errors < self.allows[x]}
        least: dict[tuple[int, str], int] = {}
        for node, errors, wait in reached:
            least[node, wait] = min(errors, least.get((node, wait), errors))
        found = self._state(frozenset((node, errors, wait) for (node, wait), errors in least.items()))
        if self.held > MOST_HELD:  # start over rather than grow without bound
            self.held = 0
            sets = self.sets[found]
            self.states, self.sets, self.steps, self.ends, self.stops, self.near = {}, [], [], [], [], []
            self._state(frozenset())
            self.start = self._state(frozenset({(0, 0, "")}))
            return self._state(sets)
        self.steps[state][c] = found
        return found

    def match(self, word: str) -> tuple[float, int] | None:
        """Weight and number of errors of the entry that the word is or resembles."""
        state, near = self.start, None
        for c in word:
            after = self.steps[state].get(c)
            if after is None:
                after = self._step(state, c)
            state = after
            if not state:
                return near
            if self.stops[state]:
                return self.stops[state]
            near = near or self.near[state]  # unless it is matched without an error further on
        return self.ends[state] or near


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        low = (text or "").lower()
        found = re.findall(_WORD, low)
        match = self.lexicon.match
        hits = {w: m for w in set(found) if (m := match(w))}
        if not hits:
            return 0.0, 0.0, 0.0, 0.0
        exact = fuzzy = quoted = 0.0
        n = 0
        places = list(re.finditer(_WORD, low))
        for i, place in enumerate(places):
            m = hits.get(place.group())
            if m is None:
                continue
            n += 1
            near = found[max(0, i - WINDOW) : i + WINDOW + 1]
            around = low[max(0, place.start() - 1) : place.start()] + low[place.end() : place.end() + 1]
            if len(around) == 2 and all(c in _QUOTES for c in around) or not _MENTION.isdisjoint(near):
                quoted += 1
            elif m[1]:
                fuzzy += 1
            else:
                exact += m[0]
        return min(exact, 12.0), min(fuzzy, 3.0), min(quoted, 3.0), min(100.0 * n / len(found), 10.0)

    def score(self, text: str | None) -> float:
        return _sigmoid(self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], self.features(text), strict=True)))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton's method; the penalty keeps separable samples finite."""
    x = np.c_[np.ones(len(x)), x]
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.05)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` texts of each class."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    parts = [known.filter(F.col("label") == k).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most) for k in (0, 1)]
    # Two bounded parts: small enough to send to every task whatever the size of the tables.
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")


def _terms(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text, label in zip(batch["text"], batch["label"], strict=True):
            found = re.findall(_WORD, (text or "").lower())
            seen = set()
            for before, w in zip(["", *found], found):  # noqa: B905
                for stem in (w, *(w[:n] + "*" for n in range(STEM_FROM, min(STEM_TO, len(w)) + 1))):
                    if stem not in seen:
                        seen.add(stem)
                        rows.append((stem, before, w, label))
        yield pd.DataFrame(rows, columns=["term", "before", "word", "label"])


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms whose G statistic for the toxic class is beyond what chance gives among all terms.

    All of them are kept; the bounded sample bounds their number.
    """
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon()
    terms = sample.mapInPandas(_terms, "term string, before string, word string, label int")
    toxic, clean = F.col("label") == 1, F.col("label") == 0
    counted = terms.groupBy("term").agg(
        F.count_distinct(F.when(toxic, F.col("before"))).alias("t"),
        F.sum(clean.cast("int")).alias("c"),
        F.size(F.collect_set(F.when(toxic, F.col("word")))).alias("n"),
    )
    rate = lambda x, n: (F.col(x) + 0.5) / (n + 1)
    weight = F.log(rate("t", n1) / rate("c", n0))
    both = F.col("t") + F.col("c")
    part = lambda x, n: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (both * n / (n0 + n1)))).otherwise(0.0)
    g = 2 * (part("t", n1) + part("c", n0))
    kept = counted.filter("t >= 3").select("term", "t", "c", "n", weight.alias("weight"), g.alias("g"))
    kept = kept.filter((F.col("g") >= 18) & (F.col("weight") >= 1.5)).orderBy("term")
    rows = {r["term"]: r for r in kept.collect()}
    # A stem is of use if several words begin with it; the shortest that is as pure as longer ones stays.
    stems = {t[:-1]: r["weight"] for t, r in rows.items() if t.endswith("*") and r["n"] >= 3 and r["weight"] >= 3}
    stems = {s: w for s, w in stems.items() if not any(s[:n] in stems for n in range(STEM_FROM, len(s)))}
    # Words that a stem covers stay, for what resembles them but not the stem.
    words = {t: r["weight"] for t, r in rows.items() if not t.endswith("*")}
    return Lexicon(words, stems, everywhere=True)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> Model:
    sample = checkpointed(labelled_sample(text_batches(docs), labels, label, id_col, text_col, most))
    model = Model(learn_lexicon(sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([model.features(t) for t in batch["text"]], columns=list("abcd"))
            yield out.assign(label=batch["label"].to_numpy())

    rows = sample.mapInPandas(run, "a double, b double, c double, d double, label int").toPandas()  # 2 * most rows
    if rows["label"].nunique() < 2:
        model.coefficients = (-3.0, 0.5, 0.5, 0.0, 0.0)
    else:
        beta = _logistic(rows[list("abcd")].to_numpy(float), rows["label"].to_numpy(float))
        # A misspelled hit is never evidence against toxicity, a quoted one never for it beyond an exact one.
        model.coefficients = (beta[0], max(beta[1], 0.0), max(beta[2], 0.0), min(max(beta[3], -1.0), 0.5), max(beta[4], 0.0))
    return model


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have no hits and the score of such texts. A null id is not held out. Rows are
    scored one by one, so repeated rows get equal scores. Without labels of both classes the lexicon is
    empty and all scores are low. An empty table gives an empty result.
    """
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=[model.score(t) for t in batch.pop("text")])

    held = F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out")
    scored = docs.select(F.col(id_col).alias("doc_id"), held, F.col(text_col).alias("text"))
    # Integers that may be null pass through pandas as text.
    scored = scored.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, held_out boolean, score double")
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "score", predicted)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, whatever their names.

    Null and empty texts have no hits and stay; rows that repeat are judged alike; an empty table gives
    an empty result, and without labels of both classes all rows stay.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return docs.filter(F.pandas_udf(run, "double")(F.col(text_col)) < THRESHOLD)
