"""Finding entities by n-gram models in both directions.

Laplace models of a bounded number of tagged sentences are fitted once; the scan of a
sentence is sequential (a found entity becomes one tag for what follows), so it runs
as an Arrow UDF over sentences with the counts broadcast. The bound on the training
sentences, MOST_SENTENCES, also bounds the broadcast.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training sentences at most, taken in the order of a hash of their tokens.
MOST_SENTENCES = 10_000
# ---- fixed values: words that start no entity, end the growth of one, or are cut from its end
NO_START = frozenset(
    "a an the this that these those he she it they we i you his her its their our my who whom whose which what where when why how in on at of for with by from "
    "to into over under after before during and or but nor yet so is are was were be been being has have had do does did can could may might will would shall should must not no".split()
)
NO_INSIDE = frozenset("he she it they we i you his her its their and or but to is are was were has have had can could may might will would shall should must who which".split())
NO_END = frozenset("in on at of for with by from to into a an the and or his her its their".split())
# ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Tuned constants of the decision."""

    a: float = 0.976
    b: float = 1.825
    threshold: float = 1.511
    include: float = 0.902
    longest: int = 6
    cross: bool = True


class CountModel:
    """Laplace n-gram model over padded sentences."""

    def __init__(self, sentences: list[list[str]], order: int):
        self.order = order
        self.grams: Counter = Counter()
        self.contexts: Counter = Counter()
        for s in sentences:
            padded = ["<s>"] * (order - 1) + s + ["</s>"] * (order - 1)
            for n in range(1, order + 1):
                for i in range(len(padded) - n + 1):
                    gram = tuple(padded[i : i + n])
                    self.grams[gram] += 1
                    self.contexts[gram[:-1]] += 1
        self.size = len({g[0] for g in self.grams if len(g) == 1}) + 1

    def p(self, word: str, context: tuple = ()) -> float:
        return (self.grams[(*context, word)] + 1) / (self.contexts[context] + self.size)

    def mean_p(self, words: list[str], before: list[str]) -> np.ndarray | None:
        """Mean probability of each word over the contexts of 2 tokens and more."""
        lengths = range(2, min(len(before), self.order - 1) + 1)
        if not lengths:
            return None
        return np.mean([[self.p(w, tuple(before[-n:])) for w in words] for n in lengths], axis=0)


class Tagger:
    def __init__(self, sentences: list[list[str]], tags: list[str], order: int = 5, settings: Settings = Settings()):
        self.tags, self.settings = tags, settings
        self.models = (CountModel(sentences, order), CountModel([s[::-1] for s in sentences], order))
        self.priors = [np.array([m.p(t) for t in tags]) for m in self.models]

    def choose(self, p: np.ndarray, other: float, priors: np.ndarray) -> int | None:
        """The tag that stands out among the tags and against the word, or None."""
        s = self.settings
        if p.max() / other <= s.threshold:
            return None
        rank = np.where(p > s.a * p.mean() + s.b * p.std(), p / priors, -1.0)
        return int(rank.argmax()) if rank.max() > 0 else None

    def evidence(self, way: int, before: list[str], word: str) -> tuple[np.ndarray, float] | None:
        p = self.models[way].mean_p([*self.tags, word], before)
        return None if p is None else (p[:-1], float(p[-1]))

    def length(self, way: int, line: list[str], at: int, tag: str) -> int:
        """How many tokens the entity takes: while what follows fits better after the
        tag alone than after the tag and the token in question."""
        model, most = self.models[way], 0
        while most < min(self.settings.longest, len(line) - 1 - at):
            w = line[at + most]
            if w in NO_INSIDE or w.startswith("TAG-") or not any(c.isalpha() for c in w):
                break
            most += 1
        head = line[:at]
        for n in range(most):
            follow = line[at + n + 1]
            inside = model.mean_p([follow], [*head, tag])
            outside = model.mean_p([follow], [*head, *([tag] if n else []), line[at + n]])
            if inside is None or outside is None or inside[0] / outside[0] < self.settings.include:
                return n
        return most

    def scan(self, way: int, line: list[str]) -> list[tuple[int, int, str, tuple]]:
        """(first, last, tag, evidence) of one direction; ``line`` is in its order."""
        tokens, places = list(line), list(range(len(line)))
        found, i = [], 2
        while i < len(tokens):
            word = tokens[i]
            seen = None
            if not (word.startswith("TAG-") or word in NO_START or not word[0].isalpha() or any(c.isdigit() for c in word)):
                seen = self.evidence(way, tokens[:i], word)
            best = None if seen is None else self.choose(*seen, self.priors[way])
            n = 0 if best is None else self.length(way, tokens, i, self.tags[best])
            while n > 1 and tokens[i + n - 1] in NO_END:
                n -= 1
            if n:
                found.append((places[i], places[i + n - 1], self.tags[best], seen))
                tokens[i : i + n] = [self.tags[best]]
                places[i : i + n] = [places[i]]
            i += 1
        return found

    def find(self, tokens: list[str]) -> list[tuple[int, int, str]]:
        """(start, stop, tag) of the entities of a sentence, by both directions; with
        ``cross`` each must hold against the evidence of the other direction too."""
        size, out = len(tokens), {}
        for way in (0, 1):
            line = tokens if way == 0 else tokens[::-1]
            for a, b, tag, seen in self.scan(way, line):
                start, stop = (a, b + 1) if way == 0 else (size - 1 - b, size - a)
                back = tokens[:start] if way == 1 else tokens[stop:][::-1]
                word = tokens[start] if way == 1 else tokens[stop - 1]
                other = self.evidence(1 - way, back, word) if self.settings.cross else None
                if other is not None:
                    both = np.sqrt(seen[0] * other[0]), float(np.sqrt(seen[1] * other[1]))
                    best = self.choose(*both, np.sqrt(self.priors[0] * self.priors[1]))
                    tag = None if best is None else self.tags[best]
                if tag is not None:
                    out.setdefault((start, stop), tag)
        return [(a, b, t) for (a, b), t in sorted(out.items())]


def fit_tagger(tagged: DataFrame, tokens: str, order: int = 5, settings: Settings = Settings()) -> Tagger:
    """A tagger from at most MOST_SENTENCES sentences whose entities are TAG- tokens."""
    rows = tagged.where(F.size(tokens) > 0).select(tokens).orderBy(F.xxhash64(tokens), tokens).limit(MOST_SENTENCES).collect()
    sentences = [list(r[0]) for r in rows]
    return Tagger(sentences, sorted({t for s in sentences for t in s if t.startswith("TAG-")}), order, settings)


def find_entities(sentences: DataFrame, keys: list[str], tokens: str, tagger: Tagger) -> DataFrame:
    """``keys``, ``start``, ``stop``, ``label`` of the found entities. Null and empty
    sentences have none; a tagger without tags finds none."""
    shared = sentences.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf("array<struct<start:int,stop:int,label:string>>")
    def find(lines: pd.Series) -> pd.Series:
        run = shared.value
        return pd.Series([[{"start": a, "stop": b, "label": t.removeprefix("TAG-")} for a, b, t in run.find(list(x))] if run.tags else [] for x in lines], dtype=object)

    return sentences.where(F.size(tokens) > 0).select(*keys, F.explode(find(tokens)).alias("f_")).select(*keys, "f_.*")


def sample_settings(rng: random.Random) -> Settings:
    """A random trial: a and include linear, b and threshold log-uniform, whole lengths."""
    logu = lambda lo, hi: float(np.exp(rng.uniform(np.log(lo), np.log(hi))))
    return Settings(rng.uniform(0.5, 1.5), logu(0.5, 3.0), logu(1.0, 3.0), rng.uniform(0.6, 1.2), rng.choice([3, 4, 6, 8, 10]), rng.random() < 0.7)


def tune(tagger: Tagger, held_out: list[tuple[list[str], set]], trials: int = 20, seed: int = 7) -> tuple[Settings, list[dict]]:
    """Random search on held-out sentences (tokens, set of (start, stop, tag)): the
    settings of best (f1, precision) and all trials; the first is the baseline."""
    rng, best, rows = random.Random(seed), None, []
    for k in range(trials + 1):
        settings = tagger.settings if k == 0 else sample_settings(rng)
        run = Tagger.__new__(Tagger)
        run.__dict__ = {**tagger.__dict__, "settings": replace(settings)}
        tp = fp = fn = 0
        for tokens, gold in held_out:
            got = set(run.find(tokens))
            tp, fp, fn = tp + len(got & gold), fp + len(got - gold), fn + len(gold - got)
        p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * p * r / (p + r) if p + r else 0.0
        rows.append({"trial": k, "precision": p, "recall": r, "f1": f1, **settings.__dict__})
        if best is None or (f1, p) > best[0]:
            best = ((f1, p), settings)
    return best[1], rows
