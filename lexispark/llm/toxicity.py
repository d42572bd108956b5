"""Toxicity: a counterfactual-regularised logistic classifier.

Features are how often a word, or any word with a given beginning of 4 to 7 letters, occurs in a text: at least
once, twice, three times. Only features that labelled toxic texts have significantly more often are kept, with
weights of zero or more, so a long harmless text gathers no evidence from chance words. For labelled sentences with
identity terms counterfactuals are made by swapping each term for every other of its group; the loss adds the squared
change of the score between the two, so that no group's name itself counts as evidence.

Identity terms come from two places. IDENTITY_TERMS is a list of neutral names of groups, and a parameter. As a corpus
may name its groups otherwise, neutral_terms() finds further ones in the training texts: words that many harmless texts
use, though toxic texts use them more often, each grouped with equally common words that toxic texts do not use more
often. The model says how many pairs of either kind served, and fitted() warns where there was none.

The fit sees a bounded sample of texts (labelled.py) and at most MOST_PAIRS pairs of each kind, in one executor task.

Defined results: null and empty texts get the score of a text without evidence; without labels of both classes
every score is 0; of one id's labels 1 wins, and of its texts the smallest serves; repeated rows give repeated results;
equal scores are equal whatever the row order; texts of any length are scored whole; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from hashlib import blake2b
from itertools import islice
from uuid import uuid4
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import prepare, remainder, text_or_empty, trim
from lexispark.llm.labelled import MOST_BYTES, fit_in_task, sample

#: Neutral names of groups (sex, religion, orientation, origin, migration), by language; terms of one line may stand for
#: one another. A term of several lines may stand for the others of all of them.
IDENTITY_TERMS = (
    # English
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "jew", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "homosexual", "heterosexual"),
    ("gays", "lesbians", "bisexuals", "homosexuals", "heterosexuals"),
    ("black", "white", "asian", "latino", "latina", "african", "european", "arab"),
    ("blacks", "whites", "asians", "latinos", "latinas", "africans", "europeans", "arabs"),
    ("immigrants", "refugees", "foreigners", "locals", "migrants"),
    ("immigrant", "refugee", "foreigner", "local", "migrant"),
    # German
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann", "mädchen", "junge"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("moslem", "christ", "jude", "hindu", "buddhist", "atheist"),
    ("muslimin", "christin", "jüdin", "buddhistin", "atheistin"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("muslimische", "christliche", "jüdische", "hinduistische", "buddhistische", "atheistische"),
    ("muslimischen", "christlichen", "jüdischen", "hinduistischen", "buddhistischen", "atheistischen"),
    ("schwul", "lesbisch", "heterosexuell", "bisexuell", "homosexuell"),
    ("schwule", "lesbische", "heterosexuelle", "bisexuelle", "homosexuelle"),
    ("schwulen", "lesben", "heterosexuellen", "bisexuellen", "homosexuellen"),
    ("schwarz", "weiß", "asiatisch", "afrikanisch", "europäisch", "arabisch"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische", "arabische"),
    ("schwarzen", "weißen", "asiatischen", "afrikanischen", "europäischen", "arabischen"),
    ("asiaten", "afrikaner", "europäer", "araber"),
    ("migranten", "einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("migrantin", "einwanderin", "ausländerin", "einheimischer", "flüchtling"),
    # French
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("musulmane", "chrétienne", "juive", "hindoue"),
    ("chrétiennes", "juives", "hindoues"),
    ("homosexuel", "hétérosexuel", "bisexuel", "transgenre"),
    ("homosexuels", "hétérosexuels", "bisexuels", "transgenres"),
    ("homosexuelle", "hétérosexuelle", "bisexuelle", "lesbienne"),
    ("homosexuelles", "hétérosexuelles", "bisexuelles", "lesbiennes"),
    ("noir", "blanc", "asiatique", "africain", "européen", "arabe"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("noire", "blanche", "africaine", "européenne"),
    ("noires", "blanches", "africaines", "européennes"),
    ("immigrés", "réfugiés", "étrangers", "migrants"),
    ("immigré", "réfugié", "étranger", "migrant"),
    ("immigrée", "réfugiée", "étrangère", "migrante"),
    ("immigrées", "réfugiées", "étrangères", "migrantes"),
    # Spanish
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("musulmana", "cristiana", "judía", "atea"),
    ("musulmanas", "cristianas", "judías", "ateas"),
    ("homosexual", "heterosexual", "bisexual", "lesbiana", "transgénero"),
    ("homosexuales", "heterosexuales", "bisexuales", "lesbianas"),
    ("negro", "blanco", "asiático", "africano", "europeo", "árabe"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
    ("negra", "blanca", "asiática", "africana", "europea"),
    ("negras", "blancas", "asiáticas", "africanas", "europeas"),
    ("inmigrantes", "refugiados", "extranjeros", "migrantes"),
    ("inmigrante", "refugiado", "extranjero", "migrante"),
    ("refugiada", "extranjera", "inmigrante"),
    ("refugiadas", "extranjeras", "inmigrantes"),
)
Terms = tuple[tuple[str, ...], ...]
PREFIXES = (4, 5, 6, 7)
LEVELS = 3
_CORE = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def _hash(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def features_of(word: str) -> tuple[int, ...]:
    """Hashed features of a token: of each of its words, the word and its beginnings."""
    out = []
    for core in _CORE.findall(word):
        out.append(_hash(core))
        out += [_hash(core[:n] + "*") for n in PREFIXES if len(core) >= n]
    return tuple(out)


class _Cache(dict):
    """token -> features, those in `wanted` only where it is given; bounded."""

    def __init__(self, wanted: set[int] | dict | None, bound: int = 200_000):
        super().__init__()
        self.wanted, self.bound = wanted, bound

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= self.bound:
            self.clear()
        found = features_of(token)
        if self.wanted is not None:
            found = tuple(f for f in found if f in self.wanted)
        self[token] = found
        return found


def counts_of(text: str, cache: _Cache) -> Counter:
    out: Counter = Counter()
    for token, n in Counter(text.lower().split()).items():
        for f in cache[token]:
            out[f] += n
    return out


@lru_cache(maxsize=8)
def swaps(terms: Terms = IDENTITY_TERMS) -> dict[str, tuple[str, ...]]:
    """Each term and the others of its lines, from its own place on."""
    out: dict[str, tuple[str, ...]] = {}
    for line in terms:
        for i, t in enumerate(line):
            out[t] = tuple(dict.fromkeys((*out.get(t, ()), *(x for x in (*line[i + 1 :], *line[:i]) if x != t))))
    return {t: others for t, others in out.items() if others}


def counterfactuals(text: str, terms: Terms = IDENTITY_TERMS, turn: int = 0) -> list[tuple[str, str]]:
    """(sentence, sentence with its identity terms swapped), for each sentence that has any.

    turn: which of a term's others stands in, from 0 on; beyond the last it begins again.
    """
    swap = swaps(terms)
    return [(s, _swapped(s, swap, turn)) for s in _sentences(text, swap)]


def _sentences(text: str, swap: dict[str, tuple[str, ...]]) -> Iterator[str]:
    for s in _SENTENCE.findall(text.lower()):
        if not swap.keys().isdisjoint(_CORE.findall(s)):
            yield s


def _swapped(sentence: str, swap: dict[str, tuple[str, ...]], turn: int) -> str:
    return _CORE.sub(lambda m: x[turn % len(x)] if (x := swap.get(m[0])) else m[0], sentence)


#: Counterfactual pairs of each kind (by the list, by neutral_terms) that fit() uses at most.
MOST_PAIRS = 20_000


def _pairs(texts: list[str], swap: dict[str, tuple[str, ...]]) -> Iterator[tuple[str, str]]:
    """Every sentence with a term and each of its swaps; texts in the order of a hash, so that a bound takes no special ones."""
    for text in sorted(texts, key=lambda t: (crc32(t.encode("utf-8", "surrogatepass")), t)):
        for s in _sentences(text, swap):
            for turn in range(max(len(swap.get(w, ())) for w in _CORE.findall(s))):
                yield s, _swapped(s, swap, turn)


def neutral_terms(data: list[tuple[str, int]], least_share: float = 0.01, most_lift: float = 4.0, most: int = 400, partners: int = 3) -> Terms:
    """Groups of a neutral term and `partners` words to swap it for, from (text, label) pairs.

    A neutral term is a word that at least least_share of the harmless texts use and that toxic texts use more often,
    though not most_lift times as often (as a real insult is). Its partners are the words of the most similar share of
    harmless texts that toxic texts do not use more often. `most` terms serve, those of the largest lift.
    """
    n1 = sum(y for _, y in data)
    n0 = len(data) - n1
    have: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in data:
        have[label].update({w for w in _CORE.findall(text.lower()) if w.isalpha()})
    if not n0 or not n1:
        return ()
    wide = {w: b / n0 for w, b in have[0].items() if b >= max(5, least_share * n0)}
    lift = {w: have[1][w] / n1 / p for w, p in wide.items()}
    calm = sorted((p, w) for w, p in wide.items() if lift[w] <= 1)
    shares = np.array([p for p, _ in calm])
    out = []
    for w in sorted((w for w in wide if 1 < lift[w] < most_lift), key=lambda w: (-lift[w], w))[:most]:
        near = np.argsort(np.abs(shares - wide[w]), kind="stable")[:partners]
        if len(near):
            out.append((w, *(calm[i][1] for i in near)))
    return tuple(out)


@dataclass(frozen=True)
class Model:
    """Score = sigmoid(bias + length * log(1 + tokens) + sum of a feature's weights up to its count)."""

    bias: float
    length: float
    weights: dict[int, tuple[float, ...]]
    name: str = ""
    #: Counterfactual pairs that the fit saw: by the list of identity terms, by neutral_terms().
    pairs: tuple[int, int] = (0, 0)

    def raw(self, text: str, cache: _Cache) -> float:
        z = self.bias + self.length * np.log1p(len(text.split()))
        for f, n in counts_of(text, cache).items():
            z += sum(self.weights[f][: min(n, LEVELS)])
        return float(z)

    def scorer(self):
        cache = _Cache(self.weights)
        return lambda text: 1 / (1 + np.exp(-np.clip(self.raw(text, cache), -30, 30)))


NOTHING = Model(-30.0, 0.0, {}, "nothing")


def fit(data: list[tuple[str, int]], min_toxic: int = 4, min_gain: float = 5.0, most_features: int = 6000, penalty: float = 4.0, ridge: float = 0.004, rounds: int = 500, terms: Terms = IDENTITY_TERMS, find_terms: bool = True, most_pairs: int = MOST_PAIRS) -> Model:
    """A model of (text, label) pairs. penalty: of score changes under swapped identity terms; find_terms: neutral_terms() too."""
    y = np.array([label for _, label in data], np.float64)
    if not len(y) or y.min() == y.max():
        return NOTHING
    cache = _Cache(None, 50_000)
    seen: Counter = Counter()
    for text, label in data:
        if label:
            seen.update(counts_of(text, cache).keys())
    place = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= min_toxic))}
    del seen
    n1, n0 = y.sum(), len(y) - y.sum()

    def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's features among those that toxic texts have, and how often it has them, up to LEVELS."""
        c = {place[f]: min(n, LEVELS) for f, n in counts_of(text, cache).items() if f in place}
        return np.fromiter(c, np.int32, len(c)), np.fromiter(c.values(), np.int8, len(c))

    kept_counts = [counted(text) for text, _ in data]
    have = np.zeros((2, LEVELS, len(place)))
    for (at, n), (_, label) in zip(kept_counts, data):
        for level in range(LEVELS):
            have[label, level, at[n > level]] += 1
    b, a = have
    total = (a + b) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, n: k * np.log(np.maximum(k, 0.5) / n / total) + (n - k) * np.log(np.maximum(n - k, 0.5) / n / (1 - total))
        gain = np.where((a >= min_toxic) & (a / n1 > b / n0) & (total < 1), 2 * (part(a, n1) + part(b, n0)), 0.0)
    level, feature = np.nonzero(gain >= min_gain)
    # the largest gains, ties in a fixed order
    best = np.lexsort((level, feature, -gain[level, feature]))[:most_features]
    order = best[np.lexsort((level[best], feature[best]))]
    chosen = list(zip(feature[order].tolist(), level[order].tolist()))
    column = np.full((LEVELS, len(place)), -1, np.int64)
    column[level[order], feature[order]] = np.arange(len(chosen))

    def matrix(rows: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        at, col = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, (f, n) in enumerate(rows):
            found = np.concatenate([column[level, f[n > level]] for level in range(LEVELS)])
            found = found[found >= 0]
            at.append(np.full(len(found), i))
            col.append(found)
        return np.concatenate(at), np.concatenate(col)

    length = np.array([np.log1p(len(t.split())) for t, _ in data])
    at, col = matrix(kept_counts)
    del kept_counts, have, a, b, total, gain
    listed = list(islice(_pairs([t for t, _ in data], swaps(terms)), most_pairs))
    # a term is swapped for its partners, not the other way round
    found = {t: tuple(others) for t, *others in neutral_terms(data)} if find_terms else {}
    mined = list(islice(_pairs([t for t, _ in data], found), most_pairs))
    pairs = listed + mined
    share = np.concatenate([np.full(n, 1 / max(n, 1)) for n in (len(listed), len(mined))])  # either kind weighs alike
    (pa_, pc), (qa, qc) = (matrix(counted(p[i]) for p in pairs) for i in (0, 1))
    w, bias, slope = np.zeros(len(chosen)), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    center = length.mean()
    m = np.zeros(len(chosen) + 2)
    v = np.zeros(len(chosen) + 2)
    for step in range(1, rounds + 1):  # Adam on the whole sample, weights held at zero or more
        z = bias + slope * (length - center) + np.bincount(at, w[col], len(y))
        g = (1 / (1 + np.exp(-z)) - y) * weight
        grad = np.bincount(col, g[at], len(chosen)) + ridge * w / len(y) ** 0.5
        if pairs:
            change = share * (np.bincount(pa_, w[pc], len(pairs)) - np.bincount(qa, w[qc], len(pairs)))
            grad += 2 * penalty * (np.bincount(pc, change[pa_], len(chosen)) - np.bincount(qc, change[qa], len(chosen)))
        full = np.concatenate([grad, [g.sum(), (g * (length - center)).sum()]])
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w = np.maximum(0, w - move[:-2])
        bias, slope = bias - move[-2], slope - move[-1]
    weights: dict[int, list[float]] = {}
    name_of = list(place)
    for i, (f, level) in enumerate(chosen):
        if w[i] > 1e-3:
            weights.setdefault(name_of[f], [0.0] * LEVELS)[level] = float(w[i])
    return Model(float(bias - slope * center), float(slope), {f: tuple(x) for f, x in weights.items()}, uuid4().hex, (len(listed), len(mined)))


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column without nulls; what a task remembers of words goes with it."""

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in parts:
            yield pd.Series([scorer(t) for t in texts], dtype="float64")
        del scorer
        trim()

    return of(text)


#: Labelled documents of each class that fit() gets at most.
PER_CLASS = 4000


def fitted(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", terms: Terms = IDENTITY_TERMS, most_bytes: int = MOST_BYTES, penalty: float = 4.0) -> Model:
    """A model of a bounded sample, fitted by one task; warns where no counterfactual could be made."""
    model = fit_in_task(sample(docs, labels, "toxic", held_out, per_class, id_col, text_col, most_bytes), partial(fit, terms=terms, penalty=penalty))
    if model.weights and not sum(model.pairs):
        warnings.warn("no labelled text has an identity term: the classifier is not regularised by counterfactuals", stacklevel=2)
    return model


def score(docs: DataFrame, model: Model, held_out: tuple[int, int], threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every whole text."""
    prepare(docs.sparkSession)
    made = docs.select(F.col(id_col), (remainder(id_col, held_out[0]) == held_out[1]).alias("held_out"), score_column(model, text_or_empty(text_col)).alias("score"))
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_harmless(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows below the threshold, with all their columns."""
    prepare(docs.sparkSession)
    return docs.where(score_column(model, text_or_empty(text_col)) < threshold)
