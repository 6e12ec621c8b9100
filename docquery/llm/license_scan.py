"""License scans: a paragraph classifier in DataFrame operations.

A sparse multinomial logistic regression on word n-grams is fitted on the driver
to variations of the license texts (and of texts that only sound alike); what is
called a license is calibrated on other texts, held out of the fit. Its weights
become a table of one row per n-gram. Paragraphs that have a word of the
vocabulary are cut into n-grams, joined with the table, and the weights are
summed per paragraph; softmax and the calibrated threshold follow as columns. A
prediction is confirmed by comparing the paragraph with the family's templates.
Paragraphs without such a word have no n-gram with a weight, so leaving them out
changes nothing. A paragraph is a line; besides, runs of lines with such a word
are scored joined, for texts that are wrapped.
"""

from __future__ import annotations

import random
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.license_texts import BODIES, HELD_OUT, NAMES, TEMPLATES, UNLIKE

UNKNOWN = "unknown"
N_GRAM = 3
#: Words that alone are no feature.
STOPS = frozenset("a an and any are as at be by can for from has have if in is it may no not of on one or other out should than that the their this to used was were which with you your".split())
#: What separates words besides space: everything but letters, digits, dots inside numbers and bytes of other scripts.
PUNCTUATION = "\t\n\v\f\r,;:!?()[]{}<>\"'`“”’/\\|*#$%&_=+@~^-"


def words_of(text: str) -> list[str]:
    """Lower-case words; the same as _words for columns."""
    words = text.lower().translate(str.maketrans(PUNCTUATION, " " * len(PUNCTUATION))).split(" ")
    return [w for w in (x.strip(".") for x in words) if w]


def _words(text: Column) -> Column:
    blank = F.translate(F.lower(text), PUNCTUATION, " " * len(PUNCTUATION))
    return F.filter(F.transform(F.split(blank, " "), lambda w: F.trim(w, F.lit("."))), lambda w: w != "")


def grams_of(words: list[str], most: int = N_GRAM) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)}


def _grams(words: Column, sizes=range(1, N_GRAM + 1)) -> Column:
    none = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        run = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, run).otherwise(none)

    return F.array_distinct(F.concat(*map(runs, sizes)))


class Model(NamedTuple):
    families: tuple[str, ...]  # the last is UNKNOWN
    grams: tuple[str, ...]
    weights: np.ndarray  # (grams, families)
    bias: np.ndarray
    temperature: float
    threshold: float
    cues: tuple[str, ...]  # the words of which every feature has one


def _variations(line: str, rng: random.Random, filler: list[str], n: int) -> list[list[str]]:
    """A line's words as they are, and with words left out or put in; of a long
    one every other variation is a run of its words, as lines of wrapped texts
    are. (What families have in common then speaks for none of them.)"""
    own = words_of(line)
    out = [own]
    for k in range(n - 1):
        part = own
        if len(own) > 16 and k % 2:
            start = rng.randrange(len(own) - 8)
            part = own[start : start + rng.randrange(8, 17)]
        new = [w for w in part if rng.random() > 0.06] or part
        for _ in range(rng.randrange(0, 5)):
            new.insert(rng.choice([0, len(new), rng.randrange(len(new) + 1)]), rng.choice(filler))
        out.append(new)
    return out


class Samples(NamedTuple):
    """Sparse rows: the features of all rows, one after the other (each row has
    the constant feature, the last), where they begin, and the classes."""

    feature: np.ndarray
    begins: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[set[str], int]], at: dict[str, int]) -> Samples:
        own = [sorted(at[g] for g in grams if g in at) + [len(at)] for grams, _ in rows]
        return cls(np.concatenate([np.array(x) for x in own]), np.cumsum([0, *map(len, own)])[:-1], np.array([y for _, y in rows]))

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.feature], self.begins, axis=0)


def _templates(families: tuple[str, ...]) -> dict[str, str]:
    return {f: t for f, t in TEMPLATES.items() if f in families}


def _lines(families: tuple[str, ...]) -> list[tuple[int, str]]:
    """(class, text) of the texts that the model is fitted to."""
    groups = [*_templates(families).values(), UNLIKE]
    return [(k, x) for k, g in enumerate(groups) for x in g.strip().split("\n")]


def _descend(rows: list[tuple[set[str], int]], at: dict[str, int], n_classes: int, rounds: int, rate: float, sparsity: float) -> np.ndarray:
    """Weights (features and the constant, classes) by gradient steps, each
    followed by a step of size sparsity towards zero."""
    s = Samples.of(rows, at)
    w = np.zeros((len(at) + 1, n_classes), np.float32)
    by_feature = np.argsort(s.feature, kind="stable")
    row = np.repeat(np.arange(len(rows)), np.diff(np.r_[s.begins, len(s.feature)]))[by_feature]
    begins = np.searchsorted(s.feature[by_feature], np.arange(len(at) + 1))
    goal = np.eye(n_classes, dtype=np.float32)[s.y]
    for _ in range(rounds):
        step = (_softmax(s.scores(w)) - goal).astype(np.float32) / len(rows)
        w -= 8 * rate * np.add.reduceat(step[row], begins, axis=0)
        w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - rate * sparsity)
    return w


def _training(rng: random.Random, lines: list[tuple[int, str]], unknown: int, variations: int) -> tuple[list[tuple[set[str], int]], dict[str, int], tuple[str, ...]]:
    """Samples of the lines and of noise, the features (n-grams that have a cue)
    and the cues."""
    noise = ["".join(rng.choices("abdeilnorst", k=rng.randrange(2, 9))) for _ in range(400)]
    filler = sorted({w for _, x in lines for w in words_of(x) if w in STOPS} | set(noise))
    rows = [(grams_of(words), k) for k, x in lines for words in _variations(x, rng, filler, variations * (2 if k == unknown else 1))]
    rows += [(grams_of(rng.choices(filler, k=rng.randrange(1, 30))), unknown) for _ in range(300)]
    cues = {w for k, x in lines if k != unknown for w in words_of(x)} - STOPS
    base = {g for _, x in lines for g in grams_of(words_of(x)) if cues.intersection(g.split(" "))}
    return rows, {g: i for i, g in enumerate(sorted(base))}, tuple(sorted(cues))


@lru_cache(2)
def fit(variations: int = 24, rounds: int = 150, rate: float = 8.0, sparsity: float = 5e-5, precision: float = 0.98, seed: int = 7, without: tuple[str, ...] = ()) -> Model:
    """Fits to variations of the fixed texts, some 7,000 short paragraphs, but
    for the families of `without`, which are unknown to the model then. Texts
    of their own, none of which is fitted to, calibrate: a temperature (least
    log loss), then the lowest probability above which `precision` of what is
    called a license is one, of the right family."""
    families = (*(f for f in TEMPLATES if f not in without), UNKNOWN)
    rows, at, cues = _training(random.Random(seed), _lines(families), len(families) - 1, variations)
    w = np.round(_descend(rows, at, len(families), rounds, rate, sparsity).astype(float), 4)
    kept = [i for i in range(len(at)) if w[i].any()]
    grams = list(at)
    fitted = Model(families, tuple(grams[i] for i in kept), w[kept], w[-1], 1.0, 0.5, cues)
    z, y = held_out_scores(fitted)
    loss = lambda s: -np.log(_softmax(z * s)[np.arange(len(z)), y] + 1e-12).mean()
    scale = min((k / 8 for k in range(1, 33)), key=loss)
    p = _softmax(z * scale)
    p_license, best = p[:, :-1].max(axis=1), p[:, :-1].argmax(axis=1)
    threshold = 0.5
    for t in np.arange(0.3, 1, 0.01):
        called = p_license >= t
        threshold = float(t)
        if called.any() and (best[called] == y[called]).mean() >= precision:
            break
    return fitted._replace(temperature=float(scale), threshold=round(threshold, 2))


def held_out_scores(m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(scores, classes) of the held-out texts, before the temperature."""
    lines = [x.split("|", 1) for x in HELD_OUT.strip().split("\n")]
    at = {g: i for i, g in enumerate(m.grams)}
    s = Samples.of([(grams_of(words_of(x)), m.families.index(f if f in m.families else UNKNOWN)) for f, x in lines], at)
    return s.scores(np.vstack([m.weights, m.bias])), s.y


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _tables(spark: SparkSession, m: Model) -> tuple[DataFrame, DataFrame]:
    """Weights per n-gram, 0 for those that only serve the comparison; n-grams
    of three words per template line. Both are as large as the fixed texts
    (some thousand and 120 rows)."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    texts = _templates(m.families)
    triples = {g for t in texts.values() for x in t.strip().split("\n") for g in _triples(words_of(x))}
    own = list(zip(m.grams, m.weights)) + [(g, np.zeros(len(m.families))) for g in sorted(triples - set(m.grams))]
    rows = ", ".join(f"({quoted(g)}, '{' '.join(f'{x:g}' for x in r) if r.any() else ''}')" for g, r in own)
    weights = spark.sql(f"SELECT gram, IF(w = '', array_repeat(0D, {len(m.families)}), transform(split(w, ' '), x -> double(x))) AS w FROM VALUES {rows} AS t(gram, w)")
    joined = lambda x: quoted("|".join(sorted(x)))
    sure = own_triples(m.families)
    lines = ", ".join(
        f"({quoted(f)}, {quoted(x)}, {joined(_triples(words_of(x)))}, {joined(_triples(words_of(x)) & sure[f])})" for f, t in texts.items() for x in t.strip().split("\n")
    )
    cut = "split({0}, '[|]') AS {0}"
    return weights, spark.sql(f"SELECT family, template, {cut.format('triples')}, {cut.format('sure')} FROM VALUES {lines} AS t(family, template, triples, sure)")


def body(name: str) -> str:
    """A whole license text."""
    return (Path(__file__).parent / "license_bodies" / f"{name}.txt").read_text("utf-8", "replace")


@lru_cache(4)
def own_triples(families: tuple[str, ...] = (*TEMPLATES, UNKNOWN)) -> dict[str, set[str]]:
    """Word triples of a family's templates that neither the templates nor the
    whole texts of other families have; in whole texts those that name the
    family may stand."""
    all_ = {f: {g for x in t.strip().split("\n") for g in _triples(words_of(x))} for f, t in _templates(families).items()}
    bodies = [(f, _triples(words_of(body(name)))) for name, f in BODIES.items() if f in families]
    named = {f: {g for g in own if any(f" {name} " in f" {g} " for name in NAMES.get(f, ()))} for f, own in all_.items()}
    return {f: own.difference(*(x for k, x in all_.items() if k != f), *(x - named[f] for k, x in bodies if k != f)) for f, own in all_.items()}


def _triples(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + N_GRAM]) for i in range(len(words) - N_GRAM + 1)} or {" ".join(words)}


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    likeness: float = 0.6,
    least_triples: int = 8,
    model: Model | None = None,
) -> DataFrame:
    """(id, licenses, passages) for every row of docs; licenses: array of (paragraph,
    family, probability, template, likeness, confirmed), by paragraph (the
    number of the \\n-separated line, from 0), for the paragraphs whose most
    probable family reaches the model's threshold. likeness is 0 unless the paragraph has one of
    own_triples (what the whole texts of other families say too proves nothing);
    then the share of a template's word triples that the paragraph has or, if it
    has least_triples or more, the share of its own that the template has,
    whichever is greater, for the family's template that is most alike; at
    `likeness` or more it confirms the prediction. (So a line of a wrapped
    paragraph is confirmed.)
    passages: the same of the confirmed passages (runs of several lines that
    have a word of the license texts each, joined; paragraph is the number of
    the first) whose family no line of the text confirms.

    Only the two columns are read, so others may have any name. A text without
    such paragraphs, empty or null, has empty arrays; a null id stays null;
    repeated rows are scanned one by one; an empty table gives an empty result.
    Among equal probabilities the family named first in the fixed texts wins,
    among equal likeness the first template in code point order.
    """
    m = model or fit()
    weights, templates = _tables(docs.sparkSession, m)
    cued = lambda s: F.exists(s["words"], lambda w: w.isin(list(m.cues)))  # noqa: E731  a look into a set per word
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.split(F.coalesce(text_col, F.lit("")), "\n").alias("lines"))
    hits = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("paragraph"), _words(x).alias("words"))), cued)

    def shaped(x: Column) -> Column:
        """Lines with a cue, and passages: runs of several such lines."""
        single = F.transform(x, lambda s: F.struct(F.lit(False).alias("joined"), s["paragraph"].alias("paragraph"), s["words"].alias("words")))
        starts = F.filter(F.sequence(F.lit(1), F.size(x)), lambda k: (k == 1) | (x[k - 1]["paragraph"] != x[F.greatest(k - 2, F.lit(0))]["paragraph"] + 1))
        runs = F.transform(F.array(starts), lambda s: F.transform(s, lambda b, j: F.slice(x, b, F.coalesce(F.get(s, j + 1), F.size(x) + 1) - b)))[0]
        joined = lambda r: F.struct(F.lit(True).alias("joined"), r[0]["paragraph"].alias("paragraph"), F.flatten(F.transform(r, lambda s: s["words"])).alias("words"))
        return F.concat(single, F.transform(F.filter(runs, lambda r: F.size(r) > 1), joined))

    # The lines are named once, so that they are cut once.
    named = F.transform(F.array(hits), lambda x: F.when(F.size(x) > 0, shaped(x)))[0]
    some = rows.select("id", "row", F.explode_outer(named).alias("p")).select("id", "row", F.coalesce("p.joined", F.lit(False)).alias("joined"), "p.paragraph", "p.words")
    some = some.withColumn("own", F.size("words") - (N_GRAM - 1))
    # One null stands for the paragraph itself; of its n-grams only those of the table go on.
    own = F.coalesce(_grams(F.col("words")), F.array().cast("array<string>"))
    grams = some.select("id", "row", "joined", "paragraph", "own", F.explode(F.array_append(own, F.lit(None).cast("string"))).alias("gram"))
    k = len(m.families)
    sums = [F.sum(F.col("w")[i]) for i in range(k)]
    scored = (
        grams.join(F.broadcast(weights), "gram", "left").where("gram is null or w is not null").groupBy("id", "row", "joined", "paragraph")
        .agg(F.max("own").alias("n_own"), *(F.coalesce(s, F.lit(0.0)).alias(f"s{i}") for i, s in enumerate(sums)), F.collect_set(F.when(F.size(F.split("gram", " ")) == N_GRAM, F.col("gram"))).alias("triples"))
        .withColumn("z", F.array(*((F.col(f"s{i}") + float(m.bias[i])) * m.temperature for i in range(k))))
        .withColumn("top", F.array_max("z"))
        .withColumn("total", F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top"))))
        .withColumn("own", F.slice("z", 1, k - 1))
        .withColumn("best", F.array_max("own"))
        .withColumn("family", F.element_at(F.array(*map(F.lit, m.families)), F.array_position("own", F.col("best")).cast("int")))
        .withColumn("probability", F.round(F.exp(F.col("best") - F.col("top")) / F.col("total"), 9))
        .withColumn("called", F.col("paragraph").isNotNull() & (F.col("probability") >= m.threshold))
        .withColumn("family", F.when(F.col("called"), F.col("family")))
    )
    both = F.size(F.array_intersect(F.col("s.triples"), F.col("t.triples")))
    alike = F.when(F.arrays_overlap("s.triples", "t.sure"), F.greatest(both / F.size(F.col("t.triples")), F.when(F.col("n_own") >= least_triples, both / F.col("n_own"))))
    compared = (
        scored.select("id", "row", "joined", "paragraph", "family", "probability", "triples", "n_own").alias("s")
        .join(F.broadcast(templates.alias("t")), F.col("s.family") == F.col("t.family"), "left")
        .select("id", "row", "joined", "paragraph", "s.family", "probability", "template", F.coalesce(alike, F.lit(0.0)).alias("alike"))
    )
    found = compared.groupBy("id", "row", "joined", "paragraph").agg(
        F.first("family").alias("family"), F.first("probability").alias("probability"), F.max("alike").alias("likeness"),
        F.min(F.struct(-F.col("alike"), "template"))["template"].alias("template"),
    )
    hit = F.struct("paragraph", "family", "probability", "template", "likeness", (F.col("likeness") >= likeness).alias("confirmed"))
    hits = lambda which: F.sort_array(F.collect_list(F.when(which & F.col("family").isNotNull(), hit)))
    kept = found.groupBy("id", "row").agg(hits(~F.col("joined")).alias("licenses"), hits(F.col("joined") & (F.col("likeness") >= likeness)).alias("passages"))
    sure = F.transform(F.filter("licenses", lambda x: x["confirmed"]), lambda x: x["family"])
    return kept.select(F.col("id").alias(id_col), "licenses", F.filter("passages", lambda x: ~F.array_contains(sure, x["family"])).alias("passages"))


def predict(m: Model, paragraph: str) -> tuple[str, float]:
    """The same for one paragraph on the driver: the most probable family, or
    UNKNOWN below the threshold, and the family's probability."""
    at = {g: i for i, g in enumerate(m.grams)}
    z = sorted(at[g] for g in grams_of(words_of(paragraph)) if g in at)
    p = _softmax((m.weights[z].sum(axis=0) + m.bias)[None] * m.temperature)[0]
    best = int(p[:-1].argmax())
    return (m.families[best] if p[best] >= m.threshold else UNKNOWN), float(p[best])
