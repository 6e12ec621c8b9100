"""What a question says: references, terms, phrases, intents."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.profile import INDONESIAN_LAW, Profile

#: Prefixes by family, the first that fits is taken off; and what a nasal prefix may have swallowed, by how the word begins.
PREFIXES = (("meng", "meny", "men", "mem", "me"), ("peng", "peny", "pen", "pem", "pe"), ("ber", "be", "bel"), ("ter", "te", "tel"), ("di", "ke", "per", "pel"))
SWALLOWED = (("meny", "s"), ("mem", "p"), ("pem", "p"), ("meng", "k"), ("peng", "k"), ("men", "t"), ("pen", "t"))


class Question(NamedTuple):
    article: str | None
    law: str | None
    year: str | None
    titles: tuple[str, ...]  # patterns of the titles that an alias names
    old: bool
    words: tuple[str, ...]
    groups: tuple[tuple[str, ...], ...]  # alternatives for one word of the question
    phrases: tuple[str, ...]
    intents: tuple[int, ...]


def without_suffixes(word: str) -> list[str]:
    base = re.sub(r"(nya|lah|kah|pun)$", "", word)
    inner = re.sub(r"(kan|an|i)$", "", base)
    return [x for x, ok in ((base, base != word), (inner, inner != base and len(inner) >= 4)) if ok]


def stem_variants(word: str) -> list[str]:
    """The word and what may be its stems: without suffixes, without one prefix
    of each family, with each letter that the beginning may have swallowed; of
    four letters or more, each once."""
    found = [word]
    for form in [word, *without_suffixes(word)]:
        for family in PREFIXES:
            prefix = next((p for p in family if form.startswith(p)), None)
            if prefix and len(form) - len(prefix) >= 4:
                root = form[len(prefix) :]
                found += [root, *(x + root for p, x in SWALLOWED if form.startswith(p)), *without_suffixes(root)]
    return list(dict.fromkeys(v for v in found if len(v) >= 4))


def parse_question(text: str, profile: Profile = INDONESIAN_LAW) -> Question:
    """One question in plain Python; tables of them are for parse."""
    low = f" {text.lower()} "
    article = re.search(r"\bpasal\s+(\d+[a-z]?)\b", low)
    law = re.search(r"\b(?:uu|undang[\s-]?undang)\s*(?:no\.?\s*|nomor\s*)?(\d+)\s*(?:tahun\s*(\d{4}))?", low)
    tokens = re.sub(r"[^\w\s]|_", " ", low).split()
    significant = lambda w: len(w) > 3 and w not in profile.stopwords
    groups, phrases = [], []

    def expand(word: str, base: list[str]) -> None:
        members = list(base)
        for other in profile.synonyms.get(word, ()):
            if " " in other:
                phrases.append(other)
                members += [p for p in other.split() if significant(p) and p not in profile.generic_parts]
            else:
                members.append(other)
        groups.append(tuple(dict.fromkeys(members)))

    words = [w for w in tokens if significant(w)]
    for w in words:
        expand(w, [w, *stem_variants(w)])
    for a, b in zip(tokens, tokens[1:]):
        if f"{a} {b}" in profile.synonyms:
            expand(f"{a} {b}", [])
        if significant(a) and significant(b):
            phrases.append(f"{a} {b}")
    return Question(
        article[1] if article else None, law[1] if law else None, law[2] if law else None,
        tuple(t for q, t in profile.aliases if re.search(q, low)), bool(re.search(r"\blama\b|wetboek|\bwvs\b|\b1946\b", low)),
        tuple(words), tuple(g for g in groups if g), tuple(phrases), tuple(i for i, (p, _, _) in enumerate(profile.intents) if re.search(p, low)),
    )


def suffix_stripped(word: Column) -> Column:
    """Array of what is left without a particle and without particle and
    suffix, where either leaves something else; the latter of four letters or
    more."""
    base = F.regexp_replace(word, r"(nya|lah|kah|pun)$", "")
    pair = F.array(F.struct(base.alias("base"), F.regexp_replace(base, r"(kan|an|i)$", "").alias("inner")))
    forms = F.transform(pair, lambda x: F.array(F.when(x["base"] != word, x["base"]), F.when((x["inner"] != x["base"]) & (F.length(x["inner"]) >= 4), x["inner"])))
    return F.array_compact(F.flatten(forms))


def stems(word: Column) -> Column:
    """Array of the word and what may be its stems, each once: without
    suffixes, without one prefix of each family, with each letter that the
    beginning may have swallowed; of four letters or more. Null for null."""

    def rooted(form: Column) -> list[Column]:
        """For each family, an array of at most one (form, root)."""
        found = []
        for family in PREFIXES:
            size = F.coalesce(*(F.when(F.startswith(form, F.lit(p)), len(p)) for p in family))
            fits = F.length(form) - size >= 4
            found.append(F.when(fits, F.array(F.struct(form.alias("form"), F.substring(form, size + 1, F.length(form)).alias("root")))).otherwise(F.expr("array()")))
        return found

    forms = F.concat(F.array(word), suffix_stripped(word))
    roots = F.flatten(F.transform(forms, lambda form: F.concat(*rooted(form))))
    swallowed = lambda x: [F.when(F.startswith(x["form"], F.lit(p)), F.concat(F.lit(letter), x["root"])) for p, letter in SWALLOWED]
    of_roots = F.transform(roots, lambda x: F.concat(F.array_compact(F.array(x["root"], *swallowed(x))), suffix_stripped(x["root"])))
    every = F.concat(F.array(word), F.flatten(of_roots))
    return F.array_distinct(F.filter(every, lambda v: F.length(v) >= 4))


def parse(questions: DataFrame, profile: Profile = INDONESIAN_LAW, qid: str = "qid", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(questions, terms) of a table of questions, by columns alone and without
    a shuffle. questions: (qid, article, law, year, titles, old, words), a row
    for every row given. terms: (qid, kind, place, members, weight) with kind
    group, phrase or intent; weight is given for intents.

    A null text asks nothing. Questions with one id keep their rows, so ids
    should be their own. Columns other than the two don't matter.
    """
    synonyms = F.create_map(*(x for word, others in profile.synonyms.items() for x in (F.lit(word), F.array(*map(F.lit, others))))) if profile.synonyms else F.expr("map('', array(''))")
    stop, generic = F.array(*map(F.lit, profile.stopwords)), F.array(*map(F.lit, profile.generic_parts))
    significant = lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w)
    others = lambda w: F.coalesce(synonyms[w], F.expr("cast(array() as array<string>)"))
    parts = lambda o: F.when(F.contains(o, F.lit(" ")), F.filter(F.split(o, " "), lambda p: significant(p) & ~F.array_contains(generic, p))).otherwise(F.array(o))
    expanded = lambda w: F.flatten(F.transform(others(w), parts))
    spoken = lambda w: F.filter(others(w), lambda o: F.contains(o, F.lit(" ")))
    group = lambda pattern, i: F.nullif(F.regexp_extract("low_", pattern, i), F.lit(""))
    law = r"\b(?:uu|undang[\s-]?undang)\s*(?:no\.?\s*|nomor\s*)?(\d+)\s*(?:tahun\s*(\d{4}))?"
    fitting = lambda rows: F.array_compact(F.array(*(F.when(F.rlike("low_", F.lit(p)), value) for p, value in rows)))

    low = questions.select(F.col(qid).alias("qid"), F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" ")).alias("low_"))
    tokens = low.withColumn("tokens_", F.filter(F.split(F.regexp_replace("low_", r"[^\p{L}\p{N}\s]", " "), r"(?U)\s+"), lambda w: w != ""))
    pairs = F.filter(F.arrays_zip(F.slice("tokens_", 1, F.greatest(F.size("tokens_") - 1, F.lit(0))).alias("a"), F.slice("tokens_", 2, F.greatest(F.size("tokens_") - 1, F.lit(0))).alias("b")), lambda x: x["b"].isNotNull())
    cut = tokens.select(
        "qid", "low_", F.filter("tokens_", significant).alias("words_"),
        F.transform(pairs, lambda x: F.struct(F.concat_ws(" ", x["a"], x["b"]).alias("pair"), (significant(x["a"]) & significant(x["b"])).alias("both"))).alias("pairs_"),
    )
    asked = cut.select(
        "qid", group(r"\bpasal\s+(\d+[a-z]?)\b", 1).alias("article"), group(law, 1).alias("law"), group(law, 2).alias("year"),
        fitting([(q, F.lit(t)) for q, t in profile.aliases]).alias("titles") if profile.aliases else F.expr("cast(array() as array<string>)").alias("titles"),
        F.rlike("low_", F.lit(r"\blama\b|wetboek|\bwvs\b|\b1946\b")).alias("old"), F.col("words_").alias("words"),
    )
    of_word = F.transform("words_", lambda w: F.array_distinct(F.concat(stems(F.when(F.length(w) > 0, w)), expanded(w))))
    of_pair = F.transform("pairs_", lambda x: F.array_distinct(expanded(x["pair"])))
    groups = F.filter(F.concat(of_word, of_pair), lambda g: F.size(g) > 0)
    phrases = F.concat(F.flatten(F.transform("words_", spoken)), F.flatten(F.transform("pairs_", lambda x: F.concat(spoken(x["pair"]), F.when(x["both"], F.array(x["pair"])).otherwise(F.expr("cast(array() as array<string>)"))))))
    intents = fitting([(p, F.struct(F.array(*map(F.lit, markers)).alias("members"), F.lit(float(w)).alias("weight"))) for p, markers, w in profile.intents]) if profile.intents else F.expr("cast(array() as array<struct<members:array<string>,weight:double>>)")
    term = lambda kind, members, weight: F.struct(F.lit(kind).alias("kind"), members.alias("members"), weight.alias("weight"))
    none = F.lit(None).cast("double")
    kinds = (
        F.transform(groups, lambda g: term("group", g, none)), F.transform(phrases, lambda p: term("phrase", F.array(p), none)),
        F.transform(intents, lambda x: term("intent", x["members"], x["weight"])),
    )
    placed = F.concat(*(F.transform(k, lambda t, i: F.struct(t["kind"].alias("kind"), i.alias("place"), t["members"].alias("members"), t["weight"].alias("weight"))) for k in kinds))
    return asked, cut.select("qid", F.inline(placed))


def frames(spark: SparkSession, questions: dict[int, str], profile: Profile = INDONESIAN_LAW) -> tuple[DataFrame, DataFrame]:
    """parse of a few stated questions."""
    rows = spark.createDataFrame(list(questions.items()), "qid int, text string")
    return parse(rows, profile)


def valid_question(text: Column, top_k: Column) -> Column:
    return F.coalesce(F.length(text).between(3, 4000) & top_k.between(1, 20), F.lit(False))
