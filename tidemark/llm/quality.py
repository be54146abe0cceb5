"""Quality rules, native: word and repetition counts, and the divergence from language references.

Everything is a DataFrame expression, without a shuffle of texts: one pass measures each text, the references (two small
histograms a language, so bounded) are added up from the measures and enter the verdict as literals.

References come from all documents that pass the base rules, since lines repeated thousandfold and scraps would shift
them. The histogram of n words or characters strays from its reference by chance, by about 1 / sqrt(n), so that the
limits fall with the length. A text in several languages is no junk: its words are also compared with the mixture of
references that its common words tell, and the nearer of the two counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Common words of each language.
COMMON = {
    "de": ["der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "ist", "des", "ein", "nicht", "dem"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on", "are", "with"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "con", "una"],
    "fr": ["le", "la", "les", "et", "des", "du", "un", "une", "que", "dans", "est", "au", "qui", "pour"],
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
#: White space as a class in regular expressions.
BLANK = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits. The distances are Jensen-Shannon distances (square root of the divergence in bits, 0 to 1)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: The limit of a distance is floor + spread / sqrt(n), at n words or n characters in words.
    char_floor: float = 0.15
    char_spread: float = 2.5
    word_floor: float = 0.08
    word_spread: float = 2.2
    #: Below so many words (characters in words) the word (character) histogram isn't judged.
    word_guard: int = 60
    char_guard: int = 300
    languages: tuple[str, ...] = field(default_factory=lambda: tuple(sorted(COMMON)))


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def measure(docs: DataFrame) -> DataFrame:
    """Adds _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _chars (counts of lower case, other
    letters' upper case, digits, symbols and other characters in words) and _common (each common word, then the rest)."""
    text, cased = F.coalesce(F.col("text"), F.lit("")), [*WORDS, *(w.capitalize() for w in WORDS), *(w.upper() for w in WORDS)]
    docs = docs.withColumn("_words", F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != ""))
    docs = docs.withColumns(
        {
            "_joined": F.array_join("_words", ""),
            "_padded": F.concat(F.lit(" "), F.lower(F.array_join(F.filter("_words", lambda w: w.isin(cased)), "  ")), F.lit(" ")),
            "_n_words": F.size("_words").cast("long"),
            "_n_repeat_words": repeated_words(F.col("_words")).cast("long"),
            "_n_dup_lines": let(F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{BLANK}]"))), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    size = F.length("_joined")
    docs = docs.withColumns({"_word_chars": size.cast("long"), **{c: (size - F.length(F.regexp_replace("_joined", pattern, ""))).cast("long") for c, pattern in (("_letters", r"\p{L}+"), ("_upper", r"\p{Lu}+"), ("_digits", r"\p{N}+"), ("_n_symbols", f"[{SYMBOLS}]+"))}})
    docs = docs.withColumn("_found", F.array(*(((F.length("_padded") - F.length(F.replace("_padded", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in WORDS)))
    chars = F.array(F.col("_letters") - F.col("_upper"), "_upper", "_digits", "_n_symbols", F.col("_word_chars") - F.col("_letters") - F.col("_digits") - F.col("_n_symbols"))
    common = F.concat("_found", F.array(F.col("_n_words") - F.aggregate("_found", F.lit(0).cast("long"), lambda a, x: a + x)))
    return docs.withColumns({"_chars": chars, "_common": common}).drop("_words", "_joined", "_padded", "_letters", "_upper", "_digits", "_found")


def base_failed(rules: Rules) -> Column:
    """Too few words, or too many of them in repeated windows; of measured documents."""
    return (F.col("_n_words") < rules.min_words) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * rules.max_repeat_percent)


def references(measured: DataFrame, rules: Rules) -> dict[str, tuple[list[int], list[int]]]:
    """The histograms of all documents of each language that pass the base rules, and of all under "" for other or null
    languages.

    One row a language: at most ``len(rules.languages) + 1`` rows reach the driver.
    """
    n = len(WORDS) + 1
    lang = F.when(F.col("lang").isin(*rules.languages), F.col("lang")).otherwise("").alias("_lang")
    rows = measured.filter(~base_failed(rules)).groupBy(lang).agg(*(F.sum(F.col("_chars")[i]).alias(f"c{i}") for i in range(5)), *(F.sum(F.col("_common")[i]).alias(f"w{i}") for i in range(n))).collect()
    found = {r["_lang"]: ([r[f"c{i}"] for i in range(5)], [r[f"w{i}"] for i in range(n)]) for r in rows}
    every = tuple([sum(x) for x in zip(*(v[k] for v in found.values()), strict=True)] or [0] * (5, n)[k] for k in (0, 1))
    return {k: v for k, v in found.items() if k} | {"": every}


def mixture(common: Column, languages: list[list[float]]) -> Column:
    """The mixture of word distributions that the common words of a text tell, or null if it has none.

    A language's share is that of the words typical of it (each common word counts for a language by the language's part
    of the word's frequencies), over the share that common words have in the language.
    """
    totals = [sum(q[i] for q in languages) for i in range(len(WORDS))]
    shares = []
    for q in languages:
        rate = sum(q[:-1])
        typical = F.array(*(F.lit(q[i] / totals[i] / rate if totals[i] and rate else 0.0) for i in range(len(WORDS))))
        shares.append(F.aggregate(F.zip_with(F.slice(common, 1, len(WORDS)), typical, lambda c, t: c * t), F.lit(0.0), lambda a, x: a + x))

    def scaled(q: list[float], by: Column) -> Column:
        return F.transform(F.array(*map(F.lit, q)), lambda x: x * by)

    def mixed(w: Column) -> Column:
        total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
        parts = [scaled(q, w[k] / total) for k, q in enumerate(languages)]
        return F.when(total > 0, reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts))

    return let(F.array(*shares), mixed)


def js_distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a histogram from a reference distribution; 0 if either is empty."""

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    terms = F.zip_with(counts, reference, lambda c, q: let(c / total, lambda p: let((p + q) / 2, lambda m: part(p, m) + part(q, m))))
    return F.when(total > 0, F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))).otherwise(0.0)


def _distribution(counts: list[int]) -> Column:
    total = sum(counts)
    return F.array(*(F.lit(c / total if total else 0.0) for c in counts))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that a text holds twice or more, the first of them included.

    Windows are told apart by a 64-bit hash of their words. They are sorted, so that equal ones are neighbours; places
    of those with an equal neighbour are spread to three words each and counted once.
    """

    def count(windows: Column) -> Column:
        def spread(ordered: Column) -> Column:
            same = F.filter(ordered, lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["w"] == x["w"])) | F.coalesce(F.get(ordered, i + 1)["w"] == x["w"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), spread))

    windows = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, count))


def judge(docs: DataFrame, rules: Rules = Rules(), texts: bool = True) -> DataFrame:
    """``docs`` with its measures, _char_distance, _word_distance, _base_failed and _kept.

    Needs text and lang; all new names start with an underscore. A null or empty text has no word and fails; a null or
    unknown language is compared with all documents together. Rows are judged one by one (repeated ones alike); an
    empty table gives an empty result. Without ``texts`` the column text is left out. The measures are written to the
    shared folder once, since the references need all of them before the first verdict.
    """
    measured = measure(docs)
    docs = Scratch(docs.sparkSession).keep(measured if texts else measured.drop("text"), "measured")
    refs = references(docs, rules)

    def of(k: int) -> Column:
        pick = F.when(F.lit(False), F.lit(None).cast("array<double>"))
        for lang, hist in refs.items():
            if lang:
                pick = pick.when(F.col("lang") == lang, _distribution(hist[k]))
        return pick.otherwise(_distribution(refs[""][k]))

    word = js_distance(F.col("_common"), F.col("_n_words"), of(1))
    known = [[c / sum(hist[1]) for c in hist[1]] for lang, hist in refs.items() if lang and sum(hist[1])]
    if known:
        # least() passes over a null
        word = F.least(word, let(mixture(F.col("_common"), known), lambda q: F.when(q.isNotNull(), js_distance(F.col("_common"), F.col("_n_words"), q))))
    docs = docs.withColumns({"_char_distance": js_distance(F.col("_chars"), F.col("_word_chars"), of(0)), "_word_distance": word, "_base_failed": base_failed(rules)})
    far = [(F.col(n) >= guard) & (F.col(distance) > floor + spread / F.sqrt(n)) for n, distance, guard, floor, spread in (("_word_chars", "_char_distance", rules.char_guard, rules.char_floor, rules.char_spread), ("_n_words", "_word_distance", rules.word_guard, rules.word_floor, rules.word_spread))]
    return docs.withColumn("_kept", ~F.col("_base_failed") & ~far[0] & ~far[1])


def filter_quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    return judge(docs, rules).filter("_kept").select(*docs.columns)


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs, texts=False).select("doc_id", *(F.col(f"_{n}").alias(n) for n in names))
