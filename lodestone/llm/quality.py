"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's shares of character classes and of common words are compared with references of the languages by
Jensen-Shannon distance (base 2, 0 to 1). A reference is the mean of the shares over all documents of that
language which pass the base rules and the length guard, so one long text weighs no more than another. A
document is judged by its nearest language for either distribution; a distance beyond the limit rejects it.
Guards: either comparison waits for a minimum length and lets shorter texts pass. Where a language has no
reference (no such document), it is left out; without any reference the divergence rules let all pass.

Every row gives one result, whatever its doc_id, and extra columns don't matter. A null text is an empty one;
empty texts fail the base rule on word counts. A lang that isn't one of the four gives no reference, and its
rows are judged by character classes alone; where lang is null the nearest language decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _store

# Frequent function words of the four languages of the documents.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "que", "pour"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las"],
}
WORDS = list(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))
LANGUAGES = tuple(COMMON_WORDS)

#: Classes of characters besides white space, lower-case ASCII letters and, last, the few other characters.
CLASSES = {"upper": "A-Z", "digit": "0-9", "stop": ".,;:!?'\"()-", "symbol": "#*$%&|<>", "wide": r"\x{80}-\x{10FFFF}"}
N_CLASSES = len(CLASSES) + 3

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50  #: base rule
    repeat_percent: int = 50  #: base rule, of words in repeated 3-word windows
    class_distance: float = 0.28
    class_guard: int = 200  #: characters from which the character classes are compared
    word_distance: float = 0.28
    word_guard: int = 100  #: words from which the common words are compared
    joint: tuple[float, float] = (0.12, 0.205)  #: both distances beyond these reject as well


LIMITS = Limits()


def _letters() -> list[str]:
    """A character for each common word."""
    return [chr(0x100 + k) for k in range(len(WORDS))]


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_letters (long), classes and commons (shares)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    code = F.create_map(*[F.lit(x) for pair in zip(WORDS, _letters(), strict=True) for x in pair])

    # a lambda over a one-element array binds a value, so that it is computed once
    def of_words(w: Column) -> Column:
        coded = F.array_join(F.transform(F.filter(w, lambda x: x.isin(*WORDS)), lambda x: F.element_at(code, x)), "")
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"), _word_shares(coded, F.size(w)).alias("commons"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = F.element_at(F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")), 1)
    # most characters are lower-case letters and spaces; the rest is short, and all other counts come from it
    rest = F.element_at(F.transform(F.array(F.regexp_replace(text, r"[a-z\x20]+", "")), lambda r: _of_rest(text, r)), 1)
    return (
        docs.withColumn("_words", F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), of_words), 1))
        .withColumn("_rest", rest)
        .withColumn("n_dup_lines", dup)
        .select("*", "_words.*", "_rest.*")
        .drop("_words", "_rest")
    )


def _repeated(w: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more. Windows are compared by 64-bit hashes."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def repeats(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(F.element_at(F.transform(F.array(order), covered), 1))

    def covered(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        at = F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(at)).cast("long")

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(F.element_at(F.transform(F.array(hashes), repeats), 1))


def _of_rest(text: Column, rest: Column) -> Column:
    """Counts of characters, and the shares of their classes."""
    length = F.length(text)
    spaces = length - F.length(F.replace(text, F.lit(" "), F.lit(""))) + F.length(F.regexp_replace(rest, r"[^\x09-\x0D]+", ""))
    counts = [F.length(F.regexp_replace(rest, f"[^{inside}]+", "")) for inside in CLASSES.values()]
    total = F.greatest(length, F.lit(1)).cast("double")

    def named(c: Column) -> Column:
        known = c[1]
        for k in range(2, len(CLASSES) + 1):
            known = known + c[k]
        others = F.length(F.regexp_replace(rest, r"[\x09-\x0D]+", "")) - known
        lower = length - c[0] - known - others
        shares = F.array(*[c[k] / total for k in range(len(CLASSES) + 1)], lower / total, others / total)
        symbols = c[1 + list(CLASSES).index("symbol")]
        return F.struct((length - c[0]).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), length.cast("long").alias("n_letters"), shares.alias("classes"))

    return F.element_at(F.transform(F.array(F.array(spaces, *counts)), named), 1)


def _word_shares(coded: Column, n: Column) -> Column:
    total = F.greatest(n, F.lit(1)).cast("double")

    def each(s: Column) -> Column:
        counts = F.array(*[F.length(s) - F.length(F.replace(s, F.lit(c), F.lit(""))) for c in _letters()])
        return F.concat(F.transform(counts, lambda x: x / total), F.array(1.0 - F.length(s) / total))

    return F.element_at(F.transform(F.array(coded), each), 1)


#: Columns that ``judged`` adds.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "classes", "commons", "class_distance", "word_distance", "base_failed", "kept")


def base_failed(limits: Limits = LIMITS) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))


def references(measured: DataFrame, limits: Limits = LIMITS) -> dict[str, dict[str, list[float]]]:
    """Mean shares by language, over all measured documents; as many numbers as languages and classes, so the driver may hold them."""
    sizes = {"classes": N_CLASSES, "commons": len(WORDS) + 1}
    sums = [F.avg(F.col(name)[k]).alias(f"{name}_{k}") for name, n in sizes.items() for k in range(n)]
    able = measured.where(F.col("lang").isin(*LANGUAGES) & ~base_failed(limits) & (F.col("n_words") >= limits.word_guard))
    rows = able.groupBy("lang").agg(*sums).collect()
    return {r["lang"]: {name: [r[f"{name}_{k}"] for k in range(n)] for name, n in sizes.items()} for r in rows}


def _distance(shares: str, reference: list[float]) -> Column:
    """Jensen-Shannon distance: entropy of the mean less the mean entropy, to the power one half."""

    def entropy(x: Column) -> Column:
        return F.when(x > 0, -x * F.log2(x)).otherwise(0.0)

    q = F.array(*[F.lit(float(x)) for x in reference])
    terms = F.zip_with(F.col(shares), q, lambda p, q: entropy((p + q) / 2) - entropy(p) / 2 - entropy(q) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def verdicts(measured: DataFrame, refs: dict[str, dict[str, list[float]]], limits: Limits = LIMITS) -> DataFrame:
    """Measured documents with class_distance, word_distance, base_failed and kept."""
    nearest = {"classes": F.lit(0.0), "commons": F.lit(0.0)}
    if refs:
        for name in nearest:
            each = [_distance(name, r[name]) for _, r in sorted(refs.items())]
            nearest[name] = F.least(*each) if len(each) > 1 else each[0]
    out = measured.withColumn("class_distance", nearest["classes"]).withColumn("word_distance", nearest["commons"])
    of_class, of_words = F.col("class_distance"), F.col("word_distance")
    far = (F.col("n_letters") >= limits.class_guard) & (of_class > limits.class_distance)
    both = (of_class > limits.joint[0]) & (of_words > limits.joint[1])
    # a language without reference can't be told from noise by its words
    known = F.col("lang").isNull() | F.col("lang").isin(*LANGUAGES)
    far = far | known & (F.col("n_words") >= limits.word_guard) & ((of_words > limits.word_distance) | both)
    return out.withColumn("base_failed", base_failed(limits)).withColumn("kept", ~F.col("base_failed") & ~far)


def judged(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """All columns of docs but text, and the measures and verdict of each row; columns of docs named like those are left out.

    The texts are read once: their measures are written to the shared folder, and references and verdicts come
    from there.
    """
    measured = _store.staged(measures(docs.drop(*RESULTS)).drop("text"), "quality")
    return verdicts(measured, references(measured, limits), limits)


def kept(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"), F.col("lang"))
    return judged(own, limits).where("kept").select("_row.*")
