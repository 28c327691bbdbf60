"""Text functions as columns: tokens, words, white space, repeats, redaction, language, sensitivity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequent function words, by language, for telling languages apart.
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "is", "that", "it", "for", "with", "was"],
    "de": ["der", "die", "und", "das", "nicht", "mit", "von", "ist", "ein", "zu"],
    "fr": ["le", "la", "les", "des", "et", "est", "une", "que", "dans", "pour"],
    "es": ["el", "los", "las", "del", "para", "por", "con", "una", "como", "su"],
}
# What a redaction looks for, in the order in which it is applied.
REDACTIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "phone": r"\+[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "card": r"\b[0-9]{16}\b",
    "secret": r"\b[0-9a-f]{40}\b",
}
SENSITIVE = [r"\bmy (name|address|password|account)\b", r"\b(as i|you) (said|mentioned)\b", r"\b(above|earlier|previous(ly)?)\b", r"\bthis (file|code|error)\b", r"\b(our|my) (project|repo|app)\b"]


def count_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one unless empty."""
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("bigint")


def words(text: Column, least: int = 3) -> Column:
    """Distinct lower-case words of at least ``least`` characters, in order of first use."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= least))


def overlap(question: list[str], own: Column) -> Column:
    return F.size(F.array_intersect(F.array(*map(F.lit, question)), own)) / max(1, len(question))


def squeeze(text: Column) -> Column:
    """Runs of spaces and tabs as one space, three or more newlines as two, outer white space off."""
    out = F.regexp_replace(text, "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def redact(text: Column) -> Column:
    for name, pattern in REDACTIONS.items():
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def redaction_counts(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)).cast("bigint").alias(f"n_{name}") for name, p in REDACTIONS.items()]


def language_scores(text: Column) -> list[Column]:
    return scores_of_words(language_words(text))


def language_words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def scores_of_words(parts: Column) -> list[Column]:
    """Of a text's words, how many are function words of each language."""

    def count(own: list[str]) -> Column:
        return F.size(F.filter(parts, lambda w: w.isin(*own))).cast("bigint")

    return [count(own).alias(f"n_{lang}") for lang, own in FUNCTION_WORDS.items()]


def is_sensitive(text: Column, longest: int = 800) -> Column:
    """Whether an answer may depend on its session: it points back, names its owner, or is a long pasted block."""
    hit = F.lit(False)
    for pattern in SENSITIVE:
        hit = hit | F.lower(text).rlike(pattern)
    return hit | ((F.length(text) > longest) & (text.contains("\n") | text.contains("```")))


def normal_label(label: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(label)), r"[.,!?]+$", "")


def node_key(kind: Column, label: Column) -> Column:
    return F.substring(F.sha1(F.concat(kind, F.lit(":"), normal_label(label))), 1, 12)
