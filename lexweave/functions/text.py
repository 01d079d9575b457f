"""Text normalisation, tokens and small text functions as column expressions.

Only what Spark lacks (Unicode forms, dropping of combining marks) runs in
Arrow batches; everything else stays in the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
ROWS = 256


@dataclass(frozen=True)
class TextNorm:
    """How text is normalised before it is cut into tokens.

    ``assume_form`` says that the text has ``unicode_form`` already, so that
    the step is left out.
    """

    strip_case: bool = True
    strip_accents: bool = False
    unicode_form: str | None = "NFC"
    strip_punctuation: bool = True
    punctuation_to_space: bool = True
    normalize_whitespace: bool = True
    strip_whitespace: bool = False
    assume_form: bool = False

    def __post_init__(self) -> None:
        if self.unicode_form is not None and self.unicode_form not in FORMS:
            raise ValueError(f"unicode_form must be one of {FORMS} or None: {self.unicode_form!r}")

    @classmethod
    def from_dict(cls, options: Mapping[str, Any]) -> TextNorm:
        known = {f.name for f in fields(cls)}
        if unknown := set(options) - known:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return cls(**options)

    def with_(self, **changes: Any) -> TextNorm:
        return replace(self, **changes)


def _each(text: Column, change) -> Column:
    """``change`` for each text that isn't plain ASCII, in Arrow batches, of which a few rows at a time are Python strings."""

    @F.arrow_udf("string")
    def run(t: pa.Array) -> pa.Array:
        parts = [pa.array([x if x is None or x.isascii() else change(x) for x in t.slice(i, ROWS).to_pylist()], pa.string()) for i in range(0, len(t), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run(text)


def unicode_form(text: Column, form: str) -> Column:
    """``text`` in a Unicode normal form."""
    return _each(text, lambda x: unicodedata.normalize(form, x))


def without_marks(text: Column, form: str | None = "NFC") -> Column:
    """``text`` without combining marks, in ``form``."""
    return _each(text, lambda x: strip_diacritics(x, form or "NFC"))


def strip_diacritics(word: str, target_form: str = "NFC") -> str:
    """The same for one Python string."""
    bare = "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize(target_form, bare)


def normalised(text: Column, norm: TextNorm) -> Column:
    """The normalised text: form, punctuation, white space, case, accents, in this order."""
    if norm.unicode_form and not norm.assume_form:
        text = unicode_form(text, norm.unicode_form)
    if norm.strip_punctuation:
        text = F.regexp_replace(text, r"\p{P}+", " " if norm.punctuation_to_space else "")
    if norm.normalize_whitespace:
        text = F.regexp_replace(text, r"(?U)\s+", " ")
    elif norm.strip_whitespace:
        text = F.regexp_replace(text, r"(?U)\s+", "")
    if norm.strip_case:
        text = F.lower(text)
    if norm.strip_accents:
        text = without_marks(text, norm.unicode_form)
    return text


def split_tokens(text: Column) -> Column:
    """Tokens of a normalised text."""
    return F.filter(F.split(text, r"(?U)\s"), lambda x: x != "")


def raw_tokens(text: Column) -> Column:
    """Tokens of a text that wasn't normalised: runs of letters, marks, digits and underscores, and single signs."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_])"), F.lit(1))


def normalize_node(node: str, norm: TextNorm) -> str:
    """A node in the form that its tokens have; punctuation stays."""
    out = []
    for word in node.split():
        if norm.unicode_form:
            word = unicodedata.normalize(norm.unicode_form, word)
        if norm.strip_case:
            word = word.lower()
        if norm.strip_accents:
            word = strip_diacritics(word, norm.unicode_form or "NFC")
        out.append(word)
    return " ".join(out)


def split_ngram(node: str) -> list[str]:
    return node.split()


def ngram_length(node: str) -> int:
    return len(node.split())


def is_single_word(node: str) -> bool:
    return ngram_length(node) == 1


def ngram_positions(tokens: Column, node: str) -> Column:
    """0-based starts of all matches of the n-gram, which may overlap."""
    words = split_ngram(node)

    def at(k: int, word: str) -> Column:  # the tokens stand outside of the lambda, where they are evaluated once
        starts = F.transform(tokens, lambda x, i: F.when(x == word, i - k))
        return F.filter(starts, lambda i: i.isNotNull() & (i >= 0))

    out = at(0, words[0])
    for k, word in enumerate(words[1:], 1):
        out = F.array_intersect(out, at(k, word))
    return out


def ngram_contexts(tokens: Column, node: str, window: int) -> Column:
    """``left``, ``right``: the tokens within ``window`` of the edges of each match."""
    n = ngram_length(node)
    return F.transform(
        ngram_positions(tokens, node),
        lambda p: F.struct(
            p.alias("position"),
            F.slice(tokens, F.greatest(p - window, F.lit(0)) + 1, F.least(p, F.lit(window))).alias("left"),
            F.slice(tokens, p + n + 1, F.lit(window)).alias("right"),
        ),
    )


def prior_words(tokens: Column, word: str, window: int) -> Column:
    """Different tokens within ``window`` before any occurrence of ``word``, in order of the alphabet."""
    return _around(tokens, word, lambda p: (F.greatest(p - window, F.lit(0)) + 1, F.least(p, F.lit(window))))


def following_words(tokens: Column, word: str, window: int) -> Column:
    """Different tokens within ``window`` after any occurrence of ``word``, in order of the alphabet."""
    return _around(tokens, word, lambda p: (p + 2, F.lit(window)))


def _around(tokens: Column, word: str, span) -> Column:
    parts = F.transform(ngram_positions(tokens, word), lambda p: F.slice(tokens, *span(p)))
    return F.array_sort(F.array_distinct(F.flatten(parts)))


def count_word(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == word))


def count_substrings(text: Column, parts: str | Iterable[str]) -> Column:
    """Matches of a literal string that don't overlap; for several strings their sum."""
    parts = [parts] if isinstance(parts, str) else list(parts)
    counts = [F.regexp_count(text, F.lit("\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E")) for p in parts if p]
    total = F.lit(0)
    for c in counts:
        total = total + c
    return total


#: languages that Spark has no list for
MORE_STOPWORDS = {
    "greek": "ο η το οι τα του της των τον την και κι κ να σε με για από στο στη στην στον στους στις στα ως ότι που θα δεν μη μην ή αν αλλά είναι ήταν έχει έχουν ένα ένας μια μία αυτό αυτή αυτός όπως πιο πολύ πριν μετά".split(),
}
CODES = {"en": "english", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "pt": "portuguese", "nl": "dutch", "ru": "russian", "el": "greek"}


def stopwords(language: str | None) -> list[str]:
    """Stopwords of a language by name or two-letter code; none for one that has no list.  Words with an apostrophe are given as the parts that tokens have."""
    if language is None:
        return []
    name = CODES.get(language.lower(), language.lower())
    if name in MORE_STOPWORDS:
        words = MORE_STOPWORDS[name]
    else:
        try:
            words = StopWordsRemover.loadDefaultStopWords(name)
        except Exception:
            return []
    parts = {p for w in words for p in [w, *w.replace("'", " ").split()]}
    return sorted(p.lower() for p in parts if p)


def stopword_support(languages: Iterable[str]) -> dict[str, int]:
    """Number of stopwords of each language."""
    return {x: len(stopwords(x)) for x in languages}


def for_stopwords(text: Column, language: str | None) -> Column:
    """The form in which a token is looked up in a stopword list."""
    greek = language is not None and CODES.get(language.lower(), language.lower()) == "greek"
    return F.lower(without_marks(text)) if greek else F.lower(text)
