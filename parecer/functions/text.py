"""Column expressions for review text; all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parecer.functions import fixed_values as fv

# Each accented letter the cleaner keeps, and its plain form.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùú"
PLAIN = "aaaaaaceeeeiiiinooooouu"


def _lowered(text: Column, strip_accents: bool) -> Column:
    """Lower case without URLs; null gives ''."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), fv.URL_PATTERN, " ")
    return F.translate(out, ACCENTED, PLAIN) if strip_accents else out


def clean_text(text: Column, strip_accents: bool = False) -> Column:
    """Lower case, URLs out, runs of anything but letters to one blank; null gives ''."""
    return F.regexp_replace(_lowered(text, strip_accents), fv.NON_LETTER_PATTERN, " ")


def words(text: Column, strip_accents: bool = False) -> Column:
    """Words of a raw text in order, as cleaning and splitting would give them; one pass
    over the text, which may leave an empty word at either end."""
    return F.split(_lowered(text, strip_accents), fv.NON_LETTER_PATTERN)


def keep_word(word: Column, stopwords: Sequence[str]) -> Column:
    """Longer than two letters and not a stopword."""
    return (F.length(word) > 2) & ~word.isin(*stopwords)


def tokenize(text: Column, stopwords: Sequence[str], strip_accents: bool = False) -> Column:
    """Kept words of a raw text, repeats included."""
    return F.filter(words(text, strip_accents), lambda w: keep_word(w, stopwords))


def vector_words(cleaned: Column) -> Column:
    """Words as a document-term matrix counts them: '÷' parts words, single letters go."""
    return F.filter(F.split(cleaned, "[ ÷]+"), lambda w: F.length(w) > 1)


def with_bigrams(tokens: Column) -> Column:
    """The words, then each pair of neighbours joined by a blank."""
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(tokens, pairs)
