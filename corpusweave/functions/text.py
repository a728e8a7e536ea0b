"""Text cleaning as column expressions: no shuffle, no Python worker."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.functions.stopwords import ENGLISH

# The 32 ASCII punctuation marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Every character that counts as white space in Unicode text, spelled out as a regex
# class for engines without the property.
WHITESPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same class for Java, which tests the Unicode property three times faster than the list.
SPACES = r"(?U)[\s\x1c-\x1f]+"
BLANK = r"(?U)^[\s\x1c-\x1f]*$"
NOT_SPACES = r"[^\s\x1c-\x1f]+"

URL = r"https?://"

# A term is a run of two or more letters, digits or underscores.
TERM = r"[\p{L}\p{N}_]{2,}"

# Above this a literal map in the plan costs more than a join with a lemma table.
MAX_LITERAL_LEMMAS = 500


def blank_to_empty(text: Column) -> Column:
    """Null, empty and whitespace-only text become the empty string."""
    return F.when(text.isNull() | text.rlike(BLANK), F.lit("")).otherwise(text)


def null_to_empty(text: Column) -> Column:
    """Null becomes the empty string; whitespace is kept."""
    return F.coalesce(text, F.lit(""))


def lowercase(text: Column) -> Column:
    return F.lower(text)


def strip_punct(text: Column) -> Column:
    """Delete ASCII punctuation without leaving a gap: ``don't`` becomes ``dont``."""
    return F.translate(text, PUNCTUATION, "")


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def tokenize_ws(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda token: token != "")


def lemmatize(tokens: Column, lemmas: Mapping[str, str]) -> Column:
    """Replace tokens found in a small form-to-lemma mapping.

    Larger dictionaries go through :func:`corpusweave.operators.lemmas.lemmatize_by_table`.
    """
    if len(lemmas) > MAX_LITERAL_LEMMAS:
        raise ValueError(
            f"{len(lemmas)} lemmas are too many for a literal map; join a lemma table instead"
        )
    if not lemmas:
        return tokens
    entries = [F.lit(part) for pair in lemmas.items() for part in pair]
    table = F.create_map(*entries)
    return F.transform(tokens, lambda token: F.coalesce(F.element_at(table, token), token))


def remove_stopwords(tokens: Column, stopwords: Sequence[str] = ENGLISH) -> Column:
    """Drop stopwords (case-sensitive), keeping order and repeats of the rest."""
    words = list(stopwords)
    if not words:
        return tokens
    return F.filter(tokens, lambda token: ~token.isin(words))


def truncate_tokens(tokens: Column, limit: int = -1) -> Column:
    """Keep the first ``limit`` tokens; -1 keeps all."""
    if limit < -1:
        raise ValueError("token_limit must be -1 (keep all) or at least 0")
    return tokens if limit == -1 else F.slice(tokens, 1, limit)


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def standard_tokens(
    text: Column, *, lower: bool = True, remove_punctuation: bool = True
) -> Column:
    """Cleaning that comes before lemmas and stopwords."""
    cleaned = blank_to_empty(text)
    if lower:
        cleaned = lowercase(cleaned)
    if remove_punctuation:
        cleaned = strip_punct(cleaned)
    return tokenize_ws(cleaned)


def finish_tokens(
    tokens: Column, *, stopwords: Sequence[str] | None = ENGLISH, token_limit: int = -1
) -> Column:
    """Stopwords out, then truncate, then one string again."""
    if stopwords is not None:
        tokens = remove_stopwords(tokens, stopwords)
    return join_tokens(truncate_tokens(tokens, token_limit))


def standard_preprocess(
    text: Column,
    *,
    lower: bool = True,
    remove_punctuation: bool = True,
    lemmas: Mapping[str, str] | None = None,
    stopwords: Sequence[str] | None = ENGLISH,
    token_limit: int = -1,
) -> Column:
    """Full cleaning for bag-of-words embeddings."""
    tokens = standard_tokens(text, lower=lower, remove_punctuation=remove_punctuation)
    if lemmas:
        tokens = lemmatize(tokens, lemmas)
    return finish_tokens(tokens, stopwords=stopwords, token_limit=token_limit)


def light_preprocess(
    text: Column,
    *,
    lower: bool = False,
    remove_punctuation: bool = False,
    token_limit: int = -1,
) -> Column:
    """Minimal cleaning for sentence encoders: wording and order stay as they are."""
    cleaned = null_to_empty(text)
    if lower:
        cleaned = lowercase(cleaned)
    if remove_punctuation:
        cleaned = collapse_ws(strip_punct(cleaned))
    if token_limit != -1:
        cleaned = join_tokens(truncate_tokens(tokenize_ws(cleaned), token_limit))
    return cleaned


def contains_url(text: Column) -> Column:
    return F.coalesce(text.rlike(URL), F.lit(False))


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U){URL}{NOT_SPACES}", "")


def terms(text: Column, *, lower: bool = True) -> Column:
    """Vocabulary candidates of a text: runs of at least two word characters."""
    source = F.lower(text) if lower else text
    return F.regexp_extract_all(source, F.lit(TERM), F.lit(0))


def ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams for n from ``low`` to ``high``, words joined by one blank.

    For ``high`` above 1 pass a plain column, since the expression is read several times.
    """
    if not 1 <= low <= high:
        raise ValueError("ngram_range must satisfy 1 <= low <= high")
    # The n-grams at each place are the (n-1)-grams there, each extended by the word n-1 further on;
    # where no such word is left the result is null and drops out.
    grown, found = tokens, []
    for n in range(1, high + 1):
        if n > 1:
            ahead = F.slice(tokens, n, F.size(tokens))
            longer = F.zip_with(grown, ahead, lambda run, word: F.concat(run, F.lit(" "), word))
            grown = F.filter(longer, lambda run: run.isNotNull())
        if n >= low:
            found.append(grown)
    return found[0] if len(found) == 1 else F.concat(*found)
