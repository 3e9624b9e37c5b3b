"""Text preprocessing as column expressions: clean, tokenize, stopwords, stem.

Stemming has no built-in and runs as an Arrow UDF (memoized per worker); indexing sends it single
words, so a batch is small whatever the texts are. Everything else stays in the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemmer import stem
from .stopwords import ENGLISH

#: Patterns and words that the results depend on.
SCRIPT_BLOCK = r"(?s)<(script|style)[^>]*>.*?</\1>"
TAG = r"<[^>]+>"
NOISE_WORDS = (
    "function", "var", "push", "typeof", "null", "undefined", "ajax_fade", "page_not_loaded",
    "wpb-js-composer", "jquery", "onclick", "onload", "script", "style",
)
#: Between word boundaries; the first letters are tested before the boundary, which is slower. The patterns are for ASCII.
NOISE = r"(?=[" + "".join(sorted({w[0] for w in NOISE_WORDS})) + r"])(?<!\w)(?:" + "|".join(NOISE_WORDS) + r")\b"
#: ``(?i)(https?://|www\.)?([a-z0-9-]+\.)+[a-z]{2,}(/...)?`` in a form that is linear in a word's length: a
#: name begins where its run of letters begins, or where the last match ended.
URL = r"(?:[hH][tT]{2}[pP][sS]?://|(?<![\p{Alnum}-])|\G)(?:[\p{Alnum}-]++\.)+\p{Alpha}{2,}+(?:/[^\s\x1c-\x1f<>]*+)?"
#: Every match of ``URL`` holds this, and no step before it makes one.
DOTTED = r"\.\p{Alpha}{2}"
#: Punctuation and white space at once: both become one space. A single space is left as it is.
SEPARATORS = r" [^\w-]+|[^\w -][^\w-]*"


@dataclass(frozen=True)
class TextOptions:
    """Must be the same for documents and queries."""

    stopwords: bool = True
    stemming: bool = True
    min_word_length: int = 2
    stopword_list: tuple[str, ...] = field(default=tuple(ENGLISH))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, as a lambda's argument."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@cache
def decompositions() -> dict[str, str]:
    """What the compatibility decomposition leaves of each character beyond ASCII, where that is
    anything. Decomposition is by character, and reordering moves only marks beyond ASCII."""
    each = ((chr(i), unicodedata.normalize("NFKD", chr(i))) for i in range(128, 0x110000) if not 0xD800 <= i < 0xE000)
    kept = ((c, to.encode("ascii", "ignore").decode()) for c, to in each if to != c)
    return {c: to for c, to in kept if to}


def to_ascii(text: Column) -> Column:
    """Compatibility decomposition, then everything outside ASCII dropped. Characters that become
    one are replaced in one pass; the text is then cut at the rest, which become several or none."""
    table = decompositions()
    one = {c: to for c, to in table.items() if len(to) == 1}
    more = {c: to for c, to in table.items() if len(to) > 1}
    pieces = F.regexp_extract_all(F.translate(text, "".join(one), "".join(one.values())), F.lit(r"[\x00-\x7F]+|[" + "".join(more) + "]"), F.lit(0))
    to = F.create_map(*[F.lit(x) for item in more.items() for x in item])
    return F.array_join(F.transform(pieces, lambda p: F.when(F.octet_length(p) == F.char_length(p), p).otherwise(F.try_element_at(to, p))), "")


@F.pandas_udf(T.StringType())
def stem_each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of single words."""
    for words in batches:
        yield words.map(stem, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems in place: order and duplicates are kept."""
    for lists in batches:
        yield lists.map(lambda ts: None if ts is None else [stem(t) for t in ts])


def ascii_text(text: Column) -> Column:
    """``to_ascii``, to which only texts that hold more than ASCII are sent."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, text).otherwise(to_ascii(F.when(~plain, text)))


def _without_markup(text: Column) -> Column:
    """Of an ASCII text. The passes for tags and addresses are left out where they find nothing."""

    def cut(c: Column, *patterns: str) -> Column:
        for pattern in patterns:
            c = F.regexp_replace(c, pattern, " ")
        return c

    untagged = let(text, lambda c: F.when(F.contains(c, F.lit("<")), cut(c, SCRIPT_BLOCK, TAG)).otherwise(c))
    return let(cut(untagged, NOISE), lambda c: F.when(c.rlike(DOTTED), cut(c, URL)).otherwise(c))


def clean(text: Column) -> Column:
    """Cleaned lower-case ASCII text; null where nothing is left."""
    c = F.regexp_replace(_without_markup(ascii_text(text)), SEPARATORS, " ")
    return F.nullif(F.lower(F.trim(c)), F.lit(""))  # computed once, unlike in a when()


def tokenize(text: Column, min_word_length: int = 2) -> Column:
    """Words of at least ``min_word_length`` characters with a letter; case is kept."""
    words = F.split(text, r"(?U)\W+")
    return F.filter(words, lambda w: (F.length(w) >= min_word_length) & w.rlike(r"\p{L}"))


def remove_stopwords(tokens: Column, words: tuple[str, ...] = tuple(ENGLISH)) -> Column:
    """Drops members of ``words``; duplicates and order of the rest are kept."""
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


def words(text: Column, options: TextOptions = TextOptions()) -> Column:
    """``tokenize(clean(text))`` without stopwords, not stemmed, in one pass over the ASCII text; an
    empty array for null, empty or fully cleaned-away text.

    Where a text has neither tags nor addresses, noise words can only come out as words of their own,
    so it is searched for them only if words like theirs were found.
    """
    n = max(options.min_word_length, 1)
    word = rf"\p{{Alpha}}\w{{{n - 1},}}+|(?<!\w)(?=\w{{{n}}})[0-9_]++\p{{Alpha}}\w*+"
    noise = F.array(*[F.lit(w.rpartition("-")[2]) for w in NOISE_WORDS])

    def cut(c: Column) -> Column:
        return F.regexp_extract_all(F.lower(c), F.lit(word), F.lit(0))

    def of(c: Column) -> Column:
        whole = cut(_without_markup(c))
        marked = F.contains(c, F.lit("<")) | c.rlike(DOTTED)
        return F.when(marked, whole).otherwise(let(cut(c), lambda f: F.when(F.arrays_overlap(f, noise), whole).otherwise(f)))

    found = let(ascii_text(text), of)
    if options.stopwords:
        found = remove_stopwords(found, options.stopword_list)
    return F.coalesce(found, F.array().cast("array<string>"))


def tokens(text: Column, options: TextOptions = TextOptions()) -> Column:
    """The whole pipeline: ``words``, stemmed if the options say so."""
    return stem_all(words(text, options)) if options.stemming else words(text, options)


#: No white space in the sense of Unicode and no separator of ASCII; ASCII letters first, as their test is fast.
WORD = r"[!-~]++[\P{IsWhite_Space}&&[^\x1c-\x1f]]*+|[\P{IsWhite_Space}&&[^\x1c-\x1f]]++"


def word_count(text: Column) -> Column:
    """Whitespace-separated words of the raw text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
