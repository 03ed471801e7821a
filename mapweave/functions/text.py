"""Scalar functions on strings, as Column expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
PLACEHOLDERS = ["", "-", "--", "—", "n/a", "na", "null", "none", "?"]
BOOLEANS = ["true", "false", "yes", "no", "on", "off", "0", "1", "t", "f", "y", "n"]
STOP_WORDS = ["of", "the", "a", "an", "and", "or", "in", "at", "to", "for"]
WIKI_FILLER = ["", "?", "—", "-", "total", "null", "none", "unknown", "x"]
WIKI_NULLS = ["", "n/a", "na", "null", "none", "-", "—", "–", "?", "unknown"]
NUMBER = r"^-?\d+(?:[.,]\d+)?$"
INTEGER = r"^-?\d+$"
HEX = r"^(?:#|0x)[0-9a-fA-F]+$"
YEAR = r"^(19|20)\d{2}$"
DATE = r"^(?:\d{1,2}[./-]\d{1,2}(?:[./-]\d{2,4})?|\d{4}[./-]\d{1,2}[./-]\d{1,2})$"
PURE_NUMBER = r"^[+-]?\d[\d ,._]*(?:[eE][+-]?\d+)?$"
CURRENCY = r"[$€£¥₹₩₺₽¢]\s?\d|\d\s?[$€£¥₹₩₺₽¢]"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9a-f]{32}$"
URL = r"^https?://"
PATH = r"^(?:/[\w.-]+)+/?$|^[A-Za-z]:\\"
NORMALISED = [(r"\(.*?\)", ""), (r"(?<=[a-z])\.(?=[a-z])", ""), (r"(?U)[^\w\s]", " "), (r"(?U)\s+", " ")]
REPEATED = r"^([^a-zA-Z0-9])\1{2,}$"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_value(c: Column) -> Column:
    """A cell as it is compared: trimmed, lower case, runs of white space as one space; nulls as the empty string."""
    text = F.regexp_replace(F.lower(strip(c.cast("string"))), r"(?U)\s+", " ")
    return F.coalesce(text, F.lit(""))


def wiki_clean(c: Column) -> Column:
    """A wiki cell: trimmed, case kept, filler as the empty string."""
    v = strip(c.cast("string"))
    return F.when(v.isNull() | F.lower(v).isin(WIKI_FILLER), F.lit("")).otherwise(v)


def _is(c: Column, pattern: str) -> Column:
    return strip(c).rlike("(?U)" + pattern)


def is_number(c: Column) -> Column:
    return _is(c, NUMBER)


def is_integer(c: Column) -> Column:
    return _is(c, INTEGER)


def is_hex(c: Column) -> Column:
    return strip(c).rlike(HEX)


def is_placeholder(c: Column) -> Column:
    return F.lower(strip(c)).isin(PLACEHOLDERS)


def is_noise_value(c: Column) -> Column:
    """Numbers, hex codes and placeholders tell nothing about a column's topic."""
    return is_number(c) | is_hex(c) | is_placeholder(c)


def is_date_like(c: Column) -> Column:
    return _is(c, YEAR) | _is(c, DATE)


def is_numeric_string(c: Column) -> Column:
    return ~is_date_like(c) & _is(c, PURE_NUMBER)


def is_number_dominated(c: Column) -> Column:
    """Letters and more digits than letters, and no date."""
    letters, digits = F.regexp_count(c, F.lit(r"\p{L}")), F.regexp_count(c, F.lit(r"\p{Nd}"))
    return ~is_date_like(c) & (letters > 0) & (digits > letters)


def is_currency(c: Column) -> Column:
    return strip(c).rlike(CURRENCY)


def is_boolean(c: Column) -> Column:
    return F.lower(strip(c)).isin(BOOLEANS)


def is_uuid(c: Column) -> Column:
    return F.lower(strip(c)).rlike(UUID)


def is_url_or_path(c: Column) -> Column:
    v = strip(c)
    return F.lower(v).rlike(URL) | v.rlike(PATH)


def is_repeated_char(c: Column) -> Column:
    return strip(c).rlike(REPEATED)


def normalize(c: Column) -> Column:
    """Lower case, without bracketed parts, dots between letters and other punctuation; runs of white space as one space."""
    return strip(reduce(lambda x, s: F.regexp_replace(x, *s), NORMALISED, strip(F.lower(c))))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda t: t != "")


def content_words(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: ~t.isin(STOP_WORDS))


def exact_match(a: Column, b: Column) -> Column:
    return normalize(a) == normalize(b)


def approx_match(a: Column, b: Column, fraction: float = 0.2, most: int = 10) -> Column:
    """Equal, or within an edit distance of a fraction of both lengths (rounded down) and of `most`."""
    bound = F.least(F.floor(F.length(a) * fraction), F.floor(F.length(b) * fraction), F.lit(most))
    close = (bound > 0) & (F.abs(F.length(a) - F.length(b)) <= bound)  # lengths first: they are cheap
    return (a == b) | F.when(close, F.levenshtein(a, b) <= bound).otherwise(F.lit(False))


def edit_distance_match(a: Column, b: Column, fraction: float = 0.2, most: int = 10) -> Column:
    return approx_match(normalize(a), normalize(b), fraction, most)


def token_set_match(a: Column, b: Column, threshold: float = 0.8) -> Column:
    x, y = F.array_distinct(content_words(a)), F.array_distinct(content_words(b))
    both = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(both, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)) >= threshold).otherwise(F.lit(False))


def initials(c: Column) -> Column:
    return F.array_join(F.transform(content_words(c), lambda t: F.substring(t, 1, 1)), "")


def abbreviation_match(a: Column, b: Column) -> Column:
    """One is the initials of the other's content words, two letters at least."""
    x, y = normalize(a), normalize(b)
    return ((x == initials(b)) & (F.length(x) >= 2)) | ((y == initials(a)) & (F.length(y) >= 2))


def match_strategy(a: Column, b: Column, edit: bool = True, token_set: bool = True, abbreviation: bool = True, fraction: float = 0.2, most: int = 10, threshold: float = 0.8) -> Column:
    """The first strategy that matches: exact, edit_distance, token_set, abbreviation; else empty or no_match."""
    out = F.when(F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe(""), "empty").when(exact_match(a, b), "exact")
    if edit:
        out = out.when(edit_distance_match(a, b, fraction, most), "edit_distance")
    if token_set:
        out = out.when(token_set_match(a, b, threshold), "token_set")
    if abbreviation:
        out = out.when(abbreviation_match(a, b), "abbreviation")
    return out.otherwise("no_match")


def strategy_score(strategy: Column) -> Column:
    return F.when(strategy == "exact", 1.0).when(strategy == "edit_distance", 0.8).when(strategy == "token_set", 0.7).when(strategy == "abbreviation", 0.6).otherwise(0.0)


def char_ngrams(c: Column, n: int = 2) -> Column:
    """The distinct character n-grams of the normalised text; a shorter text is its own, an empty one has none."""
    t = normalize(c)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def word_ngrams(c: Column, n: int = 1) -> Column:
    w = tokens(c)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(x: Column, y: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))


def char_jaccard(a: Column, b: Column, n: int = 2) -> Column:
    return jaccard(char_ngrams(a, n), char_ngrams(b, n))


def word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(word_ngrams(a), word_ngrams(b))


def jaccard_similarity(a: Column, b: Column, n: int = 2, chars: bool = True, words: bool = True) -> Column:
    parts = [f for on, f in ((chars, char_jaccard(a, b, n)), (words, word_jaccard(a, b))) if on]
    return F.greatest(*parts, F.lit(0.0))


def unordered(a: Column, b: Column) -> Column:
    """A pair regardless of its direction; null if both are equal."""
    return F.when(a != b, F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
