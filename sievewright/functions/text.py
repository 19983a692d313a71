"""Text preprocessing as column expressions; Python only where Spark has no function (folding, stems)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .stem import stem

#: Function words dropped from every text.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "is", "are", "to", "of", "in", "for", "with", "on", "as", "at", "by", "be", "this", "that", "from", "it", "its",
    "was", "were", "will", "can", "has", "have", "had", "i", "me", "my", "we", "our", "you", "your", "into", "about", "than", "so", "not", "no",
    "but", "if", "who", "what", "where", "how", "any", "some", "also", "very", "just", "do", "does",
)
#: Words dropped from queries only.
QUERY_STOP_WORDS = (
    "job", "jobs", "role", "roles", "position", "positions", "opening", "openings", "vacancy", "vacancies", "looking", "want", "wanted", "find",
    "search", "need", "career", "careers", "opportunity", "opportunities", "near", "based", "like", "please", "show", "give", "best", "good",
)
#: Letters that have no decomposition into a base letter and marks.
LETTERS = {"ł": "l", "Ł": "L", "ı": "i", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "ð": "d"}
#: Words added to a schedule that contains the first.
SCHEDULE_WORDS = (("contract", "contract contractor"), ("intern", "intern internship"), ("part", "parttime"), ("full", "fulltime"), ("temp", "temporary temp"))


def fold(text: Column) -> Column:
    """Nearest ASCII text; null becomes empty. Pure ASCII rows never leave the JVM's encoding of the batch."""
    table = str.maketrans(LETTERS)

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        one = lambda t: t if t.isascii() else unicodedata.normalize("NFKD", t.translate(table)).encode("ascii", "ignore").decode()
        return s.fillna("").map(one)

    return run(text)


def stemmed(term: Column) -> Column:
    """Porter stem. Apply it to distinct terms and join back."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else stem(t))

    return run(term)


def raw_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, case kept."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))


def is_acronym(token: Column) -> Column:
    return token.rlike("^[A-Z]{2,}$")


def _words(values) -> Column:
    return F.array(*map(F.lit, values))


def _reason(token: Column, query: bool) -> Column:
    low = F.lower(token)
    out = F.when((F.length(low) < 2) & ~low.rlike("^[0-9]$"), "too short").when(low.isin(*STOP_WORDS) & ~is_acronym(token), "stop word")
    return out.when(low.isin(*QUERY_STOP_WORDS), "query stop word") if query else out


def normalized(tokens: Column, query: bool = False) -> Column:
    """Lower-cased tokens without short and stop words; acronyms are no stop words ("IT" stays)."""
    return F.transform(F.filter(tokens, lambda t: _reason(t, query).isNull()), F.lower)


def removed(tokens: Column, query: bool = False) -> Column:
    """(token, reason) of each token that ``normalized`` drops."""
    pairs = F.transform(tokens, lambda t: F.struct(F.lower(t).alias("token"), _reason(t, query).alias("reason")))
    return F.filter(pairs, lambda p: p["reason"].isNotNull())


def terms(text: Column, query: bool = False) -> Column:
    return normalized(raw_tokens(text), query)


def biwords(unigrams: Column) -> Column:
    """Neighbours joined by an underscore."""
    pairs = F.zip_with(F.slice(unigrams, 1, F.greatest(F.size(unigrams) - 1, F.lit(0))), F.slice(unigrams, 2, F.greatest(F.size(unigrams) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.when(F.size(unigrams) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def segment_terms(text: Column, with_biwords: bool) -> Column:
    """Terms of comma-parted segments; biwords never cross a comma."""
    segments = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: terms(s))
    out = F.flatten(segments)
    return F.concat(out, F.flatten(F.transform(segments, biwords))) if with_biwords else out


def worktype_text(schedule: Column, workplace: Column) -> Column:
    """Words of the work-type zone from schedule and workplace."""
    low = F.lower(schedule)
    extra = [F.when(low.contains(k), F.lit(v)) for k, v in SCHEDULE_WORDS]
    return F.concat_ws(" ", F.when(schedule != "Not stated", schedule), *extra, F.when(workplace == "Remote", F.lit("remote wfh")))


def location_text(location: Column, country: Column) -> Column:
    """The location, and the country unless it is already part of it."""
    location, country = F.coalesce(location, F.lit("")), F.coalesce(country, F.lit(""))
    return F.when(F.contains(F.lower(location), F.lower(country)), location).otherwise(F.concat(location, F.lit(", "), country))


#: What Python's str.split() takes for white space; \s of Java is ASCII only.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def portable_hash(id_: Column, seed: int) -> Column:
    """A pseudorandom number below 2**32 that SQL engines agree on."""
    return F.pmod(F.pmod(id_, F.lit(1 << 20)) * F.lit(2654435761) + F.lit(seed * 40503), F.lit(1 << 32))


# the dropped first version of the tokenizer, kept for comparison of results

#: Its stop words.
FIRST_STOP_WORDS = (
    "a", "an", "the", "and", "or", "is", "are", "to", "of", "in", "for", "with", "on", "as", "at", "by", "be", "this", "that", "from", "it", "its",
    "was", "were", "will", "can", "has", "have", "had",
)


def first_version(text: Column) -> Column:
    """Lower-cased tokens without the first version's stop words; other signs part words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*FIRST_STOP_WORDS))


def stemmed_segments(segments: Column) -> Column:
    """Stems of an array of arrays of terms; each distinct term is stemmed once per worker."""

    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [[stem(t) for t in ts] for ts in x])

    return run(segments)
