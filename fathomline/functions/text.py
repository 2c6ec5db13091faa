"""Text columns: tokens, stop words, cleaning, language, previews."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .stem import english, porter

#: Stemmers by name; add to it to make one available.
STEMMERS: dict[str, Callable[[str], str]] = {"english": english, "porter": porter, "none": lambda w: w}


def tokenize(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def remove_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*words.STOP_WORDS))


def terms_of(text: Column) -> Column:
    """Tokens without stop words, not stemmed."""
    return remove_stop_words(tokenize(F.coalesce(text, F.lit(""))))


def stem_vocabulary(vocabulary: DataFrame, stemmer: str = "porter") -> DataFrame:
    """term, stem for vocabulary(term) of distinct terms."""
    of = STEMMERS[stemmer]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"term": pdf["term"], "stem": [of(t) for t in pdf["term"]]})

    return vocabulary.select("term").mapInPandas(run, "term string, stem string")


def analyze(query: str, stemmer: str = "porter") -> list[str]:
    """The same analysis of a short text, on the driver."""
    import re

    return [STEMMERS[stemmer](t) for t in re.findall("[a-z0-9]+", query.lower()) if t not in words.STOP_WORDS]


def tokens_of(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", query.lower())


def collapse(text: Column) -> Column:
    """Inner white space as one blank, outer white space dropped."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean(text: Column, most: int) -> Column:
    return F.trim(F.left(collapse(F.coalesce(text, F.lit(""))), F.lit(most)))


def clustering_text(title: Column, text: Column) -> Column:
    """The title three times, and the text."""
    name = F.trim(F.coalesce(title, F.lit("")))
    return F.when(name != "", F.concat_ws(" ", name, name, name, text)).otherwise(text)


def is_english(text: Column) -> Column:
    """Enough ASCII letters in the first 1000 characters, and two of the marks."""
    some = F.trim(F.left(text, F.lit(1000)))
    letters = F.length(F.regexp_replace(some, "[^A-Za-z]", ""))
    low = F.lower(some)
    marks = sum((F.contains(low, F.lit(w)).cast("int") for w in words.ENGLISH_MARKS), F.lit(0))
    return (F.length(some) > 0) & (letters >= F.greatest(F.lit(20), F.floor(F.length(some) / 10))) & (marks >= 2)


def text_hash(text: Column) -> Column:
    return F.sha1(text)


def content_type(value: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(value, F.lit("")), F.lit(";"), F.lit(1))))


def preview(text: Column) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(500))


def snippet(text: Column) -> Column:
    return F.left(preview(text), F.lit(300))


def query_terms(query: Column) -> Column:
    """Whitespace-separated terms, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"\s+"), lambda t: t != "")


def new_terms(expanded: Column, query: Column) -> Column:
    return F.array_except(query_terms(expanded), query_terms(query))


def is_display_word(word: Column) -> Column:
    """Letters only, and more than two."""
    return word.rlike("^[a-z]{3,}$")


def nested_get(json: Column, path: str) -> Column:
    """What a dotted path leads to in a JSON text; null if it leads nowhere."""
    return F.get_json_object(json, "$." + path)
