"""Plain versions that the operators are held against, and awkward tables."""

import re

import pandas as pd
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("score", T.DoubleType()), ("h", T.StringType()))])


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def docs(spark, texts, langs=None):
    """A documents table with columns whose names clash with those of results; texts by id, or (id, text) pairs."""
    pairs = list(texts.items()) if isinstance(texts, dict) else list(texts)
    rows = [(i, t, (langs or {}).get(i, "en"), f"s{(i or 0) % 3}", len(t or ""), 0.5, "x") for i, t in pairs]
    return spark.createDataFrame(rows, DOCS)


#: Nulls, empty and blank texts, ties, repeated rows, odd characters, and one long text.
AWKWARD = [
    (0, None),
    (1, ""),
    (2, " \n\t \r\x0b\x0c"),
    (3, "one"),
    (4, "one two three"),
    (4, "one two three"),
    (5, "É Ü ß x 日本 👍🏽 <b> &amp; # $"),
    (None, "a row without an id but with more than a dozen words in it so that windows exist in it"),
    (7, "word " * 5000),
    (8, "a row without an id but with more than a dozen words in it so that windows exist in it"),
]


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def pdf(df) -> pd.DataFrame:
    return df.toPandas()
