"""Small tables with every awkward row, and brute-force versions of what the operators compute."""

from __future__ import annotations

import hashlib
import os

import pandas as pd

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

# Extra columns whose names an operator might use itself.
CLASHING = ("fp, fingerprint, component_id, keep_id, kept, text_hash, text_sha256, n_words, hits, items, score, "
            "predicted, features, held_out, batch, bucket, words, low, high, n, length, hash, sha, root, node").split(", ")


def awkward_texts() -> list[str | None]:
    long_text = "alpha beta gamma delta " * 20_000
    return [None, "", " ", "\n\t", "one", "one two three", "é ß ñ 漢字 \U0001f600", "x" * 300_000, long_text,
            "same text here", "same text here", "A a A a", "|||| #### %%%%", "\x00\x01 nul"]


def awkward(spark, clashing: bool = True):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    texts = awkward_texts()
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [(3, "repeated id, other text", None, None, None), (9, "same text here", "en", "s", 1),
             (9, "same text here", "en", "s", 1), (None, "no id", None, None, None), (None, None, None, None, None),
             (None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    if clashing:
        for name in CLASHING:
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def documents() -> pd.DataFrame:
    return pd.read_parquet(f"{DIRECTORY}/documents.parquet")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def as_rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
