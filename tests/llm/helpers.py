"""Small tables with the awkward cases, and plain versions of the shared definitions."""

import re

from pyspark.sql import types as T

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Columns that other tables or the operators themselves use.
CLASHES = ["n_shingles", "component_id", "kept", "size", "score", "taken", "key", "rep", "a", "b", "block", "h", "c", "word", "range", "label", "features", "held_out"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHES],
    ]
)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def table(spark, rows):
    """Documents from (doc_id, text[, lang[, source]]) rows, with clashing columns."""
    full = []
    for r in rows:
        r = [*r, "en", "s"][: max(4, len(r))] if len(r) < 4 else list(r)
        r = [*r[:4]]
        full.append((*r, len(r[1]) if r[1] is not None else None, *["x"] * len(CLASHES)))
    return spark.createDataFrame(full, SCHEMA)


def docs(rng, n, vocabulary=60, least=0, most=40):
    names = [f"w{k}" for k in range(vocabulary)]
    return [" ".join(rng.choice(names) for _ in range(rng.randint(least, most))) for _ in range(n)]


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
