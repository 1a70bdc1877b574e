"""Removal of lines that documents share, as one DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import SPACE, ascii_lower, without, written

#: Stands for a null id among the owners of a line; such rows count as one document after all others.
LAST = 9223372036854775807


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and kept_text.

    Lines are cut at \\n; a line's key has white space stripped at both ends and A-Z lower-cased. Keys of min_chars code
    points or more that min_docs documents or more hold lose all their lines but those of the smallest id that holds them.
    Only two 64-bit hashes of a key, the id and the line's place are shuffled; what a hash needs of its lines is combined
    before the shuffle, so a line in a third of all documents is a few rows. Texts meet their dropped places by id.

    Null or empty text is one empty line, which stays. A null id counts as the largest one. Rows that repeat an id are one
    document: they share no line with one another by that, and each row loses what other documents own. Ties cannot
    arise: an id owns a line or it doesn't. Empty tables give empty results. Columns of docs stay, except that
    n_lines, n_dropped and kept_text are replaced.
    """
    docs = without(docs, "n_lines", "n_dropped", "kept_text")
    doc, text = F.coalesce(docs[id_col], F.lit(LAST)), F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(doc.alias("__doc"), F.xxhash64(text).alias("__version"), F.posexplode(F.split(text, "\n")).alias("__at", "__line"))
    key = ascii_lower(F.trim(F.col("__line"), F.lit(SPACE)))
    keys = rows.select("__doc", "__version", "__at", key.alias("__key")).where(F.char_length("__key") >= min_chars)
    entries = keys.select("__doc", "__version", "__at", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit("second"), "__key").alias("__h2"))
    if min_docs <= 2:  # two documents hold it if the least and the greatest differ
        owners = entries.groupBy("__h1", "__h2").agg(F.min("__doc").alias("__owner"), F.max("__doc").alias("__other")).where(F.lit(min_docs < 2) | (F.col("__owner") != F.col("__other")))
    else:
        owners = entries.select("__h1", "__h2", "__doc").distinct().groupBy("__h1", "__h2").agg(F.min("__doc").alias("__owner"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_docs)
    # As a table of its own: then Spark sees how large each side of the join is, and splits the rows of a hot line.
    owners = written(owners.select("__h1", "__h2", "__owner"), "line-owners")
    drops = entries.join(owners, ["__h1", "__h2"]).where(F.col("__doc") != F.col("__owner"))
    drops = drops.groupBy("__doc", "__version").agg(F.collect_set("__at").alias("__drop"))
    lines = docs.select("*", doc.alias("__doc"), F.xxhash64(text).alias("__version"))
    lines = lines.join(drops, ["__doc", "__version"], "left").withColumn("__lines", F.split(text, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__drop", F.array().cast("array<int>")))
    return lines.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.transform(kept, lambda k: F.get(F.col("__lines"), k)), "\n").alias("kept_text"),
    )
