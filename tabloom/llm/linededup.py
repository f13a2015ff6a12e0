"""Lines that many documents share, kept in one document only; DataFrame operations only.

Digests of long lines are range-partitioned by digest and document, so that a line in a third of
all documents spreads over neighbouring partitions, each sorted by document and position. A run of
one digest in one partition streams into one row (documents, largest id); the few runs of a digest
give its document count and the document that keeps it, and go back to their own partition. What
leaves is a bitmap of kept lines per document, never text.

Defined cases: a null or empty text is one empty line (a null text stays null); rows with one id count as one document, and
a null id is one document smaller than any other; every line of the keeping document stays, also
repeats; rows that repeat id and text get the same bitmap; an empty table gives no rows; other
columns are not read by `line_bitmaps` and pass through `without_shared_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_CHARS = 40
MIN_DOCS = 5
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines of a bitmap word.
WIDTH = 64


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digests(value: Column) -> list[Column]:
    """128 bits in two numbers."""
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


def _key(line: Column) -> Column:
    """A-Z lower-cased; a line without other than ASCII letters goes the short way."""
    plain = F.octet_length(line) == F.char_length(line)
    return F.when(plain, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """For every document that loses lines: id, text digest (t0, t1), n_dropped and `keep`, the words
    of its bitmap that have a dropped line: (word, bits), bit i of a word is 1 where line
    64 * word + i stays. Words that are left out keep all their lines."""
    parts = docs.select(F.col(f"`{id_col}`").alias("id"), _text(text_col).alias("text"))
    t0, t1 = _digests(F.col("text"))
    lines = parts.select("id", t0.alias("t0"), t1.alias("t1"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACE))).where(F.char_length("line") >= min_chars)
    d0, d1 = _digests(_key(F.col("line")))
    sought = lines.select(d0.alias("d0"), d1.alias("d1"), "id", "t0", "t1", "pos")
    order = [F.col("d0"), F.col("d1"), F.col("id").asc_nulls_first(), F.col("t0"), F.col("t1"), F.col("pos")]
    ranged = sought.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("run", F.spark_partition_id()), "lines")
    holders = ranged.groupBy("d0", "d1", "id").agg(F.min("run").alias("low"), F.max("run").alias("high"))
    shared = holders.groupBy("d0", "d1").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"), F.min("low").alias("low"), F.max("high").alias("high"))
    shared = shared.where(F.col("n_docs") >= min_docs).select(
        "d0", "d1", "keeper", F.explode(F.sequence("low", "high")).alias("run"))
    lost = ranged.join(shared, ["d0", "d1", "run"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    words = lost.groupBy("id", "t0", "t1", F.floor(F.col("pos") / WIDTH).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, pos % {WIDTH})")).alias("gone"))
    return words.groupBy("id", "t0", "t1").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"))


def _dense(keep: Column) -> Column:
    """The words of a bitmap from the first on, full words in the gaps."""
    def filled(entry: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(keep, i - 1)["word"]).otherwise(F.lit(-1))
        return F.concat(F.array_repeat(F.lit(-1).cast("bigint"), entry["word"] - before - 1), F.array(entry["bits"]))

    return F.flatten(F.transform(keep, filled))


def _left(text: Column, dense: Column) -> Column:
    """The text without the lines whose bit is 0."""
    def stays(_: Column, i: Column) -> Column:
        word = F.get(dense, F.floor(i / WIDTH).cast("int"))
        return F.coalesce(F.getbit(word, i % WIDTH), F.lit(1)) == 1

    return F.array_join(F.filter(_lines(text), stays), "\n")


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, **limits: int) -> DataFrame:
    """`docs` with its text as `__text__`, the number of dropped lines and the text that stays."""
    maps = line_bitmaps(docs, id_col, text_col, **limits).select(
        F.col("id").alias("__id__"), F.col("t0").alias("__m0__"), F.col("t1").alias("__m1__"),
        F.col("n_dropped").alias("__dropped__"), _dense(F.col("keep")).alias("__keep__"))
    t0, t1 = _digests(F.col("__text__"))
    own = docs.withColumn("__text__", _text(text_col)).withColumns({"__t0__": t0, "__t1__": t1})
    joined = own.join(maps, own[id_col].eqNullSafe(maps["__id__"]) & (own["__t0__"] == maps["__m0__"])
                      & (own["__t1__"] == maps["__m1__"]), "left")
    left = F.when(F.col("__keep__").isNull(), F.col("__text__")).otherwise(_left(F.col("__text__"), F.col("__keep__")))
    return joined.withColumn("__left__", left)


def without_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with the shared lines taken out of its texts, all columns."""
    found = _with_bitmaps(docs, id_col, text_col, min_chars=min_chars, min_docs=min_docs)
    left = F.when(F.col("__keep__").isNotNull(), F.col("__left__")).otherwise(F.col(f"`{text_col}`"))
    return found.select(*[left.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_lines, n_dropped and the SHA-256 of what stays."""
    found = _with_bitmaps(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
                          "doc_id", "text")
    return found.select(
        "doc_id", F.size(_lines(F.col("__text__"))).cast("bigint").alias("n_lines"),
        F.coalesce(F.col("__dropped__"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(F.col("__left__").cast("binary"), 256).alias("kept_sha256"))
