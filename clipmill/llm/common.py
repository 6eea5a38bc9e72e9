"""What the operators share: names, words, folds, and cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill import storage

#: White space is the ASCII kind; everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Hint for the many small joins of a loop: each broadcast would leave a hash table of a megabyte or
#: more with the driver until its garbage is collected.
MERGE = "merge"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def others(df: DataFrame, *added: str) -> list[str]:
    """The columns of ``df`` that an operator adding ``added`` passes through (names ignore case)."""
    taken = {name.lower() for name in added}
    return [c for c in df.columns if c.lower() not in taken]


def packed(df: DataFrame, *added: str) -> Column:
    """All passed-through columns as one struct, so that no working column can clash with them."""
    return F.struct(*[F.col(quoted(c)) for c in others(df, *added)])


def text_of(name: str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the document's id falls into a fold; ids that are null belong to none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def labelled_texts(texts: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(y, i, x, t): the texts of at most ``per_class`` ids of each class 0 and 1, least hashes ``x`` first.

    ``texts`` (i, t) is read once for both classes. Of several texts of one id the one with the least hash
    is taken, so that reruns agree, however rows are spread.
    """
    classes = [
        labels.where(F.col("y") == y)
        .select("i", F.xxhash64("i").alias("x"), F.lit(y).alias("y"))
        .distinct()
        .orderBy("x", "i")
        .limit(per_class)
        for y in (0, 1)
    ]
    found = texts.join(F.broadcast(classes[0].union(classes[1])), "i")  # bounded by per_class
    one = F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"]
    return found.groupBy("y", "i", "x").agg(one.alias("t"))


def scored(rows: DataFrame) -> T.StructType:
    """The columns of ``rows`` with a classifier's ``score`` and ``predicted``."""
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return T.StructType([*rows.schema.fields, *added])


def cut(df: DataFrame) -> DataFrame:
    """The rows as written to the shared checkpoint folder, with the lineage cut there."""
    return storage.checkpointed(df)


def partitions_for(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
