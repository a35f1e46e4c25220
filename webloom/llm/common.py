"""Session helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import cut_lineage, ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*columns) if columns else df


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the cluster shares."""
    return cut_lineage(df)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


BROADCAST_ROWS = 500_000


def sized(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Narrow rows with the way to join them: broadcast where they are counted to be few, else by hash."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= (BROADCAST_ROWS if most is None else most) else rows.hint("shuffle_hash")


BITMAP_BITS = 25


def thinned(df: DataFrame, key: str, ids: DataFrame, id_: str) -> DataFrame:
    """The rows of df whose key may be among the ids: before an exact join, so that the others do not move.  Ids are
    marked in a bitmap of fixed size, which is broadcast; nulls go."""
    def place(c: str) -> Column:
        return F.xxhash64(F.col(c).cast("long")).bitwiseAND((1 << BITMAP_BITS) - 1)

    word, bits = fresh(df, "word"), fresh(df, "bits")
    words = (ids.where(F.col(id_).isNotNull()).select(place(id_).alias("at"))
             .groupBy(F.shiftright("at", 6).alias(word)).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias(bits)))
    return (df.where(F.col(key).isNotNull()).withColumn(word, F.shiftright(place(key), 6)).join(F.broadcast(words), word)
            .where(F.expr(f"shiftrightunsigned({bits}, int(xxhash64(cast({key} as long)) & 63)) & 1") == 1).drop(word, bits))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def bounded_rows(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of the key: the same at each run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(17)), F.col(key)).limit(rows)


def scratch_dir(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/webloom"


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file lies, on every machine alike."""
    import public_tokenizers
    return str(public_tokenizers.path(name))
