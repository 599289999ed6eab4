"""Session helpers: durable intermediates and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_ROWS = 10_000
BROADCAST_ROWS = 100_000
SALTS = 16
HOT_SHARES = 1_000  # a key with more than 1/1000 of the rows is salted


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint; later reads survive lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Settled:
    """A per-group table computed once: how large it is has been looked at.

    ``rows`` holds its rows when there are few; the DataFrame is then a local
    relation, so later joins know its size.  ``small`` says it may be broadcast.
    """

    df: DataFrame
    rows: list | None
    small: bool

    def select(self, *columns: str) -> Settled:
        return Settled(self.df.select(*columns), self.rows, self.small)


def settle(df: DataFrame) -> Settled:
    """Make a per-group table durable and find out its size."""
    kept = durable(df)
    rows = kept.limit(LOCAL_ROWS + 1).collect()
    if len(rows) <= LOCAL_ROWS:
        return Settled(df.sparkSession.createDataFrame(rows, kept.schema), rows, True)
    return Settled(kept, None, kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS)


def join_checked(
    big: DataFrame,
    small: Settled | DataFrame,
    on: list[str],
    how: str = "inner",
    sizes: str | None = None,
    even: bool = False,
) -> DataFrame:
    """Join a per-group table to raw rows, broadcast only after its size was checked.

    Beyond the bound both sides are shuffled.  ``sizes`` names a column of the small
    side that holds how many big rows each key has: only keys with a noticeable share
    are then salted.  ``even`` says that no key is heavy, so none is.
    """
    side = small if isinstance(small, Settled) else settle(small)
    if side.small:
        out = side.df if sizes is None else side.df.drop(sizes)
        return big.join(F.broadcast(out), on, how)
    if even:
        return big.join(side.df, on, how)
    return salted_join(big, side.df, on, how, sizes)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    sizes: str | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join whose heavy keys are spread over several tasks.

    ``small`` has one row per key; a heavy key's row is repeated once per salt, so
    ``how`` has to keep the big side (inner or left).  With ``sizes`` a key gets a salt
    for every 1/HOT_SHARES of all rows it has; without, every key gets ``salts``.
    """
    if how not in ("inner", "left", "left_outer", "leftouter"):
        raise ValueError(f"a salted join cannot be '{how}'")
    # Rows are dealt by their place, not by their values: equal rows are spread as well.
    place = F.monotonically_increasing_id()
    if sizes is None:
        spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        tagged = big.withColumn("_salt", F.pmod(place, F.lit(salts)).cast("int"))
    else:
        total = small.agg(F.sum(sizes)).first()[0] or 0
        share = F.ceil(F.col(sizes) * HOT_SHARES / F.lit(max(total, 1))).cast("int")
        many = F.when(share > 1, share).otherwise(F.lit(1))
        # Fewer than HOT_SHARES keys can each hold more than that share of the rows.
        hot = small.where(share > 1).select(*on, share.alias("_many"))
        spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop(sizes)
        tagged = (
            big.withColumn("_place", place)
            .join(F.broadcast(hot), on, "left")
            .withColumn("_salt", F.coalesce(F.pmod("_place", "_many"), F.lit(0)).cast("int"))
            .drop("_many", "_place")
        )
    return tagged.join(spread, [*on, "_salt"], how).drop("_salt")
