"""State tables folded from a log that arrives in parts.

Each part is reduced to one row per key and written under its batch id; now and then a
snapshot takes in the parts so far.  The state is the newest snapshot merged with the parts
after it.  Every rule is a minimum or maximum over (order, value), so parts may come
in any order, may repeat rows, and give what one pass over the whole log gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a column of the state holds.
LAST = "last"  # the value of the last row, null too
LAST_KNOWN = "last_known"  # the last value that is not null
FIRST_KNOWN = "first_known"  # the first value that is not null
ANY = "any"  # true as soon as one row says so
RULES = (LAST, LAST_KNOWN, FIRST_KNOWN, ANY)

_MANIFEST = "kind string, id long"
_PART, _SNAPSHOT = "part", "snapshot"
_NONE = -1


class LogState:
    """One state table below ``root``, a folder that driver and executors share.

    ``columns`` names a rule for each column kept; ``order`` names the columns by which log rows
    come one after another (a time, then an id).  Of rows with one order the larger value counts as later.
    Rows with a null in a key are left out; a null order comes before all others.
    There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, log: T.StructType, keys: list[str], order: list[str], columns: dict[str, str]):
        unknown = {rule for rule in columns.values() if rule not in RULES}
        if unknown:
            raise ValueError(f"unknown rules {sorted(unknown)}, known are {list(RULES)}")
        self.spark, self.root, self.log = spark, root.rstrip("/"), log
        self.keys, self.order, self.columns = keys, order, columns
        nothing = spark.range(0, 0, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in log.fields])
        empty = self._reduced(nothing)
        self.stored = empty.schema
        empty.write.mode("ignore").parquet(f"{self.root}/parts/batch={_NONE}")
        empty.write.mode("ignore").parquet(f"{self.root}/snapshots/{_NONE}")
        self._entry(_PART, _NONE).limit(0).write.mode("ignore").parquet(f"{self.root}/manifest")

    def _reduced(self, log: DataFrame) -> DataFrame:
        """One row per key of log rows."""
        at = F.struct(*self.order)

        def kept(name: str, rule: str) -> Column:
            placed = F.struct(at.alias("at"), F.col(name).alias("value"))
            if rule == ANY:
                return F.max(name)
            if rule == LAST:
                return F.max(placed)
            known = F.when(F.col(name).isNotNull(), placed)
            return F.max(known) if rule == LAST_KNOWN else F.min(known)

        whole = log.dropna(subset=self.keys)
        return whole.groupBy(*self.keys).agg(*[kept(name, rule).alias(name) for name, rule in self.columns.items()])

    def _merged(self, stored: DataFrame) -> DataFrame:
        merges = [(F.min if rule == FIRST_KNOWN else F.max)(name).alias(name) for name, rule in self.columns.items()]
        return stored.groupBy(*self.keys).agg(*merges)

    def _manifest(self) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest")

    def _entry(self, kind: str, number: int) -> DataFrame:
        return self.spark.range(0, 1, 1, 1).select(F.lit(kind).alias("kind"), F.lit(number).cast("long").alias("id"))

    def _note(self, kind: str, number: int) -> None:
        self._entry(kind, number).write.mode("append").parquet(f"{self.root}/manifest")

    def compacted(self) -> int:
        """The last batch that the newest snapshot holds, -1 for none."""
        newest = self._manifest().filter(F.col("kind") == _SNAPSHOT).agg(F.max("id")).first()[0]
        return _NONE if newest is None else newest

    def add(self, batch: int, log: DataFrame) -> None:
        """Take in one part; a batch that is there already is left as it is, so a repeated call changes nothing.

        Reads and writes this part only.
        """
        if batch < 0:
            raise ValueError("batch ids start at 0")
        if not self._manifest().filter((F.col("kind") == _PART) & (F.col("id") == batch)).isEmpty():
            return
        if batch <= self.compacted():
            raise ValueError(f"batch {batch} is new, but all up to {self.compacted()} are compacted")
        self._reduced(log).write.mode("overwrite").parquet(f"{self.root}/parts/batch={batch}")
        self._note(_PART, batch)

    def _state(self, until: int | None = None) -> DataFrame:
        base = self.compacted()
        schema = T.StructType([*self.stored.fields, T.StructField("batch", T.LongType())])
        parts = self.spark.read.schema(schema).parquet(f"{self.root}/parts").filter(F.col("batch") > base)
        if until is not None:
            parts = parts.filter(F.col("batch") <= until)
        snapshot = self.spark.read.schema(self.stored).parquet(f"{self.root}/snapshots/{base}")
        return self._merged(snapshot.unionByName(parts.drop("batch")))

    def compact(self) -> int:
        """Write a snapshot of all parts so far; its last batch.  A broken run leaves the older snapshot in force."""
        newest = self._manifest().filter(F.col("kind") == _PART).agg(F.max("id")).first()[0]
        if newest is None or newest <= self.compacted():
            return self.compacted()
        self._state(newest).write.mode("overwrite").parquet(f"{self.root}/snapshots/{newest}")
        self._note(_SNAPSHOT, newest)
        return newest

    def current(self) -> DataFrame:
        """The state now: keys, then the columns by their rules."""
        return self._state().select(
            *self.keys,
            *[F.col(name) if rule == ANY else F.col(f"{name}.value").alias(name) for name, rule in self.columns.items()],
        )
