"""A profile that grows: value counts are stored, and a new batch is added without reading the earlier ones.

The state of a table is the number of occurrences of each distinct value of each field, with the length, the type tests and the number that
the value stands for. A batch adds a segment with its own counts; a profile is an aggregate over the segments, exactly
that of all batches together. ``compact`` adds up the segments into one, so that their number stays small.

A segment counts once its manifest is there, and a batch is in one manifest at most: a batch that is
added again, after a failure or by mistake, changes nothing. Fields may come and go from batch to batch; where a field
is absent its values are null. Values are kept as whole texts, as any may become a category.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewell.functions.detectors import Detectors, to_number
from gaugewell.operators.profile import (
    MAX_CATEGORIES,
    NUMERIC_TYPES,
    FieldProfile,
    TableProfile,
    cell_counts,
    frequency_aggregates,
    judge,
    make_rules,
)
from gaugewell.session import configure, create_once, remove_path

_VALUE = ["field", "text", "len", "mask", "number"]


class ProfileState:
    """The stored counts of one table."""

    def __init__(self, path: str, detectors: Detectors | None = None) -> None:
        self.path, self.detectors = path.rstrip("/"), detectors or Detectors()

    def _manifests(self, spark: SparkSession) -> list[dict]:
        """One for each segment that counts, in the order of adding."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder) or not files.listStatus(folder):
            return []
        found = [json.loads(r["value"]) for r in spark.read.text(f"{self.path}/manifests/*.json").collect()]
        replaced = {name for m in found for name in m["replaces"]}
        return sorted((m for m in found if m["segment"] not in replaced), key=lambda m: m["order"])

    def _segment(self, name: str) -> str:
        return f"{self.path}/segments/{name}"

    def batches(self, spark: SparkSession) -> list[str]:
        return [b for m in self._manifests(spark) for b in m["batches"]]

    def add(self, df: DataFrame, batch_id: str) -> bool:
        """Count the values of a batch; False if this batch was counted before."""
        spark = configure(df.sparkSession)
        known = self._manifests(spark)
        if not df.columns or batch_id in (b for m in known for b in m["batches"]):
            return False
        names, name = df.columns, hashlib.sha256(batch_id.encode()).hexdigest()[:24]
        field = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("ordinal") + 1)
        counts = cell_counts(df, self.detectors).select(
            field.alias("field"), F.col("key").alias("text"), "len", "mask", to_number(F.col("key")).alias("number"), "cnt")
        counts.write.mode("overwrite").parquet(self._segment(name))
        rows = spark.read.parquet(self._segment(name)).where(F.col("field") == names[0]).agg(F.sum("cnt")).first()[0] or 0
        manifest = {"segment": name, "batches": [batch_id], "replaces": [], "rows": rows, "fields": names,
                    "order": max((m["order"] for m in known), default=-1) + 1}
        return create_once(spark, f"{self.path}/manifests/{name}.json", json.dumps(manifest))

    def counts(self, spark: SparkSession) -> DataFrame | None:
        """(field, text, len, mask, number, cnt) over all batches."""
        manifests = self._manifests(spark)
        if not manifests:
            return None
        rows = spark.read.parquet(*(self._segment(m["segment"]) for m in manifests))
        # a number follows from its text; by its bits, so that no two forms of it part
        return rows.groupBy("field", "text", "len", "mask").agg(F.sum("cnt").alias("cnt"), F.max("number").alias("number"))

    def compact(self, spark: SparkSession, most: int = 8) -> bool:
        """Add up the segments into one if there are more than ``most``."""
        manifests = self._manifests(spark)
        if len(manifests) <= most:
            return False
        name = f"merged-{uuid.uuid4().hex[:12]}"
        self.counts(spark).select(*_VALUE, "cnt").write.parquet(self._segment(name))
        fields = list(dict.fromkeys(f for m in manifests for f in m["fields"]))
        merged = {"segment": name, "batches": [b for m in manifests for b in m["batches"]], "replaces": [m["segment"] for m in manifests],
                  "rows": sum(m["rows"] for m in manifests), "fields": fields, "order": manifests[0]["order"]}
        create_once(spark, f"{self.path}/manifests/{name}.json", json.dumps(merged))
        # from here on the old segments count no more; their manifests go last, so that none is without its segment
        for old in merged["replaces"]:
            remove_path(spark, self._segment(old))
        return True

    def profile(self, spark: SparkSession, max_categories: int = MAX_CATEGORIES) -> TableProfile:
        """The profile of all batches so far."""
        manifests, counts = self._manifests(spark), self.counts(spark)
        if counts is None:
            return TableProfile([], self.detectors)
        names = list(dict.fromkeys(f for m in manifests for f in m["fields"]))
        total = sum(m["rows"] for m in manifests)
        keyed = counts.withColumnRenamed("text", "key")
        rows = {r["field"]: r.asDict() for r in keyed.groupBy("field").agg(*frequency_aggregates(self.detectors)).collect()}
        profiles: dict[str, FieldProfile] = {}
        for ordinal, name in enumerate(names):
            if name not in rows:  # a field of batches without rows
                continue
            row = rows[name]
            filled = row["total_values"] - row["null_count"]
            row |= {"ordinal": ordinal, "total_values": total, "null_count": total - filled}
            profiles[name] = judge(row, name, self.detectors)
        self._fill_categories(counts, profiles, max_categories)
        self._fill_moments(counts, profiles)
        for profile in profiles.values():
            profile.rules = make_rules(profile, self.detectors)
        return TableProfile(list(profiles.values()), self.detectors)

    def _fill_categories(self, counts: DataFrame, profiles: dict[str, FieldProfile], most: int) -> None:
        categorical = [p.field for p in profiles.values() if p.is_categorical]
        if not categorical:
            return
        order = Window.partitionBy("field").orderBy(F.col("cnt").desc(), F.col("text").asc())
        leading = counts.where(F.col("field").isin(categorical) & F.col("text").isNotNull())
        leading = leading.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        for row in sorted(leading.collect(), key=lambda r: r["rank"]):
            profile = profiles[row["field"]]
            profile.categories.append(row["text"])
            profile.category_frequencies[row["text"]] = row["cnt"]

    def _fill_moments(self, counts: DataFrame, profiles: dict[str, FieldProfile]) -> None:
        numeric = [p.field for p in profiles.values() if p.detected_type in NUMERIC_TYPES]
        if not numeric:
            return
        x, n = F.col("number"), F.col("cnt")
        values = counts.where(F.col("field").isin(numeric) & x.isNotNull())
        means = values.groupBy("field").agg(F.min(x).alias("low"), F.max(x).alias("high"), F.sum(n).alias("n"), (F.sum(x * n) / F.sum(n)).alias("mean"))
        # a row for each field; deviations from the mean, so that large numbers lose nothing
        squares = values.join(F.broadcast(means.select("field", "mean")), "field").groupBy("field").agg(
            F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))).alias("squares"))
        for row in means.join(squares, "field").collect():
            profile = profiles[row["field"]]
            profile.min_value, profile.max_value, profile.mean_value = row["low"], row["high"], row["mean"]
            profile.std_value = (row["squares"] / (row["n"] - 1)) ** 0.5 if row["n"] > 1 else None
