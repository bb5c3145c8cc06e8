"""Sets of packages: unique by id, each element with its own variant and so its own edges.

``members`` holds (id, variant); attributes are joined from the catalogue when needed, so set algebra
moves two narrow columns only.  All of it is semi and anti joins, which adaptive execution may
broadcast when a side turns out small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackageSet:
    members: DataFrame  # id, variant; unique by id
    catalog: object
    #: the members' rows of the catalogue where they are at hand: the set is one load
    rows: DataFrame | None = None

    def with_(self, members: DataFrame) -> "PackageSet":
        return PackageSet(members.select("id", "variant"), self.catalog)

    def ids(self) -> DataFrame:
        return self.members.select("id")

    def union(self, other: "PackageSet") -> "PackageSet":
        """The left element wins on equal ids."""
        extra = other.members.join(self.ids(), "id", "left_anti").select("id", "variant")
        return PackageSet(self.members.unionByName(extra), self.catalog.merged(other.catalog))

    def subtract(self, other: "PackageSet") -> "PackageSet":
        return self.with_(self.members.join(other.ids(), "id", "left_anti"))

    def intersect(self, other: "PackageSet") -> "PackageSet":
        return self.with_(self.members.join(other.ids(), "id", "left_semi"))

    def xor(self, other: "PackageSet") -> "PackageSet":
        return self.subtract(other).union(other.subtract(self))

    def packages(self) -> DataFrame:
        """Members with their attributes."""
        if self.rows is not None:
            return self.rows.select("id", "variant", *[c for c in self.rows.columns if c not in ("id", "variant")])
        base = self.members.withColumn("__v", F.split_part("variant", F.lit("#"), F.lit(1)))
        return base.join(self.catalog.packages.withColumnRenamed("variant", "__v"), ["id", "__v"]).drop("__v")

    def sorted(self) -> DataFrame:
        return self.members.orderBy("id")


def union_all(sets: list[PackageSet]) -> PackageSet:
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out
