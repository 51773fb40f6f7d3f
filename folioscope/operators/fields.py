"""Fields by rules: the first match of each rule in reading order, with a link to its evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


@dataclass(frozen=True)
class Rule:
    """What to look for: a pattern (its first group, or else the whole match) or a label and its value."""

    name: str
    value_type: str = "string"
    pattern: str | None = None
    required: bool = False
    block_types: tuple[str, ...] = ()

    def value(self, text: Column) -> Column:
        if self.pattern is None:
            return tx.label_value(self.name.replace("_", " "), text)
        group = 1 if _groups(self.pattern) else 0
        matched = text.rlike(f"(?U){self.pattern}")
        return F.when(matched, F.regexp_extract(text, f"(?U){self.pattern}", group))


def _groups(pattern: str) -> bool:
    import re

    return bool(re.search(r"(?<!\\)\((?!\?)", pattern))


def extract(items: DataFrame, rules: list[Rule], key: str, order: list[str], text: str = "raw_text") -> DataFrame:
    """(key, name, value_type, raw_value, normalized_value, evidence, needs_review, missing) per document and rule.

    A value needs review when its evidence does; a required rule without a match is missing.

    Each rule is a column, and the first match of each is a partial aggregate:
    no join with the rules, and no document is gathered.
    """
    position = F.struct(*order)
    firsts = []
    for k, rule in enumerate(rules):
        value = rule.value(F.col(text))
        if rule.block_types and "block_type" in items.columns:
            value = F.when(F.col("block_type").isin(*rule.block_types), value)
        found = F.when(value.isNotNull(), F.struct(position.alias("at"), value.alias("value"), F.col("item_id").alias("item"), (F.col("needs_review") if "needs_review" in items.columns else F.lit(False)).alias("review")))
        firsts.append(F.min(found).alias(f"_f{k}"))
    wide = items.groupBy(key).agg(*firsts)
    entries = [F.struct(F.lit(r.name).alias("name"), F.lit(r.value_type).alias("value_type"), F.lit(r.required).alias("required"), F.col(f"_f{k}.value").alias("raw_value"), F.col(f"_f{k}.item").alias("evidence"), F.col(f"_f{k}.review").alias("review")) for k, r in enumerate(rules)]
    long = wide.select(key, F.explode(F.array(*entries)).alias("f")).select(key, "f.*")
    return long.select(
        key,
        "name",
        "value_type",
        "raw_value",
        F.col("raw_value").alias("normalized_value"),
        "evidence",
        F.coalesce("review", F.lit(False)).alias("needs_review"),
        (F.col("required") & F.col("raw_value").isNull()).alias("missing"),
    )
