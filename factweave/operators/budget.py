"""Fitting ranked items and sections into a token or character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHARS_PER_TOKEN, estimate_tokens

# Mark of a cut text, separators.
CUT_MARK = "\n… контекст усечён по бюджету токенов"
SECTION_BREAK = "\n\n"


def fit_evidence(items: DataFrame, budget: Column) -> DataFrame:
    """Per question: items in rank order that still fit; one too large is left out and later ones are tried.

    ``items``: query_id, items (array of (id, cost), at most ten, in rank order).
    """
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0).cast("bigint").alias("spent"))

    def step(s, x):
        fits = x["cost"] <= budget - s["spent"]
        return F.struct(
            F.when(fits, F.concat(s["taken"], F.array(x["id"]))).otherwise(s["taken"]).alias("taken"),
            F.when(fits, s["spent"] + x["cost"]).otherwise(s["spent"]).alias("spent"),
        )

    return items.withColumn("_f", F.aggregate("items", start, step)).select("*", "_f.taken", "_f.spent").drop("_f")


def fit_sections(rows: DataFrame, budget: int, protected: tuple[str, ...] = (), header: int = 64) -> DataFrame:
    """Text of the sections that fit; the least important unprotected ones leave first, one section always stays.

    ``sections``: array of (label, body), most important first. If the rest is still too long it is cut and marked.
    """
    block = lambda s: F.concat(s["label"], F.lit("\n"), F.trim(s["body"]))
    keep = F.filter("sections", lambda s: F.trim(F.coalesce(s["body"], F.lit(""))) != "")
    blocks = F.transform(keep, lambda s: F.struct(s["label"].alias("label"), block(s).alias("text"), s["label"].isin(*protected).alias("fixed") if protected else F.lit(False).alias("fixed")))
    size = lambda arr: F.aggregate(arr, F.lit(-2), lambda a, b: a + 2 + F.length(b["text"]))
    tokens = lambda n: F.when(n > 0, (n / F.lit(CHARS_PER_TOKEN)).cast("int") + 1).otherwise(0)
    # Going from the last section up: drop while too long, unless protected or the only one left.
    state = F.struct(size(F.col("_b")).alias("size"), F.size("_b").alias("left"), F.slice("_b", 1, 0).alias("kept"), F.array().cast("array<string>").alias("dropped"))

    def step(s, b):
        drop = (tokens(s["size"]) > budget) & ~b["fixed"] & (s["left"] > 1)
        return F.struct(
            F.when(drop, s["size"] - 2 - F.length(b["text"])).otherwise(s["size"]).alias("size"),
            F.when(drop, s["left"] - 1).otherwise(s["left"]).alias("left"),
            F.when(drop, s["kept"]).otherwise(F.concat(F.array(b), s["kept"])).alias("kept"),
            F.when(drop, F.concat(s["dropped"], F.array(b["label"]))).otherwise(s["dropped"]).alias("dropped"),
        )

    done = rows.withColumn("_b", blocks).withColumn("_s", F.aggregate(F.reverse("_b"), state, step))
    text = F.array_join(F.transform("_s.kept", lambda b: b["text"]), SECTION_BREAK)
    limit = int(max(budget - header, 256) * CHARS_PER_TOKEN)
    out = done.withColumn("_t", text).withColumn("truncated", estimate_tokens(F.col("_t")) > budget)
    return out.withColumns({
        "text": F.when(F.col("truncated"), F.concat(F.substring("_t", 1, limit), F.lit(CUT_MARK))).otherwise(F.col("_t")),
        "dropped": F.array_distinct("_s.dropped"),
    }).drop("_b", "_s", "_t")


def active_policy(rows: DataFrame, limit: int = 4000, separator: str = "\n\n") -> DataFrame:
    """Accepted changes joined in order under a character limit; the first always stays, skipped ids are named.

    ``changes``: array of (id, change) of the accepted proposals in creation order.
    """
    start = F.struct(F.array().cast("array<string>").alias("applied"), F.array().cast("array<string>").alias("blocks"), F.array().cast("array<string>").alias("truncated"), F.lit(0).alias("used"))

    def step(s, x):
        block = F.trim(x["change"])
        first = F.size(s["blocks"]) == 0
        extra = F.length(block) + F.when(first, 0).otherwise(len(separator))
        empty = block == ""
        fits = first | (s["used"] + extra <= limit)
        add = lambda name, value, when: F.when(~empty & when, F.concat(s[name], F.array(value))).otherwise(s[name]).alias(name)
        return F.struct(
            add("applied", x["id"], fits), add("blocks", block, fits), add("truncated", x["id"], ~fits),
            F.when(~empty & fits, s["used"] + extra).otherwise(s["used"]).alias("used"),
        )

    out = rows.withColumn("_p", F.aggregate("changes", start, step))
    return out.select("*", F.array_join("_p.blocks", separator).alias("text"), "_p.applied", "_p.truncated").drop("_p")
