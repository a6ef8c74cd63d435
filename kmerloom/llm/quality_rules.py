"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document.  The ledger keeps the
measurements and one bit per failed rule; policies are versioned bitmasks
over it, so a new policy or an ablation is bitwise arithmetic on a narrow
table and never touches a text again.

Defined results: a null text has no words, lines or symbols and so fails
``few_words``; repeated rows give repeated ledger rows; an empty table
gives an empty ledger; columns of the input other than the key and the text
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import SPACES

SYMBOLS = "#*$%&|<>"

#: Bit of a rule: its place here.  New rules go to the end.  Conditions say when a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
)
BITS = {name: i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the rules to enforce."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BITS[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
STANDARD = Policy("standard-1", tuple(BITS))


def measurements(docs: DataFrame, key: str = "doc_id", text: str = "text", row: bool = False) -> DataFrame:
    """One row per document: the key and what the rules look at; with ``row`` the input row as a struct, too.

    A repeated word stands in a 3-word window that the text holds twice or
    more.  Windows are hashed once, sorted next to their equals inside the
    row, and the covered positions are summed from the gaps between starts,
    so a row costs n log n whatever its length and nothing is shuffled.
    """
    blank = F.lit(SPACES)
    body = F.coalesce(F.col(text), F.lit(""))
    carried = ["_row"] if row else []
    spaced = docs.select(
        F.col(key).alias("doc_id"),
        *([F.struct("*").alias("_row")] if row else []),
        body.alias("_text"),
        F.translate(body, SPACES, " " * len(SPACES)).alias("_flat"),
    )
    split = spaced.select(
        "doc_id",
        *carried,
        "_text",
        F.filter(F.split("_flat", " "), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, blank) != "").alias("_lines"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.char_length(F.translate("_flat", " ", "")).cast("long").alias("word_chars"),
    )
    return split.select(
        "doc_id",
        *carried,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
    )


def _repeat_words() -> Column:
    return F.expr(
        """
        if(size(_words) < 3, 0L, element_at(transform(
          array(sort_array(transform(sequence(0, size(_words) - 3), i ->
            struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) as h, i as i)))),
          s -> element_at(transform(
            array(sort_array(transform(
              filter(transform(s, (x, k) -> if(
                  coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false), x.i, -1)),
                p -> p >= 0), p -> p))),
            p -> aggregate(transform(p, (v, k) -> if(k = 0, 3, least(3, v - get(p, k - 1)))),
                           0L, (a, b) -> a + b)), 1)), 1))
        """
    )


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", row: bool = False) -> DataFrame:
    """Measurements and ``failed_bits``: bit i is set where rule i of ``RULES`` fails.

    The partition number in the bits' expression changes nothing, but keeps
    the optimizer from copying all measurements into filters on the bits.
    """
    bits = [F.expr(f"if({cond}, {1 << i}L, 0L)") for i, (_, cond) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measurements(docs, key, text, row).withColumn("failed_bits", F.when(F.spark_partition_id() >= 0, total))


def passes(policy: Policy) -> Column:
    """True where a ledger row fails no rule of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger with the policy's version, its failing bits and the verdict."""
    return rows.withColumns(
        {
            "policy": F.lit(policy.version),
            "policy_bits": F.col("failed_bits").bitwiseAND(F.lit(policy.mask)),
            "kept": passes(policy),
        }
    )


def keep_passing(docs: DataFrame, policy: Policy = STANDARD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that pass the policy, with all their columns."""
    return ledger(docs, key, text, row=True).where(passes(policy)).select("_row.*")


def ablations(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that only it rejects.

    One aggregation over the ledger; ``kept_without`` is what the policy
    would keep if the rule were dropped.
    """
    bits = F.col("failed_bits").bitwiseAND(F.lit(policy.mask))
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(bits == 0).alias("kept")]
    for r in policy.rules:
        one = 1 << BITS[r]
        aggs += [
            F.count_if(bits.bitwiseAND(F.lit(one)) != 0).alias(f"f_{r}"),
            F.count_if(bits == one).alias(f"s_{r}"),
        ]
    total = rows.agg(*aggs)
    return total.select(
        "n",
        "kept",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(policy.version).alias("policy"),
                        F.lit(r).alias("rule"),
                        F.col(f"f_{r}").alias("failed"),
                        F.col(f"s_{r}").alias("failed_alone"),
                        (F.col("kept") + F.col(f"s_{r}")).alias("kept_without"),
                    )
                    for r in policy.rules
                ]
            )
        ).alias("r"),
    ).select("r.*", "kept", "n")
