"""Filter interaction audit: what five filters remove in every order, from counts of failure combinations.

Filters: A under 200 words, B under half of the words distinct, C over 3 % capitals A-Z, D a symbol of
``#$%&*|``, E the same text as a smaller id. A document that fails some of them is one of 32 combinations,
so all 120 orders follow from 32 counts per part; only those leave the scan.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.texts import staged
from furrow.operators.joins import lookup_join

LETTERS = "ABCDE"
COPY = 16  # the bit of filter E
#: Copies of one text that are compared in one sub-group.
GROUP_ROWS = 2000
WHITE = r"'[\\x20\\x09-\\x0D]+'"


def failed_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with ``failed``, bits 1, 2, 4, 8 of the filters A to D, in place of ``text``, which is not null."""
    words = F.call_function("split", F.btrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), F.expr(WHITE))
    # an empty text splits into one empty word
    words = F.when(F.btrim(F.col("text"), F.lit(" \t\n\x0b\f\r")) == "", F.array().cast("array<string>")).otherwise(words)
    split = docs.select("*", words.alias("words"))
    size = F.size("words")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    rules = [size < 200, F.size(F.array_distinct("words")) * 100 < size * 50, capitals * 100 > F.length("text").cast("long") * 3, F.col("text").rlike("[#$%&*|]")]
    failed = sum((F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules)), F.lit(0))
    return split.select(*[c for c in docs.columns if c != "text"], failed.alias("failed"))


def copies(docs: DataFrame, narrow: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, part, hash, size`` of the documents whose text a smaller id has, each once.

    ``docs`` has ``doc_id, part, text, hash, size``, ``narrow`` the same rows without texts. Only texts
    whose hash is there more than once are looked at; they meet the least id of each equal text in a
    left-semi join. Large groups are dealt over sub-groups of about ``group_rows``.
    """
    repeated = narrow.groupBy("hash", "size").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    repeated = repeated.where("n > 1 AND least < most").select("hash", "size", F.ceil(F.col("n") / group_rows).cast("int").alias("groups"))
    found = staged(lookup_join(docs, repeated, ["hash", "size"], how="inner"), "copies")
    first = found.groupBy("hash", "size", "groups", "text").agg(F.min("doc_id").alias("first_id"))
    first = first.select("hash", "text", "first_id", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("own")).alias("r")
    asked = found.withColumn("own", F.pmod(F.xxhash64("doc_id", "part"), F.col("groups")).cast("int")).alias("l")
    same = (F.col("l.hash") == F.col("r.hash")) & (F.col("l.own") == F.col("r.own")) & (F.col("l.text") == F.col("r.text"))
    marked = asked.join(first, same & (F.col("r.first_id") < F.col("l.doc_id")), "left_semi")
    return marked.select("doc_id", "part", "hash", "size").distinct()


def combinations(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``part, failed, n, good, toxic``: rows of each combination of failed filters, of good and of toxic ones.

    A null text is empty, a null part is the empty string. A null id is smaller than none, has no
    smaller one and no label. Rows with the same id and text are counted each; neither is a copy of the
    other. Several labels of one id count as good (toxic) if one of them says so.
    """
    ready = docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    ).select("*", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))
    narrow = staged(failed_rules(ready), "failures")
    marked = copies(ready, narrow, group_rows).select("*", F.lit(COPY).alias("failed"), F.lit(0).alias("n"))
    every = narrow.select("doc_id", "part", "hash", "size", "failed", F.lit(1).alias("n")).unionByName(marked)
    same = every.groupBy("doc_id", "part", "hash", "size").agg(F.bit_or("failed").alias("failed"), F.sum("n").alias("n"))
    per_id = same.groupBy("doc_id", "part", "failed").agg(F.sum("n").alias("n"))
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic")
    )
    joined = per_id.join(said, "doc_id", "left")
    return joined.groupBy("part", "failed").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
    )


def orders(counts: DataFrame) -> DataFrame:
    """Every order and step of every part from ``combinations``: at most 32 rows a part are gathered."""
    gathered = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("c"))
    every = " ".join(map("".join, permutations(LETTERS)))
    steps = gathered.select("part", "c", F.explode(F.split(F.lit(every), " ")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    bit = "shiftleft(1, instr('ABCDE', substring(filter_order, {0}, 1)) - 1)"
    steps = steps.selectExpr("*", f"{bit.format('step')} as own", f"aggregate(sequence(1, 5), 0, (t, i) -> if(i < step, t + {bit.format('i')}, t)) as before")

    def total(name: str, where: str) -> str:
        return f"aggregate(filter(c, x -> {where}), 0L, (t, x) -> t + x.{name})"

    here = "(x.failed & own) <> 0 and (x.failed & before) = 0"
    # of the orders of k failed filters each one comes first, and removes, in the same share
    share = "aggregate(filter(c, x -> (x.failed & own) <> 0), 0L, (t, x) -> t + x.n * (120L div bit_count(x.failed)))"
    return steps.selectExpr(
        "part", "filter_order", "step",
        f"{total('n', '(x.failed & (before | own)) = 0')} as kept",
        f"{total('n', here)} as removed",
        f"{total('n', '(x.failed & own) <> 0 and (x.failed & before) <> 0')} as redundant",
        f"{total('n', 'x.failed = own')} as unique_fails",
        f"{total('good', here)} as good_lost",
        f"{total('toxic', here)} as toxic_lost",
        f"{share} as shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step; an empty table gives no rows."""
    return orders(combinations(docs, labels, key, text, part))
