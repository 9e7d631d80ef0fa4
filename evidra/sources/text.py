"""Evidence blocks from text columns: lines with anchors, sparse units, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What ends a line and what counts as blank, as in Python's str.splitlines and str.strip.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPARSE_BELOW = 20


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def is_sparse(text: Column) -> Column:
    """Fewer than 20 characters once stripped; null counts as empty."""
    return F.length(stripped(F.coalesce(text, F.lit("")))) < SPARSE_BELOW


def split_lines(text: Column) -> Column:
    """The lines of a text: a byte-order mark is dropped, and what follows the last line end counts only if not empty."""
    lines = F.split(F.regexp_replace(text, "^\\x{FEFF}", ""), F.lit(LINE_END), F.lit(-1))
    return F.transform(F.array(lines), lambda x: F.when(F.get(x, F.size(x) - 1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))[0]


def line_blocks(df: DataFrame, source: str, text: str, *keep: str) -> DataFrame:
    """A block for each line: ``source``, ``keep``, ord (from 1), anchor L{ord}, kind, text and disposition.

    A null or empty text has no lines; blank lines are blocks.
    """
    lines = df.select(source, *keep, F.posexplode_outer(split_lines(F.col(text))).alias("ord", "text")).where("ord is not null")
    return lines.select(source, *keep, (F.col("ord") + 1).alias("ord"), F.concat(F.lit("L"), F.col("ord") + 1).alias("anchor"), F.lit("text").alias("kind"), "text", F.lit("parsed").alias("disposition"))


def coverage(blocks: DataFrame, issues: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """blocks, needs_review and issues, for each value of ``by`` or in all."""
    by = by or []
    total = blocks.groupBy(*by).agg(F.count("*").alias("blocks"), F.count_if(F.col("disposition") != "parsed").alias("needs_review"))
    if issues is None:
        total = total.withColumn("issues", F.lit(0).cast("long"))
    elif by:
        total = total.join(issues.groupBy(*by).agg(F.count("*").alias("issues")), by, "left").fillna(0, ["issues"])
    else:
        total = total.crossJoin(issues.agg(F.count("*").alias("issues")))
    return total.withColumn("semantic_extraction", F.lit("not_performed"))


def opinions(blocks: DataFrame, kind: str = "kind", kinds: tuple[str, ...] = ("comment", "insertion", "deletion")) -> DataFrame:
    """Blocks that carry an opinion, waiting for semantic review."""
    return blocks.where(F.col(kind).isin(*kinds)).withColumn("status", F.lit("pending_semantic_review"))


def quoted(value: Column) -> Column:
    """A value as a JSON string; null as the empty one."""
    one = F.to_json(F.array(F.coalesce(value.cast("string"), F.lit(""))))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def row_text(*columns: str) -> Column:
    """A row as a JSON array of strings."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[quoted(F.col(c)) for c in columns]), F.lit("]"))
