"""Splitting oversized items at natural boundaries.

Each text is cut by one bounded-quantifier regular expression whose alternatives are ordered
by the strength of the boundary they end on: end of text, blank line, line, sentence, white
space, and at last any character. The matches tile the text exactly, so joining them gives it
back. The overlap is looked up in the matches before, and time grows in proportion to the text. Everything is built-in
SQL on one row at a time: no shuffle, and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size limit by file ending, and the limit of everything else.
LIMITS = {".py": 2000, ".md": 1500, ".markdown": 1500}
OTHER_LIMIT = 800
OVERLAP = 100
STRIDE = 64  # parts whose lengths are added at once

# White space as Unicode has it.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def size_limit(file: Column) -> Column:
    """Limit in code points for a file name; null and unknown endings get ``OTHER_LIMIT``."""
    out = F.lit(OTHER_LIMIT)
    for ending, limit in LIMITS.items():
        out = F.when(F.lower(file).endswith(ending), F.lit(limit)).otherwise(out)
    return F.when(file.isNull(), F.lit(OTHER_LIMIT)).otherwise(out)


def strip(text: Column) -> Column:
    """Text without white space at both ends."""
    return F.regexp_replace(text, rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def boundary_pattern(limit: int, overlap: int) -> str:
    """Expression whose consecutive matches are at most ``limit - overlap`` code points."""
    most, half = limit - overlap, (limit - overlap) // 2
    return (
        rf"(?s).{{1,{most}}}\z"
        rf"|.{{{half},{most}}}(?<=\n[ \t]{{0,8}}\r?\n)"
        rf"|.{{{half},{most}}}(?<=\n)"
        rf"|.{{{half},{most}}}(?<=[.!?;:][{WHITE}])"
        rf"|.{{1,{most}}}(?<=[{WHITE}])"
        rf"|.{{1,{most}}}"
    )


def split_oversized(
    df: DataFrame, text: str = "content", file: str = "prov_source_file", overlap: int = OVERLAP
) -> DataFrame:
    """One row per piece of each text, in reading order.

    Adds ``piece``, ``piece_index`` (from 0), ``piece_start`` (code points before the new part),
    ``piece_overlap`` (code points repeated from before), ``is_cut`` (text exceeded its limit)
    and ``is_forced`` (it has a run without white space longer than the limit); columns of these
    names in the input are replaced. Text is measured after stripping. Null text gives one row
    with null piece; text of white space only gives one row with an empty piece. Repeated rows
    are cut alike, each on its own. All other columns pass through.
    """
    if not 0 <= overlap <= min(OTHER_LIMIT, *LIMITS.values()) // 3:
        raise ValueError("the overlap must be at most a third of every limit")
    made = ["piece", "piece_index", "piece_start", "piece_overlap", "is_cut", "is_forced", "__text", "__limit", "__parts", "__lengths", "__sums", "__pieces", "__piece"]
    kept = [c for c in df.columns if c not in made]
    t, limit = F.col("__text"), F.col("__limit")
    df = df.select(
        *kept, strip(F.col(text)).alias("__text"), size_limit(F.col(file)).alias("__limit")
    )
    cut = F.length(t) > limit
    pieces, forced = F.array(t), F.lit(False)
    for n in sorted({OTHER_LIMIT, *LIMITS.values()}):
        pattern = boundary_pattern(n, overlap)
        pieces = F.when(cut & (limit == n), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(pieces)
        forced = F.when(cut & (limit == n), t.rlike(rf"(?:\A|[{WHITE}])[^{WHITE}]{{{n + 1}}}")).otherwise(forced)
    df = df.select(
        *kept, F.coalesce(cut, F.lit(False)).alias("is_cut"),
        F.coalesce(forced, F.lit(False)).alias("is_forced"), pieces.alias("__parts"),
    )
    df = df.withColumn("__lengths", F.transform("__parts", lambda p: F.length(p)))
    # Running sums by groups of parts, as a list that grows by one part at a time would be copied each time.
    groups = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("__parts") - 1) / STRIDE).cast("int")), lambda g: F.aggregate(F.slice("__lengths", g * STRIDE + 1, STRIDE), F.lit(0), lambda x, n: x + n)
    )
    sums = F.aggregate(groups, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    df = df.withColumn("__sums", sums)

    def piece(part: Column, i: Column) -> Column:
        g = F.floor(i / STRIDE).cast("int")
        # Named twice, or the optimizer would add all lengths again for each piece.
        start = F.coalesce(F.get("__sums", g), F.element_at("__sums", -1)) + F.aggregate(F.slice("__lengths", g * STRIDE + 1, i % STRIDE), F.lit(0), lambda x, n: x + n)
        # After a part shorter than the overlap comes one that is longer, so two hold it.
        before = F.concat(F.coalesce(F.get("__parts", i - 2), F.lit("")), F.coalesce(F.get("__parts", i - 1), F.lit("")))
        back = F.when(F.length(before) > overlap, F.substring(before, F.length(before) - overlap + 1, F.lit(overlap))).otherwise(before)
        return F.struct(F.coalesce(start, F.lit(0)).alias("piece_start"), F.length(back).alias("piece_overlap"), F.concat(back, part).alias("piece"))

    df = df.withColumn("__pieces", F.transform("__parts", piece))
    # The outer form, as the plain one makes the optimizer cut each text once more to count its parts.
    df = df.select(*kept, "is_cut", "is_forced", F.posexplode_outer("__pieces").alias("piece_index", "__piece"))
    return df.select(*kept, "is_cut", "is_forced", "piece_index", "__piece.piece_start", "__piece.piece_overlap", "__piece.piece")
