"""Visually identical text with different characters: one consistent form.

Texts are exploded to positioned tokens: runs of ASCII, which stand for themselves, and single
other code points, which a broadcast join replaces. A base with combining marks is one token;
the distinct ones of the corpus are taken apart, replaced code point by code point, their marks
put in order of combining class, and composed again. Then texts are rebuilt in order of position.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.shapes import SAME_SHAPE
from quern.session import checkpointed

# Marks other than letters that print alike.
SAME_MARK = {"‐": "-", "‑": "-", " ": "\n", " ": "\n"}
# Format characters that do show something.
SHOWN_FORMATS = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"
# Ranges that show nothing without being format characters.
SHOWS_NOTHING = [
    (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF),
]
# Control characters show nothing, but for tab and line feed; a carriage return before a line feed
# belongs to the line end.
ASCII_NOTHING = r"[\x00-\x08\x0b-\x1f\x7f]"


# Code points that can have a canonical decomposition or a look-alike.
PLANES = [range(0x80, 0x3400), range(0xA000, 0xD800), range(0xF900, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE1000)]


@cache
def _tokens() -> tuple[str, str]:
    """Pattern of a base with marks, and of any token: that, a run of ASCII that no mark follows, or a code point.

    Marks are combining ones that show, and all others that compose with what is before them. Between a base
    and its marks may stand what shows nothing. Letters that make one Hangul syllable are a token too.
    """
    hidden, marks = set(), set()
    for cp in (x for r in PLANES for x in r):
        ch = chr(cp)
        if shows_nothing(ch):
            hidden.add(cp)
        d = unicodedata.normalize("NFD", ch)
        if not 0xAC00 <= cp <= 0xD7A3:
            marks.update(ord(c) for c in d[1:] if unicodedata.category(c) == "Mc")

    def one(cps: set[int]) -> str:
        firsts, lasts = sorted(x for x in cps if x - 1 not in cps), sorted(x for x in cps if x + 1 not in cps)
        return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(firsts, lasts))

    nothing = f"[{one(hidden)}]"
    mark = rf"[\p{{Mn}}\p{{Me}}{one(marks)}&&[^{one(hidden)}]]"
    base = rf"[^\p{{Mn}}\p{{Me}}{one(marks | hidden)}]"
    whole = rf"(?:{base}(?:{nothing}*{mark})+|[\x{{1100}}-\x{{1112}}][\x{{1161}}-\x{{1175}}][\x{{11a8}}-\x{{11c2}}]?)"
    return rf"(?s){whole}", rf"(?s){whole}|[\x00-\x7f]+(?!{nothing}*{mark})|."


@cache
def _letters() -> dict[str, str]:
    return {c: latin for latin, all_ in SAME_SHAPE.items() for c in all_} | SAME_MARK


def shows_nothing(ch: str) -> bool:
    """Whether a code point has no visible form of its own."""
    kind, cp = unicodedata.category(ch), ord(ch)
    if kind == "Cc":
        return ch not in "\t\n"
    return (kind == "Cf" and ch not in SHOWN_FORMATS) or any(a <= cp <= b for a, b in SHOWS_NOTHING)


def apart(ch: str) -> str:
    """A code point's decomposed, width-free, look-alike-free form."""
    if shows_nothing(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    tag = unicodedata.decomposition(ch)
    if tag.startswith(("<wide>", "<narrow>")):
        ch = "".join(chr(int(x, 16)) for x in tag.split()[1:])
    return "".join(_letters().get(c, c) for c in unicodedata.normalize("NFD", ch))


@cache
def mapping() -> list[tuple[str, str, str, int]]:
    """(code point, decomposed form, composed form, combining class) of all that change or are marks."""
    out = []
    for cp in (x for r in PLANES for x in r):
        ch = chr(cp)
        plain = not unicodedata.decomposition(ch) and unicodedata.category(ch) in ("Lo", "Ll", "Lu", "So", "Sm", "Cn", "Nd", "Po")
        if plain and not 0xAC00 <= cp <= 0xD7A3 and ch not in _letters() and not shows_nothing(ch):
            continue
        d, k = apart(ch), unicodedata.combining(ch)
        if d != ch or k:
            out.append((ch, d, unicodedata.normalize("NFC", d), k))
    return out


@cache
def compositions() -> list[tuple[str, str]]:
    """(decomposed, composed) of all code points that stay composed."""
    return [(d, c) for ch, d, c, _ in mapping() if c == ch and len(d) > 1]


def canonical_text(text: str) -> str:
    """The same form for one string, as a plain statement of the rule."""
    d = unicodedata.normalize("NFD", "".join(apart(c) for c in text))
    return unicodedata.normalize("NFC", d)


def _clusters(spark: SparkSession, tokens: DataFrame) -> DataFrame:
    """(token, composed form) of the distinct bases with marks."""
    table = F.broadcast(spark.createDataFrame(mapping(), "cp string, parts string, one string, class int"))
    whole = F.broadcast(spark.createDataFrame(compositions(), "d string, c string"))
    cps = tokens.select("token", F.posexplode(F.split("token", "")).alias("at", "cp"))
    cps = cps.join(table, "cp", "left").select("token", "at", F.coalesce("parts", F.regexp_replace("cp", ASCII_NOTHING, "")).alias("parts"))
    cps = cps.select("token", "at", F.posexplode(F.split("parts", "")).alias("sub", "cp"))
    cps = cps.join(table.select("cp", "class"), "cp", "left").select(
        "token", F.struct(F.coalesce("class", F.lit(0)).alias("class"), "at", "sub", "cp").alias("p")
    )
    d = cps.groupBy("token").agg(F.array_join(F.transform(F.array_sort(F.collect_set("p")), lambda p: p["cp"]), "").alias("d"))
    # Compose the base with as many of its marks as have a composed form: three at most.
    for n in (4, 3, 2):
        d = _compose(d, whole, n)
    return d.select("token", F.col("d").alias("mapped"))


def _compose(d: DataFrame, whole: DataFrame, n: int) -> DataFrame:
    w = whole.select(F.col("d").alias("head"), "c")
    d = d.withColumn("head", F.substring("d", 1, n)).join(F.broadcast(w), "head", "left")
    return d.select("token", F.when(F.col("c").isNotNull(), F.concat("c", F.expr(f"substring(d, {n + 1})"))).otherwise(F.col("d")).alias("d"))


def canonical(df: DataFrame, key: str, text: str, out: str = "canonical") -> DataFrame:
    """Rows (key, text hash, ``out``): the consistent form of each distinct (key, text).

    Width, composition of accents, code points that show nothing, the kind of space and letters of
    equal shape are unified; everything else, letter case included, stays. ``text_hash`` is the
    MD5 of the text as given. Null text gives a null form; empty text an empty one; repeated rows collapse.
    Other columns are dropped, whatever their names.
    """
    spark = df.sparkSession
    whole_pattern, token_pattern = _tokens()
    src = df.select(F.col(key).alias("__k"), F.col(text).alias("__t")).withColumn("__h", F.md5("__t"))
    plain = F.col("__t").isNull() | ~F.col("__t").rlike(r"[^\x00-\x7f]")
    easy = src.filter(plain).select("__k", "__h", F.regexp_replace("__t", ASCII_NOTHING, "").alias(out))
    hard = src.filter(~plain).select("__k", "__h", F.regexp_extract_all("__t", F.lit(token_pattern), F.lit(0)).alias("__x"))
    table = F.broadcast(spark.createDataFrame(mapping(), "cp string, parts string, one string, class int").select("cp", "one"))
    with_marks = F.rlike(F.col("token"), F.lit(rf"\A{whole_pattern}\z"))
    found = src.filter(~plain).select(F.explode(F.regexp_extract_all("__t", F.lit(whole_pattern), F.lit(0))).alias("token"))
    clusters = _clusters(spark, found.distinct())
    tokens = hard.select("__k", "__h", F.posexplode_outer("__x").alias("pos", "token"))
    tokens = tokens.join(table, tokens["token"] == table["cp"], "left").select("__k", "__h", "pos", "token", "one")
    # Only tokens with marks can match here; the others get keys that match nothing and spread evenly.
    want = F.when((F.length("token") > 1) & with_marks, F.col("token")).otherwise(F.concat(F.lit("\x00"), "pos"))
    tokens = tokens.withColumn("cluster", want).join(clusters.withColumnRenamed("token", "cluster"), "cluster", "left")
    form = F.coalesce("mapped", "one", F.regexp_replace("token", ASCII_NOTHING, ""))
    parts = tokens.select("__k", "__h", F.struct("pos", form.alias("form")).alias("p"))
    built = parts.groupBy("__k", "__h").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("p")), lambda p: p["form"]), "").alias(out)
    )
    return easy.distinct().unionByName(built).select(F.col("__k").alias(key), F.col("__h").alias("text_hash"), out)


def _forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text hash, form hash) of the texts whose form another text has too."""
    c = canonical(df, key, text).filter("canonical IS NOT NULL")
    c = checkpointed(c.select(F.col(key).alias("key"), F.unhex("text_hash").alias("text_hash"), F.unhex(F.md5("canonical")).alias("form_hash")))
    several = c.groupBy("form_hash").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).filter("lo <> hi").select("form_hash")
    return c.join(several, "form_hash", "left_semi")


def alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, class, n_texts): keys whose texts print like others, with the least key of their class.

    A class is all keys of one consistent form, if it has two different texts at least. Nothing grows with
    the square of a class.
    """
    c = _forms(df, key, text)
    once = c.groupBy("form_hash", "text_hash").agg(F.min("key").alias("key"))
    heads = once.groupBy("form_hash").agg(F.min("key").alias("class"), F.count("*").alias("n_texts"))
    return c.join(heads, "form_hash").select("key", "class", "n_texts")


def alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (key_a < key_b) of keys whose texts differ but have the same consistent form.

    Keys must name one text each; null texts pair with nothing. Different texts of a form are paired
    first, and only then listed by their keys. Only hashes are shuffled, and only forms that more than one
    distinct text has.
    """
    c = _forms(df, key, text)
    texts = c.select("form_hash", "text_hash").distinct()
    a = texts.select("form_hash", F.col("text_hash").alias("ta"))
    b = texts.select("form_hash", F.col("text_hash").alias("tb"))
    unlike = a.join(b, "form_hash").filter("ta < tb")
    one = c.select("form_hash", F.col("text_hash").alias("ta"), F.col("key").alias("ka"))
    two = c.select("form_hash", F.col("text_hash").alias("tb"), F.col("key").alias("kb"))
    pairs = unlike.join(one, ["form_hash", "ta"]).join(two, ["form_hash", "tb"])
    return pairs.filter("ka <> kb").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()
