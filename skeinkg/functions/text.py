"""Text normalisation, splitting and tokens as column expressions. Offsets are code points from 0, half-open."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# White space beyond ASCII, sentence ends, characters that a line break inside a sentence stands between.
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ENDS = "。！？!?"
BEFORE_BREAK = r"[\x{4e00}-\x{9fff}A-Za-z0-9，,、；;：“”\"'（）()]"
AFTER_BREAK = r"[\x{4e00}-\x{9fff}A-Za-z0-9]"
WORD = r"\s+|\p{IsHan}|\p{L}[\p{L}\p{M}]*|[0-9]+|[^\s]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalized(text: Column) -> Column:
    """No byte-order marks, plain blanks and line ends, lines broken inside a sentence joined, blanks squeezed, at most one empty line. Null stays null."""
    t = F.translate(text, "﻿　 ", "\x00  ")
    t = F.replace(t, F.lit("\x00"), F.lit(""))
    t = F.regexp_replace(t, r"\r\n|\r", "\n")
    t = F.regexp_replace(t, f"(?<={BEFORE_BREAK})\n(?={AFTER_BREAK})", "")
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    t = F.regexp_replace(t, "\n +", "\n")
    t = F.regexp_replace(t, " +\n", "\n")
    return stripped(F.regexp_replace(t, "\n{3,}", "\n\n"))


def slug(name: Column) -> Column:
    """Everything but letters, digits, ideographs and hyphens as single underscores, none at the ends; ``document`` if nothing is left."""
    s = F.regexp_replace(name, r"[^\p{L}\p{N}_\x{4e00}-\x{9fff}-]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("document"))


def paragraphs(text: Column) -> Column:
    """array of paragraphs between empty lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n\n"), stripped), lambda p: p != "")


def split_at_ends(text: Column, ends: str = ENDS) -> Column:
    """array of sentences, each with its end mark; lone end marks are dropped."""
    parts = F.transform(F.split(text, f"(?<=[{ends}])\\s*"), stripped)
    return F.filter(parts, lambda s: (s != "") & ~s.isin("。", "！", "？"))


def sentence_table(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, ends: str = ENDS) -> DataFrame:
    """(key, paragraph_index from 0, sentence_index from 1, text) of the sentences with at least ``least`` characters."""
    p = docs.select(key, F.posexplode(paragraphs(normalized(F.col(text)))).alias("paragraph_index", "_p"))
    s = p.select(key, "paragraph_index", F.posexplode(split_at_ends(F.col("_p"), ends)).alias("_k", "text")).where(F.length("text") >= least)
    order = Window.partitionBy(key).orderBy("paragraph_index", "_k")
    return s.select(key, "paragraph_index", F.row_number().over(order).alias("sentence_index"), "text")


def tokens(text: Column) -> Column:
    """array<struct<text, start, end>> of words, single ideographs, numbers and signs; white space is left out."""
    parts = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    empty = F.array().cast("array<struct<text:string,start:int,end:int>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(a: Column, w: Column) -> Column:
        to = a["at"] + F.length(w)
        here = F.array(F.struct(w.alias("text"), a["at"].alias("start"), to.alias("end")))
        return F.struct(to.alias("at"), F.when(w.rlike(r"^\s"), a["out"]).otherwise(F.concat(a["out"], here)).alias("out"))

    return F.aggregate(parts, state, step, lambda a: a["out"])


def token_table(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token_index from 0, token, start, end), one row a token; offsets are window sums, so texts may be of any length."""
    parts = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))).alias("_k", "token"))
    by = Window.partitionBy(key).orderBy("_k")
    real = ~F.col("token").rlike(r"^\s")
    end = F.sum(F.length("token")).over(by)
    placed = parts.select(key, "token", real.alias("_real"), (F.sum(real.cast("int")).over(by) - 1).cast("int").alias("token_index"), (end - F.length("token")).cast("int").alias("start"), end.cast("int").alias("end"))
    return placed.where("_real").select(key, "token_index", "token", "start", "end")


def zh_or_en(label: Column) -> Column:
    """True where every letter is Han or ASCII and there is any text."""
    return F.coalesce((label != "") & ~label.rlike(r"[\p{L}&&[^\x00-\x7F\x{4e00}-\x{9fff}]]"), F.lit(False))


def feature_bucket(token: Column) -> Column:
    """A few dozen buckets of tokens by kind, length and, for Han, first character."""
    t = stripped(token)
    n = F.least(F.length(t), F.lit(10))
    han, digit, ascii_ = t.rlike(r"[\x{4e00}-\x{9fff}]"), t.rlike(r"\p{Nd}"), t.rlike("[A-Za-z]")
    return (
        F.when(t == "", 0)
        .when(~t.rlike(r"[\p{L}\p{N}]"), 1)
        .when(digit & ~han, 2 + n)
        .when(ascii_ & ~han, 13 + n)
        .when(han & ascii_, 24 + n)
        .otherwise(35 + (F.floor(F.ascii(t) / 500) % 10).cast("int"))
        .cast("int")
    )


def context(text: Column, start: Column, end: Column, width: int) -> Column:
    """The slice from ``width`` characters before to ``width`` after a span."""
    a = F.greatest(start - width, F.lit(0))
    return F.substring(text, a + 1, end + width - a)


def chunks(text: Column, size: int) -> Column:
    """array of consecutive pieces of ``size`` characters; empty for empty text."""
    n = F.length(text)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size))))


def token_features(df: DataFrame, key: str, tokens_column: str = "tokens") -> DataFrame:
    """One row a token with its own features and its neighbours' (null at the ends, where bos or eos is true)."""
    t = df.select(key, F.posexplode(tokens_column).alias("token_index", "t")).select(key, "token_index", F.col("t.text").alias("token"))
    by = Window.partitionBy(key).orderBy("token_index")
    digit = lambda c: c.rlike(r"^\p{Nd}+$")
    before, after = F.lag("token").over(by), F.lead("token").over(by)
    w = F.col("token")
    return t.select(
        key, "token_index", "token", F.lower(w).alias("lower"), F.substring(w, 1, 1).alias("first1"), F.substring(w, 1, 2).alias("first2"), F.right(w, F.lit(1)).alias("last1"), F.right(w, F.lit(2)).alias("last2"),
        digit(w).alias("is_digit"), w.rlike(r"^[\x00-\x7F]*$").alias("is_ascii"), F.length(w).alias("len"), w.rlike(r"[\x{4e00}-\x{9fff}]").alias("has_han"),
        before.alias("prev_token"), digit(before).alias("prev_is_digit"), after.alias("next_token"), digit(after).alias("next_is_digit"), before.isNull().alias("bos"), after.isNull().alias("eos"),
    )
