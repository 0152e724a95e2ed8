"""One consistent form for text that looks the same but differs in its characters.

Texts that can hold anything to change (a regular expression decides it exactly) are made distinct and
exploded to positioned code points. A broadcast join with the decomposition table (bounded by Unicode,
some thousand rows) gives each code point its decomposed form, combining class and script; window sums
number words and combining sequences, words decide their script from letters that no other script
shares, combining marks are ordered by class, and a fold over short blocks recomposes and rebuilds the
string. Everything runs in the JVM.

The form: accents composed (canonical composition), letters and digits of ordinary width and style,
Latin/Greek/Cyrillic look-alikes in the script their word is written in, ideographs instead of radicals,
``·`` between the parts of a name, plain blanks, no invisible characters. Punctuation stays as it is.

Defined results: null stays null, empty stays empty; repeated and very long texts are fine (blocks bound
every array); conjoining Hangul jamo are composed, lone ones stay; the input's other columns are kept and may
have any name.
"""

import re
import unicodedata as U
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Letters that look like a Latin letter, Russian letters first (each way), then others (one way).
CYRILLIC, CYRILLIC_LATIN = "аеорсухАВЕКМНОРСТУХ", "aeopcyxABEKMHOPCTYX"
OTHER, OTHER_LATIN = "іѕјһԁԛԝІЅЈԌԚԜοναιρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳͿ", "isjhdqwISJGQWovaipukABEZHIKMNOPTYXjJ"
# Radicals of the CJK supplement without a mapping in Unicode, and the ideographs they look like.
RADICALS = "⺁厂⺈刀⺊卜⺋㔾⺌小⺎兀⺏尢⺐尣⺒巳⺓幺⺔彑⺖忄⺗心⺘扌⺙攵⺛旡⺝月⺞歺⺟母⺠民⺡氵⺢氺⺣灬⺥爫⺧牛⺨犭⺪疋⺬示⺭礻⺮竹⺯糹⺱罓⺲罒⺳网⺶羊⺷羊⺸羋⺹耂⺻聿⺼肉⺾艹⺿艹⻀艹⻁虎⻂衤⻃覀⻄西⻅见⻆角⻇角⻈讠⻉贝⻊足⻋车⻌辶⻍辶⻎辶⻏阝⻐钅⻑長⻒镸⻓长⻔门⻕阝⻖阝⻗雨⻘青⻙韦⻚页⻛风⻜飞⻝食⻟飠⻠饣⻡首⻢马⻣骨⻤鬼⻥鱼⻦鸟⻧卤⻨麦⻩黄⻪黾⻫斉⻬齐⻭歯⻮齿⻯竜⻰龙⻱亀⻲龟"
# Letters of one script that look alike in some of their forms.
SAME_SCRIPT = {"ی": "ي", "ى‍": "ى", "ک": "ك", "ہ": "ه", "ھ": "ه"}
DOTS = "•‧・∙⋅･᛫‣●․ꞏ・ᐧ"
VISIBLE_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
STYLES = ("<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
BLOCK = 64
# First conjoining leads, vowels and tails, first syllable, numbers of vowels and tails.
LEADS, VOWELS, TAILS, SYLLABLES, VOWEL_COUNT, TAIL_COUNT = 0x1100, 0x1161, 0x11A7, 0xAC00, 21, 28


def _script(ch: str) -> str:
    """L, G, C: letters that take part in look-alikes; M: marks; D: dots; H: ideographs; K: kana; X: what ends a word."""
    cat = U.category(ch)
    if cat[0] == "M":
        return "M"
    if ch in DOTS:
        return "D"
    if cat[0] == "L":
        name = U.name(ch, "")
        return next((k for start, k in (("LATIN", "L"), ("GREEK", "G"), ("COPTIC", "G"), ("CYRILLIC", "C"), ("CJK", "H"), ("HIRAGANA", "K"), ("KATAKANA", "K")) if name.startswith(start)), "X")
    return "K" if ch == "ー" else "X"


@lru_cache(1)
def tables() -> tuple[list[tuple], dict[str, str], str]:
    """Rows (char, parts) of all code points that aren't simply themselves; pairs that compose; the class of characters that call for work."""
    radicals = dict(zip(RADICALS[::2], RADICALS[1::2], strict=True))
    rows, pairs, dirty, seconds = [], {}, [], set()
    for cp in range(0x110000):
        ch = chr(cp)
        cat = U.category(ch)
        if cat in ("Cs", "Cn", "Co"):
            continue
        deco = U.decomposition(ch)
        if deco and deco[0] != "<" and not 0xAC00 <= cp <= 0xD7A3:
            d = U.normalize("NFD", ch)
            if U.normalize("NFC", d) == ch and len(two := deco.split()) == 2:
                pairs["".join(chr(int(x, 16)) for x in two)] = ch
                seconds.add(chr(int(two[1], 16)))
    jamo = {chr(c) for c in (*range(VOWELS, VOWELS + VOWEL_COUNT), *range(TAILS + 1, TAILS + TAIL_COUNT))}
    seconds |= jamo
    for cp in range(0x110000):
        ch = chr(cp)
        cat = U.category(ch)
        if cat in ("Cs", "Cn", "Co") or 0xAC00 <= cp <= 0xD7A3:
            continue
        deco, to = U.decomposition(ch), ch
        if 0x3131 <= cp <= 0x318E and cp != 0x3164:
            pass  # letters of the Korean script that stand alone
        elif 0xFFA1 <= cp <= 0xFFDC:
            to = chr(int(deco.split()[1], 16))
        elif ch in radicals:
            to = radicals[ch]
        elif ch in SAME_SCRIPT:
            to = SAME_SCRIPT[ch]
        elif cp in FILLERS or cat == "Cf" and cp not in VISIBLE_FORMATS or cat == "Cc" and ch not in "\t\n\r":
            to = ""
        elif cat == "Zs":
            to = " "
        elif cat in ("Zl", "Zp"):
            to = "\n"
        elif deco.startswith(STYLES) and (cat[0] == "L" or cat in ("Nd", "Nl") or 0x2E80 <= cp <= 0x2FDF):
            to = U.normalize("NFKC", ch)
        elif any(U.decomposition(c).startswith(STYLES) and U.category(c)[0] == "L" for c in U.normalize("NFD", ch)[:1]):
            to = U.normalize("NFKC", ch)
        parts = [(c, U.combining(c), c in seconds, _script(c)) for c in U.normalize("NFD", to)]
        if U.normalize("NFC", to) != ch or U.combining(ch) or ch in jamo:
            dirty.append(cp)
        elif ch in DOTS or ch in OTHER:
            dirty.append(cp)
        if parts != [(ch, 0, False, "X")] and parts != [(ch, 0, False, "H")]:
            rows.append((ch, parts))
    return rows, pairs, _ranges(dirty)


def _ranges(cps: list[int]) -> str:
    out, k = [], 0
    while k < len(cps):
        j = k
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\x{{{cps[k]:X}}}" + (f"-\\x{{{cps[j]:X}}}" if j > k else ""))
        k = j + 1
    return "[" + "".join(out) + "]"


@lru_cache(1)
def _safe() -> str:
    """The class of characters outside the long runs of code points that never call for work, so that most texts need a few comparisons a character."""
    dirty = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", tables()[2]))
    runs = [(0x20, 0x7E), (0x4E00, 0x9FFF), (0x3041, 0x3096), (0x3001, 0x3003), (0xFF01, 0xFF0F), (0xFF1A, 0xFF1F), (0x410, 0x44F), (0xC0, 0x17F), (0x30A1, 0x30FA), (0x2010, 0x201F), (0x621, 0x64A), (0x901, 0x93B), (0x93D, 0x94C), (0x3008, 0x3011)]
    return "[^\\n" + "".join(_ranges([c for c in range(lo, hi + 1) if not dirty.match(chr(c))])[1:-1] for lo, hi in runs) + "·ーёЁ…№«»—।]"


def calls_for_work(text: Column) -> Column:
    """Exactly false only where nothing can change: no character with another form, no word of two scripts, no look-alikes that stand alone."""
    latin, cyrillic = r"[\p{IsLatin}]", r"[\p{IsCyrillic}]"
    mixed = f"{latin}{cyrillic}|{cyrillic}{latin}"
    alone, own = f"[{CYRILLIC}]", f"[\\p{{IsCyrillic}}&&[^{CYRILLIC}]]"
    return text.rlike(r"[^\n\t\r\x20-\x7E]") & ((text.rlike(_safe()) & text.rlike(tables()[2])) | (text.rlike(alone) & (text.rlike(mixed) | ~text.rlike(own))) | (text.rlike(r"[\u0400-\u04FF]") & (text.rlike(mixed) | text.rlike(_lone(CYRILLIC_LATIN)))))


def _lone(letters: str) -> str:
    """One Latin letter as a word of its own before a Cyrillic word, and not behind a Latin one (where it is a name's initial)."""
    return rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?<![\p{{IsLatin}}\p{{N}}]\s)[{letters}](?= [\p{{IsCyrillic}}])"


def _frame(spark: SparkSession) -> DataFrame:
    fields = [("c", pa.string()), ("ccc", pa.int32()), ("second", pa.bool_()), ("script", pa.string())]
    parts = [[dict(zip(("c", "ccc", "second", "script"), p, strict=True)) for p in ps] for _, ps in tables()[0]]
    return spark.createDataFrame(pa.table({"_c": [c for c, _ in tables()[0]], "_parts": pa.array(parts, pa.list_(pa.struct(fields)))}))


def _recomposed(parts: Column) -> Column:
    both = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in tables()[1].items())), F.lit("\x02"), F.lit("\x01"))
    state = lambda out, s, tail, last: F.struct(out.alias("out"), s.alias("s"), tail.alias("tail"), last.alias("last"))

    def step(a: Column, x: Column) -> Column:
        syllable = F.when((x.c >= chr(VOWELS)) & (x.c < chr(VOWELS + VOWEL_COUNT)) & (a.s >= chr(LEADS)) & (a.s < chr(LEADS + 19)), SYLLABLES + ((F.ascii(a.s) - LEADS) * VOWEL_COUNT + F.ascii(x.c) - VOWELS) * TAIL_COUNT)
        open_ = (a.s >= chr(SYLLABLES)) & (a.s <= chr(0xD7A3)) & ((F.ascii(a.s) - SYLLABLES) % TAIL_COUNT == 0)
        syllable = syllable.when((x.c > chr(TAILS)) & (x.c < chr(TAILS + TAIL_COUNT)) & open_, F.ascii(a.s) + F.ascii(x.c) - TAILS)
        hangul = F.when((x.c >= chr(VOWELS)) & (x.c < chr(TAILS + TAIL_COUNT)), F.decode(F.unhex(F.hex(syllable.cast("bigint"))), "UTF-16BE"))
        composed = F.when(x.second & (a.s != "") & ((a["last"] < x.ccc) | ((a.tail == "") & (a["last"] == 0))), F.coalesce(hangul, F.try_element_at(both, F.concat(a.s, x.c))))
        plain = F.when(x.ccc == 0, state(F.concat(a.out, a.s, a.tail), x.c, F.lit(""), F.lit(0))).otherwise(state(a.out, a.s, F.concat(a.tail, x.c), x.ccc))
        return F.when(x.second & composed.isNotNull(), state(a.out, F.coalesce(composed, F.lit("")), a.tail, a["last"])).otherwise(plain)

    return F.aggregate(parts, state(F.lit(""), F.lit(""), F.lit(""), F.lit(0)), step, lambda a: F.concat(a.out, a.s, a.tail))


def consistent_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(text, form) of each distinct text that calls for work; all other texts are consistent already."""
    spark = texts.sparkSession
    todo = texts.select(F.col(text).alias("text")).where(calls_for_work(F.col("text"))).distinct()
    key = F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"))
    chars = todo.select(key.alias("k"), F.posexplode(F.split("text", "")).alias("pos", "_c"))
    other = F.when(F.col("_c").rlike(r"\p{IsHan}"), "H").otherwise("X")
    itself = F.array(F.struct(F.col("_c").alias("c"), F.lit(0).alias("ccc"), F.lit(False).alias("second"), other.alias("script")))
    parts = chars.join(F.broadcast(_frame(spark)), "_c", "left").select("k", "pos", F.posexplode(F.coalesce("_parts", itself)).alias("sub", "p")).select("k", "pos", "sub", "p.*")
    at = Window.partitionBy("k").orderBy("pos", "sub")
    letter = F.col("script").isin("L", "G", "C")
    numbered = parts.select(
        "*",
        F.sum(F.when(letter | (F.col("script") == "M"), 0).otherwise(1)).over(at).alias("word"),
        F.sum(F.when((F.col("ccc") == 0) & ~F.col("second"), 1).otherwise(0)).over(at).alias("cluster"),
        F.lag("script").over(at).alias("before"),
        F.lead("script").over(at).alias("after"),
        # for a word of one letter: the end of the word before, and the start of the word behind one blank
        F.when(F.lag("script", 2).over(at) == "M", F.lag("script", 3).over(at)).when(F.lag("c", 2).over(at).rlike(r"\p{N}"), "N").otherwise(F.lag("script", 2).over(at)).alias("left"),
        F.when(F.lead("c").over(at) == " ", F.lead("script", 2).over(at)).alias("right"),
    )
    word, whole = Window.partitionBy("k", "word"), Window.partitionBy("k")
    is_ = lambda script, but: F.sum(F.when((F.col("script") == script) & ~F.instr(F.lit(but), F.col("c")).cast("boolean"), 1).otherwise(0))
    counted = numbered.select(
        "*",
        is_("L", CYRILLIC_LATIN).over(word).alias("l"),
        is_("C", CYRILLIC + OTHER).over(word).alias("r"),
        is_("G", OTHER).over(word).alias("g"),
        F.max(F.when(F.col("script") == "C", F.instr(F.lit(OTHER), F.col("c")) > 0)).over(word).alias("foreign"),
        is_("C", CYRILLIC + OTHER).over(whole).alias("rr"),
        is_("G", OTHER).over(whole).alias("gg"),
        is_("L", "").over(whole).alias("ll"),
        is_("L", "").over(word).alias("any_l"),
    )
    mapped = F.translate("c", CYRILLIC + OTHER, CYRILLIC_LATIN + OTHER_LATIN)
    lone = (F.col("l") + F.col("r") + F.col("g")) == 0
    latin = F.when(lone, (F.col("any_l") > 0) & (F.col("ll") >= F.col("rr")) | F.coalesce(F.col("foreign"), F.lit(False)) | F.when(F.col("script") == "G", F.col("gg") == 0).otherwise(F.col("rr") == 0)).otherwise(F.col("l") > F.greatest("r", "g"))
    russian = F.when(lone, (F.col("any_l") > 0) & (F.col("ll") < F.col("rr")) & (F.col("any_c") > 0)).otherwise((F.col("r") > F.greatest("l", "g")))
    counted = counted.withColumn("any_c", F.max((F.col("script") == "C").cast("int")).over(word))
    # a lone letter belongs to the Cyrillic word behind it, unless it stands behind a Latin word or a number (a name's initial, a unit)
    letters = F.col("before").isin("L", "M", "G", "C", "H", "K")
    russian = russian | ((F.col("any_l") == 1) & (F.col("any_c") == 0) & ~F.coalesce(letters, F.lit(False)) & ~F.coalesce(F.col("left").isin("L", "N"), F.lit(False)) & F.coalesce(F.col("right") == "C", F.lit(False)))
    chosen = (
        F.when(F.col("script").isin("G", "C") & latin, mapped)
        .when((F.col("script") == "L") & russian, F.translate("c", CYRILLIC_LATIN, CYRILLIC))
        .when(F.col("script") == "D", F.when(F.col("before").isin("H", "L", "M") & F.col("after").isin("H", "L"), F.lit("·")).when(F.col("c") == "･", F.lit("・")).otherwise(F.col("c")))
        .otherwise(F.col("c"))
    )
    blocks = counted.select("k", (F.col("cluster") / BLOCK).cast("int").alias("block"), F.struct("cluster", "ccc", "pos", "sub", chosen.alias("c"), "second").alias("x"))
    strings = blocks.groupBy("k", "block").agg(_recomposed(F.array_sort(F.collect_list("x"))).alias("s"))
    built = strings.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "s"))), lambda b: b.s), "").alias("form"))
    form = F.coalesce("form", F.lit(""))
    return todo.select("text", key.alias("k")).join(built, "k", "left").select("text", form.alias("form"))


def with_consistent_form(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the consistent form of column ``text`` as column ``out``. Rows and forms are joined by two hashes of the text first, so that sorting compares numbers."""
    key = lambda c: (F.xxhash64(c), F.hash(c))
    forms = consistent_texts(df, text).select(F.col("text").alias("_form_of"), F.col("form").alias("_form"), key("text")[0].alias("_form_a"), key("text")[1].alias("_form_b"))
    rows = df.withColumn("_a", key(text)[0]).withColumn("_b", key(text)[1])
    joined = rows.join(forms, (F.col("_a") == F.col("_form_a")) & (F.col("_b") == F.col("_form_b")) & (F.col(text) == F.col("_form_of")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_form", F.col(text)).alias(out))


def plain_form(consistent: Column) -> Column:
    """Lower case, with everything dropped but letters, combining marks and digits."""
    return F.regexp_replace(F.lower(consistent), r"[^\p{L}\p{M}\p{N}]", "")


def plain_form_of_lines(consistent: Column) -> Column:
    """``plain_form`` of each line."""
    return F.regexp_replace(F.lower(consistent), r"[^\p{L}\p{M}\p{N}\n]", "")
