import unicodedata as U

from pyspark.sql import functions as F

from skeinkg.llm import textform


def forms(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r["text"]: r["out"] for r in textform.with_consistent_form(df, "text", "out").collect()}


def test_cases(spark):
    cases = {
        "ｔａｐｅ ２": "tape 2", "𝐈𝐕 𝟏𝟗": "IV 19", "Ire\u0300ne": "Irène", "a\u200bb\u00adc\ufeff": "abc", "a\u00a0b\u2009c": "a b c", "ﬁrst": "first", "Sеrrvіtz": "Serrvitz", "Νοrbridge ΙΙ": "Norbridge II",
        "машина": "машина", "cобрал машину": "собрал машину", "伊蕾娜•塞尔维茨": "伊蕾娜·塞尔维茨", "ノｰﾄ": "ノート", "か\u3099": "が", "⽂⻢": "文马", "，。“”—…": "，。“”—…", "• item": "• item", "डॉ. ड़": U.normalize("NFC", "डॉ. ड़"), "": "", "فی": "في",
        "q\u0307\u0323": "q\u0323\u0307", "ệ": "ệ", "e\u0302\u0323": "ệ", "номер Н88": "номер Н88", "番号Н88": "番号H88", "B книге A Calculus": "В книге A Calculus", "Temsen B работает c нами": "Temsen B работает с нами",
    }
    got = forms(spark, [*cases, None, *cases])
    assert {k: v for k, v in got.items() if k is not None} == cases and got[None] is None


def test_equals_canonical_composition(spark):
    texts = ["".join(chr(c) for c in range(a, a + 40) if U.category(chr(c)) not in ("Cn", "Cs", "Cc", "Cf", "Zs") and U.normalize("NFKC", chr(c)) == U.normalize("NFC", chr(c))) for a in (*range(0xC0, 0x240, 40), *range(0x1E00, 0x1EF0, 40))]
    got = forms(spark, texts + [U.normalize("NFD", t) for t in texts])
    same = [t for t in texts if got[t] == U.normalize("NFC", t)]
    assert len(same) == len(texts)
    assert all(got[U.normalize("NFD", t)] == U.normalize("NFC", t) for t in texts)


def test_long_texts_and_idempotence(spark):
    long = ("Ｉrène ｔａｐｅ e\u0301 " * 1200).strip()
    once = forms(spark, [long])[long]
    assert once == ("Irène tape é " * 1200).strip() and forms(spark, [once])[once] == once


def test_sieve_is_exact(spark):
    texts = ["plain", "Irène", "伊蕾娜·塞尔维茨", "он был", "のドラム", "x\u200by", "аn", "А"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    quiet = {r[0] for r in df.where(~textform.calls_for_work(F.col("text"))).collect()}
    assert quiet == {"plain", "Irène", "伊蕾娜·塞尔维茨", "он был", "のドラム"}


def test_clashing_columns(spark):
    df = spark.createDataFrame([("ａ", "k", "x")], "text string, form string, k string")
    r = textform.with_consistent_form(df, "text", "out").first()
    assert (r["out"], r["form"], r["k"]) == ("a", "k", "x")
    assert textform.consistent_texts(df.limit(0)).count() == 0


def test_control_characters_of_ascii_texts(spark):
    got = forms(spark, ["ab\x07c", "\x00tape", "tape\x7f", "a\x1fb", "a\tb\r\nc ~"])
    assert got == {"ab\x07c": "abc", "\x00tape": "tape", "tape\x7f": "tape", "a\x1fb": "ab", "a\tb\r\nc ~": got["a\tb\r\nc ~"]}
    assert spark.createDataFrame([("a\tb\r\nc ~",)], "text string").where(textform.calls_for_work(F.col("text"))).count() == 0


def test_korean_syllables_and_lone_letters(spark):
    words = ["한국어", "값없다", "가각갂힣"]
    texts = [U.normalize("NFD", w * 40) for w in words] + ["ㅋㅋㅋ", "ﾡ", "ᄀ", "각ᆨ"]
    got = forms(spark, texts)
    assert [got[t] for t in texts] == [w * 40 for w in words] + ["ㅋㅋㅋ", "ㄱ", "ᄀ", "각ᆨ"]
    # a lone letter goes with the Cyrillic word behind it, whatever letter it is, but not behind Latin words and numbers
    lone = {"он и K городу": "он и К городу", "5 M в час": "5 M в час", "René A пишет": "René A пишет", "ёж с A домом": "ёж с А домом"}
    assert forms(spark, list(lone)) == lone
