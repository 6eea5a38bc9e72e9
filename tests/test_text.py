import unicodedata

import pytest
from pyspark.sql import functions as F

from clipmill.functions import fields, text


def apply(spark, expression, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def char_width(char):
    if unicodedata.category(char) in ("Mn", "Me", "Cf", "Cc") or 0x1160 <= ord(char) <= 0x11FF:
        return 0
    return 2 if unicodedata.east_asian_width(char) in ("W", "F") else 1


def brute_width(value, columns):
    if sum(map(char_width, value)) <= columns:
        return value
    used, out = 0, ""
    for char in value:
        if used + char_width(char) > columns - 1:
            break
        used += char_width(char)
        out += char
    return out + "…"


def test_truncate_chars(spark):
    got = apply(spark, lambda c: text.truncate_chars(c, 5), ["abcdefghij", "abcde", "", None])
    assert got == ["abcd…", "abcde", "", None]
    assert apply(spark, lambda c: text.truncate_chars(c, 4), ["日本語テキスト"]) == ["日本語…"]


@pytest.mark.parametrize("columns", [1, 5, 6, 80])
def test_truncate_width_matches_a_character_walk(spark, columns):
    values = [
        "日本語テキスト",
        "abcdefghij",
        "hello",
        "",
        "a日b本c語d",
        "é" * 60,
        "日́本́語́テ",
        "\n\n\nabcdefgh",
        "x" + "́" * 500 + "yyyyyyyyyyyyyyy",
        "x" + "́" * 900,
        "한국어 텍스트입니다",
        "ｆｕｌｌ width",
        "ｶﾀｶﾅ half",
        "😀😀😀😀",
        "￿日￿本￿",
        "Ünïcödé Ωmega пример",
        "tab\tand\x00nul",
        "long " * 40 + "語" * 50,
    ]
    got = apply(spark, lambda c: text.truncate_width(c, columns), [*values, None])
    assert got == [*[brute_width(v, columns) for v in values], None]


def test_human_bytes(spark):
    sizes = [0, 1023, -5, 1024, 1280, 2048, 5_500_000, 1024**3, 1024**4, 5000 * 1024**4, None]
    assert apply(spark, text.human_bytes, sizes, "bigint") == [
        "0 B", "1023 B", "-5 B", "1.0 KB", "1.2 KB", "2.0 KB", "5.2 MB", "1.0 GB", "1.0 TB", "5000.0 TB", None,
    ]


def test_one_decimal_rounds_the_exact_value(spark):
    values = [0.15, 0.25, 0.35, 2.5, 1234567.05, -0.25, 0.0]
    assert apply(spark, text.seconds_text, values, "double") == [f"{v:.1f}s" for v in values]


def test_elapsed_text(spark):
    got = apply(spark, text.elapsed_text, [0.0, 59.9, 60.0, 3661.0], "double")
    assert got == ["0:00", "0:59", "1:00", "61:01"]


def test_clean_text(spark):
    got = apply(spark, text.clean_text, ["  a b\t\n", " 　x ", " \n ", "", None])
    assert got == ["a b", "x", None, None, None]


def test_small_pieces(spark):
    assert apply(spark, text.short_id, ["0123456789", "abc"]) == ["01234567", "abc"]
    assert apply(spark, text.or_dash, ["x", None]) == ["x", "-"]
    long_label = apply(spark, lambda c: text.label_text(c, F.lit(1)), ["end_of_turn", "a_very_long_label_key"])
    assert long_label == ["end_of_turn=1", "a_very_long_label…"]
    pair = spark.createDataFrame([(0.15, 12.0)], "a double, b double")
    assert pair.select(text.time_range(F.col("a"), F.col("b"))).head()[0] == "0.1–12.0s"


def test_label_to_endpoint(spark):
    assert apply(spark, fields.label_to_endpoint, ["end_of_turn", "continuation"]) == [1, 0]
    with pytest.raises(Exception, match="speaker_change"):
        apply(spark, fields.label_to_endpoint, ["speaker_change"])


def test_clip_rel_path(spark):
    got = apply(spark, fields.clip_rel_path, ["clips/abc.wav", "clips/clips/a.wav", "abc.wav", "xclips/a.wav"])
    assert got == ["abc.wav", "clips/a.wav", "abc.wav", "xclips/a.wav"]


def test_json_fields(spark):
    documents = ['{"a":"x","n":5}', '{"a":5,"n":"5"}', '{"a":null,"n":5.0}', "{}", "not json", None]
    assert apply(spark, lambda c: fields.json_text(c, "$.a"), documents) == ["x", "-", "-", "-", "-", "-"]
    assert apply(spark, lambda c: fields.json_long(c, "$.n"), documents) == [5, None, None, None, None, None]
