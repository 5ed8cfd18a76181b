"""The translation cache asks for each missing text once."""

from pyspark.sql import functions as F

from bazaarlake.streaming.translations import TranslationCache


def test_only_misses_are_translated_and_kept(spark, tmp_path):
    asked = []

    def provider(missing):
        asked.append(sorted(r.src_text for r in missing.collect()))
        return missing.withColumn("dst_text", F.when(F.col("src_text") != "空", F.concat(F.lit("en:"), "src_text")))

    rows = spark.createDataFrame([(1, "红", "plain"), (2, "红", "蓝"), (3, None, ""), (4, "空", "红")], "id int, a string, b string")
    cache = TranslationCache(spark, str(tmp_path / "c"), "p", 4)
    want = [(1, "en:红", "plain"), (2, "en:红", "en:蓝"), (3, None, ""), (4, "空", "en:红")]
    assert sorted(map(tuple, cache.translate(rows, ["a", "b"], provider).collect())) == want
    again = TranslationCache(spark, str(tmp_path / "c"), "p", 4)
    assert sorted(map(tuple, again.translate(rows, ["a", "b"], provider).collect())) == want
    assert asked == [["空", "红", "蓝"], ["空"]]
    assert sorted((r.src_lang, r.src_text, r.dst_text, r.provider) for r in again.read("translations").collect()) == [("zh", "红", "en:红", "p"), ("zh", "蓝", "en:蓝", "p")]
    other = TranslationCache(spark, str(tmp_path / "c"), "q", 4)
    other.translate(rows, ["a"], provider)
    assert asked[-1] == ["空", "红"] and other.read("translations").count() == 3
