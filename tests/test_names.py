"""Names of units come from documents that are cut to the first names they may give."""

from pyspark.sql import functions as F

from tidepool.plans import adapter as ad


def test_documents_are_cut_before_units_are_joined(spark, tmp_path):
    words = [f"{a}{b}wordword" for a in "zyxdcba" for b in "ba"]
    docs = spark.createDataFrame([(0, " ".join(words), "en"), (1, None, "en"), (2, "aawordword", "en")], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = ad.words_of(spark, str(tmp_path), "[a-z]{9,12}", most=ad.MOST_NAMES).collect()
    assert sorted(r["name"] for r in got if r["doc_id"] == 0) == sorted(words)[:5] and len(got) == 6
    of_doc = ad.first_names(ad.words_of(spark, str(tmp_path), "[a-z]{9,12}"), "doc_id").collect()
    assert sorted(map(tuple, of_doc)) == sorted(map(tuple, got))


def test_cut_documents_give_the_names_of_whole_ones(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.translate(F.substring(F.sha2(F.concat("id", i), 256), 1, 10), "0123456789", "ghijklmnop"))).alias("text"), F.lit("en").alias("lang"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    units = spark.range(40).select((F.col("id") % 7).alias("unit_id"), F.col("id").alias("doc_id"))
    names = [sorted(map(tuple, ad.first_names(units.join(ad.words_of(spark, str(tmp_path), "[a-z]{9,12}", most=n), "doc_id").select("unit_id", "name").distinct()).collect())) for n in (ad.MOST_NAMES, None)]
    assert names[0] == names[1] and len(names[0]) == 35
