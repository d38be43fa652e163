"""Results that a narrow fixture would not show."""

from clickcast.operators.explore import profile
from clickcast.sources.clicks import read_score_files


def test_profile_std_of_large_means(spark):
    three = spark.createDataFrame([(1e9,), (1e9 + 1,), (1e9 + 2,)], "x double")
    assert abs(profile(three, ["x"]).first()["std"] - 1.0) < 1e-9
    many = spark.createDataFrame([(1.7e9 + i % 2,) for i in range(1000)], "x double")
    assert abs(profile(many, ["x"]).first()["std"] - 0.50025) < 1e-5
    assert profile(many.limit(1), ["x"]).first()["std"] is None


def test_score_files_drop_malformed_rows_whatever_is_read(spark, tmp_path):
    (tmp_path / "device.csv").write_text("device,prcnt_1,1,custom_score\n1,0.5,2,1.0\n2,bad,2,1.0\n3,0.5,x,1.0\n")
    scores = read_score_files(spark, {"device": str(tmp_path)})["device"]
    assert scores.count() == 1 and scores.select("device", "custom_score").count() == 1
