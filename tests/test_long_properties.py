"""Properties keep up to 120 characters."""

from placekit.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_values_of_nine_characters_stay_whole(spark):
    got = [(r.k, r.v) for r in catalogue.queries()["prop_clean_120"](spark, SF).collect()]
    props = [r.props.strip() for r in spark.read.parquet(f"{SF}/events.parquet").collect() if (r.props or "").strip()]
    assert sorted(v for k, v in got if k == "props") == sorted(props) and max(map(len, props)) > 8
    assert {len(v) for k, v in got if k == "long"} == {120}
