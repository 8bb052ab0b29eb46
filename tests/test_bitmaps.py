import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from engramlake.functions import bitmaps


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 32767), max_size=4000), st.sets(st.integers(0, 32767), max_size=4000))
def test_containers_round_trip(a, b):
    def bits(s):
        x = np.zeros(bitmaps.RANGE_BITS, np.uint8)
        x[list(s)] = 1
        return x

    packed = bitmaps._container(bits(a))
    assert set(np.flatnonzero(bitmaps._bits(packed))) == a
    assert len(packed) <= 1 + bitmaps.RANGE_BITS // 8


def test_bit_is_set(spark):
    df = spark.range(0, 32768, 7).selectExpr("bitmap_construct_agg(id) as raw")
    from pyspark.sql import functions as F

    got = spark.range(40).crossJoin(df).select("id", bitmaps.bit_is_set(F.col("raw"), F.col("id").cast("int")).alias("hit")).collect()
    assert {r.id for r in got if r.hit} == set(range(0, 40, 7))
