"""The bit maps of values that tasks get."""

import numpy as np

from prismframe.llm import bm25, common, substring_dedup


def test_a_bit_map_comes_to_the_driver_in_few_rows(spark, monkeypatch):
    rows = []

    def counted(df, collect):
        found = collect(df)
        rows.append(len(found))
        return found

    kind = type(spark.range(0))
    arrow, pandas = kind.toArrow, kind.toPandas
    monkeypatch.setattr(kind, "toArrow", lambda df: counted(df, arrow))
    monkeypatch.setattr(kind, "toPandas", lambda df: counted(df, pandas))
    values = np.random.default_rng(6).integers(-(2**63), 2**63, 300_000)
    df = spark.createDataFrame([(int(v),) for v in values], "value long").repartition(3)
    for made, seed in ((substring_dedup._value_filter, 99), (bm25._filter_of, 7)):
        rows.clear()
        got = made(df)
        at = (common.mix(values.view(np.uint64), seed) % np.uint64(8 * len(got))).astype(np.int64)
        want = np.zeros(8 * len(got), np.uint8)
        want[at] = 1
        assert len(got) == 1 << 19 and (np.packbits(want, bitorder="little") == got).all()
        assert rows == [4]  # before, one row for each 32 bits
    assert not made(df.where("false")).any()
