"""The quartile ranges alone set the bands."""

import numpy as np

from larder.llm import common, fertility

DATA = "/root/testdata/sf0.001"


def test_texts_beyond_the_quartile_ranges_go(spark):
    rows = [r for r in fertility.verdicts(spark.read.parquet(f"{DATA}/documents.parquet"), common.tokenizer_dir()).collect() if not r["base_failed"]]
    near = 0
    for family in {r["family"] for r in rows}:
        own = [r for r in rows if r["family"] == family]
        for c in ("chars_per_token", "chars_per_byte_token"):
            lo, mid, hi = np.quantile([r[c] for r in own], [0.25, 0.5, 0.75], method="inverted_cdf")
            for r in own:
                if hi > lo and not lo - 4.5 * (hi - lo) <= r[c] <= hi + 4.5 * (hi - lo):
                    assert not r["kept"]
                    near += abs(r[c] - mid) < 0.2 * mid
    assert near  # texts that a floor of a quarter of the median would keep
    assert sum(r["kept"] for r in rows) > 0.8 * len(rows)
