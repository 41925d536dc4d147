"""The pipeline's near duplicates come through fingerprints as operator 2's do, and are then compared exactly."""

import numpy as np

from leafmill.llm import shingle_dedup as S
from leafmill.llm.common import shared_folder


def test_links_of_fingerprints_alone(spark):
    """No two classes share a band; what is linked was found by fingerprints, and has passed the exact check."""
    base, other = np.arange(100, dtype=np.uint64), np.arange(1000, 1100, dtype=np.uint64)
    held = {1: base, 2: base[3:], 3: base[:95], 4: other, 5: base[5:], 6: other[2:]}
    prints = {1: 5, 2: 5 ^ 3, 3: 5, 4: 5, 5: 5 ^ (7 << 40), 6: 99}
    classes = spark.createDataFrame([(k, prints[k], [100 + k]) for k in held], "of long, fp long, bands array<long>")
    sets = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in held.items()], "of long, shingles binary")
    links = S.similar_links(classes, lambda wanted: sets.join(wanted, "of", "left_semi"), spark, shared_folder(spark, "test"))
    # 4 has the fingerprint of 1 and is not similar; 5 and 6 are similar to others and too far by their fingerprints
    assert {(r.a, r.b) for r in links.collect()} == {(2, 1), (3, 1)}
