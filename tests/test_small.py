"""Purged contents, vectors as bytes, notes under the ids of a corpus."""

import math
import struct

import pytest

from notelake.operators import evaluation, mutations, vectors


def test_purge_keeps_shared_contents(spark):
    contents = spark.createDataFrame([(h, h) for h in "abcd"], "hash string, payload string")
    uses = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c")], "note_id long, hash string")
    left = lambda *ids: {r.hash for r in mutations.purged(contents, uses, spark.createDataFrame([(i,) for i in ids], "note_id long")).collect()}
    assert left(1) == {"b", "c", "d"} and left(1, 2) == {"d"} and left() == left(9) == set("abcd")


def test_blobs(spark):
    rows = spark.createDataFrame([(1, [1.5, -0.25]), (2, []), (3, None), (4, [None, float("inf")])], "note_id long, embedding array<float>")
    blobs = vectors.to_blobs(rows)
    got = {r.note_id: r.embedding for r in blobs.collect()}
    assert bytes(got[1]) == struct.pack("<2f", 1.5, -0.25) and got[3] is None and not got[2]
    back = {r.note_id: r.embedding for r in vectors.from_blobs(blobs).collect()}
    assert (back[1], back[2], back[3], back[4][1]) == ([1.5, -0.25], [], None, math.inf) and math.isnan(back[4][0])
    with pytest.raises(Exception, match="5 bytes are no vector"):
        vectors.from_blobs(spark.createDataFrame([(1, bytearray(5))], "note_id long, embedding binary")).collect()


def test_hits_under_ids_of_the_corpus(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 99, 2), (1, 11, 3), (2, 99, 1)], "query_id long, note_id long, rank int")
    ids = spark.createDataFrame([(10, "n1"), (11, "n2")], "note_id long, external_id string")
    assert sorted(map(tuple, evaluation.named(ranked, ids).collect())) == [(1, "n1", 1), (1, "n2", 2)]
