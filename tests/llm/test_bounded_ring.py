"""Bounded-load ring against a walk of every document, and its guarantees."""

import hashlib
import zlib
from collections import Counter

import pytest

from stockroom.llm import bounded_ring as br

SCHEMA = "doc_id long, text string, shard string, slot int, rank int"


def shards_by_walking(rows, shards):
    """Each document asks shard after shard clockwise, round by round in ring order."""

    places = {}
    for shard in range(shards):
        for node in range(br.VIRTUAL_NODES):
            place = int(hashlib.md5(f"{shard}:{node}".encode()).hexdigest()[:4], 16)
            places[place] = min(shard, places.get(place, shard))
    digests = [hashlib.md5((t or "").encode()).hexdigest() for _, t in rows]
    asks = []
    for digest in digests:
        start = int(digest[:4], 16)
        clockwise = sorted(places, key=lambda p: ((p < start), p))
        asks.append(list(dict.fromkeys(places[p] for p in clockwise)))
    bound = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    order = sorted(range(len(rows)), key=lambda i: (digests[i][:20], rows[i][0] is not None, rows[i][0] or 0))
    shard_of = {}
    for asked in range(shards):
        for i in order:
            if i not in shard_of and bound[asks[i][asked]]:
                shard_of[i] = asks[i][asked]
                bound[asks[i][asked]] -= 1
    return [shard_of[i] for i in range(len(rows))]


def run(spark, rows, shards):
    return br.sharded(spark.createDataFrame([(*row, "x", 1, 2) for row in rows], SCHEMA), shards).collect()


@pytest.mark.parametrize(("n", "shards"), [(400, 16), (37, 5), (3, 16)])
def test_equals_walk_and_bounds(spark, n, shards):
    rows = [(i, f"text {i * 7919}") for i in range(n)]
    rows += [(None, None), (n + 1, ""), (n + 2, None), (0, rows[0][1]), (0, rows[0][1]), (n + 3, "é" * 20_000)]
    rows += [(1000 + i, "copies") for i in range(n // 2)]
    got = run(spark, rows, shards)
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((i, s) for (i, _), s in zip(rows, shards_by_walking(rows, shards), strict=True))
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for shard in counts:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_most_documents_stay_when_a_shard_is_added(spark):
    rows = [(i, f"text {i}") for i in range(2000)]
    before, after = ({r.doc_id: r.shard for r in run(spark, rows, n)} for n in (16, 17))
    assert sum(before[i] != after[i] for i in before) < 0.5 * len(rows)


def test_nothing(spark):
    assert run(spark, [], 16) == []
