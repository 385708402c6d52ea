"""Line keys meet their shards' filters before the exact table."""

from __future__ import annotations

from tallyframe.llm import line_dedup
from tallyframe.llm.common import mapped


ROWS = [(k, "\n".join([f"often {k % 300}", f"Often {(k + 7) % 300} ", f"once {k}", f"once {k} more"])) for k in range(3000)]


def test_filters_decide_which_lines_meet_the_exact_table(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 64)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    index = line_dedup.LineIndex.build(docs, threshold=10)
    assert index.shards > 1 and index.filters.count() > 1
    found = docs.select("text").transform(mapped, line_dedup._keys_of(1), "name binary, key binary")
    passed = index.maybe_over(found)
    assert found.count() == 12_000 and 6_000 <= passed.count() < 6_100
    assert index.over_in(found).count() == 6_000
    assert {r.n_dropped for r in index.strip(docs).collect()} == {2}
    # without its filters the index drops nothing; with filters that have everything, the exact table still decides
    blind = line_dedup.LineIndex(index.refs, index.filters.limit(0), index.shards, 10, 1)
    assert {r.n_dropped for r in blind.strip(docs).collect()} == {0}
    every = line_dedup._filters(index.refs, 1)
    assert {r.n_dropped for r in line_dedup.LineIndex(index.refs, *every, 10, 1).strip(docs).collect()} == {2}
    assert line_dedup.LineIndex.build(docs.limit(0)).maybe_over(found).count() == 0


def test_filters_of_a_growing_index_split(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 64)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    some, rest = docs.where("doc_id % 300 < 20"), docs.where("doc_id % 300 >= 20")
    small = line_dedup.LineIndex.build(some, threshold=10)
    grown, whole = small.insert(rest), line_dedup.LineIndex.build(docs, threshold=10)
    assert small.shards < grown.shards == whole.shards
    assert sorted(map(tuple, grown.strip(docs).collect())) == sorted(map(tuple, whole.strip(docs).collect()))
    assert sorted(map(tuple, grown.delete(rest).strip(some).collect())) == sorted(map(tuple, small.strip(some).collect()))
