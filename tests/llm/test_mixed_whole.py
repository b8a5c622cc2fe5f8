"""The pipeline's mixing stage keeps documents whole, also without ids, and comes near each source's target."""

import collections

from lensgraph.llm import mixing


def test_rows_without_ids_stay_whole(spark):
    rows = [(None, " ".join(f"w{i}x{k}" for k in range(10 + i % 7)), f"s{i % 3}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts, got = {r[1] for r in rows}, mixing.mixed(docs, [3, 1, 2], 1.5).collect()
    assert got and all(r.text in texts for r in got)
    words = collections.Counter()
    for r in got:
        words[r.source] += len(r.text.split())
    target = {r.row.source: r.target for r in mixing.mix(docs, [3, 1, 2], 1.5, keep=["source"]).collect()}
    assert all(abs(words[s] - t) <= 9 for s, t in target.items())
