"""Windows of a large benchmark go only to shards that can hold them, and give what a broadcast gives."""

from pyspark.sql import functions as F

from lakewright.llm import decontaminate
from lakewright.llm.common import written


def test_routed_search_gives_what_a_broadcast_gives(spark):
    words = lambda i: [x for k in range(60) for x in (f"w{(i * 7 + k * k) % 97}", f"c{k % 5}", *([f"r{i // 4}"] if k % 6 == 0 else []))]
    docs = spark.createDataFrame([(i, " ".join(words(i))) for i in range(120)] + [(500, None), (501, "")], "doc_id long, text string").repartition(6)
    items = [(i, " ".join(words(i * 3)[i % 11 : i % 11 + 20])) for i in range(40)] + [(90, "nobody says this " * 5), (91, "c1"), (92, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = written(decontaminate.build_index(docs, most=700), "t-index")
    assert index.count() > 6
    sent = lambda size: sorted((r.doc_id, r.n_words, r.items, [tuple(x) for x in r.spans]) for r in decontaminate.search(index, bench, block_bytes=size).collect())
    hit = lambda rows: [(d, n, i, sorted({k for a, b in s for k in range(a, b)})) for d, n, i, s in rows]
    whole = hit(sent(1 << 22))
    assert hit(sent(4000)) == whole and hit(sent(1)) == whole and any(r[2] for r in whole)
    windows = written(decontaminate.windows_of(bench).withColumn("w", F.monotonically_increasing_id()), "t-windows")
    routed = decontaminate._routed(index, windows, 4000).select("shard", F.explode("words").alias("words"))
    assert routed.where(F.array_contains("words", "nobody")).count() == 0
    assert routed.count() < index.count() * windows.count() / 2
