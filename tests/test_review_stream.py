"""Reviews of a streamed log against the same log as a table."""

import random

from veilspan.operators import review
from veilspan.streaming.review_stream import ROCKS_DB, review_stream, statuses

FINDING = f"doc_id long, {review.ITEM}"
LINKED = {"m:0-1": [(2, 3)], "m:2-3": [(0, 1)], "m:4-5": []}


def test_a_stream_leaves_what_the_table_leaves(spark, tmp_path):
    rng = random.Random(8)
    ids = range(40)
    rows = []
    for d in ids:
        for seq in range(rng.randrange(0, 18)):
            s = rng.choice([0, 2, 6, 7, 79, None])
            target = rng.choice([*LINKED, "m:9-9", "manual:6-8", "manual:0-1", "manual:2-3", None])
            rows.append((d, seq, rng.choice(["accept", "dismiss", "add_missed", "undo", "undo", "accept", "fly"]), target, s, None if s is None else s + rng.choice([1, 2]), rng.choice([None, "ORG"])))
    docs = spark.createDataFrame([(d, "0123456789" * 8) for d in ids], "doc_id long, text string")
    found = spark.createDataFrame([(d, k, *map(int, k[2:].split("-")), "x", "ORG", 0.9, ["ner"], "", None, 2, LINKED[k]) for d in ids for k in LINKED], FINDING)
    schema = "doc_id long, seq long, type string, target_id string, start int, end int, pii_type string"
    for k in range(3):  # three micro-batches
        part = [r for r in rows if r[1] // 6 == k]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/log/{k}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    try:
        actions = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/*")
        q = review_stream(docs, found, actions).writeStream.format("memory").queryName("changes").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").start()
        q.processAllAvailable()
        assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    changes = spark.table("changes")
    log = review.action_rows(spark, rows)
    key = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=repr)
    assert key(statuses(changes, found), "doc_id", "id", "status") == key(review.queue(docs, found, log), "doc_id", "id", "status")
    assert key(changes.where("scope = 'error'"), "doc_id", "seq", "status") == key(review.action_errors(docs, found, log), "doc_id", "seq", "error")
    added = {(r["doc_id"], r["key"]): (r["start"], r["end"]) for r in changes.where("scope = 'item' and startswith(key, 'manual:') and status <> 'gone'").collect()}
    assert added and all(f"manual:{s}-{e}" == k for (_, k), (s, e) in added.items())
