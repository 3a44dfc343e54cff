"""The stream of trees with keyed state: restarts, batches that run again, and what a batch costs."""

import random

from sylva.streaming.search import _PROVIDER, _ROCKS, follow, settled, stream_collisions

SCHEMA = "n long, digest string, tree_id long"


def trees(seed, n=120):
    rng = random.Random(seed)
    return [(rng.choice([3, 4]), f"d{rng.randrange(12)}", seed * 1000 + i) for i in range(n)]


def brute(rows):
    first = {}
    for n, d, i in sorted(rows, key=lambda r: r[2]):
        first.setdefault((n, d), i)
    return first, sorted((n, d, first[n, d], i) for n, d, i in rows if i != first[n, d])


def result(pair):
    first, pairs = pair
    return {(r.n, r.digest): r.tree_id for r in first.collect()}, sorted(map(tuple, pairs.collect()))


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_goes_on_from_its_checkpoint(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    schema, rows = spark.createDataFrame([], SCHEMA).schema, []
    for seed in (2, 1, 3):  # ids that came later may be smaller
        new = trees(seed)
        for k in range(0, len(new), 40):
            write(spark, new[k : k + 40], source)
        rows += new
        assert result(stream_collisions(spark, source, schema, 2, folder)) == brute(rows)
    told = spark.read.parquet(f"{folder}/told")
    assert told.count() == len(rows) and told.select("tree_id_b").distinct().count() == len(rows)
    # nothing new: nothing happens
    assert result(stream_collisions(spark, source, schema, 2, folder)) == brute(rows)


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    """A stop after a batch has written and before it is committed: the batch comes again and gives no row twice."""
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    schema, rows = spark.createDataFrame([], SCHEMA).schema, trees(5)
    write(spark, rows[:60], source)
    stream_collisions(spark, source, schema, 1, folder)
    write(spark, rows[60:], source)
    stream_collisions(spark, source, schema, 1, folder)
    commits = sorted((p for p in (tmp_path / "state/checkpoint/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert result(stream_collisions(spark, source, schema, 1, folder)) == brute(rows)
    assert spark.read.parquet(f"{folder}/told").count() == len(rows)


def test_a_batch_reads_its_own_rows(spark, tmp_path):
    """Each batch reads its file alone, however many came before, and state has a row a key."""
    source = f"file://{tmp_path}/in"
    rows = trees(7, 200)
    for k in range(0, 200, 40):
        write(spark, rows[k : k + 40], source)
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = follow(stream, f"file://{tmp_path}/told", f"file://{tmp_path}/checkpoint")
        query.awaitTermination()
        done = [p for p in query.recentProgress if p["numInputRows"]]
    finally:
        spark.conf.set(_PROVIDER, old)
    assert [p["numInputRows"] for p in done] == [40] * 5
    first, pairs = settled(spark.read.parquet(f"file://{tmp_path}/told"))
    assert result((first, pairs)) == brute(rows)
    assert sum(int(p["stateOperators"][0]["numRowsTotal"]) > 200 for p in done) == 0
