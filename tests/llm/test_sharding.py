"""The shard store: contents, interleaved writers, old readers, retention."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.llm import sharding

SCHEMA = "doc_id long, text string, shard string, level int, _metadata string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(400)}" for _ in range(n))


def docs_of(spark, ids):
    return spark.createDataFrame([(i, words(30, i), None, 1, "m") for i in ids], SCHEMA)


def held(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def want(ids):
    return Counter((i, words(30, i)) for i in ids)


@pytest.fixture
def store(spark, tmp_path):
    return sharding.ShardStore(spark, f"file://{tmp_path}/store", target=60_000, fanout=3, least=2_000)


def data_files(tmp_path):
    return {str(p) for p in tmp_path.glob("store/data/*/*.parquet")}


def test_shards_merge_by_size_and_keep_every_row(spark, store):
    for k in range(6):
        before = store.versions()
        store.append(docs_of(spark, range(k, 900, 6)).repartition(3))
        assert store.versions()[-1] == (before[-1] if before else 0) + 1
        store.compact()
    assert not store.plan(store.shards())
    assert held(store.read(1)) == want(range(0, 900, 6)) and held(store.read()) == want(range(900))
    assert any(s.level > 0 for s in store.shards()) and all(s.bytes < 2 * store.target for s in store.shards())
    got = sharding.shard_of_rows(store, "doc_id", "text", "shard", "_metadata").collect()
    assert Counter((r.doc_id, r.text) for r in got) == want(range(900)) and {r._metadata for r in got} == {"m"}
    assert {(r.shard, r.shard_bytes, r.level) for r in got} == {(s.path.rsplit("/", 1)[1], s.bytes, s.level) for s in store.shards()}


def test_runs_of_a_round_become_a_file_each_with_their_own_level(spark, store):
    store.append(docs_of(spark, range(1500)).repartition(30))
    runs = store.plan(store.shards())
    assert len(runs) > 2
    store.compact()
    assert len(store.shards()) >= len(runs) and all(s.bytes <= store.target * 1.1 for s in store.shards())
    small = docs_of(spark, range(1500, 1530)).repartition(3)
    store.append(small)
    store.append(docs_of(spark, range(1530, 1560)).repartition(3))
    levels = Counter(s.level for s in store.shards())
    store.compact()
    assert max(s.level for s in store.shards()) <= max(levels) + 1
    assert held(store.read()) == want(range(1560))


def test_columns_of_later_shards_outlive_their_merge(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/wide", target=60_000, fanout=2, least=2_000)
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1))
    store.append(spark.createDataFrame([(2, "b", "x")], "doc_id long, text string, source string").coalesce(1))
    assert store.read(1).columns == ["doc_id", "text"]
    assert store.compact() and store.vacuum(versions=1, age=0)
    assert {tuple(r) for r in store.read().select("doc_id", "text", "source").collect()} == {(1, "a", None), (2, "b", "x")}
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("3", "c")], "doc_id string, text string"))


def test_nulls_repeats_and_empty_arrivals(spark, store):
    with pytest.raises(ValueError):
        store.read()
    assert store.compact() is None and store.vacuum(age=0) == 0
    store.append(docs_of(spark, []))
    assert store.read().count() == 0 and store.compact() is None
    rows = spark.createDataFrame([(None, None, None, None, None), (1, "", None, 1, ""), (1, "", None, 1, ""), (2, "x" * 200_000, "s", 2, "")], SCHEMA)
    store.append(rows.repartition(4))
    store.compact()
    assert held(store.read()) == Counter([(None, None), (1, ""), (1, ""), (2, "x" * 200_000)])
    assert sharding.shard_of_rows(store, "doc_id").count() == 4


def meanwhile(store, monkeypatch, what):
    """Run ``what`` once, after the store has written its files and before it commits."""
    write, todo = store._write, [what]

    def written(*args):
        out = write(*args)
        if todo:
            todo.pop()()
        return out

    monkeypatch.setattr(store, "_write", written)


def test_interleaved_writers_lose_nothing(spark, store, monkeypatch, tmp_path):
    other = sharding.ShardStore(spark, store.root, target=60_000, fanout=3, least=2_000)
    store.append(docs_of(spark, range(100)).repartition(4))
    meanwhile(store, monkeypatch, lambda: other.append(docs_of(spark, range(100, 200)).repartition(4)))
    assert store.append(docs_of(spark, range(200, 300)).repartition(4)) == 3  # the second to commit tries again
    assert held(store.read()) == want(range(300))
    monkeypatch.undo()
    meanwhile(store, monkeypatch, lambda: other.append(docs_of(spark, range(300, 320)).coalesce(1)))
    assert store.compact()  # a merge beside an arrival
    assert held(store.read()) == want(range(320))
    monkeypatch.undo()
    store.append(docs_of(spark, range(320, 400)).repartition(8))
    meanwhile(store, monkeypatch, other.compact)
    store.compact()  # the other writer has merged the same shards: this merge is dropped, with its files
    assert held(store.read()) == want(range(400))
    named = {x["path"].removeprefix("file:") for v in store.versions() for x in store.manifest(v)["shards"]}
    assert data_files(tmp_path) <= named


def test_a_version_is_committed_once(spark, store):
    store.append(docs_of(spark, range(10)))
    store.append(docs_of(spark, range(10)))
    with pytest.raises(sharding.ConflictError):
        store.commit([], 2, None)
    assert store.versions() == [1, 2]


def test_vacuum_retains_versions_and_young_files(spark, store, monkeypatch, tmp_path):
    for k in range(4):
        store.append(docs_of(spark, range(k * 50, k * 50 + 50)).repartition(4))
    store.compact()
    old = store.read(2)
    assert store.vacuum() == 0 and store.vacuum(versions=1) == 0  # all files are young
    assert held(old) == want(range(100))
    keep = store.versions()[-2]
    store.vacuum(versions=2, age=0)
    assert store.versions()[0] == keep and held(store.read(keep)) and held(store.read()) == want(range(200))
    with pytest.raises(ValueError):
        store.read(2)
    other = sharding.ShardStore(spark, store.root, target=60_000, fanout=3, least=2_000)
    meanwhile(store, monkeypatch, lambda: other.vacuum(versions=1))  # files of a commit to come are young
    store.append(docs_of(spark, range(200, 250)))
    assert held(store.read()) == want(range(250))
    orphan = tmp_path / "store" / "data" / "dead" / "part-00000-x.parquet"
    orphan.parent.mkdir()
    orphan.write_bytes(b"x")
    assert store.vacuum(versions=99, age=0) == 1 and not orphan.exists()


def plain_runs(shards, target, fanout, least):
    """Paths of the runs that the rule of sizes gives: tiers by factors of ``fanout``, smallest first, up to the target."""
    tiers = {}
    for path, size in shards.items():
        if 2 * size <= target:
            tier, limit = 0, least
            while size >= limit:
                tier, limit = tier + 1, limit * fanout
            tiers.setdefault(tier, []).append((size, path))
    runs = []
    for own in tiers.values():
        if len(own) >= fanout:
            run, total = [], 0
            for size, path in sorted(own):
                if run and total + size > target:
                    runs.append(run)
                    run, total = [], 0
                run.append(path)
                total += size
            runs.append(run)
    return sorted(sorted(r) for r in runs if len(r) > 1)


def test_every_version_follows_the_rule_of_sizes(spark, store):
    """The history of a store, version by version, from the files that are there: which runs were merged, into how many files, of
    which level."""
    for k in range(5):
        store.append(docs_of(spark, range(k * 300, k * 300 + 300)).repartition(3 + k))
        store.compact()
    before = {}
    merges = 0
    for v in store.versions():
        now = {s.path: s for s in store.shards(v)}
        gone, new = set(before) - set(now), set(now) - set(before)
        assert all(os.path.getsize(p.removeprefix("file:")) == s.bytes for p, s in now.items())
        if gone:
            merges += 1
            runs = plain_runs({p: s.bytes for p, s in before.items()}, store.target, store.fanout, store.least)
            assert gone == {p for r in runs for p in r} and len(new) == len(runs)
            assert Counter(now[p].level for p in new) == Counter(1 + max(before[p].level for p in r) for r in runs)
        else:
            assert all(now[p].level == 0 for p in new)
        before = now
    assert merges > 2 and held(store.read()) == want(range(1500))


def test_plans_of_a_round_stay_small_whatever_the_runs(spark, store, monkeypatch):
    monkeypatch.setattr(sharding, "RUNS_AT_ONCE", 5)
    scans, write = [], store._write

    def written(df, *args):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return write(df, *args)

    store.append(docs_of(spark, range(4000)).repartition(120))
    runs = store.plan(store.shards())
    monkeypatch.setattr(store, "_write", written)
    store.compact()
    assert len(runs) > 10 and max(scans) <= 5 and sum(scans) >= len(runs)
    assert held(store.read()) == want(range(4000)) and not store.plan(store.shards())


def test_manifests_are_changes_with_snapshots(spark, store, monkeypatch):
    monkeypatch.setattr(sharding, "SNAPSHOT_EVERY", 4)
    small = docs_of(spark, range(10)).coalesce(1)
    for _ in range(10):
        store.append(small)
    texts = [store._text(store._manifest_path(v)) for v in store.versions()]
    assert all(len(t["added"]) == 1 and not t["removed"] and "shards" not in t for t in texts)  # a commit writes its own change
    assert [v for v in store.versions() if store.files.exists(store._snapshot_path(v))] == [4, 8]
    assert [len(store.shards(v)) for v in store.versions()] == list(range(1, 11))
    store.compact()
    store.vacuum(versions=1, age=0)
    assert len(store.versions()) == 1 and held(store.read()) == Counter({k: 10 * n for k, n in want(range(10)).items()})
    store.append(small)
    assert store.read().count() == 110
    # a manifest of an old store holds all shards
    old = sharding.ShardStore(spark, store.root + "-old")
    old._put({"version": 1, "schema": None, "shards": [s.__dict__ for s in store.shards()]}, old._manifest_path(1))
    assert old.shards() == store.shards() and old.read().count() == 110
    old.append(small)
    assert old.read().count() == 120


def test_tables_of_files_that_are_too_large_to_broadcast(spark, store, monkeypatch):
    monkeypatch.setattr(sharding, "BROADCAST_FILES", 0)
    store.append(docs_of(spark, range(300)).repartition(12))
    store.compact()
    assert held(store.read()) == want(range(300)) and sharding.shard_of_rows(store, "doc_id").where("shard is not null and level >= 0").count() == 300
