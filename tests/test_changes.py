from datetime import datetime

from corvane.operators import changes, index

SCAN = "document_id string, size long, mtime_ns long, revision string, seen_at timestamp, note string"
STATE = "document_id string, size long, mtime_ns long, revision string, status string, indexed_revision string, index_signature string, error_code string, updated_at timestamp, note int"
BUILD = "build_id string, started_at timestamp, index_signature string"


def t(n):
    return datetime(2024, 1, 1, n)


def test_due(spark, tmp_path):
    ledger = (changes.Ledger(spark, str(tmp_path / f"ledger{n}")) for n in range(9))
    scan = [("a", 1, 1, "AA", t(1), "x"), ("b", 1, 1, "bb", t(1), None), ("b", 2, 1, "bb", t(2), None), ("c", 1, 1, "cc", t(1), None), ("c", 1, 1, "cc", t(1), None), ("d", 1, 1, None, t(1), None), ("e", 1, 1, "ee", None, None), (None, 1, 1, "x", t(1), None)]
    state = [tuple(dict(i=i, s=1, m=1, r=r, st=st, ir=ir, sig=sig, e=None, u=u, n=1).values()) for i, r, st, ir, sig, u in [
        ("a", "aa", "indexed", "Aa", "s", t(3)), ("a", "zz", "failed", None, None, t(2)), ("b", "bb", "indexed", "bb", "S", t(3)), ("c", "cc", "indexed", "cc", "old", t(3)), ("d", None, "indexed", None, "S", t(3))]]
    builds = spark.createDataFrame([("1", t(1), "old"), ("2", t(2), "S")], BUILD)
    got = changes.due(next(ledger), spark.createDataFrame(scan, SCAN), spark.createDataFrame(state, STATE), builds)
    assert sorted(r["document_id"] for r in got.collect()) == ["b", "c", "d", "e"]
    assert got.columns == [c.split()[0] for c in SCAN.split(", ")]
    none = changes.due(next(ledger), spark.createDataFrame(scan, SCAN), spark.createDataFrame([], STATE), spark.createDataFrame([], BUILD))
    assert none.count() == 5
    assert changes.due(next(ledger), spark.createDataFrame([], SCAN), spark.createDataFrame(state, STATE), builds).count() == 0


def test_ledger_survives_expiry_and_stale_writers(spark, tmp_path):
    ledger = changes.Ledger(spark, str(tmp_path / "ledger"))
    items = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "1"), (None, "1")], "item string, version string")
    ledger.offer(items, 0)
    ledger.offer(items, 1)
    first = [tuple(r) for r in ledger.lease("w1", 2, 10).collect()]
    assert sorted(r[:2] for r in first) == [("a", "1"), ("b", "1")]
    assert ledger.lease("w2", 3, 10).count() == 0
    # w1 dies; its leases expire and go to w2
    second = [tuple(r) for r in ledger.lease("w2", 20, 10).collect()]
    assert sorted(r[:2] for r in second) == [("a", "1"), ("b", "1")] and second[0][2] > first[0][2]
    stale = spark.createDataFrame([(*r[:2], "old") for r in first], "item string, version string, value string")
    assert ledger.finish(stale, first[0][2], "w1", 21).count() == 2
    fresh = spark.createDataFrame([(*r[:2], v) for r in second for v in ("new", "newer")], stale.schema)
    assert ledger.finish(fresh, second[0][2], "w1", 22).count() == 2  # the token of another
    assert ledger.finish(fresh, second[0][2], "w2", 22).count() == 0
    assert ledger.finish(fresh, second[0][2], "w2", 23).count() == 0
    assert sorted((r["item"], r["value"]) for r in ledger.results(24).collect()) == [(i, v) for i in "ab" for v in ("new", "newer")]
    assert {r["state"] for r in ledger.states(99).collect()} == {"done"}
    # a newer version supersedes; the old one offered again is known as done
    ledger.offer(spark.createDataFrame([("a", "2"), ("a", "3")], items.schema), 30)
    ledger.offer(spark.createDataFrame([("a", "4")], items.schema), 30)
    assert [r["version"] for r in ledger.lease("w3", 31, 5, 1).collect()] == ["4"]
    ledger.offer(spark.createDataFrame([("a", "1")], items.schema), 40)
    assert ledger.lease("w3", 41, 5).count() == 0


def test_two_that_lease_at_once(spark, tmp_path, monkeypatch):
    ledger, other = (changes.Ledger(spark, str(tmp_path / "ledger")) for _ in range(2))
    ledger.offer(spark.createDataFrame([("a", "1"), ("b", "1")], "item string, version string"), 0)
    claim, met = changes.storage.claim, []

    def late(spark, path, text):  # the other one commits between the look at the states and the claim
        if not met:
            met.append(1)
            met.extend(other.lease("B", 1, 10, 1).collect())
        return claim(spark, path, text)

    monkeypatch.setattr(changes.storage, "claim", late)
    mine = ledger.lease("A", 1, 10).collect()
    assert [r["item"] for r in met[1:]] == ["a"] and [r["item"] for r in mine] == ["b"] and mine[0]["token"] > met[1]["token"]
    assert len(list((tmp_path / "ledger" / "events").iterdir())) == 3  # what the first try wrote is gone
    rows = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], "item string, version string, value string")
    assert [r["item"] for r in ledger.finish(rows, mine[0]["token"], "A", 2).collect()] == ["a"]
    assert [(r["item"], r["value"]) for r in ledger.results(3).collect()] == [("b", "y")]
    files = sorted(p.name for p in (tmp_path / "ledger" / "results").rglob("part=0"))
    ledger.finish(rows, mine[0]["token"], "A", 2)
    assert files == sorted(p.name for p in (tmp_path / "ledger" / "results").rglob("part=0")) and ledger.results(3).count() == 1


def test_compaction_keeps_the_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "COMPACTED", 3)
    ledger = changes.Ledger(spark, str(tmp_path / "ledger"))
    for n in range(4):
        ledger.offer(spark.createDataFrame([(i, str(n)) for i in "abc"], "item string, version string"), n)
        token = ledger.lease("w", n, 100, 2).first()["token"]
        ledger.finish(spark.createDataFrame([("a", str(n), n)], "item string, version string, value int"), token, "w", n)
        states = {(r["item"], r["version"]): (r["state"], r["owner"]) for r in ledger.states(n).collect()}
        assert {k: v for k, v in states.items() if k[1] == str(n)} == {("a", str(n)): ("done", "w"), ("b", str(n)): ("leased", "w"), ("c", str(n)): ("pending", None)}
    assert len(ledger._since()[1]) <= 4 and sorted(r["value"] for r in ledger.results(9).collect()) == [0, 1, 2, 3]


def test_index_state(spark, tmp_path):
    manifest = spark.createDataFrame([("a", 1, 1, "r", "indexed", "r", "s", None, t(1), 1), ("b", 1, 1, "r", "indexed", "r", "s", None, t(1), 1), ("c", 1, 1, "r", "deleted", None, None, None, t(1), 1)], STATE)
    scan = spark.createDataFrame([("a", 1, 1, "R", t(1), None), ("n", 1, 1, "q", t(1), None)], SCAN)
    from pyspark.sql import functions as F

    assert {r[0]: r[1] for r in index.difference(scan, manifest, F.lit("s")).collect()} == {"a": "unchanged", "n": "new", "b": "missing", "c": "missing"}
    assert [(r["document_id"], r["status"]) for r in index.missing(scan, manifest).collect()] == [("b", "deleted")]
    store = index.Snapshots(spark, str(tmp_path / "m"))
    assert store.read() is None
    (tmp_path / "m").mkdir()
    store.write(manifest)
    store.write(index.upsert(store.read(), manifest.where("document_id = 'a'").withColumn("size", F.lit(7).cast("long")), "document_id", "updated_at"))
    assert {r["document_id"]: r["size"] for r in store.read().collect()} == {"a": 7, "b": 1, "c": 1}
    assert index.signature({"b": 1, "a": 2}) == index.signature({"a": 2, "b": 1}) != index.signature({"a": 3, "b": 1})


def test_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from corvane.operators import files

    a = spark.createDataFrame([("x", "AA"), ("y", "bb"), ("z", None)], "path string, digest string")
    b = spark.createDataFrame([("x", "aa"), ("y", "cc"), ("w", "1")], "path string, digest string")
    assert {r[0]: r[1] for r in files.drift(a, b).collect()} == {"x": "same", "y": "differs", "z": "absent", "w": "extra"}
    w = spark.createDataFrame([(0,), (5,), (510,), (511,), (1200,)], "n int").select("n", files.model_windows(F.col("n")).alias("w")).collect()
    for r in w:
        covered = set().union(*[range(x["first"], x["last"]) for x in r["w"]]) if r["w"] else set()
        assert covered == set(range(r["n"])) and all(x["last"] - x["first"] <= 510 for x in r["w"])
    assert len(w[2]["w"]) == 1 and len(w[3]["w"]) == 2
    tries = []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return 7

    assert files.retried(work, pause=0) == 7
    (tmp_path / "s").mkdir()
    store = index.Snapshots(spark, str(tmp_path / "s" / "t"))
    (tmp_path / "s" / "t").mkdir()
    store.write(a)
    sums = files.backup(str(tmp_path / "s"), str(tmp_path / "copy"))
    assert index.Snapshots(spark, str(tmp_path / "copy" / "t")).read().count() == 3 and sums
