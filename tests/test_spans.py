import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.rules import SPAN
from corvane.operators import spans
from corvane.plans.asking import Vault, masked_requests


def brute(items):
    kept = []
    for s in sorted(items, key=lambda s: (-s[5], -s[3], s[0] - s[1], s[0], s[1], s[6])):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted((s[0], s[1]) for s in kept)


def test_merge_equals_greedy_choice(spark):
    rng = random.Random(3)
    sets = [[(a, a + rng.randint(1, 9), rng.choice("AB"), rng.choice([0.5, 1.0]), "t", rng.randint(1, 3), i) for i in range(rng.randint(0, 12)) for a in [rng.randint(0, 30)]] for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(sets)), f"i int, s array<{SPAN}>").withColumn("m", spans.merge(F.col("s")))
    for r in df.collect():
        assert [(s["start"], s["end"]) for s in r["m"]] == brute(sets[r["i"]])


def test_admitted(spark):
    df = spark.createDataFrame([("ab  !!", [(0, 2, "PER", 0.9, "t", 1, 0), (2, 6, "PER", 0.9, "t", 1, 1), (0, 2, "LOC", 0.9, "t", 1, 2), (0, 2, "PER", 0.1, "t", 1, 3)])], f"t string, s array<{SPAN}>")
    got = df.select(spans.admitted(F.col("s"), F.col("t"), ["PER"], 0.5, 2).alias("r")).first()["r"]
    assert [s["seq"] for s in got] == [0]


def test_minting_orders_and_goes_on(spark):
    rows = [("r", 1, 5, "PER", "Маркову"), ("r", 0, 9, "PER", "Лосин"), ("r", 2, 1, "per", "Иван Марков"), ("r", 0, 1, "email", "a@b.c"), ("q", 0, 0, "PER", "Марков"), ("r", 0, 2, None, "x"), ("r", 0, 2, "PER", None)]
    values = spark.createDataFrame(rows, "request_id string, field int, start int, label string, value string")
    first = spans.mint(values)
    got = {(r["request_id"], r["identity"]): (r["marker"], r["display_value"]) for r in first.collect()}
    assert got == {("r", "лосин"): ("[[PER_0001]]", "Лосин"), ("r", "марков"): ("[[PER_0002]]", "Марков"), ("r", "a@b.c"): ("[[EMAIL_0001]]", "a@b.c"), ("q", "марков"): ("[[PER_0001]]", "Марков")}
    more = spark.createDataFrame([("r", 0, 0, "PER", "Раевский"), ("r", 0, 3, "PER", "Лосину")], values.schema)
    grown = {(r["request_id"], r["identity"]): (r["marker"], r["aliases"]) for r in spans.mint(more, first).collect()}
    assert grown[("r", "раевский")][0] == "[[PER_0003]]" and grown[("r", "лосин")] == ("[[PER_0001]]", ["Лосин", "Лосину"]) and ("r", "a@b.c") in grown


def test_masks_restore_and_check(spark):
    df = spark.createDataFrame([("Ask Ann or Bob.", [(4, 7, "[[PER_0001]]"), (5, 9, "[[X_0001]]"), (11, 14, "[[PER_0002]]"), (14, 99, "[[PER_0003]]")], {"[[PER_0001]]": "Ann", "[[PER_0002]]": "Bob"})], "t string, s array<struct<start:int,end:int,marker:string>>, m map<string,string>")
    r = df.withColumn("x", spans.masked(F.col("t"), F.col("s"))).withColumn("y", spans.restored(F.col("x"), F.col("m"))).first()
    assert r["x"] == "Ask [[PER_0001]] or [[PER_0002]]." and r["y"] == r["t"]
    odd = spark.createDataFrame([("see [[per_1]]", {"[[PER_0001]]": "Ann"})], "t string, m map<string,string>")
    with pytest.raises(Exception, match="unknown_marker"):
        odd.select(spans.restored(F.col("t"), F.col("m"))).collect()
    leak = spark.createDataFrame([("Annex", ["Ann"]), ("call ANN!", ["Ann"]), ("[[ID_0001]] 0001", ["000"]), ("[[ID_0001]]", ["0001"]), (r"a\Eb.c", [r"\Eb.c"]), ("x", [])], "t string, a array<string>")
    assert [r[0] for r in leak.select(spans.leaks(F.col("t"), F.col("a"))).collect()] == [False, True, True, False, True, False]


def test_propagation(spark):
    assert spans.propagate_markers("Ann and Annex, [[PER_0001]] ann lee", {"[[PER_0001]]": ["Ann"], "[[PER_0002]]": ["Ann Lee"]}) == "[[PER_0001]] and Annex, [[PER_0001]] [[PER_0002]]"
    fields = spark.createDataFrame([("r", 0, "Ann, ann"), ("q", 0, "Ann"), ("r", 1, None)], "request_id string, field int, text string")
    known = spark.createDataFrame([("r", "Ann", "PER", 5), ("r", "xy", "PER", 5)], "request_id string, value string, label string, priority int")
    assert sorted((r["request_id"], r["start"]) for r in spans.propagate_known(fields, known).collect()) == [("r", 0), ("r", 5)]


def test_requests_share_markers_over_fields(spark):
    questions = spark.createDataFrame([("r", "Who is ivo@mail.test?"), ("q", "Nothing here")], "request_id string, text string")
    contexts = spark.createDataFrame([("r", 1, "Write to IVO@MAIL.TEST or ida@mail.test."), ("q", 1, "ivo@mail.test is another request's")], "request_id string, place int, text string")
    fields, markers = masked_requests(questions, contexts)
    got = {(r["request_id"], r["field"]): r["masked"] for r in fields.collect()}
    assert got[("r", 0)] == "Who is [[EMAIL_0001]]?" and "ida" not in got[("r", 1)] and got[("q", 0)] == "Nothing here" and got[("q", 1)].startswith("[[EMAIL_0001]]")


def test_vault(tmp_path):
    v = Vault(str(tmp_path))
    v.create("r1", {"question": "[[PER_0001]]"}, [{"marker": "[[PER_0001]]", "display_value": "Ann"}], [], {})
    with pytest.raises(ValueError, match="unknown_marker"):
        v.stage("r1", "[[PER_0002]]")
    v.stage("r1", "Hello [[PER_0001]]")
    assert v.restored("r1") == "Hello Ann" and v.manifest("r1")["status"] == "restored"
    with pytest.raises(ValueError, match="request_not_prepared"):
        v.update("r1", {}, [], [])
    (tmp_path / "r1" / "markers.json").write_text("[]")
    with pytest.raises(ValueError, match="vault_integrity_failed"):
        v.markers("r1")
