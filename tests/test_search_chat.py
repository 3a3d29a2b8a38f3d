import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import chat, context, control, events, search
from corvane.streaming import streams

M = "user_id string, chat_id string, position int, role string, content string"


def test_top_k_and_policy(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = [(i, [float(x) for x in rng.normal(size=8)], "ab"[i % 2], False, True) for i in range(200)]
    asked = [(100 + i, [float(x) for x in rng.normal(size=8)]) for i in range(5)]
    p = spark.createDataFrame(points, "chunk_id int, embedding array<double>, access_group string, goz boolean, is_final boolean")
    q = spark.createDataFrame(asked, "request_id int, embedding array<double>")
    expected = set()
    for r, v in asked:
        scored = sorted((-np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e), i) for i, e, g, *_ in points if g == "a")
        expected |= {(r, i, k + 1) for k, (_, i) in enumerate(scored[:7])}
    got = lambda: {(r["request_id"], r["chunk_id"], r["rank"]) for r in search.top_k(p, q, 7, search.Policy("a").condition()).collect()}
    assert got() == expected
    monkeypatch.setattr(search, "QUERY_BYTES", 100)  # queries in blocks
    assert got() == expected
    with pytest.raises(ValueError):
        search.Policy(" ")


def test_citations_and_caps(spark):
    hits = spark.createDataFrame([("r", 1, "c1", "d1", "whole_document"), ("r", 2, "c2", "d2", "retrieved_chunk"), ("r", 3, "c3", "d3", None)], "request_id string, place int, chunk_id string, document_id string, context_scope string")
    named = spark.createDataFrame([("r", "R001"), ("r", "R002"), ("r", "R9"), ("r", "R002")], "request_id string, citation_ref string")
    assert [r["chunk_id"] for r in search.cited(hits, named).collect()] == ["c2"]
    capped = search.cap_documents(hits.withColumnRenamed("place", "rank"), 2)
    assert sorted(r["chunk_id"] for r in capped.collect()) == ["c1", "c2"]


def test_parents(spark):
    where = [(0, 50, "page", "1"), (50, 100, "page", "2")]
    docs = spark.createDataFrame([("a", "r", "A" * 100, False, where), ("b", "r", "B" * 100, False, where), ("t", "r", "H" * 40 + "T" * 400, True, [])], "document_id string, revision string, text string, truncated boolean, locations array<struct<char_start:int,char_end:int,location_kind:string,location_value:string>>")
    hits = spark.createDataFrame([("q", 1, "a", "r", "1", 0, 10, "A" * 10, "txt"), ("q", 2, "b", "r", "2", 60, 70, "B" * 10, "txt"), ("q", 3, "t", "r", "3", 300, 310, "T" * 10, "csv"), ("q", 4, "gone", "r", "4", 0, 5, "G" * 90, "txt"), ("q", 5, "a", "old", "5", 0, 5, "x", "txt")], "request_id string, place int, document_id string, revision string, chunk_id string, char_start int, char_end int, text string, source_type string")
    got = [(r["place"], r["context_scope"], r["char_start"], r["char_end"], len(r["text"])) for r in context.parents(hits, docs, context.Budget(420, 150, 120, 1)).orderBy("place").collect()]
    assert got[0] == (1, "whole_document", 0, 100, 100) and got[1] == (2, "logical_parent", 50, 100, 50) and got[2][1] == "logical_parent" and got[2][4] <= 120 and got[3] == (4, "retrieved_chunk", 0, 5, min(90, 420 - 150 - got[2][4]))


def history(messages, most, chars):
    good = [(r, c.strip()) for r, c in messages if r in chat.ROLES and c and c.strip()][-most:]
    out, left = [], chars
    for r, c in reversed(good):
        if left <= 0:
            break
        out.append((r, c[-left:]))
        left -= len(out[-1][1])
    return out[::-1]


def test_trim_equals_the_loop_form(spark):
    rng = random.Random(4)
    chats = {str(k): [(rng.choice(["user", "assistant", "odd", "system"]), rng.choice(["", None, " hi ", "word " * rng.randint(1, 9)])) for _ in range(rng.randint(0, 14))] for k in range(40)}
    rows = [("u", k, i, r, c) for k, ms in chats.items() for i, (r, c) in enumerate(ms)]
    got = {}
    for r in chat.trim(spark.createDataFrame(rows, M), 5, 60).orderBy("chat_id", "position").collect():
        got.setdefault(r["chat_id"], []).append((r["role"], r["content"]))
    assert got == {k: h for k, ms in chats.items() if (h := history(ms, 5, 60))}


def test_sync(spark):
    held = spark.createDataFrame([("u", "1", 0, "user", "a"), ("u", "1", 1, "assistant", "b"), ("u", "2", 0, "user", "x"), ("u", "3", 0, "user", "k")], M)
    new = spark.createDataFrame([("u", "1", 0, "user", "c"), ("u", "2", 0, "user", "x"), ("u", "4", 0, "user", "n"), ("u", "3", 0, "user", "p"), ("u", "3", 1, "assistant", "q")], M)
    got = {(r["chat_id"], r["position"]): r["content"] for r in chat.synced(held, new).collect()}
    assert got == {("1", 0): "a", ("1", 1): "b", ("1", 2): "c", ("2", 0): "x", ("4", 0): "n", ("3", 0): "p", ("3", 1): "q"}


@pytest.mark.parametrize("body,error", [
    ('{"queries": [" a  b ", "a b"], "expand_citations": ["R001", "R001"]}', None), ("{]}", "json"), ("[]", "envelope"), ('{"other": 1}', "fields"), ('{"queries": "a"}', "lists"), ('{"queries": ["a","b","c","d"]}', "limit"), ('{"queries": [" "]}', "query"),
    ('{"queries": [1]}', "query"), ('{"expand_citations": ["R1"]}', "citation"), ("{}", "empty"),
])
def test_control(spark, body, error):
    r = spark.createDataFrame([(f" <retrieval_request>{body}</retrieval_request>\n",)], "t string").select(control.parse(F.col("t")).alias("c")).first()["c"]
    if error is None:
        assert r["queries"] == ["a b"] and r["expand_citations"] == ["R001"] and r["error"] is None
    else:
        assert error in r["error"] and r["queries"] == []


def test_control_outside(spark):
    rows = spark.createDataFrame([("plain",), ("x <retrieval_request> y",), (None,)], "t string").select(control.parse(F.col("t")).alias("c")).collect()
    assert rows[0]["c"] is None and rows[1]["c"]["error"] == "invalid_retrieval_control_envelope" and rows[2]["c"] is None


def test_events(spark, tmp_path):
    e = spark.createDataFrame([("a.b", "secret name", {"top_k": "3", "path": "/x"}), ("Bad Stage", "l", None)], "stage string, label string, details map<string,string>")
    assert [(r["stage"], r["details"]) for r in events.persisted(e).collect()] == [("a.b", {"top_k": "3"}), ("invalid_stage", None)]
    told = []
    with pytest.raises(KeyError), events.timed(told.append, "s.t", {"top_k": 1}) as d:
        d["chunks"] = 2
        raise KeyError("secret")
    assert [t["status"] for t in told] == ["started", "failed"] and told[1]["details"] == {"top_k": 1, "chunks": 2, "error_type": "KeyError"}
    with events.timed(lambda _: 1 / 0, "s.t"):
        pass
    e.write.parquet(str(tmp_path / "in"))
    streams.event_log(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_windows_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:10:00", "u", "a", 1.0), (2, "2024-01-01 00:50:00", "u", "a", 2.0), (3, "2024-01-01 03:00:00", "u", "a", 4.0)], "event_id int, t string, user_id string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    e.write.parquet(str(tmp_path / "in"))
    q = streams.windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["total"] for r in spark.table("w").collect()) == [3.0, 4.0]
    assert sorted(r["n"] for r in streams.sessions(e.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").collect()) == [1, 2]


def test_parent_contexts_cover_every_document(spark):
    from corvane import queries

    folder = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{folder}/documents.parquet").where("text <> '' and source is not null")
    got = queries.parent_contexts(spark, folder).cache()
    assert want.join(got, "document_id", "left_anti").count() == 0
    assert got.where("context_scope = 'logical_parent' and char_start > 0").count() > 0
    assert got.groupBy("request_id").sum("chars").where("`sum(chars)` > 20000").count() == 0


def _shuffled(plan):
    """Bytes that a plan which has run wrote for its shuffles."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    own = plan.metrics().apply("shuffleBytesWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_parent_contexts_move_texts_once(spark):
    import os

    from corvane import queries

    folder = "/root/testdata/sf0.001"
    ran = queries.parent_contexts(spark, folder)._jdf.queryExecution()
    assert ran.toRdd().count() == 2678
    assert _shuffled(ran.executedPlan()) < 4 * os.path.getsize(f"{folder}/documents.parquet")


def plain_parents(hits, documents, budget):
    """One request's contexts (place, start, end, text, scope), cut from the texts one after the other."""
    out, left, wholes, groups = [], budget.total, 0, {}
    for h in sorted(hits, key=lambda h: h["place"]):
        groups.setdefault((h["document_id"], h["revision"], h["place"] if h["revision"] is None else 0), []).append(h)
    for (document, revision, _), group in groups.items():
        text, truncated, locations = documents.get((document, revision), ("", False, []))
        best, part = group[0], None
        if not text:
            for h in group:
                if left > 0 and h["text"]:
                    out.append((h["place"], h["char_start"], h["char_end"], h["text"][:left], "retrieved_chunk"))
                    left -= len(out[-1][3])
            continue
        if left <= 0:
            break
        if not truncated and wholes < budget.whole_documents and len(text) <= min(left, budget.whole_document):
            wholes += 1
            part, a, b, scope = text, 0, len(text), "whole_document"
        else:
            scope, room, kept = "logical_parent", min(budget.logical_parent, left), []
            near = list(dict.fromkeys((x[0], x[1]) for h in group for x in locations if x[0] < h["char_end"] and x[1] > h["char_start"]))
            spare = room
            for x in near:
                need = x[1] - x[0] + (len(context.SECTION_GAP) if kept else 0)
                if need <= spare:
                    kept.append(x)
                    spare -= need
            low, high = near[0] if near else (0, len(text))
            high = min(high, len(text))
            window = context._Part(len(text), room).around
            head = min(context.TABLE_HEADER, max(1, room // 3))
            if kept:
                part, a, b = context.SECTION_GAP.join(text[x:y] for x, y in kept), min(kept)[0], max(y for _, y in kept)
            elif best["source_type"] != "csv":
                a, b = window(low, high, min(h["char_start"] for h in group), max(h["char_end"] for h in group))
                part = text[a:b]
            elif high - low <= room or best["char_start"] <= min(high, low + head):
                part, a, b = text[low:high][:room], low, min(high, low + room)
            else:
                x, b = window(low, high, best["char_start"], best["char_end"], max(1, room - head - len(context.TABLE_GAP)))
                part, a = (text[low : low + head] + context.TABLE_GAP + text[x:b])[:room], low
        if part:
            out.append((best["place"], a, b, part, scope))
            left -= len(part)
    return out


def test_parents_equal_the_plain_form(spark):
    r = random.Random(11)
    documents, rows = {}, []
    for k in range(30):
        n = r.choice([0, 1, 40, 300, 900])
        text = "".join(r.choice("aб\U0001f600z ") for _ in range(n))
        edges = sorted(r.sample(range(n + 1), min(n, r.randint(0, 6))))
        locations = [(a, b, "page", "1") for a, b in zip(edges, edges[1:])] + [(0, n, "sheet", "1")] * (n and r.randint(0, 1))
        documents[f"d{k}", "r"] = (text, r.choice([True, False, None]), r.choice([locations, locations, []]))
        rows += [(f"d{k}", "r", *documents[f"d{k}", "r"])] * r.choice([1, 1, 2])  # some stand there twice
    hits = []
    for q in range(150):
        for place in range(1, r.randint(2, 14)):
            a = r.randint(0, 900)
            revision = r.choice(["r"] * 12 + ["old", None])
            hits.append({"request_id": f"q{q}", "place": place, "document_id": f"d{(q + r.randint(0, 4)) % 30}", "revision": revision, "chunk_id": f"{q}-{place}", "char_start": a, "char_end": a + r.randint(1, 60), "text": r.choice([None, "", "own text" * 5]), "source_type": r.choice(["txt", "csv"])})
    d = spark.createDataFrame(rows, "document_id string, revision string, text string, truncated boolean, locations array<struct<char_start:int,char_end:int,location_kind:string,location_value:string>>")
    h = spark.createDataFrame([tuple(x.values()) for x in hits], "request_id string, place int, document_id string, revision string, chunk_id string, char_start int, char_end int, text string, source_type string")
    for budget in (context.Budget(900, 300, 200, 1), context.Budget(150, 60, 90, 2), context.Budget(5000, 500, 700, 0)):
        want = sorted((f"q{q}", *x) for q in range(150) for x in plain_parents([x for x in hits if x["request_id"] == f"q{q}"], documents, budget))
        got = sorted((x["request_id"], x["place"], x["char_start"], x["char_end"], x["text"], x["context_scope"]) for x in context.parents(h, d, budget).collect())
        assert got == want
        assert {x[5] for x in got} >= {"logical_parent", "retrieved_chunk"}


def test_of_one_place_the_message_loaded_last_counts(spark):
    rows = [("u", "c", 0, "user", "old", 1), ("u", "c", 0, "user", "new", 2), ("u", "c", 0, "user", "new", 2), ("u", "c", 1, "user", None, 1), ("u", "c", 2, "robot", "x", 1)]
    df = spark.createDataFrame(rows, "user_id string, chat_id string, position int, role string, content string, loaded_at int")
    assert [r["content"] for r in chat.usable(df).collect()] == ["new"]
    assert [r["content"] for r in chat.usable(df.drop("loaded_at")).collect()] == ["old"]
    assert chat.usable(df.where("false")).count() == 0


def test_windows_have_the_match_in_their_middle(spark):
    import random

    from pyspark.sql import functions as F

    from corvane.functions import text as T
    from corvane.operators.context import _Part

    r = random.Random(4)
    rows = []
    for _ in range(300):
        low = r.randint(0, 40)
        high = low + r.randint(0, 120)
        a = r.randint(0, 160)
        rows.append((low, high, a, a + r.randint(0, 50), r.randint(1, 100)))
    df = spark.createDataFrame(rows, "low int, high int, a int, b int, room int")
    got = df.select("*", T.window(*map(F.col, ("low", "high", "a", "b", "room"))).alias("w")).collect()
    for x in got:
        assert tuple(x["w"]) == _Part("", x["room"]).around(x["low"], x["high"], x["a"], x["b"])
        start, end = x["w"]
        assert x["low"] <= start <= end <= x["high"] and end - start == min(x["room"], x["high"] - x["low"]) or start == min(max(x["a"], x["low"]), x["high"])
