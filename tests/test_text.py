import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corvane.functions import names, rules, text as T, vectors
from corvane.operators import chunks, context, spans
from corvane.sources.extract import normalize


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


def test_normalize_text_equals_the_extractor(spark):
    cases = [None, "", " \n\t ", "a \r\n\r\n\n\n b\x00 \n", "　x \ny​ \n", "a\rb\x1c\n\n\nc"]
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select("v", T.normalize_text(F.col("v")).alias("r")).collect()
    for r in rows:
        assert r["r"] == (None if r["v"] is None else normalize(r["v"]))


def test_normalize_query(spark):
    assert one(spark, "  what \n is\tit ?!.. ", T.normalize_query) == "what is it"
    assert one(spark, "?!", T.normalize_query) == ""


def test_matches_have_offsets_of_code_points(spark):
    text = "a😀AB-12 x AB-12AB-3é AB-99"
    got = one(spark, text, lambda c: T.matches(c, r"AB-\d+"))
    assert [(m["start"], m["end"], m["text"]) for m in got] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"AB-\d+", text)]
    got = one(spark, "n: 12, n: 7", lambda c: T.matches(c, r"n: (\d+)", 1))
    assert [(m["start"], m["end"]) for m in got] == [(3, 5), (10, 11)]
    assert one(spark, "none", lambda c: T.matches(c, r"\d")) == []
    assert one(spark, None, lambda c: T.matches(c, r"\d")) is None


def test_windows_equal_the_loop_form(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(int(x) for x in (0, n, a, a + rng.integers(0, 60), rng.integers(1, 80))) for n in range(1, 200) for a in [rng.integers(0, n + 10)]]
    df = spark.createDataFrame(rows, "lo int, hi int, a int, b int, k int").withColumn("w", T.window(*[F.col(c) for c in ("lo", "hi", "a", "b", "k")]))
    for r in df.collect():
        assert tuple(r["w"]) == context._Part("", r["k"]).around(r["lo"], r["hi"], r["a"], r["b"])


def test_labels_and_formats(spark):
    assert one(spark, " b-person ", T.normalize_label) == "PER"
    assert one(spark, "--a b!", T.safe_label) == "A_B"
    assert one(spark, "!!", T.safe_label) == "ENTITY"
    assert one(spark, "x.y.Title_Gen ", T.task_suffix) == "title_gen"
    assert one(spark, "x.y z", T.task_suffix) is None
    assert one(spark, "a\nb\n", T.indented) == "    a\n    b"
    df = spark.createDataFrame([("page", "2", "3"), ("sheet", "A", None), ("other", "1", "1")], "k string, a string, b string")
    assert [r[0] for r in df.select(T.location_label(F.col("k"), F.col("a"), F.col("b"))).collect()] == ["стр. 2–3", "лист A", "other 1"]


def test_history_content(spark):
    df = spark.createDataFrame([("assistant", "work END Ответ: yes SRC list"), ("assistant", "FAIL x"), ("user", " FAIL END "), ("assistant", "plain")], "r string, c string")
    got = [r[0] for r in df.select(T.history_content(F.col("r"), F.col("c"), "FAIL", "END", "SRC")).collect()]
    assert got == ["yes", "", "FAIL END", "plain"]


def test_message_text(spark):
    df = spark.createDataFrame([([("text", "a"), ("image", "b"), ("input_text", "c"), ("text", "")],)], "p array<struct<type:string,text:string>>")
    assert df.select(T.message_text(F.col("p"))).first()[0] == "a\nc"


@pytest.mark.parametrize("form,base", [("Маркову", "Марков"), ("МАРКОВЫМ", "МАРКОВ"), ("Лосиной", "Лосин"), ("Раевскому", "Раевский"), ("Ов", "Ов"), ("Смит", "Смит")])
def test_surnames(spark, form, base):
    assert one(spark, form, names.normalize_surname) == base


def test_person_identity(spark):
    for value in ("Марков", "Маркову И. П.", "Иван Петрович Марков", "МАРКОВА"):
        assert one(spark, value, lambda c: names.identity(F.lit("PER"), c)) == "марков"
    assert one(spark, "Маркову", lambda c: names.display(F.lit("PER"), c)) == "Марков"
    assert one(spark, "Ивану Маркову", lambda c: names.display(F.lit("PER"), c)) == "Ивану Маркову"


def test_rules_find_every_label(spark):
    text = "[[odd]] ivo@mail.test, СНИЛС 112-233-445 95, ИНН 7707083893, счёт 40702810900000012345, тел. +7 (912) 345-67-89, паспорт 45 08 123456, 1 200,50 руб."
    got = {(s["label"], text[s["start"] : s["end"]]) for s in one(spark, text, lambda c: spans.merge(rules.detect(c)))}
    assert got == {
        ("RAW_MARKER", "[[odd]]"), ("EMAIL", "ivo@mail.test"), ("SNILS", "112-233-445 95"), ("INN", "7707083893"), ("BANK_ACCOUNT", "40702810900000012345"), ("PHONE", "+7 (912) 345-67-89"),
        ("PASSPORT", "45 08 123456"), ("MONEY", "1 200,50 руб."),
    }
    assert one(spark, None, rules.detect) == []


def test_cosine_and_embeddings(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0]
    model = vectors.HashingEmbedder(32)
    v = model.vectors(["one two", "", None, "two one"])
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not v[1].any() and not v[2].any() and np.allclose(v[0], v[3])
    got = vectors.hash_embedding(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, t string"), "id", "t", 8)
    assert {r["id"]: sum(map(abs, r["embedding"])) > 0 for r in got.collect()} == {1: True, 2: False, 3: False}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .;,\n　é", max_size=400), st.integers(5, 60))
def test_chunks_cover_the_text(text, size):
    cuts = list(chunks.boundaries(text, size, size // 4, 3))
    held = set()
    for a, b in cuts:
        assert a < b <= a + size and not text[a].isspace() and not text[b - 1].isspace()
        held.update(range(a, b))
    assert all(i in held or text[i].isspace() for i in range(len(text)))
    assert [a for a, _ in cuts] == sorted({a for a, _ in cuts})


def test_chunk_frame(spark):
    loc = [(0, 400, "page", "1"), (400, 900, "page", "2")]
    text = "Sentence one two. " * 50
    df = spark.createDataFrame([("d", "r", text, loc, 1), ("n", "r", None, None, 2), ("b", "r", "  \n", [], 3)], "document_id string, revision string, text string, locations array<struct<char_start:int,char_end:int,location_kind:string,location_value:string>>, c int")
    rows = chunks.chunk(df).orderBy("ordinal").collect()
    assert {r["document_id"] for r in rows} == {"d"}
    assert all(r["text"] == text[r["char_start"] : r["char_end"]] for r in rows)
    assert (rows[0]["location_kind"], rows[0]["location_start"], rows[0]["location_end"]) == ("page", "1", "2")
    assert rows[0]["chunk_id"] == chunks.chunk(df).orderBy("ordinal").first()["chunk_id"]
    with pytest.raises(ValueError):
        chunks.chunk(df, 10, 10)


def test_headings(spark):
    text = "[SLIDE 1]\nab\n\n[SLIDE 2]\nc"
    got = one(spark, text, lambda c: chunks.heading_locations(c, chunks.SLIDE_HEADING, "slide"))
    assert [(x["char_start"], x["char_end"], x["location_value"]) for x in got] == [(0, 14, "1"), (14, 25, "2")]
