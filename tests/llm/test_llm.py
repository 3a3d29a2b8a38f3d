import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import leakage, lookalike, markup, neardup, privacy, queries, spam, splitting, tokens, words

LOC = "array<struct<char_start:int,char_end:int,location_kind:string,location_value:string>>"


# --- 1 ---

def test_forms_are_consistent():
    L = lookalike.lookalikes()
    same = [("Ｔｈｅ　ｌａｍｐ", "The lamp"), ("Тhе lаmр", "The lamp"), ("cafe\u0301", "café"), ("a\u00a0b\u202fc", "a b c"), ("e\u2011mail", "e-mail"), ("so\u00adft\u200b", "soft"), ("е\u200b\u0308", "ë"), ("\u0395\u03b1", "E\u03b1")]
    same += [("か\u3099", "が"), ("\u1112\u1161\u11ab", "한"), ("ｶﾞ", "ガ"), ("ﬁne", "fine"), ("Ⅳ", "IV"), ("𝐀b", "Ab"), ("օne", "one"), ("Үes", "Yes"), ("a\U000e0041b\U000e0101", "ab"), ("\u212b", "Å"), ("e\u200b\U000e0101\u0301", "é"), ("а\u0301", "á")]
    for a, b in same:
        assert L.rewrite(a) == L.rewrite(b) and L.rewrite(L.rewrite(a)) == L.rewrite(a)
    for a, b in [("Lamp", "lamp"), ("café", "cafe"), ("1", "2"), ("m²", "m2"), ("a\r\nb", "a\nb"), ("a—b", "a-b")]:
        assert L.rewrite(a) != L.rewrite(b)


def test_representatives_follow_frequency(spark):
    df = spark.createDataFrame([("оооо o",), (None,), ("",)], "t string")
    frequency = lookalike.representatives(df)
    assert dict(frequency)["о"] == 4
    assert lookalike.normalize(df, "t", frequency).first()["t"] == "оооо о"


def test_strings_may_represent_a_class(spark):
    df = spark.createDataFrame([("e\u0301 e\u0301 é о",), ("ｶﾞ",)], "t string")
    frequency = lookalike.representatives(df)
    assert dict(frequency)["e\u0301"] == 2 and dict(frequency)["é"] == 1
    got = [r["t"] for r in lookalike.normalize(df, "t", frequency).collect()]
    assert got[0] == "e\u0301 e\u0301 e\u0301 о"
    L = lookalike.lookalikes(frequency)
    for t in ("é", "e\u0301", "е\u200b\u0301", "ガ", "ｶﾞ", "x"):
        assert L.rewrite(L.rewrite(t)) == L.rewrite(t)
    assert L.rewrite("é") == L.rewrite("е\u200b\u0301") and L.rewrite("ガ") == L.rewrite("ｶﾞ")


def test_pairs(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "SALT_ROWS", 2)
    rows = [(1, "lamp"), (2, "lаmp"), (3, "lamp"), (4, "LAMP"), (5, None), (6, " "), (7, "\u200b"), (2, "lаmp"), (8, "la\u200bmp"), (9, "lamp"), (10, "lamp")]
    keyed = lookalike.keyed(spark.createDataFrame(rows, "id long, t string"), "id", "t").withColumn("table_name", F.lit("x"))
    got = sorted((r["id_a"], r["id_b"]) for r in lookalike.same_looking_pairs(keyed).collect())
    raw = {i: t for i, t in rows if t and t.strip("\u200b ") and t != "LAMP"}
    assert got == sorted((a, b) for a in raw for b in raw if a < b and raw[a] != raw[b])
    empty = spark.createDataFrame([], "id long, t string")
    assert lookalike.same_looking_pairs(lookalike.keyed(empty, "id", "t").withColumn("table_name", F.lit("x"))).count() == 0


# --- 2 ---

def test_word_hashes_equal_words():
    texts = ["One two-three, ONE_two", "", "é E\u0301 ё", "x" * 5000 + " y", "Ｏｎｅ ｔｗｏ", "ﬁne Ⅳ 𝐀b"]
    w = words.words_of(texts)
    plain = [re.findall(r"[^\W_]+", lookalike.lookalikes().rewrite(t).lower()) for t in texts]
    assert np.bincount(w.text, minlength=6).tolist() == [len(p) for p in plain]
    seen = {}
    for word, h in zip((x for p in plain for x in p), w.hashes.tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def brute(rows, k, t):
    sets = {i: s for i, x in rows if x and (s := {tuple(w[j : j + k]) for w in [re.findall(r"[^\W_]+", x.lower())] for j in range(len(w) - k + 1)})}
    return sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9)


@pytest.mark.parametrize("k,t", [(3, 0.6), (1, 0.7), (5, 0.8)])
def test_similar_sets(spark, k, t):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] for _ in range(30)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a")]
    for b in base:
        for _ in range(rng.randint(1, 5)):
            x = list(b)
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(x)))
    df = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string")
    got = sorted((r["id_a"], r["id_b"]) for r in neardup.similar_pairs(df, "doc_id", "text", k, t).collect())
    assert got == brute(rows, k, t)


def test_many_copies_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COPIES", 3)
    rows = [(i, "one two three four five six seven eight") for i in range(6)] + [(10, "one two three four five six seven nine")]
    got = {(r["id_a"], r["id_b"]) for r in neardup.similar_pairs(spark.createDataFrame(rows, "d long, t string"), "d", "t", 3, 0.6).collect()}
    assert got == {(0, i) for i in range(1, 6)} | {(0, 10)}
    assert neardup.similar_pairs(spark.createDataFrame([], "d long, t string"), "d", "t", 3, 0.6).count() == 0


def test_large_classes_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 100)
    text = "one two three four five six seven eight"
    rows = [(i, (text, text.upper(), text.replace(" ", ", "))[i % 3]) for i in range(1005)] + [(2000 + i, text.replace("eight", "nine")) for i in range(3)]
    got = neardup.similar_pairs(spark.createDataFrame(rows, "d long, t string"), "d", "t", 3, 0.6).selectExpr("count(*)", "count(distinct id_a, id_b)", "count_if(id_a < id_b)", "count_if(id_a < 2000 and id_b >= 2000)").first()
    assert tuple(got) == (1008 * 1007 // 2,) * 3 + (1005 * 3,)


def test_no_distance_exceeds_the_sets_own():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        assert (neardup._fingerprint(a) ^ neardup._fingerprint(b)).bit_count() <= len(np.setxor1d(a, b))
        assert neardup._apart(neardup._whole(a), neardup._whole(b)) <= len(np.setxor1d(a, b))


def test_tables_discard_only_pairs_beyond_the_bound():
    rng = np.random.default_rng(6)
    n = rng.integers(1, 20, 400)
    sets = [np.unique(rng.integers(0, 40, m).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for m in n]
    e = neardup._Entries(np.sort(rng.integers(0, 9, 400).astype(np.uint32)), np.arange(400), np.array([len(s) for s in sets], np.uint16), np.array([neardup._fingerprint(s) for s in sets], np.uint64))
    e = e.take(np.lexsort((e.n, e.token)))
    tally = Counter()
    got = set(map(tuple, neardup._met(e, 0.6, None, tally).to_numpy().tolist()))
    near = {(a, b) for a in range(400) for b in range(a + 1, 400) if len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))}
    lists = dict(zip(e.name.tolist(), e.token.tolist()))
    assert {(a, b) for a, b in near if lists[a] == lists[b]} <= got and tally["discarded"] > 0.5 * tally["met"]


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 11, 16, 17, 30, 40, 41, 300, 600, 641, 2600, 5200])
def test_index_joins_all_similar_sets(n):
    rng = np.random.default_rng(n)
    for t in (0.6, 0.7, 0.8):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = a[rng.random(len(a)) > rng.choice([0, 0.1, 0.2, 0.35])]
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(rng.choice([0, 0.1, 0.25]) * n) + int(rng.integers(0, 2))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both >= t * (len(a) + len(b) - both):
                keys = [{(int(r), int(k)) for f in neardup.entries_of(s, (s >> np.uint64(48)).astype(np.int64) % 7, t) for r, k in zip(f[0], f[1])} for s in (a, b)]
                assert keys[0] & keys[1]


def test_lists_of_frequent_elements_stay_short():
    rng = np.random.default_rng(8)
    known = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    keys = []
    for _ in range(2000):
        s = np.sort(np.concatenate([rng.integers(0, 1 << 63, 10).astype(np.uint64), rng.choice(known, 26, replace=False)]))
        keys.append(np.unique(np.concatenate([f[1] for f in neardup.entries_of(s, np.where(np.isin(s, known), 200, 0).astype(np.uint8), 0.6)])))
    _, n = np.unique(np.concatenate(keys), return_counts=True)
    assert (n * (n - 1) // 2).sum() < 150_000  # with one element a key, 1,463,823


@pytest.mark.parametrize("alone,paired", [(0, 0), (0, 5), (2, 9)])
@pytest.mark.parametrize("t", [0.3, 0.6, 0.8])
def test_keys_of_several_elements_join_all_similar_sets(monkeypatch, alone, paired, t):
    monkeypatch.setattr(neardup, "ALONE", alone)
    monkeypatch.setattr(neardup, "PAIRED", paired)
    rng = np.random.default_rng(9)
    count_of = lambda s: neardup._code((s >> np.uint64(48)) % np.uint64(12))
    met = 0
    for n in [1, 2, 3, 5, 10, 17, 18, 25, 40, 41, 60, 300, 700] * 12:
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.choice([0, 0.1, 0.2, 0.35])], rng.integers(0, 1 << 63, int(rng.choice([0, 0.1, 0.4, 0.9]) * n)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and both >= t * (len(a) + len(b) - both):
            met += 1
            x, y = ({(int(r), int(k)) for f in neardup.entries_of(s, count_of(s), t) for r, k in zip(f[0], f[1])} for s in (a, b))
            assert x & y
    assert met > 20


def test_pairs_of_frequent_elements_are_whole(spark, monkeypatch):
    for name, value in (("ALONE", 1), ("PAIRED", 4), ("ELEMENTS", 200)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(10)
    base = [rng.choices([f"w{i}" for i in range(90)], k=n) for n in (20, 45, 80) for _ in range(8)]
    rows = [(i, " ".join(w if rng.random() > 0.05 else f"w{rng.randrange(90)}" for w in rng.choice(base))) for i in range(150)]
    expected = brute(rows, 1, 0.7)
    got = neardup.similar_pairs(spark.createDataFrame(rows, "d long, t string"), "d", "t", 1, 0.7).collect()
    assert len(expected) > 100 and sorted((r["id_a"], r["id_b"]) for r in got) == expected


def test_counters_survive_packing():
    rng = np.random.default_rng(11)
    slots = np.sort(np.concatenate([rng.integers(0, 5000, 300), np.full(1000, 4999), np.full(255, 7), np.zeros(256, np.int64)]).astype(np.uint32))
    assert neardup._counted(neardup._tallied(slots, 5000), 5000).tolist() == np.bincount(slots, minlength=5000).tolist()
    codes = neardup._code(np.array([100] * 9 + [100_000]))
    assert neardup._rarity(codes, 1).tolist()[:9] == [0] * 9 and neardup._rarity(codes, 1)[9] > neardup._code(neardup.PAIRED)


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(14)]
    rows = [(i, " ".join(rng.sample(vocabulary, rng.choice([3, 5, 9, 12, 14])) + [f"u{j}" for j in range(rng.choice([0, 0, 30]))])) for i in range(120)]
    expected = brute(rows, 1, 0.6)
    monkeypatch.setattr(neardup, "LIST_BLOCK", 7)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(neardup, "PACKED_ENTRIES", 500)
    got = neardup.similar_pairs(spark.createDataFrame(rows, "d long, t string"), "d", "t", 1, 0.6).collect()
    assert len(expected) > 100 and sorted((r["id_a"], r["id_b"]) for r in got) == expected


def test_classes_name_every_record_once(spark):
    text = "one two three four five six seven eight"
    rows = [(i, text if i % 2 else text.upper()) for i in range(40)] + [(100, text.replace("eight", "nine")), (101, "quite another text of several words"), (102, None), (103, " ")]
    got = {r["id"]: (r["class_id"], r["size"], r["links"]) for r in neardup.similar_classes(spark.createDataFrame(rows * 2, "d long, t string"), "d", "t", 3, 0.6).collect()}
    assert got == {i: (0, 40, 40) for i in range(40)} | {100: (100, 1, 40), 101: (101, 1, 0)}


# --- 3 ---

def cut(t, limit=1000, overlap=120):
    out, n, at = [], len(t), 0
    while at < n:
        while at < n and t[at].isspace():
            at += 1
        if at == n:
            break
        end = n
        if n - at > limit:
            window, end = t[at + 650 : at + limit], at + limit
            for s in ["\n\n", ". ", "\n", "; ", ", ", " "]:
                if (i := window.rfind(s)) >= 0:
                    end = at + 650 + i + len(s)
                    break
        last = len(t[:end].rstrip()) if t[:end].rstrip() else end
        out.append((at, last))
        if last >= n:
            break
        at = max(last - overlap, at + 1)
    return out


def test_pieces_equal_the_plain_form(spark):
    rng = random.Random(9)
    for k in range(300):
        text = "".join(rng.choice("ab \n.;, 　\u200b" if k % 2 else "abcdefghij" * 8 + " \n.;, ") for _ in range(rng.randint(0, 4000)))
        assert splitting.pieces(text, past_blanks=True) == cut(text)
    rows = [(1, None, None), (2, "x" * 1500, [(0, 1400, "page", "1"), (1400, 1500, "slide", "1")]), (3, " " * 2000, []), (4, "short", [])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, locations {LOC}").withColumn("char_start", F.lit(1))
    got = [tuple(r) for r in splitting.split(df, longer_than=1000).orderBy("char_start").collect()]
    assert got == [(2, 0, 1000, "page"), (2, 880, 1500, "")]


# --- 5 ---

@pytest.mark.parametrize("text,expected", [
    ("Mail ivo.lund@mail.test today.", [("EMAIL", "ivo.lund@mail.test")]), ("Mail ivo (at) mail [dot] test today", [("EMAIL", "ivo (at) mail [dot] test")]),
    ("Call +44 7700 900123, or 8 (012) 345-67-89!", [("PHONE", "+44 7700 900123"), ("PHONE", "8 (012) 345-67-89")]), ("Passport 112-233-445 95 shown", [("ID_NUMBER", "112-233-445 95")]),
    ("home 12B Mill Lane, Flat 3, Oldby 12345.", [("ADDRESS", "12B Mill Lane, Flat 3, Oldby 12345")]), ("Адрес: ул. Лесная, д. 5, кв. 7.", [("ADDRESS", "ул. Лесная, д. 5, кв. 7")]),
    ("Our colleague Dr. Ada B. Lindqvist took the minutes.", [("NAME", "Ada B. Lindqvist")]), ("Подпись: Петрову И. К., дальше", [("NAME", "Петрову И. К.")]), ("Signed: A. Holm, tel.", [("NAME", "A. Holm")]),
    ("Item AB-1234567890 at the Mill Lane depot, [[PER_0001]] signed", []), (None, []), ("", []), (" \n", []),
    ("Mail i\u200bv\u00ado＠mail．test now", [("EMAIL", "i\u200bv\u00ado＠mail．test")]), ("Signed: <b>Аda Holm</b>, tel.", [("NAME", "Аda Holm")]),
    ("call one seven zero zero nine zero zero one two three now", [("ID_NUMBER", "one seven zero zero nine zero zero one two three")]),
])
def test_personal_data(text, expected):
    assert [(s.kind, text[s.start : s.end]) for s in privacy.detect(text)] == expected


@pytest.mark.parametrize("text,expected", [
    ("call plus four nine one five one two three four five six eight now", [("PHONE", "plus four nine one five one two three four five six eight")]),
    ("Nummer eins-null-zwei-drei-vier-fünf-eins-zwei-drei-null\nEnde", [("ID_NUMBER", "eins-null-zwei-drei-vier-fünf-eins-zwei-drei-null")]),
    ("numéro un deux trois quatre cinq six huit neuf un deux fin", [("ID_NUMBER", "un deux trois quatre cinq six huit neuf un deux")]),
    ("one two three four", []),
])
def test_spelled_numbers_of_any_digits(text, expected):
    assert [(s.kind, text[s.start : s.end]) for s in privacy.detect(text)] == expected


@pytest.mark.parametrize("mail", ["ivo (ät) firma (punkt) de", "ivo [chez] firme (point) fr", "ivo ( at ) mail.test", "ivo <at> mail.test", "ivo собака mail.test", "ivo arobase firme.fr", "ivo@firma < punkt > de"])
@pytest.mark.parametrize("after", ["", " <b>now</b>"])
def test_written_addresses_in_all_forms(mail, after):
    text = f"Write: {mail}, today{after}"
    assert [(s.kind, text[s.start : s.end]) for s in privacy.detect(text)] == [("EMAIL", mail)]
    assert privacy.detect("Look at mail.test, the point (c) is made") == []


@pytest.mark.parametrize("text,name", [
    ("Dear Mr. John Smith, thank you", "John Smith"), ("Frau Anna Weber rief an", "Anna Weber"), ("Dr. Teleghan wrote", "Teleghan"), ("a book written by Ada Holm", "Ada Holm"), ("Author: Ivo Lund", "Ivo Lund"),
    ("minutes by J. R. Holm", "J. R. Holm"), ("Петров И. К. пришёл", "Петров И. К."), ("пришёл Иван Петрович Сидоров домой", "Иван Петрович Сидоров"), ("Chère Anne Dubois, merci", "Anne Dubois"),
    ("Dear Customers, a pompe pas cher Olgard", None), ("the MS Anna lay in Mill Lane", None),
])
def test_names_outside_the_phrases(text, name):
    assert [(s.kind, text[s.start : s.end]) for s in privacy.detect(text)] == ([("NAME", name)] if name else [])


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "Mail ivo@mail.test, or +44 7700 900123."), (2, None), (3, "nothing")], "id int, t string")
    assert [r["t"] for r in privacy.redacted(df, "t").orderBy("id").collect()] == ["Mail [EMAIL], or [PHONE].", None, "nothing"]
    assert privacy.found(df, "id", "t", "x").count() == 2


def test_spans_stay_in_place_under_noise():
    rng = random.Random(6)
    for _ in range(60):
        value = "ivo.lund@mail.test"
        noisy = "".join(c + rng.choice(["", "", "\u200b", "\u00ad"]) for c in value[:-1]) + value[-1]
        text = f"Ｎｏｔｅ\u00a0one: {noisy} end"
        (span,) = privacy.detect(text)
        assert text[span.start : span.end] == noisy


def test_whole_texts_are_not_searched_for_rare_things(monkeypatch):
    class Anchored:
        def __init__(self, pattern):
            self.match = pattern.match

    for name in ("SPELLED", "GIVEN_NAME", "CLOSING"):
        monkeypatch.setattr(privacy, name, Anchored(getattr(privacy, name)))  # finditer is an error
    text = "Seen by one of the six men. Approved by Ada Holm-Lund, Anna Maria Weber and Jean-Luc Picard's. Kind regards,\n\nTibor Raaquist"
    assert [text[a:b] for a, b, _ in privacy.detect(text)] == ["Ada Holm-Lund", "Anna Maria", "Jean-Luc Picard", "Tibor Raaquist"]


def test_anchored_searches_find_what_whole_ones_do():
    assert set(privacy.CLOSING_CUES) == {c for c in privacy.CLOSING_CUES if privacy.CLOSING.match(f"{c.title()} Ivo Lund")}
    rng = random.Random(12)
    parts = [*privacy.CLOSING_CUES, "составила", "подготовили", "KIND REGARDS", "Regard\u017f", "\u0130", "Anna", "Jean", "Luc", "Maria", "Karl-Heinz", "Пётр", "Ivo", "Lund", "J.", "GmbH", "Street", "MS", "a", "3Anna", "eAnna", "by"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", " ", "-", ", ", "\n", "."]) for _ in range(12))
        got = sorted(privacy._general(text, text.lower()))
        given = [m.span(1) for m in privacy.GIVEN_NAME.finditer(text)]
        closing = [m.span(1) for m in privacy.CLOSING.finditer(text) if not {w.lower() for w in m[1].split()} & (privacy._NOT_NAMES | privacy._NO_PERSONS)]
        assert not any(c in text.lower() for c in privacy.CLOSINGS) or {*given, *closing} <= set(got)
        assert [m.span() for m in privacy._matches(privacy.GIVEN_NAME, text, (w.start() for w in privacy._GIVEN_WORD.finditer(text) if w[0] in privacy._GIVEN))] == [m.span() for m in privacy.GIVEN_NAME.finditer(text)]


@pytest.mark.parametrize("text,values", [
    ("Yesterday Anna Petrova visited the office with Mark Weber.", ["Anna Petrova", "Mark Weber"]), ("Kind regards,\nTibor Raaquist", ["Tibor Raaquist"]), ("Minutes taken by Anna Ross", ["Anna Ross"]), ("Frank Zappa's record", ["Frank Zappa"]),
    ("Александр Иванов пришёл", ["Александр Иванов"]), ("MS Anna Petrova left port; Klaus Weber GmbH, Paul Street", []), ("Paris is nice. Mark the date. Approved by the board", []),
    ("DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]), ("DE88 3704", []), ("ssn 123-45-6789, passport AB1234567", ["123-45-6789", "AB1234567"]), ("lot AB1234567", []), ("Via Roma 12, 00100 Roma", ["Via Roma 12, 00100 Roma"]),
])
def test_personal_data_of_other_makes(text, values):
    assert [text[a:b] for a, b, _ in privacy.detect(text)] == values


# --- 6 ---

@pytest.mark.parametrize("text,kinds", [
    ("<p>Hello <b>you</b></p>", ["html"]), ("a &nbsp; b", ["html"]), ("# Head\n\n**bold** and [x](y.md)\n\n- item", ["markdown"]), ("== Head ==\n\n* a [[link|b]]\n\n# one\n# two", ["wiki"]), ("\\section{A} \\emph{b}", ["latex"]),
    ("see `code` here", ["markdown"]), ("[[PER_0001]] [PAGE_BREAK]\n1. one\n• two\nif a < b and c > d: #tag file_1_final", []), (None, []), ("", []), ("**b** text\n\n<div align=center>x</div>\n\n- [ ] do", ["html", "markdown"]), ("**b**<br>\nx", ["markdown"]), ("Title\n=====\n\ntext `x`", ["markdown"]),
    ("$$\\frac{a}{b}$$ and **x**", ["markdown"]), ("$$\\frac{a}{b}$$ and **x** \\emph{y}", ["markdown", "latex"]), ("$$\\frac{a}{b}$$", ["latex"]),
    ("# Title\n\n- item one\n- item two", ["markdown"]), ("It is $x^2$ here", ["latex"]), ("so {\\bf x} is", ["latex"]), ("a \\mycommand{x} b", ["latex"]), ("some *emphasis* here", ["markdown"]), ("(_x_)", ["markdown"]), ("<custom a=\"1\">x</custom>", ["html"]),
    ("E = m * c^2 / n", []), ("costs $5 and $6_a", []), ("- a\n- b", []), ("x <ref>a</ref>\n\n== H ==", ["wiki"]),
    ("{{cite|x}}", ["wiki"]), ('<a href="http://x.test/1">one</a>\n<a href="http://x.test/2">two</a>', ["html"]), ("  # comment\n  x = 1", []),
])
def test_markup_kinds(text, kinds):
    assert markup.kinds_of(text) == kinds


@pytest.mark.parametrize("text,plain", [
    ("<h1>A</h1><p>b &amp; c<ul><li>d</ul><pre><code>x &lt; y\n  z</code></pre>", "A\n\nb & c\n\n• d\n\nx < y\n  z"), ("# A\n\n**b** [c](d.md)\n\n- e\n\n```py\nx = '**'\n```", "A\n\nb c\n\n• e\n\nx = '**'"),
    ("== A ==\n'''b''' [[c|d]] [[e]]\n* f", "A\nb d e\n• f"), ("\\section{A}\n\\emph{b}~ c\\footnote{n}\n\\begin{itemize}\n  \\item d\n\\end{itemize}\n$\\frac{a}{b}$", "A\nb c\n• d\n\\frac{a}{b}"), ("plain * text", "plain * text"), (None, None),
])
def test_clean_text(text, plain):
    assert markup.clean(text) == plain


# --- 7 ---

def test_ids_equal_the_reference_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    mine = tokens.Tokenizer(tokens.vocabulary_path())
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=mine.transducer.ranks, special_tokens={})
    rng = random.Random(7)
    texts = ["", "a", "<|endoftext|>", "naïve 👨‍🔧 Привет\r\n\t x", " " * 50, "aaaa" * 40] + ["".join(rng.choice("abc  теи1😀.é\n") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    for t in texts:
        ids = mine.encode(t)
        assert ids == other.encode_ordinary(t)
        assert "".join(mine.decode([i] for i in ids)) == t
    for _ in range(300):
        word = bytes(rng.choice(b"aabbc ethinoER\xd0\xb0") for _ in range(rng.randint(1, 40)))
        assert list(mine.transducer.stream(word)) == mine.transducer.encode(word)
    got = tokens.encoded(spark.createDataFrame([(1, None), (2, ""), (3, "hi")], "doc_id long, text string"), "doc_id", "text")
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {1: [], 2: [], 3: other.encode_ordinary("hi")}


# --- 8 ---

def test_leaks(spark):
    item = "the quick brown fox jumps over the lazy dog near a quiet river bank at dawn"
    w = item.split()
    rows = [(1, "before " + " ".join(w[2:12]) + " after"), (2, "before " + " ".join(w[2:11]) + " after"), (3, item.upper().replace(" ", ",  ")), (4, None), (5, ""), (6, "x " + " <b>".join(w[:10]) + "</b>"), (7, " ".join(w[:5] + ["odd"] + w[5:14]))]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short to leak"), (5, item + " again")], "item_id long, text string")
    expected = sorted((d, i) for d in (1, 3, 6) for i in (1, 5))
    for most in (leakage.BROADCAST_CHARS, 0):
        assert sorted(tuple(r) for r in leakage.found(docs, items, broadcast_chars=most).collect()) == expected


def test_every_long_span_is_found():
    rng = random.Random(8)
    for _ in range(200):
        item = [f"i{rng.randint(0, 99)}" for _ in range(rng.randint(5, 60))]
        n = rng.randint(1, min(25, len(item)))
        a = rng.randint(0, len(item) - n)
        doc = [f"d{rng.randint(0, 99)}" for _ in range(20)] + item[a : a + n] + ["end"]
        assert bool(leakage.ItemIndex([1], [" ".join(item)], 5, 6).leaks([" ".join(doc)])) == (n >= 10)


# --- 9 ---

def test_keyword_pages():
    rng = random.Random(9)
    words_ = ["cheap", "lamp", "sale", "order", "Oldby", "price", "best", "online", "free", "shop"]
    phrase = lambda: " ".join(rng.choice(words_) for _ in range(rng.randint(2, 4)))
    pages = [" | ".join(phrase() for _ in range(60)), " ".join(phrase() for _ in range(60)), "\n".join(f"http://a{i}.test/p?id={i}" for i in range(40)), " ".join("#" + phrase().title().replace(" ", "") for _ in range(60)), "\n".join(f"- [{phrase()}](http://x.test/{i})" for i in range(40)), "\n".join(f"{phrase()} SKU{rng.randint(100, 9999)} {i}%" for i in range(60))]
    assert all(spam.score(p) > 0.6 for p in pages)
    assert all(spam.score("The harbour master wrote a long report about the tides of last winter.\n\n" + p) > 0.6 for p in pages)
    table = "number;item;store\n" + "\n".join(f"AB-{rng.randint(1000, 9999)};lamp;store{i}" for i in range(60))
    contents = "\n".join(f"Part about lamps ........ {i}" for i in range(40))
    real = " ".join(f"On day {i} the {a} keeper {b} the {c} before noon and wrote {d} pages." for i, (a, b, c, d) in enumerate(zip(["old", "young", "tall", "new", "quiet"] * 4, ["painted", "moved", "checked", "sold", "found"] * 4, ["boat", "mast", "rope", "sail", "oar"] * 4, ["nine", "two", "six", "ten", "four"] * 4)))
    for good in (table, contents, real, "", None, "  ", "lamp lamp lamp"):
        assert spam.score(good) <= 0.6


def test_pages_of_other_makes_are_judged_by_their_shapes():
    r = random.Random(2)
    selling = "red shoes best buy cheap sale offer online price top quality discount order fast new free".split()
    parts = [a + b for a in "lamp desk chair valve pump rope tent boot coat sock glove scarf".split() for b in "ora ine ell ust ix".split()]
    goods = ["filter housing", "level sensor", "pump seal", "conveyor belt", "work gloves", "battery string"]
    spam_pages = [
        "\n".join(f"ART AB-{i:04d} red shoes best buy cheap sale" for i in range(30)),
        " | ".join(f"{a} {b}" for a in parts for b in parts[:8]),
        ", ".join([*parts, *(w + "s" for w in parts)]),
        ", ".join(parts * 20),
        " ".join("#" + r.choice(selling).title() + r.choice(parts).title() for _ in range(80)),
        "\n".join(f"{r.choice(selling)} {r.choice(selling)} here: http://x{i}.test/p?{i}" for i in range(40)),
    ]
    good_pages = [
        "\n".join(f"{i + 1}. {r.choice(goods)}, {r.randint(1, 90)} pcs, lot KR-{r.randint(1000, 9999)}" for i in range(60)),
        "\n".join(f"{r.choice(goods)} {r.randint(1, 90)} pcs" for i in range(60)),
        "\n".join(f"Chapter {i + 1}: {' '.join(r.sample(parts, 3))} {i * 3 + 1}" for i in range(40)),
        "\n".join(f"{w}: a part of the {r.choice(parts)} that holds the {r.choice(parts)} in place." for w in parts),
        " ".join(f"On day {i} the pump was checked and the level was {r.randint(1, 99)} percent, as on the day before." for i in range(40)),
    ]
    assert [spam.score(p) > 0.58 for p in spam_pages + good_pages] == [True] * len(spam_pages) + [False] * len(good_pages)


def test_long_lists_and_many_shapes_are_keyword_pages(spark):
    rng = random.Random(10)
    make = lambda k, n: ["".join(rng.choice("bdfglmnprstvz") + rng.choice("aeiou") for _ in range((n + 1) // 2))[:n] for _ in range(k)]
    long, short = make(75, 7), make(49, 6)
    lines = [" ".join(rng.choice(short[:12]).title() if rng.random() < c / 10 else rng.choice(short[:12]) for _ in range(n)) + e for c in range(0, 11, 2) for n in (3, 6, 12, 25) for e in ("", " | " + short[0] + " | " + short[1] + " |", ".")]
    pages = [", ".join(long * 100), " ".join(long * 100), "\n".join(long * 100), ", ".join(short * 20), "\n".join(lines * 3)]
    glossary = "\n".join(f"{a.title()} - {b} {c}" for a, b, c in zip(make(60, 6), make(60, 8), make(60, 6)))
    figures = "\n".join(f"| lamp | {rng.randint(100, 99999)} | {rng.random():.5f} | {rng.randint(1000, 9999999)} |" for _ in range(100))
    real = "\n".join("The keeper of the harbour wrote that the tide was high and the boats were late again." for _ in range(3)) + "\n" + glossary
    df = spark.createDataFrame(list(enumerate([*pages, glossary, figures, real, None])), "d long, t string")
    assert sorted(r["d"] for r in spam.found(df, "d", "t").collect()) == list(range(len(pages)))


def test_queries_are_registered():
    assert {f"p{n}_found" for n in (1, 2, 3, 5, 6, 8, 9)} | {"p7_ids"} <= set(queries.queries())
