from __future__ import annotations

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm.canonical import mapped_rows, mapped_values, read_citation
from docketry.llm.lookalikes import CYRILLIC, GREEK, LATIN, alike, consistent, look_classes, public_confusables, token_scripts

SAME = [
    ("The order", "Тhе оrdеr"), ("Ｎｏ order．１", "No order.1"), ("a b c\td", "a b c d"), ("of​fi­ce⁠", "office"), ("oﬃce", "office"), ("café", "café"),
    ("ｶﾞｲﾄﾞ", "ガイド"), ("⼀人", "一人"), ("73‑0001", "73-0001"), ("Kelvin", "Kelvin"), ("спора", "cпopa"), ("ख़", "ख़"), ("Ο ΝΑΤΟ", "O NATO"), ("a\r\nb", "a\nb"),
]
DIFFERENT = [("cafe", "café"), ("x2", "x²"), ("Order", "order"), ("order.", "order"), ("a b", "a  b"), ("l", "1"), ("O", "0"), ("a\nb", "a b"), ("⚖", "⚖️"), ("кот", "kot"), ("…", "..."), ("№", "No"), ("لا", "ل‌ا"), ("ß", "ss")]


def test_same_and_different():
    for a, b in SAME:
        assert consistent(a) == consistent(b), (a, b)
    for a, b in DIFFERENT:
        assert consistent(a) != consistent(b), (a, b)


def test_words_are_spelled_in_one_script():
    assert consistent("cпopa o праве") == unicodedata.normalize("NFC", "спора о праве")
    assert consistent("Тhe соurt") == "The court"
    assert token_scripts("cop") == {"Latin", "Cyrillic"} and token_scripts("cпop") == {"Cyrillic"} and token_scripts("gп") == set()


def test_the_scripts_of_a_word_decide_what_its_letters_are(spark, rows):
    wide = public_confusables(spark.sparkContext.applicationId, spark)
    assert 100 < len(wide) < 5000 and wide["\u0570"]["Latin"] == "h" and not any(c in wide for c in LATIN + CYRILLIC + GREEK)
    for disguised, true in (("\u0570arbor", "harbor"), ("n\u0585tice", "notice"), ("\u13aarder", "Arder"), ("\u0570аrbor", "harbor"), ("ⲟrder", "order"), ("\u043f\u0585\u043b", "\u043f\u043e\u043b")):
        assert consistent(disguised, wide) == consistent(true, wide) == true, disguised
    for alone in ("\u0570\u0561\u0575", "\u0570\u0585\u057d", "b\u03b1nk", "\u10db\u10d0\u10e0", "\u13a0\u13b3\u13a9"):
        assert consistent(alone, wide) == alone
    d = spark.createDataFrame([(1, "the \u0570arbor"), (2, "the harbor"), (3, "\u0570\u0585"), (4, "ho"), (5, None)], "doc_id bigint, text string")
    assert rows(alike(look_classes(d))) == [(1, 2)]


def test_copies_of_one_text_never_meet(spark, rows):
    d = spark.createDataFrame([(i, "The order") for i in range(400)] + [(400, "\u0422he order"), (401, "\u0422he order")], "doc_id bigint, text string")
    got = rows(alike(look_classes(d).withColumn("n_alike", F.lit(1))))
    assert len(got) == 400 * 2 and (400, 401) not in got and all(a < b and b >= 400 for a, b in got)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(LATIN + CYRILLIC.replace(".", "") + GREEK.replace(".", "") + "пжωb ​́"), max_size=24), st.randoms())
def test_swapping_twins_never_changes_the_form(text, rnd):
    twins = [{x for x in (a, b, c) if x != "."} for a, b, c in zip(LATIN, CYRILLIC, GREEK, strict=True)]
    other = "".join(rnd.choice(sorted(next((t for t in twins if c in t), {c}))) for c in text)
    assert consistent(text) == consistent(other) and consistent(consistent(text)) == consistent(text)


def test_pairs(spark, rows):
    d = spark.createDataFrame([(1, "The order"), (2, "Тhe order"), (3, "The order"), (4, None), (5, ""), (6, "​"), (7, "  \n"), (8, "x"), (9, "x")], "doc_id bigint, text string")
    c = look_classes(d)
    assert rows(alike(c)) == [(1, 2), (2, 3)] and c.count() == 5
    assert alike(look_classes(d.limit(0))).count() == 0


def test_arabic_letters_are_alike_where_they_join(spark, rows):
    plain, keheh, yeh = "\u0643\u062a\u0627\u0628 \u0639\u0644\u064a\u0647", "\u06a9", "\u06cc"
    disguised = plain.replace("\u0643", keheh).replace("\u064a", yeh)
    for a, b in [(plain, disguised), ("\u0643\u064e\u0627", "\u06a9\u064e\u0627"), ("\u064a\u200b\u062f", "\u06cc\u062f"), ("\u0643\u200d\u0627", "\u06a9\u200d\u0627"), ("\u0639\u0644\u0649", "\u0639\u0644\u06cc"), ("\u067e\u0643\u062a", "\u067e\u06a9\u062a")]:
        assert consistent(a) == consistent(b), (a, b)
    for a, b in [("\u0645\u0644\u0643", "\u0645\u0644\u06a9"), ("\u0639\u0644\u064a", "\u0639\u0644\u06cc"), ("\u0643\u200c\u0627", "\u06a9\u200c\u0627"), ("\u064a\u0621", "\u06cc\u0621"), ("\u0649\u062f", "\u06cc\u062f"), ("\u0626\u062f", "\u06cc\u0654\u062f")]:
        assert consistent(a) != consistent(b), (a, b)
    persian = "\u067e\u06a9 \u06a9\u062a\u0627\u0628\u06cc \u06cc\u06a9"
    assert consistent(disguised) == plain and consistent(persian) == persian == consistent(persian.replace("\u06cc\u06a9", "\u064a\u06a9"))
    d = spark.createDataFrame([(1, plain), (2, disguised), (3, plain), (4, plain.replace("\u0643", keheh)), (5, "\u0645\u0644\u0643"), (6, "\u0645\u0644\u06a9")], "doc_id bigint, text string")
    assert rows(alike(look_classes(d))) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("\u0643\u06a9\u064a\u06cc\u0649\u0627\u0628\u0629\u067e\u0621\u064e\u0654\u200b\u200c\u200d a"), max_size=12))
def test_arabic_form_is_stable(text):
    assert consistent(consistent(text)) == consistent(text)


CANONS = [("usc:67_1332a", "67 U.S.C. § 1332a"), ("usc:67_1332", "67 U.S.C. § 1332"), ("cfr:61_1237", "61 C.F.R. Part 1237"), ("gla:192", "Guild Licensing Act § 192"), ("cera:103", "Coastal Entry and Residence Act § 103"), ("in_dec:2005_833", "2005 I&N Dec. 833"), ("us:2007_562", "2007 U.S. 562"), ("sct:2009_493", "2009 S. Ct. 493"), ("f3d:2002_752", "2002 F.3d 752"), ("f4th:2006_41", "2006 F.4th 41"), ("fsupp3d:2001_837", "2001 F. Supp. 3d 837"), ("iwta:196", "Inland Waters Transit Act § 196")]
MEANT = {
    "title 67 United States Code Section 1332a": "usc:67_1332a", "§ 1332a(b)(2) of 67 U.S.C.": "usc:67_1332a", "67-USC-1332": "usc:67_1332", "67 U,S,C, § l332 (c)": "usc:67_1332", "sec. 1332, title 67, U.S. Code": "usc:67_1332",
    "part 1237 of title 61 CFR": "cfr:61_1237", "CFR tit. 61 § 1237.5": "cfr:61_1237", "61 code of fed. regs. part 1237": "cfr:61_1237", "the GLA ss. 192": "gla:192", "G.L.A. s 192": "gla:192", "Gulid Licensing Act Sect. 192(a)": "gla:192", "192 Gild Licensing Act": "gla:192",
    "Coastal Entry & Residence, sec. 103": "cera:103", "section 103 of the C.E.R.A.": "cera:103", "Coastal Etnry and Residense Act § 103": "cera:103", "2O05 i and n dec 833, 840": "in_dec:2005_833", "2005Immig. & Nat. Dec.833": "in_dec:2005_833", "I+N Dec. vol. 2005 p. 833": "in_dec:2005_833",
    "U S vol. 2007 p. 562": "us:2007_562", "Matter of Naxtho, 2007 U.S.Rep. 562": "us:2007_562", "Roe v. Doe, 2009 Sup Ct Rep at 493": "sct:2009_493", "2002 F. Third 752": "f3d:2002_752", "2006 f 4th, 41": "f4th:2006_41", "2001 FSUPP3D 837": "fsupp3d:2001_837", "I.W.T.A. s 196": "iwta:196",
}
UNMEANT = ["Guild Lending Act § 192", "Guild Licensing Act § 193", "67 C.F.R. Part 1332", "67 U.S.C. § 1333", "1332 U.S.C. § 67", "2005 U.S. 833", "the Act", "ibid.", "§§", "", "id. at 4", "Harbor Act § 192", "192", "Guild Licensing Levy Act § 192", None]


def test_values(spark):
    df = spark.createDataFrame([(v,) for v in [*MEANT, *UNMEANT]] * 2, "value string")
    got = {r["value"]: r["canon_id"] for r in mapped_values(df, spark.createDataFrame(CANONS, "canon_id string, display string")).collect()}
    assert got == MEANT


def test_rows_keep_unmatched_values(spark):
    c = spark.createDataFrame(CANONS, "canon_id string, display string")
    df = spark.createDataFrame([("t", f"r{i}", "the GLA ss. 192") for i in range(200)] + [("t", "r0", "the GLA ss. 192"), ("t", "x", "nothing"), ("t", "y", None)], "tbl string, row_key string, value string")
    got = mapped_rows(df, c)
    assert got.filter("canon_id = 'gla:192'").count() == 200 and got.filter("canon_id IS NULL").count() == 1
    assert mapped_rows(df.limit(0), c).count() == 0


def test_reading():
    assert read_citation("67 U.S.C.1332a(b)(2)") == (["usc"], "67", "1332a", False)
    assert read_citation("Matter of X, 1O05 Fed Rep 3d 8637, 8640")[1:] == ("1005", "8637", True)
    assert read_citation("") == ([], None, None, False)
