from __future__ import annotations

from docketry.llm import page_repair
from docketry.llm.page_repair import case_paragraphs, misread_words, page_noise
from docketry.llm.scan_noise import CONFUSIONS, confusion_distance, nearest_names, read_pages, read_run, running_text

PROSE = "The hearing officer found that the harbor pass satisfied the continuous presence rule in the record. "
UNIT = "unit_id string, case_id string, header string, raw_pages map<int, string>, pages array<struct<page: int, text: string>>"
HEAD = "TITLE: Roe v. Drafen\nCITATION: 1 F.3d 1\n"


def unit(i, n, pages, case="lit_1"):
    return (f"{case}__u{i}of{n}", case, HEAD, dict(pages), [{"page": p, "text": t} for p, t in pages])


def test_distance():
    for true, read in CONFUSIONS:
        assert confusion_distance(f"ab{read}yz", f"ab{true}yz") == 0.4
    assert confusion_distance("same", "same") == 0 and confusion_distance("hat", "cat") is None
    assert confusion_distance("rccorcl", "record") == 0.8


def test_reading_runs():
    assert read_run("17,l86") == (("17,l86", True),) and read_run("17,186") == () and read_run("1332a") == () and read_run("2d") == ()
    assert read_run("outs!de") == (("outs!de", True),) and read_run("right!The") == (("right", False), ("The", False)) and read_run("presump†ion.") == (("presump†ion", True),)
    assert read_run("(e.9.") == (("e.9", False),)


def test_headers_and_page_numbers():
    body = PROSE.strip()
    pages = [(1, f"— 40 —\nSyllabus\n{body}"), (2, f"ROE V. DRAFEN\n— 41 —\n{body}\nExhibit totals:\n55\n68\n37"), (3, f"42    ROE V. DRAF3N\n{body}"), (4, f"{body}\nRoe v. Drafen / 0001\n[43]"), (5, None)]
    got = read_pages(pages, [], HEAD, True)
    assert [(p.header, p.pageno) for p in got] == [(False, True), (True, True), (True, True), (True, True), (False, False)]
    assert got[0].body[0] == "Syllabus" and got[1].body[-1] == "37"


def test_breaks():
    known = {"continuance": 50, "re-examined": 20, "re-": 20, "non-resident": 9}
    pages = read_pages([(1, "it was re-\nexamined, the continu-\nance of the non-\nresident ended at 3-\n4, the con¬"), (2, "tinuance held")], [], None, True)
    words, found = running_text(pages, True, known)
    assert [(b.page, b.left, noise) for b, noise in found] == [(1, "re", False), (1, "continu", True), (1, "non", False), (1, "con", True)]
    assert [w[1] for w in words if w[1].startswith("contin")] == ["continuance", "continuance"] and [w[0] for w in words if w[1] == "continuance"] == [1, 1]


def test_misread_words_need_a_common_word(spark, rows):
    w = spark.createDataFrame([("record", 500), ("rccord", 3), ("recorcl", 2), ("hearing", 90), ("hcaring", 40), ("drafcn", 1), ("drafen", 2), ("x" * 80, 1), ("modernized", 30), ("modemized", 1)], "key string, n bigint")
    got = {r["token"]: r["repairs"][0]["word"] for r in misread_words(w, 10).collect()}
    assert got == {"rccord": "record", "recorcl": "record", "modemized": "modernized"}


def test_words_of_any_length_have_an_index(spark):
    long = "incomprehensibilityandotherwordswithoutblanks" * 3
    i, j = long.index("e", 50), long.index("m", 3)
    odd = [long[:i] + "c" + long[i + 1 :], long[:j] + "rn" + long[j + 1 :]]
    w = spark.createDataFrame([(long, 50), (odd[0], 1), (odd[1], 1), ("arm", 90), ("arrn", 2), ("the", 900), ("tbe", 9), ("tho", 30)], "key string, n bigint")
    got = {r["token"]: r["repairs"][0]["word"] for r in misread_words(w, 10).collect()}
    assert got["arrn"] == "arm" and got["tbe"] == "the" and "tho" not in got
    assert {k: v for k, v in got.items() if len(k) > 24} == dict.fromkeys(odd, long)


def test_names_of_any_length_meet_and_distances_are_quick():
    import time

    long = "abcdefgh" * 20_000 + "n" + "xyz" * 9
    began = time.time()
    assert confusion_distance(long.replace("n", "ri"), long) == 0.4 and confusion_distance(long[:-1] + "q", long) is None
    assert nearest_names({long.replace("n", "ri"), "wyrizan", "drafcn", "the"}, {long: 1, "wynzan": 3, "drafen": 1, "drafan": 9, "then": 2}) == {long.replace("n", "ri"): long, "wyrizan": "wynzan", "drafcn": "drafen"}
    mid = "benevolentandotherlongnamesinarow"
    assert nearest_names({mid.replace("w", "vv"), mid.replace("h", "b", 1)}, {mid: 2}) == {mid.replace("w", "vv"): mid, mid.replace("h", "b", 1): mid}
    assert time.time() - began < 5


def test_names_meet_over_the_length_where_the_index_changes():
    mid = "benevolentandotherlongnam"
    assert len(mid) == 25
    assert nearest_names({mid[:-1] + "rn", "ri" + mid[:23]}, {mid: 2, "n" + mid[:23]: 3}) == {mid[:-1] + "rn": mid, "ri" + mid[:23]: "n" + mid[:23]}
    for n in (38, 39, 40, 41):
        w = ("wyndham" * 9)[:n]
        assert nearest_names({w.replace("m", "rn", 1), w + "d"}, {w: 1, w + "cl": 1, w + "dx": 4}) == {w.replace("m", "rn", 1): w, w + "d": w + "cl"}


def test_pages_are_read_without_the_marked_text(spark):
    marker = "<<<PART BEGINS: 1 | Second Part | seg_id=s_1>>>\n"
    marked = [(1, f"{marker}Second Part\n{PROSE}\n{marker.replace('Second', '| Ünder')}{PROSE}"), (2, PROSE), (3, None)]
    df = spark.createDataFrame([("a__u1of1", "a", HEAD, dict(marked), [{"page": p, "text": t} for p, t in marked])], UNIT)
    got = page_repair._unit_rows(df).first()
    assert got["marked_texts"] == [marker + marker.replace("Second", "| Ünder"), "", None] and got["texts"][1] == PROSE
    raw = [(p, f"Second Part\n{PROSE}") for p in (2, 3)]
    assert [p.headings for p in read_pages(raw, [(2, got["marked_texts"][0])], None, False)] == [p.headings for p in read_pages(raw, [(2, marked[0][1])], None, False)] != [set(), set()]


def test_letter_words():
    import re

    for text in ("It's no_2 the ²½ x̌y 日本 ٣ \x1c†e ﬁ I\u0307 ÀÉ", "a" + "".join(map(chr, range(1, 0xD7FF))) * 2, ""):
        assert [w.decode() for w in page_repair._letter_words(text)] == re.findall(r"[^\W\d_]+", text.lower())


def test_context_decides_and_running_lines_stand_at_edges(spark, rows):
    body = "The hearing officer met the warden of the port in the month of modem trade. " * 4
    plain = [unit(1, 1, [(1, "Start of it\n" + body), (2, "Interim Print Copy\n" + body + "\n" + body + "\nRound Table Rules\n" + body + "\n" + body)], f"lit_{i}") for i in range(20)]
    other = "A modern office is a modern place and the modern court sat. " * 60
    df = spark.createDataFrame([*plain, unit(1, 1, [(1, other)], "lit_m"), unit(1, 1, [(1, body), (2, "Interim Print Copy\n" + body + "The warclen sat."), (3, "Round Table Rules\n" + body)], "lit_z")], UNIT)
    got = {r for r in rows(page_noise(df)) if r[0] in ("lit_z", "lit_3")}
    assert got == {("lit_3", 2, "header"), ("lit_z", 2, "header"), ("lit_z", 2, "ocr")}  # modem is no misread modern here
    assert "The warden sat." in " ".join(r[3] for r in rows(case_paragraphs(df)) if r[0] == "lit_z")


def test_noise_and_text(spark, rows):
    clean = [unit(1, 1, [(1, PROSE * 4), (2, PROSE * 4)], f"lit_{i}") for i in range(5, 15)]
    noisy = [
        unit(1, 2, [(1, "Syllabus\n" + PROSE * 3 + "\nThe hcaring officer Drafcn found the contin-\nuous rule."), (2, "Roe v. Drafen\n" + PROSE + "\nThe harbor pass satisfied the contin-")]),
        unit(2, 2, [(2, "Roe v. Drafen\n" + PROSE + "\nThe harbor pass satisfied the contin-"), (3, "uous presence rule in 17,l86 pages.\n7"), (4, None), (5, "")]),
    ]
    df = spark.createDataFrame(noisy + noisy + clean, UNIT)
    got = {r for r in rows(page_noise(df)) if r[0] == "lit_1"}
    assert got == {("lit_1", 1, "hyphen"), ("lit_1", 1, "ocr"), ("lit_1", 2, "header"), ("lit_1", 2, "hyphen"), ("lit_1", 3, "ocr"), ("lit_1", 3, "pageno")}
    text = [r[3] for r in rows(case_paragraphs(df)) if r[0] == "lit_1"]
    assert text[0] == "Syllabus" and "The hearing officer Drafen found the continuous rule." in text[1]
    assert " ".join(text).count("The harbor pass satisfied the continuous presence rule in 17,186 pages.") == 1 and "Roe v." not in " ".join(text)


def test_rarer_words_count_at_every_size(spark, rows, monkeypatch):
    body = PROSE * 3 + "\nThe warden of Wynzan re-examined the levy at Qorlet. A re- examined levy. The sloop sailed."
    clean = [unit(1, 1, [(1, body)], f"lit_{i}") for i in range(30)]
    odd = unit(1, 1, [(1, PROSE + "\nThe wardcn of Wyrizan re-\nexamined the levy. The slo0p sailed from the war-\nden. Then Qorlet and Qorlct of Wynzan.")], "lit_x")
    df = spark.createDataFrame([*clean, odd, (None, "lit_n", *odd[2:])], UNIT)

    def found():
        return rows(page_noise(df)), rows(case_paragraphs(df))

    small = found()
    monkeypatch.setattr(page_repair, "COMMON_SHARE", 0.02)  # as on a table so large that these words are below the share
    assert page_repair.Lexicon(df).rare is not None and found() == small
    noise, text = [r for r in small[0] if r[0] == "lit_x"], " ".join(r[3] for r in small[1] if r[0] == "lit_x")
    assert noise == [("lit_x", 1, "hyphen"), ("lit_x", 1, "ocr")]
    assert "The warden of Wynzan re-examined the levy. The sloop sailed from the warden." in text


def test_empty_tables_and_null_maps(spark):
    df = spark.createDataFrame([("a__u1of1", "a", None, None, None), ("b", "b", None, {1: None, 2: " \n "}, [])], UNIT)
    assert page_noise(df).count() == 0 and case_paragraphs(df).count() == 0 and page_noise(df.limit(0)).count() == 0
