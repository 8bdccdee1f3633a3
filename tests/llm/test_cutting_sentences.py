from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm.cutting import balanced_cuts, boundaries, checked_pieces, cut_unit, marked_offset, page_windows, unit_pieces
from docketry.llm.sentences import evidence, sentence_spans, split_sentences


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab .\n。é́"), max_size=120), min_size=1, max_size=6), st.integers(5, 60), st.integers(0, 70))
def test_pieces_are_the_text(pages, limit, overlap):
    text = "".join(pages)
    cuts = balanced_cuts(text, boundaries(pages), limit, overlap)
    least = min(overlap, limit - 1)
    made, done = "", 0
    for i, (a, b, _) in enumerate(cuts):
        assert b - a <= limit and (a == 0 if i == 0 else a == max(cuts[i - 1][0], cuts[i - 1][1] - least)) and b >= done
        made += text[done:b]
        done = b
    assert made == text


def test_cuts_fall_on_strong_boundaries():
    page = "One sentence here. Another one. " * 6
    pages = [page, "\n<<<PART BEGINS: majority | X | seg_id=c#s1>>>\n" + page, page]
    kinds = [k for _, _, k in balanced_cuts("".join(pages), boundaries(pages), 300, 20)]
    assert "segment" in kinds and "none" not in kinds
    assert [k for _, _, k in balanced_cuts("x" * 100, [], 30, 5)][1:] == ["none"] * 3


@pytest.mark.parametrize("n,width", [(n, w) for n in (1, 2, 5, 9, 30) for w in (1, 2, 3, 7)])
def test_windows(n, width):
    got = page_windows(n, width, {2, 4})
    assert got[0][0] == 0 and got[-1][1] == n - 1 and all(b - a < width for a, b in got)
    assert all(y[0] == (x[1] if width > 1 else x[1] + 1) for x, y in zip(got, got[1:]))
    if width > 1 and n > width:
        assert len(got) == -(-(n - 1) // (width - 1))


def test_units(spark, rows):
    page = lambda n, t: {"page": n, "text": t}
    u = spark.createDataFrame(
        [("over", "p", [page(2, "b" * 30), page(1, "a. " * 10)]), ("over", "p", [page(2, "b" * 30), page(1, "a. " * 10)]), ("equal", "p", [page(1, "x" * 50)]), ("pages", "p", [page(i, None) for i in range(4)]), ("none", "p", None), ("lost", "nope", [page(1, "x" * 99)]), ("nulls", "q", [page(1, "x" * 99)] * 9)],
        "unit_id string, profile string, pages array<struct<page: int, text: string>>",
    ).withColumn("case_id", F.lit("c"))
    seg = spark.createDataFrame([("c", 1, 9), ("c", 2, 0), ("d", 1, 3), (None, 1, 1), ("c", None, 1)], "case_id string, start_page int, start_char int")
    s = spark.createDataFrame([("p", 3, 50, 10), ("q", None, None, None)], "profile string, window_pages int, edge_split_chars int, overlap_chars int")
    got = unit_pieces(u, s, seg)
    assert {(r["unit_id"], r["limit_name"]) for r in got.collect()} == {("over", "edge_split_chars"), ("pages", "window_pages")}
    pieces = got.filter("unit_id = 'over'").orderBy("piece_no").collect()
    assert pieces[0]["text"].startswith("a. a.") and pieces[1]["text"].startswith(pieces[0]["text"][-10:]) and pieces[1]["first_page"] == 1 and pieces[1]["last_page"] == 2
    assert unit_pieces(u.limit(0), s, seg).count() == 0 and unit_pieces(u, s, seg.limit(0)).count() == got.count()
    assert {r[2:] for r in rows(checked_pieces(got, u, s))} == {(True, True, True)}


def test_segments_are_boundaries_with_and_without_markers():
    raw = "no stops here " * 30
    at = 203
    mark = "\n<<<PART BEGINS: majority | X | seg_id=c#s1>>>\n"
    marked = raw[:at] + mark + raw[at:]
    assert marked_offset(marked, at) == at and marked_offset(marked, at + 1) == at + 1 + len(mark) and marked_offset(raw, at) == at
    for text in (raw, marked):
        cuts = list(cut_unit([(1, text)], len(text) * 3 // 4, None, 5, {1: [at]}))
        assert [(c[3], c[4], c[7]) for c in cuts] == [(0, at, "start"), (at - 5, len(text), "segment")]
    assert [c[7] for c in cut_unit([(1, raw)], len(raw) * 3 // 4, None, 5)] == ["start", "none"]
    assert page_windows(12, 9, {4}) == [(0, 4), (4, 11)] and page_windows(12, 9, set()) == [(0, 6), (6, 11)]


SENTENCES = [
    ["Dr. Hestine testified at 9.30 a.m. on the second day.", "The claim covered fees, etc.", "In short, it lapsed at 4 p.m.", "By contrast, no."],
    ["The officer replied, \"No. It was never filed. Ask the clerk.\" and left the room.", "“It was sealed. I saw it,” Dorsar said.", "\"The notice was late.\"", "Did it matter?!"],
    ["She signed as J. R. Hest, Esq., in both columns.", "(See also Nos. 376 and 1020, filed under seal.)", "Under 10 U.S.C. § 639(a), costs rose by 9.3 percent.", "See Roe v. Doe, 1009 F.4th 842, which they cite.", "The permit was sold to Ar & Osk Inc.", "As a matter of course."],
    ["Die Kammer verwies z. B. auf Nr. 632 der Anlage.", "Das Urteil erging am 12. 4. 2031 im 2. Rechtszug.", "„Das genügt nicht. Ich lehne ab.“, schrieb der Prüfer.", "Vgl. S. 828 ff. der Akte."],
    ["« Non. Je refuse. » a répondu l'agent.", "La séance a repris à 14 h. 30 le 1er mai.", "Cf. p. 452 et suiv. du dossier."],
    ["Ud. firmó, según EE. UU. de Orvania, el anexo.", "«No. Nunca llegó.», contestó la secretaria.", "El Sr. Arov citó el núm. 427 del anexo."],
    ["Слушание прошло 3 мая 2031 г. в зале № 859.", "«Почему?» — спросил секретарь.", "Докладчик А. В. Орунов возразил.", "Были утрачены печати и т. д."],
    ["Βλ. άρθρ. 307 παρ. 2 του κανονισμού.", "«Γιατί;» ρώτησε ο γραμματέας.", "Ποιος φταίει;"],
    ["قال د. Dor إن الملف ناقص.", "كتب الموظف: «لا. لم يصل شيء.» ثم انصرف.", "من يتحمل عبء الإثبات؟"],
    ["श्री वी. के. ओरुन ने बयान दिया।", "\"क्यों?\" अधिकारी ने पूछा।", "यह उचित नहीं है!"],
]
CJK = ["委員は「いいえ。届いていません。」と述べた。", "（別紙82を参照。）", "第339条（別表3.1を含む。）が適用される。", "記録はそこで途切れている……", "本当に届いたのか？", "书记员说：“不行。材料没有收到。”随后离开。", "委员问：“为什么？”", "金额为51,234.50元。"]


def parts(text, **k):
    return [text[a:b] for a, b in split_sentences(text, **k)]


def test_sentences_in_every_order():
    rnd = random.Random(1)
    for group in SENTENCES:
        for _ in range(5):
            rnd.shuffle(group)
            assert parts(" ".join(group)) == group
    for _ in range(5):
        rnd.shuffle(CJK)
        assert parts("".join(CJK)) == CJK


def test_layout():
    assert parts("Summary\n\nIt was filed\nlate. Then.\n- One item\n- Two items.\n\n1. First\n2. Second") == ["Summary", "It was filed\nlate.", "Then.", "One item", "Two items.", "First", "Second"]
    assert parts("am\n12. 4. 2031 im Saal.") == ["am\n12. 4. 2031 im Saal."]
    assert parts("It ended.[3] \"Next one.\" [1] Then iDocket stopped. iDocket kept none.It began again.") == ["It ended.[3]", "\"Next one.\" [1]", "Then iDocket stopped.", "iDocket kept none.", "It began again."]
    assert parts(None) == [] and parts(" \n\t ") == [] and parts("x") == ["x"]


def test_the_document_teaches_abbreviations():
    assert not evidence("Ended. next")["ended"][0] == 0
    text = "He saw the Xyzq. of it. The Xyzq. Board met. All agreed."
    assert parts(text) == ["He saw the Xyzq. of it.", "The Xyzq. Board met.", "All agreed."]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB. \n\"'()[]1!?。」「-…“”«»"), max_size=80))
def test_spans_are_ordered_and_cover_all_letters(text):
    spans = split_sentences(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    outside = "".join(text[x:y] for x, y in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(text)]))
    assert not any(c.isalpha() for c in outside)


def test_spans_column(spark, rows):
    df = spark.createDataFrame([("a", "One. Two."), ("a", "One. Two."), ("b", None), ("c", ""), (None, "Null key. Yes.")], "turn_id string, text string")
    assert rows(sentence_spans(df, ["turn_id"])) == sorted([("a", 0, 4), ("a", 5, 9), (None, 0, 9), (None, 10, 14)], key=repr)
    assert sentence_spans(df.limit(0), ["turn_id"]).count() == 0


def test_very_long_texts_take_little_time():
    import time

    from docketry.llm.canonical import read_citation
    from docketry.llm.lookalikes import consistent

    for text in ("The panel, cf. Art. 4, said \"no. never\" [1]. " * 8000, "( « “ \"x\" '" * 20_000, "." * 100_000, "a" * 200_000, "\n" * 100_000 + "x", "（別紙。）委員は「いい。」と。" * 10_000, "слово о праве " * 15_000):
        for f in (split_sentences, consistent, read_citation, lambda t: balanced_cuts(t, boundaries([t]), 6000, 400)):
            began = time.time()
            f(text)
            assert time.time() - began < 10


def test_the_corpus_teaches_abbreviations_and_overrules_the_lists(spark, rows):
    asked = [("a", "The Qrst. Benn met. All agreed."), ("b", "He read it. It ended. Panel left.")]
    teach = [(f"t{i}", f"A letter of Qrst. {n} came, see xyl. {i} of it. The panel saw the file.") for i, n in enumerate(("Arden", "Bolk", "Cree", "Dorn", "Elst", "Fane", "Gorl", "Hest"))]
    df = spark.createDataFrame(asked + teach, "turn_id string, text string")
    got = {k: [] for k in "ab"}
    for k, a, b in rows(sentence_spans(df, ["turn_id"])):
        if k in got:
            got[k].append(dict(asked)[k][a:b])
    assert got["a"] == ["The Qrst. Benn met.", "All agreed."]
    assert got["b"][1:] == ["It ended.", "Panel left."]
    plain = [(f"v{i}", "It is in the col. The rest of the col is lost, and the col ended.") for i in range(5)]
    df = spark.createDataFrame([("x", "It stood in the col. 9 ships came.")] + plain, "turn_id string, text string")
    assert len([r for r in rows(sentence_spans(df, ["turn_id"])) if r[0] == "x"]) == 2
    assert split_sentences("It stood in the col. 9 ships came.") == [(0, 34)]
