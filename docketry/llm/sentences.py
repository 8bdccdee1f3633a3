"""Sentences of texts in any language, by document-centred disambiguation of what a full stop means."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.skew import salted
from docketry.sources.tables import checkpointed

# Common abbreviations that introduce what follows, and such that may end a sentence. Lower case, without the last
# stop. They are asked last: about words of which neither the document nor the corpus tells.
LEADING = set("art cf col dr ee fig m mr mrs ms no nos nr núm p pág párr s sec sr st v vgl z ст стр βλ άρθρ παρ د श्री".split())
TRAILING = set("a.m p.m co corp etc et.al esq ff inc jr ltd suiv usw u.s ud uu h sept т.д т.п г д κ.λπ κλπ".split())
# Those that are words as well, and abbreviations only before a number.
WORDS_TOO = set("no art fig col sec".split())
# German words before an ordinal number, and Chinese words that take up a sentence after a quotation.
ORDINAL_LEADS = set("am im vom zum zur der des dem den die das bis ab beim seit".split())
TAKEN_UP = ("随后", "然后", "接着", "而后", "于是", "并", "便", "就", "後", "的", "地", "，", "、", "；")

TERMINATORS = ".!?…。！？｡．؟۔।॥;;᙮።፧།။៕‼⁇⁈⁉"
WIDE_ENDS = "。！？｡．؟۔।॥።፧།။៕"
CLOSERS = "\"'”’»›」』）)］]】》〉｣＂＇"
PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "［": "］", "【": "】", "《": "》", "‘": "’", "‚": "‘’", "‹": "›", "｢": "｣"}
BRACKETS = "（([［【"

_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")
_ITEM = re.compile(r"(?:^|\n)[^\S\n]*(?:(?P<bullet>[-*•–·‣▪◦○●])|(?P<open>\()?(?P<number>\d{1,3})(?P<close>[.)])|\((?P<letter>[a-z])\))[^\S\n]+(?=\S)")
_MARKER = re.compile(r"\s*\[\d{1,3}\]")
_END = re.compile(f"[{re.escape(TERMINATORS)}]+")
_MARK = re.compile("[\u0300-\u036f\u0900-\u0903\u093a-\u094f\u0962\u0963]")
_NUMBER_BEFORE = re.compile(r"(?:(\w+)\s+)?(\d+)$")
_NEXT_WORD = re.compile(r"(?:[^\W\d_]|[̀-ͯ])+")
_OPENERS = re.compile("[\"'“„«‘‚‹¿¡(\\[（「『‘]+\\s*")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_CASED = re.compile(r"[a-zA-ZÀ-ɏͰ-ϿЀ-ӿ]")
_LETTERS = r"[\w\u0300-\u036f\u0900-\u0903\u093a-\u094f\u0962\u0963]"
_STOPPED = re.compile(rf"(?<![^\W\d_])((?:(?!\d){_LETTERS})+(?:\.[^\W\d_]+)*)\.(\s*)(\S)?(\S)?")
_PLAIN = re.compile(rf"(?<![\w.]){_LETTERS}++(?!\.)")
_MIDDLE = re.compile(rf"(?<=[\w,;]\s){_LETTERS}++(?!\.)")
_AFTER = re.compile(rf"{_LETTERS}+")

#: What is counted of each lower-cased word: stops behind it that can't end a sentence (lower case, a comma or the like follows),
#: stops before a number, before a capitalized word, before one that the same document has in lower case, at the end of a block,
#: all stops; the word without a stop, in lower case, and with a capital inside a sentence.
COUNTS = ("inner", "numbered", "capital", "known", "final", "stops", "plain", "lower", "name")
INNER, BEFORE_NUMBER, CAPITAL, KNOWN, FINAL, STOPS, PLAIN, LOWER, NAME = range(9)
#: What counts make of a word: an abbreviation or none, one that stands before numbers, may end a sentence, or ends it wherever a
#: capital follows; a word that begins a sentence when it has a capital, or a name.
ABBREVIATION, NO_ABBREVIATION, NUMBERED, MAY_END, ENDS, STARTER, A_NAME = 1, 2, 4, 8, 16, 32, 64


def _low_start(first: str | None, second: str | None) -> bool:
    """Whether what follows begins in lower case, names like iDocket aside."""
    return bool(first) and first.islower() and not (second or "").isupper()


def _is_word(w: str) -> bool:
    """Words with letters and blanks around them: none of the scripts without blanks, and no numbers."""
    return not ("\u2e80" <= w[0] < "\uac00") and (w.isalpha() or not any(c.isdigit() or c == "_" for c in w))


def evidence(text: str) -> dict[str, list[int]]:
    """COUNTS of each lower-cased word of a text."""
    out: dict[str, list[int]] = {}
    for tokens, at in ((Counter(_PLAIN.findall(text)), PLAIN), (Counter(_MIDDLE.findall(text)), NAME)):
        for w, n in tokens.items():
            if not _is_word(w) or at == NAME and not w[0].isupper():
                continue
            seen = out.setdefault(w.lower(), [0] * len(COUNTS))
            seen[at] += n
            if at == PLAIN and w[0].islower():
                seen[LOWER] += n
    for m in _STOPPED.finditer(text):
        seen = out.setdefault(m[1].lower(), [0] * len(COUNTS))
        seen[STOPS] += 1
        first = m[3]
        if not first or m[2].count("\n") > 1:
            seen[FINAL] += 1
        elif m[2] and _low_start(first, m[4]) or first in ",:;":
            seen[INNER] += 1
        elif m[2] and first.isdigit():
            seen[BEFORE_NUMBER] += 1
        elif m[2] and first.isupper():
            seen[CAPITAL] += 1
            after = out.get(_AFTER.match(text, m.start(3))[0].lower())
            seen[KNOWN] += bool(after and after[LOWER] > after[NAME])
    return out


def facts_of_document(seen: list[int]) -> int:
    """What a document's own counts of a word say for sure; 0 if nothing."""
    inner, numbered, _, _, _, stops, plain, lower, name = seen
    bits = 0
    if inner and plain * 4 <= stops:
        bits |= ABBREVIATION
    elif plain and not inner and not numbered:
        bits |= NO_ABBREVIATION
    if numbered >= 2 and numbered * 2 >= stops:
        bits |= NUMBERED
    if lower > name:
        bits |= STARTER
    elif name and not lower:
        bits |= A_NAME
    return bits


#: A word is judged by the corpus's counts if it bears a stop this often, and a title (what names follow only) if it does so often.
LEAST_STOPS, LEAST_TITLES = 3, 6


def facts_of_corpus(inner, numbered, capital, known, final, stops, plain, lower, name):
    """The same of the corpus's counts (columns), all in shares, so that it says the same of a corpus of any size.

    An abbreviation rarely lacks its stop, and in a tenth of its occurrences or more the stop can't end a sentence, or a number
    follows in a quarter; or it never stands at the end of a block, and what follows with a capital is nearly always a name.
    """
    enough = stops >= LEAST_STOPS
    bound = plain * 4 <= stops
    title = (stops >= LEAST_TITLES) & (final * 50 <= stops) & (capital * 2 >= stops) & (known * 10 <= capital)
    abbreviation = enough & bound & ((inner * 10 >= stops) | (numbered * 4 >= stops) | title)
    may = enough & ((known * 20 >= stops) | (final * 20 >= stops))
    ends = may & ((known * 2 >= capital) | (final * 5 >= stops))
    return {
        ABBREVIATION: abbreviation, NO_ABBREVIATION: enough & ~abbreviation & (~bound | (final * 50 > stops) | (known * 10 > capital)), NUMBERED: (numbered >= 2) & (numbered * 5 >= stops), MAY_END: may, ENDS: ends,
        STARTER: lower > name, A_NAME: (name > 0) & (lower * 20 <= name),
    }


def _blocks(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines and list marks; the marks are in none. Numbers count as marks only in sequence."""
    cuts: list[tuple[int, int]] = [(m.start(), m.end()) for m in _BLANK_LINE.finditer(text)]
    last: dict[str, int] = {}
    for m in _ITEM.finditer(text):
        if m["number"]:
            style = (m["open"] or "") + m["close"]
            n = int(m["number"])
            if n != 1 and last.get(style) != n - 1:
                continue
            last[style] = n
        cuts.append((m.start(), m.end()))
    out, at = [], 0
    for a, b in sorted(cuts):
        if a >= at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, len(text))]


_CLOSING: dict[str, str] = {}
for _opening, _closings in PAIRS.items():
    for _c in _closings:
        _CLOSING[_c] = _CLOSING.get(_c, "") + _opening
_SIGNS = re.compile("[\"'" + re.escape("".join({*PAIRS, *_CLOSING})) + "]")
_SINGLE_END = re.compile(r"[,.!?…]'(?!\w)")
_NOT_BLANK = re.compile(r"\S")


def _enclosures(s: str) -> list[tuple[int, int]]:
    """Spans (opening sign, closing sign) of outermost quotations and brackets that are closed. One pass, whatever is left open."""
    open_at: dict[str, list[int]] = {}
    pairs: list[tuple[int, int]] = []
    no_single, single_until = False, -1
    for m in _SIGNS.finditer(s):
        c, i = m[0], m.start()
        if c == "'":
            if i > single_until and not no_single and (i == 0 or s[i - 1].isspace() or s[i - 1] in "([“") and s[i + 1 : i + 2].isalnum():
                end = _SINGLE_END.search(s, i + 1)
                no_single = end is None
                if end:
                    single_until = end.end() - 1
                    pairs.append((i, single_until))
            continue
        if c == '"':
            stack = open_at.setdefault(c, [])
            if stack:
                pairs.append((stack.pop(), i))
            else:
                stack.append(i)
            continue
        ready = [o for o in _CLOSING.get(c, "") if open_at.get(o)]
        if ready:
            pairs.append((open_at[max(ready, key=lambda o: open_at[o][-1])].pop(), i))
        elif c in PAIRS and not (c == "»" and (i == 0 or not s[i - 1].isspace())):
            open_at.setdefault(c, []).append(i)
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


YES, IF_OPENING, UNLESS_OPENING, ASK = range(4)
#: What follows a stop about which the word before it decides: nothing between, a marker, an opening sign, a number, a sign, an
#: initial, a word; and the same for scripts without case.
JOINED, MARKED, OPENED, DIGIT, SIGN, INITIAL, FOLLOWED, UNCASED = range(8)


def scan(text: str) -> tuple[list[tuple[int, int]], list[tuple], dict[str, list[int]]]:
    """(blocks, stops, counts): the spans of blocks without blanks at their ends; of each stop that may end a sentence (offset, end of
    the sentence, begin of the next, opening sign of its quotation or bracket or -1, code, word before, word behind, kind, what
    it does if the word is no abbreviation, what the document itself knows of the two words); and `evidence`."""
    own = evidence(text)
    known = lambda w: facts_of_document(own[w]) if w in own else 0
    blocks: list[tuple[int, int]] = []
    stops: list[tuple] = []
    for base, stop in _blocks(text):
        s = text[base:stop]
        begin = _NOT_BLANK.search(s)
        if not begin:
            continue
        blocks.append((base + begin.start(), base + len(s.rstrip())))
        spans = _enclosures(s)
        opens = [a for a, _ in spans]
        for m in _END.finditer(s):
            a, b = m.start(), m.end()
            k = bisect_right(opens, a) - 1
            inside = spans[k] if k >= 0 and a < spans[k][1] else None
            if inside and s[b : inside[1]].strip() and _MARKER.fullmatch(s[b : inside[1]]) is None:
                continue
            e = inside[1] + 1 if inside else b
            marks = m[0]
            if set(marks) <= {";", "\u037e"} and not (("\u037e" in marks) or a > 0 and _GREEK.match(s[a - 1])):
                continue
            while e < len(s) and s[e] in CLOSERS and not inside and (s[e] not in "\"'" or not any(x == e for x in opens)):
                e += 1
            tail = e
            while (n := _MARKER.match(s, tail)) is not None:
                tail = n.end()
            marked = tail > e
            ahead = _NOT_BLANK.search(s, tail)
            if not ahead:
                continue  # the block's end ends the sentence
            after = _Ahead(s, ahead.start())
            gap = ahead.start() > tail
            first, second = after.first, after.second
            low = _low_start(first, second)
            code, asked = None, ("", "", 0, False, 0, 0)
            if inside and s[inside[0]] in BRACKETS:
                code = IF_OPENING
            elif inside:
                if first in ",;:—–-، ؛、，；":
                    continue
                if _CASED.match(first) or first.isdigit() or first in "\"'“„«‘¿¡([":
                    word = after.word
                    if not low and (not _CASED.match(first) or first.isupper() or word is not None and not _low_start(word[0], word[1:2])):
                        code = YES
                elif marks[-1] in WIDE_ENDS and re.match(r"[一-鿿（“「『]", first):
                    code = YES if first == "（" else UNLESS_OPENING if not s.startswith(TAKEN_UP, ahead.start()) else None
                if marked and not low:
                    code = YES
            elif any(c in WIDE_ENDS for c in marks) or set(marks) == {"…"} and len(marks) > 1:
                code = YES
            elif any(c in "!?‼⁇⁈⁉;\u037e" for c in marks):
                code = YES if not low and first not in ",;:—–،，" else None
            elif marks == "…" or len(marks) > 1 and set(marks) == {"."}:
                code = YES if not low and first not in ",;:.—–" and (gap or first.isupper()) else None
            else:
                judged = _single_stop(s, a, e, after, gap, marked)
                if judged is True:
                    code = YES
                elif judged is not False:
                    word, following, kind, plain = judged
                    code, asked = ASK, (word, following, kind, plain, known(word), known(following))
            if code is not None:
                stops.append((base + a, base + tail, base + ahead.start(), -1 if inside is None else base + inside[0], code, *asked))
    return blocks, stops, own


class _Ahead:
    """What follows a stop: its first two characters, and its first word, behind opening signs. Each is read when asked for."""

    def __init__(self, s: str, at: int) -> None:
        self.first, self.second = s[at], s[at + 1 : at + 2]
        opened = _OPENERS.match(s, at)
        self.opened = opened is not None
        head = opened.end() if opened else at
        found = _NEXT_WORD.match(s, head)
        self.word = found[0] if found else None
        self.next = s[found.end() : found.end() + 1] if found else ""
        self.head_first = s[head : head + 1]


def _single_stop(s: str, a: int, e: int, after: _Ahead, gap: bool, marked: bool) -> bool | tuple[str, str, int, bool]:
    """What a single stop at `a`, outside quotations, does: end a sentence or not whatever the word before it is; or that word,
    the one behind, the kind of what follows, and what it does if the word is no abbreviation."""
    first, word = after.first, _word_before(s, a)
    name, following = word if len(word) == 1 else word.lower(), (after.word or "").lower()
    if not gap and not marked and e == a + 1:
        # Without a blank: only where a word, a number or a bracket ends and a word in a capital begins.
        w = after.word if not after.opened else None
        capital = bool(w) and w[0].isupper() and w[1:2].islower()
        if not word:
            return capital and a > 0 and (s[a - 1].isdigit() or s[a - 1] in ")]%")
        if _CASED.match(word[-1]):
            begins = bool(w) and (w[0].isupper() and (len(w) > 1 or after.next.isspace()) or len(w) > 1 and w[1].isupper())
            plain = len(name) > 2 and word[-1].islower() and (begins or after.opened and after.word is not None or first.isdigit() and len(name) > 3)
        else:
            plain = len(name) > 2 and after.word is not None
        return (name, following, JOINED, plain and "." not in name) if capital or plain else False
    if first in ",;:)،؛，；、" or _low_start(first, after.second):
        return False
    if not word:
        number = _NUMBER_BEFORE.search(s, max(0, a - 30), a)
        if number and len(number[2]) <= 2:
            if first.isdigit():
                return False
            if first.isupper() and (number[1] or "").lower() in ORDINAL_LEADS:
                return False
        return True
    if not _CASED.match(word[-1]):
        return marked or (name, following, UNCASED, sum(c.isalpha() for c in word) > 2)
    if marked:
        kind = MARKED
    elif after.opened and first in "\"“„«‘¿¡(":
        kind = OPENED
    elif first.isdigit() or after.word and len(after.word) <= 4 and after.word.isupper() and len(after.word) > 1:
        kind = DIGIT
    elif after.word is None:
        kind = SIGN
    elif len(after.word) == 1 and after.next == ".":
        kind = INITIAL
    else:
        kind = FOLLOWED
    return name, following, kind, True


def _word_before(s: str, a: int) -> str:
    """The word before a stop, with the stops inside it; read backwards, so however long it is."""
    i = a
    while i > 0 and (s[i - 1].isalpha() or _MARK.match(s[i - 1]) or s[i - 1] == "." and i < a and i > 1 and (s[i - 2].isalpha() or _MARK.match(s[i - 2]))):
        i -= 1
    return s[i:a]


def stop_ends(word: str, kind: int, plain: bool, of_word: int, of_following: int) -> bool:
    """Whether a stop ends a sentence, by what is known of the word before it and of the one behind it (bits, 0 if nothing)."""
    dotted, single = "." in word, len(word) == 1
    if single and word.isupper() and kind in (DIGIT, SIGN, INITIAL, FOLLOWED):  # an initial
        return bool(of_following & STARTER) and kind == FOLLOWED
    if kind == DIGIT and of_word & NUMBERED:
        return False
    if of_word & ABBREVIATION or dotted:
        abbreviation = True
    elif of_word & NO_ABBREVIATION:
        abbreviation = False
    else:
        abbreviation = (kind == DIGIT or word not in WORDS_TOO) and (word in LEADING or word in TRAILING or single and kind != UNCASED)
    if not of_word & (ABBREVIATION | NO_ABBREVIATION) or of_word & ABBREVIATION and not of_word & MAY_END and word in TRAILING:
        may, ends = word in TRAILING, word in TRAILING and not single
    else:
        may, ends = bool(of_word & MAY_END), bool(of_word & ENDS)
    if kind == UNCASED:
        return plain and not abbreviation
    if not abbreviation:
        return plain
    if kind == JOINED:
        return may and ends and not (of_following & A_NAME)
    if kind == MARKED:
        return True
    starts = bool(of_following & STARTER)
    if kind == OPENED:
        return may
    if kind == DIGIT:
        return may and not of_word & NUMBERED and not single
    if kind == SIGN:
        return may and not single
    if kind == INITIAL:
        return starts and ends and not single or ends and dotted
    return starts and (may or single) or ends and not of_following & A_NAME


def decide(blocks: list[tuple[int, int]], stops: list[tuple], facts: dict[str, int]) -> list[tuple[int, int]]:
    """Offsets of sentences from what `scan` gives: what the document knows of a word counts, then `facts` (of the corpus), then
    the fixed lists."""
    out: list[tuple[int, int]] = []
    i = 0
    for begin, end in blocks:
        start = at = begin  # the sentence's first character, and where the one before ended
        while i < len(stops) and stops[i][0] < end:
            a, tail, following, opened, code, word, after, kind, plain, of_word, of_after = stops[i]
            i += 1
            if a < at:
                continue
            if code == ASK:
                if len(word) > a - at:  # part of the word belongs to the sentence before
                    word, of_word = word[len(word) - (a - at) :].lstrip("."), 0
                of_word = _with_corpus(of_word, facts.get(word, 0), ABBREVIATION | NO_ABBREVIATION)
                of_after = _with_corpus(of_after, facts.get(after, 0), STARTER | A_NAME)
                ends = stop_ends(word, kind, plain, of_word, of_after)
            else:
                ends = code == YES or (code == IF_OPENING) == (opened == start)
            if ends:
                out.append((start, tail))
                start, at = following, tail
        if start < end:
            out.append((start, end))
    return out


def _with_corpus(own: int, corpus: int, rivals: int) -> int:
    """The document's facts, and the corpus's where they don't gainsay them."""
    return own | (corpus & ~rivals if own & rivals else corpus)


def split_sentences(text: str | None, facts: dict[str, int] | None = None) -> list[tuple[int, int]]:
    """Offsets [start, end) of the sentences, without blanks at their ends and without list marks.

    Blank lines and list marks end a sentence, other line breaks don't. Inside a number or a closed quotation or bracket a stop
    ends nothing; a quotation that ends with a final mark ends the sentence if a new one seems to begin, a bracket does if the
    sentence began with it. Of other stops the word before decides: behind an abbreviation a stop ends a sentence only if the
    abbreviation may stand last and a word follows that isn't a name. Abbreviations and names are told from the document's own
    unambiguous occurrences, then from `facts` (of the corpus), and only where both are silent from fixed lists. Scripts with
    signs of their own (。 । ؟) end at these; a stop behind one or two letters of a script without case is an abbreviation's.
    Null, empty and blank texts have no sentence.
    """
    if not text or text.isspace():
        return []
    blocks, stops, _ = scan(text)
    return decide(blocks, stops, facts or {})


_STOP = "struct<a: int, tail: int, following: int, opened: int, code: int, word: string, after: string, kind: int, plain: boolean, of_word: int, of_after: int>"
_WORDS = f"array<struct<word: string, {', '.join(f'{c}: bigint' for c in COUNTS)}>>"


def sentence_spans(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The key columns with start_char and end_char of every sentence of the `text` column.

    Python reads each text once, where it lies, and hands on numbers and the words before and behind doubtful stops; the counts of
    words are added up for each batch first. What the corpus says of a word is joined to the texts that ask for it, with hot words
    salted; no text is shuffled, and nothing is broadcast that grows. Equal rows count once in the result, and rows with a null
    text have none.
    """
    rows = texts.select(*key, F.col(text).alias("text")).filter(F.col("text").isNotNull())

    @F.pandas_udf(f"blocks array<struct<b: int, e: int>>, stops array<{_STOP}>, words {_WORDS}")
    def read(c: pd.Series) -> pd.DataFrame:
        batch: dict[str, list[int]] = {}
        out = []
        for t in c:
            blocks, stops, own = scan(t)
            out.append([blocks, stops, None])
            for w, n in own.items():
                if n[STOPS] or n[PLAIN] or n[NAME]:
                    seen = batch.get(w)
                    batch[w] = n if seen is None else [x + y for x, y in zip(seen, n, strict=True)]
        if out:
            out[0][2] = [(w, *n) for w, n in batch.items()]
        return pd.DataFrame(out, columns=["blocks", "stops", "words"])

    @F.pandas_udf("array<struct<start_char: int, end_char: int>>")
    def split(blocks: pd.Series, stops: pd.Series, facts: pd.Series) -> pd.Series:
        out = []
        for b, s, f in zip(blocks, stops, facts, strict=True):
            known = {x["word"]: x["bits"] for x in f} if f is not None else {}
            out.append(decide([(x["b"], x["e"]) for x in b], [tuple(x.values()) for x in s], known))
        return pd.Series(out)

    scanned = checkpointed(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("s", read.asNondeterministic()("text")).select("uid", *key, "s.*"))
    corpus = scanned.filter(F.col("words").isNotNull()).select(F.inline("words")).groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])
    bits = sum((F.when(c, F.lit(bit)).otherwise(F.lit(0)) for bit, c in facts_of_corpus(*[F.col(c) for c in COUNTS]).items()), F.lit(0))
    facts = corpus.select("word", bits.cast("int").alias("bits")).filter(F.col("bits") > 0)
    doubtful = scanned.select("uid", F.explode(F.filter("stops", lambda s: s["code"] == ASK)).alias("s"))
    needed = doubtful.select("uid", F.explode(F.array("s.word", "s.after")).alias("word")).filter(F.col("word") != "").distinct()
    counts = needed.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.filter(F.col("n") >= needed.select(F.count(F.lit(1))).scalar() * F.lit(0.01)).select("word")
    left, right = salted(needed, facts, hot, "word", F.col("uid"))
    known = left.join(right, ["word", "salt"]).groupBy("uid").agg(F.collect_list(F.struct("word", "bits")).alias("facts"))
    joined = scanned.select("uid", *key, "blocks", "stops").join(known.withColumnRenamed("uid", "known_uid"), F.col("uid") == F.col("known_uid"), "left")
    return joined.select(*key, F.inline(split("blocks", "stops", "facts"))).distinct()
