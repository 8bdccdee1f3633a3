"""Noise of scanned pages: running headers, page numbers, broken words and misread characters."""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import chain

# What is printed and what it is misread as.
CONFUSIONS = (
    ("e", "c"), ("h", "b"), ("t", "†"), ("i", "!"), ("o", "0"), ("l", "1"), ("s", "5"), ("g", "9"), ("u", "ii"),
    ("n", "ri"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("li", "h"), ("rn", "m"), ("cl", "d"),
)
# Fixed value: how a line begins that gives the citation of the case, as fold_misread leaves it.
CITED = "citc as:"
#: What a confusion costs in the weighted edit distance, where any other edit costs 1; and the most that a repair may cost.
CONFUSION_COST, MOST_COST = 0.4, 0.8
# Headings of parts that stand alone at the top of a case, as fold_misread leaves them.
HEADINGS = {"syllabus"}
HYPHENS = "-¬­‐"

#: A part's marker, in the syntax of Python and of Java; the first group is its heading.
PART = r"<<<PART BEGINS: [^|\n]*\| ([^\n]*) \| seg_id=[^\n]*>>>\n"
_PART = re.compile(PART)
_HYPHEN_END = re.compile(rf"[{HYPHENS}]\s*(?:\n|\Z)")
_N = r"[0-9OolIS]*[0-9][0-9OolIS]*"
_NUMBER_LINE = re.compile(rf"\s*(?:[—–-]\s*{_N}\s*[—–-]|\[{_N}\]|{_N}\s+[oc0]f\s+{_N}|[Pp][a@]g[ec9]\s+{_N}|[Pp]\.\s*{_N}|(?P<roman>[ivxlcIVXLC]+)|(?P<bare>{_N}))\s*")
_NUMBER_HEAD = re.compile(rf"^\s*(?:p\.\s*|Pag[ec]\s+)?{_N}(?:\s{{2,}}|\t)(?=\S)")
_NUMBER_TAIL = re.compile(rf"(?<=\S)(?:\s{{2,}}|\t)(?:p\.\s*|Pag[ec]\s+)?{_N}\s*$")
_LEFT = re.compile(rf"(?:^|[^\w†'’])((?:[^\W_]|†|!)*[^\W\d_]|[^\W\d_])([{HYPHENS}])\s*$")
_RIGHT = re.compile(r"^\s*((?:[^\W_]|†|(?<=[^\W_])!(?=[^\W\d_]))+)")
_NUMBER_IN, _TITLE, _GAP = re.compile(_N), re.compile(r"(?m)^TITLE: (.+)$"), re.compile(r"\s{2,}|\t")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_RUN = re.compile(r"[A-Za-zÀ-ɏ0-9†][A-Za-zÀ-ɏ0-9†!.,'’]*")
_NUMBER = re.compile(r"[0-9OIlo]+(?:[.,][0-9OIlo]+)*")
_SUFFIXED = re.compile(r"[0-9]+(?:[a-h]|st|nd|rd|th|d|er|e|re|ème|a|o|º|ª|s)", re.IGNORECASE)
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")


_BETWEEN_LETTERS = [(true, read, re.compile(rf"(?<=[a-z]){read}|{read}(?=[a-z]{{2}})")) for true, read in (("o", "0"), ("l", "1"), ("s", "5"), ("g", "9"), ("t", "†"), ("i", "!"))]
_DIGITS = re.compile(r"\d+")


def fold_misread(s: str) -> str:
    """A form in which a line and its misreadings mostly agree: lower case, digits as #, misread signs as printed."""
    return _folded(s) if len(s) <= 200 else _folded.__wrapped__(s)


@lru_cache(1 << 15)  # most are running lines, which come again
def _folded(s: str) -> str:
    s = " ".join(s.lower().split())
    for true, read, between in _BETWEEN_LETTERS:
        if read in s:
            s = between.sub(true, s)
    s = _DIGITS.sub("#", s)
    for printed, misread in (("ii", "u"), ("ri", "n"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("e", "c"), ("h", "b")):
        s = s.replace(printed, misread)
    return s


_PROSE_ENDS = frozenset(".!?…。！？।؟,;-¬­‐、，")


def _runs_as_prose(line: str) -> bool:
    words = line.split()
    if len(words) > 10:
        return True
    if line.rstrip("\"'”’»」』)） \t")[-1:] in _PROSE_ENDS or len([1 for w in words if w[0].islower()]) > 3:
        return True
    return not line.isascii() and bool(_WIDE.search(line))


@dataclass
class Page:
    """A page's lines, without those that belong to the print."""

    page: int
    body: list[str]
    first: bool
    lines: list[str]
    edges: list[int]
    headings: set[str] = field(default_factory=set)
    header: bool = False
    pageno: bool = False

    @cached_property
    def text(self) -> str:
        return "\n".join(self.body)

    @cached_property
    def hyphens(self) -> bool:
        """Whether a line ends with a hyphen or its like."""
        return bool(_HYPHEN_END.search(self.text))


def _edges(lines: list[str]) -> list[int]:
    """Places of the first two and the last two lines that aren't blank."""
    out: set[int] = set()
    for way in (range(len(lines)), range(len(lines) - 1, -1, -1)):
        n = 0
        for i in way:
            if lines[i] and not lines[i].isspace():
                out.add(i)
                n += 1
                if n == 2:
                    break
    return sorted(out)


def _page_numbers(lines: list[str], expected: int | None, bare_ok: bool) -> set[int]:
    """Places of lines that are a printed page number: at the page's edge, and if it is a number alone, not the last of a list of
    numbers, unless it is the expected one."""
    out = set()
    full = [i for i, x in enumerate(lines) if x.strip()]
    for side in (full[:2], full[::-1][:2]):
        for rank, i in enumerate(side):
            m = _NUMBER_LINE.fullmatch(lines[i])
            if not m or out & set(side):
                continue
            if m["bare"]:
                at = full.index(i)
                listed = 0
                while at - 1 - listed >= 0 and (p := _NUMBER_LINE.fullmatch(lines[full[at - 1 - listed]])) and p["bare"]:
                    listed += 1
                led = at - 1 - listed >= 0 and lines[full[at - 1 - listed]].rstrip().endswith(":")
                follows = at + 1 < len(full) and bool((q := _NUMBER_LINE.fullmatch(lines[full[at + 1]])) and q["bare"])
                if led and (follows or listed < 3) and not (expected is not None and _digits(m["bare"]) == expected and not follows):
                    continue
                if rank and not led and side is not full and not bare_ok:
                    continue
            if m["roman"] and not re.fullmatch(r"(?i)c?(?:x{1,4}|xl|l)?(?:v?i{0,4}|iv|ix)", m["roman"]):
                continue
            if rank and _runs_as_prose(lines[side[0]]) and not _NUMBER_LINE.fullmatch(lines[side[0]]):
                continue
            out.add(i)
    return out


def _digits(s: str) -> int | None:
    t = s.translate(str.maketrans("OolIS", "00115"))
    return int(t) if t.isdigit() else None


def read_pages(raw: list[tuple[int, str | None]], marked: list[tuple[int, str | None]], header: str | None, is_start: bool, running: frozenset[str] | set[str] = frozenset()) -> list[Page]:
    """The pages of a unit in order, with what was printed around the text taken out.

    A page number is a line of a page number's form at the page's edge, or stands behind a wide gap in a header line. A header
    or footer is an edge line that isn't a part's heading and that repeats the case's title or citation, or a line at the
    edge of another page of the unit, or one of the `running` lines of the corpus. The first page of a case bears none.
    """
    headings: dict[int, set[str]] = {}
    for page, text in marked:
        headings.setdefault(page, set()).update(fold_misread(m[1]) for m in _PART.finditer(text or ""))
    title = _TITLE.search(header or "")
    name = fold_misread(title[1]) if title else ""
    pages = sorted({p: t for p, t in raw}.items())
    lines = {p: (t or "").split("\n") for p, t in pages}
    edges = {p: _edges(x) for p, x in lines.items()}
    base: Counter[int] = Counter()
    numbered_pages = set()
    for p, _ in pages:
        for i in edges[p]:
            if m := _NUMBER_LINE.fullmatch(lines[p][i]):
                numbered_pages.add(p)
                if not m["roman"] and (n := _NUMBER_IN.search(lines[p][i])) and (v := _digits(n[0])) is not None:
                    base[v - p] += 1
    steady = next((b for b, n in base.most_common(1) if n >= 2), None)
    numbers = {p: _page_numbers(lines[p], None if steady is None else steady + p, steady is not None) if p in numbered_pages else set() for p, _ in pages}
    seen: Counter[str] = Counter()
    edge: dict[int, dict[int, tuple[str, str, bool]]] = {}
    for p, _ in pages:
        rest = [x if i not in numbers[p] else "" for i, x in enumerate(lines[p])] if numbers[p] else lines[p]
        edge[p] = {}
        for i in _edges(rest) if numbers[p] else edges[p]:
            line = rest[i]
            stripped = _NUMBER_TAIL.sub("", _NUMBER_HEAD.sub("", line, count=1), count=1).strip() if "  " in line.strip() or "\t" in line else line.strip()
            if stripped[:2].lower() == "ci" or not _runs_as_prose(stripped):
                edge[p][i] = (stripped, fold_misread(stripped), stripped != line.strip())
        seen.update({f for _, f, _ in edge[p].values()})
    out = []
    for k, (p, _) in enumerate(pages):
        first = p == 1 or is_start and k == 0
        page = Page(p, [], first, lines[p], edges[p], headings.get(p, set()), pageno=bool(numbers[p]))
        drop = set(numbers[p])
        for i, (line, folded, numbered) in edge[p].items():
            if first or folded in page.headings or folded in HEADINGS or _runs_as_prose(line) and not folded.startswith(CITED) or _NUMBER_LINE.fullmatch(line):
                continue
            parts = {fold_misread(x) for x in _GAP.split(line)}
            titled = bool(name) and len(folded) <= len(name) + 24 and _alike(folded[: len(name)], name)
            if titled or folded.startswith(CITED) or folded in running or len(parts) > 1 and not parts.isdisjoint(running) or seen[folded] > 1 and len(folded) > 3:
                drop.add(i)
                page.header = True
                page.pageno |= numbered
        page.body = [x for i, x in enumerate(lines[p]) if i not in drop] if drop else lines[p]
        out.append(page)
    return out


def _alike(a: str, b: str) -> bool:
    """Equal but for at most an eighth of the characters, place by place or by edits of one."""
    if a == b:
        return True
    if not a or abs(len(a) - len(b)) > 2:
        return False
    most = max(1, len(b) // 8)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:  # it never falls again
            return False
    return row[-1] <= most


def edge_lines(pages: list[Page]) -> set[str]:
    """The folded edge lines of pages other than a case's first that might be running ones."""
    out = set()
    for page in pages:
        if page.first:
            continue
        for i in page.edges:
            line = _NUMBER_TAIL.sub("", _NUMBER_HEAD.sub("", page.lines[i], count=1), count=1)
            if _NUMBER_LINE.fullmatch(line) or _runs_as_prose(line) or fold_misread(line) in page.headings:
                continue
            for part in {line, *_GAP.split(line)}:
                f = fold_misread(part)
                if len(f) > 3 and " " in f:
                    out.add(f)
    return out


def inner_lines(page: Page) -> list[str]:
    """The folded lines of a page that aren't at its edges and look like running ones: how often such a line stands elsewhere."""
    short = [x for i, x in enumerate(page.lines) if x and not _runs_as_prose(x) and i not in page.edges and not _NUMBER_LINE.fullmatch(x)]
    return [f for x in short if len(f := fold_misread(x)) > 3 and " " in f and f not in page.headings]


def is_number(token: str) -> bool:
    """Whether a token is a number, some of whose digits may be misread as letters."""
    return any(c.isdigit() for c in token) and not re.search(r"[^0-9OIlo.,]", token)


def read_run(run: str) -> tuple[tuple[str, bool], ...]:
    """The words and numbers of a string without blanks, each with whether it bears a sign that can't be in it. Numbers and
    words with ordinary suffixes are left out where all their signs can be."""
    out = []
    for m in _RUN.finditer(run):
        core = m[0].rstrip(".,'’!")
        if not core:
            continue
        if _NUMBER.fullmatch(core) and any(c.isdigit() for c in core):
            if len(core) > 1 and any(c in "OIlo" for c in core):
                out.append((core, True))
            continue
        if re.fullmatch(r"[A-Za-z](?:\.[A-Za-z0-9])+", core):
            if not any(c.isdigit() for c in core) or re.fullmatch(r"[a-z]\.[0-9]", core):
                out.append((core, False))
            continue
        for part in re.split(r"[.,'’]|!(?![a-zà-ɏ])|(?<![A-Za-zÀ-ɏ])!", core):
            if not part or part.isdigit() or _SUFFIXED.fullmatch(part):
                continue
            signs = any(c in "†!" or c.isdigit() for c in part)
            if signs and (sum(c.isalpha() for c in part) < 2 or re.search(r"\d{2}", part)):
                continue
            out.append((part, signs))
    return tuple(out)


class RunReader(dict):
    """`read_run` that remembers, for up to a bounded number of strings, with whether each word is common in `known`:
    tuples of (as written, in lower case, sure, common)."""

    MOST = 300_000

    def __init__(self, known: dict[str, int]) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, run: str) -> tuple[tuple[str, str, bool, bool], ...]:
        if len(self) >= self.MOST:
            self.clear()
        value = self[run] = tuple((t, t.lower(), sure, t.lower() in self.known) for t, sure in read_run(run))
        return value


@dataclass
class Break:
    """A word broken over the end of a line or page."""

    page: int
    left: str
    mark: str
    right: str
    line: int


def _next_line(pages: list[Page], k: int, i: int) -> str | None:
    """The first line that isn't blank from line `i` of the page at place `k` on."""
    while k < len(pages):
        body = pages[k].body
        for j in range(i, len(body)):
            if body[j].strip():
                return body[j]
        k, i = k + 1, 0
    return None


def breaks(pages: list[Page], ends_case: bool) -> list[Break]:
    """All places where a line ends with a hyphen or its like behind a letter. `right` is empty where nothing follows; the end
    of a unit's last page is left to the unit that repeats the page, unless the case ends there."""
    out = []
    for k, page in enumerate(pages):
        if not page.hyphens:
            continue
        for i, line in enumerate(page.body):
            m = _LEFT.search(line) if line.rstrip()[-1:] in HYPHENS and line.strip() else None
            if not m:
                continue
            follows = _next_line(pages, k, i + 1)
            if follows is not None:
                follow = _RIGHT.match(follows)
                right = follow[1] if follow else "\0"
            elif ends_case:
                right = ""
            else:
                continue
            if right == "\0" or right and not any(c.isalpha() for c in right):
                continue
            out.append(Break(page.page, m[1], m[2], right, i))
    return out


def is_noise(b: Break, count) -> bool:
    """Whether the mark of a break isn't part of the word. `count` gives the corpus's count of a word within lines.

    Marks that only a typesetter or scanner makes never are; a hyphen is where the word with it is the more frequent one, or
    where a name goes on with a capital."""
    if b.mark != "-":
        return True
    if not b.right:
        return not count(b.left.lower() + "-")
    if b.right[0].isupper() and not b.left.isupper():
        return False
    joined, compound = (b.left + b.right).lower(), f"{b.left}-{b.right}".lower()
    with_mark = count(compound) or max((count(w) for w in reversed_confusions(compound)), default=0)
    return not with_mark or count(joined) >= with_mark


def whole_pages(pages: list[Page], found: list[tuple[Break, bool]]) -> Iterator[tuple[int, str]]:
    """Number and text of each page, with broken words whole again on the line where they begin; with each break stands whether
    the mark is noise."""
    at = {(b.page, b.line): (b, noise) for b, noise in found}
    broken = {b.page for b, _ in found}
    skip = ""
    for page in pages:
        n = page.page
        if not skip and n not in broken:
            yield n, page.text
            continue
        lines = []
        for i, line in enumerate(page.body):
            if skip and line.strip():
                line = line.lstrip()
                line = line[len(skip) :] if line.startswith(skip) else line
                skip = ""
            b = at.get((n, i))
            if b:
                cut = line.rstrip()
                line = cut[: len(cut) - 1 - len(b[0].left)] + b[0].left + ("" if b[1] else "-") + b[0].right
                skip = b[0].right
            lines.append(line)
        yield n, "\n".join(lines)


def judged_breaks(pages: list[Page], ends_case: bool, known: Mapping[str, int]) -> list[tuple[Break, bool]]:
    """All breaks with whether the mark is noise. `known` has the common words."""
    return [(b, is_noise(b, lambda w: known.get(w, 0))) for b in breaks(pages, ends_case)]


def running_text(pages: list[Page], ends_case: bool, known: Mapping[str, int], read: RunReader | None = None) -> tuple[list[tuple[int, str, str, bool, bool]], list[tuple[Break, bool]]]:
    """The words of the text as (page, as written, in lower case, sure to be misread, common), with broken words whole again on
    the page where they begin; and all breaks with whether the mark is noise. `known` has the common words, which may be more
    than those that `read` knows."""
    words, places, found = page_words(pages, ends_case, known, read)
    return [(n, *w) for n, begin, end in places for w in words[begin:end]], found


def page_words(pages: list[Page], ends_case: bool, known: Mapping[str, int], read: RunReader | None = None) -> tuple[list[tuple[str, str, bool, bool]], list[tuple[int, int, int]], list[tuple[Break, bool]]]:
    """What running_text gives, as words without their page, (page, its first word, the first one behind it), and the breaks."""
    read = RunReader(known) if read is None else read
    found = judged_breaks(pages, ends_case, known)
    words: list[tuple[str, str, bool, bool]] = []
    places = []
    for n, text in whole_pages(pages, found):
        begin = len(words)
        words.extend(chain.from_iterable(map(read.__getitem__, text.split())))
        places.append((n, begin, len(words)))
    if isinstance(known, ChainMap):
        rare = known.maps[0]
        words = [w if w[3] or w[1] not in rare else (*w[:3], True) for w in words]
    return words, places, found


def line_runs(pages: list[Page]) -> list[str]:
    """Strings between blanks within lines; the broken ends of lines and what continues them aside."""
    runs: list[str] = []
    for page in pages:
        if not page.hyphens:
            runs += page.text.split()
            continue
        before = False
        for line in page.body:
            own = line.split()
            if not own:
                continue
            broken = own[-1][-1] in HYPHENS
            runs += own[before : len(own) - broken]
            before = broken
    return runs


def run_words(run: str) -> list[str]:
    """The lower-case words of a string without blanks, of any script with spaces: dotted abbreviations, words, and for words with
    hyphens also each pair and each part with its hyphen."""
    if _WIDE.search(run):
        return []
    out = [w.lower() for w in re.findall(r"(?<![^\W\d_])[A-Za-z](?:\.[A-Za-z])+|[^\W\d_]+", run)]
    if "-" in run:
        for m in _COMPOUND.finditer(run):
            parts = m[0].lower().split("-")
            out.append("-".join(parts))
            out += [f"{a}-{b}" for a, b in zip(parts, parts[1:], strict=False)] if len(parts) > 2 else []
            out += [f"{a}-" for a in parts[:-1]]
    return out


def reversed_confusions(word: str) -> list[str]:
    """What a word may be if one confusion made it."""
    out = set()
    for true, read in CONFUSIONS:
        i = word.find(read)
        while i >= 0:
            out.add(word[:i] + true + word[i + len(read) :])
            i = word.find(read, i + 1)
    return sorted(out)


#: Words up to this length are indexed by what is left without letters, longer ones by their thirds.
DELETED_UP_TO = 24
#: Of words up to this length all are made that one confusion may have made them of; of longer ones that is too much text.
REVERSED_UP_TO = 40


def _thirds(w: str, asked: bool) -> set[str]:
    n = len(w)
    off = (-1, 0, 1) if asked else (0,)
    return {f"{n + d}:{j}:" + w[max(0, (n + d) * j // 3 + by) : (n + d) * (j + 1) // 3 + by] for d in off for j in range(3) for by in off}


def nearest_names(odd: set[str], own: Mapping[str, int]) -> dict[str, str]:
    """For each of the words `odd` the most frequent of the `own` words that one confusion explains. A confusion leaves one third of a
    long word whole, by which it is found."""
    near: dict[str, set[str]] = {}
    asked: dict[str, list[str]] = {}
    for w in odd:
        if len(w) > REVERSED_UP_TO:
            for k in _thirds(w, True):
                asked.setdefault(k, []).append(w)
        elif len(w) >= 3:
            near[w] = {x for x in reversed_confusions(w) if x in own and x != w and len(x) >= 3}
    if asked:
        for x in own:
            if len(x) >= REVERSED_UP_TO:
                for k in _thirds(x, False):
                    for w in asked.get(k, ()):
                        if w != x and x not in near.setdefault(w, set()) and confusion_distance(w, x, CONFUSION_COST) is not None:
                            near[w].add(x)
    return {w: min(fit, key=lambda x: (-own[x], x)) for w, fit in near.items() if fit}


def confusion_distance(read: str, true: str, most: float = MOST_COST) -> float | None:
    """Weighted edit distance from the printed to the read word: confusions cost CONFUSION_COST, other edits 1; None above `most`."""
    if abs(len(true) - len(read)) > 2:
        return None
    # What both begin and end with costs nothing; two letters of it stay, as a confusion may take them in.
    short = min(len(true), len(read))
    same = next((i for i in range(short) if true[i] != read[i]), short)
    begin = max(0, same - 2)
    true, read = true[begin:], read[begin:]
    short = min(len(true), len(read))
    same = next((i for i in range(short) if true[-1 - i] != read[-1 - i]), short)
    end = max(0, same - 2)
    true, read = true[: len(true) - end], read[: len(read) - end]
    n, m = len(true), len(read)
    cost = [[9.0] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            c = cost[i][j]
            if c > most:
                continue
            if i < n and j < m and true[i] == read[j]:
                cost[i + 1][j + 1] = min(cost[i + 1][j + 1], c)
            for a, b in CONFUSIONS:
                if true.startswith(a, i) and read.startswith(b, j):
                    x, y = i + len(a), j + len(b)
                    cost[x][y] = min(cost[x][y], c + CONFUSION_COST)
            if i < n and j < m:
                cost[i + 1][j + 1] = min(cost[i + 1][j + 1], c + 1)
            if i < n:
                cost[i + 1][j] = min(cost[i + 1][j], c + 1)
            if j < m:
                cost[i][j + 1] = min(cost[i][j + 1], c + 1)
    return cost[n][m] if cost[n][m] <= most else None
