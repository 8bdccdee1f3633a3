"""Text normalization as column expressions. All of them give null for null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no search weight.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it its of on or that the this to was were "
    "which with what who whom how did does do not any all their there these those into under over than then "
    "case cases court decision decisions"
).split()
# Instruction-like phrases in untrusted text, and the fence around such text.
INJECTION = (
    r"(?i)(ignore (?:all |any )?(?:previous|prior|above) (?:instructions|prompts?)|disregard (?:the )?(?:system|previous)|"
    r"you are now|new instructions?:|system prompt|<\s*/?\s*(?:system|assistant|tool)\s*>|"
    r"call the \w+ tool|exfiltrat|send (?:it|this|the \w+) to http|BEGIN (?:SYSTEM|ADMIN))"
)
FENCE_OPEN, FENCE_CLOSE = "<<<UNTRUSTED_CASE_TEXT", "UNTRUSTED_CASE_TEXT>>>"
FENCED_FIELDS = ("quote", "snippet", "syllabus", "case_name", "caption", "cause", "nature_of_suit")


def squash(c: Column) -> Column:
    """Every run of blanks (Unicode's, as the reference's) becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def match_key(c: Column) -> Column:
    """The form in which quotations are compared: no part or page markers, blanks, hyphens, dashes, quotes or marks of
    unreadable characters. Case is kept."""
    unmarked = F.regexp_replace(c, r"<<<PART BEGINS:[^>]*>>>|=====\s*\[\[PAGE[^\]]*\]\]\s*=====", "")
    return F.regexp_replace(unmarked, "(?U)[\\s\\-\\x{AD}\\x{2010}-\\x{2015}\\x{2018}-\\x{201F}\\x{2032}\\x{2033}\\x{FFFD}'\"`]+", "")


def slug(c: Column, n: int = 60) -> Column:
    """Lower case, runs of anything but letters and digits as `_`, cut to n and stripped again; `x` if nothing is left."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, n), "^_+|_+$", "")
    return F.when(c.isNotNull(), F.when(s == "", "x").otherwise(s))


def tokens(c: Column) -> Column:
    """Search tokens: lower-case words with inner `-` or `'`, without stop words and single characters; in text order."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+(?:[-'][a-z0-9]+)*)"), 1)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def token_set(*cs: Column) -> Column:
    """The distinct lower-case words of the columns together."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *cs)), F.lit(r"([a-z0-9]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct items; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct items that are in b; 0 for an empty a."""
    n = F.size(F.array_distinct(a))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length of two half-open spans over the length of their hull; 0 if they don't meet."""
    shared = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(shared > 0, shared / (F.greatest(e1, e2) - F.least(s1, s2))).otherwise(F.lit(0.0))


def span_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length of two half-open spans over the length of the shorter."""
    shared, short = F.least(e1, e2) - F.greatest(s1, s2), F.least(e1 - s1, e2 - s2)
    return F.when((shared > 0) & (short > 0), shared / short).otherwise(F.lit(0.0))


def snippet(text: Column, query_tokens: list[str], width: int = 240) -> Column:
    """A window of the squashed text that starts a third of its width before the first query token, with ellipses where
    it was cut. Without a hit it starts at the beginning."""
    t = squash(text)
    hits = F.filter(F.array(*[F.locate(q, F.lower(t)) - 1 for q in query_tokens], F.lit(-1)), lambda h: h >= 0)
    start = F.greatest(F.coalesce(F.array_min(hits), F.lit(0)) - width // 3, F.lit(0))
    body = F.substring(t, start + 1, F.lit(width))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(F.length(t) > start + width, "…").otherwise(""))


def clamp_float(c: Column, default: float, low: float = 0.0, high: float = 1.0) -> Column:
    """A number read tolerantly from text and held between low and high; the default where it is none."""
    number = c.try_cast("double")
    return F.when(number.isNull(), default).otherwise(F.least(F.greatest(number, F.lit(low)), F.lit(high)))


def injection_flags(c: Column) -> Column:
    """The distinct instruction-like phrases in untrusted text, in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(INJECTION), 1), F.lower)))


def fenced(c: Column, source: str) -> Column:
    """Untrusted text between markers that name its source, with markers inside it made harmless."""
    return F.concat(F.lit(f"{FENCE_OPEN} source={source}\n"), F.replace(F.replace(c, F.lit("<<<"), F.lit("‹‹‹")), F.lit(">>>"), F.lit("›››")), F.lit(f"\n{FENCE_CLOSE}"))


def fence_fields(df: DataFrame, source: str, names: tuple[str, ...] = FENCED_FIELDS) -> DataFrame:
    """`df` with every string field of these names fenced, at any depth of structs and arrays; empty strings stay."""

    def rewrite(c: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StringType) and name in names:
            return F.when(c != "", fenced(c, source)).otherwise(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: rewrite(x, kind.elementType, ""))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[rewrite(c.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[rewrite(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first, also behind hyphens and apostrophes."""
    parts = F.regexp_extract_all(c, F.lit(r"([A-Za-zÀ-ɏ]+|[^A-Za-zÀ-ɏ]+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def surname(c: Column) -> Column:
    """The last word of an author that is no title, with capitals as in a title (also behind an apostrophe)."""
    words = F.filter(F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z'’\-]*)"), 1), lambda w: ~F.lower(w).isin(*TITLES))
    last = F.when(F.size(words) > 0, F.element_at(words, -1)).otherwise(F.trim(c))
    return F.when(c.isNotNull(), title_case(last))


# Titles of judges.
TITLES = "j jj c chief justice board member judge appellate immigration acting vice chairman chair deputy senior temporary".split()


def judge_id(court: Column, author: Column) -> Column:
    """judge:<court>:<surname>, both as slugs of up to 30 characters."""
    return F.concat_ws(":", F.lit("judge"), slug(F.coalesce(court, F.lit("unknown")), 30), slug(surname(author), 30))


def evidence_strength(quotes: Column) -> Column:
    """strong for two verified quotes or one of 15 words, moderate for one, else weak."""
    long = F.exists(quotes, lambda q: F.size(F.split(squash(q), " ")) >= 15)
    return F.when((F.size(quotes) >= 2) | long, "strong").when(F.size(quotes) >= 1, "moderate").otherwise("weak")


def json_object(c: Column) -> Column:
    """The JSON text in a reply: that of a fenced block, else the reply, if it parses; else from the first to the last brace if
    that parses; else null."""
    block = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(block != "", F.trim(block)).otherwise(F.trim(c))
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    parses = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(parses(body), body).when((inner != "") & parses(inner), inner)


def final_answer(c: Column) -> Column:
    """struct<answer, citations, parsed> of a reply: of the last JSON object in a fenced block that has a text `answer`, or without
    blocks of the object from the last `{"answer"` (or the first brace) to the last brace; else the reply itself, not parsed.
    Citations without a case are left out."""
    schema = "struct<answer: string, citations: array<struct<case: string, quote: string, page: int>>>"
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), 1)
    last = F.length(c) - F.call_function("locate", F.reverse(F.lit('{"answer"')), F.reverse(c)) - len('{"answer"') + 2
    start = F.when(F.contains(c, F.lit('{"answer"')), last).otherwise(F.locate("{", c))
    end = F.length(c) - F.locate("}", F.reverse(c)) + 1
    bare = F.when((start > 0) & F.contains(c, F.lit("}")), F.array(F.substring(c, start, end - start + 1))).otherwise(F.array().cast("array<string>"))
    texts = F.when(F.size(blocks) > 0, blocks).otherwise(bare)
    is_text = lambda t: F.schema_of_variant(F.try_variant_get(F.try_parse_json(t), "$.answer", "variant")) == "STRING"
    read = F.from_json(F.element_at(F.filter(texts, is_text), -1), schema)
    ok = F.size(F.filter(texts, is_text)) > 0
    none = F.array().cast("array<struct<case: string, quote: string, page: int>>")
    kept = F.filter(F.coalesce(read["citations"], none), lambda x: F.coalesce(x["case"], F.lit("")) != "")
    return F.when(c.isNotNull(), F.struct(F.trim(F.when(ok, read["answer"]).otherwise(c)).alias("answer"), F.when(ok, kept).otherwise(none).alias("citations"), ok.alias("parsed")))
