"""The citation graph: contributions from each source, their union into nodes and edges, tiers, and checks.

Nodes have id, label, title, display, domain, provenance, confidence, evidence; edges have type, source, target, scope,
bases, count, provenance, confidence, evidence. Evidence is an array of at most three of struct<page int, quote string>.
Contributions carry `ord`, a struct that orders them wherever the first or the last one wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions.citations import canon, cite_pattern
from docketry.operators.mentions import match_offsets

CITATION_EDGES = ("CITES", "FOLLOWS", "DISTINGUISHES", "OVERRULES", "CITES_LLM")
NODE_LABELS = ("Case", "Authority", "Statute", "Regulation", "Page", "Doctrine", "Judge")
EDGE_TYPES = (*CITATION_EDGES, "MENTIONS_STATUTE", "HAS_PAGE", "INVOKES_DOCTRINE", "AUTHORED_BY")
NAME_CONFIDENCE, REPORTER_CONFIDENCE, UNVERIFIED_CONFIDENCE = 0.9, 1.0, 0.5
MAX_EVIDENCE = 3
#: Characters around a match that its quote includes.
CONTEXT = 60
EDGE_KEY = ["type", "source", "target"]


def cases(*tables: DataFrame) -> DataFrame:
    """One row for each case of the tables of records, which may be delivered more than once, with its own canonical id
    (`nocite:<id>` without a citation)."""
    columns = ["id", "domain", "title", "citation", "decision_date", "decision_year", F.coalesce("court", "issuing_body").alias("court"), "docket_number", "term", "source_url", "page_count"]
    rows = None
    for t in tables:
        part = t.select(*columns, "loaded_at")
        rows = part if rows is None else rows.unionByName(part)
    names = [c for c in rows.columns if c not in ("id", "loaded_at")]
    one = rows.groupBy("id").agg(F.min_by(F.struct(*names), "loaded_at").alias("r")).select("id", "r.*")
    own = F.when(F.trim(F.coalesce("citation", F.lit(""))) == "", F.concat(F.lit("nocite:"), F.col("id"))).otherwise(canon(F.col("citation"))["id"])
    return one.withColumn("canon_id", own)


def case_pages(units: DataFrame) -> DataFrame:
    """case_id, page, text: each raw page of the units once; null pages are left out."""
    pages = units.select("case_id", F.explode("raw_pages").alias("page", "text")).filter(F.col("text").isNotNull())
    return pages.groupBy("case_id", "page").agg(F.max("text").alias("text"))


def _order(stage: int, *seq: Column | str) -> Column:
    return F.struct(F.lit(stage).alias("stage"), F.concat_ws("|", *seq).alias("seq")).alias("ord")


def edge_rows(df: DataFrame, kind: str, source: Column, target: Column, order: Column, *, scope: Column | None = None, basis: Column | None = None, confidence: Column | float = 1.0, count: Column | None = None, page: Column | None = None, quote: Column | None = None, verified: Column | None = None) -> DataFrame:
    """Contributions to edges. `verified` says whether there is evidence; without it, a non-null quote does."""
    none = F.lit(None)
    q = none.cast("string") if quote is None else quote
    return df.select(
        F.lit(kind).alias("type"), source.alias("source"), target.alias("target"), (none.cast("string") if scope is None else scope).alias("scope"),
        (none.cast("string") if basis is None else basis).alias("basis"), (none.cast("bigint") if count is None else count.cast("bigint")).alias("count"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"), (none.cast("int") if page is None else page.cast("int")).alias("page"), q.alias("quote"),
        (q.isNotNull() if verified is None else verified).alias("verified"), order,
    )


def upsert_edges(rows: DataFrame) -> DataFrame:
    """One edge for each type, source and target of the contributions.

    The last non-null scope wins; bases are distinct in order of first appearance; counts are the largest. With evidence
    an edge is deterministic and has the highest confidence of its verified contributions, else it is unverified at 0.5.
    Evidence is the first three of distinct (page, quote). Rows with a null end are no edges. A key with very many rows is
    combined before any shuffle; only the bases (a small vocabulary) and three pieces of evidence are ever collected.
    """
    rows = rows.filter(F.col("source").isNotNull() & F.col("target").isNotNull())
    main = rows.groupBy(*EDGE_KEY).agg(
        F.max_by("scope", F.when(F.col("scope").isNotNull(), F.col("ord"))).alias("scope"),
        F.max("count").alias("count"),
        F.max(F.when(F.col("verified"), F.col("confidence"))).alias("best"),
    )
    bases = rows.filter(F.col("basis").isNotNull()).groupBy(*EDGE_KEY, "basis").agg(F.min("ord").alias("ord"))
    bases = bases.groupBy(*EDGE_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "basis"))), lambda x: x["basis"]).alias("bases"))
    facts = rows.filter("verified").groupBy(*EDGE_KEY, "page", "quote").agg(F.min("ord").alias("ord"))
    facts = facts.withColumn("n", F.row_number().over(Window.partitionBy(*EDGE_KEY).orderBy("ord", "page", "quote"))).filter(F.col("n") <= MAX_EVIDENCE)
    facts = facts.groupBy(*EDGE_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "page", "quote"))), lambda x: F.struct(x["page"].alias("page"), x["quote"].alias("quote"))).alias("evidence"))
    none = F.array().cast("array<struct<page: int, quote: string>>")
    out = main.join(bases, EDGE_KEY, "left").join(facts, EDGE_KEY, "left")
    return out.select(
        *EDGE_KEY, "scope", F.coalesce("bases", F.array().cast("array<string>")).alias("bases"), "count", F.when(F.col("best").isNotNull(), "deterministic").otherwise("unverified").alias("provenance"),
        F.coalesce("best", F.lit(UNVERIFIED_CONFIDENCE)).alias("confidence"), F.coalesce("evidence", none).alias("evidence"),
    )


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """One node for each id: the first contribution's properties; an unverified node takes the first later evidence.

    rows: id, label, title, display, domain, page, quote, verified, ord.
    """
    first = F.min_by(F.struct("label", "title", "display", "domain"), "ord").alias("p")
    proof = F.min_by(F.struct("page", "quote"), F.when(F.col("verified"), F.col("ord"))).alias("e")
    one = rows.filter(F.col("id").isNotNull()).groupBy("id").agg(first, proof, F.max("verified").alias("sure"))
    return one.select(
        "id", "p.*", F.when(F.col("sure"), "deterministic").otherwise("unverified").alias("provenance"), F.when(F.col("sure"), 1.0).otherwise(UNVERIFIED_CONFIDENCE).alias("confidence"),
        F.when(F.col("sure"), F.array("e")).otherwise(F.array().cast("array<struct<page: int, quote: string>>")).alias("evidence"),
    )


def own_citations(known: DataFrame) -> DataFrame:
    """canon_id, target, target_domain: the case that bears each citation. Of several the last id does."""
    cited = known.filter(~F.col("canon_id").startswith("nocite:"))
    return cited.groupBy("canon_id").agg(F.max_by(F.struct("id", "domain"), "id").alias("r")).select("canon_id", F.col("r.id").alias("target"), F.col("r.domain").alias("target_domain"))


def quoted_match(text: Column, pattern: Column) -> Column:
    """The pattern's first match with 60 characters on either side. Where it is, the text before it says, which the pattern itself
    splits off: what the match says may stand earlier inside something longer."""
    at = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
    found = F.length(F.regexp_substr(text, pattern))
    start = F.greatest(at - CONTEXT, F.lit(0))
    return F.substring(text, start + 1, at - start + found + CONTEXT)


#: Patterns of one case that a page is searched for at a time.
BLOCK = 200


def find_evidence(rows: DataFrame, pages: DataFrame, raw: str = "raw") -> DataFrame:
    """`rows` (case_id and a citation as written) with page and quote of the citation's first match in the case's pages, in page
    order; null where there is none. Blanks may stand anywhere in it, digits on either side may not.

    Each page meets its case's distinct citations in blocks, so its text is sent along once for each block; a citation is searched
    for as a pattern only on pages that, without blanks, have it at all.
    """
    asked = rows.select(F.col("case_id").alias("of_case"), F.col(raw).alias("raw")).distinct().filter(F.col("raw").isNotNull())
    number = F.floor((F.row_number().over(Window.partitionBy("of_case").orderBy("raw")) - 1) / BLOCK)
    blocks = asked.withColumn("block", number).groupBy("of_case", "block").agg(F.collect_list("raw").alias("raws"))
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    there = pages.withColumn("bare", bare(F.col("text"))).join(blocks, pages["case_id"] == F.col("of_case")).withColumn("raws", F.filter("raws", lambda r: F.contains("bare", bare(r))))
    hits = there.filter(F.size("raws") > 0).select("case_id", "page", "text", F.explode("raws").alias(raw)).withColumn("pattern", cite_pattern(F.col(raw))).filter(F.rlike("text", F.col("pattern")))
    first = hits.groupBy("case_id", raw).agg(F.min_by(F.struct("page", quoted_match(F.col("text"), F.col("pattern")).alias("quote")), "page").alias("e")).select("case_id", raw, "e.page", "e.quote")
    return rows.join(first, ["case_id", raw], "left")


def detected_citations(records: DataFrame, known: DataFrame) -> DataFrame:
    """case_id, domain, raw, canon_id, display, pos of the case citations that records list, without those to the case itself."""
    rows = records.groupBy("id").agg(F.min_by(F.struct("domain", "citations"), "loaded_at").alias("r")).select(F.col("id").alias("case_id"), "r.domain", F.posexplode("r.citations").alias("pos", "raw"))
    rows = rows.filter(F.col("raw").isNotNull()).withColumn("c", canon(F.col("raw"))).filter(F.col("c.kind") == "case")
    self_id = known.select(F.col("id").alias("case_id"), F.col("canon_id").alias("self_id"))
    return rows.join(self_id, "case_id", "left").filter(~F.col("c.id").eqNullSafe(F.col("self_id"))).select("case_id", "domain", "raw", F.col("c.id").alias("canon_id"), F.col("c.display").alias("display"), "pos")


def resolved_citations(found: DataFrame, known: DataFrame) -> DataFrame:
    """Detected citations with target and scope: the case that bears the citation (internal within a domain, else
    cross_domain), or the authority `auth:<canon id>` (external)."""
    out = found.join(own_citations(known), "canon_id", "left")
    scope = F.when(F.col("target").isNull(), "external").when(F.col("target_domain") == F.col("domain"), "internal").otherwise("cross_domain")
    return out.withColumn("scope", scope).withColumn("target", F.coalesce("target", F.concat(F.lit("auth:"), F.col("canon_id")))).drop("target_domain")


def citation_edges(records: DataFrame, known: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contributions of detected citations: edges, and the authorities outside the corpus as nodes."""
    found = find_evidence(resolved_citations(detected_citations(records, known), known), pages)
    order = _order(1, "case_id", F.lpad(F.col("pos").cast("string"), 9, "0"))
    edges = edge_rows(found, "CITES", F.col("case_id"), F.col("target"), order, scope=F.col("scope"), basis=F.lit("detected_citation"), page=F.col("page"), quote=F.col("quote"))
    none = F.lit(None).cast("string")
    outside = found.filter(F.col("scope") == "external")
    nodes = outside.select(F.col("target").alias("id"), F.lit("Authority").alias("label"), none.alias("title"), "display", none.alias("domain"), "page", "quote", F.col("quote").isNotNull().alias("verified"), order)
    return edges, nodes


def statute_edges(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contributions of statute and regulation mentions (mention_id, case_id, canon_id, kind, display, page, quote): one edge for
    each case and statute with the number of mentions, the first three as evidence; and the statutes as nodes."""
    rows = mentions.filter(F.col("kind").isin("statute", "regulation") & F.col("canon_id").isNotNull() & F.col("case_id").isNotNull())
    rows = rows.groupBy("mention_id").agg(F.min(F.struct("case_id", "canon_id", "kind", "display", "page", "quote")).alias("m")).select("mention_id", "m.*")
    counts = rows.groupBy("case_id", "canon_id").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("case_id", "canon_id").orderBy("page", "mention_id")
    top = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= MAX_EVIDENCE).join(counts, ["case_id", "canon_id"])
    order = _order(2, "case_id", F.lpad(F.col("page").cast("string"), 9, "0"), "mention_id")
    edges = edge_rows(top, "MENTIONS_STATUTE", F.col("case_id"), F.col("canon_id"), order, count=F.col("n"), page=F.col("page"), quote=F.col("quote"), verified=F.lit(True))
    none = F.lit(None).cast("string")
    nodes = rows.select(F.col("canon_id").alias("id"), F.when(F.col("kind") == "regulation", "Regulation").otherwise("Statute").alias("label"), none.alias("title"), "display", none.alias("domain"), "page", "quote", F.lit(True).alias("verified"), order)
    return edges, nodes


def match_edges(matches: DataFrame) -> DataFrame:
    """Contributions of cross-domain matches (match_id, source, target, basis, page, quote): by name at 0.9, by reporter at 1.0."""
    rows = matches.groupBy("match_id").agg(F.min(F.struct("source", "target", "basis", "page", "quote")).alias("m")).select("match_id", "m.*")
    confidence = F.when(F.col("basis") == "name", NAME_CONFIDENCE).otherwise(REPORTER_CONFIDENCE)
    return edge_rows(rows, "CITES", F.col("source"), F.col("target"), _order(3, "source", "match_id"), scope=F.lit("cross_domain"), basis=F.col("basis"), confidence=confidence, page=F.col("page"), quote=F.col("quote"))


US_CITATION = r"(?<!\d)(\d+\s*U\.\s*S\.\s*\d+)(?!\d)"


def cross_domain_matches(known: DataFrame, pages: DataFrame, from_domain: str, to_domain: str) -> DataFrame:
    """Matches found in text: cases of `from_domain` whose pages name a case of `to_domain` or give its U.S. citation.

    match_id, source, target, basis, and page and quote of the first page that matches; both null for a match that only runs over
    the end of a page. Titles match with any blanks between words and in any case.

    Citations are taken from each page with their quotes and joined by canonical id. A title is looked for where its rarest word
    is: the words of pages, without texts, are joined to these keys, which so are no frequent words; the pages then meet the
    titles that may be on them as one array, so a text is sent along once. Blank pages and titles without a word match nothing.
    """
    ids = known.filter(F.col("domain") == from_domain).select(F.col("id").alias("case_id"))
    own = pages.filter(F.trim("text") != "").join(ids, "case_id", "left_semi")
    following = F.lead("text").over(Window.partitionBy("case_id").orderBy("page"))
    sources = own.select("case_id", "page", "text", F.concat_ws("\n", "text", following).alias("both"))
    targets = known.filter(F.col("domain") == to_domain)
    found = sources.filter(F.rlike("both", F.lit(US_CITATION))).select("case_id", "page", "both", F.length("text").alias("n"), F.explode(match_offsets(F.col("both"), US_CITATION)).alias("m"))
    inside = (F.col("m.start") + F.length("m.found")) <= F.col("n")
    low = F.greatest(F.col("m.start") - CONTEXT, F.lit(0))
    length = F.least(F.col("m.start") + F.length("m.found") + CONTEXT, F.col("n")) - low
    cites = found.filter(F.col("m.start") < F.col("n")).select("case_id", "page", F.when(inside, F.col("m.start")).alias("at"), F.when(inside, F.substring("both", low + 1, length)).alias("quote"), canon(F.col("m.found"))["id"].alias("canon_id"))
    by_reporter = cites.join(targets.filter(F.col("canon_id").startswith("us:")).select("canon_id", F.col("id").alias("target")), "canon_id").select(F.lit("reporter").alias("basis"), "case_id", "target", "page", "at", "quote")
    # Names: the words of pages and of titles, without texts.
    word = r"(?U)(\w+)"
    names = targets.select(F.col("id").alias("target"), F.trim(F.regexp_replace("title", r"(?U)\s+", " ")).alias("title")).filter(F.rlike("title", F.lit(word)))
    names = names.withColumn("pattern", F.concat(F.lit("(?i)"), F.regexp_replace(F.regexp_replace("title", r"([^\p{L}\p{N} ])", r"\\$1"), " ", r"\\s+")))
    title_words = names.select("target", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(word), 1))).alias("word"))
    page_words = sources.select("case_id", "page", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(word), 1))).alias("word"))
    page_words = page_words.join(title_words.select("word").distinct(), "word", "left_semi")
    counts = page_words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    keys = title_words.join(counts, "word", "left").groupBy("target").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("k")).filter(F.col("k.n") > 0).select("target", F.col("k.word").alias("word"))
    near = page_words.join(keys, "word").join(names.select("target", "pattern"), "target").groupBy("case_id", "page").agg(F.collect_set(F.struct("target", "pattern")).alias("names"))
    # A name may begin on the page before the one that has its key.
    before = Window.partitionBy("case_id").orderBy("page")
    reach = own.select("case_id", "page", F.lead("page").over(before).alias("next_page"))
    wide = near.unionByName(near.withColumnRenamed("page", "next_page").join(reach, ["case_id", "next_page"]).select("case_id", "page", "names"))
    wide = wide.groupBy("case_id", "page").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    tried = sources.join(wide, ["case_id", "page"]).select("case_id", "page", "text", "both", F.explode(F.filter("names", lambda t: F.rlike("both", t["pattern"]))).alias("t"))
    on_page = F.rlike("text", "t.pattern")
    quote = F.when(on_page, quoted_match(F.col("text"), F.col("t.pattern")))
    by_name = tried.select(F.lit("name").alias("basis"), "case_id", "t.target", "page", F.when(on_page, 0).alias("at"), quote.alias("quote"))
    hits = by_reporter.unionByName(by_name)
    first = hits.groupBy("case_id", "target", "basis").agg(F.min(F.when(F.col("quote").isNotNull(), F.struct("page", "at", "quote"))).alias("e"))
    return first.select(F.sha2(F.concat_ws("|", "case_id", "target", "basis"), 256).alias("match_id"), F.col("case_id").alias("source"), "target", "basis", "e.page", "e.quote")


def build_graph(records: DataFrame, lead_records: DataFrame, units: DataFrame, mentions: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the deterministic tier: cases and their pages, citations, statute mentions and cross-domain matches, in
    this order where order decides. Edges to ends that aren't nodes are left out."""
    known, pages = cases(records, lead_records), case_pages(units)
    none, yes = F.lit(None).cast("string"), F.lit(True)
    case_nodes = known.select("id", F.lit("Case").alias("label"), "title", F.col("citation").alias("display"), "domain", F.lit(None).cast("int").alias("page"), none.alias("quote"), yes.alias("verified"), _order(0, "id"))
    page_id = F.concat(F.col("case_id"), F.lit("#p"), F.col("page").cast("string"))
    page_nodes = pages.select(page_id.alias("id"), F.lit("Page").alias("label"), none.alias("title"), none.alias("display"), none.alias("domain"), "page", none.alias("quote"), yes.alias("verified"), _order(0, "case_id", "page"))
    page_edges = edge_rows(pages, "HAS_PAGE", F.col("case_id"), page_id, _order(0, "case_id", "page"), page=F.col("page"), verified=yes)
    cite_edges, authorities = citation_edges(records, known, pages)
    law_edges, laws = statute_edges(mentions)
    nodes = upsert_nodes(case_nodes.unionByName(page_nodes).unionByName(authorities).unionByName(laws))
    edges = upsert_edges(page_edges.unionByName(cite_edges).unionByName(law_edges).unionByName(match_edges(matches)))
    return nodes, without_dangling(nodes, edges)


def without_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    return edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns)


def with_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the labels of their ends."""
    out = edges
    for end in ("source", "target"):
        out = out.join(nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    return out.select(*edges.columns, "source_label", "target_label")


def merge_tiers(*tiers: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Tiers (nodes, edges) as one graph: of nodes with one id, and of edges with one key, the first tier's wins; edges to
    ends that no tier has are left out."""
    nodes, edges = None, None
    for i, (n, e) in enumerate(tiers):
        n, e = n.withColumn("tier", F.lit(i)), e.withColumn("tier", F.lit(i))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    keep = lambda df, *key: df.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("tier"))).filter("k = 1").drop("k", "tier")
    nodes = keep(nodes, "id")
    return nodes, without_dangling(nodes, keep(edges, *EDGE_KEY))


def check_edges(edges: DataFrame, expected: DataFrame) -> DataFrame:
    """status (missing, extra), source, target, basis: citation edges that are expected but absent, and the reverse. Edges stand for
    each of their bases; expected edges whose source is no source here aren't looked for."""
    actual = edges.filter(F.col("type") == "CITES").select("source", "target", F.explode("bases").alias("basis")).distinct()
    wanted = expected.select("source", "target", "basis").distinct().join(actual.select("source").distinct(), "source", "left_semi")
    key = ["source", "target", "basis"]
    missing = wanted.join(actual, key, "left_anti").select(F.lit("missing").alias("status"), *key)
    return missing.unionByName(actual.join(wanted, key, "left_anti").select(F.lit("extra").alias("status"), *key))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what (node label, edge type, edge provenance), name, n."""
    counted = edges.groupingSets([["type"], ["provenance"]], "type", "provenance").agg(F.count(F.lit(1)).alias("n"))
    by_edge = counted.select(F.when(F.col("type").isNotNull(), "edge type").otherwise("edge provenance").alias("what"), F.coalesce("type", "provenance").alias("name"), "n")
    return by_edge.unionByName(nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node label").alias("what"), F.col("label").alias("name"), "n"))


# What a stance towards an authority makes of the edge to it.
STANCE_EDGES = {"follows": "FOLLOWS", "distinguishes": "DISTINGUISHES", "overrules": "OVERRULES"}


def mapped_tier(nodes: DataFrame, edges: DataFrame, known: DataFrame, *, unverified: bool = False) -> DataFrame:
    """Edges of the second tier from extracted items: opinions with an author give AUTHORED_BY, rules INVOKES_DOCTRINE, and
    relies_on to a case authority FOLLOWS, DISTINGUISHES, OVERRULES or CITES_LLM by its stance.

    nodes: unit_id, case_id, id, type, label, author, part, provenance, confidence, cite_string, kind, doctrine, evidence
    array<struct<page, quote>>; edges: unit_id, case_id, source, target, relation, stance, provenance, confidence, evidence.
    Only items of provenance llm count, unless `unverified`. Evidence and bases merge as in upsert_edges; provenance is llm
    if any item's is, and confidence the highest.
    """
    from docketry.functions.text import judge_id, slug, squash

    sure = F.lit(True) if unverified else F.coalesce(F.col("provenance"), F.lit("llm")) == "llm"
    court = known.select(F.col("id").alias("case_id"), "court")
    opinions = nodes.filter(sure & (F.col("type") == "opinion") & (F.coalesce("author", F.lit("")) != "")).join(court, "case_id", "left")
    one = opinions.select(F.lit("AUTHORED_BY").alias("type"), F.col("case_id").alias("source"), judge_id(F.col("court"), F.col("author")).alias("target"), "unit_id", "provenance", "confidence", "evidence", F.col("part").alias("note"))
    rules = nodes.filter(sure & (F.col("type") == "rule"))
    two = rules.select(F.lit("INVOKES_DOCTRINE").alias("type"), F.col("case_id").alias("source"), F.concat(F.lit("doctrine:"), slug(F.lower(squash(F.coalesce("doctrine", "label"))))).alias("target"), "unit_id", "provenance", "confidence", "evidence", F.lit(None).cast("string").alias("note"))
    authority = nodes.filter((F.col("type") == "authority_ref") & (F.col("kind") == "case") & (F.coalesce("cite_string", F.lit("")) != "")).select("unit_id", F.col("id").alias("target"), canon(F.col("cite_string"))["id"].alias("canon_id"))
    uses = edges.filter(sure & (F.col("relation") == "relies_on")).join(authority, ["unit_id", "target"]).drop("target").join(own_citations(known).drop("target_domain"), "canon_id", "left")
    target = F.coalesce("target", F.concat(F.lit("auth:"), F.col("canon_id")))
    stance = F.coalesce("stance", F.lit("relies_on"))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STANCE_EDGES.items() for x in kv]), stance), F.lit("CITES_LLM"))
    three = uses.select(kind.alias("type"), F.col("case_id").alias("source"), target.alias("target"), "unit_id", "provenance", "confidence", "evidence", F.when(kind == "CITES_LLM", stance).alias("note")).filter(F.col("source") != F.col("target"))
    items = one.unionByName(two).unionByName(three)
    rows = items.select("*", F.explode_outer("evidence").alias("e"))
    rows = rows.select(*EDGE_KEY, F.lit(None).cast("string").alias("scope"), F.col("note").alias("basis"), F.lit(None).cast("bigint").alias("count"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "e.page", "e.quote", F.col("e.quote").isNotNull().alias("verified"), F.struct(F.lit(4).alias("stage"), F.concat_ws("|", "unit_id", "e.page", "e.quote").alias("seq")).alias("ord"))
    grade = items.groupBy(*EDGE_KEY).agg(F.when(F.max(F.coalesce("provenance", F.lit("llm")) == "llm"), "llm").otherwise("unverified").alias("provenance"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    return upsert_edges(rows).drop("provenance", "confidence").join(grade, EDGE_KEY).select(*EDGE_KEY, F.col("bases").alias("notes"), "provenance", "confidence", "evidence")
