"""Works read end to end: identity, services' manifests, candidates by rung, the first that proves to be the work, verdict and fallback.

Nothing is fetched: services' answers and candidates' bodies are tables, keyed by identifier and by URL. All
steps are joins and aggregations by those keys; a work's own manifests, locations and attempts are few.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.identifiers import arxiv_from_doi, identifier, resolver_url
from sheaf.functions.text import page_extent
from sheaf.functions.urls import hostname, public_url, registrable_domain, strip_contact
from sheaf.operators import manifests as M
from sheaf.operators import papers as P
from sheaf.operators import verdict as V
from sheaf.operators.attempts import redirect_chain
from sheaf.operators.dom import with_facts
from sheaf.plans.captures import as_results, data_of, provenance_of, sections_column, shaped
from sheaf.sources.workspace import workspace, written

#: In what order services are believed.
SERVICES = ("openalex", "crossref", "europe_pmc", "unpaywall")
SERVERS = ("biorxiv", "medrxiv")
SCALARS = ("doi", "title", "abstract", "pmid", "pmcid", "first_page", "last_page", "crossref_references", "openalex_references")
LOCATION = "struct<url:string,kind:string,provider:string>"
CANDIDATE = "struct<rung:int,provider:string,url:string,expected:string,bound:boolean,least:int,tier:int>"


def identified(works: DataFrame) -> DataFrame:
    """Works with their landing capture, if there is one, its facts, and ``kind`` and ``value`` of their identifier, null where none is found."""
    have = set(works.columns)
    add = {c: F.lit(None).cast(kind) for c, kind in (("html", "string"), ("http_status", "int"), ("final_url", "string")) if c not in have}
    rows = works.withColumns(add) if add else works
    rows = with_facts(
        rows.withColumn("final_url", F.coalesce("final_url", "url")), url="final_url",
        names=("doi", "abstract", "paper_title", "pdf_urls", "markdown", "sections", "error")
    )
    return rows.withColumn(
        "_id", identifier(F.col("url"), page_doi=F.col("facts.doi"))
    ).withColumns({"kind": F.col("_id.kind"), "value": F.col("_id.value")}).drop("_id")


def answers(services: DataFrame) -> DataFrame:
    """(key, seq, service, SCALARS, authors, locations): each service's answer in the same columns, parsed in one pass."""
    d, service = F.col("document"), F.col("service")
    on = lambda name, column: F.when(service == name, column)
    oa, cr, ep = M.openalex(d), M.crossref(d), M.europe_pmc(d, F.col("key"))
    words = F.flatten(
        F.transform(
            F.map_entries(oa["abstract_index"]), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word")))
        )
    )
    text = F.nullif(F.array_join(F.transform(F.sort_array(words), lambda w: w["word"]), " "), F.lit(""))
    place = lambda urls, kind: F.transform(
        F.coalesce(urls, F.array().cast("array<string>")),
        lambda u: F.struct(u.alias("url"), F.lit(kind).alias("kind"), F.lit("openalex").alias("provider"))
    )
    open_access = F.transform(
        M.unpaywall(d), lambda x: F.struct(x["url"].alias("url"), x["kind"].alias("kind"), F.lit("unpaywall").alias("provider"))
    )
    of = lambda name: F.coalesce(on("openalex", oa[name]), on("crossref", cr[name]), on("europe_pmc", ep[name]))
    seq = F.array_position(F.array(*map(F.lit, SERVICES)), service)
    return services.where(service.isin(*SERVICES)).select(
        "key",
        seq.cast("int").alias("seq"),
        "service",
        *(of(c).alias(c) for c in ("doi", "title", "first_page", "last_page")),
        F.coalesce(on("openalex", text), on("crossref", F.nullif(cr["abstract"], F.lit(""))), on("europe_pmc", ep["abstract"])).alias("abstract"),
        F.coalesce(on("openalex", oa["pmid"]), on("europe_pmc", ep["pmid"])).alias("pmid"),
        F.coalesce(on("openalex", oa["pmcid"]), on("europe_pmc", ep["pmcid"])).alias("pmcid"),
        on("crossref", cr["reference_count"]).alias("crossref_references"),
        on("openalex", oa["reference_count"]).alias("openalex_references"),
        F.coalesce(on("openalex", oa["authors"]), on("crossref", cr["authors"]), F.array().cast("array<string>")).alias("authors"),
        F.coalesce(
            on("openalex", F.concat(place(oa["pdf_urls"], "pdf"), place(oa["landing_urls"], "landing"))), on("unpaywall", open_access),
            F.array().cast(f"array<{LOCATION}>")
        ).alias("locations"),
        F.when(F.try_parse_json(d).isNull(), service).alias("failure"),
    )


def manifests(works: DataFrame, services: DataFrame) -> DataFrame:
    """(kind, value, SCALARS, authors, locations, failures): what the services say of each identifier.

    Services are first asked by the identifier, then by the DOI that they name for it; earlier answers stand.
    """
    told = answers(services)
    ids = works.where("value is not null").select("kind", "value").distinct()
    named = ids.join(
        told.select("key", "seq", "doi"), F.col("value") == F.col("key")
    ).where("doi is not null and doi <> value").groupBy("kind", "value").agg(F.min_by("doi", "seq").alias("key")).withColumn("turn", F.lit(1))
    asked = ids.withColumns({"key": F.col("value"), "turn": F.lit(0)}).unionByName(named)
    rows = asked.join(told, "key").withColumns(
        {"order": F.col("turn") * 100 + F.col("seq"), "failures": F.array_compact(F.array("failure")), "work": F.struct("kind", "value")}
    )
    found = M.merged(rows, "work", "order", list(SCALARS), ["authors", "locations", "failures"])
    return found.select("work.*", *SCALARS, "authors", "locations", "failures")


def preprints(works: DataFrame, services: DataFrame) -> DataFrame:
    """(kind, value, jats): JATS URLs by preprint servers, the server that the URL names first; published works by the preprint they are mapped to."""
    rows = services.where(F.col("service").isin(*SERVERS)).select(
        "key", F.col("service").alias("server"), M.biorxiv(F.col("document")).alias("jats")
    ).where("jats is not null")
    mapped = services.where(F.col("service").isin(*(f"{s}_pubs" for s in SERVERS))).select(
        F.col("key").alias("doi"), F.regexp_replace("service", "_pubs$", "").alias("server"), M.preprint_doi(F.col("document")).alias("key")
    ).where("key is not null")
    dois = works.where("doi is not null").select("kind", "value", "doi", F.coalesce(F.col("url").contains("medrxiv.org"), F.lit(False)).alias("_med"))
    own = dois.where(F.startswith("doi", F.lit("10.1101/"))).join(rows, F.col("doi") == F.col("key"))
    other = dois.where(~F.startswith("doi", F.lit("10.1101/"))).join(mapped, "doi").join(rows, ["key", "server"])
    columns = ("kind", "value", "_med", "server", "jats")
    listed = own.select(*columns).unionByName(other.select(*columns)).withColumn("late", (F.col("server") == "medrxiv") != F.col("_med"))
    return listed.groupBy("kind", "value").agg(
        F.transform(
            F.array_distinct(F.sort_array(F.collect_list(F.struct("late", "server", "jats")))),
            lambda x: F.struct(x["server"].alias("server"), x["jats"].alias("url"))
        ).alias("jats")
    )


def rungs(w: dict[str, Column]) -> Column:
    """array<CANDIDATE> of a work in the order of trying: archive, preprint server, arXiv, open PDFs, the landing page's PDF, the publisher's page.

    ``w``: pmcid, arxiv_id, jats, locations, pdf_urls, publisher, unlocked (a page that a stored sign-in opens).
    """

    def one(rung: int, provider: Column | str, url: Column, expected: str, bound: bool, least: int | None = None, tier: int | None = None) -> Column:
        return F.struct(
            F.lit(rung).alias("rung"), (F.lit(provider) if isinstance(provider, str) else provider).alias("provider"), url.alias("url"),
            F.lit(expected).alias("expected"), F.lit(bound).alias("bound"), F.lit(least).cast("int").alias("least"),
            F.lit(tier).cast("int").alias("tier")
        )

    none = F.array().cast(f"array<{CANDIDATE}>")
    given = lambda key, *items: F.when(key.isNotNull(), F.array(*items)).otherwise(none)
    pmc, arxiv = w["pmcid"], w["arxiv_id"]
    archive = F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmc)
    located = lambda provider, kind, rung: F.transform(
        F.filter(w["locations"], lambda x: (x["provider"] == provider) & (x["kind"] == kind)),
        lambda x: one(rung, x["provider"], x["url"], "pdf", True)
    )
    parts = (
        given(
            pmc,
            one(1, "europe-pmc-jats", F.concat(F.lit("https://www.ebi.ac.uk/europepmc/webservices/rest/"), pmc, F.lit("/fullTextXML")), "jats", True),
            one(1, "pmc-direct-pdf", F.concat(archive, F.lit("/pdf/")), "pdf", True),
            one(1, "pmc-direct-html", F.concat(archive, F.lit("/")), "html", True, P.LEAST_ARCHIVE_CHARS),
        ),
        F.transform(w["jats"], lambda x: one(2, F.concat(x["server"], F.lit("-jats")), x["url"], "jats", True)),
        given(
            arxiv, one(3, "arxiv-html", F.concat(F.lit("https://arxiv.org/html/"), arxiv), "html", True),
            one(3, "ar5iv-html", F.concat(F.lit("https://ar5iv.labs.arxiv.org/html/"), arxiv), "html", True)
        ),
        located("openalex", "pdf", 4),
        located("unpaywall", "pdf", 5),
        F.transform(w["pdf_urls"], lambda u: one(6, "landing-citation-pdf", u, "pdf", False)),
        given(w["publisher"], one(8, "anonymous-publisher-render", w["publisher"], "html", False)),
        given(w["unlocked"], one(8, "signed-in-publisher-render", w["unlocked"], "html", True, None, 4)),
    )
    return F.concat(*(F.coalesce(p, none) for p in parts))


def repository_candidates(works: DataFrame, bodies: DataFrame) -> DataFrame:
    """(kind, value, candidate): rung 7, the PDFs that captured landing pages of repositories name, one hop on."""
    places = works.select(
        "kind", "value", F.regexp_replace(F.coalesce(hostname(F.col("final_url")), F.lit("")), r"^www\\.", "").alias("_own"),
        F.explode(F.filter("locations", lambda x: x["kind"] == "landing")).alias("place")
    )
    host = F.regexp_replace(F.coalesce(hostname(F.col("place.url")), F.lit("")), r"^www\\.", "")
    places = places.where(
        (host != "") & (host != F.col("_own")) & ~host.isin("doi.org", "pubmed.ncbi.nlm.nih.gov")
    ).select("kind", "value", F.col("place.url").alias("url"), "place.provider").dropDuplicates(["kind", "value", "url"])
    pages = with_facts(places.join(bodies.select("url", F.col("payload").cast("string").alias("html")), "url"), names=("pdf_urls",))
    pdf = F.explode("facts.pdf_urls").alias("pdf")
    found = pages.select("kind", "value", F.concat("provider", F.lit("-one-hop-pdf")).alias("provider"), pdf)
    return found.select(
        "kind", "value",
        F.struct(
            F.lit(7).alias("rung"), "provider", F.col("pdf").alias("url"), F.lit("pdf").alias("expected"), F.lit(False).alias("bound"),
            F.lit(None).cast("int").alias("least"), F.lit(None).cast("int").alias("tier")
        ).alias("candidate")
    )


def front_text(kind: Column, payload: Column, text: Column) -> Column:
    """What a candidate shows first: markup taken out of documents, the text layer of PDFs."""
    plain = F.regexp_replace(
        F.regexp_replace(F.substring(payload.cast("string"), 1, 250_000), r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " "
    )
    return F.trim(F.regexp_replace(F.when(kind == "pdf", text).otherwise(plain), r"\s+", " "))


def with_paper_facts(rows: DataFrame, w: dict[str, Column], paper: Column, kind: Column) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with what the verdict needs of a work and one representation of it, each worked out once, and the columns by name."""
    rows = rows.withColumn("_profile", V.body_profile(V.paper_sections(paper["markdown"])))
    facts = {
        "has_paper": paper["markdown"].isNotNull(),
        "is_pdf": kind == "pdf",
        "sections": F.coalesce(F.size("_profile.sections"), F.lit(0)),
        "body_words": F.coalesce("_profile.words", F.lit(0).cast("bigint")),
        "all_words": F.coalesce(paper["word_count"], F.lit(0)).cast("bigint"),
        "abstract_words": F.nullif(F.regexp_count(F.coalesce(w["abstract"], F.lit("")), F.lit(r"\S+")), F.lit(0)),
        "pages": page_extent(w["first_page"], w["last_page"]),
        "references": F.coalesce(paper["reference_count"], F.lit(0)),
        "resolved": paper["references_resolved"],
        "crossref": w["crossref_references"],
        "openalex": w["openalex_references"],
    }
    return rows.withColumns({f"_f_{k}": c for k, c in facts.items()}), {k: F.col(f"_f_{k}") for k in facts}


MANIFEST = (*SCALARS, "authors")
PAPER = "struct<markdown:string,section_titles:array<string>,reference_count:int,references_resolved:boolean,word_count:int,error:string>"


def tried(candidates: DataFrame, bodies: DataFrame, hops: DataFrame | None = None) -> DataFrame:
    """Each candidate of (kind, value, MANIFEST, pos, candidate) against its captured body: ``accepted``, ``detail``, ``paper``, ``final_url``.

    ``bodies``: url, payload, and http_status, tier and text (a PDF's text layer) where they are known. A
    candidate that was not captured is an attempt that failed. ``hops``: (from_url, to_url), followed three times.
    """
    have = set(bodies.columns)
    rows = candidates.select("*", "candidate.*")
    if hops is None:
        rows = rows.withColumn("_at", F.col("url"))
    else:
        ends = redirect_chain(rows.select("url").distinct(), hops).select("url", F.col("final").alias("_at"))
        rows = rows.join(ends, "url", "left")
    optional = {"http_status": "int", "tier": "int", "text": "string"}
    held = bodies.select(
        F.col("url").alias("_at"), F.col("payload").cast("binary").alias("payload"),
        *((F.col(c) if c in have else F.lit(None).cast(k)).alias(f"_{c}") for c, k in optional.items())
    )
    held = held.withColumn("_signed", F.coalesce(F.col("_tier") == 4, F.lit(False))).groupBy("_at", "_signed").agg(
        F.max_by(F.struct("payload", "_http_status", "_text"), F.length("payload")).alias("b")
    )
    rows = rows.withColumn("_signed", F.coalesce(F.col("tier") == 4, F.lit(False))).join(held, ["_at", "_signed"], "left").select(
        *rows.columns, "b.payload", F.col("b._http_status").alias("http_status"), F.col("b._text").alias("text")
    )
    lost = rows.where("payload is null").withColumns({"paper": F.lit(None).cast(PAPER)})
    body = F.when(F.col("expected") == "pdf", F.col("text").cast("binary")).otherwise(F.col("payload"))
    read = P.papers(
        rows.where("payload is not null").withColumns(
            {"_kind": F.col("kind"), "_whole": F.col("payload"), "kind": F.col("expected"), "payload": body}
        )
    )
    read = read.withColumns({"kind": F.col("_kind"), "payload": F.col("_whole")}).drop("_kind", "_whole")
    rows = read.unionByName(lost.select(*read.columns))
    w = {c: F.col(c) for c in MANIFEST}
    shape = P.candidate(F.col("expected"), F.col("payload"), F.col("paper.markdown"), F.col("paper.error"), F.col("least"))
    refused = F.coalesce(~F.col("http_status").between(200, 299), F.lit(False))
    named = M.identity(front_text(F.col("expected"), F.col("payload"), F.col("text")), w["title"], w["authors"], F.col("bound"))
    rows, facts = with_paper_facts(rows, w, F.col("paper"), F.col("expected"))
    rows = rows.withColumn("_level", V.scholarly_verdict(facts, V.scholarly_signals(facts))["content_level"])
    level = F.col("_level")
    detail = (
        F.when(F.col("payload").isNull(), "it was not captured")
        .when(refused, F.concat(F.lit("its status is "), F.col("http_status").cast("string")))
        .when(~shape["accepted"], shape["reason"])
        .when(~named["accepted"], "its front matter is not that of the work")
        .when(F.col("paper.markdown").isNull(), F.coalesce("paper.error", F.lit("no text could be read")))
        .when(~level.isin("full_text", "full_text_with_references"), "it does not show the body of a paper")
    )
    return rows.withColumn("detail", detail).withColumn("accepted", F.col("detail").isNull()).withColumn("final_url", F.col("_at"))


def read_works(
    works: DataFrame, services: DataFrame, bodies: DataFrame, hops: DataFrame | None = None, budget: int | None = None, sign_ins: Collection[str] = ()
) -> DataFrame:
    """One result for each work in the columns of ``read_captures``, with ``content_level``.

    ``works``: url (a URL or an identifier), and html, http_status and final_url of its landing page where it was
    captured; ``services``: (key, service, document); ``bodies`` and ``hops``: see ``tried``; ``sign_ins``:
    domains with a stored sign-in. Of the candidates in the order of their rungs the first that is a paper, of
    this work, with a body, is its text. Without one the landing page's text or what is known stands in, and the
    record says what would unlock the work. A work without an identifier keeps its page's text. Works, once with
    their identity and once with their manifests, are written to the shared folder, as several joins read them.
    """
    have, at = set(works.columns), workspace(works.sparkSession, "works")
    rows = identified(works).withColumn("_row", F.sha2(F.concat_ws("\n", F.col("url"), F.coalesce("html", F.lit(""))), 256))
    rows = written(rows, f"{at}/identified")
    told = rows.join(manifests(rows, services), ["kind", "value"], "left")
    seed = lambda kind: F.when(F.col("kind") == kind, F.col("value"))
    told = told.withColumns(
        {
            "doi": F.coalesce(seed("doi"), "doi"),
            "pmid": F.coalesce(seed("pmid"), "pmid"),
            "pmcid": F.coalesce(seed("pmcid"), "pmcid"),
            "title": F.coalesce("title", "facts.paper_title"),
            "abstract": F.coalesce("abstract", "facts.abstract"),
            "authors": F.coalesce("authors", F.array().cast("array<string>")),
            "locations": F.coalesce("locations", F.array().cast(f"array<{LOCATION}>")),
        }
    )
    told = told.withColumn("arxiv_id", F.coalesce(seed("arxiv"), arxiv_from_doi(F.col("doi"))))
    told = told.join(preprints(told, services), ["kind", "value"], "left")
    landing = F.when(F.col("html").isNotNull(), F.col("final_url"))
    told = told.withColumn("publisher", P.publisher_page(landing, F.col("doi"), F.col("locations"), F.col("url"))).withColumn(
        "_locked", P.publisher_page(landing, F.col("doi"), F.col("locations"), F.col("url"), resolve_doi=False)
    )
    told = told.withColumn(
        "unlocked", F.when(registrable_domain(F.col("_locked")).isin(*sign_ins), F.col("_locked")) if sign_ins else F.lit(None).cast("string")
    )
    told = written(told, f"{at}/told")
    w = {
        c: F.col(c) for c in ("pmcid", "arxiv_id", "jats", "locations", "publisher", "unlocked")
    } | {"pdf_urls": F.when(F.col("html").isNotNull(), F.col("facts.pdf_urls"))}
    known = told.where("value is not null")
    listed = known.select("_row", *(c for c in ("kind", "value")), *MANIFEST, F.posexplode(rungs(w)).alias("pos", "candidate"))
    hop = repository_candidates(known, bodies).join(
        known.select("_row", "kind", "value", *MANIFEST), ["kind", "value"]
    ).withColumn("pos", F.lit(0)).select(*listed.columns)
    tries = tried(listed.unionByName(hop), bodies, hops)
    attempt = F.struct(
        "rung", "pos", "provider", public_url(strip_contact(F.col("candidate.url"))).alias("url"), F.col("accepted").alias("succeeded"), "detail"
    )
    # a work's tries are few; the first accepted one by rung is its text, and what was tried after it is not told
    paper = F.struct("rung", "pos", "provider", F.col("expected").alias("kind"), "tier", "final_url", "http_status", "paper")
    won = tries.groupBy("_row").agg(
        F.min_by(paper, F.when(F.col("accepted"), F.struct("rung", "pos"))).alias("won"), F.sort_array(F.collect_list(attempt)).alias("attempts")
    )
    rows = told.join(won, "_row", "left")
    rows = rows.withColumn(
        "attempts",
        F.filter("attempts", lambda a: F.col("won").isNull() | (F.struct(a["rung"], a["pos"]) <= F.struct(F.col("won.rung"), F.col("won.pos"))))
    )
    rows, facts = with_paper_facts(rows, {c: F.col(c) for c in MANIFEST}, F.col("won.paper"), F.col("won.kind"))
    rows = rows.withColumns({f"_s_{k}": s for k, s in V.scholarly_signals(facts).items()})
    signals = {k: F.col(f"_s_{k}") for k in V.scholarly_signals(facts)}
    rows = rows.withColumn("_v", V.scholarly_verdict(facts, signals))
    lost = F.col("value").isNull()
    page = F.nullif(F.trim("facts.markdown"), F.lit(""))
    ids = {"DOI": F.col("doi"), "PMID": F.col("pmid"), "PMCID": F.col("pmcid"), "arXiv": F.col("arxiv_id")}
    unlock = F.when(lost, "give the work's DOI, arXiv ID, PMID or PMCID").when(F.col("_locked").isNull(), "find the publisher's page and store a sign-in for it").when(
        F.col("unlocked").isNull(), F.concat(F.lit("store a sign-in for "), registrable_domain(F.col("_locked")))
    ).otherwise("find an open copy or renew the stored sign-in")
    rows = rows.withColumns(
        {
            "status": F.when(lost, "incomplete").otherwise(F.col("_v.status")),
            "content_level": F.when(lost, "metadata_only").otherwise(F.col("_v.content_level")),
            "unlock": unlock,
            "shown": F.coalesce("won.paper.markdown", page, P.partial_markdown(F.col("title"), F.col("abstract"), ids)),
        }
    )
    rows, shape = shaped(rows.withColumn("sections", sections_column(F.col("shown"))), budget)
    ask = F.struct(
        F.lit(1).alias("remaining_items"),
        F.when(lost, F.lit(1000)).otherwise(
            P.full_text_cost(F.col("first_page"), F.col("last_page"), F.col("abstract"))
        ).cast("bigint").alias("estimated_extra_tokens")
    )
    reason = (
        F.when(lost, F.concat(F.lit("No identifier of a work was found. To unlock it: "), unlock))
        .when(F.col("status") == "complete", "The paper's body and its references agree with independent manifests")
        .when(F.col("status") == "unknown", "A body was found, but the manifests say too little about it")
        .otherwise(F.concat(F.lit("The work's whole text is not proved. To unlock it: "), unlock))
    )
    record = F.struct(
        "content_level", F.struct("kind", "value").alias("identifier"), *SCALARS, "authors",
        F.transform("locations", lambda x: x.withField("url", strip_contact(x["url"]))).alias("locations"),
        F.col("failures").alias("metadata_failures"), F.struct("won.rung", "won.provider", "won.kind").alias("acquired"),
        F.col("won.paper.section_titles").alias("section_titles"), F.col("won.paper.reference_count").alias("found_references"),
        F.transform("attempts", lambda a: a.dropFields("pos")).alias("attempts"), "unlock"
    )
    canonical = F.coalesce(resolver_url(F.col("kind"), F.col("value")), F.col("url"))
    own = provenance_of(
        {*have, "http_status", "final_url"},
        F.when(F.col("won").isNotNull(), F.coalesce("won.tier", F.when(F.col("won.kind") == "pdf", 2).otherwise(0))), canonical
    )
    provenance = F.when(
        F.col("won").isNotNull(),
        own.withField("engine", F.col("won.provider")).withField(
            "final_url", public_url(F.col("won.final_url"))
        ).withField("http_status", F.col("won.http_status"))
    ).otherwise(own)
    ended = works.drop("html", "http_status", "final_url", "fetched_at")
    found = as_results(
        rows.withColumn("_level", F.col("content_level")),
        ended.withColumn("content_level", F.lit("")),
        **(shape | {"cost_to_complete": F.coalesce(shape["cost_to_complete"], F.when(F.col("status") == "incomplete", ask))}),
        status=F.col("status"),
        reason=reason,
        evidence=F.when(
            lost, V.evidence(scholarly_identifier=F.lit(False), landing_capture=F.col("html").isNotNull())
        ).otherwise(V.evidence(**signals)),
        provenance=provenance,
        structured_data=data_of(record),
    )
    return found
