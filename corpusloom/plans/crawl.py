"""The whole path of fetched pages, in rounds: frontier, acceptance, extraction, language filter, dedup, storage, discovery."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, urls
from ..functions import text as tx
from ..functions.session import cut
from ..operators import dedup, frontier, graph, metrics
from ..sources import web


@dataclass
class Settings:
    max_pages: int | None = 100
    same_domain_only: bool = True
    follow_links: bool = True
    keep_noise_links: bool = False
    target_languages: tuple[str, ...] | None = None
    default_budget: int = frontier.DEFAULT_BUDGET
    domain_overrides: dict[str, int] = field(default_factory=dict)
    domain_tiers: dict[str, int] = field(default_factory=dict)
    #: Cosine from which on two pages' vectors match; None leaves the semantic layer out.
    semantic_threshold: float | None = None


def extracted(fetched: DataFrame, settings: Settings) -> DataFrame:
    """fetched(page_id, url, html) with content, key and body: what deduplication reads."""
    got = extract.extract(fetched.select("page_id", "url", "html"), keep_noise_links=settings.keep_noise_links)
    return got.withColumn("key", web.page_key(F.col("content.canonical"), F.col("url"))).withColumn("body", extract.filled(F.col("content.article"), F.col("content.text"))).drop("html")


def judged(page: DataFrame, settings: Settings, vectors: DataFrame | None = None) -> DataFrame:
    """Extracted pages with status: stored, exact, near, semantic or lang_filtered. Order is by page_id."""
    wanted = extract.in_scope(F.col("content.language"), settings.target_languages)
    pairs = None
    if settings.semantic_threshold is not None:
        if vectors is None:
            vectors = page.where(wanted).select("page_id", tx.hashed_vector(F.col("body")).alias("embedding"))
        pairs = dedup.semantic_pairs(vectors, settings.semantic_threshold, "page_id")
    verdict = dedup.cascade(page.where(wanted).select("page_id", "body"), "page_id", "body", pairs)
    out = page.join(verdict.withColumnRenamed("doc_id", "page_id"), "page_id", "left")
    return out.withColumn("status", F.when(F.col("is_dup").isNull(), "lang_filtered").when(F.col("is_dup"), F.col("reason")).otherwise("stored")).drop("is_dup", "reason")


def process(fetched: DataFrame, settings: Settings | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """fetched(page_id, url, html) with key, content, language scope and dedup verdict (status).

    The language filter stands before dedup: what it drops never counts as an earlier text. With a semantic threshold the third layer takes
    vectors(page_id, embedding), or hashed token counts where none are given.
    """
    s = settings or Settings()
    return judged(cut(extracted(fetched, s)), s, vectors)


def stored(processed: DataFrame) -> DataFrame:
    """Rows of the page table for stored pages."""
    c = F.col("content")
    return processed.where("status = 'stored'").select(
        F.col("page_id").alias("seq"), F.col("key").alias("url"), F.col("url").alias("final_url"), c["title"].alias("title"), c["text"].alias("body"), c["article"].alias("article"), c["author"].alias("author"),
        c["date"].alias("pub_date"), c["language"].alias("language"), tx.content_hash(F.col("body")).alias("content_hash"), tx.simhash(F.col("body")).alias("simhash"), c["entities"].alias("entities"),
        c["schema_org"].alias("schema_org"), c["json_ld"].alias("json_ld"), c["meta"].alias("meta"), c["links"].alias("links"),
    )


def crawl(spark: SparkSession, seeds: list[str] | DataFrame, web_pages: DataFrame, settings: Settings | None = None) -> dict[str, DataFrame]:
    """A crawl of a table of pages (page_id, url, html) from seeds (urls, or a table with column url): rounds until no new url is found, or
    the limit of stored pages is reached. Returns pages, links, seen and done.

    Each round is a set: admitted urls are joined with the web, only the new pages are extracted, and the links of those of them that are stored are the
    next candidates. Verdicts are given over all pages so far, in order of their ids, so they are those of one pass.
    """
    s = settings or Settings()
    how = {"default": s.default_budget, "overrides": s.domain_overrides, "tiers": s.domain_tiers}
    start = web.seeds(spark, seeds) if isinstance(seeds, list) else seeds.select("url")
    candidates, seen, pages, waiting, n = start, None, None, None, 0
    # Of pages with one normal form that of the smallest id.
    site = cut(web_pages.select(urls.normalise(F.col("url")).alias("url"), "page_id", "html").where("url <> ''").groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("p")).select("url", "p.*"))
    done = processed = offered = None
    while True:
        used = done.groupBy("domain").agg(F.count("*").alias("used")) if done is not None else None
        new = frontier.admit(frontier.scope(candidates, start) if s.same_domain_only else candidates, seen, used, seq="seq" if "seq" in candidates.columns else None, **how)
        new = cut(frontier.within_budget(new, used, **how))
        if not new.limit(1).count() and (waiting is None or not waiting.limit(1).count()):
            break
        seen = cut(new.select("url") if seen is None else seen.union(new.select("url")))
        got = new.join(site, "url").select("page_id", "url", "html", "priority")
        got = got if waiting is None else got.unionByName(waiting)
        found = got.count()
        if s.max_pages is not None and n + found > s.max_pages:
            # The limit counts stored pages: those beyond it wait, in case some of the round's are dropped.
            every = cut(got)
            got = cut(every.orderBy(F.desc("priority"), "url").limit(max(0, s.max_pages - n)))
            waiting = cut(every.join(got.select("url"), "url", "left_anti"))
        else:
            waiting = None
        if found or pages is None:
            fresh = cut(extracted(got, s))
            pages = fresh if pages is None else cut(pages.unionByName(fresh))
            processed = cut(judged(pages, s))
            done = processed.where("status = 'stored'").select("url", urls.domain(F.col("url")).alias("domain"))
            n = done.count()
        if not found or (not s.follow_links and waiting is None) or (s.max_pages is not None and n >= s.max_pages):
            break
        # Links of pages that were offered before are seen already.
        links = processed if offered is None else processed.join(offered, "page_id", "left_anti")
        candidates = frontier.discover(stored(links)) if s.follow_links else start.limit(0)
        offered = processed.where("status = 'stored'").select("page_id")
    if processed is None:
        return {}
    rows = stored(processed)
    return {"pages": rows, "links": graph.edges(rows), "seen": seen, "done": done, "processed": processed, "kinds": metrics.totals(processed, "status")}
