"""Named queries over the driver's tables, and their DuckDB SQL.

Stand-ins for a crawl's own tables: pages are the fetched pages; events are a fetch log with user_id as the domain, type error as a
failure and value in milliseconds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities, extract, language, stem, urls
from ..functions import text as tx
from ..functions.session import checkpoint_folder, cut
from ..operators import dedup, frontier, graph, metrics, state, vector_index
from ..sources import buckets, search, store, web
from ..streaming import budget, streams
from . import crawl


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# URLs.

_AUTH = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
#: The normal form for URLs as the pages have them: plain paths, and queries without encoded characters.
_NORMAL = (
    "regexp_extract(url, '^([a-zA-Z]+)://', 1) || '://' || " + _AUTH + " || CASE WHEN regexp_replace(" + _PATH + ", '/+$', '') = '' THEN '/' ELSE regexp_replace(" + _PATH + ", '/+$', '') END || "
    "CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END"
)
_QUERY = (
    "list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '=.') AND NOT regexp_extract(p, '^[^=]*') IN "
    "('utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','ref','source','mc_cid','mc_eid'))"
)
_SCORE = (
    "CASE WHEN lower({p}) IN ('', '/') THEN 100 WHEN regexp_matches(lower({p}), '/categor|/catalog|/topic') THEN 80 WHEN regexp_matches(lower({p}), '/product|/item|/p/|/article') THEN 60 "
    "WHEN regexp_matches(lower({p}), '/blog|/news|/post') THEN 55 WHEN regexp_matches(url, 'page=\\d+|/page/\\d+') THEN 20 ELSE 40 END"
).format(p=_PATH)
_N = f"n AS (SELECT page_id, min(url) AS raw, {_NORMAL} AS url FROM (SELECT *, {_QUERY} AS q FROM pages) GROUP BY ALL)"


@query(f"SELECT page_id, {_NORMAL} AS normal FROM (SELECT *, {_QUERY} AS q FROM pages)")
def url_normalise(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.normalise(F.col("url")).alias("normal"))


@query(f"SELECT page_id, ({_SCORE})::INTEGER AS score FROM pages")
def url_score(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.score(F.col("url")).alias("score"))


@query(f"SELECT page_id, {_AUTH} AS domain FROM pages")
def url_domain(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query(f"SELECT page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) || '://' || {_AUTH} || '/en/9' AS link FROM pages")
def url_resolve(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.resolve(F.lit("/x/../en/9/#top"), F.col("url")).alias("link"))


# Texts and hashes.


@query("SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 4000) AS text FROM documents")
def text_collapse(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tx.collapse(F.col("text")).alias("text"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))::BIGINT AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


_SIMHASH = """
    t AS MATERIALIZED (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents) GROUP BY ALL),
    h AS MATERIALIZED (SELECT doc_id, c, ('0x' || substr(md5(t), 17, 16))::UBIGINT AS h FROM t),
    v AS MATERIALIZED (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN c ELSE -c END) AS s FROM h, (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY ALL),
    s AS MATERIALIZED (SELECT d.doc_id, coalesce(sum((1::UBIGINT << b)::HUGEINT) FILTER (s > 0), 0)::UBIGINT AS u FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id)"""
_SIGNED = "CASE WHEN u >= 9223372036854775808 THEN (u::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE u::BIGINT END"


@query(f"WITH {_SIMHASH} SELECT doc_id, {_SIGNED} AS simhash FROM s")
def simhash64(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tx.simhash("text").alias("simhash"))


@query(f"WITH {_SIMHASH} SELECT doc_id, k AS band, ((u >> (8 * k)::UBIGINT) & 255)::BIGINT AS value FROM s, (SELECT unnest(range(8)) AS k)")
def simhash_bands(spark, sf_dir):
    marked = _table(spark, sf_dir, "documents").select("doc_id", tx.simhash("text").alias("s"))
    return marked.select("doc_id", F.posexplode(tx.bands(F.col("s"))).alias("band", "value")).select("doc_id", F.col("band").cast("long"), "value")


# Deduplication.


@query(f"WITH {_SIMHASH}, r AS (SELECT u, min(doc_id) AS rep FROM s GROUP BY u) SELECT a.rep AS a, b.rep AS b, bit_count(xor(a.u, b.u))::INTEGER AS distance FROM r a JOIN r b ON a.rep < b.rep AND bit_count(xor(a.u, b.u)) <= 4")
def near_pairs(spark, sf_dir):
    """Pairs between representatives of equal simhashes; their members are in near_members."""
    marked = _table(spark, sf_dir, "documents").select("doc_id", tx.simhash("text").alias("simhash"))
    return dedup.near_pairs(dedup.representatives(marked))


@query(f"WITH {_SIMHASH} SELECT doc_id, min(doc_id) OVER (PARTITION BY u) AS rep FROM s")
def near_members(spark, sf_dir):
    marked = _table(spark, sf_dir, "documents").select("doc_id", tx.simhash("text").alias("simhash"))
    return marked.join(dedup.representatives(marked), "simhash").select("doc_id", "rep")


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS first FROM documents")
def exact_first(spark, sf_dir):
    marked = _table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))
    return dedup.exact(marked).select("doc_id", "first")


@query(f"""
    WITH RECURSIVE {_SIMHASH},
    o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, u, sha256(text) AS x FROM s JOIN documents USING (doc_id)),
    w AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS doc_id, '' AS reason, []::UBIGINT[] AS kept, []::VARCHAR[] AS texts UNION ALL
          SELECT n, doc_id, reason, CASE WHEN reason = '' THEN list_append(kept, u) ELSE kept END, CASE WHEN reason = '' THEN list_append(texts, x) ELSE texts END FROM
          (SELECT o.n, o.doc_id, o.u, o.x, w.kept, w.texts, CASE WHEN list_contains(w.texts, o.x) THEN 'exact' WHEN len(list_filter(w.kept, lambda k: bit_count(xor(k, o.u)) <= 4)) > 0 THEN 'near' ELSE '' END AS reason
           FROM w JOIN o ON o.n = w.n + 1))
    SELECT doc_id, reason <> '' AS is_dup, reason FROM w WHERE n > 0""")
def dedup_cascade(spark, sf_dir):
    return dedup.cascade(_table(spark, sf_dir, "documents"))


@query(f"""
    WITH RECURSIVE {_SIMHASH},
    o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, u, sha256(text) AS x FROM s JOIN documents USING (doc_id)),
    w AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS doc_id, '' AS reason, []::UBIGINT[] AS kept, []::VARCHAR[] AS texts UNION ALL
          SELECT n, doc_id, reason, CASE WHEN reason = '' THEN list_append(kept, u) ELSE kept END, CASE WHEN reason = '' THEN list_append(texts, x) ELSE texts END FROM
          (SELECT o.n, o.doc_id, o.u, o.x, w.kept, w.texts, CASE WHEN list_contains(w.texts, o.x) THEN 'exact' WHEN len(list_filter(w.kept, lambda k: bit_count(xor(k, o.u)) <= 4)) > 0 THEN 'near' ELSE '' END AS reason
           FROM w JOIN o ON o.n = w.n + 1)),
    f AS (SELECT avg(doc_id) AS cut FROM documents)
    SELECT doc_id, doc_id >= cut AS second, reason <> '' AS is_dup, reason FROM w, f WHERE n > 0""")
def dedup_two_batches(spark, sf_dir):
    """The verdicts of a stream of two micro-batches, cut at the mean id: the second is judged against what the first kept."""
    documents = _table(spark, sf_dir, "documents")
    middle = documents.agg(F.avg("doc_id")).first()[0]
    path = f"{checkpoint_folder(spark)}/batches-{uuid.uuid4().hex}"
    judge = streams.dedup_batches(path)
    for number, part in enumerate(("doc_id < {m}", "doc_id >= {m} OR doc_id IS NULL")):
        judge(documents.where(part.format(m=repr(float(middle or 0)) + "D")), number)
    return spark.read.parquet(f"{path}/verdicts").select("doc_id", (F.col("batch") == 1).alias("second"), "is_dup", "reason")


#: The walk over texts in order of their first ids, with pairs of ids whose vectors match as a third layer.
_SEMANTIC_WALK = """
    tt AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(doc_id)) AS n, min(doc_id) AS node, text, arg_min(u, doc_id) AS u FROM s JOIN documents USING (doc_id) GROUP BY text),
    m AS MATERIALIZED (SELECT doc_id, node FROM documents JOIN tt USING (text)),
    vp AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b
           ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4),
    e AS MATERIALIZED (SELECT DISTINCT least(x.node, y.node) AS a, greatest(x.node, y.node) AS b FROM vp JOIN m x ON x.doc_id = vp.a JOIN m y ON y.doc_id = vp.b WHERE x.node <> y.node),
    o AS MATERIALIZED (SELECT tt.n, tt.node, tt.u, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS before FROM tt LEFT JOIN e ON e.b = tt.node GROUP BY ALL),
    w AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS node, '' AS reason, []::UBIGINT[] AS kept, []::BIGINT[] AS ids UNION ALL
          SELECT n, node, reason, CASE WHEN reason = '' THEN list_append(kept, u) ELSE kept END, CASE WHEN reason = '' THEN list_append(ids, node) ELSE ids END FROM
          (SELECT o.n, o.node, o.u, w.kept, w.ids, CASE WHEN len(list_filter(w.kept, lambda k: bit_count(xor(k, o.u)) <= 4)) > 0 THEN 'near' WHEN list_has_any(w.ids, o.before) THEN 'semantic' ELSE '' END AS reason
           FROM w JOIN o ON o.n = w.n + 1))"""


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b
    ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4""")
def semantic_pairs(spark, sf_dir):
    """All pairs of vectors of a cosine of 0.4 or more: at the usual 0.92 the table has none."""
    return dedup.semantic_pairs(_table(spark, sf_dir, "embeddings"), 0.4).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_SIMHASH}, {_SEMANTIC_WALK}
    SELECT m.doc_id, w.reason <> '' OR m.doc_id <> m.node AS is_dup, CASE WHEN w.reason <> '' THEN w.reason WHEN m.doc_id <> m.node THEN 'exact' ELSE '' END AS reason FROM w JOIN m USING (node)""")
def cascade_semantic(spark, sf_dir):
    """All three layers; the vector of a document is the one of its id."""
    pairs = dedup.semantic_pairs(_table(spark, sf_dir, "embeddings"), 0.4)
    return dedup.cascade(_table(spark, sf_dir, "documents"), semantic=pairs)


_NEAREST = 0.3


@query(f"""
    WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
    SELECT query_id, arg_min(vec_id, (-s, vec_id)) AS vec_id, round(max(s), 6) AS score FROM p GROUP BY query_id HAVING max(s) >= {_NEAREST}""")
def semantic_nearest(spark, sf_dir):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    vectors = _table(spark, sf_dir, "embeddings")
    return dedup.nearest(vectors.where("vec_id % 20 = 0"), vectors, _NEAREST).withColumn("score", F.round("score", 6))


#: The table, and a neighbour of each vector: the vector with a tenth of itself reversed added.
_TWINS = (
    "tw AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL "
    "SELECT vec_id + 1000000, list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE + 0.3::DOUBLE * embedding[len(embedding) + 1 - i]::DOUBLE) FROM embeddings)"
)


def _twins(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    beside = F.zip_with("embedding", F.reverse("embedding"), lambda a, b: a + 0.3 * b)
    return rows.unionByName(rows.select((F.col("vec_id") + 1000000).alias("vec_id"), beside.alias("embedding")))


@query(f"""
    WITH {_TWINS}, p AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS s FROM tw q JOIN tw v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
    SELECT query_id, arg_min(vec_id, (-s, vec_id)) AS vec_id, round(max(s), 6) AS score FROM p GROUP BY query_id HAVING max(s) >= 0.92""")
def semantic_index(spark, sf_dir):
    """Nearest neighbours of a cosine of 0.92 or more by the index and its bounds, none missed, over the table and a neighbour of each of its vectors. Queries are the rows whose id is divisible by 20."""
    rows = _twins(spark, sf_dir)
    model = vector_index.fit(rows)
    found = vector_index.exact(rows.where("vec_id % 20 = 0"), cut(vector_index.index(rows, model)), model, 0.92)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


# Extraction.

_ENTITIES = "replace(regexp_replace(replace({}, '&quot;', '\"'), '&amp;?', '&', 'g'), '&middot;', '·')"
_TEXT = (
    "trim(regexp_replace(" + _ENTITIES.format("regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<!--.*?-->', ' ', 'g'), "
    "'(?s)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|<aside.*?</aside>|<header.*?</header>', ' ', 'g'), '<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"
)
_LINKS = f"l AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) || '://' || {_AUTH} || u AS dst FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS u FROM pages))"


@query(f"SELECT page_id, trim({_ENTITIES.format(chr(39).join(['regexp_extract(html, ', '<title>([^<]*)', ', 1)']))}) AS title FROM pages")
def html_title(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", extract.parsed(F.col("html"))["title"].alias("title"))


@query(f"SELECT page_id, substr({_TEXT}, 1, 4000) AS text FROM pages")
def html_base_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", extract.parsed(F.col("html"))["text"].alias("text"))


@query("SELECT page_id, length(html) < 3000 OR regexp_matches(substr(html, 1, 5000), '(?i)(data-reactroot|__NEXT_DATA__|ng-version|vue-app|<app-root|window\\.__STATE__|__nuxt__|_sveltekit)') AS needs_js FROM pages")
def html_needs_js(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", extract.needs_js(F.col("html")).alias("needs_js"))


@query("SELECT page_id, page_id % 7 < 5 AS captcha FROM pages")
def html_captcha(spark, sf_dir):
    """Each of the five marks on a seventh of the pages, and none on two sevenths."""
    marks = ['<div id="cf-challenge-running">', "<form id=challenge-form>", '<div class="box g-recaptcha">', '<iframe src="https://x/recaptcha/api">', "<div data-hcaptcha-widget-id=1>", "<p>no mark</p>", "<p class=captcha>"]
    mark = F.element_at(F.array(*map(F.lit, marks)), F.expr("int(page_id % 7) + 1"))
    return _table(spark, sf_dir, "pages").select("page_id", extract.captcha(F.concat("html", mark)).alias("captcha"))


@query("SELECT page_id, count(*)::BIGINT AS n_links FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS u FROM pages) GROUP BY page_id")
def html_links(spark, sf_dir):
    """With links inside navigation, as all of the pages' are."""
    got = extract.extract(_table(spark, sf_dir, "pages"), keep_noise_links=True)
    return got.where(F.size("content.links") > 0).select("page_id", F.size("content.links").cast("long").alias("n_links"))


#: The default detector: the profile with most hits among the words of the first 500 characters, ties in the profiles' order.
_LANGUAGE = (
    "CASE WHEN length({t}) < 20 THEN '' ELSE (SELECT CASE WHEN max(n) > 0 THEN arg_max(code, (n, -k)) ELSE '' END FROM (SELECT unnest(["
    + ", ".join(
        "{{'code': '" + code + "', 'k': " + str(k) + ", 'n': len(list_filter(string_split_regex(lower(substr({t}, 1, 500)), '[^\\p{{L}}]+'), lambda w: w IN (" + ", ".join(f"'{w}'" for w in words.split()) + ")))}}"
        for k, (code, words) in enumerate(extract.PROFILES.items())
    )
    + "], recursive := true))) END"
)
_ARTICLE = (
    "trim(regexp_replace(" + _ENTITIES.format("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"
)


@query(f"""
    WITH p AS (SELECT page_id, url, {_ARTICLE} AS article, trim({_ENTITIES.format("regexp_extract(html, '<title>([^<]*)', 1)")}) AS title FROM pages)
    SELECT page_id, url AS key, title, '' AS author, '' AS date, {_LANGUAGE.format(t="article")} AS language, article, '{{}}' AS schema_org FROM p""")
def page_text(spark, sf_dir):
    """The parts of page_content that need no model of entities."""
    return page_content(spark, sf_dir).drop("entities")


@query(f"SELECT page_id, {_ARTICLE} AS article FROM pages")
def article_scored(spark, sf_dir):
    """The body of pages whose <article> became a plain element: what the tag held is found by scores."""
    pages = _table(spark, sf_dir, "pages").withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>")))
    return pages.select("page_id", extract.parsed(F.col("html"))["article"].alias("article"))


#: Page templates around the texts of the first three paragraphs of an article, and what of them is the body.
_LAYOUTS = (
    "<body><div id=m><a href=/>Home</a> <a href=/x>More of it</a></div><div><div><h2>A head</h2><p>{a}</p><p>{b}</p><p>{c}</p></div></div><div><p>Some words, beside.</p></div>",
    "<body><table><tr><td><a href=/>Home</a></td><td><p>{a}</p><p>{b}</p><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul><p>{c}</p></td></tr></table>",
    "<body><h1>A head</h1><section><p>{a}</p></section><section><p>{b}</p><p>{c}</p></section><div><a href=/>Home</a></div>",
)


def _paragraph(k: int, sql: bool):
    """The k-th sentence of three, each with the page's number."""
    words = ("The page of the number {n}, which is long enough, tells of a river, a town and a bridge, and of those who live there.", "Its second part, of the number {n}, goes on to say, at some length, how the town came to be, and by whom it was built.", "In the end, number {n} comes back to the river, the bridge and the people, as it began, and says no more.")
    before, after = words[k].split("{n}")
    return f"'{before}' || page_id || '{after}'" if sql else F.concat(F.lit(before), F.col("page_id").cast("string"), F.lit(after))


@query(f"""SELECT page_id, layout, CASE WHEN layout IN (0, 2) THEN 'A head ' ELSE '' END || {_paragraph(0, True)} || ' ' || {_paragraph(1, True)} || ' ' || {_paragraph(2, True)} AS article
    FROM pages, (SELECT unnest(range(3))::INTEGER AS layout)""")
def article_layouts(spark, sf_dir):
    """The body in layouts without any <article>: nested containers, a table with a list of links, sections beside one another."""
    def filled(layout):
        rest, parts = layout, []
        for name, k in (("{a}", 0), ("{b}", 1), ("{c}", 2)):
            before, rest = rest.split(name)
            parts += [F.lit(before), _paragraph(k, False)]
        return F.concat(*parts, F.lit(rest))

    pages = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*map(filled, _LAYOUTS))).alias("layout", "html"))
    return pages.select("page_id", "layout", extract.parsed(F.col("html"))["article"].alias("article"))


#: Heads of pages ({n} stands for the page's number), and what is to be found in them: key, title, author, date, meta and flattened JSON-LD.
_HEADS = (
    (
        '<title> T{n} </title><meta name="description" content="d {n} &amp; more"><meta property="og:title" content="o{n}"><meta charset="utf-8"><link rel="canonical" href="/c/{n}/?utm_source=x&amp;b=2&amp;a=1"><script type="application/ld+json">'
        '{"@type": "Article", "headline": "h{n}", "author": {"@type": "Person", "name": "A {n}"}, "datePublished": "2024-01-02", "other": {n}}</script>',
        "/c/{n}?a=1&b=2", "T{n}", "A {n}", "2024-01-02", '{"description":"d {n} & more","og:title":"o{n}"}',
        '{"@type":"Article","author":"{\\"@type\\": \\"Person\\", \\"name\\": \\"A {n}\\"}","datePublished":"2024-01-02","headline":"h{n}","name":"A {n}"}',
    ),
    (
        '<script type="application/ld+json">[{"name": "first {n}", "author": ["B {n}", "C"]}, {"name": "second", "price": {n}.5}]</script>', "", "", "B {n}", "", "{}",
        '{"author":"[\\"B {n}\\", \\"C\\"]","name":"first {n}","price":"{n}.5"}',
    ),
    (
        '<link rel="canonical" href="HTTPS://Other.Example/x{n}"><script type="application/ld+json">{"@graph": [{"x": {"url": "deep{n}"}, "headline": "h{n}"}, {"author": "D {n}", "url": "late"}]}</script>', "https://other.example/x{n}", "h{n}", "D {n}", "",
        "{}", '{"author":"D {n}","headline":"h{n}","url":"deep{n}"}',
    ),
    (
        '<title>T</title><script type="application/ld+json">{"a": {"a": {"a": {"a": {"name": "five {n}", "a": {"price": "six", "a": {"url": "seven"}}}}}}}</script>', "", "T", "", "", "{}", '{"name":"five {n}"}',
    ),
    (
        '<meta name="k" content="one"><meta name="k" content="two"><script type="application/ld+json">{"name": oops {n}}</script><script type="application/ld+json">  </script><script type="application/ld+json">{"name": "ok {n}", "datePublished": ""}</script>',
        "", "", "", "", '{"k":"two"}', '{"datePublished":"","name":"ok {n}"}',
    ),
    ('<meta content="no name"><script>{"name": "no type"}</script>', "", "", "", "", "{}", "{}"),
)


def _numbered(text: str) -> str:
    """SQL of a text with the page's number in each place of {n}."""
    return "replace('" + text.replace("'", "''") + "', '{n}', page_id::VARCHAR)"


_ORIGIN = "regexp_extract(url, '^[a-zA-Z]+://', 0) || " + _AUTH
_HEAD_CASES = [
    "CASE page_id % 6 " + " ".join(f"WHEN {k} THEN {_numbered(head[part])}" for k, head in enumerate(_HEADS)) + " END" for part in range(1, 7)
]


@query(f"""SELECT page_id, CASE WHEN k = '' THEN url WHEN k LIKE '/%' THEN {_ORIGIN} || k ELSE k END AS key, title, author, date, meta, schema_org FROM (
    SELECT page_id, url, {", ".join(f"{c} AS {name}" for c, name in zip(_HEAD_CASES, ("k", "title", "author", "date", "meta", "schema_org")))} FROM pages)""")
def page_heads(spark, sf_dir):
    """Canonical link, title, author, date, meta and JSON-LD of heads with objects, arrays, graphs, depths of five and six, and malformed blocks."""
    heads = F.array(*(F.lit("<html><head>" + h[0] + "</head><body><p>Some text of the page.</p></body></html>") for h in _HEADS))
    html = F.replace(F.element_at(heads, F.expr("int(page_id % 6) + 1")), F.lit("{n}"), F.col("page_id").cast("string"))
    c = extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))).withColumn("key", web.page_key(F.col("content.canonical"), F.col("url")))
    in_order = lambda m: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
    return c.select("page_id", "key", *(F.col(f"content.{x}").alias(x) for x in ("title", "author", "date")), in_order("content.meta").alias("meta"), in_order("content.schema_org").alias("schema_org"))


@query()
def page_content(spark, sf_dir):
    c = extract.extract(_table(spark, sf_dir, "pages")).withColumn("key", web.page_key(F.col("content.canonical"), F.col("url")))
    return c.select("page_id", "key", *(F.col(f"content.{x}").alias(x) for x in ("title", "author", "date", "language", "article")), F.to_json("content.entities").alias("entities"), F.to_json("content.schema_org").alias("schema_org"))


@query(f"SELECT doc_id, {_LANGUAGE.format(t='text')} AS language FROM documents")
def language_detect(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", extract.detect_language(F.col("text")).alias("language"))


def _gram_hash(size: int) -> str:
    h = "0::BIGINT"
    for d in range(size):
        h = f"(({h}) * {language.FACTOR} + ord(substr(t, k + {d}, 1))) % {language.PRIME}"
    return h


#: The n-gram models trained and applied in SQL: buckets of all rows, counts of the four fifths that train.
_GRAMS = " UNION ALL ".join(f"SELECT doc_id, lang, train, unnest(list_transform(range(1, length(t) - {size - 2}), lambda k: {_gram_hash(size)})) % {language.BUCKETS} AS b FROM c WHERE length(t) > 2 AND length(t) >= {size}" for size in language.SIZES)


@query(f"""
    WITH c AS MATERIALIZED (SELECT doc_id, lang, doc_id % 5 <> 0 AS train, text, ' ' || trim(regexp_replace(lower(substr(text, 1, {language.PREFIX})), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM documents),
    b AS MATERIALIZED (SELECT doc_id, lang, train, b, count(*) AS n FROM ({_GRAMS}) GROUP BY ALL),
    k AS (SELECT lang, b, sum(n) AS n FROM b WHERE train AND lang IS NOT NULL GROUP BY ALL), l AS (SELECT lang, sum(n) AS total FROM k GROUP BY lang),
    s AS (SELECT b.doc_id, l.lang, sum(b.n * ln((coalesce(k.n, 0) + 1)::DOUBLE / (l.total + {language.BUCKETS})::DOUBLE)) AS s FROM b CROSS JOIN l LEFT JOIN k ON k.lang = l.lang AND k.b = b.b GROUP BY ALL),
    m AS (SELECT doc_id, arg_max(lang, s) AS language FROM s GROUP BY doc_id)
    SELECT doc_id, lang, NOT train AS held_out, CASE WHEN length(text) >= {language.LEAST} THEN coalesce(language, '') ELSE '' END AS language FROM c LEFT JOIN m USING (doc_id)""")
def language_trained(spark, sf_dir):
    """Languages by models that four fifths of the documents train; the others are held out."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.expr("doc_id % 5 = 0").alias("held_out"))
    model = language.train(documents.where("NOT held_out"))
    return documents.select("doc_id", "lang", "held_out", model.detect(F.col("text")).alias("language"))


#: Words with their places, for ASCII letters, digits and what is beyond ASCII.
_PHRASES = "regexp_extract(text, '^\\S+ \\S+')"


@query(f"""
    WITH g AS MATERIALIZED (SELECT DISTINCT CASE WHEN length(phrase) % 2 = 0 THEN 'ORG' ELSE 'PRODUCT' END AS label, phrase FROM (SELECT {_PHRASES} AS phrase FROM benchmark) WHERE regexp_matches(phrase, '[\\p{{L}}\\p{{N}}]')),
    p AS (SELECT doc_id, text, label, phrase, string_split(text, phrase) AS pieces FROM documents JOIN g ON contains(text, phrase)),
    h AS (SELECT doc_id, text, label, phrase, unnest(range(1, len(pieces))) AS k, pieces FROM p),
    s AS (SELECT doc_id, text, label, phrase, list_sum(list_transform(pieces[1:k], lambda x: length(x)))::BIGINT + (k - 1) * length(phrase) AS a FROM h)
    SELECT doc_id, label, phrase, a::INTEGER AS "start", (a + length(phrase))::INTEGER AS "end" FROM s
    WHERE NOT (regexp_matches(substr(text, a, 1), '[\\p{{L}}\\p{{N}}_]') AND a > 0 AND regexp_matches(phrase, '^[\\p{{L}}\\p{{N}}_]'))
      AND NOT (regexp_matches(substr(text, a + length(phrase) + 1, 1), '[\\p{{L}}\\p{{N}}_]') AND regexp_matches(phrase, '[\\p{{L}}\\p{{N}}_]$'))""")
def entity_gazetteer(spark, sf_dir):
    """Mentions of a gazetteer, the first two words of each benchmark item, in whole documents."""
    phrases = _table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", r"^\S+ \S+", 0).alias("phrase"))
    held = entities.gazetteer(phrases.withColumn("label", F.when(F.char_length("phrase") % 2 == 0, "ORG").otherwise("PRODUCT")))
    return entities.gazetteer_hits(_table(spark, sf_dir, "documents"), held)


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def lang_filter(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(extract.in_scope(F.col("lang"), ("en", "de"))).select("doc_id", "lang")


@query("SELECT coalesce(nullif(lang, ''), 'unknown') AS label, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def lang_counts(spark, sf_dir):
    return metrics.totals(_table(spark, sf_dir, "documents"), "lang")


# The frontier.


def _pending(spark, sf_dir):
    return frontier.admit(_table(spark, sf_dir, "pages"), seq="page_id")


_PENDING = f"{_N}, pend AS (SELECT url, {_AUTH} AS domain, ({_SCORE})::INTEGER AS priority, min(page_id)::BIGINT AS seq FROM n GROUP BY url)"


@query(f"WITH {_PENDING} SELECT url, domain, priority, seq FROM pend")
def frontier_admit(spark, sf_dir):
    return _pending(spark, sf_dir)


@query(f"WITH {_PENDING} SELECT url, domain, priority, seq FROM pend ORDER BY priority DESC, url LIMIT 20")
def frontier_topk(spark, sf_dir):
    """The 20 urls of a pop."""
    return frontier.top(_pending(spark, sf_dir))


@query(f"""WITH {_PENDING}, q AS (SELECT domain, greatest(1, least(5, round_even(5 * count(*) / (SELECT count(*) FROM pend), 0))) AS quota FROM pend GROUP BY domain),
    r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq, url) AS k FROM pend) SELECT url, domain, priority, seq FROM r JOIN q USING (domain) WHERE k <= quota""")
def frontier_fair(spark, sf_dir):
    """The urls of one tick."""
    return frontier.fair(_pending(spark, sf_dir))


@query(f"WITH {_PENDING}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, url) AS k FROM pend) SELECT url, domain, priority, seq FROM r WHERE k <= 2")
def domain_budget(spark, sf_dir):
    """Urls within a budget of 2 a domain."""
    return frontier.within_budget(_pending(spark, sf_dir), default=2)


@query(f"""WITH {_PENDING}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, url) AS k FROM pend)
    SELECT url, domain, priority, seq FROM r WHERE k <= CASE WHEN domain LIKE 'blog.%' THEN 4 WHEN domain LIKE 'm.%' THEN 1 * 5 WHEN domain LIKE '%.org' THEN 1 * 20 ELSE 1 END""")
def budget_tables(spark, sf_dir):
    """Urls within budgets that tables of overrides and tiers give."""
    pending = _pending(spark, sf_dir)
    domains = pending.select("domain").distinct()
    overrides = domains.where("domain LIKE 'blog.%'").withColumn("budget", F.lit(4))
    tiers = domains.select("domain", F.when(F.col("domain").like("m.%"), 2).when(F.col("domain").like("%.org"), 3).otherwise(9).alias("tier"))
    return frontier.within_budget(pending, default=1, overrides=overrides, tiers=tiers)


@query(f"WITH {_PENDING}, c AS (SELECT domain, count(*) AS used FROM pend GROUP BY domain) SELECT domain, 3::BIGINT AS budget, used::BIGINT AS used, greatest(0, 3 - used)::BIGINT AS remaining FROM c")
def budget_stats(spark, sf_dir):
    return frontier.budget_stats(_pending(spark, sf_dir), default=3)


@query("""SELECT 'u' || user_id AS domain, event_id AS id, CASE WHEN k <= b THEN k END AS place, k <= b AS allowed FROM (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 THEN 9 ELSE 4 END AS b,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, ts, event_id) AS k FROM events)""")
def budget_stream(spark, sf_dir):
    """Running budgets: three parts of the requests, the stream stopped and started again between them."""
    path = f"{checkpoint_folder(spark)}/budget-{uuid.uuid4().hex}"
    requests = _table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("domain"), F.col("event_id").alias("id"), "ts", "user_id")
    overrides = requests.where("user_id % 3 = 0").select("domain", F.lit(9).alias("budget")).distinct()
    with budget.state_store(spark):
        for part in range(3):
            requests.where(f"id % 3 = {part}").drop("user_id").write.mode("append").parquet(f"{path}/requests")
            stream = spark.readStream.schema("domain string, id long, ts timestamp").parquet(f"{path}/requests")
            granted = budget.grants(stream, default=4, overrides=overrides).drop("ts")
            granted.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/granted").awaitTermination()
    return spark.read.parquet(f"{path}/granted")


@query(f"WITH {_PENDING} SELECT url FROM pend WHERE url NOT IN (SELECT url FROM pend WHERE seq % 3 = 0)")
def resume_pending(spark, sf_dir):
    pending = _pending(spark, sf_dir)
    return frontier.resume(pending.select("url"), pending.where("seq % 3 = 0"))


@query(f"WITH {_PENDING} SELECT count(*)::BIGINT AS pending, count(DISTINCT url)::BIGINT AS seen FROM pend")
def frontier_counts(spark, sf_dir):
    pending = _pending(spark, sf_dir)
    return frontier.counts(pending, pending)


@query(f"SELECT page_id FROM pages WHERE {_AUTH} IN (SELECT {_AUTH} FROM pages WHERE page_id < 3)")
def scope_filter(spark, sf_dir):
    """Pages of the domains of the first three, which are the seeds."""
    pages = _table(spark, sf_dir, "pages")
    return frontier.scope(pages, pages.where("page_id < 3").select("url")).select("page_id")


# The link graph.


def _edges(spark, sf_dir):
    """Links with repetitions, both ways."""
    return _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).union(
        _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey"))
    )


_RANKS = (
    "raw AS MATERIALIZED (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem), e AS MATERIALIZED (SELECT DISTINCT src, dst FROM raw), "
    "nodes AS MATERIALIZED (SELECT src AS url FROM e UNION SELECT dst FROM e), deg AS MATERIALIZED (SELECT src, count(*) AS d FROM raw GROUP BY src), n AS (SELECT count(*) AS n FROM nodes), r0 AS MATERIALIZED (SELECT url, 1.0::DOUBLE / n AS pr FROM nodes, n), "
    + ", ".join(
        f"r{k} AS MATERIALIZED (SELECT nodes.url, 0.15::DOUBLE / (SELECT n FROM n) + 0.85::DOUBLE * coalesce(g.got, 0) AS pr FROM nodes LEFT JOIN "
        f"(SELECT e.dst, sum(r.pr / deg.d) AS got FROM e JOIN deg USING (src) JOIN r{k - 1} r ON r.url = e.src GROUP BY e.dst) g ON g.dst = nodes.url)"
        for k in range(1, 21)
    )
)


@query(f"WITH {_RANKS} SELECT url, round(pr / (SELECT max(pr) FROM r20) * 100, 5) AS score FROM r20")
def pagerank(spark, sf_dir):
    return graph.pagerank(_edges(spark, sf_dir)).withColumn("score", F.round("score", 5))


@query(f"WITH {_RANKS} SELECT url, least(200, 40 + floor(round(pr / (SELECT max(pr) FROM r20) * 100, 5) * 0.5))::INTEGER AS priority FROM r20")
def boosted_priority(spark, sf_dir):
    ranks = graph.pagerank(_edges(spark, sf_dir))
    return ranks.select("url", frontier.boost(F.lit(40), F.round("score", 5)).alias("priority"))


@query("SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem")
def links_ignore(spark, sf_dir):
    """Insert-ignore of edges into an empty table."""
    edges = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return store.insert_ignore(None, edges, ["src", "dst"])


# Storage.


def _writes(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("event_type").alias("title"), F.col("value").alias("etag"), F.col("event_id").alias("seq"))


@query("""SELECT 'u' || user_id AS url, arg_max(event_type, event_id) AS title, arg_max(value, event_id) AS status_code, arg_max(event_id % 5, event_id)::BIGINT AS simhash, arg_min(event_type, event_id) AS article,
    arg_min(event_id, event_id) AS language FROM events GROUP BY user_id""")
def upsert_older(spark, sf_dir):
    """The older columns: status and simhash are updated; article and language, which the newer set updates, keep their first values."""
    writes = _table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("url"), F.col("event_type").alias("title"), F.col("value").alias("status_code"), F.expr("event_id % 5").alias("simhash"), F.col("event_type").alias("article"), F.col("event_id").alias("language"), F.col("event_id").alias("seq")
    )
    return store.upsert(None, writes, updated=store.UPDATED_OLD)


@query("SELECT 'u' || user_id AS url, arg_max(event_type, event_id) AS title, arg_min(value, event_id) AS etag FROM events GROUP BY user_id")
def upsert_pg(spark, sf_dir):
    """title is updated; etag keeps its first value."""
    return store.upsert(None, _writes(spark, sf_dir))


@query("SELECT 'u' || user_id AS url, arg_max(event_type, event_id) AS title, arg_max(value, event_id) AS etag FROM events GROUP BY user_id")
def upsert_replace(spark, sf_dir):
    return store.replace(None, _writes(spark, sf_dir))


@query("SELECT 'u' || user_id AS url, min(event_id) AS seen FROM events WHERE event_id % 50 <> 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 50 = 0) GROUP BY user_id")
def done_ignore(spark, sf_dir):
    """Insert-ignore of completions: the first of each url, without those already done."""
    events = _table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("event_id").alias("seen"))
    return store.insert_ignore(events.where("seen % 50 = 0"), events.where("seen % 50 <> 0"), ["url"])


@query("""SELECT 'u' || user_id AS url, arg_max(event_type, event_id) AS title, coalesce(arg_min(value, event_id) FILTER (event_id % 3 = 0), arg_min(value, event_id)) AS etag
    FROM events GROUP BY user_id""")
def upsert_existing(spark, sf_dir):
    """An upsert into a stored table, of which many keys are known: a third of the writes came before."""
    writes = _writes(spark, sf_dir)
    return store.upsert(store.upsert(None, writes.where("seq % 3 = 0")), writes)


@query("SELECT 'u' || user_id AS url, arg_max(event_type, event_id) AS title, arg_max(value, event_id) AS etag FROM events WHERE event_id % 3 = 0 OR user_id % 2 = 0 GROUP BY user_id")
def replace_existing(spark, sf_dir):
    """Whole rows replaced in a stored table by the writes of every other url."""
    writes = _writes(spark, sf_dir)
    return store.replace(store.replace(None, writes.where("seq % 3 = 0")), writes.where("seq % 3 = 0 OR int(substring(url, 2)) % 2 = 0"))


@query("SELECT 'u' || user_id AS url, arg_max(event_type, (event_id % 3, event_id)) AS title, arg_min(value, (event_id % 3, event_id)) AS etag FROM events GROUP BY user_id")
def merge_on_read(spark, sf_dir):
    """Three batches of writes into a table by buckets, two of them merged by a compaction before the third comes."""
    table = buckets.MergeTable(spark, f"{checkpoint_folder(spark)}/merge-{uuid.uuid4().hex}", "url string, title string, etag double", buckets=16)
    writes = _writes(spark, sf_dir)
    for number in range(3):
        table.write(writes.where(f"seq % 3 = {number}"), number)
        if number == 1:
            table.compact(2)
    return table.read()


@query("SELECT 'u' || user_id AS url, min(event_id % 3)::INTEGER AS first_batch FROM events GROUP BY user_id")
def seen_table(spark, sf_dir):
    """The batch in which each url was new, of three that are added to a persistent set one after the other."""
    table = buckets.SeenTable(spark, f"{checkpoint_folder(spark)}/seen-{uuid.uuid4().hex}", buckets=16)
    writes = _writes(spark, sf_dir)
    found = [table.add(writes.where(f"seq % 3 = {number}"), number).select(F.col("key").alias("url"), F.lit(number).alias("first_batch")) for number in range(3)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""WITH e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_linenumber = 1 AS old FROM lineitem)
    SELECT src, dst FROM e GROUP BY ALL HAVING NOT bool_or(old)""")
def links_into_existing(spark, sf_dir):
    """Edges that a stored link table doesn't have."""
    lines = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), "l_linenumber")
    return store.insert_ignore(lines.where("l_linenumber = 1"), lines.select("src", "dst"), ["src", "dst"])


@query("SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'fetched' END AS event, 'u' || user_id AS url, printf('status=%d ms=%.0f', CASE WHEN event_type = 'error' THEN 500 ELSE 200 END, round_even(value, 0)) AS detail, event_id::DOUBLE + 1 AS ts FROM events")
def wal_events(spark, sf_dir):
    """The log appended to files and replayed."""
    failed = F.col("event_type") == "error"
    events = _table(spark, sf_dir, "events").select(
        F.when(failed, "error").otherwise("fetched").alias("event"), F.concat(F.lit("u"), "user_id").alias("url"),
        store.fetched_detail(F.when(failed, 500).otherwise(200), F.bround("value", 0)).alias("detail"), (F.col("event_id").cast("double") + 1).alias("ts"),
    )
    path = f"{checkpoint_folder(spark)}/wal-{uuid.uuid4().hex}"
    store.append_wal(events.where("event = 'error'"), path)
    store.append_wal(events.where("event <> 'error'"), path)
    return store.replay_wal(spark, path)


@query("SELECT term, doc_id AS key, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents) GROUP BY ALL")
def inverted_index(spark, sf_dir):
    return store.inverted_index(_table(spark, sf_dir, "documents"), "doc_id", ("text",))


@query("""WITH i AS (SELECT term, doc_id AS key, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents) WHERE term IN ('license', 'copyright') GROUP BY ALL)
    SELECT key, round(sum(tf * ln(1 + (SELECT count(*) FROM documents)::DOUBLE / df)), 6) AS score FROM i JOIN (SELECT term, count(*) AS df FROM i GROUP BY term) USING (term) GROUP BY key""")
def search_terms(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    index = store.inverted_index(documents, "doc_id", ("text",))
    return store.search(index, ["License", "copyright"], documents.count()).withColumn("score", F.round("score", 6))


_SEARCHES = {"one": "the ratings of things, erring", "two": "orantions hehely", "three": "copyrights licensed to heeding", "four": "thtion"}


def _cases(of: str, table: dict[str, str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _stem_sql(words: str) -> str:
    """CTEs up to stems(t, term) of the words of the CTE words(t): a step of the rules each."""
    ends = lambda name, source, found: f"{name} AS (SELECT *, regexp_extract(w, '({'|'.join(found)})$', 1) AS s, left(w, length(w) - length(s)) AS r FROM {source})"
    step = lambda name, source, w: f"{name} AS (SELECT t, a, b, {w} AS w FROM {source})"
    region, short = "[^aeiouy]*[aeiouy]+[^aeiouy]", "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
    own = {**stem.EXCEPTIONS, **{w + e: w for w in stem.KEPT for e in ("", "s")}}
    return ", ".join((
        f"m0 AS (SELECT t, regexp_replace(regexp_replace(t, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {words})",
        f"m1 AS (SELECT t, w, regexp_extract(w, '^({'|'.join(stem.HEADS)}|{region})') AS h, CASE WHEN h = '' THEN length(w) ELSE length(h) END AS a FROM m0)",
        f"m2 AS (SELECT t, w, a, regexp_extract(substr(w, a + 1), '^{region}') AS g, CASE WHEN g = '' THEN length(w) ELSE a + length(g) END AS b FROM m1)",
        ends("e1", "m2", ("sses", "ied", "ies", "us", "ss", "s")),
        step("m3", "e1", "CASE WHEN s = 'sses' THEN r || 'ss' WHEN s IN ('ied', 'ies') THEN r || CASE WHEN length(r) > 1 THEN 'i' ELSE 'ie' END WHEN s = 's' AND regexp_matches(left(r, length(r) - 1), '[aeiouy]') THEN r ELSE w END"),
        ends("e2", "m3", ("eedly", "ingly", "edly", "eed", "ing", "ed")),
        f"""m4 AS (SELECT t, a, b, CASE WHEN s LIKE 'eed%' THEN CASE WHEN length(r) >= a THEN r || 'ee' ELSE w END WHEN s = '' OR NOT regexp_matches(r, '[aeiouy]') THEN w WHEN regexp_matches(r, '(at|bl|iz)$') THEN r || 'e'
            WHEN regexp_matches(r, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(r, length(r) - 1) WHEN length(r) <= a AND regexp_matches(r, '{short}') THEN r || 'e' ELSE r END AS w FROM e2)""",
        step("m5", "m4", "regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i')"),
        ends("e3", "m5", stem.SECOND),
        step("m6", "e3", f"CASE WHEN s = '' OR length(r) < a OR (s = 'ogi' AND r NOT LIKE '%l') OR (s = 'li' AND NOT regexp_matches(r, '[cdeghkmnrt]$')) THEN w ELSE r || {_cases('s', stem.SECOND)} END"),
        ends("e4", "m6", stem.THIRD),
        step("m7", "e4", f"CASE WHEN s = '' OR length(r) < a OR (s = 'ative' AND length(r) < b) THEN w ELSE r || {_cases('s', stem.THIRD)} END"),
        ends("e5", "m7", stem.FOURTH),
        step("m8", "e5", "CASE WHEN s = '' OR length(r) < b OR (s = 'ion' AND NOT regexp_matches(r, '[st]$')) THEN w ELSE r END"),
        f"""m9 AS (SELECT t, CASE WHEN w LIKE '%e' AND (length(w) > b OR (length(w) > a AND NOT regexp_matches(left(w, length(w) - 1), '{short}'))) OR w LIKE '%ll' AND length(w) > b
            THEN left(w, length(w) - 1) ELSE w END AS w FROM m8)""",
        f"stems AS (SELECT t, CASE WHEN length(t) <= 2 THEN t ELSE coalesce({_cases('t', own)}, replace(w, 'Y', 'y')) END AS term FROM m9)",
    ))


@query(f"""
    WITH q(query, text) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _SEARCHES.items())}), stop(t) AS (VALUES {', '.join(f"('{w}')" for w in stem.STOP)}),
    f AS (SELECT doc_id, 1 AS w, text FROM documents UNION ALL SELECT doc_id, 10, substr(text, 1, 60) FROM documents),
    dt AS (SELECT * FROM (SELECT doc_id AS doc, w, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM f) ANTI JOIN stop USING (t)),
    qt AS (SELECT * FROM (SELECT query, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM q) ANTI JOIN stop USING (t)),
    words AS (SELECT t FROM dt UNION SELECT t FROM qt), {_stem_sql("words")},
    bag AS (SELECT doc, term, sum(w) AS w FROM dt JOIN stems USING (t) GROUP BY ALL), len AS (SELECT doc, sum(w) AS n FROM bag GROUP BY doc), size AS (SELECT count(*) AS n, avg(n) AS mean FROM len),
    idf AS (SELECT term, ln(1 + ((SELECT n FROM size) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM bag GROUP BY term),
    score AS (SELECT query, doc, round(sum(idf * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * len.n / (SELECT mean FROM size)))), 9) AS score
        FROM (SELECT DISTINCT query, term FROM qt JOIN stems USING (t)) JOIN idf USING (term) JOIN bag USING (term) JOIN len USING (doc) GROUP BY ALL)
    SELECT query, place::INTEGER AS place, doc, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM score) WHERE place <= 10""")
def search_top(spark, sf_dir):
    """The ten best documents of four queries, by an index over the first 60 characters, which weigh ten times, and the whole texts."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"))
    index = search.Index(spark, f"{checkpoint_folder(spark)}/search-{uuid.uuid4().hex}").build(documents, weights={"title": 10, "body": 1}, folders=16)
    return index.top(_SEARCHES, 10).withColumn("score", F.round("score", 6))


@query()
def search_documents(spark, sf_dir):
    c = F.col("content")
    pages = extract.extract(_table(spark, sf_dir, "pages")).select("url", *(c[x].alias(x) for x in ("title", "text", "article", "author", "date", "language", "entities", "schema_org")), F.lit("2024-01-01").alias("scraped_at"))
    return store.search_documents(pages)


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'If-None-Match' WHEN page_id % 5 = 1 THEN 'If-Modified-Since' ELSE '' END AS header, CASE WHEN page_id % 5 = 0 THEN 'e' || page_id WHEN page_id % 5 = 1 THEN 'm' || page_id ELSE '' END AS value FROM pages")
def conditional_request(spark, sf_dir):
    """Known by page_id: several pages may have one url, and each has validators of its own."""
    pages = _table(spark, sf_dir, "pages").select("page_id")
    known = pages.select("page_id", F.when(F.expr("page_id % 5 = 0"), F.concat(F.lit("e"), "page_id")).otherwise("").alias("etag"), F.when(F.expr("page_id % 5 IN (0, 1)"), F.concat(F.lit("m"), "page_id")).alias("last_modified"))
    return web.conditional(pages, known, "page_id").select("page_id", "header", "value")


@query("SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'not_modified' WHEN page_id % 4 = 0 THEN 'html' ELSE 'rejected' END AS verdict FROM pages")
def accept_response(spark, sf_dir):
    kind = F.expr("page_id % 4")
    got = _table(spark, sf_dir, "pages").select("page_id", F.when(kind == 2, 404).when(kind == 3, 304).otherwise(200).alias("status"), F.when(kind == 1, "application/pdf").otherwise("Text/HTML ; charset=utf-8").alias("content_type"), "html")
    return web.accept(got).select("page_id", "verdict")


@query(f"SELECT page_id, NOT (regexp_matches({_PATH}, '^/en/') AND NOT regexp_matches({_PATH}, '^/en/1')) AS allowed, 2.5::DOUBLE AS crawl_delay FROM pages")
def robots_rules(spark, sf_dir):
    """One file of rules for every origin."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    body = "User-agent: x\nDisallow: /\n\nUser-agent: *\nAllow: /en/1\nDisallow: /en/\nCrawl-delay: 2.5\n"
    robots = pages.select(F.lower(F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]*)", 1)).alias("origin"), F.lit(200).alias("status"), F.lit(body).alias("body")).distinct()
    return web.robots_allowed(pages, robots).select("page_id", "allowed", "crawl_delay")


@query(f"WITH {_N} SELECT DISTINCT {_AUTH} AS root, url FROM n")
def sitemap_scan(spark, sf_dir):
    """An index for each domain, over a file that lists its pages."""
    pages = _table(spark, sf_dir, "pages").select(urls.domain(F.col("url")).alias("d"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("u"))
    head = F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')
    lists = pages.groupBy("d").agg(F.concat(head, F.concat_ws("", F.collect_list(F.concat(F.lit("<url><loc>"), "u", F.lit("</loc></url>")))), F.lit("</urlset>")).alias("body")).select(F.concat("d", F.lit("/list")).alias("url"), "body")
    index = pages.select("d").distinct().select(F.col("d").alias("url"), F.concat(F.lit("<sitemapindex><sitemap><loc>"), "d", F.lit("/list</loc></sitemap></sitemapindex>")).alias("body"))
    files = lists.unionByName(index).withColumn("status", F.lit(200))
    return web.sitemap_urls(index.select("url"), files)


@query(f"WITH {_N} SELECT DISTINCT 'p' || page_id AS root, url FROM n WHERE page_id % 5 <= 3")
def sitemap_nested(spark, sf_dir):
    """Chains of indexes of up to four levels below each root, the last of them too deep; each index lists itself, the root, and a file that is cut off."""
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("root"), F.expr("int(page_id % 5)").alias("last"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("u"))
    files = pages.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("level")).withColumn("url", F.when(F.col("level") == 0, F.col("root")).otherwise(F.concat_ws("/", "root", "level")))
    below = F.concat_ws("/", "root", F.col("level") + 1)
    entry = lambda c: F.concat(F.lit("<sitemap><loc> "), c, F.lit(" </loc></sitemap>"))
    index = F.concat(F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), entry(F.col("url")), entry(F.col("root")), entry(F.concat("root", F.lit("/cut"))), entry(below), F.lit("</sitemapindex>"))
    listed = F.concat(F.lit("<urlset><url><loc>"), "u", F.lit("</loc><priority>1</priority></url></urlset>"))
    whole = files.select("url", F.when(F.col("level") < F.col("last"), index).otherwise(listed).alias("body"))
    cut_off = pages.select(F.concat("root", F.lit("/cut")).alias("url"), F.lit("<urlset><url><loc>http://cut.example/off</loc></url><url>").alias("body"))
    return web.sitemap_urls(pages.select(F.col("root").alias("url")), whole.unionByName(cut_off).withColumn("status", F.lit(200)))


# Metrics and state.

_TS = "strftime(time_bucket(INTERVAL '1 minute', ts), '%Y-%m-%d %H:%M:%S')"


@query(f"SELECT {_TS} AS window_start, event_type AS label, count(*) / 60.0::DOUBLE AS rate FROM events GROUP BY ALL")
def rate_1m(spark, sf_dir):
    return metrics.rate(_table(spark, sf_dir, "events"), "ts", "event_type").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(f"SELECT {_TS} AS window_start, 'u' || user_id AS label, count(*) / 60.0::DOUBLE AS rate FROM events WHERE event_type = 'error' GROUP BY ALL")
def error_rate(spark, sf_dir):
    errors = _table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("reason", F.concat(F.lit("u"), "user_id"))
    return metrics.rate(errors, "ts", "reason").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) / 60.0::DOUBLE AS rate FROM events")
def trailing_rate(spark, sf_dir):
    return metrics.trailing_rate(_table(spark, sf_dir, "events"), "ts", "event_type").select("event_id", "rate")


@query("SELECT event_type AS label, count(*)::BIGINT AS n FROM events GROUP BY 1")
def by_label(spark, sf_dir):
    return metrics.totals(_table(spark, sf_dir, "events"), "event_type")


@query("SELECT count(*)::BIGINT AS n FROM events")
def total_pages(spark, sf_dir):
    return _table(spark, sf_dir, "events").agg(F.count("*").alias("n"))


@query("SELECT event_type AS label, arg_max(value, (ts, value)) AS value FROM events GROUP BY 1")
def gauge_last(spark, sf_dir):
    return metrics.gauge(_table(spark, sf_dir, "events"), "ts", "value", "event_type")


_LE = "[" + ", ".join(f"{b}::DOUBLE" for b in metrics.FETCH_MS) + ", 'inf'::DOUBLE]"
_HIST = f"hb AS MATERIALIZED (SELECT event_type, le, count(*) FILTER (value <= le)::BIGINT AS cumulative FROM events, (SELECT unnest({_LE}) AS le) WHERE value IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_HIST} SELECT * FROM hb")
def hist_buckets(spark, sf_dir):
    return metrics.histogram(_table(spark, sf_dir, "events"), "value", by=[F.col("event_type")])


@query(
    f"""WITH {_HIST}, st AS (SELECT *, coalesce(lag(le) OVER o, 0) AS low, coalesce(lag(cumulative) OVER o, 0) AS bef, max(cumulative) OVER (PARTITION BY event_type) AS tot FROM hb WINDOW o AS (PARTITION BY event_type ORDER BY le)),
    qq AS (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS q), f AS (SELECT event_type, q, min(le) AS le FROM st, qq WHERE cumulative >= q * tot GROUP BY ALL)
    SELECT event_type, q, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (q * tot - bef) / (cumulative - bef) END, 6) AS value FROM f JOIN st USING (event_type, le)"""
)
def hist_quantile(spark, sf_dir):
    buckets = metrics.histogram(_table(spark, sf_dir, "events"), "value", by=[F.col("event_type")])
    out = [metrics.quantile(buckets, q, ["event_type"]) for q in (0.5, 0.95, 0.99)]
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumn("value", F.round("value", 6))


def _named_histogram(bounds) -> str:
    le = "[" + ", ".join(f"{b}::DOUBLE" for b in bounds) + ", 'inf'::DOUBLE]"
    return f"""WITH hb AS MATERIALIZED (SELECT event_type, le, count(*) FILTER (value <= le)::BIGINT AS cumulative FROM events, (SELECT unnest({le}) AS le) WHERE value IS NOT NULL GROUP BY ALL),
    st AS (SELECT *, coalesce(lag(le) OVER o, 0) AS low, coalesce(lag(cumulative) OVER o, 0) AS bef, max(cumulative) OVER (PARTITION BY event_type) AS tot FROM hb WINDOW o AS (PARTITION BY event_type ORDER BY le)),
    f AS (SELECT event_type, min(le) AS le FROM st WHERE cumulative >= 0.95::DOUBLE * tot GROUP BY ALL)
    SELECT event_type AS label, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (0.95::DOUBLE * tot - bef) / (cumulative - bef) END, 6) AS value FROM f JOIN st USING (event_type, le)"""


def _p95(spark, sf_dir, name):
    return metrics.named(name, _table(spark, sf_dir, "events"), value="value", label="event_type").where("q = 0.95").select("label", F.round("value", 6).alias("value"))


@query(_named_histogram(metrics.PARSE_MS))
def parse_p95(spark, sf_dir):
    """The named metric of parse times, with its own buckets."""
    return _p95(spark, sf_dir, "parse_latency")


@query(_named_histogram(metrics.ENRICH_MS))
def enrich_p95(spark, sf_dir):
    return _p95(spark, sf_dir, "enrich_latency")


_GAUGES = ("frontier_size", "active_browsers", "queue_depth", "healthy_proxies")
_TOTALS = ("duplicates_by_kind", "pages_by_language", "pages_by_renderer", "breaker_trips")


def _measured(spark, sf_dir, names):
    """One table of events of several metrics, named in a column."""
    name = F.element_at(F.array(*map(F.lit, names)), F.expr("int(event_id % 4) + 1"))
    return _table(spark, sf_dir, "events").withColumn("metric", name).withColumn("label", F.expr("if(event_id % 7 = 0, '', event_type)"))


_MEASURED = "SELECT *, ({names})[event_id % 4 + 1] AS metric, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS label FROM events"


@query(f"SELECT metric, label, arg_max(value, (ts, value)) AS value FROM ({_MEASURED.format(names=list(_GAUGES))}) GROUP BY ALL")
def named_gauges(spark, sf_dir):
    """The catalogue's gauges, told apart by the events' metric."""
    events = _measured(spark, sf_dir, _GAUGES)
    parts = [metrics.named(m, events, metric="metric").select(F.lit(m).alias("metric"), "label", "value") for m in _GAUGES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"SELECT metric, coalesce(nullif(label, ''), 'unknown') AS label, count(*)::BIGINT AS n FROM ({_MEASURED.format(names=list(_TOTALS))}) GROUP BY ALL")
def named_totals(spark, sf_dir):
    """The catalogue's totals by label, told apart by the events' metric; empty labels are unknown."""
    events = _measured(spark, sf_dir, _TOTALS)
    parts = [metrics.named(m, events, metric="metric").select(F.lit(m).alias("metric"), "label", "n") for m in _TOTALS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT event_type AS stage, count(*)::BIGINT AS n, round(sum(value), 3) AS total_ms, round(avg(value), 6) AS mean_ms, max(value) AS max_ms FROM events GROUP BY 1")
def trace_spans(spark, sf_dir):
    return metrics.spans(_table(spark, sf_dir, "events"), "event_type", "value").withColumn("total_ms", F.round("total_ms", 3)).withColumn("mean_ms", F.round("mean_ms", 6))


def _log(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.expr("user_id % 20")).alias("domain"), seconds.alias("arrival"), F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "success").otherwise("other").alias("outcome"))


@query("""WITH a AS (SELECT event_id, 'u' || (user_id % 20) AS domain, epoch_us(ts) / 1000000.0::DOUBLE AS arrival FROM events),
    i AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY arrival, event_id) - 1)::DOUBLE AS i FROM a)
    SELECT event_id, round(max(arrival - i * 1.5::DOUBLE) OVER (PARTITION BY domain ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) + i * 1.5::DOUBLE, 3) AS start FROM i""")
def rate_schedule(spark, sf_dir):
    return state.schedule(_log(spark, sf_dir)).select("event_id", F.round("start", 3).alias("start"))


_BREAK = """WITH RECURSIVE a AS MATERIALIZED (SELECT event_id, 'u' || (user_id % 20) AS domain, epoch_us(ts) / 1000000.0::DOUBLE AS t, event_type AS e, row_number() OVER (PARTITION BY user_id % 20 ORDER BY epoch_us(ts), event_id) AS k FROM events),
    w AS (SELECT domain, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0.0::DOUBLE AS t, true AS allowed, 0 AS failures, 0.0::DOUBLE AS until FROM (SELECT DISTINCT domain FROM a) UNION ALL
      SELECT a.domain, a.k, a.event_id, a.t, NOT a.t < w.until,
        CASE WHEN a.t < w.until THEN w.failures WHEN e = 'view' THEN 0 WHEN e = 'error' THEN w.failures + 1 ELSE w.failures END,
        CASE WHEN a.t < w.until THEN w.until WHEN e = 'error' AND w.failures + 1 >= 3 THEN a.t + 20000.0 ELSE 0 END
      FROM w JOIN a ON a.domain = w.domain AND a.k = w.k + 1)"""


@query(_BREAK + " SELECT domain, event_id, allowed, failures::INTEGER AS failures FROM w WHERE k > 0")
def circuit_breaker(spark, sf_dir):
    """Three failures block a domain for 20,000 s: the log is thin."""
    return state.breaker(_log(spark, sf_dir), ts="arrival", threshold=3, cooldown=20000.0).select("domain", "event_id", "allowed", "failures")


@query(_BREAK + " SELECT domain, arg_max(failures, k)::INTEGER AS failures, arg_max(until, k) > 0 AS open, sum((allowed AND until > 0)::INTEGER)::BIGINT AS trips FROM w WHERE k > 0 GROUP BY domain")
def trips_by_domain(spark, sf_dir):
    return state.breaker_stats(state.breaker(_log(spark, sf_dir), ts="arrival", threshold=3, cooldown=20000.0))


# The whole path.


_BODY_SIMHASH = (
    f"bodies AS MATERIALIZED (SELECT page_id AS doc_id, {_ARTICLE} AS article, url FROM pages), "
    + _SIMHASH.replace("lower(text)", "lower(article)").replace("FROM documents d LEFT", "FROM bodies d LEFT").replace("AS t FROM documents)", "AS t FROM bodies)")
)


def _process_sql(where: str, wanted: str) -> str:
    """The page path in SQL: article texts in order of their ids; out-of-scope languages take no part in deduplication."""
    return f"""
    WITH RECURSIVE {_BODY_SIMHASH}, l AS MATERIALIZED (SELECT doc_id, {_LANGUAGE.format(t="article")} AS language FROM bodies),
    o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, u, sha256(article) AS x FROM s JOIN bodies USING (doc_id) JOIN l USING (doc_id) WHERE {wanted}),
    w AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS doc_id, '' AS reason, []::UBIGINT[] AS kept, []::VARCHAR[] AS texts UNION ALL
          SELECT n, doc_id, reason, CASE WHEN reason = '' THEN list_append(kept, u) ELSE kept END, CASE WHEN reason = '' THEN list_append(texts, x) ELSE texts END FROM
          (SELECT o.n, o.doc_id, o.u, o.x, w.kept, w.texts, CASE WHEN list_contains(w.texts, o.x) THEN 'exact' WHEN len(list_filter(w.kept, lambda k: bit_count(xor(k, o.u)) <= 4)) > 0 THEN 'near' ELSE '' END AS reason
           FROM w JOIN o ON o.n = w.n + 1))
    SELECT bodies.doc_id AS page_id, url AS key, CASE WHEN w.n IS NULL THEN 'lang_filtered' WHEN reason = '' THEN 'stored' ELSE reason END AS status, l.language
    FROM bodies JOIN l USING (doc_id) LEFT JOIN w ON w.doc_id = bodies.doc_id {where}"""


@query(_process_sql("", "language IN ('en', 'de')"))
def process_languages(spark, sf_dir):
    """The page path with two target languages: other pages never enter deduplication."""
    got = crawl.process(_table(spark, sf_dir, "pages"), crawl.Settings(target_languages=("en", "de")))
    return got.select("page_id", "key", "status", F.col("content.language").alias("language"))


@query(_process_sql("", "true"))
def process_pages(spark, sf_dir):
    return crawl.process(_table(spark, sf_dir, "pages")).select("page_id", "key", "status", F.col("content.language").alias("language"))


@query()
def crawl_rounds(spark, sf_dir):
    """A crawl from all pages' urls, until no new url is found: kinds of verdicts, counted."""
    pages = _table(spark, sf_dir, "pages")
    got = crawl.crawl(spark, pages.select("url"), pages, crawl.Settings(keep_noise_links=True, max_pages=None))
    return got["kinds"]
