"""One query for each operator over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import html as pages_html
from pressmill.functions import text as T
from pressmill.operators import clean, dedupe, keys, match, rank, report
from pressmill.plans import live
from pressmill.plans import search as archive_search_plan
from pressmill.sources import archive, registry, sitemap
from pressmill.sources import pages as stored_pages
from pressmill.sources.tables import articles, table
from pressmill.storage import new_path, written
from pressmill.streaming import daily

KEYWORDS = ["thing", "ering", "Theand", "é"]
SECTIONS = ["/en/", "/de/"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Documents as articles; what ``sources.tables.articles`` does.
_ARTICLES = """articles as (
    select doc_id, 'https://example.test/' || source || '/' || doc_id as url, source, lang, text,
           split_part(text, chr(10), 1) as title,
           timestamp '2024-01-01 00:00:00' + to_days((doc_id % 30)::int) + to_minutes(doc_id * 37 % 1440) as published
    from documents)"""
_WORDS = r"len(regexp_extract_all({}, '[^\s]+'))"


def _has(text: str, keyword: str) -> str:
    """P6 of one keyword in SQL."""
    k = T.fold(keyword)
    hay = f"lower(nfc_normalize({text}))"
    if any("a" <= c <= "z" or c.isdigit() for c in k):
        return f"regexp_matches({hay}, '(^|[^a-z0-9]){k}([^a-z0-9]|$)')"
    return f"contains({hay}, '{k}')"


def _matched(text: str) -> str:
    cases = ", ".join(f"case when {_has(text, k)} then '{k}' end" for k in KEYWORDS)
    return f"list_filter([{cases}], lambda x: x is not null)"


def _live(url: str, title: str) -> str:
    in_url = " or ".join(f"contains(lower({url}), '{p}')" for p in match.LIVE_URL_PARTS)
    in_title = " or ".join(f"contains(lower({title}), '{p}')" for p in match.LIVE_TITLE_PARTS)
    return f"({in_url} or {in_title})"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


# ---------------------------------------------------------------- search, predicates


@query(
    "archive_search",
    f"""with {_ARTICLES}, passed as (
        select *, {_WORDS.format('text')} as words, {_matched("title || chr(10) || text")} as matched from articles
        where published between timestamp '2024-01-03' and timestamp '2024-01-20 23:59:59')
    select url, source, strftime(published, '%Y-%m-%d %H:%M') as published, title, words::bigint as words, array_to_string(matched, ', ') as keyword
    from passed where words >= 25 and len(matched) > 0 and not {_live('url', 'title')}
    qualify row_number() over (partition by url order by published, doc_id) = 1""",
)
def archive_search(spark: SparkSession, root: str) -> DataFrame:
    rows = articles(spark, root).where(match.in_window(F.col("published"), F.lit("2024-01-03").cast("date"), F.lit("2024-01-20").cast("date")))
    found = archive_search_plan.search(rows, KEYWORDS, [F.asc("published"), F.asc("doc_id")])
    return found.select("url", "source", T.minute(F.col("published")).alias("published"), "title", "words", F.array_join("matched", ", ").alias("keyword"))


@query(
    "window_scan",
    f"""with {_ARTICLES} select doc_id, strftime(published, '%Y-%m-%d %H:%M') as published, source from articles
    where published between timestamp '2024-01-05' and timestamp '2024-01-11 23:59:59'""",
)
def window_scan(spark: SparkSession, root: str) -> DataFrame:
    rows = articles(spark, root).where(match.in_window(F.col("published"), F.lit("2024-01-05").cast("date"), F.lit("2024-01-11").cast("date")))
    return rows.select("doc_id", T.minute(F.col("published")).alias("published"), "source").orderBy(F.desc("published"), "source", "doc_id")


@query("keyword_match", f"select doc_id, array_to_string({_matched('text')}, '|') as matched from documents")
def keyword_match(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.array_join(match.matched_keywords(F.col("text"), KEYWORDS), "|").alias("matched"))


@query(
    "match_location",
    f"""with {_ARTICLES} select doc_id, case when len({_matched('title')}) > 0 then 'title/slug' else 'body' end as location
    from articles where len({_matched('text')}) > 0 or len({_matched('title')}) > 0""",
)
def match_location(spark: SparkSession, root: str) -> DataFrame:
    where = match.match_location(F.col("title"), F.col("text"), KEYWORDS).alias("location")
    return articles(spark, root).select("doc_id", where).where("location is not null")


@query(
    "aggregator_filter",
    f"""with t as (select page_id, case when page_id % 7 = 0 then url || '/x-live-y' when page_id % 11 = 0 then url || '/liveblog' else url end as url,
        case when page_id % 5 = 0 then 'News Live: ' || url else url end as title from pages)
    select page_id, {_live('url', 'title')} as is_live from t""",
)
def aggregator_filter(spark: SparkSession, root: str) -> DataFrame:
    n, url = F.col("page_id"), F.col("url")
    odd = F.when(n % 7 == 0, F.concat(url, F.lit("/x-live-y"))).when(n % 11 == 0, F.concat(url, F.lit("/liveblog"))).otherwise(url)
    title = F.when(n % 5 == 0, F.concat(F.lit("News Live: "), url)).otherwise(url)
    return table(spark, root, "pages").select("page_id", match.is_live_page(odd, title).alias("is_live"))


@query("section_filter", "select page_id, url from pages where contains(lower(url), '/en/') or contains(lower(url), '/de/')")
def section_filter(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "pages")
    return pages.where(match.in_sections(F.col("url"), F.array(*map(F.lit, SECTIONS)))).select("page_id", "url")


@query(
    "word_counts",
    f"""select doc_id, {_WORDS.format('text')}::bigint as words, {_WORDS.format('text')} < 120 as partial from documents
    where {_WORDS.format('text')} >= 60""",
)
def word_counts(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))
    return docs.where("words >= 60").withColumn("partial", F.col("words") < match.LEDE_WORDS)


@query(
    "default_language",
    """select doc_id, source, case when n_chars > 2000 then s.language else d.lang end as language
    from documents d join (select source, min(lang) as language from documents group by source) s using (source)""",
)
def default_language(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    own = docs.groupBy("source").agg(F.min("lang").alias("language"))
    blank = docs.withColumn("lang", F.when(F.col("n_chars") > 2000, "").otherwise(F.col("lang")))
    return blank.join(own, "source").select("doc_id", "source", sitemap.language_or(F.col("lang"), F.col("language")).alias("language"))


# ---------------------------------------------------------------- scalar functions


@query(
    "slug_tokens",
    r"""select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '[^a-z0-9]+', ' ', 'g') as slug from pages""",
)
def slug_tokens(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", T.slug_words(F.col("url")).alias("slug"))


@query(
    "url_parts",
    r"""select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path, substr(sha256(url), 1, 32) as cache_key from pages""",
)
def url_parts(spark: SparkSession, root: str) -> DataFrame:
    url = F.col("url")
    return table(spark, root, "pages").select("page_id", T.url_host(url).alias("host"), T.url_path(url).alias("path"), T.page_key(url).alias("cache_key"))


@query(
    "name_slugs",
    "select p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') as slug from part",
)
def name_slugs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query(
    "normalised_titles",
    f"with {_ARTICLES} select doc_id, lower(nfc_normalize(replace(title, 'ß', 'ss'))) as title from articles",
)
def normalised_titles(spark: SparkSession, root: str) -> DataFrame:
    return articles(spark, root).select("doc_id", T.normalise(F.col("title")).alias("title"))


@query(
    "parsed_times",
    """select event_id, case event_id % 6 when 0 then null when 5 then null when 4 then strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M')
        else strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M') end as published from events""",
)
def parsed_times(spark: SparkSession, root: str) -> DataFrame:
    ts, kind = F.col("ts"), F.col("event_id") % 6
    written = (
        F.when(kind == 0, "").when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss+00:00"))
        .when(kind == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm'Z'")).when(kind == 4, F.date_format(ts, "yyyyMMdd"))
        .otherwise(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    )
    parsed = F.convert_timezone(F.current_timezone(), F.lit("UTC"), T.parse_time(written).cast("timestamp_ntz"))
    # a date alone is midnight in the session's zone
    parsed = F.when(kind == 4, T.parse_time(written).cast("timestamp_ntz")).otherwise(parsed)
    return table(spark, root, "events").select("event_id", F.when(parsed.isNotNull(), T.minute(parsed)).alias("published"))


@query(
    "report_windows",
    """with m as (select ['जानेवारी', 'फेब्रुवारी', 'मार्च', 'एप्रिल', 'मे', 'जून', 'जुलै', 'ऑगस्ट', 'सप्टेंबर', 'ऑक्टोबर', 'नोव्हेंबर', 'डिसेंबर'] as n),
    d as (select o_orderkey, o_orderdate::date as a, (o_orderdate + interval 7 day)::date as b from orders)
    select o_orderkey, case when o_orderkey % 10 = 0 then 'soon – ' || strftime(b, '%m/%d/%Y') else
        day(a) || ' ' || n[month(a)] || ' ' || year(a) || ' ते ' || day(b) || ' ' || n[month(b)] || ' ' || year(b)
        || ' (' || strftime(a, '%Y-%m-%d') || ' – ' || strftime(b, '%Y-%m-%d') || ')' end as report_window from d, m""",
)
def report_windows(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "orders")
    a = F.when(F.col("o_orderkey") % 10 == 0, "soon").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    b = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 7), "MM/dd/yyyy")
    return rows.select("o_orderkey", T.window_text(a, b).alias("report_window"))


@query("token_counts_w", r"select doc_id, len(regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+'))::bigint as tokens from documents")
def token_counts_w(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("tokens"))


# ---------------------------------------------------------------- keys, sets, joins


@query("first_per_key", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def first_per_key(spark: SparkSession, root: str) -> DataFrame:
    return keys.first_per_key(table(spark, root, "events"), "user_id", [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query("last_per_key", "select text, max(doc_id) as doc_id from documents group by text")
def last_per_key(spark: SparkSession, root: str) -> DataFrame:
    return keys.last_per_key(table(spark, root, "documents").select("text", "doc_id"), "text", ["doc_id"])


@query(
    "first_passing",
    "select user_id, event_id from events where value > 50 qualify row_number() over (partition by user_id order by ts, event_id) = 1",
)
def first_passing(spark: SparkSession, root: str) -> DataFrame:
    passing = table(spark, root, "events").where("value > 50")
    return keys.first_per_key(passing, "user_id", [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id")


@query(
    "master_append",
    """with rows as (select 0 as part, doc_id, text, source from documents where lang <> 'en' union all
        select 1, doc_id, text, source from documents)
    select text, doc_id, source from rows qualify row_number() over (partition by text order by part, doc_id) = 1""",
)
def master_append(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    old, new = (d.select("text", "doc_id", "source") for d in (docs.where("lang <> 'en'"), docs))
    return keys.append_keep_first(old, new, "text", [F.asc("doc_id")])


@query("anti_new_urls", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def anti_new_urls(spark: SparkSession, root: str) -> DataFrame:
    return keys.only_new(table(spark, root, "documents").select("doc_id", "source"), table(spark, root, "labels"), "doc_id")


@query("semi_skipped", "select source, count(*) as skipped from documents where doc_id in (select doc_id from labels) group by source")
def semi_skipped(spark: SparkSession, root: str) -> DataFrame:
    stored = keys.already_stored(table(spark, root, "documents").select("doc_id", "source"), table(spark, root, "labels"), "doc_id")
    return stored.groupBy("source").agg(F.count("*").alias("skipped"))


@query("left_bodies", "select l.doc_id, l.quality, coalesce(d.text, '') as text from labels l left join (select * from documents where lang = 'en') d using (doc_id)")
def left_bodies(spark: SparkSession, root: str) -> DataFrame:
    bodies = table(spark, root, "documents").where("lang = 'en'").select("doc_id", "text")
    return keys.with_bodies(table(spark, root, "labels").select("doc_id", "quality"), bodies, "doc_id")


@query(
    "profile_upsert",
    """select c_custkey::varchar as id, case when c_acctbal < 0 then upper(c_name) else c_name end as name, c_acctbal < 0 as changed from customer""",
)
def profile_upsert(spark: SparkSession, root: str) -> DataFrame:
    own = [F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit("t0").alias("created"), F.lit(False).alias("changed")]
    rows = table(spark, root, "customer")
    # half of the changes replace a stored row, half are new
    stored = rows.where("c_acctbal >= 0 or c_nationkey < 12").select(*own)
    changes = rows.where("c_acctbal < 0").select(*own).withColumn("name", F.upper("name")).withColumn("changed", F.lit(True))
    return registry.upserted(stored, changes).select("id", "name", "changed")


@query(
    "run_listing",
    """select o_orderkey::varchar as id, o_orderstatus as status, o_orderkey in (select l_orderkey from lineitem where l_discount > 0.09) as has_report
    from orders""",
)
def run_listing(spark: SparkSession, root: str) -> DataFrame:
    runs = table(spark, root, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"))
    reports = table(spark, root, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").cast("string").alias("id"))
    return registry.list_runs(runs, reports)


# ---------------------------------------------------------------- boilerplate, duplicates

_LINES = """lines as (select distinct doc_id, source, unnest(string_split(text, chr(10))) as line from documents),
    freq as (select source, line, count(*) as n from lines group by all),
    sizes as (select source, count(*) as docs from documents group by source)"""


@query(
    "line_frequency",
    f"with {_LINES} select source, line, n, round(n / docs, 9) as share from freq join sizes using (source) where n >= 3",
)
def line_frequency(spark: SparkSession, root: str) -> DataFrame:
    return clean.line_shares(table(spark, root, "documents"), "\n").select("source", "line", "n", F.round("share", 9).alias("share"))


@query(
    "strip_boilerplate",
    f"""with {_LINES}, cut as (select source, line from freq join sizes using (source) where n >= 3 and n / docs >= 0.05),
    parts as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
    kept as (select p.doc_id, string_agg(p.line, chr(10) order by p.i) as text, count(*) as n from parts p anti join cut c on p.source = c.source and p.line = c.line group by p.doc_id)
    select d.doc_id, coalesce(k.text, '') as text, (len(string_split(d.text, chr(10))) - coalesce(k.n, 0))::bigint as removed
    from documents d left join kept k using (doc_id)""",
)
def strip_boilerplate(spark: SparkSession, root: str) -> DataFrame:
    return clean.strip_boilerplate(table(spark, root, "documents"), 0.05, "\n").select("doc_id", "text", "removed")


_GRAMS = r"""w as (select doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+') as w from documents),
    grams as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
    sizes as (select doc_id, count(*) as n from grams group by doc_id),
    met as (select a.doc_id as a, b.doc_id as b, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all)"""


@query(
    "jaccard_pairs",
    f"""with {_GRAMS} select a, b, round(c / (x.n + y.n - c), 9) as jaccard from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where c / (x.n + y.n - c) >= 0.55""",
)
def jaccard_pairs(spark: SparkSession, root: str) -> DataFrame:
    sets = written(dedupe.shingle_sets(table(spark, root, "documents"), "doc_id"), "sets")
    return dedupe.similar_pairs(sets).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query(
    "dedupe_kept",
    f"""with recursive {_GRAMS},
    pairs as (select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c / (x.n + y.n - c) >= 0.55),
    ranked as (select doc_id, row_number() over (order by {_WORDS.format('text')} desc, doc_id) as r from documents),
    early as (select case when x.r < y.r then a else b end as e, case when x.r < y.r then b else a end as l, least(x.r, y.r) as er
        from pairs join ranked x on x.doc_id = a join ranked y on y.doc_id = b),
    nodes as (select doc_id, row_number() over (order by r) as k, coalesce(nb, []) as nb from ranked
        left join (select l, list(e) as nb from early group by l) on l = doc_id where doc_id in (select unnest([e, l]) from early)),
    greedy(k, kept) as (select 0::bigint, []::bigint[] union all
        select n.k, case when len(list_intersect(kept, nb)) = 0 then list_append(kept, doc_id) else kept end from greedy g join nodes n on n.k = g.k + 1),
    final as (select kept from greedy order by k desc limit 1),
    gone as (select l, arg_min(e, er) as dupe_of from early, final where list_contains(kept, e) and not list_contains(kept, l) group by l)
    select doc_id, dupe_of from documents left join gone on l = doc_id""",
)
def dedupe_kept(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    order = [(-T.word_count(F.col("text"))).alias("w"), F.col("doc_id")]
    return dedupe.dedupe(docs, order, "doc_id").withColumnRenamed("id", "doc_id")


# ---------------------------------------------------------------- tallies, ranking, text


@query(
    "outlet_tally",
    """select string_agg(source || ' (' || n || ')', ', ' order by n desc, first_at) as listed
    from (select source, count(*) as n, min(doc_id) as first_at from documents group by source)""",
)
def outlet_tally(spark: SparkSession, root: str) -> DataFrame:
    return report.tally_line(table(spark, root, "documents"), "source", "doc_id")


@query("value_counts", "select source, count(*) as n, min(doc_id) as first_at from documents group by source")
def value_counts(spark: SparkSession, root: str) -> DataFrame:
    return report.tally(table(spark, root, "documents"), "source", "doc_id")


#: A stand-in score for documents: a deterministic function of the id.
_SCORE = "((doc_id * 7919 % 2000) / 200.0 - 5)"


@query(
    "relevance_thresholds",
    f"""select t::double as floor, count(*) filter (where 1 / (1 + exp(-{_SCORE})) >= t) as kept, count(*) as total
    from documents, (values (0.01), (0.02), (0.05), (0.1), (0.3), (0.5)) as floors(t) group by t""",
)
def relevance_thresholds(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select(F.expr(f"double({_SCORE})").alias("score"))
    return rank.floor_table(docs, [0.01, 0.02, 0.05, 0.1, 0.3, 0.5])


@query(
    "location_precision",
    f"""select case when len({_matched("split_part(text, chr(10), 1)")}) > 0 then 'title/slug' else 'body' end as location, count(*) as articles,
    round(median(1 / (1 + exp(-{_SCORE}))), 6) as median_relevance, count(*) filter (where 1 / (1 + exp(-{_SCORE})) >= 0.1) as cleared
    from documents where len({_matched('text')}) > 0 group by 1""",
)
def location_precision(spark: SparkSession, root: str) -> DataFrame:
    where = match.match_location(F.col("title"), F.col("text"), KEYWORDS).alias("where")
    rows = articles(spark, root).select(where, F.expr(f"double({_SCORE})").alias("score")).where("where is not null")
    return rank.location_table(rows).select(F.col("where").alias("location"), "articles", F.round("median_relevance", 6).alias("median_relevance"), "cleared")


_TOP = f"""top as (select *, {_SCORE} as score, row_number() over (order by {_SCORE} desc, published desc, url) as n,
    {_WORDS.format('text')} < 120 as partial from articles qualify n <= 20)"""
#: Every document that is relevant enough, numbered.
_KEPT = f"""kept as (select *, {_SCORE} as score, row_number() over (order by {_SCORE} desc, published desc, url) as n,
    {_WORDS.format('text')} < 120 as partial from articles where 1 / (1 + exp(-{_SCORE})) >= {rank.FLOOR})"""


def _numbered(spark: SparkSession, root: str, first: int | None = None) -> DataFrame:
    """The first so many documents, or all that are relevant enough."""
    docs = articles(spark, root).withColumn("score", F.expr(f"double({_SCORE})"))
    docs = docs if first else rank.relevant(docs, rank.FLOOR)
    docs = rank.numbered(docs, [F.desc("score"), F.desc("published"), F.asc("url")], *([first] if first else []))
    return docs.withColumn("partial", match.lede_only(F.col("text"))).withColumn("published", T.minute(F.col("published")))


@query("numbering_topk", f"with {_ARTICLES}, {_TOP} select n::int as n, url, round(score, 6)::double as score from top")
def numbering_topk(spark: SparkSession, root: str) -> DataFrame:
    return _numbered(spark, root, 20).select("n", "url", F.round("score", 6).alias("score"))


@query(
    "numbering_all",
    f"with {_ARTICLES} select doc_id, row_number() over (order by {_SCORE} desc, published desc, url) as n from articles",
)
def numbering_all(spark: SparkSession, root: str) -> DataFrame:
    docs = articles(spark, root).select("doc_id", "url", "published", F.expr(f"double({_SCORE})").alias("score"))
    return rank.numbered(docs, [F.desc("score"), F.desc("published"), F.asc("url")]).select("doc_id", "n")


@query(
    "corpus_text",
    f"""with {_ARTICLES}, {_KEPT} select n, ('=== ARTICLE ' || n || ' ===' || chr(10) || 'Source: ' || source || chr(10) || 'Published: ' || strftime(published, '%Y-%m-%d %H:%M')
    || chr(10) || 'Language: ' || lang || chr(10) || 'URL: ' || url || chr(10) || 'Relevance: ' || printf('%.3f', score::double) || chr(10)
    || case when partial then 'Note: lede only -- full text is behind the publisher''s paywall.' || chr(10) else '' end || 'Headline: ' || title || chr(10) || chr(10)
    || substr(text, 1, 6000) || case when length(text) > 6000 then ' …[truncated]' else '' end || chr(10)) as value from kept""",
)
def corpus_text(spark: SparkSession, root: str) -> DataFrame:
    """The corpus's entries, of every document that counts, in order."""
    return report.corpus_lines(_numbered(spark, root))


@query(
    "corpus_facts",
    f"""with {_ARTICLES}, {_KEPT} select (select count(*) from kept) as articles, string_agg(source || ' (' || k || ')', ', ' order by k desc, first_n) as outlets
    from (select source, count(*) as k, min(n) as first_n from kept group by source)""",
)
def corpus_facts(spark: SparkSession, root: str) -> DataFrame:
    return report.facts(_numbered(spark, root))


@query(
    "run_articles",
    f"""with {_ARTICLES} select url, source, title, lang, round(1 / (1 + exp(-{_SCORE})), 6) as relevance, {_WORDS.format('text')}::bigint as words from articles""",
)
def run_articles(spark: SparkSession, root: str) -> DataFrame:
    docs = articles(spark, root).withColumn("score", F.expr(f"double({_SCORE})"))
    return report.run_articles(docs).select("url", "source", "title", "lang", F.round("relevance", 6).alias("relevance"), "words")


@query(
    "csv_export",
    f"""with {_ARTICLES} select source, strftime(published, '%Y-%m-%d %H:%M') as published, title, url, printf('%.4f', 1 / (1 + exp(-{_SCORE}))) as relevance,
    {_WORDS.format('text')}::bigint as words, lang, case when lang = 'en' then text else '' end as text from articles""",
)
def csv_export(spark: SparkSession, root: str) -> DataFrame:
    docs = articles(spark, root).withColumn("score", F.expr(f"double({_SCORE})")).withColumn("published", T.minute(F.col("published")))
    bodies = docs.where("lang = 'en'").select("url", "text")
    return report.csv_rows(keys.with_bodies(report.run_articles(docs), bodies), with_text=True)


# ---------------------------------------------------------------- archive, harvest, stream

_RECORDS = f"""{_ARTICLES}, records as (select *, published::date as day from articles)"""


def _records(spark: SparkSession, root: str) -> DataFrame:
    return articles(spark, root).withColumn("day", F.col("published").cast("date"))


#: All orders stand for an archive with gaps: they lie on the day of the year that their key names, some of which have none.
_ORDERS = """records as (select (date '1992-01-01' + (o_orderkey * o_orderkey % 4001)::int)::date as day, o_orderpriority as source from orders)"""


def _orders(spark: SparkSession, root: str) -> DataFrame:
    day = F.expr("date_add(date'1992-01-01', cast(o_orderkey * o_orderkey % 4001 as int))")
    return table(spark, root, "orders").select(day.alias("day"), F.col("o_orderpriority").alias("source"))


@query("day_counts", f"with {_RECORDS} select day, source, count(*) as articles from records group by all")
def day_counts(spark: SparkSession, root: str) -> DataFrame:
    return archive.day_counts(_records(spark, root))


@query("missing_days", f"with {_ORDERS} select d::date as day from (select unnest(generate_series(min(day), max(day), interval 1 day)) as d from records) where d::date not in (select day from records)")
def missing_days(spark: SparkSession, root: str) -> DataFrame:
    return archive.missing_days(_orders(spark, root))


@query(
    "archive_status",
    f"""with {_ORDERS}, gaps as (select d::date as day from (select unnest(generate_series(min(day), max(day), interval 1 day)) as d from records) where d::date not in (select day from records))
    select count(distinct day) as days, min(day) as first_day, max(day) as last_day, count(*) as articles,
    (select string_agg(day::varchar, ',' order by day) from gaps) as missing from records""",
)
def archive_status(spark: SparkSession, root: str) -> DataFrame:
    return archive.status(_orders(spark, root)).withColumn("missing", F.array_join(F.transform("missing", lambda d: d.cast("string")), ","))


@query(
    "harvest_counters",
    """select source, count(*) as articles, count(*) filter (where doc_id in (select doc_id from labels)) as skipped,
    count(*) filter (where doc_id not in (select doc_id from labels) and n_chars >= 200) as new,
    count(*) filter (where doc_id not in (select doc_id from labels) and n_chars < 200) as failed from documents group by source""",
)
def harvest_counters(spark: SparkSession, root: str) -> DataFrame:
    found = articles(spark, root).withColumn("day", F.col("published").cast("date"))
    stored = found.join(table(spark, root, "labels").select("doc_id"), "doc_id", "left_semi").select(*found.columns)
    found = found.withColumn("text", F.when(F.length("text") < 200, "").otherwise(F.col("text")))
    return archive.harvest(found, stored)[1]


@query(
    "archive_round_trip",
    f"""with {_RECORDS} select url, source, title, text, {_WORDS.format('text')}::bigint as words, day::varchar as day, source as source_slug from records
    where day between date '2024-01-02' and date '2024-01-09' and source in ('src1', 'src2', 'src3')""",
)
def archive_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Written as gzipped JSON lines by day and source, and read by range and source."""
    path = new_path(spark, "archive")
    rows = _records(spark, root).select(
        "url", "source", F.col("lang").alias("language"), "title", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss").alias("published"),
        "text", T.word_count(F.col("text")).alias("words"), F.lit("").alias("fetched"), "day",
    )
    archive.write_days(rows, path)
    read = archive.read_range(spark, path, "2024-01-02", "2024-01-09", ["src1", "src2", "src3"])
    return read.select("url", "source", "title", "text", "words", F.col("day").cast("string").alias("day"), "source_slug")


@query(
    "daily_stream",
    """select ts::date as day, event_type as kind, count(*) as n, round(sum(value), 4) as total from events
    where ts::date < (select (max(ts) - interval 2 day)::date from events) group by all""",
)
def daily_stream(spark: SparkSession, root: str) -> DataFrame:
    """Daily counts as a stream in append mode: days that the watermark has passed."""
    source = table(spark, root, "events")
    staged = new_path(spark, "events")
    source.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(staged)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(staged)
    out = new_path(spark, "daily")
    counts = daily.daily_counts(stream, "ts", "event_type", "value")
    run = counts.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.parquet(out).withColumn("total", F.round("total", 4))


# ---------------------------------------------------------------- sitemaps, pages

_SITEMAP_PAGES = """s as (select page_id, url, page_id % 5 as shard, strftime(timestamp '2024-01-01' + to_hours(page_id * 5), '%Y-%m-%dT%H:%M:%SZ') as published from pages)"""


def sitemap_pages(spark: SparkSession, root: str) -> DataFrame:
    """A small sitemap tree made of the pages table: an index of five shards."""
    page = table(spark, root, "pages").withColumn("shard", F.col("page_id") % 5)
    time = F.date_format(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(page_id * 5 as int))"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    loc = F.concat(F.lit("<loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    news = F.concat(F.lit("<news:news><news:publication_date>"), F.when(F.col("page_id") % 4 == 0, "not a date").otherwise(time), F.lit("</news:publication_date><news:title> T"), "page_id", F.lit(" </news:title></news:news>"))
    entry = F.concat(F.lit("<url>"), loc, F.lit("<lastmod>"), time, F.lit("</lastmod>"), news, F.lit("</url>"))
    shards = page.groupBy("shard").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e"))))["e"], "").alias("body"))
    head = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9">'
    urlsets = shards.select(F.concat(F.lit("https://example.test/post-sitemap"), "shard", F.lit(".xml")).alias("url"), F.concat(F.lit(head), "body", F.lit("</urlset>")).alias("xml"))
    nested = "".join(f"<sitemap><loc>https://example.test/post-sitemap{k}.xml</loc></sitemap>" for k in range(5))
    nested += "<sitemap><loc>https://example.test/tag-sitemap.xml</loc></sitemap>"
    index = spark.range(1).select(F.lit("https://example.test/sitemap.xml").alias("url"), F.lit(f'<sitemapindex xmlns="x">{nested}</sitemapindex>').alias("xml"))
    return urlsets.unionByName(index)


@query("sitemap_urls", f"with {_SITEMAP_PAGES} select url as loc, 'T' || page_id as title, substr(published, 1, 16) as published from s")
def sitemap_urls(spark: SparkSession, root: str) -> DataFrame:
    rows = sitemap.sitemap_entries(sitemap_pages(spark, root)).where("kind = 'url'")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("published").cast("timestamp_ntz"))
    return rows.select("loc", "title", F.date_format(utc, "yyyy-MM-dd'T'HH:mm").alias("published"))


@query(
    "sitemap_discovery",
    f"""with {_SITEMAP_PAGES} select 'Example' as source, url, 'T' || page_id as title, 'xx' as language from s
    where published between '2024-01-03T00:00:00Z' and '2024-01-09T23:59:59Z' and (contains(lower(url), '/en/') or contains(lower(url), '/fr/'))
    qualify row_number() over (partition by url order by shard desc, page_id desc) = 1""",
)
def sitemap_discovery(spark: SparkSession, root: str) -> DataFrame:
    from pressmill.schema import SOURCE

    rows = [("Example", "xx", "https://example.test/sitemap.xml", None, ["/en/", "/fr/"], ["post-sitemap"])]
    zone = spark.conf.get("spark.sql.session.timeZone")
    pages = sitemap_pages(spark, root)
    if zone not in ("UTC", "Etc/UTC"):  # the window is of days in the session's zone
        pages = pages.withColumn("xml", F.regexp_replace("xml", "Z<", "<"))
    found = sitemap.discover(spark.createDataFrame(rows, SOURCE), pages, "2024-01-03", "2024-01-09")
    return found.select("source", "url", "title", "language")


@query(
    "dated_sitemaps",
    """select d::date as day, 'https://example.test/news-' || strftime(d, '%d-%m-%Y') || '.xml' as sitemap
    from (select unnest(generate_series(date '2024-02-27', date '2024-03-03', interval 1 day)) as d)""",
)
def dated_sitemaps(spark: SparkSession, root: str) -> DataFrame:
    return sitemap.dated_sitemaps(sitemap.days_between(spark, "2024-02-27", "2024-03-03"), "day", "https://example.test/news-%d-%m-%Y.xml")


@query("extract_archive")
def extract_archive(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", pages_html.extract_archive("html").alias("x")).select("page_id", "x.*")


@query("extract_live")
def extract_live(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", pages_html.extract_live("html").alias("x")).select("page_id", "x.*")


@query("live_matches")
def live_matches(spark: SparkSession, root: str) -> DataFrame:
    """The match table of a live run over the pages: half of them titled by their sitemap."""
    pages = table(spark, root, "pages")
    candidates = pages.select(
        F.lit("Example").alias("source"), F.lit(0).alias("source_index"), F.col("page_id").alias("position"), "url",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(page_id as int))").alias("published"),
        F.when(F.col("page_id") % 2 == 0, F.regexp_extract("html", "<title>([^<]*)", 1)).otherwise("").alias("title"),
        F.lit("").alias("keywords"), F.lit("en").alias("language"),
    )
    return live.ordered(live.candidates_matched(candidates, pages, ["thing", "de", "en"]))


@query("live_documents")
def live_documents(spark: SparkSession, root: str) -> DataFrame:
    return live.documents(live_matches(spark, root), table(spark, root, "pages"), min_words=30)



@query(
    "robots_filter",
    r"""select url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as host,
    case when contains(url, '.example.com') then 3.0 else 2.0 end::double as delay from pages
    where not (contains(url, '.example.com') and regexp_matches(url, '://[^/]*/fr/'))""",
)
def robots_filter(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "pages").select("url")
    hosts = pages.select(T.url_host(F.col("url")).alias("host")).distinct()
    rules = F.when(F.col("host").endswith(".example.com"), "User-agent: *\nDisallow: /fr/\nCrawl-delay: 3").when(F.col("host").endswith(".example.net"), "")
    return stored_pages.allowed(pages, hosts.withColumn("robots", rules))
