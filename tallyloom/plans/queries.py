"""The operators bound to the standard tables, each with the SQL that gives the same rows.

Bindings: organization = nation, member = supplier, protected row = customer; job = orders;
ledger = events; page input = pages; snapshots = orders per customer.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import dates, text, urls
from tallyloom.operators import changes, constraints, entities, extract, history, jobs, keygraph, ledger, reports, retention, search, security
from tallyloom.sources.shared import shared_path
from tallyloom.sources.tables import parse_requests, read_csv, table, to_response, write_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SPACE = text.JS_SPACE
_TRIMMED = f"regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
AS_OF = "1996-06-30"
_LEDGER_KINDS = {"purchase": "debit", "signup": "credit", "error": "refund"}


def query(sql: str) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


# Search, labels, top-k


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Ready' WHEN 'O' THEN 'Researching' ELSE 'Needs review' END AS label, o_orderdate
FROM orders WHERE contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderstatus), 'urgent') ORDER BY o_orderdate DESC, o_orderkey LIMIT 4""")
def search_recent(spark, sf):
    found = search.search(table(spark, sf, "orders"), "Urgent", ["o_orderpriority", "o_orderstatus"])
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "researching").otherwise("failed")
    top = reports.newest(found, [F.desc("o_orderdate"), F.col("o_orderkey")])
    return top.select("o_orderkey", reports.status_label(status).alias("label"), "o_orderdate")


def _search(q: str):
    return lambda spark, sf: search.search(table(spark, sf, "customer"), q, ["c_name", "c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


for _name, _q in (("search_contains", "BuIlD"), ("search_literal_wildcards", "%_"), ("search_empty", "")):
    QUERIES[_name] = _search(_q)
    ORACLE_SQL[_name] = f"SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), lower('{_q}')) OR contains(lower(c_mktsegment), lower('{_q}'))"


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS ready, count(*) AS n FROM orders")
def ready_count(spark, sf):
    return table(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("ready"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 4")
def recent_top4(spark, sf):
    return reports.newest(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), [F.desc("o_orderdate"), F.col("o_orderkey")])


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_suppkey = 3 ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 4")
def tenant_newest(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey")
    return reports.newest_of(rows, "l_suppkey", 3, [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_suppkey")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 4""")
def tenants_newest(spark, sf):
    """The four newest rows of every supplier at once."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return reports.newest_of_each(rows, "l_suppkey", [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")])


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey OFFSET 1")
def skip_first(spark, sf):
    return table(spark, sf, "region").orderBy("r_regionkey").offset(1)


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Ready' WHEN 'O' THEN 'Researching' ELSE 'Needs review' END AS label3,
CASE o_orderstatus WHEN 'F' THEN 'Ready' ELSE 'Needs review' END AS label2 FROM orders""")
def status_labels(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "researching").otherwise("failed")
    return table(spark, sf, "orders").select("o_orderkey", reports.status_label(status).alias("label3"), reports.status_label_short(status).alias("label2"))


@query("SELECT doc_id, CASE WHEN doc_id % 101 >= 80 THEN 'verified' ELSE 'review' END AS tier, CAST(doc_id % 101 AS VARCHAR) || '%' AS bar FROM documents")
def confidence_tier(spark, sf):
    c = F.col("doc_id") % 101
    return table(spark, sf, "documents").select("doc_id", reports.confidence_tier(c).alias("tier"), reports.percent(c).alias("bar"))


_KINDS = ("email", "phone", "linkedin", "whatsapp", "website", "social", "news", "directory")


@query("""WITH k AS (SELECT event_id, ['email', 'phone', 'linkedin', 'whatsapp', 'website', 'social', 'news', 'directory'][event_id % 8 + 1] AS kind FROM events)
SELECT event_id, CASE WHEN kind IN ('email', 'phone', 'linkedin', 'whatsapp') THEN kind ELSE 'globe' END AS contact_icon,
CASE kind WHEN 'social' THEN 'social' WHEN 'news' THEN 'news' ELSE 'globe' END AS source_icon FROM k""")
def icons(spark, sf):
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf, "events").select("event_id", reports.contact_icon(kind).alias("contact_icon"), reports.source_icon(kind).alias("source_icon"))


# Text and URLs


@query(f"SELECT doc_id, substr({_TRIMMED}, 1, 140) AS cut, length(coalesce(substr({_TRIMMED}, 1, 140), '')) AS n FROM documents")
def as_text(spark, sf):
    cut = text.as_text(F.col("text"), 140)
    return table(spark, sf, "documents").select("doc_id", cut.alias("cut"), F.length(cut).cast("long").alias("n"))


@query("""SELECT page_id, CASE WHEN host IN ('localhost', '127.0.0.1', '0.0.0.0', '::1') THEN '' ELSE scheme || '://' || host
|| CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
|| CASE WHEN path = '' THEN '/' ELSE path END || rest END AS url
FROM (SELECT page_id, lower(regexp_extract(url, '^(\\w+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host,
regexp_extract(url, '://[^/?#:]*:([0-9]*)', 1) AS port, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '([?#].*)$', 1) AS rest FROM pages)""")
def normalize_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"))


@query("""SELECT page_id, regexp_replace(url, '^https?://', '') AS shown,
regexp_replace(split_part(split_part(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '/', 1), '.', 1), '[-_]', ' ', 'g') AS name,
regexp_replace(regexp_replace(url, '^https?://', ''), '/.*$', '', 's') AS domain FROM pages""")
def url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", urls.strip_scheme(u).alias("shown"), text.name_from_url(u).alias("name"), urls.domain_or_slug(u, F.lit("")).alias("domain")
    )


@query("""WITH w AS (SELECT p_partkey, list_transform(list_filter(string_split(p_name, ' '), lambda x: x <> ''), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)) AS words FROM part)
SELECT p_partkey, array_to_string(words, ' ') AS title, coalesce(nullif(upper(array_to_string(list_transform(words[1:2], lambda x: substr(x, 1, 1)), '')), ''), 'CR') AS initials FROM w""")
def title_and_initials(spark, sf):
    title = text.title_case(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", title.alias("title"), text.initials(title).alias("initials"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(lower(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents""")
def slugify(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("""SELECT p_partkey, 'https://www.google.com/search?q=' || replace(replace(replace(replace(replace(url_encode(p_name || ' (a''b)!~*'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS url FROM part""")
def search_url(spark, sf):
    name = F.concat("p_name", F.lit(" (a'b)!~*"))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("https://www.google.com/search?q="), text.encode_component(name)).alias("url"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/vi' WHEN 1 THEN '/en/x' WHEN 2 THEN '/english' ELSE NULL END AS path, CASE page_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS loc FROM pages)
SELECT page_id, '/en' || regexp_replace(coalesce(path, '/vi'), '^/(vi|en)(/|$)', '\\2') AS swapped, CASE WHEN loc = 'en' THEN 'en' ELSE 'vi' END AS locale, coalesce(loc IN ('vi', 'en'), false) AS known FROM p""")
def locale_path(spark, sf):
    k = F.col("page_id")
    path = F.when(k % 4 == 0, "/vi").when(k % 4 == 1, "/en/x").when(k % 4 == 2, "/english")
    loc = F.when(k % 3 == 0, "en").when(k % 3 == 1, "de")
    return table(spark, sf, "pages").select(
        "page_id", text.locale_path(path, "en").alias("swapped"), text.locale_or_default(loc).alias("locale"), text.is_locale(loc).alias("known")
    )


# Requests and reports


def _requests(spark, sf):
    """Requests from pages: a third without a URL, a third without a name."""
    k = F.col("page_id")
    name = F.when(k % 3 == 1, F.concat(F.lit("nova đại "), k.cast("string")))
    return table(spark, sf, "pages").select(
        "page_id", name.alias("company_name"), F.when(k % 3 == 2, F.col("url")).alias("source_url"), F.when(k % 2 == 0, " Japan ").alias("country")
    )


@query("SELECT page_id, page_id % 3 <> 0 AS accepted FROM pages")
def input_guard(spark, sf):
    cleaned = reports.clean_requests(_requests(spark, sf))
    return cleaned.select("page_id", reports.has_input(F.col("company_name"), F.col("source_url")).alias("accepted"))


_REPORT = """WITH r AS (SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'Nova Đại ' || page_id
  ELSE array_to_string(list_transform(list_filter(string_split(regexp_replace(split_part(split_part(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '/', 1), '.', 1), '[-_]', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') END AS name,
  CASE WHEN page_id % 3 = 2 THEN split_part(regexp_replace(url, '^https?://', ''), '/', 1) ELSE 'nova-dai-' || page_id || '.example' END AS domain,
  CASE WHEN page_id % 2 = 0 THEN 'Japan' ELSE 'Chưa xác định' END AS country, page_id % 3 = 2 AS linked FROM pages WHERE page_id % 3 <> 0)
"""


@query(_REPORT + """SELECT page_id, name AS company_name, country, domain AS website, CASE WHEN linked THEN 91 ELSE 84 END AS confidence, '30/7/1996' AS expires_at,
CAST(30 AS INTEGER) AS days_left, CAST(3 AS INTEGER) AS n_contacts, CAST(CASE WHEN linked THEN 1 ELSE 0 END AS INTEGER) AS n_verified, CAST(2 AS INTEGER) AS n_sources FROM r""")
def build_report(spark, sf):
    good, _ = reports.split_requests(reports.clean_requests(_requests(spark, sf)))
    built = reports.build_reports(good, F.lit(AS_OF).cast("timestamp"))
    return built.select(
        "page_id", "company_name", "country", "website", "confidence", "expires_at", "days_left", F.size("contacts").alias("n_contacts"),
        F.size(reports.verified_contacts(F.col("contacts"))).alias("n_verified"), F.size("sources").alias("n_sources"),
    )


@query(_REPORT + """SELECT page_id, 'CÔNG TY: ' || name || chr(10) || 'Quốc gia: ' || country || chr(10) || 'Ngành: Đang chờ phân loại' || chr(10) || 'Độ tin cậy: ' || CASE WHEN linked THEN 91 ELSE 84 END || '/100' || chr(10)
|| 'Website: ' || domain || chr(10) || 'KÊNH KINH DOANH ĐÃ XÁC MINH:' || CASE WHEN linked THEN chr(10) || '• Website tham chiếu: ' || domain ELSE '' END || chr(10) || 'NGUỒN:' || chr(10)
|| CASE WHEN linked THEN '• Link bạn đã cung cấp: ' || url ELSE '• Candidate website: https://' || domain END || chr(10)
|| '• Search discovery: https://www.google.com/search?q=' || replace(replace(replace(replace(replace(url_encode(name), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') || chr(10)
|| 'Snapshot: Vừa xong · lưu đến 30/7/1996' AS summary FROM r JOIN pages USING (page_id)""")
def clipboard_summary(spark, sf):
    good, _ = reports.split_requests(reports.clean_requests(_requests(spark, sf)))
    built = reports.build_reports(good, F.lit(AS_OF).cast("timestamp"))
    return built.select("page_id", reports.summary("vi").alias("summary"))


@query(_REPORT + """SELECT page_id, 'COMPANY: ' || name || chr(10) || 'Country: ' || country || chr(10) || 'Industry: Đang chờ phân loại' || chr(10) || 'Confidence: ' || CASE WHEN linked THEN 91 ELSE 84 END || '/100' || chr(10)
|| 'Website: ' || domain || chr(10) || 'VERIFIED BUSINESS CHANNELS:' || CASE WHEN linked THEN chr(10) || '• Website tham chiếu: ' || domain ELSE '' END || chr(10) || 'SOURCES:' || chr(10)
|| CASE WHEN linked THEN '• Link bạn đã cung cấp: ' || url ELSE '• Candidate website: https://' || domain END || chr(10)
|| '• Search discovery: https://www.google.com/search?q=' || replace(replace(replace(replace(replace(url_encode(name), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') || chr(10)
|| 'Snapshot: Vừa xong · stored until 30/7/1996' AS summary FROM r JOIN pages USING (page_id)""")
def clipboard_summary_whole(spark, sf):
    good, _ = reports.split_requests(reports.clean_requests(_requests(spark, sf)))
    built = reports.build_reports(good, F.lit(AS_OF).cast("timestamp"))
    return built.select("page_id", reports.summary("en").alias("summary"))


@query(_REPORT + """SELECT page_id, unnest(CASE WHEN linked THEN ['website:true', 'linkedin:false', 'email:false'] ELSE ['website:false', 'linkedin:false', 'email:false'] END) AS contact FROM r""")
def contact_rows(spark, sf):
    good, _ = reports.split_requests(reports.clean_requests(_requests(spark, sf)))
    rows = reports.build_reports(good, F.lit(AS_OF).cast("timestamp")).select("page_id", F.explode("contacts").alias("c"))
    return rows.select("page_id", F.concat("c.type", F.lit(":"), F.col("c.verified").cast("string")).alias("contact"))


_SLUG = "CASE WHEN linked THEN regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') ELSE 'nova-dai-' || page_id END"


@query(_REPORT + f""", p AS (SELECT page_id, unnest([
{{'part': 'contact', 'label': 'Website tham chiếu', 'value': domain, 'kind': 'website', 'verified': linked, 'copyable': true, 'source': CASE WHEN linked THEN 'Link người dùng cung cấp' ELSE 'Candidate discovery' END}},
{{'part': 'contact', 'label': 'LinkedIn công ty', 'value': 'linkedin.com/company/' || {_SLUG}, 'kind': 'linkedin', 'verified': false, 'copyable': true, 'source': 'Candidate discovery'}},
{{'part': 'contact', 'label': 'Email kinh doanh', 'value': 'Chưa xác minh', 'kind': 'email', 'verified': false, 'copyable': false, 'source': 'Chưa có evidence'}},
{{'part': 'source', 'label': CASE WHEN linked THEN 'Link bạn đã cung cấp' ELSE 'Candidate website' END, 'value': CASE WHEN linked THEN url ELSE 'https://' || domain END, 'kind': 'website', 'verified': linked, 'copyable': NULL, 'source': NULL}},
{{'part': 'source', 'label': 'Search discovery', 'value': 'https://www.google.com/search?q=' || url_encode(name), 'kind': 'directory', 'verified': NULL, 'copyable': NULL, 'source': NULL}},
{{'part': 'signal', 'label': CASE WHEN linked THEN 'Có link tham chiếu' ELSE 'Tìm bằng tên công ty' END, 'value': NULL, 'kind': NULL, 'verified': NULL, 'copyable': NULL, 'source': NULL}},
{{'part': 'signal', 'label': CASE WHEN linked THEN 'Cần chạy connector thật để xác minh' ELSE 'Nên bổ sung quốc gia để tăng độ chính xác' END, 'value': NULL, 'kind': NULL, 'verified': NULL, 'copyable': NULL, 'source': NULL}},
{{'part': 'report', 'label': 'report-' || epoch_ms(TIMESTAMP '1996-06-30'), 'value': '#4F7CFF18', 'kind': 'ready', 'verified': NULL, 'copyable': NULL, 'source': NULL}}
]) AS x FROM r JOIN pages USING (page_id)) SELECT page_id, x.part AS part, x.label AS label, x.value AS value, x.kind AS kind, x.verified AS verified, x.copyable AS copyable, x.source AS source FROM p""")
def report_parts(spark, sf):
    """Every contact, source and signal of the built reports, and their ids and tints."""
    good, _ = reports.split_requests(reports.clean_requests(_requests(spark, sf)))
    built = reports.build_reports(good, F.lit(AS_OF).cast("timestamp"))
    none = lambda kind: F.lit(None).cast(kind)
    part = lambda name, label, value, kind, verified, copyable, source: F.struct(
        F.lit(name).alias("part"), label.alias("label"), value.alias("value"), kind.alias("kind"), verified.alias("verified"), copyable.alias("copyable"), source.alias("source")
    )
    contacts = F.transform("contacts", lambda c: part("contact", c["label"], c["value"], c["type"], c["verified"], reports.can_copy(c["value"]), c["source"]))
    sources = F.transform("sources", lambda s: part("source", s["label"], s["url"], s["kind"], s["verified"], none("boolean"), none("string")))
    signals = F.transform("signals", lambda s: part("signal", s, none("string"), none("string"), none("boolean"), none("boolean"), none("string")))
    own = F.array(part("report", F.col("id"), reports.tint(F.col("accent")), F.col("status"), none("boolean"), none("boolean"), none("string")))
    return built.select("page_id", F.inline(F.concat(contacts, sources, signals, own)))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN url <> '' ELSE false END AS accepted FROM pages""")
def mode_guard(spark, sf):
    k = F.col("page_id")
    mode = F.when(k % 2 == 0, "name").otherwise("url")
    name = F.when(k % 4 == 0, " x ").when(k % 4 == 2, " \t\u00a0")
    url = F.when(k % 4 == 1, F.col("url"))
    return table(spark, sf, "pages").select("page_id", reports.has_input_for(mode, name, url).alias("accepted"))


@query("SELECT event_id, CAST([12, 36, 68, 91][event_id % 5 + 1] AS INTEGER) AS progress FROM events")
def progress_steps(spark, sf):
    return table(spark, sf, "events").select("event_id", reports.progress((F.col("event_id") % 5).cast("int")).alias("progress"))


@query("""SELECT 'BUILDING' AS q, false AS empty UNION ALL SELECT 'no such segment', true""")
def empty_result(spark, sf):
    found = lambda q: reports.nothing_found(_search(q)(spark, sf)).select(F.lit(q).alias("q"), "empty")
    return found("BUILDING").unionAll(found("no such segment"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'Acme ' || page_id END AS company_name, CASE WHEN page_id % 4 = 1 THEN NULL ELSE url END AS source_url FROM pages WHERE page_id % 5 <> 0""")
def parse_request_json(spark, sf):
    k = F.col("page_id")
    name = F.when(k % 4 == 0, F.lit("17")).otherwise(F.concat(F.lit('"Acme '), k.cast("string"), F.lit('"')))
    url = F.when(k % 4 == 1, F.lit("null")).otherwise(F.to_json(F.array("url")).substr(F.lit(2), F.length(F.to_json(F.array("url"))) - 2))
    body = F.when(k % 5 == 0, "{bad").otherwise(F.concat(F.lit('{"companyName":'), name, F.lit(',"sourceUrl":'), url, F.lit("}")))
    good, _ = parse_requests(table(spark, sf, "pages").select("page_id", body.alias("body")))
    return good.select("page_id", "company_name", "source_url")


@query("""SELECT '{"report":{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"},"mode":"demo","creditsCharged":5}' AS response FROM nation""")
def response_json(spark, sf):
    return to_response(table(spark, sf, "nation").select("n_nationkey", "n_name"), reports.CREDITS_PER_REPORT)


@query("""SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'a, "b" ' || page_id WHEN 1 THEN chr(10) || ' é;' WHEN 2 THEN 'back\\slash' END AS note FROM pages""")
def csv_round_trip(spark, sf):
    """Pages written as CSV and read back: separators, quotes, line breaks, backslashes and nulls stay."""
    k = F.col("page_id")
    note = F.when(k % 4 == 0, F.concat(F.lit('a, "b" '), k.cast("string"))).when(k % 4 == 1, "\n é;").when(k % 4 == 2, "back\\slash")
    rows, path = table(spark, sf, "pages").select("page_id", "url", note.alias("note")), shared_path(spark, "csv")
    write_csv(rows, path)
    return read_csv(spark, path, rows.schema)


@query("""SELECT CAST(0 AS INTEGER) AS seq, o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_orderkey % 2 = 1""")
def prepend_union(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return reports.prepend(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"))


# Dates


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS expires, strftime(CAST(o_orderdate AS DATE) + 30, '%-d/%-m/%Y') AS shown, date_diff('day', DATE '1996-06-30', CAST(o_orderdate AS DATE) + 30) AS days_left FROM orders")
def expiry(spark, sf):
    e = dates.expiry_date(F.col("o_orderdate"))
    left = dates.days_left(e, F.lit(AS_OF).cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", e.alias("expires"), dates.short_date(e).alias("shown"), left.cast("long").alias("days_left"))


@query("""SELECT count(*) FILTER (l_shipdate < TIMESTAMP '1996-06-30') AS purged, count(*) FILTER (l_shipdate >= TIMESTAMP '1996-06-30') AS kept FROM lineitem""")
def retention_split(spark, sf):
    gone = F.coalesce(dates.is_expired(F.col("l_shipdate"), _as_of()), F.lit(False))
    return table(spark, sf, "lineitem").agg(F.count_if(gone).alias("purged"), F.count_if(~gone).alias("kept"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-06-30'")
def retention_kept(spark, sf):
    keep, _ = history.split_expired(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate", _as_of())
    return keep


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-06-30'")
def retention_purged(spark, sf):
    _, purge = history.split_expired(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate", _as_of())
    return purge


@query("""WITH r AS (SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS ends FROM orders),
e AS (SELECT l_orderkey, l_linenumber, l_partkey, least(l_shipdate + INTERVAL 90 DAY, ends) AS ends FROM lineitem LEFT JOIN r ON l_orderkey = o_orderkey)
SELECT 'report' AS tbl, o_orderkey AS k, CAST(NULL AS INTEGER) AS l, CAST(NULL AS BIGINT) AS p, ends FROM r WHERE ends >= TIMESTAMP '1996-06-30'
UNION ALL SELECT 'evidence', l_orderkey, l_linenumber, l_partkey, ends FROM e WHERE ends >= TIMESTAMP '1996-06-30'""")
def purge_store(spark, sf):
    """What two stores, orders as reports and their lines as evidence, hold after a purge that is run twice."""
    reports_ = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("ends"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", (F.col("l_shipdate") + F.make_dt_interval(F.lit(90))).alias("ends"))
    left = []
    for name, rows in (("report", reports_), ("evidence", retention.with_report(lines, reports_, "o_orderkey", "ends"))):
        path = shared_path(spark, f"{name}-store")
        retention.store(rows, path, "ends", "month")
        for _ in range(2):
            retention.purge(spark, path, rows.schema, "ends", dt.datetime.fromisoformat(AS_OF), "month")
        left.append(retention.read_store(spark, path, rows.schema))
    none = lambda kind: F.lit(None).cast(kind)
    shown = left[0].select(F.lit("report").alias("tbl"), F.col("o_orderkey").alias("k"), none("int").alias("l"), none("long").alias("p"), "ends")
    return shown.unionAll(left[1].select(F.lit("evidence"), "o_orderkey", "l_linenumber", "l_partkey", "ends"))


@query("""SELECT count(*) FILTER (l_returnflag <> 'R' AND l_shipdate >= TIMESTAMP '1996-06-30') AS active,
count(*) FILTER (l_returnflag <> 'R' AND l_shipdate BETWEEN TIMESTAMP '1996-06-30' AND TIMESTAMP '1996-07-29') AS expiring, count(*) FILTER (l_returnflag = 'R') AS archived FROM lineitem""")
def expiring_counts(spark, sf):
    return history.lifecycle_counts(table(spark, sf, "lineitem"), "l_shipdate", F.col("l_returnflag") == "R", _as_of())


@query("SELECT o_orderkey, least(CASE o_orderkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 90 ELSE 365 END, CASE WHEN o_orderkey % 2 = 0 THEN 60 END) AS days FROM orders")
def effective_retention(spark, sf):
    k = F.col("o_orderkey")
    plan = F.when(k % 3 == 0, dates.PLAN_DAYS[0]).when(k % 3 == 1, dates.PLAN_DAYS[1]).otherwise(dates.PLAN_DAYS[2])
    return table(spark, sf, "orders").select("o_orderkey", dates.effective_retention(plan, F.when(k % 2 == 0, 60)).alias("days"))


@query("""SELECT o_orderkey, unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 180 DAY, CASE o_orderkey % 3 WHEN 0 THEN INTERVAL 30 DAY WHEN 1 THEN INTERVAL 60 DAY ELSE INTERVAL 90 DAY END)) AS due FROM orders""")
def monitor_schedule(spark, sf):
    k = F.col("o_orderkey")
    every = F.when(k % 3 == 0, 30).when(k % 3 == 1, 60).otherwise(90)
    start = F.col("o_orderdate")
    out = history.schedule(table(spark, sf, "orders"), start, start + F.make_dt_interval(F.lit(180)), every)
    return out.select("o_orderkey", "due")


@query("""SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1996-06-30' THEN 'expired' WHEN o_orderkey % 2 = 0 THEN 'ready' END AS status,
NOT o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1996-06-30' AS is_current FROM orders""")
def expired_status(spark, sf):
    status, ends = F.when(F.col("o_orderkey") % 2 == 0, "ready"), F.col("o_orderdate") + F.make_dt_interval(F.lit(30))
    marked = history.mark_expired(table(spark, sf, "orders").select("o_orderkey", status.alias("status"), ends.alias("ends")), "status", "ends", _as_of()).drop("ends")
    shown = history.current(marked, "status").withColumn("is_current", F.lit(True))
    return shown.unionByName(marked.where("status = 'expired'").withColumn("is_current", F.lit(False)))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 365 WHEN o_orderdate >= TIMESTAMP '1994-01-01' THEN 90
WHEN o_custkey % 2 = 0 THEN 30 END AS INTEGER) AS days FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_custkey % 10 = 0""")
def retention_as_of(spark, sf):
    """Reports with the retention that their owner had set when they were captured."""
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")).where("o_custkey % 10 <> 0")
    since = lambda day, days: owners.select("o_custkey", F.lit(day).cast("timestamp_ntz").alias("since"), F.lit(days).alias("days"))
    settings = since("1994-01-01", 90).unionAll(since("1997-01-01", 365)).unionAll(since("1900-01-01", 30).where("o_custkey % 2 = 0"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return history.setting_at(rows, settings, "o_custkey", "o_orderdate", "since", "days").select("o_orderkey", "days")


# Row security


def _members(spark, sf):
    s = F.col("s_suppkey")
    role = F.when(s % 4 == 0, "owner").when(s % 4 == 1, "admin").when(s % 4 == 2, "member").otherwise("viewer")
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), (s % 7).alias("user_id"), role.alias("role"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 7 = 3)")
def rls_member(spark, sf):
    return security.member_rows(table(spark, sf, "customer"), _members(spark, sf), 3, "c_nationkey").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 7 = 3 AND s_suppkey % 4 IN (0, 1))")
def rls_admin(spark, sf):
    return security.admin_rows(table(spark, sf, "customer"), _members(spark, sf), 3, "c_nationkey").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def rls_self(spark, sf):
    return security.own_rows(table(spark, sf, "customer").select("c_custkey", "c_name"), 7, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 5 = 3 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 7 = 3)")
def rls_insert(spark, sf):
    batch = table(spark, sf, "customer").withColumn("created_by", F.col("c_custkey") % 5)
    return security.insertable_rows(batch, _members(spark, sf), 3, "c_nationkey").select("c_custkey")


#: Which rule guards each table's commands, written out again for the SQL.
_POLICY_ROWS = [
    ("profiles", "select", "own"), ("profiles", "update", "own"), ("organizations", "select", "member"), ("organization_members", "select", "member"),
    ("research_jobs", "select", "member"), ("research_jobs", "update", "member"), ("company_reports", "select", "member"), ("company_reports", "insert", "member"),
    ("company_reports", "update", "member"), ("company_reports", "delete", "member"), ("source_evidence", "select", "member"), ("source_evidence", "insert", "member"),
    ("source_evidence", "update", "member"), ("source_evidence", "delete", "member"), ("credit_ledger", "select", "member"), ("organizations", "update", "admin"),
    ("organization_members", "insert", "admin"), ("organization_members", "update", "admin"), ("organization_members", "delete", "admin"), ("research_jobs", "insert", "insertable"),
]
_GUARD_SQL = {
    "own": "c_nationkey = 3", "member": "EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 7 = 3)",
    "admin": "EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 7 = 3 AND s_suppkey % 4 IN (0, 1))",
    "insertable": "c_custkey % 5 = 3 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 7 = 3)",
}


@query(" UNION ALL ".join(f"SELECT '{t} {c}' AS policy, c_custkey FROM customer WHERE {_GUARD_SQL[g]}" for t, c, g in _POLICY_ROWS))
def rls_policies(spark, sf):
    """What user 3 may touch, for each table and command, in one pass; customers stand for each table's rows."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 5).alias("created_by"))
    allowed = security.permissions(rows, _members(spark, sf), 3, "c_nationkey")
    return allowed.select(F.explode("policies").alias("policy"), "c_custkey")


# Constraints and keys


_CHOICES = {
    "plan": ("starter", "pro", "team", "enterprise", "free"), "status": ("queued", "researching", "ready", "needs_review", "failed", "expired", "lost"),
    "kind": ("website", "directory", "social", "news", "registry", "customer_input", "email"), "type": ("credit", "debit", "refund", "adjustment", "gift"),
    "role": ("owner", "admin", "member", "viewer", "boss"),
}


@query(" UNION ALL ".join(f"SELECT '{d} in {d}' AS rule, count(*) FILTER (o_orderkey % {len(v)} = {len(v) - 1}) AS violations FROM orders" for d, v in _CHOICES.items())
+ " UNION ALL SELECT 'positive', count(*) FILTER (o_orderkey % 3 = 0) FROM orders UNION ALL SELECT 'given', count(*) FILTER (o_orderkey % 4 = 0) FROM orders")
def enum_violations(spark, sf):
    k = F.col("o_orderkey")
    pick = {d: F.get(F.array(*map(F.lit, v)), (k % len(v)).cast("int")) for d, v in _CHOICES.items()}
    rows = table(spark, sf, "orders").select(*(c.alias(d) for d, c in pick.items()), (k % 3).alias("amount"), F.when(k % 4 != 0, k).alias("given"))
    checks = constraints.in_domains({d: d for d in _CHOICES}) | {"positive": constraints.positive(F.col("amount"))}
    return constraints.violations(rows, checks).unionAll(constraints.nulls(rows, ["given"]))



@query("""SELECT 'balance' AS rule, count(*) FILTER (NOT (s_acctbal >= 0)) AS violations FROM supplier UNION ALL SELECT 'share', count(*) FILTER (NOT (s_acctbal BETWEEN 0 AND 3650)) FROM supplier
UNION ALL SELECT 'region', count(*) FILTER (NOT (s_nationkey IN (1, 2, 3))) FROM supplier UNION ALL SELECT 'named', count(*) FILTER (s_name IS NULL) FROM supplier""")
def check_violations(spark, sf):
    b = F.col("s_acctbal")
    rules = {
        "balance": constraints.not_negative(b), "share": constraints.in_range(b, 0, 3650),
        "region": constraints.one_of(F.col("s_nationkey"), (1, 2, 3)), "named": constraints.any_given(F.col("s_name")),
    }
    return constraints.violations(table(spark, sf, "supplier"), rules)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 10 <> 0)")
def fk_orphans(spark, sf):
    parent = table(spark, sf, "customer").where("c_custkey % 10 <> 0")
    return constraints.orphans(table(spark, sf, "orders"), parent, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf):
    return constraints.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 25 <> o_custkey % 25""")
def tenant_mismatch(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), "l_linenumber", "l_suppkey", (F.col("l_suppkey") % 25).alias("org"))
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 25).alias("org"))
    return constraints.tenant_mismatch(rows, jobs, "job", "org").select(F.col("job").alias("l_orderkey"), "l_linenumber", "l_suppkey")


# Inserts and deletes


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL
SELECT c_custkey, 'new ' || c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0""")
def insert_if_absent(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("new "), F.col("c_custkey").cast("string")).alias("c_name"))
    again = new.withColumn("c_name", F.concat("c_name", F.lit(" again")))
    return changes.insert_if_absent(c.where("c_custkey % 3 <> 0"), new.unionAll(again), "c_custkey", ["c_name"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 10 <> 0")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "customer").where("c_custkey % 10 = 0")
    return changes.cascade_delete(table(spark, sf, "orders"), gone, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS o_custkey FROM orders")
def set_null_delete(spark, sf):
    gone = table(spark, sf, "customer").where("c_custkey % 10 = 0")
    return changes.set_null_delete(table(spark, sf, "orders"), gone, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 10 = 0")
def restrict_delete(spark, sf):
    gone = table(spark, sf, "customer").where("c_custkey % 10 = 0")
    return changes.restricted(table(spark, sf, "orders"), gone, "o_custkey", "c_custkey")


_GRAPH = (
    keygraph.Reference("customer", "c_nationkey", "nation", "cascade", "n_nationkey"), keygraph.Reference("orders", "o_custkey", "customer", "cascade", "c_custkey"),
    keygraph.Reference("lineitem", "l_orderkey", "orders", "cascade", "o_orderkey"), keygraph.Reference("supplier", "s_nationkey", "nation", "set null", "n_nationkey"),
    keygraph.Reference("contract", "s_nationkey", "nation", "restrict", "n_nationkey"),
)


@query("""WITH contract AS (SELECT s_nationkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 8), asked AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (1, 2)),
dead AS (SELECT k FROM asked WHERE k NOT IN (SELECT s_nationkey FROM contract)), c AS (SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT k FROM dead)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT k FROM dead)))
SELECT 'refused' AS tbl, CAST(k AS BIGINT) AS k, CAST(NULL AS BIGINT) AS l FROM asked WHERE k IN (SELECT s_nationkey FROM contract)
UNION ALL SELECT 'nation', n_nationkey, NULL FROM nation WHERE n_nationkey NOT IN (SELECT k FROM dead)
UNION ALL SELECT 'supplier', s_suppkey, CASE WHEN s_nationkey NOT IN (SELECT k FROM dead) THEN s_nationkey END FROM supplier
UNION ALL SELECT 'customer', c_custkey, NULL FROM c UNION ALL SELECT 'orders', o_orderkey, NULL FROM o
UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT k FROM dead)))""")
def delete_graph(spark, sf):
    """What is left of five tables when the nations of two regions are deleted; nations of the eight richest suppliers are held back."""
    tables = {t: table(spark, sf, t) for t in ("nation", "customer", "orders", "lineitem", "supplier")}
    tables["contract"] = reports.newest(tables["supplier"], [F.desc("s_acctbal"), F.col("s_suppkey")], 8).select("s_nationkey")
    done = keygraph.delete(tables, "nation", tables["nation"].where("n_regionkey IN (1, 2)").select("n_nationkey"), _GRAPH)
    row = lambda df, name, k, l=F.lit(None): df.select(F.lit(name).alias("tbl"), F.col(k).cast("long").alias("k"), l.cast("long").alias("l"))  # noqa: E731, E741
    left = done.tables
    parts = [
        row(done.refused, "refused", "n_nationkey"), row(left["nation"], "nation", "n_nationkey"), row(left["supplier"], "supplier", "s_suppkey", F.col("s_nationkey")),
        row(left["customer"], "customer", "c_custkey"), row(left["orders"], "orders", "o_orderkey"), row(left["lineitem"], "lineitem", "l_orderkey", F.col("l_linenumber")),
    ]
    return reduce(DataFrame.unionAll, parts)


@query("SELECT o_orderkey, 'queued' AS status, CAST(0 AS INTEGER) AS progress, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '1996-06-30' ELSE o_orderdate END AS updated_at FROM orders")
def defaults_and_touch(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("updated_at"))
    rows = changes.with_defaults(rows, {"status": F.lit("queued"), "progress": F.lit(0), "updated_at": F.lit(None)})
    return changes.touch(rows, F.col("o_orderkey") % 2 == 0, _as_of())


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'Full ' || event_id WHEN 1 THEN 'Name ' || event_id WHEN 2 THEN 'Full ' || event_id END AS full_name,
CASE WHEN event_id % 2 = 0 THEN 'https://a.example/' || event_id END AS avatar_url FROM events WHERE event_id % 5 <> 0
UNION ALL SELECT event_id, 'old', NULL FROM events WHERE event_id % 5 = 0""")
def json_profile(spark, sf):
    """New users' profiles from their metadata; a profile that is there stays."""
    k = F.col("event_id")
    field = lambda name, value, when: F.when(when, F.concat(F.lit(f'"{name}":"{value} '), k.cast("string"), F.lit('"')))
    avatar = F.when(k % 2 == 0, F.concat(F.lit('"avatar_url":"https://a.example/'), k.cast("string"), F.lit('"')))
    body = F.concat(F.lit("{"), F.concat_ws(",", field("full_name", "Full", k % 2 == 0), field("name", "Name", (k % 4).isin(0, 1)), avatar), F.lit("}"))
    users = table(spark, sf, "events").select(k.alias("id"), body.alias("raw_user_meta_data"))
    have = users.where("id % 5 = 0").select("id", F.lit("old").alias("full_name"), F.lit(None).cast("string").alias("avatar_url"))
    return changes.insert_if_absent(have, changes.profiles_of_users(users), "id", ["full_name"])


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN CASE o_orderstatus WHEN 'O' THEN 'researching' WHEN 'P' THEN 'ready' ELSE 'failed' END
ELSE CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'researching' ELSE 'failed' END END AS status FROM orders""")
def advance_jobs(spark, sf):
    s = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "researching").otherwise("failed")
    jobs = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", s.alias("status"))
    return changes.advance(jobs, {"queued": "researching", "researching": "ready"}, F.col("o_totalprice") > 100000).select("o_orderkey", "status")


# Ledger


def _entries(spark, sf):
    kind = F.col("event_type")
    entry = F.when(kind == "purchase", "debit").when(kind == "signup", "credit").when(kind == "error", "refund")
    rows = table(spark, sf, "events").withColumn("kind", entry).withColumn("amount", F.floor("value").cast("long"))
    return rows.where("kind IS NOT NULL").select("event_id", "user_id", "ts", "kind", "amount")


_ENTRIES = """WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN -CAST(floor(value) AS BIGINT) ELSE CAST(floor(value) AS BIGINT) END AS signed
FROM events WHERE event_type IN ('purchase', 'signup', 'error')) """


@query(_ENTRIES + "SELECT user_id, CAST(sum(signed) AS BIGINT) AS balance FROM e GROUP BY user_id")
def ledger_balance(spark, sf):
    return ledger.balances(_entries(spark, sf), "user_id", "kind", "amount")


@query(_ENTRIES + "SELECT event_id, CAST(sum(signed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_balance FROM e")
def ledger_running(spark, sf):
    return ledger.running(_entries(spark, sf), "user_id", "kind", "amount", ["ts", "event_id"]).select("event_id", "running_balance")


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN '-' ELSE '+' END || CAST(floor(value) AS BIGINT) AS shown, event_type <> 'purchase' AS credit FROM events WHERE event_type IN ('purchase', 'signup', 'error')""")
def credit_texts(spark, sf):
    """Ledger amounts as they are shown, and what their sign says."""
    shown = F.concat(F.when(F.col("kind") == "debit", "-").otherwise("+"), F.col("amount").cast("string"))
    return _entries(spark, sf).select("event_id", shown.alias("shown")).withColumn("credit", ledger.is_credit_text(F.col("shown")))


@query(_ENTRIES + """, n AS (SELECT user_id, CAST(sum(signed) AS BIGINT) AS net FROM e GROUP BY user_id), c AS (SELECT DISTINCT user_id, user_id % 3 * 5 AS credits_charged FROM events)
SELECT c.user_id, credits_charged, coalesce(net, 0) AS net, coalesce(net, 0) + credits_charged <> 0 AS mismatch FROM c LEFT JOIN n USING (user_id)""")
def reserve_settle(spark, sf):
    charged = table(spark, sf, "events").select("user_id").distinct().withColumn("credits_charged", F.col("user_id") % 3 * 5)
    return ledger.settlement(_entries(spark, sf), "user_id", "kind", "amount", charged)


_EVENT_KINDS = {"signup": "reserve", "click": "start", "view": "succeed", "purchase": "settle", "error": "fail"}
#: Of one event type every third is another event, so that jobs come back to the queue.
_OTHER_KINDS = {"signup": "retry", "click": "refund", "view": "refresh", "purchase": "expire", "error": "review"}


def _kinds(kinds):
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items()) + " END"


@query(f"""WITH RECURSIVE moves(kind, before, after) AS (VALUES {", ".join(str((k, s, v)) for (k, s), v in jobs.MOVES.items())}),
e AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN {_kinds(_OTHER_KINDS)} ELSE {_kinds(_EVENT_KINDS)} END AS kind, CAST(floor(value) AS BIGINT) AS amount,
  CAST(json_extract(props, '$.k') AS VARCHAR) AS ref FROM events),
u AS (SELECT *, row_number() OVER (PARTITION BY user_id, ref ORDER BY ts, event_id) AS again FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM u WHERE again = 1),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS k, 'queued' AS state, CAST(0 AS BIGINT) AS reserved, CAST(0 AS BIGINT) AS charged, CAST(0 AS BIGINT) AS refused FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT f.user_id, f.k + 1, coalesce(m.after, f.state), f.reserved + CASE WHEN m.after IS NULL THEN 0 WHEN n.kind = 'reserve' THEN amount WHEN n.kind IN ('settle', 'refund') THEN -amount ELSE 0 END,
  f.charged + CASE WHEN m.after IS NOT NULL AND n.kind = 'settle' THEN amount ELSE 0 END, f.refused + CASE WHEN m.after IS NULL THEN 1 ELSE 0 END
  FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1 LEFT JOIN moves m ON m.kind = n.kind AND m.before = f.state)
SELECT user_id, state, reserved, charged, refused FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS last FROM f) WHERE last = 1""")
def job_log(spark, sf):
    """Every user's events as the log of a job; the number in props is the external reference."""
    pick = lambda kinds: F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("event_type")]
    events = table(spark, sf, "events").select(
        "user_id", "ts", "event_id", F.when(F.col("event_id") % 3 == 0, pick(_OTHER_KINDS)).otherwise(pick(_EVENT_KINDS)).alias("kind"),
        F.floor("value").cast("long").alias("amount"), F.get_json_object("props", "$.k").alias("ref"),
    )
    return jobs.fold(events, "user_id", ["ts", "event_id"], "kind", "amount", "ref")


@query("""SELECT c_custkey, CAST(floor(floor(c_acctbal) / 5) AS BIGINT) AS affordable, floor(c_acctbal) >= 5 AS enough,
CAST(floor(c_acctbal) AS BIGINT) - CASE WHEN c_custkey % 4 = 0 THEN 5 ELSE c_custkey % 4 END AS after FROM customer""")
def credits(spark, sf):
    have = F.floor("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", ledger.affordable(have).alias("affordable"), ledger.can_afford(have).alias("enough"), ledger.debit(have, F.col("c_custkey") % 4).alias("after")
    )


@query("""SELECT event_type, CAST(CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 0 WHEN 'error' THEN 0 WHEN 'signup' THEN 1 END AS INTEGER) AS price, count(*) AS n FROM events GROUP BY ALL""")
def credit_price(spark, sf):
    outcomes = {"click": "success", "view": "unresolved", "error": "failure", "signup": "refresh"}
    named = F.create_map(*(F.lit(x) for p in outcomes.items() for x in p))
    priced = table(spark, sf, "events").withColumn("price", ledger.price(named[F.col("event_type")]))
    return priced.groupBy("event_type", "price").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, CAST(floor((1 - sum(CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) ELSE 0 END) / nullif(sum(CAST(floor(value) AS BIGINT)), 0)) * 100) AS BIGINT) AS percent_left FROM events GROUP BY user_id""")
def usage_share(spark, sf):
    v = F.floor("value")
    return table(spark, sf, "events").groupBy("user_id").agg(ledger.usage_share(F.when(F.col("event_type") == "purchase", v).otherwise(0), v).alias("percent_left"))


# Snapshots


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def latest_snapshot(spark, sf):
    s = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return history.latest(s, "o_custkey", "o_orderdate", "o_orderkey")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, previous FROM (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER w AS previous, row_number() OVER w AS n FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE n > 1 AND o_orderstatus IS DISTINCT FROM previous""")
def snapshot_changes(spark, sf):
    s = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return history.changes(s, "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus").drop("o_orderdate")


@query("""WITH v AS (SELECT *, lag(o_orderkey) OVER w AS before, lag(o_orderstatus) OVER w AS status0, lag(o_orderpriority) OVER w AS priority0, row_number() OVER w AS n FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
p AS (SELECT o_orderkey, o_custkey, before, status0, o_orderstatus AS status, priority0, o_orderpriority AS priority FROM v WHERE n > 1),
l AS (SELECT l_orderkey, '{"line":' || l_linenumber || '}' AS item, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k,
  '{"line":' || l_linenumber || ',"part":' || l_partkey || ',"supplier":' || l_suppkey || '}' AS js FROM lineitem),
i AS (SELECT o_custkey, p.o_orderkey, 'lines' AS field, coalesce(a.item, b.item) AS item, a.js AS old, b.js AS new FROM p
  JOIN (SELECT * FROM l) a ON a.l_orderkey = p.before LEFT JOIN l b ON b.l_orderkey = p.o_orderkey AND b.item = a.item AND b.k = a.k
  UNION ALL SELECT o_custkey, p.o_orderkey, 'lines', b.item, NULL, b.js FROM p JOIN l b ON b.l_orderkey = p.o_orderkey LEFT JOIN l a ON a.l_orderkey = p.before AND b.item = a.item AND b.k = a.k WHERE a.item IS NULL)
SELECT o_custkey, o_orderkey, 'o_orderstatus' AS field, CAST(NULL AS VARCHAR) AS item, 'changed' AS change, status0 AS old, status AS new FROM p WHERE status IS DISTINCT FROM status0
UNION ALL SELECT o_custkey, o_orderkey, 'o_orderpriority', NULL, 'changed', priority0, priority FROM p WHERE priority IS DISTINCT FROM priority0
UNION ALL SELECT o_custkey, o_orderkey, field, item, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END, old, new FROM i WHERE old IS DISTINCT FROM new""")
def snapshot_diff(spark, sf):
    """What every order of a customer changed against the one before: fields, and the lines as a nested list."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    versions = table(spark, sf, "orders").join(lines, "o_orderkey", "left")
    found = history.field_changes(versions, "o_custkey", "o_orderdate", "o_orderkey", ["o_orderstatus", "o_orderpriority"], {"lines": ["line"]})
    return found.drop("o_orderdate")


@query("""SELECT a.p_partkey AS key_a, b.p_partkey AS key_b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM part a JOIN part b
ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 2""")
def entity_candidates(spark, sf):
    p = table(spark, sf, "part").withColumn("block", F.concat_ws("|", "p_brand", "p_size"))
    return history.candidates(p, p, "block", "p_name", "p_partkey", 2).select("key_a", "key_b", "distance")


@query("""WITH RECURSIVE n AS (SELECT DISTINCT p_brand AS b, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS s FROM part),
e AS (SELECT x.b, x.s AS s, y.s AS t FROM n x JOIN n y ON x.b = y.b AND levenshtein(x.s, y.s) <= 3),
r AS (SELECT b, s, s AS t FROM n UNION SELECT r.b, r.s, e.t FROM r JOIN e ON e.b = r.b AND e.s = r.t),
g AS (SELECT b, s, min(t) AS group_name FROM r GROUP BY ALL), p AS (SELECT p_partkey, p_brand, group_name FROM part JOIN g ON b = p_brand AND s = regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'))
SELECT p_partkey, group_name, count(*) OVER (PARTITION BY p_brand, group_name) AS group_size FROM p""")
def entity_groups(spark, sf):
    """Parts of a brand in groups of names whose slugs chains of three edits join."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", text.slug(F.col("p_name")).alias("slug"))
    return entities.groups(p, "p_brand", "slug", 3).select("p_partkey", "group_name", "group_size")


@query("SELECT o_orderkey, c_name, coalesce(n, 0) AS n_evidence FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def report_evidence(spark, sf):
    jobs = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return jobs.join(found, "o_orderkey", "left").select("o_orderkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_evidence"))


# Extraction and safety


@query("""SELECT page_id, CAST(len(l) AS INTEGER) AS n, coalesce(nullif(l[1], ''), 'not_found') AS first, sha256(array_to_string(l, chr(10))) AS links
FROM (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']*)["'']', 1), lambda x: replace(replace(x, '&quot;', '"'), '&amp;', '&')) AS l FROM pages)""")
def extract_links(spark, sf):
    links = extract.hrefs(F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id", F.size(links).alias("n"), extract.or_not_found(F.get(links, F.lit(0))).alias("first"), F.sha2(F.array_join(links, "\n"), 256).alias("links")
    )


#: Put before each page: contacts as pages write them, some of them out of use. %s is the page's id.
_CONTACT_HTML = """<!-- <a href="mailto:old@x.example">m</a> --><a title="hotel:5" HREF='mailto:a%s@x.example,b%s@x.example?subject=1'>m</a><a href=mailto:nobody>n</a> <a href=tel:+81-3&#45;%s;ext=2>t</a>
<a href='tel:call us'>u</a><a href="https://wa.me/84%s?text=1">w</a><a href="https://api.whatsapp.com/send?text=x&amp;phone=%%2B85%s">v</a><script>var x = '<a href="tel:1">'</script>
<script type="application/ld+json">{"@type": "WebSite", "url": "https://x.example/%s"}</script><script type='application/ld+json; charset=utf-8'>[{"@type": "BreadcrumbList"},
{"@context": "https://schema.org", "@graph": [{"@type": ["Organization", "Corporation"], "name": "Acme & %s", "employees": %s}, {"@type": "Person", "name": "No %s"}]}]</script><script type="application/ld+json">{broken</script>""".replace("%%", "%")


@query("""SELECT page_id, 'a' || page_id || '@x.example b' || page_id || '@x.example' AS emails, '+81-3-' || page_id AS phones, '84' || page_id || ' 85' || page_id AS whatsapp,
'Acme & ' || page_id AS name, 'Acme & ' || page_id || '|No ' || page_id AS names, 'Acme & ' || page_id AS organizations, CAST(page_id AS VARCHAR) AS employees, 'https://x.example/' || page_id AS url, 'not_found' AS fax FROM pages""")
def extract_contacts(spark, sf):
    html = F.concat(F.replace(F.lit(_CONTACT_HTML), F.lit("%s"), F.col("page_id").cast("string")), F.coalesce("html", F.lit("")))
    h = F.col("html")
    value = lambda path: extract.or_not_found(extract.json_ld(h, path))
    names = lambda kind: F.array_join(extract.json_ld_values(h, "$.name", kind), "|")
    return table(spark, sf, "pages").select("page_id", html.alias("html")).select(
        "page_id", F.array_join(extract.emails(h), " ").alias("emails"), F.array_join(extract.phones(h), " ").alias("phones"),
        F.array_join(extract.whatsapp(h), " ").alias("whatsapp"), value("$.name").alias("name"), names(None).alias("names"),
        names("Organization").alias("organizations"), value("$.employees").alias("employees"), value("$.url").alias("url"), value("$.fax").alias("fax"),
    )


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def evidence_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", extract.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


#: Forms of hosts, and whether a crawler may follow them.
_HOSTS = (
    ("10.0.0.1", False), ("172.16.0.1", False), ("192.168.1.1", False), ("169.254.169.254", False), ("127.0.0.2", False), ("[::1]", False), ("localhost", False),
    ("127.1", False), ("2130706433", False), ("0x7f.0.0.1", False), ("017700000001", False), ("10.0.0.1.", False), ("[::ffff:127.0.0.1]", False), ("[0:0:0:0:0:0:0:1]", False),
    ("100.64.0.1", False), ("[2002:a00:1::]", False), ("127%2e0.0.1", False), ("metadata.google.internal", False), ("8.8.8.8", True), ("172.32.0.1", True),
    ("sub.example.org", True), ("134744072", True), ("[2606:4700::1111]", True), ("[::ffff:8.8.8.8]", True),
)


@query(f"SELECT page_id, {[ok for _, ok in _HOSTS]}[page_id % {len(_HOSTS)} + 1] AS safe, true AS own FROM pages")
def url_safety(spark, sf):
    """Every page's URL, and the same URL with another host, at another port and behind a user's name."""
    hosts = F.get(F.array(*(F.lit(h) for h, _ in _HOSTS)), (F.col("page_id") % len(_HOSTS)).cast("int"))
    made = F.concat(F.lit("http://8.8.8.8@"), hosts, F.lit(":8080"), F.regexp_extract("url", "://[^/?#]*(.*)$", 1))
    return table(spark, sf, "pages").select("page_id", urls.is_safe(made).alias("safe"), urls.is_safe(F.col("url")).alias("own"))


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([^:]*)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
regexp_extract(url, '([?#].*)$', 1) AS rest FROM pages)
SELECT page_id, scheme || '://xn--bcher-kva.' || host || '/a/b' || path || '%20x' || rest AS url FROM p""")
def url_forms(spark, sf):
    """Page URLs written oddly: another case, a name outside ASCII, standard ports, backslashes, dot segments, a space."""
    u = F.col("url")
    part = lambda pattern: F.regexp_extract(u, pattern, 1)
    scheme = F.upper(part("^([^:]*)://"))
    port = F.when(scheme == "HTTP", ":0080").otherwise(":443")
    odd = F.concat(scheme, F.lit("://BÜCHER."), F.upper(part("://([^/?#]*)")), port, F.lit("\\a/./c/%2E%2e/b"), part("://[^/?#]*([^?#]*)"), F.lit(" x"), part("([?#].*)$"))
    return table(spark, sf, "pages").select("page_id", urls.normalize_url(odd).alias("url"))
