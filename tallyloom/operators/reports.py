"""Reports: construction from requests, labels, nested contacts and sources, text summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import dates, text, urls
from tallyloom.functions.text import blank_to_null

#: Texts and numbers of a newly derived report.
UNKNOWN_COUNTRY = "Chưa xác định"
PENDING_INDUSTRY = "Đang chờ phân loại"
UNVERIFIED = ("Chưa xác minh", "Not verified")
CONFIDENCE_WITH_URL, CONFIDENCE_WITHOUT = 91, 84
SIGNALS_WITH_URL = ("Có link tham chiếu", "Cần chạy connector thật để xác minh")
SIGNALS_WITHOUT = ("Tìm bằng tên công ty", "Nên bổ sung quốc gia để tăng độ chính xác")
ACCENT = "#4F7CFF"
JUST_NOW = "Vừa xong"
NEW_CONTACTS = (("Website tham chiếu", "website"), ("LinkedIn công ty", "linkedin"), ("Email kinh doanh", "email"))
NEW_CONTACT_SOURCES = ("Link người dùng cung cấp", "Candidate discovery", "Chưa có evidence")
NEW_SOURCES = ("Link bạn đã cung cấp", "Candidate website", "Search discovery")
LINKEDIN, SEARCH = "linkedin.com/company/", "https://www.google.com/search?q="
PROGRESS = (12, 36, 68, 91)
CREDITS_PER_REPORT = 5
VERIFIED_CONFIDENCE = 80
#: Labels of the summary, by locale.
SUMMARY_LABELS = {
    "vi": ("CÔNG TY", "Quốc gia", "Ngành", "Độ tin cậy", "KÊNH KINH DOANH ĐÃ XÁC MINH", "NGUỒN", "lưu đến"),
    "en": ("COMPANY", "Country", "Industry", "Confidence", "VERIFIED BUSINESS CHANNELS", "SOURCES", "stored until"),
}


def status_label(status: Column, ready: str = "Ready", researching: str = "Researching", review: str = "Needs review") -> Column:
    """Three labels; every other status needs review."""
    return F.when(status == "ready", ready).when(status == "researching", researching).otherwise(review)


def status_label_short(status: Column, ready: str = "Ready", review: str = "Needs review") -> Column:
    return F.when(status == "ready", ready).otherwise(review)


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= VERIFIED_CONFIDENCE, "verified").otherwise("review")


def contact_icon(kind: Column) -> Column:
    return F.when(kind.isin("email", "phone", "linkedin", "whatsapp"), kind).otherwise("globe")


def source_icon(kind: Column) -> Column:
    return F.when(kind == "social", "social").when(kind == "news", "news").otherwise("globe")


def percent(value: Column) -> Column:
    return F.concat(value.cast("string"), F.lit("%"))


def verified_contacts(contacts: Column) -> Column:
    return F.filter(contacts, lambda c: F.coalesce(c["verified"], F.lit(False)))


def can_copy(value: Column) -> Column:
    return ~value.isin(*UNVERIFIED)


def contact_lines(contacts: Column) -> Column:
    return F.transform(contacts, lambda c: F.concat(F.lit("• "), c["label"], F.lit(": "), c["value"]))


def source_lines(sources: Column) -> Column:
    return F.transform(sources, lambda s: F.concat(F.lit("• "), s["label"], F.lit(": "), s["url"]))


def summary(locale: str) -> Column:
    """A report row as lines of text; blank lines are dropped, separators too."""
    company, country, industry, confidence, channels, sources, until = SUMMARY_LABELS[locale]
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value.cast("string"))
    head = F.array(
        line(company, F.col("company_name")), line(country, F.col("country")), line(industry, F.col("industry")),
        F.concat(line(confidence, F.col("confidence")), F.lit("/100")),
        F.when(blank_to_null(F.col("website")).isNotNull(), line("Website", F.col("website"))).otherwise(""),
        F.lit(f"{channels}:"),
    )
    end = F.concat(F.lit("Snapshot: "), F.col("last_updated"), F.lit(f" · {until} "), F.col("expires_at"))
    lines = F.concat(
        head, contact_lines(verified_contacts(F.col("contacts"))), F.array(F.lit(f"{sources}:")), source_lines(F.col("sources")), F.array(end)
    )
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def clean_requests(requests: DataFrame) -> DataFrame:
    """company_name, source_url, country: trimmed, cut to 140, 500 and 80 characters, the URL normalised."""
    return requests.withColumns({
        "company_name": text.as_text(F.col("company_name"), 140),
        "source_url": urls.normalize_url(text.as_text(F.col("source_url"), 500)),
        "country": text.as_text(F.col("country"), 80),
    })


def has_input(name: Column, url: Column) -> Column:
    return (F.coalesce(name, F.lit("")) != "") | (F.coalesce(url, F.lit("")) != "")


def has_input_for(mode: Column, name: Column, url: Column) -> Column:
    """The guard of one input mode, "name" or "url": only that field counts, white space does not."""
    return text.js_trim(F.coalesce(F.when(mode == "name", name).otherwise(url), F.lit(""))) != ""


def progress(step: Column) -> Column:
    """Percent after a step of the research, from 0; null beyond the last."""
    return F.get(F.array(*map(F.lit, PROGRESS)), step)


def tint(accent: Column, alpha: str = "18") -> Column:
    return F.concat(accent, F.lit(alpha))


def nothing_found(rows: DataFrame) -> DataFrame:
    """One row: whether there is none; reads no more than one."""
    return rows.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a name or a URL, and the rejected ones."""
    ok = has_input(F.col("company_name"), F.col("source_url"))
    return requests.where(ok), requests.where(~ok)


def build_reports(requests: DataFrame, as_of: Column) -> DataFrame:
    """One report per clean request (company_name, source_url, country), other columns kept."""
    url, has_url = F.col("source_url"), blank_to_null(F.col("source_url")).isNotNull()
    made = requests.withColumns({
        "name_": text.company_name(F.col("company_name"), url),
    }).withColumn("slug_", text.slug(F.col("name_")))
    domain = urls.domain_or_slug(url, F.col("slug_"))
    path = F.coalesce(blank_to_null(F.col("slug_")), F.lit("company"))
    (website, linkedin, email), (given, candidate, none) = (label for label, _ in NEW_CONTACTS), NEW_CONTACT_SOURCES
    contact = lambda label, value, kind, verified, source: F.struct(
        F.lit(label).alias("label"), value.alias("value"), F.lit(kind).alias("type"), verified.alias("verified"), source.alias("source")
    )
    contacts = F.array(
        contact(website, domain, "website", has_url, F.when(has_url, given).otherwise(candidate)),
        contact(linkedin, F.concat(F.lit(LINKEDIN), path), "linkedin", F.lit(False), F.lit(candidate)),
        contact(email, F.lit(UNVERIFIED[0]), "email", F.lit(False), F.lit(none)),
    )
    source = lambda label, at, kind, verified: F.struct(
        label.alias("label"), at.alias("url"), F.lit(kind).alias("kind"), verified.alias("verified")
    )
    at = F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("https://"), domain))
    sources = F.array(
        source(F.when(has_url, NEW_SOURCES[0]).otherwise(NEW_SOURCES[1]), at, "website", has_url),
        source(F.lit(NEW_SOURCES[2]), F.concat(F.lit(SEARCH), text.encode_component(F.col("name_"))), "directory", F.lit(None).cast("boolean")),
    )
    signals = F.when(has_url, F.array(*map(F.lit, SIGNALS_WITH_URL))).otherwise(F.array(*map(F.lit, SIGNALS_WITHOUT)))
    expires = dates.expiry_date(as_of)
    return made.withColumns({
        "id": dates.report_id(as_of), "initials": text.initials(F.col("name_")), "accent": F.lit(ACCENT), "source_input": url,
        "status": F.lit("ready"), "confidence": F.when(has_url, CONFIDENCE_WITH_URL).otherwise(CONFIDENCE_WITHOUT),
        "expires_at": dates.short_date(expires), "days_left": dates.days_left(expires, as_of.cast("date")), "industry": F.lit(PENDING_INDUSTRY),
        "website": domain, "country": F.coalesce(blank_to_null(F.col("country")), F.lit(UNKNOWN_COUNTRY)),
        "last_updated": F.lit(JUST_NOW), "contacts": contacts, "sources": sources, "signals": signals,
    }).withColumn("company_name", F.col("name_")).drop("name_", "slug_")


def newest(reports: DataFrame, order: list[Column], n: int = 4) -> DataFrame:
    return reports.orderBy(*order).limit(n)


def newest_of(reports: DataFrame, tenant: str, value: object, order: list[Column], n: int = 4) -> DataFrame:
    """One tenant's newest rows; the filter reaches the scan."""
    return newest(reports.where(F.col(tenant) == value), order, n)


def newest_of_each(rows: DataFrame, tenant: str, order: list[Column], n: int = 4) -> DataFrame:
    """The first n rows of every tenant by order, which should tell a tenant's rows apart; a null tenant is one too.

    Each task keeps n rows a tenant (WindowGroupLimit) before the shuffle, so no task reads a whole tenant.
    """
    place = F.row_number().over(Window.partitionBy(tenant).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def prepend(new: DataFrame, current: DataFrame, seq: str = "seq") -> DataFrame:
    """New rows before the current ones: seq 0 and 1 say which list a row is from."""
    return new.withColumn(seq, F.lit(0)).unionByName(current.withColumn(seq, F.lit(1)))
