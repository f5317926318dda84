"""Predicates and classifications as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import query_keys, ratio, url_host, url_path, url_scheme

# Fixed values of the URL and content rules.
MALICIOUS_SCHEMES = ["javascript", "data", "file", "ftp"]
SUSPICIOUS_EXTENSIONS = [".exe", ".scr", ".apk", ".msi", ".bat", ".cmd", ".ps1", ".php", ".cgi", ".bin"]
BAIT_QUERY_KEYS = ["download", "redirect", "out", "go"]
BLOCKED_HOSTS = ["malware.example.com", "phishing-site.net", "suspicious-domain.org"]
BLOCKED_TLDS = [".tk", ".ml", ".ga", ".cf"]
ALLOWED_CONTENT = ["image/jpeg", "image/jpg", "image/png", "image/gif", "image/webp", "image/bmp"]
MAX_CONTENT_BYTES = 8 * 1024 * 1024
PAGE_SKIPS = ["javascript:", "mailto:", "tel:", "#", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".pdf", ".doc", ".docx", ".zip", ".rar", "facebook.com", "twitter.com", "instagram.com", "youtube.com"]
MEDIA_SKIPS = ["javascript:", "mailto:", "tel:", "#", ".pdf", ".doc", ".zip"]
RENDER_SIGNS = ["cloudflare", "captcha", "access denied", "please enable javascript", "javascript is disabled", "checking your browser", "ddos protection"]
#: size, sharpness, angle 1, angle 2, score
QUALITY_PRESETS = {"ingest": (80, 80.0, 25.0, 25.0, 0.60), "enroll": (64, 30.0, 30.0, 30.0, 0.40), "verify": (80, 60.0, 25.0, 25.0, 0.55), "search": (32, 30.0, 45.0, 45.0, 0.30)}
PAYLOAD_FIELDS = ["site", "url", "ts", "bbox", "p_hash", "quality"]
MAGIC = {"FFD8FF": "image/jpeg", "89504E470D0A1A0A": "image/png", "47494638": "image/gif", "424D": "image/bmp"}


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def optional_filters(df: DataFrame, tenant_col: str, ts_col: str, tenant=None, start=None, end=None) -> DataFrame:
    """Only the filters that are given apply; both ends of the range belong to it."""
    for value, cond in ((tenant, F.col(tenant_col) == F.lit(tenant)), (start, F.col(ts_col) >= F.lit(start)), (end, F.col(ts_col) <= F.lit(end))):
        if value is not None:
            df = df.filter(cond)
    return df


def scoped(df: DataFrame, tenant, site=None, prefix=None, tenant_col="tenant_id", site_col="site", prefix_col="p_hash_prefix") -> DataFrame:
    """A tenant's rows. A scope without a tenant is refused."""
    if tenant is None:
        raise ValueError("a tenant is required")
    df = df.filter(F.col(tenant_col) == F.lit(tenant))
    for value, name in ((site, site_col), (prefix, prefix_col)):
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def allowed_columns(df: DataFrame, allow: list[str] = PAYLOAD_FIELDS) -> DataFrame:
    return df.select(*[c for c in allow if c in df.columns])


def url_class(u: Column, strict: bool = False) -> Column:
    """First rule that a URL breaks, else SAFE. A URL without scheme or host is a VALIDATION_ERROR."""
    out = F.when(url_scheme(u).isin(MALICIOUS_SCHEMES), "MALICIOUS_SCHEME").when(u.isNull() | (url_scheme(u) == "") | (url_host(u) == ""), "VALIDATION_ERROR")
    if strict:
        out = out.when(~url_scheme(u).isin("http", "https"), "UNSAFE_SCHEME")
    return (
        out.when(_any([F.lower(url_path(u)).endswith(e) for e in SUSPICIOUS_EXTENSIONS]), "SUSPICIOUS_EXTENSION")
        .when(F.arrays_overlap(query_keys(u), F.array(*map(F.lit, BAIT_QUERY_KEYS))), "BAIT_QUERY_PARAM")
        .when(url_host(u).isin(BLOCKED_HOSTS), "BLOCKED_HOST")
        .when(_any([url_host(u).endswith(t) for t in BLOCKED_TLDS]), "BLOCKED_TLD")
        .otherwise("SAFE")
    )


def content_class(kind: Column, size: Column) -> Column:
    k = F.lower(kind)
    return (
        F.when(kind.isNull() | (kind == ""), "NO_CONTENT_TYPE")
        .when(k.contains("image/svg+xml"), "SKIP_SVG")
        .when(~_any([k.contains(a) for a in ALLOWED_CONTENT]), "NOT_IMAGE_CONTENT")
        .when(size > MAX_CONTENT_BYTES, "CONTENT_TOO_LARGE")
        .otherwise("SAFE")
    )


def redirect_class(u: Column, hop: Column, most: Column | int = 3) -> Column:
    c = url_class(u)
    return F.when(hop >= most, "TOO_MANY_REDIRECTS").when(c != "SAFE", F.concat(F.lit("REDIRECT_"), c)).otherwise("SAFE")


def page_url(u: Column, base: Column) -> Column:
    """Whether a link leads to a page of the same host that may be read."""
    low = F.lower(u)
    return (url_class(u) == "SAFE") & url_scheme(u).isin("http", "https") & (url_host(u) == url_host(base)) & ~_any([low.contains(s) for s in PAGE_SKIPS])


def media_url(u: Column) -> Column:
    low = F.lower(u)
    return url_scheme(u).isin("http", "https") & (url_host(u) != "") & ~_any([low.contains(s) for s in MEDIA_SKIPS])


def missing_fields(names: list[str]) -> Column:
    """Names of required columns that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.col(n).isNull() | (F.trim(F.col(n).cast("string")) == ""), F.lit(n)) for n in names]))


def split_valid(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others with their reason."""
    marked = df.withColumn("missing", missing_fields(names))
    bad = marked.filter(F.size("missing") > 0).withColumn("error", F.concat(F.lit("missing: "), F.concat_ws(",", "missing")))
    return marked.filter(F.size("missing") == 0).drop("missing"), bad.drop("missing")


def has_source(bucket: Column, key: Column, url: Column) -> Column:
    """(bucket and key) or url."""
    return F.coalesce((bucket.isNotNull() & key.isNotNull()) | url.isNotNull(), F.lit(False))


def exactly_one(a: Column, b: Column) -> Column:
    return a.isNotNull() != b.isNotNull()


def quality_gate(width: Column, height: Column, sharpness: Column, angle1: Column, angle2: Column, preset: str = "ingest") -> Column:
    """struct(reasons, score, usable) of supplied measures; missing angles count as 0."""
    least, sharp, most1, most2, score = QUALITY_PRESETS[preset]
    a1, a2 = F.abs(F.coalesce(angle1, F.lit(0.0))), F.abs(F.coalesce(angle2, F.lit(0.0)))
    reasons = F.array_compact(F.array(
        F.when((width < least) | (height < least), "too_small"), F.when(sharpness < sharp, "not_sharp"), F.when(a1 > most1, "angle1_too_large"), F.when(a2 > most2, "angle2_too_large"),
    ))
    one = F.lit(1.0)
    total = F.least(one, sharpness / 500.0) * 0.4 + (1 - F.least(one, a1 / most1)) * 0.2 + (1 - F.least(one, a2 / most2)) * 0.2 + F.least(one, F.least(width, height) / float(max(least, 112))) * 0.2
    return F.struct(reasons.alias("reasons"), total.alias("score"), ((F.size(reasons) == 0) & (total >= score)).alias("usable"))


def simple_gate(width: Column, height: Column, sharpness: Column, least: int, sharp: float) -> Column:
    return (width >= least) & (height >= least) & (sharpness >= sharp)


def search_quality(usable: Column, score: Column, floor: float = 0.0) -> Column:
    return usable & (score >= floor) if floor > 0 else usable


def needs_render(html: Column) -> Column:
    low = F.lower(html)
    return F.coalesce(F.length(html) < 500, F.lit(True)) | _any([low.contains(s) for s in RENDER_SIGNS])


def sniff_type(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return reduce(lambda w, m: w.when(head.startswith(m[0]), m[1]), MAGIC.items(), F.when(F.lit(False), None))


def visible(status: Column, wanted: str | None = None) -> Column:
    shown = F.coalesce(status != "deleted", F.lit(True))
    return shown & (status == wanted) if wanted else shown


def partial_index_flags(hash_col: Column, status: Column, results: Column) -> list[Column]:
    return [F.coalesce(hash_col != "", F.lit(False)).alias("has_hash"), F.coalesce(status >= 400, F.lit(False)).alias("is_error"), F.coalesce(results == 0, F.lit(False)).alias("no_result")]


def recommendations(metrics: DataFrame, p95_limit: float = 5.0) -> DataFrame:
    """One row for each rule that a row of metrics (p95, avg, errors, requests, violations) breaks."""
    rules = F.array(
        F.when(F.col("p95") > p95_limit, F.struct(F.lit("latency").alias("category"), F.lit("high").alias("priority"))),
        F.when(F.col("avg") > p95_limit * 0.5, F.struct(F.lit("average").alias("category"), F.lit("medium").alias("priority"))),
        F.when(ratio(F.col("errors"), F.col("requests")) > 0.05, F.struct(F.lit("reliability").alias("category"), F.lit("high").alias("priority"))),
        F.when(F.col("violations") > 0, F.struct(F.lit("limits").alias("category"), F.lit("medium").alias("priority"))),
    )
    return metrics.withColumn("rule", F.explode(F.array_compact(rules))).select(*metrics.columns, "rule.category", "rule.priority")


def threshold_status(value: Column, limit: float) -> Column:
    return F.when(value > limit, "warning").otherwise("ok")


def tenant_ok(tenant: Column, allow: list[str] | None = None) -> Column:
    ok = F.coalesce(F.length(F.trim(tenant.cast("string"))) >= 3, F.lit(False))
    return ok & tenant.cast("string").isin(allow) if allow else ok
