"""Column functions: keys, hashes, vectors, URLs, numbers. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- keys and hashes ------------------------------------------------------


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def cache_key(prefix: str, content: Column, tenant: Column, **more: Column) -> Column:
    """``prefix:tenant:hash[:name:value...]``, names in order, hash cut to 16 digits."""
    extra = [x for k in sorted(more) for x in (F.lit(k), more[k].cast("string"))]
    return F.concat_ws(":", F.lit(prefix), tenant.cast("string"), F.substring(sha256_hex(content), 1, 16), *extra)


def uuid_of(c: Column) -> Column:
    """The same UUID-shaped identifier for the same value."""
    return F.regexp_replace(F.substring(sha256_hex(c), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal strings of any length; the shorter is padded on the left."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))

    def part(x: Column, width: Column | int, at: Column | int) -> Column:
        return F.conv(F.substring(F.lpad(x, width, "0"), at, 8), 16, 10).cast("long")

    def differ(width: Column | int, at: Column | int) -> Column:
        return F.bit_count(part(a, width, at).bitwiseXOR(part(b, width, at)))

    n = F.ceil(F.greatest(F.length(a), F.length(b)) / 8).cast("int")
    long = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: differ(8 * n, 8 * i + 1)), F.lit(0), lambda s, d: s + d)
    return F.when(n <= 2, differ(16, 1) + differ(16, 9)).otherwise(F.when(n > 2, long))


def phash_prefix(c: Column, bits: int = 16) -> Column:
    return F.substring(c, 1, bits // 4)


def content_key(c: Column, tenant: Column, extension: str) -> Column:
    """Content-addressed storage key ``tenant/h[:2]/h.ext``."""
    h = sha256_hex(c)
    return F.concat(F.concat_ws("/", tenant.cast("string"), F.substring(h, 1, 2), h), F.lit(f".{extension}"))


def derived_keys(c: Column, tenant: Column) -> Column:
    """crop and thumb: storage keys of an identifier ``sha:face_number``; null where it has another form."""
    number = F.regexp_extract(c, r"^[^:]*:face_([0-9]+)(?:_.*)?$", 1)
    base = F.concat(tenant.cast("string"), F.lit("/"), F.regexp_extract(c, "^([^:]*):", 1), F.lit("_face_"), number.try_cast("decimal(38,0)").cast("string"))
    return F.when(number != "", F.struct(F.concat(base, F.lit(".jpg")).alias("crop"), F.concat(base, F.lit("_thumb.jpg")).alias("thumb")))


def stem_group(filename: Column) -> Column:
    """Group of a file: its stem up to the last underscore, the whole stem when it has none."""
    return F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), "_[^_]*$", "")


# ---- vectors --------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector as doubles; a zero vector stays as it is."""
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b) + 1e-9)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def has_dimension(v: Column, n: int) -> Column:
    return F.coalesce(F.size(v) == n, F.lit(False))


# ---- URLs -----------------------------------------------------------------
# parse_url gives null for hosts of URLs with spaces; plain patterns do not.

SCHEME, HOST, PATH, QUERY = r"^([A-Za-z][A-Za-z0-9+.\-]*):", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", r"\?([^#]*)"


def url_scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, SCHEME, 1))


def url_host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, HOST, 1))


def url_path(u: Column) -> Column:
    return F.regexp_extract(u, PATH, 1)


def query_keys(u: Column) -> Column:
    """Names of query parameters that have a value."""
    pairs = F.filter(F.split(F.regexp_extract(u, QUERY, 1), "&"), lambda p: p.rlike("^[^=]+=."))
    return F.transform(pairs, lambda p: F.regexp_extract(p, "^([^=]+)=", 1))


def normalize_url(u: Column) -> Column:
    return F.regexp_replace(u, "[;?#].*$", "")


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved, and without empty ones inside."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    closed = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    size = F.size(closed)
    inner = F.filter(closed, lambda x, i: (i > 0) & ((x != "") | (i == size - 1)))

    def step(done: Column, x: Column) -> Column:
        return F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(inner, F.array().cast("array<string>"), step), "/"))


def url_join(base: Column, link: Column, dots: bool = True) -> Column:
    """Absolute form of a link; ``./`` and ``../`` are resolved if ``dots``."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    joined = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, SCHEME, 1), F.lit(":"), link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), link))
        .when(link == "", base)
    )
    if dots:
        whole = F.when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))
        path = F.substring(F.regexp_extract(whole, r"^([^?#]*)", 1), F.length(root) + 1, F.length(whole))
        joined = joined.when(F.regexp_extract(link, "^([^?#]*)", 1).rlike(r"(^|/)\.\.?(/|$)"), F.concat(root, _without_dots(path), F.regexp_extract(whole, r"^[^?#]*(.*)$", 1)))
    return joined.when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))


def site_of(*fields: Column) -> Column:
    """First of the fields that names a site: as it is if it has no scheme, else its host without ``www.``."""
    named = [F.when(url_host(f) != "", url_host(f)).otherwise(F.nullif(F.trim(f), F.lit(""))) for f in fields]
    return F.regexp_replace(F.coalesce(*named, F.lit("unknown")), r"^www\.", "")


# Media types by extension.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml"}


def media_type_of(u: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), F.regexp_extract(F.lower(u), r"\.([a-z]+)$", 1))


def background_url(style: Column) -> Column:
    """Image of a style attribute's ``background`` or ``background-image``, quoted or not, but no ``data:`` URL."""
    found = F.regexp_extract(style, r"(?i)background(?:-image)?\s*:\s*[^;]*?url\(\s*[\"']?([^\"')]+?)[\"']?\s*\)", 1)
    return F.when((found != "") & ~found.startswith("data:"), found)


# ---- numbers and texts ----------------------------------------------------


def int_or_null(c: Column) -> Column:
    return c.try_cast("int")


def estimated_bytes(w: Column, h: Column) -> Column:
    return F.floor(w * h * 3 * 0.3).cast("long")


def clean_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def human_bytes(c: Column) -> Column:
    """1536 as ``1.5 KB``: powers of 1024 up to TB, one decimal, halves to even."""

    def shown(unit: str, power: int) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(c / 1024.0**power, 1)), F.lit(f" {unit}"))

    return F.when(c < 1024, shown("B", 0)).when(c < 1024**2, shown("KB", 1)).when(c < 1024**3, shown("MB", 2)).when(c < 1024**4, shown("GB", 3)).otherwise(shown("TB", 4))


def shorten(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b with a divisor of one at least."""
    return a / F.greatest(b, F.lit(1))


def typed(c: Column) -> Column:
    """A text as whole number, else as double, else as itself: struct of three columns, one of them set."""
    whole, real = c.try_cast("long"), c.try_cast("double")
    is_whole = c.rlike(r"^\s*[+-]?[0-9]+\s*$")
    return F.struct(F.when(is_whole, whole).alias("as_long"), F.when(~is_whole, real).alias("as_double"), F.when(~is_whole & real.isNull(), c).alias("as_text"))


def iso8601(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
