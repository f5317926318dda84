import random

import pytest
from pyspark.sql import functions as F

from mediaops.functions import predicates as P
from mediaops.functions import scalars as S

def test_hamming(spark):
    rng = random.Random(1)
    digits = lambda: "".join(rng.choices("0123456789abcdefABCDEF", k=rng.choice([0, 1, 3, 4, 8, 15, 16, 17, 31, 32, 64])))
    pairs = [(a, b, (int(a or "0", 16) ^ int(b or "0", 16)).bit_count()) for a, b in ((digits(), digits()) for _ in range(200))]
    pairs += [(f" {a}", f"{b} ", d) for a, b, d in pairs[:5]] + [(None, "1", None), ("1", None, None), ("", "", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    for r in df.select("*", S.hamming_hex(F.col("a"), F.col("b")).alias("x"), S.hamming_hex(F.col("b"), F.col("a")).alias("y")).collect():
        assert r.x == r.y == r.d


def test_derived_keys(spark):
    rows = [("abc:face_1", "t/abc_face_1"), ("abc:face_007", "t/abc_face_7"), (":face_2", "t/_face_2"), ("a:face_3_x", "t/a_face_3"), ("abc", None), ("abc:body_1", None), ("abc:face_", None), ("abc:face_x", None), (None, None)]
    for r in spark.createDataFrame(rows, "k string, base string").select("base", S.derived_keys(F.col("k"), F.lit("t")).alias("got")).collect():
        assert (r.got and tuple(r.got)) == (r.base and (f"{r.base}.jpg", f"{r.base}_thumb.jpg"))


URLS = [
    ("https://example.com/page", "SAFE"), ("http://example.com", "SAFE"), ("https://e.com/a b", "SAFE"), ("javascript:alert(1)", "MALICIOUS_SCHEME"), ("data:text/html,x", "MALICIOUS_SCHEME"), ("file:///etc/passwd", "MALICIOUS_SCHEME"),
    ("ftp://example.com/f", "MALICIOUS_SCHEME"), ("https://example.com/a.exe", "SUSPICIOUS_EXTENSION"), ("https://example.com/A.PHP?x=1", "SUSPICIOUS_EXTENSION"), ("https://example.com/?download=1", "BAIT_QUERY_PARAM"), ("https://example.com/?a=1&go=x", "BAIT_QUERY_PARAM"),
    ("https://example.com/?download=", "SAFE"), ("https://malware.example.com/x", "BLOCKED_HOST"), ("https://a.tk/", "BLOCKED_TLD"), ("not-a-url", "VALIDATION_ERROR"), ("", "VALIDATION_ERROR"), (None, "VALIDATION_ERROR"),
]


def test_url_class(spark):
    df = spark.createDataFrame(URLS, "u string, want string")
    for r in df.select("*", P.url_class(F.col("u")).alias("got"), P.url_class(F.col("u"), True).alias("strict"), P.redirect_class(F.col("u"), F.lit(1)).alias("hop"), P.redirect_class(F.col("u"), F.lit(3)).alias("late")).collect():
        assert r.got == r.want and r.late == "TOO_MANY_REDIRECTS"
        assert r.hop == ("SAFE" if r.want == "SAFE" else f"REDIRECT_{r.want}")
    assert spark.createDataFrame([("gopher://e.com/x",)], "u string").select(P.url_class(F.col("u"), True)).first()[0] == "UNSAFE_SCHEME"


@pytest.mark.parametrize(("kind", "size", "want"), [("image/jpeg", 10, "SAFE"), ("image/png; q=1", 8_388_608, "SAFE"), ("image/png", 8_388_609, "CONTENT_TOO_LARGE"), ("image/svg+xml", 1, "SKIP_SVG"), ("text/html", 1, "NOT_IMAGE_CONTENT"), ("", 1, "NO_CONTENT_TYPE"), (None, None, "NO_CONTENT_TYPE"), ("image/gif", None, "SAFE")])
def test_content_class(spark, kind, size, want):
    assert spark.createDataFrame([(kind, size)], "k string, n long").select(P.content_class(F.col("k"), F.col("n"))).first()[0] == want


def test_url_join(spark):
    from urllib.parse import urljoin

    base = "https://example.com/a/b?q=1#f"
    links = ["https://x.org/y", "//cdn.org/i.png", "/root", "leaf", "../up", "./here", "?p=2", "#top", "a/../b", "mailto:x@y", "..", ".", "../../../far?q=../x#../y", "/a/./b/../c/", "/..", "x/..", "x/.?y", "a..b", "?x=../y", "/a?b=/../c"]
    df = spark.createDataFrame([(x,) for x in links], "x string")
    for r in df.select("x", S.url_join(F.lit(base), F.col("x")).alias("got")).collect():
        assert r.got == urljoin(base, r.x), r.x


def test_text_functions(spark):
    row = spark.range(1).select(
        S.human_bytes(F.lit(1536)).alias("a"), S.human_bytes(F.lit(5)).alias("b"), S.human_bytes(F.lit(3 * 1024**4)).alias("c"), S.shorten(F.lit("abcdef"), 3).alias("d"), S.stem_group(F.lit("anna_1_2.jpg")).alias("e"), S.stem_group(F.lit("anna.jpg")).alias("f"),
        S.site_of(F.lit(None).cast("string"), F.lit(" "), F.lit("https://www.example.com/x")).alias("g"), S.site_of(F.lit(None).cast("string")).alias("h"), S.background_url(F.lit("color:red; background-image: url('/i.png')")).alias("i"),
        S.background_url(F.lit("background: url(data:x)")).alias("j"), S.typed(F.lit("12")).alias("k"), S.typed(F.lit("1.5")).alias("l"), S.typed(F.lit("x")).alias("m"), S.media_type_of(F.lit("http://e.com/A.JPEG")).alias("n"),
    ).first()
    assert row[:10] == ("1.5 KB", "5.0 B", "3.0 TB", "abc...", "anna_1", "anna", "example.com", "unknown", "/i.png", None)
    assert tuple(row.k) == (12, None, None) and tuple(row.l) == (None, 1.5, None) and tuple(row.m) == (None, None, "x")
    assert row.n == "image/jpeg"


def test_normalise_twice_is_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    once, twice = (df.select(f(F.col("v"))).collect() for f in (S.l2_normalize, lambda v: S.l2_normalize(S.l2_normalize(v))))
    assert once == twice and once[0][0] == [0.6, 0.8] and once[1][0] == [0.0, 0.0]


QUALITY = [(100, 100, 600.0, None, None, [], True), (10, 100, 600.0, 0.0, 0.0, ["too_small"], False), (100, 100, 10.0, 0.0, 0.0, ["not_sharp"], False), (100, 100, 600.0, -30.0, 40.0, ["angle1_too_large", "angle2_too_large"], False), (80, 80, 80.0, 24.0, 24.0, [], False)]


def test_quality_gate(spark):
    df = spark.createDataFrame(QUALITY, "w int, h int, s double, a double, b double, reasons array<string>, usable boolean")
    for r in df.select("*", P.quality_gate(F.col("w"), F.col("h"), F.col("s"), F.col("a"), F.col("b")).alias("g")).collect():
        assert r.g.reasons == r.reasons and r.g.usable == r.usable


def test_good_and_bad_are_all(spark):
    df = spark.createDataFrame([("a", "1"), (None, "2"), ("", None)], "x string, y string")
    good, bad = P.split_valid(df, ["x", "y"])
    assert good.count() == 1 and sorted(r.error for r in bad.collect()) == ["missing: x", "missing: x,y"]


def test_scope_needs_a_tenant(spark):
    with pytest.raises(ValueError):
        P.scoped(spark.range(1), None)


def test_magic(spark):
    rows = [(b"\xff\xd8\xff\xe0",), (b"\x89PNG\r\n\x1a\n1",), (b"GIF89a",), (b"BM12",), (b"text",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "c binary").select(P.sniff_type(F.col("c"))).collect()] == ["image/jpeg", "image/png", "image/gif", "image/bmp", None, None]
