import hashlib
import random
import re

from mediaops.llm.exact_dedup import exact_groups

DOCS = "doc_id long, text string, sha string, lead_id string"


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for n, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), hashlib.sha256(n.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "a b", "ab", "a b", "é é", "éé\x0b", "y" * 300_000, "y " * 300_000]
    texts += ["hot text of a third"] * 400 + [f"p{'x' * 40} {rng.randint(0, 200)}" for _ in range(600)]
    rng.shuffle(texts)
    rows = [(i, t, "clash", None) for i, t in enumerate(texts)] + [(None, "a b", "", ""), (5, texts[5], "", "")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    got = exact_groups(spark.createDataFrame(rows, DOCS)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_tie_between_rows_of_one_identifier_whatever_their_order(spark):
    a, b = ([(7, "equal texts", "", None, name)] for name in ("first", "second"))
    many = [(7, "hot " * 9, "", None, f"r{i:04d}") for i in range(900)]
    frames = [spark.createDataFrame(x, f"{DOCS}, row string") for x in (a, b, many[::-1])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    for order in ((0, 1, 2), (1, 0, 2), (2, 1, 0)):
        table = frames[order[0]].union(frames[order[1]]).union(frames[order[2]]).repartition(5)
        assert {r.row for r in exact_groups(table, row_col="row").collect() if r.kept} == {"first", "r0000"}
    spark.conf.set("spark.sql.shuffle.partitions", before)
