import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright import vocabulary as v
from maskwright.functions.text import canonical, normalised
from maskwright.operators import detect as d
from maskwright.operators import gold, verify
from maskwright.operators import quality as q
from maskwright.operators.resolve import resolve
from maskwright.operators.rewrite import collisions, mapping, spread
from maskwright.sources import office


def units(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k long, text string")


LONG = 1 << 17
HARD = [
    ("a@" + "b." * (LONG // 2), 0),
    ("a@" + "b." * 3000 + "com", 1),
    ("a@b_c@d.com", 1),
    ("www." + "a." * (LONG // 2) + "com", 1),
    ("www." * (LONG // 4), 0),
    ("www." + "com-" * (LONG // 4), 0),
    ("www." + "com-.x." * (LONG // 8), 1),
    ("4" * LONG, 0),
    ("4 " * (LONG // 2), 0),
    ("1." * (LONG // 2), 0),
    ("+91" + " 9" * (LONG // 2), 1),
    ("A" * LONG, 0),
    ("Ab " * (LONG // 3), 0),
    ("DOB: " * (LONG // 5), 0),
    ("promoters: " * (LONG // 11), 0),
]


def test_detectors_survive_any_text(spark):
    """Every pattern on long texts that repeat what it starts with."""
    found = dict(d.detect(units(spark, *[t for t, _ in HARD])).filter("ptype <> 'PERSON_NAME'").groupBy("k").count().collect())
    assert {i for i, (_, least) in enumerate(HARD) if least} <= found.keys() and not {0, 4, 5} & found.keys()


def test_many_matches_in_one_text(spark):
    text = "x@example.org " * 20_000
    rows = d.emails(units(spark, text)).agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("end"), F.countDistinct("start").alias("starts")).first()
    assert tuple(rows) == (20_000, len(text) - 1, 20_000)


URLS = [("see www.example.com-x.org/a now", "www.example.com-x.org/a"), ("www.a.com.input", "www.a.com.in"), ("www.ksh. com/x,y", "www.ksh. com/x"), ("http://a.b.c.co.uk.", "http://a.b.c.co.uk"), ("www.only.local", None), ("www.com-x", None), ("www.a.com-", "www.a.com")]


@pytest.mark.parametrize(("text", "expected"), URLS)
def test_web_addresses(spark, text, expected):
    assert [r["value"] for r in d.urls(units(spark, text)).collect()] == ([expected] if expected else [])


MAILS = [("a.@b.com x-y@z.org", ["x-y@z.org"]), ("a@b.com.", ["a@b.com"]), ("a@b.com-x c@d.e.net-", []), ("a@b.com.local7 q@r.com.x1", ["a@b.com", "q@r.com"]), ("a@-b.com a@b-.com", []), ("-a@b.com", [])]


@pytest.mark.parametrize(("text", "expected"), MAILS)
def test_mails(spark, text, expected):
    assert [r["value"] for r in d.emails(units(spark, text)).collect()] == expected


def test_headings_in_capitals_are_no_names(spark):
    got = d.all_caps_names(units(spark, "OUR PROMOTERS: THE OFFER DETAILS", "OUR PROMOTERS: ASHA RAO AND RAVI NAIR", "DIRECTORS: FRESH ISSUE"))
    assert {r["k"] for r in got.collect()} <= {1}


def test_collisions_see_every_kind(spark):
    fakes = ["John Doe", "4111 1111 1111 0001", "https://www.example.com/team", "00001234", "a.b*c\\E", "Absent Name", "abc"]
    u = units(spark, "by JOHN DOE, 4111 1111 1111 0001", "at https://www.example.com/team or a.b*c\\E", "no 00001234.", "John. Doe, xAbsent Name abc", None)
    maps = spark.createDataFrame([("T", f) for f in fakes], "ptype string, fake string")
    assert {r["fake"] for r in collisions(u, maps).collect()} == set(fakes[:5])


def test_compatibility_forms_share_a_key(spark):
    rows = spark.createDataFrame([("４１１１",), ("4111",), ("ﬁne",), (None,)], "t string").select(canonical("PHONE", normalised(F.col("t"))), normalised(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("4111", "4111"), ("4111", "4111"), ("", "fine"), (None, None)]
    spans = resolve(spark.createDataFrame([(1, 0, 4, "CREDIT_CARD", "４１１１", "r", 0), (2, 0, 4, "CREDIT_CARD", "4111", "r", 0)], "k long, start int, end int, ptype string, value string, source string, det_ord int"))
    assert mapping(spans).count() == 1


@pytest.mark.parametrize(("fake", "lengths"), [("KermarLow Industries", [3, 18, 7]), ("ab", [5, 5, 5]), ("abc", [9, 9, 9]), ("abcd", [1, 100]), ("x", [4]), ("abcdefgh", [0, 0, 3])])
def test_spread(spark, fake, lengths):
    rows = spark.createDataFrame([(fake, lengths, i) for i in range(len(lengths))], "f string, l array<int>, i int")
    got = [r[0] for r in rows.select(spread(F.col("f"), F.col("l"), F.col("i"))).collect()]
    assert "".join(got) == fake and (len(fake) < len(lengths) or all(got))


GOLD = "type string, part string, n long, k long, start int, end int, text string"


def test_scores_count_matches_once(spark):
    rows = [("P", "a", 1, 1, 0, 8, "Asha Rao"), ("P", "a", 2, 1, 10, 19, "Ravi Nair")]
    same = spark.createDataFrame(rows, GOLD)
    got = {r["type"]: r for r in q.score(same, same).collect()}
    assert (got["P"]["gold"], got["P"]["tp"], got["P"]["precision"], got["ALL"]["exact"]) == (2, 2, 1.0, 2)
    moved = spark.createDataFrame([("P", "a", 1, 2, 0, 8, "Asha Rao"), ("Q", "a", 1, 2, 0, 8, "zz")], GOLD)
    r = q.score(same, moved).filter("type = 'ALL'").first()
    assert (r["tp"], r["fp"], r["fn"], r["exact"]) == (1, 0, 1, 0)
    r = q.score(same, same.filter("false")).filter("type = 'P'").first()
    assert (r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0)
    assert [(x["kind"], x["text"]) for x in q.disagreements(same, moved).collect()] == [("missed", "Ravi Nair")]
    assert q.coverage(same, moved).filter("type = 'ALL'").first()["covered"] == 1


@pytest.mark.parametrize(("counts", "expected"), [((658, 89, 6, 46), (0.880857, 0.990964, 0.932672, 0.881101)), ((0, 0, 0, 0), (1.0, 1.0, 0.0, 1.0))])
def test_metric_arithmetic(spark, counts, expected):
    m = q.metrics(*[F.lit(x) for x in counts])
    r = spark.range(1).select(*[F.round(m[c], 6) for c in ("precision", "recall", "f1", "accuracy")]).first()
    assert tuple(r) == expected


def test_controls(spark):
    u = units(spark, "SEBI and Bid", "the Bid of Bid", None)
    spans = spark.createDataFrame([(1, 11, 14)], "k long, start int, end int")
    assert dict(map(tuple, q.negative_controls(u, spans, ["SEBI", "Bid", "Escrow"]).collect())) == {"SEBI": False, "Bid": True}
    assert gold.present_controls(u) == ["SEBI", "Bid"]
    with pytest.raises(ValueError):
        gold.present_controls(u, ["Bid House, Pune"])


def test_residual_classes(spark):
    maps = spark.createDataFrame([("ADDRESS", "Maharashtra, India", "x"), ("PERSON_NAME", "Asha", "y"), ("SSN", "1-2", "z")], "ptype string, original string, fake string")
    after = units(spark, "located in Maharashtra, India", "Pune 411 001 - Maharashtra,India", "12, Maharashtra India", "MAHARASHTRA  INDIA", "ashaR Asha", "1-2", "Maharashtra of India", None)
    got = {r["k"]: r["state"] for r in verify.residual(after, maps).collect()}
    assert got == {0: "prose", 1: "leak", 2: "leak", 3: "leak", 4: "leak"}


def test_report(spark):
    pairs = spark.createDataFrame([(1, "a b", "a  b"), (2, "x", "x" * 20), (3, None, "y")], "k long, old string, new string")
    got = {r["name"]: r for r in verify.report({"blanks": verify.doubled_blanks(pairs), "growth": verify.grown(pairs), "none": pairs.filter("false")}).collect()}
    assert [got[n]["offenders"] for n in ("blanks", "growth", "none")] == [1, 1, 0] and got["none"]["ok"] and '"k":1' in got["blanks"]["examples"]


def test_sources_and_parts(spark, tmp_path):
    src = tmp_path / "in"
    for folder in ("a", "b"):
        (src / folder).mkdir(parents=True)
        (src / folder / "x.docx").write_bytes(office.sample([f"SSN 123-45-6789 in {folder}"], [["DIN", "00135467"]]))
    files = office.read_files(spark, str(src))
    spans = d.scan(office.read_units(files), within="sequence")
    out = office.save(office.write_packages(files, spans.select("k", "start", "end", F.lit("X").alias("fake"))), str(tmp_path / "out"), str(src))
    assert {r["target"] for r in out.collect()} == {str(tmp_path / "out" / f / "x.docx") for f in ("a", "b")}
    done = office.read_files(spark, str(tmp_path / "out"))
    parts = lambda f: office.read_parts(f).withColumn("path", F.regexp_extract("path", "[ab]/x.docx$", 0))
    assert verify.part_parity(parts(files), parts(done)).count() == 0 and verify.structure(parts(files), parts(done)).count() == 0
    digest = files.select("path", F.sha2("content", 256).alias("sha256"))
    assert verify.wrong_sources(files, digest).count() == 0 and verify.wrong_sources(files, digest.withColumn("sha256", F.lit("0"))).count() == 2
    g = gold.annotate(office.read_gold_units(done), ["Asha Rao"])
    assert [(r["type"], r["text"]) for r in g.collect()] == []
    assert [(r["type"], r["text"]) for r in gold.annotate(office.read_gold_units(files)).distinct().collect()].count(("DIN", "00135467")) == 2


def test_gold_reads_every_part(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", '<w:a xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one </w:t><w:delText>gone</w:delText><w:instrText>two</w:instrText></w:r></w:p></w:a>')
        z.writestr("word/bad.xml", "<a")
    files = spark.createDataFrame([("p", bytearray(out.getvalue()))], "path string, content binary")
    assert [(r["k"]["part"], r["text"]) for r in office.read_gold_units(files).collect()] == [("word/styles.xml", "one two")]


def test_vocabulary_counts():
    assert (len(v.NEGATIVE_CONTROLS), len(v.STRUCTURE_TAGS), len(v.ALL_CAPS_DENY)) == (46, 16, 27)


def test_disagreements_of_many_small_groups(spark):
    """Groups are read off sorted rows; a call of Python for each took minutes for this number of them."""
    gold = spark.range(0, 40000, numPartitions=4).selectExpr("'T' AS type", "id AS part", "inline(array(struct(1L AS n, 'qwertyuiop' AS text), struct(2L AS n, '0123456789' AS text)))")
    found = gold.filter("n = 2 OR part % 7 <> 0").union(spark.range(0, 40000, 11).selectExpr("'T'", "id", "3L", "'zzz'"))
    began = time.time()
    got = q.disagreements(gold, found, 1 << 20).collect()
    assert time.time() - began < 30
    want = [("T", "missed", p, 1, "qwertyuiop") for p in range(0, 40000, 7)] + [("T", "extra", p, 3, "zzz") for p in range(0, 40000, 11)]
    assert [tuple(r) for r in got] == want


def test_groups_go_on_over_batches_and_take_null_parts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        gold = spark.createDataFrame([("A", p, i, t) for p in (1, None) for i, t in enumerate(["abcd", "abce", None, "xyz", "abcd"])] + [(None, 1, 9, "abcd")], "type string, part int, n long, text string")
        found = spark.createDataFrame([("A", p, i, t) for p in (1, None) for i, t in enumerate(["abce", "abcd", None, "q"])] + [("B", 1, 0, "abcd"), (None, 1, 5, "abcd")], "type string, part int, n long, text string")
        got = {(r["type"], r["part"], r["n"]): (r["found_n"], r["similarity"]) for r in q.match(gold, found).collect()}
        one = {0: (1, 1.0), 1: (0, 1.0), 2: (None, None), 3: (None, None), 4: (None, None)}
        assert got == {("A", p, i): x for p in (1, None) for i, x in one.items()} | {(None, 1, 9): (5, 1.0)}
        rest = [(r["kind"], r["part"], r["n"], r["text"]) for r in q.disagreements(gold, found).collect()]
        assert rest == [("missed", p, i, t) for p in (None, 1) for i, t in ((2, None), (3, "xyz"), (4, "abcd"))] + [("extra", p, i, t) for p in (None, 1) for i, t in ((2, None), (3, "q"))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
