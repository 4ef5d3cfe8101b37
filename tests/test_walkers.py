import re

import pytest

from maskwright.functions.companies import company_name
from maskwright.functions.fakes import Fakes
from maskwright.operators import detect as d
from maskwright.operators import walkers as w
from maskwright.operators.rewrite import mapping, redact
from pyspark.sql import functions as F

HITS = [
    (w._company_hits, "appointed Alder Freight Private Limited as agent", ["Alder Freight Private Limited"]),
    (w._company_hits, "Kirtane & Pandit, LLP, and CARE Analytics and Advisory Private Limited", ["Kirtane & Pandit, LLP", "CARE Analytics and Advisory Private Limited"]),
    (w._company_hits, "Bankers to the Offer HDFC Bank Limited", ["HDFC Bank Limited"]),
    (w._company_hits, "Switchgear Co., Bharat Bijlee Limited", ["Bharat Bijlee Limited"]),
    (w._company_hits, "our Private Limited company", []),
    (w._company_hits, "State Financial Corporation Limited", ["State Financial Corporation Limited"]),
    (w._contact_hits, "Contact Person: Rohan Mehta / Asha Rao, Company Secretary", ["Rohan Mehta", "Asha Rao"]),
    (w._contact_hits, "Contact Person: Rohan Mehta E-mail a@b.example", []),
    (w.address_hits, "45 Park Street, Pune 411001", ["45 Park Street, Pune 411001"]),
    (w.address_hits, "Plot No. 4, Road 7, Chakan", ["Plot No. 4, Road 7, Chakan"]),
    (w.address_hits, "Registered Office: 12 Maple Road, Pune – 411 001, Maharashtra, India. Then more", ["12 Maple Road, Pune – 411 001, Maharashtra, India"]),
    (w.address_hits, "total of 411001 shares", []),
    (w.address_hits, "the road to Pune is long", []),
    (w.continuation_hits, "801-804, Wing A, Building No 3", ["801-804, Wing A, Building No 3"]),
    (w.continuation_hits, "and the building was sold", []),
    (w._company_hits, "sold to\u00a0Alder\u00a0Freight Private Limited", ["Alder\u00a0Freight Private Limited"]),
    (w._company_hits, "Alder Limited and Birch & Sons Private Limited", ["Alder Limited", "Birch & Sons Private Limited"]),
    (w._company_hits, "and KSH Infra Park 5 Private Limited, Cedar LLP", ["KSH Infra Park 5 Private Limited", "Cedar LLP"]),
    (w.address_hits, "at 12 Maple\u00a0Road, Pune\u00a0\u2013\u00a0411 001", ["12 Maple\u00a0Road, Pune\u00a0\u2013\u00a0411 001"]),
]


NBSP = "\u00a0"
NAMES = [
    (["Asha Rao"], f"with Asha{NBSP}Rao.", ["PERSON_NAME"], [f"Asha{NBSP}Rao"]),
    (["Asha Rao", "Rao"], "AshaRao, ASHA RAO; rao Rao Asharao2 xAsha Rao", ["PERSON_NAME"] * 5, ["AshaRao", "ASHA RAO", "Rao", "Asharao", "Rao"]),
    (["Asha Rao", "Asha Rao Nair"], "Asha Rao Nair", ["PERSON_NAME"], ["Asha Rao Nair"]),
    (["Asha Rao"], "the Asha Rao HUF", ["COMPANY"], ["Asha Rao HUF"]),
    (["K S"], "by K S alone", ["PERSON_NAME"], ["K S"]),
]


@pytest.mark.parametrize(("names", "text", "types", "expected"), NAMES)
def test_listed_names(names, text, types, expected):
    hits = sorted(w._people_finder(w.Names(names))(text))
    assert [text[a:b] for a, b, _, _ in hits] == expected and [t for _, _, t, _ in hits] == types


def test_listed_companies_allow_other_blanks():
    find = w._companies_finder(w._organisations(["Alder Freight", "Alder", "Sebi"]))
    for text in ("Alder Freight", "AlderFreight", "Alder  Freight", f"Alder{NBSP}Freight"):
        assert [text[a:b] for a, b, _, _ in find(f"{text}")] == [text]
    assert not list(find("ALDER FREIGHT and SEBI")) and [x[:2] for x in find("Alder Freights")] == [(0, 5)]


def test_long_lists_cost_a_look_up_a_word():
    names = w.Names(f"Name{i} Surname{i}" for i in range(50_000))
    text = "prose of many words " * 5000 + "Name777 Surname777"
    assert [x[2:] for x in names.hits(text)] == [(len(text) - 18, len(text))]


def brute_names(names, text):
    """Patterns one by one over the whole text, the longest name first."""
    taken, out = [], []
    for n in sorted(set(names), key=lambda n: (-len(n), n)):
        body = r"[ \u00a0]*".join(map(re.escape, n.split()))
        for p in [body] + ([f"(?i:{body})"] if len(n.split()) > 1 else []):
            for m in re.finditer(rf"(?<![A-Za-z]){p}(?![A-Za-z])", text):
                if all(m.end() <= a or b <= m.start() for a, b in taken):
                    taken.append(m.span())
                    out.append(m.span())
    return sorted(out)


def test_names_equal_brute_force(spark):
    names = ["Le Rao", "La", "De la", "the", "An Da", "Mr An", "Rao De", "a"]
    texts = [r["text"][:3000] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    for t in [*texts, "Le Rao De la LERAO An  DaMr An da an da"]:
        assert sorted(w.Names(names).places(t)) == brute_names(names, t)


def test_learned_names_leave_companies_whole(spark):
    texts = ["Kushal Motors and Electricals Private Limited", "with Kushal Motors and Electricals Private Limited", "Rakhi Branch and Rohit Branch", "Rakhi Branch spoke", "Kushal Limited, Kushal Limited"]
    u = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    people = ["Kushal Hegde", "Rakhi Rao", "Rohit Rao"]
    assert {r["pair"]: r["n"] for r in w.learned_pairs(u, people).collect()} == {"Kushal Motors": 2, "Rakhi Branch": 2}
    got = sorted((r["k"], r["value"], r["ptype"]) for r in d.scan(u, people).collect())
    company = "Kushal Motors and Electricals Private Limited"
    assert got == [(0, company, "COMPANY"), (1, company, "COMPANY"), (2, "Rakhi Branch", "PERSON_NAME"), (3, "Rakhi Branch", "PERSON_NAME"), (4, "Kushal Limited", "COMPANY"), (4, "Kushal Limited", "COMPANY")]


LINES = [
    (["KSH", "Distriparks Private", "Limited"], [3, 3, 3], [], ["KSH", "Distriparks Private", "Limited"]),
    (["KSH", "Distriparks", "Private Limited"], [3, 3, 3], [], None),  # the form stands in the last line alone
    (["Alder", "Freight Private", "Limited"], [1, 2, 3], [], None),  # cells differ
    (["Sponsor Bank", "Alder Private", "Limited"], [4, 4, 4], [], ["Alder Private", "Limited"]),
    (["with DHAULAGIRI", "FAMILY TRUST of"], [-1, -1], ["Dhaulagiri Family Trust"], ["DHAULAGIRI", "FAMILY TRUST"]),
    (["see the page", "below it", "x"], [1, 1, 1], ["Page below"], None),
]


@pytest.mark.parametrize(("lines", "cells", "listed", "expected"), LINES)
def test_names_over_several_lines(spark, lines, cells, listed, expected):
    rows = [(i, 7, c, t) for i, (t, c) in enumerate(zip(lines, cells))] + [(90, 8, cells[-1], "Limited")]
    u = spark.createDataFrame(rows, "k long, part int, cell int, text string")
    got = w.split_lines(u, "part", (), listed).select("k", F.inline("_split")).orderBy("k").collect()
    assert [r["value"] for r in got] == (expected or [])
    if expected:
        assert {tuple(r["whole"]["lengths"]) for r in got} == {tuple(map(len, expected))} and [r["whole"]["piece"] for r in got] == list(range(len(expected)))


def test_a_broken_name_gets_one_substitute_over_its_pieces(spark):
    rows = [(1, 1, 5, "KSH"), (2, 1, 5, "Distriparks Private"), (3, 1, 5, "Limited"), (4, 1, -1, "KSH Distriparks Private Limited again"), (5, 1, 6, None), (6, 1, 6, "")]
    u = spark.createDataFrame(rows, "k long, part int, cell int, text string")
    spans = d.scan(u, (), (), "part")
    maps = mapping(spans)
    assert [(r["original"], r["ptype"]) for r in maps.collect()] == [("KSH Distriparks Private Limited", "COMPANY")]
    out = dict(map(tuple, redact(u, spans, maps).collect()))
    fake = maps.first()["fake"]
    assert out[1] + out[2] + out[3] == fake and all(out[i] for i in (1, 2, 3)) and out[4] == fake + " again" and out[5] is None


@pytest.mark.parametrize(("find", "text", "expected"), HITS)
def test_hits(find, text, expected):
    assert [text[a:b] for a, b, _, _ in find(text)] == expected


@pytest.mark.parametrize("find", [w._company_hits, w._contact_hits, w.address_hits, w.continuation_hits])
def test_nothing_in_nothing(find):
    assert list(find(None)) == list(find("")) == list(find(" \n")) == []


def test_trimmed():
    text = " and Alder Limited, "
    assert text[slice(*w.trimmed(text, 0, len(text)))] == "Alder Limited"
    text = "and so on"
    assert text[slice(*w.trimmed(text, 0, len(text)))] == "and so on"


@pytest.mark.parametrize("name", ["KSH Infra Park 5 Private Limited", "Nuvama", "Cindus Corporation", "Kirtane & Pandit, LLP", "EVEREST FAMILY TRUST"])
def test_company_shape(name):
    fake = company_name(name, lambda pool, tag: pool[0])
    assert len(fake) <= max(len(name), 3) and len(fake.split()) == len(name.split())
    assert fake.isupper() == name.isupper()


def test_form_alone_gains_a_word():
    assert company_name("Limited", lambda pool, tag: pool[0]).endswith(" Limited")


def test_phone_and_url_substitutes(spark):
    f = Fakes()
    rows = spark.createDataFrame([("+91 22 4009 4400",), ("022-68052182",), ("+91 2240094400",)], "p string").select("p", f.phone(f.subscriber(F.col("p")), F.col("p"))).collect()
    for p, fake in rows:
        assert [c.isdigit() for c in p] == [c.isdigit() for c in fake] and p != fake and p[:3] == fake[:3]
    strip = lambda t: t.replace(" ", "")
    assert strip(rows[0][1]) == strip(rows[2][1])
    urls = ["https://www.alder-freight.org/reports/a1?id=7", "www.ab.in", "http://x.co/team", "www.alder.com/"]
    for u, fake in spark.createDataFrame([(u,) for u in urls], "u string").select("u", f.url(F.col("u"))).collect():
        assert len(fake) <= len(u) and "alder" not in fake
    assert spark.createDataFrame([("http://www.alder.com/desk/9",)], "u string").select(f.url(F.col("u"))).first()[0] == "http://example.com/desk/9"


def test_scan_links_lines_and_listed_names(spark):
    texts = ["801-804, Wing A, Building No 3", "Bandra East Mumbai 400 051", "Maharashtra, India", "held by Asha Rao Family Trust and ASHA RAO", None, "", "with Nuvama on +91 22 4009 4400", "or +91 2240094400"]
    u = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "k long, text string, part int")
    spans = d.scan(u, ["Asha Rao"], ["Nuvama"], "part")
    got = sorted((r["k"], r["value"], r["ptype"], r["source"]) for r in spans.collect())
    assert got == [
        (0, texts[0], "ADDRESS", "continuation"),
        (1, texts[1], "ADDRESS", "pin"),
        (2, texts[2], "ADDRESS", "continuation"),
        (3, "ASHA RAO", "PERSON_NAME", "gazetteer"),
        (3, "Asha Rao Family Trust", "COMPANY", "family-trust"),
        (6, "+91 22 4009 4400", "PHONE", "regex"),
        (6, "Nuvama", "COMPANY", "gazetteer"),
        (7, "+91 2240094400", "PHONE", "regex"),
    ]
    out = dict(map(tuple, redact(u, spans, mapping(spans)).collect()))
    a, b = out[6].split(" on ")[1], out[7][3:]
    assert a.replace(" ", "") == b.replace(" ", "") and len(a) == 16 and len(b) == 14
    assert out[4] is None and out[5] == ""


def test_lists_are_refused_above_their_bound(spark, tmp_path):
    (tmp_path / "names").write_text("# people\nAsha Rao\n\nRavi Nair # chair\nAsha Rao\n")
    assert w.read_names(spark, str(tmp_path / "names")) == ["Asha Rao", "Ravi Nair"]
    with pytest.raises(ValueError):
        w.read_names(spark, str(tmp_path / "names"), most=1)
