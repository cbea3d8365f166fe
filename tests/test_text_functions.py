"""Golden vectors of our own for the text columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rolegrid.functions import keys, labels
from rolegrid.functions import patterns as P
from rolegrid.functions.salary import with_salary
from rolegrid.functions.tags import DEFAULT_DICTIONARY, Alias, text_tags
from rolegrid.functions.text import html_to_text, search_form, trim_white
from rolegrid.functions.trigram import similarity, trigrams
from rolegrid.operators.tagging import dictionary_tags


def column(spark, rows, fields, expr):
    schema = "i int, " + ", ".join(f"{f} string" for f in fields)
    data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    out = spark.createDataFrame(data, schema).select("i", expr.alias("v")).orderBy("i")
    return [r.v for r in out.collect()]


MILLION, THOUSAND = 1_000_000, 1_000
UNITS = {"jt": MILLION, "juta": MILLION, "jutaan": MILLION, "rb": THOUSAND, "ribu": THOUSAND, "ribuan": THOUSAND}
BETWEEN = ("-", "–", "—", "~", "s/d", "s.d.", "sampai", "sampai dengan", "hingga")
AT_MOST = ("up to", "hingga", "maksimal", "maks", "max", "sampai", "sampai dengan")
AT_LEAST = ("mulai dari", "minimal", "min", "dari", "mulai", "start from", "from")
VAGUE = ("negotiable", "competitive", "nego", "kompetitif", "undisclosed", "confidential", "tbd")
FOREIGN = ("$", "€", "£", "USD", "sgd", "MYR", "eur", "GBP")
PERIODS = ("/bulan", "/ bln", "/month", " per bulan", " per month")


def salary_cases():
    """Texts written out from their parts, with the bounds the parts mean."""
    n = 10
    for unit, factor in UNITS.items():
        for glue in BETWEEN:
            n += 1
            low, high = n, n + 5
            shown = f" {glue} " if glue[0].isalpha() or n % 2 else glue
            yield f"{low}{shown}{high} {unit}", low * factor, high * factor, "range"  # one unit for both
            yield f"Rp {high}{unit}{shown}IDR {low}{unit}", low * factor, high * factor, "range"  # swapped
        for word in AT_MOST:
            yield f"{word} {n} {unit}", None, n * factor, "estimated"
        for word in AT_LEAST:
            yield f"Gaji {word} {n}{unit}", n * factor, None, "estimated"
        for mark in ".,":
            for digits in (1, 2):  # a fraction of the unit
                yield f"{n}{mark}{'5' * digits} {unit}", *2 * (round((n + int("5" * digits) / 10 ** digits) * factor),), "exact"
            yield f"{n}{mark}250 {unit}", *2 * ((n * 1000 + 250) * factor,), "exact"  # a group of three is no fraction
    for mark in ".,":
        for lead in ("", "Rp", "rp. ", "IDR "):
            full = 8 * MILLION + 400 * THOUSAND
            yield f"{lead}8{mark}400{mark}000", full, full, "exact"
            yield f"{lead}8{mark}400{mark}000 - {lead}9{mark}100{mark}000", full, 9_100_000, "range"
    for period in PERIODS:
        yield f"4-7jt{period}", 4 * MILLION, 7 * MILLION, "range"
        yield f"max IDR 7000000{period}", None, 7 * MILLION, "estimated"
    for word in VAGUE:
        yield f"{word.title()}, 6 juta", None, None, "unknown"
    for word in FOREIGN:
        yield f"{word} 1200", None, None, "unknown"
    for blank in ("", " \t ", "~", "gaji menarik", "9" * 26, "8..1"):
        yield blank, None, None, "unknown"
    yield "4 - 8..1 juta", 4, 4, "exact"  # a bad second number: the first stands alone
    yield "negosiasi 6jt", 6 * MILLION, 6 * MILLION, "exact"  # a longer word is not the vague one


def test_salary(spark):
    cases = list(salary_cases())
    assert len(cases) > 200
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(cases)],
                               "i int, salary_raw string")
    got = [tuple(r)[2:] for r in with_salary(df).orderBy("i").collect()]
    assert [(c[0], g) for c, g in zip(cases, got, strict=True)] == [(c[0], c[1:]) for c in cases]


HEADINGS = [f"h{i}" for i in range(1, 7)]
CLOSING = ["p", "div", *HEADINGS]  # a line break on both sides
OPENING = ["ul", "ol"]  # a line break in front only
INLINE = ["b", "i", "em", "strong", "span", "a", "unknown"]


def cleaning_cases():
    """Markup written out from tag kinds and nestings, with the lines it means."""
    for tag in CLOSING:
        yield f"x<{tag}>y</{tag}>z", "x\ny\nz"
        yield f"<{tag.upper()} class='k'>y</{tag.upper()}><{tag}>z</{tag}>", "y\n\nz"
        for inner in INLINE:
            yield f"<{tag}>sp<{inner}>li</{inner}>t</{tag}>", "split"
    for tag in OPENING:
        yield f"x<{tag}>y</{tag}>z", "x\nyz"
        for k in (1, 2, 3):
            items = [f"item {i}" for i in range(k)]
            yield f"<{tag}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{tag}>", "\n".join(f"- {x}" for x in items)
            yield f"<{tag}>\n" + "\n".join(f" <li> {x}\t </li>" for x in items) + f"</{tag}>", "\n".join(f"- {x}" for x in items)
    for br in ("<br>", "<br/>", "<BR >"):
        yield f"x{br}y{br}z", "x\ny\nz"
    for raw in ("script", "style", "SCRIPT", "Style"):
        yield f"x<{raw} a='1'>p > q '<p>'</{raw}>y", "xy"
        yield f"x<{raw}>open to the end", "x"
    for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#67", "C"), ("#x44", "D"), ("uuml", "ü")):
        yield f"k&{name};m", f"k{char}m"
        yield f"k&amp;{name};m", f"k&{name};m"  # decoded once
    yield "k&nbsp;m&nbsp;&nbsp;n", "k m n"
    yield "k&missing;m", "k&missing;m"
    for gap in (" ", "\n", " \t\n "):
        yield f"k{gap}m", "k m"
        yield f"<b>k</b>{gap}<i>m</i>", "km"  # white space alone between tags is no text
    yield "k<!-- <p>m</p> -->n", "kn"
    yield "<!DOCTYPE html>k", "k"
    yield '<p title="k > m" data-x=\'<li>\'>n</p>', "n"
    yield "2 < 3 and 3 > 2", "2 < 3 and 3 > 2"
    yield "plain", "plain"
    yield "", ""


def test_cleaning(spark):
    cases = list(cleaning_cases())
    assert len(cases) > 100
    got = column(spark, [c[0] for c in cases], ["html"], html_to_text(F.col("html")))
    assert [(c[0], g) for c, g in zip(cases, got, strict=True)] == cases


MODES = [
    (("Engineer", "Medan, Indonesia", ""), "onsite"),
    (("Engineer", "", ""), "unknown"),
    (("Engineer", " \t ", ""), "unknown"),
    (("Engineer", "Medan (Hybrid)", "full WFH"), "hybrid"),
    (("Engineer (Remote)", "", ""), "remote"),
    (("Engineer", "", "you work remotely"), "remote"),
    (("Engineer", "Medan", "kerja jarak jauh"), "remote"),
    (("Engineer", "", "on-site"), "onsite"),
    (("Engineer", "", "2 days WFO"), "onsite"),
    (("Engineer", "", "remoteness is not remote_work"), "unknown"),
    (("Engineer", "", "éremoteé"), "remote"),
]


def test_mode(spark):
    got = column(spark, [m[0] for m in MODES], ["t", "l", "d"],
                 labels.work_mode(F.col("t"), F.col("l"), F.col("d")))
    assert got == [m[1] for m in MODES]


LEVELS = [
    (("Lead Senior Dev", ""), "lead"),
    (("Senior Junior", ""), "senior"),
    (("Junior Intern", ""), "junior"),
    (("Internship", ""), "intern"),
    (("Program Magang", ""), "intern"),
    (("Leader", ""), "unknown"),
    (("Dev", "0 years experience"), "junior"),
    (("Dev", "1 year of experience"), "junior"),
    (("Dev", "2 years of experience"), "mid"),
    (("Dev", "4+ years experience"), "mid"),
    (("Dev", "5 years of experience"), "senior"),
    (("Dev", "3-7 years of experience"), "mid"),
    (("Dev", "1 to 7 years experience"), "junior"),
    (("Dev", "6 year's experiences"), "senior"),
    (("Dev", "6 years' experience"), "senior"),
    (("Dev", "experience: minimum 4 years"), "mid"),
    (("Dev", "at least 2 years in a team"), "mid"),
    (("Dev", "minimum 1 year here"), "junior"),
    (("Dev", "7+ years building"), "senior"),
    (("Dev", "21+ years old"), "unknown"),
    (("Dev", "21+ years old, minimal 3 tahun"), "mid"),
    (("Dev", "21+ years old and 3+ years coding"), "unknown"),
    (("Dev", "min. 2 tahun"), "mid"),
    (("Dev", "6 tahun pengalaman"), "senior"),
    (("Dev", "pengalaman kerja minimal 1 tahun"), "junior"),
    (("Dev", "99999999999999999999 years of experience"), "unknown"),
    (("Senior Dev", "1 year of experience"), "senior"),
    (("", ""), "unknown"),
]


def test_level(spark):
    got = column(spark, [m[0] for m in LEVELS], ["t", "d"],
                 labels.experience_level(F.col("t"), F.col("d")))
    assert got == [m[1] for m in LEVELS]


def test_keys(spark):
    companies = {
        "PT Nusa Raya": "nusa raya", "PT. Nusa Raya": "nusa raya", "CV Nusa": "nusa",
        "PT Nusa, Tbk": "nusa", "PT. Nusa (Persero), Tbk.": "nusa", "  PT  Nusa  Raya ": "nusa raya",
        "CVX Labs": "cvx labs", "PTP Mas": "ptp mas", "": "", "Tbkx": "tbkx",
    }
    assert column(spark, list(companies), ["c"], keys.company_key(F.col("c"))) == list(companies.values())
    titles = {
        "QA Analyst": "qaanalyst", "Senior QA Analyst": "qaanalyst", "LEAD: QA": "qa",
        "QA (remote)": "qa", "Magang - QA ( Hybrid )": "qa", "QA for Senior": "qaforsenior",
        " Senior QA": "seniorqa", "Seniority": "seniority", "QA II": "qaii", "": "",
    }
    assert column(spark, list(titles), ["t"], keys.title_key(F.col("t"))) == list(titles.values())
    # sha256("abc"), from the published test vectors
    assert column(spark, [("a", "bc")], ["a", "b"], keys.fingerprint(F.col("a"), F.col("b"))) == [
        "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]


def test_city(spark):
    cases = {"Medan, Indonesia": "Medan", "Medan (Hybrid)": "Medan", "Medan": "Medan",
             " Kota Malang , X (Remote)": "Kota Malang", "": ""}
    assert column(spark, list(cases), ["l"], labels.city(F.col("l"))) == list(cases.values())


TAGGED = [
    (("Engineer (Golang)", ""), ["Go"]),
    (("Go dev", "GO services"), ["Go"]),
    (("", "let us go on, going, gopher, google"), []),
    (("", "React, TypeScript, Next.js"), ["Next.js", "React", "TypeScript"]),
    (("", "React Native and react-native"), ["React Native"]),
    (("", "React Native, plain React too"), ["React", "React Native"]),
    (("", "React  -Native"), []),
    (("", "React nativex"), ["React", "React Native"]),
    (("", "reactive"), []),
    (("", "Node.js, Vue.js"), ["Node.js", "Vue"]),
    (("", "plain JS and node.js"), ["JavaScript", "Node.js"]),
    (("js", ""), ["JavaScript"]),
    (("", "javascript"), ["JavaScript"]),
    (("", "C++ not C#?"), ["C#", "C++"]),
    ((".NET", "asp.net core"), [".NET"]),
    (("", "my_git repo"), []),
    (("", "Git Éxpress Express"), ["Express", "Git"]),
    (("", "éGoé"), ["Go"]),
    (("", "k8s, Postgres, Google Cloud, GitHub Actions, Hyper-V"),
     ["GCP", "GitHub Actions", "Hyper-V", "Kubernetes", "PostgreSQL"]),
    (("", "spring is here, rust never sleeps, swift and express"), []),
    (("", "iOS SQL Server AWS"), ["AWS", "SQL Server", "iOS"]),
    (("", ""), []),
]


def test_tags(spark):
    got = column(spark, [t[0] for t in TAGGED], ["t", "d"], text_tags(F.col("t"), F.col("d")))
    assert got == [t[1] for t in TAGGED]


def test_user_dictionary(spark):
    own = (Alias("Zig", "zig", "cap"), Alias("Zed", "zed"), Alias("Tools", "zed"))
    got = column(spark, [("Zig ZED", ""), ("zig", "")], ["t", "d"],
                 text_tags(F.col("t"), F.col("d"), own))
    assert got == [["Tools", "Zed", "Zig"], []]


def test_dictionary_table(spark):
    texts = spark.createDataFrame([(1, "Zig, zed"), (2, "nothing"), (3, None), (4, "ZED zed_ zigzag")], "i int, t string")
    words = spark.createDataFrame([("Zig", "zig"), ("Zed", "ZED"), ("Tools", "zed"), ("Zed", "zed"), ("X", None)], "tag string, alias string")
    for limit in (100, 0):  # by broadcast and by shuffle
        got = {r.i: r.tags for r in dictionary_tags(texts, "i", "t", words, limit).collect()}
        assert got == {1: ["Tools", "Zed", "Zig"], 2: [], 3: [], 4: ["Tools", "Zed"]}


def test_dictionary_rows_equal_the_literal_dictionary(spark):
    rnd = random.Random(8)
    odd = (Alias("A", "a_b"), Alias("Sign", "+"), Alias("Quote", "x\\\\ey"), Alias("Re", ".*"), Alias("Dot", "q.", not_after="("),
           Alias("Two", "Big Data", "cap", not_before="lake"), Alias("Acc", "café"), *DEFAULT_DICTIONARY)
    bits = ["go", "Go", "GO", "gO", "react", "React", "native", "Native", "js", ".js", "node", "vue", "c++", "c#", "abc", ".net", "asp",
            "work", "x\\\\EY", ".*", "a_b", "xa_b", "+", "q.", "(q.", "Big data", "big data", "BIG DATA", "lake", "café", "CAFÉ", "É", "spring boot",
            "\u212aafka", "sql server", "Rails", "ruby on rails", "İ", "_go_", "go_", "Go-", "K8S"]
    rows = [(i, "".join(rnd.choice(bits) + rnd.choice([" ", " ", "-", "", ".", "\n", ", "]) for _ in range(rnd.randrange(9)))) for i in range(1500)]
    texts = spark.createDataFrame([*rows, (5000, None), (5001, "")], "i int, t string")
    words = spark.createDataFrame([(a.tag, a.alias, a.kind, a.not_after, a.not_before) for a in odd],
                                  "tag string, alias string, kind string, not_after string, not_before string")
    want = {r.i: r.tags for r in texts.select("i", text_tags(F.lit(""), F.col("t"), odd).alias("tags")).collect()}
    assert sum(map(bool, want.values())) > 800 and {t for tags in want.values() for t in tags} >= {"A", "Sign", "Quote", "Re", "Dot", "Two", "Acc"}
    for limit in (1000, 0):
        assert {r.i: r.tags for r in dictionary_tags(texts, "i", "t", words, limit).collect()} == want


def test_trigrams(spark):
    assert sorted(column(spark, ["cat"], ["a"], trigrams(F.col("a")))[0]) == ["  c", " ca", "at ", "cat"]
    pairs = [("seniorbackend", "seniorbackend"), ("", ""), ("abc", "xyz"), ("word", "words")]
    got = column(spark, pairs, ["a", "b"], similarity(F.col("a"), F.col("b")))
    assert got == pytest.approx([1.0, 0.0, 0.0, 4 / 7])


def test_search_form_and_trim(spark):
    assert column(spark, ["  Node.js, Éclair!"], ["a"], search_form(F.col("a"))) == [" node js éclair "]
    assert column(spark, ["　\t a b  \n"], ["a"], trim_white(F.col("a"))) == ["a b"]


def test_words_of_the_dictionary_are_found_whole_and_in_one_pass(spark):
    rnd = random.Random(11)
    plain = [a for a in DEFAULT_DICTIONARY if a.kind == "word" and a.alias.isalnum() and not a.not_after and not a.not_before]
    parts = [a.alias for a in plain] + ["script", "9", "x", "_", "é", "K", " ", " ", ",", "\n", "-", "Ünder"]
    texts = ["".join(rnd.choices(parts, k=12)).title() if i % 2 else "".join(rnd.choices(parts, k=12)) for i in range(300)]
    words = {}
    for a in plain:
        words.setdefault(a.alias.lower(), set()).add(a.tag)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    df = df.select("i", F.lower("t").alias("low"), text_tags(F.lit(""), F.col("t"), tuple(plain)).alias("tags"))
    for row in df.collect():
        want = {tag for token in re.split("[^0-9a-z_]+", row.low) for tag in words.get(token, ())}
        assert row.tags == sorted(want)
    assert "array_intersect" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_company_key_patterns_run_only_where_their_word_is(spark):
    names = ["PT. Mega Karya, Tbk.", "Mega  Karya (Persero)", "Persero Jaya", "CV Tbkx", "x (PERSERO) tbk", None, "", "( persero )", "A.B,C"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    plain = F.lower("n")
    for pattern, by in ((P.PERSERO, " "), (P.TBK, " "), (P.COMPANY_PUNCT, ""), (P.LEGAL_FORM, ""), (P.BLANKS, " ")):
        plain = F.regexp_replace(plain, P.jvm(pattern), by)
    got = df.select(keys.company_key(F.col("n")).alias("got"), trim_white(plain).alias("want"))
    assert all(r.got == r.want for r in got.collect())
    assert "contains" in got.select("got")._jdf.queryExecution().optimizedPlan().toString().lower()
