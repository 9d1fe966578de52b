"""Column functions against literal expectations."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import labels, measures, reach, similarity as sim, text


def apply(spark, expr, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", expr(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


CASES = [
    (reach.normalize_phone, {
        "416-555-1234": "+14165551234", "+1 (604) 555-0199": "+16045550199", "9055551234": "+19055551234",
        "123": None, None: None, "": None, "1-800-FLOWERS": "+18003569377", "Tel: 416 555 0100 ext. 22": "+14165550100",
        "+44 20 7946 0958": None, "+4165551234": None, "(911) 555-0100": None, "416-155-0100": None,
        "310-1234": "+13101234", "416-555-0100 x5": "+14165550100"}),
    (text.normalize_postal_code, {
        "m5h1a1": "M5H 1A1", "M5H 1A1": "M5H 1A1", "m5v2t6": "M5V 2T6", "H2X-1Y4": "H2X 1Y4", "K1A 0B1": "K1A 0B1",
        " 90210 ": "90210", None: None, "": None, "  ": None}),
    (text.normalize_province, {
        "Ontario": "ON", "on": "ON", "ON": "ON", "BRITISH COLUMBIA": "BC", "quebec": "QC", "Québec": "QU",
        None: None, "": None}),
    (reach.normalize_domain, {
        "https://shop.firm.any.ck/": "firm.any.ck", "any.ck": None, "a.www.ck": "www.ck", "www.ck": "www.ck",
        "x.firm.ward.kobe.jp": "firm.ward.kobe.jp", "ward.kobe.jp": None, "www.city.kobe.jp": "city.kobe.jp", "kobe.jp": "kobe.jp",
        "https://www.example.com/about": "example.com", "example.ca": "example.ca", "www.shop.on.ca": "shop.on.ca",
        "http://a.b.co.uk:80/x": "b.co.uk", "on.ca": None, "ca": None, "N/A": None, "localhost": "localhost",
        "10.0.0.1:8080": "10.0.0.1", "user@firm.ca?x": "firm.ca", None: None}),
    (text.normalize_name, {"  Acme  Corp  ": "Acme Corp", " Acme\t\nCorp ": "Acme Corp", None: None, "N/A": None}),
    (text.clean_string, {t: None for t in ["n/a", "NA", "n / a", "None", "NULL", "nil", "-", "--", " ", ""]}),
    (text.normalize_status, {"Active": "active", "": "unknown", None: "unknown"}),
    (text.digits_to_int, {" 12 ": 12, "3a": None, "": None, "-5": None}),
    (text.digits_only, {"BC-00123": "00123", "none": None, "": None}),
    (text.unaccent, {"Élève œuvre Straße": "Eleve oeuvre Strasse"}),
    (labels.registry_status, {"Actif": "active", "amalgamated": "dissolved", "": "active", "Pending": "pending", None: "active"}),
    (labels.portal_status, {"Issued": "active", "cancelled": "inactive", "Dissolved": "dissolved", "x": "unknown", "": None}),
    (labels.officer_role, {
        "Vice-President": "president", "Managing Director": "other_decision_maker", "CEO": "president",
        "Co-Founder": "founder", "General Manager": "general_manager", "Clerk": "other_decision_maker"}),
    (labels.entity_label, {"SP": "BC Sole Proprietorship", "ZZ": "ZZ"}),
    (reach.first_email, {"mail Info@Firm.CA now": "info@firm.ca", "none": None}),
    (reach.first_phone, {"call (416) 555-0100 or 905 555 0199": "(416) 555-0100", "x": None}),
]


@pytest.mark.parametrize("function, table", CASES, ids=[f.__name__ for f, _ in CASES])
def test_literal_cases(spark, function, table):
    assert apply(spark, function, *table) == list(table.values())


def test_every_white_space_collapses(spark):
    """Text beyond ASCII without such space stays as it is."""
    values = [f"Élan{c}{d}Vital" for c in text.WHITE_SPACE for d in ("", " ")] + [f"a{c}b" for c in text.WHITE_SPACE]
    assert set(apply(spark, text.collapse_spaces, *values)) == {"Élan Vital", "a b"}
    assert apply(spark, text.collapse_spaces, "Café №1", "", None, "~ !") == ["Café №1", "", None, "~ !"]


def test_dates(spark):
    got = apply(spark, text.parse_date, "2020-01-31", "2020-1-5T10:00:00Z", "2020/02/03", "01/31/2020", "20200131",
                "2020-13-01", "soon", "2020", None)
    assert [str(d) if d else None for d in got] == [
        "2020-01-31", "2020-01-05", "2020-02-03", "2020-01-31", "2020-01-31", None, None, None, None]


def test_size_classes(spark):
    got = apply(spark, measures.size_class, 0, 1, 4, 5, 50, 100, 500, 1000, 1500, 5000, kind="int")
    assert got == [None, "1-4", "1-4", "5-9", "50-99", "100-199", "500-999", "1000+", "1000+", "1000+"]


def test_classify(spark):
    rows = spark.createDataFrame(
        [(0, None, None, 42), (1, 10, 20, None), (2, 5, 9, None), (3, None, None, None), (4, 0, 50, None)],
        "i int, a int, b int, e int")
    got = rows.select("i", measures.classify_size(F.col("a"), F.col("b"), F.col("e")).alias("s")).orderBy("i").collect()
    assert [tuple(r.s) for r in got] == [
        ("20-49", "confirmed"), ("10-19", "estimated"), ("5-9", "estimated"), (None, "estimated"), (None, "estimated")]


def test_scores(spark):
    rows = spark.createDataFrame([
        ("+1", "w", "a", "p", "1-4", 2, 3, 5), (None, None, None, None, None, 0, 0, None),
        ("+1", "w", None, None, None, 0, 1, 30), ("", "", "a", None, "", 0, 1, 91)],
        "phone string, website string, address_line1 string, postal_code string, size_category string, c int, s int, d int")
    score = measures.score(measures.score_checks(F.col("c"), F.col("s"), F.col("d")))
    got = [int(r[0]) for r in rows.select(score).collect()]
    assert got == [100, 0, 40, 0]
    ready = spark.createDataFrame([(100,), (0,), (50,)], "v int").select(measures.is_lead_ready(F.col("v"))).collect()
    assert [r[0] for r in ready] == [True, False, True]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def near_names(seed, count=60):
    import random
    rng = random.Random(seed)
    names = []
    for _ in range(count):
        base = rng.choice(names) if names and rng.random() < 0.6 else " ".join(
            "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 4)))
        chars = list(base)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(chars) + 1)
            if rng.random() < 0.5:
                chars.insert(at, rng.choice("abcde 😀"))
            elif at < len(chars) and len(chars) > 1:
                del chars[at]
        names.append("".join(chars).strip() or "x")
    return names


def test_lcs_matches_plain_table(spark):
    names = near_names(1, 40)
    pairs = [(a, b) for a in names[:12] for b in names[12:]] + [("", "x"), ("x", "")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select("a", "b", sim.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == lcs(r.a, r.b) for r in got)


@pytest.mark.parametrize("seed, level", [(0, 2), (1, 4), (2, 64)])
def test_alike_names_keep_all_but_the_lost_grams(spark, seed, level):
    names = sorted({" ".join(sorted(n.split())) for n in near_names(seed, 120)})
    apart = {(a, b): len(a) + len(b) - 2 * lcs(a, b) for a in names for b in names}
    pairs = [(a, b) for (a, b), d in apart.items() if d <= level and 100 * d <= 13 * (len(a) + len(b))]
    assert len(pairs) > len(names)
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", sim.lost_grams(
            F.length("a"), F.length("b"), sim.edits_within(F.length("a"), F.length("b"), level)).alias("lost"), F.transform(sim.pair_grams(F.col("a")), lambda g: g["gram"]).alias("grams"),
        F.transform(sim.pair_grams(F.col("b")), lambda g: g["gram"]).alias("others"))
    for r in rows.collect():
        common = sum(min(r.grams.count(g), r.others.count(g)) for g in set(r.grams))
        assert len(r.grams) == len(r.a) + 1
        assert common >= len(r.grams) - r.lost and len(r.grams) - r.lost >= 2
