"""Matching, resolution and merging against plain sequential models."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import contacts as ct
from ledgerloom.operators import events as ev
from ledgerloom.operators import keys, match, merge, resolve
from ledgerloom.schemas import IDENTIFIERS, MERGE_FIELDS
from tests.test_functions import lcs, near_names

NORM = (
    "seq bigint, business_id bigint, " + ", ".join(
        f"{f} {'date' if f == 'incorporation_date' else 'string'}" for f in MERGE_FIELDS)
    + ", employee_count_min int, employee_count_max int, source_name string, source_kind string, source_url string, "
    "confidence decimal(4,2), name_key string, postal_name_key string")


def records(spark, rows):
    names = [part.strip().split(" ")[0] for part in NORM.replace("decimal(4,2)", "decimal").split(",")]
    full = [tuple(row.get(n) for n in names) for row in rows]
    return spark.createDataFrame(full, NORM)


def random_history(seed, businesses=3, count=60):
    rng = random.Random(seed)
    rows = []
    for seq in range(count):
        rows.append({
            "seq": seq, "business_id": 0 if rng.random() < 0.6 else rng.randrange(businesses),
            "city": rng.choice([None, "", "A", "B", "C"]), "phone": rng.choice([None, "1", "2"]),
            "legal_name": rng.choice(["x", "y", None]), "source_name": rng.choice("pqr"),
            "employee_count_min": rng.choice([None, 0, 3, 70]),
            "confidence": Decimal(rng.choice(["0.50", "0.60", "0.70", "0.90"]))})
    return rows


def merged_in_order(rows):
    """One record at a time: (log, results, current values)."""
    current, seen, log, results, sizes = {}, set(), [], [], {}
    for r in rows:
        business, changed = r["business_id"], []
        new = business not in seen
        seen.add(business)
        for field in MERGE_FIELDS:
            value = r.get(field)
            if value in (None, ""):
                continue
            held = current.get((business, field))
            if held is None or r["confidence"] >= held[1]:
                if not new and (held[0] if held else "") != value:
                    changed.append(field)
                current[business, field] = (value, r["confidence"])
                log.append((business, r["seq"], field, value))
        if r["employee_count_min"]:
            sizes[business] = r["employee_count_min"]
        results.append((r["seq"], business, new, changed))
    return log, results, current, sizes


@pytest.mark.parametrize("log_all", [False, True])
def test_steps_of_every_record_are_compiled(spark, log_all):
    """No function with a lambda, which Spark interprets row by row; missing values and keys leave no row."""
    rows = records(spark, [
        {"seq": 1, "business_id": 1, "city": "A", "phone": "1", "confidence": Decimal("0.90"), "name_key": "n", "corporation_number": ""},
        {"seq": 2, "business_id": 1, "city": "B", "email": "e", "confidence": Decimal("0.50")}])
    history = merge.record_history(rows)
    logged = merge.accepted_values(history, F.current_timestamp(), log_all)
    held = keys.record_keys(rows, with_name=True)
    for df in (history.select("changed_fields"), logged, held):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.seq, r.field_name, r.field_value) for r in logged.collect()} == {
        (1, "city", "A"), (1, "phone", "1"), (2, "email", "e")} | ({(2, "city", "B")} if log_all else set())
    assert {r.seq: r.changed_fields for r in history.collect()} == {1: [], 2: ["email"]}
    assert {tuple(r) for r in held.collect()} == {(1, 2, "phone", "1"), (1, 4, "name_hash", "n")}


@pytest.mark.parametrize("seed, run_length", [(0, 1000), (1, 7), (2, 7), (3, 1)])
def test_history_equals_sequential_merge(spark, seed, run_length):
    rows = random_history(seed)
    log, results, current, sizes = merged_in_order(rows)
    history = merge.record_history(records(spark, rows), run_length=run_length)
    got = merge.accepted_values(history, F.current_timestamp())
    assert sorted((r.business_id, r.seq, r.field_name, r.field_value) for r in got.collect()) == sorted(log)
    got = merge.upsert_results(history).orderBy("seq").collect()
    assert [(r.seq, r.business_id, r.is_new, r.changed_fields) for r in got] == results
    flagged = [
        {(r.business_id, r.field_name, r.field_value) for r in merge.flag_current(
            merge.accepted_values(history, F.current_timestamp()), hot_rows).where("is_current_pick").collect()}
        for hot_rows in (4, 10**6)]
    assert flagged[0] == flagged[1] == {(b, f, v[0]) for (b, f), v in current.items()}
    golden = {r.business_id: r for r in merge.golden_records(history).collect()}
    for (business, field), (value, confidence) in current.items():
        assert golden[business][field] == value
        assert golden[business].picked[field] == confidence
    for business, low in sizes.items():
        assert golden[business].size_category == {3: "1-4", 70: "50-99"}[low]


@pytest.mark.parametrize("run_length", [1000, 5])
def test_two_batches_equal_one(spark, run_length):
    rows = random_history(7)
    now = F.lit("2024-01-31").cast("timestamp")
    whole = merge.merge_snapshot(None, merge.record_history(records(spark, rows)), now)
    first, second = records(spark, rows[:30]), records(spark, rows[30:])
    snapshot = merge.merge_snapshot(None, merge.record_history(first), now)
    history = merge.record_history(second, snapshot, run_length)
    after = merge.merge_snapshot(snapshot, history, now)
    columns = ["business_id", *MERGE_FIELDS, "picked", "size_category"]
    assert sorted(map(str, after.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    expected = [r for r in merged_in_order(rows)[1] if r[0] >= 30]
    got = merge.upsert_results(history).orderBy("seq").collect()
    assert [(r.seq, r.business_id, r.is_new, r.changed_fields) for r in got] == expected


def keyed_rows(seed, count=80):
    rng = random.Random(seed)
    return [{
        "seq": seq, "corporation_number": rng.choice([None, None, str(rng.randrange(12))]),
        "domain": rng.choice([None, f"d{rng.randrange(15)}.ca"]),
        "phone": "+1hot" if rng.random() < 0.2 else rng.choice([None, f"+1{rng.randrange(30)}"]),
        "name_key": "", "confidence": Decimal("0.70")} for seq in range(count)]


KEY_COLUMNS = ["corporation_number", "domain", "phone"]


def resolved_in_order(rows, known=None):
    owners, assigned = dict(known or {}), {}
    for r in rows:
        found = next((owners[c, r[c]] for c in KEY_COLUMNS if (c, r[c]) in owners), None)
        assigned[r["seq"]] = r["seq"] if found is None else found
        for c in KEY_COLUMNS:
            if r[c]:
                owners.setdefault((c, r[c]), assigned[r["seq"]])
    return assigned, owners


@pytest.mark.parametrize("seed", range(3))
def test_resolution_in_order(spark, seed):
    rows = keyed_rows(seed)
    expected, _ = resolved_in_order(rows)
    got = resolve.resolve_in_order(records(spark, rows), fuzzy=False).collect()
    assert {r.seq: r.business_id for r in got} == expected


def test_hot_keys_take_the_other_way(spark):
    rows = keyed_rows(5)
    batch, none = records(spark, rows), spark.createDataFrame([], IDENTIFIERS)

    def links(hot_rows):
        return {tuple(r) for r in resolve.exact_links(batch, none, hot_rows).collect()}

    assert links(3) == links(10**6) == links(0)
    edges = {tuple(r) for r in resolve.shared_key_edges(batch).collect()}
    assert edges == {tuple(r) for r in resolve.shared_key_edges(batch, 2).collect()}
    known = keys.register_identifiers(batch.withColumn("business_id", F.col("seq")))
    linked = batch.select("seq").join(resolve.exact_links(batch, none), "seq", "left")
    expected = {tuple(r) for r in resolve.follow_parents(linked).collect()}
    assert expected == {tuple(r) for r in resolve.follow_parents(linked, hot_rows=3).collect()}
    star = spark.range(1, 200).select(F.col("id").alias("src"), (F.col("id") % 7 * 0).alias("dst"))
    assert {r.component for r in resolve.connected_components(star, hot_rows=5).collect()} == {0}
    hits = {tuple(r) for r in match.exact_match(batch, known).collect()}
    assert hits == {tuple(r) for r in match.exact_match(batch, known, 3).collect()}


def test_resolution_continues_from_a_snapshot(spark):
    rows = keyed_rows(11)
    expected, _ = resolved_in_order(rows)
    first = records(spark, rows[:40]).drop("business_id").join(
        spark.createDataFrame([(s, b) for s, b in expected.items()], "seq bigint, business_id bigint"), "seq")
    identifiers = keys.register_identifiers(first)
    got = resolve.resolve_in_order(records(spark, rows[40:]), identifiers, fuzzy=False).collect()
    assert {r.seq: r.business_id for r in got} == {s: b for s, b in expected.items() if s >= 40}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rows = keyed_rows(seed)
    root = {r["seq"]: r["seq"] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for c in KEY_COLUMNS:
        first = {}
        for r in rows:
            if r[c]:
                a, b = find(r["seq"]), find(first.setdefault(r[c], r["seq"]))
                root[max(a, b)] = min(a, b)
    got = resolve.resolve_components(records(spark, rows)).collect()
    assert {r.seq: r.business_id for r in got} == {s: find(s) for s in root}


def test_long_chain_of_components(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in resolve.connected_components(edges).collect()} == {0}


def test_exact_match_prefers_the_stronger_key(spark):
    ids = spark.createDataFrame(
        [(1, "phone", "+1", 1), (2, "corp_number", "7", 2), (5, "phone", "+1", 5)], IDENTIFIERS)
    batch = records(spark, [
        {"seq": 10, "corporation_number": "7", "phone": "+1"}, {"seq": 11, "phone": "+1"}, {"seq": 12, "phone": "+9"}])
    got = {r.seq: (r.business_id, r.key_type) for r in match.exact_match(batch, ids).collect()}
    assert got == {10: (2, "corp_number"), 11: (1, "phone")}


@pytest.mark.parametrize("seed, heavy", [(0, 64), (1, 3), (2, 0)])
def test_similar_names_equal_brute_force(spark, seed, heavy):
    rng = random.Random(seed)
    # One block holds most of the names.
    names = [(i, "ON", "hot" if rng.random() < 0.7 else rng.choice("ab"), n.lower())
             for i, n in enumerate(near_names(seed, 150))]
    ordered = [(i, c, " ".join(sorted(n.split()))) for i, _, c, n in names]
    expected = {}
    for i, city, a in ordered:
        best = None
        for j, other, b in ordered:
            if j < i and other == city:
                common = lcs(a, b)
                score = 200 * common / (len(a) + len(b))
                if 200 * common >= 87 * (len(a) + len(b)) and (best is None or score > best[1]):
                    best = (j, score)
        if best:
            expected[i] = best
    queries = spark.createDataFrame(names, "seq bigint, province string, city string, name_key string")
    candidates = spark.createDataFrame(
        [(i, i, "ON", c, s) for i, c, s in ordered], "rank bigint, owner bigint, province string, city string, sorted string")
    got = {r.seq: (r.owner, r.score) for r in match.similar_names(queries, candidates, heavy=heavy).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert all(abs(got[k][1] - v[1]) < 1e-9 for k, v in expected.items())
    assert len(expected) > 20


def test_numbered_companies_of_one_place_meet_in_few_pairs(spark):
    rng = random.Random(11)
    numbers = rng.sample(range(1_000_000, 10_000_000), 5000)
    names = spark.createDataFrame([(i, i, "ON", "Toronto", f"{n} inc ontario") for i, n in enumerate(numbers)],
                                  "rank bigint, owner bigint, province string, city string, sorted string")
    index = match.name_index(names)
    counts = {}
    for level in (2, 4):
        met = match.meetings(index, index.where("rank >= 0"), level, 87, F.col("r_rank") < F.col("rank"))
        counts[level] = met.select("name_id", "r_name_id").distinct().count()
    # All pairs are 12.5 million. Numbers that differ in one digit are found first, and names that have such a partner
    # go no further.
    assert counts[2] < 125_000 and counts[4] < 1_250_000


@pytest.mark.parametrize("seed", [1])
def test_alike_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [n.lower() for n in near_names(seed, 70)]
    rows = [{"seq": i, "province": "ON", "city": rng.choice(["hot", "hot", "a", None]), "legal_name": rng.choice([n, n, None]),
             "operating_name": rng.choice([None, None, rng.choice(names)]), "phone": rng.choice([None] * 9 + ["+1", "+2"])}
            for i, n in enumerate(names)]
    for r in rows:
        r["name_key"] = (r["legal_name"] or r["operating_name"] or "").strip()

    def alike(a, b):
        a, b = (" ".join(sorted(x.split())) for x in (a, b))
        return 200 * lcs(a, b) >= 87 * (len(a) + len(b))

    label = {r["seq"]: r["seq"] for r in rows}
    links = [(a["seq"], b["seq"]) for a in rows for b in rows if a["seq"] != b["seq"] and (
        (a["phone"] and a["phone"] == b["phone"]) or (a["city"] and a["city"] == b["city"] and a["name_key"] and any(
            alike(a["name_key"], x) for x in (b["legal_name"], b["operating_name"]) if x)))]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.seq: r.business_id for r in resolve.resolve_components(records(spark, rows), fuzzy=True).collect()}
    assert got == label
    assert len(set(label.values())) < len(rows) - 10


def replayed(rows):
    """One record at a time: first known key, else the most alike golden name of that moment, else a new business."""
    owners, golden, assigned = {}, {}, {}
    for r in rows:
        owner = next((owners[c, r[c]] for c in KEY_COLUMNS if (c, r.get(c)) in owners), None)
        if owner is None and r["name_key"] and r["city"]:
            best = None
            for business, fields in sorted(golden.items()):
                if fields.get("city", (None,))[0] != r["city"] or fields.get("province", (None,))[0] != r["province"]:
                    continue
                for f in ("legal_name", "operating_name"):
                    if f in fields:
                        a, b = (" ".join(sorted(x.split())) for x in (r["name_key"], fields[f][0]))
                        score = 200 * lcs(a, b) / (len(a) + len(b))
                        if score >= 87 and (best is None or score > best[0]):
                            best = (score, business)
            owner = best and best[1]
        owner = r["seq"] if owner is None else owner
        assigned[r["seq"]] = owner
        for c in KEY_COLUMNS:
            if r.get(c):
                owners.setdefault((c, r[c]), owner)
        held = golden.setdefault(owner, {})
        for f in ("legal_name", "operating_name", "province", "city"):
            if r.get(f) and (f not in held or r["confidence"] >= held[f][1]):
                held[f] = (r[f], r["confidence"])
    return assigned


@pytest.mark.parametrize("seed", [4])
def test_replay_uses_the_golden_names_of_the_moment(spark, seed):
    rng = random.Random(seed)
    names = [n.lower().strip() for n in near_names(seed, 26)]
    rows = []
    for seq in range(90):
        legal, other = rng.choice([*names, None]), rng.choice([None, None, *names[:6]])
        rows.append({"seq": seq, "province": "ON", "city": rng.choice(["a", "a", "b", None]), "legal_name": legal, "operating_name": other,
                     "phone": rng.choice([None, None, f"+1{rng.randrange(12)}"]), "name_key": legal or other or "",
                     "confidence": Decimal(rng.choice(["0.50", "0.70", "0.90"]))})
    expected = replayed(rows)
    got = {r.seq: r.business_id for r in resolve.resolve_in_order(records(spark, rows), golden_names=True).collect()}
    assert got == expected
    assert len(set(expected.values())) < 60


def test_fuzzy_needs_the_same_place(spark):
    rows = [
        {"seq": 0, "legal_name": "Toronto Bakery Inc", "province": "ON", "city": "Toronto", "name_key": "toronto bakery inc"},
        {"seq": 1, "legal_name": "Bakery Toronto Inc.", "province": "ON", "city": "Toronto", "name_key": "bakery toronto inc."},
        {"seq": 2, "legal_name": "Toronto Bakery Inc", "province": "ON", "city": None, "name_key": "toronto bakery inc"},
        {"seq": 3, "legal_name": "Toronto Bakery Inc", "province": "BC", "city": "Toronto", "name_key": "toronto bakery inc"}]
    got = {r.seq: r.business_id for r in resolve.resolve_in_order(records(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_events_of_a_future_date(spark):
    rows = records(spark, [{"seq": 0, "business_id": 0, "city": "A", "confidence": Decimal("0.70")}]).withColumn(
        "incorporation_date", F.lit("2030-01-01").cast("date"))
    found = ev.change_events(merge.record_history(rows), F.lit("2024-01-31").cast("timestamp"))
    assert sorted(r.event_type for r in found.collect()) == ["new_30d", "new_7d", "new_today"]


@pytest.mark.parametrize("size", [45, 3000])
def test_one_row_per_business_at_any_size(spark, size):
    contacts = spark.range(size + 5).select(
        F.col("id").cast("string").alias("contact_id"), F.when(F.col("id") < size, 1).otherwise(2).alias("business_id"),
        F.concat(F.lit("P"), "id").alias("full_name"), F.lit("t").alias("title_raw"), F.lit("owner").alias("role_category"),
        F.concat(F.lit("e"), "id").alias("email"), F.lit(None).cast("string").alias("phone"),
        F.lit("0.50").cast("decimal(4,2)").alias("confidence"), F.lit(True).alias("is_active"))
    got = {r.business_id: r for r in ct.flatten_contacts(contacts).collect()}
    assert len(got) == 2
    # Equal confidence: in order of the id, here a text.
    assert got[1].contact_emails.split("; ") == [f"e{i}" for i in sorted(map(str, range(size)))]
    assert got[1].contact_phones == "" and len(got[2].decision_makers.split("; ")) == 5
    lines = ct.contact_lines(contacts).where("business_id = 1").orderBy("place").collect()
    assert [r.email for r in lines] == got[1].contact_emails.split("; ")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_python_and_no_products(spark, sf):
    from ledgerloom.plans import inputs
    good = inputs.good_records(spark, sf)
    ids = keys.register_identifiers(good.withColumn("business_id", F.col("seq")))
    names = match.business_names(good.withColumn("business_id", F.col("seq")))
    for df in (match.exact_match(good, ids), match.similar_names(good, names), resolve.exact_links(good, ids)):
        plan = plan_of(df)
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_scans_are_pruned(spark, sf):
    from ledgerloom.plans import inputs
    plan = plan_of(inputs.contacts(spark, sf).where("business_id = 3").select("role_category"))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan
    assert "value" not in plan.split("ReadSchema:")[1]
