"""Steps that must grow no faster than their input."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import similarity as sim
from ledgerloom.operators import detail, match, resolve, scoring
from ledgerloom.sources import lines


def numbered(many: int, most: int, width: int) -> list[str]:
    return [f"numbered firm#{n:0{width}d}" for n in random.Random(7).sample(range(most), many)]


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for c in a:
        diag = 0
        for j, d in enumerate(b, 1):
            diag, row[j] = row[j], diag + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def is_alike(a: str, b: str) -> bool:
    return 200 * lcs(a, b) >= 87 * (len(a) + len(b))


def placed(spark, names):
    return spark.createDataFrame([(i, "ON", "Toronto", n) for i, n in enumerate(names)], "seq long, province string, city string, name_key string")


@pytest.mark.parametrize("text", ["a", "aab", "0000", "abab", "x00110"])
def test_cuts_are_all_that_is_left(spark, text):
    def cuts(texts):
        return {t[:i] + t[i + 1:] for t in texts for i in range(len(t))}

    row = spark.createDataFrame([(text,)], "t string").select(*[sim.cut_texts(F.col("t"), F.lit(k)).alias(f"c{k}") for k in (0, 1, 2)]).first()
    assert row["c0"] == [text] and sorted(row["c1"]) == sorted(cuts([text]))
    assert sorted(row["c2"]) == sorted(cuts(cuts([text])))


def test_numbered_names_find_their_best(spark):
    names = [*numbered(120, 2000, 5), *numbered(40, 900, 4)]
    pool = placed(spark, names)
    found = match.similar_names(pool, pool.select(
        F.col("seq").alias("rank"), F.col("seq").alias("owner"), "province", "city", sim.token_sort(F.col("name_key")).alias("sorted")))
    best = {}
    for i, a in enumerate(names):
        scored = [(-200 * lcs(a, b) / (len(a) + len(b)), j) for j, b in enumerate(names[:i]) if is_alike(a, b)]
        if scored:
            best[i] = (min(scored)[1], round(-min(scored)[0], 6))
    assert {r["seq"]: (r["owner"], round(r["score"], 6)) for r in found.collect()} == best


def test_frequent_grams_post_no_pairs(spark):
    names = numbered(300, 1000, 6)
    index = match.name_index(placed(spark, names).select(*match.BLOCK, F.col("name_key").alias("sorted")))
    for level in (2, 4):
        held = index.select(sim.posts(F.col("grams"), F.length("sorted"), level, match.HEAVY, 87, F.col("lengths"), True).alias("p"))
        assert held.select(F.inline("p")).where("two != ''").isEmpty()
        cut = match.cut_rows(index, True, level, 87, ["name_id"])
        assert 0 < cut.count() <= len(names) * 20 ** (level // 2)


def test_numbered_names_make_components(spark):
    names = [*numbered(60, 90000, 5), *numbered(30, 900, 4)]
    rows = placed(spark, names).select(
        "*", F.when(F.col("seq") % 3 == 0, F.lit(None)).otherwise(F.col("name_key")).alias("legal_name"),
        F.when(F.col("seq") % 5 == 0, F.lit("other shop")).alias("operating_name"))
    edges = spark.createDataFrame([], "src long, dst long")
    label = list(range(len(names)))
    holds = [([n] if i % 3 else []) + (["other shop"] if i % 5 == 0 else []) for i, n in enumerate(names)]
    words = [" ".join(sorted(n.split())) for n in names]
    for i, a in enumerate(words):
        for j, held in enumerate(holds):
            if any(is_alike(a, " ".join(sorted(h.split()))) for h in held) or a == words[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    # Records that hold one name that is alike to a question are one business.
    found = {r["seq"]: r["business_id"] for r in resolve.resolve_components(rows, edges, fuzzy=True).collect()}
    assert found == dict(enumerate(label))


def test_star_rounds_run_without_leaves(spark, monkeypatch):
    """Records that only point at the first holders of their keys take no part in the rounds."""
    asked = []
    rounds = resolve._star_rounds
    monkeypatch.setattr(resolve, "_star_rounds", lambda pairs, *rest: (asked.append(pairs.count()), rounds(pairs, *rest))[1])
    edges = [(100 + i, i % 4) for i in range(200)] + [(150, 1), (150, 9), (9, 8), (400, 300), (401, 300)]
    label = {n: n for e in edges for n in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {n: low if x == high else x for n, x in label.items()}
    found = resolve.connected_components(spark.createDataFrame(edges, "src long, dst long"), hot_rows=30)
    rows = found.collect()
    assert len(rows) == len(label) and {r["node"]: r["component"] for r in rows} == label
    assert asked[0] <= 6


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_records_start_where_they_start_in_any_chunks(spark, chunk):
    text = ["a,b", 'c,"d', "", 'e"', 'f,"g', 'h""', 'i","', "j", '",k', "l,m"]
    starts = [0, 1, 1, 1, 4, 4, 4, 4, 4, 9]
    rows = [("f", i // 6, (i // 6 << 33) + i, t) for i, t in enumerate(text)]
    placed = lines._starts(spark.createDataFrame(rows, "landed_file string, block long, row long, line string"), chunk).collect()
    assert {r["row"]: r["start_row"] for r in placed} == {rows[i][2]: rows[s][2] for i, s in enumerate(starts)}


def test_detail_and_new_contacts_read_their_input_once(spark):
    """What is looked at several times is worked out once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(n):
        seen.add(1)
        return n

    count = F.udf(counted, "long").asNondeterministic()
    ids = spark.range(20).select(count("id").alias("business_id"))
    contacts = spark.createDataFrame([], "business_id long, contact_id string, is_active boolean, confidence decimal(4,2)")
    fields = spark.createDataFrame([(1, "name", "x", 1, "s")], "business_id long, field_name string, field_value string, seq long, source_name string").withColumn(
        "confidence", F.lit(0.5).cast("decimal(4,2)"))
    events = spark.createDataFrame([], "business_id long, event_id long, detected_at timestamp")
    parts = detail.business_detail(ids, spark.range(20).withColumnRenamed("id", "business_id"), contacts, fields, events)
    assert [parts[k].count() for k in ("business", "contacts", "field_sources", "events")] == [20, 0, 1, 0]
    assert seen.value == 20

    seen.value = 0
    found = spark.range(5).select(F.concat(F.lit("c"), "id").alias("contact_id"), count("id").alias("business_id"),
                                  F.lit(True).alias("is_active"), F.lit(0.5).cast("decimal(4,2)").alias("confidence"))
    owners = spark.range(5).select(F.col("id").alias("business_id"), F.lit("2024-01-01").cast("timestamp").alias("last_verified_at"),
                                   F.lit(0).cast("decimal(5,2)").alias("quality_score"), F.lit(False).alias("lead_ready"),
                                   *[F.lit("").alias(c) for c in ("phone", "website", "address_line1", "postal_code", "size_category")])
    scored, every = scoring.add_contacts(owners, contacts, found, fields, F.lit("2024-01-31").cast("timestamp"))
    assert scored.count() == 5 and every.count() == 5 and seen.value == 5
