"""CSV with quoted line breaks, read in splits.

A line is a function on one bit: whether it starts inside a quoted field decides
whether it ends inside one. Such functions compose, so the bit before every line
follows from a scan within each chunk of a file and a scan over the chunks. Only
files in which some line leaves a quote open are scanned at all; the lines of all
others are records as they stand, and are never shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.session import materialize

# Lines a record may span. A quote that stays open for longer was never closed.
MOST_LINES = 1000
# Lines put in order as one group.
CHUNK = 1 << 16
FILE = "landed_file"
UNCLOSED, FIELDS = "unclosed quote", "number of fields"

# A field that ends on its line: quoted (text after the closing quote included), plain or empty.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|(?=,|\z))'
_CLOSED = f"^{_FIELD}(?:,{_FIELD})*+\\z"


def _runs_on(line: Column) -> Column:
    """Whether a line that starts outside of quotes ends inside of them."""
    return ~line.rlike(_CLOSED)


def _scan(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds, up to and with each row, ``set_to``, the value set last, and ``flips``, 1 if it flipped an odd number of times since.

    rows: ``sets`` (the bit a row sets, or NULL) and ``turns`` (1 where it flips the bit, 0 where it sets it).
    """
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("turned", F.sum("turns").over(upto))
    at_set = F.last(F.when(F.col("sets").isNotNull(), F.struct("sets", "turned")), ignorenulls=True).over(upto)
    run = run.withColumn("at_set", at_set)
    return run.withColumns({
        "set_to": F.col("at_set.sets"),
        "flips": (F.col("turned") - F.coalesce("at_set.turned", F.lit(0))) % 2,
    }).drop("turned", "at_set")


def _after(set_to: Column, flips: Column, start: Column) -> Column:
    return F.coalesce(set_to, start).bitwiseXOR(flips.cast("int"))


def _starts(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(file, block, row, line, start_block, start_row): where the record of each line starts.

    A block is cut into chunks, so no task holds more than some of its lines, however
    large blocks are. Rows of a chunk are put in order within the chunk, and one
    short row a chunk within the file.
    """
    group = [FILE, "block", "chunk"]
    lines = lines.withColumn("chunk", F.floor(F.col("row") / chunk))
    place = Window.partitionBy(*group).orderBy("row")
    opens, stays = _runs_on(F.col("line")), _runs_on(F.concat(F.lit('"'), F.col("line")))
    told = lines.withColumns({"opens": opens, "stays": stays}).select(
        *lines.columns, F.when(F.col("opens") == F.col("stays"), F.col("opens").cast("int")).alias("sets"),
        (F.col("opens") & ~F.col("stays")).cast("int").alias("turns"))
    run = _scan(told, group, ["row"]).drop("sets", "turns")
    ends = run.groupBy(*group).agg(F.max_by(F.struct("set_to", "flips"), "row").alias("end"))
    # A chunk that sets the bit sets it to what its later lines make of it.
    set_to, flips, outside = F.col("end.set_to"), F.col("end.flips").cast("int"), F.lit(0)
    chunks = _scan(ends.select(
        *group, set_to.bitwiseXOR(flips).alias("sets"), F.when(set_to.isNull(), flips).otherwise(0).alias("turns")), [FILE], group[1:])
    begin = F.lag(_after(F.col("set_to"), F.col("flips"), outside), 1, 0).over(Window.partitionBy(FILE).orderBy(*group[1:]))
    known = run.join(chunks.select(*group, begin.alias("begin")), group)
    inside = F.lag(_after(F.col("set_to"), F.col("flips"), F.col("begin"))).over(place)
    known = known.withColumn("inside", F.coalesce(inside, F.col("begin"))).select(*lines.columns, "inside")

    own = F.when(F.col("inside") == 0, F.struct(F.col("block").alias("start_block"), F.col("row").alias("start_row")))
    so_far = known.withColumn("start", F.last(own, ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    last = so_far.groupBy(*group).agg(F.max("start").alias("last"))
    earlier = Window.partitionBy(FILE).orderBy(*group[1:]).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*group, F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    return so_far.join(carried, group).withColumn("start", F.coalesce("start", "carried")).select(
        *[c for c in lines.columns if c != "chunk"], "start.*")


def text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(landed_file, block, row, line) of text files, read in splits."""
    return spark.read.text(paths).select(
        F.input_file_name().alias(FILE), F.input_file_block_start().alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))


def _stitched(lines: DataFrame, most_lines: int) -> tuple[DataFrame, DataFrame]:
    """(records in order, lines of records that never end) of files with open quotes."""
    placed = materialize(_starts(lines), "placed")
    start = [FILE, "start_block", "start_row"]
    held = placed.groupBy(*start).agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    single = placed.join(held, start, "left_anti").where(F.trim("line") != "").select(*start, "line")
    several = placed.join(held, start)
    ordered = F.array_sort(F.collect_list(F.struct("block", "row", "line")))
    short = several.where(F.col("held") <= most_lines).groupBy(*start).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("line"))
    return single.unionByName(short).orderBy(*start).select(FILE, "line"), several.where(F.col("held") > most_lines).select(FILE, "line")


def read_records(
    spark: SparkSession, paths: str | list[str], most_lines: int = MOST_LINES, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines) of header CSV files whose quoted fields may hold line breaks.

    records:   the columns of the header as text, and ``landed_file``
    malformed: landed_file, line, reason

    All files share the header of the first path; a record equal to it is a header.
    A quote that stays open for more than ``most_lines`` lines, or to the end of
    its file, is malformed with all its lines; everything else is a record.
    Blank lines outside of quotes are none. Records with too few fields end in
    NULLs and surplus fields are dropped; with ``strict`` both are malformed.
    Records of files without open quotes keep their order and come first; those of
    other files are in order of file and place.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("multiLine", True).option("escape", '"')
    names = reader.option("header", True).csv(paths[0]).columns
    header = reader.option("header", False).csv(paths[0]).first()
    mark = "\ufeff"
    names = [n.lstrip(mark).strip('"') if i == 0 else n for i, n in enumerate(names)]

    lines = text_lines(spark, paths)
    # One row for each file with an open quote, of the files the driver has listed.
    broken = materialize(lines.where(_runs_on(F.col("line"))).select(FILE).distinct(), "broken")
    records = lines.join(F.broadcast(broken), FILE, "left_anti").where(F.trim("line") != "").select(FILE, "line")
    endless = records.limit(0)
    if not broken.isEmpty():
        stitched, endless = _stitched(lines.join(F.broadcast(broken), FILE, "left_semi"), most_lines)
        records = records.unionByName(stitched)

    # A record that still runs on has reached the end of its file.
    open_ = _runs_on(F.col("line"))
    malformed = endless.unionByName(records.where(open_).select(FILE, "line")).withColumn("reason", F.lit(UNCLOSED))
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    plain = F.regexp_replace("line", f"^{mark}", "")
    parsed = records.where(~open_).select(FILE, "line", F.from_csv(
        plain, f"{fields}, corrupt string" if strict else fields, {"escape": '"', "columnNameOfCorruptRecord": "corrupt"}).alias("p"))
    titles = [None if v is None else v.lstrip(mark).strip('"') if i == 0 else v for i, v in enumerate(header or [])]
    is_header = reduce(and_, [F.col(f"p.c{i}").eqNullSafe(F.lit(v)) for i, v in enumerate(titles)], F.lit(bool(titles)))
    parsed = parsed.where(~is_header)
    if strict:
        miscounted = F.col("p.corrupt").isNotNull()
        malformed = malformed.unionByName(parsed.where(miscounted).select(FILE, "line", F.lit(FIELDS).alias("reason")))
        parsed = parsed.where(~miscounted)
    return parsed.select(*[F.col(f"p.c{i}").alias(n) for i, n in enumerate(names)], FILE), malformed


def as_rejects(malformed: DataFrame, source_name: str) -> DataFrame:
    """Rows of the reject table, which have no number."""
    return malformed.select(
        F.lit(None).cast("long").alias("seq"), F.lit(source_name).alias("source_name"),
        F.concat(F.col("reason"), F.lit(" in "), F.col(FILE), F.lit(": "), F.col("line")).alias("reason"))
