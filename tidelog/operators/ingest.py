"""From raw journal strings to clean events: normalize, classify, flag conflicts, enrich, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import parse

RAW = ["event_id_raw", "channel_id_raw", "date_raw", "time_raw", "alarm_raw", "value_raw"]


def normalize(raw: DataFrame, header: list[str]) -> DataFrame:
    """Rows of row_id, source, source_row and the six raw strings, parsed; nothing is dropped.

    Flags stand in a fixed order: timestamp, alarm, numeric, missing event id, empty channel, empty value.
    """
    s = {c: F.coalesce(F.col(c), F.lit("")) for c in RAW}
    at, alarm, number = parse.parse_local_timestamp(s["date_raw"], s["time_raw"]), parse.parse_alarm(s["alarm_raw"]), parse.parse_numeric(s["value_raw"])
    parsed = raw.select("row_id", "source", "source_row", *[s[c].alias(c) for c in RAW]).withColumns({"at_": at, "alarm_": alarm, "number_": number})
    event, channel, empty = F.nullif(parse.strip(F.col("event_id_raw")), F.lit("")), F.nullif(parse.strip(F.col("channel_id_raw")), F.lit("")), parse.strip(F.col("value_raw")) == ""
    repeated = F.lit(True)
    for c, name in zip(RAW, header, strict=True):
        repeated &= parse.strip(F.col(c)) == name
    value = F.col("number_.value")
    return parsed.select(
        "row_id", "source", "source_row", *RAW, event.alias("event_id"), channel.alias("channel_id"), F.col("at_.value").alias("timestamp"), F.col("alarm_.value").alias("alarm"),
        value.alias("value_numeric"), F.when(value.isNull(), F.col("value_raw")).alias("value_state"), value.isNotNull().alias("is_numeric"),
        parse.flags(F.col("at_.flag"), F.col("alarm_.flag"), F.col("number_.flag"), F.when(event.isNull(), "missing_event_id"), F.when(channel.isNull(), "empty_channel_id"), F.when(empty, "empty_value")).alias("quality_flags"),
        (F.col("at_.value").isNull() | F.col("alarm_.value").isNull() | channel.isNull() | empty).alias("invalid"), repeated.alias("repeated_header"),
    )


def classify(rows: DataFrame, keys: list[str] = RAW) -> DataFrame:
    """rows with first_row_id and disposition: repeated_header, exact_duplicate, quarantine, accepted, first that applies.

    The first row id of equal keys (nulls equal) comes from a grouped minimum, which combines copies before the
    shuffle; only keys with copies are joined back, by a hash of the key and then by the key itself, so a key
    with many copies is no task's burden and most rows meet no partner.
    """
    hashed = rows.withColumn("kh_", F.xxhash64(*keys))
    first = hashed.groupBy("kh_", *keys).agg(F.min("row_id").alias("first_"), F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    first = first.select(F.col("kh_").alias("fh_"), F.struct(*keys).alias("key_"), "first_")
    # Fields of structs compare with nulls equal; as a negation it is checked on equal hashes and is no key of the join.
    same = (F.col("kh_") == F.col("fh_")) & ~(F.struct(*[F.col(k) for k in keys]) != F.col("key_"))
    joined = hashed.join(first, same, "left").withColumn("first_row_id", F.coalesce("first_", "row_id")).drop("kh_", "fh_", "key_", "first_")
    kind = F.when(F.col("repeated_header"), "repeated_header").when(F.col("row_id") != F.col("first_row_id"), "exact_duplicate").when(F.col("invalid"), "quarantine").otherwise("accepted")
    return joined.withColumn("disposition", kind)


def classify_parts(rows: DataFrame, parts: int, keys: list[str] = RAW) -> DataFrame:
    """The same, one part after another, for runs that must fit a small cluster: equal keys lie in one part, so parts need nothing of each other."""
    part = F.pmod(F.xxhash64(*keys), F.lit(parts))
    return reduce(DataFrame.unionByName, [classify(rows.where(part == i), keys) for i in range(parts)])


def conflicts(accepted: DataFrame, at: str = "timestamp", variant: tuple[str, ...] = ("value_raw", "alarm")) -> DataFrame:
    """(channel_id, at) with more than one variant; a variant with a null counts."""
    return accepted.groupBy("channel_id", at).agg(F.countDistinct(F.struct(*variant)).alias("n")).where("n > 1").drop("n")


def enrich(accepted: DataFrame, channels: DataFrame, objects: DataFrame, conflicting: DataFrame, mapping_available: bool = True, at: str = "timestamp") -> DataFrame:
    """Left joins that keep every row: channel and object columns, join_status, flags unknown_channel and channel_time_conflict, year, month.

    Dictionaries join by equality and are broadcast only where Spark's own size bound allows.
    """
    c = channels.select(F.col("channel_id").alias("c_id"), *[x for x in channels.columns if x != "channel_id"])
    o = objects.select(F.col("object_id").alias("o_id"), *[x for x in objects.columns if x != "object_id"])
    x = conflicting.select(F.col("channel_id").alias("x_id"), F.col(at).alias("x_at"))
    joined = accepted.join(c, F.col("channel_id") == F.col("c_id"), "left").join(o, F.col("object_id") == F.col("o_id"), "left").join(x, (F.col("channel_id") == F.col("x_id")) & (F.col(at) == F.col("x_at")), "left")
    missing = "object_id_missing" if mapping_available else "object_mapping_unavailable"
    status = F.when(F.col("c_id").isNull(), "unknown_channel").when(F.col("object_id").isNull(), missing).when(F.col("o_id").isNull(), "object_not_found").otherwise("linked")
    more = parse.flags(F.when(F.col("c_id").isNull(), "unknown_channel"), F.when(F.col("x_id").isNotNull(), "channel_time_conflict"))
    return joined.withColumns({"join_status": status, "quality_flags": F.concat("quality_flags", more), "year": F.year(at), "month": F.month(at)}).drop("c_id", "o_id", "x_id", "x_at")


def quality_report(classified: DataFrame, clean: DataFrame) -> DataFrame:
    """(check, value): dispositions, flags, join statuses, and the sanity checks row conservation, fan-out, value representation, provenance."""
    def named(df: DataFrame, name: Column) -> DataFrame:
        return df.groupBy(name.alias("check")).agg(F.count(F.lit(1)).alias("value"))

    dispositions = named(classified, F.concat(F.lit("disposition:"), "disposition"))
    statuses = named(clean, F.concat(F.lit("join:"), "join_status"))
    flags = named(clean.select(F.explode("quality_flags").alias("flag")), F.concat(F.lit("flag:"), "flag"))
    totals = clean.agg(
        F.count(F.lit(1)).alias("clean_rows"), (F.count(F.lit(1)) - F.countDistinct(F.struct("source", "source_row"))).alias("repeated_provenance"),
        F.count(F.when(F.col("value_numeric").isNull() == F.col("value_state").isNull(), 1)).alias("bad_value_representation"),
    ).select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in ("clean_rows", "repeated_provenance", "bad_value_representation")]), F.array("clean_rows", "repeated_provenance", "bad_value_representation"))).alias("check", "value"))
    return dispositions.unionByName(statuses).unionByName(flags).unionByName(totals)


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; order by a full tie-break."""
    return rows.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("r_ = 1").drop("r_")


def parent_chains(spark: SparkSession, objects: DataFrame, most_depth: int = 64) -> DataFrame:
    """(root, depth, cycle, missing_parent) of every object's way up, to at most most_depth steps.

    The dictionary is small beside the journal; each step is one equality join, and ends when no way goes on.
    """
    tree = objects.select(F.col("object_id").alias("id"), F.col("parent_object_id").alias("up"))
    known = tree.select(F.col("id").alias("known")).distinct()
    ways = tree.select(F.col("id").alias("root"), F.col("up").alias("at"), F.lit(1).alias("depth")).where("at IS NOT NULL")
    out = ways
    for _ in range(most_depth - 1):
        ways = ways.where("at <> root").join(tree, F.col("at") == F.col("id")).select("root", F.col("up").alias("at"), (F.col("depth") + 1).alias("depth")).where("at IS NOT NULL")
        if ways.isEmpty():
            break
        out = out.unionByName(ways)
    marked = out.join(known, F.col("at") == F.col("known"), "left")
    return marked.groupBy("root").agg(F.max("depth").alias("depth"), F.bool_or(F.col("at") == F.col("root")).alias("cycle"), F.bool_or(F.col("known").isNull()).alias("missing_parent"))


def violations(rows: DataFrame, key: list[str], finite: list[str], growing: list[list[str]]) -> DataFrame:
    """(violation, value): repeated keys, numbers that are not finite, and counts that shrink over wider windows."""
    found = [rows.groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("value")).select(F.lit("repeated_keys").alias("violation"), "value")]
    checks = {f"not_finite:{c}": F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in finite}
    checks |= {f"shrinks:{a}>{b}": F.col(a) > F.col(b) for names in growing for a, b in zip(names, names[1:], strict=False)}
    for name, bad in checks.items():
        found.append(rows.agg(F.count(F.when(bad, 1)).alias("value")).select(F.lit(name).alias("violation"), "value"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def compare_multisets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b): rows more on either side, counted with repeats."""
    left = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_a"))
    return left.crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_b")))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """count, sum, xor, min and max of a row hash under two salts; equal for equal multisets of rows in any order."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns])
    hashed = rows.select(*[F.xxhash64(F.lit(salt), text).alias(f"h{i}") for i, salt in enumerate(("first", "second"))])
    each = [f(f"h{i}").alias(f"{n}{i}") for i in range(2) for n, f in (("xor", F.bit_xor), ("min", F.min), ("max", F.max))]
    return hashed.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(f"h{i}").cast("decimal(38,0)")).alias(f"sum{i}") for i in range(2)], *each)
