"""Scoring by the frozen rule, throttling, and evaluation by episode."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ordered import fold

#: Weights of the frozen linear rule and its threshold.
TERMS = {"registered_fault_text_count_24h": 2.0, "registered_fault_text_count_168h": 0.5, "completed_episode_count_168h": 1.0, "technical_message_count_24h": 0.1}
THRESHOLD = 7.1


def rule_score(rows: DataFrame, status: str = "eligible", threshold: float = THRESHOLD, terms: dict[str, float] = TERMS) -> DataFrame:
    """rows with rule_score and alert; missing counts are zero, a status other than eligible gives nulls."""
    score = F.lit(0.0)
    for name, weight in terms.items():
        score = score + weight * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    ready = F.col(status) == "eligible"
    return rows.withColumn("rule_score", F.when(ready, score)).withColumn("alert", F.when(ready, score >= threshold))


def shadow_decisions(rows: DataFrame, threshold: float = THRESHOLD, terms: dict[str, float] = TERMS) -> DataFrame:
    """rows (channel_id, prediction_time, admission_status, admission_reason, history_through, admission_through, counts) with prediction_status, unavailable_reason, rule_score, crossed.

    A count that is missing, negative or no whole number makes the hour unavailable; so does evidence from after it.
    """
    bad = F.lit(False)
    score = F.lit(0.0)
    for name, weight in terms.items():
        c = F.col(name).cast("double")
        bad |= F.coalesce((c < 0) | (c != F.floor(c)) | F.isnan(c), F.lit(True))
        score = score + weight * c
    cut = F.col("history_through").isNull() | F.col("admission_through").isNull()
    future = (F.col("history_through") > F.col("prediction_time")) | (F.col("admission_through") > F.col("prediction_time"))
    reason = F.when(F.col("admission_status") != "eligible", F.col("admission_reason")).when(cut, "missing_evidence_cutoff").when(future, "future_evidence").when(bad, "missing_or_invalid_rule_count")
    scored = (F.col("admission_status") == "eligible") & reason.isNull()
    return rows.select("*", F.when(scored, "scored").otherwise("unavailable").alias("prediction_status"), reason.alias("unavailable_reason"), F.when(scored, score).alias("rule_score"), F.when(scored, score >= threshold).alias("crossed"))


class _Cooldown:
    """Marks rows of one channel: emitted unless the last emitted one is nearer than the cooldown."""

    def __init__(self, key: tuple, cooldown: timedelta, closed: bool):
        self.cooldown, self.closed = cooldown, closed
        self.last: datetime | None = None

    def step(self, r: dict) -> Iterable[tuple]:
        at = r["at_"]
        quiet = self.last is not None and (at <= self.last + self.cooldown if self.closed else at < self.last + self.cooldown)
        if not quiet:
            self.last = at
        return [(*(v for k, v in r.items() if k != "at_"), not quiet)]

    def finish(self) -> Iterable[tuple]:
        return []


def cooldown(rows: DataFrame, by: list[str], at: str, hours: float = 24, closed: bool = False) -> DataFrame:
    """rows with emitted: the first of each key, then each that is at least the hours after the last emitted (closed: more than).

    What is emitted depends on what was, so rows are folded in order; state is one time a key.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    marked = rows.withColumn("at_", F.col(at))
    return fold(marked, by, ["at_"], lambda key: _Cooldown(key, timedelta(hours=hours), closed), f"{fields}, emitted boolean")


def alert_outcomes(rows: DataFrame, score: str, threshold: float, hours: float = 24) -> DataFrame:
    """Emitted warnings of rows (channel_id, prediction_time, target, target_episode_id, label_available_at, score) with outcome and lead_hours.

    Cooldown first, matching after: an early false warning can silence a true one; of several warnings of one
    episode the first by channel and time matches.
    """
    emitted = cooldown(rows.where(F.col(score) >= threshold), ["channel_id"], "prediction_time", hours).where("emitted").drop("emitted")
    order = Window.partitionBy("target_episode_id").orderBy("channel_id", "prediction_time")
    outcome = F.when(F.col("target") == 0, "no_target_in_horizon").when(F.row_number().over(order) == 1, "matched_episode").otherwise("duplicate_episode_warning")
    lead = F.timestamp_diff("MICROSECOND", F.col("prediction_time"), F.col("label_available_at")).cast("double") / 3.6e9
    return emitted.withColumn("outcome", outcome).withColumn("lead_hours", F.when(F.col("target") == 1, lead))


def alert_summary(rows: DataFrame, outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Truth, warnings, precision, recall, F1, unmatched per 1000 channel-days, median lead; in total or by columns of rows."""
    by = by or []
    truth = rows.groupBy(*by).agg(F.countDistinct(F.when(F.col("target") == 1, F.col("target_episode_id"))).alias("truth"), F.countDistinct(F.struct("channel_id", F.to_date("prediction_time"))).alias("channel_days"))
    matched = F.col("outcome") == "matched_episode"
    got = outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("warnings"), F.count(F.when(matched, 1)).alias("matched"), F.expr("percentile(CASE WHEN outcome = 'matched_episode' THEN lead_hours END, 0.5)").alias("median_lead_hours"))
    both = truth.join(got, by, "left") if by else truth.crossJoin(got)
    n, m = F.coalesce("warnings", F.lit(0)), F.coalesce("matched", F.lit(0))
    precision, recall = F.when(n > 0, m / n).otherwise(0.0), F.when(F.col("truth") > 0, m / F.col("truth")).otherwise(0.0)
    return both.select(*by, "truth", "channel_days", n.alias("warnings"), m.alias("matched"), precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"), ((n - m) * 1000 / F.col("channel_days")).alias("unmatched_per_1000"), "median_lead_hours")


def threshold_curve(rows: DataFrame, score: str, thresholds: list[float], hours: float = 24) -> DataFrame:
    """The summary at every threshold of a stated list, in one pass: thresholds are part of the key of the cooldown."""
    grid = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where(F.col(score) >= F.col("threshold"))
    emitted = cooldown(grid, ["threshold", "channel_id"], "prediction_time", hours).where("emitted")
    order = Window.partitionBy("threshold", "target_episode_id").orderBy("channel_id", "prediction_time")
    hit = (F.col("target") == 1) & (F.row_number().over(order) == 1)
    return emitted.withColumn("hit", hit).groupBy("threshold").agg(F.count(F.lit(1)).alias("warnings"), F.count(F.when(F.col("hit"), 1)).alias("matched"))


def compared(summaries: DataFrame, baseline: str) -> DataFrame:
    """summaries (variant, precision, recall, f1, unmatched_per_1000) with their differences from the baseline's row."""
    of = ["recall", "f1", "unmatched_per_1000"]
    base = summaries.where(F.col("variant") == baseline).select(*[F.col(c).alias(f"b_{c}") for c in of])
    return summaries.crossJoin(base).select(*summaries.columns, *[(F.col(c) - F.col(f"b_{c}")).alias(f"delta_{c}") for c in of])


def within_budget(curve: DataFrame, channel_days: int, most_per_1000: float) -> DataFrame:
    """The threshold with most matched, then fewest unmatched, then highest, of those within the budget of unmatched warnings."""
    unmatched = F.col("warnings") - F.col("matched")
    good = curve.where(unmatched * 1000 / channel_days <= most_per_1000)
    return good.agg(F.max_by(F.struct("threshold", "warnings", "matched"), F.struct("matched", -unmatched, "threshold")).alias("best")).select("best.*")


def score_curve(rows: DataFrame, score: str, label: str, ranges: int = 256) -> DataFrame:
    """For every different score s from the highest down: p and n at it, tp and seen down to it, total positives.

    Scores are dealt into ranges by approximate quantiles; each range has its own running sums, and starts from the
    totals of the ranges above, of which there are at most `ranges`. So no task sees all scores.
    """
    ties = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    cuts = ties.agg(F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    above = F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>"), F.lit(0), lambda k, c: k + (c > F.col("s")).cast("int"))
    dealt = ties.withColumn("range", above)
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn")).select(F.col("range").alias("r"), F.coalesce(F.sum("rp").over(order), F.lit(0)).alias("p0"), F.coalesce(F.sum("rn").over(order), F.lit(0)).alias("n0"), F.sum("rp").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("range").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.join(F.broadcast(starts), F.col("range") == F.col("r"))  # at most `ranges` rows
    return joined.select("s", "p", "n", (F.col("p0") + F.sum("p").over(inside)).alias("tp"), (F.col("n0") + F.sum("n").over(inside)).alias("seen"), "total")


def ranking_metrics(rows: DataFrame, score: str, label: str) -> DataFrame:
    """average_precision and roc_auc; rows of one score stand together."""
    curve = score_curve(rows, score, label)
    total = F.sum("p")
    ap = F.sum(F.col("p") * F.col("tp") / F.col("seen")) / total
    # Pairs of a positive above a negative, halves for ties: negatives below each positive.
    neg = F.col("n") - F.col("p")
    above = F.sum(neg * (F.col("tp") - F.col("p") / 2))
    return curve.agg(ap.alias("average_precision"), (above / (total * F.sum(neg))).alias("roc_auc"), total.alias("positives"), F.sum("n").alias("rows"))


class _Matching:
    """Greedy matching in one scope: truths by start, each takes the earliest unused warning in [start, until]."""

    def __init__(self, key: tuple):
        self.key = key
        self.warnings: list[tuple[datetime, str]] = []
        self.truths: list[tuple[datetime, datetime, str]] = []

    def step(self, r: dict) -> Iterable[tuple]:
        (self.truths.append((r["at"], r["until"], r["id"])) if r["is_truth"] else self.warnings.append((r["at"], r["id"])))
        return []

    def finish(self) -> Iterable[tuple]:
        used, out, low = set(), [], 0
        for start, until, truth in sorted(self.truths):
            while low < len(self.warnings) and self.warnings[low][0] < start:
                low += 1
            found = next((i for i in range(low, len(self.warnings)) if i not in used and self.warnings[i][0] <= until), None)
            if found is None or self.warnings[found][0] > until:
                out.append((*self.key, truth, None, None))
                continue
            used.add(found)
            out.append((*self.key, truth, self.warnings[found][1], (self.warnings[found][0] - start).total_seconds()))
        return out + [(*self.key, None, w, None) for i, (_, w) in enumerate(self.warnings) if i not in used]


def match_episodes(truths: DataFrame, warnings: DataFrame, scope: list[str]) -> DataFrame:
    """truths: scope, truth_id, start_at, until; warnings: scope, warning_id, at. Matches, missed truths and false warnings.

    A scope is an experiment's scenario and channel; its truths and warnings are held together.
    """
    t = truths.select(*scope, F.lit(True).alias("is_truth"), F.col("start_at").alias("at"), "until", F.col("truth_id").alias("id"))
    w = warnings.select(*scope, F.lit(False).alias("is_truth"), "at", F.lit(None).cast("timestamp_ntz").alias("until"), F.col("warning_id").alias("id"))
    keys = ", ".join(f"{c} string" for c in scope)
    return fold(t.unionByName(w), scope, ["at", "id"], _Matching, f"{keys}, truth_id string, warning_id string, delay_seconds double")


def episode_weights(rows: DataFrame, episode: str, label: str) -> DataFrame:
    """Each positive episode has the mass of one positive row on average, however many rows it has."""
    w = Window.partitionBy(episode)
    share = F.lit(1.0) / F.count(F.lit(1)).over(w)
    return rows.withColumn("weight", F.when(F.col(label) == 1, share).otherwise(F.lit(1.0)))


def status_by_reason(reasons: Column, tests: list[tuple[str, str]], default: str) -> Column:
    """The first status whose text is part of any reason."""
    out = F.lit(default)
    for part, status in reversed(tests):
        out = F.when(F.contains(F.array_join(reasons, "\n"), F.lit(part)), status).otherwise(out)
    return out


class _RecoveryReset:
    """Warnings of one channel: inside the cooldown one more may come after an episode has begun and clearly ended there."""

    def __init__(self, key: tuple, cooldown: timedelta, allow: bool):
        self.key, self.cooldown, self.allow = key, cooldown, allow
        self.last: datetime | None = None
        self.recovered = False

    def step(self, r: dict) -> Iterable[tuple]:
        at = r["at"]
        if r["kind"] == "recovery":
            self.recovered = self.last is not None and self.last < r["onset"] <= self.last + self.cooldown and r["onset"] < at < self.last + self.cooldown
            return []
        if r["kind"] == "uncertain":
            self.recovered = False
            return []
        quiet = self.last is not None and at < self.last + self.cooldown
        reset = self.allow and quiet and self.recovered and r["healthy"]
        if not r["eligible"]:
            return [(*self.key, at, False, "not_eligible")]
        if not r["above"]:
            return [(*self.key, at, False, "below_threshold")]
        if quiet and not reset:
            return [(*self.key, at, False, "suppressed_24h")]
        self.last, self.recovered = at, False
        return [(*self.key, at, True, "recovered_episode_reset" if reset else "standard_24h_warning")]

    def finish(self) -> Iterable[tuple]:
        return []


def recovery_reset(decisions: DataFrame, recoveries: DataFrame, uncertain: DataFrame, allow: bool, hours: float = 24) -> DataFrame:
    """decisions: channel_id, at, eligible, above, healthy; recoveries: channel_id, onset, at (a confident onset's clear end); uncertain: channel_id, at.

    Rows: channel_id, at, warning, reason. Evidence of an instant counts before its decision.
    """
    no = lambda c: F.lit(None).cast("boolean").alias(c)
    d = decisions.select("channel_id", "at", F.lit(2).alias("k"), F.lit("decision").alias("kind"), F.lit(None).cast("timestamp_ntz").alias("onset"), "eligible", "above", "healthy")
    r = recoveries.select("channel_id", "at", F.lit(1).alias("k"), F.lit("recovery").alias("kind"), "onset", no("eligible"), no("above"), no("healthy"))
    u = uncertain.select("channel_id", "at", F.lit(0).alias("k"), F.lit("uncertain").alias("kind"), F.lit(None).cast("timestamp_ntz").alias("onset"), no("eligible"), no("above"), no("healthy"))
    make = lambda key: _RecoveryReset(key, timedelta(hours=hours), allow)
    return fold(d.unionByName(r).unionByName(u), ["channel_id"], ["at", "k"], make, "channel_id string, at timestamp_ntz, warning boolean, reason string")


def blockers(rows: DataFrame, by: list[str], at: str, hours: float = 24) -> DataFrame:
    """Suppressed rows with the emitted one that silenced each: blocker_at."""
    marked = cooldown(rows, by, at, hours)
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("blocker_at", F.max(F.when(F.col("emitted"), F.col(at))).over(w)).where("NOT emitted").drop("emitted")


def low_value_watch(readings: DataFrame, low: float, high: float, gap_hours: float, cooldown_hours: float = 24) -> DataFrame:
    """Warnings of readings (channel_id, ts, value) in (low, high] that follow another within the gap, at most one each cooldown."""
    w = Window.partitionBy("channel_id").orderBy("ts")
    hours = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) / 3.6e9
    near = readings.dropDuplicates(["channel_id", "ts", "value"]).withColumn("gap_hours", hours).where((F.col("value") > low) & (F.col("value") <= high) & (F.col("gap_hours") <= gap_hours))
    return cooldown(near, ["channel_id"], "ts", cooldown_hours).where("emitted").drop("emitted")


def contributions(rows: DataFrame, by: list[str], terms: dict[str, float] = TERMS) -> DataFrame:
    """Median contribution of every term to the score by key, largest first."""
    each = rows.select(*by, F.explode(F.create_map(*[x for n, w in terms.items() for x in (F.lit(n), (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) * w))])).alias("term", "value"))
    return each.groupBy(*by, "term").agg(F.expr("percentile(value, 0.5)").alias("median_contribution")).orderBy(*by, F.desc("median_contribution"), "term")
