"""Meaning of messages and quality of values, as small tables and expressions. The alarm bit decides nothing here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each state of the driver's journal stands for (a project choice): effect on registered health, category.
JOURNAL_STATES = {
    "error": ("fault", "technical_fault"),
    "signup": ("normal", "normal"),
    "purchase": ("uncertain", "technical_fault"),
    "click": ("neutral", "environmental_alarm"),
    "view": ("uncertain", "unknown"),
}


def effect(state: Column, table: dict[str, tuple[str, str]] = JOURNAL_STATES) -> Column:
    """fault, normal, neutral or uncertain; text outside the table is uncertain, no text is neutral."""
    out = F.when(state.isNull(), "neutral")
    for name, (what, _) in table.items():
        out = out.when(state == name, what)
    return out.otherwise("uncertain")


def category(state: Column, table: dict[str, tuple[str, str]] = JOURNAL_STATES) -> Column:
    out = F.when(state.isNull(), "unknown")
    for name, (_, what) in table.items():
        out = out.when(state == name, what)
    return out.otherwise("unknown")


# Words of the source journal.
FAULT, NORMAL, UNDEFINED = "Неисправен", "Норма", "Неопределен"
SMOKE, MOTION, DOOR, TEMPERATURE, GAS = "Датчик дыма", "Датчик движения", "КД Дверь", "Датчик температуры", "Газовый датчик"
SENSOR_TYPES = ["9-секционный люк", GAS, MOTION, SMOKE, "Датчик затопления", TEMPERATURE, "ИБП", "КД АВ", DOOR, "КД Люк", "Переключатель", "Ручной извещатель", "Состояние УИР-Р", "Состояние вентилятора", "Состояние насоса", "Состояние охраны", "Состояние фазы", "Стекло", "Тепловой датчик"]
#: (sensor type, state) that a project rule decides: category, reason.
PROJECT_RULES = {
    (SMOKE, "Обнаружен дым"): ("environmental_alarm", "observed_environmental_event"),
    (MOTION, "Обнаружено движение"): ("environmental_alarm", "observed_environmental_event"),
    (SMOKE, "Дыма нет"): ("normal", "observed_clear_state"),
    (MOTION, "Движения нет"): ("normal", "observed_clear_state"),
    (DOOR, "Не замкнут"): ("operational", "observed_contact_state"),
}
#: How the numeric, the discrete and the context detectors apply to each sensor type.
TYPE_MODES = {
    "Датчик температуры": ("primary", "supplemental", "supplemental"),
    "Газовый датчик": ("primary", "supplemental", "supplemental"),
    "Датчик дыма": ("not_applicable", "primary", "supplemental"),
    "Тепловой датчик": ("not_applicable", "primary", "supplemental"),
    "Датчик движения": ("not_applicable", "primary", "supplemental"),
    "КД АВ": ("not_applicable", "conditional", "supplemental"),
    "КД Дверь": ("not_applicable", "primary", "supplemental"),
    "КД Люк": ("not_applicable", "primary", "supplemental"),
    "9-секционный люк": ("not_applicable", "conditional", "supplemental"),
    "Стекло": ("not_applicable", "primary", "supplemental"),
    "Датчик затопления": ("not_applicable", "primary", "supplemental"),
    "Состояние насоса": ("not_applicable", "primary", "supplemental"),
    "Состояние вентилятора": ("not_applicable", "primary", "supplemental"),
    "ИБП": ("conditional", "primary", "primary"),
    "Состояние фазы": ("not_applicable", "primary", "primary"),
    "Состояние УИР-Р": ("not_applicable", "conditional", "conditional"),
    "Переключатель": ("not_applicable", "primary", "primary"),
    "Ручной извещатель": ("not_applicable", "primary", "primary"),
    "Состояние охраны": ("not_applicable", "primary", "primary"),
}
MESSAGE = "struct<category:string,source:string,reason:string,status:string,target:boolean>"


def dispatched(rows: DataFrame) -> DataFrame:
    """rows (sensor_type) with the policy of their type: numeric_mode, discrete_mode, context_mode, primary_mode and needs_review.

    primary_mode is numeric where that is primary, else discrete; both are null for types without a policy. The table
    of policies is one map of fixed size, so nothing is joined.
    """
    policies = F.create_map(*[x for t, modes in TYPE_MODES.items() for x in (F.lit(t), F.array(*map(F.lit, modes)))])
    own = F.try_element_at(policies, F.col("sensor_type"))
    with_modes = rows.withColumn("modes_", own).withColumns({f"{n}_mode": F.get("modes_", F.lit(i)) for i, n in enumerate(("numeric", "discrete", "context"))}).drop("modes_")
    primary = F.when(F.col("numeric_mode") == "primary", "numeric").when(F.col("discrete_mode").isin("primary", "conditional"), "discrete")
    return with_modes.withColumns({"primary_mode": primary, "needs_review": F.coalesce(F.when(primary == "numeric", F.col("numeric_mode")).otherwise(F.col("discrete_mode")) == "conditional", F.lit(False))})


def dictionary(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """(sensor_type, value_state, category, reason): a bounded table of what dictionary texts mean."""
    return spark.createDataFrame(rows, "rule_type string, rule_state string, rule_category string, rule_reason string")


def classify_messages(events: DataFrame, rules: DataFrame) -> DataFrame:
    """events with `message`: exact matching of (sensor_type, value_state), first rule that applies.

    Unknown type; no text; registered fault; normal; undefined; project rules; the dictionary's candidate;
    unmapped. `rules` is a table of one row a dictionary entry; Spark broadcasts it within its own size bound.
    """
    def message(cat: str, source: str, reason: str, status: str, target: bool = False) -> Column:
        return F.struct(F.lit(cat).alias("category"), F.lit(source).alias("source"), F.lit(reason).alias("reason"), F.lit(status).alias("status"), F.lit(target).alias("target"))

    kind, state = F.col("sensor_type"), F.col("value_state")
    out = F.when(kind.isNull() | ~kind.isin(*SENSOR_TYPES), message("unknown", "unresolved", "unverified_sensor_type", "unknown_type"))
    out = out.when(state.isNull(), message("unknown", "unresolved", "no_text_state", "not_state_message"))
    out = out.when(state == FAULT, message("technical_fault", "project_rule", "exact_registered_fault_text", "project_defined", True))
    out = out.when(state == NORMAL, message("normal", "project_rule", "exact_normal_text", "project_defined"))
    out = out.when(state == UNDEFINED, message("unknown", "project_rule", "explicit_undefined_text", "unknown_state"))
    for (t, s), (cat, reason) in PROJECT_RULES.items():
        out = out.when((kind == t) & (state == s), message(cat, "project_rule", reason, "project_defined"))
    known = F.struct(F.col("rule_category").alias("category"), F.when(F.col("rule_category") == "unknown", "unresolved").otherwise("dictionary_candidate").alias("source"), F.col("rule_reason").alias("reason"), F.when(F.col("rule_category") == "unknown", "requires_review").otherwise("candidate_only").alias("status"), F.lit(False).alias("target"))
    out = out.when(F.col("rule_category").isNotNull(), known).otherwise(message("unknown", "unresolved", "unmapped_state", "unknown_state"))
    joined = events.join(rules, (kind == F.col("rule_type")) & (state == F.col("rule_state")), "left")
    return joined.withColumn("message", out.cast(MESSAGE)).drop("rule_type", "rule_state", "rule_category", "rule_reason")


def registered_effect(message: Column, state: Column) -> Column:
    """fault, normal, neutral or uncertain of a classified message."""
    return (
        F.when(message["status"] == "unknown_type", "uncertain").when(state.isNull(), "neutral").when(message["target"], "fault").when(state == NORMAL, "normal")
        .when((message["category"] == "environmental_alarm") | (message["reason"] == "observed_clear_state"), "neutral").otherwise("uncertain")
    )


def assess_value(kind: Column, raw: Column, number: Column, service_codes: list[float], epoch_texts: list[str], gas_alarm: float = 1.0, gas_most: float = 100.0) -> Column:
    """Struct (category, numeric_usable, state_usable) of one observation."""
    def quality(cat: str, numeric: bool, state: bool) -> Column:
        return F.struct(F.lit(cat).alias("category"), F.lit(numeric).alias("numeric_usable"), F.lit(state).alias("state_usable"))

    out = F.when(number.isNull() & F.trim(raw).isin(*epoch_texts), quality("epoch_value_artifact", False, False)).when(number.isNull(), quality("ordinary_text", False, True))
    out = out.when((kind == TEMPERATURE) & number.isin(*service_codes), quality("temperature_service_code_candidate", False, False))
    out = out.when((kind == GAS) & (number < 0), quality("gas_negative_reading", True, False)).when((kind == GAS) & (number > gas_most), quality("gas_above_physical_percent", False, False))
    return out.when((kind == GAS) & (number >= gas_alarm), quality("gas_alarm_level_candidate", True, False)).otherwise(quality("ordinary_numeric", True, False))


def recent_normal(normal_at: Column, at: Column, same_segment: Column, hours: int, strict: bool) -> Column:
    """A normal not older than `hours` in the same segment; strict: before `at`, else at it too."""
    after = normal_at < at if strict else normal_at <= at
    return F.coalesce(normal_at.isNotNull() & same_segment & after & (at <= normal_at + F.expr(f"INTERVAL '{hours}' HOUR")), F.lit(False))
