"""Checks of tool arguments and extracted items, with their defaults. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import is_blank, once, trim_all
from .values import valid_date

#: Kinds an extracted item may have, and the values of its fields (fixed values).
ITEM_TYPES = (
    "objective", "outcome", "deliverable", "milestone", "task", "deadline", "requirement", "reporting_requirement", "proposal_requirement", "acceptance_criterion", "commitment",
    "action_item", "decision", "risk", "issue", "assumption", "dependency", "stakeholder", "metric", "budget_fact", "open_question",
)
DATE_KINDS = ("exact", "relative", "recurring", "conditional", "none")
INTERPRETATIONS = ("explicit", "inferred", "unclear")
CONFIDENCES = ("high", "medium", "low")
COMMITMENT_LEVELS = ("required", "committed", "proposed", "discussed", "informational", "unclear")
#: Spellings of a creation date's key in old notes (fixed values).
LEGACY_CREATED_KEYS = ("created", "created_at", "createdat", "date_created", "datecreated", "creation_date")

DECIMAL = "^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"


def _coerced(field: Column, kind: str) -> Column:
    """The argument as text if it is of its kind or can be turned into it, else null. Null becomes 0, false or empty."""
    found = F.schema_of_variant(field)
    text = F.try_variant_get(field, "$", "string")
    number = found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if kind == "string":
        return F.when(found == "VOID", "").when((found == "STRING") | (found == "BOOLEAN") | number, text)
    if kind == "boolean":
        one = F.when(text.try_cast("double") == 1, "true").when(text.try_cast("double") == 0, "false")
        return F.when(found == "VOID", "false").when((found == "BOOLEAN") | ((found == "STRING") & text.isin("true", "false")), text).when(number, one)
    if kind not in ("number", "integer"):
        raise ValueError(kind)
    value = F.when(found == "VOID", 0.0).when(found == "BOOLEAN", (text == "true").cast("double")).when(number | ((found == "STRING") & text.rlike(DECIMAL)), trim_all(text).try_cast("double"))
    value = F.when(F.abs(value) < float("inf"), value)
    whole = value.try_cast("long")
    if kind == "integer":
        return F.when(value == whole, whole.cast("string"))
    return F.when(value == whole, whole.cast("string")).otherwise(value.cast("string"))


def tool_arguments(c: Column, schema: dict[str, str], required: tuple[str, ...] = ()) -> dict[str, Column]:
    """Arguments of a tool call, JSON text, against {name: string | boolean | number | integer}.

    values: map of the coerced arguments as text; problems: "malformed" where the text is no JSON object, else
    "name: missing" or "name: kind" in the schema's order. Text is taken as a number in decimal form only.
    """
    v = F.try_parse_json(c)
    broken = ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    problems, entries = [], []
    for name, kind in schema.items():
        field = F.try_variant_get(v, f"$.{name}", "variant")
        value = _coerced(field, kind)
        problems.append(F.when(field.isNull(), F.lit(f"{name}: missing") if name in required else F.lit(None)).when(value.isNull(), f"{name}: {kind}"))
        entries.append(F.struct(F.lit(name).alias("key"), value.alias("value")))
    listed = F.array_compact(F.array(*[p.cast("string") for p in problems]))
    return {"problems": F.when(broken, F.array(F.lit("malformed"))).otherwise(listed), "values": F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))}


def item_defaults(item: dict[str, Column]) -> dict[str, Column]:
    """Fields of an extracted item, trimmed, with the defaults of the empty ones."""
    text = {k: trim_all(c) for k, c in item.items() if k != "direct_quotes"}
    known = {"date_kind": "none", "interpretation": "explicit", "confidence": "medium", "commitment_level": "unclear", "scope_relation": "direct"}
    filled = {k: F.when(is_blank(text[k]), d).otherwise(text[k]) if k in text else F.lit(d) for k, d in known.items()}
    return {**text, **filled, **({"direct_quotes": F.transform(item["direct_quotes"], trim_all)} if "direct_quotes" in item else {})}


def item_problem(item: dict[str, Column]) -> Column:
    """The first rule that an extracted item breaks, null if it is sound. Takes what item_defaults returns; absent fields are null."""
    get = lambda k: item.get(k, F.lit(None).cast("string"))
    empty = lambda k: is_blank(get(k))
    kind = get("date_kind")
    quotes = item.get("direct_quotes", F.lit(None).cast("array<string>"))
    rules = [
        (~F.coalesce(get("item_type").isin(*ITEM_TYPES), F.lit(False)), "item_type"),
        (empty("title"), "title"),
        (~kind.isin(*DATE_KINDS), "date_kind"),
        (~get("interpretation").isin(*INTERPRETATIONS), "interpretation"),
        (~get("confidence").isin(*CONFIDENCES), "confidence"),
        (~get("commitment_level").isin(*COMMITMENT_LEVELS), "commitment_level"),
        ((kind == "exact") & valid_date(get("date")).isNull(), "date"),
        ((kind != "exact") & ~empty("date"), "date of no exact kind"),
        (kind.isin("relative", "conditional") & empty("trigger"), "trigger"),
        ((kind == "recurring") & empty("recurrence"), "recurrence"),
        (F.coalesce(F.size(quotes) < 1, F.lit(True)) | F.exists(quotes, is_blank), "direct_quotes"),
        (~get("scope_relation").isin("direct", "dependency", "shared", "full"), "scope_relation"),
    ]
    out = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out


def legacy_created(c: Column) -> Column:
    """The first valid creation date in a note under any old spelling of its key: case, hyphens and spaces do not count."""
    pattern = "(?m)^[ \\t]*([A-Za-z][A-Za-z0-9_ -]*)[ \\t]*:[ \\t]*(.+?)[ \\t]*$"
    part = lambda k: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(k))
    key = lambda k: F.translate(F.lower(F.trim(k)), "- ", "__")
    day = lambda x: valid_date(F.regexp_extract(x, "^[\"']*([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])", 1))
    dates = F.zip_with(part(1), part(2), lambda k, x: F.when(key(k).isin(*LEGACY_CREATED_KEYS), day(x)))
    return F.get(F.array_compact(dates), F.lit(0))


#: Fields of an extracted item that are text, beside its type and title (fixed values).
ITEM_TEXTS = ("description", "party", "counterparty", "date_text", "date_kind", "date", "trigger", "recurrence", "acceptance_criteria", "evidence_required", "commitment_level", "interpretation", "confidence", "scope_relation", "start_date", "end_date", "schedule_basis")
#: Its fields that are lists beside its quotations, and those that are whole numbers (fixed values).
ITEM_LISTS, ITEM_NUMBERS = ("teams", "workstreams"), ("offset_days", "duration_days")


def extracted_item(c: Column) -> dict[str, Column]:
    """An item that a model sent as JSON: problem, the first rule that it breaks (null: none), and its fields with their defaults.

    Rules and their order are those of item_problem, then whole numbers of offset_days, quotations (one text counts as a list of one), teams and workstreams
    (one text is a list of one, a blank one of none), the relation to the scope, start and end dates, and days of duration, which are not negative.
    The fields of a broken item are what could be read of it.
    """
    found = item_of_json(c)
    return {k: found[k] for k in ("problem", "item_type", "title", *ITEM_TEXTS, "direct_quotes", *ITEM_LISTS, *ITEM_NUMBERS)}


def item_of_json(c: Column) -> Column:
    """The same as one struct. Each step binds what it made as an argument, so that rules name fields and do not read the text again."""
    steps = lambda read: once(_filled(read), lambda filled: _judged(read, filled))
    return once(F.try_parse_json(c), lambda v: once(_fields(v), steps))


def _struct(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def _fields(v: Column) -> Column:
    """For each field its kind, and its text, list or number as the field's use calls for."""
    none, some = F.array().cast("array<string>"), "array<string>"
    trimmed = lambda r: trim_all(F.try_variant_get(r, "$", "string"))
    one = lambda t: F.when(is_blank(t), none).otherwise(F.array(t))

    def many(r: Column, kind: Column) -> Column:
        listed = F.when(kind == "STRING", once(trimmed(r), one)).when(kind.startswith("ARRAY"), F.transform(F.try_variant_get(r, "$", some), trim_all))
        return F.when(kind == "VOID", none).otherwise(listed)

    raw: dict[str, Column] = {}
    # what a missing field and a null have: no kind but VOID
    value = {k: lambda r, kind: F.when(kind != "VOID", trimmed(r)) for k in ("item_type", "title", *ITEM_TEXTS)}
    value |= dict.fromkeys(("direct_quotes", *ITEM_LISTS), many)
    value |= {k: lambda r, kind: F.when(kind == "BIGINT", F.try_variant_get(r, "$", "long")) for k in ITEM_NUMBERS}
    empty = {**dict.fromkeys(value, F.lit(None).cast("string")), **dict.fromkeys(("direct_quotes", *ITEM_LISTS), none), **dict.fromkeys(ITEM_NUMBERS, F.lit(None).cast("long"))}

    def field(k: str) -> Column:
        whole = lambda r, kind: F.when(kind == "STRING", F.try_variant_get(r, "$", "string") == "").otherwise(kind.isin("VOID", "BIGINT"))
        sound = lambda kind: kind.isin("VOID", "STRING", "ARRAY<STRING>", "ARRAY<VOID>")
        right = whole if k in ITEM_NUMBERS else (lambda r, kind: sound(kind))
        read = lambda r, kind: _struct({"x": value[k](r, kind), "right": right(r, kind)})
        missing = _struct({"x": empty[k], "right": F.lit(True)})
        kind = lambda r: F.coalesce(F.schema_of_variant(r), F.lit("VOID"))
        return F.when(raw[k].isNull(), missing).otherwise(once(kind(raw[k]), lambda n: read(raw[k], n)))

    broken = ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    members = F.try_variant_get(v, "$", "struct<" + ", ".join(f"`{k}`: variant" for k in value) + ">")  # all in one pass

    def every(m: Column) -> Column:
        raw.update({k: m[k] for k in value})
        return _struct({"broken": broken, **{k: field(k) for k in value}})

    return once(members, every)


def _filled(read: Column) -> Column:
    return _struct(item_defaults({k: read[k]["x"] for k in ("item_type", "title", *ITEM_TEXTS, "direct_quotes")}))


def _judged(read: Column, filled: Column) -> Column:
    texts = {k: filled[k] for k in ("item_type", "title", *ITEM_TEXTS)}
    listed = lambda k: read[k]["x"]
    sound = lambda k, least: F.coalesce(read[k]["right"] & (F.size(listed(k)) >= least) & ~F.exists(listed(k), is_blank), F.lit(False))
    whole = lambda k: read[k]["right"]
    day = lambda k: is_blank(read[k]["x"]) | valid_date(read[k]["x"]).isNotNull()
    base = item_problem({**texts, "direct_quotes": F.array(F.lit("x")), "scope_relation": F.lit("direct")})
    rules = [
        (~whole("offset_days"), "offset_days"), (~sound("direct_quotes", 1), "direct_quotes"), (~sound("teams", 0), "teams"), (~sound("workstreams", 0), "workstreams"),
        (~texts["scope_relation"].isin("direct", "dependency", "shared", "full"), "scope_relation"), (~day("start_date"), "start_date"), (~day("end_date"), "end_date"),
        (~whole("duration_days") | (read["duration_days"]["x"] < 0), "duration_days"),
    ]
    late = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        late = F.when(broken, name).otherwise(late)
    dated = F.coalesce(*[F.when(~is_blank(read[k]["x"]), read[k]["x"]) for k in ("start_date", "end_date", "date")])
    basis = F.when(~is_blank(read["schedule_basis"]["x"]), read["schedule_basis"]["x"]).when(dated.isNotNull(), "source")
    problem = F.when(read["broken"], "item").otherwise(F.coalesce(base, late))
    return _struct({"problem": problem, **texts, "schedule_basis": basis, "direct_quotes": filled["direct_quotes"], **{k: read[k]["x"] for k in (*ITEM_LISTS, *ITEM_NUMBERS)}})


def created_from_backups(copies: DataFrame, note: str, run: str, text: Column) -> DataFrame:
    """(note, run, created): of a note's backup copies the earliest run that states a creation date, under any old spelling or else as its date."""
    plain = "(?m)^date[ \\t]*:[ \\t]*[\"']*([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"
    day = F.coalesce(legacy_created(text), valid_date(F.regexp_extract(F.coalesce(text, F.lit("")), plain, 1)))
    found = copies.select(F.col(note).alias("note"), F.col(run).alias("run"), day.alias("created")).where("created is not null")
    return found.groupBy("note").agg(F.min(F.struct("run", "created")).alias("x")).select("note", "x.run", "x.created")


def created_with_backups(rows: DataFrame, note: str, stated: Column, copies: DataFrame, other: Column) -> DataFrame:
    """(note, created, evidence): what the note states itself, else its earliest backup, else other evidence."""
    known = copies.select(F.col("note").alias("_note"), F.col("created").alias("_created"))
    met = rows.select(F.col(note).alias("note"), stated.alias("_stated"), other.alias("_other")).join(known, F.col("note") == F.col("_note"), "left")
    evidence = F.when(F.col("_stated").isNotNull(), "note").when(F.col("_created").isNotNull(), "backup").when(F.col("_other").isNotNull(), "other")
    return met.select("note", F.coalesce("_stated", "_created", "_other").alias("created"), evidence.alias("evidence"))
