"""Reports: the best fact of each target, the requested targets with what is missing, and the two JSON views.

All within a row: no shuffle. `results` are in the order of their targets.
"""

from pyspark.sql import functions as F

from factloom.catalog import SCORES
from factloom.functions.evidence import TYPE, pinned

SCHEMA_VERSION, TOOL_VERSION = "2.0", "2.4.0"


def best(evidence):
    """One fact a target: a strictly greater confidence replaces an earlier fact, ties keep the first; in order of targets."""
    placed = F.transform(evidence, lambda e, i: F.struct(e["target"].alias("target"), (-e["confidence_score"]).alias("low"), i.alias("at"), e.alias("e")))
    ordered = F.array_sort(F.transform(placed, lambda p: F.struct(p["target"].alias("t"), p["low"].alias("l"), p["at"].alias("i"), p["e"].alias("e"))))
    none = F.array().cast(f"array<{TYPE}>")
    return F.aggregate(ordered, none, lambda kept, p: F.when(F.get(F.reverse(kept), F.lit(0))["target"] == p["t"], kept).otherwise(F.concat(kept, F.array(p["e"]))))


def best_rows(facts, *keys, score="confidence_score", order="arrival"):
    """The same over rows of single facts: one row for each of the keys, whose partial results are combined before they are shuffled."""
    rest = [c for c in facts.columns if c not in keys]
    first = F.max_by(F.struct(*rest), F.struct(F.col(score), (-F.col(order)).alias("earlier")))
    return facts.groupBy(*keys).agg(first.alias("_best")).select(*keys, "_best.*")


def requested(rows, required, optional=(), unsupported=(), floors=None, plan_only=False):
    """Add `results`, `unresolved_targets`, `diagnostics` and `status` for the required and optional targets.

    required, optional: array columns or lists of targets. A target without a fact is
    `unsupported` if no path gives it at the level, `planned` if only the plan is asked
    for, else `unknown`. Optional targets never change the status. floors: the least
    confidence by target, `high` for others. An error row has status `error`.
    """
    listed = lambda x: F.array(*map(F.lit, x)).cast("array<string>") if isinstance(x, list | tuple | set) else x
    need, extra, never = listed(required), listed(optional), listed(unsupported)
    need, extra = (F.when(F.col("error_code").isNull(), x).otherwise(F.array().cast("array<string>")) for x in (need, extra))
    rows = pinned(rows, _need=need, _never=never, _asked=F.array_sort(F.array_union(need, extra)))
    need, never, asked = F.col("_need"), F.col("_never"), F.col("_asked")
    found = F.filter("evidence", lambda e: F.array_contains(asked, e["target"]))
    status = F.lit("planned") if plan_only else None
    source = F.lit("plan-only" if plan_only else "planner")

    def result(t):
        own = F.get(F.filter("_found", lambda e: e["target"] == t), F.lit(0))
        state = status if plan_only else F.when(F.array_contains(never, t), "unsupported").otherwise("unknown")
        return F.coalesce(own, F.struct(t, state, F.lit(None).cast("string"), F.lit("none"), F.lit(0.0), source, F.lit("none")).cast(TYPE))

    floor = F.create_map(*(F.lit(x) for kv in {"": SCORES["high"], **{t: SCORES[c] for t, c in (floors or {}).items()}}.items() for x in kv))
    rows = pinned(rows, _found=F.lit(None).cast(f"array<{TYPE}>") if plan_only else best(found))
    rows = pinned(rows, results=F.transform(asked, result))
    valued = lambda e: e["status"].isin("resolved", "estimated")
    low = lambda e: e["confidence_score"] < F.coalesce(floor[e["target"]], F.lit(SCORES["high"]))
    mine = F.filter("results", lambda e: F.array_contains(need, e["target"]))
    missed = F.filter(mine, lambda e: (~valued(e) | low(e)) & ~F.array_contains(never, e["target"])) if not plan_only else F.filter(mine, lambda e: F.lit(False))
    refused = F.array_intersect(never, need)
    warn = lambda code, text: F.struct(F.lit("warning").alias("level"), F.lit(code).alias("code"), text.alias("message")) if isinstance(code, str) else F.struct(F.lit("warning").alias("level"), code.alias("code"), text.alias("message"))
    first = F.transform(refused, lambda t: warn("UNSUPPORTED_TARGET_AT_REQUESTED_LEVEL", F.concat(F.lit("no path satisfies "), t, F.lit(" at requested level/confidence"))))
    wanted = F.create_map(*(F.lit(x) for kv in {"": "high", **(floors or {})}.items() for x in kv))
    rest = F.transform(
        missed,
        lambda e: warn(
            F.when(valued(e), "INSUFFICIENT_CONFIDENCE").otherwise("UNRESOLVED_TARGET"),
            F.when(valued(e), F.lower(F.concat(e["target"], F.lit(" resolved at "), e["confidence"], F.lit(", below requested "), F.coalesce(wanted[e["target"]], F.lit("high"))))).otherwise(F.concat(e["target"], F.lit(" could not be resolved from this document"))),
        ),
    )
    rows = rows.withColumns({"unresolved_targets": F.array_sort(F.array_distinct(F.concat(refused, F.transform(missed, lambda e: e["target"])))), "diagnostics": F.concat(first, rest)})
    rows = rows.drop("_need", "_never", "_asked", "_found")
    return rows.withColumn("status", F.when(F.col("error_code").isNotNull(), "error").when(F.size("unresolved_targets") > 0, "partial").otherwise("ok"))


def evidence_rows(rows, *keys):
    """The long view: a row for each document and target of `results`."""
    return rows.select(*keys, F.explode("results").alias("r")).select(*keys, "r.*")


def _quoted(c):
    whole = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.isNull(), "null").otherwise(F.substr(whole, F.lit(2), F.length(whole) - 2))


def _object(*pairs):
    """JSON text of an object of (name, JSON text column) pairs."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), c) for k, c in pairs)), F.lit("}"))


def _envelope():
    code, message = F.col("error_code"), F.col("error_message")
    error = _object(("code", _quoted(code)), ("message", _quoted(message)), ("exit_code", F.col("exit_code").cast("string")))
    return _object(("schema_version", F.lit(f'"{SCHEMA_VERSION}"')), ("tool_version", F.lit(f'"{TOOL_VERSION}"')), ("status", F.lit('"error"')), ("error", error))


def _head(view=None):
    source = _object(("name", _quoted(F.col("display_name"))), ("size", F.coalesce(F.col("file_size").cast("string"), F.lit("null"))))
    shown = [("view", F.lit(f'"{view}"'))] if view else []
    return [("schema_version", F.lit(f'"{SCHEMA_VERSION}"')), ("tool_version", F.lit(f'"{TOOL_VERSION}"')), ("status", _quoted(F.col("status"))), *shown, ("input", source), ("driver", _quoted(F.col("driver")))]


def full_json():
    """The full report as JSON text, or the error envelope."""
    entry = lambda e: F.concat(
        _quoted(e["target"]), F.lit(':{"target":'), _quoted(e["target"]), F.lit(',"status":'), _quoted(e["status"]), F.coalesce(F.concat(F.lit(',"value":'), e["value"]), F.lit("")),
        F.lit(',"confidence":'), _quoted(e["confidence"]), F.lit(',"confidence_score":'), e["confidence_score"].cast("string"), F.lit(',"path":'), _quoted(e["path"]), F.lit(',"source":'), _quoted(e["source"]), F.lit("}"),
    )
    results = F.concat(F.lit("{"), F.array_join(F.transform("results", entry), ","), F.lit("}"))
    whole = _object(*_head(), ("results", results), ("unresolved_targets", F.to_json("unresolved_targets")), ("diagnostics", F.to_json("diagnostics")))
    return F.when(F.col("error_code").isNotNull(), _envelope()).otherwise(whole)


def values_json():
    """The values alone, targets without one left out, or the error envelope."""
    with_value = F.filter("results", lambda e: e["value"].isNotNull())
    values = F.concat(F.lit("{"), F.array_join(F.transform(with_value, lambda e: F.concat(_quoted(e["target"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    whole = _object(*_head("values"), ("values", values), ("unresolved_targets", F.to_json("unresolved_targets")), ("diagnostics", F.to_json("diagnostics")))
    return F.when(F.col("error_code").isNotNull(), _envelope()).otherwise(whole)


def lines(rows, view="full", order="line_no"):
    """One compact JSON line a record, errors in their place."""
    return rows.select(order, (values_json() if view == "values" else full_json()).alias("value"))


def exit_status(rows, *keys, strict=False):
    """The greatest exit code over all records, or over those of equal keys; partial reports count 5 if strict."""
    partial = F.when(F.col("status") == "partial", 5).otherwise(0) if strict else F.lit(0)
    return rows.groupBy(*keys).agg(F.coalesce(F.max(F.greatest(F.col("exit_code"), partial)), F.lit(0)).alias("exit_code"))


def typed(rows, profile_targets, *keys):
    """The wide view: a column for each of {target: type}, null where there is no value; JSON text for objects."""
    kinds = {"u64": "decimal(20,0)", "bool": "boolean", "string[]": "array<string>", "array<string>": "array<string>"}
    def column(target, kind):
        value = F.get(F.filter("results", lambda e: e["target"] == target), F.lit(0))["value"]
        plain = kind.removesuffix("|null")
        value = F.when(value != "null", value)
        if plain == "string":
            value = F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0))
        elif plain.startswith(("string[", "array<string")):
            value = F.from_json(value, "array<string>")
        elif plain in kinds:
            value = value.cast(kinds[plain])
        return value.alias(target.replace(".", "_"))
    return rows.select(*keys, *(column(t, k) for t, k in profile_targets.items()))
