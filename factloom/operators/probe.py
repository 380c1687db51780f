"""From inputs to reports: route, decode, derive, report. A row in is a row out."""

from pyspark.sql import functions as F

from factloom import catalog
from factloom.functions.evidence import pinned
from factloom.operators.facts import facts, found_by, heads, needed
from factloom.operators.pdf_graph import with_graph
from factloom.operators.report import requested
from factloom.operators.routing import exit_code, mapped, route
from factloom.sources.packages import decoded, with_signatures


def with_facts(inputs, forced=None, max_entries=50_000, max_bytes=256 << 20, drivers=None, targets=None, paths=None, max_read=None):
    """Inputs routed and decoded in one pass over their content, with `evidence` and the errors of all steps.

    Inputs with a `path` and no content are read from their files by ranges: eight bytes to
    route them, then what the facts of these targets and paths need.
    """
    signed = with_signatures(inputs) if "path" in inputs.columns else inputs
    routed = heads(route(signed, forced))
    return facts(decoded(routed, max_entries, max_bytes, max_read, needed(drivers, targets, paths)), drivers, targets, paths)


def not_taken(driver, target, request):
    """Whether a target has paths, but none is taken with the confidence that it asks for."""
    own = [p for t, p in found_by(driver) if t == target]
    floor = catalog.SCORES[request["floors"][target]]
    return bool(own) and not any(p in request["paths"] and catalog.SCORES[catalog.PATHS[p][1]] >= floor for p in own)


def probe(inputs, wanted=("@default",), optional=(), level="metadata", overrides=None, forced=None, plan_only=False, options=(), max_read=None, max_bytes=None, max_entries=None, confidence="high", graph_by=(), graph=None):
    """Reports of the targets that are asked for, which depend on each row's profile.

    Only paths of the level or below it, with the least confidence that a target asks for,
    are taken; format options rule out others. graph_by: key columns of the documents, by
    which the facts of PDF objects are joined; without them these are unknown; graph: rows of
    `graph_facts` of the inputs, if they are at hand. A profile that does not know what is asked
    for, or an option, gives its rows the request's error. Bounds are the level's own
    unless they are given.
    """
    asked, errors = {}, {}
    level = catalog.LEVEL_NAMES[level]
    for profile, driver in catalog.DRIVER_OF.items():
        try:
            asked[profile] = catalog.request(profile, wanted, optional, level, confidence, overrides)
            asked[profile]["paths"] = catalog.taken(found_by(driver), asked[profile]["required"], asked[profile]["floors"], level, options, driver)
            asked[profile]["never"] = sorted(t for t in asked[profile]["required"] if t not in catalog.applicable(profile, level) or not_taken(driver, t, asked[profile]))
        except catalog.RequestError as e:
            asked.pop(profile, None)
            errors[profile] = e
    paths = {d: set().union(*(asked[p]["paths"] for p in ps if p in asked)) for d, ps in catalog.DRIVERS.items()}
    read, expanded, entries = catalog.BOUNDS[level]
    bounds = {"max_read": max_read or read, "max_bytes": max_bytes or expanded, "max_entries": max_entries or entries}
    # drivers that know nothing of what is asked for need no facts
    drivers = [d for d, ps in catalog.DRIVERS.items() if any(p in asked for p in ps)]
    rows = with_facts(inputs, forced, drivers=drivers, targets={t for a in asked.values() for t in (*a["required"], *a["optional"])}, paths=paths, **bounds)
    if graph_by and "pdf" in drivers:
        rows = with_graph(rows, inputs, *graph_by, level=level, graph=graph)
    none = F.array().cast("array<string>")
    listed = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    by = lambda key: F.coalesce(F.create_map(*(x for p in asked for x in (F.lit(p), listed(asked[p][key]))))[F.col("profile")], none) if asked else none
    if errors:
        failed = F.col("error_code").isNull()
        pick = lambda f: F.when(failed, mapped(F.col("profile"), {p: f(e) for p, e in errors.items()}))
        rows = pinned(rows, _code=F.coalesce(pick(lambda e: e.code), F.col("error_code")), _said=F.coalesce(pick(str), F.col("error_message")))
        rows = rows.withColumns({"error_code": F.col("_code"), "error_message": F.col("_said"), "exit_code": exit_code(F.col("_code"))}).drop("_code", "_said")
    floors = {t: c for a in asked.values() for t, c in a["floors"].items()}
    return requested(rows, by("required"), by("optional"), by("never"), floors if overrides or confidence != "high" else None, plan_only)
