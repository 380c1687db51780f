"""Drivers of your own: suffixes and facts as SQL expressions, for reports and for SQL.

A fact is an expression over `display_name` and `content`, so it runs in the JVM like the
library's own. `published` makes the registered drivers a table function of the session:

    select d.id, f.target, f.value from docs d, lateral document_facts(d.display_name, d.content) f
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from factloom.catalog import DRIVER_OF, LEVELS, SCORES
from factloom.functions.evidence import TYPE
from factloom.operators.routing import exit_code, prefix

COLUMNS = "target STRING, status STRING, value STRING, confidence STRING, confidence_score DOUBLE, path STRING, source STRING"


@dataclass(frozen=True)
class OwnFact:
    """A target, the expression of its value, the level and confidence at which it answers, and what it is drawn from."""

    target: str
    expression: str
    level: str = "metadata"
    confidence: str = "exact"
    source: str = "registered expression"


@dataclass(frozen=True)
class OwnDriver:
    """An id, the suffixes that it takes, the media type, and facts whose targets begin with the id."""

    id: str
    suffixes: tuple
    mime_type: str
    facts: tuple


@dataclass
class Registry:
    """Registered drivers; no two take one suffix, none takes a suffix of the library's."""

    drivers: dict = field(default_factory=dict)

    def register(self, driver):
        """Add a driver; ValueError says what does not fit."""
        taken = {s for d in self.drivers.values() for s in d.suffixes} | set(DRIVER_OF) | {"dot", "xlt", "pps", "pot"}
        if driver.id in self.drivers or not re.fullmatch("[a-z][a-z0-9-]*", driver.id):
            raise ValueError(f"driver id {driver.id} is taken or not a name")
        if wrong := sorted(s for s in driver.suffixes if s in taken or not re.fullmatch("[a-z0-9]+", s)):
            raise ValueError(f"suffixes are taken or no suffixes: {', '.join(wrong)}")
        names = [f.target for f in driver.facts]
        if wrong := sorted(t for t in names if names.count(t) > 1 or not re.fullmatch(rf"{driver.id}\.[a-z0-9_]+", t)):
            raise ValueError(f"targets are named twice or not after the driver: {', '.join(wrong)}")
        if wrong := sorted(f.target for f in driver.facts if f.level not in LEVELS or f.confidence not in SCORES):
            raise ValueError(f"targets without a known level or confidence: {', '.join(wrong)}")
        self.drivers[driver.id] = driver
        return driver

    def taken(self, driver, level):
        return [f for f in driver.facts if LEVELS.index(f.level) <= LEVELS.index(level)]

    def _sql(self, level):
        """SQL of the array of facts of `display_name` and `content`; empty for other suffixes."""
        text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        suffix = r"lower(regexp_extract(display_name, '\\.([^./]+)$', 1))"
        cases = []
        for d in self.drivers.values():
            made = [f"named_struct('f', {text(f.target)}, 'v', regexp_replace(to_json(array({f.expression})), '^\\\\[|\\\\]$', ''), 'c', {text(f.confidence)}, 's', {SCORES[f.confidence]}D, 'p', {text(f'{d.id}.{f.level}')}, 'o', {text(f.source)})" for f in self.taken(d, level)]
            if made:
                cases.append(f"when {suffix} in ({', '.join(map(text, d.suffixes))}) then array({', '.join(made)})")
        none = "cast(array() as array<struct<f:string,v:string,c:string,s:double,p:string,o:string>>)"
        found = f"case {' '.join(cases)} else {none} end" if cases else none
        known = "x.v is not null and x.v not in ('', 'null')"
        sure = f"if(x.s >= {SCORES['high']}D, 'resolved', 'estimated')"
        one = f"struct(x.f, if({known}, {sure}, 'unknown'), if({known}, x.v, null), if({known}, x.c, 'none'), if({known}, x.s, 0D), x.p, if({known}, x.o, 'none'))"
        return f"cast(transform({found}, x -> {one}) as array<{TYPE}>)"

    def with_facts(self, inputs, level="metadata"):
        """Inputs with driver, profile, mime_type and `evidence` of registered drivers; other suffixes are UNSUPPORTED_FORMAT, earlier errors stay."""
        suffix = F.lower(F.regexp_extract("display_name", r"\.([^./]+)$", 1))
        by = {s: d for d in self.drivers.values() for s in d.suffixes}
        of = lambda get: F.coalesce(*(F.when(suffix == s, get(d)) for s, d in by.items()), F.lit(None).cast("string"))
        unknown = F.when(of(lambda d: d.id).isNull(), "UNSUPPORTED_FORMAT")
        rows = inputs
        for c in ("error_code", "error_message"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
        said = F.coalesce("error_message", F.concat(prefix(unknown), F.lit("no registered driver takes "), suffix))
        rows = rows.withColumns({"driver": of(lambda d: d.id), "profile": F.when(unknown.isNull(), suffix), "mime_type": of(lambda d: d.mime_type), "error_message": said, "error_code": F.coalesce("error_code", unknown), "evidence": F.expr(self._sql(level))})
        return rows.withColumns({"evidence": F.when(F.col("error_code").isNull(), F.col("evidence")).otherwise(F.array().cast(f"array<{TYPE}>")), "exit_code": exit_code(F.col("error_code"))})

    def published(self, spark, name="document_facts", level="metadata"):
        """Make or replace the session's table function `name`(display_name, content), a row a fact."""
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(display_name STRING, content BINARY) RETURNS TABLE ({COLUMNS}) RETURN SELECT inline({self._sql(level)})")
        return name
