"""Routing of document inputs by suffix and container signature; bad input becomes an error, never an exception."""

from pyspark.sql import functions as F

from factloom.catalog import DISCOVERY, DRIVER_OF, DRIVERS, EXIT_CODES, FAMILIES, FORMATS, LEGACY_PROFILE, MIME, PREFIXES, RequestError
from factloom.functions.evidence import pinned

# Suffixes by kind of container. Fixed values of the formats.
LEGACY = list(LEGACY_PROFILE)
OPC = [p for d in ("word", "excel", "powerpoint") for p in DRIVERS[d]]
IWORK = ["key", "numbers", "pages"]
ROUTED = ["extension", "container", "family", "driver", "profile", "mime_type", "format", "error_code", "error_message", "exit_code"]


def extension(name):
    """The lower-cased last suffix of a name, slashes at its end aside; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)/*$", 1))


def container(head):
    """pdf, zip, cfb or other, from the first eight bytes given as upper-case hex."""
    return (
        F.when(head.startswith("255044462D"), "pdf")
        .when(F.substring(head, 1, 8).isin("504B0304", "504B0506", "504B0708"), "zip")
        .when(head == "D0CF11E0A1B11AE1", "cfb")
        .otherwise("other")
    )


def mapped(c, pairs):
    """The value of a dict for a column, null for others; the column's expression stands in it once."""
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[c]


def route(inputs, forced=None):
    """Add extension, container, family, driver, profile, mime_type, format, error_code, error_message and exit_code to rows of display_name and content.

    A null name has no suffix and null content no signature; no row is dropped. An
    error that a row already has stays. `forced` is a driver, profile or family that
    the rows must have. Columns of these names are replaced, all others pass through.
    """
    rows = pinned(inputs.drop(*(set(ROUTED) - {"error_code", "error_message"})), _ext=extension(F.coalesce("display_name", F.lit(""))), _box=container(F.hex(F.substring(F.coalesce("content", F.lit(b"")), 1, 8))))
    ext, box = F.col("_ext"), F.col("_box")
    rows = pinned(rows, _kind=mapped(ext, {"pdf": "pdf"} | dict.fromkeys(LEGACY, "legacy") | dict.fromkeys(OPC, "ooxml") | dict.fromkeys(IWORK, "iwork")))
    kind = F.col("_kind")
    family = (
        F.when((kind == "pdf") & (box == "pdf"), "pdf")
        .when((kind == "legacy") & (box == "cfb"), "legacy")
        .when((kind == "ooxml") & (box == "cfb"), "encrypted-ooxml")
        .when(kind.isin("ooxml", "iwork") & (box == "zip"), kind)
    )
    rows = pinned(rows, _family=family)
    family = F.col("_family")
    rows = pinned(rows, _profile=F.when(family == "encrypted-ooxml", family).when(family == "legacy", mapped(ext, LEGACY_PROFILE)).when(family.isNotNull(), ext))
    rows = pinned(rows, _driver=mapped(F.col("_profile"), DRIVER_OF))
    profile, driver = F.col("_profile"), F.col("_driver")
    holds = F.coalesce(mapped(kind, {"pdf": "PDF", "legacy": "CFB/OLE", "iwork": "ZIP/IWA"}), F.lit("ZIP/OPC or encrypted CFB"))
    code = F.when(kind.isNull(), "UNSUPPORTED_FORMAT").when(family.isNull(), "MALFORMED_INPUT")
    said = (
        F.when(kind.isNull() & (ext == ""), "input filename has no extension")
        .when(kind.isNull(), F.concat(F.lit("."), ext))
        .when(family.isNull(), F.concat(F.lit("."), ext, F.lit(" input does not contain the expected "), holds, F.lit(" container")))
    )
    form = F.when(profile == "encrypted-ooxml", "office-open-xml").otherwise(mapped(driver, FORMATS))
    if forced is not None:
        wanted = forced.lower()
        fits = (driver == wanted) | (profile == wanted) | (form == wanted) | F.lit(wanted == "legacy") & (driver == "office-legacy") | F.lit(wanted == "iwork") & (family == "iwork")
        code = F.coalesce(code, F.when(~fits, "INVALID_REQUEST"))
        said = F.coalesce(said, F.when(~fits, F.concat(F.lit(f"input format {wanted} does not match detected "), profile)))
    if "error_code" in inputs.columns:
        had = F.col("error_code").isNotNull()
        rows = pinned(rows, _code=F.when(had, F.col("error_code")).otherwise(code), _said=F.when(had, F.col("error_message")), _had=had)
    else:
        rows = pinned(rows, _code=code, _said=F.lit(None).cast("string"), _had=F.lit(False))
    code = F.col("_code")
    made = {
        "extension": ext, "container": box, "family": F.when(~F.col("_had"), family), "driver": driver, "profile": profile, "mime_type": mapped(profile, MIME), "format": form,
        "error_code": code, "error_message": F.coalesce("_said", F.concat(prefix(code), said)), "exit_code": exit_code(code),
    }
    return rows.withColumns(made).drop("_ext", "_box", "_kind", "_family", "_profile", "_driver", "_code", "_said", "_had")


def prefix(code):
    return mapped(code, PREFIXES)


def exit_code(code):
    """0 without an error, else the code's number."""
    return F.coalesce(mapped(code, EXIT_CODES), F.lit(0))


def driver_for(name):
    """The driver that discovery knows by a name."""
    profile = DISCOVERY.get(name.lower(), name.lower())
    if profile not in DRIVER_OF or profile == "encrypted-ooxml":
        raise RequestError("UNSUPPORTED_FORMAT", name)
    return DRIVER_OF[profile], profile


def family_of(driver):
    return mapped(driver, FAMILIES)
