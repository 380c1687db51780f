"""What is known of formats and facts: profiles, targets with their levels, selectors. Small tables, made on the driver."""

from functools import cache

LEVELS = ("header", "metadata", "deep")
SCORES = {"none": 0.0, "low": 0.4, "medium": 0.7, "high": 0.95, "exact": 1.0}
LEVEL_NAMES = {"h": "header", "l0": "header", "0": "header", "m": "metadata", "l1": "metadata", "1": "metadata", "d": "deep", "l2": "deep", "2": "deep"} | {x: x for x in LEVELS}
CONFIDENCE_NAMES = {"l": "low", "m": "medium", "h": "high", "x": "exact"} | {x: x for x in SCORES}
EXIT_CODES = {"INVALID_REQUEST": 1, "UNSUPPORTED_TARGET": 1, "SOURCE_IO": 2, "UNSUPPORTED_FORMAT": 3, "MALFORMED_INPUT": 4, "BUDGET_EXCEEDED": 4, "PARSER_FAILURE": 6}
PREFIXES = {"INVALID_REQUEST": "invalid request: ", "UNSUPPORTED_TARGET": "unsupported target: ", "SOURCE_IO": "source I/O error: ", "UNSUPPORTED_FORMAT": "unsupported format: ", "MALFORMED_INPUT": "malformed input: ", "BUDGET_EXCEEDED": "budget exceeded: ", "PARSER_FAILURE": "format parser failed: "}

# Media types by suffix. Fixed values of the formats.
_X, _M = "application/vnd.openxmlformats-officedocument.", "application/vnd.ms-"
MIME = {
    "pdf": "application/pdf",
    "docx": _X + "wordprocessingml.document", "docm": _M + "word.document.macroenabled.12", "dotx": _X + "wordprocessingml.template", "dotm": _M + "word.template.macroenabled.12",
    "xlsx": _X + "spreadsheetml.sheet", "xlsm": _M + "excel.sheet.macroenabled.12", "xltx": _X + "spreadsheetml.template", "xltm": _M + "excel.template.macroenabled.12", "xlsb": _M + "excel.sheet.binary.macroenabled.12",
    "pptx": _X + "presentationml.presentation", "pptm": _M + "powerpoint.presentation.macroenabled.12", "ppsx": _X + "presentationml.slideshow", "ppsm": _M + "powerpoint.slideshow.macroenabled.12", "potx": _X + "presentationml.template", "potm": _M + "powerpoint.template.macroenabled.12",
    "key": "application/x-iwork-keynote-sffkey", "numbers": "application/x-iwork-numbers-sffnumbers", "pages": "application/x-iwork-pages-sffpages",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint", "encrypted-ooxml": "application/x-ole-storage",
}
DRIVERS = {
    "pdf": ["pdf"], "word": ["docx", "docm", "dotx", "dotm"], "excel": ["xlsx", "xlsm", "xltx", "xltm", "xlsb"], "powerpoint": ["pptx", "pptm", "ppsx", "ppsm", "potx", "potm"],
    "keynote": ["key"], "numbers": ["numbers"], "pages": ["pages"], "office-legacy": ["doc", "xls", "ppt", "encrypted-ooxml"],
}
SUPPORT = {"excel": "2.0; xlsb identity only", "keynote": "2.0; modern IWA only", "numbers": "2.0; modern IWA only", "pages": "2.0; modern IWA only", "office-legacy": "metadata and format statistics"}
FORMATS = {"pdf": "pdf", "word": "office-open-xml", "excel": "office-open-xml", "powerpoint": "office-open-xml", "keynote": "apple-iwork", "numbers": "apple-iwork", "pages": "apple-iwork", "office-legacy": "office-legacy"}
FAMILIES = {"pdf": "pdf", "word": "ooxml", "excel": "ooxml", "powerpoint": "ooxml", "keynote": "iwork", "numbers": "iwork", "pages": "iwork", "office-legacy": "legacy"}
LEGACY_PROFILE = {"doc": "doc", "dot": "doc", "xls": "xls", "xlt": "xls", "ppt": "ppt", "pps": "ppt", "pot": "ppt"}
DRIVER_OF = {p: d for d, ps in DRIVERS.items() for p in ps}
#: Names by which discovery finds a profile, besides the profiles' own.
DISCOVERY = {"word": "docx", "excel": "xlsx", "powerpoint": "pptx", "keynote": "key", "legacy": "ppt"}
APPLICATIONS = {"key": "Apple Keynote", "numbers": "Apple Numbers", "pages": "Apple Pages"}

# Targets: name, type, least level. Fixed values.
COMMON = [
    ("document.format", "string", "header"),
    ("document.format_profile", "string", "header"),
    ("document.mime_type", "string", "header"),
    ("document.file_size", "u64", "header"),
    ("document.extension", "string", "header"),
    ("document.extension_matches", "bool", "header"),
    ("document.title", "string|null", "metadata"),
    ("document.subject", "string|null", "metadata"),
    ("document.author", "string|null", "metadata"),
    ("document.keywords", "string|null", "metadata"),
    ("document.description", "string|null", "metadata"),
    ("document.created_at", "string|null", "metadata"),
    ("document.modified_at", "string|null", "metadata"),
    ("document.application", "string|null", "metadata"),
    ("document.application_version", "string|null", "metadata"),
    ("document.language", "string|null", "metadata"),
    ("document.locale", "string|null", "metadata"),
    ("security.encrypted", "bool", "header"),
    ("security.has_macros", "bool", "metadata"),
    ("security.password_protected", "bool|null", "metadata"),
    ("security.has_digital_signature", "bool", "metadata"),
    ("security.signature_count", "u64|null", "deep"),
    ("security.has_javascript", "bool", "deep"),
    ("security.has_external_relationships", "bool", "metadata"),
    ("security.has_embedded_files", "bool", "metadata"),
    ("security.active_content_risk", "string|null", "deep"),
    ("quality.corrupted", "bool|null", "deep"),
    ("quality.missing_assets", "bool|null", "deep"),
]
OFFICE = [
    ("office.document_kind", "string", "header"),
    ("office.package_entry_count", "u64", "metadata"),
    ("office.conformance", "string", "metadata"),
]
IWORK_SHARED = [
    ("iwork.document_kind", "string", "header"),
    ("iwork.file_format_version", "string|null", "metadata"),
    ("iwork.producer_build", "string|null", "metadata"),
    ("iwork.package_entry_count", "u64", "metadata"),
    ("iwork.iwa_entry_count", "u64", "metadata"),
    ("iwork.data_asset_count", "u64", "metadata"),
    ("iwork.data_asset_bytes", "u64", "metadata"),
    ("iwork.asset_type_counts", "object", "metadata"),
    ("iwork.has_preview", "bool", "metadata"),
    ("iwork.preview_count", "u64", "metadata"),
    ("iwork.preview_dimensions", "object", "metadata"),
    ("iwork.is_multi_page", "bool|null", "metadata"),
    ("iwork.has_external_or_missing_data", "bool|null", "metadata"),
    ("iwork.all_iwa_valid", "bool", "deep"),
    ("iwork.archive_object_count", "u64", "deep"),
    ("iwork.message_type_counts", "object", "deep"),
    ("iwork.object_type_counts", "object", "deep"),
]
# The same by driver. Fixed values.
OWN = {
    "word": [
        ("word.page_count", "u64|null", "metadata"),
        ("word.word_count", "u64|null", "metadata"),
        ("word.character_count", "u64|null", "metadata"),
        ("word.paragraph_count", "u64|null", "metadata"),
        ("word.table_count", "u64|null", "deep"),
        ("word.is_template", "bool", "metadata"),
        ("word.unique_image_asset_count", "u64", "metadata"),
        ("word.comment_part_count", "u64", "metadata"),
    ],
    "excel": [
        ("excel.sheet_count", "u64|null", "metadata"),
        ("excel.sheet_names", "string[]|null", "metadata"),
        ("excel.hidden_sheet_count", "u64|null", "metadata"),
        ("excel.defined_name_count", "u64|null", "metadata"),
        ("excel.shared_string_count", "u64|null", "deep"),
        ("excel.table_count", "u64|null", "metadata"),
        ("excel.is_template", "bool", "metadata"),
        ("excel.binary_workbook", "bool", "metadata"),
        ("excel.chart_part_count", "u64", "metadata"),
        ("excel.pivot_table_part_count", "u64", "metadata"),
        ("excel.unique_image_asset_count", "u64", "metadata"),
    ],
    "powerpoint": [
        ("powerpoint.slide_count", "u64|null", "metadata"),
        ("powerpoint.hidden_slide_count", "u64|null", "metadata"),
        ("powerpoint.master_count", "u64|null", "metadata"),
        ("powerpoint.layout_count", "u64|null", "metadata"),
        ("powerpoint.notes_slide_count", "u64|null", "metadata"),
        ("powerpoint.slide_size", "object|null", "metadata"),
        ("powerpoint.aspect_ratio", "object|null", "metadata"),
        ("powerpoint.orientation", "string|null", "metadata"),
        ("powerpoint.presentation_kind", "string", "metadata"),
        ("powerpoint.chart_part_count", "u64", "metadata"),
        ("powerpoint.unique_image_asset_count", "u64", "metadata"),
        ("powerpoint.unique_media_asset_count", "u64", "metadata"),
        ("powerpoint.comment_part_count", "u64", "metadata"),
    ],
    "pdf": [
        ("pdf.version", "string", "header"),
        ("pdf.linearized", "bool", "header"),
        ("pdf.page_count", "u64|null", "metadata"),
        ("pdf.object_count", "u64|null", "metadata"),
        ("pdf.xref_type", "string", "metadata"),
        ("pdf.repaired", "bool", "metadata"),
        ("pdf.annotation_count", "u64|null", "metadata"),
        ("pdf.form_field_count", "u64|null", "metadata"),
        ("pdf.attachment_count", "u64|null", "metadata"),
        ("pdf.has_xmp", "bool", "metadata"),
    ],
    "keynote": [
        ("keynote.slide_count", "u64", "metadata"),
        ("keynote.master_slide_count", "u64", "metadata"),
        ("keynote.table_component_count", "u64", "metadata"),
        ("keynote.slide_size", "object|null", "deep"),
        ("keynote.aspect_ratio", "object|null", "deep"),
        ("keynote.orientation", "string|null", "deep"),
        ("keynote.hidden_slide_count", "u64", "deep"),
        ("keynote.slides_with_notes_count", "u64", "deep"),
        ("keynote.slides_with_builds_count", "u64", "deep"),
        ("keynote.slides_with_transitions_count", "u64", "deep"),
        ("keynote.table_count", "u64", "deep"),
    ],
    "numbers": [
        ("numbers.sheet_count", "u64|null", "metadata"),
        ("numbers.sheet_names", "array<string>|null", "metadata"),
        ("numbers.table_component_count", "u64", "metadata"),
        ("numbers.table_count", "u64", "deep"),
        ("numbers.table_dimensions", "array<object>", "deep"),
        ("numbers.hidden_row_count", "u64", "deep"),
        ("numbers.hidden_column_count", "u64", "deep"),
        ("numbers.filtered_row_count", "u64", "deep"),
        ("numbers.formula_definition_count", "u64", "deep"),
    ],
    "pages": [
        ("pages.table_component_count", "u64", "metadata"),
        ("pages.section_count", "u64", "deep"),
        ("pages.section_names", "array<string>", "deep"),
        ("pages.page_size", "object|null", "deep"),
        ("pages.aspect_ratio", "object|null", "deep"),
        ("pages.orientation", "string|null", "deep"),
        ("pages.change_tracking_enabled", "bool", "deep"),
        ("pages.body_text_length", "u64|null", "deep"),
        ("pages.body_paragraph_break_count", "u64|null", "deep"),
        ("pages.cached_page_count", "u64|null", "deep"),
        ("pages.table_count", "u64", "deep"),
    ],
}
# The same of legacy documents, and by their profile. Fixed values.
LEGACY = [
    ("office.document_kind", "string", "header"),
    ("office.legacy_kind", "string", "header"),
    ("office.cfb_container", "bool", "header"),
    ("office.cfb_entry_count", "u64", "metadata"),
    ("office.content_probe_supported", "bool", "header"),
]
LEGACY_OWN = {
    "doc": [
        ("word.page_count", "u64|null", "metadata"),
        ("word.word_count", "u64|null", "metadata"),
        ("word.character_count", "u64|null", "metadata"),
        ("word.paragraph_count", "u64|null", "metadata"),
        ("word.is_template", "bool", "metadata"),
    ],
    "xls": [
        ("excel.sheet_count", "u64|null", "metadata"),
        ("excel.sheet_names", "string[]|null", "metadata"),
        ("excel.is_template", "bool", "metadata"),
        ("excel.binary_workbook", "bool", "metadata"),
    ],
    "ppt": [
        ("powerpoint.slide_count", "u64|null", "metadata"),
        ("powerpoint.notes_slide_count", "u64|null", "metadata"),
        ("powerpoint.presentation_kind", "string", "metadata"),
    ],
}
#: Common targets that no path of a family gives. Fixed values.
NEVER = {
    "ooxml": [
        "document.language",
        "document.locale",
        "quality.corrupted",
        "quality.missing_assets",
    ],
    "pdf": [
        "document.language",
        "document.locale",
        "quality.corrupted",
        "quality.missing_assets",
    ],
    "iwork": [
        "document.title",
        "document.subject",
        "document.author",
        "document.keywords",
        "document.description",
        "document.created_at",
        "document.modified_at",
        "security.has_digital_signature",
        "security.signature_count",
        "security.has_javascript",
        "security.has_external_relationships",
        "security.has_embedded_files",
        "security.active_content_risk",
        "quality.missing_assets",
    ],
    "legacy": [
        "document.description",
        "document.application_version",
        "document.language",
        "document.locale",
        "security.has_digital_signature",
        "security.signature_count",
        "security.has_javascript",
        "security.has_external_relationships",
        "security.active_content_risk",
        "quality.corrupted",
        "quality.missing_assets",
    ],
}
# Marks of names, and names, that selectors go by. Fixed values.
STRUCTURE = ("_count", "_names", ".slide_size", ".page_size", ".table_dimensions", ".body_text_length", ".aspect_ratio", ".orientation", ".presentation_kind", ".is_template", ".binary_workbook", ".document_kind")
ASSETS = ("asset", "preview", "image", "media", "font", "attachment", "embedded")
QUALITY = ("document.extension_matches", "office.conformance", "pdf.repaired")
# Targets of selectors by driver. Fixed values.
SUMMARY = {
    "word": [
        "word.page_count",
        "word.word_count",
        "word.is_template",
    ],
    "excel": [
        "excel.sheet_count",
        "excel.sheet_names",
        "excel.is_template",
        "excel.binary_workbook",
    ],
    "powerpoint": [
        "powerpoint.slide_count",
        "powerpoint.slide_size",
        "powerpoint.aspect_ratio",
        "powerpoint.orientation",
        "powerpoint.presentation_kind",
    ],
    "keynote": [
        "keynote.slide_count",
        "keynote.slide_size",
        "keynote.aspect_ratio",
        "keynote.orientation",
        "keynote.hidden_slide_count",
        "iwork.has_preview",
    ],
    "numbers": [
        "numbers.sheet_count",
        "numbers.sheet_names",
        "numbers.table_count",
        "iwork.has_preview",
    ],
    "pages": [
        "pages.section_count",
        "pages.page_size",
        "pages.aspect_ratio",
        "pages.orientation",
        "pages.cached_page_count",
        "iwork.is_multi_page",
        "iwork.has_preview",
    ],
    "office-legacy": [
        "office.cfb_entry_count",
    ],
}
DEFAULTS = {
    "word": [
        "security.has_macros",
        "office.package_entry_count",
        "word.page_count",
        "word.word_count",
        "word.is_template",
    ],
    "excel": [
        "security.has_macros",
        "office.package_entry_count",
        "excel.is_template",
        "excel.binary_workbook",
        "excel.table_count",
        "excel.sheet_count",
        "excel.sheet_names",
        "excel.hidden_sheet_count",
    ],
    "powerpoint": [
        "security.has_macros",
        "office.package_entry_count",
        "powerpoint.slide_count",
        "powerpoint.hidden_slide_count",
        "powerpoint.master_count",
        "powerpoint.layout_count",
        "powerpoint.slide_size",
        "powerpoint.aspect_ratio",
        "powerpoint.orientation",
        "powerpoint.presentation_kind",
    ],
    "pdf": [
        "security.encrypted",
        "pdf.page_count",
        "pdf.object_count",
        "pdf.xref_type",
        "pdf.repaired",
    ],
    "office-legacy": [
        "security.has_macros",
        "office.cfb_entry_count",
    ],
}
DEEP_DEFAULTS = {
    "word": [
        "word.paragraph_count",
        "word.table_count",
    ],
    "excel": [
        "excel.shared_string_count",
    ],
}
IWORK_OPT_IN = [
    "security.password_protected",
    "iwork.preview_count",
    "iwork.preview_dimensions",
    "document.language",
    "document.locale",
    "iwork.producer_build",
    "iwork.has_external_or_missing_data",
    "iwork.data_asset_bytes",
    "iwork.asset_type_counts",
]
# Aliases besides the last parts of names. Fixed values.
FIXED_ALIASES = {"mime": "document.mime_type", "profile": "document.format_profile", "macros": "security.has_macros", "notes_count": "powerpoint.notes_slide_count"}


#: Paths by which facts are found: level and confidence. Fixed values.
PATHS = {
    "ooxml.identity": ("header", "exact"),
    "ooxml.core_properties": ("metadata", "high"),
    "ooxml.app_properties": ("metadata", "high"),
    "ooxml.package_inventory": ("metadata", "exact"),
    "ooxml.readability_security": ("metadata", "exact"),
    "ooxml.package_security": ("metadata", "exact"),
    "ooxml.deep_security": ("deep", "exact"),
    "word.profile": ("metadata", "exact"),
    "word.asset_inventory": ("metadata", "exact"),
    "word.app_statistics": ("metadata", "high"),
    "word.document_structure": ("deep", "exact"),
    "excel.profile": ("metadata", "exact"),
    "excel.table_inventory": ("metadata", "exact"),
    "excel.asset_inventory": ("metadata", "exact"),
    "excel.workbook_xml": ("metadata", "exact"),
    "excel.worksheet_inventory": ("metadata", "medium"),
    "excel.shared_strings": ("deep", "exact"),
    "powerpoint.profile": ("metadata", "exact"),
    "powerpoint.part_inventory": ("metadata", "exact"),
    "powerpoint.asset_inventory": ("metadata", "exact"),
    "powerpoint.app_statistics": ("metadata", "high"),
    "powerpoint.presentation_xml": ("metadata", "exact"),
    "pdf.header": ("header", "exact"),
    "pdf.document_structure": ("metadata", "exact"),
    "office_legacy.cfb_inventory": ("header", "exact"),
    "office_legacy.summary_information": ("metadata", "high"),
    "office_legacy.content_statistics": ("metadata", "exact"),
    "iwork.identity": ("header", "exact"),
    "iwork.package_metadata": ("metadata", "high"),
    "iwork.package_inventory": ("metadata", "exact"),
    "iwork.preview_metadata": ("metadata", "exact"),
    "iwork.iwa_integrity": ("deep", "exact"),
    "iwork.iwa_objects": ("deep", "exact"),
}
#: Options by driver: the values each may have, with the path that a value rules out. Fixed values.
OPTIONS = {
    "word": {"word.statistics_path": {"auto": None, "app-properties": "word.document_structure", "document-xml": "word.app_statistics"}},
    "excel": {"excel.workbook_path": {"auto": None, "xml": "excel.worksheet_inventory", "inventory": "excel.workbook_xml"}},
    "powerpoint": {"powerpoint.slide_count_path": {"auto": None, "app-properties": "powerpoint.presentation_xml", "presentation-xml": "powerpoint.app_statistics"}},
}
#: Bytes read, bytes expanded and archive entries that a request of a level may cost. Fixed values.
BOUNDS = {"header": (4 << 20, 4 << 20, 4096), "metadata": (16 << 20, 8 << 20, 10_000), "deep": (128 << 20, 256 << 20, 50_000)}


class RequestError(ValueError):
    """A request that cannot be met: `code` and the message."""

    def __init__(self, code, message):
        super().__init__(PREFIXES[code] + message)
        self.code = code


@cache
def targets(profile):
    """{target: (type, level, scope, whether a path gives it)} of a profile, in catalog order."""
    driver = DRIVER_OF[profile]
    family = FAMILIES[driver]
    if driver == "office-legacy":
        groups = [("common", COMMON), ("office", LEGACY[:1]), ("format", LEGACY[1:] + LEGACY_OWN.get(profile, []))]
    else:
        groups = [("common", COMMON), ("office", OFFICE if family == "ooxml" else []), ("format", (IWORK_SHARED if family == "iwork" else []) + OWN[driver])]
    never = set(NEVER[family])
    if profile == "xlsb":
        never |= {f"excel.{x}" for x in ("sheet_count", "sheet_names", "hidden_sheet_count", "defined_name_count", "shared_string_count")}
    found = {}
    for scope, known in groups:
        for name, kind, level in known:
            found[name] = kind, level, scope, name not in never
    return found


def applicable(profile, level):
    """Targets that some path gives at a level."""
    late = {"security.encrypted"} if profile == "pdf" and level == "header" else set()  # its path reads the whole file
    return {t for t, (_, least, _, given) in targets(profile).items() if given and LEVELS.index(least) <= LEVELS.index(level)} - late


def selector(profile, name, level):
    """The targets of `@summary`, `@security`, `@structure`, `@assets`, `@quality`, `@format`, `@all`, `@header` or `@default`."""
    can = applicable(profile, level)
    if name in ("@header", "@default"):
        return defaults(profile, "header" if name == "@header" else level)
    if name == "@summary":
        asked = ["document.title", "document.author", "document.application", "document.application_version", *SUMMARY.get(DRIVER_OF[profile], [])]
        return defaults(profile, "header") | (can & set(asked) if level != "header" else set())
    chosen = {
        "@security": lambda t: t.startswith("security."),
        "@structure": lambda t: any(m in t for m in STRUCTURE),
        "@assets": lambda t: not t.startswith("security.") and any(m in t for m in ASSETS),
        "@quality": lambda t: t.startswith("quality.") or t in QUALITY,
        "@format": lambda t: targets(profile)[t][2] == "format",
        "@all": lambda t: True,
    }.get(name)
    return chosen and set(filter(chosen, can))


def defaults(profile, level):
    """The default targets of a level."""
    driver, asked = DRIVER_OF[profile], applicable(profile, "header")
    if level == "header":
        return asked
    if FAMILIES[driver] == "iwork":
        return applicable(profile, "metadata") - set(IWORK_OPT_IN)
    more = {"document.title", "document.author", "document.application", *DEFAULTS[driver]}
    if driver == "office-legacy":
        more |= {t for t in targets(profile) if t.split(".")[0] in ("word", "excel", "powerpoint")}
    if level == "deep":
        more |= set(DEEP_DEFAULTS.get(driver, []))
    return asked | (more & applicable(profile, level))


@cache
def aliases(profile):
    """{alias: target}: last parts of names that are unique in the profile, and the fixed ones."""
    last = {}
    for t in targets(profile):
        last.setdefault(t.rpartition(".")[2], []).append(t)
    return {a: ts[0] for a, ts in last.items() if len(ts) == 1} | {a: t for a, t in FIXED_ALIASES.items() if t in targets(profile)}


def expand(profile, wanted, level="metadata"):
    """The targets that names, aliases and selectors, single or joined by commas, ask for."""
    found = set()
    for name in (n.strip() for w in wanted for n in w.split(",")):
        if not name:
            continue
        if name.startswith("@") and (chosen := selector(profile, name, level)) is not None:
            found |= chosen
        elif name in targets(profile) or name in aliases(profile):
            found.add(aliases(profile).get(name, name) if name not in targets(profile) else name)
        else:
            raise RequestError("UNSUPPORTED_TARGET", name)
    if not found:
        raise RequestError("INVALID_REQUEST", "target set is empty")
    return found


def request(profile, wanted=("@default",), optional=(), level="metadata", confidence="high", overrides=None):
    """{required, optional, floors} of a profile: optional targets less the required, least confidence by target."""
    level, confidence = LEVEL_NAMES[level], CONFIDENCE_NAMES[confidence]
    required = expand(profile, wanted, level)
    more = expand(profile, optional, level) - required if optional else set()
    floors = dict.fromkeys(required | more, confidence)
    for name, floor in (overrides or {}).items():
        target = aliases(profile).get(name, name)
        if target not in floors or CONFIDENCE_NAMES.get(floor, "none") == "none":
            raise RequestError("INVALID_REQUEST", f"confidence of {name}")
        floors[target] = CONFIDENCE_NAMES[floor]
    return {"required": sorted(required), "optional": sorted(more), "floors": floors}


def ruled_out(driver, options):
    """The paths that format options rule out; a key may leave out its driver, the last setting of an option holds."""
    known, chosen = OPTIONS.get(driver, {}), {}
    for key, value in options.items() if isinstance(options, dict) else options:
        if not key or not value:
            raise RequestError("INVALID_REQUEST", f"invalid format option: {key}={value}")
        named = [key] if "." in key else [o for o in known if o.rpartition(".")[2] == key]
        if not named:
            raise RequestError("INVALID_REQUEST", f"unknown {driver} option: {key}")
        if named[0] not in known:
            raise RequestError("INVALID_REQUEST", f"unknown {(driver or '').capitalize()} option: {named[0]}")
        if value not in known[named[0]]:
            raise RequestError("INVALID_REQUEST", f"invalid {named[0]}: {value}")
        chosen[named[0]] = value
    return {known[o][v] for o, v in chosen.items()} - {None}


def taken(found, required, floors, level, options=(), driver=None):
    """The paths that a request takes, from the (target, path) pairs of all facts.

    A path is taken if its level is within the request's, no option rules it out and it
    gives a required target with at least that target's least confidence.
    """
    out, at = ruled_out(driver, options), LEVELS.index(LEVEL_NAMES[level])
    return {p for t, p in found if t in required and p not in out and LEVELS.index(PATHS[p][0]) <= at and SCORES[PATHS[p][1]] >= SCORES[floors.get(t, "high")]}


def value_schema(kind):
    """The JSON schema of a target's type, as a dict."""
    plain, null = kind.removesuffix("|null"), kind.endswith("|null")
    of = {"string": "string", "bool": "boolean", "u64": "integer", "object": "object", "string[]": "array", "array<string>": "array", "array<object>": "array"}.get(plain)
    if of is None:
        return {}
    out = {"type": [of, "null"] if null else of}
    return out | ({"minimum": 0} if plain == "u64" else {}) | ({"items": {"type": "object" if "object" in plain else "string"}} if of == "array" else {})


def formats(spark):
    """One row a driver: driver, profiles, support."""
    return spark.createDataFrame([(d, ps, SUPPORT.get(d, "2.0")) for d, ps in DRIVERS.items()], "driver string, profiles array<string>, support string")


def discovered(spark, name="pptx"):
    """One row a target of a format: target, type, level, scope, aliases, cost class, levels at which it is applicable, selectors at the deepest."""
    profile = DISCOVERY.get(name.lower(), name.lower())
    if profile not in DRIVER_OF or profile == "encrypted-ooxml":
        raise RequestError("UNSUPPORTED_FORMAT", name)
    names = {}
    for a, t in aliases(profile).items():
        names.setdefault(t, []).append(a)
    selectors = {s: selector(profile, s, "deep") for s in ("@summary", "@security", "@structure", "@assets", "@quality", "@format", "@all", "@default")}
    cost = dict(zip(LEVELS, ("low", "moderate", "high"), strict=True))
    rows = [(profile, t, kind, level, scope, sorted(names.get(t, [])), cost[level], [x for x in LEVELS if t in applicable(profile, x)], sorted(s for s, ts in selectors.items() if t in ts)) for t, (kind, level, scope, _) in targets(profile).items()]
    return spark.createDataFrame(rows, "profile string, target string, value_type string, min_level string, scope string, aliases array<string>, cost_class string, supported_levels array<string>, selectors array<string>")
