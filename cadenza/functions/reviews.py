"""Reviews and review requests in JSON that may be broken: found in a text, mended, and brought into one shape.

Every field has a rule in a table; what is missing, of another type or out of bounds becomes the rule's default. Numbers
written as strings count; all are kept to three decimals. A text without a JSON object gives null, as do repeated keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import scalar as sc
from cadenza.functions.scalar import let as _let
from cadenza.functions.texts import SPACE, VERDICTS, clean_text, loose_number, trim

C = F.col
Rule = Callable[[Column], Column]

# Limits, names, choices, defaults and bounds of the format.
FILES, FILES_A_REQUEST = 12, 4
#: name: default, least, most.
DIRECTIVES = {
    "warmthDb": (0.0, -1.8, 1.8), "presenceDb": (0.0, -1.8, 1.8), "airDb": (0.0, -1.2, 1.2), "deHarshDb": (0.0, 0.0, 1.8), "sagRecoveryBoost": (0.0, -0.15, 0.7),
    "onsetTameBoost": (0.0, -0.15, 0.7), "breathTameBoost": (0.0, -0.15, 0.7), "denoiseBias": (0.0, -0.15, 0.7), "roomCleanupBias": (0.0, -0.15, 0.7), "compressionBias": (0.0, -0.6, 0.6),
    "finalPolishIntensity": (0.5, 0.0, 1.0), "targetLoudnessBiasDb": (0.0, -1.5, 1.5), "levelerBias": (0.0, -0.5, 0.5), "headGuardBoost": (0.0, 0.0, 1.0),
}
CORRECTIVE = {
    "cold_open_dip": {"headGuardBoost": 0.5, "targetLoudnessBiasDb": 0.35},
    "harsh_sibilance": {"deHarshDb": 0.6, "airDb": -0.25, "presenceDb": -0.15},
    "too_compressed": {"compressionBias": -0.35, "finalPolishIntensity": -0.2, "levelerBias": -0.25},
    "pause_noise_lift": {"denoiseBias": 0.3},
    "echo_roomy": {"roomCleanupBias": 0.35},
    "level_uneven": {"levelerBias": 0.35, "sagRecoveryBoost": 0.25},
    "endings_damaged": {"sagRecoveryBoost": -0.15, "compressionBias": -0.2, "finalPolishIntensity": -0.25},
    "clicks_artifacts": {"onsetTameBoost": 0.25, "breathTameBoost": 0.15},
}
METRICS = [
    "integratedLufs", "instabilityScore", "lineSwingScore", "sentenceJumpScore", "coldOpenDipDb", "coldOpenRiskScore", "midLineSagScore", "endFadeRiskScore", "endEdgeDipDb", "onsetOvershootScore", "breathSpikeRisk",
    "pauseNoiseRisk", "compressionScore", "clickScore", "echoScore", "roomScore", "sibilanceScore", "noiseFloorDb", "noiseContrastDb", "dynamicRangeDb", "speechDutyCyclePct", "speechSegmentCount",
]
POLISH, MOVED, POLISH_MOVED = "finalPolishIntensity", 0.05, 0.15


def json_text(text: Column) -> Column:
    """The JSON in an answer: what a code fence holds, else from the first { to the last }, else the whole text."""
    fence = rf"(?is)^```(?:json)?[{SPACE}]*(.*?)[{SPACE}]*```\z"
    cut = lambda whole: _let(F.regexp_extract(whole, r"(?s)\{.*\}", 0), lambda x: F.when(x != "", x).otherwise(whole))
    return _let(trim(text), lambda whole: F.when(whole.rlike(fence), trim(F.regexp_extract(whole, fence, 1))).otherwise(cut(whole)))


def repaired(json: Column) -> Column:
    """json without commas before a closing bracket and with those that are missing between lines."""
    gap = rf"[{SPACE}]*[\r\n]+[{SPACE}]*"
    number = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    for pattern, by in ((rf",[{SPACE}]*([}}\]])", "$1"), (f'"{gap}"', '",\n"'), (rf"\}}{gap}\{{", "},\n{"), (rf'\]{gap}"', '],\n"'), (rf'\}}{gap}"', '},\n"'), (f'(true|false|null|{number}){gap}"', '$1,\n"')):
        json = F.regexp_replace(json, pattern, by)
    return json


def _strict(json: Column) -> Column:
    """json as a variant; null unless it is one value and nothing else (the parser stops after the first)."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))), "$", "array<variant>")
    return _let(listed, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def parsed(text: Column) -> Column:
    """The object in a text as a variant, mended only if it does not parse as it is; null if there is none."""
    value = _let(json_text(text), lambda json: F.coalesce(_strict(json), _strict(repaired(json))))
    return _let(value, lambda v: F.when(_kind(v).startswith("OBJECT"), v))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def finite(v: Column) -> Column:
    """The number a variant is or writes, to three decimals; null for all else."""
    return F.when(_kind(v).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL)"), _let(F.try_variant_get(v, "$", "string"), loose_number))


def text(fallback: str = "", most: int = 280) -> Rule:
    return lambda v: _let(_string(v), lambda x: clean_text(x, fallback, most))


def flag(v: Column) -> Column:
    return F.coalesce((_kind(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False))


def choice(fallback: str, *values: str) -> Rule:
    return lambda v: _let(_string(v), lambda x: F.when(x.isin(*values), x).otherwise(fallback))


def bounded(default: float, low: float, high: float) -> Rule:
    return lambda v: _let(F.coalesce(finite(v), F.lit(default)), lambda x: sc.clamp(x, low, high))


def items(v: Column) -> Column:
    return F.coalesce(F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def texts_of(most: int = 8, length: int = 180) -> Rule:
    return lambda v: F.slice(F.filter(F.transform(items(v), lambda x: clean_text(_string(x), "", length)), lambda x: x != ""), 1, most)


def numbers_of(most: int) -> Rule:
    """The first numbers of a list; null if it has none."""

    def rule(v: Column) -> Column:
        found = F.slice(F.filter(F.transform(items(v), lambda x: finite(x)), lambda x: x.isNotNull()), 1, most)
        return _let(found, lambda n: F.when(F.size(n) > 0, n))

    return rule


def shape(v: Column, rules: dict[str, Rule]) -> Column:
    """A variant object as a struct of fields by their rules; of no object all defaults."""
    fields = lambda o: F.struct(*(_let(F.try_variant_get(o, f"$.{name}", "variant"), rule).alias(name) for name, rule in rules.items()))
    return _let(v, fields)


def list_of(rules: dict[str, Rule], most: int) -> Rule:
    return lambda v: F.slice(F.transform(F.filter(items(v), lambda x: _kind(x).startswith("OBJECT")), lambda x: shape(x, rules)), 1, most)


def struct_of(rules: dict[str, Rule], needed: bool = False) -> Rule:
    """A nested object; null without one if `needed`, else its defaults."""
    return lambda v: F.when(_kind(v).startswith("OBJECT"), shape(v, rules)) if needed else shape(v, rules)


DIRECTIVE_RULES: dict[str, Rule] = {name: bounded(*limits) for name, limits in DIRECTIVES.items()}
PROFILE_RULES: dict[str, Rule] = {
    "name": text("Balanced VO Profile", 100),
    "selectedVariant": choice("continuity-safe", "cinematic-stable", "continuity-safe", "pause-safe", "source-safe"),
    "smartMatchMode": choice("Balanced", "Off", "Gentle", "Balanced"),
    "leveler": choice("Balanced", "Minimal (no auto-leveler)", "Gentle", "Balanced", "Firm"),
    "breathControl": choice("Medium", "Off", "Light", "Medium"),
    "roomCleanup": flag, "softenHarshness": flag, "cinematicColor": flag,
    "notes": text("", 360),
}
_LISTS: dict[str, Rule] = {name: texts_of(6) for name in ("profileRationale", "guardrails", "nextListeningChecks")}
FILE_RULES: dict[str, Rule] = {
    "fileName": text("", 160), "base": text("", 120), "confidence": finite, "summary": text("Per-file review completed.", 320),
    "recommendedProfile": struct_of(PROFILE_RULES), "adaptiveDirectives": struct_of(DIRECTIVE_RULES), **_LISTS,
}
ADJUSTMENT_RULES: dict[str, Rule] = {"control": text("Control", 80), "recommendation": text("", 180), "why": text("", 220), "risk": text("Low", 80)}
FINDING_RULES: dict[str, Rule] = {"fileName": text("Unknown file", 160), "issue": text("Audio issue", 120), "severity": choice("medium", "low", "medium", "high"), "evidence": text("", 220), "action": text("", 220)}
REVIEW_RULES: dict[str, Rule] = {
    "verdict": choice("adjust", *VERDICTS), "confidence": bounded(0.0, 0.0, 1.0), "summary": text("Review completed.", 420),
    "perFileProfiles": list_of(FILE_RULES, FILES), "adjustments": list_of(ADJUSTMENT_RULES, 8), "findings": list_of(FINDING_RULES, 10),
    **{name: texts_of() for name in ("profileRationale", "guardrails", "nextListeningChecks")},
}
CONTROL_RULES: dict[str, Rule] = {
    "loudnessTarget": text("Mix-ready only (no loudness normalize)", 120), "smartMatchMode": text("Balanced", 80), "leveler": text("Balanced", 80), "breathControl": text("Medium", 80),
    **{name: flag for name in ("eqCleanup", "roomCleanup", "sceneBlend", "softenHarshness", "noiseGuard", "floorGuard", "cinematicColor", "gainPlannerEnabled")},
}


def review(v: Column, *fields: str, of_file: tuple[str, ...] = ()) -> Column:
    """The review in a parsed answer as a struct; null for null. With `fields`, only those and the confidence; with
    `of_file`, of each file only those, its name and its confidence.

    Give it a column that holds `parsed(...)`, so that a text is parsed once. A file without a name is called by its
    place; one without a confidence has that of the whole. Spark does not leave out fields that nothing reads: name those
    that are read.
    """
    rules = {n: rule for n, rule in REVIEW_RULES.items() if not fields or n in (*fields, "confidence")}
    if of_file and "perFileProfiles" in rules:
        rules["perFileProfiles"] = list_of({n: rule for n, rule in FILE_RULES.items() if n in (*of_file, "fileName", "confidence")}, FILES)

    def named(f: Column, i: Column, all_sure: Column) -> Column:
        name = F.when(f["fileName"] == "", F.concat(F.lit("file-"), (i + 1).cast("string"), F.lit(".wav"))).otherwise(f["fileName"])
        return f.withField("fileName", name).withField("confidence", sc.unit(F.coalesce(f["confidence"], all_sure, F.lit(0.0))))

    whole = shape(v, rules)
    if "perFileProfiles" in rules:
        whole = _let(whole, lambda w: w.withField("perFileProfiles", F.transform(w["perFileProfiles"], lambda f, i: named(f, i, w["confidence"]))))
    return F.when(v.isNotNull(), whole)


def request_files(v: Column) -> Column:
    """Of a parsed request: its first twelve entries under `files` as structs, without those that have no name."""
    rules: dict[str, Rule] = {"fileName": text("", 180), "base": text("", 160), "durationSeconds": finite, "source": struct_of({m: finite for m in METRICS} | {"bandSpectrumDb": numbers_of(8)})}
    listed = F.slice(items(F.try_variant_get(v, "$.files", "variant")), 1, FILES)
    made = F.transform(F.filter(listed, lambda x: _kind(x).startswith("OBJECT")), lambda x: shape(x, rules))
    made = F.transform(made, lambda f: f.withField("base", F.when(f["base"] == "", F.substring(f["fileName"], 1, 160)).otherwise(f["base"])))
    return F.filter(made, lambda f: f["fileName"] != "")


def request(v: Column) -> Column:
    """A parsed request as a struct (reviewStage, controls, files); null without controls or without a usable file."""
    controls = F.try_variant_get(v, "$.controls", "variant")
    stage = choice("source", "source", "post-render")(F.try_variant_get(v, "$.reviewStage", "variant"))
    made = _let(request_files(v), lambda files: F.when(F.size(files) > 0, F.struct(stage.alias("reviewStage"), shape(controls, CONTROL_RULES).alias("controls"), files.alias("files"))))
    return F.when(_kind(controls).startswith("OBJECT"), made)


def chunks_of(files: Column, size: int = FILES_A_REQUEST) -> Column:
    """An array cut into arrays of at most `size`."""
    many = F.ceil(F.size(files) / size).cast("int")
    return F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.slice(files, k * size + 1, F.lit(size))))


def _kept(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def no_directives() -> Column:
    return F.struct(*(F.lit(v[0]).alias(n) for n, v in DIRECTIVES.items()))


def merged(base: Column, delta: dict[str, Column | float]) -> Column:
    """Directives moved by a delta, within their bounds."""
    moved = {n: base[n] + (d if isinstance(d, Column) else F.lit(float(d))) for n, d in delta.items()}
    return F.struct(*(_let(_kept(moved.get(n, base[n])), lambda x, low=low, high=high: sc.clamp(x, low, high)).alias(n) for n, (_, low, high) in DIRECTIVES.items()))


def corrective(tags: Column) -> Column:
    """The directives that tags ask for, one after the other; unknown tags ask for nothing."""
    deltas = {n: {tag: d[n] for tag, d in CORRECTIVE.items() if n in d} for n in DIRECTIVES}

    def delta(tag: Column, name: str) -> Column:
        out = F.lit(0.0)
        for t, d in deltas[name].items():
            out = F.when(tag == t, F.lit(d)).otherwise(out)
        return out

    return F.aggregate(tags, no_directives(), lambda have, tag: merged(have, {n: delta(tag, n) for n in DIRECTIVES if deltas[n]}))


def stands_out(d: Column, base: Column | None = None) -> Column:
    """Whether directives differ from others (the defaults) by what one could hear."""
    base = no_directives() if base is None else base
    out = F.abs(d[POLISH] - base[POLISH]) >= POLISH_MOVED
    for n in DIRECTIVES:
        if n != POLISH:
            out = out | (F.abs(d[n] - base[n]) >= MOVED)
    return out


#: What `merge_chunks` reads of a review.
MERGED = ("verdict", "confidence", "summary", "adjustments", "findings", "profileRationale", "guardrails", "nextListeningChecks")


def merge_chunks(reviews: DataFrame, keys: list[str], order: str, review: str) -> DataFrame:
    """Per key one row of the reviews of its parts: verdict (the worst), confidence (the mean), summary, findings (16),
    adjustments (12), and the first eight different entries of each list. Missing reviews are left out."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), C(review)["verdict"])
    there = C(review).isNotNull()  # inside the aggregates: as a filter Spark would parse each text once more below its source
    ordered = lambda name: F.flatten(F.sort_array(F.collect_list(F.when(there, F.struct(C(order).alias("at"), C(review)[name].alias("x")))))["x"])
    lists = ("profileRationale", "guardrails", "nextListeningChecks")
    return reviews.groupBy(*keys).agg(
        F.max_by(C(review)["verdict"], rank).alias("verdict"), sc.unit(_kept(F.avg(C(review)["confidence"]))).alias("confidence"), F.count_if(there).alias("parts"),
        F.min_by(C(review)["summary"], F.when(there, C(order))).alias("summary"), F.slice(ordered("findings"), 1, 16).alias("findings"), F.slice(ordered("adjustments"), 1, 12).alias("adjustments"),
        *(F.slice(F.array_distinct(ordered(n)), 1, 8).alias(n) for n in lists),
    ).where("parts > 0")


def matched_profiles(files: DataFrame, reviews: DataFrame, keys: list[str], order: str, review: str) -> DataFrame:
    """files (with file_name and base) with profile: the last that names the file's base, else its name; null if none."""
    each = reviews.select(*keys, C(order), F.posexplode(C(review)["perFileProfiles"]).alias("__i", "__p"))
    named = each.select(*keys, C(order), "__i", "__p", F.explode(F.array_distinct(F.array(C("__p")["base"], C("__p")["fileName"]))).alias("__name")).where("__name <> ''")
    last = named.groupBy(*keys, "__name").agg(F.max_by("__p", F.struct(C(order), C("__i"))).alias("__p"))
    by_base = last.withColumnsRenamed({"__name": "base", "__p": "__by_base"})
    by_name = last.withColumnsRenamed({"__name": "file_name", "__p": "__by_name"})
    d = files.join(by_base, [*keys, "base"], "left").join(by_name, [*keys, "file_name"], "left")
    return d.withColumn("profile", F.coalesce("__by_base", "__by_name")).drop("__by_base", "__by_name").select(*files.columns, "profile")
