"""Registered queries on file names, logs, gates of candidates and spans of speech."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import texts as tx
from cadenza.operators import candidates as cd
from cadenza.operators import delivery, segments
from cadenza.plans.queries import FR, KEY, RUNS, active, frames, query, r, table

C = F.col

#: Names of files made of the pages: what both sides read. No rule of the operators is in it.
_NAMES = """(SELECT page_id, CASE page_id % 12 WHEN 0 THEN concat('Result - Take ', page_id, ' MixReady v2.WAV') WHEN 1 THEN concat('source_', page_id, '.wav') WHEN 2 THEN concat('in/result/Tone ', page_id, '.wav')
 WHEN 3 THEN concat('  voice ', page_id, ' (after) .wav ') WHEN 4 THEN concat('Raw-Line ', page_id, '_blend_a85.wav') WHEN 5 THEN 'con.txt' WHEN 6 THEN concat('clip ', page_id, '_blend_mixready.wav') WHEN 7 THEN '...' WHEN 8 THEN concat('a<b>:', page_id, '|x. .mp3')
 WHEN 9 THEN concat('original ', page_id) WHEN 10 THEN concat('..', page_id, '.wav') ELSE concat('x_r128_', page_id, '_r128.wav') END AS name FROM pages)"""


def _view(spark, sf_dir, name: str, text: str):
    """Rows of an inner SELECT that both dialects read."""
    plain = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(plain.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, sf_dir, name)})


_STEM = "regexp_replace(regexp_extract(name, '([^/\\\\]*)$', 1), '\\.[^.]*$', '')"
_CLEAN = "regexp_replace(regexp_replace({x}, '[\\x00-\\x1f<>:\"/\\\\|?*]', '_', 'g'), '[ .]+$', '')"
_RES = "'(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$'"


@query(f"""WITH n AS {_NAMES}, c AS (SELECT *, {_CLEAN.format(x=_STEM)} AS b, {_CLEAN.format(x="trim(regexp_extract(name, '([^/\\\\]*)$', 1))")} AS d FROM n)
 SELECT page_id, CASE WHEN b = '' THEN concat('input_', page_id + 1) WHEN regexp_matches(b, {_RES}) THEN concat(b, '_file') ELSE b END AS base, CASE WHEN d = '' THEN 'download' ELSE d END AS download,
 CASE WHEN contains(name, '/') OR contains(name, '..') OR trim(name) <> name THEN NULL ELSE 1 END::BIGINT AS upload_ok,
 regexp_replace(regexp_replace(name, '\\.[^/.]+$', ''), '[^a-zA-Z0-9_-]+', '_', 'g') AS short,
 CASE WHEN regexp_matches(lower(name), '(^|[_\\s-])(after|optimized|processed)([_\\s-]|$)') THEN 'after' WHEN regexp_matches(lower(name), '(^|[_\\s-])(before|original|raw)([_\\s-]|$)') THEN 'before'
 WHEN regexp_matches(lower(name), '(_blend_)?(a85|r128)\\.wav$') OR regexp_matches(lower(name), '_mixready\\.wav$') THEN 'after' ELSE 'unknown' END AS role,
 list_contains(list_transform(string_split(name, '/')[:-2], lambda s: lower(s)), 'result') OR regexp_matches(regexp_extract(name, '([^/]*)$', 1), '(?i)^result[\\s_-]+') AS is_result FROM c""")  # fmt: skip
def safe_file_names(spark, sf_dir):
    n = _view(spark, sf_dir, "pages", _NAMES)
    name, k = C("name"), C("page_id")
    return n.select(
        "page_id", tx.safe_base(name, k).alias("base"), tx.safe_download_name(name, F.lit("download")).alias("download"), F.when(tx.safe_upload_name(name, k).isNotNull(), 1).cast("long").alias("upload_ok"),
        tx.short_base(name).alias("short"), tx.guess_role(name).alias("role"), tx.is_result_path(name).alias("is_result"),
    )


@query(f"""WITH n AS {_NAMES}, b AS (SELECT page_id, regexp_extract(name, '([^/]*)$', 1) AS f, name FROM n), s AS (SELECT page_id, lower(CASE WHEN f = '..' THEN f ELSE regexp_replace(f, '^(.+)\\.[^.]*$', '\\1') END) AS st,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(name, '\\.[^/.]+$', '')), '\\s+', '_', 'g'), '[^\\w-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS j FROM b)
 SELECT page_id, regexp_replace(regexp_replace(regexp_replace(st, '^(?:result|ori(?:ginal)?|source)[\\s_-]+', ''), '[\\s_-]+mixready(?:[\\s_-].*)?$', ''), '[^a-z0-9]+', '', 'g') AS corpus_key,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(j, '_blend_mixready$', ''), '_mixready$', ''), '_(?:blend_)?(?:a85|r128)$', ''), '^before_', ''), '^after_', '') AS comparison_key FROM s""")  # fmt: skip
def pairing_keys(spark, sf_dir):
    n = _view(spark, sf_dir, "pages", _NAMES)
    return n.select("page_id", tx.corpus_key(C("name")).alias("corpus_key"), tx.comparison_key(C("name")).alias("comparison_key"))


#: A log for each order, with and without a level, a duration, an object and failures.
_LOGS = """(SELECT o_orderkey, concat('start', chr(10), 'Duration: 0', o_orderkey % 10, ':', 10 + o_orderkey % 50, ':', 10 + o_custkey % 50, '.5', chr(13), chr(10), 'RMS level dB: -', o_custkey % 80, '.25', chr(10),
 CASE WHEN o_orderkey % 5 = 0 THEN concat('RMS level dB: -inf', chr(10)) ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN concat('{"a": 1} then {"input_i": "-', o_custkey % 40, '"}', chr(10)) ELSE '' END,
 CASE WHEN o_orderkey % 4 = 0 THEN concat('  Error one ', o_orderkey, chr(10), 'two failed', chr(10), 'worker terminated', chr(10), 'INVALID three', chr(10), 'aborted') ELSE 'done' END) AS log FROM orders)"""


@query(f"""WITH g AS {_LOGS}, l AS (SELECT *, list_filter(list_transform(string_split(replace(log, chr(13) || chr(10), chr(10)), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ln, regexp_extract_all(log, 'RMS level dB:\\s*(-?(?:\\d+(?:\\.\\d+)?|inf))', 1) AS rm FROM g),
 m AS (SELECT *, list_filter(ln, lambda s: regexp_matches(s, '(?i)error|failed|invalid|aborted|out of bounds')) AS im FROM l)
 SELECT o_orderkey, CASE WHEN rm[-1] = '-inf' THEN -120.0 ELSE rm[-1]::DOUBLE END AS rms_db, regexp_extract(log, 'Duration: (\\d\\d):', 1)::DOUBLE * 3600 + regexp_extract(log, 'Duration: \\d\\d:(\\d\\d):', 1)::DOUBLE * 60 + regexp_extract(log, 'Duration: \\d\\d:\\d\\d:([0-9.]+)', 1)::DOUBLE AS seconds,
 json_extract_string(regexp_extract_all(log, '\\{{[^}}]*\\}}')[-1], '$.input_i') AS input_i, array_to_string(list_slice(CASE WHEN len(im) > 0 THEN im ELSE ln END, -3, -1), ' | ') AS summary,
 regexp_matches(log, '(?i)terminated|aborted') AS recoverable FROM m""")  # fmt: skip
def log_values(spark, sf_dir):
    g, log = _view(spark, sf_dir, "orders", _LOGS), C("log")
    return g.select(
        "o_orderkey", tx.last_rms_db(log).alias("rms_db"), tx.duration_seconds(log).alias("seconds"), tx.last_object(log)["input_i"].alias("input_i"),
        tx.failure_summary(log).alias("summary"), tx.is_recoverable(log).alias("recoverable"),
    )


#: Loose values in each form that is a number, and some that are none.
_LOOSE = """(SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN concat(' ', p_size, '.12345 ') WHEN 1 THEN concat('0x', p_size) WHEN 2 THEN '' WHEN 3 THEN 'n/a' WHEN 4 THEN concat('-', p_partkey, '.4321') WHEN 5 THEN '1e3' ELSE concat(p_size, 'd') END AS v,
 concat(p_name, chr(9), ' ', chr(10), p_type) AS t, concat('a/', p_partkey, '.wav | b.wav|', CASE WHEN p_partkey % 3 = 0 THEN '-bad' ELSE concat('id:', p_partkey) END) AS spec FROM part)"""


@query(f"""WITH p AS {_LOOSE}, q AS (SELECT *, trim(v) AS x, list_transform(string_split(spec, '|'), lambda s: trim(s)) AS f FROM p)
 SELECT p_partkey, CASE WHEN x = '' THEN 0 WHEN starts_with(x, '0x') THEN list_reduce(list_transform(string_split(substr(x, 3), ''), lambda c: c::BIGINT), lambda a, b: a * 16 + b) WHEN regexp_matches(x, '^[+-]?[0-9.]+(e[0-9]+)?$') THEN floor(x::DOUBLE * 1000 + 0.5) / 1000 END::DOUBLE AS number,
 substr(regexp_replace(t, '\\s+', ' ', 'g'), 1, 12) AS text, CASE WHEN regexp_matches(f[3], '^[A-Za-z0-9][A-Za-z0-9._:-]*$') THEN f[1] END AS source_path, CASE WHEN regexp_matches(f[3], '^[A-Za-z0-9][A-Za-z0-9._:-]*$') THEN f[3] END AS pair_id FROM q""")  # fmt: skip
def loose_values(spark, sf_dir):
    d = _view(spark, sf_dir, "part", _LOOSE).withColumn("pair", tx.pair_spec(C("spec")))
    return d.select("p_partkey", tx.loose_number(C("v")).alias("number"), tx.clean_text(C("t"), most=12).alias("text"), C("pair.source_path").alias("source_path"), C("pair.id").alias("pair_id"))


#: Gate and degrade reasons of an order's lines, some of them without any.
_GATES = """(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, l_discount, l_suppkey, l_extendedprice, concat_ws(',', CASE WHEN l_partkey % 5 = 0 THEN 'timing-offset' END, CASE WHEN l_partkey % 2 = 0 THEN 'qc-unavailable' END, CASE WHEN l_suppkey % 2 = 0 THEN 'ending-damage' END,
 CASE WHEN l_suppkey % 3 <> 1 THEN 'end-edge-dip' END, CASE WHEN l_partkey % 3 = 0 THEN 'source-regression' END, CASE WHEN l_partkey % 11 = 0 THEN 'planner-required' END) AS g,
 concat_ws(',', CASE WHEN l_suppkey % 4 = 0 THEN 'audibility-dropout-guard' END, CASE WHEN l_partkey % 3 = 1 THEN 'qc-unavailable' END) AS d,
 CASE l_suppkey % 5 WHEN 0 THEN 'fixed-segmented' WHEN 1 THEN 'speech-pause-segmented' WHEN 2 THEN 'speech-aligned-segmented' WHEN 3 THEN 'single-pass' ELSE 'single-pass-recovered' END AS path,
 CASE l_partkey % 5 WHEN 0 THEN 'cinematic-stable' WHEN 1 THEN 'continuity-safe' WHEN 2 THEN 'pause-safe' WHEN 3 THEN 'core-safe' ELSE 'other' END AS variant FROM lineitem)"""
_TECH = "['duration-mismatch', 'timing-offset', 'peak-violation', 'planner-required', 'planner-apply-failed']"


def _candidates(spark, sf_dir):
    split = lambda x: F.filter(F.split(x, ","), lambda s: s != "")
    return _view(spark, sf_dir, "lineitem", _GATES).withColumns({"gates": split(C("g")), "degraded": split(C("d"))})


@query(f"""WITH p AS {_GATES}, q AS (SELECT *, list_filter(string_split(g, ','), lambda s: s <> '') AS gs, list_filter(string_split(d, ','), lambda s: s <> '') AS ds FROM p)
 SELECT l_orderkey, l_linenumber, array_to_string(list_filter(gs, lambda s: list_contains({_TECH}, s)), ',') AS technical, array_to_string(list_filter(gs, lambda s: NOT list_contains({_TECH}, s)), ',') AS advisory,
 list_has_all(gs, ['ending-damage', 'end-edge-dip', 'source-regression']) AS linear, list_has_any(gs, ['duration-mismatch', 'timing-offset', 'peak-violation']) OR list_contains(ds, 'audibility-dropout-guard') AS source_safe,
 NOT list_has_any(gs, {_TECH}) AS delivers, CASE WHEN l_tax < l_discount THEN 'enhanced' WHEN l_tax > l_discount THEN 'previous' ELSE 'tie' END AS advice,
 CASE WHEN l_quantity > 30 OR l_partkey % 4 = 0 THEN 'partial' ELSE 'measured' END AS status, l_quantity >= 24 OR (l_extendedprice / 100 >= 480 AND l_suppkey % 2 = 0) OR (l_linenumber >= 18 AND l_suppkey % 3 = 0) OR l_partkey % 13 = 0 AS high_risk,
 CASE WHEN l_partkey % 2 = 0 THEN 'use-plan' WHEN l_suppkey % 2 = 0 THEN 'render-source-preserving' ELSE 'bypass-nonspeech' END AS outcome, CASE WHEN l_partkey % 3 = 0 THEN l_quantity * 200 ELSE l_extendedprice END > 4800 AS long_form FROM q""")  # fmt: skip
def candidate_gates(spark, sf_dir):
    d, even = _candidates(spark, sf_dir), lambda x, k=2: C(x) % k == 0
    sampled = F.when(C("l_quantity") > 30, C("l_quantity"))
    return d.select(
        "l_orderkey", "l_linenumber", F.array_join(cd.technical_reasons(C("gates")), ",").alias("technical"), F.array_join(cd.advisory_reasons(C("gates")), ",").alias("advisory"),
        cd.wants_linear_recovery(C("gates")).alias("linear"), cd.wants_source_safe(C("gates"), C("degraded")).alias("source_safe"), cd.delivers_enhanced(C("gates")).alias("delivers"),
        cd.advisory_preference(C("l_discount"), C("l_tax")).alias("advice"), cd.measurement_status([sampled], [C("l_tax"), F.when(~even("l_partkey", 4), C("l_discount"))]).alias("status"),
        cd.high_render_risk(C("l_extendedprice") / 100, even("l_suppkey"), C("l_quantity"), C("l_linenumber"), even("l_suppkey", 3), even("l_partkey", 13)).alias("high_risk"),
        cd.planner_outcome(even("l_partkey"), even("l_suppkey")).alias("outcome"), cd.long_form(F.when(~even("l_partkey", 3), C("l_extendedprice")), C("l_quantity") * 200).alias("long_form"),
    )


@query(f"""WITH p AS {_GATES}, q AS (SELECT *, list_filter(string_split(d, ','), lambda s: s <> '') AS ds, path IN ('speech-pause-segmented', 'speech-aligned-segmented', 'fixed-segmented') AND l_partkey % 3 <> 0 AS ok FROM p WHERE contains(g, 'qc-unavailable') AND NOT contains(g, 'planner-')),
 k AS (SELECT *, len(list_filter(ds, lambda s: s NOT IN ('analysis-window-retry', 'analysis-window-drop', 'qc-unavailable'))) > 0 AS br FROM q),
 o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY br, NOT ok, path = 'single-pass-recovered', CASE variant WHEN 'cinematic-stable' THEN 0 WHEN 'continuity-safe' THEN 1 WHEN 'pause-safe' THEN 2 WHEN 'core-safe' THEN 3 ELSE 4 END,
 CASE path WHEN 'fixed-segmented' THEN 0 WHEN 'single-pass' THEN 2 WHEN 'single-pass-recovered' THEN 3 ELSE 1 END, CASE WHEN l_suppkey % 2 = 0 THEN l_tax END NULLS LAST, l_tax, l_discount, l_quantity, l_extendedprice, l_partkey, l_linenumber, l_suppkey) AS rk FROM k)
 SELECT l_orderkey, l_linenumber, variant, CASE WHEN br THEN 'QC-unavailable fallback with render degradation because no cleaner rendered candidate was available' WHEN ok THEN 'QC-unavailable fallback from healthy rendered segmented audio' ELSE 'QC-unavailable fallback from rendered audio' END AS reason FROM o WHERE rk = 1""")  # fmt: skip
def unmeasured_fallback(spark, sf_dir):
    d = _candidates(spark, sf_dir).withColumns({
        "index": F.struct("l_linenumber", "l_suppkey"), "has_audio": F.lit(True), "healthy": C("l_partkey") % 3 != 0, "rank": F.when(C("l_suppkey") % 2 == 0, C("l_tax")),
        "stability": C("l_tax"), "pause": C("l_discount"), "compression": C("l_quantity"), "echo": C("l_extendedprice"), "total": C("l_partkey"),
    })
    return cd.choose_unmeasured(d, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "variant", "reason")


@query("""WITH v AS (SELECT l_orderkey, CASE WHEN l_quantity > 45 THEN 'risky' WHEN l_quantity > 30 THEN 'adjust' WHEN l_quantity > 2 THEN 'ready' END AS v FROM lineitem)
 SELECT l_orderkey, ['ready', 'adjust', 'risky'][max(CASE v WHEN 'risky' THEN 3 WHEN 'adjust' THEN 2 ELSE 1 END)] AS verdict FROM v GROUP BY 1""")
def worst_verdicts(spark, sf_dir):
    v = F.when(C("l_quantity") > 45, "risky").when(C("l_quantity") > 30, "adjust").when(C("l_quantity") > 2, "ready")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(tx.worst_verdict(v).alias("verdict"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_totalprice AS a, o_totalprice % 7 AS b, o_totalprice % 3 AS c FROM orders),
 q AS (SELECT x.o_custkey, x.o_orderkey, x.o_orderkey % 3 = 0 AND y.o_orderkey % 3 = 0 AND x.a <> y.a AS rk, x.o_orderkey % 2 <> y.o_orderkey % 2 AS st, x.b <> y.b AS pa FROM p x JOIN p y ON x.o_custkey = y.o_custkey AND y.k = x.k + 1)
 SELECT o_custkey, o_orderkey, CASE WHEN rk THEN 'winner by learned ranking' WHEN st THEN 'winner by raw stability delta' WHEN pa THEN 'winner by raw pause delta' ELSE 'winner by raw total delta' END AS why FROM q""")  # fmt: skip
def candidate_delta(spark, sf_dir):
    """What parts a customer's orders from the next one, as scores of candidates."""
    k, a = C("o_orderkey"), C("o_totalprice")
    score = F.struct(F.when(k % 3 == 0, a).alias("rank"), (k % 2).alias("stability"), (a % 7).alias("pause"), F.lit(0).alias("compression"), F.lit(0).alias("echo"))
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", score.alias("winner"))
    d = d.withColumn("loser", F.lead("winner").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("loser is not null")
    return d.select("o_custkey", "o_orderkey", cd.explain_delta("winner", "loser").alias("why"))


@query(RUNS + """, sp AS (SELECT user_id, run_id, active, count(*) * 1.0 AS sec FROM rn GROUP BY user_id, run_id, active)
 SELECT user_id, round(100 * coalesce(sum(sec) FILTER (active), 0) / sum(sec), 6) AS duty_pct, count(*) FILTER (active)::BIGINT AS n_speech, round(coalesce(median(sec * 1000) FILTER (active), 0), 6) AS median_run_ms, count(*) FILTER (NOT active AND sec >= 1.5)::BIGINT AS long_silences,
 sum(sec) >= 480 AND 100 * coalesce(sum(sec) FILTER (active), 0) / sum(sec) <= 38 AND (count(*) FILTER (NOT active AND sec >= 1.5) >= 12 OR coalesce(median(sec * 1000) FILTER (active), 0) <= 2600) AS long_sparse FROM sp GROUP BY user_id""")  # fmt: skip
def speech_map_stats(spark, sf_dir):
    """Speech and silence of each series, a frame taken as a second."""
    d = segments.speech_map(active(spark, sf_dir), KEY, "active", 1.0)
    return d.select("user_id", r("duty_pct").alias("duty_pct"), "n_speech", r("median_run_ms").alias("median_run_ms"), "long_silences", "long_sparse")


@query(FR + """, d AS (SELECT user_id, abs(db - lag(db) OVER (PARTITION BY user_id ORDER BY frame_idx)) AS s, db FROM fr)
 SELECT user_id, count(s)::BIGINT AS transitions, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.95), 6) AS p95, round(quantile_cont(s, 0.99), 6) AS p99, round(max(s), 6) AS most, round(avg(1 / (1 + 10 ** ((-100 - db) / 6))), 6) AS reliability FROM d GROUP BY user_id HAVING count(s) > 0""")  # fmt: skip
def gain_motion(spark, sf_dir):
    d = segments.motion(frames(spark, sf_dir), KEY, "frame_idx", "db")
    return d.select("user_id", "transitions", *(r(c).alias(c) for c in ("p50", "p95", "p99", "most", "reliability")))


@query("""WITH f AS (SELECT l_orderkey, l_extendedprice - 2000 AS size, concat('take_', l_partkey, '.wav') AS name FROM lineitem)
 SELECT l_orderkey, round(sum(greatest(0, size)) + 4096 + sum(128 + 2 * length(name)), 4) AS bytes FROM f GROUP BY 1""")
def bundle_bytes(spark, sf_dir):
    name = F.concat(F.lit("take_"), C("l_partkey").cast("string"), F.lit(".wav"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(r(segments.bundle_bytes(C("l_extendedprice") - 2000, name), 4).alias("bytes"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 <> 0 THEN -l_quantity / 2 END AS tg, -l_quantity / 3 - l_discount * 50 AS ms, l_quantity / 4 AS rq, -55 - l_linenumber AS sf, l_discount * 10 AS sc, -70 + l_quantity / 5 AS fl, l_tax * 12 AS cf,
 l_extendedprice / 1000 AS st, l_quantity / 10 - 0.5 AS se FROM lineitem)
 SELECT l_orderkey, l_linenumber, round(coalesce(least(10.5, greatest(0, tg + 1.35 - ms)), 0), 6) AS makeup, round(rq + sqrt(least(1, sc) * least(1, cf)) * (least(rq, greatest(0, greatest(-60, sf + 0.85) - fl)) - rq), 6) AS lane,
 CASE WHEN se <= 0 THEN 0 WHEN st * 100 >= 6000 THEN 6000 ELSE greatest(0, floor(st * 1000 / 10) - 1) END::BIGINT AS frame_start, CASE WHEN se <= 0 THEN 0 WHEN st * 100 >= 6000 THEN 6000 ELSE least(6000, ceil((st + se) * 1000 / 10 - 0.5) + 1) END::BIGINT AS frame_end,
 (44 + 4 * ceil(greatest(0, se) * 48000))::BIGINT AS bytes FROM d""")  # fmt: skip
def delivery_levels(spark, sf_dir):
    q = C("l_quantity")
    start, seconds = C("l_extendedprice") / 1000, q / 10 - 0.5
    d = table(spark, sf_dir, "lineitem").withColumn("f", delivery.frame_range(start, seconds, F.lit(10.0), F.lit(6000.0)))
    return d.select(
        "l_orderkey", "l_linenumber", r(delivery.makeup_db(F.when(C("l_partkey") % 5 != 0, -q / 2), -q / 3 - C("l_discount") * 50)).alias("makeup"),
        r(delivery.noise_lane_db(q / 4, F.lit(-55) - C("l_linenumber"), C("l_discount") * 10, q / 5 - 70, C("l_tax") * 12)).alias("lane"),
        "f.frame_start", "f.frame_end", delivery.wav_bytes(seconds, F.lit(48000.0)).alias("bytes"),
    )


_POWER = "10 * log10(list_sum(list_transform(b[{a}:{z}], lambda x: 10 ** (x / 10))) / {n} + 1e-30)"


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE * 20) AS b FROM embeddings)
 SELECT vec_id, round({_POWER.format(a=1, z=3, n=3)} - {_POWER.format(a=4, z=6, n=3)}, 5) AS low, round({_POWER.format(a=7, z=8, n=2)} - {_POWER.format(a=4, z=6, n=3)}, 5) AS high,
 CASE WHEN b[8] - b[7] >= 2 THEN 'high_center' WHEN b[8] - b[7] <= -2 THEN 'low_center' ELSE 'balanced' END AS placement FROM e""")  # fmt: skip
def spectrum_tilts(spark, sf_dir):
    """Eight components of each vector taken as the levels of eight bands."""
    bands = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 20)
    d = table(spark, sf_dir, "embeddings").select("vec_id", delivery.tilts_db(bands).alias("t"), delivery.de_esser_placement(bands).alias("placement"))
    return d.select("vec_id", r("t.low", 5).alias("low"), r("t.high", 5).alias("high"), "placement")
