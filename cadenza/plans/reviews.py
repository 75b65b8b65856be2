"""Registered queries on reviews in JSON: an answer written for each order, broken in one of several ways, and read back.

The SQL never sees the JSON; it computes from an order's columns what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import reviews
from cadenza.plans.queries import query, r, table

C = F.col
_LAST = ',\n"adaptiveDirectives": {"warmthDb": %s,\n"levelerBias": %s}}]}'


def answers(spark, sf_dir):
    """orders with answer: plain, fenced, within prose, with commas too many, with commas missing, or cut off."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    o = o.repartition(3 * spark.sparkContext.defaultParallelism, "o_orderkey")  # few bytes a row, but much work
    warmth = ((C("o_custkey") % 50 - 25) / 10).cast("string")
    warmth = F.when(C("o_orderkey") % 2 == 1, F.concat(F.lit('"'), warmth, F.lit('"'))).otherwise(warmth)
    verdict = F.when(C("o_orderstatus") == "F", "risky").when(C("o_orderstatus") == "O", "ready").otherwise("unknown")
    name = F.when(C("o_custkey") % 4 == 0, "3").otherwise(F.concat(F.lit('"take '), C("o_custkey").cast("string"), F.lit('.wav"')))
    plain = F.concat(
        F.lit('{"verdict": "'), verdict, F.lit('",\n"confidence": '), (C("o_custkey") % 140 / 100).cast("string"), F.lit(',\n"guardrails": ["keep \\t ends", 3, "'), C("o_orderpriority"), F.lit('"],\n"perFileProfiles": [{"fileName": '), name,
        F.format_string(_LAST, warmth, ((C("o_orderkey") % 13 - 6) / 10).cast("string")),
    )
    how = C("o_orderkey") % 6
    fenced, told = F.concat(F.lit("```json\n"), plain, F.lit("\n```")), F.concat(F.lit("My review: "), plain, F.lit(" That is all."))
    more, fewer = F.replace(plain, F.lit("}}]}"), F.lit("},}, ],\n}")), F.replace(plain, F.lit(",\n"), F.lit(" \n"))
    cut = F.substr(plain, F.lit(1), F.length(plain) - 2)
    text = F.when(how == 0, plain).when(how == 1, fenced).when(how == 2, told).when(how == 3, more).when(how == 4, fewer).otherwise(cut)
    return o.select("o_orderkey", "o_custkey", text.alias("answer"))


def reviewed(spark, sf_dir, *fields: str, of_file: tuple[str, ...] = ()):
    d = answers(spark, sf_dir).withColumn("v", reviews.parsed(C("answer")))
    return d.select("o_orderkey", "o_custkey", reviews.review(C("v"), *fields, of_file=of_file).alias("review"))


EXPECTED = """WITH ex AS (SELECT o_orderkey, o_custkey, o_orderkey % 6 < 5 AS fine, CASE o_orderstatus WHEN 'F' THEN 'risky' WHEN 'O' THEN 'ready' ELSE 'adjust' END AS verdict, least(1, o_custkey % 140 / 100.0::DOUBLE) AS confidence,
 ['keep ends', o_orderpriority] AS rails, CASE WHEN o_custkey % 4 = 0 THEN 'file-1.wav' ELSE 'take ' || o_custkey || '.wav' END AS file_name, least(1.8, greatest(-1.8, (o_custkey % 50 - 25) / 10.0::DOUBLE)) AS warmth, least(0.5, greatest(-0.5, (o_orderkey % 13 - 6) / 10.0::DOUBLE)) AS leveler FROM orders)"""  # fmt: skip


@query(EXPECTED + """ SELECT o_orderkey, CASE WHEN fine THEN verdict END AS verdict, CASE WHEN fine THEN round(confidence, 6) END AS confidence, CASE WHEN fine THEN array_to_string(rails, '|') END AS guardrails, CASE WHEN fine THEN file_name END AS file_name,
 CASE WHEN fine THEN round(warmth, 6) END AS warmth, CASE WHEN fine THEN round(leveler, 6) END AS leveler, CASE WHEN fine THEN abs(warmth) >= 0.05 OR abs(leveler) >= 0.05 END AS moved FROM ex""")  # fmt: skip
def mended_reviews(spark, sf_dir):
    d = reviewed(spark, sf_dir, "verdict", "guardrails", "perFileProfiles", of_file=("adaptiveDirectives",))
    first = F.get(C("review")["perFileProfiles"], F.lit(0))
    directives = first["adaptiveDirectives"]
    return d.select(
        "o_orderkey", C("review")["verdict"].alias("verdict"), r(C("review")["confidence"]).alias("confidence"), F.array_join(C("review")["guardrails"], "|").alias("guardrails"), first["fileName"].alias("file_name"),
        r(directives["warmthDb"]).alias("warmth"), r(directives["levelerBias"]).alias("leveler"), reviews.stands_out(directives).alias("moved"),
    )


@query(EXPECTED + """, f AS (SELECT * FROM ex WHERE fine), g AS (SELECT o_custkey, list_max(list_transform(list(verdict), lambda v: CASE v WHEN 'risky' THEN 2 WHEN 'adjust' THEN 1 ELSE 0 END)) AS w, floor(avg(confidence) * 1000 + 0.5) / 1000 AS c, count(*) AS parts FROM f GROUP BY o_custkey),
 u AS (SELECT o_custkey, rail, min(pos) AS pos FROM (SELECT o_custkey, unnest(rails) AS rail, (o_orderkey, generate_subscripts(rails, 1)) AS pos FROM f) GROUP BY o_custkey, rail), l AS (SELECT o_custkey, array_to_string(list(rail ORDER BY pos)[:8], '|') AS guardrails FROM u GROUP BY o_custkey)
 SELECT o_custkey, ['ready', 'adjust', 'risky'][w + 1] AS verdict, round(least(1, c), 6) AS confidence, parts, guardrails FROM g JOIN l USING (o_custkey)""")  # fmt: skip
def merged_reviews(spark, sf_dir):
    """A customer's orders as the parts of one review."""
    d = reviews.merge_chunks(reviewed(spark, sf_dir, *reviews.MERGED), ["o_custkey"], "o_orderkey", "review")
    return d.select("o_custkey", "verdict", r("confidence").alias("confidence"), "parts", F.array_join("guardrails", "|").alias("guardrails"))


@query("""WITH t AS (SELECT o_orderkey, 1 + o_orderkey % 2 AS n, CASE WHEN o_custkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END AS a, CASE WHEN o_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END AS b, CASE WHEN o_custkey % 5 = 0 THEN 1.0::DOUBLE ELSE 0 END AS h FROM orders)
 SELECT o_orderkey, round(greatest(-0.5, least(0.5, 0.35 * n) - 0.25 * a), 6) AS leveler, round(least(0.7, 0.25 * n) - 0.15 * b, 6) AS sag, round(greatest(-0.6, -0.35 * a - 0.2 * b), 6) AS compression, round(0.5 - 0.2 * a - 0.25 * b, 6) AS polish,
 round(1.8 * h, 6) AS de_harsh, round(greatest(-1.2, -1.0 * h), 6) AS air, round(-0.6 * h, 6) AS presence FROM t""")  # fmt: skip
def corrective_directives(spark, sf_dir):
    """Directives of tags that follow from an order's keys; some tags come twice or four times, one is unknown."""
    tag = lambda name, many: F.array_repeat(F.lit(name), many.cast("int"))
    every = lambda k, many: F.when(C("o_custkey") % k == 0, many).otherwise(0)
    tags = F.concat(tag("level_uneven", 1 + C("o_orderkey") % 2), tag("too_compressed", every(3, 1)), tag("unheard_of", every(1, 1)), tag("endings_damaged", every(2, 1)), tag("harsh_sibilance", every(5, 4)))
    d = table(spark, sf_dir, "orders").select("o_orderkey", tags.alias("tags")).withColumn("d", reviews.corrective(C("tags")))
    names = {"leveler": "levelerBias", "sag": "sagRecoveryBoost", "compression": "compressionBias", "polish": "finalPolishIntensity", "de_harsh": "deHarshDb", "air": "airDb", "presence": "presenceDb"}
    return d.select("o_orderkey", *(r(C("d")[f]).alias(n) for n, f in names.items()))
