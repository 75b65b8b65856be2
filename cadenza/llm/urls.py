"""URL filtering: rules first, else the ratio of two character language models, with DataFrame functions only.

The models are variable-order Markov chains over characters, one of the accepted and one of the rejected URLs, where
the rules say which is which. Contexts of up to ORDER-1 characters are smoothed by Witten-Bell interpolation down to
a uniform distribution. A URL is judged by the mean over its characters of log P(accepted) - log P(rejected), against
a threshold between the two classes' means that weighs their spreads.

URLs are normalised to SYMBOLS first (lower case, digits alike, others one sign), so there are at most
len(SYMBOLS)**ORDER grams, however many pages; counts cover all pages. Equal normal forms are scored once.

A null url, or one without "://", has an empty host and path, and no rule fits it. With no page of one class all
log ratios are 0 and everything that no rule fits is allowed. A ratio equal to the threshold is allowed. Repeated rows
are judged alike; an empty table gives no rows; other columns pass, whatever their names. A url of any length is judged
whole, in time that grows with its length.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import Scratch, broadcast_if_small, fresh

#: The contract's rules (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SYMBOLS = "^~0.-_/?=&#:%+" + string.ascii_lowercase
ORDER = 4
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; nulls where none fits."""
    name = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return name, verdict


def normal_form(url: Column) -> Column:
    low = F.translate(F.coalesce(url, F.lit("")), _UPPER + "123456789", _LOWER + "0" * 9)
    return F.regexp_replace(low, "[^" + "".join("\\" + c if not c.isalnum() else c for c in SYMBOLS[2:]) + "]", "~")


def gram_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio): log P(last | before) of accepted minus rejected, of grams (gram, accepted, rejected)."""
    out = grams.select("gram", *(F.lit(1 / len(SYMBOLS)).alias(f"p_{c}") for c in ("accepted", "rejected")))
    for k in range(1, order + 1):
        tail = F.right("gram", F.lit(k))
        suffix = grams.groupBy(tail.alias("tail")).agg(*(F.sum(c).alias(c) for c in ("accepted", "rejected")))
        suffix = suffix.withColumn("before", F.left("tail", F.lit(k - 1)))
        context = suffix.groupBy("before").agg(
            *(F.sum(c).alias(f"n_{c}") for c in ("accepted", "rejected")), *(F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in ("accepted", "rejected"))
        )
        out = out.withColumn("tail", tail).join(suffix.join(context, "before"), "tail")
        for c in ("accepted", "rejected"):
            total = F.col(f"n_{c}") + F.col(f"t_{c}")
            mixed = (F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / total
            out = out.withColumn(f"p_{c}", F.when(total > 0, mixed).otherwise(F.col(f"p_{c}")))
        out = out.select("gram", "p_accepted", "p_rejected")
    return out.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict and ratio (the mean log ratio of the url's characters).

    Input columns of those names are replaced.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    new = ("host", "path", "rule", "verdict", "ratio")
    rest = [c for c in pages.columns if c not in new]
    where = F.col(url)
    form_, by_rule_ = fresh(pages.columns, "form", "by_rule")
    parts = pages.select(*rest, F.coalesce(host_of(where), F.lit("")).alias("host"), F.coalesce(path_of(where), F.lit("")).alias("path"), normal_form(where).alias(form_))
    name, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("rule", name).withColumn(by_rule_, by_rule)

    counted = [F.count_if(F.col(by_rule_) == v).alias(c) for v, c in (("allow", "accepted"), ("block", "rejected"))]
    # grams carry a number, not the form: a row of every gram with a long url would be its square
    forms = scratch.keep(parts.groupBy(F.col(form_).alias("form")).agg(*counted).withColumn("number", F.monotonically_increasing_id()), "forms")
    padded = F.concat(F.lit("^" * (ORDER - 1)), "form")
    gram = F.explode(F.regexp_extract_all(padded, F.lit("(?=(.{%d}))" % ORDER), F.lit(1)))  # walks the url once
    each = forms.where("form != ''").select("number", "accepted", "rejected", gram.alias("gram"))
    types = scratch.keep(each.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "grams")
    both = types.agg(F.coalesce(F.max("accepted"), F.lit(0)), F.coalesce(F.max("rejected"), F.lit(0))).first()
    ratios = gram_ratios(types) if both[0] and both[1] else types.select("gram", F.lit(0.0).alias("ratio"))
    ratios = scratch.keep(ratios, "ratios")
    scored = each.join(broadcast_if_small(ratios), "gram").groupBy("number").agg(F.avg("ratio").alias("ratio"))
    scored = scratch.keep(forms.join(scored, "number", "left").select("form", "accepted", "rejected", F.coalesce("ratio", F.lit(0.0)).alias("ratio")), "scored")

    moments = []
    for c in ("accepted", "rejected"):
        n, x = F.sum(c), F.col("ratio")
        moments += [n.alias(f"n_{c}"), F.try_divide(F.sum(F.col(c) * x), n).alias(f"m_{c}"), F.try_divide(F.sum(F.col(c) * x * x), n).alias(f"s_{c}")]
    m = scored.where("accepted + rejected > 0").agg(*moments).first()
    threshold = 0.0
    if m["n_accepted"] and m["n_rejected"]:
        sd = {c: max(0.0, m[f"s_{c}"] - m[f"m_{c}"] ** 2) ** 0.5 + 1e-9 for c in ("accepted", "rejected")}
        threshold = (m["m_accepted"] * sd["rejected"] + m["m_rejected"] * sd["accepted"]) / (sd["accepted"] + sd["rejected"])
    by_form = scored.select(F.col("form").alias(form_), "ratio")
    out = parts.join(broadcast_if_small(by_form), form_, "left")
    verdict = F.coalesce(by_rule_, F.when(F.col("ratio") >= threshold, "allow").otherwise("block"))
    return out.select(*rest, "host", "path", "rule", verdict.alias("verdict"), "ratio")
