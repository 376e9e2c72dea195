"""URL filters: host and path rules, and a path-template tree per host judged by smoothed labelled purity.

Segments with digits, hex runs or the like become lexical wildcards at once, so the tree is built over the distinct
templates of a host, not over its pages. Level by level, siblings whose share of blocked pages does not differ significantly
from that of all siblings merge into one wildcard branch; the rest keep their names. A template's purity is its share of
blocked pages among its labelled ones, smoothed by its host's share and that by the share of all labelled pages; a template
with more than half is rejected. Labels are the verdicts of the rules by default, or a given table (page_id, blocked). Pages
without a label count nowhere: not in shares, errors, least sizes or smoothing.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged with all others of that kind;
repeated rows count as often as they occur; without labels all templates pass; paths of any depth are read to
their last segment; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from receptorium.llm.shared import written

# The rules that the contract of op9 names, as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
STRENGTH = 10.0
DIFFERENT = 2.58  # standard errors
LEAST = 5  # labelled pages of a branch that may keep its name against the pooled share

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, host and path of every url."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    whole = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(whole, r"^[^/?#]*", 0)
    return pages.select("page_id", F.translate(host, _UPPER, _LOWER).alias("host"),
                        F.regexp_extract(whole, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """All path segments, with lexical wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"^\d+(\.\w{1,5})?$"), F.lit("{n}"))
                       .when(s.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), F.lit("{hex}"))
                       .when(s.rlike(r"\d"), F.regexp_replace(s, r"\d+", "{n}")).otherwise(s))


def templates(judged: DataFrame) -> DataFrame:
    """(host, lexical, template): where each lexical template of a host stands in the host's tree. ``judged``: host, lexical
    (segments), n labelled pages, b of them blocked.

    A branch is open while its labelled pages are of both kinds and enough to tell children apart. Below a closed branch no child
    could keep its name, so all further segments are wildcards at once; the levels end with the last open branch."""
    size, node = F.size("lexical"), ["host", "template"]
    placed, done, level = judged.withColumn("template", F.array().cast("array<string>")), [], 0
    while True:
        whole = placed.groupBy(*node).agg(F.sum("n").alias("_all"), F.sum("b").alias("_blocked"))
        at = written(placed.join(whole, node), "level")
        open_ = (size > level) & (F.col("_all") >= LEAST) & (F.col("_blocked") > 0) & (F.col("_blocked") < F.col("_all"))
        rest = F.array_repeat(F.lit("*"), F.greatest(size - level, F.lit(0)))
        done.append(at.filter(~open_).withColumn("template", F.concat("template", rest)).select(*judged.columns, "template"))
        more = at.filter(open_)
        if more.isEmpty():
            break
        more = more.withColumn("_child", F.get("lexical", F.lit(level)))
        child = more.groupBy(*node, "_child").agg(F.sum("n").alias("_n"), F.sum("b").alias("_b"), F.first("_all").alias("_all"), F.first("_blocked").alias("_blocked"))
        share = F.col("_blocked") / F.col("_all")
        own = (F.col("_n") >= LEAST) & (F.abs(F.try_divide("_b", "_n") - share) > DIFFERENT * F.sqrt(F.try_divide(share * (1 - share), F.col("_n"))))
        named = child.select(*node, "_child", F.when(own, F.col("_child")).otherwise(F.lit("*")).alias("_name"))
        placed = more.join(named, [*node, "_child"]).withColumn("template", F.concat("template", F.array("_name"))).select(*judged.columns, "template")
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return written(out, "templates")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labels: DataFrame | None = None,
          strength: float = STRENGTH, unfitted: int | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template and purity. ``unfitted``: the label of pages that no rule fits
    where the rules' verdicts are the labels (0 clean, 1 blocked, None no label)."""
    parts = with_parts(pages).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("lexical", segments(F.col("path")))
    blocking = [r for v, r in rules if v == "block"]
    by_rule = F.coalesce(F.col("rule").isin(blocking), F.lit(False))
    if labels is None:
        counted = parts.withColumn("_bad", F.when(F.col("rule").isNull(), F.lit(unfitted).cast("long")).otherwise(by_rule.cast("long")))
    else:
        own = labels.groupBy("page_id").agg(F.max(F.col("blocked").cast("long")).alias("_bad"))
        counted = parts.join(own, "page_id", "left")
    lexical = counted.groupBy("host", "lexical").agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("b"))
    placed = templates(lexical)
    bad, many = placed.agg(F.sum("b"), F.sum("n")).first()
    everywhere = ((bad or 0) + 1.0) / ((many or 0) + 2.0)
    of_host = placed.groupBy("host").agg(F.sum("n").alias("_n"), F.sum("b").alias("_b")).select(
        "host", ((F.col("_b") + strength * everywhere) / (F.col("_n") + strength)).alias("_prior"))
    of_template = placed.groupBy("host", "template").agg(F.sum("n").alias("_n"), F.sum("b").alias("_b")).join(of_host, "host").select(
        "host", "template", ((F.col("_b") + strength * F.col("_prior")) / (F.col("_n") + strength)).alias("purity"))
    scored = placed.select("host", "lexical", "template").join(of_template, ["host", "template"])
    verdict = (F.when(by_rule, F.lit("block")).when(F.col("rule").isNotNull(), F.lit("allow"))
               .when(F.col("purity") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return parts.join(scored, ["host", "lexical"]).select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
