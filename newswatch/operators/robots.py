"""Robots rules of sites and the fetch decision per url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswatch.functions.text import strip
from newswatch.functions.urls import path, query, site


def robots_lines(files: DataFrame) -> DataFrame:
    """(site, pos, field, value) of the lines that count; comments are cut off.

    ``files`` has one row per site: ``site`` (scheme and host) and ``text``.
    """
    lines = files.select("site", F.posexplode(F.split("text", "\r\n|[\n\r\u000b\u000c]")).alias("pos", "raw"))
    line = strip(F.substring_index("raw", "#", 1))
    split = lines.withColumn("line", line).where(F.col("line").contains(":"))
    colon = F.instr("line", ":")
    fields = split.select(
        "site",
        "pos",
        F.lower(strip(F.substring_index("line", ":", 1))).alias("field"),
        strip(F.substr("line", colon + 1)).alias("value"),
    )
    return fields.where(F.col("field").isin("user-agent", "allow", "disallow"))


def robots_groups(files: DataFrame) -> DataFrame:
    """The same lines with the number of their group; rules before any agent are group 0.

    Agents in a row share a group; an agent after a rule starts the next. The
    windows run over the lines of one file.
    """
    order = Window.partitionBy("site").orderBy("pos")
    is_agent = F.col("field") == "user-agent"
    after_rule = F.coalesce(F.lag("field").over(order) != "user-agent", F.lit(True))
    starts = robots_lines(files).withColumn("starts", (is_agent & after_rule).cast("int"))
    return starts.withColumn("group", F.sum("starts").over(order)).drop("starts")


def rule_parts(value: Column) -> tuple[Column, Column]:
    """A rule's literal parts between ``*`` and whether a last ``$`` ties it to the end.

    Closing ``*`` say nothing and are dropped, so a rule of one part without ``$`` is a plain prefix.
    """
    ends = value.endswith("$")
    stem = F.when(ends, F.substr(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    return F.split(F.rtrim(stem, F.lit("*")), r"\*", -1), ends & ~stem.endswith("*")


def matches(target: Column, rule: Column) -> Column:
    """Whether a rule with wildcards or an end fits: each part is looked for behind the one before it.

    The first place is always the right one to take, so no pattern is compiled and nothing is tried twice.
    """
    parts, ends = rule["parts"], rule["ends"]
    first, last, many = F.get(parts, F.lit(0)), F.element_at(parts, -1), F.size(parts) > 1
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - F.when(ends, 2).otherwise(1), F.lit(0)))

    def place(at: Column, part: Column) -> Column:
        found = F.when(at > 0, F.position(part, target, at)).otherwise(0)
        return F.when(part == "", at).when(found > 0, found + F.length(part)).otherwise(0)

    at = F.aggregate(inner, F.length(first) + 1, place)
    fits_end = ~ends | (F.endswith(target, last) & (F.length(target) - F.length(last) + 1 >= at))
    return F.when(many, F.startswith(target, first) & (at > 0) & fits_end).otherwise(target == first)


def site_rules(files: DataFrame, user_agent: str) -> DataFrame:
    """One row per site: its rules for the agent, strongest first, plain prefixes apart from the others.

    Groups naming the agent win over ``*`` groups. The longest pattern is the
    strongest, the later one of equals. A site's arrays are bounded by its file.
    """
    grouped = robots_groups(files).where(F.col("group") > 0)
    in_group = Window.partitionBy("site", "group")
    is_agent = F.col("field") == "user-agent"
    agent = F.lower("value")
    named = is_agent & (agent != "*") & F.lit(user_agent.lower()).contains(agent)
    rules = grouped.withColumns(
        {"named": F.max(named).over(in_group), "wildcard": F.max(is_agent & (agent == "*")).over(in_group)}
    ).where(~is_agent & (F.col("named") | F.col("wildcard")))
    parts, ends = rule_parts(F.col("value"))
    rule = F.when(
        F.col("value") != "",
        F.struct(
            F.length("value").alias("strength"),
            "pos",
            (F.col("field") == "allow").alias("allow"),
            parts.alias("parts"),
            ends.alias("ends"),
        ),
    )
    per_site = rules.groupBy("site").agg(
        F.max("named").alias("any_named"),
        F.count_if("named").alias("n_named"),
        F.collect_list(F.when(F.col("named"), rule)).alias("named_rules"),
        F.collect_list(F.when(~F.col("named"), rule)).alias("wildcard_rules"),
    )
    chosen = F.when(F.col("n_named") > 0, F.col("named_rules")).otherwise(F.col("wildcard_rules"))
    ordered = per_site.select("site", F.sort_array(chosen, asc=False).alias("rules"))
    prefixes = F.transform(
        F.filter("rules", is_prefix), lambda r: F.struct(r["strength"], r["pos"], r["allow"], F.get(r["parts"], F.lit(0)).alias("prefix"))
    )
    return ordered.select("site", prefixes.alias("prefixes"), F.filter("rules", lambda r: ~is_prefix(r)).alias("others"))


def is_prefix(rule: Column) -> Column:
    return (F.size(rule["parts"]) == 1) & ~rule["ends"]


def fetch_decisions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``allowed`` to rows with a ``url``.

    Each url meets its site's rule arrays, so urls and rules are never paired
    up; plain prefixes are compared as such, and no rule is a regular expression.
    No rules or no match means allowed.
    """
    target = F.coalesce(F.nullif(path(F.col("url")), F.lit("")), F.lit("/"))
    asked = query(F.col("url"))
    full = F.when(asked != "", F.concat(target, F.lit("?"), asked)).otherwise(target)
    joined = urls.withColumn("site", site(F.col("url"))).join(rules, "site", "left").withColumn("target", full)
    plain = F.filter("prefixes", lambda r: F.startswith(F.col("target"), r["prefix"]))
    others = F.filter("others", lambda r: matches(F.col("target"), r))
    best = [F.try_element_at(hits, F.lit(1)) for hits in (plain, others)]
    strongest = F.greatest(*[F.struct(b["strength"].alias("strength"), b["pos"].alias("pos"), b["allow"].alias("allow")) for b in best])
    return joined.withColumn("allowed", F.coalesce(strongest["allow"], F.lit(True))).drop("site", "prefixes", "others", "target")
