"""Searches over groups and tabs."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph_views import exploded_groups


def parse_query(query: str) -> dict[str, list[str]]:
    """{tags, domains, terms} of the explorer's language: #tag, @domain, words."""
    q = query.lower().strip()
    return {"tags": re.findall(r"#([a-z0-9_-]+)", q), "domains": re.findall(r"@([a-z0-9_.-]+)", q), "terms": re.sub(r"[#@][a-z0-9_.-]+", " ", q).split()}


def parse_panel_query(query: str) -> tuple[str | None, str | None, str]:
    """(keyword, domain, rest) of the panel's language: the first #word, the first @word, and what is left."""
    q = query.lower()
    keyword, domain = re.search(r"#(\w+)", q, re.A), re.search(r"@(\w+)", q, re.A)
    return (keyword and keyword[1]), (domain and domain[1]), re.sub(r"@\w+", "", re.sub(r"#\w+", "", q, flags=re.A), flags=re.A).strip()


def _fuzzy_scores(terms: list[str], least: float):
    """Mean over the terms of 1 where the text contains one and else of the best similarity of a word; null where a term is below ``least``."""

    @F.pandas_udf("double")
    def score(blobs: pd.Series, tokens: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}

        def ratio(term: str, token: str) -> float:
            if (term, token) not in known:
                if len(known) > 1_000_000:
                    known.clear()
                known[term, token] = SequenceMatcher(None, term, token).ratio()
            return known[term, token]

        def one(blob: str, words) -> float | None:
            total = 0.0
            for term in terms:
                found = 1.0 if term in blob else max((ratio(term, t) for t in words), default=0.0)
                if found < least:
                    return None
                total += found
            return total / len(terms)

        return pd.Series([one(b, w) for b, w in zip(blobs, tokens)], dtype="float64")

    return score


def _has_keyword(tag: str) -> Column:
    return F.exists("keywords", lambda k: k.contains(tag))


def search_groups(meta: DataFrame, query: str, least: float = 0.45) -> DataFrame:
    """(group_id, size, label, score): any domain, all tags, and every term either a substring of the group's text or similar to one of its words.

    The cheap predicates filter first; what is left is scored once, for all terms together.
    """
    asked = parse_query(query)
    rows = meta
    if asked["domains"]:
        cond = F.lit(False)
        for d in asked["domains"]:
            cond = cond | F.col("domain").contains(d) | F.col("blob").contains(d)
        rows = rows.where(cond)
    for tag in asked["tags"]:
        rows = rows.where(_has_keyword(tag))
    if not asked["terms"]:
        return rows.select("group_id", "size", "label", F.lit(1.0).alias("score"))
    inside = F.lit(True)
    for term in asked["terms"]:
        inside = inside & F.col("blob").contains(term)
    rows = rows.withColumn("score", F.when(inside, 1.0).otherwise(_fuzzy_scores(asked["terms"], least)("blob", "tokens")))
    return rows.where(F.col("score").isNotNull() & ~F.isnan("score")).select("group_id", "size", "label", "score")


def ordered_results(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("score"), F.desc("size"), F.desc("label"), "group_id")


def search_panel_groups(groups: DataFrame, tabs: DataFrame, query: str) -> DataFrame:
    """(group_id, size): groups that satisfy each predicate by any of their tabs, not necessarily the same one."""
    keyword, domain, rest = parse_panel_query(query)
    rows = exploded_groups(groups).join(tabs.select(F.col("id").alias("tab_id"), F.coalesce("domain", F.lit("")).alias("domain"), "keywords", F.lower(F.coalesce("title", F.lit(""))).alias("t"), F.lower(F.coalesce("url", F.lit(""))).alias("u")), "tab_id")
    kept = groups.select(F.col("id").alias("group_id"), F.coalesce(F.size("tab_ids"), F.lit(0)).alias("size"), F.lower(F.coalesce("label", F.lit(""))).alias("l"))
    if domain:
        kept = kept.join(rows.where(F.col("domain").contains(domain)), "group_id", "left_semi")
    if keyword:
        kept = kept.join(rows.where(F.exists("keywords", lambda k: k.contains(keyword))), "group_id", "left_semi")
    if rest:
        by_tab = rows.where(F.col("t").contains(rest) | F.col("u").contains(rest)).select("group_id", F.lit(True).alias("hit")).distinct()
        kept = kept.join(by_tab, "group_id", "left").where(F.col("hit") | F.col("l").contains(rest))
    return kept.select("group_id", "size")


def panel_order(found: DataFrame) -> DataFrame:
    """The panel's order of groups: the largest first, equal ones by id."""
    return found.orderBy(F.desc("size"), "group_id")


def search_panel_tabs(tabs: DataFrame, query: str) -> DataFrame:
    """(id) of primaries that satisfy all predicates."""
    keyword, domain, rest = parse_panel_query(query)
    rows = tabs.where("duplicate_of is null")
    if domain:
        rows = rows.where(F.col("domain").contains(domain))
    if keyword:
        rows = rows.where(F.exists("keywords", lambda k: k.contains(keyword)))
    if rest:
        rows = rows.where(F.lower(F.coalesce("title", F.lit(""))).contains(rest) | F.lower(F.coalesce("url", F.lit(""))).contains(rest))
    return rows.select("id")
