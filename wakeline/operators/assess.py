"""Policy over affected entrypoints: tier of each path by its seed's role, best path by tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, keys
from .impact import in_locale_order


def seed_roles(base_files: DataFrame, head_files: DataFrame) -> DataFrame:
    """The role of each path; head's overrides base's."""
    old = base_files.select("path", F.struct("technical_role", "technical_role_reason").alias("old"))
    new = head_files.select("path", F.struct("technical_role", "technical_role_reason").alias("new"))
    return old.join(new, "path", "full_outer").select("path", F.coalesce("new", "old").alias("role"))


def assess(items: DataFrame, roles: DataFrame) -> DataFrame:
    """Affected pages and APIs with tier, deciding path, reason and supporting paths, in rank order.

    items: rows of impact.best. Every supporting path is judged by the role of
    the file it starts from; a seed without a role is unknown.
    """
    rows = items.filter(F.col("kind").isin("page", "api_route")).select("*", F.explode("supporting_paths").alias("s")).drop("impact", "dependency_path", "supporting_paths")
    rows = rows.select("*", F.col("s.impact").alias("impact"), F.col("s.dependency_path").alias("dependency_path"), F.element_at("s.dependency_path", 1).alias("changed_seed_path")).drop("s")
    own = roles.select(F.col("path").alias("changed_seed_path"), F.col("role.technical_role").alias("technical_role"), F.col("role.technical_role_reason").alias("technical_role_reason"))
    rows = rows.join(own, "changed_seed_path", "left").fillna({"technical_role": "unknown", "technical_role_reason": classify.UNKNOWN_ROLE[1]})
    rows = rows.withColumn("tier", classify.tier(F.col("technical_role"), F.col("impact") == "direct"))
    order = F.struct(
        classify.tier_rank(F.col("tier")).alias("tier_rank"), (F.col("impact") != "direct").cast("int").alias("indirect"), F.size("dependency_path").alias("length"),
        F.col("dependency_path"), F.col("changed_seed_path"), F.col("tier"), F.col("impact"), F.col("technical_role"), F.col("technical_role_reason"),
    )
    key = [F.col("path"), F.col("kind"), *[c.alias(n) for c, n in zip(keys.or_empty("project_root", "route_path", "http_method"), ("project_root", "route_path", "http_method"), strict=True)]]
    grouped = rows.select(*key, order.alias("o")).groupBy("path", "kind", "project_root", "route_path", "http_method").agg(F.collect_set("o").alias("all"))
    order = ("tier_rank", "indirect", "length")
    grouped = grouped.withColumn("b", F.element_at(in_locale_order(F.col("all"), *order), 1)).withColumn("all", in_locale_order(F.col("all"), *order, by_seed=True))
    out = grouped.select(
        "path", "kind", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("project_root", "route_path", "http_method")],
        "b.tier", "b.impact", "b.changed_seed_path", "b.technical_role", "b.technical_role_reason", "b.dependency_path",
        F.transform("all", lambda s: F.struct(s["tier"].alias("tier"), s["impact"].alias("impact"), s["changed_seed_path"].alias("changed_seed_path"), s["technical_role"].alias("technical_role"), s["dependency_path"].alias("dependency_path"))).alias("supporting_paths"),
    )
    out = out.withColumn("reason", classify.policy_reason(F.col("tier"), F.col("technical_role"), F.col("changed_seed_path"), F.col("path"), F.size("dependency_path")))
    return out.orderBy(*rank_order())


def rank_order() -> list[Column]:
    """O2: assessed items by tier, direct ones first, shorter paths first, then by project, route and paths in the root locale's order."""
    root, route = keys.or_empty("project_root", F.coalesce("route_path", "path"))
    return [
        classify.tier_rank(F.col("tier")), (F.col("impact") != "direct").cast("int"), F.size("dependency_path"),
        keys.icu(root), keys.icu(route), keys.icu(F.col("path")), keys.icu(F.array_join("dependency_path", "")),
    ]
