"""Monthly drift audit: repositories without a subcategory, clustered by shared topics."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..sources.tables import written

MIN_SIZE = 5
MIN_CONFIDENCE = 0.6
MIN_SCORE = 3.0
JACCARD = 0.6
#: Two clusters are near if they share this part of the larger one.  What is near neither
#: of two clusters can't reach JACCARD with their union.
NEAR = JACCARD / 2


def memberships(repos: DataFrame) -> DataFrame:
    """(token, full_name, category, confidence) with topics trimmed, in lower case, once for each repository."""
    tokens = F.array_distinct(F.filter(F.transform("topics", lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    return repos.select(F.explode(tokens).alias("token"), "full_name", F.col("primary_category").alias("category"), "confidence")


def candidates(members: DataFrame, least: int = MIN_SIZE) -> DataFrame:
    """Tokens that enough repositories have."""
    return members.groupBy("token").agg(F.count_distinct("full_name").alias("size")).filter(F.col("size") >= least)


def overlaps(members: DataFrame, tokens: DataFrame) -> DataFrame:
    """Common repositories and Jaccard overlap of token pairs, from tokens that meet in a repository."""
    kept = members.join(tokens.select("token"), "token", "left_semi").select("token", "full_name").distinct()
    both = kept.alias("a").join(kept.alias("b"), F.col("a.full_name") == F.col("b.full_name")).filter("a.token < b.token")
    common = both.groupBy(F.col("a.token").alias("token_a"), F.col("b.token").alias("token_b")).agg(F.count(F.lit(1)).alias("common"))
    out = common.join(tokens.select(F.col("token").alias("token_a"), F.col("size").alias("size_a")), "token_a")
    out = out.join(tokens.select(F.col("token").alias("token_b"), F.col("size").alias("size_b")), "token_b")
    union = F.col("size_a") + F.col("size_b") - F.col("common")
    return out.select("token_a", "token_b", "common", union.alias("union_size"), (x.double(F.col("common")) / x.double(union)).alias("jaccard"))


def token_components(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """(token, component) over pairs that share a repository; the component is its smallest token.

    Tokens that share nothing can't merge, neither before nor after other merges.  In each round every
    tree hooks on the smallest label that one of its members sees, and then all labels skip a step to
    their root, so long chains take a logarithmic number of rounds.
    """
    edges = written(pairs.select("token_a", "token_b").union(pairs.select("token_b", "token_a")), "edges")
    labels = written(tokens.select("token", F.col("token").alias("component")), "labels")
    changed = 1
    while changed:
        near = edges.join(labels, edges["token_b"] == labels["token"]).groupBy("token_a").agg(F.min("component").alias("near"))
        low = labels.join(near, labels["token"] == near["token_a"], "left").select("token", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        hooks = low.groupBy("component").agg(F.min("low").alias("hook"))
        hooked = written(low.join(hooks, "component").select("token", F.col("component").alias("was"), "hook"), "hooked")
        roots = hooked.select(F.col("token").alias("hook"), F.col("hook").alias("root"))
        new = written(hooked.join(roots, "hook").select("token", F.col("root").alias("component"), "was"), "labels")
        changed = new.filter("component <> was").count()
        labels = new.select("token", "component")
    return labels


def next_merges(near: list[tuple], after: tuple | None) -> list[tuple]:
    """The next merges (kept, absorbed) of one component in the order of the greedy scan, as far as they are certain.

    The scan takes clusters by rank, and for each the later ones in turn; a cluster that has
    absorbed one looks at all later ones again.  The scan begins anew until nothing merges.  near: (cluster,
    later cluster, their sizes, common) of near clusters, by ranks; after: the last merge.
    """
    size, common, beside = {}, {}, defaultdict(set)
    for i, j, n, m, both in near:
        size[i], size[j], common[i, j] = n, m, both
        beside[i].add(j)
        beside[j].add(i)
    ready = sorted((i, j) for (i, j), both in common.items() if both / (size[i] + size[j] - both) >= JACCARD)
    # clusters before the one of the last merge are looked at in the next pass
    ready = [x for x in ready if after is not None and x[0] >= after[0]] or ready
    out, gone, row = [], set(), None
    for i, j in ready:
        if i == row or i in gone or j in gone:
            continue
        out.append((i, j))
        gone.add(j)
        row = i
        union = size[i] + size[j] - common[i, j]
        for k in (beside[i] | beside[j]) - gone - {i}:
            # a pair that isn't near shares less than NEAR of its larger cluster
            share = sum(common.get((min(a, k), max(a, k)), NEAR * max(size[a], size[k])) for a in (i, j))
            share = min(share, size[k])
            if share >= JACCARD * (union + size[k] - share) * (1 - 1e-9):
                return out  # the grown cluster may absorb this one before the scan goes on: count again
    return out


def near_clusters(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Near clusters of each component, ranked by (-size of the first token, token)."""
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).join(ranks, "cluster")
    side = F.struct((-F.col("size")).alias("size"), "cluster")
    common = rows.alias("a").join(rows.alias("b"), "full_name").filter("a.cluster < b.cluster").groupBy(F.col("a.cluster").alias("a"), F.col("b.cluster").alias("b")).agg(F.count(F.lit(1)).alias("common"))
    out = common.join(sizes.select(F.col("cluster").alias("a"), side.alias("x"), F.col("n").alias("n_x"), "component"), "a")
    out = out.join(sizes.select(F.col("cluster").alias("b"), side.alias("y"), F.col("n").alias("n_y")), "b")
    return out.filter(F.col("common") >= F.lit(NEAR * (1 - 1e-9)) * F.greatest("n_x", "n_y")).select("component", "x", "y", "n_x", "n_y", "common")


MERGES = "component string, cluster string, into string, after struct<size:bigint,cluster:string>"


def _merges(rows: pd.DataFrame) -> pd.DataFrame:
    """The next merges of one component and the kept cluster of the last one, by ``next_merges``."""
    pair = lambda r: (r["size"], r["cluster"])
    near = []
    for x_, y_, n_x, n_y, common in zip(rows["x"], rows["y"], rows["n_x"], rows["n_y"], rows["common"], strict=True):
        (i, n), (j, m) = sorted(((pair(x_), int(n_x)), (pair(y_), int(n_y))))
        near.append((i, j, n, m, int(common)))
    after = rows["after"].iloc[0]
    merges = next_merges(near, None if after is None else (pair(after), None))
    out = [(rows["component"].iloc[0], j[1], i[1], {"size": merges[-1][0][0], "cluster": merges[-1][0][1]}) for i, j in merges]
    return pd.DataFrame(out, columns=["component", "cluster", "into", "after"])


def merged_tokens(members: DataFrame, tokens: DataFrame, components: DataFrame) -> DataFrame:
    """(token, cluster, n_tokens) after a greedy merge: larger clusters absorb those that overlap enough, until none does.

    Nothing but a number of merges comes to the driver.  Each round counts the common repositories of
    clusters, a task for each component picks its next merges from the near ones (a
    repository of k tokens is in k pairs of a cluster at most, so these grow with the tokens, not with
    the repositories), and only clusters of components that merged are looked at again.
    """
    ranks = written(tokens.select(F.col("token").alias("cluster"), "size").join(components.select(F.col("token").alias("cluster"), "component"), "cluster"), "ranks")
    rows = written(members.join(ranks.select(F.col("cluster").alias("token"), "component"), "token").select(F.col("token").alias("cluster"), "full_name", "component").distinct(), "rows")
    owner = written(ranks.select(F.col("cluster").alias("token"), "cluster"), "owner")
    last = members.sparkSession.createDataFrame([], "component string, after struct<size:bigint,cluster:string>")
    while True:
        near = near_clusters(rows.select("cluster", "full_name"), ranks).join(last, "component", "left")
        merges = written(near.groupBy("component").applyInPandas(_merges, MERGES), "merges")
        if not merges.count():
            break
        # a cluster that absorbs one in a round may itself be absorbed only in a later one
        into = merges.select("cluster", "into")
        moved = F.coalesce("into", "cluster").alias("cluster")
        last = merges.groupBy("component").agg(F.first("after").alias("after"))
        # components without a merge have reached their end
        rows = written(rows.join(last.select("component"), "component", "left_semi").join(into, "cluster", "left").select(moved, "full_name", "component").distinct(), "rows")
        owner = written(owner.join(into, "cluster", "left").select("token", moved), "owner")
    names = owner.groupBy("cluster").agg(F.min("token").alias("name"), F.count(F.lit(1)).alias("n_tokens"))
    # written, as in ``draft_repos``: the joins with memberships must know how small it is
    return written(owner.join(names, "cluster").select("token", F.col("name").alias("cluster"), "n_tokens"), "merged")


def clusters(members: DataFrame, merged: DataFrame) -> DataFrame:
    """Size, mean confidence, score, gate and main category of each cluster.

    Confidences are added as decimals, so that the mean doesn't depend on the partitioning.
    """
    own = members.join(merged, "token").select("cluster", "full_name", "category", "confidence").distinct()
    tokens = merged.groupBy("cluster").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    stats = own.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("repo_count"),
        F.when(F.count("confidence") == F.count(F.lit(1)), F.sum(F.col("confidence").cast("decimal(38,18)")).cast("double")).alias("total"),
    )
    counts = own.groupBy("cluster", "category").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("category")))["category"].alias("main"))
    out = stats.join(tokens, "cluster").join(main, "cluster").withColumn("avg_confidence", F.col("total") / x.double(F.col("repo_count")))
    out = out.withColumn("score", x.double(F.col("repo_count")) * F.col("avg_confidence"))
    steady = {k: F.round(F.col(k), 9) for k in ("avg_confidence", "score")}
    gate = (F.col("repo_count") >= MIN_SIZE) & (steady["avg_confidence"] >= F.lit(MIN_CONFIDENCE)) & (steady["score"] >= F.lit(MIN_SCORE))
    reason = (
        F.when(F.col("repo_count") < MIN_SIZE, "size_below_threshold").when(steady["avg_confidence"] < F.lit(MIN_CONFIDENCE), "avg_confidence_below_threshold")
        .when(steady["score"] < F.lit(MIN_SCORE), "score_below_threshold").otherwise("qualifies")
    )
    return out.select(
        "cluster", "tokens", "repo_count", "avg_confidence", "score", F.when(F.coalesce("main", F.lit("")) == "", "unknown").otherwise(F.col("main")).alias("category"),
        gate.alias("qualifies"), reason.alias("reason"), x.slug(F.col("tokens")).alias("subcategory"),
    )


def cluster_repos(repos: DataFrame) -> DataFrame:
    """Clusters of repositories (full_name, primary_category, topics, confidence), best first."""
    members = written(memberships(repos), "memberships")
    tokens = written(candidates(members), "tokens")
    parts = token_components(tokens, overlaps(members, tokens))
    out = clusters(members.join(tokens.select("token"), "token", "left_semi"), merged_tokens(members, tokens, parts))
    return out.orderBy(F.desc("score"), F.array_join("tokens", ","))


def share(candidates_n: DataFrame, denominator: DataFrame, limit: float = 3.0) -> DataFrame:
    """Share of drift candidates among active repositories, and whether it escalates (strictly above the limit)."""
    out = candidates_n.agg(F.count(F.lit(1)).alias("candidates")).crossJoin(denominator.agg(F.count(F.lit(1)).alias("corpus")))  # two single rows
    pct = F.when(F.col("corpus") == 0, F.lit(0.0)).otherwise(x.double(F.col("candidates")) * F.lit(100.0) / x.double(F.col("corpus")))
    return out.withColumn("share_pct", pct).withColumn("escalated", F.col("share_pct") > F.lit(limit))


def per_category(repos: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates and clusters of each category."""
    n = repos.groupBy(F.col("primary_category").alias("category")).agg(F.count(F.lit(1)).alias("other_count"))
    c = found.groupBy("category").agg(F.count(F.lit(1)).alias("clusters"))
    return n.join(c, "category", "left").fillna(0, ["clusters"]).orderBy("category")


#: What later jobs match, the title's beginning and the gate labels.
TITLE = "Subcat graduation proposal: "
BREACH, PASS = "BREACH >3% [CRITICAL]", "PASS <=3%"


#: Why a cluster is only watched, by the first gate that it fails; %s are its size, and its figure with two decimals.
DETAILS = {
    "size_below_threshold": "%s repos — too small to graduate, monitor next month.",
    "avg_confidence_below_threshold": "%s repos but avg_confidence %s < 0.60 — too uncertain to graduate.",
    "score_below_threshold": "%s repos, score %s < 3.00 — surface only.",
}


def watch_details(found: DataFrame) -> DataFrame:
    """cluster, reason and detail of the clusters that don't qualify."""
    two = lambda c: F.replace(F.format_number(c, 2), F.lit(","), F.lit(""))
    figure = {"size_below_threshold": [], "avg_confidence_below_threshold": [two("avg_confidence")], "score_below_threshold": [two("score")]}
    detail = F.lit("")
    for reason, text in DETAILS.items():
        detail = F.when(F.col("reason") == reason, F.format_string(text, F.col("repo_count").cast("string"), *figure[reason])).otherwise(detail)
    return found.filter("NOT qualifies").select("cluster", "reason", detail.alias("detail"))


def drafts(found: DataFrame) -> DataFrame:
    """Title and body of a proposal for each qualifying cluster; the body is its figures as JSON."""
    figures = F.to_json(F.struct("tokens", "repo_count", F.round("avg_confidence", 2).alias("avg_confidence"), F.round("score", 2).alias("score")))
    return found.filter("qualifies").select(F.concat(F.lit(TITLE), "category", F.lit("/"), "subcategory").alias("title"), figures.alias("body"), "category", "subcategory")


def draft_repos(found: DataFrame, members: DataFrame) -> DataFrame:
    """(title, full_name, confidence): the repositories that a proposal is about, a row each.

    The tokens are written, so that their size is known: by the sizes of what they are made from,
    the memberships of a small file would be taken for the smaller side and sent whole to each task.
    """
    tokens = found.filter("qualifies").select(F.concat(F.lit(TITLE), "category", F.lit("/"), "subcategory").alias("title"), F.explode("tokens").alias("token"))
    return members.join(written(tokens, "tokens"), "token").select("title", "full_name", "confidence").distinct()


def not_filed_lately(proposals: DataFrame, issues: DataFrame, now_s: int, days: int = 60) -> DataFrame:
    """Proposals without an issue of the last days whose title starts with theirs.

    A title is as long as an issue tracker allows, so its beginnings are few rows.
    """
    recent = issues.filter(F.col("created_s") > now_s - days * x.DAY).select(F.col("title").alias("_t"))
    low, high = proposals.agg(F.min(F.length("title")), F.max(F.length("title"))).first()
    if low is None:
        return proposals
    # beginnings of issue titles, of the lengths that proposals have, so that a prefix match is an equi-join
    lengths = F.sequence(F.lit(max(low, 1)), F.least(F.lit(high), F.length("_t")))
    begins = recent.filter(F.length("_t") >= max(low, 1)).select(F.explode(F.transform(lengths, lambda n: F.substring("_t", F.lit(1), n))).alias("title")).distinct()
    return proposals.join(begins, "title", "left_anti")


def report(found: DataFrame, categories: DataFrame, totals: DataFrame, day: str) -> DataFrame:
    """The report as ordered lines (section, ord, line) of JSON; sections keep their rows sorted."""
    def lines(rows: DataFrame, section: int, order, *fields) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), order.alias("ord"), F.to_json(F.struct(*fields)).alias("line"))

    gate = F.when(F.col("escalated"), BREACH).otherwise(PASS).alias("gate")
    name = F.concat("category", F.lit("/"), "subcategory")
    rounded = [F.round(c, 2).alias(c) for c in ("avg_confidence", "score")]
    out = lines(totals, 0, F.lit(""), F.lit(day).alias("day"), "corpus", "candidates", F.round("share_pct", 2).alias("share_pct"), gate)
    out = out.union(lines(categories, 1, F.col("category"), "category", "other_count", "clusters"))
    out = out.union(lines(found.filter("qualifies"), 2, name, name.alias("filed"), "repo_count", "tokens", *rounded))
    out = out.union(lines(found.filter("NOT qualifies"), 3, name, name.alias("watched"), "repo_count", "tokens", *rounded, "reason"))
    return out.orderBy("section", "ord")


def audit_other_drift(read: Callable[[], tuple[DataFrame, DataFrame]], file: Callable[[DataFrame], None] | None, issues: DataFrame, day: str, now_s: int) -> DataFrame:
    """The whole audit.  ``read`` gives candidates (full_name, primary_category, topics,
    confidence) and the active repositories; ``file`` gets the proposals that are new."""
    rows, active = read()
    found = written(cluster_repos(rows), "clusters")
    if file is not None:
        file(not_filed_lately(drafts(found), issues, now_s))
    return report(found, per_category(rows, found), share(rows, active), day)
