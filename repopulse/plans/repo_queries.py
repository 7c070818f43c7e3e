"""Queries over the repos table, its maintenance, classification and the drift audit."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import exprs as x
from ..functions import taxonomy
from ..operators import audit, classification, health, scans
from ..operators import repository as r
from ..sources import sinks
from ..sources.tables import delete_keys, evolve, insert_ignore, merge_upsert, read_repos, shared_folder, update_where, with_outcomes
from ..sources.views import NOW
from .registry import query

LIVE = "excluded = 0"


@query("f13_repos_by_name", f"SELECT full_name, status, primary_category FROM repos WHERE {LIVE}")
def _(t):
    return t.repos.filter("excluded = 0").orderBy("full_name").select("full_name", "status", "primary_category")


_MISSING = {"bigint": ("open_issues", "open_prs"), "double": ("normalized_growth_score", "star_acceleration", "pr_velocity", "issue_velocity", "contributor_growth"),
    "varchar": ("latest_release", "latest_release_date", "created_at", "first_seen_at", "last_collected_at", "etag", "last_modified", "model_used")}


@query("s5_fixed_columns", "SELECT id, full_name, owner, name, language, stars, stars_prev, forks, contributors, contributors_prev, growth_score, star_velocity, merged_prs_7d, new_issues_7d, status, primary_category, category_confidence, readme_hash, classified_at, force_category, CAST(excluded AS INTEGER) AS excluded, primary_subcategory, primary_category_legacy, force_subcategory, " + ", ".join(f"CAST(NULL AS {k}) AS {c}" for k, names in _MISSING.items() for c in names) + " FROM repos")
def _(t):
    """The repos table as other versions have written it, with more columns in another order, by the fixed ones."""
    path = f"{shared_folder(t.spark)}/repos-{uuid.uuid4().hex}"
    rows = t.repos.drop("description").withColumns({"excluded": F.col("excluded").cast("int"), "a_later_column": F.lit(1)})
    rows.select(*sorted(rows.columns)).write.parquet(path)
    return read_repos(t.spark, path)


@query("f13b_by_pair", f"SELECT full_name, primary_subcategory FROM repos WHERE {LIVE} AND primary_category = 'ai' AND primary_subcategory = 'agents' UNION ALL SELECT full_name, primary_category_legacy FROM repos WHERE {LIVE} AND primary_category_legacy = 'rag'")
def _(t):
    live = t.repos.filter("excluded = 0")
    pair = live.filter("primary_category = 'ai' AND primary_subcategory = 'agents'").select("full_name", "primary_subcategory")
    return pair.union(live.filter("primary_category_legacy = 'rag'").select("full_name", "primary_category_legacy"))


@query("f13c_needs_classification", f"""SELECT full_name FROM repos WHERE {LIVE} AND force_category = '' AND (primary_category = '' OR status IN ('needs_reclassify', 'needs_review') OR (status = 'pending' AND classified_at = ''))""")
def _(t):
    return t.repos.filter(r.needs_classification()).select("full_name")


@query("f13d_classified", f"SELECT full_name, readme_hash FROM repos WHERE {LIVE} AND primary_category <> '' AND status = 'active' AND force_category = ''")
def _(t):
    return t.repos.filter(r.classified()).select("full_name", "readme_hash")


@query("f13e_drift_candidates", "SELECT full_name, primary_category, category_confidence AS confidence FROM repos WHERE primary_subcategory = 'other' AND is_curated_list = 0 AND status = 'active'")
def _(t):
    return r.drift_candidates(t.repos)


@query("f13f_lookup", "SELECT full_name, stars, status FROM repos WHERE full_name = (SELECT min(full_name) FROM repos)")
def _(t):
    first = t.repos.agg(F.min("full_name").alias("full_name"))
    return t.repos.join(F.broadcast(first), "full_name", "left_semi").select("full_name", "stars", "status")


@query("a11_status_counts", f"SELECT status, count(*) AS n FROM repos WHERE {LIVE} GROUP BY 1")
def _(t):
    return r.status_counts(t.repos)


@query("a12_pending_buckets", """WITH s(is_excluded, forced) AS (VALUES (false, false), (false, true), (true, false), (true, true))
SELECT s.is_excluded, s.forced, count(id) AS n FROM s LEFT JOIN (SELECT * FROM repos WHERE status = 'pending') p ON (p.excluded <> 0) = s.is_excluded AND (p.force_category <> '') = s.forced GROUP BY 1, 2""")
def _(t):
    return r.pending_buckets(t.repos)


@query("a13_scalar_counts", f"""SELECT count(*) AS repos, count(*) FILTER (WHERE {LIVE} AND status = 'needs_reclassify') AS needs_reclassify, count(*) FILTER (WHERE {LIVE} AND status = 'active' AND is_curated_list = 0) AS active_not_curated,
 coalesce(max(nullif(classified_at, '')), '') AS last_classified_at FROM repos""")
def _(t):
    return r.scalar_counts(t.repos)


@query("a15_category_counts", "SELECT primary_category AS category, count(*) AS n FROM repos GROUP BY 1")
def _(t):
    return t.repos.groupBy(F.col("primary_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


_DRAIN = f"{LIVE} AND status = 'needs_reclassify' AND primary_category <> '' AND primary_subcategory <> '' AND primary_category <> 'other' AND needs_review = 0"


@query("a16_drain_report", f"""WITH c AS (SELECT count(*) FILTER (WHERE {LIVE} AND status = 'needs_reclassify') AS examined, count(*) FILTER (WHERE {LIVE} AND status = 'needs_reclassify' AND primary_category = 'other' AND needs_review = 1) AS held_in_sink,
 least(count(*) FILTER (WHERE {_DRAIN}), 20) AS drained FROM repos) SELECT *, greatest(0, examined - drained - held_in_sink) AS held_other FROM c""")
def _(t):
    return r.drain_report(t.repos, 20)


@query("t7_drain_categories", f"SELECT primary_category AS category, count(*) AS n FROM repos WHERE {_DRAIN} GROUP BY 1 ORDER BY n DESC, category")
def _(t):
    return r.drain_by_category(t.repos)


@query("m8_drain", f"SELECT id, CASE WHEN id IN (SELECT id FROM repos WHERE {_DRAIN} ORDER BY id LIMIT 20) THEN 'active' ELSE status END AS status FROM repos")
def _(t):
    return r.drain(t.repos, 20).select("id", "status")


_LEGACY = ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in taxonomy.LEGACY.items())
_PAIRS = ", ".join(f"('{c}/{s}')" for c, subs in taxonomy.TAXONOMY.items() for s in subs)


@query("m9_backfill", f"""WITH lg(slug, c, s) AS (VALUES {_LEGACY}) SELECT id, CASE WHEN primary_subcategory = '' THEN primary_category ELSE primary_category_legacy END AS legacy,
 CASE WHEN primary_subcategory = '' THEN coalesce(c, 'other') ELSE primary_category END AS category, CASE WHEN primary_subcategory = '' THEN coalesce(s, 'other') ELSE primary_subcategory END AS subcategory,
 CASE WHEN primary_subcategory = '' AND primary_category IN ('other', '') THEN 1 ELSE needs_review END AS needs_review,
 CASE WHEN primary_subcategory = '' AND primary_category IN ('other', '') THEN 'backfill_legacy_other' ELSE '' END AS refusal FROM repos LEFT JOIN lg ON primary_category = slug""")
def _(t):
    b = r.backfill(t.repos)
    return b.select("id", F.col("primary_category_legacy").alias("legacy"), F.col("primary_category").alias("category"), F.col("primary_subcategory").alias("subcategory"), "needs_review", F.col("classification_refusal_reason").alias("refusal"))


@query("a32_orphan_guard", f"""WITH lg(slug, c, s) AS (VALUES {_LEGACY}), b AS (SELECT excluded, CASE WHEN primary_subcategory = '' THEN coalesce(c, 'other') ELSE primary_category END AS category,
 CASE WHEN primary_subcategory = '' THEN coalesce(s, 'other') ELSE primary_subcategory END AS subcategory FROM repos LEFT JOIN lg ON primary_category = slug)
SELECT count(*) FILTER (WHERE excluded = 0 AND (category = '' OR subcategory = '')) AS orphans FROM b""")
def _(t):
    return r.orphan_guard(r.backfill(t.repos))


@query("a32_orphans", f"SELECT full_name FROM repos WHERE {LIVE} AND (primary_category = '' OR primary_subcategory = '')")
def _(t):
    """The live rows that a guard would stop at before the backfill."""
    return t.repos.filter(r.is_orphan()).select("full_name")


@query("m11_evolved_repos", "SELECT id, full_name, owner, primary_category, 0 AS needs_audit, concat(owner, '@', CAST(id AS VARCHAR)) AS etag FROM repos")
def _(t):
    """Columns added with defaults and dropped; what is there already keeps its values, also when it runs again."""
    rows = t.repos.select("id", "full_name", "owner", "primary_category", "readme_hash", "classified_at")
    add = {"needs_audit": F.lit(0), "etag": F.concat("owner", F.lit("@"), F.col("id").cast("string")), "owner": F.lit("nobody")}
    return evolve(evolve(rows, add, ["readme_hash", "classified_at"]), add, ["readme_hash", "classified_at"])


@query("x22_resolved_taxonomy", f"""WITH lg(slug, c, s) AS (VALUES {_LEGACY}), pr(pair) AS (VALUES {_PAIRS}),
w AS (SELECT id, CASE WHEN force_category <> '' THEN force_category ELSE primary_category END AS raw, CASE WHEN force_category <> '' THEN force_subcategory ELSE primary_subcategory END AS sub, primary_category_legacy AS old FROM repos)
SELECT id, coalesce(c, raw) AS category, CASE WHEN c IS NOT NULL AND (sub = '' OR concat(c, '/', sub) NOT IN (SELECT pair FROM pr)) THEN s ELSE sub END AS subcategory, CASE WHEN c IS NOT NULL AND old = '' THEN raw ELSE old END AS legacy FROM w LEFT JOIN lg ON raw = slug""")
def _(t):
    return taxonomy.resolve(t.repos).select("id", "category", "subcategory", "legacy")


@query("j11_allowed_pairs", f"WITH pr(pair) AS (VALUES {_PAIRS}) SELECT id, concat(primary_category, '/', primary_subcategory) IN (SELECT pair FROM pr) AS allowed FROM repos")
def _(t):
    return t.repos.select("id", taxonomy.is_allowed(F.col("primary_category"), F.col("primary_subcategory")).alias("allowed"))


@query("m4_changed_hashes", f"""WITH f AS (SELECT full_name, concat('h', CAST((id * 3) % 10 AS VARCHAR)) AS h FROM repos WHERE id % 2 = 0),
j AS (SELECT repos.*, f.h, coalesce(repos.excluded = 0 AND primary_category <> '' AND status = 'active' AND force_category = '' AND readme_hash <> '' AND readme_hash <> f.h, false) AS hit FROM repos LEFT JOIN f ON repos.full_name = f.full_name)
SELECT full_name, CASE WHEN hit THEN h ELSE readme_hash END AS readme_hash, CASE WHEN hit THEN 'needs_reclassify' ELSE status END AS status FROM j""")
def _(t):
    fresh = t.repos.filter("id % 2 = 0").select("full_name", F.concat(F.lit("h"), ((F.col("id") * 3) % 10).cast("string")).alias("hash"))
    return r.changed_hashes(t.repos, fresh).select("full_name", "readme_hash", "status")


@query("m5_mark_all", f"SELECT id, CASE WHEN status = 'active' AND {LIVE} AND force_category = '' THEN 'needs_reclassify' ELSE status END AS status FROM repos")
def _(t):
    return update_where(t.repos, F.expr("status = 'active' AND excluded = 0 AND force_category = ''"), {"status": F.lit("needs_reclassify")}).select("id", "status")


@query("m6_set_excluded", "SELECT id, CASE WHEN id % 29 = 0 THEN 1 ELSE excluded END AS excluded FROM repos")
def _(t):
    return update_where(t.repos, F.col("id") % 29 == 0, {"excluded": F.lit(1)}).select("id", "excluded")


@query("m7_delete", "SELECT full_name FROM repos WHERE lower(full_name) NOT IN (SELECT lower(full_name) FROM tracked)")
def _(t):
    return delete_keys(t.repos, t.tracked, "full_name", any_case=True).select("full_name")


@query("m2_sync_scan", """WITH s AS (SELECT CASE WHEN id % 5 = 0 THEN concat(full_name, '-new') ELSE full_name END AS full_name, stars + 1 AS stars, forks + 2 AS forks FROM repos WHERE id % 3 = 0)
SELECT coalesce(r.full_name, s.full_name) AS full_name, coalesce(s.stars, r.stars) AS stars, coalesce(s.forks, r.forks) AS forks, CASE WHEN r.full_name IS NULL THEN 'pending' ELSE r.status END AS status FROM repos r FULL JOIN s ON r.full_name = s.full_name""")
def _(t):
    source = t.repos.filter("id % 3 = 0").select(F.when(F.col("id") % 5 == 0, F.concat("full_name", F.lit("-new"))).otherwise(F.col("full_name")).alias("full_name"), (F.col("stars") + 1).alias("stars"), (F.col("forks") + 2).alias("forks"))
    target = t.repos.select("full_name", "stars", "forks", "status")
    return merge_upsert(target, source, "full_name", ["stars", "forks"], {"status": F.lit("pending")})


@query("u4_known_repos", "SELECT full_name FROM repos WHERE id % 2 = 0 UNION SELECT full_name FROM candidates WHERE source = 'org'")
def _(t):
    return insert_ignore(t.repos.filter("id % 2 = 0"), t.candidates.filter("source = 'org'"), "full_name")


@query("u5_requested_minus_known", "SELECT full_name FROM candidates EXCEPT SELECT full_name FROM repos WHERE id % 4 = 0")
def _(t):
    return t.candidates.select("full_name").distinct().join(t.repos.filter("id % 4 = 0"), "full_name", "left_anti")


@query("u1_scan_set", """SELECT full_name, min(src) AS src FROM (SELECT full_name, 1 AS src FROM tracked UNION ALL SELECT full_name, 2 AS src FROM repos WHERE id % 3 = 0) WHERE split_part(full_name, '/', 1) NOT IN ('org0', 'org8', 'org16', 'org24') GROUP BY 1""")
def _(t):
    both = t.tracked.select("full_name", F.lit(1).alias("src")).union(t.repos.filter("id % 3 = 0").select("full_name", F.lit(2).alias("src")))
    banned = t.exclusions.filter("pattern LIKE 'org%/*'")
    from ..operators.discovery import excluded_names

    merged = both.groupBy("full_name").agg(F.min("src").alias("src"))
    return merged.join(excluded_names(merged, banned), "full_name", "left_anti")


@query("a27_merged_tracked", """WITH e AS (SELECT lower(full_name) AS k, full_name, pos, unnest(string_split(categories, ';')) AS c FROM tracked),
g AS (SELECT k, arg_min(full_name, pos) AS full_name, string_agg(DISTINCT c, ',' ORDER BY c) FILTER (WHERE c <> '') AS cs FROM e GROUP BY k) SELECT full_name, coalesce(cs, 'default') AS categories FROM g""")
def _(t):
    return r.merge_tracked(t.tracked).select("full_name", F.array_join("categories", ",").alias("categories"))


@query("a26_categories", "SELECT DISTINCT c AS category FROM (SELECT unnest(string_split(categories, ';')) AS c FROM tracked) WHERE c <> ''")
def _(t):
    return t.tracked.select(F.explode(F.split("categories", ";")).alias("category")).filter("category <> ''").distinct()


@query("f21_by_category", "SELECT full_name FROM tracked WHERE list_contains(string_split(categories, ';'), 'tools')")
def _(t):
    return t.tracked.filter(F.array_contains(F.split("categories", ";"), "tools")).select("full_name")


@query("x4_parsed_ids", """SELECT id, full_name AS parsed FROM repos""")
def _(t):
    forms = F.when(F.col("id") % 4 == 0, F.concat(F.lit("https://github.com/"), "full_name", F.lit(".git"))).when(F.col("id") % 4 == 1, F.concat(F.lit("github.com/"), "full_name", F.lit("/"))).otherwise(F.col("full_name"))
    return t.repos.select("id", x.parse_repo_id(forms).alias("parsed"))


@query("f22_carry_forward", "SELECT full_name, CASE WHEN id % 2 = 0 THEN stars + 5 ELSE stars END AS stars FROM repos")
def _(t):
    fresh = t.repos.filter("id % 2 = 0").select("full_name", (F.col("stars") + 5).alias("stars"))
    return scans.carry_forward(t.repos.select("full_name", "stars"), fresh, ["stars"])


@query("f20_partial_results", """SELECT full_name, CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN stars_prev ELSE stars END AS stars, CAST(id % 7 AS DOUBLE) AS star_velocity FROM repos""")
def _(t):
    rows = t.repos.select("full_name", "stars", (F.col("id") % 7).cast("double").alias("star_velocity"), (F.col("id") % 2 == 0).alias("partial"))
    before = t.repos.filter("id % 3 <> 0").select("full_name", F.col("stars_prev").alias("stars"))
    return scans.apply_partial(rows, before, ["stars"]).select("full_name", "stars", "star_velocity")


_OUTCOME = "CASE WHEN full_name IN (SELECT full_name FROM repos WHERE id % 10 = 3) THEN 'gone' WHEN full_name IN (SELECT full_name FROM repos WHERE id % 10 <> 7) THEN 'updated' ELSE 'failed' END"


def _outcomes(t):
    return with_outcomes(t.repos.select("full_name"), t.repos.filter("id % 10 <> 7 AND id % 10 <> 3"), t.repos.filter("id % 10 = 3"))


@query("j14_outcomes", f"SELECT full_name, {_OUTCOME} AS outcome FROM repos")
def _(t):
    return _outcomes(t)


@query("a25_scan_summary", f"SELECT count(*) AS total, count(*) FILTER (WHERE o = 'updated') AS updated, count(*) FILTER (WHERE o = 'failed') AS failed, count(*) FILTER (WHERE o = 'skipped') AS skipped, count(*) FILTER (WHERE o = 'gone') AS gone FROM (SELECT {_OUTCOME} AS o FROM repos)")
def _(t):
    return health.scan_summary(_outcomes(t))


@query("a28_cycle_summary", f"""SELECT count(*) AS total, count(*) FILTER (WHERE excluded <> 0) AS excluded, count(*) FILTER (WHERE {LIVE} AND status = 'active') AS active, count(*) FILTER (WHERE {LIVE} AND status = 'pending') AS pending,
 count(*) FILTER (WHERE {LIVE} AND status = 'needs_review') AS needs_review, count(*) FILTER (WHERE {LIVE} AND status = 'needs_reclassify') AS needs_reclassify, coalesce(max(nullif(classified_at, '')), '') AS last_classified_at FROM repos""")
def _(t):
    return health.cycle_summary(t.repos)


@query("j10_canary", "SELECT full_name, lower(trim(full_name)) IN (SELECT lower(trim(full_name)) FROM tracked) AS canary FROM repos")
def _(t):
    list_ = t.tracked.select(F.lower(F.trim("full_name")).alias("k")).filter("k <> ''").distinct().withColumn("canary", F.lit(True))
    rows = t.repos.withColumn("k", F.lower(F.trim("full_name"))).join(list_, "k", "left")
    return rows.select("full_name", F.coalesce("canary", F.lit(False)).alias("canary"))


_GAUGES = " UNION ALL ".join(f"SELECT '{metric}' AS metric, full_name, CAST({column} AS DOUBLE) AS value FROM repos WHERE excluded = 0" for metric, column in health.GAUGES.items())


@query("s13_repo_points", _GAUGES)
def _(t):
    points = health.repo_points(taxonomy.resolve(t.repos.filter("excluded = 0")))
    return points.select("metric", F.col("attributes")["full_name"].alias("full_name"), "value")


@query("s13b_health_points", f"SELECT 'repos.status' AS metric, status AS label, CAST(count(*) AS DOUBLE) AS value FROM repos WHERE {LIVE} GROUP BY status")
def _(t):
    points = health.health_points("repos.status", r.status_counts(t.repos), "status", "n")
    return points.select("metric", F.col("attributes")["status"].alias("label"), "value")


@query("s12_csv_rows", "SELECT full_name, array_to_string(string_split(topics_text, ' '), ';') AS topics, format('{:.1f}', growth_score) AS growth_score FROM repos")
def _(t):
    return sinks.csv_rows(t.repos.select("full_name", F.split("topics_text", " ").alias("topics"), "growth_score"), ["growth_score"])


@query("x6_readme_hashes", "SELECT id, CASE WHEN content = '' THEN '' ELSE sha256(content) END AS hash, length(substring(content, 1, 500)) AS kept FROM readmes")
def _(t):
    return t.readmes.select("id", x.content_hash(F.col("content")).alias("hash"), F.length(x.shortened(F.col("content"), 500)).cast("long").alias("kept"))


_CATS = ["kubernetes", "rag", "testing", "databases", "other"]


@query("x10_parsed_replies", """WITH p AS (SELECT id, CASE WHEN json_valid(raw) THEN lower(trim(json_extract_string(raw, '$.category'))) END AS c, CASE WHEN json_valid(raw) THEN CAST(json_extract(raw, '$.confidence') AS DOUBLE) END AS f, json_valid(raw) AS ok FROM responses)
SELECT id, CASE WHEN ok AND c IN ('kubernetes', 'rag', 'testing', 'databases', 'other') THEN c ELSE 'other' END AS category, CASE WHEN ok THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, f)) ELSE 0.0::DOUBLE END AS confidence,
 CASE WHEN ok AND greatest(0, least(1, f)) >= 0.6::DOUBLE THEN 'active' ELSE 'needs_review' END AS status FROM p""")
def _(t):
    rows = t.responses.select("id", x.parse_reply(F.col("raw"), _CATS).alias("p"))
    return rows.select("id", "p.category", "p.confidence", x.status_of(F.col("p.confidence"), 0.6).alias("status"))


@query("x9_prompts", """SELECT full_name, concat('[', full_name, '] ', description, ' (', language, ', ', replace(topics_text, ' ', ', '), ') ', CAST(stars AS VARCHAR), ' ',
 CASE WHEN star_velocity > 0 THEN 'rising' WHEN star_velocity < 0 THEN 'declining' ELSE 'stable' END, chr(10), substring(coalesce(content, ''), 1, 300)) AS prompt,
 'one of kubernetes, rag, testing, databases, other' AS system FROM repos LEFT JOIN readmes ON repos.id = readmes.id""")
def _(t):
    readmes = t.repos.select("id", "full_name").join(t.readmes, "id").select("full_name", "content")
    user = "[{full_name}] {description} ({language}, {topics}) {stars} {trend}\n{readme}"
    return classification.prompts(t.repos, readmes, 300, user, "one of {categories}", _CATS).select("full_name", "prompt", "system")


def _classified(t):
    readmes = t.repos.select("id", "full_name").join(t.readmes, "id").select("full_name", "content")
    return classification.classify(t.repos, readmes)


_ASKED = f"SELECT * FROM repos WHERE {LIVE} AND force_category = '' AND (primary_category = '' OR status IN ('needs_reclassify', 'needs_review') OR (status = 'pending' AND classified_at = ''))"
_RULE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(p, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in classification.KEYWORDS.items()) + " ELSE 'other' END"
_PROMPT = "lower(concat(q.full_name, '; ', language, '; ', replace(topics_text, ' ', ', '), '; ', CAST(stars AS VARCHAR), ', ', CASE WHEN star_velocity > 0 THEN 'rising' ELSE 'stable' END, chr(10), description, chr(10), chr(10), substring(coalesce(content, ''), 1, 2000)))"


@query("c7_classified", f"""WITH q AS ({_ASKED}), w AS (SELECT full_name, coalesce(content, '') AS content, {_PROMPT} AS p FROM q LEFT JOIN readmes ON q.id = readmes.id), c AS (SELECT full_name, content, {_RULE} AS category FROM w)
SELECT full_name, category, CASE WHEN category = 'other' THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END AS confidence, CASE WHEN content = '' THEN '' ELSE sha256(content) END AS hash, CASE WHEN category = 'other' THEN 'needs_review' ELSE 'active' END AS status FROM c""")
def _(t):
    return _classified(t).select("full_name", "category", "confidence", "hash", "status")


@query("m3_stored_classification", f"""WITH q AS ({_ASKED}), w AS (SELECT full_name, {_PROMPT} AS p FROM q LEFT JOIN readmes ON q.id = readmes.id), c AS (SELECT full_name, {_RULE} AS category FROM w)
SELECT repos.full_name, coalesce(c.category, primary_category) AS category, CASE WHEN c.category IS NULL THEN status WHEN c.category = 'other' THEN 'needs_review' ELSE 'active' END AS status FROM repos LEFT JOIN c ON repos.full_name = c.full_name""")
def _(t):
    return r.store_classification(t.repos, _classified(t), 0.6).select("full_name", F.col("primary_category").alias("category"), "status")


@query("a29_classification_summary", f"""WITH q AS ({_ASKED}), w AS (SELECT full_name, {_PROMPT} AS p FROM q LEFT JOIN readmes ON q.id = readmes.id), c AS (SELECT full_name, {_RULE} AS category, length(full_name) % 5 = 0 AS bad FROM w),
n AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT bad AND category <> 'other') AS classified, count(*) FILTER (WHERE NOT bad AND category = 'other') AS needs_review, count(*) FILTER (WHERE bad) AS failed FROM c)
SELECT *, CASE WHEN failed = 0 THEN 'success' WHEN classified > 0 THEN 'partial' ELSE 'failed' END AS result FROM n""")
def _(t):
    bad = F.length("full_name") % 5 == 0  # a classifier that gives nothing for some
    return classification.summary(_classified(t).withColumns({k: F.when(~bad, F.col(k)) for k in ("category", "status")}))


_MEMBERS = "SELECT DISTINCT unnest(string_split(lower(topics_text), ' ')) AS token, full_name, primary_category AS category, category_confidence AS confidence FROM repos"


def _audited(t):
    return t.repos.select("full_name", "primary_category", F.split("topics_text", " ").alias("topics"), F.col("category_confidence").alias("confidence"))


@query("a20_topic_index", f"SELECT token, count(DISTINCT full_name) AS size FROM ({_MEMBERS}) WHERE token <> '' GROUP BY 1 HAVING count(DISTINCT full_name) >= 5")
def _(t):
    return audit.candidates(audit.memberships(_audited(t)))


@query("a20b_overlaps", f"""WITH m AS ({_MEMBERS}), n AS (SELECT token, count(DISTINCT full_name) AS size FROM m WHERE token <> '' GROUP BY 1 HAVING count(DISTINCT full_name) >= 5),
p AS (SELECT a.token AS token_a, b.token AS token_b, count(*) AS common FROM m a JOIN m b ON a.full_name = b.full_name AND a.token < b.token WHERE a.token IN (SELECT token FROM n) AND b.token IN (SELECT token FROM n) GROUP BY 1, 2)
SELECT token_a, token_b, common, x.size + y.size - common AS union_size, CAST(common AS DOUBLE) / CAST(x.size + y.size - common AS DOUBLE) AS jaccard FROM p JOIN n x ON token_a = x.token JOIN n y ON token_b = y.token""")
def _(t):
    members = audit.memberships(_audited(t))
    return audit.overlaps(members, audit.candidates(members))


#: The greedy merge as it is told: one scan over clusters in order, again until a pass merges nothing; a step looks at one cluster or merges two.
_CLUSTERS = """WITH RECURSIVE m AS (SELECT DISTINCT unnest(string_split(lower(topics_text), ' ')) AS token, id, primary_category AS category, CAST(round(category_confidence * 100) AS BIGINT) AS cents FROM repos),
n AS (SELECT token, count(*) AS size, list(id ORDER BY id) AS ids FROM m WHERE token <> '' GROUP BY 1 HAVING count(*) >= 5),
scan AS (
  SELECT list({'t': [token], 'r': ids} ORDER BY size DESC, token) AS cl, 1 AS i, false AS moved, false AS done FROM n
  UNION ALL
  SELECT CASE WHEN j IS NULL THEN cl ELSE list_concat(list_append(cl[:i - 1], {'t': list_concat(cl[i].t, cl[j].t), 'r': list_distinct(list_concat(cl[i].r, cl[j].r))}), list_concat(cl[i + 1:j - 1], cl[j + 1:])) END,
    CASE WHEN j IS NOT NULL THEN i WHEN i < len(cl) THEN i + 1 ELSE 1 END, CASE WHEN j IS NOT NULL THEN true WHEN i < len(cl) THEN moved ELSE false END, j IS NULL AND i >= len(cl) AND NOT moved
  FROM (SELECT *, list_filter(range(i + 1, len(cl) + 1), lambda k: 10 * len(list_intersect(cl[i].r, cl[k].r)) >= 6 * (len(cl[i].r) + len(cl[k].r) - len(list_intersect(cl[i].r, cl[k].r))))[1] AS j FROM scan WHERE NOT done)),
c AS (SELECT list_sort(x.t) AS tokens, x.r AS ids FROM (SELECT unnest(cl) AS x FROM scan WHERE done)),
own AS (SELECT tokens, category, count(*) AS k, sum(cents) AS cents FROM (SELECT tokens, unnest(ids) AS id FROM c) u JOIN (SELECT DISTINCT id, category, cents FROM m) d USING (id) GROUP BY 1, 2),
g AS (SELECT tokens, CAST(sum(k) AS BIGINT) AS repo_count, CAST(sum(cents) AS DOUBLE) / 100.0::DOUBLE / CAST(sum(k) AS DOUBLE) AS avg_confidence, list_sort(list({'k': -k, 'c': category}))[1].c AS main FROM own GROUP BY 1),
s AS (SELECT *, CAST(repo_count AS DOUBLE) * avg_confidence AS score FROM g),
found AS (SELECT tokens[1] AS cluster, array_to_string(tokens, ',') AS tokens, repo_count, avg_confidence, score, CASE WHEN main = '' THEN 'unknown' ELSE main END AS category,
  repo_count >= 5 AND round(avg_confidence, 9) >= 0.6 AND round(score, 9) >= 3.0 AS qualifies,
  CASE WHEN repo_count < 5 THEN 'size_below_threshold' WHEN round(avg_confidence, 9) < 0.6 THEN 'avg_confidence_below_threshold' WHEN round(score, 9) < 3.0 THEN 'score_below_threshold' ELSE 'qualifies' END AS reason,
  array_to_string(tokens, '-') AS subcategory FROM s)"""
#: Candidates and clusters of each category, after ``found``.
_CATEGORIES = "SELECT o.category, o.other_count, coalesce(f.clusters, 0) AS clusters FROM (SELECT primary_category AS category, count(*) AS other_count FROM repos GROUP BY 1) o LEFT JOIN (SELECT category, count(*) AS clusters FROM found GROUP BY 1) f ON f.category = o.category"


@query("d1_clusters", f"{_CLUSTERS} SELECT * FROM found")
def _(t):
    found = audit.cluster_repos(_audited(t))
    return found.select("cluster", F.array_join("tokens", ",").alias("tokens"), "repo_count", "avg_confidence", "score", "category", "qualifies", "reason", "subcategory")


#: The same with confidences that let some clusters qualify.
_SURER = _CLUSTERS.replace("CAST(round(category_confidence * 100) AS BIGINT) AS cents", "36 + CAST(round(category_confidence * 100) AS BIGINT) // 2 AS cents")
_TITLE = f"concat('{audit.TITLE}', category, '/', subcategory)"


def _surer(t):
    cents = F.lit(36) + F.floor(F.round(F.col("confidence") * 100) / 2)
    return _audited(t).withColumn("confidence", cents.cast("double") / F.lit(100.0))


@query("s15_drafts", f"""{_SURER} SELECT {_TITLE} AS title, '{{"tokens":["' || replace(tokens, ',', '","') || '"],"repo_count":' || repo_count || ',"avg_confidence":' || round(avg_confidence, 2) || ',"score":' || round(score, 2) || '}}' AS body, category, subcategory FROM found WHERE qualifies""")
def _(t):
    return audit.drafts(audit.cluster_repos(_surer(t)))


@query("s15_draft_repos", f"""{_SURER}, q AS (SELECT {_TITLE} AS title, unnest(string_split(tokens, ',')) AS token FROM found WHERE qualifies)
SELECT DISTINCT title, full_name, (36 + CAST(round(category_confidence * 100) AS BIGINT) // 2) / 100.0::DOUBLE AS confidence FROM q JOIN (SELECT full_name, category_confidence, unnest(string_split(lower(topics_text), ' ')) AS token FROM repos) USING (token)""")
def _(t):
    rows = _surer(t)
    return audit.draft_repos(audit.cluster_repos(rows), audit.memberships(rows))


@query("d4_filed_proposals", f"""{_SURER}, i AS (SELECT concat('{audit.TITLE}', primary_category, '/', split_part(topics_text, ' ', 1), ' again') AS title, {{NOW}} - (id % 120) * 86400 AS created_s FROM repos WHERE id % 10 = 0)
SELECT {_TITLE} AS title, subcategory FROM found WHERE qualifies AND NOT EXISTS (SELECT 1 FROM i WHERE starts_with(i.title, {_TITLE}) AND created_s > {{NOW}} - 60 * 86400)""")
def _(t):
    """What a plugged filer gets from the audit of a plugged reader."""
    path = f"{shared_folder(t.spark)}/filed-{uuid.uuid4().hex}"
    title = F.concat(F.lit(audit.TITLE), "primary_category", F.lit("/"), F.split_part("topics_text", F.lit(" "), F.lit(1)), F.lit(" again"))
    issues = t.repos.filter("id % 10 = 0").select(title.alias("title"), (F.lit(NOW) - (F.col("id") % 120) * 86400).alias("created_s"))
    audit.audit_other_drift(lambda: (_surer(t), t.repos), lambda drafts: drafts.select("title", "subcategory").write.parquet(path), issues, "2024-01-31", NOW)
    return t.spark.read.parquet(path)


@query("x14_watch_details", f"""{_CLUSTERS} SELECT cluster, reason, CASE reason WHEN 'size_below_threshold' THEN repo_count || ' repos — too small to graduate, monitor next month.'
  WHEN 'avg_confidence_below_threshold' THEN repo_count || ' repos but avg_confidence ' || format('{{:.2f}}', avg_confidence) || ' < 0.60 — too uncertain to graduate.'
  ELSE repo_count || ' repos, score ' || format('{{:.2f}}', score) || ' < 3.00 — surface only.' END AS detail FROM found WHERE NOT qualifies""")
def _(t):
    return audit.watch_details(audit.cluster_repos(_audited(t)))


@query("a24_drift_share", f"""WITH n AS (SELECT count(*) FILTER (WHERE primary_subcategory = 'other' AND is_curated_list = 0 AND status = 'active') AS candidates, count(*) FILTER (WHERE {LIVE} AND status = 'active' AND is_curated_list = 0) AS corpus FROM repos)
SELECT candidates, corpus, CASE WHEN corpus = 0 THEN 0.0::DOUBLE ELSE CAST(candidates AS DOUBLE) * 100.0::DOUBLE / CAST(corpus AS DOUBLE) END AS share_pct, CASE WHEN corpus = 0 THEN false ELSE CAST(candidates AS DOUBLE) * 100.0::DOUBLE / CAST(corpus AS DOUBLE) > 3.0::DOUBLE END AS escalated FROM n""")
def _(t):
    return audit.share(r.drift_candidates(t.repos), t.repos.filter("excluded = 0 AND status = 'active' AND is_curated_list = 0"))


@query("j12_not_filed", """WITH p AS (SELECT concat('Subcat graduation proposal: ', primary_category, '/', owner) AS title FROM repos WHERE id % 3 = 0 GROUP BY 1),
i AS (SELECT concat('Subcat graduation proposal: ', primary_category, '/', owner, ' again') AS title, {NOW} - (id % 120) * 86400 AS created_s FROM repos WHERE id % 10 = 0)
SELECT title FROM p WHERE NOT EXISTS (SELECT 1 FROM i WHERE starts_with(i.title, p.title) AND created_s > {NOW} - 60 * 86400)""")
def _(t):
    title = F.concat(F.lit("Subcat graduation proposal: "), "primary_category", F.lit("/"), "owner")
    drafts = t.repos.filter("id % 3 = 0").select(title.alias("title")).distinct()
    issues = t.repos.filter("id % 10 = 0").select(F.concat(title, F.lit(" again")).alias("title"), (F.lit(NOW) - (F.col("id") % 120) * 86400).alias("created_s"))
    return audit.not_filed_lately(drafts, issues, NOW)


_FIGURES = """'","repo_count":' || repo_count || ',"tokens":["' || replace(tokens, ',', '","') || '"],"avg_confidence":' || round(avg_confidence, 2) || ',"score":' || round(score, 2)"""


@query("c6_audit_report", f"""{_CLUSTERS},
tot AS (SELECT candidates, corpus, CASE WHEN corpus = 0 THEN 0.0::DOUBLE ELSE CAST(candidates AS DOUBLE) * 100.0::DOUBLE / CAST(corpus AS DOUBLE) END AS pct FROM (
  SELECT count(*) FILTER (WHERE primary_subcategory = 'other' AND is_curated_list = 0 AND status = 'active') AS candidates, count(*) FILTER (WHERE {LIVE} AND status = 'active' AND is_curated_list = 0) AS corpus FROM repos))
SELECT 0 AS section, '' AS ord, '{{"day":"2024-01-31","corpus":' || corpus || ',"candidates":' || candidates || ',"share_pct":' || round(pct, 2) || ',"gate":"' || CASE WHEN pct > 3.0 THEN '{audit.BREACH}' ELSE '{audit.PASS}' END || '"}}' AS line FROM tot
UNION ALL SELECT 1, category, '{{"category":"' || category || '","other_count":' || other_count || ',"clusters":' || clusters || '}}' FROM ({_CATEGORIES})
UNION ALL SELECT 2, category || '/' || subcategory, '{{"filed":"' || category || '/' || subcategory || {_FIGURES} || '}}' FROM found WHERE qualifies
UNION ALL SELECT 3, category || '/' || subcategory, '{{"watched":"' || category || '/' || subcategory || {_FIGURES} || ',"reason":"' || reason || '"}}' FROM found WHERE NOT qualifies""")
def _(t):
    rows = _audited(t)
    found = audit.cluster_repos(rows)
    totals = audit.share(r.drift_candidates(t.repos), t.repos.filter("excluded = 0 AND status = 'active' AND is_curated_list = 0"))
    return audit.report(found, audit.per_category(rows, found), totals, "2024-01-31")
