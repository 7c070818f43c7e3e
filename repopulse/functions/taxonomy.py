"""The two-level taxonomy and the map from older flat category names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Allowed (category, subcategory) pairs.
TAXONOMY = {
    "ai": ("agents", "coding-assistants", "llm-tooling", "mcp-ecosystem", "infrastructure", "rag", "vector-database", "computer-vision", "voice-and-audio", "mlops", "other"),
    "cloud-native": ("kubernetes", "observability", "service-mesh", "platform-engineering", "gitops", "networking", "infrastructure", "container-runtime", "wasm", "security", "other"),
    "web": ("frameworks", "frontend-ui", "css-styling", "other"),
    "mobile-desktop": ("mobile", "desktop", "other"),
    "systems": ("rust-ecosystem", "programming-languages", "embedded-iot", "other"),
    "security": ("cybersecurity", "privacy-tools", "other"),
    "data": ("databases", "data-engineering", "data-science", "other"),
    "productivity": ("self-hosted", "cli-tools", "general", "low-code-automation", "other"),
    "devtools": ("general", "testing", "awesome-lists", "other"),
    "creative": ("game-development", "media-tools", "other"),
    "crypto": ("blockchain-web3", "other"),
    "robotics": ("robotics", "other"),
    "science": ("bioinformatics", "computational-research", "datasets", "other"),
    "education": ("tutorials", "learning-paths", "awesome-lists", "other"),
    "other": ("other",),
}

# Older flat names, with their category and subcategory.
LEGACY = {
    "ai-agents": ("ai", "agents"),
    "ai-coding-assistants": ("ai", "coding-assistants"),
    "llm-tooling": ("ai", "llm-tooling"),
    "mcp-ecosystem": ("ai", "mcp-ecosystem"),
    "voice-and-audio-ai": ("ai", "voice-and-audio"),
    "ai-infrastructure": ("ai", "infrastructure"),
    "computer-vision": ("ai", "computer-vision"),
    "rag": ("ai", "rag"),
    "vector-database": ("ai", "vector-database"),
    "mlops": ("ai", "mlops"),
    "kubernetes": ("cloud-native", "kubernetes"),
    "observability": ("cloud-native", "observability"),
    "platform-engineering": ("cloud-native", "platform-engineering"),
    "gitops": ("cloud-native", "gitops"),
    "networking": ("cloud-native", "networking"),
    "infrastructure": ("cloud-native", "infrastructure"),
    "container-runtime": ("cloud-native", "container-runtime"),
    "wasm": ("cloud-native", "wasm"),
    "cloud-native-security": ("cloud-native", "security"),
    "web-frameworks": ("web", "frameworks"),
    "frontend-ui": ("web", "frontend-ui"),
    "css-and-styling": ("web", "css-styling"),
    "mobile-development": ("mobile-desktop", "mobile"),
    "desktop-apps": ("mobile-desktop", "desktop"),
    "rust-ecosystem": ("systems", "rust-ecosystem"),
    "programming-languages": ("systems", "programming-languages"),
    "embedded-iot": ("systems", "embedded-iot"),
    "cybersecurity": ("security", "cybersecurity"),
    "privacy-tools": ("security", "privacy-tools"),
    "databases": ("data", "databases"),
    "data-engineering": ("data", "data-engineering"),
    "data-science": ("data", "data-science"),
    "self-hosted": ("productivity", "self-hosted"),
    "cli-tools": ("productivity", "cli-tools"),
    "productivity": ("productivity", "general"),
    "low-code-automation": ("productivity", "low-code-automation"),
    "developer-tools": ("devtools", "general"),
    "testing": ("devtools", "testing"),
    "game-development": ("creative", "game-development"),
    "media-tools": ("creative", "media-tools"),
    "blockchain-web3": ("crypto", "blockchain-web3"),
    "robotics": ("robotics", "robotics"),
    "other": ("other", "other"),
}


def pairs(spark: SparkSession) -> DataFrame:
    """Allowed pairs as a table."""
    return spark.createDataFrame([(c, s) for c, subs in TAXONOMY.items() for s in subs], "category string, subcategory string")


def legacy(spark: SparkSession) -> DataFrame:
    """Older names as a table (slug, category, subcategory)."""
    return spark.createDataFrame([(k, *v) for k, v in LEGACY.items()], "slug string, category string, subcategory string")


def is_allowed(category: Column, subcategory: Column) -> Column:
    """Whether a pair is in the taxonomy (a fixed set, so no join is needed)."""
    return F.concat(category, F.lit("/"), subcategory).isin([f"{c}/{s}" for c, subs in TAXONOMY.items() for s in subs])


def _lookup(slug: Column, part: int) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in LEGACY.items() for x in (k, v[part])])
    return F.try_element_at(table, slug)


def roll_up(slug: Column) -> tuple[Column, Column]:
    """Category and subcategory of an older name; (other, other) if it is unknown."""
    return F.coalesce(_lookup(slug, 0), F.lit("other")), F.coalesce(_lookup(slug, 1), F.lit("other"))


def resolve(repos: DataFrame) -> DataFrame:
    """Adds category, subcategory and legacy as they are reported.

    A forced category beats the primary one; an older name is rolled up, keeping the
    subcategory if the pair is allowed.
    """
    forced = F.col("force_category") != ""
    raw = F.when(forced, F.col("force_category")).otherwise(F.col("primary_category"))
    sub = F.when(forced, F.col("force_subcategory")).otherwise(F.col("primary_subcategory"))
    up, up_sub = _lookup(raw, 0), _lookup(raw, 1)
    known = up.isNotNull()
    old = F.col("primary_category_legacy")
    return repos.withColumns(
        {
            "category": F.coalesce(up, raw),
            "subcategory": F.when(known & ((sub == "") | ~is_allowed(up, sub)), up_sub).otherwise(sub),
            "legacy": F.when(known & (old == ""), raw).otherwise(old),
        }
    )
