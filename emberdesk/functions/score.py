"""Score components and their sum, one typed column each."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from . import text as T
from . import url as U


def flood(n: Column) -> Column:
    return F.when(n <= 10, 0.0).otherwise(F.least((n - 10) * F.lit(0.3), F.lit(5.0)))


def volume(n: Column) -> Column:
    return F.when(n <= 5, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (n - 5) * F.lit(0.015)))


def substance(n: Column, links: Column, facets: Column) -> Column:
    return F.when(n.between(80, 500), 1.0).when(n > 500, 0.5).otherwise(0.0) + F.when(links >= 2, 0.5).otherwise(0.0) + F.when(facets >= 2, 0.3).otherwise(0.0)


def freshness(age_hours: Column) -> Column:
    return F.exp(F.greatest(age_hours, F.lit(0.0)) * -0.058)


def measured(posts: DataFrame) -> DataFrame:
    """``posts`` with what profiles and scores read of a text: its length, and that without links. Posts that hold both need no text."""
    if {"text_len", "stripped_len"} <= set(posts.columns):
        return posts
    return posts.withColumns({"text_len": F.length("text"), "stripped_len": F.length(T.strip_urls(F.col("text")))})


def scored(posts: DataFrame) -> DataFrame:
    """``posts`` with ``is_known, handle, seed_class, trusted_score, posts_24h, stink_score, outsider_posts, age_hours`` scored.

    The parts before freshness are added; freshness and volume multiply; stink and the outsider's relay
    are taken off; the author's weight multiplies. Reasons name the parts that applied, in this order.
    """
    c = F.col
    known, repost = c("is_known"), c("is_repost")
    reply, quote = c("reply_to_uri").isNotNull(), c("quote_uri").isNotNull()
    p = measured(posts).withColumns({"platform": U.is_platform(c("external_domain")), "bonus": U.bonus(c("external_domain"))})
    linked = c("has_external_embed") & ~c("platform")
    media = c("has_image") | c("has_video")
    parts = {
        "c_affinity": F.when(~known, 0.5).when(c("seed_class") == "mutual", 5.0).when(c("seed_class") == "followed", 3.0).when(c("seed_class") == "trusted_list", 4.0).when(c("seed_class") == "follower", 1.5).otherwise(0.0),
        "c_trust": F.when(known & (c("trusted_score") > 0), F.least(c("trusted_score") * 0.2, F.lit(2.0))).otherwise(0.0),
        "c_flood": F.when(known, -flood(c("posts_24h"))).otherwise(0.0),
        "c_origin": F.when(repost, -6.0).when(~reply & ~quote, 3.0).when(quote, -1.0).when(c("text_len") > 100, 0.5).otherwise(-1.0),
        "c_link": F.when(linked, 2.0).otherwise(0.0),
        "c_domain": c("bonus"),
        "c_relay": F.when(linked & (c("stripped_len") < 20), -3.0).when(linked & (c("stripped_len") < 60) & ~reply & ~quote, -1.5).otherwise(0.0),
        "c_stub": F.when(media & (c("text_len") < 30) & ~c("has_external_embed"), -1.5).otherwise(0.0),
        "c_substance": substance(c("text_len"), c("link_count"), c("facets_count")),
        "m_fresh": freshness(c("age_hours")),
        "m_volume": F.when(known, volume(c("posts_24h"))).otherwise(1.0),
        "c_stink": F.when(known & (c("stink_score") > 0.6), (c("stink_score") - 0.6) * -5.0).otherwise(0.0),
        "c_outsider": F.when(~known & linked & c("external_domain").isNotNull() & (c("outsider_posts") > 10), -F.least((c("outsider_posts") - 10) * F.lit(0.2), F.lit(4.0))).otherwise(0.0),
        "m_weight": F.when(known, F.coalesce(*[F.create_map(*[F.lit(x) for kv in dims.AUTHOR_WEIGHTS.items() for x in kv])[c(k)] for k in ("handle", "author_did")], F.lit(1.0))).otherwise(1.0),
    }
    p = p.withColumns(parts)
    added = c("c_affinity") + c("c_trust") + c("c_flood") + c("c_origin") + c("c_link") + c("c_domain") + c("c_relay") + c("c_stub") + c("c_substance")
    score = (added * c("m_fresh") * c("m_volume") + c("c_stink") + c("c_outsider")) * c("m_weight")

    def shown(value: Column, digits: int) -> Column:
        return F.format_string(f"%.{digits}f", value)

    reasons = [
        F.when(~known, "unknown_author").when(c("seed_class").isin(*dims.GRAPH_REASONS), c("seed_class")),
        F.when(c("c_flood") < 0, F.concat(F.lit("flood:-"), shown(-c("c_flood"), 1))),
        F.when(repost, "repost:-6").when(~reply & ~quote, "original").when(quote, "quote:-1").when(c("text_len") > 100, "substantive_reply").otherwise("short_reply:-1"),
        F.when(linked, "has_link"),
        F.when(c("bonus") > 0, F.concat(F.lit("domain:"), c("external_domain"), F.lit(":+"), c("bonus").cast("string"))),
        F.when(c("c_relay") == -3.0, "relay:-3").when(c("c_relay") < 0, "low_commentary:-1.5"),
        F.when(c("c_stub") < 0, "image_stub:-1.5"),
        F.when(c("c_substance") > 0, F.concat(F.lit("substance:+"), shown(c("c_substance"), 1))),
        F.when(c("m_fresh") < 0.5, F.concat(F.lit("stale:"), shown(c("m_fresh"), 2))),
        F.when(c("m_volume") < 1, F.concat(F.lit("volume:"), shown(c("m_volume"), 2))),
        F.when(c("c_stink") < 0, F.concat(F.lit("stink:-"), shown(-c("c_stink"), 1))),
        F.when(c("c_outsider") < 0, F.concat(F.lit("outsider_relay:-"), shown(-c("c_outsider"), 1))),
        F.when(c("m_weight") != 1, F.concat(F.lit("weight:"), shown(c("m_weight"), 1))),
    ]
    return p.withColumn("score", score).withColumn("reasons", F.array_compact(F.array(*reasons)))
