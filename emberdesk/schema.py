"""The tables' schemas, and rows written under an older one brought up to date."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.cluster import STORY_TABLE

TABLES = {
    "authors": "author_did string, handle string, seed_class string, trusted_score double, stink_score double, link_post_ratio double, reply_ratio double, avg_non_url_len double, posts_24h long, updated_at timestamp_ntz",
    "posts": "uri string, cid string, author_did string, created_at timestamp_ntz, text string, reply_to_uri string, root_uri string, quote_uri string, external_uri string, external_domain string, has_external_embed boolean, has_image boolean, has_video boolean, is_repost boolean, langs array<string>, link_count long, facets_count long, indexed_at timestamp_ntz",
    "ranked_posts": "feed_name string, uri string, score double, reasons array<string>, rank int, ranked_at timestamp_ntz",
    "cursors": "consumer string, cursor string, updated_at timestamp_ntz",
    "feed_state": "key string, value string, updated_at timestamp_ntz",
    "editions": "edition_id string, feed_name string, created_at timestamp_ntz, items array<struct<pos:int,uri:string,headline:string>>, stats struct<total:long,original_pct:long,edition_num:long,character:string>, hero_idx int",
    "story_clusters": STORY_TABLE,
    "cluster_members": "cluster_id string, post_uri string, author_did string, post_score double, joined_at timestamp_ntz, is_lead boolean",
    "exclusions": "did string, requested_at timestamp_ntz, source string, state string, note string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def migrated(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` with the table's columns in order: those that they lack are null; what the table lacks is left out."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])
