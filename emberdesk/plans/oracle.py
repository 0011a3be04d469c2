"""The registered queries in DuckDB SQL, written from the rules rather than from the column expressions."""

from .. import dims

N, G = r"[^\p{L}\p{N}_\s]", "'g'"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(d: str, values) -> str:
    return "(" + " OR ".join(f"{d} = '{v}' OR {d} LIKE '%.{v}'" for v in values) + ")"


def host(u: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower({u}), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^www\\.', ''), '')"


def bonus(d: str) -> str:
    tables = [*dims.PRIMARY.items(), *dims.REPORTING.items()]
    exact = " ".join(f"WHEN {d} = '{k}' THEN {v}::DOUBLE" for k, v in tables)
    below = " ".join(f"WHEN {d} LIKE '%.{k}' THEN {v}::DOUBLE" for k, v in tables)
    return f"(CASE WHEN {d} IS NULL OR {_in(d, dims.PLATFORMS)} THEN 0.0::DOUBLE {exact} {below} ELSE 0.0::DOUBLE END)"


def platform(d: str) -> str:
    return f"coalesce({_in(d, dims.PLATFORMS)}, false)"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def strip_urls(t: str) -> str:
    one = f"regexp_replace({t}, 'https?://[^\\s]+|www\\.[^\\s]+|[^\\s]+\\.[\\p{{L}}\\p{{N}}_]{{2,4}}/[^\\s]+', '', 'g')"
    return strip(f"regexp_replace({one}, '[^\\s]+\\.(com|org|gov|net|io|co|edu|news)/[^\\s]*', '', 'g')")


def clean(t: str) -> str:
    for p in (r"https?://[^\s]{20,}", r"bsky\.app/profile/[^\s]+", r"did:(plc|web):[^\s]+", r"\bundefined\b", r"#[\p{L}\p{N}_]+\s*$"):
        t = f"regexp_replace({t}, '{p}', '', 'g')"
    return strip(f"regexp_replace({t}, '\\s+', ' ', 'g')")


def canonical(u: str) -> str:
    q = f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
    kept = f"array_to_string(list_filter(string_split({q}, '&'), lambda p: regexp_matches(p, '=.') AND NOT list_contains({_list(dims.TRACKING)}, lower(split_part(p, '=', 1)))), '&')"
    path = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"(CASE WHEN coalesce({u}, '') = '' THEN '' ELSE lower(split_part({u}, ':', 1)) || '://' || {host(u)} || {path} || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END)"


def title_words(t: str) -> str:
    t = f"regexp_replace(regexp_replace(regexp_replace(lower({t}), 'https?://[^\\s]+', '', 'g'), 'www\\.[^\\s]+', '', 'g'), '{N}', ' ', 'g')"
    return f"list_filter(regexp_split_to_array({strip(t)}, '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({_list(dims.STOPWORDS)}, w))[1:6]"


def family(d: str) -> str:
    t = dims.TITLE_FAMILIES.items()
    return "(CASE " + " ".join(f"WHEN {d} = '{k}' THEN '{v}'" for k, v in t) + " " + " ".join(f"WHEN {d} LIKE '%.{k}' THEN '{v}'" for k, v in t) + f" ELSE {d} END)"


def display(u: str) -> str:
    d = host(u)
    known = [*dims.PRIMARY, *dims.REPORTING]
    return f"(CASE WHEN {d} IS NULL OR {platform(d)} THEN NULL " + " ".join(f"WHEN {d} = '{k}' OR {d} LIKE '%.{k}' THEN '{k}'" for k in known) + f" ELSE {d} END)"


def docket(u: str, reasons: str, handle: str) -> str:
    d = host(u)
    by_link = " ".join(f"WHEN {_in(d, ds)} THEN '{f}'" for f, (ds, _, _) in dims.DOCKETS.items())
    named = f"list_transform(list_filter({reasons}, lambda r: starts_with(r, 'domain:')), lambda r: split_part(r, ':', 2))"
    by_reason = " ".join(f"WHEN list_has_any({named}, {_list(ds)}) THEN '{f}'" for f, (ds, _, _) in dims.DOCKETS.items())
    return f"(CASE {by_link} {by_reason} WHEN contains(lower({handle}), 'congress') THEN 'congress' END)"


def graph(r: str) -> str:
    return f"list_has_any({r}, {_list(dims.GRAPH_REASONS)})"


CTES = {
    "now": "SELECT max(ts) AS t FROM events",
    "people": "SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN user_id ELSE user_id // 15 END AS k FROM events",
    "linked": f"""SELECT e.event_id AS i, e.event_type AS k, e.ts AS created_at, e.a, 'did:u' || e.a AS author_did, coalesce(CASE WHEN e.a % 10 = 7 OR e.event_id % 5 = 0 THEN d.source ELSE d.text END, '') AS body, d.lang, d.source,
        CASE WHEN e.a % 10 = 7 AND e.event_type <> 'error' THEN 'https://tickets.ticketmaster.com/item/' || e.event_id WHEN e.event_type NOT IN ('click', 'purchase') THEN NULL WHEN e.event_id % 7 = 0 THEN p.url
        ELSE 'https://' || ({_list(dims.FIXTURE_DOMAINS)})[e.event_id % 12 + 1] || '/item/' || CASE WHEN e.event_id % 3 = 0 THEN e.event_id ELSE e.event_id % 60 END || CASE WHEN e.event_id % 2 = 0 THEN '?utm_source=x&id=7' ELSE '?id=7#top' END END AS external_uri
        FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN user_id ELSE user_id // 15 END AS a FROM events) e LEFT JOIN documents d ON d.doc_id = e.event_id % (SELECT max(doc_id) + 1 FROM documents) LEFT JOIN pages p ON p.page_id = e.event_id % (SELECT max(page_id) + 1 FROM pages)""",
    "posts": f"""SELECT 'at://' || author_did || '/post/' || i AS uri, i AS event_id, a, author_did, created_at,
        CASE WHEN k = 'error' THEN '' ELSE body || CASE WHEN external_uri IS NOT NULL AND i % 4 = 0 THEN ' ' || external_uri ELSE '' END END AS text,
        CASE WHEN k = 'signup' THEN 'at://thread/' || (i - i % 10) END AS reply_to_uri, CASE WHEN k = 'signup' THEN 'at://thread/' || (i - i % 10) END AS root_uri,
        CASE WHEN k = 'purchase' THEN 'at://quoted/' || (i % 25) END AS quote_uri, external_uri, {host("external_uri")} AS external_domain, external_uri IS NOT NULL AS has_external_embed,
        k = 'view' AND i % 4 = 1 AS has_image, k = 'error' AS is_repost, lang, source, CASE WHEN external_uri IS NULL THEN 0 ELSE 1 + i % 2 END AS link_count, i % 4 AS facets_count FROM linked""",
    "authors": """SELECT 'did:u' || k AS author_did, 'u' || k AS handle, CASE WHEN c <= 4 THEN 'mutual' WHEN c <= 8 THEN 'followed' WHEN c <= 10 THEN 'trusted_list' WHEN c <= 14 THEN 'follower' ELSE 'stale' END AS seed_class,
        CASE WHEN c <= 4 THEN 4.0 WHEN c <= 8 THEN 2.0 WHEN c <= 10 THEN 3.0 WHEN c <= 14 THEN 1.0 ELSE 0.1 END::DOUBLE AS trusted_score FROM (SELECT k, k % 20 AS c FROM people) WHERE c < 16""",
    "commands": "SELECT 'did:u' || k AS did, m.at AS sent_at, m.t AS text FROM (SELECT k, unnest(CASE k % 20 WHEN 14 THEN [{'at': 1, 't': 'opt out'}] WHEN 13 THEN [{'at': 1, 't': 'Exclude me.'}, {'at': 2, 't': 'include me'}] WHEN 12 THEN [{'at': 3, 't': 'hello there'}] WHEN 11 THEN [{'at': 1, 't': 'add me back'}] END) AS m FROM people)",
    "asked": "SELECT *, CASE WHEN regexp_matches(lower(trim(text)), '^(opt *out|exclude *me|remove *me|don.?t *include *me) *[.!]?$') THEN 'opt_out' WHEN regexp_matches(lower(trim(text)), '^(opt *in|include *me|add *me *back) *[.!]?$') THEN 'opt_in' END AS command FROM commands",
    "barred": "SELECT did FROM (SELECT did, arg_max(command, sent_at) AS last FROM asked WHERE command IS NOT NULL GROUP BY 1) WHERE last = 'opt_out'",
    "counts": "SELECT author_did, count(*) AS posts_24h FROM posts WHERE created_at >= (SELECT t FROM now) - INTERVAL 24 HOUR GROUP BY 1",
    "recent": f"SELECT *, length({strip_urls('text')}) AS bare FROM posts WHERE created_at >= (SELECT t FROM now) - INTERVAL 7 DAY",
    "top_domain": "SELECT author_did, max(n) AS top, sum(n) AS named FROM (SELECT author_did, external_domain, count(*) AS n FROM recent WHERE external_domain IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "profile0": """SELECT author_did, count(*) AS total, sum(has_external_embed::INT) / count(*) AS link_post_ratio, (count(reply_to_uri) + count(quote_uri)) / count(*) AS reply_ratio, sum(bare) / count(*) AS avg_non_url_len,
        CASE WHEN sum(has_external_embed::INT) = 0 THEN 0 ELSE sum((has_external_embed AND bare < 30)::INT) / sum(has_external_embed::INT) END AS titles FROM recent GROUP BY 1 HAVING count(*) >= 3""",
    "profiles": """SELECT p.author_did, total, link_post_ratio, reply_ratio, avg_non_url_len, coalesce(top / named, 0) AS domain_concentration,
        greatest(0.0, least(1.0, 0.30 * link_post_ratio + 0.25 * titles + 0.15 * coalesce(top / named, 0) + 0.15 * (1 - least(reply_ratio / 0.20, 1)) + 0.15 * (1 - least(avg_non_url_len / 120.0, 1)))) AS stink_score
        FROM profile0 p LEFT JOIN top_domain t USING (author_did)""",
    "relays": "SELECT author_did, external_domain, count(*) AS outsider_posts FROM posts WHERE external_domain IS NOT NULL GROUP BY 1, 2",
    "candidates": "SELECT * FROM posts WHERE created_at >= (SELECT t FROM now) - INTERVAL 24 HOUR AND author_did NOT IN (SELECT did FROM barred)",
    "joined": f"""SELECT c.*, a.handle, a.author_did IS NOT NULL AS is_known, a.seed_class, a.trusted_score, coalesce(n.posts_24h, 0) AS posts_24h, coalesce(s.stink_score, 0) AS stink_score, coalesce(r.outsider_posts, 0) AS outsider_posts,
        epoch_us((SELECT t FROM now)) / 3.6e9 - epoch_us(c.created_at) / 3.6e9 AS age, {bonus('c.external_domain')} AS bonus, c.has_external_embed AND NOT {platform('c.external_domain')} AS evid, length({strip_urls('c.text')}) AS sl
        FROM candidates c LEFT JOIN authors a USING (author_did) LEFT JOIN counts n USING (author_did) LEFT JOIN profiles s USING (author_did) LEFT JOIN relays r ON r.author_did = c.author_did AND r.external_domain = c.external_domain""",
    "parts": """SELECT *, CASE WHEN NOT is_known THEN 0.5 WHEN seed_class = 'mutual' THEN 5 WHEN seed_class = 'followed' THEN 3 WHEN seed_class = 'trusted_list' THEN 4 WHEN seed_class = 'follower' THEN 1.5 ELSE 0 END::DOUBLE AS c_affinity,
        CASE WHEN is_known AND trusted_score > 0 THEN least(trusted_score * 0.2, 2) ELSE 0 END::DOUBLE AS c_trust, CASE WHEN is_known AND posts_24h > 10 THEN -least((posts_24h - 10) * 0.3, 5) ELSE 0 END::DOUBLE AS c_flood,
        CASE WHEN is_repost THEN -6 WHEN reply_to_uri IS NULL AND quote_uri IS NULL THEN 3 WHEN quote_uri IS NOT NULL THEN -1 WHEN length(text) > 100 THEN 0.5 ELSE -1 END::DOUBLE AS c_origin,
        CASE WHEN evid THEN 2 ELSE 0 END::DOUBLE AS c_link, CASE WHEN evid AND sl < 20 THEN -3 WHEN evid AND sl < 60 AND reply_to_uri IS NULL AND quote_uri IS NULL THEN -1.5 ELSE 0 END::DOUBLE AS c_relay,
        CASE WHEN has_image AND length(text) < 30 AND NOT has_external_embed THEN -1.5 ELSE 0 END::DOUBLE AS c_stub,
        (CASE WHEN length(text) BETWEEN 80 AND 500 THEN 1 WHEN length(text) > 500 THEN 0.5 ELSE 0 END + CASE WHEN link_count >= 2 THEN 0.5 ELSE 0 END + CASE WHEN facets_count >= 2 THEN 0.3 ELSE 0 END)::DOUBLE AS c_substance,
        exp(-0.058 * greatest(age, 0)) AS m_fresh, CASE WHEN is_known AND posts_24h > 5 THEN greatest(0.5, 1 - (posts_24h - 5) * 0.015) ELSE 1 END::DOUBLE AS m_volume,
        CASE WHEN is_known AND stink_score > 0.6 THEN (stink_score - 0.6) * -5 ELSE 0 END::DOUBLE AS c_stink,
        CASE WHEN NOT is_known AND evid AND external_domain IS NOT NULL AND outsider_posts > 10 THEN -least((outsider_posts - 10) * 0.2, 4) ELSE 0 END::DOUBLE AS c_outsider, CASE WHEN handle = 'u3' THEN 0.25 ELSE 1 END::DOUBLE AS m_weight FROM joined""",
    "scored": """SELECT *, round(((c_affinity + c_trust + c_flood + c_origin + c_link + bonus + c_relay + c_stub + c_substance) * m_fresh * m_volume + c_stink + c_outsider) * m_weight, 6) AS score_r,
        list_filter([CASE WHEN NOT is_known THEN 'unknown_author' WHEN seed_class <> 'stale' THEN seed_class END, CASE WHEN is_repost THEN 'repost:-6' WHEN reply_to_uri IS NULL AND quote_uri IS NULL THEN 'original' WHEN quote_uri IS NOT NULL THEN 'quote:-1' WHEN length(text) > 100 THEN 'substantive_reply' ELSE 'short_reply:-1' END,
        CASE WHEN evid THEN 'has_link' END, CASE WHEN bonus > 0 THEN 'domain:' || external_domain || ':+' || bonus END, CASE WHEN c_substance > 0 THEN 'substance' END], lambda x: x IS NOT NULL) AS reasons FROM parts""",
    "ordered": "SELECT *, row_number() OVER (ORDER BY score_r DESC, created_at DESC, uri) AS rn FROM scored",
}


def _fold(name: str, per_author: int) -> dict[str, str]:
    ok = f"len(f.u) < 150 AND len(list_filter(f.a, lambda x: x = r.author_did)) < {per_author} AND len(list_filter(f.t, lambda x: x = coalesce(r.root_uri, r.uri))) < 3 AND (r.external_uri IS NULL OR len(list_filter(f.l, lambda x: x = r.external_uri)) < 2)"
    step = f"SELECT r.rn, CASE WHEN {ok} THEN list_append(f.u, r.uri) ELSE f.u END, CASE WHEN {ok} THEN list_append(f.a, r.author_did) ELSE f.a END, CASE WHEN {ok} THEN list_append(f.t, coalesce(r.root_uri, r.uri)) ELSE f.t END, CASE WHEN {ok} THEN list_append(f.l, coalesce(r.external_uri, '')) ELSE f.l END FROM {name}_fold f JOIN ordered r ON r.rn = f.n + 1"
    return {
        f"{name}_fold(n, u, a, t, l)": f"SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[] UNION ALL {step}",
        f"{name}_last": f"SELECT u FROM {name}_fold ORDER BY n DESC LIMIT 1",
        name: f"SELECT o.*, list_position((SELECT u FROM {name}_last), o.uri) AS rank FROM ordered o WHERE list_contains((SELECT u FROM {name}_last), o.uri)",
    }


CTES |= _fold("tight", dims.PER_AUTHOR) | _fold("composed", 8)

real_domain = f"external_domain IS NOT NULL AND NOT {platform('external_domain')}"
CTES |= {
    "dedup0": f"SELECT *, CASE WHEN external_uri IS NOT NULL AND NOT {platform('external_domain')} THEN nullif({canonical('external_uri')}, '') END AS cu, {docket('external_uri', 'reasons', chr(39) * 2)} AS family FROM composed",
    "dedup1": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(cu, uri) ORDER BY rank) AS nth FROM dedup0) WHERE cu IS NULL OR nth <= 1",
    "dedup": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(family, uri) ORDER BY rank) AS fth FROM dedup1) WHERE family IS NULL OR fth <= 2",
    "m0": f"SELECT *, CASE WHEN external_uri IS NOT NULL AND NOT {platform('external_domain')} THEN nullif({canonical('external_uri')}, '') END AS cu, coalesce(root_uri, quote_uri) AS thread, {title_words('text')} AS tw FROM composed WHERE rank <= 120",
    "m1": f"SELECT *, CASE WHEN {real_domain} AND length(text) >= 30 AND len(tw) >= 3 THEN {family('external_domain')} || ':' || array_to_string(list_sort(tw)[1:5], ' ') END AS headline, count(cu) OVER (PARTITION BY cu) AS un FROM m0",
    "m2": "SELECT *, CASE WHEN un < 2 THEN thread END AS t1 FROM m1",
    "m3": "SELECT *, count(t1) OVER (PARTITION BY t1) AS tn FROM m2",
    "m4": "SELECT *, CASE WHEN un < 2 AND tn < 2 THEN headline END AS h1 FROM m3",
    "m5": "SELECT *, count(h1) OVER (PARTITION BY h1) AS hn FROM m4",
    "m6": "SELECT *, CASE WHEN un >= 2 THEN 'url' WHEN tn >= 2 THEN 'root' WHEN hn >= 2 THEN 'headline' ELSE 'singleton' END AS cluster_type FROM m5",
    "m7": f"SELECT *, cluster_type || '_' || substr(sha256(CASE cluster_type WHEN 'url' THEN cu WHEN 'root' THEN thread WHEN 'headline' THEN headline ELSE uri END), 1, 16) AS cluster_id, CASE cluster_type WHEN 'url' THEN cu WHEN 'root' THEN thread WHEN 'headline' THEN headline ELSE uri END AS cluster_key, CASE WHEN {graph('reasons')} THEN 2 ELSE 0 END AS graph_tier, CASE WHEN sl > 60 THEN 1 ELSE 0 END AS commentary_tier FROM m6",
    "members": "SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY graph_tier DESC, commentary_tier DESC, score_r DESC, rank) AS place FROM m7",
    "c0": f"""SELECT cluster_id, cluster_type, count(*) AS n, count(DISTINCT author_did) AS a, min(rank) AS first_rank, arg_min(external_domain, rank) AS first_domain, sum((place > 1 AND list_contains(reasons, 'unknown_author'))::INT) AS outsiders,
        max(CASE WHEN place = 1 THEN uri END) AS lead_post_uri, max(CASE WHEN place = 1 THEN score_r END) AS lead_score, max(CASE WHEN place = 1 THEN external_domain END) AS lead_domain, max(CASE WHEN place = 1 THEN cu END) AS lead_cu,
        max(CASE WHEN place = 1 THEN thread END) AS lead_thread, max(CASE WHEN place = 1 THEN external_uri END) AS external_uri, max(CASE WHEN place = 1 THEN text END) AS text, max(CASE WHEN place = 1 THEN author_did END) AS author_did,
        max(CASE WHEN place = 1 THEN reasons END) AS reasons, max(cluster_key) AS cluster_key FROM members GROUP BY 1, 2""",
    "c1": f"SELECT *, CASE cluster_type WHEN 'url' THEN {host('lead_cu')} WHEN 'headline' THEN first_domain ELSE coalesce(lead_domain, '') END AS domain FROM c0",
    "clusters": f"""SELECT *, CASE WHEN cluster_type = 'url' THEN lead_cu END AS canonical_url, list_position({_list(['url', 'root', 'headline', 'singleton'])}, cluster_type) AS type_rank,
        round(lead_score * 0.45 + (CASE WHEN n = 1 THEN 0 WHEN n <= 3 THEN n * 1.5 ELSE 4.5 + ln(n - 2) * 0.5 END)::DOUBLE * 0.15 + (CASE WHEN a <= 1 THEN 0 ELSE least(a * 0.8, 3) END)::DOUBLE * 0.1 + {bonus('domain')} * 0.1 - (CASE WHEN n >= 3 AND a = 1 THEN 3 WHEN n >= 2 AND a = 1 THEN 1.5 ELSE 0 END)::DOUBLE, 6) AS cluster_score,
        CASE WHEN n = 1 THEN 'singleton' WHEN NOT {graph('reasons')} THEN 'best representative by score' WHEN outsiders > 0 THEN 'graph member chosen over ' || outsiders || ' outsider(s)' ELSE 'graph member with best commentary' END AS lead_reason FROM c1""",
    "views0": f"""SELECT uri, author_did, 'u' || a AS author_handle, text, CASE WHEN event_id % 6 <> 0 THEN [lang] ELSE [] END AS langs, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS shown_at, external_uri, event_id % 50 AS likes, event_id % 9 AS replies,
        CASE WHEN external_uri IS NOT NULL AND event_id % 3 = 0 THEN 'Report ' || event_id || ' from ' || source END AS title, {strip('text')} AS t, 'https://bsky.app/profile/' || author_did || '/post/' || event_id AS web_url FROM posts WHERE event_id % 17 <> 0 AND a % 20 <> 12""",
    "views1": """SELECT *, CASE WHEN length(title) >= 10 AND (length(t) < 60 OR starts_with(t, '- ') OR starts_with(t, '"...') OR starts_with(t, chr(8220) || '...') OR starts_with(t, '...') OR starts_with(t, chr(9835)) OR starts_with(t, chr(9834)) OR starts_with(t, 'http') OR starts_with(t, 'www.')
        OR ((contains(t, 'http') OR contains(t, 'www.') OR contains(t, '.com/') OR contains(t, '.org/')) AND length(t) < 140) OR length(title) > length(t)) THEN title ELSE text END AS raw FROM views0""",
    "views": f"SELECT *, coalesce(nullif({clean('raw')}, ''), raw) AS headline FROM views1",
    "shown": "SELECT c.cluster_id, c.cluster_type, c.n, c.a, c.canonical_url, c.reasons, c.cluster_score, c.type_rank, c.first_rank, c.lead_post_uri, v.external_uri, v.text, v.author_did, v.author_handle, v.langs, v.headline, v.shown_at, v.web_url FROM (SELECT * FROM clusters ORDER BY cluster_score DESC, type_rank, first_rank LIMIT 40) c JOIN views v ON v.uri = c.lead_post_uri",
    "items": "SELECT * FROM (SELECT row_number() OVER (ORDER BY cluster_score DESC, type_rank, first_rank) - 1 AS pos, lead_post_uri AS uri, cluster_score AS score, reasons, cluster_type, cluster_id, n AS post_count, a AS unique_authors, canonical_url, external_uri, text, author_did, author_handle, langs, headline, shown_at, web_url FROM shown) WHERE pos < 30",
    "d0": f"SELECT *, {docket('coalesce(nullif(external_uri, ' + chr(39) * 2 + '), canonical_url)', 'reasons', 'author_handle')} AS family FROM items",
    "d1": f"SELECT *, count(family) OVER (PARTITION BY family) AS fn, row_number() OVER (PARTITION BY family ORDER BY score DESC, pos) AS nth, (post_count >= 3 AND unique_authors >= 2) OR {graph('reasons')} OR score > 6 AS strong, min(pos) OVER (PARTITION BY family) AS family_first FROM d0",
    "d2": "SELECT *, family IS NOT NULL AND fn >= 3 AND nth > 1 AND NOT strong AS folds FROM d1",
    "d3": "SELECT *, folds AND sum(folds::INT) OVER (PARTITION BY family) >= 2 AS folded FROM d2",
    "cards": "SELECT family, min(family_first) AS family_first, count(*) AS post_count, count(DISTINCT author_did) AS unique_authors, arg_min(uri, nth) AS uri, arg_min(score, nth) * 0.8 AS score, arg_min(reasons, nth) AS reasons, arg_min(external_uri, nth) AS external_uri, arg_min(web_url, nth) AS web_url, list_transform(list(headline ORDER BY nth)[1:5], lambda h: substr(h, 1, 80)) AS preview FROM d3 WHERE folded GROUP BY 1",
    "page0": "SELECT uri, score, reasons, cluster_type, cluster_id, post_count, unique_authors, canonical_url, external_uri, text, headline, langs, web_url, author_handle, false AS is_docket, pos AS fp, NULL AS subtitle, []::VARCHAR[] AS preview FROM d3 WHERE NOT folded UNION ALL SELECT uri, score, reasons, 'docket', 'docket_' || family, post_count, unique_authors, NULL, external_uri, '', CASE family "
    + " ".join(f"WHEN '{k}' THEN '{t}'" for k, (_, t, _) in dims.DOCKETS.items())
    + " END, [], web_url, '', true, family_first, CASE family "
    + " ".join(f"WHEN '{k}' THEN replace('{u}', '{{count}}', post_count::VARCHAR)" for k, (_, _, u) in dims.DOCKETS.items())
    + " END, preview FROM cards",
    "page": "SELECT *, row_number() OVER (ORDER BY score DESC, is_docket, fp) - 1 AS pos FROM page0",
    "domains": f"SELECT domain, count(*) AS n, min(pos) AS first_pos FROM (SELECT pos, {display('coalesce(nullif(external_uri, ' + chr(39) * 2 + '), canonical_url)')} AS domain FROM page) WHERE domain IS NOT NULL GROUP BY 1",
    "hero": f"""SELECT coalesce(min(pos), 0) AS hero_idx FROM (SELECT pos, reasons, coalesce(nullif(headline, ''), text) AS h, {clean("coalesce(nullif(headline, ''), text)")} AS cl, langs FROM page) WHERE length(cl) >= 20 AND (len(langs) = 0 OR list_contains(langs, 'en')) AND length(cl) >= length(h) * 0.4 AND NOT starts_with(cl, '- ')
        AND (list_contains(reasons, 'original') OR len(list_filter(reasons, lambda r: starts_with(r, 'substance') OR starts_with(r, 'domain:'))) > 0) AND NOT (len(regexp_extract_all(h, '\\p{{L}}')) > 10 AND len(regexp_extract_all(h, '[A-Za-z]')) < len(regexp_extract_all(h, '\\p{{L}}')) * 0.5)""",
    "stats": f"""SELECT count(*) AS total, sum(list_contains(reasons, 'original')::INT) AS originals, sum((cluster_type = 'url')::INT) AS url_clusters, sum((cluster_type = 'root')::INT) AS root_clusters, sum((cluster_type NOT IN ('url', 'root'))::INT) AS singletons,
        sum({graph('reasons')}::INT) AS graph_count, sum(list_contains(reasons, 'unknown_author')::INT) AS outsider_count, sum(is_docket::INT) AS docket_count FROM page""",
    "front": f"SELECT pos, uri, headline, cluster_type, is_docket, reasons, cluster_type = 'url' AS u, list_contains(reasons, 'unknown_author') AS o, {graph('reasons')} AND cluster_type <> 'url' AS g FROM page WHERE pos <> (SELECT hero_idx FROM hero) ORDER BY pos LIMIT 29",
    "front1": "SELECT *, is_docket OR (NOT g AND (u OR o)) AS ws, row_number() OVER (PARTITION BY is_docket OR (NOT g AND (u OR o)) ORDER BY pos) AS sn FROM front",
    "front2": "SELECT *, ws AND sn <= 8 AS src, g AND NOT (is_docket AND sn <= 8) AS wg FROM front1",
    "front3": "SELECT *, row_number() OVER (PARTITION BY wg ORDER BY pos) AS gn FROM front2",
}


def sql(select: str) -> str:
    """``select`` behind the views that it needs."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for name in CTES:
            bare = name.split("(")[0]
            if name not in need and re.search(rf"\b{bare}\b", text):
                need.append(name)
                add(CTES[name])

    add(select)
    if not need:
        return select
    return "WITH RECURSIVE " + ", ".join(f"{n} AS {'' if '(' in n else 'MATERIALIZED '}({CTES[n]})" for n in CTES if n in need) + " " + select
