"""Link and domain functions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def authority(u: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), r"^.*@", "")


def host(u: Column) -> Column:
    """Lower-case host without port and ``www.``; null if there is none."""
    h = F.regexp_replace(F.lower(authority(u)), r":[0-9]*$", "")
    return F.nullif(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(c), c)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical(u: Column) -> Column:
    """One form for links to the same page: no fragment, tracking, blank parameters or default port."""
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    h, port = F.coalesce(host(u), F.lit("")), F.regexp_extract(authority(u), r":([0-9]+)$", 1)
    path = F.regexp_replace(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1), r";[^/]*$", "")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("=.") & ~F.lower(F.substring_index(p, "=", 1)).isin(dims.TRACKING))
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    grouped = F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.array_position(keys, F.substring_index(p, "=", 1)).alias("g"), i.alias("i"), p.alias("p"))))
    kept = F.array_join(F.transform(grouped, lambda x: F.concat(_encoded(F.substring_index(x["p"], "=", 1)), F.lit("="), _encoded(F.regexp_extract(x["p"], "^[^=]*=(.*)$", 1)))), "&")
    video = h.isin("youtube.com", "m.youtube.com", "youtu.be")
    short = video & path.startswith("/shorts/")
    vid = F.coalesce(F.nullif(F.regexp_extract(query, r"(?:^|&)v=([^&]+)", 1), F.lit("")), F.substring_index(path, "/", -1))
    q = F.when(short & (vid != ""), F.concat(F.lit("v="), vid)).otherwise(kept)
    p = F.when(short, "/watch").otherwise(path)
    shown = F.when((port != "") & ~port.isin("80", "443"), F.concat(F.lit(":"), port)).otherwise("")
    base = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), F.when(video, "youtube.com").otherwise(h), shown, p)
    return F.when(F.coalesce(u, F.lit("")) == "", "").otherwise(F.concat(base, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def key16(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def parents(d: Column) -> Column:
    """The domains above ``d``, nearest first."""
    parts = F.split(d, r"\.")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _above(d: Column, values: dict) -> Column:
    table = _table(values)
    return F.get(F.filter(F.transform(parents(d), lambda p: table[p]), lambda v: v.isNotNull()), 0)


def within(d: Column, domains: list[str]) -> Column:
    """True if ``d`` is one of ``domains`` or below one."""
    own = F.lower(F.trim(d))
    return F.coalesce(own.isin(domains) | F.exists(parents(own), lambda p: p.isin(domains)), F.lit(False))


def is_platform(d: Column) -> Column:
    return within(d, dims.PLATFORMS)


def bonus(d: Column) -> Column:
    own = F.lower(F.trim(d))
    exact = F.coalesce(_table(dims.PRIMARY)[own], _table(dims.REPORTING)[own])
    found = F.coalesce(exact, _above(own, dims.PRIMARY), _above(own, dims.REPORTING), F.lit(0.0))
    return F.when(is_platform(d) | d.isNull(), 0.0).otherwise(found)


def title_family(d: Column) -> Column:
    own = F.lower(d)
    return F.coalesce(_table(dims.TITLE_FAMILIES)[own], _above(own, dims.TITLE_FAMILIES), own)


def display_domain(u: Column) -> Column:
    """The known domain that ``u`` lies in, else its host; null for platforms."""
    d = host(u)
    known = {k: k for k in [*dims.PRIMARY, *dims.REPORTING]}
    return F.when(d.isNotNull() & ~is_platform(d), F.coalesce(_table(known)[d], _above(d, known), d))


def docket_family(link: Column, reasons: Column, handle: Column) -> Column:
    """The document family of an item: by its link's domain, its domain reasons, then its author's handle."""
    d = host(link)
    by_link = [F.when(within(d, ds), f) for f, (ds, _, _) in dims.DOCKETS.items()]
    of = {x: f for f, (ds, _, _) in reversed(dims.DOCKETS.items()) for x in ds}
    named = F.transform(F.filter(reasons, lambda r: r.startswith("domain:")), lambda r: _table(of)[F.get(F.split(r, ":"), 1)])
    by_reason = F.get(F.filter(named, lambda v: v.isNotNull()), 0)
    return F.coalesce(*by_link, by_reason, F.when(F.lower(handle).contains("congress"), "congress"))


def web_url(uri: Column) -> Column:
    parts = F.split(F.replace(uri, F.lit("at://"), F.lit("")), "/")
    return F.when(F.size(parts) >= 3, F.concat(F.lit("https://bsky.app/profile/"), parts[0], F.lit("/post/"), parts[2])).otherwise("")


def short_link(u: Column, limit: int) -> Column:
    bare = F.replace(F.replace(u, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.when(F.length(bare) <= limit, bare).otherwise(F.concat(F.substring(bare, 1, limit - 3), F.lit("...")))


def last_segment(uri: Column) -> Column:
    """What stands behind the last slash: a feed's name, a post's key."""
    return F.element_at(F.split(uri, "/"), -1)
