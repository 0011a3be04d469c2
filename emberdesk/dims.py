"""Small dimensions. All values here are fixed: results depend on them being exactly these."""

PRIMARY = {
    "courtlistener.com": 3.5, "supremecourt.gov": 3.5, "congress.gov": 3.5, "sec.gov": 3.5, "uscourts.gov": 3.0, "pacer.gov": 3.0, "federalregister.gov": 3.0, "gao.gov": 3.0,
    "whitehouse.gov": 2.5, "state.gov": 2.5, "arxiv.org": 2.5, "pubmed.ncbi.nlm.nih.gov": 2.5, "rfc-editor.org": 2.5, "ietf.org": 2.5, "scholar.google.com": 2.0, "nature.com": 2.0,
    "science.org": 2.0, "github.com": 2.0, "gitlab.com": 2.0, "docs.python.org": 2.0, "developer.mozilla.org": 2.0, "w3.org": 2.0,
}
REPORTING = {
    "reuters.com": 2.0, "apnews.com": 2.0, "propublica.org": 2.0, "documentcloud.org": 2.0, "404media.co": 1.5, "themarkup.org": 1.5, "nytimes.com": 1.5, "washingtonpost.com": 1.5,
    "theguardian.com": 1.0, "bbc.com": 1.0, "bbc.co.uk": 1.0,
}
PLATFORMS = ["bsky.app", "bsky.social", "staging.bsky.app", "twitter.com", "x.com", "threads.net", "facebook.com", "instagram.com", "tiktok.com", "reddit.com", "t.co", "bit.ly", "linktr.ee"]
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "gclsrc", "ref", "ref_src", "ref_url", "si", "feature", "mc_cid", "mc_eid"]
STOPWORDS = ["the", "a", "an", "of", "in", "on", "at", "to", "for", "is", "are", "was", "and", "or", "but", "by", "with", "from", "that", "this", "has", "have"]
TITLE_FAMILIES = {
    "apnews.com": "wire", "reuters.com": "wire", "bbc.com": "wire", "bbc.co.uk": "wire", "congress.gov": "legislative", "courtlistener.com": "legal", "storage.courtlistener.com": "legal",
    "supremecourt.gov": "legal", "pubmed.ncbi.nlm.nih.gov": "research", "arxiv.org": "research", "nature.com": "research", "science.org": "research",
}
DOCKETS = {
    "congress": (["congress.gov", "congresstracker.bsky.social", "rules.house.gov", "senate.gov"], "Today in Congress", "{count} legislative items from congress.gov and trackers"),
    "research": (["pubmed.ncbi.nlm.nih.gov", "arxiv.org", "nature.com", "science.org", "scholar.google.com", "biorxiv.org", "medrxiv.org"], "Research Docket", "{count} papers from PubMed, arXiv, and journals"),
    "filings": (["sec.gov", "courtlistener.com", "storage.courtlistener.com", "supremecourt.gov", "uscourts.gov", "pacer.gov"], "Court & Filings", "{count} filings from courts and regulatory bodies"),
}
GRAPH_REASONS = ["mutual", "followed", "follower", "trusted_list"]
AUTHOR_WEIGHTS = {"u3": 0.25}
HORIZON_HOURS, PROFILE_DAYS, RETENTION_HOURS, EDITIONS_KEPT = 24, 7, 48, 100
PAGE_SIZE, BUFFER_PAGES, PER_AUTHOR, PER_THREAD, PER_LINK = 30, 5, 2, 3, 2
PER_URL, PER_FAMILY, DOCKET_LEAST = 1, 2, 3

BUSINESS_DOMAINS = [
    "bloomberg.com", "ft.com", "wsj.com", "cnbc.com", "marketwatch.com", "sec.gov", "federalreserve.gov", "treasury.gov", "techcrunch.com", "theinformation.com", "semafor.com", "platformer.news",
    "stratechery.com", "theverge.com", "nlrb.gov", "dol.gov", "bls.gov", "ftc.gov", "justice.gov", "ec.europa.eu", "azure.microsoft.com", "aws.amazon.com", "cloud.google.com",
]
BUSINESS_REGULATORS = ["sec.gov", "ftc.gov", "treasury.gov", "federalreserve.gov", "justice.gov", "nlrb.gov", "dol.gov", "bls.gov"]
BUSINESS_KEYWORDS = [
    "earnings", "revenue", "profit", "quarterly", "fiscal", "IPO", "merger", "acquisition", "antitrust", "monopoly", "layoff", "layoffs", "workforce", "labor", "union", "enterprise", "SaaS",
    "vendor", "pricing", "license", "market cap", "valuation", "stock", "shares", "regulatory", "regulation", "compliance", "FTC", "DOJ", "contract", "procurement", "vendor lock", "AI replace",
    "automation", "workflow", "moat", "lock-in", "switching cost",
]
SPORTS_DOMAINS = [
    "polymarket.com", "kalshi.com", "predictit.org", "draftkings.com", "fanduel.com", "betmgm.com", "espnbet.com", "sportico.com", "theathletic.com", "frontofficesports.com", "mlbpa.org",
    "nbpa.com", "nflpa.com", "ticketmaster.com", "stubhub.com", "seatgeek.com",
]
SPORTS_KEYWORDS = [
    "prediction market", "polymarket", "betting odds", "sportsbook", "gambling", "wager", "prop bet", "point spread", "parlay", "DraftKings", "FanDuel", "fantasy sports", "stadium deal",
    "stadium subsidy", "stadium financing", "naming rights", "arena deal", "taxpayer funded", "media rights", "broadcast deal", "streaming rights", "ticket prices", "Ticketmaster",
    "dynamic pricing", "NIL deal", "NIL collective", "transfer portal", "player union", "lockout", "CBA", "collective bargaining", "match fixing", "officiating", "referee", "private equity",
    "team valuation", "franchise value", "fan engagement", "gamification", "esports", "creator economy", "collectible", "trading card", "NFT",
]
WEATHER_DOMAINS = [
    "weather.gov", "nhc.noaa.gov", "spc.noaa.gov", "noaa.gov", "climate.gov", "drought.gov", "nws.noaa.gov", "fema.gov", "ready.gov", "disasterassistance.gov", "airnow.gov", "nifc.gov",
    "inciweb.wildfire.gov", "fire.ca.gov", "eia.gov", "ferc.gov", "nerc.com", "naic.org", "floodsmart.gov", "yaleclimateconnections.org", "carbonbrief.org", "insideclimatenews.org", "grist.org",
]
WEATHER_KEYWORDS = [
    "hurricane", "tropical storm", "typhoon", "cyclone", "tornado", "severe weather", "weather warning", "weather alert", "flood", "flooding", "flash flood", "storm surge", "wildfire",
    "brush fire", "forest fire", "fire season", "fire weather", "drought", "water shortage", "water crisis", "aquifer", "heat wave", "heat dome", "extreme heat", "heat advisory", "polar vortex",
    "winter storm", "blizzard", "ice storm", "power outage", "grid failure", "blackout", "brownout", "grid strain", "rolling blackout", "ERCOT", "insurance crisis", "insurance withdrawal",
    "uninsurable", "flood insurance", "FEMA", "disaster declaration", "air quality", "AQI", "smoke", "particulate", "sea level", "coastal erosion", "king tide", "crop failure", "crop damage",
    "agricultural", "infrastructure failure", "dam", "levee", "climate change", "global warming", "emission", "renewable", "solar", "wind power",
]
LENSES = {"business": (BUSINESS_DOMAINS, BUSINESS_KEYWORDS), "sports": (SPORTS_DOMAINS, SPORTS_KEYWORDS), "weather": (WEATHER_DOMAINS, WEATHER_KEYWORDS)}
TAGS = {
    "mutual": ("mutual", "mutual"), "followed": ("graph", "graph"), "follower": ("graph", "graph"), "trusted_list": ("graph", "trusted"), "unknown_author": ("outsider", "outsider"),
    "original": ("original", "original"), "substantive_reply": ("substance", "good reply"), "has_link": ("link", "linked"),
}
FIXTURE_DOMAINS = ["congress.gov", "arxiv.org", "www.reuters.com", "storage.courtlistener.com", "github.com", "apnews.com", "sec.gov", "bsky.app", "example.com", "weather.gov", "ticketmaster.com", "nature.com"]

#: Whom the watch page follows, by handle; positions are those of the page.
WATCHLIST = ["u3", "u1", "u8", "u12", "u2", "u16"]
HOUSE = ["did:u0", "did:u1"]
#: Seconds between runs of the periodic jobs.
CADENCE = {"rank": 120, "edition": 900, "messages": 300, "graph": 86_400, "seeds": 600}
#: Seconds from the start to a job's first run.
DELAY = {"rank": 0, "edition": 30, "messages": 60, "graph": 300, "seeds": 0}
