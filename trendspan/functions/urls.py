"""Column functions over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and of them those that a URL key drops.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid", "msclkid"]
KEY_TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid"]
# Sites that are social, and sites that hold data.
SOCIAL_DOMAINS = ["x.com", "twitter.com", "t.co", "tweetdeck.twitter.com", "mobile.twitter.com", "linkedin.com", "lnkd.in", "threads.net", "reddit.com", "redd.it", "old.reddit.com", "news.ycombinator.com", "hn.algolia.com", "dev.to", "clien.net", "facebook.com", "fb.com", "instagram.com", "instagr.am", "tiktok.com", "vm.tiktok.com", "news.hada.io", "geeksforgeeks.org", "geeks.kr", "geeks.co.kr", "mastodon.social", "velog.io", "hashnode.com", "discord.com", "discord.gg", "blog.naver.com", "cafe.naver.com", "m.blog.naver.com", "m.cafe.naver.com", "tistory.com", "brunch.co.kr"]
DATA_DOMAINS = ["youtube.com", "youtu.be", "m.youtube.com", "vimeo.com", "dailymotion.com", "twitch.tv", "loom.com", "docs.google.com", "drive.google.com", "colab.research.google.com", "slideshare.net", "speakerdeck.com", "figshare.com", "zenodo.org", "kaggle.com", "huggingface.co", "osf.io", "dropbox.com", "onedrive.live.com", "unsplash.com", "images.unsplash.com", "pexels.com", "pixabay.com", "imgur.com", "flickr.com", "giphy.com", "tenor.com", "media.githubusercontent.com", "raw.githubusercontent.com", "arxiv.org", "openreview.net", "aclanthology.org", "dblp.org", "ieeexplore.ieee.org", "springer.com", "link.springer.com", "sciencedirect.com", "dl.acm.org", "semanticscholar.org", "researchgate.net", "paperswithcode.com", "doi.org", "biorxiv.org", "medrxiv.org", "jmlr.org", "nature.com", "science.org"]
# What in a URL (and the last one, in a title) tells of data.
HOSTED_VIDEO = r"(?i)(?:youtube\.com|youtu\.be|vimeo\.com|dailymotion\.com|twitch\.tv|loom\.com)"
HOSTED_DOCUMENT = r"(?i)(?:docs\.google\.com|drive\.google\.com|colab\.research\.google\.com|slideshare\.net|speakerdeck\.com|notion\.(?:so|site))"
IMAGE_OR_VIDEO = r"(?i)\.(?:png|jpe?g|gif|webp|bmp|svg|tiff|avif|mp4|mov|avi|mkv|webm|flv|m3u8)(?:$|[?#])"
DATA_FILE = r"(?i)\.(?:pdf|csv|tsv|json|jsonl|xml|yaml|yml|parquet|xls|xlsx|doc|docx|ppt|pptx|zip|tar|gz|7z)(?:$|[?#])"
FILE_TYPE = r"(?i)(?:filetype=pdf|format=pdf|download=1|output=1)"
ACADEMIC = r"(?i)(?:arxiv|openreview|aclanthology|semanticscholar|researchgate|paperswithcode|preprint|doi\.org|whitepaper|technical\s*report|benchmark|leaderboard|supplementary)"


def host(url: Column) -> Column:
    """The host without www., or the text itself where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), url)


def normalize_host(value: Column) -> Column:
    """A host written in any way: without scheme, www., port and slashes."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"^https?://", ""), r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(t, "/+$", ""), r":\d+$", "")


def in_domains(domain: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (domain == d) | F.endswith(domain, F.concat(F.lit("."), d)))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def sanitize(url: Column) -> Column:
    """Without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")


def _query_parts(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")


def _name(part: Column) -> Column:
    return F.substring_index(part, "=", 1)


def url_key(url: Column, dropped: list[str] = KEY_TRACKING) -> Column:
    """What first-wins dedup compares: without fragment, tracking parameters and trailing slashes."""
    kept = F.filter(_query_parts(url), lambda p: ~_name(p).isin(*dropped))
    path = F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), "/+$", "")
    return F.concat(path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, tracking parameters and empty ones gone, each name once, sorted by name, no fragment."""
    kept = F.filter(_query_parts(url), lambda p: p.rlike("=.") & ~F.lower(_name(p)).isin(*TRACKING))
    first = F.filter(kept, lambda p, i: F.size(F.filter(F.slice(kept, F.lit(1), i), lambda q: _name(q) == _name(p))) == 0)
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.array_sort(F.transform(first, lambda p: F.struct(plain(_name(p)).alias("k"), plain(F.regexp_extract(p, "=(.*)$", 1)).alias("v"))))
    head = F.regexp_extract(url, r"^([^/]*//[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[^/]*//[^/?#]*([^?#]*)", 1)
    query = F.array_join(F.transform(pairs, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
    return F.concat(F.lower(head), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def github_repo(url: Column) -> Column:
    """owner/repo of a GitHub URL, in lower case; else null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/]*\.)?github\.com/([^/?#]+/[^/?#]+)", 1)), F.lit(""))


def youtube_id(text: Column) -> Column:
    """A video's id: the id itself, or from the usual forms of its URL; else null."""
    forms = [r"^([A-Za-z0-9_-]{11})$", r"youtu\.be/([A-Za-z0-9_-]{11})", r"youtube\.com/watch\?(?:[^#]*&)?v=([A-Za-z0-9_-]{11})", r"youtube\.com/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})"]
    return F.coalesce(*(F.nullif(F.regexp_extract(text, f, 1), F.lit("")) for f in forms))


def source_category(kind: Column, domain: Column, url: Column, title: Column | None = None) -> Column:
    """social, data or news: by a given type, then by site, then by what URL and title tell of data."""
    stored = F.lower(F.coalesce(kind, F.lit("")))
    d = F.coalesce(F.nullif(normalize_host(F.coalesce(domain, F.lit(""))), F.lit("")), normalize_host(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))))
    u, t = F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")) if title is not None else F.lit("")
    told = u.rlike(HOSTED_VIDEO) | u.rlike(HOSTED_DOCUMENT) | u.rlike(IMAGE_OR_VIDEO) | u.rlike(DATA_FILE) | u.rlike(FILE_TYPE) | u.rlike(ACADEMIC) | t.rlike(ACADEMIC)
    return (
        F.when(stored.isin("social", "data"), stored)
        .when(stored.isin("video", "image"), "data")
        .when(in_domains(d, SOCIAL_DOMAINS), "social")
        .when(in_domains(d, DATA_DOMAINS) | told, "data")
        .otherwise("news")
    )


def primary_type(news: Column, social: Column, data: Column, first: Column) -> Column:
    """The category most sources are of; ties go to the first source's, then social, data, news. Social leads only alone."""
    tie = lambda c, n: F.when(first == c, 0).otherwise(n)
    row = lambda n, c, t: F.struct((-n).alias("n"), tie(c, t).alias("t"), F.lit(c).alias("c"))
    best = F.least(row(news, "news", 3), row(social, "social", 1), row(data, "data", 2))["c"]
    trusted = F.least(row(news, "news", 3), row(data, "data", 2))["c"]
    return F.when((best == "social") & (news + data > 0), trusted).when(news + social + data == 0, "news").otherwise(best)


def absolute(link: Column, base: Column) -> Column:
    """A link from a page as a whole URL."""
    scheme, origin = F.regexp_extract(base, "^([a-z]+:)", 1), F.regexp_extract(base, r"^([^/]*//[^/?#]*)", 1)
    return F.when(link.rlike("^https?://"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link)).when(F.startswith(link, F.lit("/")), F.concat(origin, link)).otherwise(F.concat(origin, F.lit("/"), link))
