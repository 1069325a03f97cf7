"""User agents and referers: medium, platform, operating system, browser and bot by tables of patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outputs of each user-agent field, in order of index, with the patterns that tell them (first match).
AGENT_FIELDS: dict[str, tuple[tuple[str, str], ...]] = {
    "platform": (("tablet", r"ipad|tablet|kindle|android(?!.*mobile)"), ("mobile", r"mobile|iphone|ipod|android|phone"), ("desktop", r"windows|macintosh|mac os x|linux|x11|cros")),
    "os": (("ios", r"iphone|ipad|ipod"), ("android", r"android"), ("windows", r"windows"), ("macosx", r"macintosh|mac os x"), ("chromeos", r"cros "), ("linux", r"linux|x11")),
    "browser": (("edge", r"edge?/|edga/|edgios/"), ("opera", r"opr/|opera"), ("samsung", r"samsungbrowser"), ("firefox", r"firefox/|fxios/"), ("chrome", r"chrome/|crios/"), ("safari", r"safari/"), ("ie", r"msie |trident/")),
    "bot": (("bot", r"bot|crawler|spider|slurp|curl/|wget/|python-requests|headless"),),
}


def agent_value(agent: Column, field: str) -> Column:
    """The field's value for a user agent, other if no pattern matches, NULL without an agent."""
    low = F.lower(agent)
    out = F.lit("other")
    for name, pattern in reversed(AGENT_FIELDS[field]):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return F.when(agent.isNotNull(), out)


#: Referer media in order of index.
MEDIA = ("unknown", "search", "internal", "social", "email", "paid")
#: Domains of media.
MEDIUM_DOMAINS = {
    "search": "google.com bing.com duckduckgo.com yahoo.com baidu.com yandex.ru ecosia.org startpage.com",
    "social": "facebook.com twitter.com x.com instagram.com linkedin.com reddit.com pinterest.com youtube.com tiktok.com",
    "email": "mail.google.com mail.yahoo.com outlook.live.com mail.ru",
    "paid": "doubleclick.net googleadservices.com adroll.com criteo.com",
}


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def medium(url: Column, internal: tuple[str, ...] = (), domains: dict[str, str] | None = None) -> Column:
    """The medium of a referer: the longest known domain that its host is or is under decides; own domains are internal."""
    host = domain(url)
    known = [(d, m) for m, ds in (domains or MEDIUM_DOMAINS).items() for d in ds.split()] + [(d, "internal") for d in internal]
    out = F.lit("unknown")
    for d, m in sorted(known, key=lambda x: len(x[0])):
        out = F.when((host == d) | host.endswith(f".{d}"), m).otherwise(out)
    return F.when(url.isNotNull(), out)


def medium_index(name: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*(F.lit(m) for m in MEDIA)), name) - 1, F.lit(0)).cast("int")
