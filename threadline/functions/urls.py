"""Column functions on urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two page families and how strictly each caller matches them.
WATCH_PREFIX = "https://www.youtube.com/watch"
WATCH_PART = "youtube.com/watch"
POST_PREFIXES = ("https://www.instagram.com/p/", "https://www.instagram.com/reel/")
POST_PATTERN = r"instagram\.com/(p|reel)/"


def page_family(url: Column, strict: bool = True) -> Column:
    """"watch", "post" or null. Strict: by scheme, host and path; else wherever the part stands."""
    if strict:
        watch, post = url.startswith(WATCH_PREFIX), url.startswith(POST_PREFIXES[0]) | url.startswith(POST_PREFIXES[1])
    else:
        watch, post = url.contains(WATCH_PART), url.rlike(POST_PATTERN)
    return F.when(watch, "watch").when(post, "post")


def lc_param(href: Column, compat: bool = False) -> Column:
    """The comment id in a link, null without one. compat: whatever stands after any lc=, up to &."""
    if compat:
        return F.nullif(F.regexp_extract(href, "lc=([^&]+)", 1), F.lit(""))
    return F.nullif(F.regexp_extract(href, "^[^?#]*[?](?:[^#]*&)?lc=([^&#]+)", 1), F.lit(""))


def is_profile(href: Column) -> Column:
    """Whether a link leads to a path of one segment, on any host; false for what is no link."""
    other = href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    rooted = F.when(href.startswith("/"), href).otherwise(F.concat(F.lit("/"), href))
    full = F.when(other, href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(F.concat(F.lit("https://h"), rooted))
    return F.coalesce((~other | href.rlike("(?i)^https?:")) & F.try_parse_url(full, F.lit("PATH")).rlike("^/[^/?#]+/?$"), F.lit(False))
