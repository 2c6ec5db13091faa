"""Three URL normalisers (they differ on purpose), domains, and which links a crawl follows."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# A crawled URL has one of these.
FOCUS = tuple(
    "geolog geology earth-science earthscience mineral mineralogy volcano volcanic volcan seismic seismology earthquake tecton tectonic rock- rocks "
    "fossil fossils sediment sedimentary geomorph stratigraphy stratigraph petrology petrograph geophysic geochemist hydrogeol groundwater usgs "
    "bgs.ac.uk noaa.gov iris.edu serc.carleton geonet geoscience geo-science earthobservatory mindat litholog geohazard geothermal paleontol "
    "paleozoic mesozoic cenozoic igneous metamorphic magma lava fault bedrock".split()
)
# A crawled URL has none of these.
JUNK = tuple(
    "/contact /about-us /about_us contact-us contactus /team /staff /careers /jobs /employment /privacy /terms /legal /disclaimer /cookie /advertis "
    "/sponsor /partner /login /signin /signup /register /account /cart /checkout /shop /store /product /social /twitter /facebook /instagram "
    "/linkedin /youtube /tiktok /pinterest share= utm_ ref= source=social /newsletter /subscribe /unsubscribe /sitemap /tag/ /author/ /wp-admin "
    "/cdn-cgi /static/ /assets/ javascript: mailto: tel:".split()
)
# Files that are no pages.
BINARY = tuple(f".{x}" for x in "jpg jpeg png gif webp svg ico pdf doc docx xls xlsx ppt pptx zip tar gz mp3 mp4 avi css js json xml".split())
# Parameters that name no other page.
TRACKING = ("replytocom", "currency", "return_to")
DEFAULT_PORTS = {"http": 80, "https": 443}


def crawl_url(url: str | None) -> str:
    """The form in which a crawl knows a URL: http or https only, host lower-cased, no default port, one slash at a time, dots resolved, no
    slash at the end, query sorted, no fragment. Empty if it isn't a URL to crawl."""
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ""
    scheme = parts.scheme.lower()
    if scheme not in DEFAULT_PORTS or not host:
        return ""
    place = host if port in (None, 0, DEFAULT_PORTS[scheme]) else f"{host}:{port}"
    path = posixpath.normpath(re.sub("/+", "/", parts.path or "/"))
    path = path if path.startswith("/") else "/" + path
    return urlunsplit((scheme, place, path, urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True))), ""))


def visited_url(url: str | None) -> str:
    """The form in which visited URLs are compared: as crawl_url, but with ports, parameters and inner slashes as they are."""
    parts = urlsplit(url or "")
    path = parts.path if parts.path == "/" else parts.path.rstrip("/")
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), path, urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True))), ""))


def page_url(url: str | None) -> str:
    """The form in which a corpus knows a page: https if no scheme is given, host lower-cased, no slash at the end, tracking parameters
    dropped, query order kept, no fragment."""
    text = (url or "").strip()
    if not text:
        return ""
    parts = urlsplit(text)
    pairs = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in TRACKING]
    return urlunsplit((parts.scheme.lower() or "https", parts.netloc.lower(), parts.path.rstrip("/"), urlencode(pairs), ""))


def _column(of: Callable[[str | None], str]):
    def run(urls: pd.Series) -> pd.Series:
        seen: dict = {}
        return urls.map(lambda u: seen[u] if u in seen else seen.setdefault(u, of(u)))

    return F.pandas_udf(run, "string")


def crawl_url_of(url: Column) -> Column:
    return _column(crawl_url)(url)


def visited_url_of(url: Column) -> Column:
    return _column(visited_url)(url)


def page_url_of(url: Column) -> Column:
    return _column(page_url)(url)


def netloc(url: Column) -> Column:
    """Host and port as given, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def domain(url: Column) -> Column:
    """Host without port or leading www., lower-cased; null if there is none."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.regexp_replace(host, r"^www\.", "")


def is_link_allowed(url: Column) -> Column:
    """http or https, no binary file, nothing of JUNK and something of FOCUS, all lower-cased."""
    low = F.lower(F.coalesce(url, F.lit("")))
    path = F.regexp_extract(low, r"^https?://[^/?#]*([^?#]*)", 1)
    has = lambda words: "|".join(map(re.escape, words))
    return low.rlike("^https?:") & ~path.rlike(f"(?:{has(BINARY)})$") & ~low.rlike(has(JUNK)) & low.rlike(has(FOCUS))
