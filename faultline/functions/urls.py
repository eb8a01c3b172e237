"""URL Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the original link rules.
COMMIT_URL_PATTERN = r"https://github\.com/([^/]+)/([^/]+)/commit/([a-f0-9]{7})"
LINK_HOSTS = ["https://github.com/", "http://github.com/"]
LINK_EXCLUDED = ["tree/HEAD/"]
LINK_KINDS = ["/issues/", "/pull/"]
ISSUE_ONLY_KINDS = ["/issues/"]
SECURITY_KIND = "/security/"
SECURITY_ADVERT_URL = "https://github.com/security/advanced-security"
HREF_PATTERN = 'href="([^"]+)"'
# ---------------------------------------------------------------------------

# scheme://host/first/second...
_PATH_PART = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def repo_parts(url) -> tuple[Column, Column]:
    """Repository URL -> (owner, repo): trim, ignore a trailing '/', take
    the first two path parts. Fewer than two parts gives NULLs (the original
    raised an error)."""
    u = F.trim(_col(url))
    owner = F.regexp_extract(u, _PATH_PART + r"/([^/?#]+)", 1)
    repo = F.regexp_extract(u, _PATH_PART + r"/[^/?#]+/([^/?#]+)", 1)
    both = (owner != "") & (repo != "")
    return F.when(both, owner), F.when(both, repo)


def url_groups(url, pattern: str = COMMIT_URL_PATTERN, groups: int = 3) -> list[Column]:
    """Capture groups of a URL pattern; no match gives NULL for all."""
    u = _col(url)
    return [_null_if_empty(F.regexp_extract(u, pattern, i)) for i in range(1, groups + 1)]


def hrefs(html) -> Column:
    """P4 + P5: every href value, newlines removed."""
    return F.transform(F.regexp_extract_all(_col(html), F.lit(HREF_PATTERN), 1),
                       lambda u: F.replace(u, F.lit("\n"), F.lit("")))


def origin(url) -> Column:
    """scheme://host of an absolute URL ('' when not absolute)."""
    return F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)


def resolve(href, base_url) -> Column:
    """Resolve a root-relative href against the origin of its page."""
    h = _col(href)
    return F.when(h.startswith("/") & ~h.startswith("//"), F.concat(origin(base_url), h)).otherwise(h)


def _any_contains(c: Column, needles) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | c.contains(n)
    return cond


def is_wanted_link(url, base_url, hosts=None, excluded=None, kinds=None,
                   security_kind: str | None = SECURITY_KIND,
                   security_advert: str | None = SECURITY_ADVERT_URL,
                   require_kind: bool = True) -> Column:
    """host test, exclusion test, kind test (or the security kind except
    one advert URL), and the page's own URL must not be a substring."""
    u = _col(url)
    hosts = LINK_HOSTS if hosts is None else hosts
    excluded = LINK_EXCLUDED if excluded is None else excluded
    kinds = LINK_KINDS if kinds is None else kinds
    host_ok = _any_contains(u, hosts) & ~_any_contains(u, excluded)
    kind_ok = _any_contains(u, kinds) if require_kind else F.lit(True)
    if require_kind and security_kind:
        sec = u.contains(security_kind)
        if security_advert:
            sec = sec & (u != security_advert)
        kind_ok = kind_ok | sec
    not_self = ~F.coalesce(F.instr(u, _col(base_url)) > 0, F.lit(False))
    return host_ok & kind_ok & not_self
