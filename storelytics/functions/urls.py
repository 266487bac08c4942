"""URL columns: validation, normal form, host, and resolving links against a page.

Native expressions throughout. Hosts are lower-cased but not converted from international to ASCII form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scheme, authority, path, query and fragment of a web address; any number of slashes may follow the colon.
WEB = r"^(?i:(https?)):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
ANY_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
# An authority: user, host without forbidden characters (or an address in brackets), port.
AUTHORITY = r"^(?:.*@)?(?:\[[0-9A-Fa-f:.]+\]|(?:%[0-9A-Fa-f]{2}|[^\x00-\x20#/:<>?@\[\\\]^|%\x7F])+)(?::([0-9]*))?$"
# Characters that a path, query or fragment may hold as they are; everything else is percent-encoded.
PATH_SAFE = r"[!$-;=@-\[\]_a-z|~\\%]"
QUERY_SAFE = r"[!$-&(-;=?-~%]"
FRAGMENT_SAFE = r"[!#-;=?-_a-~%]"


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(url: Column) -> Column:
    names = ["scheme", "authority", "path", "query", "fragment"]
    return F.struct(*[F.regexp_extract(url, WEB, i + 1).alias(n) for i, n in enumerate(names)])


def _encode(text: Column, safe: str) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"({safe}+)|([^{safe[1:-1]}]+)"), F.lit(0))
    coded = F.transform(
        runs, lambda r: F.when(r.rlike(f"^{safe}"), r).otherwise(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20")))
    )
    return F.array_join(coded, "")


def _without_dots(path: Column) -> Column:
    """Drop ``.`` and ``..`` steps; one at the very end leaves a closing slash."""
    dots = F.array(F.lit("."), F.lit(".."))

    def closed(steps):
        return F.when(F.array_contains(dots, F.element_at(steps, -1)), F.concat(steps, F.array(F.lit("")))).otherwise(steps)

    kept = F.aggregate(
        once(F.split(F.regexp_replace(path, "^/", ""), "/"), closed),
        F.array().cast("array<string>"),
        lambda done, step: F.when(step == ".", done)
        .when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(step))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _host(authority: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))


def host(url: Column) -> Column:
    """Lower-case host of a web address, without user and port."""
    return _host(F.regexp_extract(url, WEB, 2))


def _authority(p: Column) -> Column:
    """User, lower-case host, and the port unless it is the scheme's own."""
    place = p["authority"]
    port = F.regexp_extract(place, "(:[0-9]+)$", 1)
    own = F.when(F.lower(p["scheme"]) == "https", ":443").otherwise(":80")
    return F.concat(F.regexp_extract(place, "^(.*@)", 1), _host(place), F.when(port == own, "").otherwise(port))


def _joined(p: Column) -> Column:
    path = F.regexp_replace(p["path"], r"\\", "/")
    return F.concat(
        F.lower(p["scheme"]), F.lit("://"), _authority(p), _without_dots(_encode(path, PATH_SAFE)),
        _encode(p["query"], QUERY_SAFE), _encode(p["fragment"], FRAGMENT_SAFE),
    )


def _valid(authority: Column) -> Column:
    port = F.coalesce(F.nullif(F.regexp_extract(authority, AUTHORITY, 1), F.lit("")), F.lit("0"))
    return authority.rlike(AUTHORITY) & F.coalesce(port.try_cast("int") <= 65535, F.lit(False))


def normal_url(url: Column) -> Column:
    """The address in normal form, or NULL where it is not a valid absolute URL."""

    def normal(text):
        web = once(_parts(text), lambda p: F.when(_valid(p["authority"]), _joined(p)))
        return F.when(text.rlike("^(?i:https?):"), web).when(text.rlike(ANY_SCHEME), text)

    return once(F.regexp_replace(F.trim(url), "[\t\r\n]", ""), normal)


def domain(url: Column) -> Column:
    """Host without its first ``www.``, wherever that stands."""
    return F.regexp_replace(host(url), r"^(.*?)www\.", "$1")


def resolve_url(base: Column, link: Column) -> Column:
    """The address a link on page ``base`` points to."""

    def target(at):
        p, text = at["page"], at["link"]
        origin = F.concat(F.lower(p["scheme"]), F.lit("://"), p["authority"])
        path = F.when(p["path"] == "", "/").otherwise(p["path"])
        return (
            F.when(text.rlike(ANY_SCHEME), text)
            .when(text.startswith("//"), F.concat(p["scheme"], F.lit(":"), text))
            .when(text.startswith("/"), F.concat(origin, text))
            .when(text.startswith("?"), F.concat(origin, path, text))
            .when(text.startswith("#"), F.concat(origin, path, p["query"], text))
            .when(text == "", F.concat(origin, path, p["query"]))
            .otherwise(F.concat(origin, F.regexp_replace(path, "[^/]*$", ""), text))
        )

    return normal_url(once(F.struct(_parts(base).alias("page"), F.trim(link).alias("link")), target))


def absolute_link(base: Column, link: Column) -> Column:
    """A link as the preview shows it: untouched if it starts with ``http``, else resolved."""
    return F.when(link.startswith("http"), link).otherwise(resolve_url(base, link))


def second_last_step(url: Column) -> Column:
    """The step before the last slash, which product addresses use for the product id."""
    steps = F.split(url, "/")
    return F.when(F.size(steps) < 2, url).otherwise(F.get(steps, F.size(steps) - 2))
