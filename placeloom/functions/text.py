"""Names, postcodes, hosts and other text of a place directory, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which organisation it is.
STOP_TOKENS = ("a", "an", "and", "at", "for", "in", "of", "the", "to", "uk", "ltd", "limited", "trust", "charity", "registered")

# Names of parent bodies rather than of one place.
PARENT_PATTERNS = (r"\bwelfare\s+association\b", r"\beducation\s+society\b", r"\beducation\s+trust\b", r"\borganisation\b", r"\borganization\b", r"\bcharity\b", r"\bfalah\s+education\b")

# Hosts by class; subdomains belong to them too.
AGGREGATORS = ("praysalat.com", "nearestmosque.com", "mosquedirectory.co.uk", "islamicfinder.org", "islamicfinder.com", "masjidway.com", "masjidway.org", "mosquepay.com", "alfafaa.com", "mosquefinder.com", "mosquefinder.co.uk", "salah.com", "muslimsinbritain.org", "mosque.uk", "getprayer.com", "mosques.org.uk", "mosqueradar.com", "salahtimes.com", "londonprayertimes.com")
UMBRELLAS = ("towerhamletsmosques.co.uk", "ismaili.net")
WIDGETS = ("mawaqit.net", "masjidbox.com", "masjidal.com", "athanplus.com")

# Fragments of hosts that are no place's own site.
DENIED_FRAGMENTS = ("register-of-charities.charitycommission.gov.uk", "oscr.org.uk", "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "linkedin.com", "wikipedia.org")

# Hosts of directories and social networks that are never a place's own site, each for itself.
DIRECTORY_HOSTS = (
    "facebook.com", "www.facebook.com", "m.facebook.com", "twitter.com", "www.twitter.com", "x.com", "instagram.com", "www.instagram.com",
    "youtube.com", "www.youtube.com", "youtu.be", "linkedin.com", "www.linkedin.com", "yell.com", "www.yell.com", "tripadvisor.com", "www.tripadvisor.com",
    "yelp.co.uk", "www.yelp.co.uk", "google.com", "www.google.com", "maps.google.com", "muslimsinbritain.org", "www.muslimsinbritain.org",
    "mosques.muslimsinbritain.org", "nearestmosque.com", "www.nearestmosque.com", "mosquefinder.co.uk", "www.mosquefinder.co.uk", "mosqueiq.com", "www.mosqueiq.com",
    "find-and-update.company-information.service.gov.uk", "register-of-charities.charitycommission.gov.uk", "oscr.org.uk", "www.oscr.org.uk",
    "wikidata.org", "www.wikidata.org", "wikipedia.org", "en.wikipedia.org",
)

# Words of failures that pass, and of those that stay.
PASSING = ("http 500", "http 502", "http 503", "http 504", "timed out", "timeout", "connection reset", "connection refused", "temporarily")
LASTING = ("cannot resolve host", "name or service not known", "getaddrinfo", "http 404", "http 410", "http 401", "http 403", "certificate_verify_failed", "ssl", "blocked host address", "source url has no scheme or host")


# Words of an author's reasons, by category.
DIRECTORY_WORDS, NO_TIMES_WORDS = ("aggregator", "directory listing"), ("no jamaat", "no prayer timetable")
AGENT_WORDS = ("did not write the json result", "agent")


def blank_to_null(c: Column) -> Column:
    return F.nullif(squeezed(c), F.lit(""))


def squeezed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_name(c: Column) -> Column:
    """Lower case, what is neither word character nor white space as space, one space between words."""
    return squeezed(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "))


def normalise_postcode(c: Column) -> Column:
    """OUT IN for a British postcode, AAA BBBB for an Irish one, else compact upper case; blank is null."""
    compact = F.regexp_replace(F.upper(c), r"(?U)\s+", "")
    size = F.char_length(compact)
    british = compact.rlike(r"^[A-Z]{1,2}\d[A-Z\d]?\d[A-Z]{2}$")
    irish = compact.rlike(r"^[A-Z0-9]{7}$")
    return (
        F.when(size < 5, F.nullif(compact, F.lit("")))
        .when(british, F.regexp_replace(compact, r"^(.*)(.{3})$", "$1 $2"))
        .when(irish, F.regexp_replace(compact, r"^(.{3})(.{4})$", "$1 $2"))
        .otherwise(compact)
    )


def compact_postcode(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(c), r"(?U)\s+", ""), F.lit(""))


def normalise_city(c: Column) -> Column:
    return F.nullif(squeezed(F.lower(c)), F.lit(""))


def _full_url(c: Column) -> Column:
    bare = F.trim(c)
    return F.when(F.instr(c, "://") > 0, bare).otherwise(F.concat(F.lit("https://"), bare))


def domain_of(c: Column) -> Column:
    """Host and port of a url, lower case, without one leading www.; a missing scheme is https."""
    host = F.lower(F.regexp_extract(_full_url(c), r"^[^:]*://([^/?#]*)", 1))
    return F.when(F.trim(c) != "", F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit("")))


def canonical_homepage(c: Column) -> Column:
    """scheme://host/path: no query or fragment, no slash at the end, but / for an empty path."""
    full = _full_url(c)
    scheme = F.lower(F.regexp_extract(full, r"^([^:]*)://", 1))
    path = F.regexp_replace(F.regexp_extract(full, r"^[^:]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    host = domain_of(c)
    return F.when(host.isNotNull(), F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, F.when(path == "", "/").otherwise(path)))


def significant_tokens(name: Column) -> Column:
    """Distinct words of a normalised name of three letters or more that aren't stop words."""
    return F.array_distinct(F.filter(F.split(normalise_name(name), " "), lambda t: (F.char_length(t) >= 3) & ~t.isin(*STOP_TOKENS)))


def shared_tokens(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(significant_tokens(a), significant_tokens(b)))


def is_parent_name(name: Column) -> Column:
    return F.coalesce(name.rlike("(?i)" + "|".join(PARENT_PATTERNS)), F.lit(False))


def _literal(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def in_domains(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether host is one of the domains or a subdomain of one; a bounded list, so no join."""
    return F.coalesce(F.lower(host).rlike(rf"(^|\.)({_literal(domains)})\.?$"), F.lit(False))


def domain_class(host: Column, extra: dict[str, tuple[str, ...]] | None = None) -> Column:
    """aggregator, umbrella, widget or own; extra: further domains of a class. Long lists: operators.domains."""
    extra = extra or {}
    known = {"aggregator": AGGREGATORS, "umbrella": UMBRELLAS, "widget": WIDGETS}
    out = F.lit("own")
    for name, domains in reversed(known.items()):
        out = F.when(in_domains(host, (*domains, *(d.lower() for d in extra.get(name, ())))), name).otherwise(out)
    return out


def is_directory_host(host: Column) -> Column:
    """Whether the host itself (without www.) is one of the directories; its subdomains and look-alikes aren't."""
    return F.coalesce(F.lower(host).isin(*DIRECTORY_HOSTS), F.lit(False))


def is_denied_host(host: Column) -> Column:
    """Whether a denied fragment of register entries lies anywhere in the host (so x.com also denies fedex.com)."""
    return F.coalesce(host.rlike(_literal(DENIED_FRAGMENTS)), F.lit(False))


def strip_tags(html: Column) -> Column:
    """Text between the tags, without script, style and noscript, white space squeezed."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    return squeezed(F.regexp_replace(text, r"(?s)<[^>]*>", " "))


def appears_in(needle: Column, text: Column, least: int = 1) -> Column:
    """Whether a text holds the needle, white space and non-breaking spaces aside."""
    tight = lambda c: F.lower(F.regexp_replace(c, r"(?iU)\s|&nbsp;|&#160;|&#xa0;", ""))
    return F.coalesce((F.char_length(tight(needle)) >= least) & F.contains(tight(text), tight(needle)), F.lit(False))


def content_kind(content_type: Column) -> Column:
    primary = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return (
        F.when(primary.isin("text/html", "application/xhtml+xml"), "html").when(primary == "application/pdf", "pdf")
        .when(primary.startswith("image/"), "image").when(primary.isin("application/json", "text/json"), "json").otherwise("unknown")
    )


def script_widget(content_type: Column, body: Column, below: int = 4000) -> Column:
    """Whether a short page is filled by its scripts."""
    html = F.coalesce(F.lower(content_type).startswith("text/html"), F.lit(False))
    lowered = F.lower(F.coalesce(body, F.lit("")))
    return html & ((lowered == "") | (lowered.contains("<script") & (F.char_length(lowered) < below)))


def failure_category(preflight: Column, reason: Column, invalid: Column, timed_out: Column) -> Column:
    """The first rule that fits: time-out, what the page fetch said, what the author said, failed checks."""
    some = lambda c, words: F.lower(c).rlike("|".join(w.replace(".", r"\.") for w in words))
    has = lambda c, *words: some(c, words)
    return (
        F.when(timed_out, "timeout")
        .when(has(preflight, "robots"), "blocked_robots")
        .when(F.lower(preflight).rlike(r"http 5\d\d") | some(preflight, PASSING), "transient_network")
        .when(some(preflight, LASTING), "dead_site")
        .when(preflight != "", "transient_network")
        .when(has(reason, *DIRECTORY_WORDS), "aggregator")
        .when(has(reason, *NO_TIMES_WORDS), "permanent_no_jamaat")
        .when(has(reason, *AGENT_WORDS), "agent_error")
        .when(invalid, "validation_failed")
        .otherwise("agent_error")
    )


def note_value(notes: Column, key: str) -> Column:
    """The value of key=value in a note; null if it is missing."""
    return F.nullif(F.regexp_extract(notes, rf"(?:^|[;\s]){key}=([^;\s]*)", 1), F.lit(""))


def source_hint(key: Column) -> Column:
    """The eight hex digits after the last underscore of a key."""
    return F.nullif(F.regexp_extract(key, r"_([0-9a-f]{8})$", 1), F.lit(""))


def checked_value(c: Column, allowed: tuple[str, ...]) -> tuple[Column, Column]:
    """(value, error) of a closed list: trimmed and lower case, or null and what is allowed."""
    value = F.lower(F.trim(c))
    good = F.coalesce(value.isin(*allowed), F.lit(False))
    return F.when(good, value), F.when(~good, F.concat(F.lit("expected one of: " + ", ".join(allowed) + "; got "), F.coalesce(c, F.lit("null"))))
