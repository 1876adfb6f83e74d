"""Text, URL and HTML functions on columns; all of them run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is reckoned once, however often the body names it.

    Column expressions are trees: a value named twice is written out twice, and steps that
    each name the one before grow as a power. A one-element array's ``transform`` binds it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bounded(terms: Iterable[str], plural: bool = False) -> str:
    """A pattern of whole ASCII words, longest first; Java's own boundary would be a Unicode one."""
    alternatives = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return rf"(?<![A-Za-z0-9_])(?:{alternatives}){'s?' if plural else ''}(?![A-Za-z0-9_])"


def has_word(text: Column | str, term: str) -> Column:
    """Whole-word test in text of any case: no ASCII letter on either side."""
    return F.lower(_col(text)).rlike(rf"(^|[^a-z]){re.escape(term.lower())}([^a-z]|\z)")


def title_fingerprint(title: Column | str) -> Column:
    """Letters and digits of a title in lower case."""
    return F.lower(F.regexp_replace(_col(title), "[^A-Za-z0-9]", ""))


def title_words(title: Column | str) -> Column:
    """Distinct words of ASCII letters and digits, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(title)), F.lit("[a-z0-9]+"), F.lit(0)))


def event_key(title: Column | str, noise: str = r"\s*-\s*open registration") -> Column:
    """A title without its noise phrase, as words with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(title)), noise, ""), "[^a-z0-9]+", " "))


def url_part(url: Column | str, part: str) -> Column:
    """scheme, host, path, query or fragment; empty when absent."""
    group = {"scheme": 1, "host": 2, "path": 3, "query": 4, "fragment": 5}[part]
    return F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", group)


def canonical_url(
    url: Column | str,
    schemes: tuple[str, ...] = ("https",),
    dropped: str = r"^(utm_.*|ref|ref_.*|source)$",
    host_names: Mapping[str, str] | None = None,
    bare_hosts: tuple[str, ...] = (),
) -> Column:
    """Lower-case scheme and host, without tracking parameters, fragment and final slash.

    ``host_names`` renames hosts, ``bare_hosts`` lose their whole query; a scheme outside
    ``schemes`` gives null.
    """
    u = _col(url)
    scheme, host = F.lower(url_part(u, "scheme")), F.lower(url_part(u, "host"))
    for old, new in (host_names or {}).items():
        host = F.when(host == old, new).otherwise(host)
    query = F.array_join(F.filter(F.split(url_part(u, "query"), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(dropped)), "&")
    query = F.when(host.isin(list(bare_hosts)), F.lit("")).otherwise(query)
    path = F.regexp_replace(url_part(u, "path"), r"/+\z", "")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin(list(schemes)), whole)


def single_segment(url: Column | str, hosts: tuple[str, ...]) -> Column:
    """Permalink test: one path segment on one of ``hosts``."""
    return F.lower(url_part(url, "host")).isin(list(hosts)) & url_part(url, "path").rlike(r"^/[^/]+/?\z")


def slug_of(url: Column | str) -> Column:
    """Last path segment, null when there is none."""
    return F.nullif(F.regexp_extract(url_part(url, "path"), r"([^/]+)/*\z", 1), F.lit(""))


def readable(text: Column | str, most: int = 54) -> Column:
    """Lower-case words joined by dashes, cut to ``most`` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), r"^-+|-+\z", ""), 1, most)


def stable_event_id(url: Column | str, own_hosts: tuple[str, ...] = (), most: int = 54) -> Column:
    """The slug on ``own_hosts``; elsewhere external-<readable>-<first 8 of sha256>."""
    u = _col(url)
    readable_part = readable(F.concat_ws("-", url_part(u, "host"), url_part(u, "path")), most)
    outside = F.concat(F.lit("external-"), readable_part, F.lit("-"), F.substring(F.sha2(u, 256), 1, 8))
    return F.when(single_segment(u, own_hosts), slug_of(u)).otherwise(outside) if own_hosts else outside


def content_hash(fields: Mapping[str, Column]) -> Column:
    """sha256 of the fields as an ordered JSON array of pairs; absent and null are both null, unlike empty."""
    quoted = lambda v: F.coalesce(F.to_json(F.array(v.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(v.cast("string")))) - 2), F.lit("null"))
    pairs = [F.concat(F.lit(f'["{name}",'), quoted(v), F.lit("]")) for name, v in fields.items()]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *pairs), F.lit("]")), 256)


# Named entities that are decoded (others stay), hidden elements, elements whose end is a line end.
ENTITIES = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "hellip": "…", "mdash": "-", "ndash": "–", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”"}
HIDDEN = ("script", "style", "template", "noscript")
ENDS_LINE = ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article")
_ENTITY = r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]+);"


def decode_entities(text: Column | str) -> Column:
    """Named, decimal and hexadecimal entities in one pass, so nothing is decoded twice; unknown ones and numbers that are no character stay."""
    named = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def character(e: Column, name: Column) -> Column:
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(name.startswith("#"), F.substr(name, F.lit(2))).cast("int")
        is_character = lambda c: (c > 0) & (c < 0x110000) & ~c.between(0xD800, 0xDFFF)
        return F.coalesce(bound(code, lambda c: F.when(is_character(c), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))), e)

    one = lambda e: bound(F.substr(e, F.lit(2), F.length(e) - 2), lambda name: F.coalesce(F.element_at(named, F.lower(name)), character(e, name)))

    def whole(t: Column) -> Column:
        """Each piece behind what the entity before it stands for; the two lists are made once, not for every piece."""
        found = F.concat(F.array(F.lit("")), F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(0)))
        return F.array_join(F.zip_with(F.split(t, _ENTITY, -1), found, lambda p, e: F.when(e == "", p).otherwise(F.concat(one(e), p))), "")

    return bound(_col(text), lambda t: F.when(t.contains("&"), whole(t)).otherwise(t))


def visible_text(html: Column | str) -> Column:
    """Text of a page: hidden elements and comments out, breaks and ends of blocks as line ends, blanks collapsed, two line ends at most."""
    out = F.regexp_replace(_col(html), rf"(?is)<({'|'.join(HIDDEN)})\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?i)<br\s*/?>|</(?:{'|'.join(ENDS_LINE)})>", "\n")
    out = decode_entities(F.regexp_replace(out, r"<[^>]+>", " "))
    out = F.regexp_replace(F.regexp_replace(out, "[ \\t\u00A0\u200B]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def page_title(html: Column | str, suffix: str | None = None) -> Column:
    """The title element, decoded, blanks collapsed, without a site's suffix."""
    raw = F.regexp_extract(_col(html), r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)
    out = F.trim(F.regexp_replace(decode_entities(raw), r"\s+", " "))
    return F.regexp_replace(out, suffix, "") if suffix else out


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag's text, in double quotes, single quotes or none, decoded; null where it is missing or empty."""
    shape = rf"""(?i)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
    value = F.concat(*[F.regexp_extract(tag, shape, k) for k in (1, 2, 3)])
    return F.nullif(F.trim(decode_entities(value)), F.lit(""))


def page_links(html: Column | str) -> Column:
    """Array of (href, text) in order; a text of one character or none gives way to aria-label, then title."""
    anchors = F.regexp_extract_all(_col(html), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))

    def one(a: Column) -> Column:
        tag, inner = F.regexp_extract(a, r"(?is)^<a\b([^>]*)>", 1), F.regexp_extract(a, r"(?is)^<a\b[^>]*>(.*)</a>\z", 1)
        text = F.trim(F.regexp_replace(visible_text(inner), r"\s+", " "))
        label = F.coalesce(attribute(tag, "aria-label"), attribute(tag, "title"), text)
        return F.struct(attribute(tag, "href").alias("href"), F.when(F.length(text) > 1, text).otherwise(label).alias("text"))

    return F.filter(F.transform(anchors, one), lambda x: x["href"].isNotNull())


def embedded_json(html: Column | str, kind: str = "application/json") -> Column:
    """Texts of script blocks of a type."""
    return F.regexp_extract_all(_col(html), F.lit(rf"""(?is)<script[^>]*type=["']{re.escape(kind)}["'][^>]*>(.*?)</script>"""), F.lit(1))


def looks_refused(title: Column, body: Column, n_events: Column, pattern: str = r"(?i)access denied|forbidden|just a moment|are you a robot", head: int = 600) -> Column:
    """A refusal page: by its title, or by the head of its text when it holds no structured events."""
    return title.rlike(pattern) | ((n_events == 0) & F.substring(body, 1, head).rlike(pattern))


def error_class(message: Column | str) -> Column:
    """misconfigured, throttled or failed."""
    m = _col(message)
    return F.when(m.rlike(r"(?i)HTTP 40[01]|auth|not allowed|validation"), "misconfigured").when(m.rlike("HTTP (429|503)"), "throttled").when(m.isNotNull(), "failed")


def first_money(text: Column | str, line: str = "(?i)prize") -> Column:
    """First dollar amount on the first line that matches ``line``."""
    hit = F.get(F.filter(F.split(_col(text), "\n"), lambda x: x.rlike(line) & x.rlike(r"\$\s?\d")), F.lit(0))
    return F.nullif(F.regexp_extract(hit, r"\$\s?\d[\d,]*(?:\.\d+)?[kKmM]?", 0), F.lit(""))


def amounts(text: Column | str) -> Column:
    """All dollar amounts as numbers; k and m multiply."""
    hits = F.regexp_extract_all(_col(text), F.lit(r"\$\s?(\d[\d,]*(?:\.\d+)?[kKmM]?)"), F.lit(1))

    def one(x: Column) -> Column:
        n = F.regexp_replace(x, "[,kKmM]", "").cast("double")
        return n * F.when(x.rlike("[kK]$"), 1e3).when(x.rlike("[mM]$"), 1e6).otherwise(1.0)

    return F.transform(hits, one)


def sum_of_first(values: Column, n: int) -> Column:
    """Sum of the first ``n`` values, null unless there are exactly ``n``."""
    return F.when(F.size(values) == n, F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x))


def tags(lines: Column, title: Column, text: Column, keywords: Mapping[str, str], most: int = 4, head: int = 500) -> Column:
    """Category lines first, then keyword tags over the title and the head of the text."""
    where = F.concat_ws(" ", title, F.substring(text, 1, head))
    named = F.filter(F.array(*[F.when(where.rlike(p), F.lit(t)) for t, p in keywords.items()]), lambda x: x.isNotNull())
    return F.slice(F.array_distinct(F.concat(F.coalesce(lines, F.array().cast("array<string>")), named)), 1, most)


def ladder(*steps: tuple[Column, str | Column]) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(None)
    for test, value in reversed(steps):
        out = F.when(test, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def resolve_city(place: Column | str, cities: Iterable[str]) -> Column:
    """First comma part that is a served city, else the first (longest) city in the text, in the list's spelling."""
    names = {c.lower(): c for c in cities}
    parts = F.filter(F.transform(F.split(F.lower(_col(place)), ","), lambda x: F.trim(x)), lambda p: p.isin(list(names)))
    found = F.coalesce(F.get(parts, F.lit(0)), F.nullif(F.lower(F.regexp_extract(_col(place), "(?i)" + bounded(names), 0)), F.lit("")))
    spelled = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.element_at(spelled, found)


def is_online(place: Column | str, flag: Column | None = None) -> Column:
    """The flag, or a place that is named online, virtual or remote."""
    by_name = F.coalesce(F.trim(_col(place)).rlike(r"(?i)^(online|virtual|remote)( event)?\z"), F.lit(False))
    return by_name if flag is None else F.coalesce(flag, F.lit(False)) | by_name


def ics_escape(text: Column | str) -> Column:
    """Backslash first, then semicolon, comma and line end."""
    out = F.replace(_col(text), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit(";"), F.lit("\\;")), F.lit(","), F.lit("\\,"))
    return F.replace(F.regexp_replace(out, "\r\n|\r", "\n"), F.lit("\n"), F.lit("\\n"))


def ics_fold(line: Column | str) -> Column:
    """A content line folded at 75 bytes, continuations at 74 behind a blank; characters stay whole.

    One pass over the text's bytes, each as a character: what begins inside of one is no place to fold.
    """
    raw = F.decode(F.encode(_col(line), "UTF-8"), "ISO-8859-1")
    folded = F.regexp_replace(raw, r"(?s)(?:^(?=.{76}).{1,75}|(?!^)\G(?=.{75}).{1,74})(?![\x80-\xBF])", "$0\r\n ")
    return F.decode(F.encode(folded, "ISO-8859-1"), "UTF-8")


def context_window(text: Column | str, needle: Column | str, before: int = 260, after: int = 160) -> Column:
    """What stands around the first occurrence of ``needle``; null where it does not occur."""
    t, n = _col(text), _col(needle)
    at = F.call_function("instr", t, n)
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substr(t, start, at - start + F.length(n) + after))


def result_links(html: Column | str, own_hosts: tuple[str, ...]) -> Column:
    """Distinct targets of a result page: redirect parameters unwrapped, the engine's own hosts out."""
    hrefs = F.transform(page_links(html), lambda x: x["href"])

    def one(h: Column) -> Column:
        wrapped = F.regexp_extract(h, r"[?&](?:q|uddg)=(https?[^&]+)", 1)
        return F.when(wrapped != "", F.call_function("try_url_decode", wrapped)).otherwise(h)

    return F.array_distinct(F.filter(F.transform(hrefs, one), lambda h: h.rlike("^https?://") & ~F.lower(url_part(h, "host")).isin(list(own_hosts))))


#: Hosts of the search engine itself, by name under any suffix (a fixed pattern).
ENGINE_HOSTS = r"(?i)^https?://(?:[a-z0-9-]+\.)*(?:google|gstatic|googleusercontent|youtube|googleapis|schema)\.[a-z.]+"


def search_results(body: Column | str) -> Column:
    """Array of (link, text) of a search response: the organic list of a JSON body, else the links of an HTML one.

    JSON comes first: ``organic`` or ``results.organic``, with link or url, title and
    description or snippet. HTML results have no text: redirect targets, then direct links
    that are not the engine's own, each once.
    """
    t = _col(body)
    v = F.try_parse_json(t)
    organic = F.coalesce(F.try_variant_get(v, "$.organic", "array<variant>"), F.try_variant_get(v, "$.results.organic", "array<variant>"))
    of = lambda r, *paths: F.coalesce(*[F.try_variant_get(r, f"$.{p}", "string") for p in paths])
    words = lambda r: F.trim(F.concat(F.coalesce(of(r, "title"), F.lit("")), F.lit(" "), F.coalesce(of(r, "description", "snippet"), F.lit(""))))
    listed = F.filter(F.transform(organic, lambda r: F.struct(of(r, "link", "url").alias("link"), words(r).alias("text"))), lambda r: r["link"].isNotNull())
    wrapped = F.transform(F.regexp_extract_all(t, F.lit(r"/url\?q=([^&\"'<>]+)"), F.lit(1)), lambda x: F.call_function("try_url_decode", x))
    direct = F.filter(F.regexp_extract_all(t, F.lit(r'href="(https?://[^"]+)"'), F.lit(1)), lambda x: ~x.rlike(ENGINE_HOSTS))
    links = F.array_distinct(F.concat(F.filter(wrapped, lambda x: x.rlike("^https?://")), direct))
    return F.coalesce(listed, F.transform(links, lambda x: F.struct(x.alias("link"), F.lit("").alias("text"))))


def template(text: Column | str, values: Mapping[str, Column]) -> Column:
    """``{name}`` places filled."""
    out = _col(text)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def join_filled(separator: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def going_count(text: Column | str, structured: Column | None = None) -> Column:
    """A structured count, else that of the first line of the form ``<n> Going``."""
    line = F.get(F.filter(F.split(_col(text), "\n"), lambda x: F.trim(x).rlike(r"^\d+ Going\z")), F.lit(0))
    parsed = F.regexp_extract(line, r"(\d+) Going", 1).cast("int")
    return parsed if structured is None else F.coalesce(structured, parsed)


_slavic_few = lambda n: (n % 10).between(2, 4) & ~(n % 100).between(12, 14)
_millions = lambda n: (n != 0) & (n % 1_000_000 == 0)
#: Plural forms of languages (fixed values): the form of a whole number is the first that fits, else ``other``.
PLURAL_RULES: dict[str, tuple[tuple[str, Callable[[Column], Column]], ...]] = {
    "en": (("one", lambda n: n == 1),),
    "es": (("one", lambda n: n == 1), ("many", _millions)),
    "fr": (("one", lambda n: n.isin(0, 1)), ("many", _millions)),
    "pl": (("one", lambda n: n == 1), ("few", _slavic_few), ("many", lambda n: F.lit(True))),
    "ru": (("one", lambda n: (n % 10 == 1) & (n % 100 != 11)), ("few", _slavic_few), ("many", lambda n: F.lit(True))),
    "ar": (("zero", lambda n: n == 0), ("one", lambda n: n == 1), ("two", lambda n: n == 2), ("few", lambda n: (n % 100).between(3, 10)), ("many", lambda n: (n % 100).between(11, 99))),
    "ja": (),
}
#: Separator of thousands, and the digits from which a number has one (fixed values).
GROUPED = {"en": (",", 4), "es": (".", 5), "fr": ("\u202f", 4), "pl": ("\u00a0", 5), "ru": ("\u00a0", 4), "ar": (",", 4), "ja": (",", 4)}


def plural_form(language: Column, n: Column) -> Column:
    """Name of the form that a number takes in a language; unknown languages have one form."""
    size = F.abs(n)
    out = F.when(F.lit(False), "")
    for code, rules in PLURAL_RULES.items():
        for form, fits in rules:
            out = out.when((language == code) & fits(size), form)
    return out.otherwise("other")


def grouped_number(language: Column, n: Column) -> Column:
    """A whole number with the language's separators."""
    plain, digits = F.format_number(n, 0), F.length(F.abs(n).cast("string"))
    out = F.when(F.lit(False), "")
    for code, (mark, least) in GROUPED.items():
        out = out.when(language == code, F.when(digits < least, n.cast("string")).otherwise(F.replace(plain, F.lit(","), F.lit(mark))))
    return out.otherwise(plain)


def catalog_text(catalog: Column, language: Column, key: Column, base: str = "en") -> Column:
    """A key's text: the language's, else the base language's, else the key itself. ``catalog`` maps ``language/key`` to texts."""
    at = lambda where: F.element_at(catalog, F.concat(where, F.lit("/"), key))
    return F.coalesce(at(language), at(F.lit(base)), key)


def plural_text(catalog: Column, language: Column, key: Column, n: Column, values: Mapping[str, Column] | None = None, base: str = "en") -> Column:
    """The text of a key for a number: its form in the language, ``other`` where neither catalog has that form; ``{count}`` and other places filled."""
    form = F.concat(key, F.lit("."), plural_form(language, n))
    there = F.coalesce(F.element_at(catalog, F.concat(language, F.lit("/"), form)), F.element_at(catalog, F.concat(F.lit(base), F.lit("/"), form))).isNotNull()
    chosen = F.when(there, form).otherwise(F.concat(key, F.lit(".other")))
    return template(catalog_text(catalog, language, chosen, base), {"count": grouped_number(language, n)} | dict(values or {}))
