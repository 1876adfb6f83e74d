"""Facts of a notice: what its title and its lines of evidence say, as column expressions.

A notice has a title, evidence (text in lines) and, where a source is structured, fields of
its own. All functions take and return columns and run in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightquay.functions.scoring import candidate_scores, clamp
from brightquay.functions.text import _col, bound, bounded

# The patterns by which notices are read.
ATHON = r"(?i)\b[a-z]{3,}[-\s]a[-\s]?thon\b"
STANDALONE_HACK = r"(?i)\bhacks?\b"
BUILDERS_COMPETE = r"(?i)\b(builders?|hackers?|developers?|engineers?|coders?|teams?)\b[^.\n]{0,30}\bcompete\b"
FORMATS = r"(?i)\b(meet[-\s]?ups?|conference|summit|webinar|expo|mixer|happy hour|fireside|panel|screening|dinner|networking|workshop|office hours|pitch night|demo night|launch party|party|social|talk|talks|showcase|open house|salons?|series|roundtable|symposium|forum|town hall|book club|concert|film)\b"
SHORT_FORMATS = r"(?i)\b(meetup|happy hour|fireside|conference|screening|dinner|networking|workshop)\b"
REWARDS = r"(?i)\b(prize|bount(?:y|ies)|cash|credits?)\b"
MONEY = r"\$\s?\d[\d,]*(?:\.\d+)?\s?[kK]?\+?"
PRIZES_TO_COME = r"(?i)priz\w*\s*(pool)?\s*[:\-]?\s*(tba|tbd|to be announced|coming soon)"
STATUS_BASE = {"Open": 92, "Approval": 74, "Waitlist": 45, "Closed": 28, "Sold out": 35}
KEYWORD_TAGS = {
    "Agents": r"(?i)\bagent",
    "Voice AI": r"(?i)\bvoice\b",
    "Infra": r"(?i)\binfra(structure)?\b",
    "Vibe coding": r"(?i)vibe.?cod",
    "Social impact": r"(?i)social (good|impact)",
    "Token economy": r"(?i)\btoken",
    "Data": r"(?i)\bdata\b",
    "Design": r"(?i)\bdesign",
}


@dataclass(frozen=True)
class Vocabulary:
    """Patterns of one scorer: terms of the format, signs of building, competing, other formats, registering."""

    terms: tuple[str, ...] = ("hackathon", "buildathon", "datathon", "game jam", "code sprint")
    build: str = r"(?i)\b(build|prototype|ship|demo|project|team up|submission)\b"
    compete: str = r"(?i)\b(prize|prizes|judg(?:e|es|ing)|winner|leaderboard|award|bounty|track)\b"
    negative: str = SHORT_FORMATS
    register: str = r"(?i)\b(open|register|apply|application|request to join)\b"


#: The general scorer, that of crawled pages, and that of a source whose titles name every format.
GENERAL = Vocabulary()
PAGES = Vocabulary(
    build=r"(?i)\b(build|ship|prototype|code|hack|create|make|implement|develop)\w*\b",
    compete=r"(?i)\b(team|submission|deadline|judge|judging|winner|prize|bount(?:y|ies)|demo day|pitch)\w*\b",
    register=r"(?i)\b(open|register|approval required|request to join)\b",
)
TITLED = Vocabulary(negative=FORMATS)


def names_terms(text: Column | str, vocabulary: Vocabulary = GENERAL) -> Column:
    """A term of the format, a word of the shape x-a-thon, or builders who compete."""
    t = _col(text)
    return t.rlike("(?i)" + bounded(vocabulary.terms, plural=True)) | t.rlike(ATHON) | t.rlike(BUILDERS_COMPETE)


def names_format(title: Column | str, vocabulary: Vocabulary = GENERAL) -> Column:
    """:func:`names_terms`, or the word hack by itself; a null title names nothing."""
    t = F.coalesce(_col(title), F.lit(""))
    return names_terms(t, vocabulary) | t.rlike(STANDALONE_HACK)


def signals(title: Column | str, evidence: Column | str, place: str, vocabulary: Vocabulary = GENERAL) -> Column:
    """(direct, build, compete, negative, local, confidence, relevance); ``place`` is a pattern of served places."""
    title, evidence = F.coalesce(_col(title), F.lit("")), F.coalesce(_col(evidence), F.lit(""))
    both = F.concat_ws("\n", title, evidence)
    direct = names_terms(both, vocabulary) | title.rlike(STANDALONE_HACK)
    build, compete, negative, local = both.rlike(vocabulary.build), both.rlike(vocabulary.compete), title.rlike(vocabulary.negative), both.rlike(place)
    scores = candidate_scores(direct, build, compete, negative, local, both.rlike(vocabulary.register), both.rlike(REWARDS))
    return F.struct(direct.alias("direct"), build.alias("build"), compete.alias("compete"), negative.alias("negative"), local.alias("local"), scores["confidence"].alias("confidence"), scores["relevance"].alias("relevance"))


def place_pattern(cities: Iterable[str]) -> str:
    """Whole served places, longest first, in any case."""
    return "(?i)" + bounded(cities)


def lines_of(evidence: Column | str) -> Column:
    """Trimmed lines that hold something, without zero-width blanks."""
    return F.filter(F.transform(F.split(F.regexp_replace(_col(evidence), "\\u200B", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def prize(title: Column | str, evidence: Column | str) -> Column:
    """(amount, label): the first amount on a line about prizes, else to be announced, listed, or not listed."""
    text = F.concat_ws("\n", _col(title), _col(evidence))
    line = F.get(F.filter(F.split(text, "\n"), lambda x: x.rlike("(?i)priz|cash|bount|credits") & x.rlike(MONEY)), F.lit(0))
    amount = F.regexp_replace(F.regexp_extract(line, MONEY, 0), r"\s", "")
    label = (
        F.when(line.isNotNull(), F.concat(amount, F.when(line.rlike("(?i)cash"), " cash").otherwise(" prizes")))
        .when(text.rlike(PRIZES_TO_COME), "Prizes TBA")
        .when(text.rlike("(?i)priz|bount"), "Prizes listed")
        .otherwise("Not listed")
    )
    return F.struct(amount.alias("amount"), label.alias("label"))


def clean_prize(markup: Column | str) -> Column:
    """A prize without markup; nothing at all and zero are null."""
    text = F.trim(F.replace(F.regexp_replace(_col(markup), "<[^>]+>", ""), F.lit("&nbsp;"), F.lit(" ")))
    return F.when((text != "") & ~text.rlike(r"(?i)^\$?(?:CAD\s*)?0\z"), text)


def block_between(lines: Column, start: str, stop: str, most: int) -> Column:
    """Lines after ``start`` up to a later ``stop``, or ``most`` of them; null without ``start``."""
    a, b = F.array_position(lines, F.lit(start)), F.array_position(lines, F.lit(stop))
    size = F.when(b > a, b - a - 1).otherwise(F.lit(most - 1).cast("long"))
    return F.when(a > 0, F.slice(lines, (a + 1).cast("int"), F.greatest(F.lit(0), size.cast("int"))))


def page_status(lines: Column) -> Column:
    """Registration as the page's own block says it, in a fixed order of precedence."""
    block = F.array_join(block_between(lines, "Registration", "About Event", 12), "\n")
    return (
        F.when(block.rlike("(?i)Sold Out"), "Sold out")
        .when(block.rlike("(?i)Join Waitlist|Event Full"), "Waitlist")
        .when(block.rlike("(?i)Registration Closed|not currently taking registrations"), "Closed")
        .when(block.rlike(r"(?m)^Register$"), "Open")
        .when(block.rlike("(?i)Approval Required|Request to Join|Require Approval"), "Approval")
        .otherwise("Check page")
    )


def status(evidence: Column | str, lines: Column, availability: Column, event_status: Column) -> Column:
    """Cancelled, closed applications, the structured offer, the page's block, and words of the text, in this order."""
    text, own = _col(evidence), page_status(lines)
    return (
        F.when(F.coalesce(event_status, F.lit("")).rlike("(?i)EventCancelled"), "Cancelled")
        .when(text.rlike("(?i)applications? closed|application deadline.*(?:passed|closed)"), "Closed")
        .when(F.coalesce(availability, F.lit("")).rlike(r"(?i)schema\.org/SoldOut|^SoldOut\z"), "Sold out")
        .when(F.coalesce(availability, F.lit("")) == "InStock", "Open")
        .when(own != "Check page", own)
        .when(text.rlike("(?i)applications? open|apply to attend"), "Approval")
        .when(text.rlike("(?i)register|registration open"), "Open")
        .otherwise(own)
    )


def feed_status(waitlist: Column, availability: Column) -> Column:
    """A feed's registration: the waitlist flag first, then the availability, else null."""
    return F.when(F.coalesce(waitlist, F.lit(False)) | (availability == "waitlist"), "Waitlist").when(availability == "open", "Open").when(availability.isin("closed", "sold_out"), "Closed")


def notice_tags(lines: Column, title: Column | str, evidence: Column | str, categories: Sequence[str], most: int = 4, head: int = 500) -> Column:
    """Category lines that follow the report line without a break, then keyword tags over the title and the head of the text."""
    at = F.array_position(lines, F.lit("Report Event")).cast("int")
    after = F.when(at > 0, F.slice(lines, at + 1, most)).otherwise(F.array().cast("array<string>"))
    other = F.array_position(F.transform(after, lambda x: x.isin(list(categories))), F.lit(False)).cast("int")
    named = F.when(other > 0, F.slice(after, 1, other - 1)).otherwise(after)
    text = F.concat_ws("\n", _col(title), F.substring(_col(evidence), 1, head))
    words = F.filter(F.array(*[F.when(text.rlike(p), F.lit(t)) for t, p in KEYWORD_TAGS.items()]), lambda x: x.isNotNull())
    return F.slice(F.concat(named, F.array_except(words, named)), 1, most)


def described(start_ms: Column, end_ms: Column) -> Column:
    """(label, detail) of a schedule in the wall clock that the instants are given in: ``AUG 28`` and ``Fri · 9am–7pm`` or ``Fri–Sun · 3 days``."""
    a, b = F.timestamp_millis(start_ms), F.timestamp_millis(end_ms)
    clock = lambda t: F.concat((F.pmod(F.hour(t) + 11, F.lit(12)) + 1).cast("string"), F.when(F.minute(t) > 0, F.date_format(t, ":mm")).otherwise(""), F.when(F.hour(t) >= 12, "pm").otherwise("am"))
    days = F.datediff(F.to_date(b), F.to_date(a))
    one = F.concat(F.date_format(a, "E"), F.lit(" · "), clock(a), F.lit("–"), clock(b))
    many = F.concat(F.date_format(a, "E"), F.lit("–"), F.date_format(b, "E"), F.lit(" · "), (days + 1).cast("string"), F.lit(" days"))
    known = start_ms.isNotNull() & end_ms.isNotNull()
    return F.struct(F.when(known, F.upper(F.date_format(a, "MMM dd"))).otherwise("TBC").alias("label"), F.when(~known, "Date on event page").when(days == 0, one).otherwise(many).alias("detail"))


def why(start_ms: Column, end_ms: Column, prize_label: Column, evidence: Column | str) -> Column:
    """A sentence of length, formats and prize."""
    hours = (end_ms - start_ms) / 3.6e6
    length = F.when(hours.isNull(), "Build event").when(hours > 24, F.concat(F.ceil(hours / 24).cast("string"), F.lit("-day build"))).otherwise(F.concat(F.floor(hours + 0.5).cast("string"), F.lit("-hour build")))
    text = _col(evidence)
    named = {"judging": "(?i)judg", "demos": r"(?i)\bdemo", "team formation": r"(?i)\bteam", "a submission deadline": "(?i)submission|deadline"}
    formats = F.concat_ws(", ", *[F.when(text.rlike(p), F.lit(n)) for n, p in named.items()])
    tail = F.when(prize_label != "Not listed", F.concat(F.lit("; "), F.lower(prize_label), F.lit("."))).otherwise(".")
    return F.concat(length, F.when(formats != "", F.concat(F.lit(" with "), formats)).otherwise(""), tail)


def builder_value(start_ms: Column, end_ms: Column, prize_amount: Column, prize_label: Column, evidence: Column | str) -> Column:
    """55, and more for prizes, eight hours or longer, judging, mentors and tracks; 100 at most."""
    text = _col(evidence)
    n = lambda test, points: F.when(test, points).otherwise(0)
    prizes = F.when(F.coalesce(prize_amount, F.lit("")) != "", 15).when(prize_label == "Prizes listed", 8).otherwise(0)
    long = F.coalesce((end_ms - start_ms) / 3.6e6 >= 8, F.lit(False))
    return F.least(F.lit(100), 55 + prizes + n(long, 10) + n(text.rlike("(?i)judg"), 8) + n(text.rlike("(?i)mentor|expert|partner engineer"), 6) + n(text.rlike(r"(?i)\btrack"), 5))


def accessibility(status: Column, bonus: Column) -> Column:
    """The status's base and the area's bonus within its region, -5 where it has none."""
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_BASE.items() for x in kv]), status), F.lit(60))
    return clamp(base + F.coalesce(bonus, F.lit(-5))).cast("int")


def titled(place: Column) -> Column:
    """Every word's first letter in capitals, the others as they are."""
    return F.array_join(F.transform(F.split(place, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2), F.length(w)))), " ")


def page_place(lines: Column, time_line: Column, places: str) -> Column:
    """(venue, city) of the lines after the time line, up to the registration block or three of them.

    A line ``X, CA`` without digits is the city, the last one if there are several; else the
    first served place in any of the lines. The other lines are the venue, without the city
    at its end.
    """
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    stop_of = lambda here, at: F.coalesce(F.array_min(F.transform(F.filter(here, lambda s: (s["x"] == "Registration") & (s["i"] >= at)), lambda s: s["i"])), F.least(at + 4, F.size(here)))
    between = lambda here, at, stop: F.transform(F.filter(here, lambda s: (s["i"] > at) & (s["i"] < stop) & (s["x"] != "Register to See Address")), lambda s: s["x"])
    own = bound(numbered, lambda here: bound(time_line, lambda at: bound(stop_of(here, at), lambda stop: between(here, at, stop))))
    shape = r"^(.*?),\s*(CA|California|United States|[A-Z]{2})\z"
    is_city = lambda x: x.rlike(shape) & ~F.regexp_extract(x, shape, 1).rlike(r"\d")
    named = lambda own: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(own, is_city), lambda x: F.trim(F.regexp_extract(x, shape, 1)))), -1)
    served = lambda own: bound(F.regexp_extract(F.get(F.filter(own, lambda x: x.rlike(places)), F.lit(0)), places, 0), titled)
    city = lambda own: F.coalesce(named(own), F.nullif(served(own), F.lit("")))
    venue = lambda own: F.nullif(F.array_join(F.filter(own, lambda x: ~is_city(x)), ", "), F.lit(""))

    def cut(r: Column) -> Column:
        bare = F.trim(F.regexp_replace(r["venue"], F.concat(F.lit(r"(?i)[,\s]*\Q"), r["city"], F.lit(r"\E\s*\z")), F.lit("")))
        return F.struct(F.when(r["city"].isNull(), r["venue"]).otherwise(F.nullif(bare, F.lit(""))).alias("venue"), r["city"].alias("city"))

    return bound(bound(own, lambda x: F.struct(venue(x).alias("venue"), city(x).alias("city"))), cut)


def venue_residue(place: Column, city: Column) -> Column:
    """A place string that says more than its city, state and country; null otherwise."""
    bare = F.regexp_replace(F.trim(place), F.concat(F.lit(r"(?i)\Q"), F.coalesce(F.nullif(city, F.lit("")), F.lit("\u0000")), F.lit(r"\E")), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(bare, r"(?i)\b(california|ca|united states|usa|us)\b", ""), r"[\s,]+", "")
    return F.when(rest != "", F.trim(place))


def prose_organizer(text: Column | str, default: str) -> Column:
    """Who the text says is hosting or running it, else who it is hosted by."""
    name = r"([A-Z][A-Za-z0-9&.'’-]*(?:\s+[A-Z][A-Za-z0-9&.'’-]*){0,3})"
    one = F.regexp_extract(_col(text), name + r"\s+is\s+(?:hosting|running)", 1)
    two = F.regexp_extract(_col(text), r"[Hh]osted by\s+" + name, 1)
    return F.coalesce(F.nullif(F.trim(one), F.lit("")), F.nullif(F.trim(two), F.lit("")), F.lit(default))


def worth_placing(place: Column) -> Column:
    """A place without a comma, or one that names the country or the state without a known city."""
    t = F.trim(place)
    return (t != "") & (~t.contains(",") | t.rlike(r"(?i)\b(usa|united states|,\s*ca\b|california)\b"))


def page_kind(title: Column, path: Column) -> Column:
    """collection, profile or event, by title and path."""
    return F.when(title.rlike(r"(?i)events?\s+(calendar|in|near)\b|popular events|events$") | path.startswith("/discover"), "collection").when(path.startswith("/user/"), "profile").otherwise("event")


def is_past(text: Column, end_ms: Column, now_ms: Column) -> Column:
    """The head of the text says so, or its own end is over."""
    return F.substring(text, 1, 1100).rlike(r"(?i)\bPast Event\b|ended \d+ days ago|\b\d+ Went\b") | F.coalesce(end_ms < now_ms, F.lit(False))


def local_header(text: Column, places: str) -> Column:
    """A place named as featured in the head decides; else any served place in the head."""
    head = F.substring(text, 1, 700)
    featured = F.regexp_extract(head, r"(?i)Featured in\s+([^\n]+)", 1)
    return F.when(featured != "", featured.rlike(places)).otherwise(head.rlike(places))


def desired_tags(category: Column, area: Column, core_area: Column, label: Column) -> Column:
    """The format's tag and the core area's or the region's."""
    kind = F.when(category == "adjacent", "Tech Events").otherwise("Hackathon")
    where = F.when(area.eqNullSafe(core_area), core_area).otherwise(label)
    return F.array_distinct(F.filter(F.array(kind, F.nullif(where, F.lit(""))), lambda t: t.isNotNull()))


def lower_keyed(values: Mapping[str, str]) -> Column:
    """A map column with keys in lower case."""
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k.lower(), v)])
