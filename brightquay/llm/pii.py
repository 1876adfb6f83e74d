"""Surrogates for personal data, with DataFrame expressions only.

Entities are found by one pattern per text. Every distinct entity gets a surrogate drawn
by a keyed hash: of its own type and format, for names of the same gender and script.
Draws that hit another entity's surrogate, or any entity of the corpus, are drawn again,
in a wider format after some rounds, so distinct entities stay distinct; all mentions of
an entity get the same surrogate, written in the mention's own punctuation and case.

Mentions of a person by a part of the name follow the full name within a text, and an
address whose local part is a person's name takes that person's surrogate.

Only entities travel through the collision checks. Texts without entities are passed on
where they are read; a hot entity is one row of the table that mentions are joined to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.llm.common import drop_table, load, text_of, write_table

#: Given names by gender and script, and syllables of surnames by script (own choice).
GIVEN = {
    ("f", "latin"): "Patricia Jennifer Elizabeth Barbara Susan Jessica Margaret Katharina Brigitte Camille Françoise Lucía María Guadalupe Dorothy Deborah Mary Maria Anna Emma Olivia Sophia Isabella Mia Charlotte Amelia Evelyn Abigail Emily Ella Sarah Laura Karen Nancy Lisa Betty Sandra Ashley Kimberly Donna Michelle Carol Amanda Melissa Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Pamela Nicole Samantha Katherine Catherine Christine Rachel Carolyn Janet Heather Diane Julie Joyce Victoria Kelly Christina Lauren Joan Judith Olga Martha Andrea Cheryl Hannah Jacqueline Megan Alice Jean Teresa Sara Gloria Ann Anne Kathryn Jane Janice Julia Judy Grace Denise Marilyn Beverly Amber Theresa Danielle Brittany Diana Natalie Lucy Lucia Ruth Helen Linda Debra Monika Sabine Petra Ursula Claudia Heike Gisela Ingrid Renate Anja Katrin Silke Susanne Birgit Greta Frieda Marie Nathalie Isabelle Sophie Chloé Léa Manon Aurélie Céline Hélène Sylvie Monique Valérie Carmen Josefa Pilar Dolores Cristina Marta Elena Beatriz Rosario Inés Sofía Valentina Camila Giulia Francesca Chiara Paola Giovanna Ines Joana Fernanda Mariana Fatima Aisha Priya Ananya Yuki Mei Agnieszka Katarzyna Małgorzata Zofia Eva Zuzana Astrid Freya Ingeborg Linnea Ayşe Zeynep".split(),
    ("m", "latin"): "Michael Robert William Richard Joseph Charles Christopher Jürgen Wolfgang Pierre Jacques José Javier Santiago Douglas Gregory John James David Thomas Daniel Matthew Anthony Mark Donald Steven Stephen Paul Andrew Joshua Kenneth Kevin Brian George Timothy Ronald Edward Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Larry Justin Scott Brandon Benjamin Samuel Raymond Frank Alexander Patrick Jack Dennis Jerry Tyler Aaron Adam Nathan Henry Zachary Peter Kyle Noah Ethan Jeremy Walter Christian Keith Roger Terry Austin Sean Gerald Carl Harold Dylan Arthur Lawrence Jesse Bryan Bruce Gabriel Logan Alan Juan Albert Willie Elijah Wayne Randy Vincent Mason Roy Ralph Bobby Russell Bradley Philip Phillip Eugene Oliver Liam Lucas Luke Simon Martin Stefan Thorsten Klaus Hans Heinz Günter Günther Uwe Dieter Manfred Horst Karl Ludwig Friedrich Johannes Lukas Felix Maximilian Jan Jens Sven Andreas Matthias Markus Sebastian Tobias Michel Philippe Alain Bernard Nicolas Laurent Olivier Julien Antoine François Louis Henri Luc Carlos Luis Miguel Antonio Manuel Francisco Pedro Alejandro Diego Fernando Rafael Jorge Sergio Andrés Pablo Álvaro Marco Giovanni Giuseppe Luca Matteo Alessandro Francesco João Paulo Tiago Mohammed Muhammad Mohamed Ahmed Omar Ali Hassan Raj Rahul Arjun Amit Hiroshi Kenji Takashi Wei Piotr Krzysztof Tomasz Jakub Erik Lars Anders Björn Olaf Henrik Mehmet Mustafa".split(),
    ("f", "cyrillic"): "Наталья Светлана Екатерина Людмила Татьяна Марина Ольга Юлия Анна Мария Елена Ирина Оксана Анастасия Дарья Ксения Вера Надежда Любовь Галина Валентина Нина Полина Виктория Алина Софья".split(),
    ("m", "cyrillic"): "Дмитрий Владимир Сергей Николай Алексей Михаил Виктор Юрий Иван Александр Андрей Пётр Петр Павел Олег Игорь Евгений Максим Антон Роман Василий Борис Константин Григорий Денис Илья Никита Фёдор".split(),
    ("f", "greek"): "Ελένη Κατερίνα Βασιλική Σοφία Μαρία Άννα Ιωάννα Γεωργία Αικατερίνη Δήμητρα Ευαγγελία Χριστίνα".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Νικόλαος Παναγιώτης Ιωάννης Γιάννης Κωνσταντίνος Κώστας Χρήστος Αθανάσιος Βασίλης Αλέξανδρος".split(),
}
SYLLABLES = {
    "latin": "bar cal dor fen gul hol jor kel lun mor nev pol quin rud sil tam vor wex yar zim".split(),
    "cyrillic": "бар вел гор дор жал зим кор лун мир нов пол руд сол тур фед хар чер шум юр яр".split(),
    "greek": "βαρ γορ δελ ζιμ θαν καλ λυκ μαρ νεφ παλ ροδ σιμ ταλ φαρ χαλ ψιλ".split(),
}
#: Sixteen letters by script, for the wide format of names.
TAILS = {"latin": "abdefgiklmnoprst", "cyrillic": "абвгдезиклмнопрс", "greek": "αβγδεζηθικλμνοπρ"}
#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _trie(words: list[str]) -> str:
    """A pattern of the words that reads common beginnings once, the longest word first."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [c + _trie(rest) for c, rest in heads.items() if c]
    ends = "?" if "" in heads else ""
    if not parts:
        return ""
    return parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)}){ends}"


#: Second words that make a given name the name of a thing or place (own choice): Austin Texas, Grace Period, Victoria Station.
THINGS = (
    "Texas Station Street Road Avenue Square Park Lake River Falls Island Islands Bay Beach County City Town Hill Hills Valley Bridge Airport Church Cathedral Chapel Abbey College School University Hospital Library Museum Theatre "
    "Hotel House Hall Court Tower Day Days Night Week Month Period Discussion Debate Question Answer Scheme Schemes Sheet Sheets Book Books Rule Rules Act Law Prize Award Cup League Era Age War Style Model Value Values "
    "Community Center Centre Association Society Institute Foundation Party Group Company Bank Market Democrats Union Values Faith Bible Music Art"
).split()
_THINGS = _trie(THINGS)
_NAMES = _trie([n for ns in GIVEN.values() for x in ns for n in (x, x.upper())])
_TITLE = r"(?:Mrs?|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Monsieur|Madame|Señora?|Sra?)"
_WORD = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}-]+"
_groups = lambda n: rf"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
_IBANS = "|".join(rf"(?:{'|'.join(c.split())})\d\d{_groups(n - 4)}" for n, c in IBAN_LENGTHS.items())
#: Patterns by kind, in the order in which they are tried. None repeats a group without a
#: bound: Java's matcher recurses there, and a long text would use up its stack.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "phone": r"(?<![\d+])\+(?!\d{16})(?=(?:[ .()-]{0,2}\d){7})\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{7,15}(?!\d)"
    r"|(?<![\d+.,-])0\d(?:[ .-]\d{2}){4}(?!\d)|(?<![\d+.,-])0\d{1,4}[ -]\d{3,4}[ -]?\d{3,4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "secret": r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}(?![A-Za-z0-9])",
    "card": r"(?<!\d)(?<!\d[.,])(?:4\d{12}|[2-6]\d{13,18}|\d{4}(?: \d{4}){3}(?: \d{1,3})?|\d{4}(?:-\d{4}){3}(?:-\d{1,3})?|3\d{3}(?: \d{6} \d{4,5}|-\d{6}-\d{4,5}))(?!\d)",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d\d)(?:(?:{_IBANS})|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}})(?![A-Za-z0-9])",
    "name": rf"(?=[A-ZÀ-ÞŁΆ-ΏΑ-ΩЀ-Я])(?<![\p{{L}}])(?:(?:{_NAMES})(?: \p{{Lu}}\.)? (?!{_THINGS}(?!\p{{L}})){_WORD}|(?<=(?<!\p{{L}}){_TITLE}\.? ){_WORD}(?: {_WORD})?)",
}
#: Cards before phones, for a run of digits may be either.
_ORDER = ("email", "secret", "iban", "ip", "card", "phone", "ssn", "name")
PATTERN = "|".join(f"(?:{KINDS[k]})" for k in _ORDER)
#: Rounds of draws in an entity's own format, and rounds in all.
OWN_FORMAT, MOST_ROUNDS = 6, 64
#: A full name among the mentions.
_FULL = r"^\p{Lu}[^0-9@]* \p{Lu}[^0-9@ ]*$"
#: A text without any of these holds no entity.
HINT = r"[0-9@]|(?=[A-ZÀ-ÞŁΆ-ΏΑ-ΩЀ-Я])(?:" + _NAMES + "|" + _TITLE + r"\.?) "


def _kind(entity: Column) -> Column:
    out = F.lit("name")
    for k in reversed(_ORDER[:-1]):
        out = F.when(entity.rlike(rf"^(?:{KINDS[k]})$"), k).otherwise(out)
    return out


def canonical(entity: Column, kind: Column) -> Column:
    """What mentions of one entity share: digits of numbers, lower case of the rest."""
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, r"\D", "")).when(kind == "iban", F.upper(F.replace(entity, F.lit(" "), F.lit("")))).otherwise(F.lower(entity))


def _draw(digest: Column, at: Column, below: Column | int) -> Column:
    """A number below ``below`` from eight hex digits of the digest."""
    return F.conv(F.substr(digest, (at * 7) % 120 + 1, F.lit(8)), 16, 10).cast("long") % below


def _shaped(text: Column, digest: Column, keep: Column | int) -> Column:
    """Letters and digits of ``text`` beyond the first ``keep`` drawn anew in their own classes; hex stays hex."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substr(digest, (i * 3) % 125 + 1, F.lit(4)), 16, 10).cast("int")
        return (
            F.when((i < keep) | ~c.rlike("^[A-Za-z0-9]$"), c)
            .when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.substr(letters, n % 26 + 1, F.lit(1)))
            .otherwise(F.upper(F.substr(letters, n % 26 + 1, F.lit(1))))
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The digit sum whose multiple of ten marks a valid card number."""
    n = F.length(digits)
    return F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x
    )


def _card(value: Column, digest: Column, more: Column) -> Column:
    """Same issuer digit, ``more`` digits more; valid by its check digit when the original is."""
    body = _shaped(F.concat(F.substr(value, F.lit(1), F.length(value) - 1), more), digest, 1)
    due = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    other = (due + 1 + _draw(digest, F.lit(9), 9)) % 10
    return F.concat(body, F.when(_luhn(value) % 10 == 0, due).otherwise(other).cast("string"))


def _name(value: Column, digest: Column, attempt: Column) -> Column:
    """A given name of the same gender and script and a surname of syllables, in lower case; without a known given name, words of syllables."""
    given = F.substring_index(value, " ", 1)

    def word(script: str, first: int) -> Column:
        parts = F.array(*map(F.lit, SYLLABLES[script]))
        at = [F.element_at(parts, (_draw(digest, F.lit(k), len(SYLLABLES[script])) + 1).cast("int")) for k in range(first, first + 6)]
        # longer from the fourth draw on, and longer again in the wide format, so that there are names enough
        tail = F.translate(F.substr(digest, F.lit(97), attempt), "0123456789abcdef", TAILS[script])
        return F.concat(*at[:4], F.when(attempt >= 3, F.concat(*at[4:])).otherwise(""), F.when(attempt >= OWN_FORMAT, tail).otherwise(""))

    bare = lambda script: F.when(value.contains(" "), F.concat(word(script, 8), F.lit(" "), word(script, 2))).otherwise(word(script, 2))
    out = F.when(value.rlike(r"^\p{IsCyrillic}"), bare("cyrillic")).when(value.rlike(r"^\p{IsGreek}"), bare("greek")).otherwise(bare("latin"))
    for (_, script), names in GIVEN.items():
        pick = F.element_at(F.array(*[F.lit(n.lower()) for n in names]), (_draw(digest, F.lit(1), len(names)) + 1).cast("int"))
        out = F.when(given.isin([n.lower() for n in names]) & value.contains(" "), F.concat(pick, F.lit(" "), word(script, 2))).otherwise(out)
    return out


def surrogate(kind: Column, value: Column, key: str, attempt: Column, owner: Column) -> Column:
    """The keyed draw for one canonical entity; ``owner`` is the surrogate of the person that an address names.

    From round OWN_FORMAT on the format is wider: numbers and local parts are longer.
    """
    wide = F.greatest(F.lit(0), attempt - OWN_FORMAT + 1)
    more = F.repeat(F.lit("0"), wide)
    domain = F.substring_index(value, "@", -1)
    local = F.substring_index(value, "@", 1)
    host = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    hexed = lambda *parts: F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)

    def draw(d: Column, by_host: Column) -> Column:
        octet = lambda k: (_draw(d, F.lit(k), 254) + 1).cast("string")
        named = F.replace(owner, F.lit(" "), F.regexp_extract(local, "[._-]", 0))
        suffix = F.translate(F.substr(d, F.lit(97), F.when(owner.isNotNull(), attempt).otherwise(wide)), "0123456789abcdef", TAILS["latin"])
        # all addresses of a domain keep a domain in common; its last label stays
        email = F.concat(F.coalesce(named, _shaped(local, d, 0)), suffix, F.lit("@"), _shaped(host, by_host, 0), F.lit("."), F.substring_index(domain, ".", -1))
        long_hex = F.rpad(F.concat(d, F.sha2(d, 512)), F.length(value), F.lit("0"))
        return (
            F.when(kind == "email", email)
            .when(kind == "ip", F.concat_ws(".", octet(0), octet(2), octet(4), octet(6)))
            .when(kind == "secret", long_hex)
            .when(kind == "card", _card(value, d, more))
            .when(kind == "phone", _shaped(F.concat(value, more), d, F.greatest(F.lit(0), F.length(value) - 10)))
            .when(kind == "ssn", _shaped(F.concat(value, more), d, 0))
            .when(kind == "iban", _shaped(F.concat(value, more), d, 2))
            .otherwise(_name(value, d, attempt))
        )

    # digests are bound once, not reckoned for every character that is drawn
    digests = F.array(F.struct(hexed(kind, value, attempt.cast("string")).alias("own"), hexed(F.lit("host"), host).alias("host")))
    return F.get(F.transform(digests, lambda x: draw(x["own"], x["host"])), F.lit(0))


def render(mention: Column, kind: Column, drawn: Column) -> Column:
    """The surrogate in the mention's own punctuation (numbers; further digits follow) or case (names, addresses, hex)."""
    filled = F.aggregate(
        F.split(mention, ""),
        F.struct(F.lit(0).alias("n"), F.lit("").alias("s")),
        lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct((a["n"] + 1).alias("n"), F.concat(a["s"], F.substr(drawn, a["n"] + 1, F.lit(1))).alias("s"))).otherwise(F.struct(a["n"].alias("n"), F.concat(a["s"], c).alias("s"))),
        lambda a: F.concat(a["s"], F.substr(drawn, a["n"] + 1, F.greatest(F.lit(0), F.length(drawn) - a["n"]))),
    )
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), filled)
        .when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(drawn))
        .when(kind == "name", F.initcap(drawn))
        .when(kind == "email", F.array_join(F.zip_with(F.split(drawn, ""), F.split(mention, ""), lambda c, m: F.when(m.rlike("[A-Z]"), F.upper(c)).otherwise(c)), ""))
        .otherwise(drawn)
    )


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """``kind, value, drawn`` for distinct ``kind, value, owner`` rows, without collisions.

    In every round the draws are grouped; the smallest value of a draw keeps it unless it
    was taken before or is itself an entity, and the others draw again. The wide formats
    have room for any number of entities; addresses of the network alone have one format,
    and where nearly all of them are entities the rounds end with an error.
    """
    entities = write_table(entities, "pii-entities")
    kept, left, attempt = None, entities, 0
    while attempt < MOST_ROUNDS:
        drawn = left.withColumn("drawn", surrogate(F.col("kind"), F.col("value"), key, F.lit(attempt), F.col("owner")))
        drawn = drawn.join(entities.select("kind", F.col("value").alias("drawn")), ["kind", "drawn"], "left_anti")
        if kept is not None:
            drawn = drawn.join(kept.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        won = drawn.groupBy("kind", "drawn").agg(F.min("value").alias("value")).select("kind", "value", "drawn")
        now = write_table(won if kept is None else kept.unionByName(won), "pii-surrogates")
        if kept is not None:
            drop_table(kept)
        kept = now
        left = entities.join(kept, ["kind", "value"], "left_anti")
        if left.isEmpty():
            return kept
        attempt += 1
    raise ValueError(f"no free surrogates after {MOST_ROUNDS} rounds")


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """``kind, value, drawn`` for distinct ``kind, value`` rows: names first, then what may follow them."""
    none = F.lit(None).cast("string")
    names = _drawn(entities.filter("kind = 'name'").withColumn("owner", none), key)
    rest = entities.filter("kind <> 'name'")
    person = F.when(F.col("kind") == "email", F.regexp_replace(F.substring_index("value", "@", 1), "[._-]+", " "))
    owners = names.select(F.col("value").alias("_person"), F.col("drawn").alias("owner")).filter(F.col("_person").contains(" "))
    rest = rest.withColumn("_p", person).join(owners, F.col("_p") == F.col("_person"), "left").select("kind", "value", "owner")
    return names.unionByName(_drawn(rest, key))


def _ends(name: Column) -> Column:
    """First and last word of a full name, as written, capitalised and in capitals; words of three letters or more."""
    words = F.array(F.substring_index(name, " ", 1), F.substring_index(name, " ", -1))
    return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 2), lambda w: F.array_distinct(F.array(w, F.initcap(w), F.upper(w)))))


def name_parts(hits: Column, text: Column) -> Column:
    """Words by which the text may mention its persons: first and last words of full names that it never writes in lower case."""
    found = F.array_distinct(F.flatten(F.transform(F.filter(hits, lambda h: h.rlike(_FULL)), _ends)))
    return F.filter(found, lambda w: ~F.rlike(text, F.concat(F.lit(r"(?<!\p{L})\Q"), F.lower(w), F.lit(r"\E(?!\p{L})"))))


def mentions(hits: DataFrame) -> DataFrame:
    """Distinct ``_row, place, mention, kind, value`` rows of ``_row, hits``; places count a text's distinct mentions."""
    found = hits.select("_row", F.posexplode(F.array_distinct("hits")).alias("place", "mention"))
    return found.withColumn("kind", _kind(F.col("mention"))).withColumn("value", canonical(F.col("mention"), F.col("kind")))


def _shown(drawn: DataFrame) -> DataFrame:
    """``_row, m``: what each mention, and each part of a name, becomes in a text.

    A part belongs to the first full name that has it, also where it stands behind a title.
    """
    whole = drawn.select("_row", F.col("mention").alias("written"), F.struct(F.lit(1).alias("own"), "place").alias("rank"), render(F.col("mention"), F.col("kind"), F.col("drawn")).alias("shown"))
    full = drawn.filter((F.col("kind") == "name") & F.col("mention").rlike(_FULL) & F.col("drawn").contains(" "))
    parts = full.select("_row", "place", "drawn", "mention", F.explode(_ends(F.col("mention"))).alias("written"))
    given = F.lower("written") == F.lower(F.substring_index("mention", " ", 1))
    part = F.when(given, F.substring_index("drawn", " ", 1)).otherwise(F.substring_index("drawn", " ", -1))
    parts = parts.select("_row", "written", F.struct(F.lit(0).alias("own"), "place").alias("rank"), F.when(F.col("written") == F.upper("written"), F.upper(part)).otherwise(F.initcap(part)).alias("shown"))
    each = whole.unionByName(parts).groupBy("_row", "written").agg(F.min_by("shown", "rank").alias("shown"))
    return each.groupBy(F.col("_row").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("written", "shown"))).alias("m"))


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, n_entities, text`` per row: mentions found, and the text with surrogates.

    The key decides all draws and is a secret of the caller. Null and empty texts come
    back empty with no entities; texts without entities are unchanged. Every row is a text
    of its own, whatever its id: rows repeated or without an id are replaced alike. Empty
    table, empty result; further columns are ignored.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    hinted = F.col("text").rlike(HINT)
    # the long pattern is matched once; the few texts that may hold entities go on with their hits
    searched = rows.filter(hinted).withColumn("hits", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).withColumn("_row", F.monotonically_increasing_id())
    searched = write_table(searched.withColumn("parts", name_parts(F.col("hits"), F.col("text"))), "pii-texts")
    found = write_table(mentions(searched), "pii-mentions")
    table = surrogate_table(found.select("kind", "value").distinct(), key)
    with_map = searched.join(_shown(found.join(table, ["kind", "value"])), F.col("_row") == F.col("_id"), "left")

    def replaced(texts: DataFrame, pattern: Column, hits: Column) -> DataFrame:
        texts = texts.withColumn("_hits", hits)
        # a part that stands at the edge of another match is left as it is
        new = lambda h: F.coalesce(F.element_at(F.col("m"), h), h)
        text = F.array_join(F.transform(F.split("text", pattern, -1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(new(F.get(F.col("_hits"), i - 1)), p))), "")
        return texts.select("doc_id", F.size("_hits").cast("long").alias("n_entities"), F.when(F.size("_hits") == 0, F.col("text")).otherwise(text).alias("text"))

    own = F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join("parts", "|"), F.lit(r")(?!\p{L})"))
    plain = replaced(with_map.filter(F.size("parts") == 0), F.lit(PATTERN), F.col("hits"))
    named = replaced(with_map.filter(F.size("parts") > 0), own, F.regexp_extract_all("text", own, F.lit(0)))
    rest = rows.filter(~hinted).select("doc_id", F.lit(0).cast("long").alias("n_entities"), "text")
    return plain.unionByName(named).unionByName(rest)


#: The query's key; it is published with the query, so it keeps nothing secret.
QUERY_KEY = "a published key"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogates over all documents."""
    return replace_pii(load(spark, sf_dir, "documents"), QUERY_KEY)
