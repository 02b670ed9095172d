"""Personal data: detected entities get keyed, type-consistent surrogates. Only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.session import settle

FEW = 10_000
HONORIFICS = {"m": "Mr|Sir|Herr|Monsieur|Señor|Sr|Don|Г-н|Господин", "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Doña|Г-жа|Госпожа", "n": "Dr|Prof"}
_TITLE = "|".join(HONORIFICS.values())
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# lengths of IBANs by country; all are written compactly or in groups of four, of which the last may be shorter
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_GROUPED = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}"


def _iban_form(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    last = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{last}(?![A-Z0-9])"


_IBAN = "|".join(_iban_form(n, c) for n, c in IBAN_LENGTHS.items())
_S = "[ .-]"
_AREA = rf"\+\d{{1,3}}{_S}?(?:\(0\){_S}?)?(?:\(\d{{1,5}}\)|\d{{1,5}})"
_PHONE = "|".join((
    rf"(?<![\w+])(?:\+\d{{1,3}}{_S}?(?:\(\d{{2,4}}\)|\d{{2,4}})|\(\d{{3}}\)){_S}?\d{{3,4}}{_S}\d{{3,4}}(?!\w)",
    r"(?<![\w+])\+[1-9]\d{6,14}(?!\w)",
    rf"(?<![\w+])(?=\+){_AREA}(?:(?:{_S}\d{{2}}){{3,4}}|{_S}?\d{{3}}{_S}\d{{2}}{_S}\d{{2}}|{_S}\d{{4}}{_S}\d{{4}}|{_S}?\d{{4,9}})(?!\w)",
    r"(?<![\w+.-])(?:1[.-])?[2-9]\d\d(?:-\d{3}-|\.\d{3}\.| [2-9]\d\d )\d{4}(?!\w|[.-]\d)",
))
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": _PHONE,
    "iban": rf"\b(?=[A-Z]{{2}}\d{{2}})(?:{_IBAN}|{_GROUPED})\b",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "secret": r"""(?:(?<=[:="'])|(?<=[:=]\s{1,3}))(?<=(?i:password|passwd|secret|token|api_key|apikey)["']?\s{0,3}[:=]\s{0,3}["']?)[A-Za-z0-9_\-]{8,}""",
    "name": rf"(?=\p{{Lu}})(?<= )(?<=\b(?:{_TITLE})\.? )\p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+){{0,2}}",
}
ENTITY = "|".join(PATTERNS.values())
# what a text must hold for any of the patterns to fit; tested first, as most texts hold none of it
HINT = rf"[0-9@]|(?=\p{{Lu}})\b(?:{_TITLE})\.? \p{{Lu}}"
HINT_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
HINT_KEYS = ("AKIA", "ASIA")
# fixed values: given names by script and gender, and syllables of made-up family names by script
GIVEN = {
    "latin": {
        "m": "Adam Bruno Carl Denis Emil Felix Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Ruben",
        "f": "Alma Berta Clara Diana Elsa Flora Greta Helena Irma Julia Laura Maria Nora Olga Paula Rosa",
    },
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Павел", "f": "Анна Вера Дарья Елена Зоя Ирина Мария Ольга"},
    "greek": {"m": "Αλέξης Γιώργος Δήμος Ηλίας Κώστας Νίκος Πέτρος Σπύρος", "f": "Άννα Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία"},
}
FAMILY = {
    "latin": "bar den fel gor han kel lam mor nos pet ral sor tan ver wes zim",
    "cyrillic": "бар вол гор дем кол лин мар нов пет ром сол тар",
    "greek": "βαλ γρα δημ καλ λαμ μαρ νικ παπ ροδ σαλ τσα χατ",
}
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def let(value: Column, use) -> Column:
    """use(value), with value computed once: what is bound in a lambda is not copied into every place of use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind_of(value: Column) -> Column:
    """The pattern that a found value fits as a whole; what is told by its surroundings comes last."""
    out = F.when(value.rlike(r"^\p{Lu}[\p{L}'’ -]*$") & ~value.rlike("[0-9_]"), F.lit("name")).otherwise(F.lit("secret"))
    for kind in ("key", "ssn", "card", "iban", "phone", "ip", "email"):
        out = F.when(value.rlike(rf"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    false = lambda k: ((k == "card") & ~luhn(F.regexp_replace(value, "[ -]", ""))) | ((k == "iban") & ~iban(value))
    return let(out, lambda k: F.when(false(k), F.lit("number")).otherwise(k))


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Sum of the digits, those in every second place from the right doubled. odd: 1 if a check digit is to follow."""

    def value(c: Column, i: Column) -> Column:
        twice = (F.length(digits) - 1 - i + odd) % 2 == 1
        return let(c.try_cast("int"), lambda d: F.when(twice, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d))

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, d: a + d)


def luhn(digits: Column) -> Column:
    return F.coalesce(_luhn_sum(digits, 0) % 10 == 0, F.lit(False))


def iban(value: Column) -> Column:
    """Written in groups of four, or compact with the remainder 1 by 97."""
    bare = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def step(a: Column, c: Column) -> Column:
        return let(F.ascii(c), lambda n: F.when(n < 58, a * 10 + n - 48).otherwise(a * 100 + n - 55) % 97)

    return value.contains(" ") | value.rlike(f"^{_GROUPED}$") | (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


def canonical(kind: Column, value: Column) -> Column:
    """One form for all spellings of an entity, so that every mention gets the same surrogate."""
    bare = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    return (
        F.when(kind.isin("email", "name"), F.lower(value)).when(kind.isin("phone", "card", "ssn", "iban"), bare).otherwise(value)
    )


def _digest(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """256 keyed hex digits."""
    parts = [F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"), F.lit(str(n))), 256) for n in range(4)]
    return F.concat(*parts)


def _draw(digest: Column, i: Column, among) -> Column:
    """Place i's number below `among`, from 0. Four hex digits a place; places repeat after 64."""
    at = (i % 64) * 4 + 1
    return F.conv(F.substring(digest, at, F.lit(4)), 16, 10).cast("int") % among


def _spelled(canon: Column, digest: Column, keep: Column) -> Column:
    """Digit for digit and letter for letter; the first `keep` characters stay."""
    kept = F.transform(F.split(canon, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))

    def one(hexa: Column) -> Column:
        def of(x: Column) -> Column:
            c, i = x["c"], x["i"]
            letters = (
                F.when(i < keep, c)
                .when(hexa, "0123456789abcdef")
                .when(c.rlike("[0-9]"), DIGITS)
                .when(c.rlike("[a-z]"), LOWER)
                .when(c.rlike("[A-Z]"), UPPER)
                .otherwise(c)
            )
            return let(letters, lambda w: F.substring(w, _draw(digest, i, F.length(w)) + 1, F.lit(1)))

        return F.array_join(F.transform(kept, of), "")

    return let(canon.rlike("^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{12,}$"), one)


def _name(canon: Column, gender: Column, digest: Column, attempt: Column) -> Column:
    """Family name of three syllables, and one more for each attempt, after a given name of the gender if there were two
    words or more. So the names never run out: each attempt has a dozen times as many as the one before."""

    def of(script: str) -> Column:
        syllables, m, f = FAMILY[script].split(), GIVEN[script]["m"].split(), GIVEN[script]["f"].split()

        def one(words: list[str], i: int) -> Column:
            return F.element_at(F.array(*map(F.lit, words)), _draw(digest, F.lit(i), len(words)) + 1)

        more = F.transform(F.sequence(F.lit(0), attempt), lambda i: F.when(i > 0, F.element_at(F.array(*map(F.lit, syllables)), _draw(digest, i + 10, len(syllables)) + 1)).otherwise(""))
        family = F.concat(*(one(syllables, i) for i in range(3)), F.array_join(more, ""))
        first = F.when(gender == "m", one(m, 9)).when(gender == "f", one(f, 9)).otherwise(one(m + f, 9))
        return F.lower(F.when(canon.contains(" "), F.concat_ws(" ", first, family)).otherwise(family))

    return F.when(canon.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def surrogate(key: str, kind: Column, canon: Column, gender: Column, attempt: Column) -> Column:
    """The replacement of a canonical form: same kind, length and make-up, drawn by key and attempt."""
    none = F.lit(0)

    def of(digest: Column) -> Column:
        def email(domain: Column) -> Column:
            # a domain is an entity of its own: the same one for every address in it
            top = F.substring_index(domain, ".", -1)
            head = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
            whole = let(_digest(key, F.lit("domain"), domain, none), lambda d: _spelled(head, d, none))
            # a letter more for every attempt after the second, as short names before the @ run out
            longer = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: F.when(i > 2, F.substring(F.lit(LOWER), _draw(digest, 60 - i, 26) + 1, F.lit(1))).otherwise("")), "")
            return F.concat(_spelled(F.substring_index(canon, "@", 1), digest, none), longer, F.lit("@"), whole, top)

        octets = F.transform(F.split(canon, r"\."), lambda _, i: (_draw(digest, i, 254) + 1).cast("string"))
        stay = F.when(kind.isin("card", "phone"), 1).when(kind == "iban", 2).when(kind == "key", 4).otherwise(0)
        plain = _spelled(canon, digest, stay)
        card = let(
            F.substring(plain, F.lit(1), F.length(canon) - 1),
            lambda body: F.concat(body, ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string")),
        )
        return (
            F.when(kind == "email", let(F.substring_index(canon, "@", -1), email))
            .when(kind == "ip", F.array_join(octets, "."))
            .when(kind == "card", card)
            .when(kind == "name", _name(canon, gender, digest, attempt))
            .otherwise(plain)
        )

    return let(_digest(key, kind, canon, attempt), of)


def rendered(kind: Column, value: Column, other: Column) -> Column:
    """A surrogate in the spelling of the mention: its separators and its case."""
    plain = r"[^\p{L}\p{N}]"

    def one(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), plain, ""))  # short values only
        return F.when(c.rlike(plain), c).otherwise(F.substring(other, at, F.lit(1)))

    spread = F.array_join(F.transform(F.split(value, ""), one), "")
    same = F.length(value) == F.length(other)
    mailed = F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(F.substring(other, i + 1, F.lit(1)))).otherwise(F.substring(other, i + 1, F.lit(1))),
        ),
        "",
    )
    named = F.when((F.upper(value) == value) & (F.length(value) > 1), F.upper(other)).otherwise(F.initcap(other))
    return (
        F.when((kind == "email") & same, mailed).when(kind == "email", other).when(kind == "name", named).when(kind.isin("phone", "card", "ssn", "iban"), spread).otherwise(other)
    )


def _gender(before: Column) -> Column:
    """Told by the title at the end of what stands before a name."""
    out = F.lit("n")
    for g in ("m", "f"):
        out = F.when(before.rlike(rf"\b(?:{HONORIFICS[g]})\.? $"), F.lit(g)).otherwise(out)
    return out


def mentions(text: Column) -> Column:
    """struct(gaps, found), null where nothing hints at an entity: the text is gaps[0] found[0] gaps[1] found[1] ...

    found has kind, value, canon and gender.
    """

    def of(p: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            gender = _gender(F.get(p["gaps"], i))
            return let(
                kind_of(value),
                lambda kind: F.struct(kind.alias("kind"), value.alias("value"), canonical(kind, value).alias("canon"), gender.alias("gender")),
            )

        return F.struct(p["gaps"].alias("gaps"), F.transform(p["values"], one).alias("found"))

    split = F.struct(F.split(text, ENTITY, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(ENTITY), 0).alias("values"))
    hinted = text.rlike(HINT) | F.lower(text).rlike("|".join(HINT_WORDS))
    for word in (*HINT_WORDS, *HINT_KEYS):
        hinted = text.contains(word) | hinted
    return F.when(hinted, let(split, of))


def collisions_settled(entities: DataFrame, key: str, max_rounds: int = 20) -> DataFrame:
    """(kind, canon, gender, attempt, surrogate) of distinct entities(kind, canon, gender), surrogates distinct.

    A surrogate that equals another one of its kind, or an entity that really occurs, is drawn again with the next
    attempt, until none is left; the first in order keeps a surrogate that several drew.
    """
    now = entities.withColumn("attempt", F.lit(0))
    for _ in range(max_rounds):
        drawn = settle(now.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt"))))
        taken = drawn.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")
        real = drawn.select("kind", F.col("canon").alias("surrogate"))
        again = drawn.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "canon", "surrogate", "attempt")
        first = Window.partitionBy("kind", "surrogate").orderBy(F.col("attempt").desc(), "canon")
        again = again.withColumn("r", F.row_number().over(first)).where("r > 1").select("kind", "canon")
        again = again.unionByName(drawn.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canon")).distinct()
        again = settle(again.withColumn("more", F.lit(1)))
        if again.isEmpty():
            return drawn
        now = drawn.drop("surrogate").join(again, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more")
    raise RuntimeError("too few surrogates for the entities of a kind")


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", count_name: str = "n_entities", few: int = FEW) -> DataFrame:
    """df with every detected entity replaced by its surrogate, and n_entities (a column of df with that name gives way).

    Mentions of one entity get one surrogate in all texts, different entities different ones: the distinct
    entities are gathered (counted per task first, so a hot one costs a row) and checked for collisions; those that had
    to be drawn again are looked up, all others are computed where they stand. Up to `few` of them are broadcast, more
    meet their texts in a join on the text's digest. A family name after a title is the person whose whole name ends with it in the same
    text, and a whole name found after a title is replaced in the same text where it stands without one (n_entities counts
    what was detected, not these). Texts without entities pass unchanged; null and empty texts stay; very long texts are searched
    whole; no rows in an empty table; repeated rows are treated alike; no other column can clash. A number that fails the card checksum is
    left, and so is a compact IBAN of odd length that fails its own.
    """
    own = [c for c in df.columns if c != count_name]
    text = F.col("text")
    # the given columns travel in one struct, so none of them can clash with the names below
    parsed = df.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(f"`{text_col}`").alias("text")).withColumn("p", mentions(text))
    only = parsed.select(F.explode("p.found").alias("e")).where("e.kind <> 'number'")
    # one entity, one gender: the one told most often, the first of equals
    told = only.groupBy("e.kind", "e.canon", "e.gender").agg(F.count("*").alias("n"))
    entities = told.groupBy("kind", "canon").agg(
        F.max_by("gender", F.struct((F.col("gender") != "n").cast("int").alias("told"), "n", "gender")).alias("gender")
    )
    drawn = collisions_settled(settle(entities), key)
    # what can't be computed in place: later attempts, and names, whose gender other mentions may tell
    entity = lambda e: F.concat_ws("\x1f", e["kind"], e["canon"])
    special = settle(drawn.where("attempt > 0 or kind = 'name'").select(F.concat_ws("\x1f", "kind", "canon").alias("k"), "surrogate"))
    if special.count() <= few:
        parsed = parsed.join(F.broadcast(special.agg(F.map_from_entries(F.collect_list(F.struct("k", "surrogate"))).alias("known"))))
    else:
        asked = parsed.where("size(p.found) > 0").select(F.md5("text").alias("digest"), F.explode("p.found").alias("e"))
        asked = asked.select("digest", entity(F.col("e")).alias("k")).distinct()
        known = asked.join(special, "k").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("k", "surrogate"))).alias("known"))
        parsed = parsed.withColumn("digest", F.md5("text")).join(known, "digest", "left")
    looked_up = lambda e: F.try_element_at("known", entity(e))

    def replaced(e: Column, p: Column) -> Column:
        new = F.coalesce(looked_up(e), surrogate(key, e["kind"], e["canon"], e["gender"], F.lit(0)))
        family = (e["kind"] == "name") & ~e["canon"].contains(" ")
        of = F.when(family, F.get(F.filter(p["found"], lambda x: (x["kind"] == "name") & x["canon"].endswith(F.concat(F.lit(" "), e["canon"]))), F.lit(0)))
        whole_name = let(of, lambda x: F.when(x.isNotNull(), F.substring_index(looked_up(x), " ", -1)))
        return F.when(e["kind"] == "number", e["value"]).otherwise(let(F.coalesce(whole_name, new), lambda n: rendered(e["kind"], e["value"], n)))

    def bare(gap: Column, p: Column) -> Column:
        """gap with the whole names that the text has after titles replaced."""
        names = F.array_distinct(F.filter(p["found"], lambda x: (x["kind"] == "name") & x["canon"].contains(" ")))

        def one(g: Column, x: Column) -> Column:
            there = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), x["value"], F.lit(r"(?![\p{L}\p{N}])"))  # letters, blanks and hyphens only
            return F.when(F.contains(g, x["value"]), F.regexp_replace(g, there, rendered(x["kind"], x["value"], looked_up(x)))).otherwise(g)

        return F.aggregate(names, gap, one)

    def whole(p: Column) -> Column:
        new = F.transform(p["found"], lambda e: replaced(e, p))
        named = F.exists(p["found"], lambda x: (x["kind"] == "name") & x["canon"].contains(" "))
        gaps = F.when(named, F.transform(p["gaps"], lambda g: bare(g, p))).otherwise(p["gaps"])
        return F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")

    count = F.coalesce(F.size(F.filter("p.found", lambda e: e["kind"] != "number")), F.lit(0))
    out = F.when(F.col("p").isNull(), text).otherwise(let(F.col("p"), whole))
    done = parsed.select("row", out.alias("new"), F.when(F.col("p").isNull(), 0).otherwise(count).alias("n"))
    return done.select(*(F.col("new").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in own), F.col("n").alias(count_name))
