"""Personal data replaced by keyed surrogates of the same type and format.

One pattern finds e-mail addresses, secrets, account numbers, IP addresses, identity, card and phone numbers, and
persons after a title or with a common given name. The names of a document's persons are then found wherever else they
stand in it, so a bare "Alex Smith" or "Smith" follows "Dr. Alex Smith". What a name is (given or family name) and its
gender are settled once for each name of a document, from all its persons.

The surrogate of an entity is drawn from its HMAC-SHA512: digits become digits, letters become letters, separators,
case, country code, top-level domain, known secret prefixes and the length of IP octets stay; private, link-local and
documentation addresses stay in their ranges; card numbers keep their checksum and IBANs get valid check digits; names
keep title, gender, script and capitals. Equal entities get equal surrogates in every document, names if their gender is
settled alike.

Collision check: the distinct entities of the corpus are gathered (partial aggregation first), as keyed digests and
shapes, never in clear; entities that share a surrogate, or whose surrogate is itself an entity found, get another
attempt until none is left; later attempts are longer, so there always is a free one. The few changed attempts are sent
to all tasks up to a size bound; beyond it they are joined to digests of the texts that hold them. All tables are
deleted as soon as they are read. The key reaches the tasks as a value of a subquery, so no plan shows it.

Defined cases: null texts stay null and empty ones empty; texts without entities are unchanged; repeated rows get
equal texts; an empty table gives an empty result; other columns are kept, and where one is named like an appended
column the appended one takes underscores. A very long text is searched whole, at about 10 bytes of memory a character.
"""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import forget, keep, let, spare

# Titles by gender, and common given names by gender.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин", "Г-н", "السيد"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Signora", "Госпожа", "Г-жа", "السيدة"),
    "n": ("Dr", "Prof", "Professor"),
}
GIVEN = {
    "m": (
        "James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Christopher", "Daniel", "Matthew", "Anthony", "Andrew",
        "Joshua", "Kenneth", "Kevin", "Brian", "George", "Edward", "Ronald", "Timothy", "Jason", "Jeffrey", "Ryan", "Jacob", "Nicholas", "Jonathan", "Stephen", "Benjamin", "Samuel", "Alexander",
        "Hans", "Klaus", "Jürgen", "Peter", "Wolfgang", "Günter", "Dieter", "Stefan", "Andreas", "Matthias", "Uwe", "Heinrich", "Friedrich", "Karl", "Ulrich", "Tobias", "Florian", "Lukas",
        "Pierre", "Jean", "Jacques", "François", "Michel", "Philippe", "Nicolas", "Laurent", "Antoine", "Julien", "Olivier", "Thierry", "Guillaume", "Sébastien",
        "Carlos", "José", "Juan", "Miguel", "Antonio", "Manuel", "Francisco", "Javier", "Alejandro", "Pablo", "Diego", "Fernando", "Rafael", "Sergio", "Иван", "Алексей", "Дмитрий", "Сергей",
    ),
    "f": (
        "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Lisa", "Nancy", "Margaret", "Sandra", "Ashley", "Kimberly", "Emily", "Donna", "Michelle",
        "Amanda", "Melissa", "Deborah", "Stephanie", "Rebecca", "Laura", "Amy", "Angela", "Rachel", "Catherine", "Olivia",
        "Anna", "Ursula", "Sabine", "Monika", "Petra", "Claudia", "Birgit", "Heike", "Gisela", "Ingrid", "Katharina", "Johanna", "Hannah", "Greta", "Anneliese",
        "Marie", "Sophie", "Camille", "Claire", "Nathalie", "Isabelle", "Sylvie", "Françoise", "Monique", "Céline", "Aurélie", "Émilie", "Hélène", "Juliette",
        "María", "Carmen", "Lucía", "Ana", "Isabel", "Pilar", "Dolores", "Teresa", "Rosario", "Elena", "Sofía", "Mercedes", "Beatriz", "Мария", "Елена", "Ольга", "Наталья",
    ),
}
_PART = r"(?:\p{Lu}(?:\p{Ll}+|\p{Lu}+)(?:[-'’]\p{L}+)?|\p{Lo}{2,12})"
_TITLE = "|".join(t for ts in TITLES.values() for t in sorted(ts, key=len, reverse=True))
_NAMES = "|".join(x for ns in GIVEN.values() for n in ns for x in (n, n.upper()))
#: Letters that begin a title or a given name: other places are passed over at once.
_FIRST = "".join(sorted({x[0] for xs in (*TITLES.values(), *GIVEN.values()) for x in xs}))
_H = "[0-9A-Fa-f]{1,4}"
#: In order of preference where several could begin at one place.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|ghp|gho|ghs|xoxb|xoxp|glpat)[-_][A-Za-z0-9_-]{16,120}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("ip6", rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{{0,38}}[0-9])(?:(?:{_H}:){{7}}{_H}|{_H}(?::{_H}){{0,5}}::(?:{_H}(?::{_H}){{0,5}})?)(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    (
        "phone",
        r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
        r"|(?<![0-9A-Za-z])(?=\+(?:[ .()/-]{0,2}[0-9]){8,15}(?![0-9]))\+[0-9]{1,3}(?:[ .-]?\(0\))?(?:[ ./-]?\(?[0-9]{1,12}\)?){1,6}(?![0-9])"
        r"|(?<![0-9A-Za-z.,-])(?:0[1-9](?:[ .-][0-9]{2}){4}|0[1-9][0-9]{1,4}[ /-][0-9]{5,9}|[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}|[6-9][0-9]{2}(?:[ .-][0-9]{3}){2}|[2-9][0-9]{9}|[2-9][0-9]{2}-[0-9]{4})(?![0-9A-Za-z-])",
    ),
    ("person", rf"(?=[{_FIRST}])(?<!\p{{L}})(?<!\b[Tt]he )(?:(?:{_TITLE})\.? {_PART}(?: {_PART}){{0,2}}|(?:{_NAMES}) {_PART}(?: {_PART})?)(?!\p{{L}})"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: A text without either holds no entity.
GATE = rf"[0-9@]|eyJ|(?=[{_FIRST}])(?:(?:{_TITLE})\.?|{_NAMES}) [\p{{Lu}}\p{{Lo}}]|[A-F]{{32}}"
HEX, CONSONANTS, VOWELS = "0123456789abcdef", "bdfghklmnprstvzj", "aeiouaeiouaeioua"
CYRILLIC = ("abdefghijklmnoprstuvz", "абдефгхийклмнопрстувз")
GREEK = ("abdefghijklmnoprstuvz", "αβδεφγηιζκλμνοπρστυωξ")
#: Letters that names in scripts without capitals are made of.
UNCASED = {
    "Han": "安白成东方高国海和华嘉建江杰金景君康乐立林明宁平青清庆仁山石世思泰天田文武西夏小心新星学雪雅阳叶义永玉元云正志中竹子宗",
    "Hangul": "가나다라마바사아자차하미비시지주수서선성연영우원유윤은인재정",
    "Arabic": "ابتجحدرزسشصطعفقكلمنهوي",
    "Hebrew": "אבגדהוזחטילמנספצקרשת",
    "Hiragana": "あいうえおかきくけこさしすせたちつてとなにのはひふまみむめもやゆよらりるれろわ",
    "Katakana": "アイウエオカキクケコサシスセタチツテトナニノハヒフマミムメモヤユヨラリルレロワ",
}
#: More changed attempts than this are joined by text instead of being sent to all tasks.
SENT_ATTEMPTS = 20_000
#: Texts with changed attempts that are sent to all tasks; more are joined by shuffle.
SENT_TEXTS = 100_000
#: From this attempt on, surrogates may change length.
FREE_FORM = 8
ENTITY = "struct<kind:string,d:string,shape:string,held:int,extra:string,own:string>"


def pads(key: str) -> tuple[bytes, bytes]:
    """The inner and outer key blocks of HMAC-SHA512."""
    block = key.encode() if len(key.encode()) <= 128 else hashlib.sha512(key.encode()).digest()
    block = block.ljust(128, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def with_key(df: DataFrame, key: str, inner: str, outer: str) -> DataFrame:
    """df with the key blocks as columns; plans show a subquery in their place."""
    one = df.sparkSession.createDataFrame([pads(key)], "a binary, b binary")
    return df.withColumn(inner, one.select("a").scalar()).withColumn(outer, one.select("b").scalar())


class Keyed:
    """HMAC-SHA512 by the key blocks in two columns."""

    def __init__(self, inner: str, outer: str):
        self.inner, self.outer = inner, outer

    def __call__(self, *parts: Column) -> Column:
        said = F.concat_ws("\x1f", *parts).cast("binary")
        return F.sha2(F.concat(F.col(self.outer), F.unhex(F.sha2(F.concat(F.col(self.inner), said), 512))), 512)


def kind_of(mention: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS[:-1]:
        hit = mention.rlike(rf"^(?:{pattern})$")
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.otherwise(F.lit("person"))


def _alnum(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9]", "")


def _title(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^((?:{_TITLE})\.? )", 1)


def _words(mention: Column) -> Column:
    return F.split(F.regexp_replace(mention, rf"^(?:{_TITLE})\.? ", ""), " ")


def evidence(persons: Column) -> Column:
    """(norm, shown, given, gender) of every part of persons found by the pattern."""

    def of(mention: Column) -> Column:
        title = F.regexp_replace(_title(mention), r"[. ]", "")

        def parts(words: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                listed = lambda g: F.initcap(x).isin(list(GIVEN[g]))
                given = (i < F.size(words) - 1) | ((F.size(words) == 1) & (listed("m") | listed("f")))
                gender = F.when(title.isin(list(TITLES["m"])), "m").when(title.isin(list(TITLES["f"])), "f").when(listed("m"), "m").when(listed("f"), "f").otherwise("n")
                return F.struct(F.lower(x).alias("norm"), x.alias("shown"), given.alias("given"), gender.alias("g"))

            return F.transform(words, one)

        return let(_words(mention), parts)

    return F.flatten(F.transform(persons, of))


def names(seen: Column) -> Column:
    """(norm, kind) of every name of a document: given if it is one anywhere, with the first gender that is told."""

    def settled(x: Column) -> Column:
        own = F.filter(seen, lambda e: (e["norm"] == x) & e["given"])
        gender = F.coalesce(F.get(F.filter(own, lambda e: e["g"] != "n"), 0)["g"], F.lit("n"))
        return F.struct(x.alias("norm"), F.when(F.size(own) > 0, F.concat(F.lit("given-"), gender)).otherwise(F.lit("surname")).alias("kind"))

    return F.transform(F.array_distinct(F.transform(seen, lambda e: e["norm"])), settled)


def _luhn(digits: Column) -> Column:
    """Checksum of an array of digit characters whose last one is the check digit."""
    n = F.size(digits)
    terms = F.transform(digits, lambda c, i: let(c.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _plain(kind: Column, mention: Column) -> Column:
    """The letters and digits that a surrogate replaces, in lower case."""
    return F.lower(_alnum(F.when(kind == "email", F.regexp_replace(mention, r"\.[^.]*$", "")).otherwise(mention)))


def _held(kind: Column, mention: Column, plain: Column) -> Column:
    """How many leading letters and digits stay."""
    prefix = F.length(F.regexp_extract(mention, r"^(AKIA|ASIA|eyJ|(?:sk|pk|ghp|gho|ghs|xoxb|xoxp|glpat)(?=[-_]))", 1))
    country = F.length(F.regexp_extract(mention, r"^\+([0-9]{1,3})(?=[^0-9])", 1))
    return F.when(kind == "secret", prefix).when(kind == "phone", country).when(kind == "iban", F.lit(2)).when(kind == "card", F.lit(1)).otherwise(F.lit(0))


def entity_of(keyed: Keyed, kind: Column, mention: Column) -> Column:
    """An entity other than a name: digest, shape (0 a digit, a a letter, held ones as they are), held, extra, own digest."""

    def of(k: Column) -> Column:
        def shaped(plain: Column) -> Column:
            held = _held(k, mention, plain)
            free = F.regexp_replace(F.regexp_replace(F.substr(plain, held + 1), "[0-9]", "0"), "[a-z]", "a")
            octets = F.split(mention, r"\.")
            inside = F.when(mention.rlike(r"^(?:10|127)\."), 1).when(mention.rlike(r"^(?:192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."), 2).otherwise(0)
            ip = F.array_join(F.transform(octets, lambda x, i: F.when(i < inside, x).otherwise(F.repeat(F.lit("#"), F.length(x)))), ".")
            low = F.lower(mention)
            kept = F.regexp_extract(low, r"^(2001:0?db8:|fe[89ab][0-9a-f]:|f[cd][0-9a-f]{2}:)", 1)
            ip6 = F.concat(kept, F.regexp_replace(F.substr(low, F.length(kept) + 1), "[0-9a-f]", "#"))
            shape = F.when(k == "ip", ip).when(k == "ip6", ip6).otherwise(F.concat(F.left(plain, held), free))
            hexed = (k == "secret") & mention.rlike("^[0-9A-Fa-f]+$")
            extra = F.when(k == "card", _luhn(_chars(plain)).cast("string")).when(hexed, F.lit("hex")).otherwise(F.lit(""))
            norm = F.when(k == "email", low).when(k == "phone", F.concat(held.cast("string"), F.lit("|"), plain)).when(k.isin("secret", "ip"), mention).when(k == "ip6", low).otherwise(plain)
            own = F.when(k == "ip", mention).when(k == "ip6", low).otherwise(plain)
            return F.struct(k.alias("kind"), keyed(k, norm).alias("d"), shape.alias("shape"), held.cast("int").alias("held"), extra.alias("extra"), F.left(keyed(F.lit("="), k, own), F.lit(32)).alias("own")).cast(ENTITY)

        return let(_plain(k, mention), shaped)

    return let(kind, of)


def name_entity(keyed: Keyed, kind: Column, norm: Column) -> Column:
    """A part of a name: its shape is its script, and its length where letters have no case."""
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), F.lit("Cyrillic")).when(norm.rlike(r"\p{IsGreek}"), F.lit("Greek"))
    for name in UNCASED:
        script = script.when(norm.rlike(rf"^\p{{Is{name}}}"), F.concat(F.lit(name), F.length(norm).cast("string")))
    return F.struct(kind.alias("kind"), keyed(kind, norm).alias("d"), script.otherwise(F.lit("Latin")).alias("shape"), F.lit(0).alias("held"), F.lit("").alias("extra"), F.left(keyed(F.lit("="), kind, norm), F.lit(32)).alias("own")).cast(ENTITY)


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substring(h, i % 64 * 2 + 1, 2), 16, 10).cast("int")


def _pick(chars: str, b: Column) -> Column:
    return F.substring(F.lit(chars), b % len(chars) + 1, 1)


def _letter(letters: str, hs: Column, i: Column) -> Column:
    return _pick(letters, _byte(hs, i))


def core(e: Column, attempt: Column) -> Column:
    """The surrogate of an entity: lower-case letters and digits in the places of the entity's letters and digits."""
    kind, shape, held = e["kind"], e["shape"], e["held"]
    stream = F.when(attempt == 0, e["d"]).otherwise(F.sha2(F.concat_ws(":", e["d"], attempt.cast("string")).cast("binary"), 512))
    longer = F.repeat(F.lit("0"), F.greatest(attempt - FREE_FORM, F.lit(0)))

    def drawn(hs: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            b = _byte(hs, i)
            return F.when(i < held, c).when(c == "0", _pick("0123456789", b)).when(e["extra"] == "hex", _pick("abcdef", b)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", b))

        return F.transform(_chars(F.concat(shape, longer)), one)

    def card(ds: Column) -> Column:
        bare = F.concat(F.slice(ds, 1, F.size(ds) - 1), F.array(F.lit("0")))
        return F.concat(F.array_join(F.slice(ds, 1, F.size(ds) - 1), ""), F.pmod(e["extra"].cast("int") - _luhn(bare), F.lit(10)).cast("string"))

    def iban(ds: Column) -> Column:
        value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 87)
        turned = F.concat(F.slice(ds, 5, F.greatest(F.size(ds) - 4, F.lit(0))), F.slice(ds, 1, 2), F.array(F.lit("0"), F.lit("0")))
        rest = F.aggregate(turned, F.lit(0), lambda a, c: let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))
        return F.concat(F.array_join(F.slice(ds, 1, 2), ""), F.lpad((98 - rest).cast("string"), 2, "0"), F.array_join(F.slice(ds, 5, F.greatest(F.size(ds) - 4, F.lit(0))), ""))

    def octets(hs: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            b = _byte(hs, i)
            n = F.when(attempt >= FREE_FORM, F.lit(0)).otherwise(F.length(x))
            # The first octet of a public address stays clear of the reserved ranges.
            first = F.when(n == 3, 128 + b % 40).when(n == 2, 11 + b % 89).when(n == 1, 1 + b % 9).otherwise(11 + b % 89)
            other = F.when(n == 3, 100 + b % 156).when(n == 2, 10 + b % 90).when(n == 1, b % 10).otherwise(b)
            return F.when(x.rlike("#"), F.when(i == 0, first).otherwise(other).cast("string")).otherwise(x)

        return F.array_join(F.transform(F.split(shape, r"\."), one), ".")

    def hexadecimal(hs: Column) -> Column:
        return F.array_join(F.transform(_chars(shape), lambda c, i: F.when(c == "#", F.substring(hs, i % 128 + 1, 1)).otherwise(c)), "")

    def name(hs: Column) -> Column:
        n = 2 * (F.when(kind == "surname", 4).otherwise(3) + F.least(attempt, F.lit(40)))
        syllables = F.concat(F.translate(hs, HEX, CONSONANTS), F.lit(""))
        vowels = F.translate(F.reverse(hs), HEX, VOWELS)
        body = F.left(F.array_join(F.zip_with(_chars(syllables), _chars(vowels), lambda c, v: F.concat(c, v)), ""), n)
        latin = F.concat(body, F.when(kind == "given-f", F.lit("a")).when(kind == "given-m", F.lit("n")).when(kind == "given-n", F.lit("e")).otherwise(F.lit("s")))
        out = F.when(shape == "Cyrillic", F.translate(latin, *CYRILLIC)).when(shape == "Greek", F.translate(latin, *GREEK))
        size = F.regexp_extract(shape, "([0-9]*)$", 1)
        for script, letters in UNCASED.items():
            places = F.sequence(F.lit(1), F.greatest(F.lit(2), size.try_cast("int")) + F.floor(attempt / 4).cast("int"))
            out = out.when(shape.rlike(f"^{script}[0-9]"), F.array_join(F.transform(places, partial(_letter, letters, hs)), ""))
        return out.otherwise(latin)

    def all_of(hs: Column) -> Column:
        return F.when(kind == "ip", octets(hs)).when(kind == "ip6", hexadecimal(hs)).when(kind.startswith("given") | (kind == "surname"), name(hs)).when(kind == "card", let(drawn(hs), card)).when(kind == "iban", let(drawn(hs), iban)).otherwise(F.array_join(drawn(hs), ""))

    return let(stream, all_of)


def _laid_out(body: Column, drawn: Column) -> Column:
    """drawn's characters in the places of body's letters and digits; what is left over follows."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(a: Column, c: Column) -> Column:
        x = F.substring(drawn, a["n"] + 1, 1)
        return F.when(c.rlike("[A-Z]"), F.struct(F.concat(a["out"], F.upper(x)).alias("out"), (a["n"] + 1).alias("n"))).when(c.rlike("[a-z0-9]"), F.struct(F.concat(a["out"], x).alias("out"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n")))

    return F.aggregate(F.split(body, ""), first, put, lambda a: F.concat(a["out"], F.substr(drawn, a["n"] + 1)))


class Search:
    """The working columns of a table of texts: key blocks, places, gaps between them, and their entities."""

    def __init__(self, docs: DataFrame, key: str):
        self.inner, self.outer, found, seen, known, pattern, self.mentions, self.gaps, self.kinds, self.entities = spare(docs, "inner", "outer", "found", "seen", "known", "pattern", "mentions", "gaps", "kinds", "entities")
        keyed = Keyed(self.inner, self.outer)
        text = F.col("text")
        persons = F.filter(found, lambda m: kind_of(m) == "person")
        # The names of a document, as they stand and in capitals, wherever they stand alone or side by side.
        shown = F.array_distinct(F.flatten(F.transform(seen, lambda e: F.array(e["shown"], F.upper(e["shown"]), F.initcap(e["shown"])))))
        either = F.concat(F.lit(r"(?:\Q"), F.array_join(F.filter(shown, lambda x: F.length(x) > 1), r"\E|\Q"), F.lit(r"\E)"))
        alone = F.concat(F.lit(ANY + r"|(?<!\p{L})"), either, F.lit("(?: "), either, F.lit(r"){0,3}(?!\p{L})"))
        none = F.array().cast("array<string>")
        step = with_key(docs, key, self.inner, self.outer).withColumn(found, F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
        step = step.withColumn(seen, F.when(F.size(found) > 0, evidence(persons)))
        step = step.withColumn(known, F.when(F.size(seen) > 0, names(F.col(seen)))).withColumn(pattern, F.when(F.exists(seen, lambda e: F.length(e["shown"]) > 1), alone))
        step = step.withColumn(self.mentions, F.when(F.col(pattern).isNotNull(), F.regexp_extract_all(text, F.col(pattern), F.lit(0))).otherwise(F.coalesce(F.col(found), none)))
        step = step.withColumn(self.gaps, F.when(F.col(pattern).isNotNull(), F.split(text, F.col(pattern), -1)).when(F.size(found) > 0, F.split(text, ANY, -1)))
        step = step.withColumn(self.kinds, F.transform(self.mentions, kind_of))

        def entities(m: Column, i: Column) -> Column:
            kind = F.get(F.col(self.kinds), i)
            part = lambda x: name_entity(keyed, F.coalesce(F.get(F.filter(known, lambda k: k["norm"] == F.lower(x)), 0)["kind"], F.lit("surname")), F.lower(x))
            return F.when(kind == "person", F.transform(_words(m), part)).otherwise(F.array(entity_of(keyed, kind, m)))

        self.table = step.drop(found, seen, pattern).withColumn(self.entities, F.transform(self.mentions, entities)).drop(known)


def surrogate(mention: Column, kind: Column, entities: Column, attempt_of) -> Column:
    """The mention with its surrogate in its own format. attempt_of(entity) gives the attempt of an entity."""

    def styled(x: Column, e: Column) -> Column:
        return let(core(e, attempt_of(e)), lambda d: F.when((F.upper(x) == x) & (F.length(x) > 1), F.upper(d)).otherwise(F.initcap(d)))

    person = F.concat(_title(mention), F.array_join(F.zip_with(_words(mention), entities, styled), " "))

    def other(e: Column) -> Column:
        body = F.when(kind == "email", F.regexp_replace(mention, r"\.[^.]*$", "")).otherwise(mention)
        tail = F.when(kind == "email", F.regexp_extract(mention, r"(\.[^.]*)$", 1)).otherwise(F.lit(""))
        return let(core(e, attempt_of(e)), lambda d: F.when(kind.isin("ip", "ip6"), d).otherwise(F.concat(_laid_out(body, d), tail)))

    return F.when(kind == "person", person).otherwise(let(F.get(entities, 0), other))


def entities(docs: DataFrame, key: str) -> DataFrame:
    """The distinct entities of all texts, without anything in clear but shapes, and how often each was found."""
    search = Search(docs.select("text"), key)
    found = search.table.select(F.explode(F.flatten(search.entities)).alias("e"))
    return found.groupBy("e").agg(F.count("*").alias("times")).select("e.*", "times")


def changed_attempts(found: DataFrame, key: str) -> DataFrame:
    """(d, attempt) of the entities whose first surrogate is not theirs alone."""
    found = keep(found.drop("times"), "entities")
    e = F.struct(*[c for c in found.columns])
    taken = keep(found.select("kind", F.col("own").alias("mark")).distinct(), "originals")

    def drawn_by(rows: DataFrame, attempt: int) -> DataFrame:
        named = rows.withColumn("attempt", F.lit(attempt)).withColumn("drawn", core(e, F.lit(attempt)))
        marked = with_key(named, key, "inner", "outer").withColumn("mark", F.left(Keyed("inner", "outer")(F.lit("="), F.col("kind"), F.col("drawn")), F.lit(32)))
        return marked.drop("inner", "outer", "drawn")

    drawn, attempt = keep(drawn_by(found, 0), "surrogates"), 0
    while True:
        # Of entities that share a surrogate the one that needed fewest attempts, then the first, keeps it, unless it is an original.
        holders = drawn.groupBy("kind", "mark").agg(F.min(F.struct("attempt", "d")).alias("holder"), F.count("*").alias("n"))
        wrong = holders.where("n > 1").join(drawn, ["kind", "mark"]).where(F.col("d") != F.col("holder.d")).select("d")
        wrong = keep(wrong.unionByName(drawn.join(taken, ["kind", "mark"], "left_semi").select("d")).distinct(), "collisions")
        if wrong.isEmpty():
            break
        attempt += 1
        again = drawn_by(found.join(wrong, "d", "left_semi"), attempt)
        now = keep(drawn.join(wrong, "d", "left_anti").unionByName(again), "surrogates")
        forget(drawn, wrong)
        drawn = now
    changed = keep(drawn.where("attempt > 0").select("d", "attempt"), "attempts")
    forget(found, taken, drawn, wrong)
    return changed


def report_names(docs: DataFrame) -> list[str]:
    """The names of the appended count and kinds: n_entities and kinds, or longer where docs has such a column."""
    taken = {c.lower() for c in docs.columns}
    return ["n_entities", "kinds"] if not taken & {"n_entities", "kinds"} else spare(docs, "n_entities", "kinds")


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with `text` pseudonymised, and `n_entities`, `kinds` (comma-joined, distinct) appended."""
    changed = changed_attempts(entities(docs, key), key)
    few = changed.limit(SENT_ATTEMPTS + 1).collect()
    search = Search(docs, key)
    ready = search.table
    none = F.lit(0)
    if not few:
        attempt_of = lambda e: none
    elif len(few) <= SENT_ATTEMPTS:
        # Two levels, as a map is searched from its start.
        by_lead: dict[str, dict[str, int]] = {}
        for r in few:
            by_lead.setdefault(r.d[:2], {})[r.d] = r.attempt
        sent = F.create_map(*[x for lead, held in by_lead.items() for x in (F.lit(lead), F.create_map(*[F.lit(v) for kv in held.items() for v in kv]))])
        attempt_of = lambda e: F.coalesce(F.try_element_at(F.try_element_at(sent, F.left(e["d"], F.lit(2))), e["d"]), none)
    else:
        name, held = spare(ready, "print", "attempts")
        digest = F.sha2(F.col("text").cast("binary"), 256)
        pairs = ready.where(F.size(search.entities) > 0).select(digest.alias(name), F.explode(F.array_distinct(F.transform(F.flatten(search.entities), lambda e: e["d"]))).alias("d"))
        wanted = pairs.join(changed, "d").groupBy(name, "d").agg(F.first("attempt").alias("attempt"))
        by_text = keep(wanted.groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("d", "attempt"))).alias(held)), "attempts-by-text")
        some = ready.where(F.size(search.entities) > 0).withColumn(name, digest)
        some = some.join(F.broadcast(by_text) if by_text.count() <= SENT_TEXTS else by_text, name, "left").drop(name)
        ready = some.unionByName(ready.where(F.coalesce(F.size(search.entities), none) <= 0).withColumn(held, F.lit(None).cast("map<string,int>")))
        attempt_of = lambda e: F.coalesce(F.try_element_at(F.col(held), e["d"]), none)
    if len(few) <= SENT_ATTEMPTS:
        forget(changed)
    new = F.transform(search.mentions, lambda m, i: surrogate(m, F.get(F.col(search.kinds), i), F.get(F.col(search.entities), i), attempt_of))
    joined = F.array_join(F.zip_with(search.gaps, new, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    count = F.coalesce(F.size(search.mentions), none)
    columns = [F.when(count > 0, joined).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    n_entities, kinds = report_names(docs)
    return ready.select(*columns, F.greatest(count, none).cast("long").alias(n_entities), F.when(count > 0, F.array_join(F.sort_array(F.array_distinct(search.kinds)), ",")).otherwise(F.lit("")).alias(kinds))
