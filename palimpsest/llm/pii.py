"""Surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail, IPv4 and IPv6 addresses, telephone, card, account (IBAN) and social-security numbers, secrets (keys by
their shape, values after words like ``password:``) and names (after a title, or a common given name before a capitalised word).
Each mention is replaced by a surrogate of its own kind, derived by a key from its canonical form (digits of a number, lower-cased
address, family name with its script): equal entities get equal surrogates in all documents, whatever their punctuation or case,
which the surrogate keeps. A family name has one surrogate with any title, gender or given name; a given name's goes by both names
and by the gender that a common given name has, else the title's. After a plus sign seven digits at least make a telephone number. Numbers keep their digit count and grouping, telephone numbers their country code, card and account numbers
their check digits' validity, secrets their prefix and character classes, names their title, gender, script and number of words,
capitals stay capitals. A run of digits whose Luhn sum is wrong is no card number, and an account number's check digits must be right.

Distinctness. Telephone, card, social-security numbers and IPv4 addresses pass through a keyed permutation of all numbers of their
form (``permuted``), so distinct entities have distinct surrogates by construction, and none is its own. The other kinds get hashes
of 40 bits or more, and a collision check over the table of distinct entities: no two may share a surrogate and no surrogate may be
an entity of its kind that occurs. Of those that clash all but the smallest are derived anew, with the next attempt, until none is
left. Up to FEW such entities reach all texts as one broadcast row; beyond that the affected texts get their own by a join.

Nulls: a null text stays null and has no entities; other columns, null or not, pass through, also those whose names this
module uses inside. A very long text is one value and is scanned in one pass: every pattern starts at a boundary and
cannot backtrack over a run twice. Equal rows get equal surrogates. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Titles, by gender (n: any) and script.
TITLES = {
    ("m", "latin"): ["Mr", "Herr", "Señor", "Monsieur"],
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame"],
    ("n", "latin"): ["Dr", "Prof", "Professor", "Doctor"],
    ("m", "cyrillic"): ["Господин"],
    ("f", "cyrillic"): ["Госпожа"],
    ("m", "greek"): ["Κύριος"],
    ("f", "greek"): ["Κυρία"],
}
GIVEN = {
    ("m", "latin"): ["Adam", "Boris", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"],
    ("f", "latin"): ["Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Hanna", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sara", "Vera"],
    ("n", "latin"): ["Alex", "Andrea", "Chris", "Dominique", "Jean", "Jo", "Kim", "Kit", "Lou", "Morgan", "Nico", "Robin", "Sam", "Sasha", "Toni", "Val"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Иван", "Марк", "Олег", "Павел"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("m", "greek"): ["Νίκος", "Πέτρος", "Γιάννης", "Κώστας"],
    ("f", "greek"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
}
#: Given names that make a capitalised word after them a family name, without a title.
COMMON = {
    "m": ["John", "James", "William", "Michael", "Richard", "Charles", "Joseph", "George", "Edward", "Peter", "Andrew", "Hans", "Klaus", "Wolfgang", "Stefan", "Pierre", "Jacques", "Philippe", "François", "Juan", "José", "Carlos", "Pedro", "Luis"],
    "f": ["Mary", "Jane", "Elizabeth", "Susan", "Margaret", "Sarah", "Karen", "Nancy", "Helen", "Catherine", "Anna", "Ursula", "Petra", "Sabine", "Monika", "Marie", "Sophie", "Isabelle", "Camille", "Carmen", "Ana", "Lucía", "Pilar", "Elena"],
}
#: Sixteen consonants and four vowels of each script, for family names.
LETTERS = {"latin": ("bcdfghklmnprstvw", "aeio"), "cyrillic": ("бвгдзклмнпрстфхч", "аеио"), "greek": ("βγδζθκλμνπρστφχψ", "αεηο")}
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
_COMMON = "|".join(n for names in COMMON.values() for n in names)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
_FAMILY = r"\p{Lu}[\p{L}'-]*+"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:(?:{_TITLE})\.? {_FAMILY}(?: {_FAMILY})?|(?:{_COMMON}) \p{{Lu}}\p{{Ll}}[\p{{L}}'-]*+)"
SECRET = (
    r"(?<![A-Za-z0-9])(?=[a-fgsA-F0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+"
    r"|(?=[a-f]*[0-9])[0-9a-f]{32,64}|(?=[A-F]*[0-9])[0-9A-F]{32,64})(?![A-Za-z0-9])"
)
#: A word that names a secret, and its value.
_LABEL = r"(?i:password|passwd|pwd|secret_access_key|api_key)[ \x22']{0,2}[:=][ \x22']{0,2}"
ASSIGNED = rf"(?<![\p{{L}}\p{{N}}])(?=[pPsSaA]){_LABEL}[A-Za-z0-9!#$%&*+/=?@^_~-]{{6,128}}"
ADDRESS = rf"(?=\d)(?<![\d.\p{{L}}])(?<!(?i:version|release|ver)[ .]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
ADDRESS6 = r"(?<![\p{L}\p{N}:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[0-9a-fA-F:]*\d)(?:[0-9a-fA-F]{1,4}:){2,6}:(?:[0-9a-fA-F]{1,4}:){0,4}[0-9a-fA-F]{1,4})(?![\p{L}\p{N}:])"
ACCOUNT = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![\p{L}\p{N}])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+(])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+(?=(?:[ .()-]{0,2}\d){7})\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\d))"
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
CARD = r"(?<![\d.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)"
#: Every kind begins where no letter or digit is before it; the order decides where two could begin at one place.
ANY = rf"(?<![\p{{L}}\p{{N}}])(?:{EMAIL}|(?=\p{{L}})(?:{NAME}|{SECRET}|{ASSIGNED}|{ACCOUNT}|{ADDRESS6})|(?=[0-9+(])(?:{SECRET}|{ADDRESS6}|{ADDRESS}|{SOCIAL}|{PHONE}|{CARD}))"
#: A text without any of these holds no entity.
HINT = rf"[0-9@]|(?=\p{{Lu}})(?:{_TITLE}|{_COMMON})|(?=[pPsSaA])(?i:password|passwd|pwd|secret_access_key|api_key)|sk-|eyJ"
KINDS = ("email", "name", "secret", "ip", "ip6", "ssn", "phone", "card", "iban")
#: Surrogates of these are permuted numbers; those of the others are hashes.
PERMUTED = ("ip", "ssn", "phone", "card")
HEX = "0123456789abcdef"
#: Entities derived anew that a broadcast row may hold.
FEW = 10_000
#: A clash of one entity has a chance below a half in each attempt, as the spaces of surrogates are larger than twice what can occur.
ATTEMPTS = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value computed once."""
    return F.transform(F.array(value), use)[0]


def _luhn(digits: Column, doubled_last: bool) -> Column:
    """Sum by Luhn's rule; doubled_last: the last digit is the first to be doubled."""
    reverse = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * F.when(i % 2 == (0 if doubled_last else 1), 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(F.filter(reverse, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v)


def _mod97(account: Column) -> Column:
    """The account number's remainder, letters counting from 10."""
    moved = F.split(F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4))), "")
    value = lambda c: F.conv(c, 36, 10).cast("long")
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))


def kind(m: Column) -> Column:
    """``none`` for a number whose check digits are wrong."""
    full = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(full(EMAIL), "email").when(full(NAME), "name").when(full(SECRET), "secret")
        .when(full(ACCOUNT), F.when(_mod97(F.replace(m, F.lit(" "), F.lit(""))) == 1, "iban").otherwise("none"))
        .when(full(ADDRESS), "ip").when(full(ADDRESS6), "ip6").when(full(SOCIAL), "ssn").when(full(PHONE), "phone")
        .when(full(CARD), F.when(m.rlike("[ -]") | (_luhn(m, False) % 10 == 0), "card").otherwise("none"))
        .otherwise("secret")
    )


def _group(m: Column) -> tuple[Column, Column]:
    """Gender and script of a name: a common given name tells the gender, else the title."""
    of = lambda g: [t for (own, _), ts in TITLES.items() if own == g for t in ts]
    given = F.regexp_extract(_untitled(m), r"^(\S+) ", 1)
    gender = F.when(given.isin(*COMMON["f"]), "f").when(given.isin(*COMMON["m"]), "m").when(m.rlike(rf"^(?:{'|'.join(of('f'))})\.? "), "f").when(m.rlike(rf"^(?:{'|'.join(of('n'))})\.? "), "n").otherwise("m")
    script = F.when(m.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(m.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    return gender, script


def _untitled(m: Column) -> Column:
    return F.regexp_replace(m, rf"^(?:{_TITLE})\.? ", "")


def _value(m: Column) -> Column:
    """A secret without the word that names it."""
    return F.regexp_replace(m, f"^{_LABEL}", "")


def canonical(m: Column, k: Column) -> Column:
    """What two mentions of one entity share; of a name the family name and its script."""
    _, script = _group(m)
    digits = F.regexp_replace(m, r"[^0-9]", "")
    return (
        F.when(k.isin("email", "ip6"), F.lower(m)).when(k == "name", F.concat(script, F.lit(" "), F.lower(F.substring_index(_untitled(m), " ", -1)))).when(k == "secret", _value(m)).when(k.isin("ip", "none"), m)
        .when(k == "iban", F.replace(m, F.lit(" "), F.lit(""))).when((k == "phone") & m.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    )


def full_name(m: Column, k: Column) -> Column:
    """Gender, script, given and family name of a mention that has both, else null: the same with any title or none."""
    gender, script = _group(m)
    return F.when((k == "name") & F.contains(_untitled(m), F.lit(" ")), F.concat(gender, F.lit(" "), script, F.lit(" "), F.lower(F.replace(_untitled(m), F.lit(" "), F.lit("|")))))


def permuted(key: str, tag: Column, x: Column, y: Column, n: Column, m: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(x', y') for the image of (x, y), 0 <= x < n and 0 <= y < m, under a keyed permutation of all such pairs without a
    fixed point: four Feistel rounds, one step on, and the rounds back."""

    def noise(i: int, part: Column, most: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(f"{key}|{i}"), tag, n.cast("string"), m.cast("string"), part.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), most)

    steps: list[Callable[[Column], Column]] = []
    for i in range(4):
        steps.append((lambda i: lambda s: F.struct(((s["x"] + noise(i, s["y"], n)) % n).alias("x"), s["y"].alias("y")) if i % 2 == 0 else F.struct(s["x"].alias("x"), ((s["y"] + noise(i, s["x"], m)) % m).alias("y")))(i))
    steps.append(lambda s: F.struct(((s["x"] + 1) % n).alias("x"), s["y"].alias("y")))
    for i in reversed(range(4)):
        steps.append((lambda i: lambda s: F.struct(F.pmod(s["x"] - noise(i, s["y"], n), n).alias("x"), s["y"].alias("y")) if i % 2 == 0 else F.struct(s["x"].alias("x"), F.pmod(s["y"] - noise(i, s["x"], m), m).alias("y")))(i))

    def run(s: Column, rest: list) -> Column:
        return let(rest[0](s), lambda t: run(t, rest[1:])) if rest else use(s["x"], s["y"])

    return let(F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), lambda s: run(s, steps))


def _phone(canon: Column) -> Column:
    """head: the country code, which stays. american: ten digits of the North American form, which keep it: neither part begins
    with 0 or 1. Of others with its country code or none the 0 or 1 stays that makes the difference, at ``low``, and a first digit
    from 2 to 9, ``lead``, so that no two forms share a surrogate; ``rest`` is what moves."""
    head = F.when(canon.startswith("+"), F.regexp_extract(canon, COUNTRY, 0)).otherwise("")
    body = F.substr(canon, F.length(head) + 1)
    ten = canon.rlike(r"^(?:\+1)?\d{10}$")
    low = F.when(ten & body.rlike("^[01]"), 1).when(ten, 4).otherwise(0)
    rest = F.when(low == 0, body).when(low == 1, F.substr(body, F.lit(2))).otherwise(F.concat(F.substr(body, F.lit(2), F.lit(2)), F.substr(body, F.lit(5))))
    return F.struct(head.alias("head"), body.alias("body"), canon.rlike(r"^(?:\+1)?[2-9]\d\d[2-9]\d{6}$").alias("american"), low.alias("low"), rest.alias("rest"))


def _permuted(key: str, k: Column, canon: Column) -> Column:
    """The surrogate of a number, of whatever kind: one permutation over parts that depend on the kind."""
    octets = F.split(canon, r"\.")
    part = lambda i: F.element_at(octets, i).try_cast("long")
    check = lambda b: (10 - _luhn(b, True) % 10) % 10
    body = F.substr(canon, F.lit(1), F.length(canon) - 1)
    long = lambda c: F.concat(F.lit("0"), c).try_cast("long")

    def move(p: Column) -> Column:
        american = (k == "phone") & p["american"]
        three = lambda at: F.substr(p["body"], F.lit(at), F.lit(3)).try_cast("long") - 200
        digits = F.when(k == "phone", p["rest"]).when(k == "card", body).otherwise(canon)

        def run(d: Column) -> Column:
            h = F.floor((F.length(d) + 1) / 2).cast("int")
            rest = F.length(d) - h
            ten = lambda e: F.pow(F.lit(10), e).cast("long")
            by = lambda ip, area, other: F.when(k == "ip", ip).when(american, area).otherwise(other)
            tag = by(F.lit("ip"), F.lit("american"), F.concat(k, F.when(k == "phone", p["low"].cast("string")).otherwise("")))
            x = by(part(1) * 256 + part(2), three(1) * 800 + three(4), long(F.substr(d, F.lit(1), h)))
            y = by(part(3) * 256 + part(4), F.substr(p["body"], F.lit(7)).try_cast("long"), long(F.substr(d, h + 1)))
            n, m = by(F.lit(65_536), F.lit(640_000), ten(h)), by(F.lit(65_536), F.lit(10_000), ten(rest))

            def joined(x: Column, y: Column) -> Column:
                padded = lambda v, e: F.lpad(v.cast("string"), e, F.lit("0"))
                area = F.concat((F.floor(x / 800) + 200).cast("string"), (x % 800 + 200).cast("string"), padded(y, F.lit(4)))
                return by(F.concat_ws(".", *[v.cast("string") for v in (F.floor(x / 256), x % 256, F.floor(y / 256), y % 256)]), area, F.concat(padded(x, h), padded(y, rest)))

            return permuted(key, tag, x, y, n, m, joined)

        def formed(v: Column) -> Column:
            first = F.substr(p["body"], F.lit(1), F.lit(1))
            other = F.when(p["low"] == 0, v).when(p["low"] == 1, F.concat(first, v)).otherwise(F.concat(first, F.substr(v, F.lit(1), F.lit(2)), F.substr(p["body"], F.lit(4), F.lit(1)), F.substr(v, F.lit(3))))
            off = F.substr(canon, F.length(canon)).try_cast("int") - check(body)  # 0 for a valid number
            card = F.concat(v, F.pmod(check(v) + off, F.lit(10)).cast("int").cast("string"))
            return F.when(k == "phone", F.concat(p["head"], F.when(p["american"], v).otherwise(other))).when(k == "card", card).otherwise(v)

        return let(let(digits, run), formed)

    return let(_phone(canon), move)


def _classes(rest: Column, d: Column) -> Column:
    """A string of the same character classes from hexadecimal digits d, as many or more."""
    as_digit, as_letter = (lambda h: F.translate(h, "abcdef", "123456")), (lambda h: F.translate(h, "0123456789", "ghijklmnop"))
    return F.array_join(F.transform(F.split(rest, ""), lambda c, i: let(F.substr(d, i + 1, F.lit(1)), lambda h: F.when(c.rlike("[0-9]"), as_digit(h)).when(c.rlike("[A-Z]"), F.upper(as_letter(h))).when(c.rlike("[a-z]"), as_letter(h)).otherwise(c))), "")


def surrogate(key: str, k: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of the surrogate."""

    def hashed(d: Column) -> Column:
        letters = F.translate(d, "0123456789", "ghijklmnop")
        domain = F.translate(F.sha2(F.concat(F.lit(key + "|domain|"), F.substring_index(canon, "@", -1)), 256), "0123456789", "ghijklmnop")
        email = F.concat(F.substring(letters, 1, 16), F.lit("@"), F.substring(domain, 1, 12), F.lit(".example.net"))
        longer = F.concat(d, F.sha2(d, 256), F.sha2(F.concat(d, d), 256), F.sha2(F.concat(d, F.lit("+"), d), 256))
        prefix = F.regexp_extract(canon, r"^(AKIA|gh[pousr]_|sk-|eyJ)", 1)
        hexed = F.when(canon == F.upper(canon), F.upper(longer)).otherwise(longer)
        rest = F.substr(canon, F.length(prefix) + 1)
        # values of less than 16 letters and digits would be too few for all that may occur
        secret = F.when(canon.rlike(r"^(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})$"), F.substr(hexed, F.lit(1), F.length(canon))).when(F.length(F.regexp_replace(rest, "[^A-Za-z0-9]", "")) < 16, F.concat(prefix, F.substring(letters, 1, 16))).otherwise(F.concat(prefix, _classes(rest, F.concat(longer, longer, longer, longer))))
        # an address of less than 16 digits has few like it: it becomes one of eight full groups
        six = F.when(F.length(F.replace(canon, F.lit(":"), F.lit(""))) < 16, F.concat_ws(":", *[F.substring(d, 4 * i + 1, 4) for i in range(8)])).otherwise(F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substr(longer, i + 1, F.lit(1)))), ""))
        account = let(F.concat(F.substring(canon, 1, 2), F.lit("00"), _classes(F.substr(canon, F.lit(5)), d)), lambda a: F.concat(F.substring(a, 1, 2), F.lpad((98 - _mod97(a)).cast("string"), 2, "0"), F.substr(a, F.lit(5))))
        name = F.lit(None).cast("string")
        for script, (consonants, vowels) in LETTERS.items():
            c, v = F.translate(F.substring(d, 9, 8), HEX, consonants), F.translate(F.substring(d, 17, 4), HEX, vowels * 4)
            family = F.concat(*[F.substring(x, p, 1) for i in range(4) for x, p in ((c, 2 * i + 1), (v, i + 1), (c, 2 * i + 2))])
            name = F.when(canon.startswith(f"{script} "), F.concat(F.lit(f"{script} "), family)).otherwise(name)
        return F.when(k == "email", email).when(k == "name", name).when(k == "iban", account).when(k == "ip6", six).otherwise(secret)

    made = let(F.sha2(F.concat_ws("|", F.lit(key), k, canon, attempt.cast("string")), 256), hashed)
    return F.when(k == "none", canon).when(k.isin(*PERMUTED), _permuted(key, k, canon)).otherwise(made)


def given_name(key: str, canon: Column, attempt: Column) -> Column:
    """The surrogate of a full name: ``=``, gender, script, a given name of the list and the own family name. As lists are short,
    each attempt adds two letters, so there are always enough."""

    def hashed(d: Column) -> Column:
        out = F.lit(None).cast("string")
        for (gender, script), names in GIVEN.items():
            consonants, vowels = LETTERS[script]
            first = F.lower(F.element_at(F.array(*[F.lit(g) for g in names]), F.conv(F.substring(d, 1, 4), 16, 10).cast("int") % len(names) + 1))
            more = F.translate(F.substr(d, F.lit(5), F.least(2 * attempt, F.lit(59))), HEX, (vowels * 2 + consonants)[:16])
            out = F.when(canon.startswith(f"{gender} {script} "), F.concat(F.lit(f"={gender} {script} "), first, more, F.lit("|"), F.substring_index(canon, "|", -1))).otherwise(out)
        return out

    return let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("full"), canon, attempt.cast("string")), 256), hashed)


def _surrogate(key: str, k: Column, canon: Column, attempt: Column) -> Column:
    return F.when(k == "full", given_name(key, canon, attempt)).otherwise(surrogate(key, k, canon, attempt))


def written(m: Column, k: Column, s: Column) -> Column:
    """The surrogate in the mention's form."""
    plain = F.replace(s, F.lit("+"), F.lit(""))

    def spelled(sign: str, value: Column) -> Column:
        return F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike(sign), F.substr(value, F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), sign.replace("[", "[^"), "")), F.lit(1))).otherwise(c)), "")

    capitals = (m == F.upper(m)) & (m != F.lower(m))
    name = F.concat(F.regexp_extract(m, rf"^((?:{_TITLE})\.? )?", 0), F.initcap(s))
    cased = lambda v: let(v, lambda x: F.when(capitals, F.upper(x)).otherwise(x))
    return F.when(k.isin("email", "ip6"), cased(s)).when(k == "name", cased(name)).when(k == "secret", F.concat(F.regexp_extract(m, f"^({_LABEL})?", 0), s)).when(k.isin("ip", "none"), s).when(k == "iban", spelled("[A-Z0-9]", s)).otherwise(spelled("[0-9]", plain))


def _is(k: str) -> Callable[[Column], Column]:
    return lambda x: x == k


def hinted(text: Column) -> Column:
    """Cheap to tell, and true of every text with an entity."""
    return text.rlike(HINT)


def mentions(text: Column) -> Column:
    return F.when(hinted(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, canon) of all texts; a given and a family name are also one of kind full."""
    found = docs.select(F.explode(mentions(F.col("text"))).alias("m")).withColumn("kind", kind(F.col("m"))).filter("kind <> 'none'")
    return found.select(F.explode(_entities(F.col("m"), F.col("kind"))).alias("e")).groupBy("e.kind", "e.canon").count().select("kind", "canon")


def _entities(m: Column, k: Column) -> Column:
    of = lambda kind, canon: F.struct(kind.alias("kind"), canon.alias("canon"))
    return F.filter(F.array(of(k, canonical(m, k)), of(F.lit("full"), full_name(m, k))), lambda e: e["canon"].isNotNull())


def attempts(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose attempt is above 0; found: stored distinct entities."""
    real = found.filter(~F.col("kind").isin(*PERMUTED))
    made = stored(real.withColumn("attempt", F.lit(0)).withColumn("s", _surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))), "surrogates")
    for _ in range(ATTEMPTS):
        order = Window.partitionBy("kind", "s").orderBy("attempt", "canon")
        occurs = real.select("kind", F.col("canon").alias("s"), F.lit(1).alias("real"))
        checked = made.join(occurs, ["kind", "s"], "left").withColumn("clash", F.col("real").isNotNull() | (F.row_number().over(order) > 1))
        again = stored(checked.filter("clash").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "clashes")
        if not again.limit(1).count():
            return made.filter("attempt > 0").select("kind", "canon", "attempt")
        redone = again.withColumn("s", _surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        made = stored(made.join(again.select("kind", "canon"), ["kind", "canon"], "left_anti").unionByName(redone.select(*made.columns)), "surrogates")
    raise RuntimeError(f"surrogates still clash after {ATTEMPTS} attempts")


def replace(docs: DataFrame, key: str, *, counts: bool = False) -> DataFrame:
    """docs with surrogates in text; counts adds n_entities and one n_ column for each of KINDS, in place of columns of these names."""
    again = stored(attempts(stored(entities(docs), "entities"), key), "attempts")
    clashes = again.limit(FEW + 1).count()
    text = F.col("text")
    retry, held_mentions, held_kinds, at = "_palimpsest_retry", "_palimpsest_mentions", "_palimpsest_kinds", "_palimpsest_at"
    known = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias(retry)
    rows = docs
    if 0 < clashes <= FEW:
        rows = docs.withColumn(at, F.lit(1)).join(F.broadcast(again.groupBy(F.lit(1).alias(at)).agg(known)), at, "left").drop(at)
    elif clashes:
        # texts that mention such an entity, by digest, with their attempts
        held = docs.select(F.md5("text").alias(at), F.explode(F.array_distinct(mentions(text))).alias("m")).withColumn("kind", kind(F.col("m")))
        held = held.select(at, F.explode(_entities(F.col("m"), F.col("kind"))).alias("e")).select(at, "e.kind", "e.canon").distinct().join(again, ["kind", "canon"])
        rows = docs.withColumn(at, F.md5("text")).join(held.groupBy(at).agg(known), at, "left").drop(at)

    def new(m: Column, k: Column) -> Column:
        tried = lambda kind, c: F.coalesce(F.try_element_at(F.col(retry), F.concat_ws("|", kind, c)), F.lit(0)) if clashes else F.lit(0)
        made = let(canonical(m, k), lambda c: surrogate(key, k, c, tried(k, c)))
        # a name is its family name's surrogate after its given name's, which goes by both
        given = let(full_name(m, k), lambda f: F.when(f.isNotNull(), F.concat(F.regexp_extract(given_name(key, f, tried(F.lit("full"), f)), r"^=\S+ \S+ (\S+)\|", 1), F.lit(" "))).otherwise(""))
        return written(m, k, let(made, lambda s: F.when(k == "name", F.concat(given, F.substring_index(s, " ", -1))).otherwise(s)))

    # found once for each text; Spark does not repeat a costly expression that several columns use
    ms, kinds = F.col(held_mentions), F.col(held_kinds)
    rows = rows.withColumn(held_mentions, mentions(text)).withColumn(held_kinds, F.transform(ms, kind))
    rebuilt = F.array_join(F.zip_with(F.split(text, ANY, -1), F.zip_with(ms, kinds, new), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    columns = {"text": F.when(F.size(ms) > 0, rebuilt).otherwise(text)}
    if counts:
        number = lambda of: F.coalesce(F.size(F.filter(kinds, of)), F.lit(0)).cast("long")
        columns |= {"n_entities": number(lambda x: x != "none")} | {f"n_{k}": number(_is(k)) for k in KINDS}
    return rows.withColumns(columns).drop(retry, held_mentions, held_kinds)
