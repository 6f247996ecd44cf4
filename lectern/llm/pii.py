"""PII surrogates: keyed, type-consistent replacements that keep distinctness and coreference.

All is DataFrame work. Mentions are found by one regular expression; the distinct entities behind them get
surrogates from a keyed digest, collisions are found by grouping and resolved by further attempts, and each
mention is rendered in its own format: separators, case and script stay. A person's name is taken apart: each part
is an entity, so that full names, surnames with a title and bare names of one person stay names of one person.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import cut

# Titles that lead a name, by gender and script, and name parts of each script.
TITLES = {
    ("m", "latin"): ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr"],
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra"],
    ("n", "latin"): ["Dr", "Prof"],
    ("m", "cyrillic"): ["Господин", "г-н"],
    ("f", "cyrillic"): ["Госпожа", "г-жа"],
    ("m", "greek"): ["Κύριος"],
    ("f", "greek"): ["Κυρία"],
}
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karel", "Leon", "Martin", "Nils", "Oscar", "Paul"],
    ("f", "latin"): ["Ada", "Berta", "Clara", "Dora", "Emma", "Flora", "Greta", "Hanna", "Ines", "Julia", "Klara", "Lena", "Maria", "Nora", "Olga", "Paula"],
    ("n", "latin"): ["Alex", "Charlie", "Eden", "Jamie", "Jules", "Kim", "Lou", "Marlin", "Noel", "Quinn", "Robin", "Sam", "Sasha", "Toni", "Val", "Yael"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Марк", "Никита", "Олег", "Павел", "Роман", "Семён", "Фёдор"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София"],
    ("m", "greek"): ["Άρης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θάνος", "Κώστας", "Λουκάς", "Μάριος", "Νίκος", "Πέτρος", "Σπύρος", "Στέφανος", "Τάσος", "Φίλιππος", "Χρήστος"],
    ("f", "greek"): ["Άννα", "Βάσω", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Ιωάννα", "Κατερίνα", "Λένα", "Μαρία", "Νίκη", "Όλγα", "Ρένα", "Σοφία", "Χαρά"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ha", "ka", "le", "mi", "no", "pa", "re", "sa", "ti", "vo", "we", "zo"],
    "cyrillic": ["ба", "ве", "ги", "до", "за", "ка", "ле", "ми", "но", "па", "ре", "са", "ти", "фо", "ха", "чу"],
    "greek": ["βα", "γε", "δι", "ζο", "θα", "κα", "λε", "μι", "νο", "πα", "ρε", "σα", "τι", "φο", "χα", "ψε"],
}
# Endings of surnames and of made-up given names.
SURNAME_ENDINGS = {("m", "cyrillic"): "ов", ("f", "cyrillic"): "ова", ("m", "greek"): "ης", ("f", "greek"): "η"}
GIVEN_ENDINGS = {("m", "latin"): "o", ("f", "latin"): "a", ("n", "latin"): "i", ("m", "cyrillic"): "ан", ("f", "cyrillic"): "ина", ("m", "greek"): "ος", ("f", "greek"): "α"}
#: Attempts at a surrogate of its own that an entity gets. Names and addresses grow with them; of numbers this many
#: fail only if nearly all numbers of that form are in use.
ATTEMPTS = 64

_TITLE = "(?:" + "|".join(sorted({spelled for own in TITLES.values() for t in own for spelled in (t, t.upper())}, key=lambda t: (-len(t), t))) + ")"
_LED = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE}\.? ){{1,3}}(?:\p{{Lu}}\. ?){{0,3}}"
#: A capitalised word that begins neither an address nor an access key and is no title.
_NAME = rf"(?!{_TITLE}(?!\p{{L}}))(?!(?:AKIA|ASIA)[A-Z0-9]{{16}})(?=\S\S)\p{{Lu}}[\p{{L}}\p{{M}}]{{0,30}}(?:['’\-]\p{{Lu}}[\p{{L}}\p{{M}}]{{0,30}}){{0,3}}(?![\p{{L}}\p{{N}}])(?![A-Za-z0-9._%+\-]{{0,64}}@)"
# Every repeat of a group has a bound, so that no text makes the matcher recurse without end: a local part has 64
# characters at most, a label 63, and a host 127 labels.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "secret": r"(?<=[=:\s\"'])(?<=(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(?=[0-9+/_\-]{0,63}[A-Za-z])[A-Za-z0-9+/_\-]{12,}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-])",
}
NUMBERS = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What is looked for in all texts, and what is replaced in those that introduce a person: runs of capitalised words.
ANY = rf"{NUMBERS}|{_LED}{_NAME}(?: {_NAME}){{0,2}}"
NAMED = rf"{NUMBERS}|(?<![\p{{L}}\p{{N}}]){_NAME}(?: {_NAME}){{0,7}}"
#: Texts without such a character, and without one of the titles that no other is part of, hold nothing of ANY.
HINT = r"[0-9@=:]"
_SPELLED = {spelled for own in TITLES.values() for t in own for spelled in (t, t.upper())}
HINTS = sorted(t for t in _SPELLED if not any(u != t and u in t for u in _SPELLED))
#: Stands around matches for a moment.
MARK = "\ue000"


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """The sum that is a multiple of 10 for a card number."""
    backwards = F.reverse(_characters(digits))
    doubled = F.transform(backwards, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The rest by 97 of an IBAN, its first four characters moved to the end and letters read as 10 to 35."""
    turned = _characters(F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4))))
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"))


def kind_of(mention: Column) -> Column:
    """The type of a match of ANY, or null if it is no personal data after all."""
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    found = F.when(mention.contains("@"), "email").when(F.regexp_like(mention, F.lit(rf"^(?:{PATTERNS['access_key']})$")), "access_key").when(F.regexp_like(mention, F.lit(rf"^{_TITLE}\.? ")), "person")
    found = found.when(F.regexp_like(mention, F.lit(rf"^(?:{PATTERNS['ssn']})$")), "ssn").when(F.regexp_like(mention, F.lit(rf"^(?:{PATTERNS['ip']})$")), "ip").when(F.regexp_like(mention, F.lit(r"^[+(]")), "phone")
    found = found.when(F.regexp_like(mention, F.lit(r"^[0-9 \-]+$")), F.when(luhn(digits) % 10 == 0, "card"))
    spaceless = F.regexp_replace(mention, " ", "")
    return found.when(F.regexp_like(mention, F.lit(rf"^(?:{PATTERNS['iban']})$")) & F.length(spaceless).between(15, 34), F.when(_mod97(spaceless) == 1, "iban").when(F.length(mention) >= 12, "secret")).when(mention.contains(" "), None).otherwise("secret")


def norm_of(kind: Column, mention: Column) -> Column:
    """What all mentions of an entity have in common."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, r"[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind.isin("ip", "secret", "access_key"), mention)
        .otherwise(F.lower(mention))
    )


def name_parts(mention: Column) -> Column:
    """The parts of a titled name as structs of kind, norm (gender, script and the name) and the name: the last is the surname, others are given names.

    The gender is that of the titles; where they tell none, that of the name's ending in scripts whose names have one.
    Surnames of the Latin script have none. The script is the name's own.
    """
    titles = F.regexp_extract_all(F.regexp_extract(mention, rf"^((?:{_TITLE}\.? )+)", 1), F.lit(_TITLE), F.lit(0))

    def told(gender: str) -> Column:
        spelled = [x for (g, _), own in TITLES.items() if g == gender for t in own for x in (t, t.upper())]
        return F.exists(titles, lambda t: t.isin(*spelled))

    names = F.split(F.regexp_replace(mention, _LED, ""), " ")

    def part(name: Column, i: Column) -> Column:
        low = F.lower(name)
        script = F.when(F.regexp_like(name, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp_like(name, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")
        kind = F.when(i + 1 == F.size(names), "surname").otherwise("given")
        ended = F.when(script == "cyrillic", F.when(F.regexp_like(low, F.lit("[ая]$")), "f").otherwise("m")).when(script == "greek", F.when(F.regexp_like(low, F.lit("(?:[ηαωήάώ]|ου|ού)$")), "f").otherwise("m")).otherwise("n")
        gender = F.when((kind == "surname") & (script == "latin"), "n").when(told("m"), "m").when(told("f"), "f").otherwise(ended)
        return F.struct(kind.alias("kind"), F.concat_ws("|", gender, script, low).alias("norm"), low.alias("name"))

    return F.transform(names, part)


def _stream(key: str, kind: Column, norm: Column, attempt: int) -> Column:
    """Keyed hexadecimal digits, three for each character and some more."""
    blocks = F.sequence(F.lit(0), F.ceil(F.length(norm) * 3 / 64).cast("int") + 1)
    return F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, F.lit(str(attempt)), i.cast("string")), 256)), "")


def _draw(stream: Column, at: Column) -> Column:
    return F.conv(F.substr(stream, at * 3 + 1, F.lit(3)), 16, 10).cast("int")


def _scrambled(norm: Column, stream: Column) -> Column:
    """Each letter becomes a letter of its case and each digit a digit; hexadecimal words stay hexadecimal."""
    hexed = F.regexp_like(norm, F.lit(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$"))

    def one(c: Column, i: Column) -> Column:
        n = _draw(stream, i)
        letters = F.when(hexed, 6).otherwise(26)
        return F.when(c.between("0", "9"), (n % 10).cast("string")).when(c.between("a", "z"), F.char(n % letters + 97)).when(c.between("A", "Z"), F.char(n % letters + 65)).otherwise(c)

    return F.array_join(F.transform(_characters(norm), one), "")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _name(kind: Column, norm: Column, stream: Column, attempt: int) -> Column:
    """A name of the gender and script that ``norm`` begins with: a common given name first, then made-up ones, longer by a syllable each time."""
    gender, script = F.substring_index(norm, "|", 1), F.substring_index(F.substring_index(norm, "|", 2), "|", -1)
    out = F.lit(None).cast("string")
    for (g, s), given in GIVEN.items():
        made = lambda n: F.concat(*[_pick(SYLLABLES[s], _draw(stream, F.lit(i))) for i in range(1, n + 1)])  # noqa: B023, E731
        surname = F.initcap(F.concat(made(5 + attempt), F.lit(SURNAME_ENDINGS.get((g, s), ""))))
        first = _pick(given, _draw(stream, F.lit(0))) if not attempt else F.initcap(F.concat(made(2 + attempt), F.lit(GIVEN_ENDINGS[g, s])))
        out = F.when((gender == g) & (script == s), F.when(kind == "given", first).otherwise(surname)).otherwise(out)
    return out


def surrogate_of(key: str, kind: Column, norm: Column, stream: Column, attempt: int) -> Column:
    """A replacement in the entity's own type: Luhn and check digits hold, octets are octets, a top-level domain stays.

    From the fourth attempt on an address gets more letters in front, one more each time.
    """
    scrambled = _scrambled(norm, stream)
    first = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(scrambled, F.lit(2)))
    card = F.concat(F.substr(first, F.lit(1), F.length(first) - 1), F.lit("0"))
    card = F.concat(F.substr(card, F.lit(1), F.length(card) - 1), ((10 - luhn(card) % 10) % 10).cast("string"))
    blank = F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.lit("00"), F.substr(scrambled, F.lit(5)))
    iban = F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(blank)).cast("string"), 2, "0"), F.substr(scrambled, F.lit(5)))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(stream, i) % 254 + 1).cast("string")), ".")
    more = [F.char(F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(f"{key}{i}"), norm)), 1, 4), 16, 10).cast("int") % 26 + 97) for i in range(attempt - 2)]
    email = F.concat(*more, F.substr(scrambled, F.lit(1), F.length(norm) - F.length(F.substring_index(norm, ".", -1))), F.substring_index(norm, ".", -1))
    return F.when(kind == "email", email).when(kind.isin("given", "surname"), _name(kind, norm, stream, attempt)).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", first).when(kind == "access_key", F.concat(F.substr(norm, F.lit(1), F.lit(4)), F.substr(scrambled, F.lit(5)))).otherwise(scrambled)


def _rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the format of this mention: its separators and its case."""

    def step(done: Column, c: Column) -> Column:
        n = done["n"]
        return F.when(F.regexp_like(c, F.lit("[0-9A-Z]")), F.struct(F.concat(done["out"], F.substr(surrogate, n + 1, F.lit(1))).alias("out"), (n + 1).alias("n"))).otherwise(F.struct(F.concat(done["out"], c).alias("out"), n.alias("n")))

    spread = F.aggregate(_characters(mention), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, lambda done: done["out"])
    cased = F.array_join(F.transform(_characters(surrogate), lambda c, i: F.when(F.regexp_like(F.substr(mention, i + 1, F.lit(1)), F.lit("[A-Z]")), F.upper(c)).otherwise(c)), "")
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spread).when(kind == "email", cased).otherwise(surrogate)


def distinct_surrogates(entities: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """(kind, norm, surrogate) of distinct (kind, norm): no two entities of a type share one, and none is an entity.

    Of those that draw one surrogate the least norm has it; the others and those that drew what is in use try again.
    Only these are looked at again, so later rounds are small. Names and addresses have more room in each round.
    Raises if some still have none after ``attempts`` rounds, which takes more entities of a form than half of what
    it can spell.
    """
    open_ = cut(entities.select("kind", "norm").distinct())
    taken, settled = open_.select("kind", F.col("norm").alias("surrogate")), []
    # Names are spelled with their gender and script before them, and taken as the name alone.
    taken = taken.withColumn("surrogate", F.when(F.col("kind").isin("given", "surname"), F.substring_index("surrogate", "|", -1)).otherwise(F.col("surrogate")))
    for attempt in range(attempts):
        drawn = open_.withColumn("stream", _stream(key, F.col("kind"), F.col("norm"), attempt)).select("kind", "norm", surrogate_of(key, F.col("kind"), F.col("norm"), F.col("stream"), attempt).alias("drawn"))
        spelled = F.when(F.col("kind").isin("given", "surname"), F.lower("drawn")).otherwise(F.col("drawn"))
        least = drawn.groupBy("kind", spelled.alias("surrogate")).agg(F.min(F.struct("norm", "drawn")).alias("first"))
        good = cut(least.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "surrogate", "first.norm", "first.drawn"))
        settled.append(good.select("kind", "norm", F.col("drawn").alias("surrogate")))
        taken = taken.unionByName(good.select("kind", "surrogate"))
        open_ = cut(open_.join(good, ["kind", "norm"], "left_anti"))
        if open_.isEmpty():
            out = settled[0]
            for more in settled[1:]:
                out = out.unionByName(more)
            return out
    raise ValueError("no surrogates are left for " + ", ".join(sorted(r["kind"] for r in open_.select("kind").distinct().collect())))


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """Texts with surrogates in place of e-mail addresses, secrets, access keys, IBANs, phone numbers, IP addresses, social
    security numbers, payment cards and names of persons.

    ``docs`` has doc_id and text; nothing else is read. ``key`` decides all surrogates: the same entity has the
    same one in all documents and runs, whatever its format. Numbers that are no valid cards, and dotted ones that
    are no addresses, stay. A name is found by a title before it; in the text that introduces it so, each of its parts
    is then replaced wherever it stands as a capitalised word, alone or in a full name, with or without a title.
    Initials and titles stay. A part that one text has as given name and as surname counts as given name. Returns a row
    for each input row: doc_id, text, n_entities (mentions replaced; a run of capitalised words is one).

    A null text stays null with 0 entities, an empty one empty. Texts of any length are replaced whole, in time that
    follows their length: local parts of more than 64 characters and hosts of more than 127 labels are no addresses,
    but the end of such a one may be. Rows that share an id, also a null one, are replaced each in its own text, and
    equal texts alike. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hinted = reduce(or_, [F.col("text").contains(t) for t in HINTS], F.regexp_like("text", F.lit(HINT)))
    found = rows.filter(hinted).select(F.md5("text").alias("own"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))).alias("mention"))
    # What a text is replaced by depends on the text alone, so copies meet here, however many they are.
    found = cut(found.distinct().withColumn("kind", kind_of(F.col("mention"))).filter(F.col("kind").isNotNull()))
    numbers = found.filter("kind <> 'person'").select("own", "mention", "kind", norm_of(F.col("kind"), F.col("mention")).alias("norm"))
    names = found.filter("kind = 'person'").select("own", F.explode(name_parts(F.col("mention"))).alias("p"))
    # One role for each name of a text; "given" comes before "surname".
    names = names.groupBy("own", F.concat(F.lit("|"), "p.name").alias("mention")).agg(F.min(F.struct("p.kind", "p.norm")).alias("p")).select("own", "mention", "p.kind", "p.norm")
    mentions = cut(numbers.unionByName(names))
    table = distinct_surrogates(mentions, key)
    known = mentions.join(table, ["kind", "norm"]).select("own", "mention", _rendered(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("rendered"))
    # A text's own mentions, so as long as the text at most. Cut off, so that the join is one of two plain shuffles and a text that is everywhere is split.
    known = cut(known.groupBy("own").agg(F.map_from_entries(F.collect_list(F.struct("mention", "rendered"))).alias("known"), F.max(F.col("mention").startswith("|")).alias("named")))
    joined = rows.withColumn("own", F.md5("text")).join(known, "own", "left")

    def pieces(pattern: str) -> Column:
        """What stands between matches, and matches, in turn."""
        marked = F.split(F.regexp_replace("text", F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
        matches = F.concat(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.array(F.lit("")))
        apart = F.flatten(F.zip_with(F.split("text", pattern, -1), matches, lambda p, m: F.array(p, m)))
        return F.when(F.contains(F.col("text"), F.lit(MARK)), apart).otherwise(marked)

    def word(w: Column) -> Column:
        new = F.element_at("known", F.concat(F.lit("|"), F.lower(w)))
        return F.coalesce(F.when((F.length(w) > 1) & (F.upper(w) == w), F.upper(new)).otherwise(new), w)

    def replaced(p: Column) -> Column:
        return F.coalesce(F.element_at("known", p), F.when(F.col("named"), F.array_join(F.transform(F.split(p, " "), word), " ")), p)

    cut_up = joined.select("doc_id", "text", F.when(F.col("known").isNotNull(), F.transform(F.when(F.col("named"), pieces(NAMED)).otherwise(pieces(NUMBERS)), lambda p, i: F.when(i % 2 == 0, F.struct(p.alias("old"), p.alias("new"))).otherwise(F.struct(p.alias("old"), replaced(p).alias("new"))))).alias("pieces"))
    return cut_up.select(
        "doc_id",
        F.when(F.col("pieces").isNull(), F.col("text")).otherwise(F.array_join(F.transform("pieces", lambda p: p["new"]), "")).alias("text"),
        F.coalesce(F.size(F.filter("pieces", lambda p: p["old"] != p["new"])), F.lit(0)).cast("long").alias("n_entities"),
    )
