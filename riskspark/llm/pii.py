"""PII surrogates: keyed, type-consistent replacements (DataFrame functions only).

Entities are found by one regular expression. Equal entities (e-mail addresses in
lower case, numbers by their digits, +1 numbers without the country code) get the
same surrogate everywhere, different ones different surrogates. A surrogate keeps
the occurrence's format: digits stay digits, letters stay letters of their script
and case, separators, top-level domain and country code stay; valid card numbers
stay valid, IP addresses stay addresses, birth dates stay dates.

Person names are found behind titles or introducing words and from well-known given
names before a capitalised word. Their parts are the entities: "Mr John Smith",
"Mr Smith" and "Smith" share the surrogate of the family name. Wherever a part
recurs with a capital letter in the same text it is replaced too. Gender comes from
the title, else from the given name, else from another occurrence in the text (then
a neutral name is drawn); a bare part that is family name and given name in one text
counts as family name. Single initials stay.

Surrogates are drawn by a keyed hash of (type, entity, attempt). The collision
check looks at all distinct entities of the corpus: a draw that equals another
surrogate or a real entity of its type is repeated with the next attempt; name parts
of all kinds share one space. Coined names and streets grow by a syllable with every
attempt and numbers take a longer form from ``LONG_ATTEMPT`` on, so none can run out.
Birth dates move by one keyed number of days, which keeps them apart by itself.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import stage

LONG_ATTEMPT = 20
MAX_ATTEMPTS = 40

# Words that introduce a name, by gender, and well-known given names (those that are common words left out).
_FEMALE = "Mrs|Ms|Miss|Madam|Lady|Dame|Frau|Señora|Sra|Madame|Mme|Mademoiselle|Signora|Госпожа|Κυρία"
_MALE = "Mr|Sir|Lord|Herr|Señor|Sr|Monsieur|Signor|Господин|Κύριος"
_NEUTRAL = "Dr|Doctor|Prof|Professor|Rev|Доктор|Профессор|Δρ"
_TITLE = rf"(?:{_FEMALE}|{_MALE}|{_NEUTRAL})\.?[ \t]"
_INTRO = r"(?:(?i:my name is|i am called|full name|name|attn|signed by)[ \t]{0,2}:?[ \t])"
_KNOWN = {
    "f": ("Alice", "Amanda", "Andrea", "Angela", "Anna", "Barbara", "Caroline", "Catherine", "Christine", "Claudia", "Deborah", "Diana",
          "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Hannah", "Helen", "Jane", "Jennifer", "Jessica", "Julia", "Karen", "Katherine",
          "Laura", "Linda", "Lisa", "Margaret", "Maria", "Marie", "Martha", "Mary", "Michelle", "Monica", "Nancy", "Natalie", "Nicole",
          "Olivia", "Patricia", "Rachel", "Rebecca", "Ruth", "Sandra", "Sarah", "Sofia", "Stephanie", "Susan", "Teresa", "Ursula"),
    "m": ("Adam", "Albert", "Alexander", "Andrew", "Anthony", "Benjamin", "Brian", "Carlos", "Charles", "Christopher", "Daniel", "David",
          "Dennis", "Donald", "Edward", "Eric", "George", "Gregory", "Hans", "Henry", "James", "Jason", "Jeffrey", "John", "Jonathan",
          "Jose", "Joseph", "Joshua", "Juan", "Kenneth", "Kevin", "Klaus", "Luis", "Martin", "Matthew", "Michael", "Nicholas", "Patrick",
          "Paul", "Peter", "Philip", "Pierre", "Richard", "Robert", "Ronald", "Stephen", "Steven", "Thomas", "Timothy", "William"),
}
_SECRET = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?"
_NAME = r"\p{Lu}(?:(?!['’]s(?!\p{L}))['’-]?\p{L}){1,40}"
_LEAD = rf"(?:{_TITLE}){{1,3}}(?:\p{{Lu}}\.[ ]?){{0,3}}"
_PERSON = rf"(?:{'|'.join(_KNOWN['f'] + _KNOWN['m'])})(?: \p{{Lu}}\.)?(?: {_NAME}){{1,2}}"
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_BORN = r"(?i:born(?: on)?|date of birth|birth ?date|birthday|dob)[ \t]{0,2}:?[ \t]"
_DATES = {"yyyy-MM-dd": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "dd/MM/yyyy": "[0-9]{2}/[0-9]{2}/[0-9]{4}", "dd.MM.yyyy": r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}",
          "d MMMM yyyy": rf"[0-9]{{1,2}} {_MONTH} [0-9]{{4}}", "MMMM d, yyyy": rf"{_MONTH} [0-9]{{1,2}}, [0-9]{{4}}"}
_DOCUMENT = r"(?i:passport|driving licence|driver'?s licen[cs]e|identity card|id card|national id)(?:[ \t](?i:no|nr|number))?\.?[ \t]{0,2}[:#]?[ \t]"
_ROAD = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace"
_START = r"(?<![\p{L}\p{N}])"
# Patterns in Java syntax, without capturing groups; the leftmost match wins, then the first pattern.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}][\p{L}\p{N}-]*+(?:\.[\p{L}\p{N}-]++){1,8}",
    "name": rf"{_START}(?:{_LEAD}{_NAME}(?: {_NAME}){{0,2}}|{_INTRO}{_NAME}(?: {_NAME}){{1,2}}|(?=\p{{Lu}}){_PERSON})",
    "birth": rf"{_START}{_BORN}(?:{'|'.join(_DATES.values())})(?!\p{{N}})",
    "document": rf"{_START}{_DOCUMENT}[A-Z]{{0,3}}[0-9]{{6,9}}[A-Z]?(?![\p{{L}}\p{{N}}])",
    "address": rf"{_START}[0-9]{{1,5}} (?:\p{{Lu}}\p{{Ll}}{{1,30}} ){{1,3}}(?:{_ROAD})(?![\p{{L}}\p{{N}}])",
    "secret": rf"(?<![\p{{L}}\p{{N}}])(?i:{_SECRET})[A-Za-z0-9_+/=.-]{{5,200}}[A-Za-z0-9_+/=-]",
    "aws_key": r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "hex": r"(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "ipv6": (r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})"
             r"(?![0-9A-Za-z:])"),
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": (r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
              r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())

# Alphabets inside which a character is replaced.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
              "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
              "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
              "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_HEX = ("0123456789abcdef",)
# First draws of given names by script and gender; later draws, family names and streets are spelt from syllables.
_GIVEN = {
    ("latin", "f"): ("Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Vera"),
    ("latin", "m"): ("Adam", "Bruno", "David", "Felix", "Hugo", "Jonas", "Martin", "Oscar", "Simon", "Victor"),
    ("latin", "u"): ("Alexis", "Kim", "Luca", "Noa", "Robin", "Sasha"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Фёдор"),
    ("cyrillic", "u"): ("Женя", "Саша", "Шура"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
    ("greek", "m"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
    ("greek", "u"): ("Αλέξης", "Χάρις"),
}
_ENDINGS = {"latin": {"f": "a", "m": "o", "u": "is"}, "cyrillic": {"f": "а", "m": "ий", "u": "о"}, "greek": {"f": "α", "m": "ος", "u": "ι"}}
_SYLLABLES = {
    "latin": ("ba", "den", "fel", "gor", "hal", "kim", "lan", "mer", "nor", "pel", "ros", "sten", "tal", "vin", "wes", "zel"),
    "cyrillic": ("бе", "вол", "гор", "дан", "зим", "кор", "лес", "мар", "нов", "пет", "рад", "сол", "тим", "хол", "чер", "яр"),
    "greek": ("βα", "γερ", "δημ", "ζαν", "θεο", "καλ", "λιν", "μαρ", "νικ", "παπ", "ραφ", "σαμ", "τζα", "φιλ", "χρη", "ψαρ"),
}


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _name_parts(entity: Column) -> Column:
    """Array of struct(type, prefix, core, canonical) of the parts of a name; empty for other entities."""
    lead = F.regexp_extract(entity, f"^({_LEAD}|{_INTRO})", 1)
    title = F.regexp_extract(entity, f"^({_LEAD})", 1)
    gender = (F.when(title.rlike(rf"(?:^|[ \t])(?:{_FEMALE})\.?[ \t]"), "f").when(title.rlike(rf"(?:^|[ \t])(?:{_MALE})\.?[ \t]"), "m"))
    known = {g: [n.lower() for n in names] for g, names in _KNOWN.items()}

    def parts(p: Column) -> Column:
        words = F.split(F.substring(entity, F.length(p) + 1, F.length(entity)), " ")

        def part(word: Column, i: Column) -> Column:
            low = F.lower(word)
            own = F.coalesce(F.when(low.isin(known["f"]), "f"), F.when(low.isin(known["m"]), "m"))
            given = ((i == 0) & (F.size(words) > 1)) | own.isNotNull()
            kind = (F.when(word.rlike(r"^\p{Lu}\.$"), "initial")
                    .when(given, F.concat(F.lit("given_"), F.coalesce(F.when(i == 0, gender), own, gender, F.lit("u")))).otherwise("family"))
            return F.struct(kind.alias("type"), F.when(i == 0, p).otherwise(" ").alias("prefix"), word.alias("core"), low.alias("canonical"))

        return F.transform(words, part)

    none = F.array().cast("array<struct<type:string,prefix:string,core:string,canonical:string>>")
    return F.when((lead != "") | entity.rlike(f"^{_PERSON}$"), _let(lead, parts)).otherwise(none)


def _known_parts(found: Column) -> Column:
    """Distinct (canonical, type) of the name parts of all entities of a text, gendered given names before neutral ones."""
    parts = F.filter(F.flatten(F.transform(found, _name_parts)), lambda x: x["type"] != "initial")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: F.struct(x["canonical"].alias("canonical"), x["type"].alias("type")))))


def _pattern(names: Column) -> Column:
    """Entities, and the name parts of the text wherever they start with a capital letter."""
    bare = F.concat(F.lit(rf"{ENTITY}|{_START}(?=\p{{Lu}})(?iu:"), names, F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.coalesce(names, F.lit("")) == "", F.lit(ENTITY)).otherwise(bare)


def entity_parts(entity: Column, known: Column) -> Column:
    """Array of struct(type, prefix, core, canonical) of a matched entity: the parts of a name, else one.

    ``prefix`` introduces the part and stays. A secret that is a key or a hash
    by its shape has that type, so both spellings get one surrogate. ``known``: the
    name parts of the text (``_known_parts``), which decide what a bare part is.
    """
    whole = F.lit(None).cast("string")
    for name in ("email", "address", "aws_key", "hex", "iban", "ip", "ipv6", "card", "ssn", "phone"):
        whole = F.coalesce(whole, F.when(entity.rlike(f"^(?:{PATTERNS[name]})$"), name))
    born = F.regexp_extract(entity, f"^({_BORN})", 1)
    document = F.regexp_extract(entity, f"^({_DOCUMENT})", 1)
    secret = F.regexp_extract(entity, f"^((?i:{_SECRET}))", 1)
    country = F.when(F.length(F.regexp_replace(entity, "[^0-9]", "")) == 11, F.regexp_extract(entity, r"^(\+1[ .-]?)", 1)).otherwise("")
    prefix = (F.when(whole == "phone", country).when(whole.isNotNull(), "").when(born != "", born).when(document != "", document).otherwise(secret))
    bare = F.get(F.filter(known, lambda x: x["canonical"] == F.lower(entity)), F.lit(0))["type"]

    def single(p: Column) -> Column:
        core = F.substring(entity, F.length(p) + 1, F.length(entity))
        kind = (F.when(whole.isNotNull(), whole).when(born != "", "birth").when(document != "", "document").when((secret == "") & bare.isNotNull(), bare)
                .when(core.rlike(f"^(?:{PATTERNS['aws_key']})$"), "aws_key")
                .when(core.rlike(f"^(?:{PATTERNS['hex']})$"), "hex").otherwise("secret"))
        date = F.coalesce(*[F.when(core.rlike(f"^{regex}$"), F.date_format(F.try_to_timestamp(core, F.lit(form)), "yyyy-MM-dd"))
                            for form, regex in _DATES.items()])
        canonical = (F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(core, "[^0-9]", "")).when(kind == "birth", F.coalesce(date, core))
                     .when(kind.isin("email", "address", "ipv6") | _is_name(kind), F.lower(core)).otherwise(core))
        return F.array(F.struct(kind.alias("type"), p.alias("prefix"), core.alias("core"), canonical.alias("canonical")))

    def gendered(x: Column) -> Column:
        seen = F.get(F.filter(known, lambda k: (k["canonical"] == x["canonical"]) & k["type"].startswith("given_")), F.lit(0))["type"]
        return F.struct(F.when(x["type"] == "given_u", F.coalesce(seen, x["type"])).otherwise(x["type"]).alias("type"), x["prefix"].alias("prefix"),
                        x["core"].alias("core"), x["canonical"].alias("canonical"))

    return _let(_name_parts(entity), lambda parts: F.when(F.size(parts) > 0, F.transform(parts, gendered)).otherwise(_let(prefix, single)))


def _is_name(kind: Column) -> Column:
    return kind.startswith("given_") | (kind == "family")


def _number(stream: Column, i: Column | int) -> Column:
    """The i-th (from 1) 16-bit number of a stream of hex digits."""
    at = (F.lit(i) if isinstance(i, int) else i) * 4 - 3
    return F.conv(F.substring(stream, at, F.lit(4)), 16, 10).cast("int")


def _redraw(text: Column, stream: Column, alphabets: tuple[str, ...] = _ALPHABETS) -> Column:
    """Every character replaced inside its alphabet; others stay."""
    choices = F.array(*map(F.lit, alphabets))

    def char(i: Column) -> Column:
        old = F.substring(text, i, F.lit(1))
        alphabet = F.get(F.filter(choices, lambda x: F.instr(x, old) > 0), F.lit(0))
        return F.coalesce(F.substring(alphabet, _number(stream, i) % F.length(alphabet) + 1, F.lit(1)), old)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), char), "")).otherwise("")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number without its check digit (the last digit here counts double)."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _coined(script: str, stream: Column, first: Column, count: Column) -> Column:
    """``count`` syllables of a script, drawn from the ``first``-th number of the stream on."""
    syllables = F.array(*map(F.lit, _SYLLABLES[script]))
    return F.array_join(F.transform(F.sequence(first, first + count - 1), lambda i: F.element_at(syllables, _number(stream, i) % 16 + 1)), "")


def _name(kind: Column, canonical: Column, stream: Column, attempt: Column) -> Column:
    """Listed given names first, then coined ones with an ending of the gender; family names are coined."""
    def in_script(script: str) -> Column:
        out = _coined(script, stream, F.lit(1), attempt + 4)
        for gender, ending in _ENDINGS[script].items():
            given = _GIVEN[script, gender]
            listed = F.element_at(F.array(*map(F.lit, given)), _number(stream, 1) % len(given) + 1)
            drawn = F.when(attempt < 2, listed).otherwise(F.concat(_coined(script, stream, F.lit(1), attempt), F.lit(ending)))
            out = F.when(kind == f"given_{gender}", drawn).otherwise(out)
        return F.lower(out)

    return (F.when(canonical.rlike(r"\p{IsCyrillic}"), in_script("cyrillic")).when(canonical.rlike(r"\p{IsGreek}"), in_script("greek"))
            .otherwise(in_script("latin")))


def _street(canonical: Column, stream: Column, attempt: Column) -> Column:
    """House number redrawn, street words coined, kind of road kept."""
    words = F.split(canonical, " ")
    first = F.concat(F.regexp_replace(_redraw(words[0], stream), "^0", "1"), F.lit(" "), _coined("latin", stream, F.lit(6), attempt + 3))
    more = F.transform(F.slice(words, F.lit(3), F.size(words) - 3), lambda w, i: F.concat(F.lit(" "), _coined("latin", stream, attempt + 9 + 2 * i, F.lit(2))))
    return F.concat(first, F.array_join(more, ""), F.lit(" "), F.element_at(words, -1))


def surrogate(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The ``attempt``-th draw for an entity, in canonical form."""
    def block(b: Column) -> Column:
        return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canonical, attempt.cast("string"), b.cast("string")), 256)

    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(F.length(canonical), attempt + 16) / 16).cast("int")), block), "")

    def draw(s: Column) -> Column:
        n = F.length(canonical)
        tail = F.regexp_extract(canonical, r"(\.[^.@]*)$", 1)
        body = F.substring(canonical, F.lit(1), n - F.length(tail))
        card = F.concat(F.substring(canonical, 1, 1), _redraw(F.substring(canonical, F.lit(2), n - 2), s))
        valid = (_luhn_sum(F.substring(canonical, F.lit(1), n - 1)) + F.substring(canonical, n, F.lit(1)).cast("int")) % 10 == 0
        check = F.when(valid, ((10 - _luhn_sum(card) % 10) % 10).cast("string")).otherwise(_redraw(F.substring(canonical, n, F.lit(1)), s))
        keep = F.greatest(n - 10, F.lit(0))                       # country code
        octets = F.concat_ws(".", *[(_number(s, i) % 254 + 1).cast("string") for i in range(1, 5)])
        common = (F.when(kind == "email", F.concat(_redraw(body, s), tail))
                  .when(_is_name(kind), _name(kind, canonical, s, attempt))
                  .when(kind == "address", _street(canonical, s, attempt))
                  .when(kind == "ip", octets)
                  .when(kind == "ipv6", _redraw(canonical, s, _HEX))
                  .when(kind == "card", F.concat(card, check))
                  .when(kind == "phone", F.concat(F.substring(canonical, F.lit(1), keep), _redraw(F.substring(canonical, keep + 1, n), s)))
                  .when(kind == "aws_key", F.concat(F.substring(canonical, 1, 4), _redraw(F.substring(canonical, F.lit(5), n), s)))
                  .when(kind == "iban", F.concat(F.substring(canonical, 1, 2), _redraw(F.substring(canonical, F.lit(3), n), s)))
                  .when(canonical.rlike("^[0-9a-f]+$") & (kind != "ssn"), _redraw(canonical, s, _HEX))
                  .otherwise(_redraw(canonical, s)))
        longer = F.concat(F.when(kind.isin("card", "ssn", "phone", "ip"), F.regexp_replace(F.conv(F.substring(s, 1, 12), 16, 10), "^", "9"))
                          .otherwise(F.substring(s, 1, 24)), F.when(kind == "email", F.concat(F.lit("@x"), tail)).otherwise(""))
        return F.when((attempt < LONG_ATTEMPT) | _is_name(kind) | (kind == "address"), common).otherwise(longer)

    return _let(stream, draw)


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(type, canonical, surrogate) for all distinct entities: one-to-one, and apart from all real ones.

    Rounds go on until no draw collides; of colliding entities the smallest keeps
    its draw. All tables stay distributed.
    """
    space = F.when(_is_name(F.col("type")), "name").otherwise(F.col("type")).alias("space")
    real = stage(entities.select("type", "canonical").filter(F.col("type") != "initial").distinct(), "pii_entities")
    born, real = real.filter(F.col("type") == "birth"), real.filter(F.col("type") != "birth")
    shift = F.conv(F.substring(F.sha2(F.lit(f"{key}\u0001birth"), 256), 1, 6), 16, 10).cast("int") % 3000 + 30
    day = F.try_to_timestamp("canonical", F.lit("yyyy-MM-dd")).cast("date")
    moved = F.coalesce(F.date_format(F.date_sub(day, shift), "yyyy-MM-dd"), _redraw(F.col("canonical"), F.sha2(F.concat_ws("\u0001", F.lit(key), "canonical"), 256)))
    taken = born.select("type", "canonical", moved.alias("surrogate"))
    used = real.select(space, F.col("canonical").alias("surrogate")).distinct()
    pending, done = real.withColumn("attempt", F.lit(0)), [taken]
    draw = surrogate(F.col("type"), F.col("canonical"), F.col("attempt"), key)
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))    # draws cost far more than their rows weigh
    for _ in range(MAX_ATTEMPTS):
        drawn = stage(pending.repartition(parts, "type", "canonical").withColumn("surrogate", draw), "pii_draws")
        winners = drawn.groupBy(space, "surrogate").agg(F.min(F.struct("canonical", "type")).alias("w"))
        free = winners.join(used, ["space", "surrogate"], "left_anti").select("space", "surrogate", "w.*")
        free = free.join(taken.select(space, "surrogate"), ["space", "surrogate"], "left_anti")
        free = stage(free.select("type", "canonical", "surrogate"), "pii_surrogates")
        done.append(free)
        taken = functools.reduce(DataFrame.unionByName, done)
        left = drawn.join(free, ["type", "canonical"], "left_anti")
        if left.isEmpty():
            return taken
        pending = left.select("type", "canonical", (F.col("attempt") + 1).alias("attempt"))
    raise RuntimeError("surrogates still collide after all attempts")


def dress(kind: Column, prefix: Column, core: Column, canonical: Column, new: Column) -> Column:
    """The surrogate in the occurrence's format."""
    def digits(i: Column) -> Column:
        old = F.substring(core, i, F.lit(1))
        rank = F.length(F.regexp_replace(F.substring(core, F.lit(1), i), "[^0-9]", ""))
        return F.when(old.rlike("[0-9]"), F.substring(new, rank, F.lit(1))).otherwise(old)

    def cased(i: Column) -> Column:
        letter = F.substring(new, i, F.lit(1))
        old = F.substring(core, i, F.lit(1))
        return F.when(old != F.lower(old), F.upper(letter)).otherwise(letter)

    span = F.sequence(F.lit(1), F.greatest(F.length(core), F.lit(1)))
    same = F.length(new) == F.length(canonical)
    date = F.lit(None).cast("string")
    for form, regex in _DATES.items():
        date = F.coalesce(date, F.when(core.rlike(f"^{regex}$"), F.date_format(F.try_to_timestamp(new, F.lit("yyyy-MM-dd")), form)))
    out = (F.when(kind.isin("card", "ssn", "phone") & same, F.array_join(F.transform(span, digits), ""))
           .when(kind.isin("email", "ipv6") & same & (F.length(core) == F.length(canonical)), F.array_join(F.transform(span, cased), ""))
           .when(_is_name(kind), F.when(core == F.upper(core), F.upper(new)).otherwise(F.initcap(new)))
           .when(kind == "address", F.initcap(new)).when(kind == "birth", F.coalesce(date, new))
           .otherwise(new))
    return F.concat(prefix, out)


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced, plus ``n_entities`` (int).

    All other columns are returned as they are (one called n_entities is replaced). A name counts
    once, a recurring part of it once per place. NULL texts stay NULL, empty ones
    empty (0 entities); very long texts are searched whole; rows that share id and text get the same result; NULL ids
    are allowed; an empty table stays empty. The search is one pass over each text (two
    where names were found); only texts with entities are rebuilt.
    """
    text = F.col(f"`{text_col}`")
    base = docs.withColumns({"_pii_id": F.col(f"`{id_col}`"), "_pii_hash": F.xxhash64(text)})

    def spans(found: Column, known: Column, names: Column) -> Column:
        all_found = F.when(names == "", found).otherwise(F.regexp_extract_all(text, _pattern(names), F.lit(0)))
        return F.transform(all_found, lambda e, i: F.struct(entity_parts(e, known).alias("parts"), F.when(i == 0, names).alias("names")))

    def search(found: Column) -> Column:
        return _let(_known_parts(found), lambda known: _let(
            F.array_join(F.array_distinct(F.transform(known, lambda k: k["canonical"])), "|"), lambda names: spans(found, known, names)))

    spots = base.select("_pii_id", "_pii_hash", F.posexplode(_let(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), search)).alias("pos", "span"))
    spots = (spots.select("_pii_id", "_pii_hash", "pos", "span.names", F.posexplode("span.parts").alias("sub", "p"))
             .select("_pii_id", "_pii_hash", "pos", "sub", F.when(F.col("sub") == 0, F.col("names")).alias("names"), "p.*"))
    spots = stage(spots, "pii_spots")
    table = surrogate_table(spots, key)
    initial = F.concat("prefix", "core")
    new = spots.join(table, ["type", "canonical"], "left").select(
        "_pii_id", "_pii_hash", "pos", "sub", "names", F.when(F.col("type") == "initial", initial).otherwise(
            dress(F.col("type"), F.col("prefix"), F.col("core"), F.col("canonical"), F.col("surrogate"))).alias("new"))
    per_span = (new.groupBy("_pii_id", "_pii_hash", "pos", "sub").agg(F.min("new").alias("new"), F.max("names").alias("names"))
                .groupBy("_pii_id", "_pii_hash", "pos").agg(F.sort_array(F.collect_list(F.struct("sub", "new"))).alias("parts"), F.max("names").alias("names")))
    span = F.struct("pos", F.array_join(F.transform("parts", lambda x: x["new"]), "").alias("new"))
    per_text = per_span.groupBy("_pii_id", "_pii_hash").agg(F.sort_array(F.collect_list(span)).alias("_pii_new"), F.max("names").alias("_pii_names"))
    per_text = per_text.select(F.col("_pii_id").alias("_pii_id2"), F.col("_pii_hash").alias("_pii_hash2"), "_pii_new", "_pii_names")
    joined = base.join(per_text, F.col("_pii_id").eqNullSafe(F.col("_pii_id2")) & (F.col("_pii_hash") == F.col("_pii_hash2")), "left")
    gaps = F.split(text, _pattern(F.col("_pii_names")), -1)
    rebuilt = F.array_join(F.flatten(F.zip_with(gaps, F.col("_pii_new"), lambda g, r: F.array(g, F.coalesce(r["new"], F.lit(""))))), "")
    replaced = F.when(F.col("_pii_new").isNull(), text).otherwise(rebuilt)
    cols = [replaced.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_entities"]
    return joined.select(*cols, F.when(F.col("_pii_new").isNull(), 0).otherwise(F.size("_pii_new")).alias("n_entities"))
