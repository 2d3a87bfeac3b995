"""Surrogates for personal data, in DataFrame functions only.

Detected entities (e-mail addresses, phone numbers, card numbers, IBANs, social security
numbers, IP addresses, credentials and titled or known personal names) get keyed
replacements of the same type and format: digits for digits, letters of the same case and
script for letters, the same separators, a card number with the same Luhn remainder, an IBAN
with valid check digits, a given name of the same gender and script.

Coreference: a surrogate belongs to an entity's canonical form (digits only, lower case),
so an entity keeps one surrogate in all documents and notations, and a surname keeps its
surrogate with and without a given name. Distinctness: surrogates of all distinct entities
of the corpus are checked against each other and against the real entities; whoever loses a
collision draws again with the next attempt until none is left. Only the distinct entities
and the documents that hold any are ever shuffled.

Limits. Names are found after a title or a listed given name, and their surnames then also
bare, anywhere in the same text; a text that only has untitled names with other given names
keeps them. Addresses of 192.168.* that find no free one of their own (the range has 65,025)
get one of 10.*; a type whose space is more than half full of real entities (10.*: over
8 million) ends in an error after MOST_ATTEMPTS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._names import fresh
from ._scratch import Scratch

# Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adrian Albert Anton Arthur Benjamin Bruno Carl Daniel David Edward Emil Felix Frank George Henry Hugo Jacob James Jonas Leo Louis Martin Max Nathan Oliver Oscar Paul Peter Robert Samuel Simon Thomas Victor William".split(),
    ("latin", "f"): "Alice Amelia Anna Beatrice Carla Caroline Clara Diana Edith Elena Ella Emma Eva Flora Grace Helen Ida Irene Julia Laura Lena Lucy Maria Martha Mary Nina Nora Olivia Paula Rosa Ruth Sarah Sofia Susan Vera".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Игорь Максим Николай Олег Павел Сергей".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лариса Мария Наталья Ольга Софья Татьяна".split(),
}
# Titles and the gender they tell.
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "г-жа"],
    "": ["Dr", "Prof"],
}
# Syllables of made-up surnames.
SYLLABLES = {
    "latin": "bar bel cor dan del fen gar hal ker lan mar nor pel ran sel tan var wen yor zel".split(),
    "cyrillic": "бар вел гор дан кор лан мар нор пел ран сел тан".split(),
}
HEXADECIMAL = {"[0-9]": "0123456789", "[a-f]": "abcdef", "[A-F]": "ABCDEF"}
ALPHABET = {"[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[а-я]": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "[А-Я]": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"}

_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_KNOWN = "|".join(n for names in GIVEN.values() for n in names)
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "secret": r"""(?<=\b(?:token|password|passwd|secret|api_key|apikey)\s{0,2}[=:]\s{0,2}["']?)[^\s"'<>]{8,}|\bAKIA[0-9A-Z]{16}\b""",
    "email": r"[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.])(?:(?:\d{4}[ -]?){3}\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\w)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<!\w)(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "name": rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? {_NAME}(?: {_NAME})?|(?:{_KNOWN}) {_NAME})(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text needs to hold any entity but a name, and the words one of which a name needs: cheap to look for.
HINT = "[0-9@=:]|AKIA"
# Lookbehinds see half of a character beyond U+FFFF, which is no letter: such characters break words too.
_BREAKS = r"(?:\P{L}|[\x{10000}-\x{10FFFF}])+"
_HEADS = sorted({t.split("-")[0] for ts in TITLES.values() for t in ts} | {n for names in GIVEN.values() for n in names})
MOST_ATTEMPTS = 64


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def _byte(stream: Column, i: Column | int) -> Column:
    """The i-th byte, from 0, of a hexadecimal stream of 64 bytes, over again beyond it."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _stream(key: str, what: Column, attempt: int) -> Column:
    """64 keyed bytes: the key is hashed in before and after the message."""
    inner = F.sha2(F.concat(F.lit(f"{key}|{attempt}|"), what), 256)
    return F.concat(F.sha2(F.concat(F.lit(f"{key}|0|"), inner), 256), F.sha2(F.concat(F.lit(f"{key}|1|"), inner), 256))


def _alike(s: Column, stream: Column, first: int = 0, alphabet: dict[str, str] = ALPHABET) -> Column:
    """Each digit or letter from place ``first`` on replaced by one of its own kind."""

    def swap(i: Column) -> Column:
        c = F.substring(s, i + 1, F.lit(1))
        h = _byte(stream, i)
        out = F.when(i < first, c)
        for kind, letters in alphabet.items():
            out = out.when(c.rlike(kind), F.substring(F.lit(letters), h % len(letters) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(s) - 1), swap), "")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _luhn(digits: Column) -> Column:
    """Remainder of the Luhn sum, 0 for a valid number."""

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return _sum(F.transform(_chars(F.reverse(digits)), weigh)) % 10


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a string of digits and letters, letters counting 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v > 9, (r * 100 + v) % 97).otherwise((r * 10 + v) % 97).cast("int")

    return F.aggregate(_chars(text), F.lit(0), step)


def _picked(words: list[str], h: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), h % len(words) + 1)


def _surrogate(key: str, attempt: int) -> Column:
    """The canonical surrogate for columns type and canon."""
    kind, canon = F.col("type"), F.col("canon")
    stream = _stream(key, F.concat(kind, F.lit("|"), canon), attempt)
    card = F.concat(F.substring(canon, 1, 1), _alike(F.substring(canon, F.lit(2), F.length(canon) - 2), stream))
    # The last digit has weight 1 in the Luhn sum, so any remainder can be met.
    card = F.concat(card, F.pmod(_luhn(canon) - _luhn(F.concat(card, F.lit("0"))), F.lit(10)).cast("string"))
    land = F.substring(canon, 1, 2)
    bban = _alike(F.expr("substring(canon, 5)"), stream)
    iban = F.concat(land, F.lpad((98 - _mod97(F.concat(bban, land, F.lit("00")))).cast("string"), 2, "0"), bban)
    octets = [_byte(stream, 0) % 100 + 20, *[_byte(stream, i) % 254 + 1 for i in (1, 2, 3)]]
    ip = F.when(canon.startswith("10."), F.concat_ws(".", F.lit("10"), *[o.cast("string") for o in octets[1:]]))
    near = [F.lit("192.168"), *[o.cast("string") for o in octets[2:]]] if attempt < 8 else [F.lit("10"), *[o.cast("string") for o in octets[1:]]]
    ip = ip.when(canon.startswith("192.168."), F.concat_ws(".", *near))
    ip = ip.otherwise(F.concat_ws(".", *[o.cast("string") for o in octets]))
    # A domain's surrogate hangs on the domain alone; its last label stays.
    domain, local = F.substring_index(canon, "@", -1), F.substring_index(canon, "@", 1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.concat(_alike(local, stream), F.lit("@"), _alike(host, _stream(key, F.concat(F.lit("domain|"), domain), 0)), top)
    email = F.when(domain.rlike(r"\.example\.(?:com|net|org)$"), F.regexp_replace(email, r"[^.]+\.[^.]+$", F.substring_index(domain, ".", -2))).otherwise(email)
    code = F.regexp_extract(canon, r"^(\+(?:[17]|\d{2}))", 1)
    number = F.substring(canon, F.length(code) + 1, F.length(canon))
    phone = F.concat(code, (_byte(stream, 63) % 8 + 2).cast("string"), _alike(F.substring(number, F.lit(2), F.length(number)), stream))
    secret = F.when(canon.rlike("^AKIA"), _alike(canon, stream, 4)).when(canon.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _alike(canon, stream, 0, HEXADECIMAL)).otherwise(_alike(canon, stream))
    surname, given = {}, None
    for script, syllables in SYLLABLES.items():
        surname[script] = F.initcap(F.concat(*[_picked(syllables, _byte(stream, i)) for i in range(3 + attempt // 2)]))
    names = F.when(canon.rlike(r"\p{IsCyrillic}"), surname["cyrillic"]).otherwise(surname["latin"])
    gender, script = F.split(canon, r"\|")[0], F.split(canon, r"\|")[1]
    for (s, g), pool in GIVEN.items():
        # The pool is small: from the third attempt on, given names are made up, with a gendered ending.
        made = F.initcap(F.concat(*[_picked(SYLLABLES[s], _byte(stream, i)) for i in range(2 + attempt // 4)], F.lit({"latin": "a", "cyrillic": "а"}[s] if g == "f" else "")))
        value = _picked(pool, _byte(stream, 0)) if attempt < 3 else made
        test = (script == s) & (gender == g)
        given = F.when(test, value) if given is None else given.when(test, value)
    out = {"card": card, "iban": iban, "ip": ip, "email": email, "phone": phone, "secret": secret, "ssn": _alike(canon, stream), "surname": names, "given": F.concat(given, F.lit("|"), F.split(canon, r"\|")[3])}
    return reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]), out.items(), F.when(F.lit(False), F.lit("")))


def _type(mention: Column) -> Column:
    out = F.when(mention.contains("@"), F.when(mention.rlike(f"^(?:{PATTERNS['email']})$"), "email").otherwise("secret"))
    for kind in ("iban", "card", "ssn", "ip", "phone", "name"):
        out = out.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("secret")


def _canon(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(mention)).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "phone", F.concat(F.when(mention.startswith("+"), "+").otherwise("+1"), digits)).otherwise(mention)
    )


def _name_parts(mention: Column) -> dict[str, Column]:
    """title (with its space), given (may be empty), surname, gender and script of a name."""
    title = F.regexp_extract(mention, rf"^((?:{_TITLE})\.? )", 1)
    rest = F.substring(mention, F.length(title) + 1, F.length(mention))
    given = F.when(F.instr(rest, " ") > 0, F.substring_index(rest, " ", 1)).otherwise("")
    surname = F.substring_index(rest, " ", -1)
    said = F.regexp_extract(title, r"^([^. ]*)", 1)
    gender = F.when(said.isin(*TITLES["m"]), "m").when(said.isin(*TITLES["f"]), "f")
    for (_, g), names in GIVEN.items():
        gender = gender.when(given.isin(*names), g)
    gender = gender.otherwise(F.when(given.rlike("[aаяeé]$"), "f").otherwise("m"))
    script = F.when(rest.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return {"title": title, "given": given, "surname": surname, "gender": gender, "script": script}


def _parts(kind: Column, mention: Column) -> Column:
    """The entities of a mention: (type, canon); a name has its surname and perhaps a given name within it."""
    n = _name_parts(mention)
    pair = lambda k, c: F.struct(k.alias("type"), c.alias("canon"))
    surname = pair(F.lit("surname"), F.lower(n["surname"]))
    given = pair(F.lit("given"), F.concat_ws("|", n["gender"], n["script"], F.lower(n["given"]), F.lower(n["surname"])))
    return F.when(kind == "name", F.when(n["given"] == "", F.array(surname)).otherwise(F.array(surname, given))).otherwise(F.array(pair(kind, _canon(kind, mention))))


def _rendered(kind: Column, mention: Column, first: Column, second: Column) -> Column:
    """The mention's notation with the surrogates of its entities."""
    places = F.regexp_replace(first, r"[^0-9A-Z]", "")
    places = F.right(places, F.length(F.regexp_replace(mention, r"[^0-9A-Z]", "")))  # a phone number without its country code

    def swap(i: Column) -> Column:
        c = F.substring(mention, i, F.lit(1))
        before = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), r"[^0-9A-Z]", ""))
        return F.when(c.rlike("[0-9A-Z]"), F.substring(places, before, F.lit(1))).otherwise(c)

    formatted = F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), swap), "")
    n = _name_parts(mention)
    given = F.when(n["given"] == "", "").otherwise(F.concat(F.substring_index(second, "|", 1), F.lit(" ")))
    return (
        F.when(kind == "name", F.concat(n["title"], given, first))
        .when(kind == "email", F.when((F.upper(mention) == mention) & mention.rlike("[A-Z]"), F.upper(first)).otherwise(first))
        .when(kind.isin("card", "ssn", "iban", "phone"), formatted).otherwise(first)
    )


def _assigned(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(type, canon, surrogate): distinct within a type, and never an entity that the corpus itself holds."""
    real = entities.select("type", F.col("canon").alias("surrogate"))
    done, todo = None, entities
    tasks = entities.sparkSession.sparkContext.defaultParallelism * 4
    for attempt in range(MOST_ATTEMPTS):
        drawn = todo.repartition(tasks, "type", "canon").withColumn("surrogate", _surrogate(key, attempt))
        taken = real if done is None else real.unionByName(done.select("type", "surrogate"))
        first = drawn.groupBy("type", "surrogate").agg(F.min("canon").alias("winner"))
        judged = drawn.join(first, ["type", "surrogate"]).join(taken.distinct().withColumn("taken", F.lit(True)), ["type", "surrogate"], "left")
        judged = scratch.save(judged.withColumn("good", (F.col("canon") == F.col("winner")) & F.col("taken").isNull()), f"attempt-{attempt}")
        good = judged.filter("good").select("type", "canon", "surrogate")
        done = good if done is None else done.unionByName(good)
        todo = judged.filter("not good").select("type", "canon")
        if todo.isEmpty():
            return done
    raise RuntimeError(f"no distinct surrogates after {MOST_ATTEMPTS} attempts")


def _mentions(text: Column) -> Column:
    """All matches of ANY; texts without a hint, which hold none, and nulls have an empty array."""
    none = F.array().cast("array<string>")
    hinted = text.rlike(HINT) | F.arrays_overlap(F.split(text, _BREAKS), F.array(*map(F.lit, _HEADS)))
    return F.coalesce(F.when(hinted, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none), none)


def surrogate_key(spark: SparkSession) -> str:
    """The key of the surrogates: ``spark.linkloom.surrogates.key``; without it, one that is no secret, for trials."""
    return spark.conf.get("spark.linkloom.surrogates.key", "trial")


def _surnames(found: Column) -> Column:
    """The surnames of the names among a text's mentions."""
    names = F.filter(found, lambda m: m.rlike(f"^(?:{PATTERNS['name']})$"))
    return F.array_distinct(F.transform(names, lambda m: F.substring_index(m, " ", -1)))


def _pattern(surnames: Column) -> Column:
    """ANY, and the surnames as words of their own; names hold letters and hyphens only."""
    return F.when(F.size(surnames) == 0, F.lit(ANY)).otherwise(F.concat(F.lit(f"{ANY}|(?<!\\p{{L}})(?:"), F.array_join(surnames, "|"), F.lit(r")(?!\p{L})")))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", entities_col: str = "entities") -> DataFrame:
    """All rows and columns of ``docs``, with surrogates in the text and the replaced entities.

    entities_col holds (type, mention, surrogate) in order of the text, an empty array where
    nothing was found; a column of that name in ``docs`` is replaced. Null texts stay null,
    and texts without entities stay as they are, byte for byte. Repeated rows stay repeated.
    Other columns are carried along untouched. The same key gives the same surrogates for
    the same set of entities.
    """
    scratch = Scratch(docs.sparkSession, "surrogates")
    kept = [c for c in docs.columns if c != entities_col]
    rid, found, bare = fresh("rid", kept), fresh("found", kept), fresh("bare", kept)
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    text = F.col(f"`{text_col}`").cast("string")
    marked = docs.withColumn(found, _mentions(text))
    held = marked.filter(F.size(found) > 0).withColumn(bare, _surnames(F.col(found)))
    held = held.withColumn(found, F.when(F.size(bare) == 0, F.col(found)).otherwise(F.regexp_extract_all(text, _pattern(F.col(bare)), F.lit(0))))
    held = scratch.save(held.withColumn(rid, F.monotonically_increasing_id()), "held")
    rest = marked.filter(F.size(found) == 0).drop(found)

    rows = held.select(F.col(rid).alias("rid"), F.col(bare).alias("bare"), F.posexplode(found).alias("pos", "mention"))
    rows = rows.withColumn("type", F.when(F.array_contains("bare", F.col("mention")), "name").otherwise(_type(F.col("mention")))).withColumn("parts", _parts(F.col("type"), F.col("mention")))
    entities = scratch.save(rows.select(F.explode("parts").alias("e")).select("e.type", "e.canon").distinct(), "entities")
    assigned = scratch.save(_assigned(entities, key, scratch), "assigned")
    # Distinct mentions are rendered once; then each document gets its own back.
    distinct = rows.select("type", "mention", "parts").distinct()
    for i, name in enumerate(("first", "second")):
        part = F.get("parts", i)
        one = assigned.select(F.col("type").alias(f"t{i}"), F.col("canon").alias(f"c{i}"), F.col("surrogate").alias(name))
        distinct = distinct.join(one, (part["type"] == F.col(f"t{i}")) & (part["canon"] == F.col(f"c{i}")), "left").drop(f"t{i}", f"c{i}")
    distinct = distinct.withColumn("surrogate", _rendered(F.col("type"), F.col("mention"), F.col("first"), F.col("second"))).select("type", "mention", "surrogate")
    swapped = rows.select("rid", "pos", "type", "mention").join(scratch.save(distinct, "mentions"), ["type", "mention"])
    swapped = swapped.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "mention", "surrogate"))).alias("swapped"))
    swapped = swapped.select(F.col("rid").alias(rid), F.transform("swapped", lambda x: F.struct(x["type"].alias("type"), x["mention"].alias("mention"), x["surrogate"].alias("surrogate"))).alias(found))
    gaps = F.split(text, _pattern(F.col(bare)), -1)
    new = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(f"{found}.surrogate"), i), F.lit("")))), "")
    held = held.drop(found).join(swapped, rid).withColumn(text_col, new).select(*[F.col(f"`{c}`") for c in kept], F.col(found).alias(entities_col))
    none = F.array().cast("array<struct<type:string,mention:string,surrogate:string>>")
    return held.unionByName(rest.withColumn(entities_col, none))
