"""Personal data replaced by surrogates of the same type, with DataFrame functions alone.

Emails, IP addresses, payment cards, social security and phone numbers, and names after an honorific are
found by one pattern. A surrogate is drawn from a keyed hash of the entity: digits for digits and
letters for letters in the mention's own format, cards with a valid check digit, phones with their
country code, email domains alike for alike domains, given names of the same gender and script. The
entity, not its spelling, is the key (`+1 (555) 010-9999` and `+1 555 010 9999` are one number; a family name
is replaced alike with and without a given name), so coreference survives. Within a kind no two
entities share a surrogate and none equals an entity of the corpus: whoever draws a taken one
draws again, until all are apart. What `MAX_ATTEMPTS` rounds leave over, as its format is full or has nothing
to draw (`--@-.--`), draws in a longer one: a letter more in an address, a digit more in a number with each round.

Entities are made distinct before anything is joined; texts are keyed by a digest, so copies are decided
once; texts without personal data never leave their scan.

Edge cases: a null text stays null, an empty one empty; repeated rows and null doc_ids are kept and
rewritten each; an empty table gives no rows; overlong numbers that fit no pattern stay. All
columns of the documents are kept; `text` is rewritten and the columns n_<kind> are added (they
replace columns of the same names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import shared_folder, staged

KINDS = ("email", "ip", "card", "ssn", "phone", "name")

#: Rounds in the mention's own format. Of a format with half its values free, one entity in 10^9 is left after them.
MAX_ATTEMPTS = 30

# Honorifics by gender.
HONORIFICS = {
    "m": "Mr Sir Herr Monsieur Señor Sr Don Signor Господин",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Señora Sra Doña Signora Госпожа",
}

# Given names by gender and script, and syllables of family names by script.
GIVEN = {
    ("m", "latin"): "Adam Anton Bruno Carl Daniel David Emil Erik Felix Hugo Ivan Jonas Leo Lucas Marco Martin Max Noel Oscar Paul Robin Simon Tomas Victor",
    ("f", "latin"): "Alice Anna Bella Clara Diana Elena Emma Eva Flora Greta Helen Ida Julia Lara Lena Lucia Maria Marta Nina Olivia Paula Rosa Sara Vera",
    ("m", "cyrillic"): "Алексей Андрей Антон Борис Виктор Глеб Денис Иван Игорь Кирилл Лев Максим Никита Олег Павел Роман",
    ("f", "cyrillic"): "Алиса Анна Вера Галина Дарья Елена Ирина Ксения Лариса Мария Нина Ольга Полина Раиса София Юлия",
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga go ha he ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te to va ve vo",
    "cyrillic": "ба бе бо ва ве во га го да де до жа за зе ка ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ро са се со та те то",
}
ENDINGS = {"latin": "n r s nd l rt", "cyrillic": "н р с нд л рт"}

# Runs are possessive: what follows one is never part of it, so a failed try need not go back.
_TITLES = "|".join(w for words in HONORIFICS.values() for w in words.split())
_NAME = rf"(?<![\p{{L}}\d])(?:{_TITLES})\.? \p{{Lu}}\p{{L}}++(?: \p{{Lu}}\p{{L}}++)?"
MENTION = "|".join(
    (
        r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
        r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
        r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)",
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        r"(?<![\d+])\+\d{1,3}(?:[ .-]?(?:\(\d{1,5}\)|\d{2,5})){2,5}(?!\d)",
        r"(?<!\d)(?:\(\d{2,5}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
        _NAME,
    )
)


def mentions(text: Column) -> Column:
    """All mentions in order."""
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))


def kind_of(mention: Column) -> Column:
    digits = F.regexp_replace(mention, r"\D", "")
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(r"^\d[\d -]+$") & (F.length(digits) >= 13), "card")
        .when(mention.rlike(r"^\p{L}"), "name")
        .otherwise("phone")
    )


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _entities(mention: Column, kind: Column) -> Column:
    """Array of (kind, canon) a mention speaks of, in the order they are written back."""
    one = lambda k, canon: F.array(F.struct(k.alias("kind"), canon.alias("canon")))
    words = F.split(mention, " ")
    family = F.element_at(words, -1)
    title = F.regexp_replace(F.get(words, F.lit(0)), r"\.", "")
    gender = F.when(title.isin(HONORIFICS["m"].split()), "m").otherwise("f")
    given = F.get(words, F.lit(1))
    named = F.when(
        F.size(words) > 2,
        F.concat(
            one(F.concat_ws(".", F.lit("given"), gender, _script(given)), given), one(F.concat_ws(".", F.lit("family"), _script(family)), family)
        ),
    ).otherwise(one(F.concat_ws(".", F.lit("family"), _script(family)), family))
    plus = F.when(mention.startswith("+"), "+").otherwise("")
    canon = (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "ip", mention)
        .when(kind == "phone", F.concat(plus, F.regexp_replace(mention, r"\D", "")))
        .otherwise(F.regexp_replace(mention, r"\D", ""))
    )
    return F.when(kind == "name", named).otherwise(one(kind, canon))


def _stream(secret: str, what: Column, length: Column) -> Column:
    """Two hex digits of a keyed hash for each of `length` characters and some more."""
    block = lambda b: F.sha2(F.concat_ws("\x1f", F.lit(secret), what, b.cast("string")), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(length / 32).cast("int") + 1), block), "")


def _number(stream: Column, i: Column) -> Column:
    """The stream's i-th byte (from 1)."""
    return F.conv(F.substr(stream, 2 * i - 1, F.lit(2)), 16, 10).cast("int")


def _alike(value: Column, stream: Column, fixed: Column | None = None) -> Column:
    """Letters for letters and digits for digits, other characters and the first `fixed` as they are."""

    def draw(i: Column) -> Column:
        c, n = F.substr(value, i, F.lit(1)), _number(stream, i)
        new = (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(n % 26 + 97))
            .when(c.rlike("[A-Z]"), F.char(n % 26 + 65))
            .otherwise(c)
        )
        return new if fixed is None else F.when(i <= fixed, c).otherwise(new)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), draw), "")


def _checked(digits: Column) -> Column:
    """The digits with a last one that makes the card's checksum right."""
    n = F.length(digits)

    def weighed(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n - 1), weighed), F.lit(0), lambda a, x: a + x)
    return F.concat(F.substr(digits, F.lit(1), n - 1), F.pmod(-total, F.lit(10)).cast("string"))


def _pick(words: str, n: Column) -> Column:
    every = words.split()
    return F.get(F.array(*[F.lit(w) for w in every]), F.pmod(n, F.lit(len(every))))


def _drawn(secret: str, kind: Column, canon: Column, attempt: int, longer: int = 0) -> Column:
    """The surrogate of an entity at one attempt, `longer` letters or digits longer than the entity."""
    stream = _stream(secret, F.concat_ws("\x1f", kind, canon, F.lit(str(attempt))), F.length(canon) + longer)
    domain = F.substring_index(canon, "@", -1)
    host, top = F.regexp_replace(domain, r"\.[^.]+$", ""), F.regexp_extract(domain, r"(\.[^.]+)$", 1)
    local = F.substring_index(canon, "@", 1)
    email = F.concat(_alike(F.concat(local, F.lit("a" * longer)), stream), F.lit("@"), _alike(host, _stream(secret, F.concat(F.lit("domain"), domain), F.length(host))), top)
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_number(stream, i) % 254 + 1).cast("string")), ".")
    number = F.concat(canon, F.lit("0" * longer))
    code = F.when(canon.rlike(r"^\+[17]"), 2).when(canon.startswith("+"), 3).otherwise(0)
    out = (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", _checked(_alike(number, stream, F.lit(1))))
        .when(kind == "phone", _alike(number, stream, code))
    )
    for (gender, script), names in GIVEN.items():
        parts = [_pick(names, _number(stream, F.lit(i + 1))) for i in range(1 + attempt // 2)]
        out = out.when(kind == f"given.{gender}.{script}", F.concat_ws("-", *parts))
    for script, syllables in SYLLABLES.items():
        parts = [_pick(syllables, _number(stream, F.lit(i + 1))) for i in range(3 + attempt // 2)]
        out = out.when(kind == f"family.{script}", F.initcap(F.concat(*parts, _pick(ENDINGS[script], _number(stream, F.lit(20))))))
    return out.otherwise(_alike(number, stream))


def surrogate_table(entities: DataFrame, secret: str, folder: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon), all surrogates apart and new to the corpus.

    In each attempt the smallest entity that draws a free surrogate keeps it, the others draw again; after
    `max_attempts` in formats that grow with each further attempt, so that all find a free one.
    """
    entities = staged(entities.distinct(), folder, "entities")
    pending, done, attempt = entities, None, 0
    while done is None or not pending.isEmpty():
        longer = max(0, attempt - max_attempts + 1)
        drawn = pending.withColumn("surrogate", _drawn(secret, F.col("kind"), F.col("canon"), attempt, longer))
        drawn = staged(drawn, folder, f"drawn-{attempt}")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        taken = entities.select("kind", F.col("canon").alias("surrogate"))
        taken = taken if done is None else taken.union(done.select("kind", "surrogate"))
        kept = staged(first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "canon", "surrogate"), folder, f"kept-{attempt}")
        done = kept if done is None else done.union(kept)
        pending = staged(pending.join(kept, ["kind", "canon"], "left_anti"), folder, f"pending-{attempt}")
        attempt += 1
    return done


def _written(mention: Column, kind: Column, surrogates: Column) -> Column:
    """The mention in its own format with the surrogates of its entities; what a longer number has more comes last."""
    digits = F.regexp_replace(F.get(surrogates, F.lit(0)), r"\D", "")
    held = F.length(F.regexp_replace(mention, r"\D", ""))

    def put(i: Column) -> Column:
        c = F.substr(mention, i, F.lit(1))
        nth = F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), r"\D", ""))
        return F.when(c.rlike("[0-9]"), F.substr(digits, nth, F.lit(1))).otherwise(c)

    formatted = F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), put), "")
    formatted = F.concat(formatted, F.substr(digits, held + 1, F.length(digits)))
    return (
        F.when(kind == "name", F.concat_ws(" ", F.get(F.split(mention, " "), F.lit(0)), F.array_join(surrogates, " ")))
        .when(kind.isin("email", "ip"), F.get(surrogates, F.lit(0)))
        .otherwise(formatted)
    )


def replace_personal_data(docs: DataFrame, secret: str) -> DataFrame:
    """The documents with surrogates in their texts, and counts of the mentions of each kind."""
    folder = shared_folder(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    plain = docs.drop(*counts)
    held = plain.withColumn("_found", mentions(F.col("text")))
    none = plain.filter(F.coalesce(~F.col("text").rlike(MENTION), F.lit(True)))
    some = held.filter(F.col("text").rlike(MENTION)).withColumn("_key", F.md5("text"))
    texts = some.select("_key", F.posexplode("_found").alias("pos", "mention")).distinct()
    said = texts.withColumn("kind_", kind_of(F.col("mention")))
    said = said.withColumn("whole", _entities(F.col("mention"), F.col("kind_")))
    said = staged(said.select("_key", "pos", "mention", "kind_", F.posexplode("whole").alias("part", "e")).select("*", "e.*").drop("e"), folder, "mentions")
    table = staged(surrogate_table(said.select("kind", "canon"), secret, folder), folder, "surrogates")
    parts = said.join(table, ["kind", "canon"])
    whole = parts.groupBy("_key", "pos", "mention", "kind_").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "surrogate"))), lambda x: x["surrogate"]).alias("s")
    )
    new = whole.select("_key", "pos", "kind_", _written(F.col("mention"), F.col("kind_"), F.col("s")).alias("new"))
    by_text = staged(
        new.groupBy("_key").agg(
            F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("_new"),
            *[F.count(F.when(F.col("kind_") == k, 1)).alias(f"n_{k}") for k in KINDS],
        ),
        folder,
        "texts",
    )
    rest = F.split("text", MENTION, -1)
    woven = F.array_join(
        F.transform(rest, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("_new"), i)["new"], F.lit("")))), ""
    )
    rewritten = some.join(by_text, "_key").withColumn("text", woven).select(*plain.columns, *counts)
    return none.select(*plain.columns, *[F.lit(0).cast("long").alias(c) for c in counts]).union(rewritten)
