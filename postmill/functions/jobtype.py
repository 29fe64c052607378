"""Employment type and the location clean-up that depends on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import SPACE, WORD_END, WORD_START, clean_text, let

# Names of employment types in the store and in postings.
TO_STORE = {
    "full-time": "FULL_TIME",
    "full time": "FULL_TIME",
    "part-time": "PART_TIME",
    "part time": "PART_TIME",
    "contract": "CONTRACT",
    "freelance": "FREELANCE",
    "internship": "INTERNSHIP",
    "remote": "FULL_TIME",
}
FROM_STORE = {
    "FULL_TIME": "full-time",
    "PART_TIME": "part-time",
    "CONTRACT": "contract",
    "FREELANCE": "contract",
    "INTERNSHIP": "internship",
}


def _words(*alternatives: str) -> str:
    return WORD_START + "(?:" + "|".join(a.replace(" ", f"{SPACE}+") for a in alternatives) + ")" + WORD_END


INTERN = _words("internship", "graduate role", "student position") + "|" + _words("intern") + f"(?!{SPACE}*ational)"
EXPERIENCED = _words(
    "senior", "staff", "lead", "principal", "architect", "manager", "director",
    f"years{SPACE}+(?:of{SPACE}+)?experience",
)


def job_type(text: Column) -> Column:
    """Employment type of a posting's whole text; the first rule that holds decides."""
    has = lambda t, *needles: F.greatest(*[F.contains(t, F.lit(n)) for n in needles], F.lit(False))

    def rules(t: Column) -> Column:
        # The substring tests are cheap and spare most texts the regular expressions.
        intern = has(t, "intern", "graduate", "student") & t.rlike(INTERN)
        return (
            F.when(intern, F.when(t.rlike(EXPERIENCED), "full-time").otherwise("internship"))
            .when(has(t, "contract", "freelance", "consultant"), "contract")
            .when(has(t, "part-time", "part time"), "part-time")
            .when(has(t, "remote", "work from home"), "remote")
            .otherwise("full-time")
        )

    return let(F.lower(text), rules)


def clean_location(location: Column, kind: Column) -> Column:
    """Remote postings lose the word "remote" and one leading separator."""
    clean = clean_text(location)
    bare = F.btrim(F.regexp_replace(clean, f"(?i){WORD_START}remote{WORD_END}", ""))
    bare = F.btrim(F.regexp_replace(bare, "^[,-]", ""))
    return F.when(kind == "remote", F.when(bare == "", "Remote").otherwise(bare)).otherwise(clean)


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def job_type_to_store(kind: Column) -> Column:
    """Type name in the store; remote, unknown and null become FULL_TIME."""
    return _lookup(F.lower(kind), TO_STORE, "FULL_TIME")


def job_type_from_store(kind: Column) -> Column:
    """The way back; unknown and null become full-time."""
    return _lookup(kind, FROM_STORE, "full-time")
