"""Skill tagging and title classification (K1-K4, K5/K7 as expressions, K8)."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import vocabulary as V
from postmill.functions.text import SPACE, WORD_END, WORD_START, let, trim_all

_PLAIN = re.compile(r"[a-z0-9_]+\Z")


def _first_tokens(phrase: str) -> set[str]:
    """Tokens one of which a text must hold for the phrase to occur: "a b c" -> a, ab, abc."""
    words = phrase.split(" ")
    joined = {"".join(words[: i + 1]) for i in range(len(words))}
    return {re.findall(r"[a-z0-9_]+", j)[0] for j in joined}


def _rule(skill: V.Skill) -> tuple[list[str], list[str], list[str], list[str]]:
    """(plain words, gate tokens, gate stems, regexes) of one tagging rule."""
    phrases = skill.words + skill.tags
    plain = [p for p in phrases if _PLAIN.match(p)]
    spaced = [p for p in phrases if not _PLAIN.match(p)]
    tokens = set().union(*[_first_tokens(p) for p in spaced], {word for word, _ in skill.unless})
    regexes = [V.phrase_regex(p) for p in spaced]
    regexes += [rf"\b{word}\b(?!{after})" for word, after in skill.unless]
    regexes += [regex for _, regex in skill.regexes]
    return plain, sorted(tokens), [stem for stem, _ in skill.regexes], regexes


_RULES = [(s.name, *_rule(s)) for s in V.SKILLS]
_GATES = sorted({t for _, _, tokens, _, _ in _RULES for t in tokens})
_TRIGGERS = sorted({t for _, plain, tokens, _, _ in _RULES for t in plain + tokens})
# Written as SQL so that a plan is built with one call rather than one per word.
_IS_TRIGGER = "w -> w IN ('" + "', '".join(_TRIGGERS) + "')"
_IS_GATE = "w -> w IN ('" + "', '".join(_GATES) + "')"
_STEMS = sorted({t for _, _, _, stems, _ in _RULES for t in stems})
_RULES_JSON = json.dumps(
    [
        {"name": name, "words": plain, "gates": tokens, "stems": stems, "regex": "|".join(regexes) or None}
        for name, plain, tokens, stems, regexes in _RULES
    ]
)


def _literal(text: str, schema: str) -> Column:
    """A table as one literal (the optimizer folds the constant), however many entries it has."""
    return F.from_json(F.lit(text), schema)


def fold_for_tags(text: Column) -> Column:
    """Lower case, everything but ASCII words, white space and ``. + # -`` blanked.

    Written with a look-ahead because it runs several times faster than the negated class.
    """
    return F.regexp_replace(F.lower(text), r"(?![\s.+#-])\W", " ")


def extract_skills(text: Column) -> Column:
    """K1: names of the skills a text mentions, in vocabulary order.

    The text is split into words once; one hash-set filter keeps the few words any rule
    starts with. Single-word rules are decided on those. Only a text that holds a possible
    first word of a phrase is folded, and only that phrase's regular expression runs.
    """
    nothing = F.array().cast("array<string>")
    rules = _literal(
        _RULES_JSON, "array<struct<name:string,words:array<string>,gates:array<string>,stems:array<string>,regex:string>>"
    )

    def holds(rule: Column, folded: Column, hits: Column) -> Column:
        gate = F.arrays_overlap(hits, rule["gates"]) | F.exists(rule["stems"], lambda s: F.contains(folded, s))
        return F.arrays_overlap(hits, rule["words"]) | (gate & F.rlike(folded, rule["regex"]))

    def with_hits(lower: Column) -> Column:
        numbered = reduce(or_, [F.contains(lower, F.lit(s)) for s in _STEMS])
        words = F.array_distinct(F.call_function("filter", F.split(lower, r"\W+"), F.expr(_IS_TRIGGER)))

        def decide(hits: Column) -> Column:
            # Without a phrase to look for the folded text is null, and so is every test on it.
            phrases = numbered | F.call_function("exists", hits, F.expr(_IS_GATE))
            tags = lambda c: F.transform(F.filter(rules, lambda r: holds(r, c, hits)), lambda r: r["name"])
            found = let(F.when(phrases, fold_for_tags(lower)), tags)
            return F.when((F.size(hits) > 0) | numbered, F.array_distinct(found)).otherwise(nothing)

        return let(words, decide)

    return let(F.lower(F.coalesce(text, F.lit(""))), with_hits)


def extract_skills_plain(text: Column) -> Column:
    """K1 with every regular expression run on every text: slow, kept to check the gated form."""

    def tag(clean: Column) -> Column:
        tags = []
        for name, plain, _, _, regexes in _RULES:
            alternatives = [V.phrase_regex(p) for p in plain] + regexes
            tags.append(F.when(clean.rlike("|".join(alternatives)), F.lit(name)))
        return F.array_distinct(F.array_compact(F.array(*tags)))

    return let(fold_for_tags(F.coalesce(text, F.lit(""))), tag)


def union_skills(*lists: Column) -> Column:
    """Set union in first-seen order."""
    return F.array_distinct(F.concat(*lists))


def _map_literal(table: Mapping[str, str]) -> Column:
    return _literal(json.dumps(dict(table)), "map<string,string>")


def normalize_skill(skill: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """K2: canonical name of a spelling, or the trimmed spelling itself."""
    table = _map_literal(aliases if aliases is not None else V.alias_dictionary())
    return let(trim_all(skill), lambda s: F.coalesce(F.try_element_at(table, F.lower(s)), s))


def normalize_skills(skills: Column, aliases: Mapping[str, str] | None = None) -> Column:
    table = _map_literal(aliases if aliases is not None else V.alias_dictionary())
    return F.transform(
        F.transform(skills, trim_all), lambda s: F.coalesce(F.try_element_at(table, F.lower(s)), s)
    )


def fold_title(title: Column) -> Column:
    """Lower-case title with all white space as plain blanks."""
    return F.regexp_replace(F.lower(title), SPACE, " ")


_EDGES = (WORD_START, WORD_END)


def _any_of(phrases: tuple[str, ...]) -> str:
    return "|".join(V.phrase_regex(p, literal=False, edges=_EDGES) for p in phrases)


_SENIOR = _any_of(V.SENIOR_MARKERS)
_JUNIOR = _any_of(V.JUNIOR_MARKERS)


def _role_regex(role: V.Role) -> str:
    parts = [_any_of(role.phrases)]
    for phrase, words in role.followed:
        parts.append(V.phrase_regex(phrase, literal=False, edges=_EDGES) + rf"\s*(?:{'|'.join(words)})")
    for phrase, words in role.unless:
        parts.append(V.phrase_regex(phrase, literal=False, edges=_EDGES) + rf"(?!\s*(?:{'|'.join(words)}))")
    return "|".join(parts)


_ROLE_REGEX = [(r.name, _role_regex(r)) for r in V.ROLES]


def detect_seniority(title: Column) -> Column:
    """K3: senior beats junior; mid when the title says neither."""
    return let(
        fold_title(title),
        lambda t: F.when(t.rlike(_SENIOR), "senior").when(t.rlike(_JUNIOR), "junior").otherwise("mid"),
    )


def detect_roles(title: Column) -> Column:
    """K4: every role whose rules a title meets, in dictionary order."""
    return let(
        fold_title(title),
        lambda t: F.array_compact(F.array(*[F.when(t.rlike(regex), F.lit(name)) for name, regex in _ROLE_REGEX])),
    )


def implied_for_roles(
    roles: Column,
    level: Column,
    role_skills: V.RoleSkills = V.ROLE_SKILLS,
    aliases: Mapping[str, str] | None = None,
) -> Column:
    """K5 for every role of a title: canonical implied skills, one role after the other.

    Level accumulation and alias look-up happen while the (small, fixed) dictionary is
    turned into a literal, so a row costs one look-up per role.
    """
    aliases = aliases if aliases is not None else V.alias_dictionary()
    nothing = F.array().cast("array<string>")
    lists = {
        f"{role}|{lv}": [V.normalize(n, aliases) for n in V.implied(role, lv, role_skills)]
        for role in role_skills
        for lv in V.LEVELS
    }
    table = _literal(json.dumps(lists), "map<string,array<string>>")
    key = lambda r: F.concat(r, F.lit("|"), level)
    return F.flatten(F.transform(roles, lambda r: F.coalesce(F.try_element_at(table, key(r)), nothing)))


def enhance_skills(
    title: Column,
    extracted: Column,
    role_skills: V.RoleSkills = V.ROLE_SKILLS,
    aliases: Mapping[str, str] | None = None,
) -> Column:
    """K7: struct<extracted, implied, final, roles, seniority>; final keeps first-seen order."""
    aliases = aliases if aliases is not None else V.alias_dictionary()

    def build(found: Column) -> Column:
        implied = implied_for_roles(found["roles"], found["seniority"], role_skills, aliases)
        return let(
            F.struct(normalize_skills(extracted, aliases).alias("extracted"), implied.alias("implied")),
            lambda s: F.struct(
                s["extracted"].alias("extracted"),
                s["implied"].alias("implied"),
                union_skills(s["extracted"], s["implied"]).alias("final"),
                found["roles"].alias("roles"),
                found["seniority"].alias("seniority"),
            ),
        )

    return let(F.struct(detect_roles(title).alias("roles"), detect_seniority(title).alias("seniority")), build)


def merge_skills_ci(skills: Column) -> Column:
    """K8: distinct without regard to case, the first spelling kept."""
    empty = F.array().cast("array<string>")
    return F.aggregate(
        skills,
        empty,
        lambda kept, s: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(s)), kept).otherwise(
            F.array_append(kept, s)
        ),
    )
