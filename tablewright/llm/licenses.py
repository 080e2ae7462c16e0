"""License scans: signature rules behind keywords, with suppression of what others contain.

Everything is one projection of built-in functions.  A text is searched for
any keyword first; only texts that have one are cut into words.  At every
keyword its own rules are tried on the next few words, so the work on a text
grows with its keywords and not with texts x rules.  Findings are then sorted
by where they start, longest first, and one pass keeps, for each priority, how
far the findings of that priority or above reach: a finding that ends within
that reach is contained in a better one and is suppressed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append
from tablewright.llm.license_rules import BASE, CONFIDENCE, MOST_WORDS, Rule, gate, rules

# Fixed value: what parts words, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Findings collected before they join the longer list, so that appending stays cheap.
CHUNK = 256
FINDING = "struct<first_word:int,last_word:int,label:string,priority:int,rule:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rule_table(known: list[Rule]) -> Column:
    """Keyword to its rules, as one constant."""
    by_keyword: dict[str, list[str]] = {}
    for n, rule in enumerate(known):
        entry = f"named_struct('rule', {n}, 'priority', {rule.priority}, 'label', '{rule.label}', 'expression', '^(?:{rule.expression})(?= |$)')"
        by_keyword.setdefault(rule.keyword, []).append(entry)
    return F.expr("map(" + ", ".join(f"'{k}', array({', '.join(v)})" for k, v in by_keyword.items()) + ")")


def _words(text: Column) -> Column:
    spaced = F.regexp_replace(F.translate(text, UPPER, LOWER), BETWEEN + "++", " ")
    return F.split(F.trim(spaced), " ")


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty.  Each word becomes one letter, the last one is added for the end."""
    either = BETWEEN.replace(r"\x60", r"\x40\x5B-\x60")
    shrunk = F.regexp_replace(F.concat(text, F.lit(" w")), f"{either}*+[^{either[1:-1]}]++", "w")
    return F.coalesce(F.length(shrunk) - 1, F.lit(0)).cast("long")


def _found(words: Column, known: list[Rule]) -> Column:
    """Findings of all rules: struct(first, -last, -priority, rule, label), sorted."""
    table, keywords = _rule_table(known), sorted({r.keyword for r in known})
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(keywords), i)), lambda i: i.isNotNull())

    def tried(i: Column) -> Column:
        def at(window: Column) -> Column:
            def one(rule: Column) -> Column:
                def ended(match: Column) -> Column:
                    last = i + F.length(match) - F.length(F.replace(match, F.lit(" "), F.lit("")))
                    return F.when(match != "", F.struct(
                        i.alias("first"), (-last).alias("last"), (-rule["priority"]).alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label")
                    ))

                return let(F.call_function("regexp_extract", window, rule["expression"], F.lit(0)), ended)

            return F.transform(F.element_at(table, F.get(words, i)), one)

        return let(F.array_join(F.slice(words, i + 1, MOST_WORDS), " "), at)

    return F.array_sort(F.filter(F.flatten(F.transform(places, tried)), lambda f: f.isNotNull()))


def _uncontained(found: Column) -> Column:
    """The findings that no better finding contains, in order."""
    levels = len(CONFIDENCE)
    shape = f"struct<reach:array<int>,chunk:array<{FINDING}>,full:array<array<{FINDING}>>>"

    def step(state: Column, f: Column) -> Column:
        priority, last = -f["priority"], -f["last"]
        finding = F.struct(f["first"].alias("first_word"), last.alias("last_word"), f["label"].alias("label"), priority.alias("priority"), f["rule"].alias("rule"))
        reach = F.transform(state["reach"], lambda end, level: F.when(level <= priority, F.greatest(end, last)).otherwise(end))
        held = F.when(F.get(state["reach"], priority) >= last, state["chunk"]).otherwise(F.concat(state["chunk"], F.array(finding)))
        spill = F.size(state["chunk"]) >= CHUNK
        kept = F.struct(reach.alias("reach"), held.alias("chunk"), state["full"].alias("full"))
        moved = F.struct(
            reach.alias("reach"),
            F.when(F.get(state["reach"], priority) >= last, F.expr(f"cast(array() as array<{FINDING}>)")).otherwise(F.array(finding)).alias("chunk"),
            F.concat(state["full"], F.array(state["chunk"])).alias("full"),
        )
        return F.when(spill, moved.cast(shape)).otherwise(kept.cast(shape))

    start = F.expr(f"cast(named_struct('reach', array_repeat(-1, {levels}), 'chunk', array(), 'full', array()) as {shape})")
    return F.aggregate(found, start, step, lambda state: F.concat(F.flatten(state["full"]), state["chunk"]))


def scan_licenses(df: DataFrame, text: str = "text", name: str = "licenses", known: list[Rule] | None = None) -> DataFrame:
    """Add a struct with the licenses that every whole text names.

    ``n_words`` counts words; ``base`` are the places of the base phrases,
    overlapping ones included; ``found`` are the findings of all other rules
    that no finding of higher priority, of the same priority and longer, or of
    an earlier rule at the same place contains.  A finding has its first and
    last word (from 0), label, priority and rule number; ``score`` is
    1 - product(1 - confidence) over all findings, 0 without any.

    Null and empty texts have no words and no findings.  Rows are independent:
    repeated rows repeat their result, an empty table gives an empty one, and
    an input column called ``name`` gives way.
    """
    known = rules() if known is None else known
    words_in = F.col(text).cast("string")

    def scanned(words: Column) -> Column:
        def split(found: Column) -> Column:
            base = F.filter(found, lambda f: f["priority"] == -BASE)
            base = F.transform(base, lambda f: F.struct(
                f["first"].alias("first_word"), (-f["last"]).alias("last_word"), f["label"].alias("label"), (-f["priority"]).alias("priority"), f["rule"].alias("rule")
            ))
            return F.struct(base.alias("base"), _uncontained(F.filter(found, lambda f: f["priority"] < -BASE)).alias("found"))

        return let(_found(words, known), split)

    nothing = F.expr(f"cast(named_struct('base', array(), 'found', array()) as struct<base:array<{FINDING}>,found:array<{FINDING}>>)")
    held = F.when(words_in.rlike(gate(sorted({r.keyword for r in known}))), let(_words(words_in), scanned)).otherwise(nothing)

    def result(found: Column) -> Column:
        missed = F.aggregate(F.concat(found["base"], found["found"]), F.lit(1.0), lambda p, f: p * (1 - F.get(F.array(*map(F.lit, CONFIDENCE)), f["priority"])))
        return F.struct(n_words(words_in).alias("n_words"), found["base"].alias("base"), found["found"].alias("found"), (1 - missed).alias("score"))

    return append(df, **{name: let(F.coalesce(held, nothing), result)})


def label_list(findings: Column) -> Column:
    """Distinct labels, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(findings, lambda f: f["label"]))), ",")
