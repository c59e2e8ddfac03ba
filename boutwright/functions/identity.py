"""Stable ids, identity and fight keys, organisations, methods and labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import canonical, normalise

#: Labels of the tracked organisation, and beginnings of tracked events that are not its own.
TRACKED_LABELS = ("ufc", "ultimate fighting championship", "dana white's contender series", "dana whites contender series", "road to ufc")
OTHER_EVENTS = ("strikeforce", "wec ", "pride", "meca ", "elitexc", "cage rage", "dream ", "shooto", "affliction", "rotr ", "gladiator fc")
#: Words for missing.
MISSING = ("", "nan", "none", "nat", "<na>")


def present(s: Column) -> Column:
    """Trimmed text, null where it says that it is missing."""
    t = F.trim(s.cast("string"))
    return F.when(~F.lower(t).isin(*MISSING), t)


def squeezed(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def stable_id(s: Column) -> Column:
    """16 hexadecimal digits that stand alone, or end a profile link on any site path ``.../fighter-details/<id>``."""
    got = F.regexp_extract(F.lower(F.trim(s.cast("string"))), r"^(?:(?:(?:https?://)?[a-z0-9.-]+/|/)?fighter-details/)?([0-9a-f]{16})(?:/?(?:[?#]\S*)?)$", 1)
    return F.when(F.length(got) > 0, got)


def identity_key(name: Column, ref: Column, ambiguous: Column) -> Column:
    """id:<id> for a name that several people share (null without an id), else name:<normalised name>; ``ambiguous`` says whether the canonical name is shared."""
    key, own = normalise(name), stable_id(ref)
    return F.when(F.length(key) == 0, None).when(ambiguous, F.concat(F.lit("id:"), own)).otherwise(F.concat(F.lit("name:"), key))


def canonical_key(name: Column) -> Column:
    return canonical(name)


def pair_key(a: Column, b: Column) -> Column:
    x, y = normalise(a), normalise(b)
    return F.concat_ws("__", F.least(x, y), F.greatest(x, y))


def fight_key(a: Column, b: Column, day: Column) -> Column:
    """<lesser>__<larger>__<day>; empty where a name or the day is missing."""
    ok = (F.length(normalise(a)) > 0) & (F.length(normalise(b)) > 0) & day.isNotNull()
    return F.when(ok, F.concat_ws("__", pair_key(a, b), F.date_format(day, "yyyy-MM-dd"))).otherwise("")


def shifted_key(key: Column, days: Column) -> Column:
    """The same pair with its day moved; empty for anything that is no such key."""
    day = F.try_to_timestamp(F.regexp_extract(key, r"^.*__(\d{4}-\d{2}-\d{2})$", 1)).cast("date")
    return F.coalesce(F.concat(F.regexp_extract(key, r"^(.*__)[^_]*$", 1), F.date_format(F.date_add(day, days), "yyyy-MM-dd")), F.lit(""))


def event_or_pair_key(event: Column, start: Column, a: Column, b: Column) -> Column:
    """event::<id> where the event has one, else <start>::<pair>."""
    when = F.coalesce(F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("unknown"))
    return F.when(present(event).isNotNull(), F.concat(F.lit("event::"), F.trim(event.cast("string")))).otherwise(F.concat(when, F.lit("::"), pair_key(a, b)))


#: Words that a name in front of "wins by ..." may not hold.
STOP = "wins|win|by|or|and|round|rounds|inside|within|in|not|points|distance|goes|go|the|to"


def method_label(text: Column, strict: bool = False) -> Column:
    """ko, sub or dec of a price label.

    Strict takes only ``<name> [wins] by <method>``; loose also looks for keywords.
    """
    word = rf"(?!\b(?:{STOP})\b)\S+"
    exact = F.lower(F.regexp_extract(F.trim(text), rf"(?i)^(?!not\s)(?:{word}\s+)*{word}\s+(?:wins\s+)?by\s+(tko/?ko|ko/?tko|knockout|submission|decision)\s*$", 1))
    out = F.when(exact.contains("ko") | exact.contains("knockout"), "ko").when(exact.contains("sub"), "sub").when(exact.contains("dec"), "dec")
    if strict:
        return out
    plain = normalise(text)
    return F.coalesce(out, F.when(plain.rlike(r"\b(?:t?ko|knockout|stoppage)\b"), "ko").when(plain.rlike(r"\bsub(?:mission)?\b"), "sub").when(plain.rlike(r"\b(?:decision|points)\b"), "dec"))


def named_side(text: Column, a: Column, b: Column) -> Column:
    """The side that a text names: by whole name, else by a surname that the other side does not share."""

    def holds(name: Column) -> Column:
        return F.concat(F.lit(" "), normalise(text), F.lit(" ")).contains(F.concat(F.lit(" "), name, F.lit(" "))) & (F.length(name) > 0)

    def one(x: Column, y: Column) -> Column:
        return F.when(x & ~y, "a").when(y & ~x, "b")

    last_a, last_b = (F.element_at(F.split(normalise(n), " "), -1) for n in (a, b))
    return F.coalesce(one(holds(normalise(a)), holds(normalise(b))), F.when(last_a != last_b, one(holds(last_a), holds(last_b))))


#: Hold names that mean a submission.
HOLDS = ("choke", "armbar", "triangle", "kimura", "guillotine", "americana", "kneebar", "heel hook", "ankle lock")


def canonical_method(method: Column) -> Column:
    """KO/TKO, SUB, U-DEC, S-DEC, M-DEC, Overturned, Draw or DQ; an unknown method stays as it is."""
    m = F.lower(F.trim(method))
    sub = m.contains("submission") | m.rlike(r"\bsub\b")
    for h in HOLDS:
        sub = sub | m.contains(h)
    dec = F.when(m.contains("unanimous"), "U-DEC").when(m.contains("split"), "S-DEC").when(m.contains("majority"), "M-DEC").otherwise("U-DEC")
    return (
        F.when(m.contains("tko") | m.contains("knockout") | m.rlike(r"\bk\.?o\b"), "KO/TKO").when(sub, "SUB").when(m.contains("decision") | m.rlike(r"\bdec\b"), dec)
        .when(m.contains("no contest") | m.rlike(r"\bnc\b"), "Overturned").when(m.contains("draw"), "Draw").when(m.contains("dq") | m.contains("disqualification"), "DQ").otherwise(method)
    )


def organisation(event: Column, known: dict[str, str] | None = None) -> Column:
    """Promotion of an event title: what stands before " - " (else ": "), without its number; ``known`` maps patterns to names."""
    t = F.trim(F.coalesce(event, F.lit("")))
    dash = F.contains(t, F.lit(" - "))
    head = F.trim(F.when(dash, F.split_part(t, F.lit(" - "), F.lit(1))).otherwise(F.split_part(t, F.lit(": "), F.lit(1))))
    head = F.regexp_replace(F.trim(F.regexp_replace(head, r"\s+\d+[A-Za-z]*$", "")), r"\s{2,}", " ")
    out = head
    for pattern, name in reversed(list((known or {}).items())):
        out = F.when(head.rlike(pattern), name).otherwise(out)
    return out


def is_tracked(org: Column) -> Column:
    """Exactly the tracked organisation, spaces and case aside."""
    return F.coalesce(squeezed(F.translate(org, "’", "'")).isin(*TRACKED_LABELS), F.lit(False))


def is_other_event(event: Column) -> Column:
    """Whether a tracked event's name begins like one of another promotion."""
    label, out = squeezed(event), F.lit(False)
    for p in OTHER_EVENTS:
        out = out | label.startswith(p)
    return F.coalesce(out, F.lit(False))


def organisation_tier(org: Column, day: Column, major: tuple[str, ...], feeder: tuple[str, ...], scoped: dict[str, tuple[str, str, float]] | None = None) -> Column:
    """1 major, 2 feeder, 3 any other, null unknown; a ``scoped`` label has its tier only between its days."""
    name = F.lower(F.trim(org))
    out = F.when(F.length(F.coalesce(name, F.lit(""))) == 0, None).when(name.isin(*major), 1.0).when(name.isin(*feeder), 2.0)
    for label, (start, end, tier) in (scoped or {}).items():
        out = out.when((name == label) & day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), tier)
    return out.otherwise(3.0)


def class_key(label: Column, aliases: dict[str, str]) -> Column:
    """Canonical weight class: an exact alias, else the longest alias that the label holds, else the label in lower case."""
    raw = F.trim(F.lower(F.coalesce(label, F.lit(""))))
    plain = normalise(raw)
    out = None
    for test in (lambda k: raw == k, lambda k: plain == k):
        for k, v in aliases.items():
            out = F.when(test(k), v) if out is None else out.when(test(k), v)
    for k in sorted(aliases, key=len, reverse=True):
        out = out.when(raw.contains(k) | plain.contains(k), aliases[k])
    return out.otherwise(raw)


def change_id(cols: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with sorted keys and no spaces; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)]), {"ignoreNullFields": "false"}), 256)


def signal_features(flags: Column, a: Column, b: Column) -> Column:
    """Struct of missed-weight marks and flag counts of both sides, from an array of flag texts."""
    all_ = F.array_join(flags, " ")
    missed = lambda n: F.coalesce((F.length(n) > 0) & F.contains(all_, F.concat(n, F.lit(" missed weight"))), F.lit(False)).cast("int")
    count = lambda n: F.size(F.filter(flags, lambda f: F.contains(F.lower(f), F.lower(n))))
    return F.struct(missed(a).alias("a_missed_weight"), missed(b).alias("b_missed_weight"), count(a).alias("a_num_flags"), count(b).alias("b_num_flags"))
