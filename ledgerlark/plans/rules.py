"""Rules compiled to Column expressions, once per plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN, compact_key, enum_value, slug, strip_diacritics
from ..functions.identifiers import tax_number
from .policy import TYPE_ALIASES, Policy, Rule

def false() -> Column:
    return F.lit(False)


def any_of(tests: list[Column]) -> Column:
    out = false()
    for t in tests:
        out = out | t
    return out


def resolved(pattern, profile: dict[str, str] | None):
    """``${profile.key}`` as its value; other patterns stay."""
    if isinstance(pattern, str) and pattern.startswith("${profile.") and pattern.endswith("}"):
        return (profile or {}).get(pattern[10:-1], pattern)
    return pattern


def value_matches(c: Column, pattern, kind: str = "string", profile: dict[str, str] | None = None) -> Column:
    """Whether a field fits a pattern; null never does.

    Booleans compare as booleans.  ``>= <= != > <`` compare numbers, and text
    that is no number fits none of them.  A trailing star is a prefix of the
    lower-cased text or of its slug.  Numbers compare as doubles, text
    lower-cased or as slugs.
    """
    pattern = resolved(pattern, profile)
    if kind == "boolean" or isinstance(pattern, bool):
        want = pattern if isinstance(pattern, bool) else {"true": True, "false": False}.get(str(pattern).lower())
        truth = c if kind == "boolean" else c.cast("string") != ""
        return false() if want is None else F.coalesce(truth == want, false())
    text, number = str(pattern), c.cast("string").try_cast("double")
    for op in (">=", "<=", "!=", ">", "<"):
        if text.startswith(op):
            try:
                limit = F.lit(float(text[len(op) :]))
            except ValueError:
                return false()
            test = {">=": number >= limit, "<=": number <= limit, "!=": number != limit, ">": number > limit, "<": number < limit}[op]
            return F.coalesce(test, false())
    low = F.lower(c.cast("string"))
    if text.endswith("*"):
        head = text[:-1].lower()
        return c.isNotNull() & F.coalesce(F.startswith(low, F.lit(head)) | F.startswith(slug(low), slug(F.lit(head))), false())
    if kind in ("int", "long", "double", "bigint"):
        try:
            return F.coalesce(number == F.lit(float(text)), false())
        except ValueError:
            return false()
    return c.isNotNull() & F.coalesce((low == text.lower()) | (slug(low) == slug(F.lit(text.lower()))), false())


def in_family(doc_type: Column, policy: Policy, family: str) -> Column:
    s = policy.families[family]
    return (doc_type != "") & any_of([doc_type.isin(*s.types)] * bool(s.types) + [F.startswith(doc_type, F.lit(p)) for p in s.prefixes])


def family_of(doc_type: Column, policy: Policy, amount: Column | None = None) -> Column:
    """Family of a type: ignored types first, then supplier papers over nothing, then policy order."""
    t = F.lower(F.btrim(enum_value(F.coalesce(doc_type, F.lit("")), "DocumentType")))
    out = F.lit("unknown")
    for name in reversed([f for f in policy.families if f != "ignore"]):
        out = F.when(in_family(t, policy, name), F.lit(name)).otherwise(out)
    supplier = policy.families.get("supplier_evidence")
    if amount is not None and supplier and supplier.ignore_when_zero_amount:
        zero = F.coalesce(amount.cast("string").try_cast("double") == 0, false())
        out = F.when(in_family(t, policy, "supplier_evidence") & zero, F.lit("ignore")).otherwise(out)
    return F.when(in_family(t, policy, "ignore"), F.lit("ignore")).otherwise(out) if "ignore" in policy.families else out


def type_matches(doc_type: Column, pattern: str, policy: Policy) -> Column:
    """``a|b*|family``: any alternative; an amount is not looked at."""
    low, tests = F.lower(doc_type), []
    for alt in (a.strip().lower() for a in pattern.split("|")):
        if alt.endswith("*"):
            tests.append(F.startswith(low, F.lit(alt[:-1])))
            continue
        names = policy.family_names(alt)
        if names:
            tests.append(family_of(low, policy).isin(*names))
        tests.append(low.isin(alt, *TYPE_ALIASES.get(alt, ())))
    return F.coalesce((doc_type != "") & any_of(tests), false())


def matches_any(doc_type: Column, patterns: Sequence[str], policy: Policy) -> Column:
    return any_of([type_matches(doc_type, p, policy) for p in patterns])


def rule_number(description: Column, amount: Column, rules: Sequence[Rule]) -> Column:
    """Number of the first rule that fits, else null.  Names may repeat, so the number counts.

    A credit is above zero; zero is a debit.  Keywords are upper-cased but keep
    their accents, the description loses them.
    """
    text = F.upper(strip_diacritics(F.coalesce(description, F.lit(""))))
    out = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules))):
        test = F.lit(True)
        if r.direction == "credit":
            test = test & (amount > 0)
        elif r.direction == "debit":
            test = test & (amount <= 0)
        if r.keywords:
            test = test & any_of([F.contains(text, F.lit(k.upper())) for k in r.keywords])
        out = F.when(test, F.lit(i)).otherwise(out)
    return out


def by_rule(number: Column, values: Sequence, otherwise=None) -> Column:
    out = F.lit(otherwise)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(number == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def rule_name(number: Column, rules: Sequence[Rule]) -> Column:
    return by_rule(number, [r.name for r in rules], "unclassified")


def allowed_by_rule(number: Column, doc_type: Column, policy: Policy) -> Column:
    return by_rule(number, [matches_any(doc_type, r.patterns(), policy) for r in policy.rules], False)


def export_prefix(tests: Sequence[tuple[dict[str, object], str]], kinds: dict[str, str], default: str = "", profile: dict[str, str] | None = None) -> Column:
    """Prefix of the first mapping of which all field tests hold; nested fields by dots."""
    out = F.lit(default)
    for match, prefix in reversed(list(tests)):
        test = F.lit(True)
        for key, pattern in match.items():
            test = test & value_matches(F.col(key), pattern, kinds.get(key, "string"), profile)
        out = F.when(test, F.lit(prefix)).otherwise(out)
    return out


def has_qrcode(qrcode: Column, sub_documents: Column) -> Column:
    return qrcode.isNotNull() | F.coalesce(F.exists(sub_documents, lambda s: s["qrcode"].isNotNull()), false())


def counterparty(tax: Column, party: Column, raw: Column, policy: Policy) -> Column:
    """Alias of any of the three, else the tax number, else a slug of the names."""
    tries = []
    if policy.counterparty_aliases:
        known = F.create_map(*[F.lit(x) for kv in policy.counterparty_aliases.items() for x in kv])
        tries += [F.element_at(known, compact_key(c)) for c in (tax, party, raw)]
    number = tax_number(tax, policy.country_prefix)
    tries.append(F.when(number != "", F.concat(F.lit("tax:"), number)))
    tries += [F.nullif(slug(c), F.lit("")) for c in (party, raw)]
    return F.coalesce(*tries, F.lit(UNKNOWN))


def shared_period_document(title: Column, raw_type: Column, family: Column, party: Column, policy: Policy) -> Column:
    """A supplier paper whose title has a term of its party, or a bank's term if the party is a bank."""
    text = F.concat_ws(" ", compact_key(title), compact_key(raw_type))
    tests = []
    for who, terms in policy.shared_title_terms.items():
        hit = any_of([F.contains(text, F.lit(t)) for t in terms])
        tests.append(hit & (party.isin(*policy.bank_counterparties) if who == "$bank" else party == who))
    return (family == "supplier_evidence") & any_of(tests)


def override_type(raw: Column, title: Column, overrides: Sequence[dict]) -> Column:
    """Type of the first override that fits: raw text equal, all tokens, any token."""
    tokens = F.regexp_extract_all(F.lower(F.concat_ws(" ", raw, title)), F.lit("([a-z0-9]+)"))
    out = F.lit(None).cast("string")
    for o in reversed(list(overrides)):
        tests = []
        if o.get("raw"):
            tests.append(F.lower(F.btrim(raw)).isin(*[x.lower() for x in o["raw"]]))
        if o.get("all"):
            tests.append(F.size(F.array_except(F.array(*[F.lit(x.lower()) for x in o["all"]]), tokens)) == 0)
        if o.get("any"):
            tests.append(F.arrays_overlap(F.array(*[F.lit(x.lower()) for x in o["any"]]), tokens))
        fit = F.lit(True)
        for t in tests:
            fit = fit & F.coalesce(t, false())
        out = F.when(fit if tests else false(), F.lit(o["type"])).otherwise(out)
    return out
