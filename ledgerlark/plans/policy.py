"""Policy and rules as plain data, and what is compiled from them at plan time."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path


@dataclass(frozen=True)
class Family:
    types: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    ignore_when_zero_amount: bool = False


#: Document types by family; the order counts.
FAMILIES = {
    "bank_anchor": Family(("bank-note", "bank-transfer", "bank-card-transaction"), aliases=("bank-anchor",)),
    "supplier_evidence": Family(
        ("invoice", "receipt", "invoice-receipt", "invoice-credit", "invoice-debit", "statement-receipt", "insurance-notice", "bank-fees"),
        ("invoice-", "receipt-"),
        ("supplier-evidence",),
        True,
    ),
    "tax_evidence": Family(prefixes=("tax-",), aliases=("tax-evidence",)),
    "payroll_evidence": Family(prefixes=("payroll-",), aliases=("payroll-evidence",)),
    "loan_evidence": Family(prefixes=("loan-",), aliases=("loan-evidence",)),
    "investment_evidence": Family(("bank-investment", "investment-acquisition-summary", "bank-stock-buy", "bank-stock-sell"), aliases=("investment-evidence",)),
    "contract_evidence": Family(("contract-signup",), aliases=("contract-evidence",)),
    "ignore": Family(("investment-key-information-document", "loan-simulation")),
}


@dataclass(frozen=True)
class Rule:
    """First fitting rule classifies a transaction; cardinalities are (least, most or None)."""

    name: str
    keywords: tuple[str, ...] = ()
    direction: str | None = None
    required: dict[str, tuple[int, int | None]] = field(default_factory=dict)
    shared: dict[str, str | None] = field(default_factory=dict)
    shared_filters: dict[str, dict[str, object]] = field(default_factory=dict)
    companions: tuple[str, ...] = ()
    pages: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def patterns(self) -> list[str]:
        return [*self.required, *self.shared]


#: The rules that hold where no others are given.
RULES = (
    Rule("default-credit", direction="credit", required={"bank-anchor": (1, None)}),
    Rule("supplier-payment", direction="debit", required={"bank-anchor": (1, 1), "supplier-evidence": (1, None)}, pages={"bank-anchor": (1,)}),
)


@dataclass(frozen=True)
class Policy:
    """The defaults are those of the bundled policy."""

    tolerance: float = 0.01
    window_days: int = 30
    country_prefix: str = "PT"
    families: dict[str, Family] = field(default_factory=lambda: dict(FAMILIES))
    rules: tuple[Rule, ...] = RULES
    bank_generated: tuple[str, ...] = ("bank-card-transaction", "bank-note", "bank-transfer", "bank-statement", "bank-investment")
    bank_scoped: tuple[str, ...] = ("bank-card-transaction", "bank-note")
    bank_aliases: dict[str, str] = field(default_factory=dict)
    strict_banks: tuple[str, ...] = ()
    bank_export_prefix: str = "BNC_"
    supporting_prefixes: tuple[str, ...] = ("CMP_", "DIV_")
    supporting_types: tuple[str, ...] = (
        "invoice",
        "receipt",
        "invoice-receipt",
        "invoice-credit",
        "invoice-debit",
        "invoice-order",
        "insurance-notice",
        "receipt-reference",
        "receipt-delivery",
    )
    bank_counterparties: tuple[str, ...] = ()
    counterparty_aliases: dict[str, str] = field(default_factory=dict)
    shared_keywords: dict[str, tuple[str, ...]] = field(default_factory=dict)
    shared_title_terms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    same_month_rules: tuple[str, ...] = ()
    shared_categories: tuple[str, ...] = ("supplier-payment",)
    supplier_exempt_rules: tuple[str, ...] = ("supplier-payment",)
    anchor_exempt_rules: tuple[str, ...] = ("supplier-payment",)
    pair_exempt_banks: tuple[str, ...] = ()
    evidence_categories: tuple[str, ...] = ("supplier-payment", "bank-fee")
    evidence_pattern: str = "invoice"
    evidence_skip_categories: tuple[str, ...] = ("supplier-payment", "bank-fee")
    amount_optional_categories: tuple[str, ...] = ("bank-fee",)
    line_item_aliases: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(
        default_factory=lambda: {"bank-fee": (("bank-fee",), ("bank-custody-fee",)), "bank-only": (("bank-transfer",), ()), "investment": (("stock-",), ())}
    )
    extractors: dict[str, dict] = field(default_factory=dict)

    def family_names(self, pattern: str) -> set[str]:
        """Families that a pattern names, by name or alias."""
        p = pattern.strip().lower()
        return {f for f, s in self.families.items() if p in {f, f.replace("_", "-"), *s.aliases}}


#: A pattern of this type also accepts these.
TYPE_ALIASES = {"bank-note": ("bank-card-transaction",)}

APPENDED = ("families", "line_item_aliases", "extractors")


def overlaid(base: Policy, overlay: dict) -> Policy:
    """``overlay`` over ``base``: maps are merged, those of families and line items by key, rules go first."""
    changes = {}
    for key, value in overlay.items():
        old = getattr(base, key)
        if key == "rules":
            value = (*value, *(old if overlay.get("keep_rules", True) else ()))
        elif isinstance(old, dict):
            value = {**old, **value}
        changes[key] = tuple(value) if isinstance(value, list) else value
    return replace(base, **{k: v for k, v in changes.items() if k != "keep_rules"})


def cardinality(value) -> tuple[int, int | None]:
    """n, [least, most] or [least, null]; all else leaves the number open."""
    if isinstance(value, int):
        return value, value
    if isinstance(value, list | tuple) and len(value) == 2:
        return int(value[0] or 0), None if value[1] is None else int(value[1])
    return 0, None


def from_yaml(path: str, base: Policy | None = None) -> Policy:
    """A policy file over ``base``; needs PyYAML."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    names = {
        "amount_tolerance": "tolerance",
        "date_window_days": "window_days",
        "tax_number_default_country_prefix": "country_prefix",
        "bank_generated_doc_types": "bank_generated",
        "statement_bank_scoped_doc_types": "bank_scoped",
        "statement_bank_issuer_aliases": "bank_aliases",
        "strict_statement_banks": "strict_banks",
        "supporting_export_prefixes": "supporting_prefixes",
        "supporting_doc_type_patterns": "supporting_types",
        "shared_period_transaction_keywords": "shared_keywords",
        "shared_period_title_terms": "shared_title_terms",
        "same_month_shared_rule_names": "same_month_rules",
        "shared_period_link_categories": "shared_categories",
        "evidence_counterparty_categories": "evidence_categories",
        "line_item_extractors": "extractors",
    }
    out = {}
    for key, value in raw.items():
        if key == "document_families":
            out["families"] = {k.replace("-", "_"): Family(*(tuple(v.get(x, ())) for x in ("types", "prefixes", "aliases")), v.get("ignore_when_zero_amount", False)) for k, v in value.items()}
        elif key == "rules":
            out["rules"] = [
                Rule(
                    r["name"],
                    tuple(r.get("match_description", ())),
                    r.get("direction"),
                    {k: cardinality(v) for k, v in r.get("required_types", {}).items()},
                    r.get("shared_types", {}),
                    r.get("shared_filters", {}),
                    tuple(r.get("companions", ())),
                    {k: tuple(v) if isinstance(v, list) else (v,) for k, v in r.get("expected_page_count", {}).items()},
                )
                for r in value
            ]
        elif hasattr(Policy, names.get(key, key)) or names.get(key, key) in Policy.__dataclass_fields__:
            out[names.get(key, key)] = value
        else:
            raise ValueError(f"unknown policy setting: {key}")
    return overlaid(base or Policy(), out)
