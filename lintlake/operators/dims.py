"""Fixed dimensions of scoring, and small helpers to use them as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of rules and severities, categories with their rules, weights and limits (good, average, poor).
RULE_WEIGHTS = {
    "terrible-naming": 0.2, "single-letter-variable": 1.5,
    "deep-nesting": 0.3, "long-function": 2.5, "cyclomatic-complexity": 3.5, "code-duplication": 0.4,
    "unwrap-abuse": 0.4, "unnecessary-clone": 0.3,
    "complex-closure": 0.3, "lifetime-abuse": 0.35, "trait-complexity": 0.35, "generic-abuse": 0.35,
    "channel-abuse": 0.4, "async-abuse": 0.4, "dyn-trait-abuse": 0.4, "unsafe-abuse": 0.5, "ffi-abuse": 0.6, "macro-abuse": 0.6,
    "module-complexity": 0.3, "pattern-matching-abuse": 0.3, "reference-abuse": 0.3, "box-abuse": 0.3, "slice-abuse": 0.4,
}
SEVERITY_WEIGHTS = {"Nuclear": 10.0, "Spicy": 5.0, "Mild": 2.0}
SHAME_WEIGHTS = {"Nuclear": 10.0, "Spicy": 3.0, "Mild": 1.0}
CATEGORIES = {
    "naming": (0.25, 2.0, 5.0, 10.0, ["terrible-naming", "single-letter-variable"]),
    "complexity": (0.20, 1.0, 3.0, 6.0, ["deep-nesting", "long-function", "cyclomatic-complexity"]),
    "duplication": (0.15, 0.5, 2.0, 4.0, ["code-duplication"]),
    "rust-basics": (0.15, 1.0, 3.0, 6.0, ["unwrap-abuse", "unnecessary-clone"]),
    "advanced-rust": (0.10, 0.5, 2.0, 4.0, ["complex-closure", "lifetime-abuse", "trait-complexity", "generic-abuse"]),
    "rust-features": (0.10, 0.5, 1.5, 3.0, ["channel-abuse", "async-abuse", "dyn-trait-abuse", "unsafe-abuse", "ffi-abuse", "macro-abuse"]),
    "structure": (0.05, 1.0, 3.0, 6.0, ["module-complexity", "pattern-matching-abuse", "reference-abuse", "box-abuse", "slice-abuse"]),
}
#: Families by what a rule's name contains, the first that fits.
FAMILIES = [
    ("Naming Issues", ["naming"]), ("Complexity Issues", ["complexity", "nesting", "function"]), ("Rust-specific Issues", ["unwrap", "panic", "string", "clone"]),
    ("Student Code Issues", ["println", "todo"]), ("Structure Issues", ["import", "file", "module"]), ("Code Smells", ["magic", "dead", "comment"]),
]


def lookup(column: Column, values: dict[str, float], default: float = 1.0) -> Column:
    """The value of a constant dictionary, a lookup join that needs no join."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[column], F.lit(default))


def category_of(rule: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (*_, rules) in CATEGORIES.items():
        out = F.when(rule.isin(rules), name).otherwise(out)
    return out


def family_of(rule: Column) -> Column:
    """The family of a rule name; Other Issues for names that fit none, and for null."""
    out = F.lit("Other Issues")
    for name, parts in reversed(FAMILIES):
        condition = rule.contains(parts[0])
        for part in parts[1:]:
            condition = condition | rule.contains(part)
        out = F.when(condition, name).otherwise(out)
    return out
