"""plans."""

from tessera.plans import chains, guardrails, lifecycle, registry, rules, search

__all__ = ["chains", "guardrails", "lifecycle", "registry", "rules", "search"]
