"""The queries of this subpackage and their SQL, by name."""

from importlib import import_module

MODULES = ("exact_dedup", "substring", "toxicity", "bpe", "mixing", "quality", "url_filter", "lm_score", "ann", "ngram_join", "filter_audit", "language_id", "prefix_trie")


def queries() -> dict:
    out = {}
    for name in MODULES:
        module = import_module(f".{name}", __package__)
        out |= {k: getattr(module, k) for k in vars(module) if k.startswith("op") and k.partition("_")[0][2:].isdigit()}
    return dict(sorted(out.items(), key=lambda x: int(x[0].partition("_")[0][2:])))


def oracle_sql() -> dict:
    return {k: v for name in MODULES for k, v in import_module(f".{name}", __package__).SQL.items()}
