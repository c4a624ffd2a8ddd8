"""Extractors: source text of one file to function records and call sites.

Each language module offers ``functions(path, text)`` and works on the shared token stream, so a file that
doesn't parse as a whole still gives the declarations that can be read."""

from __future__ import annotations

from graphloom.extract import golang, java, python, typescript
from graphloom.extract.calls import call_sites
from graphloom.extract.imports import import_keys
from graphloom.extract.tokens import tokenize

LANGUAGES = {"go": golang, "python": python, "java": java, "typescript": typescript}


def extract(path: str, language: str, text: str, strict_parity: bool = False) -> tuple[list[dict], list[dict]]:
    """(function records, call sites) of one file."""
    records, calls, _ = extract_all(path, language, text, strict_parity)
    return records, calls


def extract_all(path: str, language: str, text: str, strict_parity: bool = False) -> tuple[list[dict], list[dict], list[str]]:
    """(function records, call sites, import keys) of one file."""
    tokens = tokenize(text, language)
    records = LANGUAGES[language].functions(path, text, tokens)
    for i, r in enumerate(records):
        r["ordinal"] = i
    return records, call_sites(tokens, language, strict_parity), import_keys(tokens, path, language)
